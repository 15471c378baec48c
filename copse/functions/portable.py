"""Randomness and codecs as column expressions that any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def draw(*parts) -> Column:
    """An integer in [0, 2**60) that depends on the parts only: the first 60 bits of the MD5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *map(_text, parts))), 1, 15), 16, 10).cast("long")


def uniform(*parts) -> Column:
    """:func:`draw` as a number in [0, 1)."""
    return draw(*parts) / F.lit(1152921504606846976.0)


def draw_sql(*parts: str) -> str:
    """DuckDB text of :func:`draw`; the parts are SQL expressions."""
    return "('0x' || substr(md5(concat_ws(':', " + ", ".join(parts) + ")), 1, 15))::BIGINT"


def int8_encode(value: Column, scale: float, zero: float = 0.0) -> Column:
    """Eight-bit code of a number: value over scale plus zero point, held within -128 to 127, without its fraction."""
    held = F.least(F.greatest(value / F.lit(float(scale)) + F.lit(float(zero)), F.lit(-128.0)), F.lit(127.0))
    return held.cast("int")


def int8_decode(code: Column, scale: float, zero: float = 0.0) -> Column:
    return (code - F.lit(float(zero))) * F.lit(float(scale))


def nf4_encode(value: Column) -> Column:
    """Four-bit linear code by sign and size: 0 to 7 for [0, 1], 8 to 15 for 0 down to -1; larger numbers as the end of their side."""
    size = F.least(F.floor(F.abs(value) * 7 + F.lit(0.5)), F.lit(7))
    return (size + F.when(value < 0, 8).otherwise(0)).cast("int")


def nf4_decode(code: Column) -> Column:
    return F.when(code >= 8, (8 - code) / F.lit(7.0)).otherwise(code / F.lit(7.0))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """An array of numbers scaled to length 1; a zero vector stays."""
    size = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(F.lit(0.0)))
