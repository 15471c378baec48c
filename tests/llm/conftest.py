from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly boil a pot of strange green soup near the old harbour"

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # columns whose names operators use inside
    *(T.StructField(c, T.StringType()) for c in ("class", "band", "key", "k1", "size", "stratum", "words", "lines", "chunk", "digest", "group", "ids", "n_lines", "copies", "target")),
])


def rows():
    """Nulls in any column, empty texts, a very long text, ties and repeated rows."""
    extra = ("x",) * 15
    nothing = (None,) * 15
    long = " ".join(f"word{i % 997}x{i % 31}" for i in range(30_000))
    return [
        (1, PROSE, "en", "a", len(PROSE), *extra),
        (1, PROSE, "en", "a", len(PROSE), *extra),  # a repeated row
        (1, "another text under the same id, long enough to be a line of its own\nand a second line that says something else entirely", "en", "b", 9, *extra),
        (2, PROSE, "fr", None, None, *nothing),  # an exact copy
        (3, PROSE + " indeed", None, "b", 3, *extra),  # a near copy
        (4, None, None, None, None, *nothing),
        (5, "", "en", "a", 0, *extra),
        (6, " \t\n\n ", "en", "a", 5, *extra),
        (7, long, "de", "c", len(long), *extra),
        (8, "a" * 20_000, "de", "c", 20_000, *extra),
        (9, "ünï çødé ▁   漢字 🙂 <|endoftext|> x﻿ 12.5% don't", "es", "c", 1, *extra),
        (10, "one two three", "es", "c", 13, *extra),
        (None, PROSE, "en", "a", 1, *extra),
        (None, None, None, None, None, *nothing),
        (11, "first line of the text here\n" + "a line that comes twice in this text\n" * 2 + "the end of it", "en", "d", 1, *extra),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def copies(spark, documents):
    """Documents with exact and near copies under new ids, and a crowd of variants of one text."""
    base = documents.filter("length(text) > 400").orderBy("doc_id").limit(30).select("doc_id", "text")
    exact = base.filter("doc_id % 2 = 0").select((F.col("doc_id") + 100_000).alias("doc_id"), "text")
    near = base.filter("doc_id % 3 = 0").select((F.col("doc_id") + 200_000).alias("doc_id"), F.regexp_replace("text", r"^\S+ \S+", "changed words").alias("text"))
    words = [f"term{i}" for i in range(160)]
    crowd = [(300_000 + v, " ".join(w if i not in (5 * v % 160, (11 * v + 3) % 160, (v * v) % 160) else f"edit{v}" for i, w in enumerate(words))) for v in range(60)]
    return base.union(exact).union(near).union(spark.createDataFrame(crowd, "doc_id long, text string")).cache()
