"""Helpers that the operators of this subpackage share.

Nothing outside ``copse.llm`` imports this module.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of every word definition here: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a single machine (tests), where it is unset, our own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "/tmp/checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/copse/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and outlives an executor."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(*tables: DataFrame) -> None:
    """Remove tables made by :func:`written` that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        for f in df.inputFiles()[:1]:
            at = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows that go to a Python worker at once; whole texts of any length go with them.
ARROW_ROWS = 1000


def clear_scratch(spark: SparkSession) -> None:
    """Remove all intermediate tables of this package from the shared folder, once no result that reads them is needed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/copse")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table. Batches for Python workers are kept small from here on, as texts are."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text"):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


#: Bytes up to which a written table is broadcast.
BROADCAST_BYTES = 4 << 20


def maybe_broadcast(df: DataFrame, entries: str | None = None) -> DataFrame:
    """A written table as a broadcast side if its measured bytes in memory (with those of an array column) are few; else it is joined by a shuffle."""
    wide = [F.octet_length(c) for c, t in df.dtypes if t in ("string", "binary")]
    row = sum(wide, F.lit(16 * (len(df.columns) + 2))) + (40 * F.size(entries) if entries else F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(row.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES else df


class Memo(dict):
    """Results by key, made at first use, in two generations: when one is full the one before it is forgotten."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value


def byte_characters() -> list[str]:
    """The character that byte-level BPE files write for each byte: visible Latin-1 for itself, then code points from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]
