"""Sample data and readers. Tables of measurements are read from files; nothing is built in."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.functions.portable import uniform


@dataclass
class Dataset:
    """A table with what its columns mean: features, and a label or target column."""

    df: DataFrame
    features: list[str]
    label: str
    class_names: list[str]
    task: str


IRIS = ["sepal_length", "sepal_width", "petal_length", "petal_width"]
WINE = [
    "alcohol", "malic_acid", "ash", "alcalinity_of_ash", "magnesium", "total_phenols", "flavanoids", "nonflavanoid_phenols", "proanthocyanins",
    "color_intensity", "hue", "od280_od315", "proline",
]
AIR = ["co_sensor", "nmhc_sensor", "nox_sensor", "no2_sensor", "o3_sensor", "temperature", "relative_humidity", "absolute_humidity"]


def _measured(spark: SparkSession, path: str, features: Sequence[str], label: str, kind: str) -> DataFrame:
    columns = ", ".join([*(f"{c} double" for c in features), f"{label} {kind}"])
    df = spark.read.schema(columns).csv(path, header=True) if path.endswith(".csv") else spark.read.parquet(path).select(*features, label)
    return df


def iris(spark: SparkSession, path: str) -> Dataset:
    """Flower measurements (four in cm and a species 0 to 2) from a CSV or Parquet file."""
    return Dataset(_measured(spark, path, IRIS, "species", "int"), IRIS, "species", ["setosa", "versicolor", "virginica"], "classify")


def wine(spark: SparkSession, path: str) -> Dataset:
    """Wine measurements (thirteen and a cultivar 0 to 2) from a CSV or Parquet file."""
    return Dataset(_measured(spark, path, WINE, "cultivar", "int"), WINE, "cultivar", ["0", "1", "2"], "classify")


def air_quality(spark: SparkSession, path: str) -> Dataset:
    """Sensor readings (eight and a CO concentration) from a CSV or Parquet file."""
    return Dataset(_measured(spark, path, AIR, "co", "double"), AIR, "co", [], "regress")


def generated(spark: SparkSession, n: int, p: int, seed: int | str = 42, task: str = "classify") -> Dataset:
    """``row_id``, normal features x0, x1, ..., and a label (x0 + x1 > 0) or target (2 x0 + x1 and a tenth of noise) that they decide."""
    def normal(name: str):
        return F.sqrt(-2 * F.log(1 - uniform(seed, name, "r", F.col("row_id")))) * F.cos(2 * 3.141592653589793 * uniform(seed, name, "a", F.col("row_id")))

    features = [f"x{i}" for i in range(p)]
    df = spark.range(n).select(F.col("id").alias("row_id")).select("row_id", *[normal(c).alias(c) for c in features])
    y = (F.col("x0") + F.col("x1") > 0).cast("int") if task == "classify" else 2 * F.col("x0") + F.col("x1") + 0.1 * normal("noise")
    return Dataset(df.withColumn("y", y), features, "y", ["0", "1"] if task == "classify" else [], task)


def read_dense(spark: SparkSession, path: str, features: Sequence[str] | None = None, **options) -> DataFrame:
    """A Parquet, ORC, JSON or CSV table by its ending, with the columns asked for only."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind not in ("parquet", "orc", "json", "csv"):
        raise ValueError(f"cannot tell the format of {path!r}")
    df = spark.read.options(**({"header": "true", "inferSchema": "true"} if kind == "csv" else {}) | options).format(kind).load(path)
    return df.select(*features) if features else df


def read_sparse_rows(spark: SparkSession, path: str) -> DataFrame:
    """``row_id, feature, value`` from compressed sparse rows in Parquet: (row_id, indices array, data array)."""
    rows = spark.read.parquet(path)
    return rows.select("row_id", F.explode(F.arrays_zip("indices", "data")).alias("e")).select("row_id", F.col("e.indices").cast("string").alias("feature"), F.col("e.data").cast("double").alias("value"))


def read_stacked_keys(spark: SparkSession, path: str) -> DataFrame:
    """``dimension, key, description`` from a file of several two-column tables below each other.

    A table begins with its header, a line that has no number as key; blank lines separate
    tables. The file is a lookup of dimensions and is read as one piece.
    """
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line")).filter("trim(line) not in ('', ',')")
    parts = lines.select("at", F.trim(F.regexp_extract("line", "^([^,]*)", 1)).alias("key"), F.trim(F.regexp_replace(F.regexp_extract("line", "^[^,]*,(.*)$", 1), '^"|"$', "")).alias("description"))
    from pyspark.sql import Window

    header = F.when(~F.col("key").rlike(r"^-?\d+$"), F.col("key"))
    named = parts.withColumn("dimension", F.last(header, ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("at")))
    return named.filter(F.col("key").rlike(r"^-?\d+$")).select("dimension", F.col("key").cast("int").alias("key"), "description")
