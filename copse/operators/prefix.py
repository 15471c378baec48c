"""Running sums over an order, without one task for all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copse.plans.storage import materialised


def running_sums(df: DataFrame, order: Sequence, sums: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``df`` with the inclusive running sum of each column; ``order`` are columns or sort expressions without ties.

    Rows are range-partitioned; each partition's sums (a row each) give the offsets of the next.
    """
    part = materialised(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    totals = part.groupBy("__part").agg(*[F.sum(c).alias(f"__t{i}") for i, c in enumerate(sums)]).orderBy("__part").collect()
    out, inside = part, Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for i, (c, name) in enumerate(zip(sums, names)):
        entries, done = [], 0
        for r in totals:
            entries += [F.lit(r["__part"]), F.lit(done)]
            done += r[f"__t{i}"] or 0
        before = F.element_at(F.create_map(*entries), F.col("__part")) if entries else F.lit(0)
        out = out.withColumn(name, before + F.sum(c).over(inside))
    return out.drop("__part")
