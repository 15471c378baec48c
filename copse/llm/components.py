"""Connected components of an edge table, by alternating large-star and small-star joins.

Edges never leave the cluster: each round is two aggregations and two joins, and its
result is written to the shared folder. The number of rounds grows with the logarithm
of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.llm._shared import drop_tables, written


#: Links (counted) that one task handles as well as many: a round is then a single stage.
ONE_TASK = 200_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the least node around: the larger ones (large star) or the others (small star)."""
    pairs = lambda *ab: F.explode(F.array(*[F.struct(x.alias("a"), y.alias("b")) for x, y in ab])).alias("e")
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    if large:
        around = edges.select(pairs((a, b), (b, a))).select("e.*")
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    if large:
        hung = around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        hung = around.join(least, "a").select(pairs((b, m), (a, m))).select("e.*")
    return hung.filter("a <> b").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of a link; root is the least node reachable.

    Nodes can be of any orderable type. Null ends and self links are ignored, repeated
    links count once, an empty table gives an empty table.
    """
    edges = written(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b").distinct(), "links")
    state = None
    while True:
        found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found[0] == 0 or tuple(found) == state:
            break
        state = tuple(found)
        here = edges.coalesce(1) if found[0] <= ONE_TASK else edges
        nxt = written(_star(_star(here, True), False), "links")
        drop_tables(edges)
        edges = nxt
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
