"""A small forest by rule, over customers, with which everything after growth can be checked in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.functions.portable import draw_sql
from copse.operators import forest
from copse.operators.prep import bootstrap, with_row_id
from copse.plans.storage import materialised

TREES, DEPTH, CLASSES = 5, 6, 3
FEATURES = ("x0", "x1", "x2")
_LOW, _HIGH = (-1000.0, 0.0, 0.0), (10000.0, 25.0, 5.0)


def nodes() -> list[tuple]:
    """Node rows: each level halves the range of feature (tree + depth) mod 3, the third one being categories 0 to 4."""
    out = []
    for tree in range(TREES):
        level = [(0, _LOW, _HIGH)]
        for depth in range(DEPTH + 1):
            below = []
            for node, low, high in level:
                f = (tree + depth) % 3
                label, value = (node + tree) % CLASSES, (node % 17) / 2.0
                if depth == DEPTH:
                    out.append((tree, node, forest.TERMINAL, None, None, None, None, None, label, value, 1.0 + node % 3 / 4.0, 0, depth))
                    continue
                mid = (low[f] + high[f]) / 2
                cats = [float(c) for c in range(5) if low[f] <= c < mid] if f == 2 else None
                out.append((tree, node, forest.SPLIT, f, None if cats is not None else mid, cats, 2 * node + 1, 2 * node + 2, label, value, 1.0, 0, depth))
                below.append((2 * node + 1, low, tuple(mid if i == f else h for i, h in enumerate(high))))
                below.append((2 * node + 2, tuple(mid if i == f else v for i, v in enumerate(low)), high))
            level = below
    return out


def nodes_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(nodes(), forest.NODES)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id, x0, x1, x2, y, t, c_mktsegment`` of every customer."""
    c = with_row_id(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment"), ["c_custkey"])
    segments = c.select(F.col("c_mktsegment").alias("s")).distinct()
    from copse.operators.prep import dictionary, encode

    c = encode(c, "c_mktsegment", dictionary(segments, "s"), "seg")
    return c.select("row_id", F.col("c_acctbal").alias("x0"), F.col("c_nationkey").cast("double").alias("x1"), F.col("seg").cast("double").alias("x2"), (F.col("c_nationkey") % 3).alias("y"), (F.col("c_acctbal") / 1000).alias("t"), "c_mktsegment")


class Stub:
    """Rows, nodes, bag and leaves of the stub forest."""

    def __init__(self, spark: SparkSession, sf_dir: str, target: str = "y"):
        self.raw = customers(spark, sf_dir)
        self.rows = materialised(forest.feature_rows(self.raw, FEATURES, target), "stub-rows")
        self.nodes = nodes_df(spark)
        self.bag = bootstrap(self.rows, TREES, "bag")
        self.leaves = materialised(forest.leaves(self.rows, self.nodes, self.bag), "stub-leaves")


def _case(by: dict, tree: int, node: int, x: tuple[str, str, str]) -> str:
    r = by[tree, node]
    if r[2] == forest.TERMINAL:
        return str(node)
    f = r[3]
    test = f"{x[f]} IN ({', '.join(str(c) for c in r[5]) or 'NULL'})" if r[5] is not None else f"{x[f]} <= {r[4]!r}"
    return f"CASE WHEN {test} THEN {_case(by, tree, r[6], x)} ELSE {_case(by, tree, r[7], x)} END"


def leaf_sql(tree: int, x: tuple[str, str, str] = ("x0", "x1", "x2")) -> str:
    """The leaf of a row in a tree as a SQL expression."""
    return _case({(r[0], r[1]): r for r in nodes()}, tree, 0, x)


_ENDS = ", ".join(f"({r[0]}, {r[1]}, {r[8]}, {r[9]!r}::DOUBLE, {r[10]!r}::DOUBLE)" for r in nodes() if r[2] == forest.TERMINAL)

BASE_SQL = f"""
segments AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS code FROM (SELECT DISTINCT c_mktsegment AS s FROM customer)),
base AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_id, c_acctbal AS x0, c_nationkey::DOUBLE AS x1, code::DOUBLE AS x2,
         c_nationkey % 3 AS y, c_acctbal / 1000 AS t FROM customer JOIN segments ON c_mktsegment = s),
n AS (SELECT count(*) AS n FROM base)"""

STUB_SQL = f"""{BASE_SQL},
ends(tree_id, leaf_id, node_class, node_pred, node_weight) AS (VALUES {_ENDS}),
bag AS (SELECT tree_id, row_id, count(*) AS nin FROM (
  SELECT tree_id, {draw_sql("'bag'", "tree_id", "d")} % (SELECT n FROM n) AS row_id
  FROM (SELECT unnest(range({TREES})) AS tree_id), (SELECT unnest(range((SELECT n FROM n))) AS d)) GROUP BY 1, 2),
routed AS ({" UNION ALL ".join(f"SELECT {t} AS tree_id, row_id, {leaf_sql(t)} AS leaf_id FROM base" for t in range(TREES))}),
leaves AS (SELECT r.tree_id, r.row_id, r.leaf_id, coalesce(nin, 0) AS nin, nin IS NULL AS is_oob FROM routed r LEFT JOIN bag b ON r.tree_id = b.tree_id AND r.row_id = b.row_id),
nout AS (SELECT row_id, sum(is_oob::INT)::BIGINT AS nout FROM leaves GROUP BY 1)"""
