"""Registered queries and the SQL that must give the same rows.

Floating results are rounded to six places on both sides, as sums run in another order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.functions import portable
from copse.functions.portable import draw_sql, uniform
from copse.operators import forest, importance, impute, metrics, outlier, prep, proximity, similar, split, votes
from copse.plans import stub
from copse.plans.stub import BASE_SQL, STUB_SQL, TREES, Stub, customers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places."""
    return df.select(*[F.round(F.col(f"`{c}`"), 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- splits ------------------------------------------------------------------------------

LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
BINS = 32


def line_long(spark: SparkSession, sf_dir: str, features=LINE, keep=()) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").select(*dict.fromkeys([*features, "l_extendedprice", "l_returnflag", "l_linestatus"]))
    edges = prep.edge_arrays(prep.bin_edges(df, features, BINS))
    y = (F.col("l_returnflag") == "R").cast("int").alias("y")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), prep.bin_of(F.col(c), edges[c]).alias("bin"), F.col(c).alias("value")) for c in features])).alias("e")
    return df.select(*keep, y, (F.col("l_extendedprice") / 1000).alias("t"), each).select(*keep, "y", "t", "e.*")


def long_sql(features=LINE, keep: str = "") -> str:
    parts = " UNION ALL ".join(f"SELECT {keep} '{c}' AS feature, {c} AS value, (l_returnflag = 'R')::INT AS y, l_extendedprice / 1000 AS t FROM lineitem" for c in features)
    return f"""long AS ({parts}),
dist AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY feature) AS n FROM (SELECT DISTINCT feature, value FROM long)),
bins AS (SELECT feature, value, ((r + 1) * least({BINS}, n) - 1) // n AS bin FROM dist),
binned AS (SELECT long.*, bin FROM long JOIN bins USING (feature, value))"""


def split_sql(task: str, groups: str = "", features=LINE) -> str:
    g = f"{groups}, " if groups else ""
    sums = "sum(y) AS s1, count(*) - sum(y) AS s0, count(*) AS s2" if task == "class" else "count(*) AS s0, sum(t) AS s1, sum(t * t) AS s2"
    if task == "class":
        n_l, n_r = "(l0 + l1)", "(a0 - l0 + a1 - l1)"
        part = lambda p0, p1, n: f"(({p0}) * ({p0}) + ({p1}) * ({p1})) / {n}::DOUBLE"
        score = f"({part('l0', 'l1', n_l)} + {part('a0 - l0', 'a1 - l1', n_r)})"
        value = f"1 - {score} / (a0 + a1)"
    else:
        n_l, n_r = "l0", "(a0 - l0)"
        score = f"(l1 * l1 / {n_l} + (a1 - l1) * (a1 - l1) / {n_r})"
        value = f"(a2 - {score}) / a0"
    return f"""WITH {long_sql(features, f"{groups}," if groups else "")},
h AS (SELECT {g}feature, bin, {sums}, min(value) AS lo, max(value) AS hi FROM binned GROUP BY ALL),
c AS (SELECT {g}feature, bin, {", ".join(f"sum(s{i}) OVER w AS l{i}, sum(s{i}) OVER p AS a{i}" for i in range(3))}, max(hi) OVER w AS below, lead(lo) OVER (PARTITION BY {g}feature ORDER BY bin) AS above
      FROM h WINDOW w AS (PARTITION BY {g}feature ORDER BY bin ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY {g}feature)),
s AS (SELECT {g}feature, round((below + above) / 2, 6) AS split_value, {n_l}::DOUBLE AS n_left, {n_r}::DOUBLE AS n_right, {value} AS impurity,
      row_number() OVER (PARTITION BY {g}feature ORDER BY round({score}, 6) DESC, bin) AS r FROM c WHERE {n_l} >= 1 AND {n_r} >= 1)
SELECT {g}feature, split_value, n_left, n_right, round(impurity, 6) AS impurity FROM s WHERE r = 1"""


def _splits(long: DataFrame, groups: list[str], task: str) -> DataFrame:
    stats = split.class_sums(F.col("y"), F.lit(1.0), 2) if task == "class" else split.moments(F.col("t"), F.lit(1.0))
    cand = split.numeric_candidates(split.histogram(long, groups, stats), groups, task, 2 if task == "class" else 3)
    best = split.best(cand.withColumn("score", F.round("score", 6)), [*groups, "feature"])
    size = lambda c: split.size_of(F.col(c), task)
    return r6(best.select(*groups, "feature", "split_value", size("left").alias("n_left"), size("right").alias("n_right"), split.impurity(F.col("left"), F.col("right"), task).alias("impurity")))


@query(split_sql("class"))
def gini_split(spark, sf_dir):
    """Best Gini cut of each line item feature for being returned."""
    return _splits(line_long(spark, sf_dir), [], "class")


@query(split_sql("class", "l_linestatus"))
def gini_split_per_group(spark, sf_dir):
    return _splits(line_long(spark, sf_dir, keep=["l_linestatus"]), ["l_linestatus"], "class")


MSE_FEATURES = ("l_quantity", "l_discount", "l_tax")


@query(split_sql("regress", "", MSE_FEATURES))
def mse_split(spark, sf_dir):
    return _splits(line_long(spark, sf_dir, MSE_FEATURES), [], "regress")


@query("""WITH h AS (SELECT l_quantity AS v, sum((l_returnflag = 'R')::INT) AS s1, count(*) - sum((l_returnflag = 'R')::INT) AS s0 FROM lineitem GROUP BY 1),
c AS (SELECT v, lead(v) OVER (ORDER BY v) AS above, sum(s0) OVER w AS l0, sum(s1) OVER w AS l1, sum(s0) OVER () AS a0, sum(s1) OVER () AS a1 FROM h WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)),
s AS (SELECT (v + above) / 2 AS split_value, l0 + l1 AS n_left, a0 + a1 - l0 - l1 AS n_right, (l0 * l0 + l1 * l1) / (l0 + l1)::DOUBLE + ((a0 - l0) * (a0 - l0) + (a1 - l1) * (a1 - l1)) / (a0 + a1 - l0 - l1)::DOUBLE AS score, v
      FROM c WHERE above IS NOT NULL)
SELECT round(split_value, 6) AS split_value, n_left::DOUBLE AS n_left, n_right::DOUBLE AS n_right FROM s ORDER BY round(score, 6) DESC, v LIMIT 1""")
def gini_split_exact(spark, sf_dir):
    """The cut at every value boundary, without bins."""
    df = read(spark, sf_dir, "lineitem").select(F.lit("q").alias("feature"), F.col("l_quantity").alias("value"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    cand = split.exact_candidates(df, [], "class", split.class_sums(F.col("y"), F.lit(1.0), 2), 2)
    best = split.best(cand.withColumn("score", F.round("score", 6)), [])
    return r6(best.select("split_value", split.size_of(F.col("left"), "class").alias("n_left"), split.size_of(F.col("right"), "class").alias("n_right")))


@query(f"""WITH {BASE_SQL},
h AS (SELECT x2::INT AS c, sum((x0 > 4500)::INT) AS s1, count(*) - sum((x0 > 4500)::INT) AS s0 FROM base GROUP BY 1),
p AS (SELECT *, row_number() OVER (ORDER BY c) - 1 AS i FROM h),
m AS (SELECT unnest(range(1, (1 << ((SELECT count(*) FROM p)::INT - 1)))) AS mask),
s AS (SELECT mask, sum(CASE WHEN (mask >> i) & 1 = 1 THEN s0 ELSE 0 END) AS l0, sum(CASE WHEN (mask >> i) & 1 = 1 THEN s1 ELSE 0 END) AS l1, sum(s0) AS a0, sum(s1) AS a1 FROM m, p GROUP BY 1)
SELECT mask::BIGINT AS mask, (l0 + l1)::DOUBLE AS n_left, (a0 + a1 - l0 - l1)::DOUBLE AS n_right,
  round((l0 * l0 + l1 * l1) / (l0 + l1)::DOUBLE + ((a0 - l0) * (a0 - l0) + (a1 - l1) * (a1 - l1)) / (a0 + a1 - l0 - l1)::DOUBLE, 6) AS score
FROM s WHERE l0 + l1 >= 1 AND a0 + a1 - l0 - l1 >= 1 ORDER BY score DESC, mask LIMIT 1""")
def categorical_split(spark, sf_dir):
    """The best of all subsets of market segments."""
    c = customers(spark, sf_dir)
    long = c.select(F.lit("x2").alias("feature"), F.col("x2").cast("int").alias("bin"), F.col("x2").alias("value"), (F.col("x0") > 4500).cast("int").alias("y"))
    h = split.histogram(long, [], split.class_sums(F.col("y"), F.lit(1.0), 2))
    best = split.best(split.categorical_candidates(h, [], "class", 2).withColumn("score", F.round("score", 6)), [])
    return best.select(F.col("bin").alias("mask"), split.size_of(F.col("left"), "class").alias("n_left"), split.size_of(F.col("right"), "class").alias("n_right"), "score")


# -- preparation -------------------------------------------------------------------------

@query(f"""WITH {long_sql()},
b AS (SELECT feature, bin, min(value) AS v, max(r) AS r FROM bins JOIN dist USING (feature, value) GROUP BY 1, 2)
SELECT feature, bin::INT AS bin, round(CASE WHEN bin = 0 THEN v - 1 ELSE v END, 6) AS lo,
  round(coalesce(lead(v) OVER (PARTITION BY feature ORDER BY bin), (SELECT max(value) FROM dist d WHERE d.feature = b.feature)), 6) AS hi FROM b""")
def bin_edges(spark, sf_dir):
    return r6(prep.bin_edges(read(spark, sf_dir, "lineitem").select(*LINE), LINE, BINS))


@query(f"WITH {long_sql()} SELECT feature, bin::INT AS bin, count(*) AS n FROM binned GROUP BY 1, 2")
def bin_assign(spark, sf_dir):
    return line_long(spark, sf_dir).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_unique, max(abs({c} - round({c}))) <= 1e-5 AND count(DISTINCT {c}) > 2 AND count(DISTINCT {c}) <= 60 AND min({c}) >= 0 AND max({c}) < 60 AS categorical FROM part"
    for c in ("p_size", "p_retailprice", "p_partkey")))
def detect_kinds(spark, sf_dir):
    return prep.kinds(read(spark, sf_dir, "part").select("p_size", "p_retailprice", "p_partkey"), ["p_size", "p_retailprice", "p_partkey"], 60)


@query(f"WITH {BASE_SQL} SELECT s AS label, code FROM segments")
def label_dictionary(spark, sf_dir):
    return prep.dictionary(read(spark, sf_dir, "customer"), "c_mktsegment")


@query("""WITH d AS (SELECT b, row_number() OVER (ORDER BY b) - 1 AS code FROM (SELECT DISTINCT p_brand AS b FROM part))
SELECT p_partkey, code, b AS label FROM part LEFT JOIN d ON p_brand = b""")
def encode_decode(spark, sf_dir):
    """Codes learnt from all parts, and what they decode to."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    labels = prep.dictionary(part, "p_brand")
    return prep.decode(prep.encode(part, "p_brand", labels), "code", labels).select("p_partkey", "code", "label")


@query(f"WITH {STUB_SQL} SELECT tree_id::INT AS tree_id, row_id, nin FROM bag")
def bootstrap_uniform(spark, sf_dir):
    return prep.bootstrap(read(spark, sf_dir, "customer"), TREES, "bag")


@query(f"""WITH {BASE_SQL}, w AS (SELECT row_id, x1 + 1 AS w, sum(x1 + 1) OVER (ORDER BY row_id ROWS UNBOUNDED PRECEDING) AS upto FROM base),
u AS (SELECT tree_id, {draw_sql("'wbag'", "tree_id", "d")} / 1152921504606846976.0::DOUBLE * (SELECT max(upto) FROM w) AS u
  FROM (SELECT unnest(range({TREES})) AS tree_id), (SELECT unnest(range((SELECT n FROM n))) AS d))
SELECT tree_id::INT AS tree_id, row_id, count(*) AS nin FROM u JOIN w ON u >= upto - w AND u < upto GROUP BY 1, 2""")
def bootstrap_weighted(spark, sf_dir):
    c = customers(spark, sf_dir).withColumn("w", F.col("x1") + 1)
    return prep.weighted_bootstrap(c, "w", TREES, "wbag")


@query(f"WITH {STUB_SQL} SELECT row_id, nout FROM nout")
def oob_counts(spark, sf_dir):
    c = customers(spark, sf_dir)
    return prep.oob_counts(c, prep.bootstrap(c, TREES, "bag"), TREES)


@query(f"""WITH {BASE_SQL}, {", ".join(f"p{c} AS (SELECT {c}, row_number() OVER (ORDER BY {draw_sql("'syn'", f"'{c}'", 'row_id')}, row_id) - 1 AS place FROM base)" for c in ("x0", "x1"))}
SELECT row_id, x0, x1, 1 AS is_real FROM base UNION ALL SELECT (SELECT n FROM n) + place, x0, x1, 0 FROM px0 JOIN px1 USING (place)""")
def synthetic_union(spark, sf_dir):
    return prep.synthetic_union(customers(spark, sf_dir), ["x0", "x1"], 1.0, "syn")


@query("SELECT l_returnflag AS label, count(*) AS n, round((SELECT count(*) FROM lineitem) / ((SELECT count(DISTINCT l_returnflag) FROM lineitem) * count(*)::DOUBLE), 6) AS weight FROM lineitem GROUP BY 1")
def class_weights(spark, sf_dir):
    return r6(prep.class_weights(read(spark, sf_dir, "lineitem"), "l_returnflag"))


@query("SELECT o_orderkey, round(exp(0.01 * (o_orderkey % 97)) / avg(exp(0.01 * (o_orderkey % 97))) OVER (), 6) AS weight FROM orders")
def recency_weights(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 97).alias("age"))
    return r6(prep.recency_weights(o, "age", 0.01).select("o_orderkey", "weight"))


@query(f"""WITH {BASE_SQL}, h AS (SELECT *, {draw_sql("'tt'", 'row_id')} AS h FROM base)
SELECT row_id, CASE WHEN row_number() OVER (ORDER BY h, row_id) - 1 < floor((SELECT n FROM n) * 0.2)::BIGINT THEN 'test' ELSE 'train' END AS split FROM h""")
def train_test_split(spark, sf_dir):
    return prep.train_test_split(customers(spark, sf_dir), 0.2, "tt").select("row_id", "split")


@query(f"""WITH {BASE_SQL}, h AS (SELECT *, {draw_sql("'st'", 'row_id')} AS h FROM base)
SELECT row_id, y, CASE WHEN row_number() OVER (PARTITION BY y ORDER BY h, row_id) - 1 < floor(count(*) OVER (PARTITION BY y) * 0.2) THEN 'test' ELSE 'train' END AS split FROM h""")
def stratified_split(spark, sf_dir):
    return prep.train_test_split(customers(spark, sf_dir), 0.2, "st", stratify="y").select("row_id", "y", "split")


@query(f"""WITH {BASE_SQL}, h AS (SELECT row_id, (y = 1)::INT AS p, {draw_sql("'bal'", 'row_id')} AS h FROM base),
k AS (SELECT floor(sum(p) * 0.8)::BIGINT AS k FROM h)
SELECT row_id, CASE WHEN row_number() OVER (PARTITION BY p ORDER BY h, row_id) <= (SELECT k FROM k) THEN 'train' ELSE 'test' END AS split FROM h""")
def balanced_split(spark, sf_dir):
    c = customers(spark, sf_dir).withColumn("p", (F.col("y") == 1).cast("int"))
    return prep.balanced_split(c, "p", 0.8, "bal").select("row_id", "split")


@query("""WITH d AS (SELECT o_orderdate AS t, count(*) AS n FROM orders GROUP BY 1),
b AS (SELECT t, sum(n) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER () AS total FROM d)
SELECT o_orderkey, CASE WHEN before < 0.75 * total THEN 'train' ELSE 'test' END AS split FROM orders JOIN b ON o_orderdate = t""")
def chrono_split(spark, sf_dir):
    return prep.chronological_split(read(spark, sf_dir, "orders"), "o_orderdate", train=0.75).select("o_orderkey", "split")


@query("""WITH e AS (SELECT quantile_cont(c_acctbal, 0.01) AS a, quantile_cont(c_acctbal, 0.99) AS b FROM customer)
SELECT c_custkey, round(least(greatest(c_acctbal, a), b), 6) AS c_acctbal FROM customer, e""")
def winsorize(spark, sf_dir):
    return r6(prep.winsorised(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]))


@query("""SELECT c_custkey, CASE WHEN c_nationkey IN (3, 7) THEN NULL ELSE c_nationkey::DOUBLE END AS nation,
CASE WHEN c_acctbal > -1000 AND c_acctbal <= 0 THEN 'debt' WHEN c_acctbal > 0 AND c_acctbal <= 5000 THEN 'low' WHEN c_acctbal > 5000 AND c_acctbal <= 10000 THEN 'high' END AS band,
(c_mktsegment = 'BUILDING')::INT AS segment_building, round(c_acctbal / nullif(c_nationkey, 0), 6) AS per_nation FROM customer""")
def feature_engineering(spark, sf_dir):
    """Sentinels, bands, indicators and ratios."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("nation"), "c_acctbal", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("raw"))
    c = prep.sentinels_to_null(prep.one_hot(c, "segment", ["BUILDING"]), ["nation"], [3, 7])
    band = prep.cut(F.col("c_acctbal"), [-1000, 0, 5000, 10000], ["debt", "low", "high"])
    return r6(c.select("c_custkey", "nation", band.alias("band"), F.col("segment_BUILDING").alias("segment_building"), prep.ratio(F.col("c_acctbal"), F.col("raw")).alias("per_nation")))


MASKED_SQL = f"""{BASE_SQL}, masked AS (SELECT row_id, {", ".join(f"CASE WHEN {draw_sql("'mask'", f"'{c}'", 'row_id')} / 1152921504606846976.0::DOUBLE >= 0.15 THEN {c} END AS {c}" for c in ("x0", "x1", "x2"))} FROM base)"""


def masked(spark, sf_dir):
    return prep.mask_cells(customers(spark, sf_dir).select("row_id", "x0", "x1", "x2"), ["x0", "x1", "x2"], 0.15, "mask")


@query(f"WITH {MASKED_SQL} SELECT * FROM masked")
def mask_cells(spark, sf_dir):
    return masked(spark, sf_dir)


# -- routing, votes ----------------------------------------------------------------------

@query(f"WITH {STUB_SQL} SELECT tree_id::INT AS tree_id, row_id, leaf_id::BIGINT AS leaf_id, nin, is_oob FROM leaves")
def stub_leaves(spark, sf_dir):
    return Stub(spark, sf_dir).leaves.select("tree_id", "row_id", "leaf_id", "nin", "is_oob")


@query(f"WITH {STUB_SQL} SELECT tree_id::INT AS tree_id, row_id, leaf_id::BIGINT AS leaf_id FROM routed")
def route_by_join(spark, sf_dir):
    """Routing level by level, as for a forest too large to travel."""
    s = Stub(spark, sf_dir)
    return forest.route(s.rows, s.nodes, by_join=True)


def _vote_sql(weight: str, oob: bool = False, last: str | None = None) -> str:
    return f"""WITH {STUB_SQL}, v AS (SELECT row_id, node_class AS class, sum({weight}) AS votes FROM leaves JOIN ends USING (tree_id, leaf_id) {"WHERE is_oob" if oob else ""} GROUP BY 1, 2)
{last or "SELECT row_id, class::INT AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY votes DESC, class) = 1"}"""


@query(_vote_sql("1"))
def stub_vote(spark, sf_dir):
    s = Stub(spark, sf_dir)
    return votes.argmax_class(votes.class_votes(votes.with_leaf(s.leaves, s.nodes)))


@query(_vote_sql("CASE WHEN node_class = 1 THEN 2.5 ELSE 1 END"))
def weighted_vote(spark, sf_dir):
    s = Stub(spark, sf_dir)
    return votes.argmax_class(votes.class_votes(votes.with_leaf(s.leaves, s.nodes), class_weight={1: 2.5}))


@query(_vote_sql("node_weight"))
def casewise_vote(spark, sf_dir):
    s = Stub(spark, sf_dir)
    return votes.argmax_class(votes.class_votes(votes.with_leaf(s.leaves, s.nodes), casewise=True))


@query(_vote_sql("1", False, """SELECT row_id, k::INT AS class, round(coalesce(votes, 0) / 5.0::DOUBLE, 6) AS p FROM (SELECT row_id, unnest(range(3)) AS k FROM base) b LEFT JOIN v USING (row_id) WHERE class = k OR class IS NULL
UNION ALL SELECT row_id, k::INT, 0.0::DOUBLE FROM (SELECT row_id, unnest(range(3)) AS k FROM base) b WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.row_id = b.row_id AND v.class = b.k)"""))
def stub_proba(spark, sf_dir):
    s = Stub(spark, sf_dir)
    return r6(votes.probabilities(votes.class_votes(votes.with_leaf(s.leaves, s.nodes)), [0, 1, 2]))


@query(f"WITH {STUB_SQL} SELECT row_id, round(avg(node_pred), 6) AS prediction FROM leaves JOIN ends USING (tree_id, leaf_id) GROUP BY 1")
def stub_regress(spark, sf_dir):
    s = Stub(spark, sf_dir)
    return r6(votes.mean_prediction(votes.with_leaf(s.leaves, s.nodes)))


@query(f"WITH {STUB_SQL} SELECT tree_id::INT AS tree_id, leaf_id::BIGINT AS leaf_id, round(sum(nin) / count(*)::DOUBLE, 6) AS node_weight FROM leaves WHERE nin > 0 GROUP BY 1, 2")
def leaf_weights(spark, sf_dir):
    return r6(votes.leaf_weights(Stub(spark, sf_dir).leaves))


@query(_vote_sql("1", True, """, p AS (SELECT row_id, class FROM v QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY votes DESC, class) = 1)
SELECT count(*) AS n, round(avg((class <> y)::INT), 6) AS oob_error FROM p JOIN base USING (row_id)"""))
def oob_error(spark, sf_dir):
    s = Stub(spark, sf_dir)
    return r6(votes.oob_error(votes.with_leaf(s.leaves, s.nodes), s.rows))


@query(f"""WITH {STUB_SQL}, p AS (SELECT row_id, avg(node_pred) AS p FROM leaves JOIN ends USING (tree_id, leaf_id) WHERE is_oob GROUP BY 1)
SELECT count(*) AS n, round(avg((t - p) * (t - p)), 6) AS oob_mse FROM p JOIN base USING (row_id)""")
def oob_mse(spark, sf_dir):
    s = Stub(spark, sf_dir, "t")
    return r6(votes.oob_mse(votes.with_leaf(s.leaves, s.nodes), s.rows))


@query(_vote_sql("1", True, "SELECT row_id, class::INT AS class, round(votes / nout::DOUBLE, 6) AS share FROM v JOIN nout USING (row_id) WHERE nout > 0"))
def vote_shares(spark, sf_dir):
    s = Stub(spark, sf_dir)
    return r6(votes.normalised_votes(votes.class_votes(votes.with_leaf(s.leaves.filter("is_oob"), s.nodes)), votes.oob_count(s.leaves)))


# -- proximity, similarity ---------------------------------------------------------------

RAW_SQL = f"""{STUB_SQL}, raw AS (SELECT o.row_id AS i, b.row_id AS j, count(*)::DOUBLE AS r FROM leaves o JOIN leaves b USING (tree_id, leaf_id) WHERE o.is_oob AND b.nin > 0 GROUP BY 1, 2)"""
FINISH_SQL = f"""{RAW_SQL}, sums AS (SELECT i, j, sum(r) / 2 AS s FROM (SELECT i, j, r FROM raw UNION ALL SELECT j, i, r FROM raw) GROUP BY 1, 2),
prox AS (SELECT i, j, s * (1.0::DOUBLE / greatest(a.nout, 1) + 1.0::DOUBLE / greatest(b.nout, 1)) / 2 AS p FROM sums JOIN nout a ON a.row_id = i JOIN nout b ON b.row_id = j WHERE i <> j
  UNION ALL SELECT row_id, row_id, 1.0::DOUBLE FROM base)"""


@query(f"WITH {RAW_SQL} SELECT i, j, r FROM raw")
def proximity_pairs(spark, sf_dir):
    return proximity.raw_proximity(Stub(spark, sf_dir).leaves)


@query(f"WITH {FINISH_SQL} SELECT i, j, round(p, 6) AS p FROM prox")
def proximity_finish(spark, sf_dir):
    leaves = Stub(spark, sf_dir).leaves
    return proximity.finished_proximity(leaves, shown=lambda p: F.round(p, 6))


@query(f"""WITH {STUB_SQL}, m AS (SELECT tree_id, leaf_id, sum(nin) AS m FROM leaves WHERE nin > 0 GROUP BY 1, 2),
k AS (SELECT o.row_id AS i, b.row_id AS j, sum(b.nin / m::DOUBLE) AS s FROM leaves o JOIN leaves b USING (tree_id, leaf_id) JOIN m USING (tree_id, leaf_id) WHERE o.is_oob AND b.nin > 0 GROUP BY 1, 2),
g AS (SELECT i, j, s / c AS g FROM k JOIN (SELECT o.row_id AS i, count(*) AS c FROM leaves o WHERE o.is_oob GROUP BY 1) USING (i))
SELECT i, j, round(sum(g) / 2 + 1e-9, 6) AS p FROM (SELECT i, j, g FROM g UNION ALL SELECT j, i, g FROM g) GROUP BY 1, 2
UNION ALL SELECT row_id, row_id, 1.0::DOUBLE FROM nout WHERE nout = 0""")
def rfgap(spark, sf_dir):
    return proximity.gap_proximity(Stub(spark, sf_dir).leaves, lambda p: F.round(p + 1e-9, 6))


@query(f"WITH {STUB_SQL} SELECT round(avg((a.leaf_id = b.leaf_id)::INT), 6) AS p FROM leaves a JOIN leaves b USING (tree_id) WHERE a.row_id = 3 AND b.row_id = 5 AND a.is_oob")
def pair_proximity(spark, sf_dir):
    return r6(proximity.pair_proximity(Stub(spark, sf_dir).leaves, 3, 5))


TOP_SQL = f"""{STUB_SQL}, q AS (SELECT * FROM leaves WHERE row_id % 50 = 0)"""


@query(f"""WITH {TOP_SQL}, c AS (SELECT q.row_id AS i, l.row_id AS j, count(*) AS n FROM q JOIN leaves l USING (tree_id, leaf_id) WHERE q.is_oob AND q.row_id <> l.row_id GROUP BY 1, 2),
s AS (SELECT i, j, n / nout::DOUBLE AS p FROM c JOIN nout ON nout.row_id = i)
SELECT i, (row_number() OVER (PARTITION BY i ORDER BY p DESC, j))::INT AS rank, j, round(p, 6) AS p FROM s QUALIFY rank <= 10""")
def topk_similar(spark, sf_dir):
    """A query set (every fiftieth row) against all rows."""
    s = Stub(spark, sf_dir)
    return r6(similar.top_similar(s.leaves, s.rows.filter("row_id % 50 = 0"), 10))


@query(f"""WITH {TOP_SQL}, c AS (SELECT q.row_id AS i, l.row_id AS j, count(*) / {TREES}.0::DOUBLE AS p FROM q JOIN leaves l USING (tree_id, leaf_id) WHERE q.row_id <> l.row_id GROUP BY 1, 2),
t AS (SELECT i, (row_number() OVER (PARTITION BY i ORDER BY p DESC, j))::INT AS rank, j, p FROM c QUALIFY rank <= 5)
SELECT i, rank, j, round(p, 6) AS p, round(p / max(p) OVER (PARTITION BY i), 6) AS norm FROM t""")
def topk_all_trees(spark, sf_dir):
    s = Stub(spark, sf_dir)
    return r6(similar.top_similar_all_trees(s.leaves, s.rows.filter("row_id % 50 = 0"), 5, TREES))


def _supplier_rows(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"), F.array(F.col("s_acctbal"), F.col("s_nationkey").cast("double"), (F.col("s_suppkey") % 5).cast("double")).alias("x"))


NEW_SQL = f"""{STUB_SQL}, new AS (SELECT s_suppkey AS row_id, s_acctbal AS x0, s_nationkey::DOUBLE AS x1, (s_suppkey % 5)::DOUBLE AS x2 FROM supplier),
new_leaves AS ({" UNION ALL ".join(f"SELECT {t} AS tree_id, row_id, {stub.leaf_sql(t)} AS leaf_id FROM new" for t in range(TREES))}),
near AS (SELECT a.row_id AS i, l.row_id AS j, count(*) / {TREES}.0::DOUBLE AS p FROM new_leaves a JOIN leaves l USING (tree_id, leaf_id) GROUP BY 1, 2),
top AS (SELECT i, (row_number() OVER (PARTITION BY i ORDER BY p DESC, j))::INT AS rank, j, p FROM near QUALIFY rank <= 5)"""


@query(f"WITH {NEW_SQL} SELECT i, rank, j, round(p, 6) AS p FROM top")
def topk_new(spark, sf_dir):
    s = Stub(spark, sf_dir)
    return r6(similar.top_similar_new(forest.route(_supplier_rows(spark, sf_dir), s.nodes), s.leaves, 5, TREES))


# On the stub's complete trees a leaf's path is its chain of parents; a split at depth d (from 1) is on feature (tree + d - 1) mod 3.
STEPS_SQL = f"steps AS (SELECT tree_id, d, ((tree_id + d - 1) % 3)::INT AS feature FROM (SELECT unnest(range({TREES})) AS tree_id), (SELECT unnest(range(1, {stub.DEPTH + 1})) AS d))"


@query(f"""WITH {NEW_SQL}, {STEPS_SQL},
c AS (SELECT top.i, top.j, s.feature, sum(1.0::DOUBLE / s.d) AS c FROM top JOIN new_leaves a ON a.row_id = top.i JOIN leaves l ON l.row_id = top.j AND l.tree_id = a.tree_id AND l.leaf_id = a.leaf_id JOIN steps s ON s.tree_id = a.tree_id GROUP BY 1, 2, 3),
sh AS (SELECT i, j, feature, c / sum(c) OVER (PARTITION BY i, j) AS share FROM c)
SELECT i, (row_number() OVER (PARTITION BY i ORDER BY round(sum(share), 6) DESC, feature))::INT AS rank, feature, round(sum(share), 6) AS value FROM sh GROUP BY i, feature QUALIFY rank <= 3""")
def topk_explain(spark, sf_dir):
    """The features that speak for new rows' neighbours."""
    s, new = Stub(spark, sf_dir), _supplier_rows(spark, sf_dir)
    found = similar.explained_new(forest.route(new, s.nodes), s.leaves, forest.paths(new, s.nodes), 5, TREES, 3)[2]
    from pyspark.sql import Window

    rounded = found.withColumn("value", F.round("value", 6))
    return rounded.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("value"), "feature")))


@query(f"""WITH {FINISH_SQL}, m AS (SELECT b.y, i, round(sum(p) / (SELECT count(*) FROM base c WHERE c.y = b.y), 9) AS mean FROM prox JOIN base b ON b.row_id = i JOIN base o ON o.row_id = j AND o.y = b.y GROUP BY 1, 2)
SELECT y::DOUBLE AS "group", (row_number() OVER (PARTITION BY y ORDER BY mean DESC, i))::INT AS rank, i AS row_id, round(mean, 6) AS mean FROM m QUALIFY rank <= 3""")
def prototypes_class(spark, sf_dir):
    s = Stub(spark, sf_dir)
    return r6(similar.prototypes(s.leaves.join(s.rows.select("row_id", "y"), "row_id"), 3, "y"))


@query(f"""WITH {FINISH_SQL}, m AS (SELECT i, round(sum(p) / (SELECT n FROM n), 9) AS mean FROM prox GROUP BY 1)
SELECT 0 AS "group", (row_number() OVER (ORDER BY mean DESC, i))::INT AS rank, i AS row_id, round(mean, 6) AS mean FROM m QUALIFY rank <= 5""")
def prototypes_global(spark, sf_dir):
    return r6(similar.prototypes(Stub(spark, sf_dir).leaves, 5))


@query(f"""WITH {NEW_SQL}
SELECT i AS row_id, (b.y)::INT AS prediction FROM top JOIN base b ON b.row_id = top.j WHERE rank = 1""")
def most_similar_label(spark, sf_dir):
    """The label of the most similar training row."""
    s = Stub(spark, sf_dir)
    pairs = similar.top_similar_new(forest.route(_supplier_rows(spark, sf_dir), s.nodes), s.leaves, 1, TREES)
    return votes.most_similar_label(pairs, s.rows.select("row_id", F.col("y").cast("int").alias("label")))


@query(f"WITH {STUB_SQL} SELECT tree_id::INT AS tree_id, leaf_id::BIGINT AS leaf_id, count(*) AS n, min(row_id) AS first_row FROM leaves GROUP BY 1, 2")
def leaf_index(spark, sf_dir):
    return proximity.leaf_index(Stub(spark, sf_dir).leaves).select("tree_id", "leaf_id", "n", F.col("rows")[0].alias("first_row"))


@query("""WITH e AS (SELECT vec_id AS i, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT i, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e),
s AS (SELECT a.i, b.i AS j, round(list_inner_product(a.v, b.v), 9) AS cosine FROM u a JOIN u b ON a.i <> b.i WHERE a.i % 50 = 0)
SELECT i, (row_number() OVER (PARTITION BY i ORDER BY cosine DESC, j))::INT AS rank, j, round(cosine, 6) AS cosine FROM s QUALIFY rank <= 10""")
def cosine_topk(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("x"))
    return r6(similar.top_cosine(e.filter("row_id % 50 = 0"), e, 10))


@query("""WITH s AS (SELECT DISTINCT user_id AS id, event_type || ':' || (day(ts) % 7) AS item FROM events),
z AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b USING (item) WHERE a.id < b.id GROUP BY 1, 2)
SELECT c.a, c.b, round(k / (x.n + y.n - k)::DOUBLE, 6) AS jaccard FROM c JOIN z x ON x.id = c.a JOIN z y ON y.id = c.b WHERE k / (x.n + y.n - k)::DOUBLE >= 0.2""")
def jaccard(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.concat("event_type", F.lit(":"), F.dayofmonth("ts") % 7).alias("item")).distinct()
    return similar.jaccard_pairs(e, 0.2, lambda p: F.round(p, 6))


# -- outliers ----------------------------------------------------------------------------

def _norm_sql(group: str) -> str:
    part = f"PARTITION BY {group}" if group else ""
    on = f"USING ({group})" if group else "ON true"
    g = f"{group}," if group else ""
    pick = lambda col, src: f"SELECT {g} {col} AS m FROM (SELECT {g} {col}, row_number() OVER ({part} ORDER BY {col}) AS r, count(*) OVER ({part}) AS c FROM {src}) WHERE r = c // 2 + 1"
    return f"""med AS ({pick("raw", "scored")}), dev AS (SELECT scored.*, m AS centre, abs(raw - m) AS away FROM scored JOIN med {on}),
mad AS ({pick("away", "dev")}), normed AS (SELECT dev.*, CASE WHEN mad.m < 1e-10 THEN 1 ELSE mad.m END AS spread FROM dev JOIN mad {on})"""


FULL_SQL = f"""{STUB_SQL}, c AS (SELECT a.row_id, b.row_id AS j, count(*) / {TREES}.0::DOUBLE AS p FROM leaves a JOIN leaves b USING (tree_id, leaf_id) WHERE a.row_id <> b.row_id GROUP BY 1, 2),
sq AS (SELECT row_id, sum(p * p) AS s FROM c GROUP BY 1),
raws AS (SELECT row_id, CASE WHEN coalesce(s, 0) <= 1e-10 THEN (SELECT n FROM n) * 1e10 ELSE ((SELECT n FROM n) - 1) / s END AS raw FROM base LEFT JOIN sq USING (row_id)),
scored AS (SELECT row_id, y::DOUBLE AS class, round(raw, 6) AS raw FROM raws JOIN base USING (row_id))"""


def _full(spark, sf_dir):
    s = Stub(spark, sf_dir)
    raw = outlier.full_scores(s.leaves, TREES).withColumn("raw", F.round("raw", 6))
    return s, outlier.normalised(raw.join(s.rows.select("row_id", F.col("y").alias("class")), "row_id"), "class")


@query(f"WITH {FULL_SQL}, {_norm_sql('class')} SELECT row_id, class, round(raw, 6) AS raw, round((raw - centre) / spread, 6) AS score, round(centre, 6) AS centre, round(spread, 6) AS spread FROM normed")
def outlier_full(spark, sf_dir):
    return r6(_full(spark, sf_dir)[1])


@query(f"WITH {FULL_SQL}, {_norm_sql('class')} SELECT row_id, round((raw - centre) / spread, 6) AS score FROM normed ORDER BY score DESC, row_id LIMIT 10")
def outlier_topk(spark, sf_dir):
    scores = _full(spark, sf_dir)[1].withColumn("score", F.round("score", 6))
    return outlier.top_outliers(scores, 10).select("row_id", "score")


ANCHOR_SQL = f"""{STUB_SQL}, anchors AS (SELECT row_id AS j FROM base ORDER BY {draw_sql("12345", "row_id")}, row_id LIMIT 20),
c AS (SELECT a.row_id, j, count(*) / {TREES}.0::DOUBLE AS p FROM leaves a JOIN (SELECT tree_id, leaf_id, row_id AS j FROM leaves WHERE row_id IN (SELECT j FROM anchors)) b USING (tree_id, leaf_id) WHERE a.row_id <> j GROUP BY 1, 2),
sq AS (SELECT row_id, sum(p * p) AS s FROM c GROUP BY 1),
scored AS (SELECT row_id, round(CASE WHEN coalesce(s, 0) <= 1e-10 THEN (SELECT n FROM n) * 1e10 ELSE 20 / s END, 6) AS raw FROM base LEFT JOIN sq USING (row_id))"""


@query(f"WITH {ANCHOR_SQL}, {_norm_sql('')} SELECT row_id, raw, round((raw - centre) / spread, 3) AS score, round(centre, 6) AS centre, round(spread, 6) AS spread FROM normed")
def outlier_greedy(spark, sf_dir):
    s = Stub(spark, sf_dir)
    raw = outlier.anchor_scores(s.leaves, outlier.random_anchors(s.rows, 20), TREES).withColumn("raw", F.round("raw", 6))
    return r6(outlier.normalised(raw).withColumn("score", F.round("score", 3)))  # rows next to no anchor score some 10**12


@query(f"""WITH {NEW_SQL}, sq AS (SELECT i, sum(p * p) AS s, count(*) AS k FROM near GROUP BY 1)
SELECT row_id, round(CASE WHEN coalesce(s, 0) <= 1e-10 THEN (SELECT n FROM n) * 1e10 ELSE k / s END, 6) AS raw FROM new LEFT JOIN sq ON i = row_id""")
def outlier_predict(spark, sf_dir):
    s = Stub(spark, sf_dir)
    return r6(outlier.predicted_raw(forest.route(_supplier_rows(spark, sf_dir), s.nodes), s.leaves, TREES))


@query(f"""WITH {NEW_SQL}, z AS (SELECT tree_id, leaf_id, count(*) AS c FROM leaves GROUP BY 1, 2)
SELECT row_id, round(1 - sum(coalesce(c, 0)) / ((SELECT n FROM n) * {TREES}.0::DOUBLE), 6) AS score FROM new_leaves LEFT JOIN z USING (tree_id, leaf_id) GROUP BY 1""")
def outlier_mean_proximity(spark, sf_dir):
    s = Stub(spark, sf_dir)
    return r6(outlier.mean_proximity_scores(forest.route(_supplier_rows(spark, sf_dir), s.nodes), s.leaves, TREES))


@query("WITH e AS (SELECT quantile_cont(c_acctbal, 0.9) AS q FROM customer) SELECT c_custkey, (c_acctbal > q)::INT AS flag FROM customer, e")
def percentile_flags(spark, sf_dir):
    return outlier.percentile_flags(read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("score"))).select("c_custkey", "flag")


@query(f"""WITH s AS (SELECT c_mktsegment AS method, {draw_sql("'imp'", "c_custkey")} / 1152921504606846976.0::DOUBLE AS p FROM customer),
m AS (SELECT method, avg(p) AS mean_p, avg((p > 0.5)::INT) AS share_above FROM s GROUP BY 1)
SELECT method, round(mean_p, 6) AS mean_p, round(share_above, 6) AS share_above, (row_number() OVER (ORDER BY mean_p, method))::INT AS rank FROM m""")
def rank_imputers(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("method"), uniform("imp", F.col("c_custkey")).alias("p"))
    return r6(outlier.rank_imputers(c))


# -- importance --------------------------------------------------------------------------

def _changed_sql(donor: str) -> str:
    """Rows of changed leaves: each out-of-bag row, tree and feature, with the donor's value."""
    names = stub.FEATURES
    return " UNION ALL ".join(
        f"SELECT {t} AS tree_id, m.row_id, {f} AS feature, m.leaf_id AS was, {stub.leaf_sql(t, tuple(f'd.{c}' if i == f else f'm.{c}' for i, c in enumerate(names)))} AS leaf_id FROM mine m JOIN base d ON d.row_id = {donor.format(t=t, f=f)} WHERE m.tree_id = {t}"
        for t in range(TREES) for f in range(3))


SHIFT = "(CASE WHEN (m.row_id + 31 * {f} + 17 * {t}) % (SELECT n FROM n) = m.row_id THEN (m.row_id + 1) % (SELECT n FROM n) ELSE (m.row_id + 31 * {f} + 17 * {t}) % (SELECT n FROM n) END)"
PROX_IMP_SQL = f"""{STUB_SQL}, noob AS (SELECT tree_id, count(*) AS noob FROM leaves WHERE is_oob GROUP BY 1),
mine AS (SELECT l.*, x0, x1, x2 FROM leaves l JOIN ends USING (tree_id, leaf_id) JOIN base USING (row_id) WHERE is_oob AND node_class = y),
changed AS ({_changed_sql(SHIFT)}),
imp AS (SELECT row_id, feature, sum(CASE WHEN was <> leaf_id THEN 1.0::DOUBLE / noob ELSE 0 END) AS importance FROM changed JOIN noob USING (tree_id) GROUP BY 1, 2)"""


@query(f"WITH {PROX_IMP_SQL} SELECT row_id, feature::INT AS feature, round(importance, 6) AS importance FROM imp")
def prox_importance(spark, sf_dir):
    s = Stub(spark, sf_dir)
    return r6(importance.proximity_importance(s.rows, s.nodes, s.leaves))


@query(f"WITH {PROX_IMP_SQL} SELECT feature::INT AS feature, round(sum(importance) / (SELECT n FROM n), 6) AS importance FROM imp GROUP BY 1")
def prox_importance_overall(spark, sf_dir):
    s = Stub(spark, sf_dir)
    return r6(importance.overall(importance.proximity_importance(s.rows, s.nodes, s.leaves), s.rows.count()))


PERM_SQL = f"""{STUB_SQL}, o AS (SELECT tree_id, row_id, row_number() OVER (PARTITION BY tree_id ORDER BY row_id) AS a, row_number() OVER (PARTITION BY tree_id ORDER BY {draw_sql("42", "tree_id", "row_id")}, row_id) AS b FROM leaves WHERE is_oob),
don AS (SELECT x.tree_id, x.row_id, z.row_id AS donor FROM o x JOIN o z ON x.tree_id = z.tree_id AND x.a = z.b),
mine AS (SELECT l.*, x0, x1, x2, y, donor FROM leaves l JOIN base USING (row_id) JOIN don ON don.tree_id = l.tree_id AND don.row_id = l.row_id WHERE is_oob),
changed AS ({_changed_sql("m.donor")}),
d AS (SELECT c.tree_id, c.row_id, c.feature, (e2.node_class <> y)::INT - (e1.node_class <> y)::INT AS d FROM changed c JOIN base USING (row_id)
  JOIN ends e1 ON e1.tree_id = c.tree_id AND e1.leaf_id = c.was JOIN ends e2 ON e2.tree_id = c.tree_id AND e2.leaf_id = c.leaf_id)"""


@query(f"""WITH {PERM_SQL}, t AS (SELECT tree_id, feature, avg(d) AS d FROM d GROUP BY 1, 2)
SELECT feature::INT AS feature, round(sum(d), 6) AS importance, round(sum(d * d), 6) AS sqsd FROM t GROUP BY 1""")
def perm_importance(spark, sf_dir):
    s = Stub(spark, sf_dir)
    return r6(importance.permutation_importance(s.rows, s.nodes, s.leaves, importance.oob_donors(s.leaves)))


@query(f"WITH {PERM_SQL} SELECT row_id, feature::INT AS feature, round(100 * sum(d) / {TREES}.0::DOUBLE, 6) AS importance FROM d GROUP BY 1, 2")
def local_importance(spark, sf_dir):
    s = Stub(spark, sf_dir)
    return r6(importance.local_importance(s.rows, s.nodes, s.leaves, importance.oob_donors(s.leaves), TREES))


@query(f"WITH {STUB_SQL}, {STEPS_SQL} SELECT row_id, feature, round(sum(1.0::DOUBLE / d) / {TREES}, 6) AS importance FROM base, steps GROUP BY 1, 2")
def path_importance(spark, sf_dir):
    s = Stub(spark, sf_dir)
    return r6(importance.path_importance(s.rows, s.nodes, TREES))


# -- imputation --------------------------------------------------------------------------

FILL_SQL = "f0 AS (SELECT median(x0) AS f0 FROM masked), f1 AS (SELECT median(x1) AS f1 FROM masked), f2 AS (SELECT x2 AS f2 FROM masked WHERE x2 IS NOT NULL GROUP BY x2 ORDER BY count(*) DESC, x2 LIMIT 1)"


@query(f"WITH {MASKED_SQL}, {FILL_SQL} SELECT row_id, round(coalesce(x0, f0), 6) AS x0, round(coalesce(x1, f1), 6) AS x1, round(coalesce(x2, f2), 6) AS x2 FROM masked, f0, f1, f2")
def rough_impute(spark, sf_dir):
    return r6(impute.rough_impute(masked(spark, sf_dir), ["x0", "x1", "x2"], ["x2"]))


@query(f"""WITH {MASKED_SQL}, o AS (SELECT x0 AS v, row_number() OVER (ORDER BY row_id) - 1 AS place, count(*) OVER () AS n FROM masked WHERE x0 IS NOT NULL)
SELECT m.row_id, round(coalesce(m.x0, v), 6) AS x0 FROM masked m LEFT JOIN o ON m.x0 IS NULL AND place = {draw_sql("42", "'x0'", "m.row_id")} % (SELECT any_value(n) FROM o)""")
def random_impute(spark, sf_dir):
    return r6(impute.random_impute(masked(spark, sf_dir).select("row_id", "x0"), ["x0"]))


def _donor_sql(how: str) -> str:
    cells = " UNION ALL ".join(f"SELECT row_id, '{c}' AS feature, {c} AS value FROM masked" for c in ("x0", "x1"))
    end = (
        "SELECT i AS row_id, feature, round(sum(p * value) / sum(p), 6) AS value FROM d GROUP BY 1, 2" if how == "mean" else
        """SELECT i AS row_id, feature, round(min(value), 6) AS value FROM (SELECT *, sum(w) OVER (PARTITION BY i, feature ORDER BY value ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY i, feature) AS a
FROM (SELECT i, feature, value, sum(p) AS w FROM d GROUP BY 1, 2, 3)) WHERE c >= a / 2 - 1e-12 GROUP BY 1, 2""")
    return f"""WITH {MASKED_SQL.replace(BASE_SQL, STUB_SQL)}, cells AS ({cells}),
pairs AS (SELECT a.row_id AS i, b.row_id AS j, count(*) / {TREES}.0::DOUBLE AS p FROM leaves a JOIN leaves b USING (tree_id, leaf_id) WHERE a.row_id <> b.row_id GROUP BY 1, 2),
d AS (SELECT i, e.feature, v.value, p FROM cells e JOIN pairs ON i = e.row_id JOIN cells v ON v.row_id = j AND v.feature = e.feature WHERE e.value IS NULL AND v.value IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY i, e.feature ORDER BY p DESC, j) <= 10)
{end}"""


def _donors(spark, sf_dir, how):
    s, m = Stub(spark, sf_dir), masked(spark, sf_dir).select("row_id", "x0", "x1")
    return r6(impute.leaf_fills(m, s.leaves, TREES, ["x0", "x1"], (), 10, how))


@query(_donor_sql("mean"))
def prox_impute_topk_mean(spark, sf_dir):
    return _donors(spark, sf_dir, "mean")


@query(_donor_sql("median"))
def prox_impute_topk_median(spark, sf_dir):
    return _donors(spark, sf_dir, "median")


# -- metrics -----------------------------------------------------------------------------

def toxic(spark, sf_dir):
    """Labels with a score that follows from the text's length."""
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return read(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("doc_id").alias("row_id"), F.col("toxic").alias("y"), F.round(F.col("n_chars") % 1000 / 1000.0, 3).alias("score"))


TOXIC_SQL = "t AS (SELECT l.doc_id AS row_id, toxic AS y, round(n_chars % 1000 / 1000.0::DOUBLE, 3) AS score FROM labels l JOIN documents USING (doc_id))"
COUNT_SQL = "sum((y = 1 AND score >= {c})::INT)::BIGINT AS tp, sum((y <> 1 AND score < {c})::INT)::BIGINT AS tn, sum((y <> 1 AND score >= {c})::INT)::BIGINT AS fp, sum((y = 1 AND score < {c})::INT)::BIGINT AS fn"
CURVE_SQL = f"""{TOXIC_SQL}, e AS (SELECT score, sum((y = 1)::INT) AS p, sum((y <> 1)::INT) AS n FROM t GROUP BY 1),
c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM e WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""
RATE_SQL = """tp, tn, fp, fn, (tp + tn) / (tp + tn + fp + fn)::DOUBLE AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision,
CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall, CASE WHEN tn + fp > 0 THEN tn / (tn + fp)::DOUBLE ELSE 0 END AS specificity,
CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
(tp::DOUBLE * tn - fp::DOUBLE * fn) / greatest(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 1e-10) AS mcc"""
ROUND_RATES = "tp, tn, fp, fn, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("accuracy", "precision", "recall", "specificity", "f1", "mcc"))
AREA_SQL = "sum(n * (tp - p / 2.0::DOUBLE)) / (max(pos) * max(neg)) AS auc, sum(p * tp / (tp + fp)::DOUBLE) / max(pos) AS average_precision, max(tp / pos::DOUBLE - fp / neg::DOUBLE) AS ks"
LOSS_SQL = "avg((score - y) * (score - y)) AS brier, avg(-(y * ln(least(greatest(score, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)))) AS log_loss"


@query(f"WITH {TOXIC_SQL} SELECT {COUNT_SQL.format(c='0.5')} FROM t")
def confusion(spark, sf_dir):
    return metrics.confusion_counts(toxic(spark, sf_dir))


@query(_vote_sql("1", False, """, p AS (SELECT row_id, class FROM v QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY votes DESC, class) = 1),
k AS (SELECT y AS a, class AS b, count(*) AS n FROM p JOIN base USING (row_id) GROUP BY 1, 2)
SELECT x.a::INT AS actual, z.b::INT AS predicted, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(3)) AS a) x CROSS JOIN (SELECT unnest(range(3)) AS b) z LEFT JOIN k ON k.a = x.a AND k.b = z.b"""))
def confusion_matrix(spark, sf_dir):
    s = Stub(spark, sf_dir)
    p = votes.argmax_class(votes.class_votes(votes.with_leaf(s.leaves, s.nodes))).join(s.rows, "row_id")
    return metrics.confusion_matrix(p, 3)


@query(_vote_sql("1", False, """, p AS (SELECT row_id, class, y FROM v JOIN base USING (row_id) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY votes DESC, class) = 1),
k AS (SELECT c AS class, sum((y = c)::INT) AS s, sum((class = c)::INT) AS q, sum((y = c AND class = c)::INT) AS h FROM p, (SELECT unnest(range(3)) AS c) GROUP BY 1)
SELECT class::INT AS class, round(CASE WHEN q > 0 THEN h / q::DOUBLE ELSE 0 END, 6) AS precision, round(CASE WHEN s > 0 THEN h / s::DOUBLE ELSE 0 END, 6) AS recall,
round(CASE WHEN h > 0 THEN 2.0::DOUBLE * h / (s + q) ELSE 0 END, 6) AS f1, s::BIGINT AS support FROM k"""))
def class_report(spark, sf_dir):
    s = Stub(spark, sf_dir)
    p = votes.argmax_class(votes.class_votes(votes.with_leaf(s.leaves, s.nodes))).join(s.rows.select("row_id", F.col("y").cast("int").alias("y")), "row_id")
    return r6(metrics.classification_report(p))


@query(f"WITH {CURVE_SQL} SELECT score AS threshold, round(fp / neg::DOUBLE, 6) AS fpr, round(tp / pos::DOUBLE, 6) AS tpr FROM c")
def roc(spark, sf_dir):
    return r6(metrics.roc_curve(toxic(spark, sf_dir)).filter("threshold < 2"))


@query(f"WITH {CURVE_SQL} SELECT score AS threshold, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / pos::DOUBLE, 6) AS recall FROM c")
def pr(spark, sf_dir):
    return r6(metrics.pr_curve(toxic(spark, sf_dir)).filter("threshold < 2"))


@query(f"WITH {CURVE_SQL}, a AS (SELECT {AREA_SQL} FROM c) SELECT round(auc, 6) AS auc, round(2 * auc - 1, 6) AS gini, round(average_precision, 6) AS average_precision, round(ks, 6) AS ks FROM a")
def auc(spark, sf_dir):
    return r6(metrics.areas(toxic(spark, sf_dir)))


@query(f"WITH {CURVE_SQL}, p AS (SELECT 0.0::DOUBLE AS x, 0.0::DOUBLE AS y UNION ALL SELECT fp / neg::DOUBLE, tp / pos::DOUBLE FROM c), s AS (SELECT x - lag(x) OVER (ORDER BY x, y) AS dx, (y + lag(y) OVER (ORDER BY x, y)) / 2 AS h FROM p) SELECT round(sum(dx * h), 6) AS area FROM s")
def trapezoid_area(spark, sf_dir):
    return r6(metrics.trapezoid(metrics.roc_curve(toxic(spark, sf_dir)), "fpr", "tpr"))


@query(f"WITH {TOXIC_SQL}, l AS (SELECT {LOSS_SQL} FROM t) SELECT round(brier, 6) AS brier, round(log_loss, 6) AS log_loss FROM l")
def brier_logloss(spark, sf_dir):
    return r6(metrics.brier_logloss(toxic(spark, sf_dir)))


GRID_SQL = f"g AS (SELECT unnest([{', '.join(map(repr, metrics.thresholds()))}]::DOUBLE[]) AS threshold)"
SWEEP_SQL = f"{TOXIC_SQL}, {GRID_SQL}, k AS (SELECT threshold, {COUNT_SQL.format(c='threshold')} FROM g, t GROUP BY 1), sweep AS (SELECT threshold, {RATE_SQL} FROM k)"


@query(f"WITH {SWEEP_SQL} SELECT threshold, {ROUND_RATES} FROM sweep")
def threshold_sweep(spark, sf_dir):
    return metrics.threshold_sweep(toxic(spark, sf_dir)).select("threshold", "tp", "tn", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "specificity", "f1", "mcc")])


@query(f"WITH {SWEEP_SQL} SELECT threshold, round(f1, 6) AS f1, round(recall, 6) AS recall FROM sweep WHERE recall >= 0.3 ORDER BY round(f1, 12) DESC, threshold LIMIT 1")
def tune_threshold(spark, sf_dir):
    best = metrics.tune_threshold(toxic(spark, sf_dir), min_recall=0.3)
    return best.select("threshold", F.round("f1", 6).alias("f1"), F.round("recall", 6).alias("recall"))


EVAL_SQL = f"""WITH {CURVE_SQL}, a AS (SELECT {AREA_SQL} FROM c), l AS (SELECT {LOSS_SQL} FROM t), k AS (SELECT {COUNT_SQL.format(c='0.5')} FROM t), s AS (SELECT {RATE_SQL} FROM k)
SELECT {ROUND_RATES}, round(auc, 6) AS auc, round(2 * auc - 1, 6) AS gini, round(average_precision, 6) AS average_precision, round(ks, 6) AS ks, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, tp + tn + fp + fn AS support FROM s, a, l"""


@query(EVAL_SQL)
def evaluate(spark, sf_dir):
    return r6(metrics.evaluate(toxic(spark, sf_dir)))


@query(f"""WITH {TOXIC_SQL}, m AS (SELECT 'length' AS model, y, score FROM t UNION ALL SELECT 'reverse', y, round(1 - score, 3) FROM t),
e AS (SELECT model, score, sum((y = 1)::INT) AS p, sum((y <> 1)::INT) AS n FROM m GROUP BY 1, 2),
c AS (SELECT *, sum(p) OVER w AS tp, sum(p) OVER (PARTITION BY model) AS pos, sum(n) OVER (PARTITION BY model) AS neg FROM e WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
a AS (SELECT model, sum(n * (tp - p / 2.0::DOUBLE)) / (max(pos) * max(neg)) AS auc FROM c GROUP BY 1)
SELECT model, round(auc, 6) AS auc, (row_number() OVER (ORDER BY round(auc, 12) DESC, model))::INT AS rank FROM a""")
def compare(spark, sf_dir):
    t = toxic(spark, sf_dir)
    return r6(metrics.compare({"length": t, "reverse": t.withColumn("score", F.round(1 - F.col("score"), 3))}).select("model", "auc", "rank"))


@query(f"WITH {TOXIC_SQL} SELECT least(floor(round(score * 100) / 10), 9)::INT AS bin, round(avg(score), 6) AS mean_predicted, round(avg(y), 6) AS fraction_positive, count(*) AS n FROM (SELECT y, round(score * 100) / 100 AS score FROM t) GROUP BY 1")
def calibration(spark, sf_dir):
    return r6(metrics.calibration(toxic(spark, sf_dir).withColumn("score", F.round(F.col("score") * 100) / 100)))


@query("""WITH p AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem), a AS (SELECT count(*) AS n, avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae, corr(y, p) AS corr, var_pop(y) AS v FROM p)
SELECT n, round(mse, 3) AS mse, round(sqrt(mse), 6) AS rmse, round(mae, 6) AS mae, round(corr, 6) AS corr, round(1 - mse / v, 6) AS r2 FROM a""")
def regression_metrics(spark, sf_dir):
    p = read(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("prediction"))
    return metrics.regression(p).select("n", F.round("mse", 3).alias("mse"), *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "corr", "r2")])


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, round(avg(value), 6) AS value FROM events GROUP BY 1")
def daily_means(spark, sf_dir):
    return r6(metrics.daily_means(read(spark, sf_dir, "events"), "ts", ["value"]).withColumn("day", F.col("day").cast("string")))


@query("""WITH r AS (SELECT o_custkey AS u, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, (o_orderkey % 4) AS rel FROM orders),
i AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY rel DESC, rank) AS best FROM r)
SELECT u AS "user", round(CASE WHEN sum(CASE WHEN best <= 10 THEN rel / log2(best + 1) ELSE 0 END) > 0 THEN sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN best <= 10 THEN rel / log2(best + 1) ELSE 0 END) ELSE 0 END, 6) AS ndcg,
max((rank <= 10 AND rel > 0)::INT)::DOUBLE AS hit_rate FROM i GROUP BY 1""")
def ndcg_hr(spark, sf_dir):
    from pyspark.sql import Window

    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("rank"), (F.col("o_orderkey") % 4).alias("relevance"))
    return r6(metrics.ndcg(o, 10))


RECO_SQL = """e AS (SELECT DISTINCT user_id AS u, (event_id % 40) AS item FROM events WHERE value >= 100), seen AS (SELECT DISTINCT user_id AS u, (event_id % 40) AS item FROM events),
z AS (SELECT item, count(*) AS n FROM e GROUP BY 1), c AS (SELECT a.item AS a, b.item AS b, count(*) AS k FROM e a JOIN e b USING (u) WHERE a.item <> b.item GROUP BY 1, 2),
nb AS (SELECT a AS item, b AS other, round(k / (x.n + y.n - k)::DOUBLE, 9) AS p FROM c JOIN z x ON x.item = a JOIN z y ON y.item = b),
s AS (SELECT u, other AS item, round(sum(p), 9) AS score FROM e JOIN nb USING (item) GROUP BY 1, 2),
rec AS (SELECT u, item, score, (row_number() OVER (PARTITION BY u ORDER BY score DESC, item))::INT AS rank FROM s WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.u = s.u AND seen.item = s.item) QUALIFY rank <= 20)"""


def _recommended(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("user"), (F.col("event_id") % 40).alias("item"), "value")
    liked, seen = e.filter("value >= 100").select("user", "item").distinct(), e.select("user", "item").distinct()
    p = similar.jaccard_pairs(liked.select(F.col("item").alias("id"), F.col("user").alias("item")), 0.0)
    p = p.withColumn("jaccard", F.round("jaccard", 9))
    neighbours = p.select(F.col("a").alias("item"), F.col("b").alias("other"), F.col("jaccard").alias("p")).union(p.select("b", "a", "jaccard"))
    return metrics.recommend(liked, seen, neighbours, 20)


@query(f'WITH {RECO_SQL} SELECT u AS "user", item, round(score, 6) AS score, rank FROM rec')
def user_recommend(spark, sf_dir):
    return r6(_recommended(spark, sf_dir))


@query(f"""WITH {RECO_SQL}, rel AS (SELECT DISTINCT user_id AS u, (event_id * 7 % 40) AS item FROM events WHERE event_id % 3 = 0),
k AS (SELECT u, count(*) AS n FROM rel GROUP BY 1), h AS (SELECT u, sum(1 / log2(rank + 1)) AS dcg FROM rec JOIN rel USING (u, item) WHERE rank <= 10 GROUP BY 1)
SELECT u AS "user", round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(10, n) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg, (dcg IS NOT NULL)::INT::DOUBLE AS hit_rate FROM k LEFT JOIN h USING (u)""")
def user_ranking(spark, sf_dir):
    rel = read(spark, sf_dir, "events").filter("event_id % 3 = 0").select(F.col("user_id").alias("user"), (F.col("event_id") * 7 % 40).alias("item")).distinct()
    return r6(metrics.user_ranking(_recommended(spark, sf_dir), rel, 10))


@query("""WITH v AS (SELECT vec_id, unnest(range(len(embedding))) AS k, embedding FROM embeddings), x AS (SELECT vec_id, k, embedding[k + 1]::DOUBLE AS v FROM v),
c AS (SELECT *, trunc(greatest(least(v / 0.02::DOUBLE + 3, 127), -128))::INT AS i8, (least(floor(abs(v) * 7 + 0.5), 7) + CASE WHEN v < 0 THEN 8 ELSE 0 END)::INT AS n4 FROM x)
SELECT vec_id, k::INT AS k, i8, n4, round((i8 - 3) * 0.02::DOUBLE, 6) AS i8_back, round(CASE WHEN n4 >= 8 THEN (8 - n4) / 7.0::DOUBLE ELSE n4 / 7.0::DOUBLE END, 6) AS n4_back FROM c""")
def quant_codec(spark, sf_dir):
    """Codes of all entries of each vector and what they decode to."""
    return _quantised(read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v")))


def _quantised(e):
    e = e.withColumn("v", F.col("v").cast("double"))
    e = e.select("vec_id", "k", portable.int8_encode(F.col("v"), 0.02, 3).alias("i8"), portable.nf4_encode(F.col("v")).alias("n4"))
    return r6(e.select("*", portable.int8_decode(F.col("i8"), 0.02, 3).alias("i8_back"), portable.nf4_decode(F.col("n4")).alias("n4_back")))


# -- grown forests: rows only, invariants are tested --------------------------------------

def _learnable(spark, sf_dir):
    c = customers(spark, sf_dir)
    return c.select("row_id", "x0", "x1", "x2", (F.col("x0") / 1000 + F.col("x1") / 5 > 7).cast("int").alias("label"), (F.col("x0") / 1000 + F.col("x1") / 5).alias("target"))


@query()
def grow_classifier(spark, sf_dir):
    from copse.plans.estimators import ForestClassifier

    model = ForestClassifier(["x0", "x1", "x2"], "label", n_trees=10, max_depth=8, n_bins=64).fit(_learnable(spark, sf_dir))
    return model.oob_predictions()


@query()
def grow_regressor(spark, sf_dir):
    from copse.plans.estimators import ForestRegressor

    return ForestRegressor(["x0", "x1", "x2"], "target", n_trees=10, max_depth=8, n_bins=64, min_node=5).fit(_learnable(spark, sf_dir)).oob_predictions()


@query()
def unsupervised_anomaly(spark, sf_dir):
    """The chance of being synthetic, of rows some of which were made anomalous."""
    from copse.plans.estimators import ForestUnsupervised

    c = customers(spark, sf_dir).select("row_id", "x0", "x1")
    model = ForestUnsupervised(["x0", "x1"], n_trees=10, max_depth=8, n_bins=64).fit(c)
    return model.predict_proba(prep.inject_anomalies(c, ["x0", "x1"], 0.05))


@query()
def forest_impute(spark, sf_dir):
    return impute.forest_impute(masked(spark, sf_dir), ["x0", "x1", "x2"], n_trees=5, params={"max_depth": 5, "n_bins": 32})[0]


@query()
def scaling_coordinates(spark, sf_dir):
    from copse.operators import embed

    return embed.leaf_scaling(Stub(spark, sf_dir).leaves, 3)
