"""More registered queries with their SQL: what new rows, other tasks and other modes of the core operators give."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from copse.functions.portable import draw_sql
from copse.operators import embed, forest, importance, metrics, outlier, prep, proximity, similar, split, votes
from copse.plans import stub
from copse.plans.catalog import (
    FINISH_SQL, FULL_SQL, NEW_SQL, ORACLES, PERM_SQL, PROX_IMP_SQL, SWEEP_SQL, TOXIC_SQL, _learnable, _norm_sql, _supplier_rows, _vote_sql, query, r6, read, toxic,
)
from copse.plans.storage import materialised, shared_dir
from copse.plans.stub import BASE_SQL, STUB_SQL, TREES, Stub, customers

# -- changed values ------------------------------------------------------------------------

REPEATS = 3


def _swapped_sql(table: str = "base") -> str:
    """swapped: each row with each feature in turn taken from each of its donors; moved: its leaves."""
    names = stub.FEATURES
    parts = " UNION ALL ".join(f"SELECT b.row_id, k, {f} AS f, {', '.join(f'd.{c}' if i == f else f'b.{c}' for i, c in enumerate(names))} FROM {table} b JOIN don USING (row_id) JOIN {table} d ON d.row_id = donor" for f in range(3))
    return f"""don AS (SELECT row_id, k, {draw_sql("12345", "row_id", "k")} % (SELECT n FROM n) AS donor FROM {table}, (SELECT unnest(range({REPEATS})) AS k)),
swapped(row_id, k, f, x0, x1, x2) AS ({parts}),
moved AS ({" UNION ALL ".join(f"SELECT {t} AS tree_id, row_id, k, f, {stub.leaf_sql(t)} AS leaf_id FROM swapped" for t in range(TREES))})"""


@query(f"""WITH {STUB_SQL}, {_swapped_sql()},
now AS (SELECT row_id, k, f, node_class AS c FROM moved JOIN ends USING (tree_id, leaf_id) GROUP BY row_id, k, f, node_class QUALIFY row_number() OVER (PARTITION BY row_id, k, f ORDER BY count(*) DESC, node_class) = 1),
was AS (SELECT row_id, node_class AS c FROM routed JOIN ends USING (tree_id, leaf_id) GROUP BY row_id, node_class QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY count(*) DESC, node_class) = 1)
SELECT row_id, f::INT AS feature, round(avg((now.c <> was.c)::INT), 6) AS importance FROM now JOIN was USING (row_id) GROUP BY 1, 2""")
def predicted_permutation(spark, sf_dir):
    s = Stub(spark, sf_dir)
    return r6(importance.predicted_permutation(s.rows, s.nodes, 3, REPEATS))


@query(f"""WITH {STUB_SQL}, {_swapped_sql()}
SELECT m.row_id, f::INT AS feature, round(sum((m.leaf_id <> r.leaf_id)::INT) / ({TREES} * {REPEATS})::DOUBLE, 6) AS importance FROM moved m JOIN routed r ON r.tree_id = m.tree_id AND r.row_id = m.row_id GROUP BY 1, 2""")
def predicted_proximity_importance(spark, sf_dir):
    s = Stub(spark, sf_dir)
    return r6(importance.predicted_proximity_importance(s.rows, s.nodes, 3, REPEATS))


CHANGE_SQL = f"""{STUB_SQL}, {_swapped_sql()},
now AS (SELECT row_id, k, f, avg(node_pred) AS p FROM moved JOIN ends USING (tree_id, leaf_id) GROUP BY 1, 2, 3),
was AS (SELECT row_id, avg(node_pred) AS p FROM routed JOIN ends USING (tree_id, leaf_id) GROUP BY 1)"""


@query(f"WITH {CHANGE_SQL} SELECT row_id, f::INT AS feature, round(median(abs(now.p - was.p)), 6) AS importance FROM now JOIN was USING (row_id) GROUP BY 1, 2")
def median_change(spark, sf_dir):
    s = Stub(spark, sf_dir)
    return r6(importance.median_change(s.rows, s.nodes, 3, REPEATS))


@query(f"WITH {CHANGE_SQL} SELECT row_id, f::INT AS feature, round(avg(abs(now.p - was.p)), 6) AS importance FROM now JOIN was USING (row_id) GROUP BY 1, 2")
def predicted_permutation_regress(spark, sf_dir):
    s = Stub(spark, sf_dir)
    return r6(importance.predicted_permutation(s.rows, s.nodes, 3, REPEATS, "regress"))


REGRESS_SQL = PERM_SQL.replace("x2, y, donor", "x2, t, donor").replace("(e2.node_class <> y)::INT - (e1.node_class <> y)::INT AS d", "(e2.node_pred - t) * (e2.node_pred - t) - (e1.node_pred - t) * (e1.node_pred - t) AS d")


@query(f"""WITH {REGRESS_SQL}, m AS (SELECT tree_id, feature, avg(d) AS d FROM d GROUP BY 1, 2)
SELECT feature::INT AS feature, round(sum(d), 6) AS importance, round(sum(d * d), 6) AS sqsd FROM m GROUP BY 1""")
def perm_importance_regress(spark, sf_dir):
    """Permutation importance by squared error."""
    s = Stub(spark, sf_dir, "t")
    return r6(importance.permutation_importance(s.rows, s.nodes, s.leaves, importance.oob_donors(s.leaves), "regress"))


@query(f"WITH {REGRESS_SQL} SELECT row_id, feature::INT AS feature, round(100 * sum(d) / {TREES}.0::DOUBLE, 6) AS importance FROM d GROUP BY 1, 2")
def local_importance_regress(spark, sf_dir):
    s = Stub(spark, sf_dir, "t")
    return r6(importance.local_importance(s.rows, s.nodes, s.leaves, importance.oob_donors(s.leaves), TREES, "regress"))


# -- rows made anomalous, clusters, resamples ------------------------------------------------

def _anomalous_sql(i: int, c: str, p: int = 2) -> str:
    u = lambda *parts: f"({draw_sql('42', *parts)} / 1152921504606846976.0::DOUBLE)"
    point = f"CASE WHEN (({i} - {draw_sql('42', chr(39) + 'first' + chr(39), 'b.row_id')}) % {p} + {p}) % {p} < 1 + floor({u(chr(39) + 'count' + chr(39), 'b.row_id')} * 3) THEN b.{c} + CASE WHEN {u(f'{chr(39)}{c}{chr(39)}', chr(39) + 'sign' + chr(39), 'b.row_id')} < 0.5 THEN -1.0 ELSE 1.0 END::DOUBLE * (5 + 5 * {u(f'{chr(39)}{c}{chr(39)}', chr(39) + 'size' + chr(39), 'b.row_id')}) * s_{c} ELSE b.{c} END"
    swap = f"CASE WHEN ({i} + {draw_sql('42', chr(39) + 'swap' + chr(39), 'b.row_id')}) % {p} < {max(1, p // 2)} THEN d.{c} ELSE b.{c} END"
    shift = f"b.{c} + (2 + 2 * {u(chr(39) + 'shift' + chr(39), f'{chr(39)}{c}{chr(39)}')}) * s_{c}"
    return f"round(CASE WHEN NOT hit THEN b.{c} WHEN kind = 0 THEN {point} WHEN kind = 1 THEN {swap} ELSE {shift} END, 6) AS {c}"


@query(f"""WITH {BASE_SQL}, s AS (SELECT stddev_pop(x0) AS s_x0, stddev_pop(x1) AS s_x1 FROM base),
b AS (SELECT row_id, x0, x1, {draw_sql("42", "'hit'", "row_id")} / 1152921504606846976.0::DOUBLE < 0.1::DOUBLE AS hit, floor({draw_sql("42", "'kind'", "row_id")} / 1152921504606846976.0::DOUBLE * 3) AS kind, {draw_sql("42", "'donor'", "row_id")} % (SELECT n FROM n) AS donor FROM base)
SELECT b.row_id, {_anomalous_sql(0, "x0")}, {_anomalous_sql(1, "x1")}, hit::INT AS is_anomaly FROM b JOIN base d ON d.row_id = donor CROSS JOIN s""")
def anomalies(spark, sf_dir):
    return r6(prep.inject_anomalies(customers(spark, sf_dir).select("row_id", "x0", "x1"), ["x0", "x1"], 0.1))


@query(f"""WITH RECURSIVE {FINISH_SQL}, near AS (SELECT j, list(i) AS before FROM prox WHERE p > 0.5 AND i < j GROUP BY 1),
listed AS (SELECT row_id, coalesce(before, []) AS before FROM base LEFT JOIN near ON j = row_id),
steps(place, seeds) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT place + 1, CASE WHEN list_has_any(seeds, before) THEN seeds ELSE list_append(seeds, row_id) END FROM steps JOIN listed ON row_id = place),
last AS (SELECT seeds FROM steps ORDER BY place DESC LIMIT 1),
seed AS (SELECT row_id, CASE WHEN list_contains(seeds, row_id) THEN row_id ELSE list_min(list_intersect(seeds, before)) END AS s FROM listed, last)
SELECT row_id, (dense_rank() OVER (ORDER BY s) - 1)::INT AS label FROM seed""")
def cluster_labels(spark, sf_dir):
    leaves = Stub(spark, sf_dir).leaves
    return proximity.leaf_cluster_labels(leaves, 0.5).select("row_id", F.col("label").cast("int").alias("label"))


@query(f"""WITH {TOXIC_SQL}, r AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS i, y, score FROM t), n AS (SELECT count(*) AS n FROM r),
drawn AS (SELECT rep, {draw_sql("42", "rep", "d")} % (SELECT n FROM n) AS i FROM (SELECT unnest(range(50)) AS rep), (SELECT unnest(range((SELECT n FROM n))) AS d)),
e AS (SELECT rep, score, sum((y = 1)::INT) AS p, sum((y <> 1)::INT) AS n FROM drawn JOIN r USING (i) GROUP BY 1, 2),
c AS (SELECT *, sum(p) OVER (PARTITION BY rep ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp FROM e),
a AS (SELECT rep, sum(n * (tp - p / 2.0::DOUBLE)) / (sum(p) * sum(n)) AS v FROM c GROUP BY 1 HAVING sum(p) > 0 AND sum(n) > 0)
SELECT 'auc' AS metric, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(*) AS replicates FROM a""")
def bootstrap_ci(spark, sf_dir):
    t = prep.with_row_id(toxic(spark, sf_dir).withColumnRenamed("row_id", "id"), ["id"])
    return r6(metrics.bootstrap_ci(t, replicates=50))


# -- splits, errors, thresholds ----------------------------------------------------------------

@query("""WITH h AS (SELECT l_quantity AS v, count(*) AS n, sum(l_extendedprice / 1000) AS s FROM lineitem GROUP BY 1),
c AS (SELECT v, lead(v) OVER (ORDER BY v) AS above, sum(n) OVER w AS n0, sum(s) OVER w AS s0, sum(n) OVER () AS an, sum(s) OVER () AS asum FROM h WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)),
s AS (SELECT (v + above) / 2 AS split_value, n0 AS n_left, an - n0 AS n_right, s0 * s0 / n0 + (asum - s0) * (asum - s0) / (an - n0) AS score, v FROM c WHERE above IS NOT NULL)
SELECT round(split_value, 6) AS split_value, n_left::DOUBLE AS n_left, n_right::DOUBLE AS n_right FROM s ORDER BY round(score, 4) DESC, v LIMIT 1""")
def mse_split_exact(spark, sf_dir):
    """The cut of least squared error at every value boundary, without bins."""
    df = read(spark, sf_dir, "lineitem").select(F.lit("q").alias("feature"), F.col("l_quantity").alias("value"), (F.col("l_extendedprice") / 1000).alias("t"))
    cand = split.exact_candidates(df, [], "regress", split.moments(F.col("t"), F.lit(1.0)), 3)
    best = split.best(cand.withColumn("score", F.round("score", 4)), ["feature"])
    return r6(best.select("split_value", split.size_of(F.col("left"), "regress").alias("n_left"), split.size_of(F.col("right"), "regress").alias("n_right")))


@query(_vote_sql("1", False, """, p AS (SELECT row_id, class FROM v QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY votes DESC, class) = 1)
SELECT round(avg((class <> y)::INT), 6) AS error_rate FROM p JOIN base USING (row_id)"""))
def error_rate(spark, sf_dir):
    s = Stub(spark, sf_dir)
    p = votes.argmax_class(votes.class_votes(votes.with_leaf(s.leaves, s.nodes))).join(s.rows.select("row_id", "y"), "row_id")
    return r6(votes.error_rate(p))


@query(f"WITH {SWEEP_SQL} SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM sweep ORDER BY round(abs(recall - 0.6), 12), threshold LIMIT 1")
def target_recall(spark, sf_dir):
    """The threshold whose recall is nearest to a target."""
    best = metrics.tune_threshold(toxic(spark, sf_dir), target_recall=0.6)
    return best.select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"WITH {SWEEP_SQL} SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM sweep ORDER BY round(abs(precision - 0.05), 12), threshold LIMIT 1")
def target_precision(spark, sf_dir):
    best = metrics.tune_threshold(toxic(spark, sf_dir), target_precision=0.05)
    return best.select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"""WITH {SWEEP_SQL} SELECT threshold, round(CASE WHEN precision + recall > 0 THEN 5 * precision * recall / (4 * precision + recall) ELSE 0 END, 6) AS fbeta FROM sweep
ORDER BY round(CASE WHEN precision + recall > 0 THEN 5 * precision * recall / (4 * precision + recall) ELSE 0 END, 12) DESC, threshold LIMIT 1""")
def tune_fbeta(spark, sf_dir):
    """The threshold of highest F-score that weighs recall twice."""
    best = metrics.tune_threshold(toxic(spark, sf_dir), "fbeta", 2.0)
    return best.select("threshold", F.round("goal", 6).alias("fbeta"))


# -- anchors, scores of new rows -----------------------------------------------------------------

def _diverse_sql(k: int) -> str:
    """chosen0, chosen1, ...: one anchor each, by unrolled steps."""
    out = [f"chosen0 AS (SELECT row_id FROM base ORDER BY {draw_sql('12345', 'row_id')}, row_id LIMIT 1)", "state0 AS (SELECT row_id, 0.0::DOUBLE AS p FROM base)"]
    for i in range(1, k):
        taken = " UNION ALL ".join(f"SELECT row_id FROM chosen{j}" for j in range(i))
        out.append(f"""near{i} AS (SELECT a.row_id, count(*) / {TREES}.0::DOUBLE AS q FROM leaves a JOIN leaves b USING (tree_id, leaf_id) WHERE b.row_id = (SELECT row_id FROM chosen{i - 1}) GROUP BY 1),
state{i} AS (SELECT row_id, greatest(p, coalesce(q, 0)) AS p FROM state{i - 1} LEFT JOIN near{i} USING (row_id)),
chosen{i} AS (SELECT row_id FROM state{i} WHERE row_id NOT IN ({taken}) ORDER BY p, row_id LIMIT 1)""")
    return ", ".join(out)


@query(f"WITH {STUB_SQL}, {_diverse_sql(6)} " + " UNION ALL ".join(f"SELECT row_id FROM chosen{i}" for i in range(6)))
def diverse_anchors(spark, sf_dir):
    return outlier.diverse_anchors(Stub(spark, sf_dir).leaves, 6, TREES)


@query(f"""WITH {STUB_SQL}, anchors AS (SELECT row_id AS j FROM base ORDER BY {draw_sql("12345", "row_id")}, row_id LIMIT 20),
c AS (SELECT a.row_id, b.row_id AS j, count(*) / {TREES}.0::DOUBLE AS p FROM leaves a JOIN leaves b USING (tree_id, leaf_id) WHERE b.row_id IN (SELECT j FROM anchors) AND a.row_id <> b.row_id GROUP BY 1, 2),
sq AS (SELECT row_id, sum(p * p) AS s FROM c GROUP BY 1)
SELECT row_id, round(CASE WHEN coalesce(s, 0) <= 1e-10 THEN (SELECT n FROM n) * 1e10 ELSE (20 - (row_id IN (SELECT j FROM anchors))::INT) / s END, 6) AS raw FROM base LEFT JOIN sq USING (row_id)""")
def outlier_used_anchors(spark, sf_dir):
    """Scores whose numerator counts only the anchors that are other rows."""
    s = Stub(spark, sf_dir)
    return r6(outlier.anchor_scores(s.leaves, outlier.random_anchors(s.rows, 20), TREES, used_only=True))


@query(f"""WITH {NEW_SQL}, {FULL_SQL[len(STUB_SQL) + 2:]}, {_norm_sql('')},
new_sq AS (SELECT i, sum(p * p) AS s, count(*) AS k FROM near GROUP BY 1),
new_raw AS (SELECT row_id, round(CASE WHEN coalesce(s, 0) <= 1e-10 THEN (SELECT n FROM n) * 1e10 ELSE k / s END, 6) AS raw FROM new LEFT JOIN new_sq ON i = row_id)
SELECT row_id, raw, round((raw - centre) / spread, 3) AS score FROM new_raw, (SELECT DISTINCT centre, spread FROM normed)""")
def outlier_predict_normalised(spark, sf_dir):
    """New rows' scores by the centre and spread of the training rows'."""
    s = Stub(spark, sf_dir)
    raw = outlier.predicted_raw(forest.route(_supplier_rows(spark, sf_dir), s.nodes), s.leaves, TREES).withColumn("raw", F.round("raw", 6))
    stats = outlier.normalised(outlier.full_scores(s.leaves, TREES).withColumn("raw", F.round("raw", 6)))
    return outlier.predicted_scores(raw, stats).withColumn("score", F.round("score", 3))


# -- bags, readers, streams ------------------------------------------------------------------------

@query(f"WITH {STUB_SQL} SELECT tree_id::INT AS tree_id, row_id, nin::BIGINT AS nin FROM leaves WHERE nin > 0")
def in_bag(spark, sf_dir):
    """How often each tree has drawn each of its rows."""
    s = Stub(spark, sf_dir)
    return prep.in_bag(s.rows.select("row_id"), s.bag).select("tree_id", "row_id", F.col("nin").cast("long").alias("nin"))


@query("SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def csv_read(spark, sf_dir):
    """A table written as CSV in the shared folder and read back by the dense reader."""
    from copse.sources.datasets import read_dense

    path = f"{shared_dir(spark)}/copse-core/{uuid.uuid4().hex}.csv"
    read(spark, sf_dir, "region").select("r_regionkey", "r_name").write.option("header", True).csv(path)
    return read_dense(spark, path).select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name")


@query(_vote_sql("1", False, """, p AS (SELECT row_id, class FROM v QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY votes DESC, class) = 1)
SELECT row_id, class::INT AS prediction FROM p"""))
def stream_score(spark, sf_dir):
    """Customers read as a stream of files, each batch scored by the static forest."""
    from copse.streaming.score import score_stream

    s = Stub(spark, sf_dir)
    path = f"{shared_dir(spark)}/copse-core/stream-{uuid.uuid4().hex}"
    s.rows.select("row_id", "x").repartition(4).write.parquet(f"{path}/rows")
    rows = spark.readStream.schema(s.rows.select("row_id", "x").schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/rows")
    answer = lambda batch: votes.argmax_class(votes.class_votes(votes.with_leaf(forest.route(batch, s.nodes), s.nodes)))
    score_stream(rows, answer, f"{path}/scores", f"{path}/progress").awaitTermination()
    return spark.read.parquet(f"{path}/scores").select("row_id", "prediction")


# -- out-of-bag answers, loaded models, sparse rows -------------------------------------------------

@query(_vote_sql("1", True, """, p AS (SELECT row_id, class FROM v QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY votes DESC, class) = 1)
SELECT row_id, y::INT AS y, class::INT AS prediction FROM base LEFT JOIN p USING (row_id)"""))
def oob_predictions(spark, sf_dir):
    """Each row's class by the trees that have not drawn it; null where all have."""
    s = Stub(spark, sf_dir)
    out = votes.oob_predictions(votes.with_leaf(s.leaves, s.nodes), s.rows)
    return out.select("row_id", F.col("y").cast("int").alias("y"), "prediction")


@query(f"WITH {BASE_SQL} SELECT row_id, k::INT AS k, {draw_sql('12345', 'row_id', 'k')} % (SELECT n FROM n) AS donor FROM base, (SELECT unnest(range(4)) AS k)")
def row_donors(spark, sf_dir):
    return importance.row_donors(Stub(spark, sf_dir).rows, 4)


def _loaded(spark, sf_dir):
    """The stub's forest, saved in the shared folder and loaded again."""
    from copse.plans.estimators import FittedClassifier
    from copse.plans.model import Model

    s = Stub(spark, sf_dir)
    labels = spark.createDataFrame([(k, k) for k in range(stub.CLASSES)], "label int, code long")
    path = f"{shared_dir(spark)}/copse-core/model-{uuid.uuid4().hex}"
    Model(forest.GrowParams(n_trees=TREES), list(stub.FEATURES), "classify", {"nodes": s.nodes, "bag": s.bag, "rows": s.rows, "leaves": s.leaves, "labels": labels}).save(path)
    return s, FittedClassifier.load(spark, path)


@query(_vote_sql("1", False, """, p AS (SELECT row_id, class FROM v QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY votes DESC, class) = 1)
SELECT row_id, class::INT AS label FROM p"""))
def loaded_predict(spark, sf_dir):
    s, model = _loaded(spark, sf_dir)
    return model.predict(s.raw)


@query(ORACLES["topk_similar"])
def loaded_topk(spark, sf_dir):
    s, model = _loaded(spark, sf_dir)
    return r6(model.top_similar(s.rows.filter("row_id % 50 = 0"), 10))


def _entries(spark, sf_dir):
    """What is stored of the customers' second and third feature: all but zeros."""
    c = customers(spark, sf_dir)
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(x).alias("value")) for x in ("x1", "x2")])).alias("e")
    return c, c.select("row_id", each).select("row_id", "e.*").filter("value <> 0")


@query(f"WITH {BASE_SQL} SELECT row_id, x1, x2 FROM base")
def sparse_ingest(spark, sf_dir):
    c, entries = _entries(spark, sf_dir)
    return prep.from_sparse(entries, ["x1", "x2"], c)


@query(f"""WITH {BASE_SQL}, e AS (SELECT row_id, 'x1' AS feature, x1 AS value FROM base WHERE x1 <> 0 UNION ALL SELECT row_id, 'x2', x2 FROM base WHERE x2 <> 0),
cells AS (SELECT d, feature, {draw_sql("'sp'", "feature", "d")} % (SELECT n FROM n) AS row_id FROM (SELECT unnest(range((SELECT n FROM n))) AS d), (SELECT unnest(['x1', 'x2']) AS feature))
SELECT d + (SELECT n FROM n) AS row_id, feature, value FROM cells JOIN e USING (row_id, feature)""")
def sparse_synthetic(spark, sf_dir):
    c, entries = _entries(spark, sf_dir)
    return prep.synthetic_sparse(entries, c.count(), ["x1", "x2"], 1.0, "sp")


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_unique, max(abs({c} - round({c}))) <= 1e-5 AND count(DISTINCT {c}) <= 60 AS categorical FROM part" for c in ("p_size", "p_retailprice", "p_partkey")))
def detect_kinds_imputer(spark, sf_dir):
    return prep.kinds(read(spark, sf_dir, "part").select("p_size", "p_retailprice", "p_partkey"), ["p_size", "p_retailprice", "p_partkey"], 60, for_imputer=True)


@query(f"""WITH {PROX_IMP_SQL} SELECT row_id, (row_number() OVER (PARTITION BY row_id ORDER BY round(importance, 6) DESC, feature))::INT AS rank, feature::INT AS feature, round(importance, 6) AS value
FROM imp WHERE row_id % 50 = 0 QUALIFY rank <= 2""")
def topk_features(spark, sf_dir):
    """The features that matter most for each of a query set's rows."""
    s = Stub(spark, sf_dir)
    return similar.top_features(r6(importance.proximity_importance(s.rows, s.nodes, s.leaves)), s.rows.filter("row_id % 50 = 0"), 2)


@query("SELECT 'r_regionkey' AS dimension, r_regionkey::INT AS key, r_name AS description FROM region UNION ALL SELECT 'n_nationkey', n_nationkey::INT, n_name FROM nation")
def stacked_lookup(spark, sf_dir):
    """Two small tables written below each other in one file, and read as a lookup."""
    from copse.sources.datasets import read_stacked_keys

    region, nation = read(spark, sf_dir, "region").select("r_regionkey", "r_name"), read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    lines = [x for t in (region, nation) for x in [",".join(t.columns), *[f"{k},{name}" for k, name in sorted(t.collect())], ""]]  # the lookup's 30 rows
    path = f"{shared_dir(spark)}/copse-core/stacked-{uuid.uuid4().hex}"
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    return read_stacked_keys(spark, path)


@query(f"""WITH {PROX_IMP_SQL}, ov AS (SELECT feature, sum(importance) / (SELECT n FROM n) AS importance FROM imp GROUP BY 1),
ov_votes AS (SELECT row_id, node_class AS class, count(*) AS v FROM leaves JOIN ends USING (tree_id, leaf_id) WHERE is_oob GROUP BY 1, 2),
p AS (SELECT row_id, class FROM ov_votes QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY v DESC, class) = 1)
SELECT 'importance' AS panel, feature::VARCHAR AS name, round(importance, 6) AS value FROM ov
UNION ALL SELECT 'error', 'out of bag', round(avg((class <> y)::INT), 6) FROM p JOIN base USING (row_id)
UNION ALL SELECT 'rows', y::VARCHAR, count(*)::DOUBLE FROM base GROUP BY y
UNION ALL SELECT 'leaves', tree_id::VARCHAR, count(DISTINCT leaf_id)::DOUBLE FROM leaves GROUP BY tree_id""")
def report_panels(spark, sf_dir):
    """What a report on a forest shows, as one table of named numbers."""
    s = Stub(spark, sf_dir)
    n = s.rows.count()
    parts = [
        importance.overall(importance.proximity_importance(s.rows, s.nodes, s.leaves), n).select(F.lit("importance").alias("panel"), F.col("feature").cast("string").alias("name"), F.col("importance").alias("value")),
        votes.oob_error(votes.with_leaf(s.leaves, s.nodes), s.rows).select(F.lit("error"), F.lit("out of bag"), "oob_error"),
        s.rows.groupBy(F.col("y").cast("int").cast("string").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("rows"), "name", "value"),
        s.leaves.groupBy(F.col("tree_id").cast("string").alias("name")).agg(F.count_distinct("leaf_id").cast("double").alias("value")).select(F.lit("leaves"), "name", "value"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return r6(out)


# -- growth ----------------------------------------------------------------------------------------

def grown_sql(trees: int, depth: int, bins: int, mtry: int) -> str:
    """Nodes of a classifier grown level by level, each level a few common tables."""
    x = ("x0", "x1", "x2")
    values = " UNION ALL ".join(f"SELECT row_id, {i} AS feature, {c} AS value FROM data" for i, c in enumerate(x))
    out = [f"""{BASE_SQL}, data AS (SELECT row_id, x0, x1, x2, (x0 / 1000 + x1 / 5 > 7)::INT AS y FROM base), cells AS ({values}),
ranks AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY feature) AS k FROM (SELECT DISTINCT feature, value FROM cells)),
binned AS (SELECT row_id, feature, value, ((r + 1) * least({bins}, k) - 1) // k AS bin FROM cells JOIN ranks USING (feature, value)),
at0 AS (SELECT DISTINCT tree_id, {draw_sql("12345", "tree_id", "d")} % (SELECT n FROM n) AS row_id, 0::BIGINT AS node_id FROM (SELECT unnest(range({trees})) AS tree_id), (SELECT unnest(range((SELECT n FROM n))) AS d))"""]
    for i in range(depth + 1):
        out.append(f"""open{i} AS (SELECT tree_id, node_id, count(*) AS n, sum(y) AS c1, count(*) - sum(y) AS c0 FROM at{i} JOIN data USING (row_id) GROUP BY 1, 2)""")
        if i < depth:
            out.append(f"""asked{i} AS (SELECT tree_id, node_id, feature FROM open{i}, (SELECT unnest(range(3)) AS feature) WHERE c0 > 0 AND c1 > 0
  QUALIFY row_number() OVER (PARTITION BY tree_id, node_id ORDER BY {draw_sql("12345", "tree_id", "node_id", "feature")}, feature) <= {mtry}),
hist{i} AS (SELECT tree_id, node_id, feature, bin, sum(y) AS s1, count(*) - sum(y) AS s0, min(value) AS lo, max(value) AS hi FROM at{i} JOIN asked{i} USING (tree_id, node_id) JOIN binned USING (row_id, feature) JOIN data USING (row_id) GROUP BY 1, 2, 3, 4),
cuts{i} AS (SELECT *, sum(s0) OVER w AS l0, sum(s1) OVER w AS l1, sum(s0) OVER p AS a0, sum(s1) OVER p AS a1, (max(hi) OVER w + lead(lo) OVER o) / 2 AS split_value FROM hist{i}
  WINDOW w AS (PARTITION BY tree_id, node_id, feature ORDER BY bin ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY tree_id, node_id, feature), o AS (PARTITION BY tree_id, node_id, feature ORDER BY bin)),
best{i} AS (SELECT tree_id, node_id, feature, bin, split_value FROM cuts{i} WHERE l0 + l1 >= 1 AND a0 + a1 - l0 - l1 >= 1
  QUALIFY row_number() OVER (PARTITION BY tree_id, node_id ORDER BY (l0 * l0 + l1 * l1)::DOUBLE / (l0 + l1) + ((a0 - l0) * (a0 - l0) + (a1 - l1) * (a1 - l1))::DOUBLE / (a0 + a1 - l0 - l1) DESC, feature, bin) = 1),
at{i + 1} AS (SELECT a.tree_id, a.row_id, CASE WHEN z.bin <= b.bin THEN 2 * a.node_id + 1 ELSE 2 * a.node_id + 2 END AS node_id FROM at{i} a JOIN best{i} b USING (tree_id, node_id) JOIN binned z ON z.row_id = a.row_id AND z.feature = b.feature)""")
    levels = [
        f"SELECT tree_id::INT AS tree_id, node_id, (CASE WHEN feature IS NULL THEN -1 ELSE 1 END)::INT AS status, feature::INT AS feature, round(split_value, 6) AS split_value, (c1 > c0)::INT AS node_class, n FROM open{i} LEFT JOIN best{i} USING (tree_id, node_id)"
        if i < depth else f"SELECT tree_id::INT, node_id, -1, NULL, NULL, (c1 > c0)::INT, n FROM open{i}" for i in range(depth + 1)]
    return f"WITH {', '.join(out)} {' UNION ALL '.join(levels)}"


def _grown(spark, sf_dir, **how):
    rows = forest.feature_rows(_learnable(spark, sf_dir), ["x0", "x1", "x2"], "label")
    params = forest.GrowParams(**how)
    return r6(forest.grow(rows, forest.make_bag(rows, params), params, 3, 2, by_level=True).select("tree_id", "node_id", "status", "feature", "split_value", "node_class", "n"))


@query(grown_sql(3, 3, 32, 1))
def grow_by_level(spark, sf_dir):
    """A small forest grown level by level, one candidate feature a node."""
    return _grown(spark, sf_dir, n_trees=3, max_depth=3, n_bins=32)


@query(grown_sql(2, 4, 64, 3))
def grow_all_features(spark, sf_dir):
    """Trees that ask every feature at every node."""
    return _grown(spark, sf_dir, n_trees=2, max_depth=4, n_bins=64, mtry=3)


# -- factors and clusters: tested against numpy ------------------------------------------------------

@query()
def low_rank_factors(spark, sf_dir):
    return embed.leaf_factors(Stub(spark, sf_dir).leaves, 4)


@query()
def scaling_from_factors(spark, sf_dir):
    return embed.scaling_of_factors(embed.leaf_factors(Stub(spark, sf_dir).leaves, 4), 2)
