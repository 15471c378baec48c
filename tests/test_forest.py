"""Growth, votes and what follows: invariants and relations between results."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from copse.operators import forest, metrics, outlier, prep, proximity, votes
from copse.plans.estimators import ForestClassifier, ForestRegressor, ForestUnsupervised, Imputer
from copse.plans.storage import materialised
from copse.sources.datasets import generated, read_stacked_keys


@pytest.fixture(scope="module")
def data(spark):
    return generated(spark, 400, 5)


@pytest.fixture(scope="module")
def table(data):
    return materialised(data.df, "test")


@pytest.fixture(scope="module")
def model(data, table):
    return ForestClassifier(data.features, "y", n_trees=20, n_bins=32, max_depth=12).fit(table)


def test_bag_sums_to_n(model):
    sums = model.bag.groupBy("tree_id").agg(F.sum("nin").alias("n")).collect()
    assert len(sums) == 20 and {r["n"] for r in sums} == {400}


def test_both_growers_agree(spark, data, table):
    rows = materialised(forest.feature_rows(table.withColumn("x4", F.when(F.col("row_id") % 7 != 0, F.floor(F.col("x4") * 2) % 4 + 3)), data.features, "y"), "rows")
    params = forest.GrowParams(n_trees=3, max_depth=4, n_bins=16, mtry=3, categorical=(4,), seed="s")
    bag = materialised(forest.make_bag(rows, params), "bag")
    whole, level = (forest.grow(rows, bag, params, 5, 2, by_level=x).orderBy("tree_id", "node_id").collect() for x in (False, True))
    key = lambda r: (r["tree_id"], r["node_id"], r["status"], r["feature"], None if r["split_value"] is None else round(r["split_value"], 9), r["cats_left"] and sorted(r["cats_left"]), r["node_class"], r["n"])
    assert list(map(key, whole)) == list(map(key, level))
    capped = forest.GrowParams(n_trees=2, max_nodes=7, n_bins=16, seed="s")
    for by in (False, True):
        sizes = forest.grow(rows, bag.filter("tree_id < 2"), capped, 5, 2, by_level=by).groupBy("tree_id").count().collect()
        assert all(r["count"] <= 7 for r in sizes)


def test_children_partition_their_parent(model):
    nodes = {(r["tree_id"], r["node_id"]): r for r in model.nodes.collect()}
    for (t, _), r in nodes.items():
        if r["status"] == forest.SPLIT:
            a, b = nodes[t, r["left_id"]], nodes[t, r["right_id"]]
            assert a["n"] + b["n"] == r["n"] and a["n"] and b["n"]


def test_routes_agree(model):
    a = model.leaves.select("tree_id", "row_id", "leaf_id")
    b = forest.route(model.rows, model.nodes, by_join=True)
    assert a.exceptAll(b.select(*a.columns)).count() == 0 and a.count() == b.count()


def test_learns_what_can_be_learnt(spark, model, table):
    assert model.oob_error() < 0.2
    noise = table.withColumn("y", (F.xxhash64("row_id") % 2 == 0).cast("int"))
    assert ForestClassifier(model.features, "y", n_trees=10, n_bins=16, max_depth=6).fit(noise).oob_error() > 0.35


def test_probabilities_sum_to_one(model, table):
    for r in model.predict_proba(table).groupBy("row_id").agg(F.sum("p").alias("p")).collect():
        assert math.isclose(r["p"], 1)


def test_importance_finds_the_features_that_decide(model):
    found = {r["name"]: r["importance"] for r in model.feature_importances().collect()}
    assert len(found) == 5 and sorted(found, key=found.get)[-2:] in (["x0", "x1"], ["x1", "x0"])
    local = model.local_importance().groupBy("feature").agg(F.avg("importance").alias("v")).orderBy(F.desc("v")).limit(2).collect()
    assert {r["feature"] for r in local} == {0, 1}


def test_proximity(model):
    p = materialised(model.proximity(), "prox")
    assert p.filter("p < 0").count() == 0
    assert p.filter("i = j and p <> 1").count() == 0
    back = p.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("p").alias("q"))
    assert p.join(back, ["i", "j"]).filter("abs(p - q) > 1e-9").count() == 0
    gap = proximity.gap_directed(model.leaves).groupBy("i").agg(F.sum("g").alias("s")).collect()
    assert all(math.isclose(r["s"], 1) for r in gap)
    means = {r["row_id"]: r["mean"] for r in __import__("copse.operators.similar", fromlist=["x"]).mean_proximity(model.leaves).collect()}
    direct = {r["i"]: r["m"] for r in p.groupBy("i").agg((F.sum("p") / 400).alias("m")).collect()}
    assert all(math.isclose(means[i], m, rel_tol=1e-9) for i, m in direct.items())


def test_outliers(spark, model, table):
    scores = model.outlier_scores()
    for c in (0, 1):
        v = sorted(r["score"] for r in scores.filter(F.col("class") == c).collect())
        assert abs(v[len(v) // 2]) < 1e-9
    far = spark.createDataFrame([(0, 6.0, -6.0, 7.0, -7.0, 6.0), (1, 0.1, 0.1, 0.0, 0.0, 0.0)], "row_id long, x0 double, x1 double, x2 double, x3 double, x4 double")
    raw = {r["row_id"]: r["raw"] for r in outlier.predicted_raw(model.apply(far), model.leaves, 20).collect()}
    assert raw[0] > raw[1]
    assert model.outlier_scores("greedy", 20, "diverse").count() == 400
    assert model.predicted_outlier_scores(far, scores).count() == 2


def test_upper_median(spark):
    for n in (1, 2, 7, 5000):
        df = spark.range(n).select(F.lit("g").alias("g"), (F.xxhash64("id") % 1000).cast("double").alias("v"))
        values = sorted(r["v"] for r in df.collect())
        assert outlier.upper_median(materialised(df, "m"), "v", "g").first()["m"] == values[n // 2]


def test_class_weights_do_not_change_the_order(data, table, model):
    heavy = ForestClassifier(data.features, "y", class_weight={1: 3.0}, n_trees=20, n_bins=32, max_depth=12).fit(table)
    assert heavy.predict(table).filter("label = 1").count() >= model.predict(table).filter("label = 1").count()

    def area(m):
        p = m.predict_proba(table).filter("label = 1").select("row_id", F.col("p").alias("score")).join(table.select("row_id", "y"), "row_id")
        return metrics.areas(p).first()["auc"]

    assert math.isclose(area(heavy), area(model), abs_tol=1e-9)
    balanced = ForestClassifier(data.features, "y", class_weight="balanced", n_trees=3, n_bins=8, max_depth=3).fit(table)
    assert set(balanced.class_weight) == {0, 1}
    with pytest.raises(ValueError):
        ForestClassifier(data.features, "y", class_weight={9: 1.0}, n_trees=2).fit(table)


def test_regression(spark):
    d = generated(spark, 400, 4, task="regress")
    t = materialised(d.df, "reg")
    m = ForestRegressor(d.features, "y", n_trees=15, n_bins=32, min_node=3, max_depth=12).fit(t)
    var = t.agg(F.var_pop("y")).first()[0]
    assert m.oob_mse() < 0.5 * var
    assert metrics.regression(m.predict(t).join(t.select("row_id", "y"), "row_id")).first()["r2"] > 0.7


def test_casewise_and_weights(data, table):
    w = table.select("row_id", F.when(F.col("row_id") < 200, 1.0).otherwise(0.0).alias("weight"))
    m = ForestClassifier(data.features, "y", n_trees=3, n_bins=16, max_depth=4, casewise=True).fit(table, w)
    assert m.bag.filter("row_id >= 200").count() == 0 and m.oob_error() is not None


def test_unsupervised(spark, data, table):
    m = ForestUnsupervised(data.features, n_trees=10, n_bins=16, max_depth=8).fit(table)
    p = m.predict_proba(table)
    assert p.filter("abs(p_real + p_synthetic - 1) > 1e-9").count() == 0
    assert 0 < p.agg(F.avg("p_synthetic")).first()[0] < 1
    assert m.leaves.select("row_id").distinct().count() == 400
    labels = m.cluster_labels(0.3)
    assert labels.count() == 400
    assert m.predict(table.limit(5), labels).count() == 5
    with pytest.raises(ValueError):
        m.predicted_importance(table, "permutation")
    with pytest.raises(ValueError):
        ForestUnsupervised(data.features).fit(table, table)


def test_cluster_labels_follow_the_order(spark):
    pairs = spark.createDataFrame([(0, 2, 0.9), (2, 3, 0.9), (1, 3, 0.9), (3, 4, 0.9)], "i long, j long, p double")
    both = pairs.union(pairs.selectExpr("j", "i", "p"))
    got = {r["row_id"]: r["label"] for r in proximity.cluster_labels(both, spark.range(6).withColumnRenamed("id", "row_id")).collect()}
    assert got[0] == got[2] and got[1] == got[3] and len({got[0], got[1], got[4], got[5]}) == 4


def test_explanations(model, table):
    top, shares, features = model.explain(table.limit(4), 5, 3)
    assert top.groupBy("i").count().filter("count > 5").count() == 0
    assert all(math.isclose(r["s"], 1) for r in shares.groupBy("i", "j").agg(F.sum("share").alias("s")).collect())
    assert features.groupBy("i").count().filter("count > 3").count() == 0
    near, found = model.explain_training(table.filter("row_id < 3"), 5, 2)
    assert near.filter("rank = 1 and abs(norm - 1) > 1e-9").count() == 0 and found.count() <= 6


def test_save_and_load(spark, model, table, tmp_path):
    path = str(tmp_path / "model")
    model.save(path)
    again = type(model).load(spark, path)
    assert again.oob_error() == model.oob_error()
    assert again.predict(table).exceptAll(model.predict(table)).count() == 0
    spark.createDataFrame([('{"format": "x"}',)], "value string").coalesce(1).write.mode("overwrite").text(path + "/meta")
    with pytest.raises(ValueError):
        type(model).load(spark, path)


def test_scaling_recovers_distances(spark):
    import numpy as np

    from copse.operators import embed

    points = np.random.default_rng(1).normal(size=(30, 3))
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    top = d.max()
    pairs = spark.createDataFrame([(i, j, float(top - d[i, j])) for i in range(30) for j in range(30)], "i long, j long, p double")
    got = np.array([[r["c0"], r["c1"], r["c2"]] for r in embed.scaling(pairs, spark.range(30).withColumnRenamed("id", "row_id"), 3).orderBy("row_id").collect()])
    assert np.allclose(np.linalg.norm(got[:, None] - got[None], axis=2), d, atol=1e-5)


def test_imputer(spark):
    df = materialised(generated(spark, 200, 3).df.withColumn("x1", 2 * F.col("x0") + 0.01 * F.col("x1")).withColumn("kind", F.when(F.col("x0") > 0, "up").otherwise("down")), "imp")
    holes = df.withColumn("x1", F.when(F.col("row_id") % 5 != 0, F.col("x1"))).withColumn("kind", F.when(F.col("row_id") % 7 != 0, F.col("kind")))
    imp = Imputer(["x0", "x1", "kind"], n_trees=8, params={"max_depth": 8, "n_bins": 32})
    out = materialised(imp.decode(imp.fit_transform(holes)), "out")
    assert out.filter("x1 is null or kind is null").count() == 0
    err = out.select("row_id", F.col("x1").alias("z")).join(df, "row_id").filter("row_id % 5 = 0").agg(F.avg(F.abs(F.col("z") - F.col("x1")))).first()[0]
    assert err < 0.6
    right = out.select("row_id", F.col("kind").alias("k")).join(df, "row_id").filter("row_id % 7 = 0").agg(F.avg((F.col("k") == F.col("kind")).cast("double"))).first()[0]
    assert right > 0.8


def test_random_and_nothing_to_impute(spark):
    from copse.operators import impute

    df = spark.createDataFrame([(0, 1.0, None), (1, None, None), (2, 3.0, None)], "row_id long, a double, b double")
    out = {r["row_id"]: r for r in impute.random_impute(df, ["a", "b"]).collect()}
    assert out[1]["a"] in (1.0, 3.0) and out[0]["b"] == 0.0
    assert impute.forest_impute(df.select("row_id", "b").fillna(1.0), ["b"])[1]["iterations"] == 0
    assert impute.rough_fills(df, ["a", "b"]) == {"a": 2.0, "b": 0.0}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "row_id long, a double, y int")
    assert prep.bootstrap(empty, 3).count() == 0
    assert prep.synthetic_union(empty, ["a"]).count() == 0
    assert prep.bin_edges(empty.select("a"), ["a"]).count() == 0
    assert prep.with_row_id(empty, ["a"], "n").count() == 0
    rows = forest.feature_rows(empty, ["a"], "y")
    assert forest.grow(rows, prep.bootstrap(rows, 2), forest.GrowParams(n_trees=2), 1, 2).count() == 0
    assert votes.class_votes(spark.createDataFrame([], "row_id long, node_class int, node_weight double")).count() == 0


def test_feature_names():
    assert prep.feature_indices(["b", 0], ["a", "b"]) == [1, 0]
    for bad in (["z"], [7], [-1]):
        with pytest.raises(ValueError):
            prep.feature_indices(bad, ["a", "b"])


def test_stacked_keys(spark, tmp_path):
    (tmp_path / "ids.csv").write_text('kind_id,description\n1,One\n2,"Two, or so"\n,\nother_id,description\n1,First\n')
    got = {(r["dimension"], r["key"]): r["description"] for r in read_stacked_keys(spark, str(tmp_path / "ids.csv")).collect()}
    assert got == {("kind_id", 1): "One", ("kind_id", 2): "Two, or so", ("other_id", 1): "First"}


def test_stream(spark, model, table, tmp_path):
    from copse.streaming.score import score_stream, scorer

    source = str(tmp_path / "in")
    table.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(source)
    score_stream(stream, scorer(model), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("row_id", "label").exceptAll(model.predict(table)).count() == 0 and got.count() == 400


def test_sparse_round_trip(spark):
    wide = spark.createDataFrame([(0, 1.0, 0.0), (1, 0.0, 2.0), (2, 0.0, 0.0)], "row_id long, a double, b double")
    entries = prep.long_form(wide, ["a", "b"]).filter("value <> 0")
    assert prep.from_sparse(entries, ["a", "b"], wide).exceptAll(wide).count() == 0
    fake = prep.synthetic_sparse(entries, 3, ["a", "b"])
    assert fake.filter("row_id < 3").count() == 0


def test_scaling_tells_when_it_has_not_converged(spark):
    from copse.operators import embed

    rows = spark.range(6).withColumnRenamed("id", "row_id")
    pairs = rows.select(F.col("row_id").alias("i")).crossJoin(rows.select(F.col("row_id").alias("j"))).withColumn("p", F.expr("1 / (1 + abs(i - j))"))
    with pytest.warns(UserWarning, match="converged"):
        embed.scaling(pairs, rows, 1, rounds=1)
