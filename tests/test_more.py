"""Other ways of the core operators against each other, numpy and plain Python."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from copse.operators import embed, forest, importance, impute, outlier, prep, proximity, similar, split, votes
from copse.plans import stub
from copse.plans.stub import TREES, Stub
from copse.sources.datasets import generated, read_dense


@pytest.fixture(scope="module")
def s(spark, small):
    return Stub(spark, small)


def same(a, b):
    b = b.select(*a.columns)
    return a.count() == b.count() and a.exceptAll(b).count() == 0


def test_paths_and_changed_rows_by_join(s):
    assert same(forest.paths(s.rows, s.nodes, by_join=False), forest.paths(s.rows, s.nodes, by_join=True))
    trees = s.nodes.select("tree_id").distinct()
    asked = s.rows.select("row_id", "x").crossJoin(trees)
    assert same(forest.reroute(asked, s.nodes, ["row_id"], by_join=False), forest.reroute(asked, s.nodes, ["row_id"], by_join=True))
    single = s.nodes.filter("tree_id = 0 and node_id = 0").withColumn("status", F.lit(forest.TERMINAL)).withColumn("depth", F.lit(0))
    assert forest.paths(s.rows, single, by_join=True).count() == forest.paths(s.rows, single, by_join=False).count() == 0


def test_squared_sums_by_rows_and_by_trees(s):
    leaves = s.leaves.select("tree_id", "leaf_id", "row_id")
    some = leaves.filter("row_id % 7 = 0")
    a = {r["row_id"]: r["total"] for r in outlier._by_pairs_of_trees(leaves, some, TREES).collect()}
    b = {r["row_id"]: r["total"] for r in outlier.squared_sums(leaves, some, TREES).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-12) for k in a)


def test_bins_ranked_in_ranges(spark, monkeypatch):
    df = spark.range(5000).select(F.col("id").alias("row_id"), (F.col("id") * 37 % 997).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"), F.lit(None).cast("double").alias("c"))
    one = prep.bin_edges(df, ["a", "b", "c"], 32)
    monkeypatch.setattr(prep, "RANK_ROWS", 10)
    assert same(one, prep.bin_edges(df, ["a", "b", "c"], 32))


def test_bins_by_columns_and_by_arrays(spark):
    rng = np.random.default_rng(6)
    n = 3000
    values = [[float(rng.normal()), float(rng.integers(0, 7) + 3), float(rng.integers(0, 2)), None if rng.random() < 0.2 else float(rng.integers(0, 90)), 5.0] for _ in range(n)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "row_id long, a double, c double, t double, m double, o double")
    rows = forest.feature_rows(df.withColumn("y", F.lit(1.0)), ["a", "c", "t", "m", "o"], "y")
    for n_bins in (16, 256):
        params = forest.GrowParams(n_bins=n_bins, categorical=(1,))
        edges = forest.bins_of(rows, 5, params)
        edges["1"] = edges["1"][1:]  # a category that was not there
        x = np.array([[math.nan if v is None else v for v in r] for r in values])
        got = {r["row_id"]: r["b"] for r in forest.with_bins(rows, 5, edges, params).collect()}
        assert np.array_equal(np.array([got[i] for i in range(n)]), forest.bins_of_array(x, edges, params))


def test_draws_reach_beyond_32_bits(spark):
    from copse.functions.portable import draw, uniform

    got = spark.range(2000).agg(F.max(draw("t", F.col("id"))).alias("most"), F.avg(uniform("u", F.col("id"))).alias("mean")).first()
    assert 1 << 58 < got["most"] < 1 << 60 and abs(got["mean"] - 0.5) < 0.03


def test_factors_are_the_leading_eigenpairs(spark):
    rng = np.random.default_rng(3)
    n, rank = 40, 3
    x = rng.normal(size=(n, rank)) * np.array([3.0, 2.0, 1.0])
    p = x @ x.T
    pairs = spark.createDataFrame([(i, j, float(p[i, j])) for i in range(n) for j in range(n)], "i long, j long, p double")
    rows = spark.range(n).select(F.col("id").alias("row_id"))
    got = np.array([list(r)[1:] for r in embed.factors(pairs, rows, rank, rounds=40).orderBy("row_id").collect()])
    assert np.allclose(got @ got.T, p, atol=1e-6 * np.abs(p).max())
    axes = np.array([list(r)[1:] for r in embed.scaling_of_factors(embed.factors(pairs, rows, rank, rounds=40), 2).orderBy("row_id").collect()])
    centred = x - x.mean(axis=0)
    u, d, _ = np.linalg.svd(centred, full_matrices=False)
    want = u[:, :2] * d[:2]
    assert np.allclose(axes @ axes.T, want @ want.T, atol=1e-5 * np.abs(want).max() ** 2)


def test_elbow_finds_the_clusters(spark):
    rng = np.random.default_rng(4)
    points = [(int(i), *map(float, c + rng.normal(size=2) * 0.05)) for i, c in enumerate(np.repeat(np.array([[0, 0], [9, 0], [0, 9]]), 30, axis=0))]
    found, k = embed.elbow_clusters(spark.createDataFrame(points, "row_id long, c0 double, c1 double"), ["c0", "c1"], most=6, least_gain=0.9)
    groups = [{r["cluster"] for r in found.collect() if r["row_id"] // 30 == g} for g in range(3)]
    assert k == 3 and all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3


def test_proximity_imputation(spark):
    data = generated(spark, 300, 3)
    df = data.df.select("row_id", "x0", (F.col("x0") * 2).alias("x1"), F.floor(F.col("x0")).alias("x2").cast("double"))
    holes = prep.mask_cells(df, ["x0", "x1", "x2"], 0.1, "holes")
    how = {"iterations": 2, "n_trees": 20, "params": {"max_depth": 8, "n_bins": 32}}
    for f in (impute.topk_mean, impute.topk_median):
        out = f(holes, ["x0", "x1", "x2"], **how)
        assert out.columns == holes.columns and out.filter("x0 is null or x1 is null or x2 is null").count() == 0
        kept = out.join(holes.toDF("row_id", "a", "b", "c"), "row_id").filter("(a is not null and a <> x0) or (b is not null and b <> x1) or (c is not null and c <> x2)")
        assert kept.count() == 0
        error = lambda t: t.join(df.toDF("row_id", "a", "b", "c"), "row_id").join(holes.filter("x1 is null").select("row_id"), "row_id").agg(F.avg(F.abs(F.col("x1") - F.col("b")))).first()[0]
        assert error(out) < 0.8 * error(impute.rough_impute(holes, ["x0", "x1", "x2"], []))  # better than the median


def test_random_partitions_of_many_categories(spark):
    """Beyond the bound on subsets partitions are drawn: each is a proper one, and a good one is found."""
    rows = spark.range(1200).select(F.lit("c").alias("feature"), (F.col("id") % 12).cast("int").alias("bin"), (F.col("id") % 12).cast("double").alias("value"), ((F.col("id") % 12) < 6).cast("int").alias("y"))
    stats = split.class_sums(F.col("y"), F.lit(1.0), 2)
    cand = split.categorical_candidates(split.histogram(rows, [], stats), [], "class", 2, 10, 200, "seed")
    best = split.best(cand, ["feature"]).first()
    sizes = cand.select(split.size_of(F.col("left"), "class").alias("l"), split.size_of(F.col("right"), "class").alias("r")).collect()
    assert sizes and all(x["l"] > 0 and x["r"] > 0 and x["l"] + x["r"] == 1200 for x in sizes)
    low = {c for c in best["cats_left"] if c < 6}
    assert max(len(low), len(best["cats_left"]) - len(low)) >= 4


def test_reads_dense_files(spark, small, tmp_path):
    region = spark.read.parquet(f"{small}/region.parquet").select("r_regionkey", "r_name")
    for kind in ("csv", "json", "orc", "parquet"):
        path = str(tmp_path / f"region.{kind}")
        (region.write.option("header", True).csv(path) if kind == "csv" else region.write.format(kind).save(path))
        assert sorted(map(tuple, read_dense(spark, path, ["r_regionkey", "r_name"]).collect())) == sorted(map(tuple, region.collect()))
    with pytest.raises(ValueError):
        read_dense(spark, str(tmp_path / "region.xls"))


def test_explained_neighbours(s):
    """Shares of the features that speak for a neighbour sum to one for each pair."""
    new = s.rows.filter("row_id < 20")
    pairs, per_pair, summed = similar.explained_new(forest.route(new, s.nodes), s.leaves, forest.paths(new, s.nodes), 4, TREES, 3)
    assert 20 <= pairs.count() <= 80 and max(r["count"] for r in summed.groupBy("i").count().collect()) <= 3
    totals = per_pair.groupBy("i", "j").agg(F.sum("share").alias("t")).collect()
    assert len(totals) == pairs.count() and all(math.isclose(r["t"], 1) for r in totals)


def test_median_change_by_hand(s):
    rows = {r["row_id"]: r["x"] for r in s.rows.collect()}
    nodes = {(r["tree_id"], r["node_id"]): r for r in s.nodes.collect()}

    def predict(x):
        total = 0.0
        for t in range(TREES):
            n = 0
            while nodes[t, n]["status"] == forest.SPLIT:
                r = nodes[t, n]
                v = x[r["feature"]]
                left = v in r["cats_left"] if r["cats_left"] is not None else v <= r["split_value"]
                n = r["left_id"] if left else r["right_id"]
            total += nodes[t, n]["node_pred"]
        return total / TREES

    some = s.rows.filter("row_id < 10")
    donors = {(r["row_id"], r["k"]): r["donor"] for r in importance.row_donors(s.rows, 3).collect()}
    got = {(r["row_id"], r["feature"]): r["importance"] for r in importance.median_change(s.rows, s.nodes, 3, 3).collect()}
    for r, f in itertools.product([x["row_id"] for x in some.collect()], range(3)):
        each = sorted(abs(predict([rows[donors[r, k]][i] if i == f else v for i, v in enumerate(rows[r])]) - predict(rows[r])) for k in range(3))
        assert math.isclose(got[r, f], each[1], abs_tol=1e-9)


def test_proximity_by_hand(s):
    leaf = {(r["tree_id"], r["row_id"]): r["leaf_id"] for r in s.leaves.collect()}
    n = len({k[1] for k in leaf})
    got = {(r["i"], r["j"]): r["p"] for r in proximity.shared(s.leaves, s.leaves, TREES).collect()}
    for i, j in itertools.product(range(0, n, 13), range(0, n, 17)):
        assert math.isclose(got.get((i, j), 0.0), sum(leaf[t, i] == leaf[t, j] for t in range(TREES)) / TREES)
    assert votes.oob_count(s.leaves).count() == n and stub.TREES == TREES
