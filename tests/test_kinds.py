"""Questions about pairs of rows are asked of kinds of rows: the work follows the kinds, the rows are those of plain Python."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from copse.operators import embed, importance, impute, outlier, proximity, similar, votes
from copse.plans.stub import Stub

TREES, N = 3, 240


def crowded(n: int = N) -> list[tuple]:
    """(tree_id, row_id, leaf_id, nin, is_oob) of many rows in few leaves, with few patterns of draws."""
    return [(t, i, (i % 4) * 10 + (i % 4 > t), (i // 4 + t) % 3, (i // 4 + t) % 3 == 0) for t in range(TREES) for i in range(n)]


@pytest.fixture(scope="module")
def leaves(spark):
    return spark.createDataFrame(crowded(), "tree_id int, row_id long, leaf_id long, nin long, is_oob boolean").repartition(4).cache()


def test_searches_meet_kinds(spark, leaves, monkeypatch):
    met = []

    def counted(left, right, n_trees):
        met.append((left.count(), right.count()))
        return proximity.shared(left, right, n_trees)

    monkeypatch.setattr(similar, "shared", counted)
    leaf = {(t, i): at for t, i, at, _, _ in crowded()}
    oob = {(t, i): o for t, i, _, _, o in crowded()}

    def nearest(i, trees, others, k):
        p = {j: sum(leaf[t, i] == leaf[t, j] for t in trees) / max(len(trees), 1) for j in others}
        return [(j, p[j]) for j in sorted(others, key=lambda j: (-p[j], j)) if p[j] > 0][:k]

    asked = spark.range(0, N, 7).withColumnRenamed("id", "row_id")
    answers = [
        (similar.top_similar(leaves, asked, 5), lambda i: nearest(i, [t for t in range(TREES) if oob[t, i]], [j for j in range(N) if j != i], 5)),
        (similar.top_similar_all_trees(leaves, asked, 5, TREES), lambda i: nearest(i, range(TREES), [j for j in range(N) if j != i], 5)),
        (similar.top_similar_new(leaves.join(asked, "row_id"), leaves, 70, TREES), lambda i: nearest(i, range(TREES), range(N), 70)),
    ]
    for got, want in answers:
        found = {}
        for r in got.collect():
            found.setdefault(r["i"], []).append((r["rank"], r["j"], r["p"]))
        assert {i: sorted(v) for i, v in found.items()} == {i: [(n, j, p) for n, (j, p) in enumerate(want(i), 1)] for i in range(0, N, 7) if want(i)}
    assert met and all(a <= 12 * TREES and b <= 4 * TREES for a, b in met)  # 4 sets of leaves, 3 patterns of draws


def greedy(near, rows):
    """The opening row of each row, in order."""
    seeds, at = [], {}
    for j in rows:
        at[j] = next((i for i in seeds if near(i, j)), None)
        if at[j] is None:
            seeds.append(j)
            at[j] = j
    return {j: seeds.index(at[j]) for j in rows}


def finished_by_hand():
    rows = {(t, i): (leaf, nin, oob) for t, i, leaf, nin, oob in crowded()}
    f = [1 / max(sum(rows[t, i][2] for t in range(TREES)), 1) for i in range(N)]
    r = Counter((i, j) for t in range(TREES) for i in range(N) if rows[t, i][2] for j in range(N) if rows[t, j][1] > 0 and rows[t, i][0] == rows[t, j][0])
    return r, lambda i, j: (r[i, j] + r[j, i]) / 2 * (f[i] + f[j]) / 2


def test_pairs_of_rows_come_from_pairs_of_kinds(leaves):
    r, p = finished_by_hand()
    kinds, pairs = proximity.kind_proximity(leaves)
    assert kinds.select("kind").distinct().count() == 12 and pairs.count() <= 12 * 11
    assert {(x["i"], x["j"]): x["r"] for x in proximity.raw_proximity(leaves).collect()} == dict(r)
    got = {(x["i"], x["j"]): x["p"] for x in proximity.finished_proximity(leaves).collect()}
    old = {(x["i"], x["j"]): x["p"] for x in proximity.finished(proximity.raw_proximity(leaves), votes.oob_count(leaves)).collect()}
    assert got.keys() == old.keys() and all(math.isclose(got[k], old[k]) for k in got)
    assert all(math.isclose(v, 1.0 if i == j else p(i, j)) for (i, j), v in got.items())


def test_gap_proximity_by_kinds(leaves):
    g = {(x["i"], x["j"]): x["g"] for x in proximity.gap_directed(leaves).collect()}
    want = {k: (g.get(k, 0.0) + g.get(k[::-1], 0.0)) / 2 for i, j in g for k in ((i, j), (j, i))}
    got = {(x["i"], x["j"]): x["p"] for x in proximity.gap_proximity(leaves).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_clusters_take_the_lowest_opening_row(spark, leaves):
    near = {(0, 1), (1, 2), (2, 4), (3, 4)}  # 3 opens a cluster before it is known that 2 does, but 2 comes first
    pairs = spark.createDataFrame([(i, j, 0.9) for i, j in near | {(j, i) for i, j in near}], "i long, j long, p double")
    got = {r["row_id"]: r["label"] for r in proximity.cluster_labels(pairs, spark.range(5).withColumnRenamed("id", "row_id")).collect()}
    assert got == greedy(lambda i, j: (i, j) in near, range(5)) == {0: 0, 1: 0, 2: 1, 3: 2, 4: 1}
    _, p = finished_by_hand()
    for above in (0.0, 0.3):
        got = {r["row_id"]: r["label"] for r in proximity.leaf_cluster_labels(leaves, above).collect()}
        assert got == greedy(lambda i, j: p(i, j) > above, range(N))


def test_outlier_sums_by_kinds(leaves, monkeypatch):
    met = []

    def counted(a, b, n_trees):
        met.append((a.count(), b.count()))
        return proximity.shared(a, b, n_trees)

    monkeypatch.setattr(outlier, "shared", counted)
    new = leaves.filter("row_id % 9 = 0").select("tree_id", "leaf_id", "row_id")
    leaf = {(t, i): at for t, i, at, _, _ in crowded()}
    shares = {i: [c for c in (sum(leaf[t, i] == leaf[t, j] for t in range(TREES)) / TREES for j in range(N)) if c] for i in range(0, N, 9)}
    got = {r["row_id"]: r["raw"] for r in outlier.predicted_raw(new, leaves, TREES).collect()}
    assert got.keys() == shares.keys() and all(math.isclose(got[i], len(c) / sum(x * x for x in c)) for i, c in shares.items())
    every = leaves.select("tree_id", "leaf_id", "row_id")
    sums = {r["row_id"]: r["total"] for r in outlier.squared_sums(every, new, TREES).collect()}
    assert all(math.isclose(sums[i], sum((sum(leaf[t, i] == leaf[t, j] for t in range(TREES)) / TREES) ** 2 for j in range(0, N, 9))) for i in range(N))
    assert met and all(a <= 4 * TREES and b <= 4 * TREES for a, b in met)


def test_cells_are_filled_by_kinds(spark, leaves, monkeypatch):
    met = []
    pairs = proximity.shared(leaves, leaves, TREES)
    monkeypatch.setattr(impute, "shared", lambda a, b, n: met.append((a.count(), b.count())) or proximity.shared(a, b, n))
    rows = [(i, None if i % 5 == 0 else float(i * 7 % 11), None if i % 4 == 1 else float(i % 3)) for i in range(N)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double")
    for top, how in ((7, "mean"), (7, "median"), (None, "mean"), (None, "median")):
        found = []
        for fills in (impute.donor_fills(df, pairs, ["a", "b"], ["b"], top, how), impute.leaf_fills(df, leaves, TREES, ["a", "b"], ["b"], top, how)):
            found.append({(r["row_id"], r["feature"]): r["value"] for r in fills.collect()})
        assert found[0] and found[0].keys() == found[1].keys() and all(math.isclose(found[0][k], found[1][k]) for k in found[0])
    assert len(met) == 4 and all(a <= 4 * TREES and b <= 4 * TREES for a, b in met)


def test_eigenvectors_by_kinds(leaves, monkeypatch):
    _, p = finished_by_hand()
    full = np.array([[1.0 if i == j else p(i, j) for j in range(N)] for i in range(N)])
    asked = []
    for name in ("_factors", "_scaling"):
        def counted(pairs, rows, *a, f=getattr(embed, name), **how):
            asked.append((pairs.count(), rows.count()))
            return f(pairs, rows, *a, **how)
        monkeypatch.setattr(embed, name, counted)
    got = np.array([list(r)[1:] for r in embed.leaf_factors(leaves, 4).orderBy("row_id").collect()])
    values, vectors = np.linalg.eigh(full)
    at = np.argsort(-np.abs(values))[:4]
    want = (vectors[:, at] * np.maximum(values[at], 0)) @ vectors[:, at].T
    assert np.allclose(got @ got.T, want, atol=1e-3 * np.abs(want).max())  # rounds end at eigenvalues to 1e-9, vectors to its root
    got = np.array([list(r)[1:] for r in embed.leaf_scaling(leaves, 3).orderBy("row_id").collect()])
    d = (full.max() - full) ** 2
    np.fill_diagonal(d, 0.0)
    centre = np.eye(N) - 1 / N
    values, vectors = np.linalg.eigh(-0.5 * centre @ d @ centre)
    at = np.argsort(-values)[:3]
    want = (vectors[:, at] * values[at]) @ vectors[:, at].T
    assert np.allclose(got @ got.T, want, atol=1e-3 * np.abs(want).max())  # rounds end at eigenvalues to 1e-9, vectors to its root
    assert asked and all(a <= 12 * 12 and b <= 12 for a, b in asked)


def test_tables_of_rows_are_not_broadcast(spark, small, monkeypatch):
    s = Stub(spark, small)
    donors = importance.oob_donors(s.leaves)

    def asked():
        return [
            importance.predicted_permutation(s.rows, s.nodes, 3, 2), importance.predicted_permutation(s.rows, s.nodes, 3, 2, "regress"),
            importance.median_change(s.rows, s.nodes, 3, 2), importance.predicted_proximity_importance(s.rows, s.nodes, 3, 2)]

    sent, read = asked(), lambda df: {(r["row_id"], r["feature"]): round(r["importance"], 9) for r in df.collect()}
    assert not any("Broadcast" in df._jdf.queryExecution().executedPlan().toString() for df in sent)
    for df in (importance.permutation_importance(s.rows, s.nodes, s.leaves, donors), importance.proximity_importance(s.rows, s.nodes, s.leaves)):
        assert "dx" in (plan := df._jdf.queryExecution().optimizedPlan().toString()) and plan.count("strategy=merge") >= 2
    monkeypatch.setattr(importance, "SENT_NODES", 0)
    for one, other in zip(sent, asked()):
        assert read(one) == read(other)


def test_equal_sets_meet_once(spark, monkeypatch):
    words = ["a", "b", "a,b", 'c"', "d", "e", "f"]
    sets = {i: {w for k, w in enumerate(words) if (i % 20 * 37 + 5) >> k & 1} for i in range(100)}
    df = spark.createDataFrame([(i, w) for i, s in sets.items() for w in s], "id long, item string")
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    met = []
    common = similar._common_by_item
    monkeypatch.setattr(similar, "_common_by_item", lambda s: met.append(s.select("row_id").distinct().count()) or common(s))
    for bounds in ({}, {"PAIRS_BY_ITEM": 0, "BLOCK_SETS": 7}, {"WHOLE_SET": 1}):
        for name, v in bounds.items():
            monkeypatch.setattr(similar, name, v)
        for least in (0.0, 0.4):
            got = similar.jaccard_pairs(df, least).collect()
            assert len(got) == len({(r["a"], r["b"]) for r in got})
            assert {(r["a"], r["b"]): r["jaccard"] for r in got} == {k: v for k, v in want.items() if v >= least}
    assert met == [20, 20, 100, 100]  # by items; in blocks; and sets that are too long to be compared as a whole


def test_equal_vectors_meet_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    few = rng.normal(size=(30, 5)).astype(np.float32).tolist() + [[0.0] * 5]
    rows = spark.createDataFrame([(i, few[i % 31]) for i in range(200)], "row_id long, x array<float>")
    met = []
    of_rows = similar._of_rows
    monkeypatch.setattr(similar, "_of_rows", lambda a, b, pairs, *how: met.append(pairs.count()) or of_rows(a, b, pairs, *how))
    asked = rows.filter("row_id % 9 = 0")
    for k in (3, 12):
        one = sorted(map(tuple, similar.top_cosine(asked, rows, k).collect()))
        assert one == sorted(map(tuple, similar._top_cosine_by_rows(asked, rows, k, "x", 50_000).collect()))
        assert len(one) == 23 * k
    assert met and all(n <= 23 * 31 for n in met)
    holes = rows.union(spark.createDataFrame([(500, [1.0, None, 2.0, 0.0, 1.0])], "row_id long, x array<float>"))
    assert similar.top_cosine(asked, holes, 3).count() == 69 and len(met) == 2
