"""Growing forests and routing rows through them.

A forest is tables: ``nodes`` (a row a node), ``bag`` (tree, row, multiplicity) and what
routing gives, ``leaves`` (tree, row, leaf, out of bag or not). Rows carry their features as
one array ``x``; ``feature`` in nodes is a position in it.

Growth goes level by level, all trees at once: one aggregation builds the histograms of all
open nodes, windows find the best cuts, and rows move to the children. Jobs grow with depth,
not with trees. Where the binned rows are few enough for a task (a checked size), trees are
grown whole, one a task, by the same rules; results are the same.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copse.functions.portable import draw
from copse.operators import split
from copse.operators.prep import bag_weight, bin_edges, bin_of, bootstrap, edge_arrays, weighted_bootstrap
from copse.plans.storage import materialised

TERMINAL, SPLIT = -1, 1

NODES = (
    "tree_id int, node_id long, status int, feature int, split_value double, cats_left array<double>, left_id long, right_id long, "
    "node_class int, node_pred double, node_weight double, n long, depth int"
)

#: Cells (rows times features) up to which trees are grown whole in a task, and nodes up to which a forest travels to the rows.
WHOLE_CELLS, SENT_NODES = 4_000_000, 200_000


@dataclass(frozen=True)
class GrowParams:
    """What decides a forest. ``mtry`` and ``max_nodes`` of 0 are derived from the data."""

    task: str = "class"  # or "regress"
    n_trees: int = 100
    mtry: int = 0
    min_node: int = 1
    max_nodes: int = 0
    max_depth: int = 30
    n_bins: int = 256
    max_categories: int = 10
    random_partitions: int = 25
    seed: int | str = 12345
    casewise: bool = False
    categorical: tuple[int, ...] = field(default=())

    def resolved(self, n: int, p: int) -> GrowParams:
        mtry = self.mtry or max(1, int(math.sqrt(p)) if self.task == "class" else p // 3)
        nodes = self.max_nodes or min(2 * -(-max(n, 1) // max(self.min_node, 1)) + 1, 32001)
        return replace(self, mtry=min(mtry, p), max_nodes=nodes)


def feature_rows(df: DataFrame, features: Sequence[str], y: str | None, keep: Sequence[str] = ()) -> DataFrame:
    """``row_id, x, y`` and the columns to keep: features as an array, NaN as null."""
    x = F.array(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features])
    label = [F.col(y).cast("double").alias("y")] if y else []
    return df.select("row_id", x.alias("x"), *label, *keep)


def bins_of(rows: DataFrame, p: int, params: GrowParams) -> dict[str, list[tuple[float, float]]]:
    """Bins of every feature, keyed by its position as text."""
    names = [str(i) for i in range(p)]
    wide = rows.select(*[F.col("x")[i].alias(names[i]) for i in range(p)])
    return edge_arrays(bin_edges(wide, names, params.n_bins, [names[i] for i in params.categorical]))


def with_bins(rows: DataFrame, p: int, edges: dict[str, list[tuple[float, float]]], params: GrowParams) -> DataFrame:
    """The rows with their bins as the array ``b``; a missing value has the bin after the last and goes right."""
    each = [F.coalesce(bin_of(F.col("x")[i], edges.get(str(i), []), i in params.categorical), F.lit(len(edges.get(str(i), [])))).cast("int") for i in range(p)]
    return rows.withColumn("b", F.array(*each))


def bins_of_array(x: np.ndarray, edges: dict[str, list[tuple[float, float]]], params: GrowParams) -> np.ndarray:
    """What :func:`with_bins` gives, for rows by features."""
    out = np.zeros(x.shape, np.int32)
    for i in range(x.shape[1]):
        bins = edges.get(str(i), [])
        starts, value = np.array([lo for lo, _ in bins]), x[:, i]
        if i in params.categorical:
            at = np.searchsorted(starts, value)
            out[:, i] = np.where((at < len(starts)) & (starts[np.minimum(at, len(starts) - 1)] == value), at, 0) if len(starts) else 0
        elif len(bins) == 2:
            out[:, i] = value > starts[1]
        else:
            out[:, i] = np.maximum(np.searchsorted(starts, value, side="right") - 1, 0)
        out[np.isnan(value), i] = len(bins)
    return out


def make_bag(rows: DataFrame, params: GrowParams, weights: DataFrame | None = None) -> DataFrame:
    """The bag of all trees; ``weights`` (row_id, weight) makes it a weighted one."""
    if weights is None:
        return bootstrap(rows, params.n_trees, params.seed)
    return weighted_bootstrap(weights, "weight", params.n_trees, params.seed)


def candidate_features(params: GrowParams, p: int):
    """The mtry features of a node, ascending: the first in the order of a draw, without repetition."""
    drawn = F.array(*[F.struct(draw(params.seed, F.col("tree_id"), F.col("node_id"), i).alias("h"), F.lit(i).alias("f")) for i in range(p)])
    return F.sort_array(F.transform(F.slice(F.sort_array(drawn), 1, params.mtry), lambda s: s["f"]))


def grow(rows: DataFrame, bag: DataFrame, params: GrowParams, p: int, classes: int = 2, by_level: bool | None = None) -> DataFrame:
    """``nodes`` of a forest over rows (row_id, x, y). y holds classes 0, 1, ... or a target.

    A node is closed if it has fewer than ``min_node`` rows (twice that for a target), one
    class only, a variance below 1e-6, no cut with weight on both sides or no place left
    under ``max_nodes``. A leaf's class is its heaviest, the lowest of equals; its
    prediction is the mean. Rows with a null y take no part.
    """
    n = rows.count()
    params = params.resolved(n, p)
    edges = bins_of(rows, p, params)
    rows = rows.filter("y is not null")
    if by_level is None:
        by_level = n * p > WHOLE_CELLS
    if by_level:
        return _grow_by_level(materialised(with_bins(rows, p, edges, params), "binned"), bag_weight(bag, params.casewise), params, p, classes)
    return _grow_whole(rows, edges, bag, params, p, classes)


# -- level by level ----------------------------------------------------------------------

def _grow_by_level(rows: DataFrame, bag: DataFrame, params: GrowParams, p: int, classes: int) -> DataFrame:
    spark = rows.sparkSession
    by_class = params.task == "class"
    width = classes if by_class else 3
    here = bag.join(rows.select("row_id"), "row_id", "left_semi").select("tree_id", "row_id", "nin", "w").withColumn("node_id", F.lit(0).cast("long"))
    here = materialised(here, "assigned")
    done: DataFrame = spark.createDataFrame([], NODES)
    used = 1  # nodes of the fullest tree
    for depth in range(params.max_depth + 1):
        full = here.join(rows.select("row_id", "x", "b", "y"), "row_id")
        stats = split.class_sums(F.col("y"), F.col("w"), classes) if by_class else split.moments(F.col("y"), F.col("w"))
        open_nodes = full.groupBy("tree_id", "node_id").agg(
            F.count(F.lit(1)).alias("n"), F.sum("nin").alias("drawn"), stats.alias("t"), F.avg("y").alias("plain"))
        open_nodes = materialised(open_nodes, "open")
        t = F.col("t")
        if by_class:
            many = F.size(F.filter(t, lambda x: x > 0)) > 1
            splittable = (F.col("n") >= max(2, params.min_node)) & many
        else:
            splittable = (F.col("n") >= max(2, 2 * params.min_node)) & (t[2] / t[0] - (t[1] / t[0]) * (t[1] / t[0]) >= 1e-6)
        active = open_nodes.filter(splittable).select("tree_id", "node_id", "t", candidate_features(params, p).alias("features"))
        chosen = None
        if depth < params.max_depth and used + 2 <= params.max_nodes:
            long = full.join(active.select("tree_id", "node_id", "features"), ["tree_id", "node_id"]).withColumn("feature", F.explode("features"))
            long = long.select("tree_id", "node_id", "feature", F.col("b")[F.col("feature")].alias("bin"), F.col("x")[F.col("feature")].alias("value"), "y", "w")
            hist = split.histogram(long, ["tree_id", "node_id"], stats)
            cats = F.col("feature").isin(list(params.categorical)) if params.categorical else F.lit(False)
            found = split.numeric_candidates(hist.filter(~cats), ["tree_id", "node_id"], params.task, width)
            if params.categorical:
                found = found.unionByName(split.categorical_candidates(hist.filter(cats), ["tree_id", "node_id"], params.task, width, params.max_categories, params.random_partitions, params.seed))
            best = split.best(found.withColumn("bin", F.col("bin").cast("long")), ["tree_id", "node_id"])
            if not by_class:
                best = best.join(active.select("tree_id", "node_id", "t"), ["tree_id", "node_id"]).filter((F.col("score") - t[1] * t[1] / t[0]) / t[0] >= 1e-6)
            order = F.row_number().over(Window.partitionBy("tree_id").orderBy("node_id"))
            sizes = done.groupBy("tree_id").agg(F.count(F.lit(1)).alias("closed"))
            levels = open_nodes.groupBy("tree_id").agg(F.count(F.lit(1)).alias("open"))
            room = levels.join(sizes, "tree_id", "left").select("tree_id", (F.lit(params.max_nodes) - F.col("open") - F.coalesce("closed", F.lit(0))).alias("room"))
            best = best.withColumn("__o", order).join(room, "tree_id").filter(2 * F.col("__o") <= F.col("room"))
            chosen = materialised(best.select("tree_id", "node_id", "feature", "bin", "split_value", "cats_left"), "chosen")
        heaviest = F.array_max(F.transform(t, lambda x, i: F.struct(x.alias("w"), (-i).alias("k"))))["k"] if by_class else F.lit(None)
        mean = F.lit(None) if by_class else (t[1] / t[0] if params.casewise else F.col("plain"))
        level = open_nodes.select(
            "tree_id", "node_id", (-heaviest if by_class else heaviest).cast("int").alias("node_class"), mean.cast("double").alias("node_pred"),
            (F.col("drawn") / F.col("n")).alias("node_weight"), "n", F.lit(depth).alias("depth"))
        if chosen is not None:
            level = level.join(chosen, ["tree_id", "node_id"], "left")
        else:
            level = level.selectExpr("*", "cast(null as int) feature", "cast(null as double) split_value", "cast(null as array<double>) cats_left")
        cut = F.col("feature").isNotNull()
        level = level.select(
            "tree_id", "node_id", F.when(cut, SPLIT).otherwise(TERMINAL).alias("status"), F.col("feature").cast("int"), "split_value", "cats_left",
            F.when(cut, 2 * F.col("node_id") + 1).alias("left_id"), F.when(cut, 2 * F.col("node_id") + 2).alias("right_id"),
            "node_class", "node_pred", "node_weight", "n", "depth")
        done = materialised(done.unionByName(level), "nodes")
        if chosen is None or chosen.isEmpty():
            break
        moved = here.join(chosen, ["tree_id", "node_id"]).join(rows.select("row_id", "x", "b"), "row_id")
        value, bin_ = F.col("x")[F.col("feature")], F.col("b")[F.col("feature")]
        left = F.when(F.col("cats_left").isNotNull(), F.coalesce(F.array_contains("cats_left", value), F.lit(False))).otherwise(bin_ <= F.col("bin"))
        here = materialised(moved.select("tree_id", "row_id", "nin", "w", F.when(left, 2 * F.col("node_id") + 1).otherwise(2 * F.col("node_id") + 2).alias("node_id")), "assigned")
        used = done.groupBy("tree_id").count().agg(F.max("count")).first()[0]
    return done


# -- a tree a task -----------------------------------------------------------------------

def _draw(*parts) -> int:
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def _best_numeric(node: np.ndarray, k: int, b: np.ndarray, x: np.ndarray, stats: np.ndarray, t: np.ndarray, by_class: bool):
    """(score, bin, split value) of the best cut of one feature in each of k nodes at once; -inf where there is none.

    Rows come with their node; stats has a row a row: weights by class, or moments. Cells are the bins of a node that
    hold rows, in order, so running sums over cells less those before the node are what lies left of a cut.
    """
    score, at, value = np.full(k, -np.inf), np.zeros(k, np.int64), np.full(k, np.nan)
    if not len(node):
        return score, at, value
    size = int(b.max()) + 1
    key = node.astype(np.int64) * size + b
    order = np.argsort(key.astype(np.uint16) if k * size <= 1 << 16 else key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    of, bins = np.divmod(key[starts], size)
    cells = np.add.reduceat(stats[order], starts, axis=0)
    low, high = np.fmin.reduceat(x[order], starts), np.fmax.reduceat(x[order], starts)
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    many = np.diff(first, append=len(of))
    sums = np.cumsum(cells, axis=0)
    left = sums - np.repeat(sums[first] - cells[first], many, axis=0)
    right = t[of] - left
    nl, nr = (left.sum(axis=1), right.sum(axis=1)) if by_class else (left[:, 0], right[:, 0])
    with np.errstate(divide="ignore", invalid="ignore"):
        if by_class:
            each = (left * left).sum(axis=1) / nl + (right * right).sum(axis=1) / nr
        else:
            each = left[:, 1] * left[:, 1] / nl + right[:, 1] * right[:, 1] / nr
    each = np.where((nl >= 1) & (nr >= 1), each, -np.inf)
    most = np.maximum.reduceat(each, first)
    hit = np.flatnonzero((each == np.repeat(most, many)) & (each > -np.inf))
    owner, place = np.unique(of[hit], return_index=True)  # the first of equals
    cell = hit[place]
    above = low[np.minimum(cell + 1, len(low) - 1)]
    score[owner], at[owner] = each[cell], bins[cell]
    value[owner] = np.where(np.isnan(above), high[cell], (high[cell] + above) / 2)
    return score, at, value


def _best_categorical(b: np.ndarray, x: np.ndarray, stats: np.ndarray, by_class: bool, params: GrowParams, name: str):
    """(score, mask, categories on the left) of the best subset."""
    present = np.unique(b)
    k = len(present)
    if k < 2:
        return None
    hist = np.stack([stats[b == c].sum(axis=0) for c in present])
    lows = [np.nanmin(x[b == c]) if not np.isnan(x[b == c]).all() else math.nan for c in present]
    if k <= params.max_categories:
        masks = range(1, 1 << (k - 1))
    else:
        masks = [_draw(params.seed, name, i) % ((1 << min(k, 31)) - 2) + 1 for i in range(params.random_partitions)]
    found = None
    for mask in sorted(masks):
        yes = np.array([mask >> (i % 31) & 1 for i in range(k)], bool)
        left, right = hist[yes].sum(axis=0), hist[~yes].sum(axis=0)
        nl, nr = (left.sum(), right.sum()) if by_class else (left[0], right[0])
        if nl >= 1 and nr >= 1:
            score = (left * left).sum() / nl + (right * right).sum() / nr if by_class else left[1] ** 2 / nl + right[1] ** 2 / nr
            if found is None or score > found[0]:
                found = float(score), mask, [float(v) for v, y in zip(lows, yes) if y]
    return found


def _asked(params: GrowParams, tree: int, nodes: np.ndarray, can: np.ndarray, p: int) -> np.ndarray:
    """Which features each node asks: nodes by features."""
    out = np.zeros((len(nodes), p), bool)
    if params.mtry >= p:
        out[can] = True
        return out
    for i in np.flatnonzero(can):
        node = int(nodes[i])
        out[i, sorted(range(p), key=lambda f: (_draw(params.seed, tree, node, f), f))[: params.mtry]] = True
    return out


def _grow_tree(tree: int, b: np.ndarray, x: np.ndarray, y: np.ndarray, nin: np.ndarray, params: GrowParams, classes: int) -> pd.DataFrame:
    """Node rows of one tree, all nodes of a level at once; b, x: rows by features, nin: multiplicities."""
    by_class, p = params.task == "class", b.shape[1]
    inside = np.flatnonzero(nin)
    b, x, y, nin = b[inside], x[inside], y[inside], nin[inside]
    w = nin.astype(float) if params.casewise else np.ones(len(inside))
    if by_class:
        stats = np.zeros((len(inside), classes))
        stats[np.arange(len(inside)), y.astype(int)] = w
    else:
        stats = np.stack([w, w * y, w * y**2], axis=1)
    rows, node, used = np.arange(len(inside)), np.zeros(len(inside), np.int64), 1
    out: list[pd.DataFrame] = []
    for depth in range(params.max_depth + 1):
        if not len(rows):
            break
        nodes, of = np.unique(node, return_inverse=True)
        k, n = len(nodes), np.bincount(of)
        t = np.stack([np.bincount(of, s, k) for s in stats[rows].T], axis=1)
        if by_class:
            can = (n >= max(2, params.min_node)) & ((t > 0).sum(axis=1) > 1)
        else:
            can = (n >= max(2, 2 * params.min_node)) & (t[:, 2] / t[:, 0] - (t[:, 1] / t[:, 0]) ** 2 >= 1e-6)
        room = params.max_nodes - used
        score, feature, cut, value, cats = np.full(k, -np.inf), np.full(k, -1), np.zeros(k, np.int64), np.full(k, np.nan), np.full(k, None, object)
        if depth < params.max_depth and room >= 2 and can.any():
            asked = _asked(params, tree, nodes, can, p)
            for f in np.flatnonzero(asked.any(axis=0)):
                mine = np.flatnonzero(asked[of, f])
                r, o = rows[mine], of[mine]
                if f in params.categorical:
                    got, at, v, c = np.full(k, -np.inf), np.zeros(k, np.int64), np.full(k, np.nan), np.full(k, None, object)
                    order = np.argsort(o, kind="stable")
                    for part in np.split(order, np.flatnonzero(np.diff(o[order])) + 1):
                        i, each = o[part[0]], r[part]
                        found = _best_categorical(b[each, f], x[each, f], stats[each], by_class, params, f"{tree}:{nodes[i]}:{f}")
                        if found:
                            got[i], at[i], c[i] = found
                else:
                    got, at, v = _best_numeric(o, k, b[r, f], x[r, f], stats[r], t, by_class)
                    c = np.full(k, None, object)
                better = got > score
                score[better], feature[better], cut[better], value[better], cats[better] = got[better], f, at[better], v[better], c[better]
        split_here = feature >= 0
        if not by_class:
            with np.errstate(invalid="ignore"):
                split_here &= (score - t[:, 1] * t[:, 1] / t[:, 0]) / t[:, 0] >= 1e-6
        split_here &= 2 * np.cumsum(split_here) <= room
        mean = None if by_class else t[:, 1] / t[:, 0] if params.casewise else np.bincount(of, y[rows], k) / n
        no = lambda a: pd.array(np.where(split_here, a, 0), dtype="Int64").copy()
        children = {"left_id": no(2 * nodes + 1), "right_id": no(2 * nodes + 2), "feature": no(feature)}
        for column in children.values():
            column[~split_here] = pd.NA
        out.append(pd.DataFrame({
            "tree_id": tree, "node_id": nodes, "status": np.where(split_here, SPLIT, TERMINAL), "feature": children["feature"], "split_value": np.where(split_here, value, np.nan),
            "cats_left": np.where(split_here, cats, None), "left_id": children["left_id"], "right_id": children["right_id"],
            "node_class": pd.array(t.argmax(axis=1) if by_class else [None] * k, dtype="Int64"), "node_pred": np.nan if mean is None else mean,
            "node_weight": np.bincount(of, nin[rows], k) / n, "n": n, "depth": depth}))
        used += 2 * int(split_here.sum())
        keep = split_here[of]
        rows, of, node = rows[keep], of[keep], node[keep]
        go = b[rows, feature[of]] <= cut[of]
        for i in [i for i in np.flatnonzero(split_here) if cats[i] is not None]:
            here = np.flatnonzero(of == i)
            go[here] = np.isin(x[rows[here], feature[i]], cats[i])
        node = np.where(go, 2 * node + 1, 2 * node + 2)
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame()


def _grow_whole(rows: DataFrame, edges: dict[str, list[tuple[float, float]]], bag: DataFrame, params: GrowParams, p: int, classes: int) -> DataFrame:
    spark = rows.sparkSession
    table = rows.select("row_id", "x", "y").toPandas().sort_values("row_id")  # at most WHOLE_CELLS cells, checked by the caller
    names = [f.strip().split(" ")[0] for f in NODES.split(", ")]
    if table.empty:
        return spark.createDataFrame([], NODES)
    ids = table["row_id"].to_numpy()
    x = np.array([[math.nan if v is None else v for v in r] for r in table["x"]], float)
    sent = spark.sparkContext.broadcast((ids, bins_of_array(x, edges, params), x, table["y"].to_numpy()))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        ids, b, x, y = sent.value
        nin = np.zeros(len(ids), np.int64)
        at = np.minimum(np.searchsorted(ids, part["row_id"].to_numpy()), len(ids) - 1)
        known = ids[at] == part["row_id"].to_numpy()
        nin[at[known]] = part["nin"].to_numpy()[known]
        return _grow_tree(int(key[0]), b, x, y, nin, params, classes).reindex(columns=names)

    # A tree a partition, as many tasks as trees; a bag's rows fit a task as the whole table does.
    return materialised(bag.repartition(params.n_trees, "tree_id").groupBy("tree_id").applyInPandas(run, NODES), "nodes")


# -- routing -----------------------------------------------------------------------------

@dataclass
class _Tree:
    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    ids: np.ndarray
    cats: dict[int, list[float]]


def _trees(nodes: list) -> dict[int, _Tree]:
    """Arrays of each tree; a leaf's children are itself."""
    out: dict[int, _Tree] = {}
    by: dict[int, list] = {}
    for r in nodes:
        by.setdefault(r["tree_id"], []).append(r)
    for tree, rows in by.items():
        rows.sort(key=lambda r: r["node_id"])
        place = {r["node_id"]: i for i, r in enumerate(rows)}
        inner = [r["status"] == SPLIT for r in rows]
        out[tree] = _Tree(
            np.array([r["feature"] if s else 0 for r, s in zip(rows, inner)]),
            np.array([math.nan if r["split_value"] is None else r["split_value"] for r in rows]),
            np.array([place[r["left_id"]] if s else i for i, (r, s) in enumerate(zip(rows, inner))]),
            np.array([place[r["right_id"]] if s else i for i, (r, s) in enumerate(zip(rows, inner))]),
            np.array([r["node_id"] for r in rows]),
            {i: list(r["cats_left"]) for i, r in enumerate(rows) if r["cats_left"] is not None},
        )
    return out


def _walk(tree: _Tree, x: np.ndarray, steps: list | None = None) -> np.ndarray:
    """The place of each row's leaf; ``steps`` gathers (rows, features, depth) of the way there."""
    at = np.zeros(len(x), np.int64)
    moving = np.arange(len(x)) if tree.left[0] != 0 else np.empty(0, np.int64)
    depth = 0
    while len(moving):
        depth += 1
        node = at[moving]
        if steps is not None:
            steps.append((moving, tree.feature[node], depth))
        value = x[moving, tree.feature[node]]
        go = value <= tree.value[node]  # a missing value goes right
        for place, cats in tree.cats.items():
            here = node == place
            go[here] = np.isin(value[here], cats)
        at[moving] = np.where(go, tree.left[node], tree.right[node])
        moving = moving[tree.left[at[moving]] != at[moving]]
    return at


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows by features; a missing value is NaN."""
    width = column.value_lengths()
    if len(column) and not column.null_count and len(width.unique()) == 1:
        return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    return np.array([[math.nan if v is None else v for v in r] for r in column.to_pylist()], float)


def route(rows: DataFrame, nodes: DataFrame, keep: Sequence[str] = (), by_join: bool | None = None) -> DataFrame:
    """``tree_id, row_id, leaf_id`` (and kept columns) of every row in every tree.

    A row goes left if its value is at most the split value or among the left categories; a
    missing or unknown one goes right. A forest of few nodes (a checked number) travels to
    the rows; a larger one is joined level by level.
    """
    if by_join is None:
        by_join = nodes.count() > SENT_NODES
    if by_join:
        return _route_by_join(rows, nodes, keep)
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(_trees(nodes.select("tree_id", "node_id", "status", "feature", "split_value", "cats_left", "left_id", "right_id").collect()))
    rows = rows.select("row_id", *keep, "x")
    schema = "tree_id int, row_id long" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:-1]) + ", leaf_id long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        for batch in batches:
            x = _matrix(batch.column("x"))
            for t, tree in trees.items():
                if batch.num_rows:
                    leaf = tree.ids[_walk(tree, x)]
                    columns = [pa.array(np.full(len(x), t, np.int32)), batch.column("row_id"), *[batch.column(c) for c in keep], pa.array(leaf)]
                    yield pa.RecordBatch.from_arrays(columns, ["tree_id", "row_id", *keep, "leaf_id"])

    return rows.mapInArrow(run, schema)


def _steps_by_join(at: DataFrame, nodes: DataFrame, keep: Sequence[str]) -> Iterator[DataFrame]:
    """Rows (tree_id, x, kept columns) after each level of their tree, beginning at the root: ``node_id``, and the ``split_on`` feature of the step before (null where there was none)."""
    inner = nodes.filter(F.col("status") == SPLIT).select(
        "tree_id", "node_id", F.col("feature").alias("__f"), F.col("split_value").alias("__v"), F.col("cats_left").alias("__c"), F.col("left_id").alias("__l"), F.col("right_id").alias("__r"))
    at = at.select("tree_id", "x", *keep, F.lit(0).cast("long").alias("node_id"))
    yield at.withColumn("split_on", F.lit(None).cast("int"))
    for _ in range(nodes.agg(F.max("depth")).first()[0] or 0):
        value = F.get("x", F.col("__f"))
        left = F.when(F.col("__c").isNotNull(), F.array_contains("__c", value)).otherwise(value <= F.col("__v"))
        step = F.when(F.col("__f").isNull(), F.col("node_id")).when(F.coalesce(left, F.lit(False)), F.col("__l")).otherwise(F.col("__r"))
        at = materialised(at.join(inner, ["tree_id", "node_id"], "left").select("tree_id", "x", *keep, step.alias("node_id"), F.col("__f").cast("int").alias("split_on")), "step")
        yield at
        at = at.drop("split_on")


def _route_by_join(rows: DataFrame, nodes: DataFrame, keep: Sequence[str]) -> DataFrame:
    trees = nodes.select("tree_id").distinct()
    at = rows.select("row_id", "x", *keep).crossJoin(trees)  # a row a row and tree, as the result has
    for at in _steps_by_join(at, nodes, ["row_id", *keep]):
        pass
    return at.select("tree_id", "row_id", *keep, F.col("node_id").alias("leaf_id"))


def reroute(changed: DataFrame, nodes: DataFrame, keep: Sequence[str], by_join: bool | None = None) -> DataFrame:
    """``tree_id``, kept columns and ``leaf_id`` of rows (tree_id, x) in their own tree only; large forests (a checked number of nodes) by joins."""
    if by_join is None:
        by_join = nodes.count() > SENT_NODES
    if by_join:
        for at in _steps_by_join(changed, nodes, keep):
            pass
        return at.select("tree_id", *keep, F.col("node_id").alias("leaf_id"))
    sent = nodes.sparkSession.sparkContext.broadcast(_trees(nodes.collect()))
    changed = changed.select("tree_id", *keep, "x")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in changed.schema.fields[:-1]) + ", leaf_id long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree_ids = batch.column("tree_id").to_numpy()
            leaf = np.zeros(batch.num_rows, np.int64)
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                for t in np.unique(tree_ids):
                    at = np.flatnonzero(tree_ids == t)
                    tree = sent.value[int(t)]
                    leaf[at] = tree.ids[_walk(tree, x[at])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("tree_id", *keep)], pa.array(leaf)], ["tree_id", *keep, "leaf_id"])

    return changed.mapInArrow(run, schema)


def paths(rows: DataFrame, nodes: DataFrame, by_join: bool | None = None) -> DataFrame:
    """``tree_id, row_id, feature, depth``: each split on each row's way, depth from 1. Large forests (a checked number of nodes) by joins."""
    if by_join is None:
        by_join = nodes.count() > SENT_NODES
    if by_join:
        levels = list(_steps_by_join(rows.select("row_id", "x").crossJoin(nodes.select("tree_id").distinct()), nodes, ["row_id"]))  # a row a row and tree
        out = levels[0].filter(F.lit(False)).select("tree_id", "row_id", F.col("split_on").alias("feature"), F.lit(0).alias("depth"))
        for depth, at in enumerate(levels[1:], 1):
            out = out.union(at.filter("split_on is not null").select("tree_id", "row_id", "split_on", F.lit(depth)))
        return out
    sent = rows.sparkSession.sparkContext.broadcast(_trees(nodes.collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids = _matrix(batch.column("x")), batch.column("row_id").to_numpy()
            for t, tree in sent.value.items():
                steps: list = []
                if len(x):
                    _walk(tree, x, steps)
                for at, feature, depth in steps:
                    m = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, t, np.int32)), pa.array(ids[at]), pa.array(feature.astype(np.int32)), pa.array(np.full(m, depth, np.int32))], ["tree_id", "row_id", "feature", "depth"])

    return rows.select("row_id", "x").mapInArrow(run, "tree_id int, row_id long, feature int, depth int")


def leaves(rows: DataFrame, nodes: DataFrame, bag: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``tree_id, row_id, leaf_id, nin, is_oob`` of the training rows."""
    routed = route(rows, nodes, keep)
    out = routed.join(bag.select("tree_id", "row_id", "nin"), ["tree_id", "row_id"], "left")
    return out.withColumn("is_oob", F.col("nin").isNull()).withColumn("nin", F.coalesce("nin", F.lit(0)).cast("long"))
