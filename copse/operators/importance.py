"""Importance of features: by permutation, by paths and by changes of leaf.

Only trees that split on a feature are asked about it, and only their rows are routed
again, with the feature's value taken from a donor row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copse.functions.portable import draw
from copse.operators.forest import SENT_NODES, _matrix, _trees, _walk, paths, reroute, route
from copse.operators.prep import with_row_id
from copse.operators.votes import argmax_class, class_votes, mean_prediction, with_leaf


def used_features(nodes: DataFrame) -> DataFrame:
    """``tree_id, feature`` of each feature that a tree splits on."""
    return nodes.filter("status = 1").select("tree_id", "feature").distinct()


def _swapped(x: Column, feature: Column, value: Column) -> Column:
    return F.transform(x, lambda v, i: F.when(i == feature, value).otherwise(v))


def _rerouted(changed: DataFrame, nodes: DataFrame) -> DataFrame:
    """``tree_id, row_id, feature, k, leaf_id`` of rows (tree_id, row_id, feature, k, x) in their own tree only."""
    return reroute(changed, nodes, ["row_id", "feature", "k"])


def _donated(todo: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (row_id, donor and more) with their own features ``x`` and the donor's ``dx``. Joined by sorting: a table of all rows is small as a file and large in a broadcast."""
    donor = rows.select(F.col("row_id").alias("donor"), F.col("x").alias("dx")).hint("merge")
    return todo.join(rows.select("row_id", "x").hint("merge"), "row_id").join(donor, "donor")


def oob_donors(leaves: DataFrame, seed: int | str = 42) -> DataFrame:
    """``tree_id, row_id, donor``: the out-of-bag rows of a tree shuffled among themselves, the row at a place giving to the row at that place in a draw's order.

    A tree's rows are numbered within slices of the draw and of the id, so no task sorts a tree.
    """
    out = leaves.filter("is_oob").select("tree_id", "row_id").withColumn("h", draw(seed, F.col("tree_id"), F.col("row_id")))
    by_id = with_row_id(out.select("tree_id", "row_id"), ["tree_id", "row_id"], "at")
    by_draw = with_row_id(out, ["tree_id", "h", "row_id"], "at").select("at", F.col("row_id").alias("donor"))
    return by_id.join(by_draw, "at").select("tree_id", "row_id", "donor")


def permutation_importance(rows: DataFrame, nodes: DataFrame, leaves: DataFrame, donors: DataFrame, task: str = "class") -> DataFrame:
    """``feature, importance, sqsd``: per tree the fall in right answers (or the rise in squared error) over its out-of-bag rows, summed over trees."""
    before = with_leaf(leaves.filter("is_oob"), nodes).join(rows.select("row_id", "y"), "row_id")
    wrong = (lambda p: (F.col(p) - F.col("y")) ** 2) if task == "regress" else (lambda p: (F.col(p) != F.col("y")).cast("double"))
    answer = "node_pred" if task == "regress" else "node_class"
    before = before.select("tree_id", "row_id", "y", wrong(answer).alias("was"))
    todo = before.select("tree_id", "row_id").join(used_features(nodes), "tree_id").join(donors, ["tree_id", "row_id"])
    changed = _donated(todo, rows)
    changed = changed.select("tree_id", "row_id", "feature", F.lit(0).alias("k"), _swapped(F.col("x"), F.col("feature"), F.get("dx", F.col("feature"))).alias("x"))
    after = with_leaf(_rerouted(changed, nodes), nodes).join(before, ["tree_id", "row_id"]).withColumn("now", wrong(answer))
    per_tree = after.groupBy("tree_id", "feature").agg(F.avg(F.col("now") - F.col("was")).alias("d"))
    return per_tree.groupBy("feature").agg(F.sum("d").alias("importance"), F.sum(F.col("d") * F.col("d")).alias("sqsd"))


def local_importance(rows: DataFrame, nodes: DataFrame, leaves: DataFrame, donors: DataFrame, n_trees: int, task: str = "class") -> DataFrame:
    """``row_id, feature, importance``: 100 over the trees times the row's own loss through permuted features."""
    before = with_leaf(leaves.filter("is_oob"), nodes).join(rows.select("row_id", "y"), "row_id")
    wrong = (lambda p: (F.col(p) - F.col("y")) ** 2) if task == "regress" else (lambda p: (F.col(p) != F.col("y")).cast("double"))
    answer = "node_pred" if task == "regress" else "node_class"
    before = before.select("tree_id", "row_id", "y", wrong(answer).alias("was"))
    todo = before.select("tree_id", "row_id").join(used_features(nodes), "tree_id").join(donors, ["tree_id", "row_id"])
    changed = _donated(todo, rows)
    changed = changed.select("tree_id", "row_id", "feature", F.lit(0).alias("k"), _swapped(F.col("x"), F.col("feature"), F.get("dx", F.col("feature"))).alias("x"))
    after = with_leaf(_rerouted(changed, nodes), nodes).join(before, ["tree_id", "row_id"]).withColumn("now", wrong(answer))
    return after.groupBy("row_id", "feature").agg((100 * F.sum(F.col("now") - F.col("was")) / n_trees).alias("importance"))


def path_importance(rows: DataFrame, nodes: DataFrame, n_trees: int) -> DataFrame:
    """``row_id, feature, importance``: 1 over the depth of each split on the row's way, averaged over all trees."""
    return paths(rows, nodes).groupBy("row_id", "feature").agg((F.sum(1 / F.col("depth")) / n_trees).alias("importance"))


def row_donors(rows: DataFrame, repeats: int, seed: int | str = 12345) -> DataFrame:
    """``row_id, k, donor``: ``repeats`` rows of the same table for each row, with replacement; rows are numbered densely from 0."""
    n = max(rows.count(), 1)
    return rows.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("k")).withColumn("donor", draw(seed, F.col("row_id"), F.col("k")) % n)


def _changes(rows: DataFrame, nodes: DataFrame, features: Sequence[int], repeats: int, seed: int | str, what: str) -> DataFrame:
    """``row_id, feature, change``: a row a donor, of what a donor's value of the feature does to the row.

    What is asked: whether the class of most votes changes (class), by how much the mean prediction
    does (regress), in how many trees the leaf does (leaf). A row is asked in all trees at once, so
    what is grouped is a row a row, donor and feature. A large forest (a checked number of nodes) is joined.
    """
    changed = _donated(row_donors(rows, repeats, seed), rows)
    if nodes.count() > SENT_NODES:
        return _changes_by_join(changed, rows, nodes, features, what)
    found = nodes.collect()
    trees = _trees(found)
    at = {(r["tree_id"], r["node_id"]): r["node_class" if what == "class" else "node_pred"] for r in found}
    ends = {} if what == "leaf" else {t: np.array([np.nan if at[t, i] is None else at[t, i] for i in tree.ids.tolist()], float) for t, tree in trees.items()}
    sent = nodes.sparkSession.sparkContext.broadcast((trees, ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, ends = sent.value
        classes = sorted({c for e in ends.values() for c in e if c == c}) if what == "class" else []

        def answer(x: np.ndarray) -> np.ndarray:
            places = {t: _walk(tree, x) for t, tree in trees.items()}
            if what == "leaf":
                return np.stack(list(places.values()))
            each = np.stack([ends[t][place] for t, place in places.items()])
            return each.mean(axis=0) if what == "regress" else np.stack([(each == c).sum(axis=0) for c in classes]).argmax(axis=0)  # the lowest of equals

        for batch in batches:
            if not batch.num_rows:
                continue
            x, other = _matrix(batch.column("x")), _matrix(batch.column("dx"))
            was = answer(x)
            for f in features:
                moved = x.copy()
                moved[:, f] = other[:, f]
                now = answer(moved)
                change = np.abs(now - was) if what == "regress" else (now != was).sum(axis=0) if what == "leaf" else now != was
                yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(np.full(len(x), f, np.int32)), pa.array(change.astype(float))], ["row_id", "feature", "change"])

    return changed.select("row_id", "x", "dx").mapInArrow(run, "row_id long, feature int, change double")


def _changes_by_join(changed: DataFrame, rows: DataFrame, nodes: DataFrame, features: Sequence[int], what: str) -> DataFrame:
    asked = changed.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
    asked = asked.select("row_id", "feature", "k", _swapped(F.col("x"), F.col("feature"), F.get("dx", F.col("feature"))).alias("x"))
    asked = asked.crossJoin(F.broadcast(nodes.select("tree_id").distinct()))  # a row a tree, as routing gives
    now, was = _rerouted(asked, nodes), route(rows, nodes)
    if what == "leaf":
        both = now.join(was.withColumnRenamed("leaf_id", "was"), ["tree_id", "row_id"])
        return both.groupBy("row_id", "feature", "k").agg(F.sum((F.col("leaf_id") != F.col("was")).cast("double")).alias("change")).drop("k")
    now, was = with_leaf(now, nodes), with_leaf(was, nodes)
    if what == "regress":
        now, was, change = now.groupBy("row_id", "feature", "k").agg(F.avg("node_pred").alias("now")), mean_prediction(was), F.abs(F.col("now") - F.col("prediction"))
    else:
        votes = now.groupBy("row_id", "feature", "k", "node_class").agg(F.count(F.lit(1)).alias("v"))
        now = votes.groupBy("row_id", "feature", "k").agg(F.max(F.struct("v", (-F.col("node_class")).alias("c"))).alias("m")).select("row_id", "feature", "k", (-F.col("m.c")).alias("now"))
        was, change = argmax_class(class_votes(was)), (F.col("now") != F.col("prediction")).cast("double")
    return now.join(was, "row_id").select("row_id", "feature", change.alias("change"))


def predicted_permutation(rows: DataFrame, nodes: DataFrame, p: int, repeats: int = 5, task: str = "class", seed: int | str = 12345) -> DataFrame:
    """``row_id, feature, importance``: the share of donors that turn the forest's answer, or the mean absolute change of its prediction."""
    if task == "unsupervised":
        raise ValueError("an unsupervised forest has no answer to turn")
    changes = _changes(rows, nodes, range(p), repeats, seed, "regress" if task == "regress" else "class")
    return changes.groupBy("row_id", "feature").agg(F.avg("change").alias("importance"))


def median_change(rows: DataFrame, nodes: DataFrame, p: int, repeats: int = 5, seed: int | str = 12345) -> DataFrame:
    """``row_id, feature, importance``: the median absolute change of a regression forest's prediction over donors."""
    return _changes(rows, nodes, range(p), repeats, seed, "regress").groupBy("row_id", "feature").agg(F.median("change").alias("importance"))


def shift_donor(row: Column, feature: Column, tree: Column, n: int) -> Column:
    """The donor of a row for a feature in a tree: row + 31 feature + 17 tree, modulo n, the next one if that is the row itself."""
    at = (row + 31 * feature + 17 * tree) % n
    return F.when(at == row, (at + 1) % n).otherwise(at)


def proximity_importance(rows: DataFrame, nodes: DataFrame, leaves: DataFrame, correct_only: bool = True) -> DataFrame:
    """``row_id, feature, importance``: per tree, 1 over its out-of-bag rows if a donor's value moves the row to another leaf, summed over trees.

    Only out-of-bag rows, for classes only where the tree is right. Row numbers are dense from 0.
    """
    n = rows.count()
    mine = with_leaf(leaves.filter("is_oob"), nodes)
    sizes = mine.groupBy("tree_id").agg(F.count(F.lit(1)).alias("noob"))
    if correct_only:
        mine = mine.join(rows.select("row_id", "y"), "row_id").filter("node_class = y")
    todo = mine.select("tree_id", "row_id", F.col("leaf_id").alias("was")).join(used_features(nodes), "tree_id")
    todo = todo.withColumn("donor", shift_donor(F.col("row_id"), F.col("feature"), F.col("tree_id"), max(n, 1)))
    changed = _donated(todo, rows)
    changed = changed.select("tree_id", "row_id", "feature", F.lit(0).alias("k"), _swapped(F.col("x"), F.col("feature"), F.get("dx", F.col("feature"))).alias("x"))
    now = _rerouted(changed, nodes).join(todo.select("tree_id", "row_id", "feature", "was"), ["tree_id", "row_id", "feature"]).join(sizes, "tree_id")
    moved = F.when(F.col("leaf_id") != F.col("was"), 1 / F.col("noob")).otherwise(0.0)
    return now.groupBy("row_id", "feature").agg(F.sum(moved).alias("importance"))


def overall(importance: DataFrame, n_rows: int) -> DataFrame:
    """``feature, importance``: the mean over all rows, those without an entry as 0."""
    return importance.groupBy("feature").agg((F.sum("importance") / n_rows).alias("importance"))


def predicted_proximity_importance(rows: DataFrame, nodes: DataFrame, p: int, repeats: int = 5, seed: int | str = 12345) -> DataFrame:
    """``row_id, feature, importance``: the share of trees and donors whose value moves the row to another leaf."""
    n_trees = nodes.select("tree_id").distinct().count()
    used = sorted(r["feature"] for r in used_features(nodes).select("feature").distinct().collect())
    changes = _changes(rows, nodes, used, repeats, seed, "leaf")
    return changes.groupBy("row_id", "feature").agg((F.sum("change") / (n_trees * repeats)).alias("importance"))
