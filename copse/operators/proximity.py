"""Proximity: how often rows share a leaf.

Proximity is a table of pairs with a positive value, never a matrix. What only needs sums
over pairs (prototypes, outlier scores) is computed from leaf counts without any pair.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copse.operators.prep import with_row_id
from copse.plans.storage import materialised


def alike(leaves: DataFrame, by: Sequence[str | Column] = ("tree_id", "leaf_id")) -> tuple[DataFrame, DataFrame]:
    """``row_id, kind, size`` of each row, and the leaves of one row of each kind, with its ``size``.

    Rows of a kind agree in the columns ``by`` in every tree, so they have the same proximity to any
    other row. A kind is named by its lowest row, size is its number of rows. Questions about pairs of
    rows are asked of pairs of kinds: few leaves hold few kinds, however many rows there are.
    """
    key = F.unhex(F.md5(F.to_json(F.sort_array(F.collect_list(F.struct(*by)))))).alias("key")
    keyed = materialised(leaves.groupBy("row_id").agg(key), "keys")
    first = keyed.groupBy("key").agg(F.min("row_id").alias("kind"), F.count(F.lit(1)).alias("size"))
    kinds = materialised(keyed.join(first, "key").select("row_id", "kind", "size"), "kinds")
    return kinds, materialised(leaves.join(kinds.filter("row_id = kind").select("row_id", "size"), "row_id"), "kind-leaves")


def spread(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of kinds (i, j and more) as pairs of their rows (row_id, kind). Nothing is grouped or sorted after the last join, so the pairs of rows are never shuffled."""
    rest = [c for c in pairs.columns if c not in ("i", "j")]
    a = left.select(F.col("kind").alias("i"), F.col("row_id").alias("__i"))
    b = right.select(F.col("kind").alias("j"), F.col("row_id").alias("__j"))
    return pairs.join(a, "i").join(b.hint("shuffle_hash"), "j").select(F.col("__i").alias("i"), F.col("__j").alias("j"), *rest)


def _raw(leaves: DataFrame, casewise: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kinds by leaves and draws, the leaves of one row of each, and ``i, j, r`` of pairs of kinds."""
    kinds, one = alike(leaves, ["tree_id", "leaf_id", "is_oob", F.col("nin") if casewise else (F.col("nin") > 0).alias("nin")])
    inside = one.filter("nin > 0")
    if casewise:
        mass = inside.groupBy("tree_id", "leaf_id").agg(F.sum(F.col("nin") * F.col("size")).alias("mass"))
        inside = inside.join(mass, ["tree_id", "leaf_id"]).withColumn("one", F.col("nin") / F.col("mass"))
    else:
        inside = inside.withColumn("one", F.lit(1.0))
    outside = one.filter("is_oob").select("tree_id", "leaf_id", F.col("row_id").alias("i"))
    raw = outside.join(inside.select("tree_id", "leaf_id", F.col("row_id").alias("j"), "one"), ["tree_id", "leaf_id"]).groupBy("i", "j").agg(F.sum("one").alias("r"))
    return kinds, one, raw


def raw_proximity(leaves: DataFrame, casewise: bool = False) -> DataFrame:
    """``i, j, r``: trees in which i is out of bag, j in the bag and both in one leaf; casewise j counts by its share of the leaf's draws."""
    kinds, _, raw = _raw(leaves, casewise)
    return spread(raw, kinds, kinds)


def _averaged(raw: DataFrame, counts: DataFrame) -> DataFrame:
    both = raw.select("i", "j", "r").union(raw.select(F.col("j").alias("i"), F.col("i").alias("j"), "r"))
    s = both.groupBy("i", "j").agg((F.sum("r") / 2).alias("s"))
    part = counts.select("row_id", (1 / F.greatest(F.col("nout"), F.lit(1))).alias("f"))
    out = s.join(part.select(F.col("row_id").alias("i"), F.col("f").alias("fi")), "i").join(part.select(F.col("row_id").alias("j"), F.col("f").alias("fj")), "j")
    return out.select("i", "j", (F.col("s") * (F.col("fi") + F.col("fj")) / 2).alias("p"))


def finished(raw: DataFrame, counts: DataFrame) -> DataFrame:
    """``i, j, p``: half the sum of both directions, divided by each row's out-of-bag count and averaged; 1 for a row and itself.

    A row that is never out of bag divides by 1. ``counts`` (row_id, nout) lists all rows.
    """
    return _averaged(raw, counts).filter("i <> j").union(counts.select(F.col("row_id").alias("i"), F.col("row_id").alias("j"), F.lit(1.0).alias("p")))


def kind_proximity(leaves: DataFrame, casewise: bool = False) -> tuple[DataFrame, DataFrame]:
    """``row_id, kind, size`` and ``i, j, p`` of pairs of kinds: what any row of the one has with any row of the other.

    Rows of a kind are out of bag in the same trees, so they have nothing with each other and no kind is paired with itself.
    """
    kinds, one, raw = _raw(leaves, casewise)
    return kinds, _averaged(raw, one.groupBy("row_id").agg(F.sum(F.col("is_oob").cast("long")).alias("nout")))


def finished_proximity(leaves: DataFrame, casewise: bool = False, shown: Callable[[Column], Column] = lambda p: p) -> DataFrame:
    """What :func:`finished` gives for the rows' raw proximity; ``shown`` (a rounding) is asked once a pair of kinds."""
    kinds, pairs = kind_proximity(leaves, casewise)
    out = spread(pairs.select("i", "j", shown(F.col("p")).alias("p")), kinds, kinds)
    return out.union(kinds.select(F.col("row_id").alias("i"), F.col("row_id").alias("j"), F.lit(1.0).alias("p")))


def gap_directed(leaves: DataFrame) -> DataFrame:
    """``i, j, g``: mean over i's out-of-bag trees of j's share of the draws in i's leaf. A row's shares sum to 1."""
    inside = leaves.filter("nin > 0")
    mass = inside.groupBy("tree_id", "leaf_id").agg(F.sum("nin").alias("mass"))
    inside = inside.join(mass, ["tree_id", "leaf_id"]).select("tree_id", "leaf_id", F.col("row_id").alias("j"), (F.col("nin") / F.col("mass")).alias("share"))
    outside = leaves.filter("is_oob").select("tree_id", "leaf_id", F.col("row_id").alias("i"))
    trees = outside.groupBy("i").agg(F.count(F.lit(1)).alias("trees"))
    sums = outside.join(inside, ["tree_id", "leaf_id"]).groupBy("i", "j").agg(F.sum("share").alias("share"))
    return sums.join(trees, "i").select("i", "j", (F.col("share") / F.col("trees")).alias("g"))


def gap_proximity(leaves: DataFrame, shown: Callable[[Column], Column] = lambda p: p) -> DataFrame:
    """``i, j, p``: both directions of :func:`gap_directed` averaged; a row that is never out of bag has 1 with itself.

    Rows of a kind have the same leaves and draws. The directed value asks the first row's out-of-bag
    trees only, so kinds that agree in these are asked once. ``shown`` (a rounding) is asked once a pair of kinds.
    """
    kinds, one = alike(leaves, ["tree_id", "leaf_id", "is_oob", "nin"])
    inside = one.filter("nin > 0")
    mass = inside.groupBy("tree_id", "leaf_id").agg(F.sum(F.col("nin") * F.col("size")).alias("mass"))
    inside = inside.join(mass, ["tree_id", "leaf_id"]).select("tree_id", "leaf_id", F.col("row_id").alias("j"), (F.col("nin") / F.col("mass")).alias("share"))
    asks, outside = alike(one.filter("is_oob").drop("size"))
    trees = outside.groupBy(F.col("row_id").alias("i")).agg(F.count(F.lit(1)).alias("trees"))
    g = outside.select("tree_id", "leaf_id", F.col("row_id").alias("i")).join(inside, ["tree_id", "leaf_id"]).groupBy("i", "j").agg(F.sum("share").alias("share"))
    g = materialised(g.join(trees, "i").select("i", "j", (F.col("share") / F.col("trees")).alias("g")), "gaps")
    g = g.join(asks.select(F.col("kind").alias("i"), "row_id"), "i").select(F.col("row_id").alias("i"), "j", "g")
    both = g.union(g.select(F.col("j").alias("i"), F.col("i").alias("j"), "g"))
    p = both.groupBy("i", "j").agg((F.sum("g") / 2).alias("p"))
    out = spread(p.select("i", "j", shown(F.col("p")).alias("p")), kinds, kinds)
    never = kinds.join(asks.select(F.col("row_id").alias("kind")), "kind", "left_anti")
    return out.union(never.select(F.col("row_id").alias("i"), F.col("row_id").alias("j"), F.lit(1.0).alias("p")))


def pair_proximity(leaves: DataFrame, i: int, j: int) -> DataFrame:
    """``p``: of the trees in which i is out of bag, the share in which j is in its leaf."""
    mine = leaves.filter((F.col("row_id") == i) & F.col("is_oob")).select("tree_id", "leaf_id")
    other = leaves.filter(F.col("row_id") == j).select("tree_id", F.col("leaf_id").alias("other"))
    return mine.join(other, "tree_id", "left").agg(F.avg((F.col("leaf_id") == F.col("other")).cast("double")).alias("p"))


def leaf_index(leaves: DataFrame) -> DataFrame:
    """``tree_id, leaf_id, n, rows``: the rows of each leaf. Joins do not need it; it is for looking at."""
    return leaves.groupBy("tree_id", "leaf_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("row_id")).alias("rows"))


def shared(left: DataFrame, right: DataFrame, n_trees: int) -> DataFrame:
    """``i, j, n, p``: trees in which two rows of two tables of leaves share a leaf, and their share of all trees."""
    a = left.select("tree_id", "leaf_id", F.col("row_id").alias("i"))
    b = right.select("tree_id", "leaf_id", F.col("row_id").alias("j"))
    return a.join(b, ["tree_id", "leaf_id"]).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / F.lit(float(n_trees)))


def _seeds(near: DataFrame, rows: DataFrame) -> DataFrame:
    """``row_id, seed``: each row's cluster by the row that opened it; ``near`` holds pairs i < j, each row is taken by the lowest opening row next to it.

    The order decides, so rounds are needed, but each settles many rows: a row opens a
    cluster as soon as no earlier undecided row could take it.
    """
    state = materialised(rows.select("row_id", F.lit(None).cast("boolean").alias("opens")), "labels")
    while True:
        open_rows = state.filter("opens is null").select("row_id")
        waiting = near.join(open_rows.withColumnRenamed("row_id", "i"), "i").select(F.col("j").alias("row_id")).distinct()
        opening = open_rows.join(waiting, "row_id", "left_anti")
        if opening.isEmpty():
            break
        new = materialised(state.join(opening.withColumn("now", F.lit(True)), "row_id", "left").select("row_id", F.coalesce("opens", "now").alias("opens")), "labels")
        taken = near.join(new.filter("opens").select(F.col("row_id").alias("i")), "i").select(F.col("j").alias("row_id"), F.lit(False).alias("taken")).distinct()
        state = materialised(new.join(taken, "row_id", "left").select("row_id", F.coalesce("opens", "taken").alias("opens")), "labels")
    by = near.join(state.filter("opens").select(F.col("row_id").alias("i")), "i").groupBy(F.col("j").alias("row_id")).agg(F.min("i").alias("by"))
    return state.join(by, "row_id", "left").select("row_id", F.when(F.col("opens"), F.col("row_id")).otherwise(F.col("by")).alias("seed"))


def _numbered(state: DataFrame) -> DataFrame:
    numbers = with_row_id(state.select("seed").distinct(), ["seed"], "label")
    return state.join(numbers, "seed").select("row_id", "label")


def cluster_labels(pairs: DataFrame, rows: DataFrame, above: float = 0.5) -> DataFrame:
    """``row_id, label``: rows in turn open a cluster if they have none, and take with them all later rows without one whose proximity exceeds ``above``."""
    near = materialised(pairs.filter((F.col("p") > above) & (F.col("i") < F.col("j"))).select("i", "j"), "near")
    return _numbered(materialised(_seeds(near, rows), "seeds"))


def leaf_cluster_labels(leaves: DataFrame, above: float = 0.5, casewise: bool = False) -> DataFrame:
    """What :func:`cluster_labels` gives for the rows' finished proximity.

    Rows of a kind are never next to each other, and what is next to one of them is next to all. So if
    the lowest row of a kind opens a cluster, no later row next to the kind does and all its rows open
    their own; if it is taken, all are, by the same row: kinds are clustered in the order of their lowest rows.
    """
    if above < 0:
        raise ValueError("above must not be negative")
    kinds, pairs = kind_proximity(leaves, casewise)
    near = materialised(pairs.filter((F.col("p") > above) & (F.col("i") < F.col("j"))).select("i", "j"), "near")
    seeds = _seeds(near, kinds.filter("row_id = kind").select("row_id")).select(F.col("row_id").alias("kind"), "seed")
    state = kinds.join(seeds, "kind").select("row_id", F.when(F.col("seed") == F.col("kind"), F.col("row_id")).otherwise(F.col("seed")).alias("seed"))
    return _numbered(materialised(state, "seeds"))
