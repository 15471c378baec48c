"""Similarity search with explanations, prototypes and cosine search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copse.functions.portable import dot, unit
from copse.operators.prep import with_row_id
from copse.operators.proximity import alike, shared, spread
from copse.plans.storage import materialised


def _top(df: DataFrame, by: str, k: int, group: str = "i", tie: str = "j") -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(by), tie))).filter(F.col("rank") <= k)


def _nearest(mine: DataFrame, leaves: DataFrame, k: int, n_trees: int | None = None, exclude_self: bool = True) -> DataFrame:
    """``i, rank, j, p``: of each row of ``mine`` the k rows that share most of its leaves, over ``n_trees`` or over the number of its leaves.

    Kinds of queries meet kinds of rows. The k nearest rows lie in the k nearest kinds, kinds at
    one distance by their lowest rows, and there they are the lowest rows of their kind.
    """
    asked, a = alike(mine)
    rows, b = alike(leaves)
    pairs = shared(a, b, n_trees or 1)
    if n_trees is None:
        pairs = pairs.join(a.groupBy(F.col("row_id").alias("i")).agg(F.count(F.lit(1)).alias("trees")), "i").withColumn("p", F.col("n") / F.col("trees"))
    return _of_rows(asked, rows, pairs, "p", k, exclude_self)


def _of_rows(asked: DataFrame, rows: DataFrame, pairs: DataFrame, by: str, k: int, exclude_self: bool) -> DataFrame:
    """``i, rank, j`` and ``by`` of rows, from pairs of kinds (i, j, by)."""
    most = k + 1 if exclude_self else k
    near = _top(pairs, by, most).select("i", F.col("j").alias("kind"), by)
    lowest = rows.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy("row_id"))).filter(F.col("rank") <= most).select("kind", F.col("row_id").alias("j"))
    near = _top(near.join(lowest, "kind"), by, most).select(F.col("i").alias("kind"), "rank", "j", by)
    out = asked.select("kind", F.col("row_id").alias("i")).join(near, "kind")
    if exclude_self:
        out = _top(out.filter("i <> j"), by, k)
    return out.select("i", "rank", "j", by)


def top_similar(leaves: DataFrame, queries: DataFrame, k: int = 10, exclude_self: bool = True) -> DataFrame:
    """``i, rank, j, p`` for training rows as queries (row_id): over the trees in which the query is out of bag; zeros are left out, ties go to the lower row."""
    mine = leaves.filter("is_oob").join(queries.select("row_id"), "row_id", "left_semi")
    return _nearest(mine, leaves, k, exclude_self=exclude_self)


def top_similar_all_trees(leaves: DataFrame, queries: DataFrame, k: int, n_trees: int) -> DataFrame:
    """``i, rank, j, p, norm`` over all trees; norm is p over the query's best."""
    top = _nearest(leaves.join(queries.select("row_id"), "row_id", "left_semi"), leaves, k, n_trees)
    return top.withColumn("norm", F.col("p") / F.max("p").over(Window.partitionBy("i"))).select("i", "rank", "j", "p", "norm")


def top_similar_new(new_leaves: DataFrame, leaves: DataFrame, k: int, n_trees: int) -> DataFrame:
    """``i, rank, j, p`` for rows that are not in the training table."""
    return _nearest(new_leaves, leaves, k, n_trees, exclude_self=False)


def top_features(importance: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """``row_id, rank, feature, value``: each query's features of highest importance (row_id, feature, importance)."""
    mine = importance.join(queries.select("row_id"), "row_id", "left_semi").withColumnRenamed("importance", "value")
    return _top(mine, "value", n, "row_id", "feature").select("row_id", "rank", "feature", "value")


def explained_new(new_leaves: DataFrame, leaves: DataFrame, new_paths: DataFrame, k: int, n_trees: int, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Neighbours, their features and the query's features.

    Neighbours are found first. Each tree that a query and a neighbour share credits the
    splits on the query's path with 1 over their depth. ``i, j, feature, share`` sums to 1
    for a neighbour; ``i, rank, feature, value`` are a query's n features with the highest
    sums over its neighbours.
    """
    top = top_similar_new(new_leaves, leaves, k, n_trees)
    together = new_leaves.select("tree_id", "leaf_id", F.col("row_id").alias("i")).join(top.select("i", "j"), "i")
    together = together.join(leaves.select("tree_id", "leaf_id", F.col("row_id").alias("j")), ["tree_id", "leaf_id", "j"])
    steps = new_paths.select("tree_id", F.col("row_id").alias("i"), "feature", (1 / F.col("depth")).alias("credit"))
    credit = together.join(steps, ["tree_id", "i"]).groupBy("i", "j", "feature").agg(F.sum("credit").alias("credit"))
    shares = credit.withColumn("share", F.col("credit") / F.sum("credit").over(Window.partitionBy("i", "j"))).select("i", "j", "feature", "share")
    sums = shares.groupBy("i", "feature").agg(F.sum("share").alias("value"))
    return top, shares, _top(sums, "value", n, "i", "feature").select("i", "rank", "feature", "value")


def mean_proximity(leaves: DataFrame, group: str | None = None) -> DataFrame:
    """``row_id, group, mean``: a row's mean finished proximity to all rows, or to those of its group (a column of leaves), itself included.

    The sum over all partners is a sum over leaves: with R the raw counts, the finished
    value of a pair is (R_ij + R_ji) (f_i + f_j) / 4, f being 1 over the out-of-bag count;
    each of its four terms is a leaf's total times what belongs to the row.
    """
    g = F.col(group) if group else F.lit(0)
    rows = leaves.withColumn("g", g)
    nout = rows.groupBy("row_id").agg(F.sum(F.col("is_oob").cast("long")).alias("nout"))
    rows = rows.join(nout, "row_id").withColumn("f", 1 / F.greatest(F.col("nout"), F.lit(1)))
    out, inn = F.col("is_oob").cast("double"), (F.col("nin") > 0).cast("double")
    sums = rows.groupBy("tree_id", "leaf_id", "g").agg(F.sum(inn).alias("b"), F.sum(inn * F.col("f")).alias("bf"), F.sum(out).alias("o"), F.sum(out * F.col("f")).alias("of"))
    own = rows.join(sums, ["tree_id", "leaf_id", "g"])
    term = out * (F.col("b") * F.col("f") + F.col("bf")) + inn * (F.col("o") * F.col("f") + F.col("of"))
    total = own.groupBy("row_id", "g").agg((F.sum(term) / 4 + 1).alias("total"))
    size = rows.select("row_id", "g").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    return total.join(size, "g").select("row_id", F.col("g").alias("group"), (F.col("total") / F.col("size")).alias("mean"))


def prototypes(leaves: DataFrame, k: int, group: str | None = None) -> DataFrame:
    """``group, rank, row_id, mean``: the k rows of highest mean proximity to all rows, or of each group to their own."""
    rounded = mean_proximity(leaves, group).withColumn("mean", F.round("mean", 9))
    return _top(rounded, "mean", k, "group", "row_id").select("group", "rank", "row_id", "mean")


def top_cosine(queries: DataFrame, rows: DataFrame, k: int, vector: str = "x", block_rows: int = 50_000) -> DataFrame:
    """``i, rank, j, cosine`` of vectors, itself left out; a query set against all rows, in blocks of some ``block_rows``, 16 at least.

    Equal vectors are one kind. Each block of kinds keeps its k best of each query, and those within
    1e-8 of the last, before blocks meet; cosines are rounded to 1e-9 only then. Vectors with missing
    entries or of several lengths are compared row by row.
    """
    v = F.col(vector)
    shape = [t.agg(F.min(F.size(v)), F.max(F.size(v)), F.max((v.isNull() | F.exists(v, lambda e: e.isNull())).cast("int"))).first() for t in (queries, rows)]
    if len({n for s in shape for n in s[:2]}) > 1 or any(s[2] for s in shape):
        return _top_cosine_by_rows(queries, rows, k, vector, block_rows)
    asked, a = alike(queries.select("row_id", v.alias("x")), ["x"])
    held, b = alike(rows.select("row_id", v.alias("x")), ["x"])
    blocks = max(16, -(-b.count() // block_rows))
    q = a.select("row_id", unit(F.col("x")).alias("u")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    r = b.select("row_id", unit(F.col("x")).alias("u")).withColumn("block", F.pmod(F.hash("row_id"), F.lit(blocks)))
    most = k + 1  # the query's own kind may be among them

    def run(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"i": pd.Series(dtype="int64"), "j": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})]
        if len(others):
            ids, all_v = others["row_id"].to_numpy(), np.stack(others["u"])
            for start in range(0, len(mine), 64):
                few = mine.iloc[start:start + 64]
                u = np.stack(few["u"])
                score = u @ all_v.T
                score[np.isnan(score)] = np.inf  # they come first, as in SQL
                last = np.partition(score, -most, axis=1)[:, -most] if len(ids) > most else np.full(len(u), -np.inf)
                p, at = np.nonzero(score >= last[:, None] - 1e-8)
                cosine = np.zeros(len(p))
                for d in range(u.shape[1]):  # in the order of a sum over the array
                    cosine += u[p, d] * all_v[at, d]
                found.append(pd.DataFrame({"i": few["row_id"].to_numpy()[p], "j": ids[at], "cosine": cosine}))
        return pd.concat(found, ignore_index=True)

    local = q.groupBy("block").cogroup(r.groupBy("block")).applyInPandas(run, "i long, j long, cosine double")
    return _of_rows(asked, held, local.withColumn("cosine", F.round("cosine", 9)), "cosine", k, True)


def _top_cosine_by_rows(queries: DataFrame, rows: DataFrame, k: int, vector: str, block_rows: int) -> DataFrame:
    blocks = max(16, -(-rows.count() // block_rows))
    q = queries.select(F.col("row_id").alias("i"), unit(F.col(vector)).alias("u")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    r = rows.select(F.col("row_id").alias("j"), unit(F.col(vector)).alias("v")).withColumn("block", F.pmod(F.hash("j"), F.lit(blocks)))
    scored = q.join(r, "block").filter("i <> j").select("block", "i", "j", F.round(dot(F.col("u"), F.col("v")), 9).alias("cosine"))
    local = scored.withColumn("__r", F.row_number().over(Window.partitionBy("block", "i").orderBy(F.desc("cosine"), "j"))).filter(F.col("__r") <= k)
    return _top(local, "cosine", k).select("i", "rank", "j", "cosine")


#: Entries up to which a set is compared with others as a whole; pairs by items up to which no blocks are made; sets of a block.
WHOLE_SET, PAIRS_BY_ITEM, BLOCK_SETS = 10_000, 20_000_000, 1_000


def jaccard_pairs(sets: DataFrame, least: float, shown: Callable[[Column], Column] = lambda p: p) -> DataFrame:
    """``a, b, jaccard`` of sets (id, item) that reach the threshold and have an item in common.

    Equal sets are one kind. Kinds meet on items, or, where that makes more pairs than there are
    pairs of kinds by far, in blocks whose common items one product of matrices counts. Sets of more
    than WHOLE_SET items always meet on items. ``shown`` (a rounding) is asked once a pair of kinds.
    """
    rows = sets.select(F.col("id").alias("row_id"), "item")
    size = rows.groupBy("row_id").agg(F.count(F.lit(1)).alias("n"))
    if (size.agg(F.max("n")).first()[0] or 0) > WHOLE_SET:
        out = _reached(_common_by_item(rows), size, least)
        return out.select(F.col("i").alias("a"), F.col("j").alias("b"), shown(F.col("jaccard")).alias("jaccard"))
    kinds, one = alike(rows, ["item"])
    size = one.groupBy("row_id").agg(F.count(F.lit(1)).alias("n"))
    by_item = one.filter("item is not null").groupBy("item").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    common = _common_by_block(one) if by_item > max(PAIRS_BY_ITEM, size.count() ** 2 / 20) else _common_by_item(one)
    pairs = _reached(common, size, least).select("i", "j", shown(F.col("jaccard")).alias("jaccard"))
    cross = spread(pairs, kinds, kinds).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "jaccard")
    own = one.filter("size > 1").groupBy("row_id").agg(F.count("item").alias("both"), F.count(F.lit(1)).alias("n"))
    own = own.select(F.col("row_id").alias("i"), F.col("row_id").alias("j"), (F.col("both") / (2 * F.col("n") - F.col("both"))).alias("jaccard")).filter((F.col("jaccard") > 0) & (F.col("jaccard") >= least))
    same = spread(own.withColumn("jaccard", shown(F.col("jaccard"))), kinds, kinds).filter("i < j")
    return cross.union(same.select("i", "j", "jaccard"))


def _reached(common: DataFrame, size: DataFrame, least: float) -> DataFrame:
    out = common.join(size.select(F.col("row_id").alias("i"), F.col("n").alias("ni")), "i").join(size.select(F.col("row_id").alias("j"), F.col("n").alias("nj")), "j")
    return out.select("i", "j", (F.col("both") / (F.col("ni") + F.col("nj") - F.col("both"))).alias("jaccard")).filter(F.col("jaccard") >= least)


def _common_by_item(sets: DataFrame) -> DataFrame:
    """``i, j, both``: the number of common items of sets i < j that have any."""
    left, right = sets.select(F.col("row_id").alias("i"), "item"), sets.select(F.col("row_id").alias("j"), "item")
    return left.join(right, "item").filter("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("both"))


def _common_by_block(sets: DataFrame) -> DataFrame:
    """What :func:`_common_by_item` gives; each pair of blocks of sets is a task's work, whatever their items."""
    codes = with_row_id(sets.filter("item is not null").select("item").distinct(), ["item"], "code")
    packed = materialised(sets.join(codes, "item").groupBy("row_id").agg(F.collect_list("code").alias("codes")), "sets")
    blocks = -(-packed.count() // BLOCK_SETS)
    mine = packed.withColumn("at", F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int"))
    meets = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    met = mine.select("row_id", "codes", "at", meets.alias("other")).select("row_id", "codes", "at", F.least("at", "other").alias("x"), F.greatest("at", "other").alias("y"))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x, y = key
        a, b = part[part["at"] == x], part[part["at"] == y]
        items = np.unique(np.concatenate([*part["codes"]]))
        both = np.zeros((len(a), len(b)), np.float32)
        for start in range(0, len(items), 2048):  # items at a time: the matrices stay small however many there are
            few = items[start:start + 2048]
            m = []
            for half in (a, b):
                all_codes, owner = np.concatenate([*half["codes"], np.empty(0, np.int64)]), np.repeat(np.arange(len(half)), half["codes"].map(len))
                hit = np.minimum(np.searchsorted(few, all_codes), len(few) - 1)
                known = few[hit] == all_codes
                m.append(np.zeros((len(half), len(few)), np.float32))
                m[-1][owner[known], hit[known].astype(int)] = 1
            both += m[0] @ m[1].T
        p, q = np.nonzero(both)
        i, j = a["row_id"].to_numpy()[p], b["row_id"].to_numpy()[q]
        keep = i < j if x == y else np.ones(len(i), bool)
        return pd.DataFrame({"i": np.where(i < j, i, j)[keep], "j": np.where(i < j, j, i)[keep], "both": both[p, q][keep].astype(np.int64)})

    kind = sets.schema["row_id"].dataType.simpleString()
    return met.groupBy("x", "y").applyInPandas(run, f"i {kind}, j {kind}, both long")
