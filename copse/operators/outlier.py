"""Outlier and anomaly scores from leaf co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copse.functions.portable import draw
from copse.operators.proximity import alike, shared
from copse.plans.storage import materialised

#: Below this sum a row is next to no other one.
NOTHING = 1e-10


def squared_sums(rows: DataFrame, others: DataFrame, n_trees: int) -> DataFrame:
    """``row_id, total``: the sum over all rows of ``others`` of the squared share of trees whose leaf they share with the row.

    Kinds of rows are asked, with their sizes. By counts of each pair of kinds in a leaf, or without
    pairs of kinds: a squared count is a count of pairs of trees, so the sum over partners is a sum
    over pairs of trees of the rows that are in both leaves. The first grows with the leaves' kinds,
    the second with the square of the trees; the cheaper one is taken, by counts.
    """
    asked, a = alike(rows)
    b = a if others is rows else alike(others)[1]
    in_leaves = lambda df, c: df.groupBy("tree_id", "leaf_id").agg(F.count(F.lit(1)).alias(c))
    by_rows = in_leaves(a, "a").join(in_leaves(b, "b"), ["tree_id", "leaf_id"]).agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0
    by_trees = (a.count() + b.count()) * (n_trees + 1) / 2
    if by_rows <= by_trees:
        sums = _met(a, b, n_trees).select("row_id", "total")
    else:
        sums = _by_pairs_of_trees(a, b, n_trees)
    sums = sums.withColumnRenamed("row_id", "kind")
    return asked.select("row_id", "kind").join(sums, "kind", "left").select("row_id", F.coalesce("total", F.lit(0.0)).alias("total"))


def _met(a: DataFrame, b: DataFrame, n_trees: int) -> DataFrame:
    """``row_id, near, total`` of each kind of ``a``: rows of the kinds of ``b`` that share a leaf with it, and the sum of their squared shares of trees."""
    sizes = b.select(F.col("row_id").alias("j"), "size").distinct()
    total = F.sum(F.col("n") * F.col("n") * F.col("size")) / F.lit(float(n_trees) ** 2)
    return shared(a, b, n_trees).join(sizes, "j").groupBy(F.col("i").alias("row_id")).agg(F.sum("size").alias("near"), total.alias("total"))


def _by_pairs_of_trees(rows: DataFrame, others: DataFrame, n_trees: int) -> DataFrame:
    """Rows of ``others`` count by their ``size``, if there is one."""
    def pairs(df: DataFrame, name: str) -> DataFrame:
        size = (F.max("size") if "size" in df.columns else F.lit(1)).alias("size")
        packed = df.groupBy(F.col("row_id").alias(name)).agg(F.sort_array(F.collect_list(F.struct("tree_id", "leaf_id"))).alias("at"), size)  # one entry a tree
        first = packed.select(name, "size", "at", F.posexplode("at").alias("k", "s"))
        return first.select(name, "size", F.col("s.tree_id").alias("t1"), F.col("s.leaf_id").alias("l1"), F.explode(F.slice("at", F.col("k") + 1, F.size("at"))).alias("u")).select(
            name, "size", "t1", "l1", F.col("u.tree_id").alias("t2"), F.col("u.leaf_id").alias("l2"))

    keys = ["t1", "l1", "t2", "l2"]
    held = pairs(others, "j").groupBy(*keys).agg(F.sum("size").alias("c"))
    mine = pairs(rows, "row_id").join(held, keys, "left")
    twice = F.when(F.col("t1") == F.col("t2"), F.col("c")).otherwise(2 * F.col("c"))
    return mine.groupBy("row_id").agg((F.sum(F.coalesce(twice, F.lit(0))) / F.lit(float(n_trees) ** 2)).alias("total"))


def raw_score(total: Column, above: Column, n: Column) -> Column:
    """The numerator over the sum, or n times 1e10 for a row next to nothing."""
    return F.when(total <= NOTHING, n * 1e10).otherwise(above / total)


def full_scores(leaves: DataFrame, n_trees: int) -> DataFrame:
    """``row_id, raw``: (n - 1) over the squared proximities to all other rows, over all trees."""
    rows = leaves.select("tree_id", "leaf_id", "row_id")
    n = leaves.select("row_id").distinct().count()
    sums = squared_sums(rows, rows, n_trees).withColumn("total", F.col("total") - 1)  # itself
    return sums.select("row_id", raw_score(F.col("total"), F.lit(float(n - 1)), F.lit(float(n))).alias("raw"))


def random_anchors(rows: DataFrame, k: int, seed: int | str = 12345) -> DataFrame:
    """``row_id`` of k rows, the first in the order of a draw."""
    return rows.select("row_id", draw(seed, F.col("row_id")).alias("h")).orderBy("h", "row_id").limit(k).select("row_id")


def diverse_anchors(leaves: DataFrame, k: int, n_trees: int, seed: int | str = 12345) -> DataFrame:
    """``row_id`` of k rows far from each other: one by draw, then each time the row whose highest proximity to those chosen is least, the lowest of equals."""
    rows = leaves.select("row_id").distinct()
    first = random_anchors(rows, 1, seed).first()
    chosen = [first["row_id"]] if first else []
    state = materialised(rows.withColumn("p", F.lit(0.0)), "anchors")
    while chosen and len(chosen) < k:
        last = leaves.filter(F.col("row_id") == chosen[-1]).select("tree_id", "leaf_id")
        near = leaves.join(last, ["tree_id", "leaf_id"]).groupBy("row_id").agg((F.count(F.lit(1)) / F.lit(float(n_trees))).alias("q"))
        state = materialised(state.join(near, "row_id", "left").select("row_id", F.greatest("p", F.coalesce("q", F.lit(0.0))).alias("p")), "anchors")
        best = state.filter(~F.col("row_id").isin(chosen)).orderBy("p", "row_id").first()
        if best is None:
            break
        chosen.append(best["row_id"])
    return leaves.sparkSession.createDataFrame([(c,) for c in chosen], "row_id long")


def anchor_scores(leaves: DataFrame, anchors: DataFrame, n_trees: int, used_only: bool = False) -> DataFrame:
    """``row_id, raw``: anchors over the squared proximities to them, the row itself left out of the sum.

    With ``used_only`` the numerator counts the anchors that are other rows.
    """
    n = leaves.select("row_id").distinct().count()
    k = anchors.count()
    rows = leaves.select("tree_id", "leaf_id", "row_id")
    sums = squared_sums(rows, rows.join(anchors, "row_id", "left_semi"), n_trees)
    own = sums.join(anchors.withColumn("own", F.lit(1.0)), "row_id", "left").select("row_id", (F.col("total") - F.coalesce("own", F.lit(0.0))).alias("total"), F.coalesce("own", F.lit(0.0)).alias("own"))
    return own.select("row_id", raw_score(F.col("total"), F.lit(float(k)) - (F.col("own") if used_only else F.lit(0.0)), F.lit(float(n))).alias("raw"))


def upper_median(df: DataFrame, value: str, group: str) -> DataFrame:
    """``group, m``: of n sorted values the one at place floor(n / 2), from 0.

    Values are cut at approximate quantiles on both sides of the place; only the slice
    between them is sorted, after the values below it have been counted.
    """
    ends = df.groupBy(group).agg(F.count(value).alias("n"), F.percentile_approx(value, [0.49, 0.52], 10_000).alias("e"))
    near = df.join(ends.select(F.col(group).alias("__g"), "n", "e"), F.col(group).eqNullSafe(F.col("__g")))
    low, high = F.col("e")[0], F.col("e")[1]
    below = near.groupBy("__g").agg(F.sum((F.col(value) < low).cast("long")).alias("below"))
    small = near.filter((F.col(value) >= low) & ((F.col(value) <= high) | (F.col("n") < 1000))).select("__g", "n", F.col(value).alias("m"))
    at = small.withColumn("place", F.row_number().over(Window.partitionBy("__g").orderBy("m")) - 1)
    hit = at.join(below.withColumnRenamed("__g", "__h"), F.col("__g").eqNullSafe(F.col("__h"))).filter(F.col("place") + F.col("below") == F.floor(F.col("n") / 2))
    return hit.select(F.col("__g").alias(group), "m")


def normalised(scores: DataFrame, group: str | None = None) -> DataFrame:
    """``row_id, raw, score`` (and the group): raw less its upper median, over the upper median of absolute deviations; a spread below 1e-10 counts as 1."""
    g = group or "__all"
    keyed = materialised(scores if group else scores.withColumn(g, F.lit(0)), "scores")
    centre = upper_median(keyed, "raw", g).withColumnRenamed("m", "centre")
    away = keyed.join(centre.withColumnRenamed(g, "__k"), F.col(g).eqNullSafe(F.col("__k"))).drop("__k").withColumn("away", F.abs(F.col("raw") - F.col("centre")))
    away = materialised(away, "away")
    spread = upper_median(away, "away", g).select(F.col(g).alias("__k"), F.when(F.col("m") < 1e-10, 1.0).otherwise(F.col("m")).alias("spread"))
    out = away.join(spread, F.col(g).eqNullSafe(F.col("__k")))
    return out.select("row_id", *([group] if group else []), "raw", ((F.col("raw") - F.col("centre")) / F.col("spread")).alias("score"), "centre", "spread")


def top_outliers(scores: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The k rows of highest score."""
    return scores.orderBy(F.desc(by), "row_id").limit(k)


def predicted_raw(new_leaves: DataFrame, leaves: DataFrame, n_trees: int, anchors: DataFrame | None = None) -> DataFrame:
    """``row_id, raw`` of new rows: training rows (or anchors) that share any leaf with them, over the squared proximities."""
    n = leaves.select("row_id").distinct().count()
    others = leaves.select("tree_id", "leaf_id", "row_id")
    if anchors is not None:
        others = others.join(anchors, "row_id", "left_semi")
    rows = new_leaves.select("tree_id", "leaf_id", "row_id")
    asked, a = alike(rows)
    sums = asked.select(F.col("row_id").alias("i"), F.col("kind").alias("row_id")).join(_met(a, alike(others)[1], n_trees), "row_id", "left")
    total, near = F.coalesce("total", F.lit(0.0)), F.coalesce("near", F.lit(0)).cast("double")
    return sums.select(F.col("i").alias("row_id"), raw_score(total, near, F.lit(float(n))).alias("raw"))


def predicted_scores(raw: DataFrame, stats: DataFrame, group: str | None = None) -> DataFrame:
    """New raw scores normalised by the training scores' centre and spread (of their group)."""
    one = stats.select(*([F.col(group).alias("__g")] if group else []), "centre", "spread").distinct()
    out = raw.join(one, F.col(group).eqNullSafe(F.col("__g"))) if group else raw.crossJoin(F.broadcast(one))  # one row
    return out.select("row_id", "raw", ((F.col("raw") - F.col("centre")) / F.col("spread")).alias("score"))


def mean_proximity_scores(new_leaves: DataFrame, leaves: DataFrame, n_trees: int) -> DataFrame:
    """``row_id, score``: 1 less the mean proximity to all training rows, from leaf sizes alone."""
    n = leaves.select("row_id").distinct().count()
    sizes = leaves.groupBy("tree_id", "leaf_id").agg(F.count(F.lit(1)).alias("c"))
    near = new_leaves.join(sizes, ["tree_id", "leaf_id"], "left").groupBy("row_id").agg(F.sum(F.coalesce("c", F.lit(0))).alias("c"))
    return near.select("row_id", (1 - F.col("c") / F.lit(float(max(n, 1)) * n_trees)).alias("score"))


def percentile_flags(scores: DataFrame, share: float = 0.9, by: str = "score") -> DataFrame:
    """The scores with ``flag``: above the interpolated percentile."""
    at = scores.agg(F.percentile(by, F.lit(share))).first()[0]
    return scores.withColumn("flag", (F.col(by) > F.lit(at)).cast("int"))


def rank_imputers(scores: DataFrame) -> DataFrame:
    """``method, mean_p, share_above, rank`` from (method, p): p is the chance of being synthetic, the lower the better."""
    sums = scores.groupBy("method").agg(F.avg("p").alias("mean_p"), F.avg((F.col("p") > 0.5).cast("double")).alias("share_above"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("mean_p", "method")))
