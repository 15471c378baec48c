"""Split search over histograms.

A histogram has a row for each group, feature and bin. Numeric features are searched along
the bins with running sums, categorical ones over subsets of their categories. Of all
candidates of a group the best is one row, ties going to the first feature and bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copse.functions.portable import draw


def class_sums(label: Column, weight: Column, classes: int) -> Column:
    """An array of the weights of each class 0, 1, ... to aggregate into."""
    return F.array(*[F.sum(F.when(label == k, weight).otherwise(F.lit(0.0))) for k in range(classes)])


def moments(target: Column, weight: Column) -> Column:
    """Weight, weighted sum and weighted sum of squares to aggregate into."""
    return F.array(F.sum(weight), F.sum(weight * target), F.sum(weight * target * target))


def histogram(long: DataFrame, groups: Sequence[str], stats: Column) -> DataFrame:
    """``groups, feature, bin, s, lo, hi`` from rows (groups, feature, bin, value, ...); lo and hi are the values' ends."""
    return long.groupBy(*groups, "feature", "bin").agg(stats.alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def _total(s: Column) -> Column:
    return F.aggregate(s, F.lit(0.0), lambda a, x: a + x)


def _squares(s: Column) -> Column:
    return F.aggregate(s, F.lit(0.0), lambda a, x: a + x * x)


def side_score(s: Column, task: str) -> Column:
    """What a side adds to a split's score; the higher the purer."""
    return _squares(s) / _total(s) if task == "class" else s[1] * s[1] / s[0]


def size_of(s: Column, task: str) -> Column:
    return _total(s) if task == "class" else s[0]


def impurity(left: Column, right: Column, task: str) -> Column:
    """Weighted Gini impurity or weighted variance of the two sides over all weight."""
    if task == "class":
        n = _total(left) + _total(right)
        return 1 - (side_score(left, task) + side_score(right, task)) / n
    n = left[0] + right[0]
    return (left[2] + right[2] - side_score(left, task) - side_score(right, task)) / n


def numeric_candidates(hist: DataFrame, groups: Sequence[str], task: str, width: int) -> DataFrame:
    """``groups, feature, bin, score, left, right, split_value`` for a cut after each bin that leaves weight on both sides.

    The cut lies midway between the largest value on the left and the least on the right.
    """
    along = Window.partitionBy(*groups, "feature").orderBy("bin")
    run, whole = along.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*groups, "feature")
    parts = lambda w: F.array(*[F.sum(F.col("s")[i]).over(w) for i in range(width)])
    cut = hist.select(
        *groups, "feature", "bin", parts(run).alias("left"), parts(whole).alias("all"),
        F.max("hi").over(run).alias("below"), F.min("lo").over(along.rowsBetween(1, Window.unboundedFollowing)).alias("above"))
    cut = cut.withColumn("right", _minus(F.col("all"), F.col("left")))
    cut = cut.filter((size_of(F.col("left"), task) >= 1) & (size_of(F.col("right"), task) >= 1))
    score = side_score(F.col("left"), task) + side_score(F.col("right"), task)
    middle = F.when(F.col("above").isNull(), F.col("below")).otherwise((F.col("below") + F.col("above")) / 2)
    return cut.select(*groups, "feature", "bin", score.alias("score"), "left", "right", middle.alias("split_value"), F.lit(None).cast("array<double>").alias("cats_left"))


def categorical_candidates(hist: DataFrame, groups: Sequence[str], task: str, width: int, most: int = 10, tries: int = 25, seed: int | str = 12345) -> DataFrame:
    """The same for subsets of categories (``cats_left``; ``bin`` is the subset's bit mask).

    Up to ``most`` categories all subsets that leave out the last category are tried, beyond
    that ``tries`` random ones. A group has one row a category, which is what is gathered.
    """
    cats = hist.groupBy(*groups, "feature").agg(F.sort_array(F.collect_list(F.struct("bin", "s", "lo"))).alias("cats"))
    k = F.size("cats")
    power = lambda n: F.pow(F.lit(2.0), n).cast("long")
    every = F.sequence(F.lit(1).cast("long"), power(k - 1) - 1)
    some = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda i: draw(seed, F.concat_ws(":", *groups, "feature"), i) % (power(F.least(k, F.lit(31))) - 2) + 1)
    masks = cats.filter("size(cats) > 1").withColumn("bin", F.explode(F.when(k <= most, every).otherwise(some)))
    empty = F.array(*[F.lit(0.0)] * width)
    in_mask = lambda i: F.floor(F.col("bin") / power(F.pmod(i, F.lit(31)))) % 2 == 1
    chosen = lambda yes: F.aggregate(F.transform("cats", lambda x, i: F.when(in_mask(i) == F.lit(yes), x["s"]).otherwise(empty)), empty, _plus)
    sides = masks.select(*groups, "feature", "bin", "cats", chosen(True).alias("left"), chosen(False).alias("right"))
    sides = sides.filter((size_of(F.col("left"), task) >= 1) & (size_of(F.col("right"), task) >= 1))
    score = side_score(F.col("left"), task) + side_score(F.col("right"), task)
    left = F.transform(F.filter("cats", lambda x, i: in_mask(i)), lambda x: x["lo"])
    return sides.select(*groups, "feature", "bin", score.alias("score"), "left", "right", F.lit(None).cast("double").alias("split_value"), left.alias("cats_left"))


def best(candidates: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The best candidate of each group; of equals the first feature, then the first bin."""
    order = Window.partitionBy(*groups).orderBy(F.desc("score"), "feature", "bin")
    if not groups:
        order = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "feature", "bin")
    return candidates.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def exact_candidates(long: DataFrame, groups: Sequence[str], task: str, stats: Column, width: int) -> DataFrame:
    """Candidates at every value boundary, without bins: rows (groups, feature, value, ...)."""
    each = long.withColumn("bin", F.col("value"))
    return numeric_candidates(histogram(each, groups, stats), groups, task, width)
