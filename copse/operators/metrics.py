"""Evaluation of classifiers, regressions and rankings.

Binary metrics take a table with ``y`` (1 is positive) and ``score``. Curves are sums over
distinct scores; areas are sums over the curve's rows, so nothing is gathered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copse.functions.portable import draw
from copse.operators.prefix import running_sums


def _over(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _at(y: Column, yes: Column) -> list[Column]:
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return [count((y == 1) & yes).alias("tp"), count((y != 1) & ~yes).alias("tn"), count((y != 1) & yes).alias("fp"), count((y == 1) & ~yes).alias("fn")]


def confusion_counts(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``tp, tn, fp, fn`` of score >= threshold."""
    return df.agg(*_at(F.col("y"), F.col("score") >= threshold))


def confusion_matrix(df: DataFrame, classes: int, y: str = "y", prediction: str = "prediction") -> DataFrame:
    """``actual, predicted, n`` for every pair of classes 0 to ``classes`` - 1."""
    grid = df.sparkSession.range(classes * classes).select((F.col("id") / classes).cast("int").alias("actual"), (F.col("id") % classes).cast("int").alias("predicted"))
    counts = df.groupBy(F.col(y).cast("int").alias("actual"), F.col(prediction).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def classification_report(df: DataFrame, y: str = "y", prediction: str = "prediction") -> DataFrame:
    """``class, precision, recall, f1, support``; 0 where a ratio has no base."""
    sides = df.select(F.col(y).alias("class"), F.lit(1).alias("s"), F.lit(0).alias("p"), (F.col(y) == F.col(prediction)).cast("int").alias("t")).union(
        df.select(F.col(prediction).alias("class"), F.lit(0), F.lit(1), F.lit(0)))
    sums = sides.groupBy("class").agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("t").alias("hits"))
    p, r = _over(F.col("hits"), F.col("predicted")), _over(F.col("hits"), F.col("support"))
    return sums.select("class", p.alias("precision"), r.alias("recall"), _over(2 * p * r, p + r).alias("f1"), F.col("support").cast("long").alias("support"))


def score_curve(df: DataFrame) -> DataFrame:
    """``score, p, n, tp, fp, pos, neg`` at each distinct score, highest first: what is classed positive down to it."""
    each = df.groupBy("score").agg(F.sum((F.col("y") == 1).cast("long")).alias("p"), F.sum((F.col("y") != 1).cast("long")).alias("n"))
    run = running_sums(each, [F.desc("score")], ["p", "n"], ["tp", "fp"])
    totals = each.agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    return run.crossJoin(F.broadcast(totals))  # one row


def roc_curve(df: DataFrame) -> DataFrame:
    """``threshold, fpr, tpr``, from (0, 0) at an infinite threshold."""
    c = score_curve(df)
    points = c.select(F.col("score").alias("threshold"), _over(F.col("fp"), F.col("neg")).alias("fpr"), _over(F.col("tp"), F.col("pos")).alias("tpr"))
    start = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], points.schema)
    return start.union(points)


def pr_curve(df: DataFrame) -> DataFrame:
    """``threshold, precision, recall``, from recall 0 and precision 1."""
    c = score_curve(df)
    points = c.select(F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), _over(F.col("tp"), F.col("pos")).alias("recall"))
    start = df.sparkSession.createDataFrame([(float("inf"), 1.0, 0.0)], points.schema)
    return start.union(points)


def trapezoid(df: DataFrame, x: str, y: str) -> DataFrame:
    """``area`` under the points in the order of x, then y. For curves of few points; areas of scores come from :func:`areas`."""
    w = Window.partitionBy(F.lit(0)).orderBy(x, y)
    step = df.select((F.col(x) - F.lag(x).over(w)).alias("dx"), ((F.col(y) + F.lag(y).over(w)) / 2).alias("h"))
    return step.agg(F.sum(F.col("dx") * F.col("h")).alias("area"))


def areas(df: DataFrame) -> DataFrame:
    """``auc, gini, average_precision, ks`` in one pass over the curve."""
    c = score_curve(df)
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    strip = F.col("n") * (tp - F.col("p") / 2)
    out = c.agg(
        (F.sum(strip) / (F.max("pos") * F.max("neg"))).alias("auc"),
        (F.sum(F.col("p") * tp / (tp + fp)) / F.max("pos")).alias("average_precision"),
        F.max(tp / F.col("pos") - fp / F.col("neg")).alias("ks"))
    return out.select("auc", (2 * F.col("auc") - 1).alias("gini"), "average_precision", "ks")


def brier_logloss(df: DataFrame, tiny: float = 1e-15) -> DataFrame:
    y = (F.col("y") == 1).cast("double")
    p = F.least(F.greatest(F.col("score"), F.lit(tiny)), F.lit(1 - tiny))
    return df.agg(F.avg((F.col("score") - y) ** 2).alias("brier"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def rates(counts: DataFrame) -> DataFrame:
    """Counts with accuracy, precision, recall, specificity, f1 and mcc."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    p, r = _over(tp, tp + fp), _over(tp, tp + fn)
    floor = F.greatest(F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), F.lit(1e-10))
    return counts.withColumns({
        "accuracy": _over(tp + tn, tp + tn + fp + fn), "precision": p, "recall": r, "specificity": _over(tn, tn + fp), "f1": _over(2 * p * r, p + r),
        "mcc": (tp * tn - fp * fn) / floor})


def thresholds(n: int = 199, low: float = 0.01, high: float = 0.99) -> list[float]:
    """Evenly spaced numbers, to 12 places so that every engine has the same."""
    return [round(low + (high - low) * i / (n - 1), 12) for i in range(n)]


def threshold_sweep(df: DataFrame, grid: Sequence[float] | None = None) -> DataFrame:
    """``threshold`` with counts and rates of each; rows are counted by the thresholds they reach, once."""
    grid = sorted(grid or thresholds())

    def reached(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high + 1) // 2
        return F.when(F.col("score") >= grid[mid - 1], reached(mid, high)).otherwise(reached(low, mid - 1))

    hist = df.select(reached(0, len(grid)).alias("k"), (F.col("y") == 1).cast("long").alias("p")).groupBy("k").agg(F.sum("p").alias("p"), F.sum(1 - F.col("p")).alias("n"))
    steps = df.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(grid)], "step int, threshold double")
    counts = steps.join(F.broadcast(hist)).groupBy("threshold").agg(  # one row a threshold on either side
        F.sum(F.when(F.col("k") >= F.col("step"), F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("k") < F.col("step"), F.col("n")).otherwise(0)).alias("tn"),
        F.sum(F.when(F.col("k") >= F.col("step"), F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when(F.col("k") < F.col("step"), F.col("p")).otherwise(0)).alias("fn"))
    return rates(counts)


def tune_threshold(
    df: DataFrame, objective: str = "f1", beta: float = 1.0, min_precision: float | None = None, min_recall: float | None = None,
    target_precision: float | None = None, target_recall: float | None = None, grid: Sequence[float] | None = None,
) -> DataFrame:
    """The row of :func:`threshold_sweep` that serves the objective best, the lowest threshold of equals.

    Constraints that no threshold meets are dropped (``constrained`` is false then). A target
    asks for the threshold whose precision (or recall) is nearest to it.
    """
    swept = threshold_sweep(df, grid)
    p, r = F.col("precision"), F.col("recall")
    goals = {"f1": F.col("f1"), "fbeta": _over((1 + beta * beta) * p * r, beta * beta * p + r), "recall": r, "precision": p, "mcc": F.col("mcc")}
    if objective not in goals:
        raise ValueError(f"unknown objective {objective!r}")
    goal, ok = goals[objective], F.lit(True)
    if target_precision is not None:
        goal = -F.abs(p - target_precision)
    elif target_recall is not None:
        goal = -F.abs(r - target_recall)
    else:
        ok = (p >= (min_precision or 0.0)) & (r >= (min_recall or 0.0))
    ranked = swept.withColumn("constrained", ok).withColumn("goal", F.round(goal, 12))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("constrained"), F.desc("goal"), "threshold")  # the sweep's few rows
    return ranked.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def evaluate(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row with all scalars."""
    out = rates(confusion_counts(df, threshold)).crossJoin(F.broadcast(areas(df))).crossJoin(F.broadcast(brier_logloss(df)))  # one row each
    return out.withColumn("support", F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))


def compare(models: Mapping[str, DataFrame], by: str = "auc", threshold: float = 0.5) -> DataFrame:
    """:func:`evaluate` of each model, best first, with ``rank``."""
    rows = None
    for name, df in models.items():
        one = evaluate(df, threshold).withColumn("model", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round(by, 12)), "model")
    return rows.withColumn("rank", F.row_number().over(w))


def calibration(df: DataFrame, bins: int = 10, strategy: str = "uniform") -> DataFrame:
    """``bin, mean_predicted, fraction_positive, n`` of bins that hold rows; the last bin has both ends. Quantile bins that coincide are one."""
    if strategy == "uniform":
        ends = [i / bins for i in range(bins + 1)]
    else:
        ends = sorted(set(df.agg(F.percentile("score", F.array(*[F.lit(i / bins) for i in range(bins + 1)]))).first()[0] or []))
    at = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(zip(ends, ends[1:])):
        inside = (F.col("score") >= lo) & ((F.col("score") <= hi) if i == len(ends) - 2 else (F.col("score") < hi))
        at = F.when(inside, i).otherwise(at)
    each = df.withColumn("bin", at).filter("bin is not null")
    return each.groupBy("bin").agg(F.avg("score").alias("mean_predicted"), F.avg((F.col("y") == 1).cast("double")).alias("fraction_positive"), F.count(F.lit(1)).alias("n"))


def bootstrap_ci(df: DataFrame, metric: str = "auc", replicates: int = 200, level: float = 0.95, seed: int | str = 42, threshold: float = 0.5) -> DataFrame:
    """``metric, low, high, replicates`` from resamples of the rows (row_id dense from 0); resamples of one class count for nothing."""
    n = df.count()
    draws = df.sparkSession.range(replicates * n).select((F.col("id") % replicates).alias("rep"), F.floor(F.col("id") / replicates).alias("d"))
    drawn = draws.select("rep", (draw(seed, F.col("rep"), F.col("d")) % max(n, 1)).alias("row_id")).groupBy("rep", "row_id").agg(F.count(F.lit(1)).alias("w")).join(df, "row_id")
    yes = F.col("y") == 1
    if metric == "auc":
        each = drawn.groupBy("rep", "score").agg(F.sum(F.when(yes, F.col("w")).otherwise(0)).alias("p"), F.sum(F.when(yes, 0).otherwise(F.col("w"))).alias("n"))
        tp = F.sum("p").over(Window.partitionBy("rep").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0))
        values = each.withColumn("tp", tp).groupBy("rep").agg(F.sum("p").alias("ps"), F.sum("n").alias("ns"), F.when((F.sum("p") > 0) & (F.sum("n") > 0), F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)) / (F.greatest(F.sum("p"), F.lit(1)) * F.greatest(F.sum("n"), F.lit(1)))).alias("value"))
    else:
        hit = F.col("score") >= threshold
        one = lambda c, name: F.sum(F.when(c, F.col("w")).otherwise(0)).alias(name)
        counts = drawn.groupBy("rep").agg(one(yes & hit, "tp"), one(~yes & ~hit, "tn"), one(~yes & hit, "fp"), one(yes & ~hit, "fn"))
        values = rates(counts.filter("tp + fn > 0 and tn + fp > 0")).withColumn("value", F.col(metric))
    tail = (1 - level) / 2
    ends = values.filter("value is not null").agg(F.percentile("value", F.array(F.lit(tail), F.lit(1 - tail))).alias("e"), F.count(F.lit(1)).alias("replicates"))
    return ends.select(F.lit(metric).alias("metric"), F.col("e")[0].alias("low"), F.col("e")[1].alias("high"), "replicates")


def regression(df: DataFrame, y: str = "y", prediction: str = "prediction") -> DataFrame:
    """``n, mse, rmse, mae, corr, r2``."""
    d = F.col(y) - F.col(prediction)
    out = df.agg(F.count(F.lit(1)).alias("n"), F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), F.corr(y, prediction).alias("corr"), F.var_pop(y).alias("v"))
    return out.select("n", "mse", F.sqrt("mse").alias("rmse"), "mae", "corr", (1 - F.col("mse") / F.col("v")).alias("r2"))


def daily_means(df: DataFrame, at: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(F.to_date(at).alias("day")).agg(*[F.avg(c).alias(c) for c in columns])


# -- rankings ----------------------------------------------------------------------------

def ndcg(ranked: DataFrame, k: int = 10) -> DataFrame:
    """``user, ndcg, hit_rate`` from (user, rank from 1, relevance): gain over log2(rank + 1), against the list's best order."""
    best = ranked.withColumn("ideal", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("relevance"), "rank")))
    gain = lambda place: F.when(F.col(place) <= k, F.col("relevance") / F.log2(F.col(place) + 1)).otherwise(0.0)
    sums = best.groupBy("user").agg(F.sum(gain("rank")).alias("dcg"), F.sum(gain("ideal")).alias("idcg"), F.max(((F.col("rank") <= k) & (F.col("relevance") > 0)).cast("int")).alias("hit"))
    return sums.select("user", _over(F.col("dcg"), F.col("idcg")).alias("ndcg"), F.col("hit").cast("double").alias("hit_rate"))


def user_ranking(recommended: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """``user, ndcg, hit_rate`` of recommendations (user, item, rank) against sets (user, item); the ideal has min(k, relevant) hits."""
    sizes = relevant.groupBy("user").agg(F.count(F.lit(1)).alias("n"))
    hits = recommended.filter(F.col("rank") <= k).join(relevant.select("user", "item"), ["user", "item"])
    dcg = hits.groupBy("user").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n")).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    out = sizes.join(dcg, "user", "left")
    return out.select("user", (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"), F.col("dcg").isNotNull().cast("double").alias("hit_rate"))


def recommend(liked: DataFrame, seen: DataFrame, neighbours: DataFrame, k: int = 20) -> DataFrame:
    """``user, item, score, rank``: neighbours (item, other, p) of what a user liked (user, item), summed, without what the user has seen."""
    scored = liked.join(neighbours, "item").groupBy("user", F.col("other").alias("item")).agg(F.round(F.sum("p"), 9).alias("score"))
    fresh = scored.join(seen.select("user", "item"), ["user", "item"], "left_anti")
    return fresh.withColumn("rank", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("score"), "item"))).filter(F.col("rank") <= k).select("user", "item", "score", "rank")
