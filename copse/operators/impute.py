"""Imputation: constant and random fills, forests per feature, proximity-weighted donors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copse.functions.portable import draw
from copse.operators import forest
from copse.operators.prep import kinds, synthetic_union, with_row_id
from copse.operators.proximity import alike, shared
from copse.operators.votes import argmax_class, class_votes, mean_prediction, with_leaf
from copse.plans.storage import materialised

LEAST_ROWS = 10


def rough_fills(df: DataFrame, features: Sequence[str], categorical: Sequence[str] = ()) -> dict[str, float]:
    """The fill of each feature: its interpolated median, or for categories the most frequent value, the least of equals; 0 where nothing is observed."""
    numeric = [c for c in features if c not in categorical]
    out: dict[str, float] = {}
    if numeric:
        row = df.agg(*[F.median(c).alias(c) for c in numeric]).first()
        out |= {c: float(row[c]) if row[c] is not None else 0.0 for c in numeric}
    for c in categorical:
        top = df.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).first()
        out[c] = float(top[0]) if top else 0.0
    return out


def rough_impute(df: DataFrame, features: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """Missing cells filled by :func:`rough_fills`."""
    fills = rough_fills(df, features, categorical)
    return df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(fills[c])).alias(c) if c in features else F.col(c) for c in df.columns])


def random_impute(df: DataFrame, features: Sequence[str], seed: int | str = 42) -> DataFrame:
    """Missing cells filled by a random observed value of the feature, 0 where nothing is observed."""
    out = df
    for c in features:
        seen = with_row_id(df.filter(F.col(c).isNotNull()).select("row_id", F.col(c).cast("double").alias("__v")), ["row_id"], "__at").select("__at", "__v")
        n = seen.count()
        if not n:
            out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
            continue
        out = out.withColumn("__at", F.when(F.col(c).isNull(), draw(seed, c, F.col("row_id")) % n)).join(seen, "__at", "left")
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), "__v")).drop("__at", "__v")
    return out.select(*df.columns)


def _start(df: DataFrame, features: Sequence[str], categorical: Sequence[str], method: str, seed: int | str) -> DataFrame:
    if method == "rough":
        return rough_impute(df, features, categorical)
    if method == "random":
        return random_impute(df, features, seed)
    raise ValueError(f"unknown method {method!r}")


def observed_kinds(df: DataFrame, features: Sequence[str], categorical: Sequence[str] | None) -> list[str]:
    """Categorical features: the given ones and those that :func:`kinds` finds for the imputer."""
    found = [r["feature"] for r in kinds(df, features, for_imputer=True).filter("categorical").collect()]
    return [c for c in features if c in found or c in (categorical or ())]


def _fit_one(train: DataFrame, features: Sequence[str], target: str, is_class: bool, params: forest.GrowParams):
    """Nodes and the labels by class number, of a forest for one feature; a constant if there is one class only."""
    if is_class:
        labels = [r[0] for r in train.select(target).distinct().orderBy(target).collect()]  # categories: few by the rule that found them
        number = F.lit(0)
        for i, v in enumerate(labels):
            number = F.when(F.col(target) == v, i).otherwise(number)
        rows = train.withColumn("__y", number)
    else:
        labels, rows = [], train.withColumn("__y", F.col(target))
    data = materialised(with_row_id(forest.feature_rows(rows, features, "__y").withColumnRenamed("row_id", "__r"), ["__r"]).drop("__r"), "impute-rows")
    bag = materialised(forest.make_bag(data, params), "impute-bag")
    return materialised(forest.grow(data, bag, params, len(features), max(len(labels), 1)), "impute-nodes"), labels


def _predict_one(rows: DataFrame, nodes: DataFrame, labels: Sequence[float], is_class: bool) -> DataFrame:
    ends = with_leaf(forest.route(rows, nodes), nodes)
    if not is_class:
        return mean_prediction(ends)
    out = argmax_class(class_votes(ends))
    return out.select("row_id", F.element_at(F.array(*[F.lit(float(v)) for v in labels]), F.col("prediction") + 1).alias("prediction"))


def forest_impute(
    df: DataFrame, features: Sequence[str], categorical: Sequence[str] | None = None, method: str = "rough", iterations: int = 1,
    n_trees: int = 100, seed: int | str = 42, params: Mapping | None = None, tolerance: float = 1e-6,
) -> tuple[DataFrame, dict]:
    """The filled table and what was done.

    Features with missing cells are taken by rising share of them. A forest learns each from
    the others' current values on the rows where it is observed and fills the rest, before
    the next feature is taken. A feature observed in fewer than LEAST_ROWS rows keeps its
    first fill, one with a single class gets that. Rounds end when the summed mean absolute
    change falls below ``tolerance``.
    """
    cats = observed_kinds(df, features, categorical)
    counts = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in features]).first()
    todo = sorted((c for c in features if counts[c]), key=lambda c: (counts[c], list(features).index(c)))
    info = {"missing": {c: counts[c] or 0 for c in features}, "categorical": cats, "iterations": 0, "changes": []}
    if not todo:
        return df, info
    flags = df.select("row_id", *[F.col(c).isNull().alias(f"__m_{c}") for c in todo])
    state = materialised(_start(df, features, cats, method, seed).join(flags, "row_id"), "imputed")
    for step in range(iterations):
        moved = 0.0
        for c in todo:
            others = [f for f in features if f != c]
            train = state.filter(f"not `__m_{c}`")
            if train.limit(LEAST_ROWS).count() < LEAST_ROWS or not others:
                continue
            is_class = c in cats
            if is_class and train.select(c).distinct().limit(2).count() < 2:
                value = train.select(c).first()[0]
                guess = state.filter(f"`__m_{c}`").select("row_id", F.lit(float(value)).alias("prediction"))
            else:
                p = forest.GrowParams(**({"task": "class" if is_class else "regress", "n_trees": n_trees, "seed": f"{seed}:{step}:{c}",
                                          "categorical": tuple(i for i, f in enumerate(others) if f in cats)} | dict(params or {})))
                nodes, labels = _fit_one(train, others, c, is_class, p)
                guess = _predict_one(forest.feature_rows(state.filter(f"`__m_{c}`"), others, None), nodes, labels, is_class)
            new = state.join(guess, "row_id", "left")
            gap = new.agg(F.avg(F.abs(F.col("prediction") - F.col(c)))).first()[0]
            moved += gap or 0.0
            new = new.withColumn(c, F.when(F.col(f"__m_{c}"), F.coalesce("prediction", c)).otherwise(F.col(c))).drop("prediction")
            state = materialised(new, "imputed")
        info["iterations"], info["changes"] = step + 1, [*info["changes"], moved]
        if step and moved < tolerance:
            break
    return state.select(*df.columns), info


def donor_fills(df: DataFrame, pairs: DataFrame, features: Sequence[str], categorical: Sequence[str] = (), top: int | None = None, how: str = "mean") -> DataFrame:
    """``row_id, feature, value`` for each missing cell with a donor: rows with proximity above 0 that have the feature.

    Weighted mean or weighted median (the value at which half the weight is reached), for
    categories the heaviest vote, the least value of equals; of the ``top`` nearest donors,
    the lower row first of equals, if asked for. All cells are filled from the same table.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features]))
    long = df.select("row_id", cells.alias("c")).select("row_id", "c.*")
    empty = long.filter("value is null").select(F.col("row_id").alias("i"), "feature")
    donors = empty.join(pairs.filter("i <> j and p > 0"), "i").join(long.filter("value is not null").withColumnRenamed("row_id", "j"), ["j", "feature"])
    if top is not None:
        near = Window.partitionBy("i", "feature").orderBy(F.desc("p"), "j")
        donors = donors.withColumn("__r", F.row_number().over(near)).filter(F.col("__r") <= top)
    return _filled(donors.groupBy("i", "feature", "value").agg(F.sum("p").alias("w")), categorical, how).withColumnRenamed("i", "row_id")


def leaf_fills(df: DataFrame, leaves: DataFrame, n_trees: int, features: Sequence[str], categorical: Sequence[str] = (), top: int | None = None, how: str = "mean") -> DataFrame:
    """What :func:`donor_fills` gives for all pairs of rows that share a leaf.

    Rows of a kind (with the same leaves) miss a cell alike: their donors are the same, so each kind is
    filled once. Of each kind of donors the ``top`` lowest rows are enough, or the numbers of their values.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features]))
    rows, one = alike(leaves)
    long = materialised(df.select("row_id", cells.alias("c")).select("row_id", "c.*").join(rows.select("row_id", "kind"), "row_id"), "cells")
    empty, full = long.filter("value is null").select("row_id", "kind", "feature"), long.filter("value is not null")
    asked = empty.select(F.col("kind").alias("i"), "feature").distinct()
    pairs = shared(one.join(empty.select(F.col("kind").alias("row_id")), "row_id", "left_semi"), one, n_trees).join(asked, "i")
    if top is None:
        held = full.groupBy(F.col("kind").alias("j"), "feature", "value").agg(F.count(F.lit(1)).alias("m"))
        by_value = pairs.join(held, ["j", "feature"]).groupBy("i", "feature", "value").agg(F.sum(F.col("p") * F.col("m")).alias("w"))
    else:
        first = Window.partitionBy("kind", "feature").orderBy("row_id")
        lowest = full.withColumn("__r", F.row_number().over(first)).filter(F.col("__r") <= top).select(F.col("kind").alias("j"), "feature", "row_id", "value")
        near = Window.partitionBy("i", "feature").orderBy(F.desc("p"), "row_id")
        donors = pairs.join(lowest, ["j", "feature"]).withColumn("__r", F.row_number().over(near)).filter(F.col("__r") <= top)
        by_value = donors.groupBy("i", "feature", "value").agg(F.sum("p").alias("w"))
    fills = _filled(by_value, categorical, how).withColumnRenamed("i", "kind")
    return empty.join(fills, ["kind", "feature"]).select("row_id", "feature", "value")


def _filled(by_value: DataFrame, categorical: Sequence[str], how: str) -> DataFrame:
    """``i, feature, value`` from the weight ``w`` of each value of (i, feature)."""
    cat = F.col("feature").isin(list(categorical)) if categorical else F.lit(False)
    votes = by_value.filter(cat).groupBy("i", "feature").agg(F.max(F.struct(F.round("w", 9).alias("w"), (-F.col("value")).alias("v"))).alias("m")).select("i", "feature", (-F.col("m.v")).alias("value"))
    numbers = by_value.filter(~cat)
    if how == "mean":
        out = numbers.groupBy("i", "feature").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))
    elif how == "median":
        w = Window.partitionBy("i", "feature")
        run = numbers.withColumn("__c", F.sum("w").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))).withColumn("__a", F.sum("w").over(w))
        out = run.filter(F.col("__c") >= F.col("__a") / 2 - 1e-12).groupBy("i", "feature").agg(F.min("value").alias("value"))
    else:
        raise ValueError(f"unknown aggregation {how!r}")
    return out.unionByName(votes)


def apply_fills(df: DataFrame, fills: DataFrame, features: Sequence[str], otherwise: DataFrame) -> DataFrame:
    """Observed cells, then the fills, then the cells of the other table."""
    wide = fills.groupBy("row_id").pivot("feature", list(features)).agg(F.first("value"))
    wide = wide.select("row_id", *[F.col(c).alias(f"__f_{c}") for c in features])
    base = otherwise.select("row_id", *[F.col(c).alias(f"__b_{c}") for c in features])
    out = df.join(wide, "row_id", "left").join(base, "row_id", "left")
    return out.select(*[F.coalesce(F.col(c).cast("double"), f"__f_{c}", f"__b_{c}").alias(c) if c in features else F.col(c) for c in df.columns])


def proximity_impute(
    df: DataFrame, features: Sequence[str], categorical: Sequence[str] | None = None, method: str = "rough", iterations: int = 1,
    n_trees: int = 100, top: int | None = None, how: str = "mean", seed: int | str = 42, params: Mapping | None = None,
) -> DataFrame:
    """Missing cells from rows that share leaves of an unsupervised forest over the filled table.

    All cells of a round come from the round before (no cell sees another one's new value).
    """
    cats = observed_kinds(df, features, categorical)
    filled = materialised(_start(df, features, cats, method, seed), "imputed")
    for step in range(iterations):
        both = with_row_id(synthetic_union(filled, features, 1.0, f"{seed}:{step}"), ["row_id"], "__n").drop("__n")
        rows = materialised(forest.feature_rows(both, features, "is_real"), "impute-rows")
        p = forest.GrowParams(**({"n_trees": n_trees, "seed": f"{seed}:{step}", "categorical": tuple(i for i, f in enumerate(features) if f in cats)} | dict(params or {})))
        nodes = forest.grow(rows, materialised(forest.make_bag(rows, p), "impute-bag"), p, len(features), 2)
        ends = materialised(forest.route(forest.feature_rows(filled, features, None), nodes), "impute-leaves")
        filled = materialised(apply_fills(df, leaf_fills(df, ends, n_trees, features, cats, top, how), features, filled), "imputed")
    return filled


def topk_mean(df: DataFrame, features: Sequence[str], k: int = 10, **how) -> DataFrame:
    return proximity_impute(df, features, top=k, how="mean", **how)


def topk_median(df: DataFrame, features: Sequence[str], k: int = 10, **how) -> DataFrame:
    return proximity_impute(df, features, top=k, how="median", **how)
