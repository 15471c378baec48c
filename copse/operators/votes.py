"""Votes, predictions and out-of-bag estimates from leaves.

``leaves`` has (tree_id, row_id, leaf_id) and for training rows (nin, is_oob). Of equal
votes the lowest class wins, everywhere.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_leaf(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """Leaves with their class, prediction and weight; the table of leaves is joined on its key."""
    ends = nodes.filter("status = -1").select("tree_id", F.col("node_id").alias("leaf_id"), "node_class", "node_pred", "node_weight")
    return leaves.join(ends, ["tree_id", "leaf_id"])


def leaf_weights(leaves: DataFrame) -> DataFrame:
    """``tree_id, leaf_id, node_weight``: draws over distinct rows of the leaf's bag."""
    return leaves.filter("nin > 0").groupBy("tree_id", "leaf_id").agg((F.sum("nin") / F.count(F.lit(1))).alias("node_weight"))


def _class_weight(weights: Mapping[int, float] | None) -> Column:
    out = F.lit(1.0)
    for k, w in (weights or {}).items():
        out = F.when(F.col("node_class") == k, F.lit(float(w))).otherwise(out)
    return out


def class_votes(with_class: DataFrame, casewise: bool = False, class_weight: Mapping[int, float] | None = None) -> DataFrame:
    """``row_id, class, votes``: a vote is 1, or the leaf's weight if casewise, times the class's weight."""
    vote = (F.col("node_weight") if casewise else F.lit(1.0)) * _class_weight(class_weight)
    return with_class.groupBy("row_id", F.col("node_class").alias("class")).agg(F.sum(vote).alias("votes"))


def argmax_class(votes: DataFrame) -> DataFrame:
    """``row_id, prediction``: the class with most votes, the lowest of equals."""
    best = votes.groupBy("row_id").agg(F.max(F.struct("votes", (-F.col("class")).alias("k"))).alias("m"))
    return best.select("row_id", (-F.col("m.k")).cast("int").alias("prediction"))


def probabilities(votes: DataFrame, classes: Sequence[int]) -> DataFrame:
    """``row_id, class, p`` for every class, 0 where there is no vote."""
    sums = votes.groupBy("row_id").agg(F.sum("votes").alias("all"), *[F.sum(F.when(F.col("class") == k, F.col("votes")).otherwise(0.0)).alias(f"v{k}") for k in classes])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("class"), (F.col(f"v{k}") / F.col("all")).alias("p")) for k in classes]))
    return sums.select("row_id", pairs.alias("s")).select("row_id", "s.class", "s.p")


def mean_prediction(with_pred: DataFrame, casewise: bool = False) -> DataFrame:
    """``row_id, prediction``: the mean over trees, by leaf weight if casewise."""
    mean = F.sum(F.col("node_pred") * F.col("node_weight")) / F.sum("node_weight") if casewise else F.avg("node_pred")
    return with_pred.groupBy("row_id").agg(mean.alias("prediction"))


def oob_predictions(with_class: DataFrame, rows: DataFrame, **how) -> DataFrame:
    """``row_id, y, prediction``; null for rows that every tree has drawn."""
    votes = class_votes(with_class.filter("is_oob"), **how)
    return rows.select("row_id", "y").join(argmax_class(votes), "row_id", "left")


def oob_error(with_class: DataFrame, rows: DataFrame, **how) -> DataFrame:
    """``n, oob_error`` over rows that are out of bag somewhere."""
    seen = oob_predictions(with_class, rows, **how).filter("prediction is not null")
    return seen.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") != F.col("y")).cast("double")).alias("oob_error"))


def oob_mse(with_pred: DataFrame, rows: DataFrame, casewise: bool = False) -> DataFrame:
    """``n, oob_mse`` of the mean out-of-bag prediction."""
    mean = mean_prediction(with_pred.filter("is_oob"), casewise)
    return rows.select("row_id", "y").join(mean, "row_id").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("y") - F.col("prediction")) ** 2).alias("oob_mse"))


def oob_count(leaves: DataFrame) -> DataFrame:
    """``row_id, nout``."""
    return leaves.groupBy("row_id").agg(F.sum(F.col("is_oob").cast("long")).alias("nout"))


def error_rate(df: DataFrame, y: str = "y", prediction: str = "prediction") -> DataFrame:
    return df.agg(F.avg((F.col(y) != F.col(prediction)).cast("double")).alias("error_rate"))


def normalised_votes(votes: DataFrame, counts: DataFrame) -> DataFrame:
    """Votes over the number of a row's out-of-bag trees."""
    return votes.join(counts, "row_id").select("row_id", "class", F.when(F.col("nout") > 0, F.col("votes") / F.col("nout")).alias("share"))


def most_similar_label(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``row_id, prediction``: the label of the training row (j) with the highest similarity, the lowest j of equals."""
    best = pairs.withColumn("__r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("p"), "j"))).filter("__r = 1")
    return best.join(labels.select(F.col("row_id").alias("j"), "label"), "j").select(F.col("i").alias("row_id"), F.col("label").alias("prediction"))
