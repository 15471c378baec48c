"""Scoring a stream against a fitted forest. It is stateless: each row is scored on its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from copse.plans.estimators import Fitted, FittedUnsupervised


def scorer(model: Fitted, stats: DataFrame | None = None) -> Callable[[DataFrame], DataFrame]:
    """A function that adds a forest's answers to a micro-batch (with row_id and the features).

    With ``stats`` (what outlier_scores gave) rows get outlier scores, else what the model
    predicts; an unsupervised model gives the chance of being synthetic.
    """
    def score(batch: DataFrame) -> DataFrame:
        if stats is not None:
            return model.predicted_outlier_scores(batch, stats)
        return model.predict_proba(batch) if isinstance(model, FittedUnsupervised) else model.predict(batch)

    return score


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append each micro-batch's scores to Parquet files below ``path``, under the number of the batch.

    A batch that is run again after a failure replaces its own files, so scores appear once.
    """
    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
