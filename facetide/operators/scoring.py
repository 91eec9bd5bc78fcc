"""Plug-in point for a scoring model: feature vectors in, class probabilities out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import probs as P

LABELS_SENT = 100_000

Scorer = Callable[[np.ndarray], np.ndarray]  # (rows, features) -> (rows, classes) logits


def score_faces(
    faces: DataFrame, scorer_factory: Callable[[], Scorer], features: str = "features"
) -> DataFrame:
    """``logits`` and ``probs`` per face.

    ``scorer_factory`` is called once per task, its scorer once per Arrow batch. When a batch
    fails its rows are scored one by one; a face that fails alone gets null logits and
    ``score_failed`` and the others go on.
    """

    @F.pandas_udf("array<double>")
    def logits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = scorer_factory()
        for batch in batches:
            yield _score_batch(scorer, batch)

    # not to be repeated: else Spark would score a face once more for each filter on the outcome
    scored = faces.withColumn("logits", logits.asNondeterministic()(F.col(features)))
    return scored.withColumns({"probs": P.softmax(F.col("logits")), "score_failed": F.col("logits").isNull()})


def _score_batch(scorer: Scorer, batch: pd.Series) -> pd.Series:
    try:
        return pd.Series(list(np.asarray(scorer(np.stack(batch.to_list())), dtype="float64")))
    except Exception:  # a bad face must not stop the others
        return pd.Series([_score_one(scorer, face) for face in batch], dtype=object)


def _score_one(scorer: Scorer, face) -> np.ndarray | None:
    try:
        return np.asarray(scorer(np.stack([face])), dtype="float64")[0]
    except Exception:
        return None


def usable(scored: DataFrame) -> DataFrame:
    """Faces that could be scored."""
    return scored.where(~F.col("score_failed"))


def failures(scored: DataFrame) -> DataFrame:
    """One row: how many faces could not be scored."""
    return scored.agg(F.count_if("score_failed").alias("failed"), F.count(F.lit(1)).alias("faces"))


def with_labels(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """``idx``, ``label`` and ``score`` of the likeliest class; a class without a name is
    called class_<idx>. The label table has one row per class and is counted: up to ``LABELS_SENT``
    rows it is sent to the faces, which then need no shuffle by their few class numbers."""
    labels = F.broadcast(labels) if labels.count() <= LABELS_SENT else labels
    best = scored.withColumns({"idx": P.argmax(F.col("probs")), "score": F.array_max("probs")})
    named = best.join(labels, "idx", "left")
    return named.withColumn("label", F.coalesce("label", F.concat(F.lit("class_"), F.col("idx").cast("string"))))
