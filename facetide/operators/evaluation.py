"""The tabular side of model training: class index, weights, accuracy, report, best epoch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered


def class_index(rows: DataFrame, label: str = "label") -> DataFrame:
    """(idx, label): distinct labels in text order, numbered from 0."""
    distinct = rows.select(F.col(label).alias("label")).where(F.col("label").isNotNull()).distinct()
    return numbered(distinct, ["label"], "idx").select((F.col("idx") - 1).cast("int").alias("idx"), "label")


def with_class_index(rows: DataFrame, label: str = "label") -> DataFrame:
    """``rows`` with the class index of their label."""
    index = class_index(rows, label).withColumnRenamed("label", label)
    return rows.join(index, label, "left")


def class_weights(rows: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """(idx, label, count, weight) in class order; weight is 1 / count.

    A class of ``labels`` without rows is an error (division by zero).
    """
    counted = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    joined = labels.join(counted, "label", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    weight = F.lit(1.0) / F.col("count")
    return joined.select("idx", "label", "count", weight.alias("weight")).orderBy("idx")


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """Rows in random order, repeatable for a seed and an input layout."""
    return rows.orderBy(F.rand(seed))


def accuracy(predictions: DataFrame) -> DataFrame:
    """(epoch, accuracy) of (epoch, y_true, y_pred) rows."""
    right = (F.col("y_true") == F.col("y_pred")).cast("double")
    return predictions.groupBy("epoch").agg(F.avg(right).alias("accuracy"))


def epoch_loss(log: DataFrame) -> DataFrame:
    """Mean training loss per epoch."""
    return log.groupBy("epoch").agg(F.avg("loss").alias("train_loss"))


def best_epoch(accuracies: DataFrame, floor: float = 0.0) -> DataFrame:
    """One row: the epoch of highest accuracy above ``floor``, the earliest on a tie."""
    better = accuracies.where(F.col("accuracy") > F.lit(floor))
    return better.agg(
        F.max_by("epoch", F.struct("accuracy", -F.col("epoch"))).alias("best_epoch"),
        F.max("accuracy").alias("best_accuracy"),
    )


def improvements(accuracies: DataFrame, floor: float = 0.0) -> DataFrame:
    """Epochs that beat every epoch before them: the ones at which a model is saved.

    An epoch improves when its accuracy is above the largest of all earlier epochs and ``floor``. The one
    ordered window is over the epochs (one row each after ``accuracy``), not over predictions.
    """
    before = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    best_before = F.greatest(F.lit(floor), F.max("accuracy").over(before))
    return accuracies.withColumn("best_before", best_before).where(F.col("accuracy") > F.col("best_before"))


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def classification_report(predictions: DataFrame, epoch: int | None = None) -> DataFrame:
    """Rows (class, precision, recall, f1, support) per class, then accuracy, macro and weighted
    averages. A zero division counts as 0. ``epoch`` picks the predictions of one epoch."""
    if epoch is not None:
        predictions = predictions.where(F.col("epoch") == F.lit(epoch))
    cells = confusion(predictions)
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0))
    # Every cell counts once as support of its true class and once as a call of its predicted one.
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("called"), hit.cast("bigint").alias("hits")),
                F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("called"), F.lit(0).cast("bigint").alias("hits")),
            )
        ).alias("side")
    )
    per_class = sides.groupBy(F.col("side.label").alias("label")).agg(
        *[F.sum(f"side.{name}").alias(name) for name in ("support", "called", "hits")]
    )
    scored = per_class.select(
        "label",
        "support",
        "hits",
        _ratio(F.col("hits"), F.col("called")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
    ).withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    columns = ["class", "precision", "recall", "f1", "support"]
    classes = scored.withColumn("class", F.col("label").cast("string")).select(*columns)
    measures = ("precision", "recall", "f1")
    total = F.sum("support").alias("support")
    overall = scored.agg(
        total,
        _ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[_ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}") for m in measures],
    )
    summary = overall.select(
        F.explode(
            F.array(
                _summary_row("accuracy", *[F.lit(None).cast("double")] * 2, F.col("accuracy")),
                _summary_row("macro avg", *[F.col(f"macro_{m}") for m in measures]),
                _summary_row("weighted avg", *[F.col(f"weighted_{m}") for m in measures]),
            )
        ).alias("row")
    ).select("row.*")
    return classes.unionByName(summary.select(*columns))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def _summary_row(name: str, precision: Column, recall: Column, f1: Column) -> Column:
    return F.struct(
        F.lit(name).alias("class"),
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
        F.col("support").alias("support"),
    )
