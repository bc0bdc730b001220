"""Classification metrics as aggregates over (target, predicted_class) and class probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = (-1, 0, 1)
PROBABILITIES = ("ensemble_down", "ensemble_neutral", "ensemble_up")


def accuracy() -> Column:
    return F.avg((F.col("target") == F.col("predicted_class")).cast("double"))


def macro_f1(classes: Sequence[int] = CLASSES) -> Column:
    """Mean F1 of the classes; 0 for a class that is neither there nor predicted."""
    scores = []
    for c in classes:
        hit = F.count_if((F.col("target") == c) & (F.col("predicted_class") == c))
        scores.append(F.coalesce(F.try_divide(2.0 * hit, F.count_if(F.col("target") == c) + F.count_if(F.col("predicted_class") == c)), F.lit(0.0)))
    return sum(scores[1:], scores[0]) / len(classes)


def log_loss(probabilities: Sequence[str] = PROBABILITIES, classes: Sequence[int] = CLASSES, floor: float = 1e-15) -> Column:
    own = F.lit(None).cast("double")
    for p, c in zip(probabilities, classes):
        own = F.when(F.col("target") == c, F.col(p)).otherwise(own)
    return F.avg(-F.ln(F.greatest(own, F.lit(floor))))


def confusion_matrix(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by, "target", "predicted_class").agg(F.count(F.lit(1)).alias("bars"))


def class_weights(rows: DataFrame) -> DataFrame:
    """(target, bars, weight): rows / (classes * rows of the class)."""
    counts = rows.groupBy("target").agg(F.count(F.lit(1)).alias("bars"))
    total = counts.agg(F.sum("bars").alias("_rows"), F.count(F.lit(1)).alias("_classes"))
    return counts.crossJoin(total).select("target", "bars", (F.col("_rows") / (F.col("_classes") * F.col("bars"))).alias("weight"))  # total is one row


def classification_report(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("bars"), accuracy().alias("accuracy"), macro_f1().alias("macro_f1"), log_loss().alias("log_loss"))
