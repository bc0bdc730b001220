"""Learning target: forward return by a horizon, three classes by a threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import BLOCK, change, in_order, own_rows, with_halo
from barloom.operators.profile import not_finite

CLASSES = {-1: "DOWN", 0: "NEUTRAL", 1: "UP"}


def learning_target(rows: DataFrame, close: str = "close", horizon: int = 1, threshold: float = 0.00025, by: Sequence[str] = (), drop_last: bool = True) -> DataFrame:
    """rows with future_close, future_return, target (-1, 0, 1; strictly beyond the threshold) and target_label. The
    last `horizon` rows have no future: they go, or stay with class 0 and null returns."""
    spread = with_halo(rows, after=horizon, by=by)
    spread = spread.withColumn("future_close", F.lead(close, horizon).over(in_order([*by, BLOCK])))
    out = own_rows(spread).withColumn("future_return", change(F.col("future_close"), F.col(close)))
    r = F.col("future_return")
    out = out.withColumn("target", F.when(r > threshold, 1).when(r < -threshold, -1).otherwise(0))
    names = F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv])
    out = out.withColumn("target_label", names[F.col("target")])
    return out.dropna(subset=["future_close", "future_return"]) if drop_last else out


def terminal_rows(rows: DataFrame, labelled: DataFrame, horizon: int = 1) -> DataFrame:
    """Whether labelling took exactly the last `horizon` rows: row counts, and the ends of both tables."""
    before = rows.agg(F.count(F.lit(1)).alias("bars"), F.max("timestamp").alias("_end"))
    after = labelled.agg(F.count(F.lit(1)).alias("labelled_bars"), F.max("timestamp").alias("last_labelled"))
    out = before.crossJoin(after)  # one row each
    dropped = F.col("bars") - F.col("labelled_bars")
    return out.select("bars", "labelled_bars", "last_labelled", dropped.alias("dropped_bars"), ((dropped == horizon) & (F.col("last_labelled") < F.col("_end"))).alias("exact"))


def target_distribution(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows and percent of each class; absent classes count 0. With `by`, per group."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"), *[F.count_if(F.col("target") == c).alias(n) for c, n in CLASSES.items()])
    long = counts.unpivot([*by, "_all"], list(CLASSES.values()), "target_label", "bars")
    return long.select(*by, "target_label", "bars", F.coalesce(F.try_divide(100.0 * F.col("bars"), F.col("_all")), F.lit(0.0)).alias("percent"))


def target_validation(rows: DataFrame, close: str = "close", horizon: int = 1, threshold: float = 0.00025) -> DataFrame:
    """Checks of a labelled table, recomputing returns and classes: errors, unknown classes, wrong labels."""
    again = F.col("future_close") / F.col(close) - 1
    wanted = F.when(F.col("future_return") > threshold, 1).when(F.col("future_return") < -threshold, -1).otherwise(0)
    names = F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv])
    return rows.agg(
        F.count(F.lit(1)).alias("bars"), F.max(F.abs(again - F.col("future_return"))).alias("max_error"), F.count_if(~F.col("target").isin(*CLASSES)).alias("unknown_classes"),
        F.count_if(F.col("target") != wanted).alias("wrong_classes"), F.count_if(names[F.col("target")] != F.col("target_label")).alias("wrong_labels"),
        F.count_if(F.col("future_return").isNull()).alias("null_returns"), F.count_if(not_finite("future_return") | not_finite("future_close")).alias("not_finite"), (F.count("timestamp") - F.count_distinct("timestamp")).alias("duplicate_timestamps"),
        (F.size(F.array_except(F.collect_set("target"), F.array(*[F.lit(c) for c in CLASSES]))) == 0).alias("known_classes_only"),
    )
