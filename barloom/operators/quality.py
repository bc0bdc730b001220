"""Quality of a bar table: each report is one pass of aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions import BLOCK, holds, in_order, own_rows, with_halo

PRICES = ["open", "high", "low", "close"]


def bad_ohlc() -> Column:
    """The bar's prices contradict each other or are not positive."""
    o, h, low, c = (F.col(n) for n in PRICES)
    return holds((h < low) | (h < o) | (h < c) | (low > o) | (low > c) | (o <= 0) | (h <= 0) | (low <= 0) | (c <= 0))


def ohlc_validity(bars: DataFrame) -> DataFrame:
    o, h, low, c = (F.col(n) for n in PRICES)
    return bars.agg(
        F.count(F.lit(1)).alias("bars"), F.count_if(h < low).alias("high_below_low"), F.count_if((h < o) | (h < c)).alias("high_below_body"),
        F.count_if((low > o) | (low > c)).alias("low_above_body"), F.count_if((o <= 0) | (h <= 0) | (low <= 0) | (c <= 0)).alias("not_positive"), F.count_if(bad_ohlc()).alias("invalid"),
    )


def volume_spread_quality(bars: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col(c) == 0).alias(f"zero_{c}") for c in ("tickvol", "vol", "spread")]
    counts += [F.count_if(F.col(c) < 0).alias(f"negative_{c}") for c in ("tickvol", "vol", "spread")]
    return bars.agg(F.count(F.lit(1)).alias("bars"), *counts)


def raw_profile(rows: DataFrame) -> DataFrame:
    """Rows, columns, rows that repeat another one whole, and null cells."""
    cells = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in rows.columns), F.lit(0))
    whole = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    repeated = whole.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))
    counts = rows.agg(F.count(F.lit(1)).alias("row_count"), F.lit(len(rows.columns)).cast("long").alias("column_count"), cells.cast("long").alias("null_cells"))
    return counts.crossJoin(repeated)  # one row each


def timestamp_quality(bars: DataFrame, order: str, ts: str = "timestamp") -> DataFrame:
    """Null and repeated times, and steps back in the ingest order given by column `order`."""
    spread = with_halo(bars.select(ts, order), 1, ts=order)
    steps = own_rows(spread.withColumn("back", F.col(ts) < F.lag(ts).over(in_order([BLOCK], order))))
    return steps.agg(
        F.count(F.lit(1)).alias("bars"), F.count_if(F.col(ts).isNull()).alias("null_timestamps"),
        (F.count(ts) - F.count_distinct(ts)).alias("duplicate_timestamps"), F.count_if("back").alias("steps_back"),
        (F.count_if("back") == 0).alias("monotonic"),
    )


def head_tail(bars: DataFrame, rows: int = 5, ts: str = "timestamp") -> DataFrame:
    """The first and last rows in time, with side and place; a row of a short table stands on both sides."""
    parts = []
    for side, order in (("head", F.col(ts).asc()), ("tail", F.col(ts).desc())):
        few = bars.orderBy(order).limit(rows)
        parts.append(few.withColumns({"side": F.lit(side), "place": F.row_number().over(Window.orderBy(order))}))  # `rows` rows
    return parts[0].unionByName(parts[1])


def intervals(bars: DataFrame, by: Sequence[str] = (), ts: str = "timestamp") -> DataFrame:
    """Each bar with the seconds since the bar before it (of its symbol)."""
    spread = with_halo(bars, 1, ts=ts, by=by).withColumn("previous", F.lag(ts).over(in_order([*by, BLOCK], ts)))
    return own_rows(spread).withColumn("seconds", F.expr(f"timestampdiff(SECOND, previous, {ts})"))


def interval_histogram(bars: DataFrame, top: int = 15) -> DataFrame:
    counted = intervals(bars).where("seconds is not null").groupBy("seconds").agg(F.count(F.lit(1)).alias("bars"))
    return counted.orderBy(F.desc("bars"), "seconds").limit(top)


def interval_mode(bars: DataFrame) -> DataFrame:
    """The most frequent step; the smallest on ties."""
    return intervals(bars).agg(F.mode("seconds", True).alias("mode_seconds"))


def gap_analysis(bars: DataFrame, expected_seconds: int, top: int = 20) -> DataFrame:
    """The longest gaps, with the bars that are missing in them."""
    found = intervals(bars).where(F.col("seconds") > expected_seconds)
    missing = (F.expr(f"seconds div {expected_seconds}") - 1).cast("long")
    rows = found.select("previous", "timestamp", "seconds", missing.alias("missing_bars"))
    return rows.orderBy(F.desc("seconds"), "timestamp").limit(top)


def gap_totals(bars: DataFrame, expected_seconds: int) -> DataFrame:
    wide = F.col("seconds") > expected_seconds
    missing = F.when(wide, F.expr(f"seconds div {expected_seconds}") - 1)
    return intervals(bars).agg(F.count_if(wide).alias("gaps"), F.coalesce(F.sum(missing), F.lit(0)).cast("long").alias("missing_bars"), F.max("seconds").alias("longest_seconds"))


def data_manifest(bars: DataFrame, name: str) -> DataFrame:
    return bars.agg(
        F.lit(name).alias("timeframe"), F.count(F.lit(1)).alias("bars"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
        (F.count("timestamp") - F.count_distinct("timestamp")).alias("duplicate_timestamps"), F.count_if(bad_ohlc()).alias("invalid_ohlc"),
        F.count_if(F.col("tickvol") <= 0).alias("tickvol_not_positive"), F.count_if(F.col("vol") < 0).alias("negative_vol"), F.count_if(F.col("spread") < 0).alias("negative_spread"), F.count_if(F.col("spread") == 0).alias("zero_spread"),
    )
