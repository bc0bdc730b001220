"""Bars: from raw text, and from ticks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.sources import BAR, require_columns

PRICES = ["open", "high", "low", "close"]


def standardize(raw: DataFrame) -> DataFrame:
    """Typed bars from string columns date, time (if intraday), open, high, low, close, tickvol, vol, spread.

    Casts are strict: a value that is no number, or no date, fails the job.
    """
    require_columns(raw, ["date", *PRICES, "tickvol", "vol", "spread"])
    if "time" in raw.columns:
        ts = F.to_timestamp_ntz(F.concat_ws(" ", "date", "time"), F.lit("yyyy.MM.dd HH:mm:ss"))
    else:
        ts = F.to_timestamp_ntz(F.col("date"), F.lit("yyyy.MM.dd"))
    kept = [c for c in ("ordinal",) if c in raw.columns]
    return raw.select(ts.alias("timestamp"), *[F.col(f.name).cast(f.dataType).alias(f.name) for f in BAR[1:]], *kept)


def ohlc_bars(ticks: DataFrame, every: str, by: Sequence[str] = (), ts: str = "ts", value: str = "value") -> DataFrame:
    """Bars of `every` (such as "15 minutes") from ticks with unique times: first, greatest, least and last value, and
    the number of ticks. One partial and one final aggregation; a busy bar is combined before the shuffle."""
    price = F.col(value).cast("double")
    made = ticks.groupBy(*by, F.window(F.col(ts), every).alias("w")).agg(
        F.min_by(price, ts).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, ts).alias("close"), F.count(F.lit(1)).alias("tickvol")
    )
    return made.select(*by, F.col("w.start").cast("timestamp_ntz").alias("timestamp"), *PRICES, "tickvol")


def tick_bars(ticks: DataFrame, every: str, by: Sequence[str] = ()) -> DataFrame:
    """ohlc_bars with vol and spread, which ticks don't carry: no volume, and a spread made of the tick count."""
    return ohlc_bars(ticks, every, by).withColumns({"vol": F.lit(0).cast("long"), "spread": (F.col("tickvol") % 3).cast("int")})
