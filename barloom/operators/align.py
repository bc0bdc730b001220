"""Causal alignment: as-of joins, completed context and partial state of higher timeframes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions import BLOCK, carried, in_blocks, period_start

BAR = ["open", "high", "low", "close", "tickvol", "vol", "spread"]


def _asof(left: DataFrame, right: DataFrame, left_on: Column, right_on: Column, by: Sequence[str], ties: bool, forward: bool) -> DataFrame:
    """Left rows with struct column ctx: the nearest right row before (or after) them. Both sides go through one
    exchange on symbol and block of time, and one sort; no pair of rows is ever made."""
    context = F.struct(*right.columns)
    rows = left.select(*by, left_on.alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(context.alias("c")).schema["c"].dataType).alias("_ctx"))
    others = right.select(*by, right_on.alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), context.alias("_ctx"))
    both = rows.unionByName(others)
    # on equal times the side that must not see the other comes first; forward is backward in falling order
    order = [F.col("_at").desc() if forward else F.col("_at").asc(), F.col("_side") if ties else -F.col("_side")]
    # a symbol is cut into blocks of time; each starts with the last context of the blocks before it
    nearest = F.min_by if forward else F.max_by
    blocks = in_blocks(both, by, "_at")
    blocks = carried(blocks, nearest("_ctx", F.when(F.col("_side") == 0, F.col("_at"))), lambda c: F.last(c, True), forward, by)
    seen = F.last("_ctx", True).over(Window.partitionBy(*by, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = blocks.withColumn("ctx", F.coalesce(seen, "_carry"))
    return both.where("_side = 1").select("_row.*", "ctx")


def asof_backward(left: DataFrame, right: DataFrame, left_on: str | Column = "timestamp", right_on: str | Column = "timestamp", by: Sequence[str] = (), ties: bool = False) -> DataFrame:
    """Each left row with the last right row (struct ctx, null if none) whose key is less, or with ties not greater."""
    left_on, right_on = (F.col(x) if isinstance(x, str) else x for x in (left_on, right_on))
    return _asof(left, right, left_on, right_on, by, ties, False)


def asof_forward(left: DataFrame, right: DataFrame, left_on: str | Column = "timestamp", right_on: str | Column = "timestamp", by: Sequence[str] = (), ties: bool = False) -> DataFrame:
    """Each left row with the first right row whose key is greater, or with ties not less."""
    left_on, right_on = (F.col(x) if isinstance(x, str) else x for x in (left_on, right_on))
    return _asof(left, right, left_on, right_on, by, ties, True)


def completed_context(m15: DataFrame, bars: DataFrame, prefix: str, by: Sequence[str] = (), availability: str = "label", bar_seconds: int = 3600, decision_seconds: int = 900) -> DataFrame:
    """m15 rows with the columns of the last higher bar before them, prefixed.

    availability "label" takes the bar whose label lies before the row's label, though it may still be forming (the
    customary rule, which leaks); "close" takes the last bar that has ended when the row's own bar ends.
    """
    if availability not in ("label", "close"):
        raise ValueError(f"availability is label or close, not {availability}")
    context = bars.select(*by, "timestamp", *BAR)
    if availability == "label":
        joined = asof_backward(m15, context, by=by)
    else:
        ends = F.col("timestamp") + F.expr(f"INTERVAL {bar_seconds} SECONDS")
        joined = asof_backward(m15, context, F.col("timestamp") + F.expr(f"INTERVAL {decision_seconds} SECONDS"), ends, by, ties=True)
    return joined.select(*m15.columns, *[F.col(f"ctx.{c}").alias(f"{prefix}{c}") for c in ["timestamp", *BAR]])


def completed_day(m15: DataFrame, days: DataFrame, prefix: str = "d1_completed_", by: Sequence[str] = ()) -> DataFrame:
    """m15 rows with the last daily bar of an earlier calendar date."""
    context = days.select(*by, F.to_date("timestamp").alias("date"), "timestamp", *BAR)
    joined = asof_backward(m15, context, F.to_date("timestamp"), F.col("date"), by)
    return joined.select(*m15.columns, *[F.col(f"ctx.{c}").alias(f"{prefix}{c}") for c in ["date", "timestamp", *BAR]])


def partial_state(bars: DataFrame, period: str, prefix: str, by: Sequence[str] = ()) -> DataFrame:
    """bars with the state of their hour or day from the bars before them in it; null on a period's first bar."""
    start = period_start(F.col("timestamp"), period)
    before = Window.partitionBy(*by, f"{prefix}period").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, -1)
    return bars.withColumn(f"{prefix}period", start).withColumns(
        {
            f"{prefix}open": F.first("open").over(before),
            f"{prefix}high": F.max("high").over(before),
            f"{prefix}low": F.min("low").over(before),
            f"{prefix}close": F.last("close").over(before),
            f"{prefix}tickvol": F.sum("tickvol").over(before),
            f"{prefix}last_m15_timestamp": F.last("timestamp").over(before),
        }
    )


def align_timeframes(m15: DataFrame, h1: DataFrame, d1: DataFrame, by: Sequence[str] = (), availability: str = "label", repeat_m15: bool = False) -> DataFrame:
    """The aligned row: M15 columns (suffix _x), completed and partial H1 and D1 context. With repeat_m15 the M15
    columns come once more with suffix _y."""
    rows = partial_state(partial_state(m15, "hour", "h1_partial_", by), "day", "d1_partial_", by)
    rows = completed_day(completed_context(rows, h1, "h1_completed_", by, availability), d1, by=by)
    again = {f"{c}_y": F.col(c) for c in BAR} if repeat_m15 else {}
    return rows.withColumns(again).withColumnsRenamed({c: f"{c}_x" for c in BAR})


Derive = Callable[[Mapping[str, Column]], Mapping[str, Column]]


def rolled_up(m15: DataFrame, by: Sequence[str] = (), derive: Derive | None = None) -> DataFrame:
    """align_timeframes of M15 bars whose hour and day bars are rolled up from them, in one pass: the bars go through one
    exchange on symbol and block of time, and all contexts and states are windows over it. Other columns pass through.

    A rolled-up bar has the first open, greatest high, least low, last close, sums of tickvol and vol, and the last
    spread; `derive` (from the bar's columns by name) replaces some of them. Completed context follows "label": of hours,
    the row's own if it began before the row, else the last one before; of days, the last of an earlier date.
    """
    rows = in_blocks(m15, by)
    for name in ("hour", "day"):
        rows = rows.withColumn(f"_{name}_start", period_start(F.col("timestamp"), name))
        of = Window.partitionBy(*by, BLOCK, f"_{name}_start").orderBy("timestamp")
        whole = of.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        bar = {
            "open": F.first("open").over(whole), "high": F.max("high").over(whole), "low": F.min("low").over(whole), "close": F.last("close").over(whole),
            "tickvol": F.sum("tickvol").over(whole), "vol": F.sum("vol").over(whole), "spread": F.last("spread").over(whole),
        }
        bar |= derive(bar) if derive else {}
        rows = rows.withColumn(f"_{name}", F.struct(F.col(f"_{name}_start").alias("timestamp"), *[bar[c].alias(c) for c in BAR]))
        p, before = ("h1" if name == "hour" else "d1"), of.rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumns(
            {
                f"{p}_partial_period": F.col(f"_{name}_start"), f"{p}_partial_open": F.first("open").over(before), f"{p}_partial_high": F.max("high").over(before), f"{p}_partial_low": F.min("low").over(before),
                f"{p}_partial_close": F.last("close").over(before), f"{p}_partial_tickvol": F.sum("tickvol").over(before), f"{p}_partial_last_m15_timestamp": F.last("timestamp").over(before),
            }
        )
    # the bar before: of the row before, which at a block's start is carried from the block before
    rows = carried(rows, F.max_by(F.struct("_hour", "_day"), "timestamp"), lambda c: F.last(c, True), by=by)
    row_before = Window.partitionBy(*by, BLOCK).orderBy("timestamp")
    back = {n: F.coalesce(F.lag(f"_{n}").over(row_before), F.col(f"_carry._{n}")) for n in ("hour", "day")}
    rows = rows.withColumns({"_hour_back": back["hour"], "_day_back": back["day"]})
    of_day = Window.partitionBy(*by, BLOCK, "_day_start").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_d1", F.first("_day_back").over(of_day)).withColumn("_h1", F.when(F.col("timestamp") > F.col("_hour_start"), F.col("_hour")).otherwise(F.col("_hour_back")))
    passed = [F.col(c).alias(f"{c}_x") if c in BAR else F.col(c) for c in m15.columns if c != BLOCK]
    state = [f"{p}_partial_{c}" for p in ("h1", "d1") for c in ("period", "open", "high", "low", "close", "tickvol", "last_m15_timestamp")]
    h1 = [F.col(f"_h1.{c}").alias(f"h1_completed_{c}") for c in ["timestamp", *BAR]]
    d1 = [F.to_date("_d1.timestamp").alias("d1_completed_date"), *[F.col(f"_d1.{c}").alias(f"d1_completed_{c}") for c in ["timestamp", *BAR]]]
    return rows.select(BLOCK, *passed, *state, *h1, *d1)


def causality_violations(aligned: DataFrame) -> DataFrame:
    """Counts of context that is not older than its row."""
    seen = ["h1_partial_last_m15_timestamp", "d1_partial_last_m15_timestamp", "h1_completed_timestamp", "d1_completed_timestamp"]
    late = [F.count_if(F.col(c) >= F.col("timestamp")).alias(f"late_{c}") for c in seen]
    return aligned.agg(F.count(F.lit(1)).alias("bars"), *late)


def assert_causal(aligned: DataFrame) -> DataFrame:
    found = causality_violations(aligned).first().asDict()
    if any(v for k, v in found.items() if k.startswith("late_")):
        raise ValueError(f"context from the future: {found}")
    return aligned


def label_endpoints(rows: DataFrame, timeline: DataFrame) -> DataFrame:
    """rows with label_end: the first timestamp of timeline after theirs, null past its end."""
    joined = asof_forward(rows, timeline.select("timestamp").distinct())
    return joined.select(*rows.columns, F.col("ctx.timestamp").alias("label_end"))
