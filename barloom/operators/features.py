"""Features of an aligned row. Windows run over rows in time order, in blocks of a symbol's series (or of the one series)
with the rows before them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import BLOCK, both_max, both_min, carried, change, holds, in_blocks, in_order, own_rows, rolling, safe_divide, with_halo
from barloom.operators.align import BAR, Derive, rolled_up

#: Rows before its own that a feature may see: 16 returns of one row each.
LOOK_BACK = 16


def m15_features(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return own_rows(_m15_own(with_halo(rows, LOOK_BACK, by=by), by))


def _m15_own(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    w = in_order([*by, BLOCK])
    close, open_, high, low = (F.col(f"{c}_x").cast("double") for c in ("close", "open", "high", "low"))
    lagged = {n: F.lag(close, n).over(w) for n in (1, 4, 16)}
    one = F.try_divide(close, lagged[1])
    out = rows.withColumns({f"m15_return_{n}": change(close, lagged[n]) for n in lagged})
    out = out.withColumns(
        {
            "m15_log_return_1": F.ln(one), "m15_range": high - low, "m15_body": close - open_, "m15_body_abs": F.abs(close - open_),
            "m15_upper_wick": high - both_max(open_, close), "m15_lower_wick": both_min(open_, close) - low,
            "m15_momentum_4": close - lagged[4], "m15_momentum_16": close - lagged[16],
        }
    )
    span = F.col("m15_range")
    return out.withColumns(
        {
            "m15_body_range_ratio": safe_divide(F.col("m15_body_abs"), span),
            "m15_upper_wick_ratio": safe_divide(F.col("m15_upper_wick"), span),
            "m15_lower_wick_ratio": safe_divide(F.col("m15_lower_wick"), span),
            "m15_range_mean_4": rolling(F.avg, span, w, 4),
            "m15_range_mean_16": rolling(F.avg, span, w, 16),
            "m15_return_std_16": rolling(F.stddev_samp, F.col("m15_return_1"), w, 16),
        }
    )


def _partial_shape(p: str) -> dict:
    open_, high, low, close = (F.col(f"{p}_partial_{c}").cast("double") for c in ("open", "high", "low", "close"))
    body, span = close - open_, high - low
    return {
        f"{p}_partial_range": span, f"{p}_partial_body": body, f"{p}_partial_body_abs": F.abs(body), f"{p}_partial_body_range_ratio": safe_divide(F.abs(body), span),
        f"{p}_partial_upper_wick": high - both_max(open_, close), f"{p}_partial_lower_wick": both_min(open_, close) - low,
    }


def _completed(p: str) -> dict:
    open_, close = (F.col(f"{p}_completed_{c}").cast("double") for c in ("open", "close"))
    return {f"{p}_completed_return": change(close, open_), f"m15_to_{p}_close_distance": safe_divide(F.col("close_x") - close, close)}


def _h1_own(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows (BLOCK): h1_return_1 lags by one row, of the block before at a block's start."""
    close = F.col("h1_completed_close").cast("double")
    rows = carried(rows, F.max_by(close, "timestamp"), F.last, by=by)
    there = F.lag(F.lit(True)).over(in_order([*by, BLOCK]))
    before = F.when(there, F.lag(close).over(in_order([*by, BLOCK]))).otherwise(F.col("_carry"))
    return rows.withColumns(_partial_shape("h1") | _completed("h1") | {"h1_return_1": change(close, before)}).drop("_carry")


def h1_bar_returns(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """rows with h1_bar_return_1: the completed hour's close against that of the completed hour before it in rows."""
    hour = rows.where(F.col("h1_completed_timestamp").isNotNull()).groupBy(*by, F.col("h1_completed_timestamp").alias("_hour")).agg(F.max(F.col("h1_completed_close").cast("double")).alias("_close"))
    spread = with_halo(hour, 1, ts="_hour", by=by)
    hours = own_rows(spread.withColumn("h1_bar_return_1", change(F.col("_close"), F.lag("_close").over(in_order([*by, BLOCK], "_hour")))).drop("_close"))
    hours = hours.withColumnsRenamed({c: f"_{c}" for c in by})
    same = F.col("h1_completed_timestamp") == F.col("_hour")
    for c in by:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return rows.join(hours, same, "left").drop("_hour", *[f"_{c}" for c in by])


def h1_features(rows: DataFrame, by: Sequence[str] = (), bar_returns: bool = True) -> DataFrame:
    """h1_return_1 follows the customary rule, a lag of one M15 row; h1_bar_return_1 (which takes a join) lags by
    completed hour."""
    own = _h1_own(in_blocks(rows, by), by).drop(BLOCK)
    return h1_bar_returns(own, by) if bar_returns else own


def d1_features(rows: DataFrame) -> DataFrame:
    return rows.withColumns(_partial_shape("d1") | _completed("d1"))


def cross_timeframe(rows: DataFrame) -> DataFrame:
    m15, h1, d1 = (F.signum(c) for c in ("m15_return_1", "h1_completed_return", "d1_completed_return"))
    close = F.col("close_x")
    return rows.withColumns(
        {
            "mtf_m15_h1_alignment": m15 * h1, "mtf_m15_d1_alignment": m15 * d1, "mtf_h1_d1_alignment": h1 * d1,
            "mtf_all_direction_agreement": holds((m15 == h1) & (h1 == d1) & (m15 != 0)).cast("int"),
            "m15_position_in_h1_range": safe_divide(close - F.col("h1_partial_low"), F.col("h1_partial_range")),
            "m15_position_in_d1_range": safe_divide(close - F.col("d1_partial_low"), F.col("d1_partial_range")),
        }
    )


def all_features(aligned: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    rows = _h1_own(own_rows(_m15_own(with_halo(aligned, LOOK_BACK, by=by), by), keep_block=True), by).drop(BLOCK)
    return cross_timeframe(d1_features(h1_bar_returns(rows, by)))


def rolled_up_features(m15: DataFrame, by: Sequence[str] = (), derive: Derive | None = None) -> DataFrame:
    """all_features but h1_bar_return_1 from M15 bars alone: the bars' own features first, then the contexts, all in the
    blocks of one exchange."""
    names = {c: f"{c}_x" for c in BAR}
    own = own_rows(_m15_own(with_halo(m15.withColumnsRenamed(names), LOOK_BACK, by=by), by), keep_block=True)
    aligned = rolled_up(own.withColumnsRenamed({v: k for k, v in names.items()}), by, derive)
    return cross_timeframe(d1_features(_h1_own(aligned, by))).drop(BLOCK)


def partial_availability(rows: DataFrame, prefix: str) -> DataFrame:
    """1.0 where the whole partial state is there, else 0.0."""
    there = [F.col(f"{prefix}{c}").isNotNull() for c in ("open", "high", "low", "close", "tickvol")]
    whole = there[0]
    for x in there[1:]:
        whole = whole & x
    return rows.withColumn(f"{prefix}available", whole.cast("double"))
