"""Named checks of a table that ride on the job that writes it: no table is read again to be judged."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from barloom.functions import BLOCK, in_order, own_rows, with_halo
from barloom.operators.labels import CLASSES
from barloom.operators.profile import not_finite
from barloom.operators.quality import bad_ohlc
from barloom.sources import write_table

REPEATED, BACK = "_repeated", "_step"


@dataclass(frozen=True)
class Check:
    """An aggregate without DISTINCT, and which of its values pass."""

    name: str
    value: Column
    passes: Callable[[object], bool] = lambda v: v == 0


def row_checks() -> list[Check]:
    return [Check("bars", F.count(F.lit(1)), lambda v: v > 0), Check("null_timestamps", F.count_if(F.col("timestamp").isNull()))]


def series_checks() -> list[Check]:
    """For tables that checked() has put in order: repeated timestamps (each row after the first of a time)."""
    return [Check("duplicate_timestamps", F.count_if(F.col(REPEATED)))]


def bar_checks() -> list[Check]:
    """As data_manifest counts."""
    return [
        Check("invalid_ohlc", F.count_if(bad_ohlc())), Check("tickvol_not_positive", F.count_if(F.col("tickvol") <= 0)), Check("negative_vol", F.count_if(F.col("vol") < 0)),
        Check("negative_spread", F.count_if(F.col("spread") < 0)), Check("zero_spread", F.count_if(F.col("spread") == 0), lambda v: True),
    ]


def label_checks(close: str = "close", threshold: float = 0.00025, tolerance: float = 1e-12) -> list[Check]:
    """As target_validation counts, from the returns."""
    r = F.col("future_return")
    wanted = F.when(r > threshold, 1).when(r < -threshold, -1).otherwise(0)
    return [
        Check("max_error", F.max(F.abs(F.col("future_close") / F.col(close) - 1 - r)), lambda v: v is None or v <= tolerance), Check("unknown_classes", F.count_if(~F.col("target").isin(*CLASSES))),
        Check("wrong_classes", F.count_if(F.col("target") != wanted)), Check("null_returns", F.count_if(r.isNull())), Check("not_finite", F.count_if(not_finite("future_return") | not_finite("future_close"))),
    ]


def feature_checks(columns: Sequence[str]) -> list[Check]:
    """Nulls (which may be) and values that are not finite (which may not), of each column."""
    each = [(Check(f"nulls_{c}", F.count_if(F.col(c).isNull()), lambda v: True), Check(f"not_finite_{c}", F.count_if(not_finite(c)))) for c in columns]
    return [check for pair in each for check in pair]


def causal_checks() -> list[Check]:
    """As causality_violations counts."""
    seen = ["h1_partial_last_m15_timestamp", "d1_partial_last_m15_timestamp", "h1_completed_timestamp", "d1_completed_timestamp"]
    return [Check(f"late_{c}", F.count_if(F.col(c) >= F.col("timestamp"))) for c in seen]


def write_checked(df: DataFrame, path: str, checks: Sequence[Check], by: Sequence[str] = (), stop: bool = False, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write df and return (check, value, passed), observed by the same job. Rows are compared with the one before them in
    time (of their symbol) only if a check asks for it. With stop a failed check raises, naming what failed; the table is
    written by then, for a look at it."""
    names = [c.name for c in checks]
    if len(set(names)) != len(names):
        raise ValueError("checks need names of their own")
    rows = df
    if any(c.name == "duplicate_timestamps" for c in checks):
        rows = with_halo(df, 1, by=by).withColumn(REPEATED, F.equal_null("timestamp", F.lag("timestamp").over(in_order([*by, BLOCK]))) & F.col("timestamp").isNotNull())
        rows = own_rows(rows)
    seen = Observation()
    watched = rows.observe(seen, *[c.value.alias(c.name) for c in checks])
    write_table(watched.select(*[F.col(f"`{c}`") for c in df.columns]), path, partition_by)
    found = seen.get
    made = [(c.name, None if found[c.name] is None else float(found[c.name]), bool(c.passes(found[c.name]))) for c in checks]
    if stop and (failed := {n: v for n, v, good in made if not good}):
        raise ValueError(f"{path}: {failed}")
    return df.sparkSession.createDataFrame(made, "check string, value double, passed boolean")
