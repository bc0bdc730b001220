"""Profiles of feature tables: nulls, constants, equal columns, and the feature suite as one report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Name prefixes of features, and names that may not be features.
PREFIXES = ("m15_", "h1_", "d1_", "mtf_")
FORBIDDEN = ("timestamp", "target", "target_label", "future_close", "future_return", "h1_partial_period", "d1_partial_period", "h1_completed_timestamp", "d1_completed_timestamp", "d1_completed_date", "h1_partial_last_m15_timestamp", "d1_partial_last_m15_timestamp")
SUSPICIOUS = ("future", "target", "label", "next", "lead", "forward")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def feature_columns(df: DataFrame, prefixes: Sequence[str] = PREFIXES, forbidden: Sequence[str] = FORBIDDEN) -> list[str]:
    """Columns with a feature prefix that are not forbidden."""
    return [c for c in df.columns if c.startswith(tuple(prefixes)) and c not in forbidden]


def suspicious_names(df: DataFrame) -> list[str]:
    """Columns whose names hint at the future, features or not."""
    return [c for c in df.columns if any(t in c.lower() for t in SUSPICIOUS)]


def assert_numeric(df: DataFrame, columns: Sequence[str]) -> None:
    if other := sorted(set(columns) - set(numeric_columns(df))):
        raise TypeError(f"not numeric: {other}")


def columns_except(df: DataFrame, excluded: Sequence[str]) -> list[str]:
    """All columns but those named."""
    return [c for c in df.columns if c not in excluded]


def not_finite(column: str) -> Column:
    """The value is NaN or infinite; a null is neither."""
    value = F.col(column).cast("double")
    return value.isNotNull() & (F.isnan(value) | (F.abs(value) == float("inf")))


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, nulls, percent, not_finite), from one aggregation."""
    counts = df.agg(F.count(F.lit(1)).alias("_all"), *[F.struct(F.count_if(F.col(c).isNull()).alias("nulls"), F.count_if(not_finite(c)).alias("not_finite")).alias(c) for c in columns])
    long = counts.unpivot("_all", list(columns), "feature", "n")
    return long.select("feature", "n.nulls", F.coalesce(F.try_divide(100.0 * F.col("n.nulls"), F.col("_all")), F.lit(0.0)).alias("percent"), "n.not_finite")


def null_ranking(df: DataFrame, columns: Sequence[str], top: int = 20) -> DataFrame:
    """The columns with most nulls, by name on ties."""
    return null_profile(df, columns).orderBy(F.desc("nulls"), "feature").limit(top)


def _constant(column: str) -> Column:
    return F.equal_null(F.min(F.col(column).cast("double")), F.max(F.col(column).cast("double")))


def constant_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, constant): no two values differ; nulls don't count."""
    flags = df.agg(*[_constant(c).cast("int").alias(c) for c in columns])
    return flags.unpivot([], list(columns), "feature", "constant")


def _fingerprint(column: str) -> Column:
    """128 bits over all rows with their timestamps: columns that are equal in every row have one fingerprint."""
    value = F.col(column).cast("double") + 0.0
    return F.struct(F.bit_xor(F.xxhash64("timestamp", value)).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), value, F.lit(2), "timestamp")).alias("b"))


def duplicate_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(left, right) of columns that are equal in every row (of unique timestamps), nulls included: one aggregate a
    column, and the pairs are of fingerprints."""
    long = df.agg(*[_fingerprint(c).alias(c) for c in columns]).unpivot([], list(columns), "feature", "f")
    place = F.create_map(*[x for n, c in enumerate(columns) for x in (F.lit(c), F.lit(n))])
    long = long.withColumn("n", place[F.col("feature")])
    left, right = (long.select(F.col("feature").alias(side), F.col("f").alias(f"f_{side}"), F.col("n").alias(f"n_{side}")) for side in ("left", "right"))
    return left.join(right, (F.col("f_left") == F.col("f_right")) & (F.col("n_left") < F.col("n_right"))).select("left", "right")


def assert_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Raise on NaN or infinite features; nulls may be."""
    if bad := {r.feature: r.not_finite for r in null_profile(df, columns).where("not_finite > 0").collect()}:
        raise ValueError(f"values are not finite: {bad}")
    return df


def assert_complete(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise if a feature has a missing value (rows of later splits may not be dropped)."""
    bad = {r.feature: r.nulls for r in null_profile(df, columns).where("nulls > 0").collect()}
    if bad:
        raise ValueError(f"missing values: {bad}")


def feature_suite(df: DataFrame, required: Sequence[str], expected_rows: int | None = None) -> DataFrame:
    """One row of the suite's verdicts over a feature table, from one aggregation."""
    columns = feature_columns(df)
    nulls, infinite = (sum((F.count_if(test(c)) for c in columns), F.lit(0)).cast("long") for test in (lambda c: F.col(c).isNull(), not_finite))
    rows = F.count(F.lit(1))
    prints = F.array(*[_fingerprint(c) for c in columns])
    constant = F.filter(F.array(*[F.when(_constant(c), F.lit(c)) for c in sorted(columns)]), lambda c: c.isNotNull())
    out = df.agg(
        rows.alias("bars"), F.lit(len(columns)).cast("long").alias("features"), F.lit(len(set(df.columns)) == len(df.columns)).alias("unique_names"),
        F.lit(not set(columns) - set(numeric_columns(df))).alias("all_numeric"), F.lit(not set(required) - set(df.columns)).alias("required_present"),
        (F.count("timestamp") == F.count_distinct("timestamp")).alias("unique_timestamps"), (F.count_if(F.col("timestamp").isNull()) == 0).alias("no_null_timestamp"),
        nulls.alias("null_cells"), infinite.alias("not_finite"), constant.alias("_constant"), prints.alias("_prints"), (F.lit(True) if expected_rows is None else rows == expected_rows).alias("expected_rows"),
    )
    # a feature repeats one before it if its fingerprint does
    repeats = F.size("_prints") - F.size(F.array_distinct("_prints"))
    return out.withColumns({"constant_features": F.size("_constant").cast("long"), "constant_names": F.array_join("_constant", ","), "repeated_features": repeats.cast("long")}).drop("_constant", "_prints")
