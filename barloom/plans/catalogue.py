"""The queries by name: (what to run, SQL with the same rows). Doubles are rounded on both sides."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import settled, shared_folder
from barloom.operators import align, bars, checks, ensemble, features, labels, learners, metrics, nulls, optimize, profile, quality, splits, trading, tree_text
from barloom.plans import fixtures as fx
from barloom.sources import read_artifact, read_raw_bars, table, write_report

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to DIGITS places, without negative zero."""
    return df.select(*[(F.round(F.col(f"`{n}`"), DIGITS) + 0.0).alias(n) if kind in ("double", "float") else F.col(f"`{n}`") for n, kind in df.dtypes])


def add(name: str, make: Query, sql: str | None = None, doubles: str = "") -> None:
    """Register a query; `doubles` names the SQL's columns to round."""
    QUERIES[name] = lambda spark, d: rounded(make(spark, d))
    if sql is not None:
        change = ", ".join(f"round(({c})::DOUBLE, {DIGITS}) + 0.0 AS {c}" for c in doubles.split())
        head, _, body = sql.rpartition("\n--\n")
        ORACLE[name] = f"WITH {head} SELECT * " + (f"REPLACE ({change}) " if change else "") + f"FROM ({body})" if head else f"SELECT * " + (f"REPLACE ({change}) " if change else "") + f"FROM ({body})"


def q(ctes: str, body: str) -> str:
    return f"{ctes}\n--\n{body}"


P = "open high low close"

# ---- ingest and quality ----
add("ohlc_bars", lambda s, d: bars.ohlc_bars(table(s, d, "events"), "15 minutes"), q(fx.M15, 'SELECT "timestamp", open, high, low, close, tickvol FROM m15'), P)
add("ohlc_bars_by_symbol", lambda s, d: bars.ohlc_bars(table(s, d, "events"), "15 minutes", fx.SYMBOL), q(fx.M15S, 'SELECT event_type, "timestamp", open, high, low, close, tickvol FROM m15'), P)


def _raw(s: SparkSession, d: str) -> DataFrame:
    m = fx.m15(s, d)
    text = [F.format_string("%.4f", F.col(c)).alias(c) for c in P.split()] + [F.col(c).cast("string").alias(c) for c in ("tickvol", "vol", "spread")]
    return bars.standardize(m.select(F.date_format("timestamp", "yyyy.MM.dd").alias("date"), F.date_format("timestamp", "HH:mm:ss").alias("time"), *text)).withColumns({c: F.round(F.col(c).cast("double"), 2) for c in P.split()})


add("standardize_bars", _raw, q(fx.M15, 'SELECT "timestamp", ' + ", ".join(f"round(round({c}, 4)::FLOAT::DOUBLE, 2) AS {c}" for c in P.split()) + ", tickvol, vol, spread FROM m15"), P)


def _raw_files(s: SparkSession, d: str) -> DataFrame:
    """The bars as tab-separated text files, written and read again as raw input is: names in angle brackets, all strings."""
    m = fx.m15(s, d)
    text = [F.format_string("%.4f", F.col(c)).alias(f"<{c.upper()}>") for c in P.split()] + [F.col(c).cast("string").alias(f"<{c.upper()}>") for c in ("tickvol", "vol", "spread")]
    path = f"{shared_folder(s)}/raw-{uuid.uuid4().hex}"
    m.select(F.date_format("timestamp", "yyyy.MM.dd").alias("<DATE>"), F.date_format("timestamp", "HH:mm:ss").alias("<TIME>"), *text).write.option("sep", "\t").option("header", True).csv(path)
    raw = read_raw_bars(s, path)
    return bars.standardize(raw).drop("ordinal").withColumns({c: F.round(F.col(c).cast("double"), 2) for c in P.split()})


add("raw_file_bars", _raw_files, q(fx.M15, 'SELECT "timestamp", ' + ", ".join(f"round(round({c}, 4)::FLOAT::DOUBLE, 2) AS {c}" for c in P.split()) + ", tickvol, vol, spread FROM m15"), P)
add("data_manifest", lambda s, d: quality.data_manifest(fx.m15(s, d), "m15"), q(fx.M15, """SELECT 'm15' AS timeframe, count(*) AS bars, min("timestamp") AS first, max("timestamp") AS last, count("timestamp") - count(DISTINCT "timestamp") AS duplicate_timestamps,
  count(*) FILTER (high < low OR high < open OR high < close OR low > open OR low > close OR open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS invalid_ohlc, count(*) FILTER (tickvol <= 0) AS tickvol_not_positive, count(*) FILTER (vol < 0) AS negative_vol, count(*) FILTER (spread < 0) AS negative_spread, count(*) FILTER (spread = 0) AS zero_spread FROM m15"""))
RAW = ["event_id", "ts", "user_id", "event_type", "value", "props"]
add("raw_profile", lambda s, d: quality.raw_profile(table(s, d, "events")), f"SELECT count(*) AS row_count, (SELECT count(*) FROM (DESCRIBE SELECT * FROM events))::BIGINT AS column_count, ({' + '.join(f'count(*) FILTER ({c} IS NULL)' for c in RAW)})::BIGINT AS null_cells, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM events)))::BIGINT AS duplicate_rows FROM events")
add("head_tail", lambda s, d: quality.head_tail(fx.m15(s, d).select("timestamp", *P.split(), "tickvol")), q(fx.M15 + """, n AS (SELECT "timestamp", open, high, low, close, tickvol, row_number() OVER (ORDER BY "timestamp")::INTEGER AS up, row_number() OVER (ORDER BY "timestamp" DESC)::INTEGER AS down FROM m15)""", "SELECT * EXCLUDE (up, down), 'head' AS side, up AS place FROM n WHERE up <= 5 UNION ALL SELECT * EXCLUDE (up, down), 'tail' AS side, down AS place FROM n WHERE down <= 5"), P)
add("timestamp_quality", lambda s, d: quality.timestamp_quality(table(s, d, "events").select(F.col("ts").alias("timestamp"), "event_id"), "event_id"), q("""o AS (SELECT ts, ts < lag(ts) OVER (ORDER BY event_id) AS back FROM events)""", """SELECT count(*) AS bars, count(*) FILTER (ts IS NULL) AS null_timestamps, count(ts) - count(DISTINCT ts) AS duplicate_timestamps, count(*) FILTER (back) AS steps_back, count(*) FILTER (back) = 0 AS monotonic FROM o"""))
STEPS = fx.M15 + """, steps AS (SELECT *, lag("timestamp") OVER (ORDER BY "timestamp") AS previous, date_diff('second', lag("timestamp") OVER (ORDER BY "timestamp"), "timestamp") AS seconds FROM m15)"""
add("interval_histogram", lambda s, d: quality.interval_histogram(fx.m15(s, d)), q(STEPS, "SELECT seconds, count(*) AS bars FROM steps WHERE seconds IS NOT NULL GROUP BY 1 ORDER BY bars DESC, seconds LIMIT 15"))
add("interval_mode", lambda s, d: quality.interval_mode(fx.m15(s, d)), q(STEPS, "SELECT seconds AS mode_seconds FROM steps WHERE seconds IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, seconds LIMIT 1"))
add("gap_analysis", lambda s, d: quality.gap_analysis(fx.m15(s, d), 900), q(STEPS, 'SELECT previous, "timestamp", seconds, (seconds // 900 - 1)::BIGINT AS missing_bars FROM steps WHERE seconds > 900 ORDER BY seconds DESC, "timestamp" LIMIT 20'))
add("gap_totals", lambda s, d: quality.gap_totals(fx.m15(s, d), 900), q(STEPS, "SELECT count(*) FILTER (seconds > 900) AS gaps, coalesce(sum(seconds // 900 - 1) FILTER (seconds > 900), 0)::BIGINT AS missing_bars, max(seconds) AS longest_seconds FROM steps"))
add("ohlc_validity", lambda s, d: quality.ohlc_validity(fx.m15(s, d)), q(fx.M15, """SELECT count(*) AS bars, count(*) FILTER (high < low) AS high_below_low, count(*) FILTER (high < open OR high < close) AS high_below_body, count(*) FILTER (low > open OR low > close) AS low_above_body,
  count(*) FILTER (open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS not_positive, count(*) FILTER (high < low OR high < open OR high < close OR low > open OR low > close OR open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS invalid FROM m15"""))
add("volume_spread_quality", lambda s, d: quality.volume_spread_quality(fx.m15(s, d)), q(fx.M15, "SELECT count(*) AS bars, " + ", ".join(f"count(*) FILTER ({c} {o} 0) AS {n}_{c}" for n, o in (("zero", "="), ("negative", "<")) for c in ("tickvol", "vol", "spread")) + " FROM m15"))



def _observed(s: SparkSession, d: str) -> DataFrame:
    """The checks of the bars and of their contexts, seen while the aligned table is written."""
    rows = fx.aligned(s, d).withColumnsRenamed({f"{c}_x": c for c in align.BAR})
    path = f"{shared_folder(s)}/aligned-{uuid.uuid4().hex}.parquet"
    return checks.write_checked(rows, path, [*checks.row_checks(), *checks.series_checks(), *checks.bar_checks(), *checks.causal_checks()])


# ---- alignment ----
HC = [f"h1_completed_{c}" for c in ["timestamp", *align.BAR]]
DC = [f"d1_completed_{c}" for c in ["date", "timestamp", *align.BAR]]
HP, DP = ([f"{p}_partial_{c}" for c in ("period", "open", "high", "low", "close", "tickvol", "last_m15_timestamp")] for p in ("h1", "d1"))
X = [f"{c}_x" for c in align.BAR]
PRICED = lambda *prefixes: " ".join(f"{p}{c}" for p in prefixes for c in P.split())


def dated(df: DataFrame) -> DataFrame:
    """The context's date as text, which every client reads alike."""
    return df.withColumn("d1_completed_date", F.col("d1_completed_date").cast("string"))


def pick(df: DataFrame, *names: str) -> DataFrame:
    return df.select("timestamp", *names)


def sel(names, source: str, key: str = "") -> str:
    return f'SELECT {key}"timestamp", {", ".join(names)} FROM {source}'


A, AS = fx.aligned_sql(), fx.aligned_sql("event_type")
SLICE = ["h1_completed_return", "m15_to_h1_close_distance"]
add("asof_h1_completed", lambda s, d: features.h1_features(align.partial_state(align.completed_context(fx.m15(s, d), fx.h1(s, d), "h1_completed_"), "hour", "h1_partial_").withColumnRenamed("close", "close_x"), bar_returns=False).select("timestamp", *HC, *SLICE), q(fx.features_sql(), sel([*HC, *SLICE], "features")), PRICED("h1_completed_") + " " + " ".join(SLICE))
add("asof_h1_completed_by_symbol", lambda s, d: align.completed_context(fx.m15(s, d, fx.SYMBOL), fx.h1(s, d, fx.SYMBOL), "h1_completed_", fx.SYMBOL).select("event_type", "timestamp", *HC), q(AS, sel(HC, "aligned", "event_type, ")), PRICED("h1_completed_"))
add("asof_d1_completed", lambda s, d: pick(dated(align.completed_day(fx.m15(s, d), fx.d1(s, d))), *DC), q(A, sel(DC, "aligned")), PRICED("d1_completed_"))
add("asof_available_on_close", lambda s, d: pick(align.completed_context(fx.m15(s, d), fx.h1(s, d), "h1_completed_", availability="close"), *HC), q(f"{fx.M15}, {fx.H1}", 'SELECT m."timestamp", ' + ", ".join(f"h.{c[13:]} AS {c}" for c in HC) + """ FROM m15 m ASOF LEFT JOIN (SELECT *, "timestamp" + INTERVAL 1 HOUR AS ends FROM h1) h ON m."timestamp" + INTERVAL 15 MINUTE >= h.ends"""), PRICED("h1_completed_"))
add("partial_h1_state", lambda s, d: pick(align.partial_state(fx.m15(s, d), "hour", "h1_partial_"), *HP), q(A, sel(HP, "aligned")), PRICED("h1_partial_"))
add("partial_d1_state", lambda s, d: pick(align.partial_state(fx.m15(s, d), "day", "d1_partial_"), *DP), q(A, sel(DP, "aligned")), PRICED("d1_partial_"))
ALIGNED = [*X, *HC, *HP, *DC, *DP]
add("mtf_aligned", lambda s, d: pick(dated(fx.aligned(s, d)), *ALIGNED), q(A, sel(ALIGNED, "aligned")), PRICED("h1_completed_", "h1_partial_", "d1_completed_", "d1_partial_") + " open_x high_x low_x close_x")
add("mtf_aligned_by_symbol", lambda s, d: dated(fx.aligned(s, d, fx.SYMBOL)).select("event_type", "timestamp", *ALIGNED), q(AS, sel(ALIGNED, "aligned", "event_type, ")), PRICED("h1_completed_", "h1_partial_", "d1_completed_", "d1_partial_") + " open_x high_x low_x close_x")
LATE = ["h1_partial_last_m15_timestamp", "d1_partial_last_m15_timestamp", "h1_completed_timestamp", "d1_completed_timestamp"]
add("causality_validation", lambda s, d: align.causality_violations(fx.aligned(s, d)), q(A, "SELECT count(*) AS bars, " + ", ".join(f'count(*) FILTER ({c} >= "timestamp") AS late_{c}' for c in LATE) + " FROM aligned"))

SEEN = {"bars": ("count(*)", "n > 0"), "null_timestamps": ('count(*) FILTER ("timestamp" IS NULL)', "n = 0"), "duplicate_timestamps": ('count("timestamp") - count(DISTINCT "timestamp")', "n = 0"),
  "invalid_ohlc": ("count(*) FILTER (high_x < low_x OR high_x < open_x OR high_x < close_x OR low_x > open_x OR low_x > close_x OR open_x <= 0 OR high_x <= 0 OR low_x <= 0 OR close_x <= 0)", "n = 0"), "tickvol_not_positive": ("count(*) FILTER (tickvol_x <= 0)", "n = 0"), "negative_vol": ("count(*) FILTER (vol_x < 0)", "n = 0"), "negative_spread": ("count(*) FILTER (spread_x < 0)", "n = 0"), "zero_spread": ("count(*) FILTER (spread_x = 0)", "true"),
  **{f"late_{c}": (f'count(*) FILTER ({c} >= "timestamp")', "n = 0") for c in LATE}}
add("observed_checks", _observed, q(A, " UNION ALL ".join(f"""SELECT '{n}' AS "check", n::DOUBLE AS value, {good} AS passed FROM (SELECT {sql} AS n FROM aligned)""" for n, (sql, good) in SEEN.items())), "value")

# ---- features ----
FS, FSS = fx.features_sql(), fx.features_sql("event_type")
BAR_RETURN = "hours AS (SELECT h1_completed_timestamp, c / nullif(lag(c) OVER (ORDER BY h1_completed_timestamp), 0) - 1 AS h1_bar_return_1 FROM (SELECT h1_completed_timestamp, any_value(h1_completed_close) AS c FROM features WHERE h1_completed_timestamp IS NOT NULL GROUP BY 1))"
GROUPS = {
    "m15_returns": ["m15_return_1", "m15_return_4", "m15_return_16", "m15_log_return_1"],
    "m15_momentum": ["m15_momentum_4", "m15_momentum_16"],
    "m15_candle_structure": ["m15_range", "m15_body", "m15_body_abs", "m15_upper_wick", "m15_lower_wick", "m15_body_range_ratio", "m15_upper_wick_ratio", "m15_lower_wick_ratio"],
    "rolling_range": ["m15_range_mean_4", "m15_range_mean_16"],
    "rolling_volatility": ["m15_return_std_16"],
    "h1_features": ["h1_partial_range", "h1_partial_body", "h1_partial_body_abs", "h1_partial_body_range_ratio", "h1_partial_upper_wick", "h1_partial_lower_wick", "h1_return_1", "h1_completed_return", "m15_to_h1_close_distance"],
    "d1_features": ["d1_partial_range", "d1_partial_body", "d1_partial_body_abs", "d1_partial_body_range_ratio", "d1_partial_upper_wick", "d1_partial_lower_wick", "d1_completed_return", "m15_to_d1_close_distance"],
}
for _name, _columns in GROUPS.items():
    _made = fx.featured if _name in ("h1_features", "d1_features") else fx.m15_featured
    add(_name, lambda s, d, c=_columns, made=_made: pick(made(s, d), *c), q(FS, sel(_columns, "features")), " ".join(_columns))
    add(f"{_name}_by_symbol", lambda s, d, c=_columns, made=_made: made(s, d, fx.SYMBOL).select("event_type", "timestamp", *c), q(FSS, sel(_columns, "features", "event_type, ")), " ".join(_columns))
#: Positions inside a range of zero are huge and lose their last digits, so they are compared as logarithms of size.
CROSS = ["mtf_m15_h1_alignment", "mtf_m15_d1_alignment", "mtf_h1_d1_alignment", "mtf_all_direction_agreement"]
INSIDE = ["m15_position_in_h1_range", "m15_position_in_d1_range"]
add("cross_timeframe", lambda s, d: pick(fx.featured(s, d).withColumns({c: F.signum(c) * F.log1p(F.abs(c)) for c in INSIDE}), *CROSS, *INSIDE), q(FS, f'SELECT "timestamp", {", ".join(CROSS)}, {", ".join(f"sign({c}) * ln(1 + abs({c})) AS {c}" for c in INSIDE)} FROM features'), " ".join([*CROSS[:3], *INSIDE]))
ALL_FEATURES = [c for g in GROUPS.values() for c in g] + CROSS + INSIDE
add("partial_availability", lambda s, d: features.partial_availability(align.partial_state(fx.m15(s, d), "hour", "h1_partial_"), "h1_partial_").groupBy("h1_partial_available").agg(F.count(F.lit(1)).alias("bars")), q(A, "SELECT CASE WHEN h1_partial_open IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS h1_partial_available, count(*) AS bars FROM aligned GROUP BY 1"), "h1_partial_available")
add("feature_null_profile", lambda s, d: profile.null_profile(fx.featured(s, d), ALL_FEATURES), q(FS, " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER ({c} IS NULL) AS nulls, 100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*) AS percent, count(*) FILTER (NOT isfinite({c}::DOUBLE)) AS not_finite FROM features" for c in ALL_FEATURES)), "percent")
add("null_ranking", lambda s, d: profile.null_ranking(fx.featured(s, d), ALL_FEATURES), q(FS, "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER ({c} IS NULL) AS nulls, 100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*) AS percent, count(*) FILTER (NOT isfinite({c}::DOUBLE)) AS not_finite FROM features" for c in ALL_FEATURES) + ") ORDER BY nulls DESC, feature LIMIT 20"), "percent")
add("h1_bar_return", lambda s, d: pick(features.h1_bar_returns(fx.featured(s, d)), "h1_completed_timestamp", "h1_bar_return_1"), q(FS + f", {BAR_RETURN}", 'SELECT "timestamp", h1_completed_timestamp, h1_bar_return_1 FROM features LEFT JOIN hours USING (h1_completed_timestamp)'), "h1_bar_return_1")
CONSTANT = ["vol_x", "close_x", "h1_completed_vol", "d1_completed_vol", *ALL_FEATURES]
add("constant_features", lambda s, d: profile.constant_features(fx.featured(s, d), CONSTANT), q(FS, " UNION ALL ".join(f"SELECT '{c}' AS feature, (count(DISTINCT {c}) <= 1)::INTEGER AS constant FROM features" for c in CONSTANT)))
SAME = ["close_x", "vol_x", "h1_completed_vol", "m15_range", "m15_body", "m15_body_abs", "m15_copy"]
add("duplicate_features", lambda s, d: profile.duplicate_features(fx.featured(s, d).withColumn("m15_copy", F.col("m15_range")), SAME), q(FS + ", f AS (SELECT *, m15_range AS m15_copy FROM features)", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", bool_and({a} IS NOT DISTINCT FROM {b}) AS same FROM f" for i, a in enumerate(SAME) for b in SAME[i + 1 :]) + ") WHERE same"))
ORACLE["duplicate_features"] = ORACLE["duplicate_features"].replace("SELECT * FROM (SELECT * FROM (", 'SELECT "left", "right" FROM (SELECT * FROM (', 1)
SUITE = [c for c in ["h1_partial_open", "h1_partial_high", "h1_partial_low", "h1_partial_close", "h1_partial_tickvol", "h1_completed_open", "h1_completed_high", "h1_completed_low", "h1_completed_close", "h1_completed_tickvol", "h1_completed_vol", "h1_completed_spread", "d1_partial_open", "d1_partial_high", "d1_partial_low", "d1_partial_close", "d1_partial_tickvol", "d1_completed_open", "d1_completed_high", "d1_completed_low", "d1_completed_close", "d1_completed_tickvol", "d1_completed_vol", "d1_completed_spread", *ALL_FEATURES, "h1_bar_return_1"]]
add("feature_suite", lambda s, d: profile.feature_suite(features.h1_bar_returns(settled(fx.featured(s, d))), ALL_FEATURES), q(FS + f""", {BAR_RETURN}, suite AS (SELECT features.*, h1_bar_return_1 FROM features LEFT JOIN hours USING (h1_completed_timestamp)), names AS (SELECT column_name AS c, column_type AS t FROM (DESCRIBE suite)), own AS (SELECT * FROM names WHERE regexp_matches(c, '^({"|".join(profile.PREFIXES)})') AND c NOT IN ({", ".join(f"'{c}'" for c in profile.FORBIDDEN)})),
  k AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, count(DISTINCT {c}) <= 1 AS constant FROM suite" for c in SUITE)}), v AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, {n} AS n, list({c}::DOUBLE ORDER BY timestamp) AS l FROM suite" for n, c in enumerate(SUITE))})""", f"""SELECT count(*) AS bars, (SELECT count(*) FROM own) AS features, (SELECT count(*) = count(DISTINCT c) FROM names) AS unique_names, (SELECT bool_and(t IN ('DOUBLE', 'BIGINT', 'INTEGER', 'FLOAT')) FROM own) AS all_numeric, (SELECT count(*) FILTER (c IN ({", ".join(f"'{c}'" for c in ALL_FEATURES)})) = {len(ALL_FEATURES)} FROM names) AS required_present, count("timestamp") = count(DISTINCT "timestamp") AS unique_timestamps, count(*) FILTER ("timestamp" IS NULL) = 0 AS no_null_timestamp,
  ({" + ".join(f"count(*) FILTER ({c} IS NULL)" for c in SUITE)})::BIGINT AS null_cells, ({" + ".join(f"count(*) FILTER (NOT isfinite({c}::DOUBLE))" for c in SUITE)})::BIGINT AS not_finite, (SELECT count(*) FILTER (constant) FROM k) AS constant_features, (SELECT coalesce(string_agg(c, ',' ORDER BY c) FILTER (constant), '') FROM k) AS constant_names,
  (SELECT count(*) FROM v WHERE EXISTS (SELECT 1 FROM v w WHERE w.n < v.n AND w.l = v.l)) AS repeated_features, true AS expected_rows FROM suite"""))

# ---- probe of missing partial state ----
PROBE = A + """, p AS (SELECT "timestamp", "timestamp" = min("timestamp") OVER (PARTITION BY h1_partial_period) AS first_of_period, h1_partial_open IS NULL AS missing, h1_completed_open IS NULL AS completed_missing FROM aligned)"""


add("partial_null_contingency", lambda s, d: nulls.null_contingency(fx.aligned(s, d), "h1_partial_open", "h1_partial_period", "h1_completed_open"), q(PROBE, 'SELECT first_of_period, missing, count(*) AS bars, count(*) FILTER (completed_missing) AS completed_missing, count(DISTINCT CAST("timestamp" AS DATE)) AS dates FROM p GROUP BY 1, 2'))
add("partial_null_weekdays", lambda s, d: nulls.null_weekdays(fx.aligned(s, d), "h1_partial_open"), q(PROBE, """SELECT ((dayofweek("timestamp") + 6) % 7)::INTEGER AS weekday, count(*) AS bars, count(*) FILTER (missing) AS missing_bars FROM p GROUP BY 1"""))
add("null_run_lengths", lambda s, d: nulls.null_run_lengths(fx.aligned(s, d), "h1_partial_open", 900), q(PROBE + """, r AS (SELECT "timestamp", sum(CASE WHEN date_diff('second', before, "timestamp") = 900 THEN 0 ELSE 1 END) OVER (ORDER BY "timestamp") AS run FROM (SELECT "timestamp", lag("timestamp") OVER (ORDER BY "timestamp") AS before FROM p WHERE missing))""", "SELECT length, count(*) AS runs FROM (SELECT count(*) AS length FROM r GROUP BY run) GROUP BY 1"))

# ---- labels and splits ----
L = f"{fx.M15}, {fx.label_sql()}"
LS = f"{fx.M15S}, {fx.label_sql('m15', 'event_type')}"
LABELS = ["close", "future_close", "future_return", "target", "target_label"]
add("learning_target", lambda s, d: pick(fx.labelled(s, d), *LABELS), q(L, sel(LABELS, "labelled")), "close future_close future_return")
add("learning_target_by_symbol", lambda s, d: fx.labelled(s, d, fx.SYMBOL).select("event_type", "timestamp", *LABELS), q(LS, sel(LABELS, "labelled", "event_type, ")), "close future_close future_return")
add("target_distribution", lambda s, d: labels.target_distribution(fx.labelled(s, d)), q(L, " UNION ALL ".join(f"SELECT '{n}' AS target_label, count(*) FILTER (target = {c}) AS bars, 100.0::DOUBLE * count(*) FILTER (target = {c}) / count(*) AS percent FROM labelled" for c, n in labels.CLASSES.items())), "percent")
add("target_validation", lambda s, d: labels.target_validation(fx.labelled(s, d), threshold=fx.THRESHOLD), q(L, f"""SELECT count(*) AS bars, max(abs(future_close / close - 1 - future_return)) AS max_error, count(*) FILTER (target NOT IN (-1, 0, 1)) AS unknown_classes, count(*) FILTER (target <> CASE WHEN future_close / close - 1 > {fx.THRESHOLD} THEN 1 WHEN future_close / close - 1 < -{fx.THRESHOLD} THEN -1 ELSE 0 END) AS wrong_classes,
  count(*) FILTER (target_label <> ['DOWN', 'NEUTRAL', 'UP'][target + 2]) AS wrong_labels, count(*) FILTER (future_return IS NULL) AS null_returns, count(*) FILTER (NOT isfinite(future_return) OR NOT isfinite(future_close)) AS not_finite, count("timestamp") - count(DISTINCT "timestamp") AS duplicate_timestamps, coalesce(bool_and(target IN (-1, 0, 1)), true) AS known_classes_only FROM labelled"""), "max_error")
add("terminal_rows", lambda s, d: labels.terminal_rows(fx.m15(s, d), fx.labelled(s, d)), q(L, """SELECT (SELECT count(*) FROM m15) AS bars, count(*) AS labelled_bars, max("timestamp") AS last_labelled, (SELECT count(*) FROM m15) - count(*) AS dropped_bars, (SELECT count(*) FROM m15) - count(*) = 1 AND max("timestamp") < (SELECT max("timestamp") FROM m15) AS exact FROM labelled"""))
CASES = " ".join(f"WHEN \"timestamp\" BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}' THEN '{n}'" for n, (a, b) in fx.SPLITS.items())
SP = f"{L}, split AS (SELECT * FROM (SELECT *, CASE {CASES} END AS split FROM labelled) WHERE split IS NOT NULL)"


def _split(s: SparkSession, d: str) -> DataFrame:
    return splits.temporal_split(fx.labelled(s, d), fx.SPLITS)


add("temporal_split", lambda s, d: pick(_split(s, d), "split", "target"), q(SP, sel(["split", "target"], "split")))
add("split_distribution", lambda s, d: labels.target_distribution(_split(s, d), ["split"]), q(SP, " UNION ALL ".join(f"SELECT split, '{n}' AS target_label, count(*) FILTER (target = {c}) AS bars, 100.0::DOUBLE * count(*) FILTER (target = {c}) / count(*) AS percent FROM split GROUP BY split" for c, n in labels.CLASSES.items())), "percent")
add("split_validation", lambda s, d: splits.split_validation(_split(s, d)), q(SP + """, e AS (SELECT split, count(*) AS bars, min("timestamp") AS first, max("timestamp") AS last, count(*) FILTER (target IS NULL) AS null_targets FROM split GROUP BY 1)""", "SELECT *, date_diff('second', lag(last) OVER (ORDER BY first), first) AS gap_seconds, coalesce(first > lag(last) OVER (ORDER BY first), true) AS in_order FROM e"))
add("split_overlap", lambda s, d: splits.split_overlap(_split(s, d)), q(SP + """, n AS (SELECT DISTINCT split FROM split), k AS (SELECT DISTINCT "timestamp", split FROM split)""", """SELECT a.split AS "left", b.split AS "right", (SELECT count(*) FROM k x JOIN k y ON x."timestamp" = y."timestamp" WHERE x.split = a.split AND y.split = b.split)::BIGINT AS shared FROM n a JOIN n b ON a.split < b.split"""))
add("split_conservation", lambda s, d: splits.split_conservation(fx.labelled(s, d), _split(s, d)), q(SP + """, r AS (SELECT split, min("timestamp") AS lo, max("timestamp") AS hi FROM split GROUP BY 1), c AS (SELECT count(*) AS all_rows, count(*) FILTER (EXISTS (SELECT 1 FROM r WHERE l."timestamp" BETWEEN lo AND hi)) AS rows_in_ranges, (SELECT count(*) FROM split) AS split_rows FROM labelled l)""", "SELECT *, rows_in_ranges = split_rows AS preserved FROM c"))
add("test_year_purity", lambda s, d: splits.year_purity(_split(s, d), [2024]), q(SP, """SELECT count(*) AS bars, count(*) FILTER (year("timestamp") <> 2024) AS foreign_bars, count(DISTINCT year("timestamp")) AS years, count(*) FILTER (year("timestamp") <> 2024) = 0 AND count(DISTINCT year("timestamp")) = 1 AS pure FROM split WHERE split = 'test'"""))
INPUT = ["timestamp", "close", "future_return", "target", "target_label"]
add("split_input_validation", lambda s, d: splits.split_input_validation(fx.labelled(s, d), INPUT), q(L + f""", v AS (SELECT count(*) AS bars, (SELECT count(*) FILTER (column_name IN ({", ".join(f"'{c}'" for c in INPUT)})) = {len(INPUT)} FROM (DESCRIBE labelled)) AS columns_present, (SELECT bool_or(column_name = 'timestamp' AND column_type LIKE 'TIMESTAMP%') FROM (DESCRIBE labelled)) AS timestamp_typed, count(*) FILTER ("timestamp" IS NULL) AS null_timestamps, count("timestamp") - count(DISTINCT "timestamp") AS duplicate_timestamps,
  count(*) FILTER (target IS NULL OR target NOT IN (-1, 0, 1)) AS bad_targets, count(*) FILTER (future_return IS NULL OR NOT isfinite(future_return)) AS bad_returns FROM labelled)""", "SELECT *, columns_present AND timestamp_typed AND null_timestamps = 0 AND duplicate_timestamps = 0 AND bad_targets = 0 AND bad_returns = 0 AND bars > 0 AS passed FROM v"))
add("development_union", lambda s, d: pick(splits.development_union(_split(s, d).where("split = 'train'"), _split(s, d).where("split = 'validation'")), "split", "target"), q(SP, """SELECT "timestamp", split, target FROM split WHERE split IN ('train', 'validation')"""))
add("missing_years", lambda s, d: splits.missing_years(fx.days(s, d), 1992, 2003), q(fx.DAYS, """SELECT range::INTEGER AS year FROM range(1992, 2004) WHERE range NOT IN (SELECT year("timestamp") FROM days)"""))

# ---- walk-forward folds over daily bars ----
TAGGED = f"""{fx.DAYS}, b AS (SELECT *, lead("timestamp") OVER (ORDER BY "timestamp") AS label_end FROM days),
  y AS (SELECT * FROM (VALUES {", ".join(f"({n}, {v})" for n, v in enumerate(fx.FOLD_YEARS, 1))}) AS v(fold, vy)),
  tagged AS (SELECT b.*, y.fold, CASE WHEN year("timestamp") = vy THEN 'validation' WHEN label_end >= make_timestamp(vy, 1, 1, 0, 0, 0) THEN 'purged' ELSE 'train' END AS role FROM b JOIN y ON year("timestamp") BETWEEN {fx.FIRST_YEAR} AND vy),
  folds AS (SELECT fold, min("timestamp") FILTER (role <> 'validation') AS train_start, max("timestamp") FILTER (role <> 'validation') AS train_end_before_purge, max("timestamp") FILTER (role = 'train') AS train_end_after_purge, min("timestamp") FILTER (role = 'validation') AS validation_start, max("timestamp") FILTER (role = 'validation') AS validation_end,
    count(*) FILTER (role <> 'validation') AS train_rows_before_purge, count(*) FILTER (role = 'purged') AS purged_rows, count(*) FILTER (role = 'train') AS train_rows_after_purge, count(*) FILTER (role = 'validation') AS validation_rows, 1 AS purge_bars, 0 AS embargo_bars FROM tagged GROUP BY 1)"""


def _splitter() -> splits.PurgedWalkForwardSplitter:
    return splits.PurgedWalkForwardSplitter(fx.FOLD_YEARS, fx.FIRST_YEAR)


add("walk_forward_folds", lambda s, d: splits.walk_forward_folds(fx.days(s, d), fx.FOLD_YEARS, fx.FIRST_YEAR), q(TAGGED, f"SELECT fold, {fx.FIRST_YEAR} AS first_train_year, (vy - 1)::INTEGER AS last_train_year, vy AS validation_year, count(*) FILTER (role <> 'validation') AS train_bars, count(*) FILTER (role = 'validation') AS validation_bars FROM tagged JOIN y USING (fold) GROUP BY fold, vy"))
add("purged_walk_forward", lambda s, d: _splitter().fold_table(fx.days(s, d)), q(TAGGED, "SELECT * FROM folds"))
add("purged_walk_forward_rows", lambda s, d: _splitter().tagged(fx.days(s, d)).select("timestamp", "fold", "role", "label_end"), q(TAGGED, 'SELECT "timestamp", fold, role, label_end FROM tagged'))
add("fold_independence", lambda s, d: splits.fold_independence(_splitter().fold_table(fx.days(s, d))), q(TAGGED, "SELECT fold, train_end_after_purge < validation_start AS train_before_validation, coalesce(validation_start > lag(validation_end) OVER (ORDER BY fold), true) AS after_previous FROM folds"))
add("label_endpoints", lambda s, d: align.label_endpoints(fx.m15(s, d).select("timestamp"), fx.d1(s, d)), q(f"{fx.M15}, {fx.D1}", """SELECT a."timestamp", b."timestamp" AS label_end FROM m15 a ASOF LEFT JOIN d1 b ON a."timestamp" < b."timestamp" """))
AUDIT = TAGGED + """, audit AS (SELECT fold, count(*) FILTER (role = 'purged') AS purged_bars, max("timestamp") FILTER (role = 'train') AS train_end, min("timestamp") FILTER (role = 'validation') AS validation_start, count(*) FILTER (role = 'train' AND label_end IS NULL) AS open_labels, 0::BIGINT AS embargoed_bars FROM tagged GROUP BY 1)"""
add("purge_audit", lambda s, d: splits.purge_audit(_splitter().tagged(fx.days(s, d))), q(AUDIT, "SELECT *, date_diff('second', train_end, validation_start) AS gap_seconds, train_end < validation_start AS clean FROM audit"))
add("purge_totals", lambda s, d: splits.purge_totals(splits.purge_audit(_splitter().tagged(fx.days(s, d)))), q(AUDIT, "SELECT count(*) AS boundaries, sum(purged_bars)::BIGINT AS purged_bars, bool_and(train_end < validation_start) AS all_clean FROM audit"))
LAST = f"""{fx.DAYS}, b AS (SELECT *, lead("timestamp") OVER (ORDER BY "timestamp") AS label_end FROM days),
  y AS (SELECT * FROM (VALUES (1, 1998, {fx.FIRST_YEAR}), (2, 1999, {fx.FIRST_YEAR}), (3, 2000, {fx.FIRST_YEAR}), (4, 2001, 2000)) AS v(fold, vy, since)),
  tagged AS (SELECT b.*, y.fold, CASE WHEN year("timestamp") = vy THEN 'validation' WHEN label_end >= make_timestamp(vy, 1, 1, 0, 0, 0) THEN 'purged' ELSE 'train' END AS role FROM b JOIN y ON year("timestamp") BETWEEN since AND vy),
  audit AS (SELECT fold, count(*) FILTER (role = 'purged') AS purged_bars, max("timestamp") FILTER (role = 'train') AS train_end, min("timestamp") FILTER (role = 'validation') AS validation_start FROM tagged GROUP BY 1)"""
add("boundary_totals", lambda s, d: splits.boundary_totals(splits.purge_audit(splits.PurgedWalkForwardSplitter(fx.FOLD_YEARS[:3], fx.FIRST_YEAR).with_test_boundary(fx.days(s, d), 2001))), q(LAST, "SELECT count(*) AS boundaries, sum(purged_bars)::BIGINT AS purged_bars, bool_or(purged_bars > 0) AS purge_required, 0::BIGINT AS embargoed_bars, true AS no_embargo, bool_and(train_end < validation_start) AS all_clean FROM audit"))
add("horizon_audit", lambda s, d: splits.horizon_audit(fx.m15(s, d), 900), q(STEPS, "SELECT count(*) FILTER (seconds = 900) AS exact, count(*) FILTER (seconds <> 900) AS other, CASE WHEN count(*) FILTER (seconds <> 900) = 0 THEN 'PASS' ELSE 'REVIEW' END AS verdict FROM steps WHERE seconds IS NOT NULL"))
add("leakage_audit", lambda s, d: splits.leakage_audit(_split(s, d), profile.suspicious_names(_split(s, d))), q(SP + f""", e AS (SELECT split, min("timestamp") AS first, max("timestamp") AS last, count(*) FILTER (target IS NULL) AS null_targets FROM split GROUP BY 1), g AS (SELECT *, coalesce(first > lag(last) OVER (ORDER BY first), true) AS in_order FROM e),
  v AS (SELECT (SELECT bool_and(in_order) FROM g) AS splits_in_order, (SELECT sum(null_targets) = 0 FROM g) AS targets_present, (SELECT count(*) = 0 FROM (SELECT "timestamp" FROM split GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS no_shared_timestamps, (SELECT count(*) = count("timestamp") FROM split) AS no_null_timestamps,
    (SELECT count(*) FROM (DESCRIBE split) WHERE regexp_matches(lower(column_name), '{"|".join(profile.SUSPICIOUS)}'))::BIGINT AS suspicious_names)""", "SELECT *, CASE WHEN NOT (splits_in_order AND targets_present AND no_shared_timestamps AND no_null_timestamps) THEN 'FAIL' WHEN suspicious_names > 0 THEN 'REVIEW' ELSE 'PASS' END AS verdict FROM v"))
add("validation_report", lambda s, d: splits.validation_report(fx.days(s, d), splits.PurgedWalkForwardSplitter(fx.FOLD_YEARS[:3], fx.FIRST_YEAR).fold_table(fx.days(s, d)), "2001-01-01"), q(TAGGED + """, k AS (SELECT *, coalesce(validation_start > lag(validation_end) OVER (ORDER BY fold), true) AS after FROM folds WHERE fold <= 3)""", """SELECT (SELECT count("timestamp") = count(DISTINCT "timestamp") FROM days) AS unique_timestamps, (SELECT count(*) = count("timestamp") FROM days) AS no_null_timestamps, bool_and(train_rows_after_purge > 0 AND validation_rows > 0) AS folds_filled, bool_and(after) AS folds_independent, (SELECT max("timestamp") FILTER ("timestamp" < TIMESTAMP '2001-01-01') < min("timestamp") FILTER ("timestamp" >= TIMESTAMP '2001-01-01') FROM days) AS test_isolated,
  bool_and(train_end_after_purge < validation_start) AS folds_in_order, bool_and(purged_rows >= 1) AS all_purged, bool_and(validation_end < TIMESTAMP '2001-01-01') AS folds_before_test, CASE WHEN bool_and(train_end_after_purge < validation_start AND purged_rows >= 1 AND validation_end < TIMESTAMP '2001-01-01' AND after AND train_rows_after_purge > 0 AND validation_rows > 0) AND (SELECT count("timestamp") = count(DISTINCT "timestamp") AND count(*) = count("timestamp") AND max("timestamp") FILTER ("timestamp" < TIMESTAMP '2001-01-01') < min("timestamp") FILTER ("timestamp" >= TIMESTAMP '2001-01-01') FROM days) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM k"""))

# ---- learners and metrics over made-up probabilities ----
E = fx.ensemble_sql()
add("train_median_impute", lambda s, d: learners.train_medians(fx.aligned(s, d).where("timestamp < timestamp_ntz'2024-01-21'"), HP[1:6]), q(A, " UNION ALL ".join(f"SELECT '{c}' AS feature, quantile_cont({c}::DOUBLE, 0.5) AS median FROM aligned WHERE \"timestamp\" < TIMESTAMP '2024-01-21'" for c in HP[1:6])), "median")
add("class_weights", lambda s, d: metrics.class_weights(fx.labelled(s, d)), q(L, "SELECT target, count(*) AS bars, (SELECT count(*)::DOUBLE FROM labelled) / ((SELECT count(DISTINCT target) FROM labelled) * count(*)) AS weight FROM labelled GROUP BY 1"), "weight")
add("confusion_matrix", lambda s, d: metrics.confusion_matrix(fx.ensembled(s, d)), q(E, "SELECT target, predicted_class, count(*) AS bars FROM ensembled GROUP BY 1, 2"))
F1 = "(" + " + ".join(f"coalesce(2.0::DOUBLE * count(*) FILTER (target = {c} AND predicted_class = {c}) / nullif(count(*) FILTER (target = {c}) + count(*) FILTER (predicted_class = {c}), 0), 0)" for c in (-1, 0, 1)) + ") / 3"
LOSS = "avg(-ln(greatest(CASE target WHEN -1 THEN ensemble_down WHEN 0 THEN ensemble_neutral ELSE ensemble_up END, 1e-15)))"
ACC = "avg((target = predicted_class)::INTEGER::DOUBLE)"
add("accuracy", lambda s, d: fx.ensembled(s, d).agg(metrics.accuracy().alias("accuracy")), q(E, f"SELECT {ACC} AS accuracy FROM ensembled"), "accuracy")
add("macro_f1", lambda s, d: fx.ensembled(s, d).agg(metrics.macro_f1().alias("macro_f1")), q(E, f"SELECT {F1} AS macro_f1 FROM ensembled"), "macro_f1")
add("log_loss", lambda s, d: fx.ensembled(s, d).agg(metrics.log_loss().alias("log_loss")), q(E, f"SELECT {LOSS} AS log_loss FROM ensembled"), "log_loss")
add("prediction_alignment", lambda s, d: learners.prediction_alignment(fx.predictions(s, d), fx.predictions(s, d).where("minute(timestamp) <> 15").withColumn("target", F.when(F.minute("timestamp") == 30, F.col("target") * 0).otherwise(F.col("target")))), q(fx.prediction_sql() + """, r AS (SELECT "timestamp", CASE WHEN minute("timestamp") = 30 THEN 0 ELSE target END AS t FROM predictions WHERE minute("timestamp") <> 15)""", """SELECT count(*) FILTER (p."timestamp" IS NOT NULL AND r."timestamp" IS NOT NULL) AS shared, count(*) FILTER (r."timestamp" IS NULL) AS left_only, count(*) FILTER (p."timestamp" IS NULL) AS right_only, count(*) FILTER (p."timestamp" IS NOT NULL AND r."timestamp" IS NOT NULL AND target IS DISTINCT FROM t) AS targets_differ FROM predictions p FULL JOIN r ON p."timestamp" = r."timestamp" """))
add("probability_audit", lambda s, d: ensemble.probability_audit(fx.ensembled(s, d)), q(E + ", o AS (SELECT abs(ensemble_down + ensemble_neutral + ensemble_up - 1) AS off, least(ensemble_down, ensemble_neutral, ensemble_up) AS low FROM ensembled)", "SELECT count(*) AS bars, max(off) AS max_deviation, avg(off) AS mean_deviation, count(*) FILTER (low < 0) AS negative, CASE WHEN max(off) <= 1e-9 THEN 'keep' WHEN max(off) <= 0.01 THEN 'renormalize' ELSE 'reject' END AS action FROM o"), "max_deviation mean_deviation")
OFF = "greatest(" + ", ".join(f"abs({k}_down + {k}_neutral + {k}_up - 1)" for k in fx.LEARNERS) + ")"
add("audit_predictions", lambda s, d: learners.audit_predictions(fx.predictions(s, d).withColumn("ordinal", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01', timestamp)")), order="ordinal"), q(fx.prediction_sql() + f""", b AS (SELECT *, "timestamp" < lag("timestamp") OVER (ORDER BY epoch("timestamp")) AS back FROM predictions),
  v AS (SELECT (SELECT list(column_name) = [{", ".join(f"'{c}'" for c in ensemble.prediction_columns())}] FROM (DESCRIBE predictions)) AS names_match, count(*) AS bars, count(*) FILTER (target IS NULL OR target NOT IN (-1, 0, 1)) AS bad_targets, max({OFF}) AS max_deviation, count(*) FILTER (least({", ".join(fx.PROBABILITIES)}) < 0) AS negative, count(*) - count(DISTINCT "timestamp") AS duplicate_timestamps, count(*) FILTER ("timestamp" IS NULL) AS null_timestamps, count(*) FILTER (back) AS steps_back FROM b)""", "SELECT *, names_match AND bad_targets = 0 AND max_deviation <= 1e-3 AND negative = 0 AND duplicate_timestamps = 0 AND steps_back = 0 AS passed FROM v"), "max_deviation")

# ---- ensemble ----
add("price_context", lambda s, d: fx.context(s, d), q(f"{fx.M15}, {fx.CONTEXT_SQL}", "SELECT * FROM context"), "close_x vol_16 forward_return_1")
CX = ["close_x", "vol_16", "forward_return_1", "next_timestamp"]
END = "2024-01-25 00:00:00"
add("attach_price_context", lambda s, d: pick(trading.attach_price_context(fx.predictions(s, d), fx.context(s, d), END), "target", *CX), q(f"{fx.prediction_sql()}, {fx.CONTEXT_SQL}", f"""SELECT p."timestamp", target, close_x, vol_16, CASE WHEN next_timestamp <= TIMESTAMP '{END}' THEN forward_return_1 END AS forward_return_1, next_timestamp FROM predictions p LEFT JOIN context USING ("timestamp")"""), "close_x vol_16 forward_return_1")
add("regime_thresholds", lambda s, d: ensemble.regime_thresholds(fx.context(s, d)), q(f"{fx.M15}, {fx.CONTEXT_SQL}", "SELECT quantile_cont(vol_16, 1.0::DOUBLE / 3) AS q33, quantile_cont(vol_16, 2.0::DOUBLE / 3) AS q67 FROM context"), "q33 q67")
CONTEXTS = fx.CONTEXT_SQL.replace("(ORDER BY", "(PARTITION BY event_type ORDER BY").replace('SELECT "timestamp",', 'SELECT event_type, "timestamp",')
add("price_context_by_symbol", lambda s, d: fx.context(s, d, fx.SYMBOL), q(f"{fx.M15S}, {CONTEXTS}", "SELECT * FROM context"), "close_x vol_16 forward_return_1")
add("regime_thresholds_by_symbol", lambda s, d: ensemble.regime_thresholds(fx.context(s, d, fx.SYMBOL), by=fx.SYMBOL), q(f"{fx.M15S}, {CONTEXTS}", "SELECT event_type, quantile_cont(vol_16, 1.0::DOUBLE / 3) AS q33, quantile_cont(vol_16, 2.0::DOUBLE / 3) AS q67 FROM context GROUP BY 1"), "q33 q67")
add("regime_assignment", lambda s, d: pick(fx.ensembled(s, d), "vol_16", "regime"), q(E, sel(["vol_16", "regime"], "ensembled")), "vol_16")
ENS = [f"ensemble_{x}" for x in fx.SIDES]
add("regime_weighted_ensemble", lambda s, d: pick(fx.ensembled(s, d), "target", "regime", *ENS, "predicted_class"), q(E, sel(["target", "regime", *ENS, "predicted_class"], "ensembled")), " ".join(ENS))
POINTS = "pts AS (SELECT p_partkey AS id, (p_partkey * 37 % 101)::DOUBLE AS a, (p_partkey * 53 % 97)::DOUBLE AS b FROM part)"
FRONT = POINTS + ", pairs AS (SELECT DISTINCT a, b FROM pts), front AS (SELECT pts.* FROM pts JOIN pairs p USING (a, b) WHERE NOT EXISTS (SELECT 1 FROM pairs o WHERE o.a >= p.a AND o.b >= p.b AND (o.a > p.a OR o.b > p.b)))"


def _points(s: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(s, d, "part").select(key.alias("id"), (key * 37 % 101).cast("double").alias("a"), (key * 53 % 97).cast("double").alias("b"))


add("pareto_front", lambda s, d: ensemble.pareto_front(_points(s, d), ["a", "b"]), q(FRONT, "SELECT id, a, b FROM front"), "a b")


RANKS = POINTS + """, pairs AS (SELECT DISTINCT a, b FROM pts), chains AS (SELECT a, b, 1 AS k FROM pairs UNION SELECT p.a, p.b, k + 1 FROM chains c JOIN pairs p ON c.a >= p.a AND c.b >= p.b AND (c.a > p.a OR c.b > p.b)), ranks AS (SELECT a, b, max(k)::INTEGER AS rank FROM chains GROUP BY 1, 2)"""
add("pareto_ranks", lambda s, d: ensemble.pareto_ranks(_points(s, d), ["a", "b"]), "WITH RECURSIVE " + RANKS + " SELECT id, a, b, rank FROM pts JOIN ranks USING (a, b)")
THREE = """pts AS (SELECT p_partkey AS id, (p_partkey * 37 % 101)::DOUBLE AS a, (p_partkey * 53 % 97)::DOUBLE AS b, (p_size * 7 % 50)::DOUBLE AS c FROM part)"""
add("pareto_front_of_three", lambda s, d: ensemble.pareto_front(table(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 37 % 101).cast("double").alias("a"), (F.col("p_partkey") * 53 % 97).cast("double").alias("b"), (F.col("p_size") * 7 % 50).cast("double").alias("c")), ["a", "b", "c"]), q(THREE, "SELECT * FROM pts p WHERE NOT EXISTS (SELECT 1 FROM pts o WHERE o.a >= p.a AND o.b >= p.b AND o.c >= p.c AND (o.a > p.a OR o.b > p.b OR o.c > p.c))"), "a b c")


def _front(s: SparkSession, d: str) -> DataFrame:
    return ensemble.pareto_front(_points(s, d), ["a", "b"]).groupBy("a", "b").agg(F.min("id").alias("id"))


CROWD = FRONT + """, u AS (SELECT a, b, min(id) AS id FROM front GROUP BY 1, 2), g AS (SELECT *, lag(a) OVER (ORDER BY a) AS la, lead(a) OVER (ORDER BY a) AS ha, lag(b) OVER (ORDER BY b) AS lb, lead(b) OVER (ORDER BY b) AS hb, max(a) OVER () - min(a) OVER () AS sa, max(b) OVER () - min(b) OVER () AS sb FROM u),
  c AS (SELECT id, a, b, la IS NULL OR ha IS NULL OR lb IS NULL OR hb IS NULL AS infinite, CASE WHEN sa >= 1e-12 THEN (ha - la) / sa ELSE 0 END + CASE WHEN sb >= 1e-12 THEN (hb - lb) / sb ELSE 0 END AS d FROM g)"""
add("crowding_distance", lambda s, d: ensemble.crowding_distance(_front(s, d), ["a", "b"]), q(CROWD, "SELECT id, a, b, infinite, CASE WHEN NOT infinite THEN d END AS crowding FROM c"), "a b crowding")
add("compromise_selection", lambda s, d: ensemble.compromise(_front(s, d), ["a", "b"], "id"), q(CROWD, "SELECT id, a, b, (a - min(a) OVER ()) / CASE WHEN max(a) OVER () - min(a) OVER () < 1e-12 THEN 1 ELSE max(a) OVER () - min(a) OVER () END + (b - min(b) OVER ()) / CASE WHEN max(b) OVER () - min(b) OVER () < 1e-12 THEN 1 ELSE max(b) OVER () - min(b) OVER () END AS score FROM u ORDER BY score DESC, id LIMIT 1"), "a b score")
SHARPE = lambda c: f"coalesce(CASE WHEN stddev_pop({c}) >= 1e-12 THEN avg({c}) / stddev_pop({c}) END, 0)"
add("sharpe_by_regime", lambda s, d: fx.ensembled(s, d).groupBy("regime").agg(F.count("forward_return_1").alias("bars"), trading.sharpe(F.col("predicted_class") * F.col("forward_return_1")).alias("sharpe")), q(E, f"SELECT regime, count(forward_return_1) AS bars, {SHARPE('predicted_class * forward_return_1')} AS sharpe FROM ensembled GROUP BY 1"), "sharpe")

# ---- trading ----
T = f"{E}, {fx.trading_sql()}"
TD = ["position", "forward_return", "position_change", "gross_return", "gross_equity"]
add("equity_curve", lambda s, d: pick(trading.evaluated(fx.ensembled(s, d)), *TD), q(T, sel(TD, "traded")), " ".join(TD))
add("drawdown", lambda s, d: pick(trading.evaluated(fx.ensembled(s, d)), "gross_equity", "gross_drawdown"), q(T, sel(["gross_equity", "gross_drawdown"], "traded")), "gross_equity gross_drawdown")
add("position_changes", lambda s, d: pick(trading.evaluated(fx.ensembled(s, d)), "position", "position_change"), q(T, sel(["position", "position_change"], "traded")), "position position_change")
SUMMARY = f"""count(*) AS bars, count(*) FILTER (position <> 0) AS trades, coalesce(count(*) FILTER (position <> 0 AND gross_return > 0)::DOUBLE / nullif(count(*) FILTER (position <> 0), 0), 0) AS win_rate, arg_max(gross_equity, "timestamp") - 1 AS total_return, min(gross_drawdown) AS max_drawdown, {SHARPE("gross_return")} AS sharpe"""
SD = "win_rate total_return max_drawdown sharpe"
add("equity_summary", lambda s, d: trading.equity_summary(trading.evaluated(fx.ensembled(s, d))), q(T, f"SELECT {SUMMARY} FROM traded"), SD)


def _per_regime(s: SparkSession, d: str) -> DataFrame:
    rows = fx.ensembled(s, d)
    return trading.equity_summary(trading.evaluated(rows, by=["regime"]), ["regime"]).join(metrics.classification_report(rows, ["regime"]).withColumnRenamed("bars", "labelled_bars"), "regime")


add("per_regime_metrics", _per_regime, q(f"{E}, {fx.trading_sql(by='regime')}, x AS (SELECT regime, {SUMMARY} FROM traded GROUP BY 1), m AS (SELECT regime, count(*) AS labelled_bars, {ACC} AS accuracy, {F1} AS macro_f1, {LOSS} AS log_loss FROM ensembled GROUP BY 1)", "SELECT * FROM x JOIN m USING (regime)"), SD + " accuracy macro_f1 log_loss")
SCENARIOS = E + ", scenarios AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {r}::DOUBLE)" for n, r in trading.COST_SCENARIOS.items()) + ") AS v(scenario, rate)), spread AS (SELECT * FROM ensembled CROSS JOIN scenarios), " + fx.trading_sql("spread", rate="rate", by="scenario").replace("SELECT scenario, ", "SELECT scenario, rate, ", 1)
COSTS = f"""scenario, rate, count(*) AS bars, count(*) FILTER (position <> 0) AS directional_bars, count(*) FILTER (position_change > 0) AS position_changes, arg_max(gross_equity, "timestamp") - 1 AS gross_total_return, sum(cost) AS total_cost, arg_max(net_equity, "timestamp") - 1 AS net_total_return, arg_max(net_equity, "timestamp") AS net_equity, min(net_drawdown) AS max_drawdown_net,
  coalesce(count(*) FILTER (position <> 0 AND net_return > 0)::DOUBLE / nullif(count(*) FILTER (position <> 0), 0), 0) AS win_rate_net, {SHARPE("net_return")} AS sharpe_net, {SHARPE("net_return")} * sqrt(count(*) / (date_diff('second', min("timestamp"), max("timestamp")) / 86400.0::DOUBLE / 365.25)) AS sharpe_annual"""
add("cost_scenarios", lambda s, d: trading.cost_scenarios(fx.ensembled(s, d)), q(SCENARIOS, f"SELECT {COSTS} FROM traded GROUP BY 1, 2"), "rate gross_total_return total_cost net_total_return net_equity max_drawdown_net win_rate_net sharpe_net sharpe_annual")
HOLD = f"{E}, holds AS (SELECT * FROM (VALUES ('buy_hold', 1.0::DOUBLE), ('flat', 0.0::DOUBLE)) AS v(strategy, hold)), spread AS (SELECT * FROM ensembled CROSS JOIN holds), {fx.trading_sql('spread', 'hold', by='strategy')}"
add("baselines", lambda s, d: trading.baselines(fx.ensembled(s, d)), q(HOLD, f"""SELECT strategy, {SUMMARY}, (SELECT arg_max(close_x * (1 + forward_return_1), "timestamp") / nullif(arg_min(close_x, "timestamp"), 0) - 1 FROM ensembled WHERE forward_return_1 IS NOT NULL) AS close_to_close FROM traded GROUP BY 1"""), SD + " close_to_close")
HELD = f"""{E}, scenarios AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {r}::DOUBLE)" for n, r in trading.COST_SCENARIOS.items())}) AS v(scenario, rate)), holds AS (SELECT unnest(['strategy', 'buy_hold', 'flat']) AS strategy),
  spread AS (SELECT *, CASE strategy WHEN 'strategy' THEN predicted_class WHEN 'buy_hold' THEN 1 ELSE 0 END AS hold FROM ensembled CROSS JOIN scenarios CROSS JOIN holds), {fx.trading_sql("spread", "hold", "rate", "strategy, scenario").replace("SELECT strategy, scenario, ", "SELECT strategy, scenario, rate, ", 1)}"""
add("strategy_costs", lambda s, d: trading.strategy_costs(fx.ensembled(s, d)), q(HELD, f"SELECT strategy, {COSTS} FROM traded GROUP BY 1, 2, 3"), "rate gross_total_return total_cost net_total_return net_equity max_drawdown_net win_rate_net sharpe_net sharpe_annual")
add("return_outliers", lambda s, d: trading.return_outliers(fx.ensembled(s, d)), q(E, """SELECT count(forward_return_1) AS returns, min(forward_return_1) AS least, max(forward_return_1) AS greatest, avg(forward_return_1) AS mean, stddev_pop(forward_return_1) AS deviation, count(*) FILTER (abs(forward_return_1) > 0.01) AS soft_outliers, count(*) FILTER (abs(forward_return_1) > 0.2) AS hard_outliers,
  count(*) FILTER (close_x < 500) AS below_floor, count(*) FILTER (close_x <= 0) AS not_positive, count(*) FILTER (abs(forward_return_1) > 0.2) = 0 AND count(*) FILTER (close_x < 500) = 0 AS sane FROM ensembled"""), "least greatest mean deviation")
add("largest_returns", lambda s, d: trading.largest_returns(fx.ensembled(s, d)), q(E, 'SELECT "timestamp", close_x, forward_return_1 FROM ensembled WHERE forward_return_1 IS NOT NULL ORDER BY abs(forward_return_1) DESC, "timestamp" LIMIT 10'), "close_x forward_return_1")
REPRODUCED = {"gross_total_return": "total_return", "sharpe_net": "sharpe", "net_total_return": "max_drawdown"}
add("baseline_reproduction", lambda s, d: trading.baseline_reproduction(trading.cost_scenarios(fx.ensembled(s, d), scenarios={"zero_cost": 0.0}), trading.equity_summary(trading.evaluated(fx.ensembled(s, d))), REPRODUCED), q(f"{T}, z AS (SELECT {SUMMARY} FROM traded), m AS (" + " UNION ALL ".join(f"SELECT '{a}' AS metric, ({n})::DOUBLE AS now, {o} AS saved FROM z" for (a, o), n in zip(REPRODUCED.items(), ("total_return", "sharpe", "total_return"))) + ")", "SELECT metric, now, saved, coalesce(abs(now - saved) <= 1e-6, false) AS reproduced FROM m"), "now saved")


def _reproduced(s: SparkSession, d: str) -> DataFrame:
    """The free scenario against the report that an evaluation has saved before."""
    rows = fx.ensembled(s, d)
    path = f"{shared_folder(s)}/trading-report-{uuid.uuid4().hex}.json"
    write_report(trading.equity_summary(trading.evaluated(rows)), path)
    saved = read_artifact(s, path)
    return trading.baseline_reproduction(trading.cost_scenarios(rows, scenarios={"zero_cost": 0.0}), s.createDataFrame([(saved["total_return"], saved["max_drawdown"], saved["sharpe"])], "total_return double, max_drawdown double, sharpe double"), SAVED)


SAVED = {"net_total_return": "total_return", "max_drawdown_net": "max_drawdown", "sharpe_net": "sharpe"}
add("saved_report_reproduction", _reproduced, q(f"{T}, z AS (SELECT {SUMMARY} FROM traded), m AS (" + " UNION ALL ".join(f"SELECT '{a}' AS metric, {o} AS now, {o} AS saved FROM z" for a, o in SAVED.items()) + ")", "SELECT metric, now, saved, true AS reproduced FROM m"), "now saved")
add("top_contributors", lambda s, d: trading.top_contributors(trading.evaluated(fx.ensembled(s, d))), q(T, 'SELECT "timestamp", position, forward_return, gross_return, 1 + gross_return AS multiplier FROM traded ORDER BY abs(gross_return) DESC, "timestamp" LIMIT 5'), "position forward_return gross_return multiplier")

# ---- fitted models: no SQL gives their rows ----
COLUMNS = ["tickvol", *[f"{p}_partial_{c}" for p in ("h1", "d1") for c in ("open", "high", "low", "close", "tickvol")]]
AVAILABLE = ["h1_partial_available", "d1_partial_available"]


def _learned(fit):
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = align.partial_state(align.partial_state(fx.labelled(s, d), "hour", "h1_partial_"), "day", "d1_partial_")
        rows = splits.temporal_split(features.partial_availability(features.partial_availability(rows, "h1_partial_"), "d1_partial_"), fx.SPLITS)
        train = rows.where("split = 'train'")
        rows = learners.impute(rows, learners.train_medians(train, COLUMNS))
        train = rows.where("split = 'train'")
        return learners.probabilities(fit(learners.clean_train(train, COLUMNS), [*COLUMNS, *AVAILABLE]), rows.where("split <> 'train'"), "m15", ["timestamp", "target", "split"])

    return run


add("lr_probabilities", _learned(learners.fit_logistic))
add("tree_probabilities", _learned(lambda t, c: learners.fit_trees(t, c, inner_from="2024-01-17")))
add("nsga2_weights", lambda s, d: optimize.regime_fronts(fx.ensembled(s, d)))
DUMP = "num_class=3\nfeature_names=high low\n" + "".join(f"\nTree={i}\nnum_leaves=3\nnum_cat=0\nsplit_feature=0 1\nthreshold={t} {u}\ndecision_type=2 2\nleft_child=1 -1\nright_child=-2 -3\nleaf_value={a} {b} {c}\n\n" for i, (t, u, a, b, c) in enumerate([(250000.0, 2000.0, 0.1, -0.2, 0.4), (300000.0, 1500.0, -0.3, 0.2, 0.05), (200000.0, 2500.0, 0.25, 0.0, -0.1)]))
SUMS = [f"CASE WHEN high <= {t} THEN CASE WHEN low <= {u} THEN {a} ELSE {c} END ELSE {b} END" for t, u, a, b, c in [(250000.0, 2000.0, 0.1, -0.2, 0.4), (300000.0, 1500.0, -0.3, 0.2, 0.05), (200000.0, 2500.0, 0.25, 0.0, -0.1)]]
add("tree_text_scores", lambda s, d: tree_text.score(fx.days(s, d), tree_text.parse(DUMP)).select("timestamp", "down", "neutral", "up"), q(fx.DAYS + f', z AS (SELECT "timestamp", exp(({SUMS[0]})::DOUBLE) AS a, exp(({SUMS[1]})::DOUBLE) AS b, exp(({SUMS[2]})::DOUBLE) AS c FROM days)', 'SELECT "timestamp", a / (a + b + c) AS down, b / (a + b + c) AS neutral, c / (a + b + c) AS up FROM z'), "down neutral up")
