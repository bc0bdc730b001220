"""Frames that the queries start from, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import BLOCK, settled
from barloom.operators import align, bars, ensemble, features, labels, trading
from barloom.sources import table

SYMBOL = ["event_type"]
#: Move that counts as up or down: event values change by large factors.
THRESHOLD = 0.25
#: Returns of event values are scaled down so that compounding stays in range.
SCALE = 0.0001
LEARNERS, SIDES = ensemble.LEARNERS, ensemble.SIDES
PROBABILITIES = [f"{k}_{s}" for k in LEARNERS for s in SIDES]
WEIGHTS = {
    "low_vol": dict(zip(LEARNERS, (0.30, 0.05, 0.25, 0.10, 0.20, 0.10))),
    "medium_vol": dict(zip(LEARNERS, (0.40, 0.10, 0.20, 0.10, 0.05, 0.15))),
    "high_vol": dict(zip(LEARNERS, (0.25, 0.35, 0.15, 0.05, 0.05, 0.15))),
}
SPLITS = {"train": ("2024-01-01 00:00:00", "2024-01-20 23:59:59"), "validation": ("2024-01-21 00:00:00", "2024-01-25 23:59:59"), "test": ("2024-01-26 00:00:00", "2024-01-30 23:59:59")}
FOLD_YEARS, FIRST_YEAR = [1998, 1999, 2000, 2001], 1995


def m15(spark: SparkSession, d: str, by=()) -> DataFrame:
    return bars.tick_bars(table(spark, d, "events"), "15 minutes", by)


def h1(spark: SparkSession, d: str, by=()) -> DataFrame:
    return bars.tick_bars(table(spark, d, "events"), "1 hour", by)


def d1(spark: SparkSession, d: str, by=()) -> DataFrame:
    return bars.tick_bars(table(spark, d, "events"), "1 day", by)


def _made_spread(bar):
    """The spread that tick_bars makes of the number of ticks."""
    return {"spread": (bar["tickvol"] % 3).cast("int")}


def aligned(spark: SparkSession, d: str, by=()) -> DataFrame:
    return align.rolled_up(m15(spark, d, by), by, _made_spread).drop(BLOCK)


def m15_featured(spark: SparkSession, d: str, by=()) -> DataFrame:
    return features.m15_features(m15(spark, d, by).withColumnsRenamed({c: f"{c}_x" for c in align.BAR}), by)


def featured(spark: SparkSession, d: str, by=()) -> DataFrame:
    return features.rolled_up_features(m15(spark, d, by), by, _made_spread)


def labelled(spark: SparkSession, d: str, by=()) -> DataFrame:
    return labels.learning_target(m15(spark, d, by), threshold=THRESHOLD, by=by)


def days(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars of orders."""
    return bars.ohlc_bars(table(spark, d, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_orderkey"), F.col("o_totalprice").alias("value")), "1 day").select("timestamp", "high", "low", "tickvol")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Labelled bars with made-up probabilities of six learners, exact in any engine."""
    return predicted(labelled(spark, d))


def predicted(rows: DataFrame) -> DataFrame:
    s = lambda k, j: (1 + (F.col("tickvol") * (k + 3) + F.minute("timestamp") + 7 * j * (k + 1)) % 11).cast("double")
    made = {f"{n}_{side}": s(k, j) / (s(k, 0) + s(k, 1) + s(k, 2)) for k, n in enumerate(LEARNERS) for j, side in enumerate(SIDES)}
    return rows.select("timestamp", "target", *[v.alias(c) for c, v in made.items()])


def context(spark: SparkSession, d: str, by=()) -> DataFrame:
    return trading.price_context(m15(spark, d, by), by=by)


def ensembled(spark: SparkSession, d: str) -> DataFrame:
    """Predictions with price context, regime, ensemble and scaled forward return. The bars and their context are read
    several times over, so each is computed once."""
    bars = settled(m15(spark, d))
    made = predicted(labels.learning_target(bars, threshold=THRESHOLD))
    rows = settled(trading.attach_price_context(made, trading.price_context(bars)).where("vol_16 is not null"))
    rows = ensemble.combine(ensemble.assign_regimes(rows, ensemble.regime_thresholds(rows)), WEIGHTS)
    return rows.withColumn("forward_return_1", F.col("forward_return_1") * SCALE)


def _bars_sql(name: str, every: str, by: str = "") -> str:
    key, group = (f"{by}, ", ", 2") if by else ("", "")
    return f"""{name} AS (SELECT {key}time_bucket(INTERVAL '{every}', ts) AS "timestamp", arg_min(value, ts) AS open, max(value) AS high,
      min(value) AS low, arg_max(value, ts) AS close, count(*)::BIGINT AS tickvol, 0::BIGINT AS vol, (count(*) % 3)::INTEGER AS spread FROM events GROUP BY 1{group})"""


M15, H1, D1 = _bars_sql("m15", "15 minutes"), _bars_sql("h1", "1 hour"), _bars_sql("d1", "1 day")
M15S, H1S, D1S = (_bars_sql(n, e, "event_type") for n, e in (("m15", "15 minutes"), ("h1", "1 hour"), ("d1", "1 day")))
BAR = align.BAR


def aligned_sql(by: str = "") -> str:
    """CTEs up to `aligned`."""
    key, part, same, both = (f"m.{by}, ", f"{by}, ", f"m.{by} = h.{by} AND ", f"m.{by} = d.{by} AND ") if by else ("", "", "", "")
    partial = lambda p: ", ".join([f"first_value(open) OVER {p} AS {p}_partial_open, max(high) OVER {p} AS {p}_partial_high, min(low) OVER {p} AS {p}_partial_low, last_value(close) OVER {p} AS {p}_partial_close, (sum(tickvol) OVER {p})::BIGINT AS {p}_partial_tickvol, last_value(\"timestamp\") OVER {p} AS {p}_partial_last_m15_timestamp"])
    window = lambda p, period: f"{p} AS (PARTITION BY {part}date_trunc('{period}', \"timestamp\") ORDER BY \"timestamp\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    first = ", ".join([M15S, H1S, D1S] if by else [M15, H1, D1])
    x = ", ".join(f"m.{c} AS {c}_x" for c in BAR)
    completed = lambda a, p: ", ".join(f'{a}.{c} AS {p}_completed_{c}' for c in ["timestamp", *BAR])
    state = ", ".join(f"m.{p}_partial_{c}" for p in ("h1", "d1") for c in ("period", "open", "high", "low", "close", "tickvol", "last_m15_timestamp"))
    return f"""{first}, m AS (SELECT *, date_trunc('hour', "timestamp")::TIMESTAMP AS h1_partial_period, date_trunc('day', "timestamp")::TIMESTAMP AS d1_partial_period,
      {partial("h1")}, {partial("d1")} FROM m15 WINDOW {window("h1", "hour")}, {window("d1", "day")}),
    aligned AS (SELECT {key}m."timestamp", {x}, {state}, {completed("h", "h1")}, CAST(CAST(d."timestamp" AS DATE) AS VARCHAR) AS d1_completed_date, {completed("d", "d1")}
      FROM m ASOF LEFT JOIN h1 h ON {same}m."timestamp" > h."timestamp" ASOF LEFT JOIN (SELECT *, CAST("timestamp" AS DATE) AS dt FROM d1) d ON {both}CAST(m."timestamp" AS DATE) > d.dt)"""


def features_sql(by: str = "") -> str:
    """CTEs up to `features`."""
    part = f"PARTITION BY {by} " if by else ""
    lag = lambda c, n=1: f'lag({c}, {n}) OVER ({part}ORDER BY "timestamp")'
    ratio = lambda a, b: f"{a} / nullif({b}, 0) - 1"
    safe = lambda a, b: f"({a}) / (abs({b}) + 1e-12)"
    roll = lambda agg, c, n: f'CASE WHEN count({c}) OVER ({part}ORDER BY "timestamp" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= {n} THEN {agg}({c}) OVER ({part}ORDER BY "timestamp" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END'
    body = lambda p, o, h, l, c: f"{h} - {l} AS {p}_range, {c} - {o} AS {p}_body, abs({c} - {o}) AS {p}_body_abs, {h} - CASE WHEN {o} IS NULL OR {c} IS NULL THEN NULL ELSE greatest({o}, {c}) END AS {p}_upper_wick, CASE WHEN {o} IS NULL OR {c} IS NULL THEN NULL ELSE least({o}, {c}) END - {l} AS {p}_lower_wick"  # noqa: E731, E741
    partial = lambda p: body(f"{p}_partial", *[f"{p}_partial_{c}" for c in ("open", "high", "low", "close")])
    return f"""{aligned_sql(by)},
    f1 AS (SELECT *, {", ".join(f"{ratio('close_x', lag('close_x', n))} AS m15_return_{n}" for n in (1, 4, 16))},
      CASE WHEN close_x / nullif({lag('close_x')}, 0) > 0 THEN ln(close_x / nullif({lag('close_x')}, 0)) END AS m15_log_return_1,
      {body("m15", "open_x", "high_x", "low_x", "close_x")}, close_x - {lag('close_x', 4)} AS m15_momentum_4, close_x - {lag('close_x', 16)} AS m15_momentum_16,
      {partial("h1")}, {partial("d1")}, {ratio('h1_completed_close', lag('h1_completed_close'))} AS h1_return_1,
      {ratio('h1_completed_close', 'h1_completed_open')} AS h1_completed_return, {safe('close_x - h1_completed_close', 'h1_completed_close')} AS m15_to_h1_close_distance,
      {ratio('d1_completed_close', 'd1_completed_open')} AS d1_completed_return, {safe('close_x - d1_completed_close', 'd1_completed_close')} AS m15_to_d1_close_distance FROM aligned),
    features AS (SELECT *, {safe('m15_body_abs', 'm15_range')} AS m15_body_range_ratio, {safe('m15_upper_wick', 'm15_range')} AS m15_upper_wick_ratio, {safe('m15_lower_wick', 'm15_range')} AS m15_lower_wick_ratio,
      {roll('avg', 'm15_range', 4)} AS m15_range_mean_4, {roll('avg', 'm15_range', 16)} AS m15_range_mean_16, {roll('stddev_samp', 'm15_return_1', 16)} AS m15_return_std_16,
      {safe('h1_partial_body_abs', 'h1_partial_range')} AS h1_partial_body_range_ratio, {safe('d1_partial_body_abs', 'd1_partial_range')} AS d1_partial_body_range_ratio,
      (sign(m15_return_1) * sign(h1_completed_return))::DOUBLE AS mtf_m15_h1_alignment, (sign(m15_return_1) * sign(d1_completed_return))::DOUBLE AS mtf_m15_d1_alignment, (sign(h1_completed_return) * sign(d1_completed_return))::DOUBLE AS mtf_h1_d1_alignment,
      coalesce(sign(m15_return_1) = sign(h1_completed_return) AND sign(h1_completed_return) = sign(d1_completed_return) AND sign(m15_return_1) <> 0, false)::INTEGER AS mtf_all_direction_agreement,
      {safe('close_x - h1_partial_low', 'h1_partial_range')} AS m15_position_in_h1_range, {safe('close_x - d1_partial_low', 'd1_partial_range')} AS m15_position_in_d1_range FROM f1)"""


def label_sql(source: str = "m15", by: str = "") -> str:
    """A CTE `labelled` over bars."""
    part = f"PARTITION BY {by} " if by else ""
    return f"""l0 AS (SELECT *, lead(close) OVER ({part}ORDER BY "timestamp") AS future_close FROM {source}),
    l1 AS (SELECT *, future_close / nullif(close, 0) - 1 AS future_return FROM l0),
    labelled AS (SELECT *, CASE WHEN future_return > {THRESHOLD} THEN 1 WHEN future_return < -{THRESHOLD} THEN -1 ELSE 0 END AS target,
      CASE WHEN future_return > {THRESHOLD} THEN 'UP' WHEN future_return < -{THRESHOLD} THEN 'DOWN' ELSE 'NEUTRAL' END AS target_label FROM l1 WHERE future_close IS NOT NULL AND future_return IS NOT NULL)"""


def prediction_sql() -> str:
    """CTEs up to `predictions`."""
    s = lambda k, j: f'(1 + (tickvol * {k + 3} + minute("timestamp") + {7 * j * (k + 1)}) % 11)::DOUBLE'
    made = ", ".join(f"{s(k, j)} / ({s(k, 0)} + {s(k, 1)} + {s(k, 2)}) AS {n}_{side}" for k, n in enumerate(LEARNERS) for j, side in enumerate(SIDES))
    return f'{M15}, {label_sql()}, predictions AS (SELECT "timestamp", target, {made} FROM labelled)'


CONTEXT_SQL = """c0 AS (SELECT "timestamp", close AS close_x, close / nullif(lag(close) OVER w, 0) - 1 AS r, lead(close) OVER w / nullif(close, 0) - 1 AS forward_return_1, lead("timestamp") OVER w AS next_timestamp FROM m15 WINDOW w AS (ORDER BY "timestamp")),
    context AS (SELECT "timestamp", close_x, CASE WHEN count(r) OVER w >= 16 THEN stddev_samp(r) OVER w END AS vol_16, forward_return_1, next_timestamp FROM c0 WINDOW w AS (ORDER BY "timestamp" ROWS BETWEEN 15 PRECEDING AND CURRENT ROW))"""


def ensemble_sql() -> str:
    """CTEs up to `ensembled`."""
    weight = lambda k: "CASE regime " + " ".join(f"WHEN '{r}' THEN {own[k]}::DOUBLE" for r, own in WEIGHTS.items()) + " END"
    total = lambda side: " + ".join(["0.0::DOUBLE", *[f"({weight(k)}) * {k}_{side}" for k in LEARNERS]])
    return f"""{prediction_sql()}, {CONTEXT_SQL},
    attached AS (SELECT p.*, c.close_x, c.vol_16, c.forward_return_1, c.next_timestamp FROM predictions p LEFT JOIN context c USING ("timestamp") WHERE c.vol_16 IS NOT NULL),
    thresholds AS (SELECT quantile_cont(vol_16, 1.0::DOUBLE / 3) AS q33, quantile_cont(vol_16, 2.0::DOUBLE / 3) AS q67 FROM attached),
    regimes AS (SELECT a.*, CASE WHEN vol_16 <= q33 THEN 'low_vol' WHEN vol_16 <= q67 THEN 'medium_vol' ELSE 'high_vol' END AS regime FROM attached a CROSS JOIN thresholds),
    e0 AS (SELECT * REPLACE (forward_return_1 * {SCALE} AS forward_return_1), {", ".join(f"{total(s)} AS ensemble_{s}" for s in SIDES)} FROM regimes),
    ensembled AS (SELECT *, CASE WHEN ensemble_down >= ensemble_neutral AND ensemble_down >= ensemble_up THEN -1 WHEN ensemble_neutral >= ensemble_up THEN 0 ELSE 1 END AS predicted_class FROM e0)"""


def trading_sql(source: str = "ensembled", position: str = "predicted_class", rate: str = "0.0", by: str = "") -> str:
    """CTEs `t0` to `traded` over a frame with forward_return_1."""
    part, keep = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    w, grown = f'({part}ORDER BY "timestamp")', f'({part}ORDER BY "timestamp" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)'
    return f"""t0 AS (SELECT {keep}"timestamp", ({position})::DOUBLE AS position, forward_return_1 AS forward_return FROM {source} WHERE forward_return_1 IS NOT NULL),
    t1 AS (SELECT *, abs(position - coalesce(lag(position) OVER {w}, 0)) AS position_change, position * forward_return AS gross_return FROM t0),
    t2 AS (SELECT *, ({rate})::DOUBLE * position_change AS cost, gross_return - ({rate})::DOUBLE * position_change AS net_return FROM t1),
    t3 AS (SELECT *, product(1 + gross_return) OVER {grown} AS gross_equity, product(1 + net_return) OVER {grown} AS net_equity FROM t2),
    traded AS (SELECT *, gross_equity / nullif(max(gross_equity) OVER {grown}, 0) - 1 AS gross_drawdown, net_equity / nullif(max(net_equity) OVER {grown}, 0) - 1 AS net_drawdown FROM t3)"""


DAYS = """days AS (SELECT time_bucket(INTERVAL '1 day', o_orderdate) AS "timestamp", max(o_totalprice) AS high, min(o_totalprice) AS low, count(*)::BIGINT AS tickvol FROM orders GROUP BY 1)"""
