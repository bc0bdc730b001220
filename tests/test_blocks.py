"""Series cut into blocks give what the whole series gives, and no task holds a symbol."""

import re
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom import sources
from barloom.functions import settled
from barloom.operators import align, checks, features, labels, quality, splits, trading

QUARTER = timedelta(minutes=15)


def _series(rng, start, n, step=QUARTER, gaps=0.1):
    times = [start + i * step for i in range(n) if rng.random() > gaps]
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, len(times))))
    open_ = np.r_[100, close[:-1]]
    return pd.DataFrame({"timestamp": times, "open": open_, "high": np.maximum(open_, close) * 1.002, "low": np.minimum(open_, close) * 0.997, "close": close, "tickvol": rng.integers(1, 50, len(times)), "vol": rng.integers(0, 9, len(times)), "spread": rng.integers(0, 4, len(times))})


@pytest.fixture(scope="module")
def skewed():
    """Three symbols over some months; one has most of the rows, one a few bars far apart."""
    rng = np.random.default_rng(11)
    parts = {"big": _series(rng, datetime(2023, 12, 20), 7000), "small": _series(rng, datetime(2024, 1, 3, 7, 15), 500), "rare": _series(rng, datetime(2024, 1, 1), 12, timedelta(days=17), 0)}
    return pd.concat([p.assign(symbol=k) for k, p in parts.items()], ignore_index=True)


def _frame(spark, pandas):
    return spark.createDataFrame(pandas).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).repartition(4)


def _windows(df):
    """What the windows of the plan are partitioned by."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [re.sub(r"#\d+L?", "", m) for m in re.findall(r"Window \[.*?\], \[(.*?)\], \[", plan)]


def test_asof_inside_a_large_symbol(spark, skewed):
    assert (skewed["symbol"] == "big").mean() > 0.9
    hours = skewed.set_index("timestamp").groupby("symbol").resample("1h").agg({"open": "first", "high": "max", "low": "min", "close": "last", "tickvol": "sum", "vol": "sum", "spread": "last"}).dropna(subset=["open"]).reset_index()
    got = align.completed_context(_frame(spark, skewed), _frame(spark, hours.astype({"tickvol": "int64"})), "r_", ["symbol"])
    want = pd.merge_asof(skewed.sort_values("timestamp"), hours[["symbol", "timestamp", "close"]].rename(columns={"close": "r_close", "timestamp": "at"}).sort_values("at"), left_on="timestamp", right_on="at", by="symbol", allow_exact_matches=False)
    key = ["symbol", "timestamp"]
    a, b = got.toPandas().sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True)
    pd.testing.assert_series_equal(a["r_close"], b["r_close"], check_names=False)
    rows = [w for w in _windows(got) if "_block" in w]
    assert rows and all("symbol" in w for w in rows)
    for w in _windows(got):  # a window over a symbol alone sees one row a block
        assert "_block" in w or w == "symbol"


def test_rows_without_a_symbol_are_a_series(spark, skewed):
    key = ["symbol", "timestamp"]
    plain = features.rolled_up_features(_frame(spark, skewed), ["symbol"]).toPandas().sort_values(key).reset_index(drop=True)
    lost = _frame(spark, skewed).withColumn("symbol", F.when(F.col("symbol") != "big", F.col("symbol")))
    other = features.rolled_up_features(lost, ["symbol"]).fillna("big", ["symbol"]).toPandas().sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(plain, other[plain.columns])


def test_roll_up_equals_contexts_of_separate_bars(spark, skewed):
    bars = {rule: skewed.set_index("timestamp").groupby("symbol").resample(rule).agg({"open": "first", "high": "max", "low": "min", "close": "last", "tickvol": "sum", "vol": "sum", "spread": "last"}).dropna(subset=["open"]).reset_index().astype({"tickvol": "int64", "vol": "int64", "spread": "int64"}) for rule in ("1h", "1D")}
    m15 = _frame(spark, skewed)
    want = align.align_timeframes(m15, _frame(spark, bars["1h"]), _frame(spark, bars["1D"]), ["symbol"])
    got = align.rolled_up(m15, ["symbol"]).drop("_block")
    assert sorted(got.columns) == sorted(want.columns)
    key = ["symbol", "timestamp"]
    a, b = (x.select(*sorted(want.columns)).toPandas().sort_values(key).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("SortMergeJoin|ShuffledHashJoin|BroadcastHashJoin", plan)) == 1  # the carried row of a block


def test_features_of_the_roll_up(spark, skewed):
    m15 = _frame(spark, skewed)
    names = {c: f"{c}_x" for c in align.BAR}
    got = features.rolled_up_features(m15, ["symbol"])
    want = features.all_features(align.rolled_up(m15, ["symbol"]).drop("_block"), ["symbol"]).drop("h1_bar_return_1")
    key = ["symbol", "timestamp"]
    a, b = (x.select(*sorted(want.columns)).toPandas().sort_values(key).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
    big = skewed[skewed["symbol"] == "big"].reset_index(drop=True)
    own = features.m15_features(m15.withColumnsRenamed(names), ["symbol"]).where("symbol = 'big'").orderBy("timestamp").toPandas()
    np.testing.assert_allclose(own["m15_return_std_16"].astype(float), big["close"].pct_change().rolling(16).std(), rtol=1e-9)
    np.testing.assert_allclose(own["m15_return_16"].astype(float), big["close"].pct_change(16), rtol=1e-9)
    rare = a[a["symbol"] == "rare"]["h1_return_1"]  # every bar a block of its own
    closes = skewed[skewed["symbol"] == "rare"].sort_values("timestamp")["close"].to_numpy()
    np.testing.assert_allclose(rare.to_numpy()[2:].astype(float), closes[1:-1] / closes[:-2] - 1, rtol=1e-9)


def test_labels_and_context_by_symbol(spark, skewed):
    got = labels.learning_target(_frame(spark, skewed), by=["symbol"], horizon=3).toPandas().sort_values(["symbol", "timestamp"])
    want = skewed.sort_values(["symbol", "timestamp"]).assign(future=lambda x: x.groupby("symbol")["close"].shift(-3)).dropna(subset=["future"])
    np.testing.assert_allclose(got["future_close"], want["future"])
    context = trading.price_context(_frame(spark, skewed), by=["symbol"]).toPandas().sort_values(["symbol", "timestamp"])
    forward = skewed.sort_values(["symbol", "timestamp"]).groupby("symbol")["close"].pct_change().groupby(skewed.sort_values(["symbol", "timestamp"])["symbol"]).shift(-1)
    np.testing.assert_allclose(context["forward_return_1"].astype(float), forward, rtol=1e-9)


@pytest.mark.parametrize("wild", [False, True])
def test_equity_folded_over_blocks(spark, wild):
    """Also where a bar loses more than everything, so that equity turns negative."""
    rng = np.random.default_rng(3)
    rows = []
    for key in ("a", "b", None):
        for i in range(400):
            r = float(rng.normal(0, 0.9 if wild else 0.02))
            rows.append((key, datetime(2024, 1, 1) + i * timedelta(hours=11), float(rng.integers(-1, 2)), None if i % 50 == 7 else r))
    df = spark.createDataFrame(rows, "k string, timestamp timestamp_ntz, p double, forward_return_1 double").repartition(3)
    rate = 0.001
    got = trading.evaluated(df, "p", ["k"], rate).toPandas().sort_values(["k", "timestamp"])
    for key in ("a", "b", None):
        own, held, gross, net, tops = got[got["k"].isna() if key is None else got["k"] == key], 0.0, 1.0, 1.0, [-np.inf, -np.inf]
        for (_, _, p, r), x in zip([q for q in rows if q[0] == key and q[3] is not None], own.itertuples()):
            change, held = abs(p - held), p
            gross, net = gross * (1 + p * r), net * (1 + p * r - rate * change)
            tops = [max(tops[0], gross), max(tops[1], net)]
            assert (x.position_change, x.gross_equity, x.net_equity) == pytest.approx((change, gross, net), rel=1e-9)
            assert (x.gross_drawdown, x.net_drawdown) == pytest.approx(((gross - tops[0]) / tops[0], (net - tops[1]) / tops[1]), rel=1e-8, abs=1e-9)
    assert all("_block" in w or w == "k" for w in _windows(trading.evaluated(df, "p", ["k"])))


def test_costs_of_strategies(spark):
    rows = [(datetime(2024, 1, 1) + i * timedelta(hours=9), float(i % 3 - 1), 0.01 * ((i * 7) % 5 - 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, predicted_class double, forward_return_1 double")
    got = {(r.strategy, r.scenario): r for r in trading.strategy_costs(df).collect()}
    alone = {r.scenario: r for r in trading.cost_scenarios(df).collect()}
    assert len(got) == 12 and all(got["strategy", n].net_equity == pytest.approx(r.net_equity) for n, r in alone.items())
    assert all(got["flat", n].net_equity == 1.0 for n in alone) and got["buy_hold", "high_cost"].total_cost == pytest.approx(0.002) and got["buy_hold", "zero_cost"].position_changes == 1


def test_last_boundary(spark):
    days = spark.createDataFrame([(datetime(2000, 1, 1) + timedelta(days=i),) for i in range(4 * 366)], "timestamp timestamp_ntz")
    audit = splits.purge_audit(splits.PurgedWalkForwardSplitter([2001, 2002], 2000, horizon_bars=2).with_test_boundary(days, 2003))
    assert [(r.fold, r.purged_bars, r.clean) for r in audit.orderBy("fold").collect()] == [(1, 2, True), (2, 2, True), (3, 2, True)]
    total = splits.boundary_totals(audit).first()
    assert (total.boundaries, total.purged_bars, total.purge_required, total.no_embargo, total.all_clean) == (3, 6, True, True, True)


def test_settled_is_read_from_the_shared_folder(spark):
    rows = settled(spark.range(100).withColumn("x", F.rand()))
    assert rows.agg(F.sum("x")).first() == rows.agg(F.sum("x")).first() and "ExistingRDD" in rows._jdf.queryExecution().executedPlan().toString()


def test_checks_ride_on_the_write(spark, skewed, tmp_path):
    bars = _frame(spark, skewed)
    bad = bars.unionByName(bars.where("symbol = 'rare'")).withColumn("low", F.when(F.col("tickvol") == 7, F.col("high") + 1).otherwise(F.col("low")))
    wanted = [*checks.row_checks(), *checks.series_checks(), *checks.bar_checks(), *checks.feature_checks(["close", "low"])]
    found = {r.check: r for r in checks.write_checked(bad, f"{tmp_path}/bars.parquet", wanted, ["symbol"]).collect()}
    taken = {}
    for name, write in (("plain", lambda: sources.write_table(bars, f"{tmp_path}/plain.parquet")), ("checked", lambda: checks.write_checked(bars, f"{tmp_path}/checked.parquet", checks.bar_checks()))):
        spark.sparkContext.setJobGroup(name, name)
        write()
        taken[name] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setJobGroup("after", "after")
    assert taken["checked"] == taken["plain"]  # no job more
    written = spark.read.parquet(f"{tmp_path}/bars.parquet")
    manifest = quality.data_manifest(written, "m").first()
    assert sorted(written.columns) == sorted(bars.columns) and manifest.bars == found["bars"].value == bad.count()
    assert all(found[n].value == manifest[n] for n in ("invalid_ohlc", "tickvol_not_positive", "negative_vol", "negative_spread", "zero_spread"))
    assert found["duplicate_timestamps"].value == 12 and not found["duplicate_timestamps"].passed and not found["invalid_ohlc"].passed and found["negative_vol"].passed
    with pytest.raises(ValueError, match="invalid_ohlc"):
        checks.write_checked(bad, f"{tmp_path}/again.parquet", checks.bar_checks(), stop=True)
    made = labels.learning_target(bars, by=["symbol"])
    verdict = {r.check: r.value for r in checks.write_checked(made, f"{tmp_path}/labels.parquet", checks.label_checks()).collect()}
    report = labels.target_validation(made).first()
    assert verdict["wrong_classes"] == report.wrong_classes == 0 and verdict["null_returns"] == report.null_returns and verdict["max_error"] == pytest.approx(report.max_error)


def _below(plan):
    """Each exchange of a plan with the lines under it."""
    lines = plan.splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-*0123456789()"))
    for i, line in enumerate(lines):
        if "Exchange" in line and "Reused" not in line:
            under = []
            for x in lines[i + 1 :]:
                if depth(x) <= depth(line):
                    break
                under.append(x)
            yield line, under


def test_stored_series_are_aligned_without_an_exchange_of_rows(spark, skewed):
    bars = _frame(spark, skewed)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan as it is run
    try:
        sources.write_series(bars, "stored_bars", ["symbol"], 4)
        stored = sources.read_series(spark, "stored_bars")
        got = align.rolled_up(stored, ["symbol"])
        plan = got._jdf.queryExecution().executedPlan().toString()
        found = list(_below(plan))
        assert found and all(any("Aggregate" in x for x in under) for _, under in found)  # only the row of a block moves
        want = align.rolled_up(bars, ["symbol"])
        a, b = (x.drop("_block").toPandas().sort_values(["symbol", "timestamp"]).reset_index(drop=True) for x in (got, want))
        pd.testing.assert_frame_equal(a[b.columns], b, check_dtype=False)
        year = sources.read_series(spark, "stored_bars", years=[2023])
        scan = year._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^]]*_year#\d+ (=|IN)", scan) and year.count() == sum(t.year == 2023 for t in skewed["timestamp"])
        span = sources.read_series(spark, "stored_bars", start="2024-02-01 00:00:00", end="2024-02-10 12:00:00")
        assert "_year" in re.search(r"PartitionFilters: \[([^]]*)\]", span._jdf.queryExecution().executedPlan().toString())[1]
        assert span.count() == ((skewed["timestamp"] >= "2024-02-01") & (skewed["timestamp"] <= "2024-02-10 12:00")).sum()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sql("DROP TABLE IF EXISTS stored_bars")
