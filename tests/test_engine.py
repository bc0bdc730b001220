"""Operators of the time-series engine on small frames, against hand-made numbers and pandas."""

import json
import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom import audit_cli, sources, streaming
from barloom.functions import argmax_class, both_max, change, exact_percentiles, finite, safe_divide
from barloom.operators.boosting import Boosting
from barloom.operators import align, bars, ensemble, features, labels, learners, metrics, optimize, profile, quality, splits, trading, tree_text

T0 = datetime(2024, 1, 1)
QUARTER = timedelta(minutes=15)


def at(n, step=QUARTER):
    return T0 + n * step


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(4)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 300)))
    open_ = np.r_[100, close[:-1]]
    times = [at(n) for n in range(320) if n % 17 != 5][:300]
    return pd.DataFrame({"timestamp": times, "open": open_, "high": np.maximum(open_, close) * 1.002, "low": np.minimum(open_, close) * 0.997, "close": close, "tickvol": rng.integers(1, 50, 300), "vol": 0, "spread": 1})


@pytest.fixture(scope="module")
def m15(spark, series):
    return spark.createDataFrame(series).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).repartition(3)


def resample(frame, rule):
    out = frame.set_index("timestamp").resample(rule).agg({"open": "first", "high": "max", "low": "min", "close": "last", "tickvol": "sum", "vol": "sum", "spread": "last"})
    return out.dropna(subset=["open"]).reset_index()


@pytest.fixture(scope="module")
def higher(spark, series):
    return [spark.createDataFrame(resample(series, r)).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")) for r in ("1h", "1D")]


def test_functions(spark):
    row = spark.sql("SELECT 1.0D a, 0.0D z, CAST(NULL AS DOUBLE) n, double('nan') q, double('inf') i").select(
        safe_divide(F.col("a"), F.col("z")).alias("s"), change(F.col("a"), F.col("z")).alias("c"), both_max(F.col("a"), F.col("n")).alias("m"), finite(F.col("q")).alias("f"), finite(F.col("i")).alias("g"),
        argmax_class([F.lit(0.4), F.lit(0.4), F.lit(0.2)], (-1, 0, 1)).alias("k"),
    ).first()
    assert row.s == pytest.approx(1e12) and row.c is None and row.m is None and row.f is None and row.g is None and row.k == -1


def test_raw_bars(spark, tmp_path):
    (tmp_path / "m15.csv").write_text("<DATE>\t<TIME>\t<OPEN>\t<HIGH>\t<LOW>\t<CLOSE>\t<TICKVOL>\t<VOL>\t<SPREAD>\n2024.01.02\t09:00:00\t1.5\t2\t1\t1.75\t10\t0\t3\n2024.01.02\t09:15:00\t1.75\t2\t1\t1.5\t11\t0\t2\n")
    (tmp_path / "other.txt").write_text("x\n")
    raw = sources.read_raw_bars(spark, str(tmp_path))
    assert raw.columns[:3] == ["date", "time", "open"] and raw.select("file_size").first()[0] > 100
    made = bars.standardize(raw)
    assert [f.dataType for f in made.schema][:8] == [f.dataType for f in sources.BAR]
    rows = made.orderBy("timestamp").collect()
    assert rows[0].timestamp == datetime(2024, 1, 2, 9) and rows[1].close == 1.5
    report = quality.timestamp_quality(made, "ordinal").first()
    assert report.monotonic and report.duplicate_timestamps == 0
    daily = spark.createDataFrame([("2024.01.02", "1", "2", "1", "2", "5", "0", "1")], "date string, open string, high string, low string, close string, tickvol string, vol string, spread string")
    assert bars.standardize(daily).first().timestamp == datetime(2024, 1, 2)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        bars.standardize(daily.withColumn("open", F.lit("x"))).collect()
    with pytest.raises(FileNotFoundError):
        sources.read_raw_bars(spark, str(tmp_path), "*.none")
    with pytest.raises(ValueError):
        sources.require_columns(daily, ["nope"])


def test_tables_and_artifacts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    for name in ("x.csv", "x.parquet", "x.tsv"):
        sources.write_table(df, f"{tmp_path}/{name}") if not name.endswith("tsv") else df.write.option("header", True).option("sep", "\t").csv(f"{tmp_path}/{name}")
        assert sources.read_table(spark, f"{tmp_path}/{name}", df.schema).collect() == df.collect()
    with pytest.raises(ValueError):
        sources.read_table(spark, "x.unknown")
    (tmp_path / "w.json").write_text(json.dumps({"low_vol": {"m15_lr": 0.25}}))
    assert sources.read_weights(spark, f"{tmp_path}/w.json").first().weight == 0.25
    sources.write_report(df, f"{tmp_path}/report")
    assert json.loads(spark.read.text(f"{tmp_path}/report").first()[0]) == {"k": 1, "v": "a"}


def test_quality_reports(spark):
    rows = [(at(0), 1.0, 2.0, 0.5, 1.5, 3), (at(1), 1.0, 0.9, 0.5, 1.5, 0), (at(5), 0.0, 2.0, 0.0, 1.5, 1), (at(5), 1.0, 2.0, 0.5, 1.5, -1)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, open double, high double, low double, close double, tickvol long").withColumns({"vol": F.lit(0), "spread": F.lit(1)})
    assert quality.ohlc_validity(df).first().invalid == 2
    assert quality.volume_spread_quality(df).first().negative_tickvol == 1
    gap = quality.gap_analysis(df, 900).collect()
    assert [(g.seconds, g.missing_bars) for g in gap] == [(3600, 3)]
    assert quality.gap_totals(df, 900).first().missing_bars == 3
    assert quality.interval_mode(df).first().mode_seconds == 0  # lowest of three single steps
    assert quality.data_manifest(df, "m15").first().duplicate_timestamps == 1
    profile_row = quality.raw_profile(df.drop("timestamp")).first()
    assert profile_row.row_count == 4 and profile_row.null_cells == 0


def test_asof_matches_pandas(spark, m15, higher, series):
    want = pd.merge_asof(series, resample(series, "1h").add_prefix("r_"), left_on="timestamp", right_on="r_timestamp", allow_exact_matches=False)
    got = align.completed_context(m15, higher[0], "r_").orderBy("timestamp").toPandas()
    pd.testing.assert_series_equal(got["r_close"], want["r_close"])
    assert pd.isna(got["r_close"][0])
    plan = align.completed_context(m15, higher[0], "r_")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_asof_ties_and_directions(spark):
    left = spark.createDataFrame([("a", at(0)), ("a", at(1)), ("a", at(2)), ("b", at(1))], "s string, timestamp timestamp_ntz")
    right = spark.createDataFrame([("a", at(1), 1), ("a", at(2), 2), ("b", at(3), 3)], "s string, timestamp timestamp_ntz, v int")
    value = lambda df: [r.ctx.v if r.ctx else None for r in df.orderBy("s", "timestamp").collect()]
    assert value(align.asof_backward(left, right, by=["s"])) == [None, None, 1, None]
    assert value(align.asof_backward(left, right, by=["s"], ties=True)) == [None, 1, 2, None]
    assert value(align.asof_forward(left, right, by=["s"])) == [1, 2, None, 3]
    assert value(align.asof_forward(left, right, by=["s"], ties=True)) == [1, 1, 2, 3]
    with pytest.raises(ValueError):
        align.completed_context(left, right, "x_", availability="no")


def test_partial_state_matches_pandas(m15, series):
    got = align.partial_state(m15, "hour", "p_").orderBy("timestamp").toPandas()
    hour = series["timestamp"].dt.floor("h")
    group = series.groupby(hour)
    for column, cumulated in (("high", group["high"].cummax()), ("low", group["low"].cummin()), ("tickvol", group["tickvol"].cumsum()), ("close", series["close"])):
        want = cumulated.shift(1).where(hour == hour.shift(1))
        np.testing.assert_allclose(got[f"p_{column}"].astype(float), want.astype(float))
    assert got["p_open"].isna().sum() == hour.nunique()


def test_features_match_pandas_and_never_look_ahead(spark, m15, higher, series):
    aligned = align.assert_causal(align.align_timeframes(m15, *higher, availability="close", repeat_m15=True))
    assert "close_y" in aligned.columns
    full = features.all_features(aligned).orderBy("timestamp").toPandas()
    r = series["close"].pct_change()
    np.testing.assert_allclose(full["m15_return_std_16"].astype(float), r.rolling(16).std(), rtol=1e-9)
    np.testing.assert_allclose(full["m15_range_mean_4"].astype(float), (series["high"] - series["low"]).rolling(4).mean(), rtol=1e-9)
    cut = 200
    bent = series.copy()
    bent.loc[cut + 1 :, ["open", "high", "low", "close"]] *= 3
    frame = lambda p: spark.createDataFrame(p).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    again = features.all_features(align.align_timeframes(frame(bent), frame(resample(bent, "1h")), frame(resample(bent, "1D")), availability="close")).orderBy("timestamp").toPandas()
    for c in profile.feature_columns(spark.createDataFrame([], aligned.schema)) + ["m15_return_1", "mtf_all_direction_agreement"]:
        assert full[c][: cut + 1].equals(again[c][: cut + 1]), c


def test_profile(spark):
    df = spark.createDataFrame([(at(0), 1.0, 1.0, None, 5), (at(1), 2.0, 2.0, 3.0, 5)], "timestamp timestamp_ntz, m15_a double, m15_b double, h1_c double, d1_d int")
    assert {(r.feature, r.nulls, r.percent) for r in profile.null_profile(df, ["m15_a", "h1_c"]).collect()} == {("m15_a", 0, 0.0), ("h1_c", 1, 50.0)}
    assert {r.feature for r in profile.constant_features(df, ["m15_a", "h1_c", "d1_d"]).where("constant = 1").collect()} == {"h1_c", "d1_d"}
    assert [tuple(r) for r in profile.duplicate_features(df, ["m15_a", "m15_b", "h1_c"]).collect()] == [("m15_a", "m15_b")]
    assert profile.feature_suite(df, ["m15_a"], 2).first().expected_rows
    assert profile.suspicious_names(df.withColumn("future_x", F.lit(1))) == ["future_x"]
    with pytest.raises(ValueError):
        profile.assert_complete(df, ["h1_c"])
    with pytest.raises(TypeError):
        profile.assert_numeric(df, ["timestamp"])


def test_labels(spark):
    close = [100.0, 100.025, 100.025 * 1.00025, 100.1, 0.0, 5.0]
    df = spark.createDataFrame([(at(i), c) for i, c in enumerate(close)], "timestamp timestamp_ntz, close double")
    rows = labels.learning_target(df, threshold=0.00025, drop_last=False).orderBy("timestamp").collect()
    assert [r.target for r in rows][2:] == [1, -1, 0, 0] and rows[4].future_return is None
    flat = spark.createDataFrame([(at(0), 4.0), (at(1), 5.0), (at(2), 4.0)], "timestamp timestamp_ntz, close double")
    assert [r.target for r in labels.learning_target(flat, threshold=0.25).orderBy("timestamp").collect()] == [0, 0 if 4 / 5 - 1 >= -0.25 else -1]  # exactly at the threshold: neutral
    kept = labels.learning_target(df, threshold=0.00025)
    assert kept.count() == 4 and labels.target_validation(kept).first().max_error == 0
    assert {(r.target_label, r.bars) for r in labels.target_distribution(kept.where("target = 1")).collect()} >= {("DOWN", 0)}


def test_walk_forward(spark):
    days = spark.createDataFrame([(datetime(y, m, d),) for y in range(2015, 2021) for m in range(1, 13) for d in (1, 15)], "timestamp timestamp_ntz")
    splitter = splits.PurgedWalkForwardSplitter([2018, 2019, 2020], 2015)
    folds = list(splitter.split(days))
    assert [f.purged_rows for _, _, f in folds] == [1, 1, 1] and [f.validation_rows for _, _, f in folds] == [24, 24, 24]
    for train, validation, fold in folds:
        assert train.agg(F.max("timestamp")).first()[0] < validation.agg(F.min("timestamp")).first()[0] and train.count() == fold.train_rows_after_purge
    assert splits.fold_rows([folds[0][2]])[0]["fold"] == 1
    wide = splits.PurgedWalkForwardSplitter([2018], 2015, horizon_bars=3, embargo_bars=2, allow_embargo=True).tagged(days)
    assert {r.role: r["count"] for r in wide.groupBy("role").count().collect()} == {"train": 67, "purged": 3, "embargoed": 2, "validation": 24}
    for bad in (dict(validation_years=[], first_train_year=2015), dict(validation_years=[2015], first_train_year=2015), dict(validation_years=[2018, 2018], first_train_year=2015), dict(validation_years=[2018], first_train_year=2015, horizon_bars=0), dict(validation_years=[2018], first_train_year=2015, embargo_bars=1)):
        with pytest.raises(ValueError):
            splits.PurgedWalkForwardSplitter(**bad)
    with pytest.raises(ValueError):
        splitter.validate(days.union(days))
    with pytest.raises(ValueError):
        splits.walk_forward_folds(days, [2016], 2015)
    purged = splits.temporal_split(days.withColumn("label_end", F.lead("timestamp").over(splits.in_order())), {"a": ("2015-01-01", "2015-12-31"), "b": ("2016-01-01", "2016-12-31")}, purge=True)
    assert purged.where("split = 'a'").count() == 23


def test_cost_model_golden_numbers(spark):
    rows = [(at(i), p, r) for i, (p, r) in enumerate(zip([1.0, 1.0, -1.0, 0.0], [0.01, -0.02, 0.01, 0.005]))]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, p double, forward_return_1 double")
    got = {r.scenario: r for r in trading.cost_scenarios(df, "p", {"free": 0.0, "dear": 0.001, "dearer": 0.002}).collect()}
    r = got["dear"]
    assert [x.position_change for x in trading.evaluated(df, "p").orderBy("timestamp").collect()] == [1, 0, 2, 1]
    assert (r.total_cost, r.gross_total_return, r.net_total_return) == pytest.approx((0.004, -0.020098, -0.02402279416))
    assert r.directional_bars == 3 and r.position_changes == 3
    assert got["free"].net_total_return == got["free"].gross_total_return and got["free"].total_cost == 0
    assert got["free"].net_total_return > r.net_total_return > got["dearer"].net_total_return
    trading.assert_costs_never_help(trading.cost_scenarios(df, "p"))
    empty = trading.cost_summary(trading.evaluated(df.limit(0), "p")).first()
    assert (empty.bars, empty.net_equity, empty.sharpe_net, empty.sharpe_annual) == (0, 1.0, 0.0, 0.0)
    flat = trading.equity_summary(trading.evaluated(df, F.lit(0.0))).first()
    assert (flat.total_return, flat.sharpe, flat.win_rate) == (0.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        trading.assert_prices_sane(df.withColumn("close_x", F.lit(1.0)))
    with pytest.raises(ValueError):
        trading.check_one_to_one(df.union(df), ["timestamp"])


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1, 0.1, 0.2, 0.7), (1, 0, 0.1, 0.6, 0.3), (0, 0, 0.2, 0.5, 0.3), (0, 0, 0.3, 0.4, 0.3)], "target int, predicted_class int, ensemble_down double, ensemble_neutral double, ensemble_up double")
    r = metrics.classification_report(df).first()
    assert r.accuracy == 0.75 and r.macro_f1 == pytest.approx((0 + 0.8 + 2 / 3) / 3)
    assert r.log_loss == pytest.approx(-np.mean(np.log([0.7, 0.3, 0.5, 0.4])))
    assert {(x.target, x.weight) for x in metrics.class_weights(df).collect()} == {(0, 1.0), (1, 1.0)}


def test_ensemble(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0, None)], "vol_16 double")
    q = ensemble.regime_thresholds(df)
    assert tuple(q.first()) == pytest.approx((2.0, 3.0))
    assert [r.regime for r in ensemble.assign_regimes(df, q).orderBy(F.col("vol_16").asc_nulls_last()).collect()] == ["low_vol", "low_vol", "medium_vol", "high_vol", None]
    w = spark.createDataFrame([([-1.0, 1.0, 3.0],), ([0.0, 0.0, 0.0],)], "g array<double>").select(ensemble.simplex(F.col("g")).alias("w")).collect()
    assert w[0].w == [0, 0.25, 0.75] and w[1].w == pytest.approx([1 / 3] * 3)
    p = spark.createDataFrame([(0.5, 0.3, 0.2005), (0.2, 0.2, 0.6)], "ensemble_down double, ensemble_neutral double, ensemble_up double")
    assert ensemble.probability_audit(p).first().action == "renormalize"
    assert all(sum(r) == pytest.approx(1) for r in ensemble.renormalize(p).collect())
    with pytest.raises(ValueError):
        ensemble.renormalize(p.withColumn("ensemble_up", F.col("ensemble_up") + 0.05))


def test_front_and_search(spark):
    rng = np.random.default_rng(1)
    value = rng.integers(0, 9, (60, 2)).astype(float)
    dominated = [any((o >= v).all() and (o > v).any() for o in value) for v in value]
    assert [(r > 0) for r in optimize.fronts(value)] == dominated
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(value)], "id long, a double, b double")
    assert {r.id for r in ensemble.pareto_front(df, ["a", "b"]).collect()} == {i for i, d in enumerate(dominated) if not d}
    line = np.array([[0.0, 4.0], [1.0, 3.0], [3.0, 1.0], [4.0, 0.0]])
    assert optimize.crowding(line).tolist() == [math.inf, 1.5, 1.5, math.inf]
    assert np.isinf(optimize.crowding(line[:2])).all()
    found, best = optimize.search(lambda g: np.array([g[0], 1 - g[0] - abs(g[1] - 0.5)]), 2, 20, 30, 7)
    again, _ = optimize.search(lambda g: np.array([g[0], 1 - g[0] - abs(g[1] - 0.5)]), 2, 20, 30, 7)
    assert (found == again).all() and (found >= 0).all() and (found <= 1).all() and np.abs(found[:, 1] - 0.5).mean() < 0.1
    spark_gap = ensemble.crowding_distance(spark.createDataFrame(line.tolist(), "a double, b double"), ["a", "b"]).orderBy("a").collect()
    assert [r.crowding for r in spark_gap] == [None, 1.5, 1.5, None]
    assert ensemble.compromise(df, ["a", "b"], "id").count() == 1


def test_learners(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    target = np.where(x[:, 0] > 0.5, 1, np.where(x[:, 0] < -0.5, -1, 0))
    df = spark.createDataFrame([(at(i), int(t), float(a), float(b)) for i, (t, (a, b)) in enumerate(zip(target, x))], "timestamp timestamp_ntz, target int, a double, b double")
    for fit in (lambda d, c: learners.fit_logistic(d, c, 50), lambda d, c: learners.fit_trees(d, c, params=Boosting(rounds=6, depth=2, rate=0.5, least_rows=5))):
        out = learners.probabilities(fit(df, ["a", "b"]), df, "m15_lr")
        rows = out.collect()
        assert all(r.m15_lr_down + r.m15_lr_neutral + r.m15_lr_up == pytest.approx(1) for r in rows)
        hits = [max((r.m15_lr_down, -1), (r.m15_lr_neutral, 0), (r.m15_lr_up, 1))[1] == r.target for r in rows]
        assert np.mean(hits) > 0.8
    holes = df.withColumn("a", F.when(F.col("b") > 2.2, None).otherwise(F.col("a")))
    assert 0 < df.count() - learners.clean_train(holes, ["a"]).count() <= 8
    with pytest.raises(ValueError):
        learners.clean_train(df.withColumn("a", F.when(F.col("b") < 0, F.col("a"))), ["a"])
    m = learners.train_medians(df, ["a"])
    assert m.first().median == pytest.approx(np.median(x[:, 0]))
    assert learners.impute(holes, m).where("a is null").count() == 0
    with pytest.raises(ValueError):
        learners.train_medians(df.withColumn("n", F.lit(None).cast("double")), ["n"])
    with pytest.raises(ValueError):
        learners.reorder_classes(F.array(), [0, 1])
    got = spark.range(1).select(learners.reorder_classes(F.array(F.lit(0.1), F.lit(0.2), F.lit(0.7)), [1, -1, 0]).alias("p")).first().p
    assert got == [0.2, 0.7, 0.1]
    assert learners.row_drift({"train": 3}, {"train": 4, "test": 0}) == {"train": -1}


def test_prediction_audit(spark, tmp_path, capsys):
    names = ensemble.prediction_columns()
    rows = [(at(i), i % 3 - 1, *[0.2, 0.3, 0.5] * 6) for i in range(6)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, target int, " + ", ".join(f"{c} double" for c in names[2:]))
    assert learners.audit_predictions(df, 6).first().passed
    for bad in (df.union(df.limit(1)), df.withColumn("target", F.lit(5)), df.withColumn("d1_lr_up", F.lit(0.9)), df.select(*names[::-1])):
        assert not learners.audit_predictions(bad).first().passed
    assert not learners.audit_predictions(df, 7).first().passed
    df.coalesce(1).write.parquet(f"{tmp_path}/p.parquet")
    assert audit_cli.main(["--file", f"{tmp_path}/p.parquet", "--expected-rows", "6"]) == 0 and json.loads(capsys.readouterr().out)["passed"]
    blocks = [df.select("timestamp", "target", *[f"{k}_{s}" for s in ensemble.SIDES]) for k in ensemble.LEARNERS]
    assert learners.join_blocks(blocks).columns == names
    assert learners.prediction_alignment(blocks[0], blocks[1].where("target >= 0").withColumn("target", F.lit(1))).first().asDict() == {"shared": 4, "left_only": 2, "right_only": 0, "targets_differ": 2}


def test_tree_text(spark):
    dump = "num_class=3\nfeature_names=x y\n\nTree=0\nnum_leaves=2\nnum_cat=0\nsplit_feature=0\nthreshold=1.5\ndecision_type=2\nleft_child=-1\nright_child=-2\nleaf_value=0.5 -0.5\n\nTree=1\nnum_leaves=1\nnum_cat=0\nsplit_feature=\nthreshold=\ndecision_type=\nleft_child=\nright_child=\nleaf_value=0.1\n\nTree=2\nnum_leaves=3\nnum_cat=0\nsplit_feature=1 0\nthreshold=0 2\ndecision_type=2 2\nleft_child=1 -2\nright_child=-3 -1\nleaf_value=1 2 3\n\nend of trees\n"
    model = tree_text.parse(dump)
    rows = [(1.5, -1.0), (1.6, 0.0), (3.0, -1.0), (0.0, 1.0)]
    for (x, y), r in zip(rows, tree_text.score(spark.createDataFrame(rows, "x double, y double").coalesce(1), model).collect()):
        raw = np.array([0.5 if x <= 1.5 else -0.5, 0.1, (2 if x <= 2 else 1) if y <= 0 else 3])
        want = np.exp(raw) / np.exp(raw).sum()
        assert (r.down, r.neutral, r.up) == pytest.approx(tuple(want))
    with pytest.raises(ValueError):
        tree_text.parse(dump.replace("num_cat=0", "num_cat=0\nis_linear=1"))


def test_streamed_bars_equal_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartitionByRange(4, "ts").write.parquet(f"{tmp_path}/in")
    stream = streaming.stream_bars(streaming.read_ticks(spark, f"{tmp_path}/in", events.schema, 1), "15 minutes", "40 days")
    streaming.write_bars(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    want = {r.timestamp: r for r in bars.ohlc_bars(events, "15 minutes").collect()}
    late = streaming.stream_bars(streaming.read_ticks(spark, f"{tmp_path}/in", events.schema), "15 minutes", "1 minute")
    streaming.write_bars(late, f"{tmp_path}/out2", f"{tmp_path}/check2").awaitTermination()
    done = spark.read.parquet(f"{tmp_path}/out2").collect()
    assert len(done) >= len(want) - 2 and all(want[r.timestamp].close == r.close and want[r.timestamp].tickvol == r.tickvol for r in done)


def test_exact_percentiles_narrowed_and_whole(spark):
    rng = np.random.default_rng(3)
    n = 3001
    frame = pd.DataFrame({"a": rng.normal(size=n), "b": np.round(rng.normal(size=n), 1), "c": [1.0] * (n - 5) + [9.0] * 5})
    frame.loc[:99, "a"] = np.nan
    rows = spark.createDataFrame(frame).withColumn("a", F.when(~F.isnan("a"), F.col("a"))).withColumn("none", F.lit(None).cast("double"))
    shares = (0.0, 1 / 3, 0.5, 2 / 3, 0.999, 1.0)
    for sorted_values in (7, 500, 100_000):
        got = {(r.column, r.share): r.value for r in exact_percentiles(rows, ["a", "b", "c", "none"], shares, sorted_values).collect()}
        assert len(got) == 4 * len(shares)
        for p in shares:
            assert got["none", p] is None
            for c in "abc":
                assert got[c, p] == pytest.approx(np.percentile(frame[c].dropna(), 100 * p), rel=1e-12), (c, p)
    assert exact_percentiles(rows.where("a > 1e9"), ["a"], [0.5]).collect()[0].value is None


def test_exact_percentiles_of_groups(spark):
    rng = np.random.default_rng(6)
    sizes = {"big": 4000, "one": 1, "two": 2, "same": 600, None: 300}
    frame = pd.concat([pd.DataFrame({"k": k, "v": rng.lognormal(0, 9, n) if k != "same" else np.repeat([2.0, 5.0], n // 2)}) for k, n in sizes.items()])
    rows = spark.createDataFrame([(k, float(v)) for k, v in frame.itertuples(index=False)] + [("empty", None)], "k string, v double").repartition(3)
    for sorted_values in (5, 100_000):
        got = {(r.k, r.share): r.value for r in exact_percentiles(rows, ["v"], (0.0, 0.25, 1 / 3, 0.9), sorted_values, ["k"]).collect()}
        assert len(got) == 4 * 6 and got["empty", 0.25] is None
        for (k, p), v in got.items():
            if k != "empty":
                own = frame[frame["k"].isna() if k is None else frame["k"] == k]["v"]
                assert v == pytest.approx(np.percentile(own, 100 * p), rel=1e-12), (k, p)


def test_ranks_of_all_layers(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.random((300, 3)), 1)
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)] + [(900, None, 1.0, 1.0)], "id int, a double, b double, c double").repartition(3)
    want = optimize.fronts(np.unique(x, axis=0)) + 1
    of = {tuple(p): r for p, r in zip(np.unique(x, axis=0), want)}
    for chunk in (40, 5000):
        got = ensemble.pareto_ranks(points, ["a", "b", "c"], chunk=chunk).collect()
        assert len(got) == 300 and all(r["rank"] == of[r.a, r.b, r.c] for r in got)
    few = ensemble.pareto_ranks(points, ["a", "b", "c"], layers=2, chunk=10).collect()
    assert {r.id for r in few} == {i for i, p in enumerate(x) if of[tuple(p)] <= 2}
    front = ensemble.pareto_front(points, ["a", "b", "c"])
    assert {r.id for r in front.collect()} == {i for i, p in enumerate(x) if of[tuple(p)] == 1} and "NestedLoop" not in front._jdf.queryExecution().executedPlan().toString()
    assert ensemble.pareto_ranks(points.limit(0), ["a", "b"]).count() == 0


def test_streamed_context_equals_batch(spark, tmp_path):
    """Bars come in several files, also late ones; the contexts are those of the batch over the bars that were in time."""
    rng = np.random.default_rng(9)
    parts = []
    for k in ("a", "b"):
        times = [T0 + i * QUARTER for i in range(600) if rng.random() > 0.3]
        close = 100 + np.cumsum(rng.normal(size=len(times)))
        parts.append(pd.DataFrame({"symbol": k, "timestamp": times, "open": close - 0.5, "high": close + 1, "low": close - 2, "close": close, "tickvol": rng.integers(1, 9, len(times)), "vol": 1, "spread": 2}))
    bars = pd.concat(parts).sort_values("timestamp", kind="stable").reset_index(drop=True)
    frame = lambda x: spark.createDataFrame(x).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    late = bars.iloc[[5, 40]].assign(close=-1.0)
    out, seen = f"{tmp_path}/out", f"{tmp_path}/seen"
    for at in range(0, len(bars), 211):
        more = [bars.iloc[at : at + 211], *([late] if at == 422 else [])]
        frame(pd.concat(more)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/bars")
        stream = streaming.stream_context(spark.readStream.schema(frame(bars).schema).parquet(f"{tmp_path}/bars"), ["symbol"])
        query = streaming.write_bars(stream, out, seen)
        assert query.awaitTermination(120)
    got = spark.read.parquet(out)
    agg = {"open": "first", "high": "max", "low": "min", "close": "last", "tickvol": "sum", "vol": "sum", "spread": "last"}
    higher = [frame(bars.set_index("timestamp").groupby("symbol").resample(r).agg(agg).dropna(subset=["open"]).reset_index().astype({c: "int64" for c in ("tickvol", "vol", "spread")})) for r in ("1h", "1D")]
    want = align.align_timeframes(frame(bars), *higher, ["symbol"], "close").select(got.columns)
    a, b = (x.toPandas().sort_values(["symbol", "timestamp"]).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(bars)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
