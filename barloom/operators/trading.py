"""Trading evaluation: price context, equity, drawdown, costs, baselines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions import BLOCK, change, finite, in_blocks, in_order, join_blocks, own_rows, rolling, sharpe, with_halo

#: Cost of one unit of position change, by scenario (fixed values).
COST_SCENARIOS = {"zero_cost": 0.0, "low_cost": 0.0001, "medium_cost": 0.0005, "high_cost": 0.0020}


def price_context(bars: DataFrame, window: int = 16, by: Sequence[str] = ()) -> DataFrame:
    """timestamp, close_x, vol_16, forward_return_1 and next_timestamp of bars (timestamp, close)."""
    close = F.col("close").cast("double")
    bars = bars.select(*by, "timestamp", close.alias("close_x"))
    rows = with_halo(bars, window, 1, by=by)
    w = in_order([*by, BLOCK])
    rows = rows.withColumns({"_r": change(F.col("close_x"), F.lag("close_x").over(w)), "forward_return_1": change(F.lead("close_x").over(w), F.col("close_x")), "next_timestamp": F.lead("timestamp").over(w)})
    rows = rows.withColumn("vol_16", rolling(F.stddev_samp, F.col("_r"), w, window))
    return own_rows(rows).select(*by, "timestamp", "close_x", "vol_16", "forward_return_1", "next_timestamp")


def attach_price_context(predictions: DataFrame, context: DataFrame, end: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Predictions with their price context, one to one: a timestamp without context gets nulls; one that repeats on
    either side fails the job. A forward return that reaches beyond `end` is null."""
    key = [*by, "timestamp"]
    out = unique_by(predictions, key).join(unique_by(context, key), key, "left")
    if end is None:
        return out
    inside = F.col("next_timestamp") <= F.lit(end).cast("timestamp_ntz")
    return out.withColumn("forward_return_1", F.when(inside, F.col("forward_return_1")))


def unique_by(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """rows, but reading a row whose key repeats fails. The check shares the exchange of a join on the key."""
    count = F.count(F.lit(1)).over(Window.partitionBy(*key))
    checked = rows.withColumn("_n", count)
    failed = F.raise_error(F.concat(F.lit(f"{list(key)} is not unique: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in key])))
    return checked.withColumn(key[-1], F.when(F.col("_n") > 1, failed.cast(rows.schema[key[-1]].dataType)).otherwise(F.col(key[-1]))).drop("_n")


def check_one_to_one(rows: DataFrame, key: Sequence[str]) -> None:
    if rows.groupBy(*key).count().where("count > 1").take(1):
        raise ValueError(f"{list(key)} is not unique")


def evaluated(rows: DataFrame, position: str | Column = "predicted_class", by: Sequence[str] = (), rate: Column | float = 0.0, keep: Sequence[str] = ()) -> DataFrame:
    """Bars with a finite forward return: position, change, gross and net return, equity and drawdown of both.

    The position before the first bar is 0; equity starts at 1, which is not part of the running maximum. A series is
    cut into blocks of time. A block is summed up in one row (its ends' positions, its product, the greatest and least
    of its running products); those rows, folded in the order of the blocks, say with which position, equity and peak a
    block begins, and the bars follow from that. The bars go through one exchange; scenarios, regimes or strategies
    (`by`) share it.
    """
    position = F.col(position) if isinstance(position, str) else position
    rate = F.lit(rate) if isinstance(rate, (int, float)) else rate
    rows = rows.withColumn("_p", position.cast("double")).withColumn("_f", finite(F.col("forward_return_1"))).where("_f is not null").withColumn("_rate", rate.cast("double"))
    rows = in_blocks(rows.select(*by, *keep, *[c for c in (BLOCK,) if c in rows.columns], "timestamp", F.col("_p").alias("position"), F.col("_f").alias("forward_return"), "_rate"), by)
    w = in_order([*by, BLOCK])
    grown = w.rowsBetween(Window.unboundedPreceding, 0)
    # inside a block: the first bar's change of position isn't known yet, so its factor stays apart
    rows = rows.withColumns({"_change": F.abs(F.col("position") - F.lag("position").over(w)), "gross_return": F.col("position") * F.col("forward_return"), "_first": F.row_number().over(w) == 1})
    later = lambda cost: F.product(F.when(F.col("_first"), 1.0).otherwise(1 + F.col("gross_return") - cost)).over(grown)
    rows = rows.withColumns({"_g": later(F.lit(0.0)), "_n": later(F.col("_rate") * F.coalesce("_change", F.lit(0.0)))})
    ends = [f("position", "timestamp").alias(n) for f, n in ((F.min_by, "enters"), (F.max_by, "leaves"))] + [F.min_by("gross_return", "timestamp").alias("first_return"), F.min_by("_rate", "timestamp").alias("first_rate")]
    summed = rows.groupBy(*by, BLOCK).agg(*ends, *[f(c, *more).alias(f"{n}{c}") for c in ("_g", "_n") for n, f, more in (("all", F.max_by, ("timestamp",)), ("most", F.max, ()), ("least", F.min, ()))])
    order = Window.partitionBy(*by).orderBy(BLOCK) if by else Window.orderBy(BLOCK)  # a row a block
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    summed = summed.withColumn("_held", F.coalesce(F.lag("leaves").over(order), F.lit(0.0)))
    first = {"_g": 1 + F.col("first_return"), "_n": 1 + F.col("first_return") - F.col("first_rate") * F.abs(F.col("enters") - F.col("_held"))}
    summed = summed.withColumns({f"first{c}": v for c, v in first.items()})
    summed = summed.withColumns({f"from{c}": F.col(f"first{c}") * F.coalesce(F.product(F.col(f"first{c}") * F.col(f"all{c}")).over(earlier), F.lit(1.0)) for c in first})
    peak = {c: F.greatest(F.col(f"from{c}") * F.col(f"most{c}"), F.col(f"from{c}") * F.col(f"least{c}")) for c in first}
    summed = summed.select(*by, BLOCK, "_held", *[f"from{c}" for c in first], *[F.max(v).over(earlier).alias(f"peak{c}") for c, v in peak.items()])
    rows = join_blocks(rows, summed, by)
    if by:  # rows that lack a key are one block, which begins with nothing
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        alone = {c: F.first(v).over(whole) for c, v in {"_g": 1 + F.col("gross_return"), "_n": 1 + F.col("gross_return") - F.col("_rate") * F.abs("position")}.items()}
        rows = rows.withColumns({"_held": F.coalesce("_held", F.lit(0.0)), **{f"from{c}": F.coalesce(F.col(f"from{c}"), v) for c, v in alone.items()}})
    rows = rows.withColumn("position_change", F.coalesce("_change", F.abs(F.col("position") - F.col("_held")))).withColumn("cost", F.col("_rate") * F.col("position_change")).withColumn("net_return", F.col("gross_return") - F.col("cost"))
    rows = rows.withColumns({"gross_equity": F.col("from_g") * F.col("_g"), "net_equity": F.col("from_n") * F.col("_n")})
    top = lambda c: F.greatest(F.max(f"{c}_equity").over(grown), F.col(f"peak_{c[0]}"))
    rows = rows.withColumns({f"{c}_drawdown": F.try_divide(F.col(f"{c}_equity") - top(c), top(c)) for c in ("gross", "net")})
    return rows.select(*by, *keep, "timestamp", "position", "forward_return", "position_change", "gross_return", "cost", "net_return", "gross_equity", "net_equity", "gross_drawdown", "net_drawdown")


def equity_summary(bars: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Summary of evaluated bars: trades are bars with a position."""
    held = F.col("position") != 0
    none = lambda c, other=0.0: F.coalesce(c, F.lit(other))
    aggs = [
        F.count(F.lit(1)).alias("bars"), F.count_if(held).alias("trades"), none(F.try_divide(F.count_if(held & (F.col("gross_return") > 0)).cast("double"), F.count_if(held))).alias("win_rate"),
        none(F.max_by("gross_equity", "timestamp") - 1).alias("total_return"), none(F.min("gross_drawdown")).alias("max_drawdown"), sharpe(F.col("gross_return")).alias("sharpe"),
    ]
    return bars.groupBy(*by).agg(*aggs) if by else bars.agg(*aggs)


def cost_summary(bars: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ten figures of net-of-cost trading, and the annualised Sharpe ratio over the bars' own span."""
    held = F.col("position") != 0
    none = lambda c, other=0.0: F.coalesce(c, F.lit(other))
    aggs = [
        F.count(F.lit(1)).alias("bars"), F.count_if(held).alias("directional_bars"), F.count_if(F.col("position_change") > 0).alias("position_changes"),
        none(F.max_by("gross_equity", "timestamp") - 1).alias("gross_total_return"), none(F.sum("cost")).alias("total_cost"), none(F.max_by("net_equity", "timestamp") - 1).alias("net_total_return"),
        none(F.max_by("net_equity", "timestamp"), 1.0).alias("net_equity"), none(F.min("net_drawdown")).alias("max_drawdown_net"),
        none(F.try_divide(F.count_if(held & (F.col("net_return") > 0)).cast("double"), F.count_if(held))).alias("win_rate_net"), sharpe(F.col("net_return")).alias("sharpe_net"),
        F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"),
    ]
    out = bars.groupBy(*by).agg(*aggs) if by else bars.agg(*aggs)
    days = F.expr("timestampdiff(SECOND, _first, _last)") / 86400.0
    yearly = F.col("sharpe_net") * F.sqrt(F.col("bars") / (days / 365.25))
    return out.withColumn("sharpe_annual", F.when(days > 0, yearly).otherwise(0.0)).drop("_first", "_last")


def cost_scenarios(rows: DataFrame, position: str | Column = "predicted_class", scenarios: Mapping[str, float] = COST_SCENARIOS) -> DataFrame:
    """cost_summary of each scenario. The rows are dealt out by blocks, then repeated once for each of the few scenarios,
    which are literals."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(r)).alias("rate")) for n, r in scenarios.items()]))
    position = F.col(position) if isinstance(position, str) else position
    dealt = in_blocks(rows.select("timestamp", "forward_return_1", position.alias("_position")))
    spread = dealt.withColumn("_s", each).select("*", "_s.scenario", "_s.rate")
    return cost_summary(evaluated(spread, "_position", ["scenario", "rate"], F.col("rate")), ["scenario", "rate"])


def strategy_costs(rows: DataFrame, position: str | Column = "predicted_class", scenarios: Mapping[str, float] = COST_SCENARIOS) -> DataFrame:
    """cost_summary of the strategy, of holding and of staying out, each under every scenario: (strategy, scenario, rate,
    figures). One exchange of the rows serves them all."""
    position = F.col(position) if isinstance(position, str) else position
    held = {"strategy": F.col("_position").cast("double"), "buy_hold": F.lit(1.0), "flat": F.lit(0.0)}
    each = F.array(*[F.struct(F.lit(k).alias("strategy"), p.alias("hold"), F.lit(n).alias("scenario"), F.lit(float(r)).alias("rate")) for k, p in held.items() for n, r in scenarios.items()])
    dealt = in_blocks(rows.select("timestamp", "forward_return_1", position.alias("_position")))
    keys = ["strategy", "scenario", "rate"]
    return cost_summary(evaluated(dealt.select("*", F.inline(each)), "hold", keys, F.col("rate")), keys)


def assert_costs_never_help(summary: DataFrame) -> None:
    rows = {r.scenario: (r.rate, r.net_total_return) for r in summary.select("scenario", "rate", "net_total_return").collect()}
    free = max(v for r, v in rows.values() if r == 0)
    if any(v > free + 1e-9 for r, v in rows.values() if r > 0):
        raise ValueError(f"a cost improved the return: {rows}")


def baselines(rows: DataFrame) -> DataFrame:
    """equity_summary of holding and of staying out, with holding's cross-check last close / first close - 1."""
    each = F.explode(F.array(F.struct(F.lit("buy_hold").alias("strategy"), F.lit(1.0).alias("hold")), F.struct(F.lit("flat").alias("strategy"), F.lit(0.0).alias("hold")))).alias("_s")
    spread = in_blocks(rows.select("timestamp", "forward_return_1")).select("*", each).select("*", "_s.strategy", "_s.hold")
    summary = equity_summary(evaluated(spread, "hold", ["strategy"]), ["strategy"])
    check = rows.where(F.col("forward_return_1").isNotNull()).agg((F.max_by(F.col("close_x") * (1 + F.col("forward_return_1")), "timestamp") / F.min_by("close_x", "timestamp") - 1).alias("close_to_close"))
    return summary.crossJoin(check)  # check is one row


def return_outliers(rows: DataFrame, soft: float = 0.01, hard: float = 0.20, floor: float = 500.0) -> DataFrame:
    """Statistics of the forward returns and counts of the soft and hard limits; sane: nothing beyond the hard ones."""
    r = F.col("forward_return_1")
    out = rows.agg(
        F.count(r).alias("returns"), F.min(r).alias("least"), F.max(r).alias("greatest"), F.avg(r).alias("mean"), F.stddev_pop(r).alias("deviation"),
        F.count_if(F.abs(r) > soft).alias("soft_outliers"), F.count_if(F.abs(r) > hard).alias("hard_outliers"), F.count_if(F.col("close_x") < floor).alias("below_floor"), F.count_if(F.col("close_x") <= 0).alias("not_positive"),
    )
    return out.withColumn("sane", (F.col("hard_outliers") == 0) & (F.col("below_floor") == 0))


def assert_prices_sane(rows: DataFrame, hard: float = 0.20, floor: float = 500.0) -> DataFrame:
    found = return_outliers(rows, hard=hard, floor=floor).first()
    if not found.sane:
        raise ValueError(f"prices are not sane: {found.asDict()}")
    return rows


def largest_returns(rows: DataFrame, top: int = 10) -> DataFrame:
    """Bars with the greatest absolute forward return."""
    return rows.select("timestamp", "close_x", "forward_return_1").where("forward_return_1 is not null").orderBy(F.desc(F.abs("forward_return_1")), "timestamp").limit(top)


def baseline_reproduction(now: DataFrame, saved: DataFrame, names: Mapping[str, str], tolerance: float = 1e-6) -> DataFrame:
    """(metric, now, saved, reproduced) of two reports of one row; names: now's metric -> saved's. A missing value
    reproduces nothing."""
    pairs = now.select(*[F.col(c).cast("double").alias(f"n_{c}") for c in names]).crossJoin(saved.select(*[F.col(o).cast("double").alias(f"s_{c}") for c, o in names.items()]))
    each = [F.struct(F.lit(c).alias("metric"), F.col(f"n_{c}").alias("now"), F.col(f"s_{c}").alias("saved")) for c in names]
    return pairs.select(F.inline(F.array(*each))).withColumn("reproduced", F.coalesce(F.abs(F.col("now") - F.col("saved")) <= tolerance, F.lit(False)))


def top_contributors(bars: DataFrame, top: int = 5) -> DataFrame:
    """Bars with the greatest absolute strategy return."""
    return bars.select("timestamp", "position", "forward_return", "gross_return", (1 + F.col("gross_return")).alias("multiplier")).orderBy(F.desc(F.abs("gross_return")), "timestamp").limit(top)
