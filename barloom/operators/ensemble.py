"""Volatility regimes and the regime-weighted ensemble of base learners."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions import argmax_class, exact_percentiles, settled

LEARNERS = ("m15_lr", "m15_lgbm", "h1_lr", "h1_lgbm", "d1_lr", "d1_lgbm")
SIDES = ("down", "neutral", "up")
REGIMES = ("low_vol", "medium_vol", "high_vol")
CLASSES = (-1, 0, 1)


def prediction_columns() -> list[str]:
    """Columns of a prediction file, in order."""
    return ["timestamp", "target", *[f"{k}_{s}" for k in LEARNERS for s in SIDES]]


def regime_thresholds(rows: DataFrame, value: str = "vol_16", by: Sequence[str] = ()) -> DataFrame:
    """(by, q33, q67): exact tertiles by linear interpolation."""
    q = exact_percentiles(rows, [value], (1 / 3, 2 / 3), by=by)
    ends = F.min("value").alias("q33"), F.max("value").alias("q67")
    return q.groupBy(*by).agg(*ends) if by else q.agg(*ends)


def regime(value: Column, q33: Column | float, q67: Column | float) -> Column:
    """low_vol up to q33, medium_vol up to q67 (both inclusive), else high_vol; null for a null value."""
    return F.when(value <= q33, REGIMES[0]).when(value <= q67, REGIMES[1]).when(value.isNotNull(), REGIMES[2])


def assign_regimes(rows: DataFrame, thresholds: DataFrame, value: str = "vol_16") -> DataFrame:
    """rows with their regime under thresholds (one row: q33, q67)."""
    return rows.crossJoin(F.broadcast(thresholds.select("q33", "q67"))).withColumn("regime", regime(F.col(value), F.col("q33"), F.col("q67"))).drop("q33", "q67")


def weights_column(weights: Mapping[str, Mapping[str, float]]) -> Column:
    """array of the learners' weights of the row's regime; an unknown regime gives null."""
    pairs = [x for r, own in weights.items() for x in (F.lit(r), F.array(*[F.lit(float(own[k])) for k in LEARNERS]))]
    return F.create_map(*pairs)[F.col("regime")]


def combine(rows: DataFrame, weights: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """rows with the ensemble's probabilities, sums of weight times probability, and predicted_class."""
    w = weights_column(weights)
    out = rows.withColumn("_w", w)
    total = lambda side: sum((F.col("_w")[i] * F.col(f"{k}_{side}") for i, k in enumerate(LEARNERS)), F.lit(0.0))
    out = out.withColumns({f"ensemble_{s}": total(s) for s in SIDES}).drop("_w")
    return out.withColumn("predicted_class", argmax_class([F.col(f"ensemble_{s}") for s in SIDES], CLASSES))


def simplex(genes: Column) -> Column:
    """Weights of an array of genes: negative ones are 0; equal weights if nothing is left."""
    clipped = F.transform(genes, lambda g: F.greatest(g, F.lit(0.0)))
    total = F.aggregate(clipped, F.lit(0.0), lambda a, g: a + g)
    return F.when(total < 1e-9, F.transform(genes, lambda g: F.lit(1.0) / F.size(genes))).otherwise(F.transform(clipped, lambda g: F.try_divide(g, total)))


def probability_audit(rows: DataFrame, columns: Sequence[str] = tuple(f"ensemble_{s}" for s in SIDES), exact: float = 1e-9, ceiling: float = 0.01) -> DataFrame:
    """Deviation of the probabilities' sum from 1, and what to do: keep, renormalize or reject."""
    off = F.abs(sum((F.col(c) for c in columns), F.lit(0.0)) - 1)
    out = rows.agg(F.count(F.lit(1)).alias("bars"), F.max(off).alias("max_deviation"), F.avg(off).alias("mean_deviation"), F.count_if(F.least(*columns) < 0).alias("negative"))
    return out.withColumn("action", F.when(F.col("max_deviation") <= exact, "keep").when(F.col("max_deviation") <= ceiling, "renormalize").otherwise("reject"))


def renormalize(rows: DataFrame, columns: Sequence[str] = tuple(f"ensemble_{s}" for s in SIDES), ceiling: float = 0.01) -> DataFrame:
    """Divide by the sum; raise if the deviation is more than rounding explains."""
    found = probability_audit(rows, columns, ceiling=ceiling).first()
    if found.action == "reject":
        raise ValueError(f"probabilities are off by {found.max_deviation}")
    total = sum((F.col(c) for c in columns), F.lit(0.0))
    return rows if found.action == "keep" else rows.withColumns({c: F.col(c) / total for c in columns})


#: Parts in which fronts are first sought on their own.
FRONT_PARTS = 64


def pareto_front(points: DataFrame, objectives: Sequence[str]) -> DataFrame:
    """Points that no other dominates (all objectives are maximised; a null objective is on no front).

    Two objectives: of each value of the first only the greatest second counts, and it is on the front if it exceeds
    that of every greater first: a running maximum, first within parts, then over the parts' small fronts. More: the
    first layer of pareto_ranks.
    """
    points = points.where(" and ".join(f"`{o}` is not null" for o in objectives))
    if len(objectives) == 2:
        a, b = objectives
        best = points.groupBy(F.col(a).alias("_a")).agg(F.max(b).alias("_b")).withColumn("_part", F.pmod(F.xxhash64("_a"), F.lit(FRONT_PARTS)))
        for keys in (["_part"], []):
            better = F.max("_b").over(Window.partitionBy(*keys).orderBy(F.desc("_a")).rowsBetween(Window.unboundedPreceding, -1))
            best = best.withColumn("_better", better).where("_better is null or _b > _better")
        return points.join(best.select("_a", "_b"), (F.col(a) == F.col("_a")) & (F.col(b) == F.col("_b"))).drop("_a", "_b")
    return pareto_ranks(points, objectives, 1).drop("rank")


#: Points that are ranked at once: so many go to the driver and to every task.
RANKED_POINTS = 4096


def _ranks(points: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Ranks of points in falling order; best: the greatest rank of an earlier point that dominates one (0: none)."""
    out = best.copy()
    for i, p in enumerate(points):
        above = points[:i]
        dominates = (above >= p).all(axis=1) & (above > p).any(axis=1)
        out[i] = max(best[i], out[:i][dominates].max(initial=0)) + 1
    return out


def pareto_ranks(points: DataFrame, objectives: Sequence[str], layers: int | None = None, chunk: int = RANKED_POINTS) -> DataFrame:
    """points with rank: 1 for the front, then of the front of what is left, and so on (all objectives are maximised; a
    null objective has no rank and goes). With `layers`, points of a higher rank go.

    A point's rank is one more than the greatest of those that dominate it, and in falling order of the objectives those
    come before it. So distinct points are numbered in that order and settled chunk by chunk: a chunk ranks its own
    points, then goes to all tasks and raises what lies behind it. No pair of points is made a row. With `layers` points
    that have so many layers above them within a batch, or so far, drop out early: what is left of a front is small.
    """
    spark = points.sparkSession
    names = [f"_{i}" for i in range(len(objectives))]
    distinct = points.select(*[F.col(o).cast("double").alias(n) for n, o in zip(names, objectives)]).dropna().distinct()
    layout = ", ".join(f"{n} double" for n in names)

    def thin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), RANKED_POINTS):
                own = frame.iloc[at : at + RANKED_POINTS].sort_values(names, ascending=False)
                yield own[_ranks(own.to_numpy(), np.zeros(len(own), int)) <= layers]

    distinct = distinct if layers is None else distinct.mapInPandas(thin, layout)
    falling = [F.col(n).desc() for n in names]
    placed = settled(distinct.repartitionByRange(*falling).sortWithinPartitions(*falling).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33).alias("_part")
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))  # a row a partition
    numbered = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    state = settled(numbered.select(*names, F.floor((F.col("_start") + F.col("_id") % (1 << 33)) / chunk).cast("long").alias("_chunk"), F.lit(0).alias("_best")))
    ranked, last = None, state.agg(F.max("_chunk")).first()[0]
    for c in range((-1 if last is None else last) + 1):
        rows = state.where(F.col("_chunk") == c).collect()  # `chunk` rows at most
        own = np.array(sorted(((*[r[n] for n in names], r["_best"]) for r in rows), reverse=True)).reshape(len(rows), len(names) + 1)
        ranks = _ranks(own[:, :-1], own[:, -1].astype(int))
        kept = np.ones(len(ranks), bool) if layers is None else ranks <= layers
        found = spark.createDataFrame([(*map(float, p), int(r)) for p, r in zip(own[kept, :-1], ranks[kept])], f"{layout}, rank int")
        ranked = found if ranked is None else ranked.unionByName(found)
        if c == last:
            break
        held = spark.sparkContext.broadcast((own[:, :-1], ranks))

        def raised(frames: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            above, ranks = held.value
            for frame in frames:
                x, best = frame[names].to_numpy(), frame["_best"].to_numpy().copy()
                for i in range(len(x)):
                    dominates = (above >= x[i]).all(axis=1) & (above > x[i]).any(axis=1)
                    best[i] = max(best[i], ranks[dominates].max(initial=0))
                frame["_best"] = best
                yield frame if layers is None else frame[best < layers]

        state = settled(state.where(F.col("_chunk") > c).mapInPandas(raised, f"{layout}, _chunk long, _best int"))
        if c % 16 == 15:
            ranked = settled(ranked)
    if ranked is None:
        return points.limit(0).withColumn("rank", F.lit(None).cast("int"))
    same = F.lit(True)
    for n, o in zip(names, objectives):
        same = same & (F.col(o).cast("double") == F.col(n))
    return points.join(ranked, same).drop(*names)


def crowding_distance(points: DataFrame, objectives: Sequence[str], front: Sequence[str] = ()) -> DataFrame:
    """Sum over the objectives of the normalised gap between neighbours; infinite (null with infinite=true) at the ends
    and in fronts of one or two points."""
    gaps, ends = [], F.lit(False)
    for o in objectives:
        w = Window.partitionBy(*front).orderBy(o)
        whole = Window.partitionBy(*front)
        lo, hi = F.lag(o).over(w), F.lead(o).over(w)
        ends = ends | lo.isNull() | hi.isNull()
        span = F.max(o).over(whole) - F.min(o).over(whole)
        gaps.append(F.when(span >= 1e-12, (hi - lo) / span).otherwise(0.0))
    out = points.withColumn("infinite", ends).withColumn("crowding", sum(gaps[1:], gaps[0]))
    return out.withColumn("crowding", F.when(~F.col("infinite"), F.col("crowding")))


def compromise(points: DataFrame, objectives: Sequence[str], key: str) -> DataFrame:
    """The point with the greatest sum of min-max normalised objectives; the first by key on ties."""
    whole = Window.partitionBy()
    score = F.lit(0.0)
    for o in objectives:
        lo, hi = F.min(o).over(whole), F.max(o).over(whole)
        score = score + (F.col(o) - lo) / F.when(hi - lo < 1e-12, 1.0).otherwise(hi - lo)
    return points.withColumn("score", score).orderBy(F.desc("score"), key).limit(1)
