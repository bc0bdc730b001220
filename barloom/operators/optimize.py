"""Two-objective evolutionary search of ensemble weights (non-dominated sorting), scored in Spark."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import argmax_class, sharpe
from barloom.operators.ensemble import LEARNERS, REGIMES, SIDES
from barloom.operators.metrics import macro_f1

CLASSES = (-1, 0, 1)
Evaluate = Callable[[np.ndarray], np.ndarray]


def fronts(values: np.ndarray) -> np.ndarray:
    """Rank of each point (0: nothing dominates it) under maximisation."""
    no_worse = (values[:, None, :] >= values[None, :, :]).all(-1)
    dominates = no_worse & (values[:, None, :] > values[None, :, :]).any(-1)
    rank, left, level = np.zeros(len(values), int), np.ones(len(values), bool), 0
    while left.any():
        front = left & ~dominates[left].any(axis=0)
        rank[front], left, level = level, left & ~front, level + 1
    return rank


def crowding(values: np.ndarray) -> np.ndarray:
    """Crowding distance of the points of one front."""
    if len(values) <= 2:
        return np.full(len(values), np.inf)
    out = np.zeros(len(values))
    for column in values.T:
        order = np.argsort(column)
        span = column[order[-1]] - column[order[0]]
        if span >= 1e-12:
            out[order[1:-1]] += (column[order[2:]] - column[order[:-2]]) / span
        out[order[[0, -1]]] = np.inf
    return out


def weights_of(genes: np.ndarray) -> np.ndarray:
    clipped = np.maximum(genes, 0)
    return clipped / clipped.sum() if clipped.sum() >= 1e-9 else np.full(len(genes), 1 / len(genes))


class Search:
    """Two-objective evolutionary search: tournaments by rank and crowding, blend crossover, Gaussian mutation, elitist
    selection; genes stay in [0, 1]. ask() gives genes to score, tell() takes their objectives."""

    def __init__(self, genes: int, population: int = 40, seed: int = 42, contenders: int = 2, mutation: float | None = None, blend: float = 0.25, sigma: float = 0.1):
        self.rng, self.chance = np.random.default_rng(seed), mutation if mutation is not None else 1 / genes
        self.genes, self.population, self.contenders, self.blend, self.sigma = genes, population, contenders, blend, sigma
        self.pool, self.value, self.young = np.empty((0, genes)), None, self.rng.random((population, genes))

    def ask(self) -> np.ndarray:
        if self.young is None:
            rank, rng = fronts(self.value), self.rng
            fit = np.lexsort((-_spread(self.value, rank), rank)).argsort()  # place in the order of rank, then of falling crowding
            pairs = (self.population + 1) // 2
            drawn = rng.integers(0, self.population, (pairs, 2, self.contenders))
            parents = np.take_along_axis(drawn, fit[drawn].argmin(axis=2)[..., None], 2)[..., 0]
            a, b = self.pool[parents[:, 0]], self.pool[parents[:, 1]]
            r = rng.uniform(-self.blend, 1 + self.blend, (pairs, self.genes))
            young = np.clip(np.concatenate([r * a + (1 - r) * b, r * b + (1 - r) * a]), 0, 1)[: self.population]
            moved = rng.random(young.shape) < self.chance
            self.young = np.clip(young + moved * rng.normal(0, self.sigma, young.shape), 0, 1)
        return self.young

    def tell(self, value: np.ndarray) -> None:
        self.pool = np.vstack([self.pool, self.young])
        self.value = value if self.value is None else np.vstack([self.value, value])
        rank = fronts(self.value)
        best = np.lexsort((-_spread(self.value, rank), rank))[: self.population] if len(self.pool) > self.population else np.arange(len(self.pool))
        self.pool, self.value, self.young = self.pool[best], self.value[best], None

    def front(self) -> tuple[np.ndarray, np.ndarray]:
        first = fronts(self.value) == 0
        return self.pool[first], self.value[first]


def _spread(value: np.ndarray, rank: np.ndarray) -> np.ndarray:
    out = np.zeros(len(value))
    for level in np.unique(rank):
        out[rank == level] = crowding(value[rank == level])
    return out


def search(evaluate: Evaluate, genes: int, population: int = 40, generations: int = 60, seed: int = 42, **options) -> tuple[np.ndarray, np.ndarray]:
    """(genes, objectives) of the last population's first front; evaluate scores one row of genes."""
    run = Search(genes, population, seed, **options)
    for _ in range(generations + 1):
        run.tell(np.array([evaluate(g) for g in run.ask()]))
    return run.front()


def score_candidates(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """(regime, candidate, macro_f1, sharpe) of candidates (regime, candidate, weights: array) over rows (regime, target,
    forward_return_1, the learners' probabilities): one pass, each row meets its regime's few candidates. Rows without
    a return count for F1 only."""
    met = rows.join(F.broadcast(candidates), "regime")  # population x regimes rows
    total = lambda side: sum((F.col("weights")[i] * F.col(f"{k}_{side}") for i, k in enumerate(LEARNERS)), F.lit(0.0))
    predicted = argmax_class([total(s) for s in SIDES], CLASSES)
    met = met.select("regime", "candidate", "target", "forward_return_1", predicted.alias("predicted_class"))
    return met.groupBy("regime", "candidate").agg(macro_f1().alias("macro_f1"), sharpe(F.col("predicted_class") * F.col("forward_return_1")).alias("sharpe"))


def regime_fronts(rows: DataFrame, population: int = 40, generations: int = 60, seed: int = 42) -> DataFrame:
    """The front of each regime: regime, point, weights, macro_f1, sharpe, chosen (the compromise).

    rows: regime, target, forward_return_1 and the learners' probabilities. Only the genes of the candidates (population
    a regime) are on the driver; each generation is scored by one job over all rows and regimes.
    """
    spark = rows.sparkSession
    columns = [f"{k}_{s}" for k in LEARNERS for s in SIDES]
    rows = rows.where(F.col("regime").isNotNull()).select("regime", "target", "forward_return_1", *columns).persist()  # read again in every generation
    there = {r.regime for r in rows.select("regime").distinct().collect()}  # of the three
    runs = {r: Search(len(LEARNERS), population, seed + n) for n, r in enumerate(REGIMES) if r in there}
    for _ in range(generations + 1):
        asked = [(r, n, weights_of(g).tolist()) for r, run in runs.items() for n, g in enumerate(run.ask())]
        found = score_candidates(rows, spark.createDataFrame(asked, "regime string, candidate int, weights array<double>")).collect()
        values = {(x.regime, x.candidate): (x.macro_f1, x.sharpe) for x in found}
        for r, run in runs.items():
            run.tell(np.array([values[r, n] for n in range(population)]))
    rows.unpersist()
    out = []
    for r, run in runs.items():
        genes, value = run.front()
        span = np.ptp(value, axis=0)
        score = ((value - value.min(axis=0)) / np.where(span < 1e-12, 1, span)).sum(axis=1)
        out += [(r, n, weights_of(g).tolist(), float(v[0]), float(v[1]), bool(n == score.argmax())) for n, (g, v) in enumerate(zip(genes, value))]
    return spark.createDataFrame(out, "regime string, point long, weights array<double>, macro_f1 double, sharpe double, chosen boolean")


def save_fronts(result: DataFrame, path: str) -> None:
    """The whole front with its objectives and the chosen weights, a JSON row a point."""
    result.coalesce(1).write.mode("overwrite").json(path)


def read_fronts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("regime string, point long, weights array<double>, macro_f1 double, sharpe double, chosen boolean").json(path)
