"""Multiclass gradient boosting: softmax gradients, quantile-binned histograms, leaf-wise trees.

Rows are binned once. A level of all classes' trees takes one job: every partition adds its rows up in histograms of
(class, node, feature), those meet by their key, and each key gives its best split back to the driver, a row each. What
moves grows with the partitions, not with the rows. Nodes are grown level by level as far as the depth allows, and the tree
is then read off best-first: the leaf of greatest gain is split next, until there are enough leaves, as leaf-wise growth
does. Rows keep their scores; every CHECKPOINT rounds they are written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import settled
from barloom.operators.tree_text import DEFAULT_LEFT, NAN, Tree, TreeModel

CHECKPOINT = 10
#: The bin of missing values; others come before it.
MISSING = 255


@dataclass(frozen=True)
class Boosting:
    """rounds at most, of trees of at most `leaves` leaves and `depth` levels. A round sees row_share of the rows (by a hash
    of the row), a tree column_share of the features. l1 and l2 shrink leaves; rate scales them. patience: rounds
    without a better loss on held rows after which fitting stops. bins: most quantile bins of a feature."""

    rounds: int = 600
    leaves: int = 15
    depth: int = 5
    rate: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    least_rows: int = 50
    least_hessian: float = 1e-3
    l1: float = 0.1
    l2: float = 0.1
    patience: int = 30
    bins: int = 255
    seed: int = 42


def feature_cuts(rows: DataFrame, columns: Sequence[str], bins: int) -> list[list[float]]:
    """Rising cut values of each column, at its quantiles: a value belongs to the first bin whose cut is not less."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    found = rows.agg(*[F.percentile_approx(value(c), shares, F.lit(20 * bins)).alias(f"q{i}") for i, c in enumerate(columns)], *[F.max(value(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return [[x for x in sorted(set(found[f"q{i}"] or ())) if x < found[f"m{i}"]] for i in range(len(columns))]


def _leaf(g, h, p: Boosting):
    return -np.sign(g) * np.maximum(np.abs(g) - p.l1, 0.0) / (h + p.l2)


def _gain(g, h, p: Boosting):
    return np.maximum(np.abs(g) - p.l1, 0.0) ** 2 / (h + p.l2)


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, p: Boosting) -> tuple | None:
    """(gain, bin, missing goes left, sums of the left and right side) of a histogram; the first of equal ones."""
    total = np.array([g.sum(), h.sum(), n.sum()])
    below = np.cumsum(np.array([g[:MISSING], h[:MISSING], n[:MISSING]]), axis=1)
    lost = np.array([g[MISSING], h[MISSING], n[MISSING]])
    best = None
    for left_missing in (True, False):
        left = below + lost[:, None] * left_missing
        right = total[:, None] - left
        fits = (np.minimum(left[2], right[2]) >= p.least_rows) & (np.minimum(left[1], right[1]) >= p.least_hessian)
        gains = np.where(fits, _gain(left[0], left[1], p) + _gain(right[0], right[1], p) - _gain(total[0], total[1], p), -np.inf)
        at = int(np.argmax(gains))
        if gains[at] > 1e-10 and (best is None or gains[at] > best[0] + 1e-12):
            best = (float(gains[at]), at, left_missing, left[:, at].tolist(), right[:, at].tolist())
        if not lost[2]:
            break
    return best


class Walk:
    """Splits of the trees of a round, nodes numbered 1, then 2 n and 2 n + 1 below n; vectorised over rows."""

    def __init__(self, splits: list[dict[int, tuple]], depth: int) -> None:
        self.tables = []
        for own in splits:
            there, feature, cut, miss = (np.zeros(2 << depth, t) for t in (bool, np.int64, np.int64, bool))
            for node, (f, b, left_missing) in own.items():
                there[node], feature[node], cut[node], miss[node] = True, f, b, left_missing
            self.tables.append((there, feature, cut, miss))

    def nodes(self, k: int, bins: np.ndarray, levels: int) -> np.ndarray:
        there, feature, cut, miss = self.tables[k]
        node, rows = np.ones(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            v = bins[rows, feature[node]]
            left = np.where(v == MISSING, miss[node], v <= cut[node])
            node = np.where(there[node], 2 * node + ~left, node)
        return node


def _sampled(ids: np.ndarray, round_: int, p: Boosting) -> np.ndarray:
    x = ids.astype(np.uint64) + np.uint64((round_ * 0x9E3779B97F4A7C15 + p.seed * 0xD1B54A32D192ED03) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(float) / (1 << 53) < p.row_share


def _columns(batch: pa.RecordBatch, features: int, classes: int):
    n = batch.num_rows
    read = lambda c, t: np.frombuffer(b"".join(batch.column(c).to_pylist()), t).reshape(n, -1)
    ids, y, w, held = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "y", "w", "held"))
    return ids, y, w, held.astype(bool), read("bins", np.uint8).reshape(n, features), read("scores", float).reshape(n, classes)


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


STATE = "id bigint, y int, w double, held boolean, bins binary, scores binary"
_PARTIAL = pa.schema([("key", pa.int64()), ("g", pa.binary()), ("h", pa.binary()), ("n", pa.binary())])


def _level(state: DataFrame, splits: list[dict], level: int, chosen: list[list[int]], round_: int, p: Boosting, features: int, use_held: bool) -> tuple[dict, float]:
    """{(class, node, feature): best split} of all nodes of a level, and at level 0 the mean loss of the held rows. Key 0
    carries the loss; else (class, node, feature) in the bits of one number."""
    classes, walk = len(splits), Walk(splits, p.depth)
    active = [sorted({c for n in own for c in (2 * n, 2 * n + 1) if c >> level == 1} if level else {1}) for own in splits]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((3, max(1, len(a)), features, MISSING + 1)) for a in active]
        loss, seen = np.zeros(MISSING + 1), False
        places = []
        for a in active:
            to = np.full(2 << p.depth, -1)
            to[a] = np.arange(len(a))
            places.append(to)
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            ids, y, w, held, bins, scores = _columns(batch, features, classes)
            chance = _softmax(scores)
            if level == 0 and use_held:
                loss[0] += (w * -np.log(np.maximum(chance[np.arange(len(y)), y], 1e-15)))[held].sum()
                loss[1] += w[held].sum()
            live = _sampled(ids, round_, p) & ~(held & use_held)
            for k in range(classes):
                at = places[k][walk.nodes(k, bins, level)]
                rows = np.flatnonzero(live & (at >= 0))
                at, c, weight = at[rows], chance[rows, k], w[rows]
                g, h = weight * (c - (y[rows] == k)), weight * c * (1 - c) * classes / (classes - 1)
                for f in chosen[k]:
                    cell, size = at * (MISSING + 1) + bins[rows, f], sums[k].shape[1] * (MISSING + 1)
                    for i, own in enumerate((g, h, None)):
                        sums[k][i, :, f] += np.bincount(cell, own, size).reshape(-1, MISSING + 1)
        if seen:
            out = [(k << 40 | node << 20 | f, *(sums[k][i, j, f].tobytes() for i in range(3))) for k in range(classes) for j, node in enumerate(active[k]) for f in chosen[k]]
            out += [(0, loss.tobytes(), b"", b"")] if level == 0 and use_held else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PARTIAL)], schema=_PARTIAL)

    layout = "key bigint, gain double, bin int, missing_left boolean, lefts array<double>, rights array<double>, total array<double>"
    schema = pa.schema([("key", pa.int64()), ("gain", pa.float64()), ("bin", pa.int32()), ("missing_left", pa.bool_()), *[(c, pa.list_(pa.float64())) for c in ("lefts", "rights", "total")]])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, *parts in zip(*[batch.column(c).to_pylist() for c in ("key", "g", "h", "n")]):
                own = np.array([np.frombuffer(x, float) if x else np.zeros(MISSING + 1) for x in parts])
                sums[key] = sums[key] + own if key in sums else own
        out = []
        for key, own in sums.items():
            total = own.sum(axis=1).tolist() if key else own[0, :2].tolist()
            found = best_split(*own, p) if key else None
            out.append((key, *(found or (None, None, None, None, None)), total))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    partials = state.mapInArrow(partial, "key bigint, g binary, h binary, n binary")
    # a task holds the sums of its keys: spread by the key, about as many tasks as the session deals out to
    found = {r.key: r for r in partials.repartition("key").mapInArrow(decide, layout).collect()}
    loss = found.pop(0, None)
    return {(k >> 40, k >> 20 & 0xFFFFF, k & 0xFFFFF): r for k, r in found.items()}, loss.total[0] / loss.total[1] if loss and loss.total[1] else float("nan")


def _scored(state: DataFrame, splits: list[dict], leaves: list[dict[int, float]], p: Boosting, features: int) -> DataFrame:
    classes, walk = len(splits), Walk(splits, p.depth)
    values = np.zeros((classes, 2 << p.depth))
    for k, own in enumerate(leaves):
        for node, v in own.items():
            values[k, node] = v

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                *_, bins, scores = _columns(batch, features, classes)
                new = scores + np.stack([values[k, walk.nodes(k, bins, p.depth)] for k in range(classes)], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([r.tobytes() for r in new], pa.binary())], names=batch.schema.names)

    return state.mapInArrow(add, STATE)


def _best_first(found: dict[int, tuple], p: Boosting) -> dict[int, tuple]:
    """Of all splits that a tree of the depth could have, those that leaf-wise growth takes."""
    taken, heap = {}, [(-found[1][0], 1)] if 1 in found else []
    while heap and len(taken) < p.leaves - 1:
        _, node = heapq.heappop(heap)
        taken[node] = found[node]
        for c in (2 * node, 2 * node + 1):
            if c in found:
                heapq.heappush(heap, (-found[c][0], c))
    return taken


def _tree(splits: dict[int, tuple], leaves: dict[int, float], cuts: list[list[float]], shift: float) -> Tree:
    """A tree of the text format; shift is added to all leaves."""
    inner, outer = {n: i for i, n in enumerate(sorted(splits))}, {n: i for i, n in enumerate(sorted(leaves))}
    place = lambda n: inner[n] if n in inner else ~outer[n]
    order = sorted(splits)
    limit = lambda f, b: cuts[f][b] if b < len(cuts[f]) else float("inf")
    return Tree(
        [splits[n][0] for n in order], [limit(*splits[n][:2]) for n in order], [place(2 * n) for n in order], [place(2 * n + 1) for n in order],
        [leaves[n] + shift for n in sorted(leaves)], [NAN << 2 | DEFAULT_LEFT * splits[n][2] for n in order],
    )


def _run(state: DataFrame, names: Sequence[str], cuts: list[list[float]], prior: list[float], p: Boosting, use_held: bool) -> tuple[TreeModel, int, list[float]]:
    """(model, best number of rounds, losses on the held rows after each round)."""
    classes, features, rng = len(prior), len(names), np.random.default_rng(p.seed)
    trees, losses, best = [], [], (float("inf"), 0)
    kept = []
    for round_ in range(p.rounds + use_held):
        chosen = [sorted(rng.choice(features, max(1, round(p.column_share * features)), replace=False).tolist()) for _ in range(classes)]
        grown: list[dict[int, tuple]] = [{} for _ in range(classes)]
        stats: list[dict[int, list[float]]] = [{} for _ in range(classes)]
        for level in range(p.depth):
            splits = [{n: s[1:4] for n, s in own.items()} for own in grown]
            found, loss = _level(state, splits, level, chosen, round_, p, features, use_held)
            if level == 0 and use_held:
                losses.append(loss)
                if round_ and loss < best[0]:
                    best = (loss, round_)
                if round_ == p.rounds or round_ - best[1] >= p.patience:
                    for df in kept:
                        df.unpersist()
                    return TreeModel(list(names), classes, trees[: classes * best[1]]), best[1], losses
            for (k, node, f), r in sorted(found.items()):
                if level == 0:
                    stats[k][1] = r.total
                if r.gain is not None and (node not in grown[k] or r.gain > grown[k][node][0] + 1e-12):
                    grown[k][node] = (r.gain, f, r.bin, r.missing_left)
                    stats[k][2 * node], stats[k][2 * node + 1] = r.lefts, r.rights
            if not any(n >> level == 1 for own in grown for n in own):
                break
        taken = [_best_first(own, p) for own in grown]
        splits = [{n: s[1:4] for n, s in own.items()} for own in taken]
        ends = [sorted({c for n in own for c in (2 * n, 2 * n + 1)} - set(own) or {1}) for own in splits]
        leaves = [{n: float(p.rate * _leaf(stats[k][n][0], stats[k][n][1], p)) if splits[k] else 0.0 for n in ends[k]} for k in range(classes)]
        trees += [_tree(splits[k], leaves[k], cuts, prior[k] if round_ == 0 else 0.0) for k in range(classes)]
        state = _scored(state, splits, leaves, p, features)
        if round_ % CHECKPOINT == CHECKPOINT - 1:
            state = settled(state)
            for df in kept:
                df.unpersist()
            kept = []
        else:
            state = state.persist(StorageLevel.MEMORY_AND_DISK)
            kept.append(state)
    for df in kept:
        df.unpersist()
    return TreeModel(list(names), classes, trees), p.rounds, losses


def fit_boosted(rows: DataFrame, columns: Sequence[str], classes: int, params: Boosting = Boosting()) -> TreeModel:
    """Trees for rows (label int from 0, weight double, held boolean, and columns). If any row is held, fitting runs twice:
    on the others, until the held rows' loss has not fallen for `patience` rounds, then on all rows with the best number
    of rounds. Null and NaN features are missing. Scores start from the logarithms of the classes' weighted shares."""
    cuts = feature_cuts(rows, columns, params.bins)
    places = [F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.lit(MISSING)) for c in columns]
    values = F.array(*[F.col(c).cast("double") for c in columns])
    missing = F.array(*[F.coalesce(m, F.lit(0)) for m in places])
    start = F.struct(F.xxhash64(*columns, "label", "weight", *[c for c in ("timestamp",) if c in rows.columns]).alias("id"), F.col("label").cast("int").alias("y"), F.col("weight").cast("double").alias("w"), F.coalesce("held", F.lit(False)).alias("held"))
    totals = {r.label: r.w for r in rows.groupBy("label").agg(F.sum("weight").alias("w")).collect()}  # a row a class
    prior = [float(np.log(max(totals.get(k, 0.0), 1e-12) / sum(totals.values()))) for k in range(classes)]
    begin = np.array(prior).tobytes()

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = [np.array(c) for c in cuts]
        for batch in batches:
            n = batch.num_rows
            x = np.array(batch.column("x").to_pylist(), float).reshape(n, len(limits)) if n else np.zeros((0, len(limits)))
            gone = np.array(batch.column("gone").to_pylist(), int).reshape(n, len(limits)) == MISSING if n else np.zeros((0, len(limits)), bool)
            bins = np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(limits)], axis=1).astype(np.uint8)
            bins[gone] = MISSING
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "y", "w", "held")], pa.array([r.tobytes() for r in bins], pa.binary()), pa.array([begin] * n, pa.binary())], names=["id", "y", "w", "held", "bins", "scores"])

    filled = F.transform(values, lambda v: F.coalesce(v, F.lit(0.0)))
    state = settled(rows.select(start.alias("s"), filled.alias("x"), missing.alias("gone")).select("s.*", "x", "gone").mapInArrow(binned, STATE))
    if state.where("held").take(1):
        _, rounds, _ = _run(state, columns, cuts, prior, params, True)
        params = replace(params, rounds=max(1, rounds))
    return _run(state, columns, cuts, prior, params, False)[0]
