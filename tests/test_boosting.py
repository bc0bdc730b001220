"""Boosting against a plain booster, its text format, and the flat-tree scorer against a plain walk."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom import sources
from barloom.operators import boosting, learners, tree_text
from barloom.operators.boosting import Boosting

T0 = datetime(2024, 1, 1)


def _plain_booster(x, y, w, classes, p, rounds):
    """Leaf-wise softmax boosting on raw values without sampling: returns the raw scores."""
    total = np.array([w[y == k].sum() for k in range(classes)])
    scores = np.tile(np.log(total / total.sum()), (len(x), 1))
    shrink = lambda g: np.maximum(np.abs(g) - p.l1, 0.0)

    def best(rows, g, h):
        found = None
        at = lambda r: (g[r].sum(), h[r].sum())
        worth = lambda s: shrink(s[0]) ** 2 / (s[1] + p.l2)
        for f in range(x.shape[1]):
            v = x[rows, f]
            for cut in np.unique(v[~np.isnan(v)]):
                for missing_left in (True, False):
                    left = (v <= cut) | (np.isnan(v) & missing_left)
                    a, b = rows[left], rows[~left]
                    if min(len(a), len(b)) < p.least_rows or min(at(a)[1], at(b)[1]) < p.least_hessian:
                        continue
                    gain = worth(at(a)) + worth(at(b)) - worth(at(rows))
                    if gain > 1e-10 and (found is None or gain > found[0] + 1e-9):
                        found = (gain, a, b)
        return found

    for _ in range(rounds):
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        chance, add = e / e.sum(axis=1, keepdims=True), np.zeros_like(scores)
        for k in range(classes):
            g, h = w * (chance[:, k] - (y == k)), w * chance[:, k] * (1 - chance[:, k]) * classes / (classes - 1)
            leaves = [(np.arange(len(x)), 0, best(np.arange(len(x)), g, h))]
            while len(leaves) < p.leaves:
                open_ = [i for i, (_, d, s) in enumerate(leaves) if s and d < p.depth]
                if not open_:
                    break
                i = max(open_, key=lambda i: leaves[i][2][0])
                _, d, (_, a, b) = leaves.pop(i)
                leaves += [(r, d + 1, best(r, g, h)) for r in (a, b)]
            if len(leaves) > 1:
                for r, _, _ in leaves:
                    add[r, k] = p.rate * -np.sign(g[r].sum()) * shrink(g[r].sum()) / (h[r].sum() + p.l2)
        scores = scores + add
    return scores


@pytest.fixture(scope="module")
def labelled():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(360, 3)), 1)
    x[rng.random(x.shape) < 0.06] = np.nan
    y = np.where(np.nan_to_num(x[:, 0]) + 0.3 * rng.normal(size=360) > 0.4, 2, np.where(np.nan_to_num(x[:, 1], nan=1.0) > 0, 1, 0))
    return x, y, np.round(rng.uniform(0.5, 2.0, 360), 3)


def _frame(spark, x, y, w, held=None):
    none = lambda v: None if np.isnan(v) else float(v)
    rows = [(T0 + i * timedelta(hours=1), int(k), float(wk), bool(held is not None and held[i]), *map(none, v)) for i, (v, k, wk) in enumerate(zip(x, y, w))]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, label int, weight double, held boolean, a double, b double, c double").repartition(3)


def test_boosting_equals_a_plain_booster(spark, labelled):
    x, y, w = labelled
    p = Boosting(rounds=3, leaves=6, depth=3, rate=0.3, row_share=1.0, column_share=1.0, least_rows=12)
    model = boosting.fit_boosted(_frame(spark, x, y, w), ["a", "b", "c"], 3, p)
    np.testing.assert_allclose(tree_text.FlatTrees(model).raw(x), _plain_booster(x, y, w, 3, p, 3), rtol=1e-6, atol=1e-9)
    assert max(len(t.leaves) for t in model.trees) <= 6


def test_boosting_stops_early_and_is_repeatable(spark, labelled):
    x, y, w = labelled
    held = np.arange(len(x)) >= 270
    p = Boosting(rounds=20, leaves=5, depth=3, rate=0.7, least_rows=10, patience=2)
    first = boosting.fit_boosted(_frame(spark, x, y, w, held), ["a", "b", "c"], 3, p)
    again = boosting.fit_boosted(_frame(spark, x, y, w, held).repartition(2), ["a", "b", "c"], 3, p)
    assert [(t.features, t.thresholds, t.left) for t in first.trees] == [(t.features, t.thresholds, t.left) for t in again.trees]
    assert all(a.leaves == pytest.approx(b.leaves, rel=1e-9) for a, b in zip(first.trees, again.trees))  # sums in another order
    assert 0 < len(first.trees) < 3 * 20 and len(first.trees) % 3 == 0
    raw = tree_text.FlatTrees(first).raw(x)
    assert np.mean(raw.argmax(axis=1) == y) > 0.8
    constant = boosting.fit_boosted(_frame(spark, np.zeros_like(x), y, w), ["a", "b", "c"], 3, Boosting(rounds=2))
    np.testing.assert_allclose(tree_text.FlatTrees(constant).raw(x)[0], np.log([w[y == k].sum() / w.sum() for k in range(3)]))


def test_boosted_classes_round_trip(spark, labelled, tmp_path):
    x, y, w = labelled
    df = _frame(spark, x, y, w).withColumn("target", F.col("label") - 1).drop("label", "held", "weight")
    fitted = learners.fit_trees(df, ["a", "b", "c"], params=Boosting(rounds=4, least_rows=10, leaves=6, depth=4))
    sources.save_model(fitted, f"{tmp_path}/model.txt")
    again = sources.load_model(f"{tmp_path}/model.txt", learners.BoostedClasses)
    assert again.model.trees == fitted.model.trees and again.model.names == ["a", "b", "c"]
    a, b = (learners.probabilities(m, df, "m15_lgbm").orderBy("timestamp").collect() for m in (fitted, again))
    assert a == b and all(r.m15_lgbm_down + r.m15_lgbm_neutral + r.m15_lgbm_up == pytest.approx(1) for r in a)
    assert json.dumps(tree_text.dump(again.model)) == json.dumps(tree_text.dump(fitted.model))


def _plain_walk(t, row):
    node = 0 if t.features else -1
    while node >= 0:
        v, kind, x = row[t.features[node]], t.decisions[node], t.thresholds[node]
        if kind & 1:
            words = t.words[t.boundaries[int(x)] : t.boundaries[int(x) + 1]]
            left = not np.isnan(v) and int(v) >= 0 and int(v) < 32 * len(words) and bool(words[int(v) // 32] >> (int(v) % 32) & 1)
        elif kind >> 2 == 2 and np.isnan(v) or kind >> 2 == 1 and (np.isnan(v) or abs(v) <= 1e-35):
            left = bool(kind & 2)
        else:
            left = (0.0 if np.isnan(v) else v) <= x
        node = t.left[node] if left else t.right[node]
    return t.leaves[~node]


def test_scorer_of_many_trees_with_categories_and_missing_values(spark):
    rng = np.random.default_rng(8)

    def tree():
        inner, features, limits, kinds, bounds, words = 14, [], [], [], [0], []
        for _ in range(inner):
            features.append(int(rng.integers(0, 4)))
            if features[-1] == 3:
                n = int(rng.integers(1, 3))
                limits.append(float(len(bounds) - 1))
                words += [int(v) for v in rng.integers(0, 1 << 32, n)]
                bounds.append(len(words))
                kinds.append(1)
            else:
                limits.append(float(rng.normal()))
                kinds.append(int(rng.choice([2, 0, 4, 6, 8, 10])))
        child = iter([*range(1, inner), *[~i for i in range(inner + 1)]])
        both = [(next(child), next(child)) for _ in range(inner)]
        return tree_text.Tree(features, limits, [a for a, _ in both], [b for _, b in both], [float(v) for v in rng.normal(size=inner + 1)], kinds, bounds if len(bounds) > 1 else [], words)

    model = tree_text.parse(tree_text.dump(tree_text.TreeModel(["p", "q", "r", "kind"], 3, [tree() for _ in range(1800)])))
    rows = [[None if rng.random() < 0.2 else 0.0 if rng.random() < 0.1 else float(v) for v in rng.normal(size=3)] + [None if rng.random() < 0.1 else float(rng.integers(-2, 80))] for _ in range(40)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p double, q double, r double, kind double").repartition(2)
    got = tree_text.score(df, model).orderBy("i").collect()
    for r, row in zip(got, rows):
        values = [np.nan if v is None else v for v in row]
        raw = np.zeros(3)
        for i, t in enumerate(model.trees):
            raw[i % 3] += _plain_walk(t, values)
        want = np.exp(raw - raw.max()) / np.exp(raw - raw.max()).sum()
        assert (r.down, r.neutral, r.up) == pytest.approx(tuple(want), rel=1e-9, abs=1e-12)
