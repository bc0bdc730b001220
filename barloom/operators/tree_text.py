"""Boosted trees as text: read, write, and score with the trees as flat arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a split's type in the text format: by category, missing goes left; then what counts as missing (fixed values).
BY_CATEGORY, DEFAULT_LEFT = 1, 2
NOTHING, ZERO, NAN = 0, 1, 2
#: Values nearer to zero than this are zero in the format.
NEAR_ZERO = 1e-35


@dataclass(frozen=True)
class Tree:
    """Inner nodes from 0; a child below 0 is leaf ~child. decisions: a split's type. A split by category keeps the number of
    its set in thresholds; set i is the 32-bit words boundaries[i] to boundaries[i + 1] of words."""

    features: list[int]
    thresholds: list[float]
    left: list[int]
    right: list[int]
    leaves: list[float]
    decisions: list[int] = field(default_factory=list)
    boundaries: list[int] = field(default_factory=list)
    words: list[int] = field(default_factory=list)


@dataclass(frozen=True)
class TreeModel:
    names: list[str]
    classes: int
    trees: list[Tree]


def parse(text: str) -> TreeModel:
    """Read a dump of trees."""
    head, *parts = text.split("\nTree=")
    fields = lambda block: dict(line.split("=", 1) for line in block.splitlines() if "=" in line)
    top, trees = fields(head), []
    for part in parts:
        f = fields(part.split("\nend of trees")[0])
        numbers = lambda key, kind=float, f=f: [kind(x) for x in f.get(key, "").split()]
        if int(f.get("is_linear", 0)):
            raise ValueError("trees with linear leaves are not supported")
        trees.append(Tree(numbers("split_feature", int), numbers("threshold"), numbers("left_child", int), numbers("right_child", int), numbers("leaf_value"), numbers("decision_type", int), numbers("cat_boundaries", int), numbers("cat_threshold", int)))
    return TreeModel(top["feature_names"].split(), int(top["num_class"]), trees)


def dump(model: TreeModel) -> str:
    """The text that parse reads; numbers are written so that they read back as they are."""
    line = lambda key, values: f"{key}={' '.join(map(repr, values))}"
    head = ["tree", "version=v4", f"num_class={model.classes}", f"num_tree_per_iteration={model.classes}", "label_index=0", f"max_feature_idx={len(model.names) - 1}", f"objective=multiclass num_class:{model.classes}", f"feature_names={' '.join(model.names)}"]
    blocks = ["\n".join(head)]
    for i, t in enumerate(model.trees):
        own = [f"Tree={i}", f"num_leaves={len(t.leaves)}", f"num_cat={max(0, len(t.boundaries) - 1)}", line("split_feature", t.features), line("threshold", t.thresholds), line("decision_type", _decisions(t)), line("left_child", t.left), line("right_child", t.right), line("leaf_value", t.leaves)]
        if t.boundaries:
            own += [line("cat_boundaries", t.boundaries), line("cat_threshold", t.words)]
        blocks.append("\n".join([*own, "is_linear=0", "shrinkage=1"]))
    return "\n\n".join(blocks) + "\n\nend of trees\n"


def read_model(spark: SparkSession, path: str) -> TreeModel:
    return parse("\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect()))


def write_model(spark: SparkSession, model: TreeModel, path: str) -> None:
    spark.createDataFrame([(dump(model),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _decisions(tree: Tree) -> list[int]:
    return tree.decisions or [DEFAULT_LEFT] * len(tree.features)


class FlatTrees:
    """All trees in arrays, a node's children as places in them. A leaf is its own child, so walking on changes nothing."""

    def __init__(self, model: TreeModel) -> None:
        self.classes = model.classes
        features, limits, kinds, left, right, value, roots, sets = [], [], [], [], [], [], [], [np.zeros(0, bool)]
        self.depth = 0
        for t in model.trees:
            start, inner = len(features), len(t.features)
            place = lambda c, start=start, inner=inner: start + (c if c >= 0 else inner + ~c)
            roots.append(start)
            for n, (f, x, kind) in enumerate(zip(t.features, t.thresholds, _decisions(t))):
                if kind & BY_CATEGORY:
                    words = np.array(t.words[t.boundaries[int(x)] : t.boundaries[int(x) + 1]], "<u4")
                    sets.append(np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool))
                    x = len(sets) - 1
                features.append(f)
                limits.append(float(x))
                kinds.append(kind)
                left.append(place(t.left[n]))
                right.append(place(t.right[n]))
                value.append(0.0)
            for leaf in t.leaves:
                here = len(features)
                features.append(0)
                limits.append(0.0)
                kinds.append(DEFAULT_LEFT)
                left.append(here)
                right.append(here)
                value.append(leaf)
            self.depth = max(self.depth, _depth(t))
        self.features, self.kinds, self.left, self.right = (np.array(x, np.int64) for x in (features, kinds, left, right))
        self.limits, self.values, self.roots, self.sets = np.array(limits), np.array(value), roots, sets
        self.plain = bool(np.all((self.kinds == DEFAULT_LEFT)))

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sums of leaves (rows, classes) of x (rows, features): NaN is missing. Tree i is of class i modulo the classes."""
        out, rows = np.zeros((len(x), self.classes)), np.arange(len(x))
        x = np.ascontiguousarray(x, float)
        for i, root in enumerate(self.roots):
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(self._left(x[rows, self.features[node]], node), self.left[node], self.right[node])
            out[:, i % self.classes] += self.values[node]
        return out

    def _left(self, v: np.ndarray, node: np.ndarray) -> np.ndarray:
        missing = np.isnan(v)
        if self.plain:
            return np.where(missing, 0.0, v) <= self.limits[node]
        kind = self.kinds[node]
        means = kind >> 2 & 3
        lacks = np.where(means == NAN, missing, np.where(means == ZERO, missing | (np.abs(v) <= NEAR_ZERO), False))
        out = np.where(lacks, (kind & DEFAULT_LEFT) > 0, np.where(missing, 0.0, v) <= self.limits[node])
        for n in np.flatnonzero(kind & BY_CATEGORY):  # few: splits by category are looked up one by one
            own = self.sets[int(self.limits[node[n]])]
            out[n] = not missing[n] and 0 <= int(v[n]) < len(own) and own[int(v[n])]
        return out


def _depth(tree: Tree) -> int:
    deepest, open_ = 0, [(0, 1)] if tree.features else []
    while open_:
        node, depth = open_.pop()
        deepest = max(deepest, depth)
        open_ += [(c, depth + 1) for c in (tree.left[node], tree.right[node]) if c >= 0]
    return deepest


def score(rows: DataFrame, model: TreeModel, names: Sequence[str] = ("down", "neutral", "up")) -> DataFrame:
    """rows with the softmax of the classes' summed leaves. The trees go to every task once; a batch of rows walks a tree
    at a time, so time grows with trees times their depth and a model of any size is scored alike. Null and NaN features
    are missing."""
    used = sorted({f for t in model.trees for f in t.features})
    place = {f: i for i, f in enumerate(used)}
    local = TreeModel([model.names[f] for f in used], model.classes, [Tree([place[f] for f in t.features], t.thresholds, t.left, t.right, t.leaves, t.decisions, t.boundaries, t.words) for t in model.trees])
    shared = rows.sparkSession.sparkContext.broadcast(local)

    @F.pandas_udf("array<double>")
    def softmax(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        flat = FlatTrees(shared.value)
        for batch in batches:
            x = batch[[c for c in batch.columns if c.startswith("f")]].to_numpy(dtype=float, na_value=np.nan) if used else np.zeros((len(batch), 0))
            raw = flat.raw(x if used else np.zeros((len(batch), 1)))
            parts = np.exp(raw - raw.max(axis=1, keepdims=True))
            yield pd.Series(list(parts / parts.sum(axis=1, keepdims=True)))

    given = F.struct(F.lit(1).alias("row"), *[F.col(f"`{model.names[f]}`").cast("double").alias(f"f{i}") for i, f in enumerate(used)])
    out = rows.withColumn("_softmax", softmax(given))
    return out.withColumns({n: F.col("_softmax")[k] for k, n in enumerate(names)}).drop("_softmax")
