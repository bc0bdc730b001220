"""Base learners: preparation fitted on training rows only, MLlib pipelines, and checks of prediction tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import exact_percentiles, finite
from barloom.operators.boosting import Boosting, fit_boosted
from barloom.operators.ensemble import LEARNERS, SIDES, prediction_columns
from barloom.operators.metrics import class_weights
from barloom.operators.quality import timestamp_quality
from barloom.operators.trading import unique_by
from barloom.operators.tree_text import TreeModel, read_model, score, write_model

CLASSES = (-1, 0, 1)


def train_medians(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, median) by exact linear interpolation; raises if a column has no value to learn from."""
    found = exact_percentiles(train, columns, [0.5]).select(F.col("column").alias("feature"), F.col("value").alias("median"))
    if empty := [r.feature for r in found.where("median is null").collect()]:
        raise ValueError(f"no values in {empty}")
    return found


def impute(rows: DataFrame, medians: DataFrame) -> DataFrame:
    """Nulls of each feature replaced by its median (a row a feature)."""
    known = {r.feature: r.median for r in medians.collect()}
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in known.items()})


def clean_train(train: DataFrame, columns: Sequence[str], ceiling: float = 0.02) -> DataFrame:
    """Training rows without missing or infinite features; raises if more than `ceiling` of them would go."""
    good = F.lit(True)
    for c in columns:
        good = good & finite(F.col(c)).isNotNull()
    r = train.agg(F.count(F.lit(1)).alias("n"), F.count_if(~good).alias("bad")).first()
    if r.n and r.bad > ceiling * r.n:
        raise ValueError(f"{r.bad} of {r.n} training rows have bad values")
    return train.where(good)


def with_class_weights(train: DataFrame) -> DataFrame:
    """train with column weight, balanced over the classes (one row a class)."""
    weights = {r.target: r.weight for r in class_weights(train).collect()}
    pairs = [F.lit(x) for kv in weights.items() for x in kv]
    return train.withColumn("weight", F.create_map(*pairs)[F.col("target")])


def _labelled(rows: DataFrame) -> DataFrame:
    return rows.withColumn("label", (F.col("target") + 1).cast("double"))


def fit_logistic(train: DataFrame, columns: Sequence[str], iterations: int = 2000) -> PipelineModel:
    """Standardised multinomial regression with balanced weights; the penalty is that of C = 1."""
    weighted = _labelled(with_class_weights(train))
    total = weighted.agg(F.sum("weight")).first()[0]
    stages = [
        VectorAssembler(inputCols=list(columns), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        LogisticRegression(family="multinomial", regParam=1.0 / total, elasticNetParam=0.0, standardization=False, weightCol="weight", maxIter=iterations),
    ]
    return Pipeline(stages=stages).fit(weighted)


@dataclass(frozen=True)
class BoostedClasses:
    """Boosted trees of all classes; saved in the text format."""

    model: TreeModel

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with array odds: each class's probability."""
        names = [f"_p{n}" for n in range(len(CLASSES))]
        return score(rows, self.model, names).withColumn("odds", F.array(*names)).drop(*names)

    def save(self, path: str) -> None:
        write_model(SparkSession.active(), self.model, path)

    @staticmethod
    def load(path: str) -> BoostedClasses:
        return BoostedClasses(read_model(SparkSession.active(), path))


def fit_trees(train: DataFrame, columns: Sequence[str], inner_from: str | None = None, inner_share: float = 0.2, params: Boosting = Boosting()) -> BoostedClasses:
    """Boosted trees with balanced classes, in two phases: on the rows before inner_from, with those after it telling when
    to stop, then on all rows with the number of rounds found. Without inner_from the last inner_share of the time span
    is held back."""
    ready = with_class_weights(train).withColumn("label", F.col("target") + 1)
    seconds = lambda c: F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01', {c})")
    if inner_from is None:
        ends = ready.agg(F.min(seconds("timestamp")).alias("lo"), F.max(seconds("timestamp")).alias("hi")).first()
        held = seconds("timestamp") > ends.hi - inner_share * (ends.hi - ends.lo)
    else:
        held = F.col("timestamp") >= F.lit(inner_from).cast("timestamp_ntz")
    return BoostedClasses(fit_boosted(ready.withColumn("held", held), columns, len(CLASSES), params))


def probabilities(model: PipelineModel | BoostedClasses, rows: DataFrame, name: str, keep: Sequence[str] = ("timestamp", "target"), present: Sequence[int] = CLASSES) -> DataFrame:
    """rows' keys and the learner's probabilities as <name>_down, _neutral, _up; present: the classes in the order in
    which the learner gives them."""
    out = model.transform(_labelled(rows))
    values = F.col("odds") if "odds" in out.columns else vector_to_array("probability")
    out = out.select(*keep, reorder_classes(values, present).alias("_p"))
    return out.select(*keep, *[F.col("_p")[i].alias(f"{name}_{s}") for i, s in enumerate(SIDES)])


def reorder_classes(values: Column, present: Sequence[int]) -> Column:
    """Array of probabilities in the order of `present`, put into the order of the classes."""
    if missing := set(CLASSES) - set(present):
        raise ValueError(f"the learner never saw classes {sorted(missing)}")
    return F.array(*[values[list(present).index(c)] for c in CLASSES])


def join_blocks(blocks: Sequence[DataFrame]) -> DataFrame:
    """Prediction blocks joined by timestamp, in the order of the file's columns. A timestamp that repeats in a block, is
    in one only, or has different targets fails the job: nothing is dropped silently."""
    out = unique_by(blocks[0], ["timestamp"])
    for b in blocks[1:]:
        other = unique_by(b, ["timestamp"]).withColumnRenamed("target", "_target").withColumn("_there", F.lit(True))
        both = out.withColumn("_here", F.lit(True)).join(other, "timestamp", "full")
        same = F.col("_here").isNotNull() & F.col("_there").isNotNull() & F.equal_null("target", "_target")
        failed = F.raise_error(F.concat(F.lit("blocks differ at "), F.col("timestamp").cast("string")))
        out = both.withColumn("target", F.when(same, F.col("target")).otherwise(failed.cast(out.schema["target"].dataType))).drop("_target", "_here", "_there")
    return out.select(*[c for c in prediction_columns() if c in out.columns])


def prediction_alignment(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two blocks that stand in one only, or with different targets."""
    a, b = left.select("timestamp", F.col("target").alias("left_target")), right.select("timestamp", F.col("target").alias("right_target"))
    both = a.withColumn("_l", F.lit(1)).join(b.withColumn("_r", F.lit(1)), "timestamp", "full")
    return both.agg(
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("shared"), F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"),
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull() & ~F.equal_null("left_target", "right_target")).alias("targets_differ"),
    )


def audit_predictions(rows: DataFrame, expected_rows: int | None = None, tolerance: float = 1e-3, order: str | None = None) -> DataFrame:
    """Verdicts over a prediction table: names and order, rows, targets, sums, signs, unique timestamps, and with `order`
    (a column of ordinals of the ingest, which is no column of the table) whether times rise in it."""
    names = prediction_columns()
    named = [c for c in rows.columns if c != order] == names
    sums = [F.abs(sum((F.col(f"{k}_{s}") for s in SIDES), F.lit(0.0)) - 1) for k in LEARNERS]
    least = F.least(*[F.col(c) for c in names[2:]])
    out = rows.agg(
        F.lit(named).alias("names_match"), F.count(F.lit(1)).alias("bars"), F.count_if(F.col("target").isNull() | ~F.col("target").isin(*CLASSES)).alias("bad_targets"), F.max(F.greatest(*sums)).alias("max_deviation"),
        F.count_if(least < 0).alias("negative"), (F.count(F.lit(1)) - F.count_distinct("timestamp")).alias("duplicate_timestamps"), F.count_if(F.col("timestamp").isNull()).alias("null_timestamps"),
    )
    good = F.col("names_match") & (F.col("bad_targets") == 0) & (F.col("max_deviation") <= tolerance) & (F.col("negative") == 0) & (F.col("duplicate_timestamps") == 0)
    if expected_rows is not None:
        good = good & (F.col("bars") == expected_rows)
    if order is not None:
        out = out.crossJoin(timestamp_quality(rows, order).select("steps_back"))  # one row each
        good = good & (F.col("steps_back") == 0)
    return out.withColumn("passed", F.coalesce(good, F.lit(False)))


def row_drift(counts: dict[str, int], expected: dict[str, int]) -> dict[str, int]:
    """Splits whose rows differ from the expected number, for a log."""
    return {k: counts.get(k, 0) - v for k, v in expected.items() if counts.get(k, 0) != v}
