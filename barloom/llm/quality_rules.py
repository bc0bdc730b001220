"""Quality rules as a learned decision list.

Sequential covering over labelled text statistics: a rule, a conjunction of thresholds, is grown on two thirds of the
labelled rows by FOIL gain and pruned on the rest; rows that it covers leave, and the next rule is grown. The list is
applied as ordered Spark conditionals. Statistics, learning counts and verdicts are DataFrame expressions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import SPACE, materialize, table

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["n_words", "mean_word", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "long_line"]
#: Words of a window that counts as repeated.
WINDOW = 8


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more; windows are compared by 64-bit hashes."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = _let(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))

    def covered(at: Column) -> Column:
        spans = F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1), x + WINDOW) - x))
        return F.aggregate(spans, F.lit(0), lambda a, x: a + x)

    def twice(pairs: Column) -> Column:
        same = F.filter(pairs, lambda p, k: (p["h"] == F.get(pairs, k - 1)["h"]) | (p["h"] == F.get(pairs, k + 1)["h"]))
        return F.sort_array(F.transform(same, lambda p: p["i"]))

    def count(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), _let(_let(pairs, twice), covered)).otherwise(0)

    return F.when(F.size(words) > WINDOW, _let(windows, count)).otherwise(0).cast("long")


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the five base counts and FEATURES (ratios as doubles) of docs (doc_id long, text string)."""
    text, long = F.col("t"), "long"
    stripped = lambda keep: F.length(F.regexp_replace(text, keep, ""))
    cut = docs.select(F.col("doc_id").cast(long).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).select(
        "doc_id", "t",
        F.filter(F.split("t", f"[{SPACE}]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("t", "\n"), lambda line: line.rlike(f"[^{SPACE}]")).alias("lines"),
    )
    counted = cut.select(
        "doc_id",
        F.size("words").cast(long).alias("n_words"),
        stripped(f"[{SPACE}]+").cast(long).alias("word_chars"),
        stripped("[^#*$%&|<>]+").cast(long).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast(long).alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        stripped("[^A-Z]+").alias("_upper"), stripped("[^0-9]+").alias("_digits"), stripped("[^!?@_=~^;:]+").alias("_marks"),
        F.size("lines").alias("_lines"),
    )
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return counted.select(
        "doc_id", *BASE,
        part("word_chars", "n_words").alias("mean_word"), part("n_symbols", "word_chars").alias("symbols"),
        part("n_dup_lines", "_lines").alias("dup_lines"), part("n_repeat_words", "n_words").alias("repeats"),
        part("_upper", "word_chars").alias("upper"), part("_digits", "word_chars").alias("digits"), part("_marks", "word_chars").alias("marks"),
        part("n_words", "_lines").alias("long_line"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def holds(self) -> Column:
        value = F.col(self.feature).cast("double")
        return value > self.threshold if self.above else value <= self.threshold


@dataclass
class DecisionList:
    """Ordered rules; a row that a rule covers is rejected, all others are kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def rejects(self) -> Column:
        """Number of the first rule that covers the row, from 1; null if none does."""
        out = F.lit(None).cast("int")
        for n, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(_all(rule), F.lit(n)).otherwise(out)
        return out

    def __str__(self) -> str:
        said = [" and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:g}" for c in r) for r in self.rules]
        return "\n".join([f"if {x}: reject" for x in said] + ["else: keep"])


def _all(rule: list[Condition]) -> Column:
    return reduce(lambda a, b: a & b, (c.holds() for c in rule), F.lit(True))


def _with_middles(values: list[float]) -> list[float]:
    return sorted({*values, *((a + b) / 2 for a, b in zip(values, values[1:]))})


def _bin(feature: str, cuts: list[float]) -> Column:
    """Number of cuts below the feature's value."""
    return F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x < F.col(feature).cast("double")))


def learn_rules(labelled: DataFrame, features: list[str] = FEATURES, cuts: int = 16, max_rules: int = 8, max_conditions: int = 3, precision: float = 0.9, least: int = 3) -> DecisionList:
    """Learn from labelled (doc_id, features, bad boolean). Thresholds: `cuts` quantiles of each feature in each class.

    A rule needs `precision` on its own rows and `least` covered bad rows. Each step is one grouped count, whose result
    has at most 4 rows for each feature and threshold; no labelled row comes to the driver. Without bad rows the list is
    empty and keeps all.
    """
    steps = [(i + 0.5) / cuts for i in range(cuts)]
    wanted = F.array(*[F.lit(x) for x in steps])
    quantiles = labelled.groupBy("bad").agg(*[F.percentile_approx(F.col(f).cast("double"), wanted, F.lit(1000)).alias(f) for f in features]).collect()
    if not any(r.bad for r in quantiles):
        return DecisionList()
    cut = {f: _with_middles(sorted({x for r in quantiles for x in r[f]})) for f in features}
    binned = labelled.select(
        *features, "bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grow"),
        *[_bin(f, cut[f]).alias(f"bin_{f}") for f in features],
    )
    binned = materialize(binned, "labelled")

    def counts(rows: DataFrame) -> dict:
        """(feature, bin, bad, grow) -> rows."""
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"bin_{f}").alias("b")) for f in features])).alias("x")
        found = rows.select("bad", "grow", each).groupBy("x.f", "x.b", "bad", "grow").count().collect()
        return {(r.f, r.b, r.bad, r.grow): r["count"] for r in found}

    def covered(rule: list[Condition], rows: DataFrame, grow: bool) -> tuple[int, int]:
        r = rows.where(_all(rule) & (F.col("grow") == grow)).agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).first()
        return r.p, r.n

    learned, rest = DecisionList(), binned
    for _ in range(max_rules):
        rule: list[Condition] = []
        while len(rule) < max_conditions:
            got = counts(rest.where(_all(rule)))
            total = [sum(v for (f, _, bad, grow), v in got.items() if f == features[0] and grow and bad == want) for want in (True, False)]
            if not total[0] or not total[1]:
                break
            tied: list[Condition] = []
            gain = 1e-9
            for f in features:
                for k, threshold in enumerate(cut[f]):
                    low = [sum(v for (g, b, bad, grow), v in got.items() if g == f and grow and bad == want and b <= k) for want in (True, False)]
                    for above in (False, True):
                        p, n = (total[0] - low[0], total[1] - low[1]) if above else low
                        g = p * (math.log2(p / (p + n)) - math.log2(total[0] / sum(total))) if p else 0.0
                        if g > gain or g == gain and tied and (f, above) == (tied[0].feature, tied[0].above):
                            tied = [*(tied if g == gain else ()), Condition(f, above, threshold)]
                            gain = g
            if not tied:
                break
            rule.append(tied[len(tied) // 2])  # of thresholds that part the rows alike, the middle one
        if not rule:
            break
        worth = lambda pn: (pn[0] - pn[1]) / max(1, sum(pn))
        held = [(worth(covered(rule[: k + 1], rest, False)), -k) for k in range(len(rule))]
        rule = rule[: 1 - max(held)[1]]
        (p, n), (q, m) = covered(rule, rest, True), covered(rule, rest, False)
        if p + q < least or p + q < precision * (p + q + n + m):
            break
        learned.rules.append(rule)
        rest = rest.where(~_all(rule))
    return learned


def judge_quality(docs: DataFrame, labels: DataFrame, min_words: int = 20, max_repeat_percent: int = 30) -> tuple[DataFrame, DecisionList]:
    """Statistics and verdict for each row of docs (doc_id, text), learned from labels (doc_id, quality: 0 is bad).

    Returns (rows, list). rows: doc_id, the base counts, base_failed (fewer than min_words words, or more than
    max_repeat_percent of them repeated), kept (false if base_failed, else no rule covers it), rule (number of the rule
    that rejects it, else null) and FEATURES. The list is learned from labelled rows that don't fail the base. Null text
    has no words and fails. Labels that are null, or have no document, teach nothing; no labels: all are kept that pass
    the base. Repeated rows are judged alike. Other columns are ignored. An empty table gives an empty table.
    """
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    stats = materialize(text_statistics(docs), "text-statistics").withColumn("base_failed", failed)
    known = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") < 0.5).alias("bad"))
    rules = learn_rules(stats.where(~F.col("base_failed")).join(known, "doc_id"))
    judged = stats.withColumn("rule", rules.rejects()).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return judged, rules


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the learned verdict of all documents."""
    judged, _ = judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *BASE, "base_failed", "kept", "rule")
