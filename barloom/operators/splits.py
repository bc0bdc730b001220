"""Splits in time: ranges, expanding walk-forward folds, purging and embargo, and their audits."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, fields
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions import BLOCK, in_order, own_rows, with_halo
from barloom.operators.profile import not_finite

Bounds = Mapping[str, tuple[str, str]]


def split_of(bounds: Bounds, ts: str = "timestamp") -> Column:
    """Name of the range (both ends inclusive) that holds the timestamp; null outside."""
    out = F.lit(None).cast("string")
    for name, (lo, hi) in bounds.items():
        out = F.when(F.col(ts).between(F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz")), F.lit(name)).otherwise(out)
    return out


def temporal_split(rows: DataFrame, bounds: Bounds, purge: bool = False) -> DataFrame:
    """rows of the ranges with their split. With purge, rows whose label (label_end) ends in a later range go."""
    out = rows.withColumn("split", split_of(bounds)).where("split is not null")
    if not purge:
        return out
    ends = {name: hi for name, (_, hi) in bounds.items()}
    limit = F.create_map(*[x for k, v in ends.items() for x in (F.lit(k), F.lit(v).cast("timestamp_ntz"))])[F.col("split")]
    return out.where(F.col("label_end").isNull() | (F.col("label_end") <= limit))


def split_validation(split: DataFrame) -> DataFrame:
    """Each split's rows, range, distance from the split before, and whether it begins after that one's end."""
    each = split.groupBy("split").agg(F.count(F.lit(1)).alias("bars"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count_if(F.col("target").isNull()).alias("null_targets"))
    each = each.withColumn("before", F.lag("last").over(Window.orderBy("first")))  # a row a split
    return each.withColumn("gap_seconds", F.expr("timestampdiff(SECOND, before, first)")).withColumn("in_order", F.coalesce(F.col("first") > F.col("before"), F.lit(True))).drop("before")


def split_conservation(rows: DataFrame, split: DataFrame) -> DataFrame:
    """Rows before and after splitting, and whether every row within the splits' ranges is in exactly one."""
    ends = split.groupBy("split").agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"), F.count(F.lit(1)).alias("n"))
    bounds = ends.agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"), F.coalesce(F.sum("n"), F.lit(0)).alias("split_rows"))  # a range a split
    inside = F.exists("ranges", lambda r: F.col("timestamp").between(r["lo"], r["hi"]))
    out = rows.select("timestamp").crossJoin(F.broadcast(bounds)).agg(F.count(F.lit(1)).alias("all_rows"), F.count_if(inside).alias("rows_in_ranges"), F.max("split_rows").alias("split_rows"))
    return out.withColumn("preserved", F.col("rows_in_ranges") == F.col("split_rows"))


def year_purity(split: DataFrame, years: Sequence[int], name: str = "test") -> DataFrame:
    """Whether a split holds rows of the given years only, and all of them."""
    year = F.year("timestamp")
    out = split.where(F.col("split") == name).agg(F.count(F.lit(1)).alias("bars"), F.count_if(~year.isin(*years)).alias("foreign_bars"), F.count_distinct(year).alias("years"))
    return out.withColumn("pure", (F.col("foreign_bars") == 0) & (F.col("years") == len(years)))


def split_input_validation(rows: DataFrame, required: Sequence[str], ts: str = "timestamp") -> DataFrame:
    """Verdicts over a table before it is split: columns, type of the time, unique and non-null times, known classes,
    finite returns."""
    kinds = dict(rows.dtypes)
    present = not set(required) - set(rows.columns)
    typed = kinds.get(ts) in ("timestamp_ntz", "timestamp", "date")
    out = rows.agg(
        F.count(F.lit(1)).alias("bars"), F.lit(present).alias("columns_present"), F.lit(typed).alias("timestamp_typed"), F.count_if(F.col(ts).isNull()).alias("null_timestamps"),
        (F.count(ts) - F.count_distinct(ts)).alias("duplicate_timestamps"), F.count_if(F.col("target").isNull() | ~F.col("target").isin(-1, 0, 1)).alias("bad_targets"), F.count_if(F.col("future_return").isNull() | not_finite("future_return")).alias("bad_returns"),
    )
    good = F.col("columns_present") & F.col("timestamp_typed")
    for c in ("null_timestamps", "duplicate_timestamps", "bad_targets", "bad_returns"):
        good = good & (F.col(c) == 0)
    return out.withColumn("passed", good & (F.col("bars") > 0))


def split_overlap(split: DataFrame) -> DataFrame:
    """Timestamps that stand in more than one split, for each pair of splits."""
    keys = split.select("timestamp", "split").distinct()
    pairs = keys.alias("a").join(keys.alias("b"), (F.col("a.timestamp") == F.col("b.timestamp")) & (F.col("a.split") < F.col("b.split")))
    names = split.select("split").distinct()
    every = names.select(F.col("split").alias("left")).join(names.select(F.col("split").alias("right")), F.col("left") < F.col("right"))
    counted = pairs.groupBy(F.col("a.split").alias("left"), F.col("b.split").alias("right")).agg(F.count(F.lit(1)).alias("shared"))
    return every.join(counted, ["left", "right"], "left").select("left", "right", F.coalesce("shared", F.lit(0)).cast("long").alias("shared"))


def development_union(train: DataFrame, validation: DataFrame) -> DataFrame:
    return train.unionByName(validation)


def missing_years(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Years of first..last without a row."""
    wanted = rows.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    return wanted.join(rows.select(F.year("timestamp").alias("year")).distinct(), "year", "left_anti")


@dataclass(frozen=True)
class WalkForwardFold:
    """One fold's ranges and counts."""

    fold: int
    train_start: datetime
    train_end_before_purge: datetime
    train_end_after_purge: datetime
    validation_start: datetime
    validation_end: datetime
    train_rows_before_purge: int
    purged_rows: int
    train_rows_after_purge: int
    validation_rows: int
    purge_bars: int
    embargo_bars: int


class PurgedWalkForwardSplitter:
    """Expanding folds: train on the years from first_train_year up to the one before the validation year.

    A training row whose label ends in the validation year or later is purged. With embargo_bars > 0 (allow_embargo), so
    many of the last training rows that are left go too. A row past the end of the timeline has no label end: it is never
    purged.
    """

    def __init__(self, validation_years: Sequence[int], first_train_year: int, horizon_bars: int = 1, embargo_bars: int = 0, timestamp_col: str = "timestamp", by: Sequence[str] = (), allow_embargo: bool = False):
        years = list(validation_years)
        if not years or len(set(years)) != len(years) or years != sorted(years):
            raise ValueError("validation_years must be distinct and rising")
        if first_train_year >= years[0]:
            raise ValueError("no year is left to train on")
        if horizon_bars < 1:
            raise ValueError("horizon_bars must be 1 or more")
        if embargo_bars < 0 or embargo_bars and not allow_embargo:
            raise ValueError("embargo_bars must be 0")
        self.years, self.first, self.horizon, self.embargo, self.ts, self.by = years, first_train_year, horizon_bars, embargo_bars, timestamp_col, list(by)

    def validate(self, rows: DataFrame) -> None:
        if self.ts not in rows.columns:
            raise ValueError(f"no column {self.ts}")
        key = [*self.by, self.ts]
        r = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(self.ts).isNull()).alias("nulls")).first()
        if not r.n or r.nulls or rows.select(*key).distinct().count() != r.n:
            raise ValueError("timestamps must be there, without nulls and unique")

    def tagged(self, rows: DataFrame) -> DataFrame:
        """rows with fold (from 1), role (train, purged, embargoed or validation) and label_end; a row stands once in
        each fold that uses it."""
        spread = with_halo(rows, after=self.horizon, ts=self.ts, by=self.by)
        spread = spread.withColumn("label_end", F.lead(self.ts, self.horizon).over(in_order([*self.by, BLOCK], self.ts)))
        year = F.year(self.ts)
        labelled = own_rows(spread).where(year.between(self.first, self.years[-1]))
        folds = F.array(*[F.struct(F.lit(n).alias("fold"), F.lit(y).alias("year")) for n, y in enumerate(self.years, 1)])
        out = labelled.withColumn("_f", F.explode(F.filter(folds, lambda f: f["year"] >= year)))
        start = F.make_timestamp_ntz(F.col("_f.year"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        late = F.coalesce(F.col("label_end") >= start, F.lit(False))
        role = F.when(year == F.col("_f.year"), "validation").when(late, "purged").otherwise("train")
        out = out.withColumn("fold", F.col("_f.fold")).withColumn("role", role).drop("_f")
        if self.embargo:
            last = F.row_number().over(Window.partitionBy(*self.by, "fold", "role").orderBy(F.desc(self.ts)))
            out = out.withColumn("role", F.when((F.col("role") == "train") & (last <= self.embargo), "embargoed").otherwise(F.col("role")))
        return out

    def with_test_boundary(self, rows: DataFrame, test_year: int) -> DataFrame:
        """tagged(rows), and as one more fold the boundary from the last year before the test year to it."""
        last = PurgedWalkForwardSplitter([test_year], test_year - 1, self.horizon, self.embargo, self.ts, self.by, self.embargo > 0)
        return self.tagged(rows).unionByName(last.tagged(rows).withColumn("fold", F.lit(len(self.years) + 1)))

    def fold_table(self, rows: DataFrame) -> DataFrame:
        """One row a fold, with the fields of WalkForwardFold."""
        ts, role = F.col(self.ts), F.col("role")
        trained = role.isin("train", "purged", "embargoed")
        return self.tagged(rows).groupBy("fold").agg(
            F.min(F.when(trained, ts)).alias("train_start"), F.max(F.when(trained, ts)).alias("train_end_before_purge"), F.max(F.when(role == "train", ts)).alias("train_end_after_purge"),
            F.min(F.when(role == "validation", ts)).alias("validation_start"), F.max(F.when(role == "validation", ts)).alias("validation_end"),
            F.count_if(trained).alias("train_rows_before_purge"), F.count_if(role == "purged").alias("purged_rows"), F.count_if(role == "train").alias("train_rows_after_purge"),
            F.count_if(role == "validation").alias("validation_rows"), F.lit(self.horizon).alias("purge_bars"), F.lit(self.embargo).alias("embargo_bars"),
        )

    def split(self, rows: DataFrame) -> Iterator[tuple[DataFrame, DataFrame, WalkForwardFold]]:
        """(train rows, validation rows, fold) in the order of the folds."""
        self.validate(rows)
        tagged = self.tagged(rows)
        names = [f.name for f in fields(WalkForwardFold)]
        for r in self.fold_table(rows).orderBy("fold").collect():  # a row a fold
            if not r.train_rows_after_purge or not r.validation_rows:
                raise ValueError(f"fold {r.fold} has no rows to train or validate on")
            own = tagged.where(F.col("fold") == r.fold)
            yield own.where("role = 'train'"), own.where("role = 'validation'"), WalkForwardFold(**{n: r[n] for n in names})


def fold_rows(folds: Sequence[WalkForwardFold]) -> list[dict]:
    return [asdict(f) for f in folds]


def walk_forward_folds(rows: DataFrame, validation_years: Sequence[int], first_train_year: int, least_train_years: int = 3) -> DataFrame:
    """Each fold's years and rows before purging. Ranges of the timestamp, so the scan can skip what they leave out."""
    if any(y - first_train_year < least_train_years for y in validation_years):
        raise ValueError(f"a fold has fewer than {least_train_years} years to train on")
    start, ts = (lambda y: F.lit(datetime(y, 1, 1)).cast("timestamp_ntz")), F.col("timestamp")
    aggs = []
    for y in validation_years:
        aggs += [F.count_if((ts >= start(first_train_year)) & (ts < start(y))).alias(f"t{y}"), F.count_if((ts >= start(y)) & (ts < start(y + 1))).alias(f"v{y}")]
    counts = rows.where((ts >= start(first_train_year)) & (ts < start(max(validation_years) + 1))).agg(*aggs)
    each = [F.struct(F.lit(n).alias("fold"), F.lit(first_train_year).alias("first_train_year"), F.lit(y - 1).alias("last_train_year"), F.lit(y).alias("validation_year"), F.col(f"t{y}").alias("train_bars"), F.col(f"v{y}").alias("validation_bars")) for n, y in enumerate(validation_years, 1)]
    return counts.select(F.inline(F.array(*each)))


def fold_independence(folds: DataFrame) -> DataFrame:
    """Each fold with whether it trains before it validates, and validates after the fold before."""
    w = Window.orderBy("fold")  # a row a fold
    return folds.select("fold", (F.col("train_end_after_purge") < F.col("validation_start")).alias("train_before_validation"), F.coalesce(F.col("validation_start") > F.lag("validation_end").over(w), F.lit(True)).alias("after_previous"))


def purge_audit(tagged: DataFrame) -> DataFrame:
    """Each boundary's training rows whose labels reach into the validation range, with the gap the purge leaves."""
    role = F.col("role")
    each = tagged.groupBy("fold").agg(
        F.count_if(role == "purged").alias("purged_bars"), F.max(F.when(role == "train", F.col("timestamp"))).alias("train_end"), F.min(F.when(role == "validation", F.col("timestamp"))).alias("validation_start"),
        F.count_if((role == "train") & F.col("label_end").isNull()).alias("open_labels"), F.count_if(role == "embargoed").alias("embargoed_bars"),
    )
    return each.withColumn("gap_seconds", F.expr("timestampdiff(SECOND, train_end, validation_start)")).withColumn("clean", F.col("train_end") < F.col("validation_start"))


def purge_totals(audit: DataFrame) -> DataFrame:
    return audit.agg(F.count(F.lit(1)).alias("boundaries"), F.sum("purged_bars").alias("purged_bars"), F.bool_and("clean").alias("all_clean"))


def boundary_totals(audit: DataFrame) -> DataFrame:
    """purge_totals with what the boundaries ask for: whether any has rows to purge, and whether none has an embargo."""
    return audit.agg(
        F.count(F.lit(1)).alias("boundaries"), F.sum("purged_bars").alias("purged_bars"), F.bool_or(F.col("purged_bars") > 0).alias("purge_required"),
        F.sum("embargoed_bars").alias("embargoed_bars"), F.bool_and(F.col("embargoed_bars") == 0).alias("no_embargo"), F.bool_and("clean").alias("all_clean"),
    )


def horizon_audit(rows: DataFrame, step_seconds: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows whose next bar is exactly one step away, others, and the verdict."""
    spread = with_halo(rows.select(*by, "timestamp"), after=1, by=by)
    spread = spread.withColumn("after", F.lead("timestamp").over(in_order([*by, BLOCK])))
    step = own_rows(spread).where("after is not null")
    exact = F.expr(f"timestampdiff(SECOND, timestamp, after) = {step_seconds}")
    return step.agg(F.count_if(exact).alias("exact"), F.count_if(~exact).alias("other")).withColumn("verdict", F.when(F.col("other") == 0, "PASS").otherwise("REVIEW"))


def leakage_audit(split: DataFrame, names: Sequence[str]) -> DataFrame:
    """Verdicts over a split table: order of the splits, shared timestamps, target there, suspicious feature names."""
    ordered = split_validation(split).agg(F.bool_and("in_order").alias("splits_in_order"), (F.sum("null_targets") == 0).alias("targets_present"))
    shared = split_overlap(split).agg((F.coalesce(F.sum("shared"), F.lit(0)) == 0).alias("no_shared_timestamps"))
    steps = split.agg((F.count("timestamp") == F.count(F.lit(1))).alias("no_null_timestamps"))
    out = ordered.crossJoin(shared).crossJoin(steps).withColumn("suspicious_names", F.lit(len(names)).cast("long"))  # one row each
    checks = F.col("splits_in_order") & F.col("targets_present") & F.col("no_shared_timestamps") & F.col("no_null_timestamps")
    return out.withColumn("verdict", F.when(~checks, "FAIL").when(F.col("suspicious_names") > 0, "REVIEW").otherwise("PASS"))


def validation_report(rows: DataFrame, folds: DataFrame, test_from: date | str) -> DataFrame:
    """One row of eight checks and the verdict: times unique and there, folds filled, in order, independent and purged at
    each boundary, and the test range isolated from rows and folds."""
    start = F.lit(str(test_from)).cast("timestamp_ntz")
    ts = F.col("timestamp")
    own = rows.agg((F.count(ts) == F.count_distinct(ts)).alias("unique_timestamps"), (F.count_if(ts.isNull()) == 0).alias("no_null_timestamps"), (F.max(F.when(ts < start, ts)) < F.min(F.when(ts >= start, ts))).alias("test_isolated"))
    after = F.coalesce(F.col("validation_start") > F.lag("validation_end").over(Window.orderBy("fold")), F.lit(True))  # a row a fold
    fold = folds.withColumn("_after", after).agg(
        F.bool_and(F.col("train_end_after_purge") < F.col("validation_start")).alias("folds_in_order"), F.bool_and(F.col("purged_rows") >= F.col("purge_bars")).alias("all_purged"), F.bool_and(F.col("validation_end") < start).alias("folds_before_test"),
        F.bool_and((F.col("train_rows_after_purge") > 0) & (F.col("validation_rows") > 0)).alias("folds_filled"), F.bool_and("_after").alias("folds_independent"),
    )
    out = own.crossJoin(fold)  # one row each
    return out.withColumn("verdict", F.when(F.forall(F.array(*out.columns), lambda x: F.coalesce(x, F.lit(False))), "PASS").otherwise("FAIL"))
