"""Column functions. Missing values are NULL everywhere, never NaN or infinity."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

EPSILON = 1e-12


def safe_divide(a: Column, b: Column) -> Column:
    """a / (|b| + epsilon): never divides by zero; null if either is."""
    return a / (F.abs(b) + F.lit(EPSILON))


def change(now: Column, before: Column) -> Column:
    """now / before - 1; null where before is 0 or missing."""
    return F.try_divide(now.cast("double"), before.cast("double")) - 1


def both_max(a: Column, b: Column) -> Column:
    """Greater of two; null if either is null (greatest() would skip it)."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def both_min(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def holds(condition: Column) -> Column:
    """Condition with null as false."""
    return F.coalesce(condition, F.lit(False))


def rolling(aggregate, value: Column, over: WindowSpec, rows: int) -> Column:
    """Aggregate of the last `rows` rows; null until as many values are there."""
    frame = over.rowsBetween(1 - rows, 0)
    return F.when(F.count(value).over(frame) >= rows, aggregate(value).over(frame))


def in_order(by: Sequence[str] = (), ts: str = "timestamp") -> WindowSpec:
    """Rows of one symbol, or of one block of a series, in time order; without `by` one partition, for small tables."""
    return Window.partitionBy(*by).orderBy(ts) if by else Window.orderBy(ts)


#: A series, of one symbol or of none, is cut into blocks, so that no task sorts the whole of it: days or numbers of a block.
BLOCK_DAYS, BLOCK_NUMBERS = 30, 1_000_000
BLOCK, OWN = "_block", "_own"


def block_of(rows: DataFrame, ts: str | Column) -> Column:
    """Number of the block of a timestamp, date or ordinal; nulls come first."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    kind = rows.select(ts.alias("t")).schema["t"].dataType.typeName()
    at = F.date_diff(ts, F.lit("1970-01-01").cast("date")) if kind in ("timestamp_ntz", "timestamp", "date") else F.floor(ts / BLOCK_NUMBERS * BLOCK_DAYS)
    return F.coalesce(F.floor(at / BLOCK_DAYS).cast("long"), F.lit(-(1 << 62)))


def with_block(rows: DataFrame, by: Sequence[str] = (), ts: str = "timestamp") -> DataFrame:
    """rows with BLOCK. Rows that lack a symbol are one block: keys of null meet in no join."""
    block = block_of(rows, ts)
    for k in by:
        block = F.when(F.col(k).isNotNull(), block).otherwise(F.lit(0).cast("long"))
    return rows.withColumn(BLOCK, block)


def in_blocks(rows: DataFrame, by: Sequence[str] = (), ts: str = "timestamp") -> DataFrame:
    """rows with BLOCK, dealt out by symbol and block; rows that have BLOCK are so already. Windows over both, and what is
    grouped by or joined on both, need no other exchange of them."""
    return rows if BLOCK in rows.columns else with_block(rows, by, ts).repartition(*by, BLOCK)


def join_blocks(rows: DataFrame, blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows with the columns of blocks (a row for each symbol and block); null for rows that lack a symbol. The keys of
    blocks pass through a window, beyond which no filter of null keys is pushed: so both sides read one exchange of rows."""
    keys = [*by, BLOCK]
    same, own = F.lit(True), Window.partitionBy(*keys)
    for k in keys:
        same = same & (rows[k] == F.col(f"_of_{k}"))
    named = blocks.withColumns({f"_of_{k}": F.max(k).over(own) for k in keys}).drop(*keys)
    return rows.join(named, same, "left").drop(*[f"_of_{k}" for k in keys])


def _blocks_in_order(by: Sequence[str], later: bool = False) -> WindowSpec:
    """Over tables of one row a block."""
    order = F.col(BLOCK).desc() if later else F.col(BLOCK).asc()
    return Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)


def with_halo(rows: DataFrame, before: int = 0, after: int = 0, ts: str = "timestamp", by: Sequence[str] = ()) -> DataFrame:
    """rows in blocks, each block with the `before` rows that precede it and the `after` rows that follow it in the series
    (OWN is false for those). A window over (by, BLOCK) in the order of ts then sees what one over the whole series would.
    The rows go through one exchange; only the ends of a block are gathered, and one small row a block meets the others."""
    at = in_blocks(rows, by, ts)
    keys, kept = [*by, BLOCK], [c for c in rows.columns if c not in (*by, BLOCK)]
    w = Window.partitionBy(*keys).orderBy(ts)
    whole, sides = at, {}
    for size, ahead in ((before, False), (after, True)):
        if not size:
            continue
        near = at.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(ts).asc() if ahead else F.col(ts).desc()))).where(F.col("_place") <= size)
        ends = near.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_place", F.struct(*kept).alias("row")))).alias("_rows"))
        met = F.slice(F.flatten(F.collect_list("_rows").over(_blocks_in_order(by, not ahead).rowsBetween(1, size))), 1, size)
        name = "_following" if ahead else "_preceding"
        whole = join_blocks(whole, ends.select(*keys, met.alias(name)), by)
        sides[name] = F.row_number().over(w) == 1 if not ahead else F.lead(F.lit(1)).over(w).isNull()
    whole = whole.withColumns({f"{n}_here": v for n, v in sides.items()})
    own = F.array(F.struct(*kept, F.lit(True).alias(OWN)))
    ghosts = [F.when(F.col(f"{n}_here"), F.transform(n, lambda g: F.struct(*[g["row"][c].alias(c) for c in kept], F.lit(False).alias(OWN)))) for n in sides]
    every = F.concat(own, *[F.coalesce(g, F.array().cast(whole.select(own.alias("o")).schema["o"].dataType)) for g in ghosts]) if ghosts else own
    return whole.select(*keys, F.inline(every))


def own_rows(rows: DataFrame, keep_block: bool = False) -> DataFrame:
    return rows.where(OWN).drop(OWN) if keep_block else rows.where(OWN).drop(BLOCK, OWN)


def carried(rows: DataFrame, aggregate: Column, over_blocks: Callable[[Column], Column], later: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """rows (by, BLOCK) with _carry: over_blocks of the aggregate of each block of their symbol before theirs (later: after)."""
    w = _blocks_in_order(by, later).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*by, BLOCK).agg(aggregate.alias("_a")).select(*by, BLOCK, over_blocks(F.col("_a")).over(w).alias("_carry"))
    return join_blocks(rows, blocks, by)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, that of spark.checkpoint.dir, which all machines see. A local session that names
    none gets a temporary one; on a cluster that would be another folder on every machine."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="barloom-"))
    return context.getCheckpointDir()


def settled(rows: DataFrame) -> DataFrame:
    """rows, computed once into the shared folder, for what is read several times over."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def finite(value: Column) -> Column:
    """NaN and infinities as null."""
    value = value.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def period_start(ts: Column, period: str) -> Column:
    """Start of the hour or day of a timestamp without zone."""
    return F.date_trunc(period, ts).cast("timestamp_ntz")


def argmax_class(columns: Sequence[Column], classes: Sequence[int]) -> Column:
    """Class of the greatest probability, the first of them on ties."""
    values = F.array(*columns)
    return F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position(values, F.array_max(values)).cast("int"))


def sharpe(value: Column) -> Column:
    """Mean over population deviation; 0 for no values or no deviation."""
    deviation = F.stddev_pop(value)
    return F.coalesce(F.when(deviation >= 1e-12, F.avg(value) / deviation), F.lit(0.0))


#: Values between two bounds that are sorted at once (8 bytes each), and quantiles of a round that narrows the bounds.
SORTED_VALUES, GRID = 100_000, 256


def exact_percentiles(rows: DataFrame, columns: Sequence[str], shares: Sequence[float], sorted_values: int = SORTED_VALUES, by: Sequence[str] = ()) -> DataFrame:
    """(by, column, share, value): exact percentiles of columns as doubles, by linear interpolation; null without values.

    No task sorts a column: of every group, column and rank wanted, a round takes approximate quantiles of the values
    between two bounds, counts exactly what lies below, between and on the nearest two, and keeps the part that holds the
    rank, about a sixtieth; until it is one value, or no more than sorted_values. All groups are narrowed at once."""
    keys = [*by, "column"]
    of_group = rows.groupBy(*by).agg(*[F.count_if(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))).alias(f"_n{i}") for i, c in enumerate(columns)])
    counts = of_group.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("_n")) for i, c in enumerate(columns)])))
    each = F.array(*[F.struct(F.lit(float(p)).alias("share"), ((F.col("_n") - 1) * float(p)).alias("_rank")) for p in shares])
    wanted = settled(counts.select(*keys, "_n", F.inline(each)))
    values = rows.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_v")) for c in columns]))).where("_v is not null and not isnan(_v)")
    none = F.lit(None).cast("double")
    # bounds are no part of what they enclose; null bounds none
    state = wanted.where("_n > 0").select(*keys, "_n", F.explode(F.array(F.floor("_rank"), F.ceil("_rank"))).alias("_k")).distinct().withColumns({"_low": none, "_high": none, "_below": F.lit(0).cast("long"), "value": none})

    def inside(open_: DataFrame) -> DataFrame:
        same = F.lit(True)
        for k in keys:
            same = same & F.col(f"_v_{k}").eqNullSafe(F.col(k))
        named = values.withColumnsRenamed({k: f"_v_{k}" for k in keys})
        between = (F.col("_low").isNull() | (F.col("_v") > F.col("_low"))) & (F.col("_high").isNull() | (F.col("_v") < F.col("_high")))
        return named.join(open_, same & between).drop(*[f"_v_{k}" for k in keys])

    ids = [*keys, "_k"]
    while (open_ := state.where(F.col("value").isNull() & (F.col("_n") > sorted_values))).take(1):
        grid = F.array(*[F.lit(i / GRID) for i in range(1, GRID)])
        narrowed = inside(open_).groupBy(*ids, "_n", "_low", "_high", "_below").agg(F.percentile_approx("_v", grid, F.lit(20 * GRID)).alias("_q"))
        place = F.floor(GRID * (F.col("_k") - F.col("_below") + 0.5) / F.col("_n")).cast("int")
        edge = lambda shift: F.col("_q")[F.greatest(F.lit(0), F.least(F.lit(GRID - 2), place - 1 + shift))]
        narrowed = settled(narrowed.withColumns({"_left": edge(-1), "_right": edge(2)}).drop("_q"))
        v = F.col("_v")
        told = inside(narrowed).groupBy(*ids, "_n", "_low", "_high", "_below", "_left", "_right").agg(*[F.count_if(c).alias(n) for n, c in (("_lt_left", v < F.col("_left")), ("_le_left", v <= F.col("_left")), ("_lt_right", v < F.col("_right")), ("_le_right", v <= F.col("_right")))])
        at = F.col("_k") - F.col("_below")
        part = F.when(at < F.col("_lt_left"), F.struct(F.col("_lt_left").alias("_n"), F.col("_low").alias("_low"), F.col("_left").alias("_high"), F.col("_below").alias("_below"), none.alias("value")))
        part = part.when(at < F.col("_le_left"), F.struct(F.lit(1).cast("long").alias("_n"), F.col("_left").alias("_low"), F.col("_left").alias("_high"), F.col("_below").alias("_below"), F.col("_left").alias("value")))
        part = part.when(at < F.col("_lt_right"), F.struct((F.col("_lt_right") - F.col("_le_left")).alias("_n"), F.col("_left").alias("_low"), F.col("_right").alias("_high"), (F.col("_below") + F.col("_le_left")).alias("_below"), none.alias("value")))
        part = part.when(at < F.col("_le_right"), F.struct(F.lit(1).cast("long").alias("_n"), F.col("_right").alias("_low"), F.col("_right").alias("_high"), F.col("_below").alias("_below"), F.col("_right").alias("value")))
        part = part.otherwise(F.struct((F.col("_n") - F.col("_le_right")).alias("_n"), F.col("_right").alias("_low"), F.col("_high").alias("_high"), (F.col("_below") + F.col("_le_right")).alias("_below"), none.alias("value")))
        done = state.where(F.col("value").isNotNull() | (F.col("_n") <= sorted_values))
        state = settled(done.unionByName(told.select(*ids, part.alias("p")).select(*ids, "p.*")))
    few = inside(state.where("value is null")).groupBy(*ids, "_below").agg(F.sort_array(F.collect_list("_v")).alias("_sorted"))
    few = few.select(*ids, F.col("_sorted")[(F.col("_k") - F.col("_below")).cast("int")].alias("value"))
    found = state.where("value is not null").select(*ids, "value").unionByName(few)
    ends = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_k", "value"))).alias("_at"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_e_{k}").eqNullSafe(F.col(k))
    out = wanted.join(ends.withColumnsRenamed({k: f"_e_{k}" for k in keys}), same, "left")
    lower, upper = F.col("_at")[F.floor("_rank")], F.col("_at")[F.ceil("_rank")]
    value = F.when(lower == upper, lower).otherwise((F.ceil("_rank") - F.col("_rank")) * lower + (F.col("_rank") - F.floor("_rank")) * upper)
    return out.select(*keys, "share", value.alias("value"))
