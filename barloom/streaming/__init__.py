"""Streams: bars from ticks, emitted once the watermark has passed their end, and the higher-timeframe context of bars."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators.align import BAR


def read_ticks(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_bars(ticks: DataFrame, every: str, late: str = "10 minutes", by: Sequence[str] = (), ts: str = "ts", value: str = "value") -> DataFrame:
    """OHLC bars of a tick stream; ticks later than `late` are dropped. In append mode a row is a completed bar, in
    update mode the state of a partial one."""
    seen = ticks.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    price = F.col(value).cast("double")
    bars = seen.groupBy(*by, F.window(ts, every).alias("w")).agg(F.min_by(price, ts).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, ts).alias("close"), F.count(F.lit(1)).alias("tickvol"))
    return bars.select(*by, F.col("w.start").cast("timestamp_ntz").alias("timestamp"), "open", "high", "low", "close", "tickvol")


def write_bars(bars: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append completed bars to a Parquet folder, and stop when the input that is there has been read."""
    return bars.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


PERIODS = {"h1": "hour", "d1": "day"}
_KINDS = {"open": T.DoubleType(), "high": T.DoubleType(), "low": T.DoubleType(), "close": T.DoubleType(), "tickvol": T.LongType(), "vol": T.LongType(), "spread": T.LongType()}
_BAR = [T.StructField("timestamp", T.TimestampNTZType()), *[T.StructField(c, _KINDS[c]) for c in BAR]]
#: Of each period the bar that is forming, that before it, and the time of the last row.
_STATE = T.StructType([*[T.StructField(f"{p}_{side}_{f.name}", f.dataType) for p in PERIODS for side in ("now", "done") for f in _BAR], T.StructField("last", T.TimestampNTZType())])


def context_schema(by: Sequence[str], bars: T.StructType) -> T.StructType:
    """Columns that stream_context returns."""
    partial = lambda p: [T.StructField(f"{p}_partial_period", T.TimestampNTZType()), *[T.StructField(f"{p}_partial_{c}", _KINDS[c]) for c in ("open", "high", "low", "close", "tickvol")], T.StructField(f"{p}_partial_last_m15_timestamp", T.TimestampNTZType())]
    completed = lambda p: [T.StructField(f"{p}_completed_{f.name}", f.dataType) for f in _BAR]
    own = [T.StructField(c, bars[c].dataType) for c in by] + [T.StructField("timestamp", T.TimestampNTZType()), *[T.StructField(f"{c}_x", _KINDS[c]) for c in BAR]]
    return T.StructType([*own, *[f for p in PERIODS for f in [*partial(p), *completed(p)]]])


class _Context:
    """The state of one symbol: bars of each period as (start, values in the order of BAR), or None."""

    def __init__(self, saved: tuple | None) -> None:
        size = len(_BAR)
        parts = [None] * 4 if saved is None else [None if saved[i * size] is None else list(saved[i * size : (i + 1) * size]) for i in range(4)]
        self.now, self.done = dict(zip(PERIODS, parts[::2])), dict(zip(PERIODS, parts[1::2]))
        self.last: datetime | None = None if saved is None else saved[-1]

    def saved(self) -> tuple:
        empty = [None] * len(_BAR)
        return (*[x for p in PERIODS for side in (self.now, self.done) for x in (side[p] or empty)], self.last)

    def row(self, ts: datetime, bar: list, step: timedelta) -> list:
        """The context that the bar sees, after which the bar belongs to the state."""
        out = []
        for p, name in PERIODS.items():
            start = ts.replace(minute=0, second=0, microsecond=0, **({"hour": 0} if name == "day" else {}))
            if self.now[p] is not None and self.now[p][0] != start:
                self.done[p], self.now[p] = self.now[p], None
            forming = self.now[p]
            out += [start, *(forming[1:6] if forming else [None] * 5), self.last if forming else None]
            if forming:
                self.now[p] = [start, forming[1], max(forming[2], bar[1]), min(forming[3], bar[2]), bar[3], forming[5] + bar[4], forming[6] + bar[5], bar[6]]
            else:
                self.now[p] = [start, *bar]
            # an hour that ends with this bar is complete; a day is, on the next date
            ended = name == "hour" and ts + step >= start + timedelta(hours=1)
            out += (self.now[p] if ended else self.done[p]) or [None] * len(_BAR)
        self.last = ts
        return out


def stream_context(bars: DataFrame, by: Sequence[str], bar_seconds: int = 900) -> DataFrame:
    """Each bar of a stream (by, timestamp, and the columns of BAR) with the last completed hour and day and the partial
    state of its own, as align_timeframes gives them under availability "close". Bars must come as stream_bars emits
    them, completed: a bar that is not later than the last of its symbol is late and left out. A symbol's state is a row
    of two hours and two days."""
    out = context_schema(by, bars.schema)

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        context = _Context(state.get if state.exists else None)
        rows = pd.concat(frames).sort_values("timestamp")
        made = []
        for ts, *bar in zip(rows["timestamp"], *[rows[c] for c in BAR]):
            ts = ts.to_pydatetime()
            if context.last is None or ts > context.last:
                bar = [*map(float, bar[:4]), *map(int, bar[4:])]
                made.append([*key, ts, *bar, *context.row(ts, bar, timedelta(seconds=bar_seconds))])
        state.update(context.saved())
        yield pd.DataFrame(made, columns=out.names).astype({f.name: "Int64" for f in out if isinstance(f.dataType, T.LongType) and f.name not in by})

    chosen = bars.select(*by, "timestamp", *[F.col(c).cast(_KINDS[c]).alias(c) for c in BAR])
    return chosen.groupBy(*by).applyInPandasWithState(follow, out, _STATE, "append", GroupStateTimeout.NoTimeout)
