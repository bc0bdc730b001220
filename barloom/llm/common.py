"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text is stripped and split at these characters only, as the contracts say.
SPACE = r"\x20\x09-\x0D"
SLICE_ROWS = 1000
#: Bits of the bitmap of wanted keys that goes to every task (4 MB), and of one row of it.
KEY_BITS, KEY_ROW_BITS = 1 << 25, 1 << 15
#: Rows from which a key is joined by broadcast, and most such keys (some 50 bytes each).
HOT, HOT_KEYS = 500, 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines of the cluster see. A session on one machine that names none (as in tests) gets a
    temporary one; on a cluster that would be another folder on every machine, so there it is an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = os.path.join(tempfile.gettempdir(), f"barloom-{os.getuid()}")
    return folder.rstrip("/")


#: Paths of the tables written by materialize, in order; those that settle deletes leave the list.
_WRITTEN: list[str] = []


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back. Survives the loss of executors. The table
    is deleted when the driver ends, or by settle."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/barloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    files, place = _file_system(spark, path)
    files.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """materialize(make(), name), after which the tables that make() wrote on its way have had their last reader: they
    are deleted."""
    before = len(_WRITTEN)
    out = materialize(make(), name)
    for path in _WRITTEN[before:-1]:
        files, place = _file_system(spark, path)
        files.delete(place, True)
    del _WRITTEN[before:-1]
    return out


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Hand freed memory back to the system: a Python worker lives on for the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def by_batch(make):
    """For mapInArrow: make() is called once a task and gives the function of one batch. Batches come in slices of at
    most SLICE_ROWS rows, so that what a function makes of long texts stays small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                out = one(batch.slice(at, SLICE_ROWS))
                if out is not None:
                    yield out
        give_back()

    return run


def likely_in(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """df with _likely: false if its column `key` is surely not in keys (key), by a bitmap of hashed keys of a fixed size.
    It spares most rows the shuffle of a join; a full bitmap would only let more rows through to the join."""
    bit = F.pmod(F.xxhash64(key), F.lit(KEY_BITS))
    row, at = F.floor(bit / KEY_ROW_BITS).alias("_row"), bit % KEY_ROW_BITS
    wanted = keys.select(row, at.alias("_at")).repartition("_row").groupBy("_row").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    likely = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return df.withColumn("_row", row).join(F.broadcast(wanted), "_row", "left").withColumn("_likely", likely).drop("_row", "_bits")


def rows_of(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of df whose column `key` is in keys (key, distinct)."""
    # an inner join: a semi-join would be pushed below the bitmap's join
    return likely_in(df, keys, key).where("_likely").drop("_likely").join(keys, key)


def join_few(df: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """df left-joined with few (at most a row a key, keys of few rows of df): what surely has no match isn't shuffled."""
    marked = likely_in(df, few.select(key), key)
    hit = marked.where("_likely").drop("_likely").join(few, key, "left")
    added = {f.name: F.lit(None).cast(f.dataType) for f in few.schema if f.name != key}
    return hit.unionByName(marked.where("not _likely").drop("_likely").withColumns(added))


def join_hot(rows: DataFrame, shared: DataFrame, key: str) -> DataFrame:
    """rows joined with shared (key, df: how many of the rows have it, and more; a row a key). A key of very many rows
    would meet in one task: the hottest keys go to every task instead. Of all rows HOT_KEYS keys at most can have more
    than a share of 1 / HOT_KEYS each, so the bound holds at any size; the other keys have few rows each."""
    seen = shared.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("rows"), F.coalesce(F.max("df"), F.lit(0)).alias("most")).first()
    limit = max(HOT, seen.rows // HOT_KEYS)
    if seen.most <= limit:
        return rows.join(shared, key)
    hot = shared.where(F.col("df") > limit)
    tried = rows.join(F.broadcast(hot), key, "left")
    usual = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return tried.where("df is not null").unionByName(usual.join(shared.where(F.col("df") <= limit), key))
