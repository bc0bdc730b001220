"""Sharding by histogram sort: splitters are refined by exact byte counts, then rows are exchanged once.

The sort key is (hash of the text, doc_id), so equal texts stand side by side. A first histogram over evenly spaced
probes gives the exact bytes below each probe; each splitter that no probe meets within the tolerance gets new, finer
probes inside its own interval, until all splitters are settled. Only then are rows moved. All of it is DataFrame work.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import join_few, likely_in, materialize, table

#: Probes of the first histogram, and of each open splitter in a later round.
FIRST_BITS, PROBE_BITS = 12, 8
KEY_BITS = 63


def _near(lo: int, hi: int, bits: int) -> int:
    """Shift that leaves at most 2**bits buckets between lo and hi."""
    return max(0, (hi - lo).bit_length() - bits)


def find_splitters(keys: DataFrame, shards: int, tolerance: float) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """keys: k1, k2 (longs from 0), size. Returns the shards - 1 splitters (least key of the next shard) and the first
    histogram's (bucket, rows). A round's result has at most 2**PROBE_BITS rows for each open splitter."""
    shift0 = KEY_BITS - FIRST_BITS
    stats = (F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("k1").alias("lo1"), F.max("k1").alias("hi1"), F.min("k2").alias("lo2"), F.max("k2").alias("hi2"))
    found = sorted(keys.groupBy(F.shiftright("k1", shift0).alias("bucket")).agg(*stats).collect(), key=lambda r: r.bucket)
    histogram = [(r.bucket, r.rows) for r in found]
    total = sum(r.bytes for r in found)
    goals = {i: total * i / shards for i in range(1, shards)}
    slack = tolerance * total / shards
    done: dict[int, tuple[int, int]] = {}
    top = (1 << KEY_BITS) - 1

    def settle(rows: list, before: int, level: int, wanted: list[int]) -> list[tuple]:
        """rows: the buckets of one interval in order, before: bytes below it. Returns what stays open: (splitters,
        row, level, bytes below the row)."""
        left: dict[int, tuple] = {}
        for i in wanted:
            at = before
            for n, r in enumerate(rows):
                if goals[i] <= at + r.bytes or n == len(rows) - 1:
                    break
                at += r.bytes
            single = r.lo1 == r.hi1 and r.lo2 == r.hi2
            if min(goals[i] - at, at + r.bytes - goals[i]) <= slack or single:
                upper = at + r.bytes - goals[i] < goals[i] - at
                if not upper:
                    done[i] = (r.lo1, r.lo2 if level == 2 else 0)
                else:
                    done[i] = (r.hi1, r.hi2 + 1) if level == 2 else (r.hi1 + 1, 0)
            else:
                left.setdefault(n, ([], r, 2 if r.lo1 == r.hi1 else 1, at))[0].append(i)
        return list(left.values())

    pending = settle(found, 0, 1, list(goals)) if found else []
    if not found:
        done = {i: (top, top) for i in goals}
    while pending:
        bucket, own = F.lit(None).cast("long"), F.lit(None).cast("int")
        for n, (_, r, level, _) in enumerate(pending):
            if level == 1:
                hit, value = F.col("k1").between(r.lo1, r.hi1), F.shiftright(F.col("k1") - r.lo1, _near(r.lo1, r.hi1, PROBE_BITS))
            else:
                hit, value = (F.col("k1") == r.lo1) & F.col("k2").between(r.lo2, r.hi2), F.shiftright(F.col("k2") - r.lo2, _near(r.lo2, r.hi2, PROBE_BITS))
            bucket, own = F.when(hit, value).otherwise(bucket), F.when(hit, n).otherwise(own)
        counted = keys.withColumn("own", own).where("own is not null").withColumn("bucket", bucket)
        rows = counted.groupBy("own", "bucket").agg(*stats).collect()
        nexts = []
        for n, (wanted, _, level, below) in enumerate(pending):
            nexts += settle(sorted((r for r in rows if r.own == n), key=lambda r: r.bucket), below, level, wanted)
        pending = nexts
    return [done[i] for i in sorted(done)], histogram


def histogram_sort_shards(docs: DataFrame, shards: int = 40, tolerance: float = 0.002, block_rows: int = 100_000, overhead: int = 16) -> DataFrame:
    """Put docs (doc_id long, text string) into shards of near equal bytes.

    A document's size is the UTF-8 bytes of its text (null: none) and `overhead`. Each boundary is within `tolerance`
    of a shard's mean size, or within one document. Returns doc_id, text, size, shard (from 0), slot (gapless from 0 in
    each shard; rows of equal text follow each other). Equal rows (same text and doc_id) can't
    be told apart and stay in one shard; their slots differ. Null doc_id sorts as 0. Other columns are ignored. An empty
    table gives an empty table. Slots follow (hash of the text, doc_id) in each shard. They are counted in blocks of about
    block_rows rows, ranges of that order, so no task holds a whole shard or a large group of equal texts; only rows that
    are equal in text and doc_id can't be parted.
    """
    text = F.col("text").cast("string")
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long").alias("size"),
        F.shiftrightunsigned(F.xxhash64(text), 1).alias("k1"),
        F.shiftrightunsigned(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).bitwiseXOR(F.lit(-(1 << 63))), 1).alias("k2"),
    )
    keys = materialize(keyed.select("k1", "k2", "size"), "shard-keys")
    splitters, histogram = find_splitters(keys, shards, tolerance)

    def shard_of() -> Column:
        above = [((F.col("k1") > a) | (F.col("k1") == a) & (F.col("k2") >= b)).cast("int") for a, b in splitters]
        return reduce(lambda x, y: x + y, above, F.lit(0))

    # blocks are ranges of (k1, k2): of k1's first bits, and where one text has many copies, of their k2
    usual = sum(r for _, r in histogram) / max(1, len(histogram))
    bits = min(KEY_BITS, FIRST_BITS + max(0, math.ceil(math.log2(max(1.0, usual / block_rows)))))
    bucket = F.shiftright("k1", KEY_BITS - bits)
    full = materialize(keys.groupBy(bucket.alias("bucket")).count().where(F.col("count") > 2 * block_rows), "shard-full")
    many = likely_in(keys.withColumn("bucket", bucket), full.select("bucket"), "bucket").where("_likely").groupBy("k1").count().where(F.col("count") > block_rows)
    many = materialize(many, "shard-many")
    hot = likely_in(keys, many.select("k1"), "k1").where("_likely").join(many, "k1")
    parts = F.col("parts").cast("double")
    cuts = hot.groupBy("k1").agg(F.ceil(F.first("count") / block_rows).cast("int").alias("parts"), F.percentile_approx("k2", F.array(*[F.lit(i / 1024) for i in range(1, 1024)]), F.lit(4096)).alias("fine"))
    # of the 1023 quantiles, as many as there are parts to cut (1,024 at most)
    wanted = F.transform(F.sequence(F.lit(1), F.least("parts", F.lit(1024)) - 1), lambda i: F.col("fine")[F.greatest(F.lit(0), F.ceil(i * 1024 / F.least(parts, F.lit(1024.0))).cast("int") - 1)])
    cuts = cuts.select("k1", F.when(F.col("parts") > 1, F.array_distinct(wanted)).otherwise(F.array().cast("array<bigint>")).alias("cuts"))
    copies = materialize(cuts.groupBy(bucket.alias("bucket")).agg(F.sort_array(F.collect_list(F.struct("k1", "cuts"))).alias("copies")), "shard-copies")
    block = ["shard", "bucket", "region", "part"]

    def placed(df: DataFrame) -> DataFrame:
        df = df.withColumn("shard", shard_of()).withColumn("bucket", bucket)
        df = join_few(df, copies, "bucket")
        none = F.array().cast(copies.schema["copies"].dataType)
        of = F.coalesce("copies", none)
        same = F.filter(of, lambda c: c["k1"] == F.col("k1"))
        region = 2 * F.size(F.filter(of, lambda c: c["k1"] < F.col("k1"))) + F.size(same)
        part = F.when(F.size(same) > 0, F.size(F.filter(same[0]["cuts"], lambda c: c <= F.col("k2")))).otherwise(0)
        return df.withColumns({"region": region, "part": part}).drop("copies")

    before = Window.partitionBy("shard").orderBy("bucket", "region", "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed(keys).groupBy(*block).count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    bases = materialize(bases, "shard-blocks")
    number = F.row_number().over(Window.partitionBy(*block).orderBy("k1", "k2"))
    numbered = placed(keyed).withColumn("number", number)
    return numbered.join(bases, block).select("doc_id", "text", "size", "shard", (F.col("base") + F.col("number") - 1).cast("long").alias("slot"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    rows = histogram_sort_shards(table(spark, sf_dir, "documents"), shards=40)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    return rows.select("doc_id", "size", crc, F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
