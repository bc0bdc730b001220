"""Near-duplicates by min-max hashing.

Each permutation of the shingle hashes gives two signature values, the least and the greatest, so a signature of 2k
values takes k evaluations. Bands of the signature make buckets; documents of one bucket are candidates, and links are
confirmed on full shingle sets. Equal sets are one class from the start. A bucket is first linked as a star to its
smallest member. Members of buckets that still hold several components are then matched exactly by their rarest
shingles (prefix filter), so a group of copies costs about as many comparisons as it has members, and no link that a
bucket shows is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import as_bytes, by_batch, join_hot, likely_in, materialize, rows_of, settle, table
from barloom.llm.components import connected_components

#: 80 permutations give 160 values: 32 bands of 5. A pair of similarity 0.8 is missed with probability 3e-6.
PERMUTATIONS, BAND_ROWS = 80, 5
BANDS = 2 * PERMUTATIONS // BAND_ROWS
_RANDOM = np.random.Generator(np.random.PCG64(20240501))
_MASKS = _RANDOM.integers(0, 1 << 64, PERMUTATIONS, np.uint64)
_FACTORS = _RANDOM.integers(0, 1 << 64, PERMUTATIONS, np.uint64) | np.uint64(1)
#: Rows of a shingle that are compared in one task.
CHUNK = 1000
_WEIGHTS = _RANDOM.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of `words` words; fewer words: the whole sequence is one shingle."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b"\0".join(found), seed=len(found))], np.uint64)
    hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in found], np.uint64)
    n = len(hashed) - words + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(words):
        mixed += hashed[k : k + n] * _WEIGHTS[k]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least values under each permutation, then the greatest; 32 bits each."""
    least, most = np.full(PERMUTATIONS, ~np.uint64(0)), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), 8192):
        values = (shingles[at : at + 8192, None] ^ _MASKS) * _FACTORS
        np.minimum(least, values.min(axis=0), out=least)
        np.maximum(most, values.max(axis=0), out=most)
    return (np.concatenate([least, most]) >> np.uint64(32)).astype("<u4")


def band_keys(values: np.ndarray) -> list[int]:
    """Signed 64-bit key of each band; least and greatest values never share a band."""
    rows = values.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh3_64_intdigest(r.tobytes(), seed=i) for i, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def _signed(docs: DataFrame, words: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("class", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, classes, bands = [], [], []
            for text in as_bytes(batch.column("text")):
                own = shingle_set(text, words)
                sizes.append(len(own))
                classes.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                bands.append(band_keys(signature(own)) if len(own) else None)
            columns = [batch.column("doc_id"), *(pa.array(x, t.type) for x, t in zip((sizes, classes, bands), list(schema)[1:]))]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        return one

    return docs.mapInArrow(by_batch(make), "doc_id bigint, n bigint, class binary, bands array<bigint>")


def _near(a: Column, b: Column, percent: int) -> Column:
    """The sizes allow the similarity."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is in ids (doc_id, distinct)."""
    return rows_of(docs, ids, "doc_id")


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is not in ids (doc_id); null is in no set."""
    ids = materialize(ids.select("doc_id").where("doc_id is not null").distinct(), "left-out")
    marked = likely_in(docs, ids, "doc_id")
    gone = ids.withColumn("_gone", F.lit(True))  # an anti-join would be pushed below the bitmap's join
    left = marked.where("_likely").join(gone, "doc_id", "left").where("_gone is null")
    return marked.where("not _likely").select(docs.columns).unionByName(left.select(docs.columns))


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full shingle sets meet the similarity."""
    ends = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = materialize(_of_ids(docs, ends), "pair-texts")
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    joined = pairs.join(right, "b").join(left, "a")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def make():
        last: list = [None, None]  # rows come by a: its set is made once

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for a, b in zip(as_bytes(batch.column("text_a")), as_bytes(batch.column("text_b"))):
                if a != last[0]:
                    last[:] = a, shingle_set(a, words)
                x, y = last[1], shingle_set(b, words)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            return pa.RecordBatch.from_arrays([batch.column(n).filter(mask) for n in ("a", "b")], schema=schema)

        return one

    return joined.select("a", "b", "text_a", "text_b").mapInArrow(by_batch(make), "a bigint, b bigint").distinct()


def _prefix_pairs(apart: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of apart (node, class, rep, n, c: component) in different components that may meet the similarity.

    A pair that does shares a shingle among the rarest of both, so near the front of both lists of shingles by rising
    frequency: the places say how many shingles the two can still share. A document that differs from its group by many
    rare shingles meets few others there, whatever the size of the group. Of the components that meet at a shingle, the
    largest is compared with the others only.
    """
    texts = _of_ids(docs, apart.select(F.col("rep").alias("doc_id")).distinct())
    schema = pa.schema([("doc_id", pa.int64()), ("class", pa.binary()), ("shingles", pa.list_(pa.int64()))])

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t, words) for t in as_bytes(batch.column("text"))]
            columns = [batch.column("doc_id"), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([x.view(np.int64) for x in sets], schema.field("shingles").type)]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        return one

    found = texts.mapInArrow(by_batch(make), "doc_id bigint, class binary, shingles array<bigint>").dropDuplicates(["class"])
    rows = materialize(found.join(apart.select("class", "node"), "class").select("node", "shingles"), "apart-shingles")
    rows = rows.select("node", F.explode("shingles").alias("shingle"))
    shared = materialize(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared-shingles")
    lists = join_hot(rows, shared, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("list"))
    alone = F.col("n") - F.size("list")  # shingles that no other has come first
    length = F.col("n") - F.floor((percent * F.col("n") + 99) / 100).cast("long") + 1
    front = lists.join(apart, "node").select("rep", "n", "c", F.posexplode(F.slice("list", F.lit(1), F.greatest(length - alone, F.lit(0)).cast("int"))).alias("at", "s"), alone.alias("alone"))
    front = materialize(front.select("rep", "n", "c", F.col("s.shingle").alias("shingle"), (F.col("alone") + F.col("at") + 1).alias("place")), "prefixes")
    largest = front.groupBy("shingle", "c").count().groupBy("shingle").agg(F.max_by("c", F.struct("count", "c")).alias("main"), F.count(F.lit(1)).alias("met"), F.sum("count").alias("df")).where("met > 1").drop("met")
    largest = materialize(largest, "met-shingles")
    front = join_hot(likely_in(front, largest.select("shingle"), "shingle").where("_likely").drop("_likely"), largest, "shingle")
    # what meets a shingle comes in chunks, each beside a copy of the shingle's rows of the smaller components
    chunks = F.ceil(F.col("df") / CHUNK).cast("int")
    one = front.where("c <> main").withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).drop("main", "df")
    two = front.select("shingle", F.pmod(F.xxhash64("rep"), chunks).cast("int").alias("chunk"), F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("c").alias("c2"), F.col("place").alias("place2"), (F.col("c") == F.col("main")).alias("in_main"))
    most = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) + 1
    meets = (F.col("c") != F.col("c2")) & (F.col("in_main") | (F.col("rep") < F.col("rep2"))) & ((100 + percent) * most >= percent * (F.col("n") + F.col("n2")))
    return one.join(two, ["shingle", "chunk"]).where(meets).select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Components of docs (doc_id long, text string) under Jaccard similarity of word shingles, percent / 100 or more.

    Words are runs of other than ASCII white space, A-Z lower-cased; a text of fewer words is one shingle, a text
    without words (or null) has none and is linked with nothing. Returns doc_id, n_shingles, component_id (the smallest
    doc_id reachable, itself included) and kept (doc_id = component_id). Rows that repeat a doc_id are one document,
    linked through any of them; of such rows each is returned. Null doc_id: component_id is that of its equals, kept is
    false. Other columns are ignored. An empty table gives an empty table. Pairs of similarity 0.8 are missed with
    probability 3e-6, more similar ones less often.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    signed = materialize(_signed(docs, words), "signatures")
    reps = signed.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    reps = materialize(reps.where("rep is not null").withColumn("node", F.monotonically_increasing_id()), "classes")
    member = reps.select(F.explode("bands").alias("key"), "node", "rep", "n")
    hubs = materialize(member.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count(F.lit(1)).alias("df")).where("df > 1"), "hubs")
    buckets = materialize(join_hot(member, hubs, "key").drop("df"), "buckets")
    star = buckets.where((F.col("hub.rep") != F.col("rep")) & _near(F.col("hub.n"), F.col("n"), percent))
    pairs = materialize(star.select(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).distinct(), "star-pairs")
    links = settle(spark, lambda: _confirmed(pairs, docs, words, percent), "star-links")
    found = settle(spark, lambda: connected_components(links), "star-components")

    # what the stars left apart: members of buckets that still hold several components, besides the hub, which has met them all
    placed = buckets.where((F.col("hub.rep") != F.col("rep")) | (F.col("hub.n") != F.col("n"))).drop("hub").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")
    split = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("df")).where("low <> high").select("key", "df")
    split = materialize(split, "split-buckets")
    maybe = likely_in(placed, split.select("key"), "key").where("_likely").drop("_likely")
    apart = join_hot(maybe, split, "key").select("node", "rep", "n", "c").distinct()
    apart = materialize(apart.join(reps.select("node", "class"), "node"), "apart")
    rest = settle(spark, lambda: _prefix_pairs(apart, docs, words, percent), "rest-pairs")
    more = settle(spark, lambda: _confirmed(rest, docs, words, percent), "rest-links")
    found = settle(spark, lambda: connected_components(links.unionByName(more)), "components")

    of_class = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("class", F.coalesce("component", "rep").alias("component_id"))
    named = signed.select("doc_id", F.col("n").alias("n_shingles"), "class").join(of_class, "class", "left")
    component = F.coalesce("component_id", "doc_id").alias("component_id")
    return named.select("doc_id", "n_shingles", component, F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(False)).alias("kept"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by shingles of four words."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


OP1_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS l FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 4 THEN [hash(l)]
         ELSE list_distinct(list_transform(range(1, len(l) - 2), lambda i: hash(l[i:i + 3]))) END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM s JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""
