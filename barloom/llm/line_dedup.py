"""Line dedup with two Bloom filters: once-seen and twice-seen line keys.

One pass sets bits of a filter for the keys seen at least once and of another for those seen at least twice. Only the
lines whose key the second filter reports ("suspected repeats") are shuffled, as 16-byte fingerprints, to count the
documents that hold them exactly and to choose the first occurrence. The filters are sized by the number of lines, up to
MOST_BITS: beyond that they fill up, more lines are shuffled (all of them in the end, 28 bytes each), and the result is
the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import as_bytes, by_batch, join_hot, materialize, table

#: Bits of each Bloom filter for a line, and least and most bits: 32 MB to the driver and to each task at most. With
#: three hashes, half of the lines that aren't repeated are suspected from 140 million distinct lines on.
BITS_PER_LINE, LEAST_BITS, MOST_BITS = 8, 1 << 20, 1 << 28
BLOOM_HASHES = 3
SEGMENT_BITS = 1 << 16
#: Up to so many confirmed keys (16 bytes each) go to every task; more are joined with the documents.
BROADCAST_KEYS = 500_000


def line_key(line: bytes) -> bytes:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    return line.strip().lower()


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(n, BLOOM_HASHES) bit numbers by double hashing of 64-bit hashes."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64) * high[:, None]) % np.uint64(bits)).astype(np.int64)


def _set(bitmap: np.ndarray, positions: np.ndarray) -> None:
    """Set bits of a packed bitmap."""
    if positions.size:
        at = np.unique(positions)
        byte, bit = at >> 3, (1 << (at & 7)).astype(np.uint8)
        starts = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
        bitmap[byte[starts]] |= np.bitwise_or.reduceat(bit, starts)


def _all_set(bitmap: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """For each row of positions whether all of its bits are set."""
    return ((bitmap[positions >> 3] >> (positions & 7).astype(np.uint8)) & 1).all(axis=1)


def _pack(positions: np.ndarray) -> bytes:
    """A segment: its bit numbers as 16-bit numbers while that is shorter, else its bitmap."""
    if positions.size * 2 < SEGMENT_BITS // 8:
        return positions.astype("<u2").tobytes()
    bitmap = np.zeros(SEGMENT_BITS, bool)
    bitmap[positions] = True
    return np.packbits(bitmap).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    bitmap = np.zeros(SEGMENT_BITS, bool)
    if len(data) == SEGMENT_BITS // 8:
        return np.unpackbits(np.frombuffer(data, np.uint8)).astype(bool)
    bitmap[np.frombuffer(data, "<u2")] = True
    return bitmap


SEGMENTS = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def _segments(once: np.ndarray, twice: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows = []
    size = SEGMENT_BITS // 8
    for s in np.flatnonzero(once.reshape(-1, size).any(axis=1)).tolist():
        a, b = (np.flatnonzero(np.unpackbits(x[s * size : (s + 1) * size], bitorder="little")) for x in (once, twice))
        rows.append((s, _pack(a), _pack(b)))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), SEGMENTS)], schema=SEGMENTS)


def _sketch(bits: int):
    """Both filters of a task's documents. A key counts once for each document that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            hashes: list[int] = []
            for text in as_bytes(batch.column("text")):
                hashes += {xxhash.xxh3_64_intdigest(k) for k in map(line_key, text.split(b"\n")) if k}
            if not hashes:
                continue
            keys, counts = np.unique(np.array(hashes, np.uint64), return_counts=True)
            at = _positions(keys, bits)
            again = _all_set(once, at) | (counts > 1)
            _set(twice, at[again].ravel())
            _set(once, at.ravel())
        yield from _segments(once, twice)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by segment: what two tasks have both seen once has been seen twice."""
    at, once, twice = None, None, None

    def done():
        a, b = np.flatnonzero(once), np.flatnonzero(twice)
        rows = [[at], [_pack(a)], [_pack(b)]]
        return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(rows, SEGMENTS)], schema=SEGMENTS)

    for batch in batches:
        for segment, a, b in zip(*(batch.column(n).to_pylist() for n in ("segment", "once", "twice"))):
            if segment != at:
                if at is not None:
                    yield done()
                at, once, twice = segment, np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
            own = _unpack(a)
            twice |= _unpack(b) | (once & own)
            once |= own
    if at is not None:
        yield done()


def filter_bits(texts: DataFrame) -> int:
    """Bits of a filter for all lines of column text: a power of two."""
    lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    count = texts.agg(F.coalesce(F.sum(lines), F.lit(0))).first()[0]
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_LINE * count - 1).bit_length() if count else 0))


def repeated_filter(texts: DataFrame, bits: int) -> np.ndarray:
    """The twice-seen filter of column text, packed (bits / 8 bytes)."""
    merged = (
        texts.select("text").mapInArrow(_sketch(bits), "segment int, once binary, twice binary")
        .repartition("segment").sortWithinPartitions("segment")
        .mapInArrow(_merge, "segment int, once binary, twice binary").select("segment", "twice")
    )
    out, size = np.zeros(bits // 8, np.uint8), SEGMENT_BITS // 8
    for row in merged.toLocalIterator():  # bits / 8 bytes at most
        out[row.segment * size : (row.segment + 1) * size] = np.packbits(_unpack(row.twice), bitorder="little")
    return out


def suspected_repeats(docs: DataFrame, bits: int) -> DataFrame:
    """(doc_id, line_no, key): the first line of each suspected key in each document; key is a 128-bit fingerprint."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(repeated_filter(docs, bits))
    schema = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int32()), ("key", pa.binary())])

    def make():
        bitmap = held.value

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, numbers, keys, hashes = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                seen = set()
                for n, key in enumerate(map(line_key, text.split(b"\n"))):
                    if key and key not in seen:
                        seen.add(key)
                        ids.append(doc_id)
                        numbers.append(n)
                        keys.append(key)
                        hashes.append(xxhash.xxh3_64_intdigest(key))
            found = np.flatnonzero(_all_set(bitmap, _positions(np.array(hashes, np.uint64), bits))) if hashes else []
            rows = [[ids[i] for i in found], [numbers[i] for i in found], [xxhash.xxh3_128_digest(keys[i]) for i in found]]
            return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(rows, schema)], schema=schema)

        return one

    return docs.select("doc_id", "text").mapInArrow(by_batch(make), "doc_id bigint, line_no int, key binary")


ADDED = ["n_lines", "n_dropped", "kept_sha256"]


def _strip_lines(docs: DataFrame, drops) -> DataFrame:
    """Cut lines out of text; drops() gives, in a task, (batch) -> for each row a function of (line number, key)."""
    kept = [f for f in docs.schema if f.name != _DROPS]
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept] + ["n_lines bigint, n_dropped bigint, kept_sha256 string"])
    names = [f.name for f in kept]

    def make():
        tests = drops()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, total, cut, digests = [], [], [], []
            for text, test in zip(as_bytes(batch.column("text")), tests(batch)):
                lines = text.split(b"\n")
                left = [x for n, x in enumerate(lines) if not ((k := line_key(x)) and test(n, k))]
                out = b"\n".join(left)
                texts.append(out)
                total.append(len(lines))
                cut.append(len(lines) - len(left))
                digests.append(hashlib.sha256(out).hexdigest())
            new = {"text": pa.array(texts, pa.binary()).cast(pa.string())}
            columns = [new[n] if n in new else batch.column(n) for n in names]
            columns += [pa.array(total, pa.int64()), pa.array(cut, pa.int64()), pa.array(digests, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=names + ADDED)

        return one

    return docs.mapInArrow(by_batch(make), schema)


_DROPS = "_dropped_lines"


def dedup_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, bits: int | None = None, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Drop the lines whose key stands in at least min_docs documents (rows of docs: doc_id long, text string).

    Returns the columns of docs, text being the kept lines joined by a newline, and n_lines, n_dropped, kept_sha256 (in
    place of columns of these names). With keep_first the first occurrence of a dropped key stays: lowest doc_id, then
    lowest line (null doc_id last; of rows that repeat a doc_id, each keeps it). Null or empty text is one empty line,
    and empty keys are never dropped. Rows that repeat a doc_id count as documents of their own. An empty table gives an
    empty table. bits: size of the filters, from the number of lines if None.
    """
    docs = docs.drop(*ADDED, _DROPS).withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    spark = docs.sparkSession
    suspects = materialize(suspected_repeats(docs, bits or filter_bits(docs)), "suspects")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "line_no")).alias("first")
    repeated = materialize(suspects.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), first).where(F.col("docs") >= min_docs), "repeated")
    if repeated.count() <= broadcast_keys:
        held = spark.sparkContext.broadcast({bytes(r.key): (r.first.doc_id, r.first.line_no) for r in repeated.select("key", "first").collect()})

        def by_key():
            known, digest = held.value, xxhash.xxh3_128_digest
            if keep_first:
                return lambda batch: [lambda n, k, d=d: known.get(digest(k), (d, n)) != (d, n) for d in batch.column("doc_id").to_pylist()]
            return lambda batch: [lambda n, k: digest(k) in known] * batch.num_rows

        return _strip_lines(docs, by_key)

    stays = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) if keep_first else F.lit(False)
    entry = F.struct("key", F.when(stays, F.col("first.line_no")).alias("stays"))
    own = join_hot(suspects.select("doc_id", "key"), repeated.withColumnRenamed("docs", "df"), "key").groupBy(F.col("doc_id").alias("_of")).agg(F.collect_set(entry).alias(_DROPS))
    joined = docs.join(own, docs.doc_id.eqNullSafe(own["_of"]), "left").drop("_of")

    def by_row():
        def tests(batch):
            for drops in batch.column(_DROPS).to_pylist():
                known = {bytes(x["key"]): x["stays"] for x in drops or ()}
                yield lambda n, k, known=known: (h := xxhash.xxh3_128_digest(k)) in known and known[h] != n

        return tests

    return _strip_lines(joined, by_row)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from every document."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10).drop("text")


OP5_SQL = """
WITH lines AS (
  SELECT doc_id, u.i AS i, u.line AS line,
         translate(trim(u.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(list_zip(range(len(l)), l)) AS z, z[1] AS i0, {'i': z[1], 'line': z[2]} AS u
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
repeated AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(r.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE r.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN repeated r ON lines.k = r.k GROUP BY doc_id
"""
