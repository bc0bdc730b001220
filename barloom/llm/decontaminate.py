"""Benchmark decontamination by greedy string tiling.

Documents and test items are joined on shared runs of SEED tokens (by rolling hash). For each pair the longest common
runs that are unmarked on both sides are marked, again and again, down to SEED tokens (running Karp-Rabin matching). The
marked tiles' share of the item is its coverage: passages are found whatever the order of their parts.
"""

from __future__ import annotations

import string
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import by_batch, join_few, join_hot, materialize, rows_of, table

#: Least tokens of a seed and so of a tile.
SEED = 5
#: Bytes of test text up to which the items' seeds go to every task; those of a larger test set are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Bits for each seed of the filter that a large test set sends ahead, and most bits of it (64 MB).
SEED_BITS, MOST_BITS = 16, 1 << 29
#: Documents of a seed that meet its items in one task.
CHUNK = 1000
_EDGE = string.punctuation
_WEIGHTS = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, SEED, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def tokens(text: str | None) -> list[str]:
    """Lower-case runs between white space without punctuation at their ends; empty ones are left out."""
    return [w for x in (text or "").lower().split() if (w := x.strip(_EDGE))]


def token_ids(text: str | None) -> np.ndarray:
    """A 64-bit hash of each token."""
    return np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in tokens(text)], np.uint64)


def seeds_of(ids: np.ndarray) -> np.ndarray:
    """Rolling hash of each run of SEED tokens."""
    n = max(0, len(ids) - SEED + 1)
    out = np.zeros(n, np.uint64)
    for k in range(SEED):
        out += ids[k : k + n] * _WEIGHTS[k]
    return out


class _Runs:
    """Hashes of all runs of a length over the free tokens of a sequence, from one table of prefix sums."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.ids, self.free = ids, np.ones(n, bool)
        one = np.ones(1, np.uint64)
        grow, self.shrink = (np.multiply.accumulate(np.concatenate([one, np.full(n, x, np.uint64)])) for x in (_BASE, _INVERSE))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate((ids ^ (ids >> np.uint64(29))) * grow[:-1])])

    def longest(self) -> int:
        edges = np.flatnonzero(np.diff(np.concatenate([[False], self.free, [False]]).astype(np.int8)))
        return int((edges[1::2] - edges[::2]).max(initial=0))

    def of(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes)"""
        count = np.concatenate([[0], np.cumsum(self.free)])
        starts = np.flatnonzero(count[length:] - count[:-length] == length)
        return starts, (self.sums[starts + length] - self.sums[starts]) * self.shrink[starts]


def tile(item: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
    """Tiles (item start, document start, length) of the greedy tiling of two sequences of 64-bit ids: the longest first,
    on ties the first in the item, then in the document.

    The longest length is found by bisection over run hashes, and all its tiles are marked in one sweep. Tiles of one
    item have at most sqrt(2 * its length) different lengths, so the time is bounded by the lengths of both, however
    often a token repeats.
    """
    a, b, tiles = _Runs(np.asarray(item, np.uint64)), _Runs(np.asarray(doc, np.uint64)), []
    a.free &= np.isin(a.ids, b.ids)
    b.free &= np.isin(b.ids, a.ids)
    high = min(a.longest(), b.longest())

    def shared(length: int) -> bool:
        return bool(np.isin(a.of(length)[1], b.of(length)[1]).any())

    while high >= SEED and shared(SEED):
        low = SEED
        if shared(high):
            low = high
        while low < high - 1:
            middle = (low + high) // 2
            low, high = (middle, high) if shared(middle) else (low, middle)
        size = low
        (at, keys), (places, others) = a.of(size), b.of(size)
        waiting = defaultdict(deque)
        there = np.isin(others, keys)
        for j, key in zip(places[there].tolist(), others[there].tolist()):
            waiting[key].append(j)
        there = np.isin(keys, others)
        done = 0
        for i, key in zip(at[there].tolist(), keys[there].tolist()):
            if i < done:
                continue
            queue = waiting[key]
            while queue and not (b.free[queue[0]] and b.free[queue[0] + size - 1]):  # tiles of one length overlap at an end
                queue.popleft()
            j = next((j for j in queue if b.free[j] and b.free[j + size - 1] and np.array_equal(a.ids[i : i + size], b.ids[j : j + size])), None)
            if j is not None:
                tiles.append((i, j, size))
                a.free[i : i + size] = b.free[j : j + size] = False
                done = i + size
        high = min(size - 1, a.longest(), b.longest())  # runs of this length are used up
    return tiles


def coverage(item: np.ndarray, doc: np.ndarray, least: float) -> float:
    """Share of the item's tokens in tiles; 0 if it is below `least`. Tokens outside shared seeds can't be in a tile."""
    mine, theirs = seeds_of(item), seeds_of(doc)
    reached = np.isin(mine, theirs)
    inside = np.convolve(reached, np.ones(SEED, np.int64)) > 0 if len(mine) else np.zeros(len(item), bool)
    if not inside.any() or inside.sum() < least * len(item):
        return 0.0
    near = np.convolve(np.isin(theirs, mine), np.ones(SEED, np.int64)) > 0
    starts = np.flatnonzero(near & ~np.concatenate([[False], near[:-1]]))
    # what lies between two reached stretches becomes one token that the item doesn't have
    stranger = np.uint64(np.setdiff1d(np.arange(len(item) + 1, dtype=np.uint64), item)[0])
    cut = np.insert(doc[near], (np.cumsum(near)[starts] - 1), stranger)
    share = sum(t[2] for t in tile(item, cut)) / len(item)
    return share if share >= least else 0.0


class ItemIndex:
    """Test items by seed."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, ids) for i, text in items if len(ids := token_ids(text)) >= SEED]
        self.known = {w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for _, text in items for w in tokens(text)}
        self.sizes = np.array([len(ids) for _, ids in self.items], np.int64)
        seeds = [np.unique(seeds_of(ids), return_counts=True) for _, ids in self.items]
        hashes, places = (np.concatenate([s[k] for s in seeds]) if seeds else np.empty(0, np.uint64) for k in (0, 1))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.places = hashes[order], places[order]
        self.owners = np.repeat(np.arange(len(seeds)), [len(s[0]) for s in seeds])[order] if seeds else np.empty(0, np.int64)

    def coverages(self, text: str | None, least: float) -> list[tuple[float, int]]:
        """(coverage, item_id) of the items covered to `least` or more."""
        get = self.known.get
        ids = np.array([get(w, 0) for w in tokens(text)], np.uint64)  # 0: in no item
        known = np.concatenate([[0], np.cumsum(ids != 0)])
        starts = np.flatnonzero(known[SEED:] - known[:-SEED] == SEED) if len(ids) >= SEED and len(self.hashes) else ()
        if not len(starts):
            return []
        mine = np.unique(seeds_of(ids)[starts])
        low = np.searchsorted(self.hashes, mine, "left")
        there = self.hashes[np.minimum(low, len(self.hashes) - 1)] == mine
        if not there.any():
            return []
        mine, low = mine[there], low[there]
        high = np.searchsorted(self.hashes, mine, "right")
        found = np.concatenate([np.arange(x, y) for x, y in zip(low[high > low], high[high > low])] or [np.empty(0, np.int64)])
        owners, at = np.unique(self.owners[found], return_inverse=True)
        reach = np.bincount(at, self.places[found], len(owners)) * SEED  # tokens in shared seeds are no more
        out = []
        for owner in owners[reach >= least * self.sizes[owners]].tolist():
            item_id, own = self.items[owner]
            if share := coverage(own, ids, least):
                out.append((share, item_id))
        return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_coverage: float = 0.5, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark documents (text string; all other columns pass through) that hold items of benchmark (item_id, text).

    Adds coverage (of the item most covered, 0 below min_coverage), item_id (that item; the lowest on ties, null if
    none), n_items (items covered to min_coverage or more) and contaminated. Columns of these names in docs are
    replaced. Items of fewer than SEED tokens, or null, can't be told from chance and match nothing; repeated rows of
    benchmark are one item. Null and empty texts are clean. Repeated rows are treated alike; an empty table gives an
    empty table. Up to broadcast_bytes of test text the items go to the tasks; beyond that documents and items are
    joined on their seeds by a shuffle, with the same result. Either way one pass over the texts finds the candidates.
    """
    docs = docs.drop("coverage", "item_id", "n_items", "contaminated")
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    found = _by_broadcast(docs, items, min_coverage) if total <= broadcast_bytes else _by_join(docs, items, min_coverage)
    return found.withColumn("contaminated", F.col("n_items") > 0)


def _by_broadcast(docs: DataFrame, items: DataFrame, least: float) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(sorted(tuple(r) for r in items.collect()))  # of broadcast_bytes at most
    out = docs.withColumns({"coverage": F.lit(0.0), "item_id": F.lit(None).cast("long"), "n_items": F.lit(0).cast("long")})

    def make():
        index = ItemIndex(held.value)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in batch.column("text").to_pylist():
                found = index.coverages(text, least)
                rows.append((*max(found, key=lambda x: (x[0], -x[1]), default=(0.0, None)), len(found)))
            new = dict(zip(("coverage", "item_id", "n_items"), zip(*rows)))
            columns = [pa.array(new[f.name], f.type) if f.name in new else batch.column(i) for i, f in enumerate(batch.schema)]
            return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        return one

    return out.mapInArrow(by_batch(make), out.schema)


def _seeds(rows: DataFrame, bits: np.ndarray | None = None) -> DataFrame:
    """(key, size, seed, places): the distinct seeds of rows (key, text), how often each stands there, and the tokens of
    the text; with bits (a bit a seed of the other side) only those that may be shared."""
    schema = pa.schema([("key", pa.string()), ("size", pa.int64()), ("seed", pa.int64()), ("places", pa.int64())])
    held = rows.sparkSession.sparkContext.broadcast(bits)

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            bits, parts = held.value, []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                ids = token_ids(text)
                seeds, places = np.unique(seeds_of(ids), return_counts=True)
                if bits is not None:
                    at = seeds & np.uint64(8 * len(bits) - 1)
                    there = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    seeds, places = seeds[there], places[there]
                if len(seeds):
                    parts.append(pa.RecordBatch.from_arrays([pa.array([key] * len(seeds)), pa.array([len(ids)] * len(seeds)), pa.array(seeds.view(np.int64)), pa.array(places)], schema=schema))
            return pa.Table.from_batches(parts, schema).combine_chunks().to_batches()[0] if parts else None

        return one

    return rows.select("key", "text").mapInArrow(by_batch(make), "key string, size bigint, seed bigint, places bigint")


def _by_join(docs: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """Candidates by a join on seeds. Equal texts are one: they are told by a digest of the text."""
    items = materialize(items.withColumn("key", F.sha2(F.concat_ws("\0", "item_id", "text"), 256)), "items")
    item_seeds = materialize(_seeds(items).select(F.col("key").alias("item"), "size", "seed", "places"), "item-seeds")
    width = min(MOST_BITS, 1 << max(15, (SEED_BITS * item_seeds.count()).bit_length()))
    place = F.col("seed").bitwiseAND(width - 1)
    rows = item_seeds.select(F.shiftright(place, 15).alias("row"), place.bitwiseAND((1 << 15) - 1).alias("at"))
    bits = np.zeros(width // 8, np.uint8)
    for r in rows.groupBy("row").agg(F.bitmap_construct_agg("at").alias("bits")).toLocalIterator():  # MOST_BITS in all
        bits[r.row << 12 : r.row + 1 << 12] = np.frombuffer(bytes(r.bits), np.uint8)
    keyed = docs.withColumn("_key", F.sha2(F.coalesce("text", F.lit("")), 256))
    mine = materialize(_seeds(keyed.select(F.col("_key").alias("key"), "text"), bits).select("key", "seed").distinct(), "document-seeds")
    # a seed of many documents meets its items in chunks of those
    df = materialize(mine.groupBy("seed").agg(F.count(F.lit(1)).alias("df")), "seed-counts")
    chunks = F.ceil(F.col("df") / CHUNK).cast("int")
    theirs = item_seeds.join(df, "seed").withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).drop("df")
    shared = join_hot(mine, df, "seed").withColumn("chunk", F.pmod(F.xxhash64("key"), chunks).cast("int")).drop("df").join(theirs, ["seed", "chunk"])
    # tokens of the item in shared seeds are no more than SEED times their places
    pairs = shared.groupBy("key", "item", "size").agg(F.sum("places").alias("places")).where(SEED * F.col("places") >= least * F.col("size"))
    pairs = materialize(pairs.select("key", "item"), "item-pairs")
    wanted = materialize(pairs.select(F.col("key").alias("_key")).distinct(), "item-documents")
    texts = rows_of(keyed.select("_key", F.col("text").alias("doc_text")), wanted, "_key").dropDuplicates(["_key"])
    met = pairs.join(texts.withColumnRenamed("_key", "key"), "key").join(items.withColumnsRenamed({"key": "item", "text": "item_text"}), "item")
    schema = pa.schema([("_key", pa.string()), ("item_id", pa.int64()), ("coverage", pa.float64())])

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = zip(batch.column("item_text").to_pylist(), batch.column("doc_text").to_pylist())
            shares = pa.array([coverage(token_ids(i), token_ids(d), least) for i, d in texts], pa.float64())
            mask = pa.array([s > 0 for s in shares.to_pylist()], pa.bool_())
            return pa.RecordBatch.from_arrays([c.filter(mask) for c in (batch.column("key"), batch.column("item_id"), shares)], schema=schema)

        return one

    covered = met.select("key", "item_id", "item_text", "doc_text").mapInArrow(by_batch(make), "_key string, item_id bigint, coverage double")
    best = covered.groupBy("_key").agg(F.max(F.struct("coverage", (-F.col("item_id")).alias("minus"))).alias("_best"), F.count(F.lit(1)).alias("_n"))
    best = materialize(best.select("_key", F.col("_best.coverage").alias("_coverage"), (-F.col("_best.minus")).alias("_item"), "_n"), "covered")
    added = [F.coalesce("_coverage", F.lit(0.0)).alias("coverage"), F.col("_item").alias("item_id"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_items")]
    return join_few(keyed, best, "_key").select(*[F.col(f"`{c}`") for c in docs.columns], *added)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark coverage of all documents."""
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "item_id", "coverage", "n_items")
