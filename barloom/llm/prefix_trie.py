"""Prefix trie of conversations: which openings conversations share, and what storing each shared turn once would save.

A node is a distinct sequence of first turns. Its key is made of the hashes of (place, turn), joined by XOR, so a
sequence's key follows from running values and a very long conversation may be cut into pieces that meet again by one
small row each. Partitions of conversations give partial tries (one row for each node that they hold); tries are
mergeable: members and ends add up under the node's key, first for groups of partitions, then for all. The roll-up runs
bottom-up: the smallest member of a node owns it, and the nodes that a conversation owns are the lower end of its own
path, so running sums from a conversation's last turn upwards, added up at every node that it passes, give leaves and
savings of whole subtrees in one pass, however deep the trie is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import SPACE, materialize, table

#: Partial tries of so many partitions are merged in the first step.
MERGED = 16
#: Ids of a piece of an end list: some 5 KB of text.
PIECE_IDS = 512
NODE = ["depth", "a", "b"]
FIRST, LAST = Window.unboundedPreceding, Window.unboundedFollowing


def _hash(side: int, place: Column) -> Column:
    """Half of a turn's share in the key of every node at or below it."""
    return F.xxhash64(F.lit(side), place, F.col("turn_key"))


def _pieces(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, turn_key, words) dealt by ranges of (conv_id, turn, turn_key): with part, the range's number.
    A conversation has rows in several parts only if it is long."""
    spread = turns.repartitionByRange("conv_id", "turn", "turn_key").withColumn("part", F.spark_partition_id())
    return materialize(spread, "trie-turns")


def _carried(pieces: DataFrame, sums: dict[str, Column], values: dict[str, Column]) -> DataFrame:
    """(part, conv_id, values, and `sums` over the pieces of the same conversation before it). pieces: one row a piece;
    the window meets the few rows of one conversation."""
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(FIRST, -1)
    return pieces.select("part", "conv_id", *[v.alias(c) for c, v in values.items()], *[F.coalesce(s.over(before), F.lit(0)).alias(c) for c, s in sums.items()])


def _rebuilt(conversations: DataFrame, group: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (part, conv_id, depth, words, a, b: the node's key, up_a, up_b: its parent's) and the rebuilt
    conversations (conv_id, depth, a, b: the node that they end in)."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("turn_key"),
        F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long").alias("words"),
    ).where("conv_id is not null")
    turns = _pieces(turns)
    sizes = turns.groupBy("part", "conv_id").agg(F.count(F.lit(1)).alias("n"))
    starts = materialize(_carried(sizes, {"start": F.sum("n")}, {"n": F.col("n")}), "trie-pieces")
    in_piece = Window.partitionBy("part", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_key")
    placed = turns.join(starts.select("part", "conv_id", "start"), ["part", "conv_id"]).withColumn("place", F.col("start") + F.row_number().over(in_piece) - 1).drop("start")
    placed = materialize(placed, "trie-places")

    # the first turns of the conversation that c is rebuilt on
    base = F.col("conv_id") - F.col("conv_id") % group
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (heads + 1)
    opening = placed.where((F.col("place") < heads) & (F.col("conv_id") % group == 0)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "turn_key", "words"))).alias("opening"))
    convs = sizes.select("conv_id").distinct().withColumn("h", h).withColumn("base", base)
    convs = convs.join(opening, "base", "left").select("conv_id", "h", F.slice(F.coalesce("opening", F.array().cast(opening.schema["opening"].dataType)), F.lit(1), F.col("h").cast("int")).alias("opening"))
    convs = materialize(convs.withColumn("k", F.size("opening").cast("long")), "trie-openings")
    heads_of = convs.select(F.lit(-1).alias("part"), "conv_id", F.inline("opening")).select("part", "conv_id", (F.col("place") + 1).alias("depth"), "turn_key", "words")
    per_piece = starts.select("part", "conv_id").join(convs.select("conv_id", "h", "k"), "conv_id")
    own = placed.join(per_piece, ["part", "conv_id"]).where("place >= h").select("part", "conv_id", (F.col("place") - F.col("h") + F.col("k") + 1).alias("depth"), "turn_key", "words")
    turns = heads_of.unionByName(own).select("part", "conv_id", "depth", "words", _hash(0, F.col("depth")).alias("x"), _hash(1, F.col("depth")).alias("y"))
    turns = materialize(turns, "trie-rebuilt")

    # running keys: inside a piece, from what the pieces before it carry
    made = turns.groupBy("part", "conv_id").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.max("depth").alias("to"))
    pieces = materialize(_carried(made, {"from_a": F.bit_xor("x"), "from_b": F.bit_xor("y")}, {"x": F.col("x"), "y": F.col("y"), "to": F.col("to")}), "trie-carried")
    so_far = Window.partitionBy("part", "conv_id").orderBy("depth").rowsBetween(FIRST, 0)
    rows = turns.join(pieces.select("part", "conv_id", "from_a", "from_b"), ["part", "conv_id"])
    rows = rows.withColumns({"a": F.col("from_a").bitwiseXOR(F.bit_xor("x").over(so_far)), "b": F.col("from_b").bitwiseXOR(F.bit_xor("y").over(so_far))})
    rows = rows.select("part", "conv_id", "depth", "words", "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("up_a"), F.col("b").bitwiseXOR(F.col("y")).alias("up_b"))
    last = pieces.groupBy("conv_id").agg(F.max("to").alias("depth"), F.bit_xor("x").alias("a"), F.bit_xor("y").alias("b"))
    none = F.lit(0).cast("long")
    ended = convs.select("conv_id").join(last, "conv_id", "left").select("conv_id", *[F.coalesce(F.col(c), none).alias(c) for c in NODE])
    return materialize(rows, "trie-rows"), materialize(ended, "trie-ends")


def merge_tries(partial: DataFrame, keys: list[str]) -> DataFrame:
    """Partial tries as one for each of `keys`: members and ends add up, the smallest member stays."""
    own = [F.sum("n_convs").alias("n_convs"), F.sum("n_ends").alias("n_ends"), F.min("conv_id").alias("conv_id"), F.min("words").alias("words"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b")]
    return partial.groupBy(*keys, *NODE).agg(*own)


def _end_hashes(ended: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of every node that a conversation ends in. Ranges of (node, id) make pieces of the lists,
    the pieces of a node meet in order and run through one hash: a hash is sequential, so a list is one task's, but
    the task holds a piece at a time."""
    keyed = pa.schema([(c, pa.int64()) for c in NODE])
    piece, hashed = keyed.append(pa.field("first", pa.int64())).append(pa.field("ids", pa.string())), keyed.append(pa.field("ends_sha256", pa.string()))

    def batch_of(rows: list, schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, out = None, [], []
        for batch in batches:
            for *key, i in zip(*[batch.column(c).to_pylist() for c in [*NODE, "conv_id"]]):
                if key != node or len(ids) == PIECE_IDS:
                    if ids:
                        out.append([*node, ids[0], ",".join(map(str, ids))])
                    node, ids = key, []
                ids.append(i)
            if out:
                yield batch_of(out, piece)
                out = []
        if ids:
            yield batch_of([[*node, ids[0], ",".join(map(str, ids))]], piece)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for batch in batches:
            for *key, ids in zip(*[batch.column(c).to_pylist() for c in [*NODE, "ids"]]):
                if key == node:
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append([*node, state.hexdigest()])
                node, state = key, hashlib.sha256(ids.encode())
            if out:
                yield batch_of(out, hashed)
                out = []
        if node is not None:
            yield batch_of([[*node, state.hexdigest()]], hashed)

    layout = "depth bigint, a bigint, b bigint"
    pieces = ended.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(cut, f"{layout}, first bigint, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(run, f"{layout}, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = 20, heads: int = 3) -> DataFrame:
    """Nodes of the prefix trie of conversations (conv_id long, turn long, role string, text string).

    Turns are ordered by turn, null first; turns of one number by a hash of role and text. Null role or text is empty.
    Conversation c is rebuilt from the first h turns of conversation c - c % group (as many as it has) and its own turns
    after its first h; h is the CRC-32 of its decimal id modulo heads + 1. Rows without conv_id are no conversation's.
    Repeated rows are turns of their own. Returns one row a node: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256 (as the contract has them), n_ends (conversations that end
    there). No conversations: no nodes. Other columns are ignored.
    """
    rows, ended = _rebuilt(conversations, group, heads)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    partial = rows.select(F.pmod(F.col("part"), F.lit(MERGED)).alias("some"), *NODE, "conv_id", "words", "up_a", "up_b", one.alias("n_convs"), none.alias("n_ends"))
    ends = ended.select(F.pmod(F.xxhash64("conv_id"), F.lit(MERGED)).cast("int").alias("some"), *NODE, "conv_id", F.lit(None).cast("long").alias("words"), *[F.lit(None).cast("long").alias(c) for c in ("up_a", "up_b")], F.when(F.col("depth") == 0, one).otherwise(none).alias("n_convs"), one.alias("n_ends"))
    through = ended.where("depth > 0").select(F.pmod(F.xxhash64("conv_id"), F.lit(MERGED)).cast("int").alias("some"), *[none.alias(c) for c in NODE], "conv_id", *[F.lit(None).cast("long").alias(c) for c in ("words", "up_a", "up_b")], one.alias("n_convs"), none.alias("n_ends"))
    nodes = merge_tries(merge_tries(partial.unionByName(ends).unionByName(through), ["some"]), [])
    nodes = materialize(nodes, "trie-nodes")

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    known = materialize(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", none)), "trie-children")

    # bottom-up: what a conversation owns from its last turn up to each depth
    own = known.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.coalesce("words", none)).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"), (F.col("n_convs") == 1).alias("alone"))
    path = rows.select("part", "conv_id", *NODE).join(own, ["conv_id", "depth"], "left")
    path = path.select("part", "conv_id", *NODE, F.coalesce("saved", none).alias("saved"), F.coalesce("leaf", none).alias("leaf"), F.coalesce("alone", F.lit(False)).alias("alone"))
    path = materialize(path, "trie-paths")
    of_piece = path.groupBy("part", "conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    after = Window.partitionBy("conv_id").orderBy("part").rowsBetween(1, LAST)
    below = of_piece.select("part", "conv_id", *[F.coalesce(F.sum(c).over(after), none).alias(f"{c}_below") for c in ("saved", "leaf")])
    to_end = Window.partitionBy("part", "conv_id").orderBy("depth").rowsBetween(0, LAST)
    summed = path.join(below, ["part", "conv_id"]).select(*NODE, "alone", *[(F.col(f"{c}_below") + F.sum(c).over(to_end)).alias(c) for c in ("saved", "leaf")])
    root = of_piece.select(*[none.alias(c) for c in NODE], "saved", "leaf")
    up = summed.where("not alone").select(*NODE, "saved", "leaf").unionByName(root).groupBy(*NODE).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))

    # the owner of each node's parent: parents of many children go to every task, at most MANY of them by their number
    out = known.join(up, NODE, "left")
    lone = (F.col("n_convs") == 1) & (F.col("depth") > 0)
    out = out.withColumns({"saved_tokens": F.coalesce("saved_tokens", none), "n_leaves": F.when(lone | (F.col("n_children") == 0), one).otherwise(F.coalesce("n_leaves", none))})
    out = out.join(_end_hashes(ended), NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    out = _with_parent(out, known)
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "n_ends")


#: Most parents that go to every task.
MANY = 10_000


def _with_parent(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """nodes with parent_conv_id. A parent of more than a share of 1 / MANY of all nodes, of which there are MANY at most,
    would draw its children into one task: those are broadcast."""
    limit = known.count() // MANY
    parents = known.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    on = ["depth", "up_a", "up_b"]
    wide = F.broadcast(parents.where(F.col("n_children") > limit).drop("n_children").withColumnRenamed("parent_conv_id", "of_wide"))
    tried = nodes.join(wide, on, "left")
    rest = tried.where("of_wide is null").drop("of_wide").join(parents.where(F.col("n_children") <= limit).drop("n_children"), on, "left")
    return tried.where("of_wide is not null").withColumnRenamed("of_wide", "parent_conv_id").unionByName(rest)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("n_ends")


#: CRC-32 of a list of bytes in SQL, by the table that the rule gives.
CRC_TABLE = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


def crc_sql(codes: str, entries: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, z: xor(c >> 8, {entries}[(xor(c, z) & 255) + 1])), 4294967295)"


OP11_SQL = f"""
WITH crc AS (SELECT {CRC_TABLE} AS e),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS p, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {crc_sql("list_transform(string_split(conv_id::VARCHAR, ''), lambda z: ord(z)::BIGINT)", "e")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
head AS (SELECT c.conv_id, t.p, t.r, t.x FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.p < c.h),
k AS (SELECT conv_id, h, (SELECT count(*) FROM head WHERE head.conv_id = c.conv_id) AS k FROM c),
rebuilt AS (SELECT conv_id, p + 1 AS depth, r, x FROM head UNION ALL SELECT t.conv_id, k + p - h + 1, r, x FROM t JOIN k USING (conv_id) WHERE p >= h),
runs AS (SELECT conv_id, depth, len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda z: z <> '')) AS words, md5(list(md5(len(r) || ':' || r || x)) OVER (PARTITION BY conv_id ORDER BY depth)::VARCHAR) AS node FROM rebuilt),
path AS (SELECT conv_id, depth, words, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), '') AS up FROM runs UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
ended AS (SELECT conv_id, arg_max(node, depth) AS node FROM path GROUP BY conv_id),
ends AS (SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM ended GROUP BY node),
nodes AS (SELECT node, any_value(up) AS up, any_value(depth) AS depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs FROM path GROUP BY node),
children AS (SELECT up AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY up),
own AS (SELECT n.*, coalesce(children.n, 0) AS n_children FROM nodes n LEFT JOIN children USING (node)),
below AS (SELECT p.node, sum((o.n_convs - 1) * o.words) AS saved, count(*) FILTER (o.n_children = 0) AS leaves FROM own o JOIN path q ON q.conv_id = o.conv_id AND q.node = o.node
  JOIN path p ON p.conv_id = o.conv_id AND p.depth <= o.depth GROUP BY p.node)
SELECT o.conv_id, o.depth, u.conv_id AS parent_conv_id, o.n_convs, o.n_children, b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, coalesce(ends.ends, sha256('')) AS ends_sha256
FROM own o JOIN below b USING (node) LEFT JOIN own u ON u.node = o.up LEFT JOIN ends ON ends.node = o.node
"""
