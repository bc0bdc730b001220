"""Packing by power-of-two decomposition: binary-length pieces, bucketed by length.

Each document is cut into full sequences and then pieces whose lengths are powers of two, the longest first. A sequence
is one piece, so no sequence crosses documents and nothing is padded; sequences of one length form a bucket, from which
a trainer draws batches of equal shape.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import by_batch, table

#: Distinct chunks that a worker keeps the ids of, and the longest chunk that it keeps.
CACHED, CACHED_CHARS = 100_000, 40
#: Marks the end of a word; a private character that no chunk of the fast way holds.
_END = "\U0010fffd"
_PLAIN = re.compile(r"[\x21-\x7e\xa1-\xff]+")
_ENCODERS: dict[tuple[str, int], "ChunkEncoder"] = {}


def pieces_of(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: powers of two up to longest (itself one), in falling order."""
    out, at = [], 0
    while n - at:
        length = min(longest, 1 << ((n - at).bit_length() - 1))
        out.append((at, length))
        at += length
    return out


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a letter: printable ones as themselves, the others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ChunkEncoder:
    """Ids of whole texts under a lower-casing byte-level BPE vocabulary with word ends (a file of tokenizers).

    The vocabulary's splitter never crosses white space, so a text's ids are those of its chunks between white space,
    and the ids of chunks are kept for the next time. Chunks of printable Latin-1 go through a merge loop over the
    vocabulary's own ranks (tiktoken), in which a private character stands for the word end; all other chunks go
    through tokenizers itself. Texts with the name of a special token, or
    with separators that only Python takes for white space, go through tokenizers whole.
    """

    def __init__(self, vocabulary: str, cached: int = CACHED):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.cached = Tokenizer.from_file(vocabulary), {}, cached
        with open(vocabulary, encoding="utf-8") as file:
            spec = json.load(file)
        letters, end = _byte_of_letter(), _END.encode()
        self.special = tuple(x["content"] for x in spec["added_tokens"])
        ranks = {end[:2]: 0, end[:3]: 1, end: 2}
        for token, i in spec["model"]["vocab"].items():
            if token not in self.special:
                last = token.endswith("</w>") and token != "</w>"
                ranks[bytes(letters[c] for c in (token[:-4] if last else token)) + end * last] = i + 3
        if (ranks[end[:2]], ranks[end[:3]], ranks[end]) != (0, 1, 2):
            raise ValueError("the vocabulary holds the word-end marker")
        self.fast = tiktoken.Encoding("words", pat_str=f"[^{_END}]*{_END}", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(ranks.values()) - 2, bool)
        self.ends[[i - 3 for x, i in ranks.items() if i > 2 and x.endswith(end)]] = True
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])

    def _encode(self, chunks: list[str]) -> dict[str, bytes]:
        plain = [c for c in chunks if _PLAIN.fullmatch(c)]
        words = [self.words.findall(c.lower()) for c in plain]
        out = {c: b"" for c in plain}
        if flat := [w for x in words for w in x]:
            ids = np.array(self.fast.encode_ordinary(_END.join(flat) + _END), "<u4") - 3
            stops = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
            bounds = stops[np.cumsum([0, *map(len, words)])] * 4
            data = ids.astype("<u4").tobytes()
            out = {c: data[a:b] for c, a, b in zip(plain, bounds[:-1].tolist(), bounds[1:].tolist())}
        other = [c for c in chunks if c not in out]
        for c, e in zip(other, self.tokenizer.encode_batch(other, add_special_tokens=False) if other else ()):
            out[c] = np.array(e.ids, "<u4").tobytes()
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out = []
        for text in texts:
            if "<" in text and any(x in text for x in self.special) or any(x in text for x in "\x1c\x1d\x1e\x1f"):
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            chunks = text.split()
            try:
                out.append(b"".join(map(self.known.__getitem__, chunks)))
                continue
            except KeyError:
                pass
            new = self._encode(list({c for c in chunks if c not in self.known}))
            out.append(b"".join([new[c] if c in new else self.known[c] for c in chunks]))
            if len(self.known) + len(new) > self.cached:
                self.known.clear()
            self.known.update((c, x) for c, x in new.items() if len(c) <= CACHED_CHARS)
        return out


def encoder(vocabulary: str, cached: int = CACHED) -> ChunkEncoder:
    """One for each vocabulary and Python worker."""
    if (vocabulary, cached) not in _ENCODERS:
        _ENCODERS[vocabulary, cached] = ChunkEncoder(vocabulary, cached)
    return _ENCODERS[vocabulary, cached]


def pack_power_of_two(docs: DataFrame, vocabulary: str, end_id: int = 2, longest: int = 4096, with_ids: bool = True, cached: int = CACHED) -> DataFrame:
    """Pack docs (doc_id long, text string) into sequences of at most longest tokens, a power of two.

    vocabulary: a file of the tokenizers library that every machine has; its path is a parameter. A document's ids are
    those of the whole text and then end_id; null or empty text has end_id alone. Returns one row a piece: doc_id,
    start, length, ids_crc32 (little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset (0: a piece is a
    sequence), bucket (length of the sequence) and, with_ids, ids (array of int). sequence_id is unique: the piece's place
    in its partition of docs, the partition, and in the last five bits the bucket, so nothing is shuffled; rows that
    repeat a doc_id get ids of their own. A worker keeps the ids of `cached` chunks, about 400 bytes each. Other columns are ignored. An empty table gives an empty table.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)
    end = np.array([end_id], "<u4").tobytes()

    def make():
        encode = encoder(vocabulary, cached)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, ids = [], []
            texts = ["" if x is None else x for x in batch.column("text").to_pylist()]
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), encode(texts)):
                data += end
                n = len(data) // 4
                for start, length in pieces_of(n, longest):
                    piece = data[4 * start : 4 * (start + length)]
                    rows.append((doc_id, start, length, zlib.crc32(piece), n))
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
            columns = [pa.array(x, t.type) for x, t in zip([*zip(*rows), *[ids] * with_ids], schema)]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        return one

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark_schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids
    pieces = docs.mapInArrow(by_batch(make), spark_schema)
    bucket_no = F.round(F.log2("length")).cast("long")
    sequence = (F.monotonically_increasing_id() * 32 + bucket_no).alias("sequence_id")
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence, F.lit(0).cast("long").alias("offset"), F.col("length").alias("bucket"), *["ids"] * with_ids)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids of the word BPE vocabulary."""
    import public_tokenizers

    return pack_power_of_two(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False, cached=500_000)
