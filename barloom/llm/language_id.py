"""Language identification by compression.

For each language a bounded sample of labelled texts becomes a raw-content zstandard dictionary. A text is encoded slice
by slice with each dictionary and gets the language whose encodings are smallest in sum; a narrow margin to the next one
is a rejection.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import by_batch, table

UNKNOWN = "und"
#: Bits of the match window (a dictionary stays in reach of the first 2**WINDOW_LOG bytes). Matches of three bytes and
#: a lazy search tell languages apart in short texts; the fast strategies miss most short matches.
WINDOW_LOG, MIN_MATCH, SEARCH_LOG = 19, 3, 2
#: Most bytes encoded at once: in a longer text the search finds the text itself instead of the dictionary.
SLICE = 1 << 14
BREAK = re.compile(rb"[\x20\x09-\x0D]")
#: A smaller encoding is better evidence the more bytes it saves; a byte's share of the odds, as matches are not independent.
ODDS_PER_BYTE = 0.5
_MODELS: dict[int, list] = {}


def fit_dictionaries(labelled: DataFrame, max_docs: int = 200, max_chars: int = 1500, languages: int = 500, rare: float = 0.5, most_chars: int = 48_000_000) -> list[tuple[str, bytes]]:
    """(language, dictionary) from labelled (text, lang), the languages in order.

    Bounds: at most `languages` languages (the most frequent), about max_docs unlike texts for each, max_chars characters
    from the middle of each of those, and most_chars characters of all: with many languages each has fewer texts. Texts
    are chosen by their hash, so at one rate over the whole table, whatever its order and size; copies count once. Dictionaries have one length, or the longest would win by its length: that
    of the shortest language's sample. A language whose sample is shorter than `rare` of the median one shortens no other
    language's dictionary: it keeps its own, shorter one, and so wins only where that is clearly the better match.
    """
    labelled = labelled.where("lang is not null and text is not null and text <> ''")
    of_lang = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("texts"))
    counts = of_lang.orderBy(F.desc("rows"), "lang").limit(languages).collect()
    if not counts:
        return []
    max_docs = min(max_docs, max(1, most_chars // (2 * len(counts) * max_chars)))
    # of the hash's 2**31 values, those below a language's limit: about twice max_docs of its documents
    limits = [F.when(F.col("lang") == r.lang, F.lit(min(1 << 31, math.ceil((2 * max_docs + 20) / max(1, r.texts) * (1 << 31))))) for r in counts]
    rank = F.shiftrightunsigned(F.xxhash64("text"), 33)
    start = F.greatest(F.lit(1), F.floor((F.length("text") - max_chars) / 2).cast("int"))
    sample = labelled.where(rank < F.coalesce(*limits)).select("lang", F.substring("text", start, F.lit(max_chars)).alias("text"), rank.alias("rank"))
    rows = sorted(map(tuple, sample.distinct().collect()), key=lambda r: (r[0], r[2], r[1]))
    out = []
    for lang in sorted({r[0] for r in rows}):
        texts = [text for _, text, _ in [r for r in rows if r[0] == lang][:max_docs]]
        out.append((lang, "\n".join(texts).lower().encode()))
    sizes = sorted(len(d) for _, d in out)
    shortest = min(n for n in sizes if n >= rare * sizes[len(sizes) // 2])
    return [(lang, data[-shortest:]) for lang, data in out]


def _compressors(model: list[tuple[str, bytes]]) -> list:
    key = hash(tuple(model))
    if key not in _MODELS:
        _MODELS.clear()
        made = []
        for _, data in model:
            own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(3, window_log=WINDOW_LOG, min_match=MIN_MATCH, search_log=SEARCH_LOG, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
            own.precompute_compress(compression_params=params)
            made.append(zstandard.ZstdCompressor(dict_data=own, compression_params=params))
        _MODELS[key] = made
    return _MODELS[key]


def slices(data: bytes) -> list[bytes]:
    """UTF-8 text in pieces of about one size, SLICE bytes at most, cut after white space where a piece's second half has any."""
    count = -(-len(data) // SLICE)
    out, at = [], 0
    while len(data) - at > SLICE:
        end = at + min(SLICE, -(-len(data) // count))
        spaces = [m.end() for m in BREAK.finditer(data, (at + end) // 2, end)]
        if spaces:
            end = spaces[-1]
        while data[end] & 0xC0 == 0x80:  # inside a character
            end -= 1
        out.append(data[at:end])
        at = end
    return [*out, data[at:]]


def classify(text: str, model: list[tuple[str, bytes]], compressors: list) -> tuple[str, float, float]:
    """(language, score, margin). All slices of the text count. Score: from the bytes saved in a slice on average.
    Margin: bytes that the best dictionary saves against the next, a character."""
    if not model or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, 0.0
    pieces = slices(text.lower().encode())
    sizes = [sum(len(c.compress(p)) for p in pieces) for c in compressors]
    best = min(range(len(sizes)), key=lambda i: (sizes[i], -len(model[i][1])))
    others = sizes[:best] + sizes[best + 1 :]
    odds = sum(math.exp(max(-700.0, -ODDS_PER_BYTE * (s - sizes[best]) / len(pieces))) for s in others)
    margin = (min(others) - sizes[best]) / len(text) if others else 1.0
    return model[best][0], 1 / (1 + odds), margin


def identify_language(docs: DataFrame, model: list[tuple[str, bytes]], min_score: float = 0.75) -> DataFrame:
    """Language of each whole text of docs (text string; all other columns pass through unchanged).

    Adds lang_pred (a language of the model; `und` if text is null or has no letter, or the model is empty), score (0 to
    1: the smallest encoding's share of the odds, by the mean over the slices; 0 for `und`), margin (bytes saved a character) and rejected (score
    below min_score: the margin is narrow). Columns of these names in docs are replaced. Ties go to the language with the longer
    dictionary, then to the first in order. Repeated rows are treated alike; an empty table gives an empty table.
    """
    docs = docs.drop("lang_pred", "score", "margin", "rejected")
    held = docs.sparkSession.sparkContext.broadcast(model)
    added = "lang_pred string, score double, margin double, rejected boolean"
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema] + [added])

    def make():
        model = held.value
        compressors = _compressors(model)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [classify(t or "", model, compressors) for t in batch.column("text").to_pylist()]
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            columns.append(pa.array([x[1] < min_score for x in found], pa.bool_()))
            return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "lang_pred", "score", "margin", "rejected"])

        return one

    return docs.mapInArrow(by_batch(make), schema)


def _fold(of: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of))


def training_rows(docs: DataFrame) -> DataFrame:
    """Labelled rows outside the held-out fold (crc32 of doc_id modulo 4 is 2)."""
    return docs.where(F.coalesce(_fold(4) != 2, F.lit(True))).select("text", "lang")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from the labelled ones outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = fit_dictionaries(training_rows(docs))
    found = identify_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "rejected")
