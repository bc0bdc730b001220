"""Language-model scores from a subword lattice: an existing vocabulary's pieces, weighted by unigram probabilities.

The pieces come from a public vocabulary file, which says how they merge, not how likely they are. Their probabilities
start from the counts of that vocabulary's own segmentation of the training documents and are then fitted by expectation
maximisation over the lattice: each round counts every piece by its share in all segmentations of all training words.
A word's probability is the sum over all of its segmentations, by the forward recursion in log space over the lattice of
pieces, and a document's is the product over its words and one end. Each distinct word's lattice is
run once, in a table of words; the most frequent words of that table go to every task, the others are joined.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import as_bytes, by_batch, materialize, table

#: The end of a text among the words, which hold no white space.
END = b"\n"
#: Words that go to every task (about 30 bytes each); all others are joined by a shuffle.
FREQUENT = 200_000
#: Distinct words that a task counts before it hands its counts on.
COUNTED = 300_000
ALPHA = 0.1
#: Rounds of expectation maximisation.
ROUNDS = 1


def _held_out() -> Column:
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10))
    return F.coalesce(fold == 0, F.lit(False))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c): count in the training rows of docs (text, held_out) of every word of docs and of END."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text, out in zip(as_bytes(batch.column("text")), batch.column("held_out").to_pylist()):
                if out:
                    counts.update(dict.fromkeys(words_of(text), 0))
                else:
                    counts.update(words_of(text))
                    counts[END] += 1
                if len(counts) > COUNTED:
                    yield rows(counts)
                    counts.clear()
        if counts:
            yield rows(counts)

    return docs.select("text", "held_out").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def _training(words: DataFrame) -> DataFrame:
    return words.where(F.col("c") > 0).where(F.col("word") != F.lit(END))


def count_pieces(words: DataFrame, vocabulary: str) -> dict[str, float]:
    """Piece -> count in the training words, by the vocabulary's own segmentation. At most a row a piece and task."""
    schema = pa.schema([("piece", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        total = np.zeros(model.get_piece_size(), np.int64)
        for batch in batches:
            texts = [w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
            for ids, n in zip(model.encode(texts, num_threads=1), batch.column("c").to_pylist()):
                for i in ids:
                    total[i] += n
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([model.id_to_piece(int(i)) for i in found], pa.string()), pa.array(total[found], pa.int64())], schema=schema)

    rows = _training(words).mapInArrow(run, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    return {r.piece: float(r.n) for r in rows}


def expected_pieces(words: DataFrame, lattice: Lattice) -> dict[str, float]:
    """Piece -> expected count in the training words, over all segmentations. At most a row a piece and task."""
    schema = pa.schema([("piece", pa.string()), ("n", pa.float64())])
    held = words.sparkSession.sparkContext.broadcast(lattice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: defaultdict[str, float] = defaultdict(float)
        add = held.value.add_expected
        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist()):
                add(word.decode("utf-8", "replace"), n, totals)
        yield pa.RecordBatch.from_arrays([pa.array(totals.keys(), pa.string()), pa.array(totals.values(), pa.float64())], schema=schema)

    rows = _training(words).mapInArrow(run, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    held.unpersist()
    return {r.piece: r.n for r in rows}


def byte_piece(b: int) -> str:
    return f"<0x{b:02X}>"


class Lattice:
    """Natural-log probabilities of words under unigram piece probabilities."""

    def __init__(self, pieces: dict[str, float], bytes_: list[float]):
        """pieces: log probability of each piece, bytes_: of each byte piece, for characters that are no piece."""
        self.arcs: dict[str, float | None] = dict(pieces)
        for piece in pieces:  # prefixes, so that a search ends where no piece goes on
            for k in range(1, len(piece)):
                self.arcs.setdefault(piece[:k])
        self.bytes = bytes_

    def _as_bytes(self, character: str) -> float:
        return sum(self.bytes[b] for b in character.encode("utf-8", "surrogatepass"))

    def _forward(self, text: str, edges: array | None = None) -> list[float]:
        """log of the sum over all segmentations of the text up to each place; edges gets the ends of all arcs met."""
        n, arcs, exp, log = len(text), self.arcs, math.exp, math.log
        into: list[list[float]] = [[] for _ in range(n + 1)]
        into[0].append(0.0)
        at = [0.0] * (n + 1)
        for i in range(n + 1):
            terms = into[i]
            into[i] = ()  # type: ignore[call-overload]
            if not terms:
                continue
            here = at[i] = terms[0] if len(terms) == 1 else (m := max(terms)) + log(sum([exp(t - m) for t in terms]))
            if i < n and arcs.get(text[i]) is None:
                into[i + 1].append(here + self._as_bytes(text[i]))
                if edges is not None:
                    edges.extend((i, i + 1))
            for j in range(i + 1, n + 1):
                p = arcs.get(text[i:j], 1.0)
                if p is None:
                    continue
                if p > 0:
                    break
                into[j].append(here + p)
                if edges is not None:
                    edges.extend((i, j))
        return at

    def word(self, text: str) -> float:
        """log of the sum, over all segmentations of the word behind its word-start mark, of their probabilities."""
        return self._forward("▁" + text)[-1]

    def add_expected(self, text: str, n: float, totals: dict[str, float]) -> None:
        """Add to totals each piece's expected number in n such words: an arc's share of all segmentations through its
        end, times that end's share of all."""
        text, edges = "▁" + text, array("q")
        at = self._forward(text, edges)
        share = [0.0] * len(at)
        share[-1] = n
        for k in range(len(edges) - 2, -1, -2):  # an arc's end comes before all arcs that lead there
            i, j = edges[k], edges[k + 1]
            if not share[j]:
                continue
            piece = text[i:j]
            p = self.arcs.get(piece)
            part = share[j] * math.exp(at[i] + (self._as_bytes(piece) if p is None else p) - at[j])
            share[i] += part
            for name in (piece,) if p is not None else map(byte_piece, piece.encode("utf-8", "surrogatepass")):
                totals[name] += part


def fit_lattice(words: DataFrame, vocabulary: str, alpha: float = ALPHA, rounds: int = ROUNDS) -> tuple[Lattice, float]:
    """The lattice after rounds of expectation maximisation and the log probability of END, smoothed by alpha over all
    pieces and END."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    names = {model.id_to_piece(i): model.is_byte(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))}
    ends = (words.where(F.col("word") == F.lit(END)).agg(F.sum("c")).first()[0]) or 0

    def weighted(counts: dict[str, float]) -> tuple[Lattice, float]:
        total = sum(counts.get(x, 0) for x in names) + ends + alpha * (len(names) + 1)
        score = lambda n: math.log((n + alpha) / total)
        return Lattice({x: score(counts.get(x, 0)) for x, is_byte in names.items() if not is_byte}, [score(counts.get(byte_piece(b), 0)) for b in range(256)]), score(ends)

    fitted = weighted(count_pieces(words, vocabulary))
    for _ in range(rounds):
        fitted = weighted(expected_pieces(words, fitted[0]))
    return fitted


def score_documents(docs: DataFrame, vocabulary: str, frequent: int = FREQUENT, rounds: int = ROUNDS) -> DataFrame:
    """Scores of docs (doc_id long, text string), learned from the documents outside the held-out fold.

    The fold is crc32(doc_id as text) modulo 10 = 0 (null doc_id: training). Returns doc_id, held_out, n_tokens (words
    and one end), n_known (tokens met in training), train_tokens, base_score (log10, words by add-0.1 smoothing) and
    score (log10 probability of the text under the lattice). Null text is empty: one end. vocabulary: a sentencepiece
    file that every machine has. Repeated rows get a row each. Other columns are ignored. An empty table gives an empty
    table; without training documents all words are unknown.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", _held_out())
    spark = docs.sparkSession
    counted = materialize(count_words(docs), "word-counts")
    lattice, end_score = fit_lattice(counted, vocabulary, rounds=rounds)
    sums = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    floor = math.log10(sums.n + ALPHA * (sums.v + 1))
    held_lattice = spark.sparkContext.broadcast(lattice)
    scored = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("base", pa.float64()), ("lm", pa.float64())])

    def make_scores():
        run = held_lattice.value.word

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            lm = [(end_score if w == END else run(w.decode("utf-8", "replace"))) / math.log(10) for w in batch.column("word").to_pylist()]
            base = np.log10(batch.column("c").to_numpy() + ALPHA) - floor
            return pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(base, pa.float64()), pa.array(lm, pa.float64())], schema=scored)

        return one

    words = materialize(counted.mapInArrow(by_batch(make_scores), "word binary, c bigint, base double, lm double"), "words")
    top = words.orderBy(F.desc("c"), "word").limit(frequent).toArrow().combine_chunks()  # columns, a tenth of the rows' size
    held = spark.sparkContext.broadcast((top["word"].to_pylist(), top["c"].to_numpy() > 0, top["base"].to_numpy(), top["lm"].to_numpy()))
    layout = [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("word", pa.binary()), ("n", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("lm", pa.float64())]
    schema = pa.schema(layout)

    def make_documents():
        names, known, base, lm = held.value
        place = {w: i for i, w in enumerate(names)}

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            columns = (batch.column(n).to_pylist() for n in ("row", "doc_id", "held_out"))
            for row, doc_id, out, text in zip(*columns, as_bytes(batch.column("text"))):
                tokens = [*words_of(text), END]
                at = np.array([place.get(w, -1) for w in tokens], np.int64)
                seen = at[at >= 0]
                rows.append((row, doc_id, out, None, len(tokens), int(known[seen].sum()), float(base[seen].sum()), float(lm[seen].sum())))
                if len(seen) < len(tokens):
                    rest = Counter(tokens[i] for i in np.flatnonzero(at < 0))
                    rows += [(row, None, None, w, n, None, None, None) for w, n in rest.items()]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

        return one

    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    spread = materialize(numbered.mapInArrow(by_batch(make_documents), "row bigint, doc_id bigint, held_out boolean, word binary, n bigint, n_known bigint, base double, lm double"), "document-words")
    tail = spread.where("word is not null").select("row", "word", "n").join(words, "word")
    tail = tail.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("n"), F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("n_known"), (F.col("n") * F.col("base")).alias("base"), (F.col("n") * F.col("lm")).alias("lm"))
    whole = spread.where("word is null").drop("word").unionByName(tail)
    return whole.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.lit(int(sums.n)).cast("long").alias("train_tokens"), F.sum("base").alias("base_score"), F.sum("lm").alias("score"),
    ).drop("row")


def op8_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattice likelihood of all documents over the pieces of the 32k vocabulary."""
    import public_tokenizers

    return score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
