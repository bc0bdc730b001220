"""Spelling variants: words that differ by one inserted, deleted or replaced letter, and the usual form of each.

A word's mask holds the parity of each of its letters. One edit flips at most two bits, so of three bands of the mask at
least one stays. It also leaves either the front half or the back half of the word as it is, so words meet where a band
and a half agree (a band alone would draw a share of all words into a bucket that doesn't shrink as the vocabulary
grows), and only words of the same length or of one letter more. What meets is filtered by the bits that differ and
verified. The whole is DataFrame work over the vocabulary; the texts are read once, to count it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import materialize, table
from barloom.llm.prefix_trie import CRC_TABLE, crc_sql

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bands of the mask and bits of a band: letters are dealt to bands in turn, so that each gets common ones.
BANDS, BAND_BITS = 3, 20


def word_counts(docs: DataFrame, least_letters: int, least_count: int, noise: int) -> DataFrame:
    """(word, n) of the words of at least least_letters code points that occur least_count times. A run of which `noise`
    divides the CRC-32 of `<doc_id>:<run>` loses a letter first."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # a match of so many letters is the whole run, and shorter runs can't become longer words
    runs = F.regexp_extract_all(text, F.lit(f"([A-Za-z\\u00C0-\\u00FF]{{{least_letters},}})"), F.lit(1))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(h % noise == 0, cut).otherwise(F.col("run"))
    counted = found.select(word.alias("word")).where(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def letter_mask(word: Column) -> Column:
    """A long whose bit is set where a letter (its code point modulo the bits) occurs an odd number of times."""
    letters = F.split(word, "")
    return F.aggregate(letters, F.lit(0).cast("long"), lambda mask, x: mask.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (F.ascii(x) % (BANDS * BAND_BITS)).cast("int"))))


def _one_edit(a: Column, b: Column, longer: Column) -> Column:
    """b, of as many letters as a or `longer` (0 or 1) more, is a but for one: behind the first difference all is equal.
    Takes linear time (the built-in distance is quadratic in long words)."""
    a, b = F.split(a, ""), F.split(b, "")
    at = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True).cast("int")
    rest = F.size(b) + 1
    return (at > 0) & (F.slice(a, F.greatest(at + 1 - longer, F.lit(1)), rest) == F.slice(b, at + 1, rest))


def near_words(words: DataFrame) -> DataFrame:
    """(a, b) both ways for words (word) that one edit turns into each other."""
    masked = materialize(words.select("word", F.length("word").alias("size"), letter_mask(F.col("word")).alias("mask")), "masks")
    # bits b, b + 3, b + 6, ... make band b
    band_of = [sum(1 << i for i in range(b, BANDS * BAND_BITS, BANDS)) for b in range(BANDS)]

    def keyed(longer: int) -> DataFrame:
        """A row for each band and half, as a word of `longer` letters more than the shorter of a pair."""
        size = F.col("size") - longer
        front = F.floor(size / 2).cast("int")
        halves = F.array(F.struct(F.lit("<").alias("side"), F.substring("word", F.lit(1), front).alias("half")), F.struct(F.lit(">").alias("side"), F.substring(F.col("word"), front + longer + 1, F.col("size")).alias("half")))
        bands = F.array(*[F.struct(F.lit(b).alias("no"), F.col("mask").bitwiseAND(F.lit(m)).alias("bits")) for b, m in enumerate(band_of)])
        return masked.select("word", "mask", size.alias("size"), F.explode(halves).alias("h"), bands.alias("bands")).select("word", "mask", "size", "h.side", "h.half", F.explode("bands").alias("band")).select("word", "mask", "size", "side", "half", "band.no", "band.bits")

    on = ["size", "side", "half", "no", "bits"]
    one = keyed(0)
    other = keyed(0).withColumn("longer", F.lit(0)).unionByName(keyed(1).withColumn("longer", F.lit(1))).withColumnsRenamed({"word": "word_b", "mask": "mask_b"})
    met = one.join(other, on).where((F.col("longer") == 1) | (F.col("word") < F.col("word_b")))
    close = met.where(F.bit_count(F.col("mask").bitwiseXOR(F.col("mask_b"))) <= 2)
    pairs = materialize(close.select("word", "word_b", "longer").distinct().where(_one_edit(F.col("word"), F.col("word_b"), F.col("longer"))), "near-words")
    return pairs.select(F.col("word").alias("a"), F.col("word_b").alias("b")).unionByName(pairs.select(F.col("word_b").alias("a"), F.col("word").alias("b")))


def group_variants(docs: DataFrame, least_letters: int = 6, least_count: int = 5, times: int = 5, noise: int = 199) -> DataFrame:
    """Words of docs (doc_id, text string) with their usual forms.

    Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. A word's form is its near word of
    largest n (ties: the smallest), if that is `times` its own n or more. Returns word, form (or null), root (the end of
    the chain of forms, the word itself without), n, n_near, form_n. Null text has no words, a null doc_id counts as
    empty; repeated rows count again. Other columns are ignored. An empty table, or one without such words, gives an
    empty table. Each form is `times` as frequent as the one before, so chains have at most log(n) / log(times) links.
    """
    words = materialize(word_counts(docs, least_letters, least_count, noise), "word-counts")
    near = near_words(words.select("word"))
    of_b = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"))
    best = near.join(of_b, "b").groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("m"), F.col("b"))).alias("best"))
    out = words.join(best.withColumnRenamed("a", "word"), "word", "left")
    has = -F.col("best.m") >= times * F.col("n")
    out = materialize(out.select("word", F.when(has, F.col("best.b")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, -F.col("best.m")).alias("form_n")), "forms")

    # the chain's end: each step doubles what a word has followed, so a few steps reach any end
    chain = out.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = chain.select(F.col("word").alias("root"), F.col("root").alias("further"))
        chain = materialize(chain.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not chain.where("moved").take(1):
            break
        chain = chain.select("word", "root")
    return out.join(chain.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of all words of all documents."""
    return group_variants(table(spark, sf_dir, "documents"))


_BYTES = "flatten(list_transform(string_split(doc_id::VARCHAR || ':' || r, ''), lambda z: CASE WHEN ord(z) < 128 THEN [ord(z)::BIGINT] ELSE [195, ord(z)::BIGINT - 64] END))"
OP13_SQL = f"""
WITH RECURSIVE crc AS (SELECT {CRC_TABLE} AS e),
runs AS (SELECT doc_id, translate(r, '{UPPER}', '{LOWER}') AS r, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS r FROM documents) GROUP BY 1, 2),
h AS (SELECT r, k, {crc_sql(_BYTES, "e")} AS h FROM runs, crc),
w AS (SELECT CASE WHEN h % 199 = 0 THEN left(r, (h % length(r))::INTEGER) || substr(r, (h % length(r))::INTEGER + 2) ELSE r END AS word, k FROM h),
words AS (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
holes AS (SELECT word, n, i, left(word, i) || chr(0) || substr(word, i + 2) AS hole, left(word, i) || substr(word, i + 2) AS cut FROM (SELECT *, unnest(range(length(word)))::INTEGER AS i FROM words)),
pairs AS (SELECT a.word AS a, b.word AS b, b.n FROM holes a JOIN holes b USING (hole) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.cut = b.word UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.cut = b.word),
best AS (SELECT a, count(*) AS n_near, max(n) AS n, min(b) FILTER (n = top) AS b FROM (SELECT *, max(n) OVER (PARTITION BY a) AS top FROM pairs) GROUP BY a),
f AS (SELECT w.word, CASE WHEN best.n >= 5 * w.n THEN best.b END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 5 * w.n THEN best.n END AS form_n FROM words w LEFT JOIN best ON best.a = w.word),
chain AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN f ON f.word = c.next)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""
