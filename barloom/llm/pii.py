"""Personal data: exact patterns, and terms whose corpus co-occurrence gives a protected entity away.

Entities are found by pattern: the contract's four kinds, and credentials (long random tokens). For each entity e and
each word t of its texts, the pointwise mutual information of t and e over the distinct texts of the
corpus is held against the information content of e: a share of 1 means that the term stands only in that entity's texts
and reveals it fully. The same is estimated for each kind of entity as a whole, from the words that stand close to its
spans: they tell that such an entity follows. Terms above a disclosure threshold are generalised to the kind that they
reveal, those above a higher one that reveal a single entity are removed. Everything is built-in DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import SPACE, join_few, likely_in, materialize, settle, table

_LOCAL = "A-Za-z0-9._%+-"
#: Possessive forms of the contract's patterns: they match the same spans, in linear time and without recursion. A
#: match can begin inside a run of characters only where the match before it ended (\G).
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds of the contract, and those with credentials: long runs of letters and digits mixed.
KINDS = list(PATTERNS)
PATTERNS["secret"] = r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}+"
ENTITIES = list(PATTERNS)
#: What a text must hold for the pattern to be tried at all.
NEEDS = {"email": "@", "phone": "+"}
#: Stand for the entities of each kind while a text is split into words: a word that touches one is no term.
HOLES = dict(zip(ENTITIES, "\ufdd0\ufdd1\ufdd2\ufdd3\ufdd4"))
HOLE = f"[{''.join(HOLES.values())}]"
#: Words on each side of a span that may tell its kind.
CLOSE = 5
EDGE = ".,;:!?()\"'|"
#: Entities of a text that meet its terms in one task.
CHUNK = 100
NO_SPANS = "array<struct<start:int,end:int,value:string>>"


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _located(text: Column, pattern: Column) -> Column:
    """Leftmost non-overlapping matches of pattern: array of (start, end, value) in code points."""

    def place(found: Column) -> Column:
        steps = _let(F.split(text, pattern), lambda gaps: F.transform(found, lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), m.alias("value"))))
        first = F.struct(F.lit(0).alias("at"), F.array().cast(NO_SPANS).alias("spans"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + F.length(x["value"])
            span = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
            return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

        return F.aggregate(steps, first, step, lambda acc: acc["spans"])

    none = F.array().cast(NO_SPANS)
    return _let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: F.when(F.size(found) > 0, place(found)).otherwise(none))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.split(value, r"\.")
        bare = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(parts, lambda p: (F.length(bare(p)) < 3) | (F.length(bare(p)) == 3) & (bare(p) <= "255"))
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "secret":
        return (F.length(_digits(value)) >= 4) & (F.length(value) - F.length(_digits(value)) >= 4)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Spans of one kind that pass its test."""
    spans = F.filter(_located(text, F.lit(PATTERNS[kind])), lambda s: _valid(kind, s["value"]))
    return F.when(F.contains(text, F.lit(NEEDS[kind])), spans).otherwise(F.array().cast(NO_SPANS)) if kind in NEEDS else spans


def _words(text: Column) -> Column:
    return F.transform(F.split(text, f"[{SPACE}]+"), lambda w: F.lower(F.btrim(w, F.lit(EDGE))))


def _spans(text: Column) -> Column:
    """Spans of all kinds of entities, value: the kind's hole."""

    def holes(kind: str):
        return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(HOLES[kind]).alias("value"))

    return F.concat(*[F.transform(base_spans(text, k), holes(k)) for k in ENTITIES])


def _marked(text: Column, spans: Column) -> Column:
    """text with each run of overlapping spans replaced by the hole of the first."""
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["value"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], out).otherwise(acc["out"]).alias("out"))

    cut = F.aggregate(F.sort_array(spans), first, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, cut).otherwise(text)


def _is_term(term: Column) -> Column:
    return term.rlike(r"[\p{L}\p{N}]") & ~term.rlike(HOLE)


def _holed_words(text: Column) -> Column:
    """The words of text, with holes in place of its entities."""
    return _let(_spans(text), lambda spans: _words(_marked(text, spans)))


def _terms(docs: DataFrame) -> DataFrame:
    """(of, term): the distinct words of each text of docs (of, text, _likely: may hold an entity) in lower case, edge
    punctuation stripped. Entities stand among them as holes."""
    # outer: an inner explode makes Spark compute the words a second time, for a filter
    words = F.when(F.col("_likely"), _holed_words(F.col("text"))).otherwise(_words(F.col("text")))
    return docs.select("of", F.explode_outer(F.array_distinct(words)).alias("term")).where("term <> ''")


def _named(kind: str):
    def name(s: Column) -> Column:
        value = F.lower(s["value"]) if kind in ("email", "ip") else s["value"] if kind == "secret" else _digits(s["value"])
        return F.struct(F.lit(kind).alias("kind"), F.xxhash64(F.lit(kind), value).alias("entity"))

    return name


def _close_words(words: Column) -> Column:
    """(kind, term) of the words at most CLOSE words from a hole."""

    def around(w: Column, i: Column) -> Column:
        kind = F.coalesce(*[F.when(F.contains(w, F.lit(h)), F.lit(k)) for k, h in HOLES.items()])
        start = F.greatest(i + 1 - CLOSE, F.lit(1))
        close = F.filter(F.slice(words, start, i + 2 + CLOSE - start), lambda t: (t != "") & _is_term(t))
        none = F.array().cast("array<struct<kind:string,term:string>>")
        return F.when(kind.isNotNull(), F.transform(close, lambda t: F.struct(kind.alias("kind"), t.alias("term")))).otherwise(none)

    return F.flatten(F.transform(words, around))


def _least_shingle(text: Column) -> Column:
    """Least hash of the runs of five words: near copies share it as often as they share their runs."""

    def least(words: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 4, F.lit(1))), lambda i: F.hash(F.slice(words, i, 5)))
        return F.array_min(runs)

    return _let(F.transform(_words(text), lambda w: F.xxhash64(w)), least)


def _independent(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, both (rows of each) and independent: the effective number of texts (inverse Simpson index of column least),
    in which near copies of one text count about once and unlike texts one each."""
    counts = rows.groupBy(*keys, "least").agg(F.count(F.lit(1)).alias("_n"))
    many = F.sum("_n")
    return counts.groupBy(*keys).agg(many.alias("both"), (many * many / F.sum(F.col("_n") * F.col("_n"))).alias("independent"))


def entity_texts(docs: DataFrame) -> DataFrame:
    """(of, kind, entity) for docs (of: hash of the text, text), distinct."""
    named = F.concat(*[F.transform(base_spans(F.col("text"), k), _named(k)) for k in ENTITIES])
    return docs.select("of", F.explode_outer(F.array_distinct(named)).alias("s")).where("s is not null").select("of", "s.kind", "s.entity").distinct()


def _sets_of(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, and a fingerprint (s, t) of the set of texts (of) in which each stands. rows: distinct."""
    return rows.groupBy(*keys).agg(F.bit_xor(F.xxhash64("of")).alias("s"), F.bit_xor(F.xxhash64("of", F.lit(1))).alias("t"))


def disclosive_terms(docs: DataFrame, seen: DataFrame, threshold: float = 0.75, removal: float = 0.95, min_texts: int = 3, min_bits: float = 4.0, broadcast_terms: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(terms, hits) for docs (of, text) and their entity_texts. terms: term, share (the greatest PMI / information content over the
    entities and kinds), kind (that entity's), removed. hits: of, term for each text with such a term. Counts
    are of distinct texts, so copies of one text count once; an entity, and its pair with a term, count from an effective
    number of min_texts texts on, in which near copies are about one (see _independent). A
    kind counts as an entity that stands in the texts where the term is close to such a span, if the term tells min_bits
    about it or more: a kind that stands in most texts is no secret. Phrases are no terms:
    near copies of a text share all of theirs. Sets of up to broadcast_terms candidate terms are broadcast, larger ones are joined by a shuffle. A list of many entities
    and terms costs a pair for each two classes that stand in the same texts, dealt out by chunks of entities."""
    total = F.lit(float(docs.select("of").distinct().count()))
    information = F.log2(total / F.col("with_entity"))

    def bits(with_term: Column, both: Column = F.col("both")) -> Column:
        return F.log2(both * total / (with_term * F.col("with_entity")))

    def share(with_term: Column, both: Column = F.col("both")) -> Column:
        return F.try_divide(bits(with_term, both), information)

    def small(terms: DataFrame) -> DataFrame:
        return F.broadcast(terms) if terms.count() <= broadcast_terms else terms

    # bounds below are exact, but for rounding: a pair stands in no more texts than its entity or its term
    least = threshold - 1e-9
    of_seen = seen.select("of").distinct()
    docs = likely_in(docs.select("of", "text"), of_seen, "of")
    whole = docs.where("_likely").dropDuplicates(["of"]).join(of_seen, "of")
    least_of = materialize(whole.select("of", _least_shingle(F.col("text")).alias("least")), "entity-shingles")
    seen = materialize(seen.join(least_of, "of"), "entities")
    of_entity = _independent(seen, "entity").where(F.col("independent") >= min_texts - 1e-9).select("entity", F.col("both").alias("with_entity"))
    known = materialize(seen.join(of_entity, "entity"), "known-entity-texts")
    # the most frequent entity admits the most frequent terms
    most = known.agg(F.coalesce(F.max("with_entity"), F.lit(1)).alias("with_entity")).first()[0]
    words = materialize(_terms(whole).where(_is_term(F.col("term"))), "entity-terms")
    # a term stands in at least the texts in which it stands with any entity: what misses the threshold even so is out
    near_all = materialize(words.groupBy("term").agg(F.count(F.lit(1)).alias("near_entities")).where(F.col("near_entities") >= min_texts), "near-terms")
    at_best = share(F.col("near_entities"), F.least("with_entity", "near_entities"))
    near_known = near_all.withColumn("with_entity", F.lit(most)).where(F.coalesce(at_best >= least, F.lit(most) >= total)).drop("with_entity")
    of_text = known.groupBy("of").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    of_known = words.join(small(of_text), "of")
    # entities that stand in the same texts are one class, and so are terms: all pairs of two classes have the same counts
    alike = ["kind", "with_entity", "e1", "e2"]
    entity_sets = _sets_of(known, "entity", "kind", "with_entity").withColumnsRenamed({"s": "e1", "t": "e2"}).select("entity", "e1", "e2")
    met_terms = materialize(of_known.join(small(materialize(near_known, "near-known-terms")), "term"), "met-terms")
    term_sets = materialize(_sets_of(met_terms, "term", "near_entities"), "term-sets")
    by_class = met_terms.join(term_sets.drop("near_entities"), "term").select("of", "chunks", "near_entities", "s", "t").distinct()
    left = known.join(entity_sets, "entity").select("of", "least", *alike).distinct().withColumn("at", F.xxhash64("e1", "e2"))
    # a text with many entities meets its terms in chunks of them
    left = left.join(small(of_text), "of").withColumn("chunk", F.pmod("at", "chunks").cast("int")).drop("at", "chunks")
    right = by_class.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    met = left.join(right, ["of", "chunk"]).where(at_best >= least)
    pairs = _independent(met, *alike, "near_entities", "s", "t").where((F.col("independent") >= min_texts - 1e-9) & (share(F.col("near_entities")) >= least))
    pairs = pairs.select("kind", "with_entity", "near_entities", "s", "t", "both").distinct().join(term_sets, ["near_entities", "s", "t"])
    pairs = pairs.select("kind", "with_entity", "term", "both", F.lit(True).alias("single"))
    around = _let(_holed_words(F.col("text")), _close_words)
    beside = whole.select("of", F.explode_outer(F.array_distinct(around)).alias("s")).where("s is not null").select("of", "s.*")
    of_kind = seen.groupBy("kind").agg(F.count_distinct("of").alias("with_entity"))
    close = _independent(beside.join(least_of, "of"), "kind", "term").where(F.col("independent") >= min_texts - 1e-9)
    close = close.join(F.broadcast(of_kind), "kind").join(near_all, "term")  # a row a kind
    close = close.where((share(F.col("near_entities")) >= least) & (bits(F.col("near_entities")) >= min_bits - 1e-9)).select("kind", "with_entity", "term", "both", F.lit(False).alias("single"))
    pairs = materialize(pairs.unionByName(close), "entity-pairs")
    candidates = pairs.select("term").distinct()
    held = materialize(_terms(docs).join(small(candidates), "term", "left_semi"), "term-hits")
    of_term = held.distinct().groupBy("term").agg(F.count(F.lit(1)).alias("with_term"))
    told = pairs.join(of_term, "term").withColumn("share", share(F.col("with_term"))).where((F.col("share") >= threshold) & (F.col("single") | (bits(F.col("with_term")) >= min_bits)))
    best = F.struct("share", "single", "kind")
    told = told.groupBy("term").agg(F.max(best).alias("b")).select("term", "b.share", "b.kind", (F.col("b.single") & (F.col("b.share") >= removal)).alias("removed"))
    terms = materialize(told, "disclosive-terms")
    return terms, held.distinct().join(terms, "term")


def _joined(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def _cut(text: Column, spans: Column) -> Column:
    """text with each span (start, end, value: what stands in its place) replaced; of overlapping spans the first."""
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["value"])
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), out.alias("out"))).otherwise(acc)

    return F.aggregate(F.sort_array(spans), first, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, threshold: float = 0.75, removal: float = 0.95, min_texts: int = 3) -> DataFrame:
    """Find and cut personal data in docs (doc_id long, text string).

    Returns doc_id, text (entities replaced by <KIND>, generalised terms by <KIND-TERM>, removed terms by nothing),
    n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans as kind:start:end, by kind and start, comma-joined),
    spans (base spans, then those of secrets and terms, joined likewise; offsets in code points, end exclusive),
    n_secret, n_terms and found (any span). Spans of secrets overlap no base span, and those of terms neither. Null text
    counts as empty. Repeated rows are treated alike. Other columns are ignored. An empty table gives an empty table. Without co-occurring terms only entities are cut.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("of", F.xxhash64("text"))
    seen = materialize(entity_texts(docs), "entity-texts")

    def text_terms() -> DataFrame:
        _, hits = disclosive_terms(docs, seen, threshold, removal, min_texts)
        return hits.groupBy("of").agg(F.array_sort(F.collect_set(F.struct("term", "kind", "removed"))).alias("own"))

    own = settle(docs.sparkSession, text_terms, "text-terms")
    joined = likely_in(join_few(docs, own, "of"), seen.select("of").distinct(), "of")
    # whole words only: the match begins where a word does, with its edge, and ends at the word's end but for its edge
    edge = r"[.,;:!?()\x22'|]*+"
    quoted = F.transform("own", lambda t: F.concat(F.lit("\\Q"), F.replace(t["term"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    pattern = F.concat(F.lit(f"(?iu)(?<![^{SPACE}]){edge}(?:"), F.array_join(quoted, "|"), F.lit(f"){edge}(?![^{SPACE}])"))
    term = F.when(F.col("own").isNotNull(), F.transform(_located(F.col("text"), pattern), _bare)).otherwise(F.array().cast(NO_SPANS))
    spans = joined.select("doc_id", "text", "own", *[F.when(F.col("_likely"), base_spans(F.col("text"), k)).otherwise(F.array().cast(NO_SPANS)).alias(k) for k in ENTITIES], term.alias("term"))

    def free_of(*others: str):
        return lambda t: ~F.exists(F.concat(*others), lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))

    spans = spans.withColumn("secret", F.filter("secret", free_of(*KINDS)))
    spans = spans.withColumn("term", F.filter("term", free_of(*ENTITIES)))
    base, more = F.concat(*[_joined(k, F.col(k)) for k in KINDS]), F.concat(_joined("secret", F.col("secret")), _joined("term", F.col("term")))
    labelled = [F.transform(F.col(k), _tagged(k)) for k in ENTITIES] + [F.transform("term", _tagged("term"))]
    return spans.select(
        "doc_id", _cut(F.col("text"), F.concat(*labelled)).alias("text"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, more), ",").alias("spans"),
        F.size("secret").cast("long").alias("n_secret"), F.size("term").cast("long").alias("n_terms"),
        (F.size(base) + F.size(more) > 0).alias("found"),
    )


def _bare(s: Column) -> Column:
    """The span without edge punctuation, value: the term."""
    start = s["start"] + F.length(s["value"]) - F.length(F.ltrim(s["value"], F.lit(EDGE)))
    value = F.btrim(s["value"], F.lit(EDGE))
    return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), F.lower(value).alias("value"))


def _tagged(kind: str):
    def tag(s: Column) -> Column:
        if kind != "term":
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"<{kind.upper()}>").alias("value"))
        told = F.get(F.filter("own", lambda t: t["term"] == s["value"]), F.lit(0))
        label = F.when(told["removed"], "").otherwise(F.concat(F.lit("<"), F.upper(F.coalesce(told["kind"], F.lit("any"))), F.lit("-TERM>")))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), label.alias("value"))

    return tag


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base, secret and term spans of all documents."""
    return sanitise(table(spark, sf_dir, "documents")).drop("text")
