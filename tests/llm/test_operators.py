"""Each operator on edge cases, and its query against brute force on the small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom import llm
from barloom.llm import common, decontaminate, html_extract, language_id, lattice_lm, line_dedup, near_dedup, packing, pii, quality_rules, sharding
from barloom.llm.components import connected_components
from tests.llm.conftest import LOWER, WORD

BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---- 1 near-dedup ----
def _shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def _components(sets):
    parent, found = {d: d for d in sets}, defaultdict(list)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, own in sets.items():
        seen = Counter(e for s in own for e in found[s])
        for e, k in seen.items():
            if 100 * k >= 80 * (len(own) + len(sets[e]) - k):
                a, b = sorted((top(d), top(e)))
                parent[b] = a
        for s in own:
            found[s].append(d)
    return {d: top(d) for d in sets}


def test_near_dedup_matches_brute_force(spark, sf, texts):
    sets = {d: _shingles(t, 4) for d, t in texts.items()}
    want = _components(dict(sorted(sets.items())))
    got = llm.QUERIES["op1_minhash_near_dedup"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_dedup_oracle(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.sql(f"SELECT doc_id, n_shingles, component_id, kept FROM ({llm.ORACLE_SQL['op1_minhash_near_dedup']})").fetchall())
    assert sorted(map(tuple, llm.QUERIES["op1_minhash_near_dedup"](spark, sf).collect())) == want


@pytest.mark.parametrize("chunk", [1000, 3])
def test_near_dedup_large_groups(spark, monkeypatch, chunk):
    """A chain of near copies and documents that share a passage only; also with shingles met in small chunks."""
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijk", k=6))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(150):  # each differs from the one before by a word: a chain of links, ends unlike each other
        base[(7 * i) % 120] = word()
        rows.append((i, " ".join(base)))
    passage = " ".join(word() for _ in range(40))
    rows += [(1000 + i, passage + " " + " ".join(word() for _ in range(30))) for i in range(100)]
    want = _components({d: _shingles(t, 5) for d, t in rows})
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_near_dedup_edges(edge, empty):
    got = near_dedup.near_duplicates(edge, words=4).collect()
    assert len(got) == edge.count()
    of = defaultdict(set)
    for r in got:
        of[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert {c for i in (1, 2, 3, 4) for _, c, _ in of[i]} == {1}
    assert of[5] == {(0, 5, True)} and of[6] == {(0, 6, True)} and of[7] == {(0, 7, True)}
    assert of[9] == {(1, 9, True)} and of[10] == {(1, 9, False)}
    assert {(c, k) for _, c, k in of[None]} == {(1, False)}
    assert near_dedup.near_duplicates(empty).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (20, 21), (7, 7), (4, 5), (None, 2)], "a long, b long")
    assert {tuple(r) for r in connected_components(links).collect()} == {(4, 3), (5, 3), (9, 3), (21, 20)}


# ---- 2 sharding ----
def test_sharding_law(spark, sf, texts):
    rows = llm.QUERIES["op2_sharding"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    mean, longest = sum(sizes.values()) / 40, max(len(t.encode()) for t in texts.values()) + 16
    assert all(abs(sizes[s] - mean) <= 2 * longest for s in range(40))


def test_sharding_hot_text(spark):
    rows = [(i, "same text" * 20 if i % 3 == 0 else f"text {i} " * 20) for i in range(3000)]
    got = sharding.histogram_sort_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8, block_rows=100).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert len(got) == 3000 and max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 8
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(8))


def test_sharding_slots_are_in_order_at_any_block_size(spark):
    """Slots follow (hash of the text, doc_id), though blocks of a few rows cut buckets, and a group of copies whose ids lie
    in clumps, into many."""
    rows = [(i if i % 4 else i * 1000, "a copy" if i % 2 else f"text {i % 700}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = []
    for block_rows in (7, 100_000):
        got = sharding.histogram_sort_shards(frame, 6, block_rows=block_rows).withColumn("k", F.shiftrightunsigned(F.xxhash64("text"), 1)).collect()
        placed = sorted(got, key=lambda r: (r.shard, r.slot))
        assert [(r.k, r.doc_id) for r in placed] == sorted((r.k, r.doc_id) for r in got)
        found.append([(r.doc_id, r.shard, r.slot) for r in placed])
    assert found[0] == found[1]


def test_sharding_edges(edge, empty):
    got = sharding.histogram_sort_shards(edge, 5).collect()
    assert len(got) == edge.count() and all(0 <= r.shard < 5 for r in got)
    assert sharding.histogram_sort_shards(empty, 5).count() == 0


# ---- 3 language ID ----
def test_language_held_out_accuracy(spark, sf):
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = llm.QUERIES["op3_language_id"](spark, sf).collect()
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in held) >= 0.93 * len(held)
    assert sum(r.rejected for r in rows) < 0.06 * len(rows)


def test_language_edges(spark, sf, edge, empty):
    model = language_id.fit_dictionaries(language_id.training_rows(spark.read.parquet(f"{sf}/documents.parquet")))
    assert sorted(m[0] for m in model) == ["de", "en", "es", "fr"] and len({len(m[1]) for m in model}) == 1
    got = language_id.identify_language(edge, model)
    assert got.columns[: len(edge.columns) - 1] == [c for c in edge.columns if c != "score"]
    rows = defaultdict(list)
    for r in got.collect():
        rows[r.doc_id].append(r)
    assert all(rows[i][0].lang_pred == "und" and rows[i][0].score == 0 and rows[i][0].rejected for i in (5, 6, 7, 11))
    assert rows[1][0].lang_pred == "en" and {r.lang_pred for r in rows[2]} == {"en"}
    assert language_id.identify_language(empty, model).count() == 0
    assert {r.lang_pred for r in language_id.identify_language(edge, []).collect()} == {"und"}
    assert language_id.fit_dictionaries(empty.select("text", "lang")) == []


def test_language_sample_counts_copies_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang")
    copied = docs.unionByName(docs.where("lang = 'en'").orderBy(F.length("text").desc()).limit(1).crossJoin(spark.range(5000)).drop("id"))
    plain, other = (dict(language_id.fit_dictionaries(x, max_docs=20, max_chars=300)) for x in (docs, copied))
    assert plain == other  # thousands of copies of one text change nothing
    bound = language_id.fit_dictionaries(docs, max_docs=200, max_chars=100, most_chars=4000)
    assert all(len(d) <= 4 * 100 * 5 + 20 for _, d in bound)


def test_language_rare_language_changes_no_other(spark, sf):
    """A language with a line of text, one with a few, and the others' predictions with and without them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = language_id.training_rows(docs)
    rare = spark.createDataFrame([("salve mundi quid agis hic", "aa")] + [(f"habari ya asubuhi rafiki yangu namba {i} karibu sana nyumbani", "sw") for i in range(30)], "text string, lang string")
    one, two = language_id.fit_dictionaries(rows), language_id.fit_dictionaries(rows.unionByName(rare))
    assert [m for m in two if m[0] not in ("aa", "sw")] == one and {m[0] for m in two} == {"aa", "de", "en", "es", "fr", "sw"}
    found = [{r.doc_id: (r.lang_pred, r.rejected) for r in language_id.identify_language(docs, m).collect()} for m in (one, two)]
    assert sum(found[0][d] != found[1][d] for d in found[0]) <= 0.01 * len(found[0])
    assert language_id.classify("karibu sana rafiki yangu, habari ya asubuhi nyumbani", two, language_id._compressors(two))[0] == "sw"


def test_language_classify_matches_brute_force(spark, sf, texts):
    import zstandard

    model = language_id.fit_dictionaries(language_id.training_rows(spark.read.parquet(f"{sf}/documents.parquet")))
    compressors = language_id._compressors(model)

    def size(data, dictionary):
        params = zstandard.ZstdCompressionParameters.from_level(3, window_log=19, min_match=3, search_log=2, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params).compress(data))

    for text in [t for t in list(texts.values())[:60] if any(map(str.isalpha, t))] + ["x", "Ünï 123"]:
        pieces = language_id.slices(text.lower().encode())
        sizes = {lang: sum(size(p, d) for p in pieces) for lang, d in model}
        lang, score, margin = language_id.classify(text, model, compressors)
        least, second = sorted(sizes.values())[:2]
        assert sizes[lang] == least and margin == (second - least) / len(text)
        assert score == pytest.approx(1 / sum(math.exp(-0.5 * (s - least) / len(pieces)) for s in sizes.values()))


def test_language_whole_text_decides():
    """Every part of a long text counts, whatever stands at its start."""
    rng = random.Random(5)
    words = {k: ["".join(rng.choices(letters, k=rng.randint(3, 9))) for _ in range(800)] for k, letters in (("aa", "abcdefghijklm"), ("bb", "nopqrstuvwxyz"))}
    write = lambda k, n: " ".join(rng.choices(words[k], k=n))
    model = [(k, write(k, 30_000).encode()[:200_000]) for k in words]
    compressors = language_id._compressors(model)
    digits = " ".join(str(rng.randrange(10**9)) for _ in range(80_000))
    for k in words:
        text = digits + " " + write(k, 20_000)
        assert language_id.classify(text, model, compressors)[0] == k
        assert language_id.classify(text, model, compressors)[2] * len(text) > 5_000
    other = write("aa", 15_000) + " " + write("bb", 250_000)
    assert language_id.classify(other, model, compressors)[0] == "bb"
    for text in (digits, "é日😀" * 20_000, "x" * 16_384, ""):
        pieces = language_id.slices(text.encode())
        assert b"".join(pieces) == text.encode() and max(map(len, pieces)) <= language_id.SLICE and all(p.decode() is not None for p in pieces)


# ---- 4 PII ----
CONTRACT = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def _base(text):
    out = []
    for kind, pattern in CONTRACT.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(d) <= 19 and _luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TRICKY = ["a@b.c_d@e.f g@h", "x..y@z.co.uk.", "@a.b a@.b a@b. a@b.c-d", "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.4 1.2.3", "4111-1111 1111-1111 4111  1111", "4111111111111111 5500005555555559 1234567890123456", "+1 (555) 010-9999 +49 30 123456 +1 2 3", "+1+2 3456789012345 +123456789-", "é😀 a@b.de 日本 10.1.2.3", "1 " * 5000, "+1" + " " * 3000 + "2", "a" * 20000 + "@"]


def test_pii_base_matches_contract(spark, sf, texts):
    for r in llm.QUERIES["op4_pii"](spark, sf).collect():
        spans = _base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest() and r.spans.startswith(",".join(spans))
    rows = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    for r in pii.sanitise(rows).collect():
        spans = _base(TRICKY[r.doc_id])
        assert r.spans == ",".join(spans), TRICKY[r.doc_id][:60]
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(spans)


def test_pii_disclosive_terms(spark):
    """A name that stands only beside one person's address is cut; common words are not."""
    rng = random.Random(3)
    noise = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) for _ in range(12))
    rows = [(i, f"{noise()} Zanzibarov writes from zb@corp.example.com {noise()}") for i in range(6)]
    rows += [(100 + i, f"{noise()} mail user{i}@x.example.org {noise()}") for i in range(60)] + [(200, f"{noise()} only zanzibarov here")]
    got = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(6):
        assert "Zanzibarov" not in got[i].text and "<EMAIL>" in got[i].text and "term:" in got[i].spans
        assert got[i].spans.startswith(",".join(_base(dict(rows)[i])))
    assert got[200].n_terms == 1 and all(got[100 + i].n_terms == 0 for i in range(60))
    copies = spark.createDataFrame([(i, "Copied text names Solo near one@two.example.com") for i in range(50)] + [(99, "other words")], "doc_id long, text string")
    assert all(r.n_terms == 0 for r in pii.sanitise(copies).collect())  # copies of one text are one text


def test_pii_every_word_is_a_candidate(spark):
    """Terms with digits, hyphens, apostrophes or regex signs, of one letter, with combining marks, and far from the entity."""
    rng = random.Random(4)
    noise = lambda n=12: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) for _ in range(n))
    terms = ["jdoe42", "AB-1234", "Smith-Jones", "O'Neil", "李", "हिन्दी", "Rene\u0301", "c++(x", "a\\Eb"]
    rows = [(i, f"{' '.join(terms)} {noise(40)} mail zb@corp.example.com {noise(40)} ({terms[0]}), faraway.") for i in range(6)]
    rows += [(100 + i, f"{noise()} mail user{i}@x.example.org {noise()}") for i in range(60)]
    rows += [(200, "alpha jdoe42.x AB-1234, call 10.0.0.7 42"), (201, "x@jdoe42.de beta")]
    got = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(6):
        left = set(got[i].text.lower().split())
        assert got[i].n_terms == len(terms) + 2 and not {t.lower() for t in [*terms, "faraway."]} & left and "<email>" in left
        term = [tuple(map(int, x.split(":")[1:])) for x in got[i].spans.split(",") if x.startswith("term:")]
        assert [rows[i][1][a:b] for a, b in term] == [*terms, terms[0], "faraway"]
    assert got[200].n_terms == 1 and "jdoe42.x" in got[200].text and got[201].n_terms == 0
    assert all(got[100 + i].n_terms == 0 for i in range(60))


def test_pii_shares_match_brute_force(spark):
    """Disclosure of every word by single entities and by kinds, from the definition."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(25)] + ["O'Neil", "Smith-Jones", "x1"]
    people = [("ann@a.example.com", ["Zorro", "Quix"]), ("10.1.2.3", ["hostline"]), ("+1 (555) 010-9999", ["red", "door"])]
    rows = []
    for i in range(400):
        own = rng.choices(words, [1 / (n + 1) for n in range(len(words))], k=rng.randrange(5, 30))
        if i % 7 == 0:
            value, near = people[rng.randrange(3)]
            at = rng.randrange(len(own))
            own[at:at] = [*(near if rng.random() < 0.8 else []), value]
        if i % 23 == 0:
            own += ["token", f'"{rng.randrange(10**12):012d}abcdefgh{i:03d}"', "end"]
        rows.append((i, " ".join(x + rng.choice(["", "", ",", "."]) if x not in ("token",) else x for x in own)))
    rows += rows[:30]  # copies count once
    texts = sorted({t for _, t in rows})
    total, of_entity, of_kind, single, beside, df = len(texts), defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    patterns = {**CONTRACT, "secret": r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}"}
    for n, t in enumerate(texts):
        found = [(m.start(), m.end(), k, m.group()) for k, p in patterns.items() for m in re.finditer(p, t) if k not in ("ip", "phone") or f"{k}:{m.start()}:{m.end()}" in _base(t)]
        found = [f for f in found if f[2] != "card" or f"card:{f[0]}:{f[1]}" in _base(t)]
        marked, at = "", 0
        for a, b, k, _ in sorted(found):
            if a >= at:
                marked += t[at:a] + f"\x00{k}\x00"
            at = max(at, b)
        own = [w.strip(pii.EDGE).lower() for w in (marked + t[at:]).split()]
        terms = {x for x in own if "\x00" not in x and re.search(r"\w", x)}
        for x in terms:
            df[x].add(n)
        for _, _, k, v in found:
            e = (k, v.lower() if k in ("email", "ip") else v if k == "secret" else re.sub("[^0-9]", "", v))
            of_entity[e].add(n)
            of_kind[k].add(n)
            for x in terms:
                single[e, x].add(n)
        for i, w in enumerate(own):
            if "\x00" in w:
                for x in own[max(0, i - 5) : i + 6]:
                    if x in terms:
                        beside[w.split("\x00")[1], x].add(n)
    best = {}
    for (e, x), both in single.items():
        if len(both) >= 3:
            share = math.log2(len(both) * total / len(df[x]) / len(of_entity[e])) / math.log2(total / len(of_entity[e]))
            best[x] = max(best.get(x, (0, False, "")), (share, True, e[0]))
    for (k, x), both in beside.items():
        bits = math.log2(len(both) * total / len(df[x]) / len(of_kind[k]))
        if len(both) >= 3 and bits >= 4:
            best[x] = max(best.get(x, (0, False, "")), (bits / math.log2(total / len(of_kind[k])), False, k))
    want = {x: (round(v[0], 9), v[2], v[1] and v[0] >= 0.95) for x, v in best.items() if v[0] >= 0.75}
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(F.xxhash64("text").alias("of"), "text")
    terms, hits = pii.disclosive_terms(docs, pii.entity_texts(docs))
    assert {r.term: (round(r.share, 9), r.kind, r.removed) for r in terms.collect()} == want
    assert {"zorro", "hostline"} <= set(want) and want["token"][1:] == ("secret", False)
    assert hits.count() == sum(len(df[x]) for x in want)


def test_pii_lists_of_entities_make_no_pairs(spark, monkeypatch):
    """Texts with many entities and terms: classes instead of pairs, in chunks; the same terms as for each entity alone."""
    rng = random.Random(12)
    names, people = [f"name{i}" for i in range(200)], [f"user{i}@corp.example.com" for i in range(300)]
    mixed = lambda xs: " ".join(rng.sample(xs, len(xs)))
    rows = [(i, f"{mixed(people)} {mixed(names)}") for i in range(4)]
    rows += [(10 + i, f"{mixed(people[:20])} {mixed(names[:5])} also") for i in range(4)]
    rows += [(100 + i, f"text {i} of other words {names[i % 2]}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(F.xxhash64("text").alias("of"), "text")
    got = []
    for size in (100, 3):
        monkeypatch.setattr(pii, "CHUNK", size)
        got.append({tuple(r) for r in pii.disclosive_terms(docs, pii.entity_texts(docs))[0].collect()})
    assert got[0] == got[1] and {*names[2:]} <= {r[0] for r in got[0]} and not {*names[:2]} & {r[0] for r in got[0]}
    assert all(r[1] == 1.0 and r[3] for r in got[0] if r[0] != "also")


def test_pii_credentials(spark):
    """Credentials are cut and the word before them is generalised to their kind."""
    rng = random.Random(8)
    noise = lambda n=9: " ".join(rng.choice(["red", "blue", "door", "wall", "lamp", "tree"]) for _ in range(n))
    rows = [(100 + i, f"{noise()} wall {noise()} {i}") for i in range(80)]
    rows += [(200 + i, f'{noise()} token = "{i:04d}abcdefabcdef{i:04d}abcdef" {noise()}') for i in range(4)]
    got = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(4):
        assert got[200 + i].n_secret == 1 and got[200 + i].n_terms == 1 and '<SECRET-TERM> = "<SECRET>"' in got[200 + i].text and got[200 + i].found
        assert got[200 + i].n_email + got[200 + i].n_card + got[200 + i].n_phone == 0
    assert not any(got[100 + i].found for i in range(80))


def test_pii_edges(edge, empty):
    got = pii.sanitise(edge).collect()
    assert len(got) == edge.count()
    row = next(r for r in got if r.doc_id == 12)
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1) and "10.0.0.256" in row.text and "<CARD>" in row.text
    assert next(r for r in got if r.doc_id == 5).base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.sanitise(empty).count() == 0


# ---- 5 line dedup ----
def _lines(rows, least, first):
    key = lambda x: x.strip(" \t\n\v\f\r").translate(LOWER)
    found, place = Counter(), {}
    for n, (d, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")} - {""}:
            found[k] += 1
        for m, x in enumerate((t or "").split("\n")):
            place.setdefault(key(x), []).append((d is None, d or 0, m))
    out = []
    for d, t in rows:
        kept = [x for m, x in enumerate((t or "").split("\n")) if not key(x) or found[key(x)] < least or first and min(place[key(x)]) == (d is None, d or 0, m)]
        out.append((d, "\n".join(kept)))
    return out


@pytest.mark.parametrize("hot, keys", [(500, 500_000), (3, 500_000), (3, 2), (0, 4)])
def test_hot_keys_join_as_others_do(spark, monkeypatch, hot, keys):
    """Keys of many rows, more hot ones than may be broadcast, and keys without rows."""
    monkeypatch.setattr(common, "HOT", hot)
    monkeypatch.setattr(common, "HOT_KEYS", keys)
    rows = spark.createDataFrame([(k, n) for k in range(8) for n in range(2**k if k < 6 else 5)], "key long, n long")
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("key <> 7").withColumn("more", F.col("key") * 2)
    got = common.join_hot(rows, shared, "key")
    assert sorted(map(tuple, got.select("key", "n", "df", "more").collect())) == sorted(map(tuple, rows.join(shared, "key").select("key", "n", "df", "more").collect()))
    assert common.join_hot(rows.limit(0), shared.limit(0), "key").count() == 0


@pytest.mark.parametrize("broadcast", [1000, 0])
@pytest.mark.parametrize("first", [False, True])
def test_line_dedup_matches_brute_force(spark, broadcast, first):
    rng = random.Random(1)
    pool = [f"line {i % 9}" for i in range(30)] + ["  Line 3\t", "LINE 4", "", " "]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randrange(6))) + f"\nown {i}") for i in range(60)] + [(100, None), (101, ""), (102, "own 5"), (None, "line 1\nline 2")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = line_dedup.dedup_lines(frame, 5, first, broadcast_keys=broadcast).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(_lines(rows, 5, first), key=key)
    assert all(r.kept_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in got)


def test_line_dedup_oracle(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({llm.ORACLE_SQL['op5_line_dedup']})").fetchall())
    got = llm.QUERIES["op5_line_dedup"](spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == want


def test_line_dedup_edges(edge, empty):
    got = line_dedup.dedup_lines(edge, 2)
    assert got.columns == [c for c in edge.columns if c not in line_dedup.ADDED] + line_dedup.ADDED
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].text == "" and rows[3].text == "" and rows[5].n_lines == 1 and rows[7].n_dropped == 0 and rows[13].text == "x" * 50_000
    assert line_dedup.dedup_lines(empty).count() == 0
    tiny = line_dedup.dedup_lines(edge, 2, bits=line_dedup.SEGMENT_BITS)  # a filter that is too small changes nothing
    assert sorted(map(str, tiny.select("doc_id", "text").collect())) == sorted(map(str, got.select("doc_id", "text").collect()))


# ---- 6 quality ----
def _statistics(text):
    w, seen, covered = WORD.findall(text), defaultdict(list), set()
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark, edge, texts):
    extra = {10_000: "a b c d e f g h " * 5, 10_001: "a " * 9, 10_002: "x\n\nx\n x\n\n", 10_003: "a b c d e f g h", 10_004: ("q w e r t y u i o " * 3 + "z ") * 4}
    every = {**texts, **extra}
    for r in quality_rules.text_statistics(spark.createDataFrame(list(every.items()), "doc_id long, text string")).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _statistics(every[r.doc_id]), r.doc_id


def test_quality_verdicts(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    judged, rules = quality_rules.judge_quality(docs, labels)
    assert str(rules).endswith("else: keep")
    rows = judged.join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.35 * len(bad)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in rows)


def test_quality_verdict_matches_brute_force(spark, sf, texts):
    """The verdict of every document from its text alone, by the learned list as it reads."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    judged, rules = quality_rules.judge_quality(docs, labels)
    assert rules.rules
    part = lambda a, b: a / b if b else 0.0

    def rejecting(text):
        n_words, chars, symbols, dup, repeats = _statistics(text)
        lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
        found = lambda pattern: len(re.findall(pattern, text))
        value = {
            "n_words": n_words, "mean_word": part(chars, n_words), "symbols": part(symbols, chars), "dup_lines": part(dup, lines), "repeats": part(repeats, n_words),
            "upper": part(found("[A-Z]"), chars), "digits": part(found("[0-9]"), chars), "marks": part(found("[!?@_=~^;:]"), chars), "long_line": part(n_words, lines),
        }
        return next((k for k, rule in enumerate(rules.rules, 1) if all((value[c.feature] > c.threshold) == c.above for c in rule)), None)

    for r in judged.collect():
        rule = rejecting(texts[r.doc_id])
        assert r.rule == rule and r.kept == (not r.base_failed and rule is None), r.doc_id


def test_quality_rule_is_the_best_of_all(spark):
    """The first condition has the greatest gain of all thresholds; a second one is taken where it helps."""
    rng = random.Random(5)
    rows = [(i, rng.random(), rng.random()) for i in range(600)]
    rows = [(i, x, y, x > 0.5 and y <= 0.4) for i, x, y in rows]
    learned = quality_rules.learn_rules(spark.createDataFrame(rows, "doc_id long, x double, y double, bad boolean"), features=["x", "y"], cuts=32)
    hit = lambda x, y: any(all(({"x": x, "y": y}[c.feature] > c.threshold) == c.above for c in rule) for rule in learned.rules)
    wrong = sum(hit(x, y) != bad for _, x, y, bad in rows)
    assert len(learned.rules[0]) == 2 and wrong <= 0.05 * len(rows)


def test_quality_edges(spark, edge, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    judged, rules = quality_rules.judge_quality(edge, none)
    assert judged.count() == edge.count() and rules.rules == []
    assert all(r.kept != r.base_failed for r in judged.collect())
    assert quality_rules.judge_quality(empty, none)[0].count() == 0


# ---- 7 decontamination ----
def test_tiling_marks_longest_first():
    item, doc = list(range(20)), list(range(10, 20)) + [99] + list(range(10))
    assert sorted(decontaminate.tile(item, doc)) == [(0, 11, 10), (10, 0, 10)]
    doc = list(range(8)) + [50] + list(range(4, 16))
    assert sorted(decontaminate.tile(list(range(16)), doc)) == [(4, 9, 12)]  # 0..3 are too few


def _greedy(item, doc, least=5):
    """Greedy string tiling by definition."""
    a, b, covered = [False] * len(item), [False] * len(doc), 0
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return covered
        for k in range(best[0]):
            a[best[1] + k] = b[best[2] + k] = True
        covered += best[0]


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op qr st uv wx".split())
    items = [(i, [word() for _ in range(rng.randrange(3, 30))]) for i in range(12)]
    rows = []
    for d in range(40):
        own = [word() for _ in range(rng.randrange(40))]
        for _, w in rng.sample(items, 2):
            cut = rng.randrange(len(w))
            parts = [w[:cut], w[cut:]]
            rng.shuffle(parts)
            for p in parts:
                at = rng.randrange(len(own) + 1)
                own[at:at] = p
        rows.append((d, " ".join(x.upper() if rng.random() < 0.1 else x + rng.choice(["", ",", "."]) for x in own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(77, None), (None, "a b c d e f")], "item_id long, text string")
    for limit in (1 << 20, 60):  # by broadcast, by a join
        for r in decontaminate.decontaminate(docs, bench, 0.5, limit).collect():
            own = decontaminate.tokens(dict(rows)[r.doc_id])
            share = {i: _greedy(w, own) / len(w) for i, w in items if len(w) >= 5}
            hit = {i: s for i, s in share.items() if s >= 0.5}
            best = max(hit.values(), default=0.0)
            assert (r.n_items, r.contaminated, r.coverage) == (len(hit), bool(hit), best)
            assert r.item_id == min((i for i, s in hit.items() if s == best), default=None)


def test_tiling_matches_definition_with_repeats():
    """Few different tokens: many equal seeds, ties and overlaps."""
    rng = random.Random(4)
    for n in range(300):
        item, doc = ([rng.randrange(1 + n % 3) for _ in range(rng.randrange(5, 30))] for _ in range(2))
        ids = [np.array([decontaminate.token_ids(f"t{x}")[0] for x in side], np.uint64) for side in (item, doc)]
        tiles = decontaminate.tile(*ids)
        assert sum(t[2] for t in tiles) == _greedy(item, doc) == round(decontaminate.coverage(*ids, 0.0) * len(item))
        assert all(item[i : i + k] == doc[j : j + k] for i, j, k in tiles)
        assert all(len({x for t in tiles for x in range(t[s], t[s] + t[2])}) == sum(t[2] for t in tiles) for s in (0, 1))


def test_tiling_time_is_bounded_by_lengths():
    import time

    started = time.process_time()
    same = " ".join(["aa"] * 20_000)
    assert decontaminate.ItemIndex([(1, same)]).coverages(same + " b " + same, 0.5) == [(1.0, 1)]
    rng = random.Random(3)
    two = " ".join(rng.choice(["aa", "bb"]) for _ in range(20_000))
    assert decontaminate.ItemIndex([(1, two)]).coverages(" ".join(rng.choice(["aa", "bb"]) for _ in range(20_000)), 0.5)[0][0] > 0.9
    assert time.process_time() - started < 20


def test_decontamination_edges(spark, edge, empty):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog")], "item_id long, text string")
    for limit in (1 << 20, 0):  # by broadcast, by a join
        got = decontaminate.decontaminate(edge.withColumn("item_id", F.lit("mine")), bench.union(bench), broadcast_bytes=limit)
        rows = {r.doc_id: r for r in got.collect()}
        assert got.columns[: len(edge.columns)] == edge.columns and got.count() == edge.count()
        assert rows[1].contaminated and rows[3].contaminated and not rows[5].contaminated and not rows[8].contaminated
        assert rows[1].n_items == 1 and rows[1].item_id == 1
        assert decontaminate.decontaminate(empty, bench, broadcast_bytes=limit).count() == 0
        assert not any(r.contaminated for r in decontaminate.decontaminate(edge, bench.limit(0), broadcast_bytes=limit).collect())


@pytest.mark.parametrize("size", [decontaminate.CHUNK, 2])
def test_decontamination_join_equals_broadcast(spark, sf, monkeypatch, size):
    monkeypatch.setattr(decontaminate, "CHUNK", size)
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [sorted(map(tuple, decontaminate.decontaminate(docs.select("doc_id", "text"), bench, broadcast_bytes=n).drop("text").collect())) for n in (1 << 24, 0)]
    assert rows[0] == rows[1] and any(r[-1] for r in rows[0])


# ---- 8 lattice LM ----
def test_lattice_sums_all_segmentations():
    pieces = {"▁": -1.0, "a": -2.0, "b": -2.5, "▁a": -1.5, "ab": -1.2, "▁ab": -3.0}
    lattice = lattice_lm.Lattice(pieces, [-5.0] * 256)

    def brute(text):
        if not text:
            return 1.0
        return sum(math.exp(pieces[text[:k]]) * brute(text[k:]) for k in range(1, len(text) + 1) if text[:k] in pieces)

    for w in ("a", "ab", "abab", "bb"):
        assert lattice.word(w) == pytest.approx(math.log(brute("▁" + w)))
    assert lattice.word("é") == pytest.approx(-1.0 - 10.0)
    assert lattice.word("ab" * 3000) < -1000  # no underflow


def test_lattice_expected_counts_match_all_segmentations():
    pieces = {"▁": -1.0, "a": -2.0, "b": -2.5, "▁a": -1.5, "ab": -1.2, "▁ab": -3.0, "bab": -4.0}
    lattice = lattice_lm.Lattice(pieces, [-5.0] * 256)

    def cuts(text):
        if not text:
            yield ()
        for k in range(1, len(text) + 1):
            if text[:k] in pieces:
                yield from ((text[:k], *rest) for rest in cuts(text[k:]))

    for word in ("a", "ab", "abab", "bbab"):
        want: Counter = Counter()
        every = [(math.exp(sum(pieces[p] for p in c)), c) for c in cuts("▁" + word)]
        for weight, cut in every:
            for piece in cut:
                want[piece] += 3 * weight / sum(w for w, _ in every)
        got: defaultdict = defaultdict(float)
        lattice.add_expected(word, 3, got)
        assert {k: v for k, v in got.items() if v > 1e-12} == pytest.approx(dict(want))
    got = defaultdict(float)
    lattice.add_expected("é", 2, got)
    assert dict(got) == pytest.approx({"▁": 2, "<0xC3>": 2, "<0xA9>": 2})
    lattice.add_expected("ab" * 50_000, 1, got)
    assert sum(len(k) * v for k, v in got.items() if "<" not in k) == pytest.approx(100_001 + 2)


def test_lattice_rounds_raise_the_likelihood(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    total = [lattice_lm.score_documents(docs, PIECES, rounds=n).groupBy("held_out").agg(F.sum("score").alias("s")).collect() for n in (0, 1, 2)]
    by_fold = {out: [next(r.s for r in rows if r.held_out == out) for rows in total] for out in (True, False)}
    assert by_fold[False] == sorted(by_fold[False]) and by_fold[True][0] < by_fold[True][1]


def test_lattice_scores(spark, sf, texts):
    got = llm.QUERIES["op8_lattice_lm"](spark, sf).collect()
    tokens = {d: t.encode().lower().split() + [b"\n"] for d, t in texts.items()}
    out = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    c = Counter(w for d, ws in tokens.items() if not out(d) for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(texts)
    for r in got:
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc_id), len(own), sum(c[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
        assert r.score < 0
    few = lattice_lm.score_documents(spark.read.parquet(f"{sf}/documents.parquet"), PIECES, frequent=50).collect()
    assert {r.doc_id: r.score for r in few} == pytest.approx({r.doc_id: r.score for r in got})  # the joined words score alike


def test_lattice_edges(edge, empty):
    got = lattice_lm.score_documents(edge, PIECES, frequent=3).collect()
    assert len(got) == edge.count()
    assert all(r.n_tokens == 1 and r.score < 0 for r in got if r.doc_id in (5, 6, 7))
    assert len({r.score for r in got if r.doc_id == 2}) == 1
    assert lattice_lm.score_documents(empty, PIECES).count() == 0


# ---- 9 packing ----
def _ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE).encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 4095, 4096, 4097, 12345])
def test_pieces(n):
    parts = packing.pieces_of(n, 4096)
    assert sum(k for _, k in parts) == n and all(k & (k - 1) == 0 and k <= 4096 for _, k in parts)
    assert [s for s, _ in parts] == list(np.cumsum([0, *[k for _, k in parts]])[:-1]) if n else parts == []


def test_chunk_encoder_is_exact():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    odd = ["a<|endoftext|>b", "x <|startoftext|> y", "É́ é Σας ΟΔΟΣ", "  a b\x1cx", "don't I'll 3.5'm", "", "ﬁn Ǆ İ", "a\rb\tc\x0bd e　f", "日本語 한국어 مرحبا", "😀😀 a‍b", "\U0010fffd x", "soft­hyphen ²³ ª", "x" * 5000, "</w> < w>"]
    encode = packing.ChunkEncoder(BPE)
    for text in odd + odd[::-1]:
        assert encode([text])[0] == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_packing_round_trip(spark, sf, texts):
    got = packing.pack_power_of_two(spark.read.parquet(f"{sf}/documents.parquet"), BPE).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and len(r.ids) == r.length == r.bucket for r in got)
    own = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(own[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        own[r.doc_id] += r.ids
    for d, t in texts.items():
        assert own[d] == _ids(t)
    assert all(r.doc_tokens == len(own[r.doc_id]) for r in got)


def test_packing_edges(edge, empty):
    got = packing.pack_power_of_two(edge, BPE, with_ids=False).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    assert [(r.start, r.length, r.doc_tokens) for r in got if r.doc_id == 5] == [(0, 1, 1)]
    assert sum(r.length for r in got if r.doc_id == 2) == 2 * sum(r.length for r in got if r.doc_id == 1)
    assert packing.pack_power_of_two(empty, BPE).count() == 0
    with pytest.raises(ValueError):
        packing.pack_power_of_two(edge, BPE, longest=1000)


# ---- 10 HTML ----
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><nav><ul><li><a href="/">Home</a></ul></nav>
<header><h2>Site</h2></header><div class="cookie-notice"><div>Accept</div></div><aside>Side</aside><!-- <p>no</p> --><div class="ad">Buy</div><article><h1>Head&nbsp;line &amp; more</h1><p>One <b>two</b>
three<p class="ad">Ad inside<p>Four &lt;x&gt;<br>five<form><input name=a><p>Mail</form><ul><li>six<li>seven</ul><div id="comments"><p>Nice!</div><p>eight</article><section class="comments"><article class="comment">Hi</article></section><footer>&copy;</footer></body></html>"""


def test_html_zones():
    zone, lines = html_extract._content(html_extract.blocks_of(PAGE))
    assert zone == html_extract.ARTICLE and lines == ["Head line & more", "One two three", "Four <x> five", "six", "seven", "eight"]
    zoned = lambda page: [(b.zone, b.text) for b in html_extract.blocks_of(page)]
    assert zoned("") == [] and zoned("<p>a<p>b") == [(0, "a"), (0, "b")]
    assert html_extract._content(html_extract.blocks_of("<div>menu</div><main><p>text</main>")) == (html_extract.MAIN, ["text"])
    assert zoned("<article><p>open <b>never closed") == [(2, "open never closed")]


def test_html_zone_of_most_text():
    content = lambda page: html_extract._content(html_extract.blocks_of(page))[1]
    body = "<p>The long true body of the page.</p><p>It has a second paragraph, too.</p>"
    lines = ["The long true body of the page.", "It has a second paragraph, too."]
    assert content(f'<main>{body}</main><section><article class="card"><h3>Read on</h3></article></section>') == lines
    assert content(f'<div>{body}</div><article class="card"><h3>Read on</h3></article>') == lines
    assert content(f"<main><h2>Crumb</h2><article>{body}</article></main>") == lines
    assert content(f"<main><article>{body}</article><article>{body}</article><article>{body}</article></main>") == lines * 3  # a list is main
    assert content(f"<article>{body}</article><article><h3>Teaser</h3></article>") == lines
    assert content(f'<div><a href="/">{"many links " * 50}</a></div><article>{body}</article>') == lines
    assert content("<main></main><article>x</article>") == ["x"] and content("") == []


def test_html_article_loses_no_words():
    content = lambda inner: html_extract._content(html_extract.blocks_of(f"<article><p>Begin</p>{inner}<p>End</p></article>"))[1][1:-1]
    assert content("<p>Let <math><mi>x</mi></math> be</p>") == ["Let x be"]
    assert content("<p>a <object>b</object> <label>c</label> <canvas>d</canvas> <video>e</video></p><fieldset>f</fieldset><dialog>g</dialog>") == ["a b c d e", "f", "g"]
    assert content('<p class="related">Work that belongs here, with <a href="/x">a link</a>.</p>') == ["Work that belongs here, with a link."]
    assert content('<div class="related"><a href="/1">One</a> <a href="/2">Two</a></div><div class="notice">Mind the step.</div>') == ["Mind the step."]
    assert content("<form><label>Mail</label><input></form>") == [] and content('<div class="advert">Buy</div><div id="comments">Nice</div>') == []


def _lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_shared_lines_is_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        at = html_extract.shared_lines(a, b)
        common = [a[i] for i in sorted(at)]
        rest = iter(b)
        assert len(at) == _lcs(a, b) and all(x in rest for x in common)


def test_html_differencing(spark):
    page = lambda i, own: f"<div>Menu</div><div>Home</div><p>{own}</p><div>Imprint</div>"
    rows = [(i, f"https://h.example/news/{i:05d}?x={i}", page(i, f"Own text {i}")) for i in range(2500)] + [(9001, "http://alone.example/a", page(0, "Single")), (9002, None, None), (9003, "http://h.example/z", PAGE)]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()}
    assert len(got) == len(rows) and all(got[i] == f"Own text {i}" for i in range(2500))
    assert got[9001] == "Menu\nHome\nSingle\nImprint" and got[9002] == "" and got[9003].startswith("Head line")


def test_html_query(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in llm.QUERIES["op10_html_extract"](spark, sf).collect():
        inner = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        import html

        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_html_missing_end_tags():
    lines = lambda page: [b.text for b in html_extract.blocks_of(page)]
    assert lines('<article><h1>T</h1><p class="ad">Buy<p>Real one<p>Real two</article>') == ["T", "Real one", "Real two"]
    assert lines('<article><ul><li class="ad">Buy<li>one</ul>two</article>three') == ["one", "two", "three"]
    assert lines('<div><div class="sponsor"><p>x<b>y</div>kept</div><table><tr><td class="ad">a<td>b<tr><td>c</table>end') == ["kept", "b", "c", "end"]
    assert lines('<head><title>T</title><p>body text</p>') == ["body text"] and lines("<select><option>a<option>b</select>c") == ["c"]
    assert lines('<span class="ad">x<span>y</span>z</span>w <i>v</i>') == ["w v"]
    assert lines('<div class="related-work">a</div><div class="related-posts">b</div><p id="notice-period">c</p><div class="siteFooter">d</div>') == ["a", "c"]
    assert lines("1 < 2 <3 & a </> b <p title='>'>q</p> <unclosed x=") == ["1 < 2 <3 & a b", "q"]
    assert lines("a<!-- > <p>b -->c<? x ?>d<script>'<p>'</script>e<style>never ends <p>f") == ["acde"]


@pytest.mark.parametrize("part", ["<a ", '<a b="', "</", "<!--", "<b class=ad><i class=ad>", "<div>", "<p><li><td>", "<", "</section><section>", "&#"])
def test_html_broken_markup_takes_linear_time(part):
    import time

    def took(size):
        html_extract.blocks_of("<p>x")
        started = time.process_time()
        html_extract.blocks_of(part * (size // len(part)))
        return time.process_time() - started

    small, large = min(took(100_000) for _ in range(2)), took(800_000)
    assert large < 20 * small + 0.5  # eight times as long; quadratic would be 64 times


def test_html_main_keeps_what_stands_between_its_own_lines(spark):
    page = lambda own: f"<p>Out</p><main><p>Crumbs</p><p>{own} a</p><p>Shared inside</p><p>{own} b</p><p>Tell friends</p></main>"
    rows = [(1, "http://h/a/1", page("one")), (2, "http://h/a/2", page("two")), (3, "http://g/1", page("x")), (4, "http://g/2", page("x"))]
    got = {r.page_id: r.text.split("\n") for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ["one a", "Shared inside", "one b"] and got[2] == ["two a", "Shared inside", "two b"]
    assert got[3] == got[4] == ["Crumbs", "x a", "Shared inside", "x b", "Tell friends"]  # copies tell nothing apart


def test_html_articles_are_differenced(spark):
    """Lines at an article's ends go where most pages of the host share them with another article; nothing else does."""

    def page(i, first="By our staff", last="Tell your friends"):
        return f"<p>Out</p><article><p>{first}</p><h2>Weekly</h2><p>Own text {i}, long enough to outweigh what the pages share.</p><p>Shared inside</p><p>More of {i}</p><p>{last}</p><p>Follow us</p></article>"

    body = lambda i: ["Weekly", f"Own text {i}, long enough to outweigh what the pages share.", "Shared inside", f"More of {i}"]
    many = [(i, f"http://many.example/{i:03d}", page(i)) for i in range(40)]
    few = [(100 + i, f"http://few.example/{i:03d}", page(i)) for i in range(9)]
    some = [(200 + i, f"http://some.example/{i:03d}", page(i, *(["By our staff"] if 10 <= i < 22 else [f"By {i}"]), last=f"Bye {i}")) for i in range(40)]
    copies = [(300 + i, f"http://copies.example/{i:03d}", page(7)) for i in range(40)]
    copy = [(400, "http://many.example/039?print", page(39))]
    sole = [(500, "http://many.example/zzz", "<article><p>By our staff</p><p>Follow us</p></article>")]
    rows = many + few + some + copies + copy + sole
    got = {r.page_id: r.text.split("\n") for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    ends = lambda i: ["By our staff", *body(i), "Tell your friends", "Follow us"]
    assert all(got[i] == body(i) for i in range(40)) and got[400] == body(39)
    assert all(got[100 + i] == ends(i) for i in range(9))  # too few pages to tell
    assert all(got[200 + i] == [f"By {i}" if not 10 <= i < 22 else "By our staff", *body(i), f"Bye {i}"] for i in range(40))  # not most pages
    assert all(got[300 + i] == ends(7) for i in range(40))  # copies are no other articles
    assert got[500] == ["By our staff", "Follow us"]


def test_shared_lines_that_repeat_take_no_quadratic_time():
    import time

    rng = random.Random(3)
    a, b = ([rng.randrange(2) for _ in range(1500)] for _ in range(2))
    assert len(html_extract.shared_lines(a, b)) == _lcs(a, b)
    a, b = ([rng.randrange(2) for _ in range(20_000)] for _ in range(2))
    started = time.process_time()
    at = html_extract.shared_lines(a, b)
    rest = iter(b)
    assert all(a[i] in rest for i in sorted(at)) and time.process_time() - started < 20  # pair by pair: minutes


def test_html_edges(spark):
    layout = "page_id long, url string, html string, text int, n_chars string, near string, zone string, lines int, host int, path int, part int, run int, own int, at int"
    long = "<article><p>" + "<p>".join(f"paragraph {i} &amp; more" for i in range(60_000)) + "</article>"
    rows = [(1, "http://a/x", long), (1, "http://a/x", long), (None, None, None), (2, None, ""), (3, "::bad::", "<article>é😀</article>"), (4, "http://a/x", "<p>plain</p>"), (4, "http://a/x", "<p>plain</p>")]
    frame = spark.createDataFrame([(*r, 1, "n", "x", "z", 1, 1, 1, 1, 1, 1, 1) for r in rows], layout).repartition(3)
    out = html_extract.extract_main_text(frame)
    got = out.collect()
    assert out.columns == ["page_id", "url", "text", "n_chars"] and len(got) == len(rows)
    assert [r.text.count("\n") for r in got if r.page_id == 1] == [59_999] * 2 and {r.text for r in got if r.page_id in (None, 2)} == {""}
    assert [(r.text, r.n_chars) for r in got if r.page_id == 3] == [("é😀", 2)] and [r.text for r in got if r.page_id == 4] == ["plain"] * 2
    assert html_extract.extract_main_text(frame.limit(0)).count() == 0


# ---- pipeline ----
def test_pipeline_stages(spark, sf, texts):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    now = docs
    for (name, stage), n in zip(corpus_pipeline.STAGES[:-1], (3, 5, 1, 7)):
        after = stage(spark, now, sf)
        assert after.columns == columns, name
        rows, old = after.collect(), {r.doc_id: r for r in now.collect()}
        left = {r.doc_id: r for r in rows}
        assert len(left) == len(rows) <= len(old)
        if n == 3:
            assert len(left) >= 0.94 * len(old)
        if n == 5:
            want = dict(_lines([(d, r.text) for d, r in sorted(old.items())], 10, True))
            assert {d: r.text for d, r in left.items()} == {d: t for d, t in want.items() if t.strip(" ") or t == (old[d].text or "")}
            assert all(r.n_chars == len(r.text) for d, r in left.items() if r.text != old[d].text)
        if n == 1:
            tops = _components({d: _shingles(r.text, 5) for d, r in sorted(old.items())})
            assert set(left) == {d for d, top in tops.items() if d == top}
        if n == 7:
            items = [(r.item_id, decontaminate.tokens(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            joined = {d: " ".join(decontaminate.tokens(r.text)) for d, r in old.items()}
            whole = {d for d, t in joined.items() if any(len(w) >= 5 and f" {' '.join(w)} " in f" {t} " for _, w in items)}
            assert not whole & set(left)
        spark.createDataFrame(rows, docs.schema).write.mode("overwrite").parquet(f"{sf_out(spark)}/{name}")
        now = spark.read.parquet(f"{sf_out(spark)}/{name}")
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    assert Counter({d: n for d, n in Counter(x for r in packed for x in [r.doc_id] * r.length).items()}) == Counter({r.doc_id: len(_ids(r.text)) for r in now.collect()})


def sf_out(spark):
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") + "/stages"


def test_pipeline_run_and_edges(spark, sf, edge, empty):
    assert corpus_pipeline.run(spark, sf).count() > 0
    only = edge.select(corpus_pipeline.COLUMNS)
    for docs in (only, only.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, sf).count() <= max(docs.count() * 20, 0), name
    assert F is not None
