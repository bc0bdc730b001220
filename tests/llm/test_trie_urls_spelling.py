"""Conversation trie, URL filters and spelling variants against brute force and on edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from barloom import llm
from barloom.llm import prefix_trie, spelling, url_filters
from tests.llm.conftest import LOWER, WORD


# ---- 11 prefix trie ----
def _trie(rows):
    """rows (conv_id, turn, role, text) -> {prefix: expected columns}."""
    of = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            of[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in of.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(turns.get(c - math.fmod(c, 20), [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, own in built.items():
        for d in range(len(own) + 1):
            members[own[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    own = {p: (len(m) - 1) * (len(WORD.findall(p[-1][1])) if p else 0) for p, m in members.items()}
    saved, leaves = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            saved[p[:d]] += own[p]
            leaves[p[:d]] += not children[p]
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p)))).encode()).hexdigest()
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], ends(p)) for p, m in members.items())


def _trie_rows(df):
    return Counter(tuple(r)[:8] for r in df.collect())


def test_trie_query_matches_brute_force_and_sql(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = _trie_rows(llm.QUERIES["op11_prefix_trie"](spark, sf))
    assert got == _trie([tuple(r) for r in rows])
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert got == Counter(con.sql(llm.ORACLE_SQL["op11_prefix_trie"]).fetchall())


def test_trie_of_copies_long_and_odd_conversations(spark, monkeypatch):
    rows = [(c, t, "user", f"turn {t} of all") for c in range(0, 300, 3) for t in range(5)]  # copies
    rows += [(41, t, "user", f"w {t % 7}") for t in range(300)] + [(61, t, "user", f"w {t % 7}") for t in range(200)]  # long ones, one the start of the other but for their heads
    rows += [(-20, None, None, None), (-20, 0, "a", "b c"), (-23, 3, "a", "b c"), (-23, 1, None, "x"), (None, 0, "user", "lost"), (500, 0, "u", ""), (501, 0, "u", ""), (502, 0, "", "u")]
    rows += [(7_000_000_000, 5, "user", "same"), (7_000_000_000, 5, "user", "same")]
    frame = spark.createDataFrame([(*r, 1, 2, "p", 3) for r in rows], "conv_id long, turn long, role string, text string, depth int, a int, part string, n_convs int")
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 3)
    monkeypatch.setattr(prefix_trie, "MANY", 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert _trie_rows(prefix_trie.prefix_trie(frame.repartition(4))) == _trie(rows)  # the long conversations lie in several parts
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert prefix_trie.prefix_trie(frame.limit(0)).count() == 0


# ---- 12 URL filters ----
def _host_path(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate(LOWER), m[2]) if m else ("", "")


def _rule(host, path):
    fits = [r for r, _ in url_filters.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


def _templates(shapes, share, least, z, strength):
    """shapes {(host, segments): [n, labelled, good]} -> {(host, segments): (template, purity)}."""
    total = [sum(v[i] for v in shapes.values()) for i in range(3)]
    base, out = (total[2] / total[1] if total[1] else 1.0), {}

    def grow(host_n, own, level, prefix, purity):
        names = defaultdict(lambda: [0, 0, 0])
        add = lambda to, v: to.__setitem__(slice(None), [a + b for a, b in zip(to, v)])
        deeper = {k: v for k, v in own.items() if len(k[1]) > level}
        out.update({k: (prefix, purity) for k in own if k not in deeper})
        for (_, s), v in deeper.items():
            add(names[s[level]], v)
        kept = {n for n, v in names.items() if v[0] >= max(least, math.ceil(host_n * share))}
        children = defaultdict(lambda: [0, 0, 0])
        for n, v in names.items():
            add(children[n if n in kept else "*"], v)
        smooth = lambda v: (v[2] + strength * purity) / (v[1] + strength)
        done = []
        for n, v in sorted(children.items(), key=lambda x: (smooth(x[1]), x[0])):
            last = done[-1][1] if done else None
            apart = False
            if last and last[1] and v[1]:
                pooled = (last[2] + v[2]) / (last[1] + v[1])
                apart = abs(last[2] / last[1] - v[2] / v[1]) > z * math.sqrt(pooled * (1 - pooled) * (1 / last[1] + 1 / v[1]))
            if last is None or apart:
                done.append(([n], list(v)))
            else:
                done[-1][0].append(n)
                add(last, v)
        for ns, v in done:
            label = ns[0] if len(ns) == 1 else "{" + "|".join(sorted(ns)) + "}"
            mine = {k: w for k, w in deeper.items() if (k[1][level] if k[1][level] in children and k[1][level] in kept else "*") in ns}
            grow(host_n, mine, level + 1, f"{prefix}/{label}", smooth(v))

    for host in {h for h, _ in shapes}:
        own = {k: v for k, v in shapes.items() if k[0] == host}
        n, lab, good = (sum(v[i] for v in own.values()) for i in range(3))
        grow(n, own, 0, "", (good + strength * base) / (lab + strength))
    return out


def test_url_filters_match_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    labels = {r.doc_id: r.quality == 1 and r.toxic != 1 for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    shapes, of = defaultdict(lambda: [0, 0, 0]), {}
    for r in pages:
        host, path = _host_path(r.url)
        segments = tuple(re.sub("[0-9]+", "<n>", path).split("/")[1:])
        of[r.page_id] = host, path, segments
        found = re.search(r"/([0-9]+)(?:[/.]|$)", path)
        label = labels.get(int(found[1])) if found else None
        shapes[host, segments] = [a + b for a, b in zip(shapes[host, segments], (1, label is not None, bool(label)))]
    want = _templates(shapes, 0.02, 20, 1.96, 10.0)
    got = llm.QUERIES["op12_url_filters"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path, segments = of[r.page_id]
        template, purity = want[host, segments]
        rule = _rule(host, path)
        verdict = dict(url_filters.RULES)[rule] if rule else "block" if purity < 0.6 else "allow"
        assert (r.host, r.path, r.rule, r.verdict, r.template) == (host, path, rule, verdict, template) and abs(r.purity - purity) < 1e-9


def test_url_templates_keep_names_merge_and_reject(spark):
    rows, labels = [], []
    for i in range(2400):
        kind = ("spam", "news", "blog")[i % 3]
        rows.append((i, f"http://Big.org/{kind}/story-{'abcdefgh'[i % 8]}{chr(97 + i % 26)}{i}x{i * 7919 % 997}/view?q={i}"))
        if i % 2:
            labels.append((i, kind != "spam" or i % 10 == 1))
    got = {r.page_id: r for r in url_filters.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good boolean")).collect()}
    assert got[0].template.startswith("/spam/") and got[0].template.endswith("/view") and got[0].verdict == "block" and got[0].purity < 0.3
    assert got[1].template.startswith("/{blog|news}/") and got[1].verdict == got[2].verdict == "allow" and got[1].host == "big.org"
    assert len({r.template for r in got.values()}) <= 6  # thousands of names are wildcards


URLS = [
    (1, None), (2, ""), (3, "no scheme/en/1"), (4, "http://EXAMPLE.net/en/1"), (5, "http://sub.example.net/en"), (6, "http://sub.example.net/fr/?a://b/c"), (7, "https://badexample.com/de/1"), (8, "https://a.example.com/de/1"),
    (9, "http://x.org/fr/2"), (10, "http://x.org"), (11, "http://x.org?p=/fr/"), (12, "http://x.net#/"), (13, "://"), (14, "http://é.ÄB.net/é"), (15, "a\nb://c\nd/e\nf?g"), (16, "http://long.org/" + "a/" * 20_000), (None, "http://x.org/fr/"),
    (9, "http://x.org/fr/2"), (17, "http://u:p@h.net:80/x#y"), (18, "http://h.io/0123456789abcdef/deadbeef12/x.html"),
]


def test_url_filters_edges(spark):
    layout = "page_id long, url string, host int, path int, segments string, n int, name int, template int, good int, purity string"
    frame = spark.createDataFrame([(*r, 1, 2, "s", 3, 4, 5, 6, "p") for r in URLS], layout).repartition(3)
    labels = spark.createDataFrame([(4, True), (4, None), (None, False), (99, False), (4, False)], "page_id long, good boolean")
    out = url_filters.filter_urls(frame, labels, depth=3)
    got = out.collect()
    assert out.columns == ["page_id", "host", "path", "rule", "verdict", "template", "purity"] and len(got) == len(URLS)
    want = Counter((i, *_host_path(u), _rule(*_host_path(u))) for i, u in URLS)
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == want
    by = {r.page_id: r for r in got}
    assert [by[i].rule for i in (4, 5, 6, 7, 8, 10, 12, 17)] == ["example.net/en/", "net/", "net/", None, "example.com/de/", None, None, None]
    assert by[6].verdict == "block" and by[4].verdict == "allow" and by[16].template == "/*/*/*/*" and by[1].template == by[3].template == ""
    assert url_filters.filter_urls(frame.limit(0), labels).count() == 0 and {r.verdict for r in url_filters.filter_urls(frame, labels.limit(0), rules=()).collect()} == {"allow"}
    shapes = frame.select(url_filters.shape_of(url_filters.host_and_path(F.col("url"))[1], 6).alias("s"), "page_id").where("page_id = 18").first()
    assert shapes.s == ["<x>", "<x>", "x.html"]


# ---- 13 spelling ----
def _words(texts):
    n = Counter()
    for i, text in texts:
        for run, k in Counter(x.translate(LOWER) for x in re.findall(r"[A-Za-z\u00C0-\u00FF]+", text or "")).items():
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += k
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def _variants(words):
    near = {w: set() for w in words}
    holes = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + "\0" + w[i + 1 :]].add(w)
            cut = w[:i] + w[i + 1 :]
            if cut in words:
                near[w].add(cut)
                near[cut].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def test_spelling_query_matches_brute_force_and_sql(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in llm.QUERIES["op13_spelling_variants"](spark, sf).collect()}
    assert got == _variants(_words(rows)) and any(r[1] for r in got)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got == set(con.sql(llm.ORACLE_SQL["op13_spelling_variants"]).fetchall())


def test_spelling_edges_and_chains(spark, edge, empty):
    words = {"colour": 4000, "color": 0, "colours": 700, "colourz": 100, "colouurz": 20, "couluurz": 5, "élévée": 30, "élevée": 6, "elevee": 5, "ÉLÉVÉE": 5, "abcabc": 9, "bacabc": 9, "abcabcd": 9, "Zebras×÷": 6, "short": 50, "zzzzzz": 25, "zzzzzzz": 5, "aaaaaaa": 25, "aaaaaab": 25, "aaaaaac": 5}
    docs = [(i, f"{w}." * 5) for w, k in words.items() for i in range(k // 5)] + [(None, "colour " * 3), (77, None), (78, "")]
    frame = spark.createDataFrame([(*d, 1, 2, "w", 4, 5) for d in docs], "doc_id long, text string, word int, n int, run string, id int, mask int")
    got = {tuple(r) for r in spelling.group_variants(frame).collect()}
    assert got == _variants(_words(docs))
    by = {r[0]: r for r in got}
    assert by["colouurz"][1:3] == ("colourz", "colour") and by["zzzzzzz"][1] == "zzzzzz" and by["aaaaaac"][1] == "aaaaaaa"
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    assert spelling.group_variants(edge, least_letters=4, least_count=1).where("length(word) = 50000").count() == 1 and spelling.group_variants(empty).count() == 0
    assert {tuple(r) for r in spelling.group_variants(edge).collect()} == _variants(_words(rows))


@pytest.mark.parametrize("size", [6, 7, 12])
def test_spelling_finds_every_edit(spark, size):
    word = "abcdefghijklmnop"[:size]
    edits = {word[:i] + c + word[i:] for i in range(size + 1) for c in "aqé"} | {word[:i] + word[i + 1 :] for i in range(size)} | {word[:i] + c + word[i + 1 :] for i in range(size) for c in "bzÿ"}
    edits -= {word}
    pairs = spelling.near_words(spark.createDataFrame([(w,) for w in sorted(edits | {word})], "word string")).collect()
    assert {r.b for r in pairs if r.a == word} == edits and len(pairs) == len(set(pairs))
