"""Main text of web pages by nearest-URL page differencing, checked against the markup.

Every page is paired with the page of its host whose URL path is nearest, the text lines of both are aligned by longest
common subsequence, and shared lines are deleted as boilerplate. Differencing alone is wrong in two ways: menus and
notices that differ from page to page stay, and article lines that two pages share go. So the parts that the markup
itself names (menus, forms, adverts, comments, ...) are cut first, and a check by the element that holds the page's text
follows. On a page without an article or main element all shared lines go. In a main element those go that stand before
the first or after the last line of the page's own. In an article element such a line goes if it is no heading and the
pages of the host confirm it: most of those that were compared with a page of another article share it.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import by_batch, join_few, join_hot, likely_in, materialize, settle, table

#: A tag from its "<" on. Quotes count only behind "="; possessive, so that a tag is read once.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_LETTER = re.compile("[a-zA-Z]")
_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
_ATTRIBUTE = re.compile(r"([a-zA-Z:-]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?+")
#: Elements whose content is no markup.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>?", re.I) for t in "script style textarea title iframe noembed noframes xmp".split()}
_CUT = set("nav header footer aside form button select datalist menu head noscript template svg annotation annotation-xml".split())
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
_CELL = {"td", "th"}
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements beyond which an end tag closes nothing, and those that end the reach of a list's items.
_SCOPE = ("html", "table", "caption", "td", "th", "template", "object", "button")
_LISTS = ("ul", "ol", "menu", "dir", "dl", *_SCOPE)
#: Which open elements a start tag ends, though their end tags may be missing, and what bounds its reach.
_ENDS = {
    "li": (("li",), _LISTS), "dd": (("dd", "dt"), _LISTS), "dt": (("dd", "dt"), _LISTS), "option": (("option",), ("select",)), "optgroup": (("optgroup", "option"), ("select",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), **{t: (("thead", "tbody", "tfoot"), ("table",)) for t in ("thead", "tbody", "tfoot")}, "body": (("head",), ()),
}
_IN_HEAD = set("base link meta noscript script style template title".split())
#: Names of classes and ids that tell what an element is for; those that inside an article need a second sign, as they may
#: be its own; and words that say no more about it.
_PLAIN = set("ad ads advert advertisement adverts adsense adsbygoogle sponsor sponsored nav navbar breadcrumb breadcrumbs sidebar footer masthead cookie cookies gdpr newsletter comment comments disqus pagination pager".split())
_UNSURE = set("banner promo promotion navigation menu consent notice popup modal overlay subscribe subscription signup respond replies share sharing social related recommended recommendations widget skip toolbar copyright".split())
_NAMES = _PLAIN | _UNSURE
_NEUTRAL = set("area articles bar block bottom box button buttons container content form global group header icons inner item items left link links list main media messages module outer page panel posts primary right row secondary section site slot stories teaser text top unit wrap wrapper".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar alert".split())
_PARTS = re.compile(r"[_-]+|\d+|(?<=[a-z])(?=[A-Z])")
ARTICLE, MAIN, OPEN = 2, 1, 0


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}


def _named(token: str, names: set[str]) -> bool:
    """A class or id that names boilerplate: every part is such a name or neutral, so "related-posts" but not "related-work"."""
    parts = {p.lower() for p in _PARTS.split(token) if p}
    return bool(parts & names) and parts <= _NAMES | _NEUTRAL


KEEP, UNSURE, CUT = 0, 1, 2


def _standing(tag: str, attributes: dict[str, str], in_zone: bool) -> int:
    """Whether an element is cut. In an article or main element a name that may be the text's own makes it unsure: it goes
    if most of its text is links."""
    if tag in ("html", "body"):
        return KEEP
    if tag in _CUT and not (tag == "header" and in_zone) or tag == "dialog" and not in_zone:
        return CUT
    if not attributes:
        return KEEP
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return CUT
    tokens = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    if attributes.get("role", "").lower() in _ROLES or any(_named(t, _PLAIN if in_zone else _NAMES) for t in tokens):
        return CUT
    return UNSURE if in_zone and any(_named(t, _UNSURE) for t in tokens) else KEEP


class Block(NamedTuple):
    """A block's zone (OPEN, or bits of MAIN and ARTICLE), the number of its outermost article (0: none), its text, how
    many characters of it stand in links, and whether it is a heading."""

    zone: int
    article: int
    text: str
    linked: int
    heading: bool


class _Page:
    """The open elements of a page that is read from front to back. Inline elements are kept only where they cut or
    make a zone; every look-up is of an element's last place, so deep or broken markup costs no more than its length."""

    def __init__(self) -> None:
        self.out: list[Block] = []
        self.parts: list[str] = []
        self.open: list[tuple[str, int, int, int]] = []  # tag, standing, zone, blocks before it
        self.places: dict[str, list[int]] = defaultdict(list)
        self.cuts, self.zones, self.articles = 0, {ARTICLE: 0, MAIN: 0, OPEN: 0}, 0
        self.in_link, self.linked = False, 0

    def text(self, text: str) -> None:
        if not self.cuts and text:
            text = html.unescape(text) if "&" in text else text
            self.parts.append(text)
            if self.in_link:
                self.linked += len(text)

    def end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts.clear()
            if text:
                inside = self.zones[ARTICLE] > 0
                self.out.append(Block(ARTICLE * inside | MAIN * (self.zones[MAIN] > 0), self.articles if inside else 0, text, min(self.linked, len(text)), any(self.places.get(t) for t in _HEADINGS)))
        self.linked = 0

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def close_from(self, place: int) -> None:
        self.end_block()
        while len(self.open) > place:
            tag, standing, zone, before = self.open.pop()
            self.places[tag].pop()
            self.cuts -= standing == CUT
            self.zones[zone] -= 1
            if standing == UNSURE and 2 * sum(b.linked for b in self.out[before:]) >= sum(len(b.text) for b in self.out[before:]):
                del self.out[before:]

    def start(self, tag: str, raw: str) -> None:
        if tag == "a":
            self.in_link = True
        if tag == "br" or tag in _CELL:
            self.text(" ")
        elif tag in _BLOCK:
            self.end_block()
        if self.places["head"] and tag not in _IN_HEAD and tag != "head":
            self.close_from(self.last(["head"]))
        if tag in _BLOCK and self.last(["p"]) > self.last(_SCOPE):
            self.close_from(self.last(["p"]))
        ends, within = _ENDS.get(tag, ((), ()))
        if ends and (place := min((p[-1] for t in ends if (p := self.places.get(t)) and p[-1] > self.last(within)), default=None)) is not None:
            self.close_from(place)
        if tag in _VOID or _CLOSED.search(raw[-2:]):
            return
        attributes = _attributes(raw)
        standing = _standing(tag, attributes, bool(self.zones[ARTICLE] or self.zones[MAIN]))
        standing = KEEP if standing == UNSURE and tag not in _BLOCK else standing
        zone = ARTICLE if tag == "article" or attributes.get("itemprop") == "articleBody" else MAIN if tag == "main" or attributes.get("role") == "main" else OPEN
        if tag not in _BLOCK and tag not in _CELL and not standing and not zone and not self.places.get(tag):
            return
        if standing or zone:
            self.end_block()
        self.articles += zone == ARTICLE and not self.zones[ARTICLE] and not self.cuts
        self.places[tag].append(len(self.open))
        self.open.append((tag, standing, zone, len(self.out)))
        self.cuts += standing == CUT
        self.zones[zone] += 1

    def end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        if tag in _BLOCK:
            self.end_block()
        place = self.last([tag])
        if tag in _BLOCK or tag in _CELL or tag in _CUT:
            within = ("template",) if tag in ("table", "html", "body") else ("table",) if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else _LISTS if tag in ("li", "dd", "dt") else _SCOPE
            reached = place > self.last([t for t in within if t != tag])
        else:  # an inline end tag reaches through a paragraph, not through other blocks
            reached = place >= 0 and all(t == "p" or t not in _BLOCK and t not in _CELL for t, *_ in self.open[place + 1 : place + 9]) and len(self.open) - place <= 9
        if place >= 0 and reached:
            self.close_from(place)


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, without the parts that the markup names as no content. End tags may
    be missing where HTML lets them be; the end of an element ends all that is still open inside it. A "<" that begins
    no tag is text; a tag, comment or script that never ends takes the rest of the page, as in a browser."""
    state, at, size = _Page(), 0, len(page)
    while at < size:
        opened = page.find("<", at)
        if opened < 0:
            state.text(page[at:])
            break
        state.text(page[at:opened])
        at = opened
        after = page[opened + 1 : opened + 2]
        if page.startswith("<!--", opened):
            close = page.find("-->", opened + 4)
            at = size if close < 0 else close + 3
        elif after in ("!", "?") or after == "/" and not _LETTER.match(page, opened + 2):
            close = page.find(">", opened)
            at = size if close < 0 else close + 1
        elif after != "/" and not _LETTER.match(after):
            state.text("<")
            at = opened + 1
        elif m := _TAG.match(page, opened):
            at, tag = m.end(), m[2].lower()
            if m[1]:
                state.end(tag)
            elif tag in _RAW and not _CLOSED.search(m[3][-2:]):
                close = _RAW[tag].search(page, at)
                at = close.end() if close else size
            else:
                state.start(tag, m[3])
        else:
            at = size
    state.close_from(0)
    return state.out


#: Pairs of equal lines, for each line of both pages, up to which they are walked one by one.
PAIRS = 16
#: Places from which the bits of a line are kept.
OFTEN = 256


def shared_lines(mine: list[int], other: list[int]) -> set[int]:
    """Places in mine of a longest common subsequence with other: Hunt-Szymanski between what both begin and end with.
    Where lines repeat so often that this would be slow, mine is halved (Hirschberg)."""
    low, most = 0, min(len(mine), len(other))
    while low < most and mine[low] == other[low]:
        low += 1
    high = 0
    while high < most - low and mine[-1 - high] == other[-1 - high]:
        high += 1
    out = {*range(low), *range(len(mine) - high, len(mine))}
    mine, other = mine[low : len(mine) - high], other[low : len(other) - high]
    places = defaultdict(list)
    for j, x in enumerate(other):
        places[x].append(j)
    if sum(len(places.get(x, ())) for x in mine) > PAIRS * (len(mine) + len(other)):
        half = len(mine) // 2
        cut = int(np.argmax(_lengths(mine[:half], other) + _lengths(mine[:half - 1 : -1], other[::-1])[::-1]))
        first, second = shared_lines(mine[:half], other[:cut]), shared_lines(mine[half:], other[cut:])
        return out | {low + i for i in first} | {low + half + i for i in second}
    ends: list[int] = []
    links: list[tuple] = []
    for i, x in enumerate(mine):
        for j in reversed(places.get(x, ())):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    link = links[-1] if links else None
    while link:
        out.add(low + link[0])
        link = link[1]
    return out


def _lengths(mine: list[int], other: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of mine with the first 0, 1, ... lines of other, a bit for each line."""
    size = (len(other) + 7) // 8
    places = defaultdict(list)
    for j, x in enumerate(other):
        places[x].append(j)
    bits = {}
    every = row = (1 << len(other)) - 1
    for x in mine:
        if x not in places:
            continue
        at = bits.get(x)
        if at is None:
            marks = bytearray(size)
            for j in places[x]:
                marks[j >> 3] |= 1 << (j & 7)
            at = int.from_bytes(marks, "little")
            if len(places[x]) >= OFTEN:
                bits[x] = at
        hit = row & at
        row = (row + hit | row - hit) & every
    ones = np.unpackbits(np.frombuffer(row.to_bytes(size, "little"), np.uint8), bitorder="little")[: len(other)]
    return np.concatenate([[0], np.cumsum(1 - ones.astype(np.int64))])


def _content(blocks: list[Block]) -> tuple[int, list[str]]:
    """The zone that holds the page's main text, and its lines."""
    zone, at = _part(blocks)
    return zone, [blocks[i].text for i in at]


def _part(blocks: list[Block]) -> tuple[int, list[int]]:
    """The zone that holds the page's main text, and the places of its blocks. Zones are weighed by their text, words in links counting a
    tenth. An article in a main element is taken if it holds half of that; an article elsewhere, such as a teaser, if it
    holds more than the main element or, without one, than all that stands outside of articles. Of several articles one
    that outweighs the others is the page's; else all are."""
    weight, inside, main, outside = defaultdict(float), set(), 0.0, 0.0
    for b in blocks:
        own = len(b.text) - 0.9 * b.linked
        weight[b.article] += own * bool(b.article)
        main += own * bool(b.zone & MAIN)
        outside += own * (b.zone == OPEN)
        if b.article and b.zone & MAIN:
            inside.add(b.article)
    weight.pop(0, None)
    best = max(weight, key=lambda k: (weight[k], -k), default=0)
    only = {best} if best and 2 * weight[best] >= sum(weight.values()) else set(weight)
    if any(b.zone & MAIN for b in blocks):
        if only <= inside and len(only) == 1 and 2 * weight[best] >= main or best not in inside and best and weight[best] > main:
            return ARTICLE, [i for i, b in enumerate(blocks) if b.article == best]
        return MAIN, [i for i, b in enumerate(blocks) if b.zone & MAIN]
    if weight and sum(weight[k] for k in only) >= outside:
        return ARTICLE, [i for i, b in enumerate(blocks) if b.article in only]
    return OPEN, [i for i, b in enumerate(blocks) if b.zone == OPEN]


def _hashed(lines: list[str]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in lines]


_SCAN = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("zone", pa.int32()), ("lines", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("headings", pa.list_(pa.bool_())), ("own", pa.list_(pa.string()))])
_ENDING = pa.struct([("line", pa.int64()), ("front", pa.int32()), ("back", pa.int32()), ("again", pa.bool_())])
_DIFF = pa.schema([("row", pa.int64()), ("host", pa.string()), ("differs", pa.bool_()), ("ending", pa.list_(_ENDING)), ("front", pa.int32()), ("back", pa.int32()), ("keep", pa.list_(pa.bool_()))])


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Zone of each page, hashes of all its lines, and of the zone's lines: places, sizes, headings and texts."""
    out = [[] for _ in list(_SCAN)[2:]]
    for page in batch.column("html").to_pylist():
        blocks = blocks_of(page or "")
        zone, at = _part(blocks)
        own = [blocks[i] for i in at]
        for column, x in zip(out, (zone, _hashed([b.text for b in blocks]), at, [len(b.text) for b in own], [b.heading for b in own], [b.text for b in own])):
            column.append(x)
    return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *(pa.array(x, f.type) for x, f in zip(out, list(_SCAN)[2:]))], schema=_SCAN)


def endings(lines: list[int], headings: list[bool], shared: set[int]) -> list[dict]:
    """The shared lines of an article that stand before its first or after its last line that is a heading or its own, with
    their distance from that end; again: the line stands in the list before."""
    n = len(lines)
    stops = [i for i in range(n) if i not in shared or headings[i]]
    front, back = (stops[0], stops[-1]) if stops else (n, -1)
    seen, out = set(), []
    for i in [*range(front), *range(max(back + 1, front), n)]:
        out.append({"line": lines[i], "front": i if i < front else None, "back": n - 1 - i if i > back else None, "again": lines[i] in seen})
        seen.add(lines[i])
    return out


def _differing(batch: pa.RecordBatch) -> pa.RecordBatch:
    """What the difference to the nearest page says of the lines of each page's zone: those of an article that may go
    (ending), and whether the two are different articles, less than half of the text being shared; lines that go at the
    ends of a main element (front, back), and lines that stay elsewhere (keep). A page that shares all its lines tells
    nothing apart and keeps them."""
    out = [[] for _ in list(_DIFF)[2:]]
    for zone, lines, places, sizes, headings, near in zip(*[batch.column(c).to_pylist() for c in ("zone", "lines", "places", "sizes", "headings", "near")]):
        mine = [lines[i] for i in places]
        shared = shared_lines(mine, near or [])
        own = [i for i in range(len(mine)) if i not in shared]
        differs, ending, front, back, keep = False, [], None, None, None
        if zone == ARTICLE:
            differs = near is not None and 2 * sum(sizes[i] for i in shared) < sum(sizes)
            ending = endings(mine, headings, shared)
        elif own and shared and zone == MAIN:
            front, back = own[0], len(mine) - 1 - own[-1]
        elif own and shared:
            keep = [i not in shared for i in range(len(mine))]
        for column, x in zip(out, (differs, ending, front, back, keep)):
            column.append(x)
    return pa.RecordBatch.from_arrays([batch.column("row"), batch.column("host"), *(pa.array(x, f.type) for x, f in zip(out, list(_DIFF)[2:]))], schema=_DIFF)


#: Pages in a row that one window task handles at once.
RUN = 1024


def nearest_pages(keys: DataFrame) -> DataFrame:
    """keys with host and near: lines of the page of the same host nearest by URL path (null: none).

    Pages are sorted by host and path over the whole table and compared with the page before and after, the one with
    the longer common path winning (on ties the one before). Windows hold RUN pages and one more at each end, so a host
    of any size is spread over many tasks, and the result doesn't depend on how the table is dealt out.
    """
    rest = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    path = F.regexp_replace(F.regexp_replace(rest, r"[?#].*$", ""), r"(?:\.html?|/)+$", "")
    named = keys.withColumn("host", F.lower(F.substring_index(path, "/", 1))).withColumn("path", path)
    order = ["host", "path", "page_id", "url", "lines"]
    mine = named.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    mine = materialize(mine, "page-order")
    part, inside = F.shiftright("at", 33), F.col("at") % (1 << 33)
    mine = mine.withColumn("part", part).withColumn("run", F.floor(inside / RUN).cast("long")).withColumn("own", F.lit(True))
    ghost = mine.withColumn("own", F.lit(False))
    place = inside % RUN
    inner = ghost.where((place == 0) & (inside > 0)).withColumn("run", F.col("run") - 1).unionByName(ghost.where(place == RUN - 1).withColumn("run", F.col("run") + 1))
    # a part's last page meets the next part's first; parts are as many as the sort's tasks
    by_part = Window.orderBy("part")
    ends = mine.groupBy("part").agg(F.max("at").alias("last"), F.max("run").alias("last_run"))
    ends = ends.withColumns({"next": F.lead("part").over(by_part), "back": F.lag("part").over(by_part), "back_run": F.lag("last_run").over(by_part)})
    ends = materialize(ends, "page-parts").withColumnRenamed("part", "of")
    to_next = ghost.join(ends.where("next is not null"), F.col("at") == F.col("last")).withColumn("part", F.col("next")).withColumn("run", F.lit(0).cast("long"))
    to_back = ghost.join(ends.where("back is not null"), F.col("at") == F.shiftleft(F.col("of"), 33)).withColumn("part", F.col("back")).withColumn("run", F.col("back_run"))
    whole = mine
    for more in (inner, to_next, to_back):
        whole = whole.unionByName(more.select(mine.columns))
    w = Window.partitionBy("part", "run").orderBy("at")
    side = F.struct("host", "path", "lines")
    seen = whole.withColumns({"before": F.lag(side).over(w), "after": F.lead(side).over(w)}).where("own")

    def shared(other: str):
        here, there = F.split("path", ""), F.split(F.col(f"{other}.path"), "")
        same = F.aggregate(F.zip_with(here, there, lambda a, b: a == b), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda acc, x: F.struct((acc["on"] & F.coalesce(x, F.lit(False))).alias("on"), (acc["n"] + (acc["on"] & F.coalesce(x, F.lit(False))).cast("int")).alias("n")), lambda acc: acc["n"])
        return F.when(F.col(f"{other}.host") == F.col("host"), same).otherwise(-1)

    scored = seen.withColumns({"b": F.coalesce(shared("before"), F.lit(-1)), "a": F.coalesce(shared("after"), F.lit(-1))})
    lines = F.when((F.col("b") >= F.col("a")) & (F.col("b") >= 0), F.col("before.lines")).when(F.col("a") >= 0, F.col("after.lines"))
    return scored.select(*keys.columns, "host", lines.alias("near"))


#: Fewest pages of a host that confirm a line of an article as boilerplate.
LEAST = 10


def differences(keys: DataFrame) -> DataFrame:
    """(row, front, back: lines that go at each end of the page's zone, keep: whether each line stays) for the pages that
    lose lines by the difference to their nearest page, of the zone's lines (row, page_id, url, zone, lines, places, sizes,
    headings)."""
    layout = "row bigint, host string, differs boolean, ending array<struct<line: bigint, front: int, back: int, again: boolean>>, front int, back int, keep array<boolean>"
    diff = settle(keys.sparkSession, lambda: nearest_pages(keys).mapInArrow(by_batch(lambda: _differing), layout), "page-differences")
    each = diff.select("row", "host", "differs", F.explode("ending").alias("e"))
    each = each.select("row", F.struct("host", "e.line").alias("key"), "differs", "e.front", "e.back", "e.again")
    seen = each.groupBy("key").agg(F.count("*").alias("df"), F.count_if(F.col("differs") & ~F.col("again")).alias("n")).where(F.col("n") >= LEAST)
    hosts = diff.where("differs").groupBy("host").agg(F.count("*").alias("pages"))
    sure = materialize(seen.join(hosts, F.col("key.host") == F.col("host")).where(2 * F.col("n") >= F.col("pages")).select("key", "df"), "page-boilerplate")
    gone = join_hot(likely_in(each, sure.select("key"), "key").where("_likely").drop("_likely"), sure, "key")
    # distances from an end, sorted: they go as far as none is left out
    run = lambda c: F.size(F.filter(F.sort_array(F.collect_list(c)), lambda x, i: x == i))
    articles = gone.groupBy("row").agg(run("front").alias("front"), run("back").alias("back"), F.lit(None).cast("array<boolean>").alias("keep"))
    return diff.where("front is not null or keep is not null").select(articles.columns).unionByName(articles)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Main text of pages (page_id long, url string, html string).

    Returns page_id, url, text (all blocks that the page nearest by URL doesn't share; of a main element all but the
    shared ones at its ends; of an article all but the shared ones at its ends that most pages of the host confirm; white
    space in a block is one space, blocks are joined by a newline; empty if none) and n_chars (its code points). Null html
    is empty; a null url counts as the empty host. Repeated rows are returned each. A page without another page of its
    host, or that would lose all its lines, keeps them. Other columns are ignored. An empty table gives an empty table. A
    page is read once from front to back: its length bounds the time, broken markup or not.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    layout = "page_id bigint, url string, zone int, lines array<bigint>, places array<int>, sizes array<int>, headings array<boolean>, own array<string>"
    scan = materialize(pages.mapInArrow(by_batch(lambda: _scan), layout).withColumn("row", F.monotonically_increasing_id()), "page-scan")
    gone = settle(pages.sparkSession, lambda: differences(scan.drop("own")), "page-losses")
    # most pages of an article lose nothing: their texts aren't shuffled
    found = join_few(scan.select("row", "page_id", "url", "own"), gone, "row")
    left = F.size("own") - F.col("front") - F.col("back")
    kept = F.when(F.col("keep").isNotNull(), F.filter("own", lambda x, i: F.get("keep", i))).when(left > 0, F.slice("own", F.col("front") + 1, left)).otherwise(F.col("own"))
    return found.select("page_id", "url", F.array_join(kept, "\n").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_main_text(table(spark, sf_dir, "pages"))
