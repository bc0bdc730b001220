"""URL filters from a tree of path templates, learned from labelled pages.

Of each host, paths are read segment by segment from the top. Numbers and long hexadecimal names fall together at once.
At every node a segment that holds a fair share of the host's pages keeps its name, all others become one wildcard, so a
host's tree is small whatever the number of its paths. Neighbouring branches whose labels do not differ more than chance
allows are merged and go on as one. A node's share of good labels (its purity) is smoothed towards its parent's, so a
branch with few labels says what its parent says; the templates that paths end in are rejected by that purity. Explicit
rules come before all. All of it is DataFrame work on distinct path shapes; texts of pages are never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import materialize, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
STATS = ["n", "labelled", "good"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no `://`."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule (`host/path`) that fits, or null. A rule fits its host and all subdomains, if the path starts with
    the rule's. Rules are a few literals."""
    found = F.lit(None).cast("string")
    for rule in sorted({r for r, _ in rules}, key=len):
        at, start = rule.split("/", 1)[0], "/" + rule.split("/", 1)[1]
        found = F.when(((host == at) | host.endswith("." + at)) & path.startswith(start), F.lit(rule)).otherwise(found)
    return found


def shape_of(path: Column, depth: int) -> Column:
    """A path's segments, numbers as <n>, names of eight or more hexadecimal digits as <x>. Segments beyond `depth` are one."""
    text = F.regexp_replace(path, r"(?<=/)(?=[0-9-]*[A-Fa-f])(?=[A-Fa-f-]*[0-9])[0-9A-Fa-f-]{8,}(?=[/.]|$)", "<x>")
    segments = F.split(F.regexp_replace(text, r"[0-9]+", "<n>"), "/")
    segments = F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0)))  # before the first slash stands nothing
    return F.when(F.size(segments) > depth, F.concat(F.slice(segments, 1, depth), F.array(F.lit("**")))).otherwise(segments)


def _merged(children: Column, z: float, prior: Column, strength: float) -> Column:
    """Children (array of structs name, n, labelled, good) as branches (array of structs names, n, labelled, good): in the
    order of their smoothed purity, a child joins the branch before it unless the two shares of good labels differ by z standard errors."""
    empty = F.array().cast("array<struct<names:array<string>,n:bigint,labelled:bigint,good:bigint>>")
    purity = lambda x: (x.good + strength * prior) / (x.labelled + strength)
    ordered = F.array_sort(F.transform(children, lambda x: F.struct(purity(x).alias("purity"), x["name"].alias("name"), x.n.alias("n"), x.labelled.alias("labelled"), x.good.alias("good"))))

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        new = F.struct(F.array(x["name"]).alias("names"), x.n.alias("n"), x.labelled.alias("labelled"), x.good.alias("good"))
        pooled = (last.good + x.good) / (last.labelled + x.labelled)
        error = F.sqrt(pooled * (1 - pooled) * (F.lit(1.0) / last.labelled + F.lit(1.0) / x.labelled))
        apart = (last.labelled > 0) & (x.labelled > 0) & (F.abs(last.good / last.labelled - x.good / x.labelled) > z * error)
        joined = F.struct(F.concat(last.names, F.array(x["name"])).alias("names"), (last.n + x.n).alias("n"), (last.labelled + x.labelled).alias("labelled"), (last.good + x.good).alias("good"))
        return F.when((F.size(done) == 0) | F.coalesce(apart, F.lit(False)), F.concat(done, F.array(new))).otherwise(F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined)))

    return F.aggregate(ordered, empty, step)


def path_templates(shapes: DataFrame, share: float = 0.02, least: int = 20, z: float = 1.96, strength: float = 10.0) -> DataFrame:
    """shapes: distinct (host, segments) with n, labelled and good (counts). Returns host, segments, template, purity.

    A segment keeps its name if at least `share` of its host's pages and `least` of them have it there, so a node has at
    most 1 / share named branches. Each level is one grouping of the shapes; a level's branches are one row a node.
    Without labels every purity is 1.
    """
    total = shapes.agg(F.sum("labelled").alias("l"), F.sum("good").alias("g"), F.max(F.size("segments")).alias("deepest")).first()
    base = (total.g or 0) / total.l if total.l else 1.0
    hosts = shapes.groupBy("host").agg(*[F.sum(c).alias(c) for c in STATS])
    hosts = materialize(hosts.select("host", F.col("n").alias("host_n"), ((F.col("good") + strength * base) / (F.col("labelled") + strength)).alias("host_purity")), "url-hosts")
    now = materialize(shapes.join(hosts, "host").withColumns({"prefix": F.lit(""), "purity": F.col("host_purity")}).drop("host_purity"), "url-level")
    for level in range(1, (total.deepest or 0) + 1):
        here = now.where(F.size("segments") >= level).withColumn("name", F.element_at("segments", level))
        sums = [F.sum(c).alias(c) for c in STATS]
        named = here.groupBy("host", "prefix", "name", "host_n", "purity").agg(*sums)
        kept = F.col("n") >= F.greatest(F.lit(least), F.ceil(F.col("host_n") * share))
        # what keeps no name is the wildcard; a node's branches are few, so they can be gathered
        named = named.withColumn("name", F.when(kept, F.col("name")).otherwise(F.lit("*"))).groupBy("host", "prefix", "name", "purity").agg(*sums)
        nodes = named.groupBy("host", "prefix", "purity").agg(F.collect_list(F.struct("name", *STATS)).alias("children"))
        branches = nodes.select("host", "prefix", F.col("purity").alias("above"), F.explode(_merged(F.col("children"), z, F.col("purity"), strength)).alias("branch"))
        names = F.col("branch.names")
        label = F.when(F.size(names) == 1, names[0]).otherwise(F.concat(F.lit("{"), F.array_join(F.array_sort(names), "|"), F.lit("}")))
        purity = (F.col("branch.good") + strength * F.col("above")) / (F.col("branch.labelled") + strength)
        found = branches.select("host", "prefix", F.explode(names).alias("branch_name"), label.alias("label"), purity.alias("new"))
        table_of = found.groupBy("host", "prefix").agg(F.map_from_entries(F.collect_list(F.struct("branch_name", F.struct("label", "new").alias("to")))).alias("to"))
        here = here.join(table_of, ["host", "prefix"])
        to = F.coalesce(F.try_element_at("to", F.col("name")), F.try_element_at("to", F.lit("*")))
        here = here.withColumn("_to", to).select("host", "segments", *STATS, "host_n", F.concat("prefix", F.lit("/"), F.col("_to.label")).alias("prefix"), F.col("_to.new").alias("purity"))
        now = materialize(now.where(F.size("segments") < level).select("host", "segments", *STATS, "host_n", "prefix", "purity").unionByName(here), "url-level")
    return now.select("host", "segments", F.col("prefix").alias("template"), "purity")


def filter_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, purity: float = 0.6, share: float = 0.02, least: int = 20, depth: int = 6, z: float = 1.96, strength: float = 10.0) -> DataFrame:
    """Verdicts on pages (page_id long, url string) from labels (page_id long, good boolean).

    The longest rule that fits decides; else a URL is blocked if the smoothed purity of its template is below `purity`.
    Returns page_id, host, path, rule, verdict, template, purity. A null url, or one without `://`, has an empty host and
    path, which make a template of their own. Labels of one page add up; null labels and labels of unknown or null pages
    are left out; without labels every template is allowed. Repeated rows are each judged and counted. Other columns are
    ignored. An empty table gives an empty table.
    """
    host, path = host_and_path(F.col("url"))
    judged = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    shaped = judged.withColumn("segments", shape_of(F.col("path"), depth))
    known = labels.where("page_id is not null and good is not null").groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.count(F.lit(1)).alias("labelled"), F.count_if("good").alias("good"))
    none = F.lit(0).cast("long")
    counted = shaped.select("page_id", "host", "segments").join(known, "page_id", "left").groupBy("host", "segments").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("labelled", none)).alias("labelled"), F.sum(F.coalesce("good", none)).alias("good"))
    templates = path_templates(materialize(counted, "url-shapes"), share, least, z, strength)
    rule = rule_of(F.col("host"), F.col("path"), rules)
    verdicts = dict(rules)
    by_rule = F.lit(None).cast("string")
    for r, v in verdicts.items():
        by_rule = F.when(F.col("rule") == r, F.lit(v)).otherwise(by_rule)
    out = shaped.join(templates, ["host", "segments"], "left").withColumn("rule", rule)
    return out.select("page_id", "host", "path", "rule", F.coalesce(by_rule, F.when(F.col("purity") < purity, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "template", "purity")


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages. The number in a page's path is the doc_id of the document that it shows, whose label (good:
    of quality and not toxic) is the page's."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    shown = pages.select("page_id", F.try_to_number(F.regexp_extract(host_and_path(F.col("url"))[1], r"/([0-9]{1,18})(?:[/.]|$)", 1), F.lit("9" * 18)).cast("long").alias("doc_id"))
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1)
    labels = shown.join(table(spark, sf_dir, "labels").select("doc_id", good.alias("good")), "doc_id").select("page_id", "good")
    return filter_urls(pages, labels)
