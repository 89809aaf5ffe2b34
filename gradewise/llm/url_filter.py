"""URL filters with redirect equivalence.

Rules judge a page by host and path. Redirects (meta refresh) and canonical links make edges between pages' addresses;
distributed connected components make classes of equivalent addresses, and a block inside a class reaches the pages that
no rule judges. An explicit allow wins for its own page, and over blocks of its class for pages that no rule judges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewise.llm.components import connected_components
from gradewise.llm.store import materialize

#: The rules (host, path, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Rules up to this many become one expression; more are joined by host. Results are the same.
INLINE_RULES = 100
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """What stands for a page in the graph: scheme and host in lower case, path and query; no fragment."""
    bare = F.regexp_extract(url, r"(?s)^([^#]*)", 1)
    head = F.regexp_extract(bare, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.concat(F.translate(head, UPPER, LOWER), F.regexp_replace(bare, r"(?s)^.*?://[^/?#]*", ""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct ``rule, verdict``; null if none does.

    A rule fits its host and every subdomain, where the path starts with the rule's. Of rules of one length the first
    in the order of their texts wins.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def with_rules(rows: DataFrame, rules=RULES) -> DataFrame:
    """``rows`` (with ``host`` and ``path``) with ``fits``, the rule of each; any number of rules.

    Many rules are a table that the hosts of distinct addresses, and their parent domains, are joined with.
    """
    if len(rules) <= INLINE_RULES:
        return rows.withColumn("fits", rule_of(F.col("host"), F.col("path"), rules))
    table = rows.sparkSession.createDataFrame([(h, p, v) for h, p, v in rules], "rule_host string, rule_path string, verdict string")
    labels = F.split("host", "[.]")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    asked = rows.select("host", "path").distinct().withColumn("rule_host", F.explode(above)).join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = asked.groupBy("host", "path").agg(F.min(F.struct((-F.length(rule)).alias("size"), rule.alias("rule"), F.col("verdict"))).alias("best"))
    found = best.select("host", "path", F.struct("best.rule", "best.verdict").alias("fits"))
    return rows.join(found, ["host", "path"], "left")


#: A tag with its attributes; then an attribute's value in either quotes or none.
_TAG = r"(?is)<(?:link|meta)\b[^>]*>"


def _value(tag: Column, name: str) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*{q}", 1), F.lit("")) for q in ('"([^"]*)"', r"'([^']*)'", r"([^\s\"'>]+)")])


def links_of(html: Column) -> Column:
    """Absolute addresses that a page names as its canonical form or sends its readers on to."""
    tags = F.regexp_extract_all(html, F.lit(_TAG), F.lit(0))
    canonical = F.transform(tags, lambda t: F.when(F.lower(_value(t, "rel")).rlike(r"(^|\s)canonical(\s|$)"), _value(t, "href")))
    onward = F.transform(tags, lambda t: F.when(F.lower(_value(t, "http-equiv")) == "refresh", F.nullif(F.trim(F.regexp_extract(_value(t, "content"), r"(?is)url\s*=\s*['\"]?([^'\"]*)", 1)), F.lit(""))))
    return F.filter(F.concat(canonical, onward), lambda x: x.isNotNull())


def _absolute(link: Column, url: Column) -> Column:
    origin = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(F.regexp_extract(url, r"^([^:]*:)", 1), link)).when(link.startswith("/"), F.concat(origin, link))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict, class_size`` for every row.

    Without a rule a page takes the verdict of its class of aliases: allow if a rule allows one of them, else block if a
    rule blocks one, else allow. A null url, or one without ``://``, has empty host and path, fits no rule, has no
    aliases and is allowed. Relative canonical links count from the page's origin; ones that start with neither ``/``
    nor a scheme are left out. Rows that repeat an address share its class. Null html has no links. An empty table gives
    no rows. Addresses are known to the graph by a 64-bit hash.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.when(url.contains("://"), F.xxhash64(address_of(url))).alias("node"), url.alias("url"), F.col(html_col).cast("string").alias("html"))
    found = rows.where("node is not null").select("node", "url", F.explode(links_of(F.col("html"))).alias("link"))
    edges = materialize(found.select(F.col("node").alias("src"), F.xxhash64(address_of(_absolute(F.col("link"), F.col("url")))).alias("dst"), _absolute(F.col("link"), F.col("url")).alias("to")).where("to is not null and src != dst").select("src", "dst").distinct(), "aliases")
    classes = materialize(connected_components(edges), "classes")
    ruled = with_rules(rows, rules).select("page_id", "host", "path", "node", "fits.rule", F.col("fits.verdict").alias("own"))
    member = ruled.join(classes, ruled.node == classes.id, "left").drop("id")
    # only classes with edges are summed up: rows without aliases neither shuffle nor meet
    verdicts = (
        member.where("component is not null").groupBy("component")
        .agg(F.max((F.col("own") == "allow").cast("int")).alias("allows"), F.max((F.col("own") == "block").cast("int")).alias("blocks"), F.count("*").alias("n"))
    )
    joined = member.join(verdicts, "component", "left")
    by_class = F.when((F.col("blocks") == 1) & (F.coalesce("allows", F.lit(0)) == 0), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("own", by_class).alias("verdict"), F.coalesce("n", F.lit(1)).alias("class_size"))
