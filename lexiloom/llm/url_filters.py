"""URL filters by redirect equivalence.

Rules name a host (with all its subdomains) and the beginning of a path, and allow or block; the longest that fits a URL
decides.  URLs that redirect to each other, or name each other as canonical, are aliases: edges between them (from the
pages' own markup, and from a table of redirects if there is one) are joined into components, and a block decision on
any member reaches the members that no rule fits, unless a rule allows a member of the component: an explicit allow takes
precedence over any block that comes by alias.  What neither decides is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import materialise
from .components import components

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; of equally long ones the one with the longer host, then allow."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "allow", r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def node_of(url: Column) -> Column:
    """A URL as a node: host, path (``/`` if empty) and query; scheme and fragment do not count."""
    path = path_of(url)
    return F.concat(host_of(url), F.when(path == "", "/").otherwise(path), F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit("")))


def resolved(base: Column, link: Column) -> Column:
    """An address that a page at ``base`` names: absolute ones as they are, others from the host, the folder or the page, with
    ``.`` and ``..`` taken out; null for other schemes (``mailto:``)."""
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    path = path_of(base)
    bare, rest = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(F.when(path == "", "/").otherwise(path), r"(?s)^(.*/)", 1)
    whole = F.when(bare.startswith("/"), bare).otherwise(F.concat(folder, bare))
    parts = F.split(F.substr(whole, F.lit(2)), "/")
    walked = F.aggregate(parts, F.lit(""), lambda at, x: F.when(x == "..", F.regexp_replace(at, "/[^/]*$", "")).when(x == ".", at).otherwise(F.concat(at, F.lit("/"), x)))
    walked = F.concat(walked, F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(bare == "", F.concat(origin, path, rest))
        .otherwise(F.concat(origin, walked, rest))
    )


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_replace(F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*[\"']?\s*([^\"'\s>]+)", 1), "&(?:amp|#38|#x26);", "&")


def markup_edges(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(source url, target url) from canonical links and refresh redirects in the pages' head tags, resolved against the page's
    ``<base>``, if it has one, and its own address."""
    tags = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    tags = F.filter(tags, lambda t: t.rlike(r"(?is)\brel\s*=\s*[\"']?\s*canonical\b|http-equiv\s*=\s*[\"']?\s*refresh\b"))
    base = _attribute(F.regexp_extract(F.col(html), r"(?is)<base\b[^>]*>", 0), "href")
    found = pages.where(F.col(html).rlike(r"(?i)canonical|refresh") & F.col(url).contains("://")).select(F.col(url).alias("u"), base.alias("base"), F.explode(tags).alias("t"))
    found = found.select("u", "base", F.when(F.col("t").rlike(r"(?is)http-equiv"), _attribute(F.col("t"), "url")).otherwise(_attribute(F.col("t"), "href")).alias("to")).where("`to` <> ''")
    from_ = F.when(F.col("base") == "", F.col("u")).otherwise(F.coalesce(resolved(F.col("u"), F.col("base")), F.col("u")))
    return found.select("u", resolved(from_, F.col("to")).alias("to")).where(F.col("to").contains("://"))


def filter_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row for each row of ``pages``.

    ``redirects`` may hold (source url, target url) rows seen by a crawler, any of them several times.  Addresses that differ in
    scheme, fragment, capitals of the host or the ``/`` of an empty path are one node, which the rules judge with ``/``.  A null
    url, or one without ``://``, has empty host and path and no alias; null markup has no links.  Of rules of equal length the one with
    the longer host fits, then an allow.  Repeated pages are judged each, other columns are not looked at, and an empty
    table gives none.
    """
    edges = markup_edges(pages, url, html)
    if redirects is not None:
        a, b = redirects.columns[:2]
        edges = edges.union(redirects.select(F.col(a), F.col(b)).where(F.col(a).contains("://") & F.col(b).contains("://")))
    ends = edges.select(node_of(F.col("u")).alias("na"), node_of(F.col("to")).alias("nb")).where("na <> nb").distinct()
    ends = materialise(ends.select(F.xxhash64("na").alias("a"), F.xxhash64("nb").alias("b"), "na", "nb"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    plain = pages.select(F.col(key).alias("page_id"), F.col(url).alias("_u"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).withColumn("rule", rule).withColumn("_v", verdict)
    if ends.isEmpty():
        return plain.select("page_id", "host", "path", "rule", F.coalesce("_v", F.lit("allow")).alias("verdict"))
    groups = components(ends.select("a", "b"))
    nodes = ends.select(F.col("a").alias("v"), F.col("na").alias("u")).union(ends.select("b", "nb")).dropDuplicates(["v"])
    # a node is judged as such, however the addresses that share it are spelled
    host = F.substring_index("u", "/", 1)
    told = rule_of(host, F.substring_index(F.substr("u", F.length(host) + 1), "?", 1), rules)[1]
    known = groups.join(nodes, "v").withColumn("w", told)
    fate = known.groupBy("root").agg(F.max(F.col("w") == "allow").alias("some_allow"), F.max(F.col("w") == "block").alias("some_block"))
    blocked = fate.where("some_block and not coalesce(some_allow, false)").select("root")
    reached = groups.join(blocked, "root").select(F.col("v").alias("_n"), F.lit("block").alias("_by"))
    out = plain.withColumn("_n", F.when(F.col("_u").contains("://"), F.xxhash64(node_of(F.col("_u"))))).join(reached, "_n", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_v", "_by", F.lit("allow")).alias("verdict"))


def op2(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
