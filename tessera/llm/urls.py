"""URL filter by host and path rules, carried to aliases over redirects and canonical links.

A rule fits its host and all subdomains where the URL's path starts with the rule's
path; the longest fitting rule decides, an allow before a block of equal length. A
URL without a rule takes the decision of its aliases: connected components over
redirect and canonical-link edges are blocked if a member is blocked by a rule and
none is allowed by one (explicit allow precedence), and allowed otherwise.

An alias is compared without scheme, fragment and tracking parameters, with its
host in lower case. Rules are a list of stated size: up to ``INLINE`` they become
one expression, beyond that a join on the host's suffixes.

Edge cases: a null URL or one without ``://`` has an empty host and path, no rule
and verdict allow; a null page has no edges; repeated rows are judged alike; an
empty table gives no rows; only the three named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage
from .graph import components

Rule = tuple[str, str, str]  # host, path, "allow" or "block"
INLINE = 200
TRACKING = r"([?&])(?:utm_[a-z]+|gclid|fbclid)=[^&#]*"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _ordered(rules: Sequence[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2], r[0], r[1]))


def with_rule(frame: DataFrame, rules: Sequence[Rule], host: str = "host", path: str = "path") -> DataFrame:
    """``frame`` with ``rule`` (host and path, or null) and ``action`` of the rule that decides."""
    if len(rules) <= INLINE:
        found = F.lit(None).cast("struct<rule: string, action: string>")
        for h, p, action in reversed(_ordered(rules)):
            fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
            found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(found)
        return frame.withColumn("__rule", found).select(*frame.columns, F.col("__rule.rule").alias("rule"), F.col("__rule.action").alias("action"))
    table = frame.sparkSession.createDataFrame([(h, p, h + p, a, k) for k, (h, p, a) in enumerate(_ordered(rules))], "__host string, __prefix string, __rule string, __action string, __order int")
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    urls = frame.select(host, path).distinct().withColumn("__host", F.explode(suffixes))
    best = urls.join(table, "__host").where(F.col(path).startswith(F.col("__prefix"))).groupBy(host, path).agg(F.min(F.struct("__order", "__rule", "__action")).alias("__best"))
    return frame.join(best, [host, path], "left").select(*frame.columns, F.col("__best.__rule").alias("rule"), F.col("__best.__action").alias("action"))


def alias_of(url: Column) -> Column:
    """Host, path and query without scheme, fragment and tracking parameters; null where there is no ``://``."""
    query = F.regexp_replace(F.regexp_extract(url, r"://[^?#]*(\?[^#]*)", 1), TRACKING, "$1")
    return F.when(url.contains("://"), F.concat(host_of(url), path_of(url), F.regexp_replace(F.regexp_replace(query, r"([?&])&+", "$1"), r"[?&]+$", "")))


def _absolute(link: Column, base: Column) -> Column:
    site = F.regexp_extract(base, r"^([^/?#]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([^?#]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([^/?#]*:)//", 1), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.rlike(r"^[^#?:]+"), F.concat(F.when(folder.endswith("/") & (folder != F.concat(F.regexp_extract(base, r"^([^/]*://)", 1))), folder).otherwise(F.concat(site, F.lit("/"))), link))
    )


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``u, v``: a page's alias and the alias its canonical link or its refresh names."""
    tags = F.regexp_extract_all(F.col(html_col), F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    tagged = pages.where(F.col(html_col).rlike(r"(?is)rel\s*=\s*[\"']?canonical|http-equiv\s*=\s*[\"']?refresh|property\s*=\s*[\"']?og:url")).select(F.col(url_col).alias("url"), F.explode(tags).alias("tag"))

    def attribute(name: str) -> Column:
        found = F.regexp_extract("tag", rf"(?is)\b{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*)", 1)
        return F.regexp_replace(found, "^[\"']|[\"']$", "")

    target = (
        F.when(F.lower(attribute("rel")) == "canonical", attribute("href"))
        .when(F.lower(attribute("http-equiv")) == "refresh", F.regexp_extract(attribute("content"), r"(?is)url\s*=\s*['\"]?([^'\"]+)", 1))
        .when(F.lower(attribute("property")) == "og:url", attribute("content"))
    )
    # a table of its own: the extractions are not repeated in what is computed from them
    links = cut_lineage(tagged.select("url", F.trim(F.replace(target, F.lit("&amp;"), F.lit("&"))).alias("link"))).where("link <> ''")
    return links.select(alias_of(F.col("url")).alias("u"), alias_of(_absolute(F.col("link"), F.col("url"))).alias("v")).where("u <> v")


def judge(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, host, path, rule, verdict`` for every row. ``redirects`` has URLs in columns ``source`` and ``target``."""
    edges = page_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionAll(redirects.select(alias_of(F.col("source")).alias("u"), alias_of(F.col("target")).alias("v")).where("u <> v"))
    nodes = components(edges)
    known = with_rule(nodes.withColumn("host", F.regexp_extract("node", r"^([^/?#]*)", 1)).withColumn("path", F.regexp_extract("node", r"^[^/?#]*([^?#]*)", 1)), rules)
    decided = known.groupBy("root").agg(F.max((F.col("action") == "block").cast("int")).alias("blocks"), F.max((F.col("action") == "allow").cast("int")).alias("allows"))
    # null where no member has a rule
    blocked = nodes.join(decided.where("blocks = 1 and allows = 0").select("root"), "root").select(F.col("node").alias("__alias"), F.lit(True).alias("__blocked"))
    url = F.col(url_col)
    own = with_rule(pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path")), rules)
    joined = own.withColumn("__alias", alias_of(F.col("url"))).join(blocked, "__alias", "left")
    return joined.select("page_id", "url", "host", "path", "rule", F.coalesce("action", F.when(F.col("__blocked"), F.lit("block")), F.lit("allow")).alias("verdict"))
