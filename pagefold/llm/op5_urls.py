"""URL verdicts that follow redirects and canonical links (operator 5).

1. Own rule: the longest rule whose host is the URL's host or a parent domain
   and whose path starts the URL's path.
2. Alias edges: from a page's URL to the target of its ``rel=canonical`` link
   and of its ``http-equiv=refresh`` redirect, relative targets resolved.
   Comments, scripts and styles do not count.
3. Connected components over the edges (distributed, see ``common``).  A URL
   without an own rule takes the component's verdict: allow where any member
   is explicitly allowed, else block where any member is blocked.  Targets
   that are no pages themselves count as members.

A node is host, path and query; scheme and fragment do not tell resources
apart, an empty path is ``/``.  Only pages with an edge enter step 3, and only
the small component table meets the pages again.

Cases: a null URL or one without ``://`` has an empty host and path, no rule
and verdict allow; a null page has no edges; repeated rows and URLs give a row
each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.functions.url import url_resolve
from pagefold.llm.common import connected_components, read, save
from pagefold.plans.catalog import register

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HIDDEN = r"(?is)<!--.*?-->|<(script|style|template|noscript|textarea)\b.*?</\1\s*>"
TAG = r"(?is)<(?:link|meta)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>"


def host_path(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query of a URL column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)?", 1)


def own_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct ``rule, verdict`` of the longest rule that fits, null if none does."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def node(url: Column) -> Column:
    host, path, query = host_path(url)
    return F.when(host != "", F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), query))


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, in either quotes or bare; '' if absent."""
    return F.coalesce(*[F.nullif(F.regexp_extract(tag, rf"(?is)[\s\"']{name}\s*=\s*{value}", 1), F.lit("")) for value in
                        (r'"([^"]*)"', r"'([^']*)'", r"([^\s\"'>]+)")], F.lit(""))


def alias_edges(pages: DataFrame) -> DataFrame:
    """``src, dst`` nodes: canonical links and redirects of ``pages(url, html)``."""
    hinted = pages.where(F.col("url").isNotNull() & F.col("html").rlike(r"(?i)canonical|http-equiv"))
    tags = hinted.select("url", F.explode(F.regexp_extract_all(
        F.regexp_replace("html", HIDDEN, " "), F.lit(f"({TAG})"), 1)).alias("tag"))
    tag = F.col("tag")
    canonical = F.when(tag.rlike(r"(?i)^<link") & F.array_contains(
        F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical"), _attribute(tag, "href"))
    refresh = F.when(tag.rlike(r"(?i)^<meta") & (F.lower(F.trim(_attribute(tag, "http-equiv"))) == "refresh"),
                     F.regexp_extract(_attribute(tag, "content"), r"(?i)^\s*[0-9.]*\s*[;,]\s*url\s*=\s*['\"]?([^'\"]*)", 1))
    target = F.trim(F.regexp_replace(F.coalesce(canonical, refresh), "&amp;", "&"))
    found = tags.withColumn("target", target).where("target <> ''")
    found = found.withColumn("target", url_resolve(F.col("target"), F.col("url")))
    return found.select(node(F.col("url")).alias("src"), node(F.col("target")).alias("dst")).where(
        "src IS NOT NULL AND dst IS NOT NULL").distinct()


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` per row of ``pages(page_id, url, html)``."""
    edges = save(alias_edges(pages.select("url", "html")), "url-edges")
    members = connected_components(edges, "url-components")
    host, path, _ = host_path(F.concat(F.lit("x://"), F.col("node")))
    known = members.withColumn("own", own_rule(host, path, rules)["verdict"])
    verdicts = known.groupBy("component").agg(
        F.when(F.max(F.col("own") == "allow"), "allow").when(F.max(F.col("own") == "block"), "block").alias("inherited"))
    aliases = save(members.join(verdicts, "component").where("inherited IS NOT NULL").select("node", "inherited"), "url-aliases")
    host, path, _ = host_path(F.col("url"))
    # The path of a bare host is empty in the result; its node is "/".
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), node(F.col("url")).alias("node"))
    judged = judged.withColumn("own", own_rule(F.col("host"), F.col("path"), rules))
    return judged.join(aliases, "node", "left").select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", "inherited", F.lit("allow")).alias("verdict"))


ORACLE = r"""
WITH RECURSIVE
rules(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
p AS (SELECT page_id, html, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
n AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\?[^#]*)?', 1) AS query FROM p),
k AS (SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS node FROM n),
tags AS (SELECT node AS src, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
    '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) AS tag
  FROM k WHERE regexp_matches(coalesce(html, ''), '(?i)canonical|http-equiv')),
target AS (SELECT src, CASE
    WHEN regexp_matches(tag, '(?is)^<link.*\brel\s*=\s*["'']?[^"''>]*canonical') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?https?://([^\s"''>#]+)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta.*http-equiv\s*=\s*["'']?refresh') THEN regexp_extract(tag, '(?i)url\s*=\s*[''"]?https?://([^\s"''>#]+)', 1) END AS t FROM tags),
edges AS (SELECT src, lower(regexp_extract(t, '^[^/?]*')) || CASE WHEN regexp_extract(t, '^[^/?]*([^?]*)', 1) = '' THEN '/' ELSE '' END
    || substr(t, length(regexp_extract(t, '^[^/?]*')) + 1) AS dst FROM target WHERE src IS NOT NULL AND t <> ''),
pairs AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
reach AS (SELECT a, b FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
own AS (SELECT r.a, x.verdict FROM reach r, LATERAL (SELECT arg_max(verdict, length(rh || rp)) AS verdict FROM rules
          WHERE (regexp_extract(r.b, '^[^/?]*') = rh OR ends_with(regexp_extract(r.b, '^[^/?]*'), '.' || rh))
            AND starts_with(regexp_extract(r.b, '^[^/?]*([^?]*)', 1), rp)) x),
inherited AS (SELECT a AS node, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' WHEN bool_or(verdict = 'block') THEN 'block' END AS verdict
              FROM own GROUP BY a),
j AS (SELECT k.page_id, k.host, k.path, k.node, f.rule, f.verdict FROM k, LATERAL (
        SELECT arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict FROM rules
        WHERE (k.host = rh OR ends_with(k.host, '.' || rh)) AND starts_with(k.path, rp)) f)
SELECT page_id, host, path, rule, coalesce(j.verdict, i.verdict, 'allow') AS verdict FROM j LEFT JOIN inherited i ON i.node = j.node"""


@register("op5_url_filters", oracle=ORACLE)
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page URL."""
    return judge(read(spark, sf_dir, "pages", "page_id", "url", "html"))
