"""Registered link queries and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefold.functions import url as U
from pagefold.operators import links as L
from pagefold.plans import duck as D
from pagefold.plans.catalog import register
from pagefold.session import materialize
from pagefold.sources import derived as S
from pagefold.sources.tables import pages

ANCHOR = D.q(L.ANCHOR_RE)

def _fill_sql(text: str) -> str:
    return f"replace(replace({D.q(text)}, '{{id}}', CAST(page_id AS VARCHAR)), '{{next}}', next_url)"


_LIST_SQL = " || ".join(
    f"'<article class=\"news-item\"><h3><a href=\"' || {_fill_sql(h)} || '\">' || {_fill_sql(t)} || '</a></h3></article>'"
    for h, t in S.LINK_LIST)

# Oracle building blocks: pages with their link list, links with resolved URLs, deduped per page.
SQL_LINKS = f"""
lpages AS (
  SELECT page_id, url, CASE WHEN page_id % 3 <> 0 THEN
    replace(html, '<body>', '<body><div class="news-list">' || {_LIST_SQL} || '</div>') ELSE html END AS html
  FROM (SELECT *, coalesce(lead(url) OVER (PARTITION BY {D.host('url')} ORDER BY page_id), '/') AS next_url FROM pages)
),
links_raw AS (
  SELECT page_id, url AS page_url,
         unnest(range(len(regexp_extract_all(html, {ANCHOR}, 1)))) AS pos,
         unnest(regexp_extract_all(html, {ANCHOR}, 1)) AS href,
         unnest(regexp_extract_all(html, {ANCHOR}, 2)) AS inner_html
  FROM lpages
),
links_j AS (
  SELECT page_id, page_url, pos, href,
         trim({D.rx_replace(D.strip_tags('inner_html'), chr(92) + 's+', ' ')}) AS text,
         {D.resolve_join('href', 'page_url')} AS j
  FROM links_raw
),
links_c AS (SELECT *, {D.canonical('j')} AS c FROM links_j),
links AS (SELECT page_id, page_url, pos, href, text, {D.resolve_final('href', 'j', 'c')} AS url FROM links_c),
links_dd AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS rn FROM links)
  WHERE rn = 1
)"""


def _content_sql(h: str, t: str) -> str:
    tl = f"length(coalesce({t}, ''))"
    tt = f"coalesce({t}, '')"
    dates = " OR ".join(f"regexp_matches({h}, {D.q(p)})" for p in L.DATE_IN_URL)
    return (f"coalesce(NOT {D.contains_any(h, L.NON_CONTENT_PATHS)} AND ("
            f"regexp_matches({h}, '\\d{{4}}\\.htm') OR ({tl} > 15 AND {D.contains_any(tt, L.CONTENT_TEXT_WORDS)}) "
            f"OR {D.contains_any(h, L.CONTENT_URL_WORDS)} OR {D.contains_any(h, L.CONTENT_PATHS)} "
            f"OR ({tl} > 10 AND contains({h}, '.htm')) OR {dates} OR {tl} > 20), false)")


@register("host_link_report", oracle=f"""
WITH {SQL_LINKS},
scored AS (
  SELECT {D.host_or_self('page_url')} AS host, page_id, url,
         {_content_sql('url', 'text')} AS is_content,
         {D.similarity('url', 'page_url')} AS sim,
         ({D.host('url')} = {D.host('page_url')}) AS internal
  FROM links_dd
)
SELECT host, count(DISTINCT page_id) AS n_pages, count(*) AS n_links,
       count(DISTINCT url) AS n_distinct_links,
       count(*) FILTER (WHERE is_content) AS n_content_links,
       count(*) FILTER (WHERE internal) AS n_internal_links,
       round(avg(sim), 6) AS avg_similarity
FROM scored GROUP BY host
""")
def host_link_report(spark, sf_dir):
    return L.host_link_report(S.linked_pages(spark, sf_dir))


def _links(spark, sf_dir):
    return L.resolved_links(S.linked_pages(spark, sf_dir))


@register("src_pages", oracle="SELECT page_id, url, length(html) AS html_chars FROM pages")
def src_pages(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", "url", F.length("html").alias("html_chars"))


@register("link_extract", oracle=f"WITH {SQL_LINKS} SELECT page_id, pos, href, text FROM links")
def link_extract(spark, sf_dir):
    return L.link_extract(S.linked_pages(spark, sf_dir)).select("page_id", "pos", "href", "text")


@register("url_resolve", oracle=f"WITH {SQL_LINKS} SELECT page_id, pos, href, url FROM links")
def url_resolve(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", "pos", "href", "url")


@register("url_normalize", oracle=f"""
WITH {SQL_LINKS}
SELECT page_id, pos, {D.normalize('url')} AS norm_url, {D.normalize('page_url')} AS norm_page_url FROM links""")
def url_normalize(spark, sf_dir):
    return _links(spark, sf_dir).select(
        "page_id", "pos", U.url_normalize("url").alias("norm_url"),
        U.url_normalize("page_url").alias("norm_page_url"))


@register("url_valid", oracle=f"""
WITH {SQL_LINKS}
SELECT page_id, pos, {D.valid('href')} AS href_valid, {D.valid('url')} AS url_valid FROM links""")
def url_valid(spark, sf_dir):
    return _links(spark, sf_dir).select(
        "page_id", "pos", U.url_valid("href").alias("href_valid"), U.url_valid("url").alias("url_valid"))


@register("url_host", oracle=f"""
SELECT {D.host_or_self('url')} AS host, count(*) AS n_pages FROM pages GROUP BY 1""")
def url_host(spark, sf_dir):
    return pages(spark, sf_dir).groupBy(U.url_host_or_self("url").alias("host")).agg(F.count("*").alias("n_pages"))


def _scope_sql(link, ex):
    return (f"({D.valid(link)} AND {D.scheme(link)} IN ('http','https') AND {D.valid(ex)} "
            f"AND {D.host(link)} = {D.host(ex)})")


@register("link_scope_filter", oracle=f"""
WITH {SQL_LINKS} SELECT page_id, pos, url FROM links WHERE {_scope_sql('url', 'page_url')}""")
def link_scope_filter(spark, sf_dir):
    return _links(spark, sf_dir).filter(L.link_scope_ok("url", "page_url")).select("page_id", "pos", "url")


@register("link_is_content", oracle=f"""
WITH {SQL_LINKS} SELECT page_id, pos, {_content_sql('url', 'text')} AS is_content FROM links""")
def link_is_content(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", "pos", L.link_is_content("url", "text").alias("is_content"))


def _light_sql(h, t):
    lt = f"trim(lower({t}))"
    bad_text = (f"({t} IS NOT NULL AND {t} <> '' AND ((length({lt}) = 1 AND {lt} IN ('>', '<', '→', '←')) "
                f"OR {lt} = ''))")
    return f"coalesce(NOT {D.contains_any(f'lower({h})', L.LIGHT_DENY)} AND NOT {bad_text}, false)"


@register("link_is_likely_content", oracle=f"""
WITH {SQL_LINKS} SELECT page_id, pos, {_light_sql('url', 'text')} AS likely_content FROM links""")
def link_is_likely_content(spark, sf_dir):
    return _links(spark, sf_dir).select(
        "page_id", "pos", L.link_is_likely_content("url", "text").alias("likely_content"))


def _strict_sql(h, t):
    lt = f"trim(lower({t}))"
    bad_text = (f"({t} IS NOT NULL AND {t} <> '' AND ({D.contains_any(lt, L.STRICT_DENY_TEXT)} "
                f"OR (length({lt}) < 3 AND NOT regexp_matches({lt}, '\\d'))))")
    return f"coalesce(NOT {D.contains_any(f'lower({h})', L.STRICT_DENY_URL)} AND NOT {bad_text}, false)"


@register("link_is_content_strict", oracle=f"""
WITH {SQL_LINKS} SELECT page_id, pos, {_strict_sql('url', 'text')} AS strict_content FROM links""")
def link_is_content_strict(spark, sf_dir):
    return _links(spark, sf_dir).select(
        "page_id", "pos", L.link_is_content_strict("url", "text").alias("strict_content"))


@register("link_dedupe", oracle=f"WITH {SQL_LINKS} SELECT page_id, pos, url, text FROM links_dd")
def link_dedupe(spark, sf_dir):
    return L.link_dedupe(_links(spark, sf_dir)).select("page_id", "pos", "url", "text")


@register("url_similarity", oracle=f"""
WITH {SQL_LINKS}
SELECT page_id, pos, round({D.similarity('url', 'page_url')}, 6) AS similarity,
       round({D.path_similarity('url', 'page_url')}, 6) AS path_similarity,
       round({D.query_similarity('url', 'page_url')}, 6) AS query_similarity
FROM links""")
def url_similarity(spark, sf_dir):
    return _links(spark, sf_dir).select(
        "page_id", "pos",
        F.round(U.url_similarity("url", "page_url"), 6).alias("similarity"),
        F.round(U.url_path_similarity("url", "page_url"), 6).alias("path_similarity"),
        F.round(U.url_query_similarity("url", "page_url"), 6).alias("query_similarity"))


@register("url_path_similarity", oracle=f"""
WITH {SQL_LINKS}
SELECT page_id, pos, round({D.path_similarity('url', 'page_url')}, 6) AS path_similarity FROM links""")
def url_path_similarity(spark, sf_dir):
    """Path-segment overlap of every link with its page URL (link first)."""
    return _links(spark, sf_dir).select(
        "page_id", "pos", F.round(U.url_path_similarity("url", "page_url"), 6).alias("path_similarity"))


@register("url_query_similarity", oracle=f"""
WITH {SQL_LINKS}
SELECT page_id, pos, round({D.query_similarity('page_url', 'url')}, 6) AS query_similarity FROM links""")
def url_query_similarity(spark, sf_dir):
    """Query-key overlap of every page URL with its links (page first)."""
    return _links(spark, sf_dir).select(
        "page_id", "pos", F.round(U.url_query_similarity("page_url", "url"), 6).alias("query_similarity"))


@register("url_municipal_pattern", oracle=f"""
WITH {SQL_LINKS}
SELECT page_id, pos, {D.municipal_pattern('url', 'page_url')} AS municipal FROM links""")
def url_municipal_pattern(spark, sf_dir):
    return _links(spark, sf_dir).select(
        "page_id", "pos", U.url_municipal_pattern("url", "page_url").alias("municipal"))


@register("url_municipal_similarity", oracle=f"""
WITH {SQL_LINKS}
SELECT page_id, pos, round({D.municipal_similarity('url', 'page_url')}, 6) AS municipal_similarity FROM links""")
def url_municipal_similarity(spark, sf_dir):
    return _links(spark, sf_dir).select(
        "page_id", "pos", F.round(U.url_municipal_similarity("url", "page_url"), 6).alias("municipal_similarity"))


def _common_path_sql(p1, p2):
    a, b = D.segments(p1), D.segments(p2)
    n = f"least(len({a}), len({b}))"
    # index of first differing segment (n+1 when none)
    first = (f"coalesce(list_min(list_filter(range(1, {n} + 1), lambda i: {a}[i] <> {b}[i])), {n} + 1)")
    return f"('/' || array_to_string({a}[1:{first} - 1], '/'))"


@register("url_common_path", oracle=f"""
WITH {SQL_LINKS}
SELECT page_id, pos, {_common_path_sql(D.path('url'), D.path('page_url'))} AS common_path FROM links""")
def url_common_path(spark, sf_dir):
    return _links(spark, sf_dir).select(
        "page_id", "pos", U.url_common_path(U.url_path("url"), U.url_path("page_url")).alias("common_path"))


# Example fixture: the second link on each page is its example URL.
SQL_EXAMPLES = "examples AS (SELECT page_id AS example_id, page_url AS main_url, url AS example_url FROM links WHERE pos = 1)"

SQL_SIBLINGS = f"""
cand0 AS (
  SELECT l.page_id, e.example_url, l.url, min(l.pos) AS pos
  FROM links l JOIN examples e ON l.page_id = e.example_id
  WHERE {_scope_sql('l.url', 'e.example_url')}
  GROUP BY 1, 2, 3
),
cands AS (
  SELECT page_id, example_url, url, pos, {D.similarity('url', 'example_url')} AS score,
         CASE WHEN {D.municipal_pattern('url', 'example_url')} THEN 0.5e0 ELSE 0.6e0 END AS threshold
  FROM cand0
),
siblings AS (SELECT page_id, example_url, url, pos, score FROM cands WHERE url <> example_url AND score >= threshold)"""


def _siblings(spark, sf_dir):
    # Written once: read twice, and a condition on ``url`` then tests a value instead of resolving it again.
    lk = materialize(_links(spark, sf_dir).select("page_id", "page_url", "pos", "url"), "links")
    ex = lk.filter("pos = 1").select(F.col("page_id").alias("example_id"),
                                     F.col("page_url").alias("main_url"), F.col("url").alias("example_url"))
    return lk, ex, L.sibling_candidates(lk, ex)


@register("sibling_filter", oracle=f"""
WITH {SQL_LINKS}, {SQL_EXAMPLES}, {SQL_SIBLINGS}
SELECT page_id, url, pos, round(score, 6) AS score FROM siblings""")
def sibling_filter(spark, sf_dir):
    _, _, s = _siblings(spark, sf_dir)
    return s.select("page_id", "url", "pos", F.round("score", 6).alias("score"))


@register("sibling_rank", oracle=f"""
WITH {SQL_LINKS}, {SQL_EXAMPLES}, {SQL_SIBLINGS}
SELECT page_id, url, rank FROM (
  SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS rank FROM siblings)
WHERE rank <= 10""")
def sibling_rank(spark, sf_dir):
    _, _, s = _siblings(spark, sf_dir)
    return L.sibling_rank(s, 10).select("page_id", "url", "rank")


@register("link_patterns", oracle=f"""
WITH {SQL_LINKS}, {SQL_EXAMPLES}, {SQL_SIBLINGS},
agg AS (
  SELECT page_id, bool_and(regexp_matches(url, '\\d{{4,}}')) AS ids,
         bool_or(regexp_matches(url, '\\d{{4}}[-_]\\d{{2}}[-_]\\d{{2}}')) AS dated,
         bool_and({D.valid('url')} AND len(string_split({D.path('url')}, '/')) = len(string_split({D.path('example_url')}, '/'))) AS depth
  FROM siblings GROUP BY page_id
)
SELECT page_id, array_to_string(list_filter([CASE WHEN ids THEN 'consistent-id-pattern' END,
  CASE WHEN dated THEN 'date-pattern' END, CASE WHEN depth THEN 'consistent-path-structure' END],
  lambda x: x IS NOT NULL), ',') AS patterns FROM agg""")
def link_patterns(spark, sf_dir):
    _, _, s = _siblings(spark, sf_dir)
    return L.link_patterns(s).select("page_id", F.array_join("patterns", ",").alias("patterns"))


@register("example_link_match", oracle=f"""
WITH {SQL_LINKS}, {SQL_EXAMPLES},
m AS (
  SELECT e.example_id, e.example_url, l.pos,
         CASE WHEN l.url = e.example_url THEN 0 ELSE 1 END AS kind
  FROM examples e JOIN links l ON l.page_id = e.example_id
   AND {D.normalize('l.url')} = {D.normalize('e.example_url')}
)
SELECT example_id, example_url, arg_min(pos, kind * 1000000 + pos) AS match_pos,
       CASE WHEN min(kind) = 0 THEN 'exact' ELSE 'host_path' END AS match_kind
FROM m GROUP BY 1, 2""")
def example_link_match(spark, sf_dir):
    lk, ex, _ = _siblings(spark, sf_dir)
    j = ex.join(lk.select(F.col("page_id").alias("example_id"), "pos", "url"), "example_id").filter(
        U.url_normalize("url") == U.url_normalize("example_url"))
    j = j.withColumn("kind", F.when(F.col("url") == F.col("example_url"), 0).otherwise(1))
    return j.groupBy("example_id", "example_url").agg(
        F.min_by("pos", F.struct("kind", "pos")).alias("match_pos"),
        F.when(F.min("kind") == 0, "exact").otherwise("host_path").alias("match_kind"))


@register("enhanced_urls", oracle=f"""
WITH {SQL_LINKS}, {SQL_EXAMPLES}, {SQL_SIBLINGS}
SELECT DISTINCT * FROM (SELECT example_id AS page_id, example_url AS url FROM examples
                        UNION ALL SELECT page_id, url FROM siblings)""")
def enhanced_urls(spark, sf_dir):
    _, ex, s = _siblings(spark, sf_dir)
    given = ex.select(F.col("example_id").alias("page_id"), F.col("example_url").alias("url"))
    return given.unionByName(s.select("page_id", "url")).distinct()


def _conf_sql(n):
    return (f"least((CASE WHEN {n} > 0 THEN 0.3e0 ELSE 0.0e0 END) + (CASE WHEN {n} > 2 THEN 0.2e0 ELSE 0.0e0 END)"
            f" + (CASE WHEN {n} > 5 THEN 0.1e0 ELSE 0.0e0 END), 1.0e0)")


@register("best_sibling_result", oracle=f"""
WITH {SQL_LINKS}, {SQL_EXAMPLES}, {SQL_SIBLINGS},
res AS (
  SELECT e.example_id, {D.host('e.main_url')} AS site, count(s.url) AS n_siblings
  FROM examples e LEFT JOIN siblings s ON s.page_id = e.example_id GROUP BY 1, 2
)
SELECT site, example_id, n_siblings, round(conf, 6) AS confidence FROM (
  SELECT *, {_conf_sql('n_siblings')} AS conf,
         row_number() OVER (PARTITION BY site ORDER BY {_conf_sql('n_siblings')} DESC, example_id) AS rn FROM res)
WHERE rn = 1""")
def best_sibling_result(spark, sf_dir):
    from pyspark.sql import Window
    _, ex, s = _siblings(spark, sf_dir)
    n = s.groupBy(F.col("page_id").alias("example_id")).agg(F.count("*").alias("n_siblings"))
    res = ex.join(n, "example_id", "left").select(
        "example_id", U.url_host("main_url").alias("site"),
        F.coalesce("n_siblings", F.lit(0)).alias("n_siblings"))
    c = F.col("n_siblings")
    conf = F.least(F.when(c > 0, 0.3).otherwise(0.0) + F.when(c > 2, 0.2).otherwise(0.0)
                   + F.when(c > 5, 0.1).otherwise(0.0), F.lit(1.0))
    res = res.withColumn("conf", conf)
    w = Window.partitionBy("site").orderBy(F.desc("conf"), "example_id")
    return res.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(
        "site", "example_id", "n_siblings", F.round("conf", 6).alias("confidence"))


@register("pagination_total", oracle=f"""
WITH {SQL_LINKS},
x AS (
  SELECT {D.host('page_url')} AS host, url,
         regexp_extract(url, '(?i)page[=/](\\d+)', 1) AS n1, regexp_extract(url, '(?i)p=(\\d+)', 1) AS n2
  FROM (SELECT page_url, page_url AS url FROM links UNION ALL SELECT page_url, url FROM links)
)
SELECT host, coalesce(max(TRY_CAST(CASE WHEN n1 <> '' THEN n1 WHEN n2 <> '' THEN n2 END AS BIGINT)), count(*)) AS total_pages
FROM x GROUP BY host""")
def pagination_total(spark, sf_dir):
    lk = _links(spark, sf_dir)
    both = lk.select("page_url", F.col("page_url").alias("url")).unionByName(lk.select("page_url", "url"))
    return L.pagination_total(both.withColumn("host", U.url_host("page_url")), keys=("host",))
