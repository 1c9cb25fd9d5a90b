"""Link operators over the page table (tier N: pure column expressions).

``link_extract`` is the regex fast path: one ``regexp_extract_all`` per page
plus a ``posexplode`` -- a narrow, map-only stage.  Everything after it is
projections, one dedupe window keyed by (page, url), and aggregations keyed by
host.  Pages are never grouped into one task: every shuffle key is at least
(page_id, ...) or host, and host aggregates are partial+final.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefold.functions import html as H
from pagefold.functions import url as U

# href in double or single quotes; the inner HTML up to the next </a>.
ANCHOR_RE = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"'>]*)["'][^>]*>(.*?)</a>"""


def link_extract(pages: DataFrame) -> DataFrame:
    """``link_extract``: every ``a[href]`` with its text, in document order.

    Output: page_id, page_url, pos (0-based), href, text.
    """
    hrefs = F.regexp_extract_all("html", F.lit(ANCHOR_RE), 1)
    inners = F.regexp_extract_all("html", F.lit(ANCHOR_RE), 2)
    return (
        pages.select("page_id", F.col("url").alias("page_url"),
                     F.arrays_zip(hrefs.alias("href"), inners.alias("inner")).alias("a"))
        .select("page_id", "page_url", F.posexplode("a").alias("pos", "a"))
        .select("page_id", "page_url", "pos", F.col("a.href").alias("href"),
                F.trim(F.regexp_replace(H.strip_tags(F.col("a.inner")), r"\s+", " ")).alias("text"))
    )


# Content-link rules (exclusions, keywords, content paths).
NON_CONTENT_PATHS = [
    "/search", "/suche", "/login", "/anmelden", "/register", "/registrieren",
    "/contact", "/kontakt", "/about", "/ueber", "/privacy", "/datenschutz",
    "/impressum", "/sitemap", "/rss", "/feed", "/admin", "/cms",
]
CONTENT_TEXT_WORDS = [
    "bericht", "sitzung", "beschluss", "veranstaltung", "meldung", "nachricht",
    "tagesordnung", "protokoll", "ausschuss", "gemeinderat", "stadtrat",
    "öffentlich", "oeffentlich",
]
CONTENT_URL_WORDS = [
    "tagesordnung", "sitzung", "beschluss", "protokoll", "ausschuss",
    "gemeinderat", "stadtrat", "oeffentlich", "öffentlich",
]
CONTENT_PATHS = ["/aktuelles/", "/news/", "/artikel/", "/meldungen/", "/termine/", "/veranstaltungen/"]
DATE_IN_URL = [r"\d{4}[-_]\d{2}[-_]\d{2}", r"\d{2}[-_.]\d{2}[-_.]\d{4}", r"\d{1,2}[+.]\d{1,2}[+.]\d{4}"]


def _any_contains(col: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | col.contains(w)
    return out


def link_is_content(href, text) -> Column:
    """``link_is_content``: exclusions first, then any content signal.

    Case-sensitive on purpose (the reference tests the raw strings).
    """
    h = U._c(href)
    t = F.coalesce(U._c(text), F.lit(""))
    tl = F.length(t)
    excluded = _any_contains(h, NON_CONTENT_PATHS)
    signals = (
        h.rlike(r"\d{4}\.htm")  # covers the 4-, 5- and 6-digit id forms
        | ((tl > 15) & _any_contains(t, CONTENT_TEXT_WORDS))
        | _any_contains(h, CONTENT_URL_WORDS)
        | _any_contains(h, CONTENT_PATHS)
        | ((tl > 10) & h.contains(".htm"))
        | F.greatest(*[h.rlike(p) for p in DATE_IN_URL])
        | (tl > 20)
    )
    return F.coalesce(~excluded & signals, F.lit(False))


def link_scope_ok(link, example, include_external: bool = False) -> Column:
    """``link_scope_filter``: http(s) only, same host unless external allowed."""
    ok = U.url_valid(link) & U.url_scheme(link).isin("http", "https") & U.url_valid(example)
    if not include_external:
        ok = ok & (U.url_host(link) == U.url_host(example))
    return ok


def link_dedupe(links: DataFrame, keys=("page_id",), keep: str = "first") -> DataFrame:
    """``link_dedupe``: one row per (keys, url) at its first position.

    ``keep='last_text'`` keeps the first position but the text of the last
    occurrence (the Map-based variant).
    """
    w = Window.partitionBy(*keys, "url").orderBy("pos")
    out = links.withColumn("_rn", F.row_number().over(w))
    if keep == "last_text":
        last = links.groupBy(*keys, "url").agg(F.max_by("text", "pos").alias("_last_text"))
        out = out.join(last, [*keys, "url"]).withColumn("text", F.col("_last_text")).drop("_last_text")
    return out.filter("_rn = 1").drop("_rn")


def resolved_links(pages: DataFrame) -> DataFrame:
    """link_extract + url_resolve against the page URL."""
    return U.with_resolved(link_extract(pages), "href", "page_url", "url")


def host_link_report(pages: DataFrame) -> DataFrame:
    """Flagship (M0): which hosts expose the most distinct content links.

    pages -> links -> resolve -> dedupe per page -> content rule and
    similarity to the page URL -> per-host aggregate.
    """
    links = link_dedupe(resolved_links(pages.select("page_id", "url", "html")))
    scored = links.select(
        U.url_host_or_self("page_url").alias("host"),
        "page_id", "url",
        link_is_content("url", "text").alias("is_content"),
        U.url_similarity("url", "page_url").alias("sim"),
        (U.url_host("url") == U.url_host("page_url")).alias("internal"),
    )
    return scored.groupBy("host").agg(
        F.countDistinct("page_id").alias("n_pages"),
        F.count("*").alias("n_links"),
        F.countDistinct("url").alias("n_distinct_links"),
        F.count_if("is_content").alias("n_content_links"),
        F.count_if("internal").alias("n_internal_links"),
        F.round(F.avg("sim"), 6).alias("avg_similarity"),
    )


def link_is_likely_content(href, text) -> Column:
    """``link_is_likely_content``: light executor filter (lower-cased URL).

    Empty (falsy) text skips the text rule, as in the reference.
    """
    h = F.lower(U._c(href))
    t = U._c(text)
    lt = F.trim(F.lower(t))
    bad_text = (t.isNotNull() & (t != "")) & (((F.length(lt) == 1) & lt.isin(">", "<", "→", "←")) | (lt == ""))
    return F.coalesce(~_any_contains(h, LIGHT_DENY) & ~bad_text, F.lit(False))


# Light filter deny list (URL fragments).
LIGHT_DENY = ["javascript:", "#", "/login", "/register", "/contact", "/kontakt",
              "/imprint", "/impressum", "/privacy", "/datenschutz"]

# Strict (deprecated) filter deny lists.
STRICT_DENY_URL = [
    "/page/", "/seite/", "?page=", "&page=", "/next", "/prev", "/previous", "/weiter",
    "/zurück", "/back", "javascript:", "#", "/search", "/suche", "/filter", "/sort",
    "/login", "/register", "/contact", "/kontakt", "/imprint", "/impressum", "/privacy",
    "/datenschutz", "/share", "/teilen", "/print", "/drucken", "/edit", "/bearbeiten",
    "/delete", "/löschen",
]
STRICT_DENY_TEXT = [
    "next", "previous", "prev", "weiter", "zurück", "back", "mehr", "more", "alle", "all",
    "share", "teilen", "print", "drucken", "edit", "bearbeiten", "delete", "löschen",
    ">>", "<<", ">", "<", "→", "←", "...",
]


def link_is_content_strict(href, text) -> Column:
    """``link_is_content_strict``: wide deny list on URL and text."""
    h = F.lower(U._c(href))
    t = U._c(text)
    lt = F.trim(F.lower(t))
    has_text = t.isNotNull() & (t != "")
    bad_text = has_text & (_any_contains(lt, STRICT_DENY_TEXT) | ((F.length(lt) < 3) & ~lt.rlike(r"\d")))
    return F.coalesce(~_any_contains(h, STRICT_DENY_URL) & ~bad_text, F.lit(False))


def derive_examples(pages: DataFrame) -> DataFrame:
    """Example fixture derived from pages: the second resolved link of each
    page is the example URL of that page (main_url = page URL)."""
    links = resolved_links(pages.select("page_id", "url", "html"))
    return links.filter("pos = 1").select(
        F.col("page_id").alias("example_id"), F.col("page_url").alias("main_url"),
        F.col("url").alias("example_url"))


def sibling_candidates(links: DataFrame, examples: DataFrame, include_external: bool = False) -> DataFrame:
    """``sibling_filter``: unique valid links of the example's page, example
    dropped, similarity >= 0.5 (municipal pattern) or 0.6.

    Equi-join on the page key first (no pairs across pages), then the
    similarity predicate on the joined rows.
    """
    lk = links.select("page_id", "pos", "url")
    ex = examples.select(F.col("example_id").alias("page_id"), "example_url")
    j = lk.join(ex, "page_id").filter(link_scope_ok("url", "example_url", include_external))
    j = j.groupBy("page_id", "example_url", "url").agg(F.min("pos").alias("pos"))
    j = j.withColumn("score", U.url_similarity("url", "example_url")).withColumn(
        "threshold", F.when(U.url_municipal_pattern("url", "example_url"), 0.5).otherwise(0.6))
    return j.filter((F.col("url") != F.col("example_url")) & (F.col("score") >= F.col("threshold"))).drop("threshold")


def sibling_rank(cands: DataFrame, k: int = 10) -> DataFrame:
    """``sibling_rank``: by similarity desc (stable on position), top k."""
    w = Window.partitionBy("page_id").orderBy(F.desc("score"), "pos")
    return cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def link_patterns(cands: DataFrame) -> DataFrame:
    """``link_patterns``: labels over a link set vs its example URL."""
    same_depth = F.size(F.split(U.url_path("url"), "/")) == F.size(F.split(U.url_path("example_url"), "/"))
    agg = cands.groupBy("page_id").agg(
        F.bool_and(F.col("url").rlike(r"\d{4,}")).alias("ids"),
        F.bool_or(F.col("url").rlike(r"\d{4}[-_]\d{2}[-_]\d{2}")).alias("dated"),
        F.bool_and(U.url_valid("url") & same_depth).alias("depth"),
    )
    labels = F.array_compact(F.array(
        F.when(F.col("ids"), F.lit("consistent-id-pattern")),
        F.when(F.col("dated"), F.lit("date-pattern")),
        F.when(F.col("depth"), F.lit("consistent-path-structure")),
    ))
    return agg.select("page_id", labels.alias("patterns"))


def pagination_total(links: DataFrame, keys=("page_id",)) -> DataFrame:
    """``pagination_total``: max page number in page=n / page/n / p=n, else link count."""
    n1 = F.regexp_extract("url", r"(?i)page[=/](\d+)", 1)
    n2 = F.regexp_extract("url", r"(?i)p=(\d+)", 1)
    num = F.when(n1 != "", n1).when(n2 != "", n2).try_cast("bigint")
    return links.groupBy(*keys).agg(
        F.coalesce(F.max(num), F.count("*")).alias("total_pages"))
