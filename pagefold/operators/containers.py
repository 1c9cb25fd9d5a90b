"""List-container discovery and sibling links.

The reference climbs the DOM from the anchor of an example URL and scores
every list container on the way.  Relationally: the anchor's ancestor list
is exploded into candidate containers, the page's links are exploded over
*their* ancestor lists, and the two meet in an equi-join on (page_id,
container_id) -- "all links under each ancestor" without a range join.
Every aggregate is keyed by (example, container); the largest group is the
link set of one container of one page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagefold.session import materialize

from pagefold.functions import html as H
from pagefold.functions import url as U
from pagefold.operators import dom as M
from pagefold.operators import links as L

# Container score / confidence words.
SCORE_WORDS = ["content", "news", "article", "list", "items", "entries", "posts"]
CONFIDENCE_WORDS = ["list", "items", "entries", "posts", "articles", "news"]
READ_MORE = ["weiterlesen", ">> weiterlesen", "weiterlesen >>"]


def dom_links(nodes_t: DataFrame, pages: DataFrame) -> DataFrame:
    """a[href] elements with resolved URL, trimmed text and content flag."""
    a = nodes_t.filter((F.col("tag") == "a") & F.map_contains_key("attrs", "href"))
    a = a.join(pages.select("page_id", F.col("url").alias("page_url")), "page_id")
    a = a.select("page_id", "node_id", "ancestors", "page_url",
                 F.col("attrs")["href"].alias("href"), H.js_trim(F.coalesce("text_content", F.lit(""))).alias("text"))
    a = a.withColumn("url", U.url_resolve("href", "page_url"))
    return a.withColumn("is_content", L.link_is_content("url", "text"))


def example_anchor(links: DataFrame, examples: DataFrame) -> DataFrame:
    """``example_link_match`` on the DOM: first anchor (document order) whose
    normalized URL equals the example's."""
    ex = examples.select("example_id", F.col("page_id"), "example_url",
                         U.url_normalize("example_url").alias("_k"))
    lk = links.select("page_id", "node_id", "ancestors", U.url_normalize("url").alias("_k"))
    j = ex.join(lk, ["page_id", "_k"])
    return j.groupBy("example_id", "page_id", "example_url").agg(
        F.min_by(F.struct("node_id", "ancestors"), "node_id").alias("a")).select(
        "example_id", "page_id", "example_url", F.col("a.node_id").alias("anchor_id"),
        F.col("a.ancestors").alias("anchor_ancestors"))


def container_stats(anchors: DataFrame, nodes_t: DataFrame, links: DataFrame) -> DataFrame:
    """Per (example, ancestor container below body): list flag, score terms
    and link statistics (``container_score`` inputs)."""
    body_ids = nodes_t.filter(F.col("tag").isin("body", "html")).select("page_id", F.col("node_id").alias("stop_id"))
    cand = anchors.select("example_id", "page_id", "example_url",
                          F.posexplode("anchor_ancestors").alias("lvl", "container_id"))
    cand = cand.join(body_ids, (cand["page_id"] == body_ids["page_id"]) & (cand["container_id"] == body_ids["stop_id"]),
                     "left_anti")
    lists = M.is_list_container(nodes_t).select("page_id", F.col("node_id").alias("container_id"), "is_list")
    info = nodes_t.select("page_id", F.col("node_id").alias("container_id"), F.col("tag").alias("c_tag"),
                          F.col("class").alias("c_class"), F.col("id").alias("c_id"),
                          F.col("child_count").alias("c_children"))
    cand = cand.join(lists, ["page_id", "container_id"]).join(info, ["page_id", "container_id"])
    # What is asked of a link is worked out once per link and example, before it is repeated for its ancestors.
    la = links.select("page_id", "url", "text", "is_content", "ancestors").join(
        anchors.select("example_id", "page_id", "example_url"), "page_id")
    la = la.withColumn("sim", U.url_similarity("url", "example_url")).select(
        "example_id", "url", "is_content", "sim", F.lower("text").isin(READ_MORE).alias("more"),
        F.explode("ancestors").alias("container_id"))
    j = cand.select("example_id", "container_id").join(la, ["example_id", "container_id"])
    per_url = j.groupBy("example_id", "container_id", "url").agg(
        F.count("*").alias("n_anchor"), F.bool_or("is_content").alias("content"),
        F.max("sim").alias("sim"),
        F.count_if("more").alias("n_read_more"))
    agg = per_url.groupBy("example_id", "container_id").agg(
        F.sum("n_anchor").alias("all_links"),
        F.count_if("content").alias("content_links"),
        F.count_if(F.col("content") & (F.col("sim") >= 0.5)).alias("similar_links"),
        F.sum("n_read_more").alias("read_more"),
        F.bool_and(~F.col("content") | F.col("url").contains(".htm")).alias("all_htm"))
    out = cand.join(agg, ["example_id", "container_id"], "left")
    return out.fillna(0, ["all_links", "content_links", "similar_links", "read_more"]).fillna(True, ["all_htm"])


def container_score(stats: DataFrame) -> DataFrame:
    """``container_score``: link ratio, keywords, tag, children,
    'weiterlesen' and .htm terms, clamped to [0, 1]."""
    c = F.col
    ratio = F.when(c("all_links") > 0, c("content_links") / c("all_links")).otherwise(F.lit(0.0))
    cls, idl = F.lower(F.coalesce("c_class", F.lit(""))), F.lower(F.coalesce("c_id", F.lit("")))
    kw = F.lit(False)
    for w in SCORE_WORDS:
        kw = kw | cls.contains(w) | idl.contains(w)
    n = c("c_children")
    score = (F.when((ratio >= 0.3) & (ratio <= 0.8), ratio * 0.4).when(ratio > 0.8, 0.2).otherwise(0.0)
             + F.when(kw, 0.3).otherwise(0.0)
             + F.when(c("c_tag").isin("main", "article", "section"), 0.2).when(c("c_tag").isin("ul", "ol"), 0.15)
             .when(c("c_tag") == "div", 0.1).otherwise(0.0)
             + F.when(n > 200, -0.3).when(n > 100, -0.2).when((n >= 3) & (n <= 50), 0.1).otherwise(0.0)
             + F.when(c("read_more") > 0, 0.2).otherwise(0.0)
             + F.when(c("all_htm") & (c("content_links") >= 3), 0.15).otherwise(0.0))
    return stats.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def container_find(stats: DataFrame) -> DataFrame:
    """``container_find``: qualifying list containers (2-20 unique content
    links, >= 1 similar); adjusted score +0.3 specific class, +0.2 when more
    than half are similar, +0.1 for <= 10 links; best wins, nearest on ties."""
    c = F.col
    s = container_score(stats).filter(c("is_list") & (c("content_links") >= 2) & (c("content_links") <= 20)
                                      & (c("similar_links") >= 1))
    cls = F.coalesce("c_class", F.lit(""))
    adj = (c("score") + F.when(cls.contains("teaser") | cls.contains("list") | cls.contains("article"), 0.3)
           .otherwise(0.0) + F.when(c("similar_links") > c("content_links") * 0.5, 0.2).otherwise(0.0)
           + F.when(c("content_links") <= 10, 0.1).otherwise(0.0))
    s = s.withColumn("adjusted_score", adj).filter(c("adjusted_score") > 0)
    w = Window.partitionBy("example_id").orderBy(F.desc("adjusted_score"), F.desc("lvl"))
    return s.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def container_links(best: DataFrame, links: DataFrame, include_external: bool = False) -> DataFrame:
    """``container_links`` (the no-model fallback): unique valid links under
    the chosen container, example removed, similarity >= 0.5 (municipal) /
    0.6; confidence 0.6."""
    la = links.select("page_id", "url", "node_id", F.explode("ancestors").alias("container_id"))
    j = best.select("example_id", "page_id", "container_id", "example_url").join(la, ["page_id", "container_id"])
    j = j.filter(L.link_scope_ok("url", "example_url", include_external))
    j = j.groupBy("example_id", "container_id", "example_url", "url").agg(F.min("node_id").alias("pos"))
    j = j.withColumn("score", U.url_similarity("url", "example_url")).withColumn(
        "threshold", F.when(U.url_municipal_pattern("url", "example_url"), 0.5).otherwise(0.6))
    return j.filter((F.col("url") != F.col("example_url")) & (F.col("score") >= F.col("threshold"))).drop("threshold")


def sibling_count(best: DataFrame, links: DataFrame) -> DataFrame:
    """``sibling_count``: unique valid links in the container (example
    excluded) over the adaptive threshold."""
    la = links.select("page_id", "url", F.explode("ancestors").alias("container_id"))
    j = best.select("example_id", "page_id", "container_id", "example_url").join(la, ["page_id", "container_id"])
    j = j.filter(U.url_valid("url") & (F.col("url") != F.col("example_url"))).select(
        "example_id", "url", "example_url").distinct()
    j = j.filter(U.url_similarity("url", "example_url")
                 >= F.when(U.url_municipal_pattern("url", "example_url"), 0.5).otherwise(0.6))
    cnt = j.groupBy("example_id").agg(F.count("*").alias("sibling_links"))
    return best.select("example_id").join(cnt, "example_id", "left").fillna(0, ["sibling_links"])


def container_confidence(best: DataFrame, counts: DataFrame) -> DataFrame:
    """``container_confidence``: sibling, child-count, tag and keyword steps, cap 1."""
    c = F.col
    j = best.join(counts, "example_id")
    cls = F.lower(F.coalesce("c_class", F.lit("")))
    kw = F.lit(False)
    for w in CONFIDENCE_WORDS:
        kw = kw | cls.contains(w)
    s, n = c("sibling_links"), c("c_children")
    conf = (F.when(s > 0, 0.3).otherwise(0.0) + F.when(s > 2, 0.2).otherwise(0.0) + F.when(s > 5, 0.1).otherwise(0.0)
            + F.when(n >= 5, 0.2).otherwise(0.0) + F.when(n >= 10, 0.1).otherwise(0.0)
            + F.when(c("c_tag").isin("ul", "ol"), 0.1).otherwise(0.0) + F.when(kw, 0.1).otherwise(0.0))
    return j.withColumn("confidence", F.least(conf, F.lit(1.0)))


def sibling_discovery(nodes_t: DataFrame, pages: DataFrame, examples: DataFrame, limit: int = 10,
                      links: DataFrame | None = None) -> DataFrame:
    """``sibling_discovery``: example -> container -> ranked sibling links.

    Output per example: signature, container confidence, method, links (top
    ``limit`` by similarity, first position on ties).  Examples whose anchor
    or container is not found yield no links (the reference's same-page and
    parent-page fallbacks return none).  ``links``: the pages' ``dom_links``, where
    the caller has written them already."""
    # Links and the one container per example are read several times below: each is written once.
    links = materialize(dom_links(nodes_t, pages), "dom-links") if links is None else links
    examples = materialize(examples, "examples")
    anchors = materialize(example_anchor(links, examples), "example-anchors")
    best = materialize(container_find(container_stats(anchors, nodes_t, links)), "containers")
    best = best.withColumn("signature", F.format_string(
        "%s.%s#%s[%d]", F.col("c_tag"), F.coalesce("c_class", F.lit("")), F.coalesce("c_id", F.lit("")),
        F.col("c_children")))
    sib = container_links(best, links)
    w = Window.partitionBy("example_id").orderBy(F.desc("score"), "pos")
    ranked = sib.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    agg = ranked.groupBy("example_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda s: s["url"]).alias("links"))
    res = examples.select("example_id").join(best.select("example_id", "container_id", "signature",
                                                         "adjusted_score"), "example_id", "left") \
        .join(agg, "example_id", "left")
    links_col = F.coalesce("links", F.array().cast("array<string>"))
    return res.select(
        "example_id", "container_id", "signature", links_col.alias("links"), F.size(links_col).alias("n_links"),
        F.when(F.col("container_id").isNotNull(), "category-page").otherwise("none").alias("method"),
        F.when(F.size(links_col) > 0, F.lit(0.6)).otherwise(F.lit(0.0)).alias("confidence"))


def container_dedupe(results: DataFrame, site_col: str = "site", order_col: str = "example_id") -> DataFrame:
    """``container_dedupe``: first result per (site, container signature);
    results without a signature are always kept."""
    signed = results.filter(F.col("signature").isNotNull())
    # The first row per key by a map-side combined aggregate; unsigned rows move nowhere.
    rest = [c for c in results.columns if c not in (site_col, "signature")]
    first = signed.groupBy(site_col, "signature").agg(F.min_by(F.struct(*rest), order_col).alias("_f"))
    return results.filter(F.col("signature").isNull()).unionByName(
        first.select(site_col, "signature", "_f.*").select(*results.columns))


# Pagination selectors in priority order and next-link rules.
PAGINATION_SELECTORS = [
    ".pagination a[href]", ".pager a[href]", ".page-numbers a[href]", ".paginate a[href]", ".page-nav a[href]",
    'a[rel="next"]', 'a[rel="prev"]', 'a[aria-label*="next" i]', 'a[aria-label*="previous" i]',
    'a[href*="seite"]', 'a[href*="page"]', 'a[href*="skip"]', 'a[href*="offset"]',
    'a[href*="&p="]', 'a[href*="?p="]', 'a[href*="&page="]', 'a[href*="?page="]',
]


def pagination_detect(nodes_t: DataFrame, pages: DataFrame) -> DataFrame:
    """``pagination_detect`` + ``pagination_next``: the first selector (in
    priority order) that yields valid links wins; its unique resolved links
    are the pagination links.  The next-link selector comes from the first
    matching selector that contains a 'next' link."""
    spark = nodes_t.sparkSession
    steps = M.selector_table(spark, {f"{i:02d}": s for i, s in enumerate(PAGINATION_SELECTORS)})
    hits = M.selector_match(nodes_t, steps).withColumn("sel_idx", F.col("sel_id").cast("int"))
    a = nodes_t.select("page_id", "node_id", "attrs", "class", F.lower(H.js_trim(F.coalesce("text_content", F.lit(""))))
                       .alias("lt"), H.js_trim(F.coalesce("text_content", F.lit(""))).alias("txt"))
    h = hits.join(a, ["page_id", "node_id"]).join(pages.select("page_id", F.col("url").alias("page_url")), "page_id")
    h = h.withColumn("href", F.col("attrs")["href"]).withColumn("url", U.url_resolve("href", "page_url"))
    aria = F.lower(F.coalesce(F.try_element_at("attrs", F.lit("aria-label")), F.lit("")))
    cls = F.lower(F.coalesce("class", F.lit("")))
    rel = F.lower(F.coalesce(F.try_element_at("attrs", F.lit("rel")), F.lit("")))
    is_next = (F.col("lt").contains("next") | F.col("lt").contains("weiter") | F.col("lt").contains("››")
               | (F.col("lt") == ">") | aria.contains("next") | aria.contains("weiter") | cls.contains("next")
               | cls.contains("pn_next") | (rel == "next"))
    h = h.withColumn("is_next", is_next).withColumn("ok", F.col("href").isNotNull() & U.url_valid("url"))
    win = h.filter("ok").groupBy("page_id").agg(F.min("sel_idx").alias("win_idx"))
    # first selector (by priority) with any match -> its first next link
    nxt = h.filter("is_next").groupBy("page_id", "sel_idx").agg(
        F.min_by(F.struct("class", F.col("attrs")["rel"].alias("rel"), "txt", "url"), "node_id").alias("n"))
    firsts = h.groupBy("page_id").agg(F.min("sel_idx").alias("first_idx"))
    sel_list = F.array(*[F.lit(s) for s in PAGINATION_SELECTORS])
    base_sel = F.regexp_replace(F.element_at(sel_list, F.col("sel_idx") + 1), " a\\[href\\]", "")
    nclass = F.coalesce("n.class", F.lit(""))
    next_cls = F.try_element_at(F.filter(F.split(nclass, " "), lambda c: c.contains("next")), F.lit(1))
    next_sel = (F.when(F.col("n.rel") == "next", F.concat(base_sel, F.lit(' a[rel="next"]')))
                .when(nclass.contains("next") & next_cls.isNotNull(), F.concat(base_sel, F.lit(" a."), next_cls))
                .when(nclass.contains("next"), F.lit(None).cast("string"))
                .when(nclass.contains("pn_next"), F.concat(base_sel, F.lit(" .pn_next")))
                .otherwise(F.element_at(sel_list, F.col("sel_idx") + 1)))
    # the next selector is set by the first selector (up to the winner) whose matches include a next link
    cand = nxt.join(firsts, "page_id").join(win, "page_id", "left").filter(
        F.col("win_idx").isNull() | (F.col("sel_idx") <= F.col("win_idx")))
    cand = cand.select("page_id", "sel_idx", next_sel.alias("next_selector"), F.col("n.url").alias("next_url"))
    first_next = cand.filter(F.col("next_selector").isNotNull()).groupBy("page_id").agg(
        F.min_by(F.struct("next_selector", "next_url"), "sel_idx").alias("x"))
    links = h.filter("ok").join(win, "page_id").filter(F.col("sel_idx") == F.col("win_idx")).groupBy(
        "page_id", "url").agg(F.min("node_id").alias("pos"))
    agg = links.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "url"))),
                                                   lambda s: s["url"]).alias("pagination_links"))
    out = pages.select("page_id").join(win, "page_id", "left").join(agg, "page_id", "left") \
        .join(first_next, "page_id", "left")
    sel = F.when(F.col("win_idx").isNotNull(), F.element_at(sel_list, F.col("win_idx") + 1))
    return out.select("page_id", sel.alias("selector"),
                      F.coalesce("pagination_links", F.array().cast("array<string>")).alias("pagination_links"),
                      F.col("x.next_selector").alias("next_selector"), F.col("x.next_url").alias("next_url"))


def pagination_walk(edges: DataFrame, page_ids: DataFrame, max_pages: int | None = None) -> DataFrame:
    """``pagination_walk``: follow next links from each start page (one that
    nobody links to) until there is none.

    Without ``max_pages`` a walk also ends at a page it has visited.  With it,
    at most that many pages are visited and a cycle repeats pages, as in the
    reference.

    Pointer doubling: round k knows each walk's first 2^k pages and the jump
    table next^(2^k); one join adds the next 2^k pages.  Only walks that still
    move take part, and the rounds stop when none does, so the work follows the
    pages visited and the logarithm of the longest walk.
    """
    jump = materialize(edges.select(F.col("page_id").alias("src"), F.col("next_page_id").alias("dst")), "walk-edges")
    walk = page_ids.select(F.col("page_id").alias("start_id")).distinct().join(
        jump.select(F.col("dst").alias("start_id")).distinct(), "start_id", "left_anti").select(
        "start_id", F.lit(1).alias("depth"), F.col("start_id").alias("page_id"))
    walk = materialize(walk, "walk")
    length, pages = 1, -1
    while True:
        ahead = walk.join(jump, walk["page_id"] == jump["src"]).select(
            "start_id", (F.col("depth") + length).alias("depth"), F.col("dst").alias("page_id"))
        both = walk.unionByName(ahead)
        if max_pages is None:
            both = both.groupBy("start_id", "page_id").agg(F.min("depth").alias("depth"))
        else:
            both = both.filter(F.col("depth") <= max_pages).distinct()
        walk = materialize(both.select("start_id", "depth", "page_id"), "walk")
        seen, pages = pages, walk.count()
        length *= 2
        if pages == seen or (max_pages is not None and length >= max_pages):
            return walk
        a, b = jump.alias("a"), jump.alias("b")
        jump = materialize(a.join(b, F.col("a.dst") == F.col("b.src")).select(
            F.col("a.src"), F.col("b.dst")).distinct(), "walk-jumps")


def frontier_schedule(requests: DataFrame, delays: DataFrame, bucket: int = 100_000) -> DataFrame:
    """``frontier_schedule``: per-host fetch slots -- position in the host's
    queue (priority, id) times the host's delay.

    The position is a distributed rank, so one host with a third of all
    pages is not sorted in one task: rows are ranked inside fixed-width id
    buckets (host, priority, page_id div ``bucket``) and each bucket's local
    rank is offset by the sizes of the host's earlier buckets (a small
    per-bucket count table).  Buckets are a pure function of the row."""
    r = requests.withColumn("_b", F.floor(F.col("page_id") / F.lit(bucket)).cast("long"))
    w = Window.partitionBy("host", "priority", "_b").orderBy("page_id")
    r = r.withColumn("_local", F.row_number().over(w) - 1)
    counts = r.groupBy("host", "priority", "_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy("host").orderBy("priority", "_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    r = r.join(offs, ["host", "priority", "_b"]).withColumn("slot", F.col("_local") + F.col("_off"))
    r = r.join(delays, "host", "left").withColumn("delay_ms", F.coalesce("delay_ms", F.lit(1000)))
    return r.withColumn("fetch_offset_ms", F.col("slot") * F.col("delay_ms")).drop("_b", "_local", "_off")


EVAL_WORDS = ["list", "items", "container", "grid", "news", "articles", "posts", "teaser"]


def container_candidate_eval(anchors: DataFrame, nodes_t: DataFrame, links: DataFrame) -> DataFrame:
    """``container_candidate_eval`` (older scorer): for each ancestor of the
    example anchor below <html>: structure score from valid link count, tag
    and class words, plus 0.4 x share of links similar (> 0.5) to the
    example; best total wins, nearest on ties."""
    c = F.col
    html_ids = nodes_t.filter(F.col("tag") == "html").select("page_id", F.col("node_id").alias("stop_id"))
    cand = anchors.select("example_id", "page_id", "example_url", "anchor_id",
                          F.posexplode("anchor_ancestors").alias("lvl", "container_id"))
    cand = cand.join(html_ids, (cand["page_id"] == html_ids["page_id"]) & (cand["container_id"] == html_ids["stop_id"]),
                     "left_anti")
    info = nodes_t.select("page_id", F.col("node_id").alias("container_id"), F.col("tag").alias("c_tag"),
                          F.col("class").alias("c_class"))
    cand = cand.join(info, ["page_id", "container_id"])
    # Links are judged once per example and counted page by page; a container then meets one row of counts.
    key = ["example_id", "page_id", "example_url"]
    la = links.select("page_id", "url", "node_id", "ancestors").join(anchors.select(*key, "anchor_id").distinct(), "page_id")
    la = la.filter((c("node_id") != c("anchor_id")) & U.url_valid("url"))
    la = la.withColumn("near", U.url_similarity("url", "example_url") > 0.5).select(
        *key, "anchor_id", "near", F.explode("ancestors").alias("container_id"))
    counts = la.groupBy(*key, "anchor_id", "container_id").agg(F.count("*").alias("n"), F.count_if("near").alias("n_near"))
    agg = cand.join(counts, [*key, "anchor_id", "container_id"]).groupBy("example_id", "container_id").agg(
        F.sum("n").alias("valid_links"), F.sum("n_near").alias("similar"))
    s = cand.join(agg, ["example_id", "container_id"], "left").fillna(0, ["valid_links", "similar"])
    n = c("valid_links")
    cls = F.lower(F.coalesce("c_class", F.lit("")))
    kw = F.lit(False)
    for w in EVAL_WORDS:
        kw = kw | cls.contains(w)
    structure = (F.when(n >= 2, 0.3).otherwise(0.0) + F.when(n >= 5, 0.2).otherwise(0.0)
                 + F.when(n >= 10, 0.1).otherwise(0.0)
                 + F.when(c("c_tag").isin("ul", "ol"), 0.2).when(c("c_tag").isin("div", "section", "article"), 0.1)
                 .otherwise(0.0) + F.when(kw, 0.2).otherwise(0.0))
    content = c("similar") / F.greatest(n, F.lit(1)) * 0.4
    s = s.withColumn("structure_score", structure).withColumn("content_score", content).withColumn(
        "total_score", structure + content).filter(c("total_score") > 0)
    w = Window.partitionBy("example_id").orderBy(F.desc("total_score"), F.desc("lvl"))
    return s.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
