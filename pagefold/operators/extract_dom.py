"""Plan-driven extraction.

A plan names selectors (list, content link, pagination, one per detail field).  The
distinct selector *strings* are parsed once; all selectors of a plan are evaluated
inside its page (``page_local``), one projection over one scan of the pages, and every
match carries what the operators need of its element.  Field values are the first
match inside the list item (document order), found with an equi-join on the item id
against the match's ancestor list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagefold.functions import html as H
from pagefold.functions import url as U
from pagefold.operators import extraction as X
from pagefold.operators import links as L
from pagefold.operators import page_local as P
from pagefold.session import materialize

# Plan defaults of the plan factory.
DEFAULT_LIST = "article, .item, .post, .entry"
DEFAULT_TITLE = "h1, h2, .title, .headline"
DEFAULT_DESCRIPTION = "p, .description, .content, .summary"
DEFAULT_RATE_MS = 1000


def plan_selectors(plans: DataFrame) -> DataFrame:
    """(plan_id, role, field, selector) for every selector of every plan."""
    base = plans.select("plan_id", F.explode(F.array(
        F.struct(F.lit("list").alias("role"), F.lit(None).cast("string").alias("field"),
                 F.col("list_selector").alias("selector")),
        F.struct(F.lit("content").alias("role"), F.lit(None).cast("string").alias("field"),
                 F.col("content_link_selector").alias("selector")),
        F.struct(F.lit("pagination").alias("role"), F.lit(None).cast("string").alias("field"),
                 F.col("pagination_selector").alias("selector")))).alias("s")).select("plan_id", "s.*")
    det = plans.select("plan_id", F.explode("detail_selectors").alias("field", "selector")).select(
        "plan_id", F.lit("detail").alias("role"), "field", "selector")
    return base.unionByName(det).filter(F.col("selector").isNotNull() & (F.col("selector") != ""))


def plan_bundles(plans: DataFrame) -> DataFrame:
    """``plan_id, wanted``: the parsed selectors of each plan in one row."""
    named = plan_selectors(plans)
    return named.join(P.selector_steps(named), "selector").groupBy("plan_id").agg(
        F.collect_list(F.struct("role", "field", "alts")).alias("wanted"))


def first_link(nodes, item):
    """The first ``a[href]`` inside an element."""
    return F.get(F.filter(nodes, lambda n: (n["tag"] == "a") & F.map_contains_key(n["attrs"], "href") & F.array_contains(n["ancestors"], item)), 0)


def match_plan_selectors(pages: DataFrame, plans: DataFrame, page_col: str = "entry_page_id") -> DataFrame:
    """(plan_id, role, field, page_id, node_id, attrs, text_content, ancestors, link):
    every element of the plan's page matched by each of the plan's selectors; ``link``
    is the first link (href, text) inside a list element.  Only the plans' own pages
    are parsed; the result is written, as most operators read it several times."""
    at = plans.select("plan_id", F.col(page_col).alias("page_id"))
    own = pages.select("page_id", "html").join(at.select("page_id").distinct(), "page_id", "left_semi")
    found = P.page_trees(own).join(at.join(plan_bundles(plans), "plan_id"), "page_id").select(
        "plan_id", "page_id", "nodes", "text", F.explode("wanted").alias("w"))
    found = found.select("*", F.explode(P.matches(F.col("nodes"), F.col("w.alts"))).alias("node_id"))
    n, link = F.get(F.col("nodes"), F.col("node_id")), first_link(F.col("nodes"), F.col("node_id"))
    link = F.when((F.col("w.role") == "list") & link.isNotNull(), F.struct(link["attrs"]["href"].alias("href"), P.node_text(F.col("text"), link).alias("text")))
    return materialize(found.select(
        "plan_id", "w.role", "w.field", "page_id", "node_id", n["attrs"].alias("attrs"), P.node_text(F.col("text"), n).alias("text_content"),
        n["ancestors"].alias("ancestors"), link.alias("link")), "plan-matches")


def list_items(matches: DataFrame, max_items: int | None = None) -> DataFrame:
    """List elements of each plan in document order (``item_idx``), capped."""
    li = matches.filter(F.col("role") == "list").select("plan_id", "page_id", F.col("node_id").alias("item_id"))
    w = Window.partitionBy("plan_id").orderBy("item_id")
    li = li.withColumn("item_idx", F.row_number().over(w) - 1)
    return li.filter(F.col("item_idx") < max_items) if max_items else li


def _descendant_matches(items: DataFrame, matches: DataFrame) -> DataFrame:
    """Detail matches inside each item: match.ancestors contains item_id."""
    det = matches.filter(F.col("role") == "detail").select("plan_id", "field", "page_id", "node_id", "attrs", "text_content",
                                                           F.explode("ancestors").alias("item_id"))
    return items.join(det, ["plan_id", "page_id", "item_id"])


def extract_list_items(pages: DataFrame, plans: DataFrame, max_items: int | None = None) -> DataFrame:
    """``extract_list_items``: one record per list element with typed
    fields (first match inside the item); title and description required;
    then the executor's basic normalization.  A page that comes several times
    gives its items as often."""
    found = match_plan_selectors(pages, plans)
    times = found.filter(F.col("role") == "list").groupBy("plan_id", F.col("node_id").alias("item_id")).agg(F.count("*").cast("int").alias("times"))
    m = found.dropDuplicates(["plan_id", "role", "field", "page_id", "node_id"])
    items = list_items(m, max_items)
    d = _descendant_matches(items, m)
    first = d.groupBy("plan_id", "item_id", "item_idx", "page_id", "field").agg(
        F.min_by(F.struct("attrs", "text_content"), "node_id").alias("e"),
        F.transform(F.array_sort(F.collect_list(F.struct("node_id", F.col("attrs")["src"].alias("src"),
                                                          "text_content"))), lambda s: s).alias("all"))
    base = plans.select("plan_id", F.col("entry_url").alias("page_url"))
    first = first.join(base, "plan_id")
    text = H.js_trim(F.col("e.text_content"))
    f = F.col("field")
    val = (F.when(f == "website", U.url_resolve(F.col("e.attrs")["href"], F.col("page_url")))
           .when(f.isin("price", "discountPrice"), X.parse_price(F.col("e.text_content")).cast("string"))
           .when(f.isin("longitude", "latitude"), X.parse_coordinate(F.col("e.text_content")).cast("string"))
           .when(f == "zipcode", X.parse_zipcode(F.col("e.text_content")).cast("string"))
           .when(f.isin("startDate", "endDate"), X.Q.iso(X.Q.parse_date(F.col("e.text_content"))))
           .otherwise(F.when(text != "", text)))
    arrays = (F.when(f == "images", F.transform(F.filter("all", lambda s: s["src"].isNotNull()),
                                               lambda s: U.url_resolve(s["src"], F.col("page_url"))))
              .when(f == "dates", F.filter(F.transform("all", lambda s: X.Q.iso(X.Q.parse_date(s["text_content"]))),
                                           lambda x: x.isNotNull())))
    kv = first.select("plan_id", "item_id", "item_idx", "page_id", "field", val.alias("v"), arrays.alias("arr"))
    g = kv.groupBy("plan_id", "item_id", "item_idx", "page_id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("field", "v")))).alias("f"),
        F.max(F.when(F.col("field") == "images", F.col("arr"))).alias("images"),
        F.max(F.when(F.col("field") == "dates", F.col("arr"))).alias("dates"))
    out = g.select("plan_id", "item_id", "item_idx", "page_id",
                   F.col("f")["title"].alias("title"), F.col("f")["description"].alias("description"),
                   F.col("f")["place"].alias("place"), F.col("f")["address"].alias("address"),
                   F.col("f")["email"].alias("email"), F.col("f")["phone"].alias("phone"),
                   F.col("f")["website"].alias("website"), F.col("f")["startDate"].alias("startDate"),
                   F.col("f")["endDate"].alias("endDate"), F.col("f")["price"].try_cast("double").alias("price"),
                   F.coalesce("dates", F.array().cast("array<string>")).alias("dates"),
                   F.coalesce("images", F.array().cast("array<string>")).alias("images"),
                   F.lit(None).cast("string").alias("createdAt"))
    out = out.filter(F.col("title").isNotNull() & F.col("description").isNotNull())
    out = out.join(times, ["plan_id", "item_id"]).withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")
    return X.item_normalize_basic(out)


def content_urls_by_selector(pages: DataFrame, plans: DataFrame, max_urls: int | None = None) -> DataFrame:
    """``content_urls_by_selector``: unique absolute hrefs of the content-link
    selector in document order, optionally capped."""
    m = match_plan_selectors(pages, plans).filter(F.col("role") == "content")
    a = m.join(pages.select("page_id", F.col("url").alias("page_url")), "page_id")
    a = a.filter(F.map_contains_key("attrs", "href")).withColumn("url", U.url_resolve(F.col("attrs")["href"],
                                                                                     F.col("page_url")))
    u = a.groupBy("plan_id", "url").agg(F.min("node_id").alias("pos"))
    w = Window.partitionBy("plan_id").orderBy("pos")
    u = u.withColumn("rank", F.row_number().over(w))
    return u.filter(F.col("rank") <= max_urls) if max_urls else u


def content_urls_by_item(pages: DataFrame, plans: DataFrame, max_items: int | None = None) -> DataFrame:
    """``content_urls_by_item``: the first a[href] inside each list item,
    light content filter, unique."""
    m = match_plan_selectors(pages, plans)
    links = m.filter((F.col("role") == "list") & F.col("link").isNotNull()).select("plan_id", "page_id", F.col("node_id").alias("item_id"), F.col("link").alias("a"))
    j = list_items(m, max_items).join(links, ["plan_id", "page_id", "item_id"]).join(pages.select("page_id", F.col("url").alias("page_url")), "page_id")
    j = j.withColumn("url", U.url_resolve(F.col("a.href"), F.col("page_url"))).filter(
        L.link_is_likely_content(F.col("url"), F.col("a.text")))
    return j.groupBy("plan_id", "url").agg(F.min("item_idx").alias("item_idx"))


def extract_sandbox(matches: DataFrame, plans: DataFrame) -> DataFrame:
    """``extract_sandbox``: for the first 3 list items, each field from the
    first match inside the item, else the first match on the page; images
    from src / data-src / data-lazy-src, e-mail and phone by regex, dates from
    datetime / data-date; then the sandbox clean-up.  ``matches`` as from ``match_plan_selectors``."""
    items = list_items(matches, 3)
    det = matches.filter(F.col("role") == "detail")
    inside = items.join(det.select("plan_id", "page_id", "field", "node_id", "attrs", "text_content",
                                   F.explode("ancestors").alias("item_id")), ["plan_id", "page_id", "item_id"])
    in_first = inside.groupBy("plan_id", "item_id", "field").agg(
        F.min_by(F.struct("attrs", "text_content"), "node_id").alias("e"))
    page_first = det.groupBy("plan_id", "field").agg(F.min_by(F.struct("attrs", "text_content"), "node_id")
                                                     .alias("pe"))
    fields = items.join(page_first, "plan_id").join(in_first, ["plan_id", "item_id", "field"], "left")
    e_attrs = F.coalesce(F.col("e.attrs"), F.col("pe.attrs"))
    e_text = H.js_trim(F.coalesce(F.col("e.text_content"), F.col("pe.text_content"), F.lit("")))
    f = F.col("field")
    raw = (F.when(f == "images", F.coalesce(e_attrs["src"], e_attrs["data-src"], e_attrs["data-lazy-src"]))
           .when(f == "website", e_attrs["href"])
           .when(f == "email", F.coalesce(F.nullif(F.regexp_extract(e_text, X.EMAIL_FIND_RE, 0), F.lit("")), e_text))
           .when(f == "phone", F.coalesce(F.nullif(H.js_trim(F.regexp_extract(e_text, X.PHONE_FIND_RE, 0)), F.lit("")),
                                          e_text))
           .when(f.isin("dates", "startDate"), F.coalesce(e_attrs["datetime"], e_attrs["data-date"], e_text))
           .otherwise(e_text))
    j = fields.join(plans.select("plan_id", F.col("entry_url")), "plan_id")
    raw = F.when(f.isin("website", "images") & raw.isNotNull() & (raw != ""), U.url_resolve(raw, F.col("entry_url"))) \
        .otherwise(raw)
    kv = j.select("plan_id", "item_id", "item_idx", "field", raw.alias("v"))
    g = kv.groupBy("plan_id", "item_id", "item_idx").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("field", "v")))).alias("f"))
    fm = F.col("f")
    items_raw = g.select("plan_id", "item_id", "item_idx",
                         *[fm[k].alias(k) for k in ["title", "description", "address", "place", "email", "phone",
                                                    "website", "startDate"]],
                         F.when(fm["images"].isNotNull(), F.array(fm["images"])).alias("images"),
                         F.when(fm["dates"].isNotNull(), F.array(fm["dates"])).alias("dates"))
    # node ids are per page: clean with a (plan, item) composite key
    keyed = items_raw.withColumn("item_id", F.concat_ws("#", "plan_id", F.col("item_id").cast("string")))
    cleaned = X.item_clean(keyed)
    out = items_raw.select("plan_id", "item_idx", F.concat_ws("#", "plan_id", F.col("item_id").cast("string"))
                           .alias("item_id"), F.col("item_id").alias("node_id")).join(cleaned, "item_id") \
        .drop("item_id").withColumnRenamed("node_id", "item_id")
    return out.filter(F.col("title").isNotNull() | F.col("description").isNotNull())


def sandbox_confidence(matches: DataFrame, plans: DataFrame, samples: DataFrame) -> DataFrame:
    """``sandbox_confidence``: 0.1 with no list element; else 0.5 + 0.2 per
    sample with more than one field, + 0.1 when the pagination selector hits
    (an error otherwise), + 0.1 x mean fields per sample; capped at 1;
    success = samples, no errors and confidence > 0.6."""
    hits = matches.groupBy("plan_id").agg(F.count_if(F.col("role") == "list").alias("n_list"),
                                          F.count_if(F.col("role") == "pagination").alias("n_pag"))
    fields = ["title", "description", "address", "place", "email", "phone", "website", "images", "startDate"]
    nf = sum((F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1).otherwise(0) for c in fields),
             F.lit(0))
    s = samples.select("plan_id", nf.alias("nf")).groupBy("plan_id").agg(
        F.count("*").alias("n_samples"), F.count_if(F.col("nf") + 1 > 1).alias("n_rich"), F.avg("nf").alias("avg_f"))
    j = plans.select("plan_id", "pagination_selector").join(hits, "plan_id", "left").join(s, "plan_id", "left") \
        .fillna(0, ["n_list", "n_pag", "n_samples", "n_rich"])
    c = F.col
    step = F.least(F.lit(0.5) + c("n_rich") * 0.2, F.lit(1.0))
    has_pag = c("pagination_selector").isNotNull()
    step = F.when(has_pag & (c("n_pag") > 0), F.least(step + 0.1, F.lit(1.0))).otherwise(step)
    step = F.when(c("n_samples") > 0, F.least(step + F.coalesce(c("avg_f"), F.lit(0.0)) * 0.1, F.lit(1.0))) \
        .otherwise(step)
    conf = F.when(c("n_list") == 0, F.lit(0.1)).otherwise(step)
    n_err = F.when(c("n_list") == 0, 1).otherwise(F.when(has_pag & (c("n_pag") == 0), 1).otherwise(0))
    return j.select("plan_id", "n_list", "n_samples", n_err.alias("n_errors"), conf.alias("confidence"),
                    ((c("n_samples") > 0) & (n_err == 0) & (conf > 0.6)).alias("success"))


def selector_hit_test(pages: DataFrame, plans: DataFrame, content_pages: DataFrame) -> DataFrame:
    """``selector_hit_test``: on each tested page +0.3 for a list hit, +0.1
    per detail selector with a hit, +0.1 for a pagination hit; success when
    at least half of the selectors hit.  ``content_pages``: (plan_id, page_id)."""
    tp = content_pages.select("plan_id", F.col("page_id").alias("test_page_id"))
    plans_t = plans.join(tp, "plan_id").withColumn("test_key", F.concat_ws("#", "plan_id", "test_page_id"))
    p2 = plans_t.drop("plan_id").withColumnRenamed("test_key", "plan_id")
    m = match_plan_selectors(pages, p2, page_col="test_page_id")
    hit = m.groupBy("plan_id", "role", F.coalesce("field", F.lit("")).alias("field")).agg(F.count("*").alias("n"))
    ps = plan_selectors(p2).withColumn("field", F.coalesce("field", F.lit(""))).join(hit, ["plan_id", "role", "field"], "left").fillna(0, ["n"])
    ps = ps.filter(F.col("role") != "content")
    g = ps.groupBy("plan_id").agg(
        F.count("*").alias("tests"), F.count_if(F.col("n") > 0).alias("hits"),
        F.sum(F.when(F.col("n") > 0, F.when(F.col("role") == "list", 0.3).otherwise(0.1)).otherwise(0.0))
        .alias("conf"))
    back = plans_t.select("test_key", "test_page_id", F.col("plan_id").alias("orig_plan"))
    r = g.join(back, g["plan_id"] == back["test_key"])
    return r.select(F.col("orig_plan").alias("plan_id"), F.col("test_page_id").alias("page_id"), "tests", "hits",
                    (F.col("hits") / F.col("tests") >= 0.5).alias("success"),
                    F.least(F.col("conf"), F.lit(1.0)).alias("confidence"))


def content_url_validation(hit_test: DataFrame) -> DataFrame:
    """``content_url_validation``: first 3 tested content URLs per plan: mean
    confidence, issues for failing pages, advice below 0.7."""
    w = Window.partitionBy("plan_id").orderBy("page_id")
    h = hit_test.withColumn("_r", F.row_number().over(w)).filter("_r <= 3")
    g = h.groupBy("plan_id").agg(F.avg("confidence").alias("average_confidence"),
                                 F.count_if(~F.col("success")).alias("n_issues"), F.count("*").alias("n_tested"))
    return g.withColumn("recommendation", F.when(
        F.col("average_confidence") < 0.7,
        F.lit("Consider updating selectors to work better with content page variations")))


def plan_score(pages: DataFrame, plans: DataFrame) -> DataFrame:
    """``plan_score``: four checks (structure, URLs, list selector, rate
    limit) -> 25 each; -20 per issue and -5 per warning, floored at 0."""
    c = F.col
    m = match_plan_selectors(pages, plans)
    hit = m.groupBy("plan_id", "role", "field").agg(F.count("*").alias("n"))
    ps = plan_selectors(plans).alias("p").join(
        hit.alias("h"), (c("p.plan_id") == c("h.plan_id")) & (c("p.role") == c("h.role"))
        & c("p.field").eqNullSafe(c("h.field")), "left").select("p.plan_id", "p.role", F.coalesce("h.n", F.lit(0)).alias("n"))
    agg = ps.groupBy("plan_id").agg(
        F.max(F.when(c("role") == "list", c("n"))).alias("n_list"),
        F.count_if((c("role") == "detail") & (c("n") == 0)).alias("empty_details"),
        F.count_if((c("role") == "pagination") & (c("n") == 0)).alias("empty_pagination"))
    j = plans.join(agg, "plan_id", "left").fillna(0, ["n_list", "empty_details", "empty_pagination"])
    structure = c("plan_id").isNotNull() & c("entry_url").isNotNull() & c("list_selector").isNotNull()
    urls_ok = U.url_valid("entry_url")
    sel_ok = urls_ok & (c("n_list") >= 2)
    access = c("rate_limit_ms").isNotNull() & (c("rate_limit_ms") >= 500)
    issues = (F.when(~structure, 1).otherwise(0) + F.when(c("entry_url").isNotNull() & ~urls_ok, 1).otherwise(0)
              + F.when(urls_ok & (c("n_list") == 0), 1).otherwise(0))
    warnings = (F.when(urls_ok & (c("n_list") == 0), 1).otherwise(0)
                + F.when(urls_ok & (c("n_list") == 1), 1).otherwise(0)
                + F.when(urls_ok, c("empty_details") + c("empty_pagination")).otherwise(0)
                + F.when(c("rate_limit_ms").isNotNull() & (c("rate_limit_ms") < 500), 1).otherwise(0))
    checks = sum((F.when(x, 1).otherwise(0) for x in [structure, urls_ok, sel_ok, access]), F.lit(0))
    base = checks / 4.0 * 100
    s1 = F.when(issues > 0, F.greatest(F.lit(0.0), base - issues * 20)).otherwise(base)
    s2 = F.when(warnings > 0, F.greatest(F.lit(0.0), s1 - warnings * 5)).otherwise(s1)
    return j.select("plan_id", "n_list", issues.alias("n_issues"), warnings.alias("n_warnings"), s2.alias("score"),
                    (~structure | (c("entry_url").isNotNull() & ~urls_ok)).alias("has_errors"))


def plan_assemble(entries: DataFrame, siblings: DataFrame, analysis: DataFrame) -> DataFrame:
    """``plan_assemble``: one plan per site from its entry page, sibling
    results (first content-link selector, best confidence) and content
    analysis (selectors, confidence); factory defaults fill the gaps."""
    sib = siblings.groupBy("site").agg(
        F.max("confidence").alias("sib_conf"),
        F.min_by("content_link_selector", F.when(F.col("content_link_selector").isNotNull(), F.col("order")))
        .alias("content_link_selector"))
    j = entries.join(sib, "site", "left").join(analysis, "site", "left")
    given = F.coalesce(F.col("detail_selectors"), F.create_map().cast("map<string,string>"))
    defaults = F.create_map(F.lit("title"), F.coalesce(F.nullif(given["title"], F.lit("")), F.lit(DEFAULT_TITLE)),
                            F.lit("description"),
                            F.coalesce(F.nullif(given["description"], F.lit("")), F.lit(DEFAULT_DESCRIPTION)))
    # given keys override (spread after the defaults)
    details = F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(given, k)), given)
    return j.select(
        F.concat(F.lit("plan-"), F.col("site")).alias("plan_id"), "site", "entry_page_id", "entry_url",
        F.coalesce(F.nullif("list_selector", F.lit("")), F.lit(DEFAULT_LIST)).alias("list_selector"),
        "content_link_selector", F.nullif("pagination_selector", F.lit("")).alias("pagination_selector"),
        details.alias("detail_selectors"),
        F.coalesce("rich_fields", F.array().cast("array<string>")).alias("rich_content_fields"),
        F.lit(DEFAULT_RATE_MS).alias("rate_limit_ms"),
        F.greatest(F.coalesce("analysis_conf", F.lit(0.0)), F.coalesce("sib_conf", F.lit(0.0))).alias("confidence_score"),
        F.struct(U.url_host("entry_url").alias("domain"), F.lit("municipal").alias("site_type"),
                 F.lit("de").alias("language"), F.lit(True).alias("robots_txt_compliant"),
                 F.lit(True).alias("gdpr_compliant")).alias("metadata"))


def plan_precheck(plans: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """``plan_precheck``: entry URL present, its domain in the allow list
    (semi join; no list = all allowed), list selector present."""
    p = plans.withColumn("_dom", U.url_host("entry_url"))
    if allowed is not None:
        ok = p.join(allowed.select(F.col("domain").alias("_dom")).distinct(), "_dom", "left_semi") \
            .select("plan_id").withColumn("_allowed", F.lit(True))
        p = p.join(ok, "plan_id", "left").withColumn("_allowed", F.coalesce("_allowed", F.lit(False)))
    else:
        p = p.withColumn("_allowed", F.lit(True))
    err = (F.when(F.col("entry_url").isNull(), F.lit("Plan must have at least one entry URL"))
           .when(~F.col("_allowed"), F.concat(F.lit("Domain "), F.col("_dom"), F.lit(" is not allowed in sandbox")))
           .when(F.col("list_selector").isNull() | (F.col("list_selector") == ""),
                 F.lit("Plan must have a list selector")))
    return p.select("plan_id", err.isNull().alias("ok"), err.alias("error"))
