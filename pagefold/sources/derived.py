"""Reference-shaped tables derived from the driver tables.

The reference's inputs (extracted items, executions, recorded model calls,
robots files, consent checks ...) do not exist as driver tables, so each one
is derived from them by a fixed expression (FIXTURES.md section 2).  Every
derivation is a narrow projection or a key join, so its size grows with the
driver tables.  The DuckDB oracle builds the same tables with the same
expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.functions import html as H
from pagefold.sources.tables import read_table

# First match of the extraction selectors used for pages (h1, article, lang).
H1_RE = r"(?is)<h1\b[^>]*>(.*?)</h1>"
ARTICLE_RE = r"(?is)<article\b[^>]*>(.*?)</article>"
LANG_RE = r"(?i)<html\b[^>]*\blang=\"([^\"]*)\""
IMG_RE = r"""(?i)<img\b[^>]*\bsrc\s*=\s*["']([^"']*)["']"""
FOOTER_HOST_RE = r"&copy; ([^ <]+)"
EMAIL_FIND_RE = r"[\w.\-]+@[\w.\-]+\.\w+"
PHONE_FIND_RE = r"[\d\s\-+()/]{8,}"


def text_of(fragment) -> F.Column:
    """textContent-like: tags removed, entities decoded, white space collapsed."""
    return F.trim(F.regexp_replace(H.strip_tags(fragment), r"\s+", " "))


def first_text(h: F.Column, pattern: str) -> F.Column:
    """Text of the first element matched by ``pattern`` (NULL when none)."""
    return F.when(h.rlike(pattern), text_of(F.regexp_extract(h, pattern, 1)))


def page_items(pages: DataFrame) -> DataFrame:
    """Items as the detail extractor yields them from a page: title = h1,
    description = article text, language = html lang, images = img src."""
    h = F.col("html")
    lang = F.regexp_extract(h, LANG_RE, 1)
    return pages.select(
        F.col("page_id").alias("item_id"),
        first_text(h, H1_RE).alias("title"),
        first_text(h, ARTICLE_RE).alias("description"),
        F.when(lang != "", lang).alias("language"),
        F.regexp_extract_all(h, F.lit(IMG_RE), 1).alias("images"),
        F.nullif(F.regexp_extract(h, FOOTER_HOST_RE, 1), F.lit("")).alias("website"),
        F.col("url").alias("sourceUrl"),
    )


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
              "l_discount", "l_tax", "l_shipdate"]


def first_lines(lineitem: DataFrame) -> DataFrame:
    """The first line of every order (line numbers repeat in the data, so
    ties break on part, supplier, price ...).  A grouped ``min_by`` combines
    map-side, so no order's lines are gathered in one place."""
    cols = ["l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate", "l_linenumber"]
    g = lineitem.groupBy("l_orderkey").agg(
        F.min_by(F.struct(*cols), F.struct(*LINE_ORDER)).alias("l"))
    return g.select("l_orderkey", "l.*")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``items`` fact table derived from the driver tables.

    Text fields come from the page; contact data from the document with the
    same id; prices, dates and coordinates from the order with the same key
    (its first line and its customer).  Every join is on a key, left outer,
    so each page yields exactly one item.

    Every rule of validation meets both its outcomes: some titles, descriptions,
    e-mails, websites, images, dates and languages are missing or malformed, and
    all dates of the hosts under .org are complete ISO timestamps.
    """
    p = page_items(read_table(spark, sf_dir, "pages"))
    d = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"),
        F.nullif(F.regexp_extract("text", EMAIL_FIND_RE, 0), F.lit("")).alias("email"),
        F.nullif(F.regexp_extract("text", PHONE_FIND_RE, 0), F.lit("")).alias("phone"))
    li = first_lines(read_table(spark, sf_dir, "lineitem")).select(
        F.col("l_orderkey").alias("item_id"), "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_shipdate")
    o = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_id"), "o_orderdate", "o_custkey")
    cu = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    j = p.join(d, "item_id", "left").join(li, "item_id", "left").join(o, "item_id", "left") \
        .join(cu, "o_custkey", "left")
    iid = F.col("item_id")
    start = F.when(iid % 7 == 0, F.concat(F.lit("31.02."), F.date_format("o_orderdate", "yyyy"))) \
        .when(iid % 2 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")) \
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    org = F.col("sourceUrl").contains(".org")
    iso_ms = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    start = F.when(org, F.date_format("o_orderdate", iso_ms)).when(iid % 29 == 0, "01.01.1800").otherwise(start)
    end = F.when(org, F.date_format("l_shipdate", iso_ms)).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    disc = F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice") * (1 + F.col("l_tax"))) \
        .otherwise(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    images = F.when(iid % 5 == 0, F.concat(F.col("images"), F.array(F.concat(
        F.lit("/img/"), iid.cast("string"), F.lit(".jpg"))))).otherwise(F.col("images"))
    images = F.when(iid % 10 == 0, F.concat(images, F.array(F.lit("http://")))).otherwise(images)
    no_dates = F.array().cast("array<string>")
    dates = F.when(end.isNull(), no_dates).when((iid % 23 == 0) & ~org, F.array(end, F.lit("99.99.2020"))).otherwise(F.array(end))
    return j.select(
        "item_id",
        F.when((iid % 17 == 3) & ~org, F.lit(None)).when(iid % 17 == 5, F.lit(" a ")).when(
            iid % 17 == 7, F.repeat(F.concat("title", F.lit(" ")), 60)).otherwise(F.col("title")).alias("title"),
        F.when(iid % 4 == 0, F.concat(F.lit("Ort "), iid.cast("string"))).alias("place"),
        F.when((iid % 19 != 1) | org, F.col("description")).alias("description"),
        F.lit(None).cast("string").alias("address"),
        F.when(iid % 13 == 2, F.lit(" Not-an-Email ")).otherwise(F.col("email")).alias("email"), "phone",
        F.when(iid % 13 == 4, F.lit("http://")).when(iid % 13 == 6, F.lit("bad host/x")).otherwise(F.col("website")).alias("website"),
        F.col("l_extendedprice").alias("price"), disc.alias("discountPrice"),
        (F.col("c_acctbal") / 50).alias("longitude"),
        F.when(iid % 3 != 0, F.col("c_acctbal") / 120).alias("latitude"),
        start.alias("startDate"), end.alias("endDate"),
        dates.alias("dates"),
        F.lit(None).cast("string").alias("createdAt"),
        ((F.col("o_custkey") * 97) % 120000).cast("int").alias("zipcode"),
        images.alias("images"), F.when(iid % 31 != 0, F.col("language")).alias("language"), "sourceUrl",
    )


ROBOTS_EPOCH = "2024-01-01 00:00:00"


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``robots(domain, status, body, fetched_at)``: one robots.txt per host,
    built from the host and its first page id (k = id % 4 picks the shape;
    every 7th host failed to fetch)."""
    from pagefold.functions import url as U
    p = read_table(spark, sf_dir, "pages").groupBy(U.url_host("url").alias("domain")).agg(
        F.min("page_id").alias("pid"))
    k = F.col("pid") % 4
    base = F.concat(
        F.lit("# robots.txt for "), F.col("domain"), F.lit("\n\nUser-agent: *\nDisallow: /fr/\nAllow: /en/\n"),
        F.lit("Crawl-delay: "), (F.col("pid") % 5).cast("string"),
        F.lit("\nSitemap: https://"), F.col("domain"), F.lit("/sitemap.xml\n"))
    agent = F.lit("\nUser-agent: pagefold-bot/1.0\nAllow: /de/\nDisallow: /e*\nCrawl-delay: 2\n")
    body = (F.when(k == 1, F.concat(base, agent))
            .when(k == 2, F.lit("User-agent: *\nDisallow: /\n"))
            .otherwise(base))
    status = F.when(F.col("pid") % 7 == 0, F.lit(0)).when(k == 3, F.lit(404)).otherwise(F.lit(200))
    fetched = F.to_timestamp(F.lit(ROBOTS_EPOCH)) + F.make_interval(hours=F.col("pid").cast("int"))
    return p.select("domain", status.alias("status"), body.alias("body"), fetched.alias("fetched_at"))


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct page hosts with their source type."""
    from pagefold.functions import url as U
    from pagefold.operators.compliance import source_type_of
    h = read_table(spark, sf_dir, "pages").select(U.url_host("url").alias("domain")).distinct()
    return h.select("domain", source_type_of(F.col("domain")).alias("source_type"))


def deletion_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deletion_requests(request_id, domain, email, phone, from_ts, to_ts)``:
    domain requests from every 25th page, e-mail / phone requests from
    documents, 30-day date ranges from every 1000th order."""
    from pagefold.functions import url as U
    ts_null = F.lit(None).cast("timestamp")
    s_null = F.lit(None).cast("string")
    pg = read_table(spark, sf_dir, "pages").filter(F.col("page_id") % 25 == 0).select(
        F.concat(F.lit("dom-"), F.col("page_id").cast("string")).alias("request_id"),
        U.url_host("url").alias("domain"), s_null.alias("email"), s_null.alias("phone"),
        ts_null.alias("from_ts"), ts_null.alias("to_ts"))
    docs = read_table(spark, sf_dir, "documents")
    em = F.regexp_extract("text", EMAIL_FIND_RE, 0)
    ph = F.regexp_extract("text", PHONE_FIND_RE, 0)
    mail = docs.filter((F.col("doc_id") % 10 == 3) & (em != "")).select(
        F.concat(F.lit("mail-"), F.col("doc_id").cast("string")).alias("request_id"), s_null.alias("domain"),
        em.alias("email"), s_null.alias("phone"), ts_null.alias("from_ts"), ts_null.alias("to_ts"))
    tel = docs.filter((F.col("doc_id") % 10 == 7) & (ph != "")).select(
        F.concat(F.lit("tel-"), F.col("doc_id").cast("string")).alias("request_id"), s_null.alias("domain"),
        s_null.alias("email"), ph.alias("phone"), ts_null.alias("from_ts"), ts_null.alias("to_ts"))
    od = read_table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 1000 == 0).select(
        F.concat(F.lit("date-"), F.col("o_orderkey").cast("string")).alias("request_id"), s_null.alias("domain"),
        s_null.alias("email"), s_null.alias("phone"), F.col("o_orderdate").cast("timestamp").alias("from_ts"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 30 DAYS")).alias("to_ts"))
    return pg.unionByName(mail).unionByName(tel).unionByName(od)


LLM_EPOCH = "2024-01-01 00:00:00"
# Fixed lists used to derive recorded model calls from conversations.
LLM_SERVICES = ["content-analysis", "sibling-link-discovery", "html-compressor", "cookie-consent"]
LLM_PROVIDERS = ["ollama", "openai", "anthropic"]


def _conv_ts() -> F.Column:
    return (F.to_timestamp(F.lit(LLM_EPOCH)) + F.make_interval(hours=F.col("conv_id").cast("int"))
            + F.make_interval(mins=F.col("turn").cast("int")))


def llm_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded requests: every user turn of a conversation (provider by
    conversation id % 3, service by turn % 4, 25 sessions)."""
    c = read_table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    svc = F.element_at(F.array(*[F.lit(s) for s in LLM_SERVICES]), (F.col("turn") % 4 + 1).cast("int"))
    prov = F.element_at(F.array(*[F.lit(s) for s in LLM_PROVIDERS]), (F.col("conv_id") % 3 + 1).cast("int"))
    return c.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
        F.concat(F.lit("session-"), (F.col("conv_id") % 25).cast("string")).alias("session_id"),
        _conv_ts().alias("ts"), svc.alias("service"), F.lit("generate").alias("method"),
        prov.alias("provider"), F.concat(prov, F.lit("-model")).alias("model"),
        F.col("text").alias("prompt"),
        F.when(F.col("turn") % 2 == 0, "json").otherwise("text").alias("format"))


def llm_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded responses: every assistant turn answers the latest user turn
    before it in the same conversation."""
    from pyspark.sql import Window
    c = read_table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("req_turn", F.max(F.when(F.col("role") == "user", F.col("turn"))).over(w))
    r = c.filter((F.col("role") == "assistant") & F.col("req_turn").isNotNull())
    ok = (F.length("text") > 0) & (F.col("conv_id") % 11 != 0)
    return r.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("req_turn").cast("string")).alias("request_id"),
        _conv_ts().alias("ts"), F.col("text").alias("content"),
        F.when(F.col("turn") % 5 != 4, F.ceil(F.length("text") / F.lit(3.5)).cast("bigint")).alias("tokens_used"),
        (F.length("text") * 3).cast("bigint").alias("duration_ms"), ok.alias("success"),
        F.when(~ok, F.lit("timeout")).alias("error"),
        F.col("turn").alias("seq"))


def llm_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context updates: each response sets 'phase' and 'chars' again."""
    r = llm_responses(spark, sf_dir)
    return r.select("request_id", "seq", F.explode(F.array(
        F.struct(F.lit("phase").alias("key"), F.concat(F.lit("turn-"), F.col("seq").cast("string")).alias("value")),
        F.struct(F.lit("chars").alias("key"), F.length("content").cast("string").alias("value")))).alias("kv")) \
        .select("request_id", "seq", "kv.key", "kv.value")


REPLY_OFFSET = 10_000_000_000
#: Replies as a model writes them, one per kind of event; ``{n}`` is the event id,
#: ``{d}`` its last digit.  Every parsed field occurs, and wrong, missing and cut-off ones.
REPLY_TEMPLATES = [
    '{"relevanceScore": 0.{d}, "contentType": "listing", "shouldKeep": true, "reasoning": "r{d}", '
    '"extractedSelectors": [".a", ".b{d}"], "detailSelectors": {"title": "h1", "description": ".d{d}", "price": " ", "n": 4}, '
    '"richContentFields": ["description", "nothing"], "confidence": 0.{d}, "exampleUrlSelector": "#{d}x a", '
    '"siblingContainerSelector": "ul.list", "contentLinkSelector": "#[data] h3 > a", "paginationNextSelector": "a.next", '
    '"paginationLinks": ["?page=2", 3, "/p/{n}"], "steps": [{"stepNumber": 2, "action": "wait", "description": "Wait"}, {}], "k": {n}}',
    'Here you are: {"relevanceScore": "0.5", "shouldKeep": false, "contentType": "", "extractedSelectors": [], "k": {d}} Anything else?',
    '{"relevanceScore": 0.9, "contentType": "article", "detailSelectors": {"title": "h',
    '{"detailSelectors": {"description": "p"}, "confidence": 7, "paginationLinks": [], "paginationNextSelector": "", '
    '"steps": [{"selector": "#ok{d}", "waitTime": 50, "fallbackSelectors": ["#a"]}], "reasoning": "only some"}',
    '{"relevanceScore": null, "confidence": 0, "richContentFields": "none", "detailSelectors": [], "steps": [], "paginationLinks": null}',
    '[1, 2]',
]


def llm_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model replies to parse: event payloads (JSON), assistant turns (prose)
    and, for every fourth event, a reply in one of the expected forms."""
    e = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("reply_id"), F.col("props").alias("reply"))
    c = read_table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant").select(
        (-(F.col("conv_id") * 1000 + F.col("turn")) - 1).alias("reply_id"), F.col("text").alias("reply"))
    made = F.element_at(F.array(*[F.lit(t) for t in REPLY_TEMPLATES]),
                        (F.floor(F.col("event_id") / 4) % len(REPLY_TEMPLATES) + 1).cast("int"))
    j = read_table(spark, sf_dir, "events").filter(F.col("event_id") % 4 == 1).select(
        (F.col("event_id") + REPLY_OFFSET).alias("reply_id"),
        F.replace(F.replace(made, F.lit("{n}"), F.col("event_id").cast("string")), F.lit("{d}"),
                  (F.col("event_id") % 10).cast("string")).alias("reply"))
    return e.unionByName(c).unionByName(j)


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``executions``: one run per event; plan = user, failed = 'error'
    events; items = floor(value), pages 1-3, duration = value seconds."""
    return executions_from(read_table(spark, sf_dir, "events"))


def executions_from(e: DataFrame) -> DataFrame:
    """``executions`` of an event table or stream."""
    ts = F.col("ts").cast("timestamp")
    dur = F.round(F.col("value") * 1000).cast("bigint")
    return e.select(
        F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("run_id"),
        F.concat(F.lit("plan-"), F.col("user_id").cast("string")).alias("plan_id"),
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
        ts.alias("start_time"),
        F.timestamp_micros(F.unix_micros(ts) + F.round(F.col("value") * 1000000).cast("bigint")).alias("end_time"),
        F.floor("value").cast("bigint").alias("items_extracted"),
        (F.col("event_id") % 3 + 1).alias("pages_processed"),
        dur.alias("duration_ms"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).cast("bigint").alias("errors_encountered"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("Selector timeout on page "),
                                                         (F.col("event_id") % 3 + 1).cast("string")))
        .alias("error_message"),
        F.col("event_type"), F.col("user_id"), F.col("props"))


def inject_before_body_end(html: F.Column, fragment: F.Column) -> F.Column:
    """Insert ``fragment`` before ``</body>``; append it when the page has none."""
    return F.when(html.rlike("(?i)</body>"),
                  F.regexp_replace(html, F.lit("(?i)</body>"), F.concat(fragment, F.lit("</body>")))) \
        .otherwise(F.concat(html, fragment))


# Fixed banner shapes injected into every third page for the consent jobs
# ({id} is the page id).
CONSENT_BANNERS = [
    '<div class="cookie-banner" style="position: fixed; z-index: 9999"><p>Wir verwenden Cookies. Datenschutz</p>'
    '<button class="btn btn-primary" id="accept-{id}">Alle akzeptieren</button><button class="btn">Ablehnen</button></div>',
    '<div id="CybotCookiebotDialog" class="consent-dialog" role="dialog"><span>We use cookies for consent</span>'
    '<button>Accept all</button><button>Settings</button><button>Save</button></div>'
    '<script src="https://consent.cookiebot.com/uc.js"></script>',
    '<section class="privacy-notice"><p>This site uses cookies</p><a role="button" class="close">×</a></section>',
    '<p class="legal">See our cookie policy</p>',
]


def consent_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a consent banner injected before ``</body>`` in every third
    page (shape by page id % 4); the rest unchanged."""
    p = read_table(spark, sf_dir, "pages")
    k = F.col("page_id") % 4
    pid = F.col("page_id").cast("string")
    banner = None
    for i, b in enumerate(CONSENT_BANNERS):
        parts = b.split("{id}")
        val = F.concat(*[x for j, part in enumerate(parts) for x in ([F.lit(part)] + ([pid] if j < len(parts) - 1 else []))])
        banner = F.when(k == i, val) if banner is None else banner.when(k == i, val)
    html = F.when(F.col("page_id") % 3 == 0, inject_before_body_end(F.col("html"), banner)).otherwise(F.col("html"))
    return p.select("page_id", "url", html.alias("html"))


def after_click_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that had a banner, after a click on it: every other one still has it."""
    before = consent_pages(spark, sf_dir).where(F.col("page_id") % 3 == 0)
    clean = read_table(spark, sf_dir, "pages").where(F.col("page_id") % 6 == 0).select("page_id", "url", "html")
    return before.where(F.col("page_id") % 6 == 3).unionByName(clean)


CONSENT_LIBS = ["Cookiebot", "OneTrust", "CookieYes", "Borlabs", "CookieLawInfo", "Cookie Notice"]
CONSENT_STEP_TEXTS = ["Click accept all", "Alle zustimmen", "Reject optional cookies", "Open settings",
                      "Speichern der Auswahl", "Close banner"]


def consent_verifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded consent-plan verifications: every 'signup' event."""
    e = read_table(spark, sf_dir, "events").filter(F.col("event_type") == "signup")
    dom = F.concat(F.lit("site-"), (F.col("user_id") % 40).cast("string"), F.lit(".example.org"))
    lib = F.element_at(F.array(*[F.lit(x) for x in CONSENT_LIBS]), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select(dom.alias("domain"), lib.alias("library"), F.col("ts").cast("timestamp").alias("ts"),
                    (F.col("value") > 25).alias("success"), F.col("event_id"),
                    F.concat(F.lit("ccp-"), F.col("event_id").cast("string")).alias("plan_id"))


def consent_plan_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of each recorded plan: 1-3 steps with fixed descriptions."""
    v = consent_verifications(spark, sf_dir)
    s = v.select("plan_id", "event_id", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int"))).alias("i"))
    k = (F.col("event_id") + F.col("i"))
    return s.select(
        "plan_id", (F.col("i") + 1).alias("step_number"),
        F.when(k % 7 == 0, "wait").otherwise("click").alias("action"),
        F.concat(F.lit("#btn-"), F.col("i").cast("string")).alias("selector"),
        F.element_at(F.array(*[F.lit(x) for x in CONSENT_STEP_TEXTS]), (k % 6 + 1).cast("int")).alias("description"))


def paginated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a pagination bar injected: each page links (rel=next) to
    the next page id of the same host, plus a numbered link."""
    from pyspark.sql import Window
    from pagefold.functions import url as U
    pages = read_table(spark, sf_dir, "pages")
    w = Window.partitionBy("host").orderBy("page_id")
    # Only ids and URLs pass through the per-host order; html joins back by page.
    near = pages.select("page_id", "url", U.url_host("url").alias("host")).select(
        "page_id", F.lead("url").over(w).alias("next_url"), F.row_number().over(w).alias("rank"))
    p = pages.join(near, "page_id")
    bar = F.concat(F.lit('<nav class="pagination"><a href="'), F.col("next_url"),
                   F.lit('" rel="next">Next ›</a><a href="?page='), (F.col("rank") + 1).cast("string"),
                   F.lit('">'), (F.col("rank") + 1).cast("string"), F.lit("</a></nav>"))
    html = F.when(F.col("next_url").isNotNull(), inject_before_body_end(F.col("html"), bar)).otherwise(F.col("html"))
    return p.select("page_id", "url", html.alias("html"))


#: List of links put at the top of a page: (href, text); ``{id}`` is the page id, ``{next}``
#: the URL of the host's next page.  Municipal and dated content, another snapshot,
#: another host, a repeated link, and links that every rule must refuse.
LINK_LIST = [
    ("/aktuelles/2024-01-05-meldung-{id}.htm", "Meldung {id} aus dem Stadtrat"),
    ("/sitzung+a+protokoll+1{id}00.htm", "Protokoll der Sitzung {id}"),
    ("/sitzung+b+protokoll+2{id}00.htm", "Protokoll der Sitzung {id} b"),
    ("/sitzung+c+bericht+3{id}00.htm", "Bericht {id} des Ausschusses"),
    ("{next}", "Weiter zur naechsten Seite"),
    ("https://other.example.net/news/{id}", "Nachricht von anderswo"),
    ("/sitzung+a+protokoll+1{id}00.htm#top", "Protokoll"),
    ("/suche?q={id}", "Suche"), ("/impressum", "Impressum"), ("#oben", ">"), ("mailto:info@example.org", "Mail"),
    ("javascript:void(0)", "x"), ("/en/{id}?page=2", "2"),
]


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a content list: two of three pages carry ``LINK_LIST`` at the
    top of their body, below an element that is a list container."""
    from pyspark.sql import Window
    from pagefold.functions import url as U
    p = read_table(spark, sf_dir, "pages")
    w = Window.partitionBy("host").orderBy("page_id")
    near = p.select("page_id", "url", U.url_host("url").alias("host")).select(
        "page_id", F.coalesce(F.lead("url").over(w), F.lit("/")).alias("next_url"))

    def fill(text):
        return F.replace(F.replace(F.lit(text), F.lit("{id}"), F.col("page_id").cast("string")), F.lit("{next}"), F.col("next_url"))
    items = [x for href, text in LINK_LIST for x in (
        F.lit('<article class="news-item"><h3><a href="'), fill(href), F.lit('">'), fill(text), F.lit("</a></h3></article>"))]
    block = F.concat(F.lit('<body><div class="news-list">'), *items, F.lit("</div>"))
    html = F.when(F.col("page_id") % 3 != 0, F.replace(F.col("html"), F.lit("<body>"), block)).otherwise(F.col("html"))
    return p.join(near, "page_id").select("page_id", "url", html.alias("html"))


#: Detail selectors that the analysis of every other site names.
PLAN_DETAILS = {"title": "h1", "description": "article p", "website": "nav a", "place": "footer"}


def plan_inputs(spark: SparkSession, sf_dir: str):
    """Inputs of plan assembly per site: the entry page (first page of the
    host), sibling results (content-link selector 'nav li > a' with the
    sibling confidence rule 0.6 when the page has links) and a content
    analysis that differs by the length of the site's name: which selectors it
    names (some hit, some do not, some are missing) and how sure it is."""
    from pagefold.functions import url as U
    p = read_table(spark, sf_dir, "pages").select("page_id", "url", U.url_host("url").alias("site"), "html")
    entries = p.groupBy("site").agg(F.min_by(F.struct("page_id", "url"), "page_id").alias("e")).select(
        "site", F.col("e.page_id").alias("entry_page_id"), F.col("e.url").alias("entry_url"))
    sib = p.select("site", F.col("page_id").alias("order"),
                   F.when(F.col("html").contains("<a "), F.lit(0.6)).otherwise(F.lit(0.0)).alias("confidence"),
                   F.lit("nav li > a").alias("content_link_selector"))
    n = F.length("site")
    more = F.create_map(*[F.lit(x) for kv in PLAN_DETAILS.items() for x in kv])
    analysis = entries.select("site", F.when(n % 4 == 1, "nav li").when(n % 4 == 2, ".missing").alias("list_selector"),
                              F.when(n % 3 == 1, "nav a").when(n % 3 == 2, ".pagination a").otherwise("").alias("pagination_selector"),
                              F.when(n % 2 == 1, more).otherwise(F.create_map().cast("map<string,string>")).alias("detail_selectors"),
                              (F.lit(4) + n % 5).cast("double").alias("tenths"),
                              F.array(F.lit("description")).alias("rich_fields")).withColumn("analysis_conf", F.col("tenths") / 10).drop("tenths")
    return entries, sib, analysis
