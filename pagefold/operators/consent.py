"""Cookie-consent detection over saved HTML.

A browser is not available, so layout terms of the reference's score come
only from inline ``style`` attributes (position, z-index, visibility); the
screen-position and size terms are omitted (README, deviations).  Dialog
candidates come from the selector engine; per page the best candidate is
an ordered ``row_number``; buttons are classified by an in-order fold
(``aggregate``) over the few buttons of one dialog.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefold.functions import html as H
from pagefold.operators import dom as M

# Consent keywords, selectors, vendors and button texts.
KEYWORDS = [
    "cookie", "consent", "zustimmen", "akzeptieren", "datenschutz",
    "cookie-präferenzen", "cookie-disclaimer", "cookie-einstellungen",
    "datenschutzeinstellungen", "einwilligung", "speichern", "auswählen",
    "alle auswählen", "alle abwählen", "cookie-banner", "cookie-hinweis",
]
OVERLAY_SELECTORS = [
    '[class*="cookie"]', '[id*="cookie"]', '[class*="consent"]', '[id*="consent"]', '[class*="gdpr"]',
    '[id*="gdpr"]', '[class*="disclaimer"]', '[id*="disclaimer"]', '[class*="präferenzen"]',
    '[id*="präferenzen"]', ".cookie-banner", ".consent-banner", ".cookie-notice", ".privacy-notice",
    ".cookie-disclaimer", ".cookie-preferences", '[role="dialog"]', '[aria-modal="true"]',
]
DIALOG_SELECTORS = [
    '[class*="cookie"][class*="dialog"]', '[class*="cookie"][class*="banner"]', ".cookie-banner-container",
    '[class*="consent"][class*="dialog"]', '[class*="consent"][class*="banner"]', '[class*="disclaimer"]',
    '[id*="disclaimer"]', '[class*="modal"]', '[role="dialog"]', '[aria-modal="true"]', ".cookie-banner",
    ".cookie-banner-container", ".consent-banner", ".cookie-notice", ".privacy-notice", ".cookie-disclaimer",
    ".cookie-preferences", '[id*="cookie"][id*="banner"]', '[id*="consent"][id*="banner"]', '[id*="disclaimer"]',
    'div:has-text("cookie")', 'div:has-text("Cookie")', 'div:has-text("COOKIE")', 'div:has-text("consent")',
    'div:has-text("Consent")', 'div:has-text("disclaimer")', 'div:has-text("Disclaimer")',
    'div:has-text("DISCLAIMER")',
]
LIBRARIES = [
    ("Cookiebot", ["cookiebot", "CookieConsent.renew", "CookieConsent"]),
    ("OneTrust", ["OneTrust", "optanon", "OptanonConsent"]),
    ("CookieYes", ["cookieyes", "cky-", "CookieYes"]),
    ("Borlabs", ["borlabs-cookie", "BorlabsCookie"]),
    ("CookieLawInfo", ["cookie-law-info", "cliSettings"]),
    ("Cookie Notice", ["cookie-notice", "CookieNotice"]),
]
BUTTON_SELECTORS = 'button, a[role="button"], input[type="button"], input[type="submit"], [role="button"]'
BUTTON_PATTERNS = {
    "acceptAll": ["akzeptieren", "alle akzeptieren", "zustimmen", "alle zustimmen", "akzeptiere alle",
                  "alle cookies akzeptieren", "cookies akzeptieren", "alle auswählen", "alle erlauben",
                  "alle zulassen", "alle cookies zulassen", "auswahl bestätigen", "accept all",
                  "accept all cookies", "allow all", "allow all cookies", "accept", "agree", "i agree",
                  "i accept", "accepter tout", "accepter tous", "j'accepte", "j'accepte tout"],
    "rejectAll": ["ablehnen", "alle ablehnen", "verweigern", "alle verweigern", "ablehne alle", "nur notwendige",
                  "nur erforderliche", "alle abwählen", "nicht zustimmen", "nur notwendige cookies zulassen",
                  "reject all", "reject all cookies", "decline all", "decline", "reject", "disagree",
                  "i disagree", "necessary only", "refuser tout", "refuser tous", "je refuse",
                  "nécessaires seulement"],
    "settings": ["einstellungen", "optionen", "präferenzen", "anpassen", "cookie einstellungen", "cookie optionen",
                 "cookie-präferenzen", "settings", "preferences", "options", "customize", "cookie settings",
                 "manage cookies", "paramètres", "préférences", "options", "personnaliser", "paramètres cookies"],
    "save": ["speichern", "save", "sauvegarder", "ok", "fertig"],
    "close": ["schließen", "schließen", "x", "×", "close", "x", "×", "dismiss", "fermer", "x", "×", "fermer"],
}
# classification order (first free slot that matches wins)
BUTTON_ORDER = ["acceptAll", "rejectAll", "save", "settings", "close"]
TEXT_SELECTOR_WORDS = ["cookie", "zulassen", "akzeptieren", "ablehnen", "notwendige"]
GENERIC_CLASSES = ["btn", "button", "text-nowrap"]
STRATEGIES = {
    "accept-all": ["acceptAll", "save", "close"],
    "reject-all": ["rejectAll", "save", "close"],
    "minimal": ["settings", "rejectAll", "save", "close"],
    "ai-decide": ["acceptAll", "rejectAll", "settings", "save", "close"],
}


def _any_contains(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w.lower())
    return out


def has_keywords(text) -> Column:
    """``consent_keywords``: any keyword in the lower-cased text."""
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    return _any_contains(t, KEYWORDS)


def library(html) -> Column:
    """``consent_library``: first vendor whose pattern occurs in the page."""
    t = F.lower(F.col(html) if isinstance(html, str) else html)
    out = None
    for name, pats in LIBRARIES:
        cond = _any_contains(t, pats)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


def _style(nodes_attrs: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(F.try_element_at(nodes_attrs, F.lit("style")), F.lit("")), r"\s", ""))


def _visible(attrs: Column) -> Column:
    st = _style(attrs)
    return ~(st.contains("display:none") | st.contains("visibility:hidden") | st.rlike(r"opacity:0(\.0*)?(;|$)")
             | F.map_contains_key(attrs, "hidden"))


def static_score(sel: Column, text: Column, attrs: Column) -> Column:
    """``consent_score`` (static terms): selector hints, keywords, inline
    overlay / z-index / visibility; capped at 100."""
    s = F.lower(F.coalesce(sel, F.lit("")))
    st = _style(attrs)
    z = F.regexp_extract(st, r"z-index:(-?\d+)", 1).try_cast("int")
    score = (F.when(s.contains("cookie") & s.contains("banner"), 35).otherwise(0)
             + F.when(s.contains("cookie") & s.contains("dialog"), 35).otherwise(0)
             + F.when(s.contains("cookie-banner-container"), 40).otherwise(0)
             + F.when(s.contains("consent"), 20).otherwise(0)
             + F.when(s.contains("disclaimer"), 10).otherwise(0)
             + F.when(has_keywords(F.coalesce(text, F.lit(""))), 30).otherwise(0)
             + F.when(st.contains("position:fixed") | st.contains("position:absolute"), 10).otherwise(0)
             + F.when(F.coalesce(z, F.lit(0)) > 100, 10).otherwise(0)
             + F.when(~(st.contains("visibility:hidden") | st.rlike(r"opacity:0(\.0*)?(;|$)")), 5).otherwise(0))
    return F.least(score, F.lit(100))


def _css_and_text_selectors(selectors):
    css, text = {}, {}
    for i, s in enumerate(selectors):
        key = f"{i:03d}"
        if ":has-text(" in s:
            text[key] = s
        else:
            css[key] = s
    return css, text


def candidates(nodes_t: DataFrame, selectors) -> DataFrame:
    """``consent_candidates``: (page_id, node_id, sel_idx, selector) for every
    visible element matched by a selector of the list (document order inside
    a selector); ``div:has-text(x)`` = a div whose text contains x (any case)."""
    spark = nodes_t.sparkSession
    css, text = _css_and_text_selectors(selectors)
    hits = M.selector_match(nodes_t, M.selector_table(spark, css))
    sel_map = F.create_map(*[x for k, v in css.items() for x in (F.lit(k), F.lit(v))])
    out = hits.select("page_id", "node_id", F.col("sel_id").cast("int").alias("sel_idx"),
                      sel_map[F.col("sel_id")].alias("selector"))
    if text:
        # One pass over the texts: the distinct words are tested once, then each selector takes its word's flag.
        words = sorted({s.split('"')[1].lower() for s in text.values()})
        divs = nodes_t.filter(F.col("tag") == "div").select(
            "page_id", "node_id", *[F.lower("text_content").contains(w).alias(f"_w{i}") for i, w in enumerate(words)])
        hit = F.array_compact(F.array(*[
            F.when(F.col(f"_w{words.index(s.split(chr(34))[1].lower())}"), F.struct(
                F.lit(int(k)).alias("sel_idx"), F.lit(s).alias("selector"))) for k, s in text.items()]))
        out = out.unionByName(divs.select("page_id", "node_id", F.explode(hit).alias("_h")).select(
            "page_id", "node_id", "_h.sel_idx", "_h.selector"))
    vis = nodes_t.select("page_id", "node_id", "attrs", "text_content", "tag")
    return out.join(vis, ["page_id", "node_id"]).filter(_visible(F.col("attrs")))


def scored_candidates(nodes_t: DataFrame, selectors) -> DataFrame:
    c = candidates(nodes_t, selectors)
    return c.withColumn("score", static_score(F.col("selector"), F.col("text_content"), F.col("attrs")))


def consent_detect(nodes_t: DataFrame, pages: DataFrame) -> DataFrame:
    """``consent_detect``: keywords on the page and best overlay score >= 50;
    plus the best dialog element (first of equal scores in selector, then
    document order), falling back to any div/section/aside/dialog with keywords."""
    ov = scored_candidates(nodes_t, OVERLAY_SELECTORS).groupBy("page_id").agg(F.max("score").alias("best_overlay"))
    dl = scored_candidates(nodes_t, DIALOG_SELECTORS)
    w = Window.partitionBy("page_id").orderBy(F.desc("score"), "sel_idx", "node_id")
    best = dl.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(
        "page_id", F.col("node_id").alias("dialog_id"), F.col("selector").alias("dialog_selector"),
        F.col("score").alias("dialog_score"))
    fb = nodes_t.filter(F.col("tag").isin("div", "section", "aside", "dialog") & _visible(F.col("attrs"))
                        & has_keywords(F.coalesce("text_content", F.lit(""))))
    fb = fb.withColumn("score", static_score(F.lit("fallback"), F.col("text_content"), F.col("attrs")))
    wf = Window.partitionBy("page_id").orderBy(F.desc("score"), "node_id")
    fbest = fb.withColumn("_r", F.row_number().over(wf)).filter("_r = 1").select(
        "page_id", F.col("node_id").alias("fb_id"), F.col("score").alias("fb_score"))
    p = pages.select("page_id", has_keywords("html").alias("has_keywords"), library("html").alias("library"))
    j = p.join(ov, "page_id", "left").join(best, "page_id", "left").join(fbest, "page_id", "left")
    return j.select(
        "page_id", "has_keywords", "library",
        (F.col("has_keywords") & (F.coalesce("best_overlay", F.lit(0)) >= 50)).alias("detected"),
        F.coalesce("best_overlay", F.lit(0)).alias("best_overlay_score"),
        F.coalesce("dialog_id", "fb_id").alias("dialog_id"),
        F.when(F.col("dialog_id").isNotNull(), F.col("dialog_selector"))
        .when(F.col("fb_id").isNotNull(), F.lit("fallback-dialog")).alias("dialog_selector"),
        F.coalesce("dialog_score", "fb_score").alias("dialog_score"))


def _matches(search: Column, pats) -> Column:
    return _any_contains(search, pats)


def consent_buttons(nodes_t: DataFrame, detect: DataFrame) -> DataFrame:
    """``consent_buttons``: buttons inside the dialog (page-wide buttons with
    keywords when the dialog has none), classified in document order: each
    button takes the first still-empty category whose pattern it matches."""
    spark = nodes_t.sparkSession
    btn = M.selector_match(nodes_t, M.selector_table(spark, {"b": BUTTON_SELECTORS})).select("page_id", "node_id")
    b = btn.join(nodes_t, ["page_id", "node_id"]).select(
        "page_id", "node_id", "tag", "id", "class", "classes", "ancestors", "parent_id", "attrs", "text_content")
    d = detect.filter(F.col("dialog_id").isNotNull()).select("page_id", "dialog_id")
    inside = b.join(d, "page_id").filter(F.array_contains("ancestors", F.col("dialog_id"))).drop("dialog_id")
    n_inside = inside.groupBy("page_id").agg(F.count("*").alias("n_in"))
    page_kw = b.filter(has_keywords(F.coalesce("text_content", F.lit("")))).join(n_inside, "page_id", "left_anti")
    chosen = inside.unionByName(page_kw)
    chosen = chosen.filter(F.col("text_content").isNotNull() & (F.col("text_content") != "") & _visible(F.col("attrs")))
    search = F.lower(F.concat_ws(" ", H.js_trim(F.lower("text_content")), F.coalesce("class", F.lit("")),
                                 F.coalesce("id", F.lit(""))))
    chosen = chosen.withColumn("flags", F.struct(*[_matches(search, BUTTON_PATTERNS[k]).alias(k) for k in BUTTON_ORDER]))
    per_page = chosen.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(
        "node_id", "flags", "tag", "id", "class", "classes", "parent_id", "text_content"))).alias("bs"))
    empty = F.struct(*[F.lit(None).cast("int").alias(k) for k in BUTTON_ORDER])

    def step(acc, x):
        expr = None
        for k in BUTTON_ORDER:
            cond = acc[k].isNull() & x["flags"][k]
            new = F.struct(*[(x["node_id"] if kk == k else acc[kk]).alias(kk) for kk in BUTTON_ORDER])
            expr = F.when(cond, new) if expr is None else expr.when(cond, new)
        return expr.otherwise(acc)
    slots = per_page.select("page_id", "bs", F.aggregate("bs", empty, step).alias("slots"))
    rows = slots.select("page_id", "bs", F.explode(F.array(*[
        F.struct(F.lit(k).alias("category"), F.col("slots")[k].alias("node_id")) for k in BUTTON_ORDER])).alias("s"))
    rows = rows.filter(F.col("s.node_id").isNotNull())
    return rows.select("page_id", F.col("s.category").alias("category"), F.col("s.node_id").alias("node_id"),
                       F.filter("bs", lambda e: e["node_id"] == F.col("s.node_id"))[0].alias("b")).select(
        "page_id", "category", "node_id", F.col("b.tag").alias("tag"), F.col("b.id").alias("id"),
        F.col("b.class").alias("class"), F.col("b.classes").alias("classes"), F.col("b.parent_id").alias("parent_id"),
        F.col("b.text_content").alias("text"))


def button_selector(buttons: DataFrame, nodes: DataFrame) -> DataFrame:
    """``consent_button_selector``: id; text selector for consent words;
    up to three classes (with a cookie parent for generic classes); one
    class; text; tag."""
    par = nodes.select("page_id", F.col("node_id").alias("parent_id"), F.col("class").alias("parent_class"))
    j = buttons.join(par, ["page_id", "parent_id"], "left")
    text = H.js_trim(F.coalesce("text", F.lit("")))
    lt = F.lower(text)
    classes = F.filter(F.split(F.coalesce("class", F.lit("")), " "), lambda c: F.trim(c) != "")
    has_text_sel = F.format_string('%s:has-text("%s")', F.col("tag"), text)
    generic = F.exists(classes, lambda c: c.isin(GENERIC_CLASSES))
    combined = F.array_join(F.slice(classes, 1, 3), ".")
    parent_first = F.try_element_at(F.split(F.coalesce("parent_class", F.lit("")), " "), F.lit(1))
    multi = F.when(generic & F.coalesce("parent_class", F.lit("")).contains("cookie"),
                   F.concat(F.lit("."), parent_first, F.lit(" ."), combined)).otherwise(F.concat(F.lit("."), combined))
    single_cls = F.try_element_at(classes, F.lit(1))
    single = F.when(single_cls.isin(GENERIC_CLASSES) & (text != ""),
                    F.format_string('%s.%s:has-text("%s")', F.col("tag"), single_cls, text)) \
        .otherwise(F.concat(F.lit("."), single_cls))
    sel = (F.when(F.coalesce(F.col("id"), F.lit("")) != "", F.concat(F.lit("#"), F.col("id")))
           .when((text != "") & _any_contains(lt, TEXT_SELECTOR_WORDS), has_text_sel)
           .when(F.size(classes) > 1, multi)
           .when(F.size(classes) == 1, single)
           .when(text != "", has_text_sel)
           .otherwise(F.col("tag")))
    return j.select("page_id", "category", "node_id", "text", sel.alias("selector"))


def consent_choice(buttons: DataFrame) -> DataFrame:
    """``consent_choice``: button(s) to click per strategy; accept-all with
    both accept and save buttons is a two-step click."""
    piv = buttons.groupBy("page_id").agg(*[
        F.max_by(F.when(F.col("category") == k, F.col("text")), F.when(F.col("category") == k, F.lit(1))).alias(k)
        for k in BUTTON_ORDER])
    rows = []
    for strat, order in STRATEGIES.items():
        pick = F.coalesce(*[F.col(k) for k in order])
        if strat == "accept-all":
            pick = F.when(F.col("acceptAll").isNotNull() & F.col("save").isNotNull(),
                          F.concat(F.col("acceptAll"), F.lit(" + "), F.col("save"))).otherwise(pick)
        rows.append(F.struct(F.lit(strat).alias("strategy"), pick.alias("clicked")))
    out = piv.select("page_id", F.explode(F.array(*rows)).alias("r"))
    return out.select("page_id", "r.strategy", "r.clicked", F.col("r.clicked").isNotNull().alias("success"))


def dismissed_check(after_nodes_t: DataFrame, pages_after: DataFrame) -> DataFrame:
    """``consent_dismissed_check``: a page is dismissed when no dialog
    candidate remains after the click (anti join) -> success, confidence 95."""
    left = scored_candidates(after_nodes_t, DIALOG_SELECTORS).select("page_id").distinct()
    ok = pages_after.select("page_id").join(left, "page_id", "left_anti").withColumn("dismissed", F.lit(True))
    j = pages_after.select("page_id").join(ok, "page_id", "left")
    d = F.coalesce("dismissed", F.lit(False))
    return j.select("page_id", d.alias("success"), F.when(d, F.lit(95)).otherwise(F.lit(0)).alias("confidence"))


STEP_CLASSES = [("accept", ["accept", "zustimmen"]), ("reject", ["reject", "ablehnen"]),
                ("save", ["save", "speichern"]), ("settings", ["settings", "einstellungen"])]


def step_classify(steps: DataFrame) -> DataFrame:
    """``consent_step_classify``: click steps mapped to accept / reject /
    save / settings by description; later steps overwrite earlier ones."""
    d = F.lower(F.coalesce("description", F.lit("")))
    cat = None
    for name, words in STEP_CLASSES:
        cond = _any_contains(d, words)
        cat = F.when(cond, F.lit(name)) if cat is None else cat.when(cond, F.lit(name))
    s = steps.filter(F.col("action") == "click").withColumn("category", cat).filter(F.col("category").isNotNull())
    return s.groupBy("plan_id", "category").agg(F.max_by("selector", "step_number").alias("selector"))


def plan_stats(verifications: DataFrame) -> DataFrame:
    """``consent_plan_stats``: usage count and rounded success % per (domain, library)."""
    return verifications.groupBy("domain", "library").agg(
        F.count("*").alias("usage_count"),
        F.floor(F.count_if("success") / F.count("*") * 100 + 0.5).cast("int").alias("success_rate"))


def latest_plan(verifications: DataFrame) -> DataFrame:
    """``consent_latest_plan``: newest plan per (domain, library)."""
    return verifications.groupBy("domain", "library").agg(
        F.max_by("plan_id", F.struct("ts", "plan_id")).alias("plan_id"), F.max("ts").alias("last_used"))
