"""Registered cookie-consent queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pagefold.operators import consent as C
from pagefold.operators import dom as M
from pagefold.plans import duck as D
from pagefold.plans import duck_dom as DD
from pagefold.plans.catalog import register
from pagefold.session import materialize
from pagefold.sources import derived as S
from pagefold.sources.tables import pages


def _banner_sql() -> str:
    whens = []
    for i, b in enumerate(S.CONSENT_BANNERS):
        parts = b.split("{id}")
        expr = " || ".join(
            x for j, part in enumerate(parts)
            for x in ([D.q(part)] + (["CAST(page_id AS VARCHAR)"] if j < len(parts) - 1 else [])))
        whens.append(f"WHEN page_id % 4 = {i} THEN {expr}")
    return f"(CASE {' '.join(whens)} END)"


SQL_CONSENT_PAGES = f"""
cpages AS (
  SELECT page_id, url,
    CASE WHEN page_id % 3 = 0 THEN (CASE WHEN regexp_matches(html, '(?i)</body>')
         THEN regexp_replace(html, '(?i)</body>', {_banner_sql()} || '</body>', 'g') ELSE html || {_banner_sql()} END)
         ELSE html END AS html
  FROM pages
)"""


def _kw_sql(e: str) -> str:
    return D.contains_any(f"lower({e})", [k.lower() for k in C.KEYWORDS])


def _lib_sql(e: str) -> str:
    whens = " ".join(f"WHEN {D.contains_any(f'lower({e})', [p.lower() for p in pats])} THEN {D.q(name)}"
                     for name, pats in C.LIBRARIES)
    return f"(CASE {whens} END)"


@register("consent_keywords", oracle=f"WITH {SQL_CONSENT_PAGES} SELECT page_id, {_kw_sql('html')} AS has_keywords FROM cpages")
def consent_keywords(spark, sf_dir):
    return S.consent_pages(spark, sf_dir).select("page_id", C.has_keywords("html").alias("has_keywords"))


@register("consent_library", oracle=f"WITH {SQL_CONSENT_PAGES} SELECT page_id, {_lib_sql('html')} AS library FROM cpages")
def consent_library(spark, sf_dir):
    return S.consent_pages(spark, sf_dir).select("page_id", C.library("html").alias("library"))


def _nodes_t(p):
    nodes, texts = M.shred_pages(p)
    return M.with_text(nodes, texts)


def _attr_sql(name: str) -> str:
    return f"regexp_extract(attr, '\\b{name}=\"([^\"]*)\"', 1)"


def _selector_sql(selector: str) -> str:
    """Condition on an element ``e`` of ``elem`` for a selector of the lists."""
    if ":has-text(" in selector:
        return f"tag = 'div' AND contains(lower(txt), {D.q(selector.split(chr(34))[1].lower())})"
    conds = []
    for name, op, value, cls, tag in re.findall(r'\[([\w-]+)(\*?=)"([^"]*)"\]|\.([\w-]+)|(^[a-z]+)', selector):
        if cls:
            conds.append(f"list_contains(classes, {D.q(cls)})")
        elif tag:
            conds.append(f"tag = {D.q(tag)}")
        else:
            conds.append(f"contains({_attr_sql(name)}, {D.q(value)})" if op == "*=" else f"{_attr_sql(name)} = {D.q(value)}")
    return " AND ".join(conds)


def _score_sql(sel: str) -> str:
    s = f"lower({sel})"
    terms = [(f"contains({s}, 'cookie') AND contains({s}, 'banner')", 35), (f"contains({s}, 'cookie') AND contains({s}, 'dialog')", 35),
             (f"contains({s}, 'cookie-banner-container')", 40), (f"contains({s}, 'consent')", 20), (f"contains({s}, 'disclaimer')", 10),
             (_kw_sql("txt"), 30), ("contains(style, 'position:fixed') OR contains(style, 'position:absolute')", 10),
             ("coalesce(TRY_CAST(regexp_extract(style, 'z-index:(-?[0-9]+)', 1) AS INTEGER), 0) > 100", 10),
             ("NOT (contains(style, 'visibility:hidden') OR regexp_matches(style, 'opacity:0(\\.0*)?(;|$)'))", 5)]
    return "least(100, " + " + ".join(f"(CASE WHEN {c} THEN {n} ELSE 0 END)" for c, n in terms) + ")"


def _candidates_sql(name: str, selectors: list[str]) -> str:
    rows = " UNION ALL ".join(f"SELECT page_id, node_id, {i} AS sel_idx, {D.q(s)} AS selector, txt, style FROM elem WHERE visible AND {_selector_sql(s)}"
                              for i, s in enumerate(selectors))
    return f"{name} AS MATERIALIZED (SELECT page_id, node_id, sel_idx, selector, {_score_sql('selector')} AS score FROM ({rows}))"


def _elements_sql(pages_name: str) -> str:
    """``elem``: elements with text, squeezed style and visibility; candidates by both selector lists."""
    return DD.dom(pages_name) + f""",
elem AS MATERIALIZED (
  SELECT *, NOT (contains(style, 'display:none') OR contains(style, 'visibility:hidden') OR regexp_matches(style, 'opacity:0(\\.0*)?(;|$)')
      OR regexp_matches(attr, '\\shidden[\\s=>]')) AS visible
  FROM (SELECT d.*, coalesce(substring(text, text_start + 1, text_end - text_start), '') AS txt, lower(regexp_replace({_attr_sql('style')}, '\\s', '', 'g')) AS style
        FROM dom d JOIN page_text USING (page_id))),
{_candidates_sql('overlay', C.OVERLAY_SELECTORS)},
{_candidates_sql('dialog', C.DIALOG_SELECTORS)}"""


_BUTTONS = " OR ".join(f"({_selector_sql(x.strip())})" for x in C.BUTTON_SELECTORS.split(","))
_FLAGS = ", ".join(D.contains_any("search", [p.lower() for p in C.BUTTON_PATTERNS[k]]) for k in C.BUTTON_ORDER)

SQL_DETECT = SQL_CONSENT_PAGES + "," + _elements_sql("cpages") + f""",
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, sel_idx, node_id) AS r FROM dialog) WHERE r = 1),
spare AS (SELECT * FROM (SELECT page_id, node_id, row_number() OVER (PARTITION BY page_id ORDER BY {_score_sql("'fallback'")} DESC, node_id) AS r
  FROM elem WHERE tag IN ('div', 'section', 'aside', 'dialog') AND visible AND {_kw_sql('txt')}) WHERE r = 1),
found AS MATERIALIZED (SELECT p.page_id, coalesce(b.node_id, f.node_id) AS dialog_id, (SELECT max(score) FROM overlay o WHERE o.page_id = p.page_id) AS best_overlay
  FROM cpages p LEFT JOIN best b USING (page_id) LEFT JOIN spare f USING (page_id))"""

#: Buttons of the dialog, or those of the page with keywords; each takes the first free category that it matches.
SQL_BUTTONS = SQL_DETECT + f""",
every_button AS (SELECT * FROM elem WHERE {_BUTTONS}),
inside AS (SELECT b.* FROM every_button b JOIN found f ON f.page_id = b.page_id AND list_contains(b.ancestors, f.dialog_id)),
chosen AS (SELECT * FROM inside UNION ALL SELECT * FROM every_button b WHERE {_kw_sql('txt')} AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.page_id = b.page_id)),
searched AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY node_id) AS n,
    lower(regexp_replace(lower(txt), '^\\s+|\\s+$', '', 'g') || ' ' || coalesce(class, '') || ' ' || coalesce(id, '')) AS search FROM chosen WHERE txt <> '' AND visible),
flagged AS MATERIALIZED (SELECT page_id, n, node_id, [{_FLAGS}] AS flags FROM searched),
slot AS (
  SELECT page_id, CAST(0 AS BIGINT) AS n, CAST([NULL, NULL, NULL, NULL, NULL] AS INTEGER[]) AS taken FROM (SELECT DISTINCT page_id FROM flagged)
  UNION ALL
  SELECT page_id, n, list_transform(range(1, 6), lambda k: CASE WHEN k = free THEN node_id ELSE taken[k] END)
  FROM (SELECT s.page_id, f.n, f.node_id, s.taken, list_filter(range(1, 6), lambda k: s.taken[k] IS NULL AND f.flags[k])[1] AS free
        FROM slot s JOIN flagged f ON f.page_id = s.page_id AND f.n = s.n + 1)),
filled AS (SELECT page_id, arg_max(taken, n) AS taken FROM slot GROUP BY ALL),
button AS MATERIALIZED (SELECT p.page_id, p.category, e.node_id, e.tag, e.id, e.class, e.parent_id, e.txt
  FROM (SELECT page_id, unnest([{', '.join(D.q(k) for k in C.BUTTON_ORDER)}]) AS category, unnest(taken) AS node_id FROM filled) p
  JOIN elem e ON e.page_id = p.page_id AND e.node_id = p.node_id)"""


@register("consent_candidates", oracle=f"WITH RECURSIVE {SQL_DETECT} SELECT page_id, node_id, sel_idx, selector FROM dialog")
def consent_candidates(spark, sf_dir):
    p = S.consent_pages(spark, sf_dir)
    return C.candidates(_nodes_t(p), C.DIALOG_SELECTORS).select("page_id", "node_id", "sel_idx", "selector")


@register("consent_score", oracle=f"WITH RECURSIVE {SQL_DETECT} SELECT page_id, selector, score FROM overlay")
def consent_score(spark, sf_dir):
    """Static score of every overlay candidate."""
    p = S.consent_pages(spark, sf_dir)
    return C.scored_candidates(_nodes_t(p), C.OVERLAY_SELECTORS).select("page_id", "selector", "score")


def _detect(spark, sf_dir):
    p = S.consent_pages(spark, sf_dir)
    n = _nodes_t(p)
    return p, n, materialize(C.consent_detect(n, p), "consent-detect")


@register("consent_detect", oracle=f"""
WITH RECURSIVE {SQL_DETECT}
SELECT p.page_id, {_kw_sql('p.html')} AS has_keywords, {_lib_sql('p.html')} AS library, {_kw_sql('p.html')} AND coalesce(best_overlay, 0) >= 50 AS detected,
  coalesce(best_overlay, 0) AS best_overlay_score, dialog_id
FROM cpages p JOIN found USING (page_id)""")
def consent_detect(spark, sf_dir):
    """Detection per page: keywords, vendor, best overlay score >= 50, and the dialog."""
    _, _, d = _detect(spark, sf_dir)
    return d.select("page_id", "has_keywords", "library", "detected", "best_overlay_score", "dialog_id")


def _buttons(spark, sf_dir):
    _, n, d = _detect(spark, sf_dir)
    return n, materialize(C.consent_buttons(n, d), "consent-buttons")


@register("consent_buttons", oracle=f"WITH RECURSIVE {SQL_BUTTONS} SELECT page_id, category, node_id, txt AS text FROM button")
def consent_buttons(spark, sf_dir):
    return _buttons(spark, sf_dir)[1].select("page_id", "category", "node_id", "text")


def _button_selector_sql() -> str:
    text = "regexp_replace(txt, '^\\s+|\\s+$', '', 'g')"
    generic = f"len(list_filter(cs, lambda c: c IN ({', '.join(D.q(c) for c in C.GENERIC_CLASSES)}))) > 0"
    first_generic = f"cs[1] IN ({', '.join(D.q(c) for c in C.GENERIC_CLASSES)})"
    has_text = "b.tag || ':has-text(\"' || t || '\")'"
    return f"""
named AS (SELECT *, {text} AS t, list_filter(string_split(coalesce(class, ''), ' '), lambda c: trim(c) <> '') AS cs FROM button)
SELECT b.page_id, b.category, b.node_id, t AS text, CASE WHEN coalesce(b.id, '') <> '' THEN '#' || b.id
  WHEN t <> '' AND {D.contains_any('lower(t)', C.TEXT_SELECTOR_WORDS)} THEN {has_text}
  WHEN len(cs) > 1 THEN CASE WHEN {generic} AND contains(coalesce(p.class, ''), 'cookie') THEN '.' || string_split(p.class, ' ')[1] || ' .' ELSE '.' END || array_to_string(cs[1:3], '.')
  WHEN len(cs) = 1 THEN CASE WHEN {first_generic} AND t <> '' THEN b.tag || '.' || cs[1] || ':has-text("' || t || '")' ELSE '.' || cs[1] END
  WHEN t <> '' THEN {has_text} ELSE b.tag END AS selector
FROM named b LEFT JOIN dom p ON p.page_id = b.page_id AND p.node_id = b.parent_id"""


@register("consent_button_selector", oracle=f"WITH RECURSIVE {SQL_BUTTONS}, {_button_selector_sql()}")
def consent_button_selector(spark, sf_dir):
    n, b = _buttons(spark, sf_dir)
    return C.button_selector(b, n)


def _choice_sql() -> str:
    def pick(strategy, order):
        first = f"coalesce({', '.join('any_value(txt) FILTER (WHERE category = ' + D.q(k) + ')' for k in order)})"
        accept, save = (f"any_value(txt) FILTER (WHERE category = {D.q(k)})" for k in ("acceptAll", "save"))
        both = f"CASE WHEN {accept} IS NOT NULL AND {save} IS NOT NULL THEN {accept} || ' + ' || {save} ELSE {first} END"
        return f"SELECT page_id, {D.q(strategy)} AS strategy, {both if strategy == 'accept-all' else first} AS clicked FROM button GROUP BY page_id"
    return " UNION ALL ".join(pick(s, o) for s, o in C.STRATEGIES.items())


@register("consent_choice", oracle=f"""
WITH RECURSIVE {SQL_BUTTONS}, choice AS ({_choice_sql()}) SELECT page_id, strategy, clicked, clicked IS NOT NULL AS success FROM choice""")
def consent_choice(spark, sf_dir):
    return C.consent_choice(_buttons(spark, sf_dir)[1])


@register("consent_dismissed_check", oracle=f"""
WITH RECURSIVE {SQL_CONSENT_PAGES},
after_click AS (SELECT c.page_id, c.url, CASE WHEN c.page_id % 6 = 3 THEN c.html ELSE p.html END AS html FROM cpages c JOIN pages p USING (page_id) WHERE c.page_id % 3 = 0),
{_elements_sql('after_click')}
SELECT page_id, NOT left_over AS success, CASE WHEN left_over THEN 0 ELSE 95 END AS confidence
FROM (SELECT page_id, EXISTS (SELECT 1 FROM dialog d WHERE d.page_id = a.page_id) AS left_over FROM after_click a)""")
def consent_dismissed_check(spark, sf_dir):
    """Pages with a banner after the click: where it worked the banner is gone, where it
    did not the page is as before."""
    after = S.after_click_pages(spark, sf_dir)
    return C.dismissed_check(_nodes_t(after), after)


SQL_VERIF = f"""
verif AS (
  SELECT 'site-' || CAST(user_id % 40 AS VARCHAR) || '.example.org' AS domain,
         ({', '.join(D.q(x) for x in S.CONSENT_LIBS).join('[]')})[event_id % 6 + 1] AS library,
         ts, value > 25 AS success, event_id, 'ccp-' || CAST(event_id AS VARCHAR) AS plan_id
  FROM events WHERE event_type = 'signup'
),
steps AS (
  SELECT plan_id, i + 1 AS step_number,
         CASE WHEN (event_id + i) % 7 = 0 THEN 'wait' ELSE 'click' END AS action,
         '#btn-' || CAST(i AS VARCHAR) AS selector,
         ({', '.join(D.q(x) for x in S.CONSENT_STEP_TEXTS).join('[]')})[(event_id + i) % 6 + 1] AS description
  FROM (SELECT plan_id, event_id, unnest(range(CAST(event_id % 3 + 1 AS BIGINT))) AS i FROM verif)
)"""


def _step_cat_sql() -> str:
    d = "lower(coalesce(description, ''))"
    whens = " ".join(f"WHEN {D.contains_any(d, words)} THEN {D.q(name)}" for name, words in C.STEP_CLASSES)
    return f"(CASE {whens} END)"


@register("consent_step_classify", oracle=f"""
WITH {SQL_VERIF}
SELECT plan_id, category, arg_max(selector, step_number) AS selector FROM (
  SELECT *, {_step_cat_sql()} AS category FROM steps WHERE action = 'click') WHERE category IS NOT NULL
GROUP BY 1, 2""")
def consent_step_classify(spark, sf_dir):
    return C.step_classify(S.consent_plan_steps(spark, sf_dir))


@register("consent_plan_stats", oracle=f"""
WITH {SQL_VERIF}
SELECT domain, library, count(*) AS usage_count,
       CAST(floor(count(*) FILTER (WHERE success) / count(*) * 100 + 0.5) AS INTEGER) AS success_rate
FROM verif GROUP BY 1, 2""")
def consent_plan_stats(spark, sf_dir):
    return C.plan_stats(S.consent_verifications(spark, sf_dir))


@register("consent_latest_plan", oracle=f"""
WITH {SQL_VERIF}
SELECT domain, library, arg_max(plan_id, (ts, plan_id)) AS plan_id, max(ts) AS last_used FROM verif GROUP BY 1, 2""")
def consent_latest_plan(spark, sf_dir):
    return C.latest_plan(S.consent_verifications(spark, sf_dir)).withColumn(
        "last_used", F.col("last_used").cast("timestamp_ntz"))
