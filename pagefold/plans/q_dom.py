"""Registered DOM-tier queries.

These run the Python shred once per query; the oracles build the element tree
of the pages in SQL (``duck_dom``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefold.operators import chunks as K
from pagefold.operators import dom as M
from pagefold.operators import telemetry as T
from pagefold.plans import duck as D
from pagefold.plans import duck_dom as DD
from pagefold.plans.catalog import register
from pagefold.sources.tables import pages

_CLEAN = ("regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), "
          "'(?is)(<script\\b[^>]*>).*?</script>', '\\1', 'g'), '(?is)(<style\\b[^>]*>).*?</style>', '\\1', 'g')")


def _nodes(spark, sf_dir):
    """The node table, written once: every step of a query reads it again."""
    return M.shred_pages(pages(spark, sf_dir))[0]


SQL_DOM = DD.dom()


@register("dom_shred", oracle=f"""
WITH RECURSIVE {SQL_DOM}
SELECT page_id, node_id, parent_id, depth, tag, id, class, array_to_string(ancestors, ',') AS ancestors, child_count, type_idx,
  text_start, text_end, src_start, src_end FROM dom""")
def dom_shred(spark, sf_dir):
    """Every element of every page with its place in the tree, the text and the source."""
    return _nodes(spark, sf_dir).select("page_id", "node_id", "parent_id", "depth", "tag", "id", "class", F.array_join("ancestors", ",").alias("ancestors"),
                                        "child_count", "type_idx", "text_start", "text_end", "src_start", "src_end")


DOM_SELECTORS = {"nav_a": "nav a", "div_ad": "div.ad", "article_p": "article > p", "h1": "h1",
                 "li_link": "ul > li > a[href]"}


@register("selector_match", oracle=f"""
WITH RECURSIVE {SQL_DOM},
up AS (SELECT d.*, p.tag AS p_tag, g.tag AS g_tag FROM dom d LEFT JOIN dom p ON p.page_id = d.page_id AND p.node_id = d.parent_id
       LEFT JOIN dom g ON g.page_id = p.page_id AND g.node_id = p.parent_id)
SELECT page_id, 'nav_a' AS sel_id, node_id FROM dom d WHERE tag = 'a' AND EXISTS (
  SELECT 1 FROM dom n WHERE n.page_id = d.page_id AND n.tag = 'nav' AND list_contains(d.ancestors, n.node_id))
UNION ALL SELECT page_id, 'div_ad', node_id FROM dom WHERE tag = 'div' AND list_contains(classes, 'ad')
UNION ALL SELECT page_id, 'article_p', node_id FROM up WHERE tag = 'p' AND p_tag = 'article'
UNION ALL SELECT page_id, 'h1', node_id FROM dom WHERE tag = 'h1'
UNION ALL SELECT page_id, 'li_link', node_id FROM up WHERE tag = 'a' AND p_tag = 'li' AND g_tag = 'ul' AND regexp_matches(attr, '\\bhref=')""")
def selector_match(spark, sf_dir):
    """Every element that one of five selectors matches."""
    steps = M.selector_table(spark, DOM_SELECTORS)
    return M.selector_match(_nodes(spark, sf_dir), steps).select("page_id", "sel_id", "node_id")


@register("element_path", oracle=f"""
WITH RECURSIVE {SQL_DOM},
chain AS (SELECT page_id, node_id, unnest(list_append(ancestors, node_id)) AS step_id, unnest(range(depth + 1)) AS lvl FROM dom),
named AS (SELECT c.page_id, c.node_id, c.lvl, s.id IS NOT NULL AS has_id,
    CASE WHEN s.id IS NOT NULL THEN '#' || s.id ELSE s.tag || CASE WHEN len(s.classes) > 0 THEN '.' || array_to_string(s.classes[1:2], '.') ELSE '' END END AS txt
  FROM chain c JOIN dom s ON s.page_id = c.page_id AND s.node_id = c.step_id),
cut AS (SELECT *, coalesce(max(lvl) FILTER (WHERE has_id) OVER (PARTITION BY page_id, node_id), 0) AS from_lvl FROM named)
SELECT page_id, node_id, string_agg(txt, ' > ' ORDER BY lvl) AS path FROM cut WHERE lvl >= from_lvl GROUP BY ALL""")
def element_path(spark, sf_dir):
    return M.element_path(_nodes(spark, sf_dir))


@register("container_signature", oracle=f"""
WITH RECURSIVE {SQL_DOM}
SELECT page_id, node_id, tag || '.' || coalesce(class, '') || '#' || coalesce(id, '') || '[' || child_count || ']' AS signature FROM dom""")
def container_signature(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return n.select("page_id", "node_id", M.container_signature(n).alias("signature"))


@register("specific_selector", oracle=f"""
WITH RECURSIVE {SQL_DOM},
cls AS (SELECT page_id, node_id, unnest(classes) AS cls FROM dom),
one_cls AS (SELECT page_id, cls FROM cls GROUP BY ALL HAVING count(*) = 1),
u_cls AS (SELECT page_id, node_id, min(cls) AS u_cls FROM cls JOIN one_cls USING (page_id, cls) GROUP BY ALL),
one_id AS (SELECT page_id, id FROM dom WHERE id IS NOT NULL GROUP BY ALL HAVING count(*) = 1),
data AS (SELECT page_id, node_id, unnest(regexp_extract_all(attr, '\\s(data-[a-zA-Z-]+="[^"]*")', 1)) AS kv FROM dom),
one_data AS (SELECT page_id, kv FROM data GROUP BY ALL HAVING count(*) = 1),
u_data AS (SELECT page_id, node_id, min('[' || kv || ']') AS u_data FROM data JOIN one_data USING (page_id, kv) GROUP BY ALL)
SELECT d.page_id, d.node_id, coalesce('.' || u_cls, '#' || one_id.id, u_data,
    CASE WHEN len(d.classes) > 0 THEN p.tag || CASE WHEN len(p.classes) > 0 THEN '.' || p.classes[1] ELSE '' END || ' > .' || d.classes[1] END,
    d.tag || ':nth-of-type(' || d.type_idx || ')') AS selector
FROM dom d LEFT JOIN u_cls USING (page_id, node_id) LEFT JOIN u_data USING (page_id, node_id) LEFT JOIN one_id ON one_id.page_id = d.page_id AND one_id.id = d.id
LEFT JOIN dom p ON p.page_id = d.page_id AND p.node_id = d.parent_id""")
def specific_selector(spark, sf_dir):
    return M.specific_selector(_nodes(spark, sf_dir))


def _container_order_sql() -> str:
    tag_re = "<([a-zA-Z][a-zA-Z0-9]*)([^>]*)>"
    return f"""
WITH c AS (SELECT page_id, {_CLEAN} AS c FROM pages),
t AS (SELECT page_id, regexp_extract_all(c, {D.q(tag_re)}, 1) AS tags, regexp_extract_all(c, {D.q(tag_re)}, 2) AS attrs
      FROM c),
n AS (SELECT page_id, unnest(range(len(tags))) AS node_id, lower(unnest(tags)) AS tag, unnest(attrs) AS attr FROM t),
k AS (SELECT page_id, node_id, tag,
        nullif(list_filter(string_split_regex(trim(regexp_extract(attr, '\\bclass="([^"]*)"', 1)), '\\s+'),
                           lambda x: x <> '')[1], '') AS primary_class,
        regexp_matches(attr, '\\bclass=') AS has_class
      FROM n)
SELECT page_id, node_id, tag, primary_class,
       row_number() OVER (PARTITION BY page_id, tag, coalesce(primary_class, '') ORDER BY node_id) AS "order",
       count(*) OVER (PARTITION BY page_id, tag, coalesce(primary_class, '')) AS n_similar
FROM k"""


@register("container_order", oracle=_container_order_sql())
def container_order(spark, sf_dir):
    return M.container_order(_nodes(spark, sf_dir))


#: Children of each element, and the verdict on it.
SQL_LISTS = f"""
kids AS (SELECT page_id, parent_id AS node_id, count(*) AS n, arg_min(tag, node_id) AS first_tag, list(tag) AS tags FROM dom WHERE parent_id >= 0 GROUP BY ALL),
lists AS (
  SELECT page_id, node_id, tag, class, coalesce(n, 0) AS n_children, coalesce(tag IN ('ul', 'ol', 'dl') OR {D.contains_any("lower(coalesce(class, ''))", M.LIST_CLASS_WORDS)}
      OR (n >= 3 AND len(list_filter(tags, lambda t: t = first_tag)) >= n * 0.7 AND first_tag NOT IN ('article', 'li', 'div'))
      OR (n >= 3 AND first_tag = 'article' AND len(list_filter(tags, lambda t: t = first_tag)) >= 3), false) AS is_list
  FROM dom LEFT JOIN kids USING (page_id, node_id))"""


@register("is_list_container", oracle=f"WITH RECURSIVE {SQL_DOM}, {SQL_LISTS} SELECT * FROM lists")
def is_list_container(spark, sf_dir):
    return M.is_list_container(_nodes(spark, sf_dir))


def _structural(spark, sf_dir):
    p = pages(spark, sf_dir)
    return K.structural_extract(M.shred_pages(p)[0], p)


def _structural_sql() -> str:
    """``structural(page_id, seq, category, content)`` in the order of categories, selectors and elements."""
    def cond(sel):
        if sel.startswith("."):
            return f"list_contains(classes, {D.q(sel[1:])})"
        if sel.startswith("[role="):
            return f"regexp_extract(attr, '\\brole=\"([^\"]*)\"', 1) = {D.q(sel.split(chr(34))[1])}"
        if sel.startswith("[class*="):
            return f"contains(coalesce(class, ''), {D.q(sel.split(chr(34))[1])})"
        return f"tag = {D.q(sel)}"
    parts = [f"SELECT page_id, {c} AS c, {k} AS k, {D.q(cat)} AS category, node_id, src_start, src_end FROM dom WHERE {cond(sel)}"
             for c, (cat, sels) in enumerate(K.STRUCTURAL.items()) for k, sel in enumerate(sels)]
    return f"""
picked AS ({' UNION ALL '.join(parts)}),
structural AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY c, k, node_id) - 1 AS seq, category, node_id,
  substring(html, src_start + 1, src_end - src_start) AS content FROM picked JOIN page_text USING (page_id))"""


@register("structural_extract", oracle=f"""
WITH RECURSIVE {SQL_DOM}, {_structural_sql()}
SELECT page_id, seq, category, node_id, length(content) AS chars, md5(content) AS content_md5 FROM structural""")
def structural_extract(spark, sf_dir):
    """Every element of each structural category, in order, with its source."""
    return _structural(spark, sf_dir).select("page_id", "seq", "category", "node_id", F.length("content").alias("chars"), F.md5("content").alias("content_md5"))


def _chunks(spark, sf_dir):
    p = pages(spark, sf_dir)
    nodes, _ = M.shred_pages(p)
    st = K.structural_extract(nodes, p)
    sem = K.chunk_semantic(nodes, p)
    return p, st, sem


#: Chunks as the operators make them: elements packed in order, then those of each category, without repeats.
SQL_CHUNKS = SQL_DOM + "," + _structural_sql() + f""",
els AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY node_id) AS n, substring(html, src_start + 1, src_end - src_start) AS el
        FROM dom JOIN page_text USING (page_id) WHERE tag IN ({', '.join(D.q(t) for t in K.SEMANTIC_TAGS)})),
pack AS (
  SELECT page_id, n, CAST(0 AS BIGINT) AS idx, CAST(length(el) AS BIGINT) AS size FROM els WHERE n = 1
  UNION ALL
  SELECT e.page_id, e.n, CASE WHEN p.size + length(e.el) > {K.MAX_CHUNK} AND p.size > 0 THEN p.idx + 1 ELSE p.idx END,
    CASE WHEN p.size + length(e.el) > {K.MAX_CHUNK} AND p.size > 0 THEN length(e.el) ELSE p.size + length(e.el) END
  FROM pack p JOIN els e ON e.page_id = p.page_id AND e.n = p.n + 1),
semantic AS (SELECT page_id, idx, string_agg(el, '' ORDER BY n) AS content FROM pack JOIN els USING (page_id, n) GROUP BY ALL),
both_kinds AS (SELECT page_id, 0 AS part, idx, 'semantic' AS type, CAST(NULL AS VARCHAR) AS category, content FROM semantic
         UNION ALL SELECT page_id, 1, seq, 'structural', category, content FROM structural),
firsts AS (SELECT *, row_number() OVER (PARTITION BY page_id, left(content, 100) ORDER BY part, idx) AS nth FROM both_kinds),
hybrid AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY part, idx) - 1 AS seq,
             coalesce(category = 'mainContent', false) OR contains(content, '<main') OR contains(content, '<article') AS keep FROM firsts WHERE nth = 1)"""


@register("chunk_semantic", oracle=f"""
WITH RECURSIVE {SQL_CHUNKS}
SELECT page_id, idx, length(content) AS chars, md5(content) AS content_md5 FROM semantic""")
def chunk_semantic(spark, sf_dir):
    _, _, sem = _chunks(spark, sf_dir)
    return sem.select("page_id", "idx", F.length("content").alias("chars"), F.md5("content").alias("content_md5"))


@register("chunk_structural", oracle="""
SELECT page_id, idx, category, chars FROM (
  SELECT page_id, 0 AS idx, 'mainContent' AS category,
         length(regexp_extract(html, '(?is)<article\\b.*?</article>', 0)) AS chars FROM pages
  UNION ALL SELECT page_id, 1, 'navigation', length(regexp_extract(html, '(?is)<nav\\b.*?</nav>', 0)) FROM pages
  UNION ALL SELECT page_id, 2, 'advertisements',
         length(regexp_extract(html, '(?is)<div class="ad"[^>]*>.*?</div>', 0)) FROM pages
  UNION ALL SELECT page_id, 3, 'footers', length(regexp_extract(html, '(?is)<footer\\b.*?</footer>', 0)) FROM pages)
WHERE chars > 0""")
def chunk_structural(spark, sf_dir):
    _, st, _ = _chunks(spark, sf_dir)
    c = K.chunk_structural(st)
    return c.select("page_id", "idx", "category", F.length("content").alias("chars"))


@register("chunk_hybrid", oracle=f"WITH RECURSIVE {SQL_CHUNKS} SELECT page_id, seq, type, category, length(content) AS chars FROM hybrid")
def chunk_hybrid(spark, sf_dir):
    _, st, sem = _chunks(spark, sf_dir)
    h = K.chunk_hybrid(sem, K.chunk_structural(st))
    return h.select("page_id", "seq", "type", "category", F.length("content").alias("chars"))


@register("chunk_classify", oracle=f"""
WITH RECURSIVE {SQL_CHUNKS}
SELECT page_id, seq, CASE WHEN keep THEN 8 ELSE 3 END AS relevance, CASE WHEN keep THEN 'main-content' ELSE 'unknown' END AS content_type, keep FROM hybrid""")
def chunk_classify(spark, sf_dir):
    _, st, sem = _chunks(spark, sf_dir)
    c = K.chunk_classify(K.chunk_hybrid(sem, K.chunk_structural(st)))
    return c.select("page_id", "seq", "relevance", "content_type", "keep")


@register("chunk_merge", oracle=f"""
WITH RECURSIVE {SQL_CHUNKS},
whole AS (SELECT page_id, string_agg(content, '' ORDER BY seq) AS content FROM structural WHERE category = 'mainContent' GROUP BY ALL),
m AS (SELECT page_id, count(*) AS n_chunks, count(*) FILTER (WHERE keep) AS n_kept, coalesce(list(content ORDER BY seq) FILTER (WHERE keep), []) AS kept FROM hybrid GROUP BY ALL),
d AS (SELECT m.*, '<!DOCTYPE html>' || chr(10) || '<html>' || chr(10) || '<head>' || chr(10) || '  <meta charset="UTF-8">' || chr(10) || '  <title>Compressed Content</title>'
    || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || '  '
    || array_to_string(list_concat(kept, CASE WHEN coalesce(whole.content, '') <> '' THEN [whole.content] ELSE [] END), chr(10)) || chr(10) || '</body>' || chr(10) || '</html>' AS doc
  FROM m LEFT JOIN whole USING (page_id))
SELECT page_id, n_chunks, n_kept, n_chunks - n_kept AS n_removed, length(doc) AS doc_chars, round(length(doc) / length(html), 6) AS size_ratio
FROM d JOIN page_text USING (page_id)""")
def chunk_merge(spark, sf_dir):
    p, st, sem = _chunks(spark, sf_dir)
    c = K.chunk_classify(K.chunk_hybrid(sem, K.chunk_structural(st)))
    m = K.chunk_merge(c, st, p)
    return m.select("page_id", "n_chunks", "n_kept", "n_removed", F.length("document").alias("doc_chars"),
                    F.round("size_ratio", 6).alias("size_ratio"))


@register("focus_content_areas", oracle="""
SELECT page_id, CASE WHEN a = '' THEN 0 ELSE 1 END AS n_elements, length(f) AS chars, md5(f) AS focused_md5 FROM (
  SELECT page_id, a, CASE WHEN a = '' THEN html ELSE '<html><head></head><body>' || a || '</body></html>' END AS f
  FROM (SELECT page_id, html, regexp_extract(html, '(?is)<article\\b.*?</article>', 0) AS a FROM pages))""")
def focus_content_areas(spark, sf_dir):
    p = pages(spark, sf_dir)
    f = K.focus_content_areas(M.dom_shred(p), p, ["article", ".content"])
    return f.select("page_id", "n_elements", F.length("focused").alias("chars"), F.md5("focused").alias("focused_md5"))


@register("llm_progressive_context", oracle=f"""
WITH RECURSIVE {SQL_CHUNKS},
pieces AS (SELECT page_id, seq, CASE WHEN keep THEN chr(10) || chr(10) || '--- Chunk chunk-' || idx || ' ---' || chr(10) || left(content, 500) END AS piece FROM hybrid),
acc AS (SELECT page_id, seq, right(coalesce(string_agg(piece, '') OVER (PARTITION BY page_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), 4000) AS context FROM pieces)
SELECT page_id, seq, length(context) AS context_chars, md5(context) AS context_md5, least(seq, 2) AS n_recent FROM acc""")
def llm_progressive_context(spark, sf_dir):
    _, st, sem = _chunks(spark, sf_dir)
    c = K.chunk_classify(K.chunk_hybrid(sem, K.chunk_structural(st)))
    pc = T.llm_progressive_context(c, "page_id", "seq")
    return pc.select("page_id", "seq", F.length("accumulated_context").alias("context_chars"), F.md5("accumulated_context").alias("context_md5"),
                     F.size("recent_chunks").alias("n_recent"))
