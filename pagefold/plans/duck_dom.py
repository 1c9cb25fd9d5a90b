"""The element tree of a page in DuckDB SQL, for the oracles of the DOM queries.

Independent of the Python parser: the page is cut into tokens by one regular expression,
and a recursive query carries the stack of open elements from token to token.  It covers
what the pages hold (comments, scripts and styles, double-quoted attributes, void
elements, implied ends of ``p`` and list items).
"""

from __future__ import annotations

from pagefold.plans import duck as D

_TOKEN = (r"(?is)<!--.*?-->|<![^>]*>|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|</?[a-z][^>]*>|[^<]+|<")
_VOID = "('area','base','br','col','embed','hr','img','input','link','meta','param','source','track','wbr')"
_ENDS_P = ("('address','article','aside','blockquote','details','div','dl','fieldset','figcaption','figure','footer','form','h1','h2','h3','h4','h5','h6',"
           "'header','hgroup','hr','main','menu','nav','ol','p','pre','section','table','ul')")
_SCOPE = "['applet','caption','html','table','td','th','marquee','object','template','button']"


def _last(tags: str, wanted: str) -> str:
    """Place of the last of ``tags`` that is in the list ``wanted``; 0 if there is none."""
    return f"coalesce(list_max(list_filter(range(1, len({tags}) + 1), lambda k: list_contains({wanted}, {tags}[k]))), 0)"


def dom(pages: str = "pages") -> str:
    """CTEs up to ``dom(page_id, node_id, parent_id, depth, tag, attr, id, class, classes, ancestors, child_count,
    type_idx, src_start, src_end, text_start, text_end)`` and ``page_text(page_id, html, text)``; needs WITH RECURSIVE."""
    entities = "t"
    for ent, ch in D.ENTITIES:
        entities = f"replace({entities}, {D.q(ent)}, {D.q(ch)})"
    return f"""
dtok AS (SELECT page_id, unnest(regexp_extract_all(html, {D.q(_TOKEN)})) AS t, generate_subscripts(regexp_extract_all(html, {D.q(_TOKEN)}), 1) AS i FROM {pages}),
dkind AS (
  SELECT page_id, i, t, CASE WHEN t LIKE '<!%' THEN 'none' WHEN regexp_matches(t, '(?i)^<(script|style)\\b') THEN 'raw' WHEN t LIKE '</%' THEN 'end'
      WHEN regexp_matches(t, '(?i)^<[a-z]') THEN 'start' ELSE 'text' END AS kind,
    lower(regexp_extract(t, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM dtok),
dpiece AS (
  SELECT *, CASE kind WHEN 'text' THEN {entities} WHEN 'raw' THEN regexp_replace(regexp_replace(t, '^<[^>]*>', ''), '</[a-zA-Z]*>$', '') ELSE '' END AS shown FROM dkind),
dplace AS MATERIALIZED (
  SELECT *, CAST(sum(length(t)) OVER w - length(t) AS BIGINT) AS src, CAST(sum(length(shown)) OVER w - length(shown) AS BIGINT) AS txt,
    CAST(count(*) FILTER (WHERE kind IN ('start', 'raw')) OVER w AS INTEGER) - 1 AS node_id
  FROM dpiece WINDOW w AS (PARTITION BY page_id ORDER BY i)),
dwalk AS (
  SELECT page_id, CAST(0 AS BIGINT) AS i, CAST([] AS INTEGER[]) AS ids, CAST([] AS VARCHAR[]) AS tags, CAST([] AS INTEGER[]) AS above FROM {pages}
  UNION ALL
  SELECT page_id, i, CASE kind WHEN 'start' THEN CASE WHEN void THEN ids[1:keep] ELSE list_append(ids[1:keep], node_id) END ELSE ids[1:keep] END,
    CASE kind WHEN 'start' THEN CASE WHEN void THEN tags[1:keep] ELSE list_append(tags[1:keep], tag) END ELSE tags[1:keep] END, ids[1:keep]
  FROM (
    SELECT *, CASE WHEN kind = 'end' THEN CASE WHEN same > 0 THEN same - 1 ELSE len(tags) END
      WHEN kind IN ('start', 'raw') AND item > item_scope AND item <= keep1 THEN item - 1 WHEN kind IN ('start', 'raw') THEN keep1 ELSE len(tags) END AS keep
    FROM (
      SELECT w.page_id, p.i, p.kind, p.tag, p.node_id, w.ids, w.tags, p.tag IN {_VOID} OR p.kind = 'raw' OR p.t LIKE '%/>' AS void,
        {_last('w.tags', '[p.tag]')} AS same,
        CASE WHEN p.tag IN {_ENDS_P} AND {_last('w.tags', "['p']")} > {_last('w.tags', _SCOPE)} THEN {_last('w.tags', "['p']")} - 1 ELSE len(w.tags) END AS keep1,
        CASE WHEN p.tag = 'li' THEN {_last('w.tags', "['li']")} WHEN p.tag IN ('dt', 'dd') THEN {_last('w.tags', "['dt', 'dd']")}
          WHEN p.tag IN ('td', 'th') THEN {_last('w.tags', "['td', 'th']")} WHEN p.tag = 'tr' THEN {_last('w.tags', "['tr']")}
          WHEN p.tag = 'option' THEN {_last('w.tags', "['option']")} ELSE 0 END AS item,
        CASE WHEN p.tag = 'li' THEN {_last('w.tags', f"list_concat({_SCOPE}, ['ol', 'ul'])")}
          WHEN p.tag IN ('td', 'th') THEN {_last('w.tags', "['applet','caption','html','table','marquee','object','template','button']")}
          ELSE {_last('w.tags', _SCOPE)} END AS item_scope
      FROM dwalk w JOIN dplace p ON p.page_id = w.page_id AND p.i = w.i + 1))),
dopen AS (
  SELECT p.page_id, p.node_id, p.i, p.t, p.tag, p.kind, p.src, p.txt, w.above AS ancestors, p.tag IN {_VOID} OR p.t LIKE '%/>' AS void
  FROM dplace p JOIN dwalk w ON w.page_id = p.page_id AND w.i = p.i WHERE p.kind IN ('start', 'raw')),
dheld AS (SELECT page_id, unnest(ids) AS node_id, i FROM dwalk),
dclose AS (SELECT page_id, node_id, max(i) + 1 AS i FROM dheld GROUP BY ALL),
dsize AS (SELECT page_id, CAST(sum(length(t)) AS BIGINT) AS n_src, CAST(sum(length(shown)) AS BIGINT) AS n_txt FROM dplace GROUP BY ALL),
page_text AS (SELECT page_id, string_agg(t, '' ORDER BY i) AS html, string_agg(shown, '' ORDER BY i) AS text FROM dplace GROUP BY ALL),
dnode AS (
  SELECT o.page_id, o.node_id, coalesce(o.ancestors[-1], -1) AS parent_id, len(o.ancestors) AS depth, o.tag,
    CASE WHEN o.kind = 'raw' THEN regexp_extract(o.t, '^<[^>]*>', 0) ELSE o.t END AS attr, o.ancestors, o.src AS src_start, o.txt AS text_start,
    CASE WHEN o.kind = 'raw' OR o.void THEN o.src + length(o.t) WHEN c.kind = 'end' THEN c.src + length(c.t) WHEN c.i IS NOT NULL THEN c.src ELSE s.n_src END AS src_end,
    CASE WHEN o.kind = 'raw' THEN o.txt + length(r.shown) WHEN o.void THEN o.txt WHEN c.i IS NOT NULL THEN c.txt ELSE s.n_txt END AS text_end
  FROM dopen o JOIN dsize s USING (page_id) JOIN dplace r ON r.page_id = o.page_id AND r.i = o.i
  LEFT JOIN dclose k ON k.page_id = o.page_id AND k.node_id = o.node_id LEFT JOIN dplace c ON c.page_id = o.page_id AND c.i = k.i),
dom AS MATERIALIZED (
  SELECT *, nullif(regexp_extract(attr, '\\bid="([^"]*)"', 1), '') AS id,
    CASE WHEN regexp_matches(attr, '\\bclass="') THEN regexp_extract(attr, '\\bclass="([^"]*)"', 1) END AS class,
    list_filter(string_split_regex(trim(regexp_extract(attr, '\\bclass="([^"]*)"', 1)), '\\s+'), lambda x: x <> '') AS classes,
    row_number() OVER (PARTITION BY page_id, parent_id, tag ORDER BY node_id) AS type_idx,
    (SELECT count(*) FROM dnode k WHERE k.page_id = d.page_id AND k.parent_id = d.node_id) AS child_count
  FROM dnode d)"""
