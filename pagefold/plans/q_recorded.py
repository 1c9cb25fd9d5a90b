"""Registered query for sibling links by recorded selectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefold.operators import containers as CT
from pagefold.operators import recorded_links as R
from pagefold.plans import duck as D
from pagefold.plans.catalog import register
from pagefold.plans.q_containers import SQL_BEST, _stats
from pagefold.plans.q_links import _scope_sql

#: Recorded analyses by the example's id: unsure, a selector that hits, one that misses with a second that hits, two that miss.
CONTENT, SECOND, MISSING = "h3 > a", 'article.news-item a[href^="/sitzung"]', ".missing a"


def _analysis(best):
    k = F.col("example_id") % 4
    return best.select("example_id", F.when(k == 0, 0.5).otherwise(0.9).alias("confidence"),
                       F.when(k.isin(0, 1), CONTENT).otherwise(MISSING).alias("content_link_selector"),
                       F.when(k == 2, SECOND).when(k == 3, MISSING).alias("example_url_selector"))


@register("container_links_recorded", oracle=f"""
WITH RECURSIVE {SQL_BEST},
linked AS (SELECT u.example_id, u.container_id, u.example_url, u.url, u.node_id, p.tag AS p_tag, regexp_extract(d.attr, '\\bhref="([^"]*)"', 1) AS href,
    EXISTS (SELECT 1 FROM dom a WHERE a.page_id = d.page_id AND list_contains(d.ancestors, a.node_id) AND a.tag = 'article' AND list_contains(a.classes, 'news-item')) AS in_item
  FROM in_best u JOIN example e USING (example_id) JOIN dom d ON d.page_id = e.page_id AND d.node_id = u.node_id JOIN dom p ON p.page_id = d.page_id AND p.node_id = d.parent_id),
picked AS (
  SELECT example_id, container_id, url, node_id, 'content-selector' AS method FROM linked WHERE example_id % 4 = 1 AND p_tag = 'h3' AND href <> '' AND url <> example_url
    AND {_scope_sql('url', 'example_url')}
  UNION ALL
  SELECT example_id, container_id, url, node_id, 'example-selector' FROM linked WHERE example_id % 4 = 2 AND in_item AND href LIKE '/sitzung%' AND url <> example_url
    AND {_scope_sql('url', 'example_url')}),
served AS MATERIALIZED (SELECT example_id, container_id, url, min(node_id) AS pos, method FROM picked GROUP BY ALL)
SELECT * FROM served UNION ALL
SELECT s.example_id, b.container_id, s.url, s.pos, 'similarity' FROM sibling s JOIN best b USING (example_id)
WHERE s.example_id NOT IN (SELECT example_id FROM served)""")
def container_links_recorded(spark, sf_dir):
    """Links of every example's container by recorded selectors, or else by similarity."""
    p, _, links, _, st = _stats(spark, sf_dir)
    best = CT.container_find(st)
    return R.container_links_recorded(best, p, links, _analysis(best))
