"""Registered plan-execution queries: listing pages, content records, run reports."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from pagefold.operators import links as L
from pagefold.operators import plan_run as R
from pagefold.plans import duck as D
from pagefold.plans.catalog import register
from pagefold.session import checkpoint_dir
from pagefold.sources import sites as S


def _run(spark, sf_dir):
    plans, pages = S.site_plans(spark, sf_dir), S.site_pages(spark, sf_dir)
    folder = os.path.join(checkpoint_dir(spark), f"plan-run-{uuid.uuid4().hex[:12]}")
    return plans, *R.execute(plans, pages, folder)


def _key(u: str) -> str:
    return f"regexp_replace({D.canonical(u)}, '#.*$', '')"


_CLEAN = ("regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), "
          "'(?is)(<script\\b[^>]*>).*?</script>', '\\1', 'g'), '(?is)(<style\\b[^>]*>).*?</style>', '\\1', 'g')")
_TITLE = D.strip_tags("regexp_extract(c, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)")
_TEXT = D.strip_tags("regexp_extract(c, '(?is)<article\\b[^>]*>.*?<p\\b[^>]*>(.*?)(<p\\b|</p>|</article>)', 1)")


def _blank(x: str) -> str:
    return f"nullif(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '')"


#: Records by the known form of the injected fields.
SQL_RECORDS = f"""
src AS (SELECT page_id, url, {D.host('url')} AS host, page_id // {S.BLOCK} AS block, {_CLEAN} AS c FROM pages),
record AS MATERIALIZED (
  SELECT page_id, url, host, block, {_blank(_TITLE)} AS title, {_blank(_TEXT)} AS description,
    CASE WHEN page_id % 4 <> 1 THEN CAST(page_id % 10 + 10 AS VARCHAR) || '.03.2024' END AS date,
    CASE WHEN page_id % 4 <> 1 THEN 'Rathaus ' || page_id END AS address, '+49 30 ' || page_id AS phone,
    'info' || page_id || '@example.org' AS email, CASE WHEN page_id % 4 <> 1 THEN 'https://example.org/' || page_id END AS website,
    CASE WHEN page_id % 4 <> 1 THEN {D.scheme('url')} || '://' || {D.host('url')} || '/media/' || page_id || '.mp4' END AS image
  FROM src)"""

#: Listing pages reached from each host's first one; a URL seen before ends the walk.
SQL_WALK = SQL_RECORDS + f""",
blocks AS (SELECT DISTINCT host, block FROM record WHERE host <> ''),
entry AS (SELECT host, min(block) AS block FROM blocks GROUP BY host),
walk AS (
  SELECT host, 1 AS page_number, block, true AS known, [block] AS path FROM entry
  UNION ALL
  SELECT w.host, w.page_number + 1, t.block, EXISTS (SELECT 1 FROM blocks b WHERE b.host = w.host AND b.block = t.block), list_append(path, t.block)
  FROM walk w, LATERAL (SELECT CASE WHEN w.block % 13 = 12 THEN NULL WHEN w.block % 11 = 10 THEN w.block - 2 ELSE w.block + 1 END AS block) t
  WHERE w.known AND t.block IS NOT NULL AND NOT list_contains(w.path, t.block) AND w.page_number < {R.MAX_PAGES}),
listing AS (
  SELECT 'plan-' || host AS plan_id, host, page_number, block, known, path,
    CASE WHEN NOT known THEN 'dead' WHEN block % 13 = 12 THEN 'end'
      WHEN list_contains(path, CASE WHEN block % 11 = 10 THEN block - 2 ELSE block + 1 END) THEN 'cycle'
      WHEN page_number >= {R.MAX_PAGES} THEN 'limit' ELSE 'ok' END AS status
  FROM walk)"""

_DENIED = " OR ".join(f"contains(lower(content_url), {D.q(w)})" for w in L.LIGHT_DENY)
SQL_RESULTS = SQL_WALK + f""",
latest AS (SELECT {_key('url')} AS key, max(page_id) AS page_id FROM pages GROUP BY 1),
given AS (
  SELECT DISTINCT plan_id, l.host, page_number, {D.canonical('r.url')} AS content_url FROM listing l JOIN record r ON r.host = l.host AND r.block = l.block
  UNION ALL
  SELECT plan_id, host, page_number, 'https://' || host || '/fehlt/' || block FROM listing WHERE known),
result AS (
  SELECT g.plan_id, g.page_number, g.content_url, r.title IS NOT NULL AS success, r.title, r.description, r.date, r.address, r.phone, r.email, r.website,
    CASE WHEN r.page_id % 4 <> 1 THEN {D.scheme('content_url')} || '://' || {D.host('content_url')} || '/media/' || r.page_id || '.mp4' END AS image
  FROM given g LEFT JOIN latest n ON n.key = {_key('content_url')} LEFT JOIN record r ON r.page_id = n.page_id
  WHERE length(g.host) % 3 <> 0 OR NOT ({_DENIED}))"""


@register("plan_execute", oracle=f"""
WITH RECURSIVE {SQL_RESULTS}
SELECT l.plan_id, l.page_number, 'https://' || l.host || '/liste/' || l.block AS url, l.status,
  count(r.plan_id) AS n_content, count(*) FILTER (WHERE r.success) AS n_success
FROM listing l LEFT JOIN result r ON r.plan_id = l.plan_id AND r.page_number = l.page_number GROUP BY ALL""")
def plan_execute(spark, sf_dir):
    """Every listing page that a plan reads, with the content pages found there."""
    _, listings, results = _run(spark, sf_dir)
    per_page = results.groupBy("plan_id", "page_number").agg(F.count("*").alias("n"), F.count_if("success").alias("ok"))
    return listings.join(per_page, ["plan_id", "page_number"], "left").select(
        "plan_id", "page_number", "url", "status", F.coalesce("n", F.lit(0)).alias("n_content"), F.coalesce("ok", F.lit(0)).alias("n_success"))


@register("plan_execute_items", oracle=f"""
WITH RECURSIVE {SQL_RESULTS}
SELECT plan_id, page_number, content_url, success, CASE WHEN NOT success THEN '{R.NO_CONTENT}' END AS error, title, md5(description) AS description_md5,
  date, address, phone, email, website, image FROM result""")
def plan_execute_items(spark, sf_dir):
    """The record of every content page that a plan reads, or why there is none."""
    _, _, results = _run(spark, sf_dir)
    return results.select("plan_id", "page_number", "content_url", "success", "error", "title", F.md5("description").alias("description_md5"),
                          F.get("dates", F.lit(0)).alias("date"), "address", "phone", "email", "website", F.get("images", F.lit(0)).alias("image"))


@register("plan_execute_report", oracle=f"""
WITH RECURSIVE {SQL_RESULTS},
per_page AS (SELECT plan_id, page_number, count(*) FILTER (WHERE success) AS n FROM result GROUP BY ALL)
SELECT plan_id, count(*) FILTER (WHERE known) AS pages_processed, count(*) FILTER (WHERE n > 0) AS successful_pages,
  count(*) FILTER (WHERE NOT known) AS errors_encountered, CAST(coalesce(sum(n), 0) AS BIGINT) AS items_extracted, arg_max(status, page_number) AS last_status
FROM listing LEFT JOIN per_page USING (plan_id, page_number) GROUP BY plan_id""")
def plan_execute_report(spark, sf_dir):
    """Pages, successes, errors and items of every plan's run."""
    return R.run_report(*_run(spark, sf_dir))


@register("extract_detail_by_plan", oracle=f"""
WITH {SQL_RECORDS}
SELECT 'plan-' || host AS plan_id, page_id, url AS "sourceUrl", title, md5(description) AS description_md5, date, address, phone, email, website, image
FROM record WHERE host <> '' AND title IS NOT NULL""")
def extract_detail_by_plan(spark, sf_dir):
    """One record per page of a plan's site by the plan's detail selectors."""
    facts = R.Facts(S.site_pages(spark, sf_dir), S.site_plans(spark, sf_dir)).table
    return R.extract_detail(facts).where(F.col("page_id") < S.LISTING_OFFSET).select(
        "plan_id", "page_id", "sourceUrl", "title", F.md5("description").alias("description_md5"), F.get("dates", F.lit(0)).alias("date"),
        "address", "phone", "email", "website", F.get("images", F.lit(0)).alias("image"))
