"""Sibling links of a container by the selectors that an analysis recorded.

Three ways to the links of an example's container, tried in order: the recorded
content-link selector, the recorded example-URL selector, URL similarity.  The first
that finds any link serves the example; a later way is only evaluated for examples
that the earlier ones left without links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.functions import url as U
from pagefold.operators import containers as CT
from pagefold.operators import links as L
from pagefold.operators import page_local as P
from pagefold.session import materialize

#: An analysis with no more confidence than this is not used.
SURE = 0.7
LINKS = ["example_id", "container_id", "url", "pos", "method"]


def _selected(pages: DataFrame, asked: DataFrame, selector: str) -> DataFrame:
    """Links that ``asked(example_id, page_id, container_id, example_url, <selector>)`` match inside their container.

    Only the pages asked for by this selector are parsed."""
    asked = asked.where(F.coalesce(F.col(selector) != "", F.lit(False)))
    own = pages.join(asked.select("page_id").distinct(), "page_id", "left_semi").select("page_id", F.col("url").alias("page_url"), "html")
    parsed = P.selector_steps(asked.select(F.col(selector).alias("selector")))
    j = P.page_trees(own).join(asked.withColumn("selector", F.col(selector)).join(parsed, "selector"), "page_id")
    hit = j.select("example_id", "container_id", "example_url", "page_url", "nodes", F.explode(P.matches(F.col("nodes"), F.col("alts"))).alias("pos"))
    node = F.get("nodes", F.col("pos"))
    hit = hit.where(F.array_contains(node["ancestors"], F.col("container_id"))).select(
        "example_id", "container_id", "example_url", "pos", F.try_element_at(node["attrs"], F.lit("href")).alias("href"), "page_url")
    hit = hit.where("href <> ''").withColumn("url", U.url_resolve("href", "page_url"))
    hit = hit.where(L.link_scope_ok("url", "example_url") & (F.col("url") != F.col("example_url")))
    return hit.groupBy("example_id", "container_id", "url").agg(F.min("pos").alias("pos"))


def container_links_recorded(best: DataFrame, pages: DataFrame, links: DataFrame, analysis: DataFrame) -> DataFrame:
    """``example_id, container_id, url, pos, method`` for the containers ``best`` of ``pages(page_id, url, html)``.

    ``analysis(example_id, confidence, content_link_selector, example_url_selector)``: at
    most one row per example; one that is missing or not ``SURE`` leaves similarity alone.
    """
    asked = best.select("example_id", "page_id", "container_id", "example_url").join(analysis.where(F.col("confidence") > SURE), "example_id")
    asked = materialize(asked, "recorded-asked")
    served = materialize(_selected(pages, asked, "content_link_selector").withColumn("method", F.lit("content-selector")).select(LINKS), "recorded-links")
    left = materialize(asked.join(served.select("example_id").distinct(), "example_id", "left_anti"), "recorded-left")
    second = materialize(_selected(pages, left, "example_url_selector").withColumn("method", F.lit("example-selector")).select(LINKS), "recorded-links")
    served = served.unionByName(second)
    rest = best.join(served.select("example_id").distinct(), "example_id", "left_anti")
    similar = CT.container_links(rest, links).withColumn("method", F.lit("similarity")).select(LINKS)
    return served.unionByName(similar)
