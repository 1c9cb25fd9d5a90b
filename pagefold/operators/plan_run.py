"""Plan execution over a page snapshot: listing pages, content pages, records.

A plan names an entry URL and selectors; running it means: read the entry page,
collect its content URLs, read each content page with the detail selectors, follow
the pagination link to the next listing page, and so on.

* ``page_facts`` -- what a plan's selectors find on a page, for (plan, page) pairs:
  next link, content links, first element per field.  One pass over the pages of the
  plans' hosts; a page elsewhere is read when a plan gets there.
* ``walk_listings`` -- the frontier of all plans moves one listing page a round.  Next
  URLs that a plan has seen are left out by an anti-join; a round is a folder of its
  own below the run's folder and is final once written, so a run that is started again
  with the same folder goes on after its last finished round.
* ``execute`` -- content URLs of all listing pages, their pages and their records.

Rounds join small rows (plan, page, URL) only; html is read once.  ``max_pages`` and
``max_items`` are the reference's own limits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.functions import html as H
from pagefold.functions import url as U
from pagefold.operators import links as L
from pagefold.operators import page_local as P
from pagefold.operators.extract_dom import first_link, plan_bundles
from pagefold.session import finished, materialize

MAX_PAGES = 50
FIELDS = ["title", "description", "date", "address", "phone", "email", "website", "images"]
NO_CONTENT = "No content extracted"


def url_key(url: Column) -> Column:
    """What names a page: its URL in canonical form, without the fragment."""
    return F.regexp_replace(U.url_canonical(url), "#.*$", "")


def snapshot(pages: DataFrame) -> DataFrame:
    """``key, page_id``: the latest page of each URL."""
    return pages.select(url_key(F.col("url")).alias("key"), "page_id").groupBy("key").agg(F.max("page_id").alias("page_id"))


def page_facts(pages: DataFrame, bundles: DataFrame, by: list[str], max_items: int | None = None) -> DataFrame:
    """``plan_id, page_id, url, next_href, has_link_selector, links, fields`` for each pair that
    ``bundles(*by, plan_id, wanted, content_link_selector)`` makes with ``pages(page_id, url, html, *by)``.

    ``links`` are ``(pos, href, text)`` of the content links, of the first link of every
    list element where the plan has no content-link selector; ``fields`` maps a field to
    ``(text, src)`` of its first element.
    """
    trees = P.page_trees(pages)
    found = trees.join(bundles, by).withColumn("hits", F.transform(
        "wanted", lambda w: F.struct(w["role"].alias("role"), w["field"].alias("field"), P.matches(F.col("nodes"), w["alts"]).alias("at"))))

    def of(role: str) -> Column:
        return F.coalesce(F.get(F.filter("hits", lambda h: h["role"] == role), 0)["at"], F.array().cast("array<int>"))

    def capped(places: Column) -> Column:
        return F.slice(places, 1, max_items) if max_items else places

    def node(k: Column) -> Column:
        return F.get(F.col("nodes"), k)

    def link(pos: Column, n: Column) -> Column:
        return F.struct(pos.alias("pos"), F.try_element_at(n["attrs"], F.lit("href")).alias("href"), P.node_text(F.col("text"), n).alias("text"))

    by_selector = F.transform(capped(of("content")), lambda k: link(k, node(k)))
    by_item = F.transform(capped(of("list")), lambda k: link(k, first_link(F.col("nodes"), k)))
    has_selector = F.coalesce(F.col("content_link_selector") != "", F.lit(False))
    details = F.filter("hits", lambda h: (h["role"] == "detail") & (F.size(h["at"]) > 0))
    fields = F.map_from_entries(F.transform(details, lambda h: F.struct(h["field"], F.struct(
        P.node_text(F.col("text"), node(h["at"][0])).alias("text"),
        F.try_element_at(node(h["at"][0])["attrs"], F.lit("src")).alias("src")))))
    return found.select(
        "plan_id", "page_id", "url", F.try_element_at(node(F.get(of("pagination"), 0))["attrs"], F.lit("href")).alias("next_href"),
        has_selector.alias("has_link_selector"), F.when(has_selector, by_selector).otherwise(by_item).alias("links"), fields.alias("fields"))


def detail_record(fields: Column, url: Column) -> dict[str, Column]:
    """Columns of the record of a content page; null where a field is missing or blank."""
    def text(name):
        found = H.js_trim(fields[name]["text"])
        return F.when(found != "", found)

    src = fields["images"]["src"]
    return {**{f: text(f) for f in FIELDS[:2]}, "dates": F.when(text("date").isNotNull(), F.array(text("date"))).otherwise(F.array().cast("array<string>")),
            **{f: text(f) for f in FIELDS[3:7]},
            # As in the reference, an element without text gives no image.
            "images": F.when(text("images").isNotNull() & (src != ""), F.array(U.url_resolve(src, url))).otherwise(F.array().cast("array<string>")),
            "language": F.lit("de")}


def extract_detail(facts: DataFrame) -> DataFrame:
    """``extract_detail``: one record per (plan, page) by the plan's detail selectors; a title is required."""
    record = detail_record(F.col("fields"), F.col("url"))
    return facts.select("plan_id", "page_id", F.col("url").alias("sourceUrl"), *[c.alias(n) for n, c in record.items()]).where("title IS NOT NULL")


class Facts:
    """Facts of (plan, page) pairs, found when first asked for and kept as written tables."""

    def __init__(self, pages: DataFrame, plans: DataFrame, max_items: int | None = None):
        self.pages = pages.select("page_id", "url", "html")
        self.bundles = materialize(plan_bundles(plans).join(plans.select("plan_id", "content_link_selector", F.col("entry_url")), "plan_id", "right")
                                   .withColumn("wanted", F.coalesce("wanted", F.expr("filter(wanted, w -> false)"))), "plan-bundles")
        self.max_items = max_items
        own = self.pages.withColumn("host", U.url_host("url"))
        hosts = self.bundles.withColumn("host", U.url_host("entry_url")).drop("entry_url")
        self.table = materialize(page_facts(own, hosts, ["host"], max_items), "plan-facts")

    def of(self, pairs: DataFrame) -> DataFrame:
        """Facts of ``pairs(plan_id, page_id)``; pages of other hosts are read now."""
        missing = pairs.select("plan_id", "page_id").distinct().join(self.table, ["plan_id", "page_id"], "left_anti")
        missing = materialize(missing, "plan-pairs")
        if not missing.isEmpty():
            wanted = missing.join(self.bundles.drop("entry_url"), "plan_id")
            more = page_facts(self.pages.join(missing.select("page_id").distinct(), "page_id", "left_semi"), wanted, ["page_id"], self.max_items)
            self.table = self.table.unionByName(materialize(more, "plan-facts"))
        return self.table


ROUND = "plan_id string, page_number int, url string, key string, page_id long, next_url string, status string"


def walk_listings(plans: DataFrame, pages: DataFrame, facts: Facts, run_dir: str, max_pages: int = MAX_PAGES) -> DataFrame:
    """``plan_id, page_number, url, key, page_id, next_url, status`` of every listing URL reached.

    ``status``: ``ok`` (the next URL is read too), ``end`` (there is none), ``cycle`` (the
    plan has read it), ``limit`` (``max_pages`` are read) or ``dead`` (no such page).
    """
    spark = pages.sparkSession
    known = materialize(snapshot(pages), "plan-snapshot")
    todo = plans.select("plan_id", F.lit(1).alias("page_number"), F.col("entry_url").alias("url"), url_key(F.col("entry_url")).alias("key"))
    done: list[str] = []
    number = 1
    while number <= max_pages:
        folder = f"{run_dir}/round={number:05d}"
        if not finished(spark, folder):
            at = materialize(todo.join(known, "key", "left"), "plan-frontier")
            found = facts.of(at.where("page_id IS NOT NULL")).select("plan_id", "page_id", U.url_resolve("next_href", "url").alias("next_url"))
            step = at.join(found, ["plan_id", "page_id"], "left").withColumn("next_key", url_key(F.col("next_url")))
            seen = step.select("plan_id", "key")
            if done:
                seen = seen.unionByName(spark.read.schema(ROUND).parquet(*done).select("plan_id", "key"))
            back = seen.select("plan_id", F.col("key").alias("next_key")).distinct().withColumn("back", F.lit(True))
            status = (F.when(F.col("page_id").isNull(), "dead").when(F.col("next_url").isNull(), "end").when(F.col("back"), "cycle")
                      .when(F.col("page_number") >= max_pages, "limit").otherwise("ok"))
            step.join(back, ["plan_id", "next_key"], "left").select(
                "plan_id", "page_number", "url", "key", "page_id", "next_url", status.alias("status")).write.mode("overwrite").parquet(folder)
        done.append(folder)
        todo = spark.read.schema(ROUND).parquet(folder).where("status = 'ok'").select(
            "plan_id", (F.col("page_number") + 1).alias("page_number"), F.col("next_url").alias("url"), url_key(F.col("next_url")).alias("key"))
        if todo.isEmpty():
            break
        number += 1
    return spark.read.schema(ROUND).parquet(*done)


def content_urls(listings: DataFrame, facts: DataFrame) -> DataFrame:
    """``plan_id, page_number, content_url, pos``: different content URLs of each listing page.
    Links of a content-link selector are trusted, those of list elements pass the light filter."""
    at = listings.where("page_id IS NOT NULL").select("plan_id", "page_number", "page_id")
    links = at.join(facts, ["plan_id", "page_id"]).select("plan_id", "page_number", "url", "has_link_selector", F.explode("links").alias("l"))
    links = links.where("l.href <> ''").select("plan_id", "page_number", U.url_resolve("l.href", "url").alias("content_url"),
                                               "l.text", "l.pos", "has_link_selector")
    links = links.where(F.col("content_url").isNotNull() & (F.col("has_link_selector") | L.link_is_likely_content("content_url", "text")))
    return links.groupBy("plan_id", "page_number", "content_url").agg(F.min("pos").alias("pos"))


def execute(plans: DataFrame, pages: DataFrame, run_dir: str, max_pages: int = MAX_PAGES, max_items: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Run all ``plans(plan_id, entry_url, list_selector, content_link_selector, pagination_selector,
    detail_selectors)`` over ``pages(page_id, url, html)``.

    Returns the listing pages as ``walk_listings`` gives them, and one row per listing
    page and content URL: ``success``, ``error`` and the record's columns.
    """
    facts = Facts(pages, plans, max_items)
    listings = walk_listings(plans, pages, facts, run_dir, max_pages)
    urls = content_urls(listings, facts.of(listings.where("page_id IS NOT NULL")))
    urls = urls.withColumn("key", url_key(F.col("content_url"))).join(snapshot(pages).withColumnRenamed("page_id", "content_page_id"), "key", "left").drop("key")
    urls = materialize(urls, "plan-content")
    pairs = urls.where("content_page_id IS NOT NULL").select("plan_id", F.col("content_page_id").alias("page_id"))
    records = facts.of(pairs).select("plan_id", F.col("page_id").alias("content_page_id"), "fields")
    joined = urls.join(records, ["plan_id", "content_page_id"], "left")
    record = detail_record(F.col("fields"), F.col("content_url"))
    out = joined.select("plan_id", "page_number", "content_url", "pos", "content_page_id", *[c.alias(n) for n, c in record.items()])
    success = F.col("title").isNotNull()
    return listings, out.withColumn("success", success).withColumn("error", F.when(~success, NO_CONTENT))


def run_report(plans: DataFrame, listings: DataFrame, results: DataFrame) -> DataFrame:
    """``plan_id, pages_processed, successful_pages, errors_encountered, items_extracted, last_status`` per plan."""
    per_page = results.groupBy("plan_id", "page_number").agg(F.count_if("success").alias("n"))
    rows = listings.join(per_page, ["plan_id", "page_number"], "left")
    report = rows.groupBy("plan_id").agg(
        F.count("page_id").alias("pages_processed"), F.count_if(F.col("n") > 0).alias("successful_pages"),
        F.count_if(F.col("page_id").isNull()).alias("errors_encountered"), F.coalesce(F.sum("n"), F.lit(0)).alias("items_extracted"),
        F.max_by("status", "page_number").alias("last_status"))
    return plans.select("plan_id").join(report, "plan_id", "left")
