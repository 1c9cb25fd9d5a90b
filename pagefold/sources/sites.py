"""Sites to run plans on, derived from the page table (mirrored in the oracle SQL).

The pages of a host are listed, ten consecutive page ids at a time, by listing pages
``https://<host>/liste/<block>`` that link to the next block; some link back, some to
a block that the host does not have.  Every page carries a block of detail fields by
its id.  There is one plan per host, some without a content-link selector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.functions import url as U
from pagefold.sources.derived import inject_before_body_end
from pagefold.sources.tables import read_table

BLOCK = 10
LISTING_OFFSET = 1_000_000_000_000
#: Fields put at the end of each page; ``{id}`` is the page id, ``{day}`` its last digit plus 10.
DETAIL = ('<div class="event"><span class="date"> {day}.03.2024 </span><p class="place">Rathaus {id}</p><span class="tel">+49 30 {id}</span>'
          '<a class="mail" href="mailto:x@example.org">info{id}@example.org</a><a class="web" href="/w">https://example.org/{id}</a>'
          '<img class="pic" src="/pic/{id}.png"><video class="media" src="/media/{id}.mp4">kein Video</video></div>')
#: The same with gaps: blank place, no date, a picture without text.
POOR_DETAIL = ('<div class="event"><p class="place">  </p><span class="tel">+49 30 {id}</span>'
               '<a class="mail" href="mailto:x@example.org">info{id}@example.org</a><img class="media" src="/pic/{id}.png"></div>')
LIST_SELECTOR = "ul.teasers > li, div.none"
LINK_SELECTOR = "ul.teasers li > a:nth-of-type(1)"
NEXT_SELECTOR = 'nav.pager a.next, a[rel="next"]'
DETAIL_SELECTORS = {"title": "article h1, h1", "description": "article p", "date": "div.event > span.date", "address": ".event .place",
                    "phone": "span.tel", "email": "a.mail[href^=\"mailto:\"]", "website": "a.web", "images": ".event .media", "other": "nav"}


def _fill(text: str) -> F.Column:
    pid = F.col("page_id").cast("string")
    day = (F.col("page_id") % 10 + 10).cast("string")
    return F.replace(F.replace(F.lit(text), F.lit("{id}"), pid), F.lit("{day}"), day)


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, url, html``: the given pages with detail fields, and the listing pages."""
    p = read_table(spark, sf_dir, "pages")
    detail = F.when(F.col("page_id") % 4 == 1, _fill(POOR_DETAIL)).otherwise(_fill(DETAIL))
    content = p.select("page_id", "url", inject_before_body_end(F.col("html"), detail).alias("html"))
    block = F.floor(F.col("page_id") / BLOCK)
    teaser = F.concat(F.lit('<li class="teaser"><a href="'), F.col("url"), F.lit('">Seite '), F.col("page_id").cast("string"),
                      F.lit('</a> <a href="/mehr">mehr</a></li>'))
    listed = p.select(U.url_host("url").alias("host"), block.alias("block"), "page_id", teaser.alias("teaser")).where("host <> ''")
    lists = listed.groupBy("host", "block").agg(  # at most BLOCK rows
        F.min("page_id").alias("first_id"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "teaser"))),
                                                                     lambda x: x["teaser"]), "").alias("teasers"))
    b = F.col("block")
    to = F.when(b % 11 == 10, b - 2).otherwise(b + 1).cast("string")
    pager = F.when(b % 13 == 12, F.lit('<nav class="pager"><a class="prev" href="/liste/0">0</a></nav>')).otherwise(
        F.concat(F.lit('<nav class="pager"><a class="next" href="/liste/'), to, F.lit('">weiter</a></nav>')))
    html = F.concat(F.lit('<html><body><ul class="teasers">'), "teasers", F.lit('<li class="teaser"><a href="/fehlt/'), b.cast("string"),
                    F.lit('">Fehlt</a></li></ul>'), pager, F.lit("</body></html>"))
    listing = lists.select((F.col("first_id") + LISTING_OFFSET).alias("page_id"),
                           F.concat(F.lit("https://"), F.col("host"), F.lit("/liste/"), b.cast("string")).alias("url"), html.alias("html"))
    return content.unionByName(listing)


def site_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plan per host; the entry is the host's first listing page."""
    p = read_table(spark, sf_dir, "pages").select(U.url_host("url").alias("host"), F.floor(F.col("page_id") / BLOCK).alias("block"))
    first = p.where("host <> ''").groupBy("host").agg(F.min("block").alias("block"))
    return first.select(
        F.concat(F.lit("plan-"), "host").alias("plan_id"),
        F.concat(F.lit("https://"), F.col("host"), F.lit("/liste/"), F.col("block").cast("string")).alias("entry_url"),
        F.lit(LIST_SELECTOR).alias("list_selector"),
        F.when(F.length("host") % 3 != 0, F.lit(LINK_SELECTOR)).alias("content_link_selector"),
        F.lit(NEXT_SELECTOR).alias("pagination_selector"),
        F.create_map(*[F.lit(x) for kv in DETAIL_SELECTORS.items() for x in kv]).alias("detail_selectors"))
