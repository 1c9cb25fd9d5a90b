"""Plan execution: selectors inside a page, the frontier of listing pages, restart, records."""

import os

import pytest
from pyspark.sql import functions as F

from pagefold.operators import dom as M
from pagefold.operators import page_local as P
from pagefold.operators import plan_run as R

SELECTORS = ["nav li > a", "article p", "h1, h2", "article > p:nth-of-type(2)", "a[href^='/']", "div.ad", "nav a, article h1", "*", "bad::selector",
             "body ul > li a", "#x .y > b"]
PLANS = ("plan_id string, entry_url string, list_selector string, content_link_selector string, pagination_selector string, "
         "detail_selectors map<string,string>")


def test_page_local_equals_joins(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    odd = spark.createDataFrame([(900001, None), (900002, ""), (900003, "<div id=x><p class='y z'><b>1</b><i><b>2</b></i><p>3</div>")], pages.schema)
    pages = pages.unionByName(odd)
    selectors = spark.createDataFrame([(s,) for s in SELECTORS], "selector string")
    trees = P.page_trees(pages)
    got = trees.join(P.selector_steps(selectors), F.lit(True)).select("page_id", "selector", P.matches(F.col("nodes"), F.col("alts")).alias("at"))
    got = {(r["page_id"], r["selector"], k) for r in got.collect() for k in r["at"]}
    nodes, _ = M.shred_pages(pages)
    want = {tuple(r) for r in M.selector_match(nodes, M.selector_steps(selectors)[0]).select("page_id", "sel_id", "node_id").collect()}
    assert got == want and (900003, "#x .y > b", 2) in got and (900003, "#x .y > b", 4) not in got
    plan = trees.join(P.selector_steps(selectors), F.lit(True))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(page_id" not in plan, "html must not be shuffled"


def listing(links, following):
    items = "".join(f'<li><a href="{u}">{t}</a></li>' for u, t in links)
    return f'<body><ul class=l>{items}</ul>' + (f'<a class=next href="{following}">more</a>' if following else "") + "</body>"


def detail(title, extra=""):
    return f"<body><h1> {title} </h1><p>Text of {title}</p>{extra}</body>"


@pytest.fixture(scope="module")
def site(spark):
    full = '<i class=d>1.2.2024</i><b class=pic>no source</b><em class=m>x@example.org</em>'
    pages = [
        (1, "https://a.example/list", listing([("/d1", "one"), ("/d2#top", "two"), ("/d1", "again"), ("/gone", "gone")], "?p=2")),
        (2, "https://a.example/list?p=2", listing([("https://b.example/d9", "far"), ("/d3", "three")], "https://b.example/l3")),
        (3, "https://b.example/l3", listing([("/d9", "nine"), ("", "none")], "https://a.example/list#again")),
        (4, "https://a.example/d1", detail("D1", full)), (5, "https://a.example/d2", detail("D2 old")), (6, "https://a.example/d2", detail("D2")),
        (7, "https://a.example/d3", "<body><p>no title</p></body>"), (8, "https://b.example/d9", detail("D9", '<b class=pic src="/p.png">pic</b>')),
        (9, "https://c.example/x", listing([("/login", "log in"), ("/y", ">"), ("/z", "zed")], "/nowhere")), (10, "https://c.example/z", detail("Z")),
        (11, "https://d.example/", None), (12, None, "<h1>no url</h1>"), (13, "https://e.example/s", listing([], "/s")),
    ]
    fields = {"title": "h1", "description": "p", "date": "i.d", "email": ".m", "images": ".pic", "bad": "p::first"}
    plans = [("a", "https://a.example/list", "ul.l > li", "ul.l a", "a.next", fields), ("c", "https://c.example/x", "ul.l > li", None, "a.next", fields),
             ("d", "https://d.example/", "li", "", "a.next", fields), ("e", "https://e.example/s", "li", None, "a.next", fields),
             ("f", "https://f.example/missing", "li", None, None, fields), ("g", "https://b.example/l3", "li", None, None, {})]
    return spark.createDataFrame(plans, PLANS), spark.createDataFrame(pages, "page_id long, url string, html string")


WALKS = {("a", 1, "ok"), ("a", 2, "ok"), ("a", 3, "cycle"), ("c", 1, "ok"), ("c", 2, "dead"), ("d", 1, "end"), ("e", 1, "cycle"), ("f", 1, "dead"), ("g", 1, "end")}


def walks(df):
    return {(r["plan_id"], r["page_number"], r["status"]) for r in df.collect()}


def test_execute(spark, site, tmp_path):
    plans, pages = site
    listings, results = R.execute(plans, pages, str(tmp_path / "run"))
    assert walks(listings) == WALKS and listings.count() == len(WALKS)
    rows = {(r["plan_id"], r["page_number"], r["content_url"]): r for r in results.collect()}
    assert {k: r["title"] for k, r in rows.items()} == {
        ("a", 1, "https://a.example/d1"): "D1", ("a", 1, "https://a.example/d2#top"): "D2", ("a", 1, "https://a.example/gone"): None,
        ("a", 2, "https://b.example/d9"): "D9", ("a", 2, "https://a.example/d3"): None, ("a", 3, "https://b.example/d9"): "D9",
        ("c", 1, "https://c.example/z"): "Z", ("g", 1, "https://b.example/d9"): None}
    one, nine = rows["a", 1, "https://a.example/d1"], rows["a", 3, "https://b.example/d9"]
    assert (one["dates"], one["email"], one["images"], one["description"], one["address"]) == (["1.2.2024"], "x@example.org", [], "Text of D1", None)
    assert nine["images"] == ["https://b.example/p.png"] and nine["dates"] == []
    assert all(r["success"] == (r["title"] is not None) and (r["error"] is None) == r["success"] for r in rows.values())
    report = {r["plan_id"]: tuple(r)[1:] for r in R.run_report(plans, listings, results).collect()}
    assert report == {"a": (3, 3, 0, 4, "cycle"), "c": (1, 1, 1, 1, "dead"), "d": (1, 0, 0, 0, "end"), "e": (1, 0, 0, 0, "cycle"),
                      "f": (0, 0, 1, 0, "dead"), "g": (1, 0, 0, 0, "end")}


def test_limits(spark, site, tmp_path):
    plans, pages = site
    listings, results = R.execute(plans, pages, str(tmp_path / "run"), max_pages=2, max_items=1)
    assert walks(listings.where("plan_id = 'a'")) == {("a", 1, "ok"), ("a", 2, "limit")}
    assert {(r["plan_id"], r["content_url"]) for r in results.collect()} == {("a", "https://a.example/d1"), ("a", "https://b.example/d9"), ("g", "https://b.example/d9")}


def test_restart_after_a_lost_round(spark, site, tmp_path):
    """A run that stops in round 2 goes on there; finished rounds are not written again."""
    plans, pages = site
    folder = str(tmp_path / "run")

    class Stopped(R.Facts):
        calls = 0

        def of(self, pairs):
            self.calls += 1
            if self.calls == 2:
                raise RuntimeError("driver lost")
            return super().of(pairs)

    with pytest.raises(RuntimeError, match="driver lost"):
        R.walk_listings(plans, pages, Stopped(pages, plans), folder)
    first = os.path.join(folder, "round=00001")
    os.makedirs(os.path.join(folder, "round=00002"))  # begun, not finished
    before = {f: os.stat(os.path.join(first, f)).st_mtime_ns for f in os.listdir(first)}
    facts = R.Facts(pages, plans)
    assert walks(R.walk_listings(plans, pages, facts, folder)) == WALKS
    assert {f: os.stat(os.path.join(first, f)).st_mtime_ns for f in os.listdir(first)} == before
    assert walks(R.walk_listings(plans, pages, facts, folder)) == WALKS  # all rounds finished: read only


def test_empty_inputs(spark, site, tmp_path):
    plans, pages = site
    listings, results = R.execute(plans.limit(0), pages, str(tmp_path / "a"))
    assert listings.count() == results.count() == 0
    listings, results = R.execute(plans, pages.limit(0), str(tmp_path / "b"))
    assert {r["status"] for r in listings.collect()} == {"dead"} and results.count() == 0


def test_one_scan_of_html(spark):
    """All selectors of all plans are one projection over one scan of the pages."""
    from pagefold.sources import sites as S
    sf = "/root/testdata/sf0.001"
    plans = S.site_plans(spark, sf)
    bundles = R.plan_bundles(plans).join(plans.select("plan_id", "content_link_selector"), "plan_id")
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("host", F.lit("h"))
    facts = R.page_facts(pages, bundles.withColumn("host", F.lit("h")), ["host"])
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("html") and sum("pages.parquet" in line and "html" in line for line in plan.splitlines()) <= 1
