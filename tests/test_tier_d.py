"""DOM-tier fixtures: sibling discovery (G1, G3), pagination (F5), consent (F6),
walks, plus batch/stream equivalence and session-free imports."""

import os
import shutil
import subprocess
import sys

from pyspark.sql import functions as F

from pagefold.operators import consent as CS
from pagefold.operators import containers as CT
from pagefold.operators import dom as M

G3 = """<html><body><div class="news-list">
<article class="news-item"><h3><a href="/news/2024/bericht-1">Bericht über die Sitzung des Gemeinderats</a></h3></article>
<article class="news-item"><h3><a href="/news/2024/bericht-2">Bericht über die Sitzung des Ausschusses</a></h3></article>
<article class="news-item"><h3><a href="/news/2024/bericht-3">Bericht über die öffentliche Sitzung</a></h3></article>
</div></body></html>"""

G1 = """<html><body><div class="news-list">""" + "".join(
    f'<article><h3><a href="/news/article-{i}">Article number {i} headline text</a></h3>'
    f'<a href="/news/article-{i}">more</a><a href="/news/article-{i}">x</a><a href="/news/article-{i}">y</a></article>'
    for i in range(1, 5)) + '<div class="pager"></div></div></body></html>'


def _nt(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    nodes, texts = M.shred_pages(pages)
    return pages, M.with_text(nodes, texts)


def test_g3_container_climb(spark):
    pages, nt = _nt(spark, [(1, "https://stadt.example.de/aktuelles", G3)])
    ex = spark.createDataFrame([(1, 1, "https://stadt.example.de/news/2024/bericht-1")],
                               "example_id long, page_id long, example_url string")
    links = CT.dom_links(nt, pages)
    best = CT.container_find(CT.container_stats(CT.example_anchor(links, ex), nt, links)).first()
    assert best["c_tag"] == "div" and best["c_class"] == "news-list"
    conf = CT.container_confidence(CT.container_find(CT.container_stats(CT.example_anchor(links, ex), nt, links)),
                                   CT.sibling_count(CT.container_find(CT.container_stats(
                                       CT.example_anchor(links, ex), nt, links)), links)).first()
    assert conf["sibling_links"] == 2
    assert abs(conf["confidence"] - 0.4) < 1e-9


def test_g1_dedupe_three_siblings(spark):
    pages, nt = _nt(spark, [(1, "https://example.com/news", G1)])
    ex = spark.createDataFrame([(1, 1, "https://example.com/news/article-2")],
                               "example_id long, page_id long, example_url string")
    r = CT.sibling_discovery(nt, pages, ex).first()
    assert r["signature"] == "div.news-list#[5]"
    assert sorted(r["links"]) == [f"https://example.com/news/article-{i}" for i in (1, 3, 4)]
    assert r["confidence"] == 0.6


def test_pagination_first_selector_wins(spark):
    html = ('<html><body><div class="pagination"><a href="?seite=1">1</a><a href="?seite=2">2</a>'
            '<a href="?seite=3" rel="next">weiter</a></div><a href="/x?page=7">p7</a></body></html>')
    pages, nt = _nt(spark, [(1, "https://ex.com/list", html)])
    d = CT.pagination_detect(nt, pages).first()
    assert d["selector"] == ".pagination a[href]"
    assert d["pagination_links"] == ["https://ex.com/list?seite=1", "https://ex.com/list?seite=2",
                                     "https://ex.com/list?seite=3"]
    assert d["next_selector"] == '.pagination a[rel="next"]'


def test_pagination_walk_cycle_and_cap(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (10, 11)], "page_id long, next_page_id long")
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 10, 11, 20)], "page_id long")
    w = CT.pagination_walk(edges, ids, 5).collect()
    got = sorted((r["start_id"], r["depth"], r["page_id"]) for r in w)
    # the cycle 1-2-3 has no start page (every page has a predecessor); 10 -> 11; 20 alone
    assert got == [(10, 1, 10), (10, 2, 11), (20, 1, 20)]


def test_consent_banner(spark):
    banner = ('<div class="cookie-banner" style="position: fixed; z-index: 9999"><p>Wir verwenden Cookies.</p>'
              '<button class="btn btn-primary" id="ok1">Alle akzeptieren</button>'
              '<button class="btn">Ablehnen</button></div>')
    html_yes = f"<html><body><p>Hallo</p>{banner}</body></html>"
    html_lib = '<html><body><script src="https://consent.cookiebot.com/uc.js"></script></body></html>'
    html_no = "<html><body><footer>cookie policy</footer></body></html>"
    pages, nt = _nt(spark, [(1, "https://a.de/", html_yes), (2, "https://b.de/", html_lib),
                            (3, "https://c.de/", html_no)])
    d = {r["page_id"]: r for r in CS.consent_detect(nt, pages).collect()}
    assert d[1]["detected"] is True and d[1]["dialog_selector"] == '[class*="cookie"][class*="banner"]'
    assert d[2]["library"] == "Cookiebot"
    assert d[3]["detected"] is False and d[3]["has_keywords"] is True
    b = {r["category"]: r for r in CS.consent_buttons(nt, CS.consent_detect(nt, pages)).collect()}
    assert b["acceptAll"]["text"] == "Alle akzeptieren" and b["rejectAll"]["text"] == "Ablehnen"
    sel = {r["category"]: r["selector"] for r in CS.button_selector(CS.consent_buttons(
        nt, CS.consent_detect(nt, pages)), nt).collect()}
    assert sel["acceptAll"] == "#ok1"
    assert sel["rejectAll"] == 'button:has-text("Ablehnen")'


def test_stream_matches_batch(spark, tmp_path):
    from pagefold.streaming import jobs as J
    sf = "/root/testdata/sf0.001"
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    src = J.stream_source(spark, sf, "events", schema)
    stream = J.run_available_now(J.terminal_stream(J.task_events_from(src)), "t").select("task_id", "exit_code")
    batch = J.terminal(J.task_events_from(spark.read.parquet(f"{sf}/events.parquet"))).select("task_id", "exit_code")
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))
    checks = J.consent_checks_from(spark.read.parquet(f"{sf}/events.parquet"))
    b = {(r["domain"], r["seq"]): r["cache_hit"] for r in J.consent_ttl_batch(checks).collect()}
    s = J.run_available_now(J.consent_ttl_stream(J.consent_checks_from(src)), "c")
    st = {(r["domain"], r["seq"]): r["cache_hit"] for r in s.collect()}
    assert b == st


def test_queries_import_without_session():
    code = ("import sys; sys.path.insert(0, %r); import __spark_entry__ as E; "
            "q = E.queries(); o = E.oracle_sql(); assert len(q) > 150 and set(o) <= set(q)"
            % os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    r = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert r.returncode == 0, r.stderr[-2000:]


def test_frontier_rank_across_buckets(spark):
    rows = [(i, "h1" if i % 3 else "h2", i % 2) for i in range(1, 41)]
    req = spark.createDataFrame(rows, "page_id long, host string, priority int")
    delays = spark.createDataFrame([("h1", 500)], "host string, delay_ms int")
    got = {r["page_id"]: (r["slot"], r["fetch_offset_ms"]) for r in CT.frontier_schedule(req, delays, bucket=4).collect()}
    for host, delay in (("h1", 500), ("h2", 1000)):
        ordered = sorted((p for p in rows if p[1] == host), key=lambda p: (p[2], p[0]))
        for slot, p in enumerate(ordered):
            assert got[p[0]] == (slot, slot * delay)


def test_consent_cache_pieces_cross_days(spark):
    from pagefold.streaming import jobs as J
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1, 23, 30)
    rows = [("d", t0 + dt.timedelta(minutes=m), i, "ok") for i, m in enumerate([0, 20, 50, 61, 65, 200, 230, 300])]
    checks = spark.createDataFrame(rows, "domain string, ts timestamp, seq long, outcome string")
    hits = {r["seq"]: r["cache_hit"] for r in J.consent_ttl_batch(checks).collect()}
    # executed at 0 (cache till 60), hits at 20/50, executed 61 (till 121), hit 65,
    # executed 200 (till 260), hit 230, executed 300
    assert [hits[i] for i in range(8)] == [False, True, True, False, True, False, True, False]


def test_rest_works_without_the_optional_part(tmp_path):
    """Without the operators' folder the other queries are there, whether or not the pipeline file is."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(os.path.join(root, "pagefold"), copy / "pagefold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(root, name)):
            shutil.copy(os.path.join(root, name), copy)
    code = "import __spark_entry__ as E; q = E.queries(); assert len(q) > 150 and 'pipeline' not in q and set(E.oracle_sql()) <= set(q)"
    r = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=copy)
    assert r.returncode == 0, r.stderr[-2000:]


def test_candidate_eval_judges_a_link_once(spark, monkeypatch):
    pages, nt = _nt(spark, [(1, "https://stadt.example.de/aktuelles", G3)])
    ex = spark.createDataFrame([(1, 1, "https://stadt.example.de/news/2024/bericht-1")],
                               "example_id long, page_id long, example_url string")
    links = CT.dom_links(nt, pages).localCheckpoint()
    anchors = CT.example_anchor(links, ex).localCheckpoint()
    best = CT.container_candidate_eval(anchors, nt, links).first()
    assert (best["c_class"], best["valid_links"], best["similar"]) == ("news-list", 2, 2)
    # Elements that come twice count their links as often.
    twice = CT.container_candidate_eval(anchors, nt.unionByName(nt), links).first()
    assert (twice["c_class"], twice["valid_links"], twice["similar"]) == ("news-list", 4, 4)
    judged = spark.sparkContext.accumulator(0)

    def similar(a, b):
        judged.add(1)
        return 1.0
    monkeypatch.setattr(CT.U, "url_similarity", lambda a, b: F.udf(similar, "double")(a, b))
    CT.container_candidate_eval(anchors, nt, links).collect()
    assert judged.value == 2
