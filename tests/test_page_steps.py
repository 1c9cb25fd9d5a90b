"""Page steps that must not grow with their input: parsing and packing in bounded pieces,
links written once, only pages that are asked for parsed; list items of every plan."""

import pyarrow as pa

from pagefold.operators import chunks as K
from pagefold.operators import containers as CT
from pagefold.operators import dom as M
from pagefold.operators import page_local as P
from pagefold.plans import q_containers, q_links, q_plans

ITEM = "<html><body><nav><ul><li><a href='/x'>x</a></li></ul></nav><article><h1>Title {0}</h1><p>Text {0}</p></article></body></html>"


def _tables(spark, folder, urls, html=ITEM):
    rows = [(k, u, html.format(k)) for k, u in enumerate(urls, 1)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(folder / "pages.parquet"))
    return str(folder)


def test_list_items_of_every_plan(spark, tmp_path):
    urls = [f"https://{'h' * n}.de/" for n in range(1, 9)]  # names of every length modulo 4
    got = q_plans.extract_list_items(spark, _tables(spark, tmp_path, urls)).collect()
    assert sorted((r["plan_id"], r["title"]) for r in got) == sorted((f"plan-{'h' * n}.de", f"Title {n}") for n in range(1, 9))


def test_list_items_of_a_repeated_page(spark, tmp_path):
    sf = _tables(spark, tmp_path, ["https://a.de/", "https://bb.de/"])
    spark.read.parquet(f"{sf}/pages.parquet").where("page_id = 2").write.mode("append").parquet(f"{sf}/pages.parquet")
    got = q_plans.extract_list_items(spark, sf).collect()
    assert sorted((r["plan_id"], r["item_idx"]) for r in got) == [("plan-a.de", 0), ("plan-bb.de", 0), ("plan-bb.de", 0)]


def test_a_large_batch_is_parsed_and_packed_in_small_pieces():
    html = "<div>" * 12 + "x" * 3000 + "</div>" * 12
    pages = pa.RecordBatch.from_pydict({"page_id": list(range(400)), "html": [html] * 399 + [None]})
    parsed = list(M._shredded(True)(iter([pages])))
    assert max(b.num_rows for b in parsed) <= M.HTML_SLICE_ROWS * 13
    assert sum(b.num_rows for b in parsed) == 399 * 13 + 1
    assert parsed[0].column("page_text")[12].as_py() == "x" * 3000
    spans = pa.RecordBatch.from_pydict({
        "page_id": list(range(4000)), "html": [html] * 4000,
        "starts": [[5 * k for k in range(12)]] * 4000, "ends": [[len(html) - 6 * k for k in range(12)]] * 4000})
    packed = [(b.nbytes, b.num_rows) for b in K._pack_batches(iter([spans]))]
    assert max(size for size, _ in packed) < 2 * K.PACK_CHARS
    assert sum(n for _, n in packed) == 4000 * 12


def test_packing_keeps_the_greedy_chunks():
    html = "a" * 900 + "b" * 900 + "c" * 900 + "d" * 2500 + "e"
    at = [0, 900, 1800, 2700, 5200]
    assert list(K._packed(html, at, [*at[1:], 5201])) == ["a" * 900 + "b" * 900, "c" * 900, "d" * 2500, "e"]
    assert list(K._packed(html, [], [])) == [] == list(K._packed(html, [3], [3]))


def test_sibling_candidates_read_written_links(spark, tmp_path):
    out = q_links.link_patterns(spark, _tables(spark, tmp_path, [f"https://a.de/{k}" for k in range(6)]))
    assert "pages.parquet" not in " ".join(out.inputFiles())


def test_discovery_extracts_links_once(spark, tmp_path, monkeypatch):
    calls, real = [], CT.dom_links
    monkeypatch.setattr(CT, "dom_links", lambda *a: calls.append(1) or real(*a))
    q_containers.sibling_discovery(spark, _tables(spark, tmp_path, ["https://a.de/1", "https://a.de/2"]))
    assert len(calls) == 1


def test_recorded_selectors_parse_only_their_own_pages(spark, monkeypatch):
    from pagefold.operators import recorded_links as R
    html = '<div><h3><a href="/a">A</a></h3></div>'
    pages = spark.createDataFrame([(k, f"https://a.de/{k}", html) for k in (1, 2)], "page_id long, url string, html string")
    best = spark.createDataFrame([(k, k, 0, "https://a.de/z") for k in (1, 2)], "example_id long, page_id long, container_id int, example_url string")
    links = spark.createDataFrame([], "page_id long, url string, node_id int, ancestors array<int>")
    analysis = spark.createDataFrame([(1, 0.9, "h3 > a", ".no"), (2, 0.9, ".no", "h3 a")],
                                     "example_id long, confidence double, content_link_selector string, example_url_selector string")
    parsed, real = [], P.page_trees

    def trees(own):
        parsed.append(sorted(r["page_id"] for r in own.select("page_id").collect()))
        return real(own)
    monkeypatch.setattr(P, "page_trees", trees)
    got = R.container_links_recorded(best, pages, links, analysis).collect()
    assert sorted((r["example_id"], r["method"]) for r in got) == [(1, "content-selector"), (2, "example-selector")]
    assert parsed == [[1, 2], [2]]
