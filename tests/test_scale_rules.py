"""Results that must not depend on caps, arrival order, file layout or group sizes."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from pagefold.operators import compliance, containers, dom, retrieval
from pagefold.sources import files
from pagefold.streaming import jobs

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """The event table in shuffled order over several files."""
    path = str(tmp_path_factory.mktemp("events"))
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.repartition(4, F.xxhash64("event_id")).sortWithinPartitions(F.xxhash64("event_id", F.lit(1))).write.parquet(f"{path}/events.parquet")
    return path, e


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_consent_stream_equals_batch_on_shuffled_files(spark, shuffled):
    path, e = shuffled
    src = jobs.stream_source(spark, path, "events", EVENTS)
    got = jobs.run_available_now(jobs.consent_ttl_stream(jobs.consent_checks_from(src)), "t-consent")
    want = jobs.consent_ttl_batch(jobs.consent_checks_from(e))
    cols = ("domain", "seq", "outcome", "cache_hit")
    assert rows(got.select(*cols)) == rows(want.select(*cols))
    assert got.where("late").count() == 0


def test_consent_stream_splits_a_domain_and_keeps_every_check(spark, tmp_path):
    """One domain: its pieces lie in several tasks; the expiry is carried over micro-batches; old checks are late, not lost."""
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("user_id", F.lit(7).cast("long"))
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    thin = e.where(F.col("event_id") % 40 == 0)
    for k, part in enumerate([thin.where(F.col("ts") < first + (last - first) / 2), thin.where(F.col("ts") >= first + (last - first) / 2),
                              e.where(F.col("event_id") % 40 == 1)]):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
        time.sleep(1.1)  # files are taken by time of change
    checks = lambda df: jobs.consent_checks_from(df)
    src = jobs.stream_source(spark, str(tmp_path), "events", EVENTS, 1)
    got = jobs.run_available_now(jobs.consent_ttl_stream(checks(src)), "t-one-domain").withColumn("file", F.input_file_name())
    cols = ("domain", "seq", "outcome", "cache_hit")
    now = got.where(F.col("seq") % 40 == 0)
    assert rows(now.select(*cols)) == rows(jobs.consent_ttl_batch(checks(thin)).select(*cols))
    assert now.where("late").count() == 0 and now.select("file").distinct().count() > 2
    old = got.where(F.col("seq") % 40 == 1)
    assert old.count() == e.where(F.col("event_id") % 40 == 1).count() and old.where("late").count() > 0


@pytest.mark.parametrize("max_files", [None, 1])
def test_terminal_and_state_in_any_order(spark, shuffled, max_files):
    path, e = shuffled
    events = jobs.task_events_from(jobs.stream_source(spark, path, "events", EVENTS, max_files))
    batch = jobs.task_events_from(e)
    got = jobs.run_available_now(jobs.terminal(events), "t-terminal", "update", key=["task_id"])
    assert rows(got.select("task_id", "exit_code", "closed_at")) == rows(jobs.terminal(batch).select("task_id", "exit_code", "closed_at"))
    got = jobs.run_available_now(jobs.task_state(events), "t-state", "update", key=["task_id"])
    want = jobs.task_state(batch)
    assert rows(got.select(*want.columns)) == rows(want)


def test_indented_result_file(spark, tmp_path):
    doc = {"runId": "r1", "planId": "p", "status": "completed", "metrics": {"itemsExtracted": 3, "duration": 5}, "errors": []}
    (tmp_path / "one.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "noid.json").write_text(json.dumps({"status": ""}, indent=2))
    (tmp_path / "bad.json").write_text("{not json")
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(doc | {"runId": f"l{k}"}) for k in range(2)))
    got = files.src_result_json(spark, str(tmp_path))
    assert got.count() == 4
    assert sorted(r["id"] for r in got.collect()) == ["l0", "l1", "noid", "r1"]
    assert got.where("id = 'r1'").first()["itemsExtracted"] == 3


def test_result_files_do_not_follow_the_number_of_plans(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FILE_DOCUMENTS", 20)
    value = "struct(id AS duration, id AS itemsExtracted, id AS pagesProcessed)"
    plan = "if(id % 10 = 0, 'hot', if(id = 1, NULL, concat('plan ', id)))"
    docs = spark.range(500).selectExpr(f"{plan} AS plan", "concat('r', id) AS runId", f"{plan} AS planId", "'ok' AS status", f"{value} AS metrics")
    files.sink_results_json(docs, str(tmp_path))
    assert len([p for p in tmp_path.iterdir() if p.is_dir()]) <= files.PLAN_GROUPS
    folders = {}
    for p in tmp_path.rglob("*.json"):
        lines = [json.loads(x) for x in p.read_text().splitlines()]
        assert len(lines) <= 20
        for x in lines:
            folders.setdefault(x.get("plan"), set()).add(p.parent.name)
    assert len(folders) == 451 and all(len(f) == 1 for f in folders.values())
    got = {r["id"]: (r["planId"], r["itemsExtracted"]) for r in files.src_result_json(spark, str(tmp_path)).collect()}
    assert got == {f"r{k}": ("hot" if k % 10 == 0 else "unknown" if k == 1 else f"plan {k}", k) for k in range(500)}


@pytest.mark.parametrize("selector", ["li:first-child", "div.a:not(.b)", "a + b", "a ~ b", "", "a,,b", "> a", "a[b~=c]", "a:hover"])
def test_selectors_outside_the_subset_are_refused(selector):
    with pytest.raises(dom.UnsupportedSelector):
        dom.parse_selector(selector)


def test_quotes_and_brackets_in_selectors(spark):
    pages = spark.createDataFrame([(1, '<div><a title="x, y" href="/a b">1</a><a title="x" data-x="p > q">2</a></div>')],
                                  "page_id long, html string")
    nodes, texts = dom.shred_pages(pages)
    named = {"a": 'a[title="x, y"]', "b": 'a[href*="a b"]', "c": 'div > a[data-x="p > q"]', "d": "a:nope"}
    steps, errors = dom.selector_steps(spark.createDataFrame([(s,) for s in named.values()], "selector string"))
    hits = dom.selector_match(nodes, steps).join(dom.with_text(nodes, texts), ["page_id", "node_id"])
    assert {r["sel_id"]: r["text_content"] for r in hits.collect()} == {named["a"]: "1", named["b"]: "1", named["c"]: "2"}
    assert [r["selector"] for r in errors.collect()] == ["a:nope"]


def test_walk_has_no_cap_and_ends_in_a_cycle(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1001), (1001, 1002), (1002, 1001)]
    ids = [(k,) for k in range(301)] + [(k,) for k in (1000, 1001, 1002)]
    e = spark.createDataFrame(edges, "page_id long, next_page_id long")
    p = spark.createDataFrame(ids, "page_id long")
    got = rows(containers.pagination_walk(e, p))
    assert got == sorted([(0, k + 1, k) for k in range(301)] + [(1000, k + 1, 1000 + k) for k in range(3)], key=repr)
    capped = rows(containers.pagination_walk(e, p, 5))
    assert capped == sorted([(0, k + 1, k) for k in range(5)] + [(1000, d, x) for d, x in
                                                              zip(range(1, 6), (1000, 1001, 1002, 1001, 1002))], key=repr)


def test_any_number_of_queries(spark):
    rng = random.Random(1)
    vecs = [(k, "l", [rng.gauss(0, 1) for _ in range(4)]) for k in range(60)]
    queries = [(str(k), [rng.gauss(0, 1) for _ in range(4)]) for k in range(5000)]
    v = spark.createDataFrame(vecs, "vec_id long, label string, embedding array<double>")
    q = spark.createDataFrame(queries, "query_id string, embedding array<double>")
    got = {}
    for r in retrieval.similar_topk(v, q, 2).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert len(got) == 5000

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    for qid, qv in rng.sample(queries, 50):
        best = sorted(vecs, key=lambda r: (-cos(r[2], qv), r[0]))[:2]
        assert got[qid] == {1: best[0][0], 2: best[1][0]}


def test_deletion_counts_an_item_once(spark):
    items = spark.createDataFrame([(1, "http://a.org/x", "m@a.org", "1", "2024-01-05"), (2, "http://a.org/y", None, "2", "2024-01-09"),
                                   (3, "http://b.org/", "m@a.org", None, None)],
                                  "item_id long, sourceUrl string, email string, phone string, endDate string")
    req = spark.sql("""SELECT * FROM VALUES ('r1', 'a.org', 'm@a.org', NULL, NULL, NULL),
        ('r2', NULL, NULL, NULL, TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31'), ('r3', 'none.org', NULL, NULL, NULL, NULL)
        AS t(request_id, domain, email, phone, from_ts, to_ts)""").withColumn("phone", F.col("phone").cast("string"))
    assert rows(compliance.gdpr_delete_counts(items, req)) == [("r1", 3), ("r2", 2), ("r3", 0)]
    assert compliance.gdpr_delete(items, req).count() == 0


def test_queries_change_no_session_setting(spark):
    before = {k: v for k, v in spark.sparkContext.getConf().getAll()} | {"arrow": spark.conf.get(
        "spark.sql.execution.arrow.maxRecordsPerBatch")}
    dom.dom_shred(spark.createDataFrame([(1, "<p>x")], "page_id long, html string")).count()
    after = {k: v for k, v in spark.sparkContext.getConf().getAll()} | {"arrow": spark.conf.get(
        "spark.sql.execution.arrow.maxRecordsPerBatch")}
    assert before == after
