"""The pipeline on the smallest tables, stage by stage, and the registered queries."""

import zlib

from test_tables import brute_components
from test_texts import brute_hits

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline as p
    from pagefold.llm import op1_toxicity as tox
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = [tuple(r) for r in docs.collect()]
    low = {r["doc_id"]: r["score"] for r in tox.score_documents(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    steps = {name: f for name, f in p.STAGES}
    assert list(steps) == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]

    docs = p.save(steps["toxicity"](spark, docs, SF), "test")
    rows = [r for r in rows if low[r[0]] < 0.7]
    assert docs.columns == columns and sorted(tuple(r) for r in docs.collect()) == sorted(rows)

    docs = p.save(steps["near_duplicates"](spark, docs, SF), "test")
    _, _, component = brute_components(rows)
    rows = [r for r, c in zip(rows, component) if r[0] == c]
    assert docs.columns == columns and sorted(tuple(r) for r in docs.collect()) == sorted(rows)

    docs = p.save(steps["decontamination"](spark, docs, SF), "test")
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = brute_hits([r[1] for r in rows], items)
    rows = [r for r, (n, h, _) in zip(rows, hits) if not (h and 20 * h >= n)]
    assert sorted(tuple(r) for r in docs.collect()) == sorted(rows)

    docs = p.save(steps["personal_data"](spark, docs, SF), "test")
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == {r[0] for r in rows}
    packed = steps["packing"](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == {r[0] for r in rows}
    assert sorted(map(tuple, p.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted(tuple(r)[:5] for r in packed)


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, clashing extra columns, an empty table: a defined result of each stage."""
    import corpus_pipeline as p
    plain = [f"plain words number {k} about gardens rivers and roads {'and more ' * k}" for k in range(6)]
    rows = [(k, t, 0.1, "fp", "mark", 3) for k, t in enumerate(plain)]
    rows += [(10, None, None, None, None, None), (11, "", 0.2, "x", "y", 1), (12, " \n", 0.2, "x", "y", 1), rows[2], rows[2], (20, plain[3], 0.9, "z", "z", 9),
             (None, "only text of a row without an id", None, None, None, None), (30, "long " * 20_000, 0.5, "a", "b", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, fp string, mark string, n_words int")
    none = spark.createDataFrame([], docs.schema)
    kept = {"toxicity": rows}
    first = {0, 1, 2, 3, 4, 5, 10, 30, None}  # 11 and 12 are empty like 10, 20 is a copy of 3
    kept["near_duplicates"] = kept["decontamination"] = [r for k, r in enumerate(rows) if r[0] in first and r not in rows[:k]]
    for name, stage in p.STAGES[:-1]:
        docs = p.save(stage(spark, docs, SF), "test")
        got = [tuple(r) for r in docs.collect()]
        if name in kept:
            assert sorted(got, key=repr) == sorted(kept[name], key=repr), name
        else:
            assert sorted(got, key=repr) == sorted(kept["decontamination"], key=repr)  # nothing personal
        empty = stage(spark, none, SF)
        assert empty.columns == docs.columns and empty.count() == 0
    packed = p.packing(spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == first and p.packing(spark, none, SF).count() == 0
    assert [r["length"] for r in packed if r["doc_id"] == 10] == [1] and len([r for r in packed if r["doc_id"] == 30]) > 1


def test_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


def test_held_out_rule():
    assert zlib.crc32(b"12") == 1330857165
