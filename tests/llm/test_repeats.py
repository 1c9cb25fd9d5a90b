"""Repeated byte strings (operator 12): suffix arrays and the whole operator against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pagefold.llm import op12_suffix_dedup as rep

DOCS = "doc_id long, text string, n long, start long, spans string, mark string, kept string"


def brute(texts, length):
    """``removed runs, kept`` per text, from the number of every string of ``length`` bytes."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k:k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, bool)
        for k in range(len(d) - length + 1):
            if seen[d[k:k + length]] > 1:
                gone[k + 1:k + 1 + length] = True
        edges = np.flatnonzero(np.diff(gone.astype("i1")))
        out.append((len(d), edges.tolist(), bytes(b for b, g in zip(d, gone[1:]) if not g)))
    return out


def mixed_texts(seed, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(60), prose(12)
    texts = [prose(rng.choice([3, 30, 200])) for _ in range(30)]
    texts += [prose(rng.randrange(1, 20)) + passage + prose(rng.randrange(1, 20)) for _ in range(40)]
    texts += [texts[0]] * 5 + [t[:40] + "X" + t[41:] for t in texts[3:12]] + [texts[7][k:k + 3 * length] for k in range(9)]
    texts += [(line + "\n") * 9, "a" * 500, "ab" * 300, "a" * (length - 1), "a" * length, "", None, "\0" * 90, "日本語" * 100]
    return texts


@pytest.mark.parametrize("group", [512, 2])
def test_against_brute_force(spark, group):
    """Also with anchors of at most two stretches, so that every common passage is cut into halves."""
    length = 32
    texts = mixed_texts(3, length)
    rows = [(k, t, 1, 2, "s", "m", "k") for k, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[35], (None, texts[4], *[None] * 5), (None, None, *[None] * 5), (900, "fresh " * 3, *[None] * 5)]
    want = brute([r[1] for r in rows], length)
    got = rep.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(5), length, gram=8, group=group).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["removed"], bytes(r["kept"])) for r in got), key=repr) == sorted(
        ((r[0], *w) for r, w in zip(rows, want)), key=repr)


def test_text_ids_and_empty_table(spark):
    rows = [("x", "q" * 50), ("y", "q" * 20 + "z"), (None, "unlike")]
    got = rep.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string"), 16, gram=4).collect()
    assert {(r["doc_id"], bytes(r["kept"])) for r in got} == {("x", b""), ("y", b"z"), (None, b"unlike")}
    empty = spark.createDataFrame([], DOCS)
    assert rep.remove_repeats(empty).collect() == []


def test_query_on_the_smallest_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = brute([r["text"] for r in docs], 400)
    got = {r["doc_id"]: tuple(r)[1:] for r in rep.op12_suffix_array_dedup(spark, sf).collect()}
    assert len(got) == len(docs) and any(w[1] for w in want)
    for r, (n, runs, kept) in zip(docs, want):
        assert got[r["doc_id"]] == (n, n - len(kept), len(runs) // 2, hashlib.sha256(kept).hexdigest())


def test_order_and_prefixes():
    """Two-stage order and neighbours' common prefixes against sorting all suffixes."""
    rng = random.Random(8)
    for _ in range(150):
        letters = rng.choice([b"a", b"ab", b"abc\0\xff"])
        length = 16
        spans = [bytes(rng.choice(letters) for _ in range(length + rng.randrange(12))) for _ in range(rng.randrange(1, 6))]
        sizes = np.array([len(s) + 1 for s in spans])
        first = np.cumsum(sizes) - sizes
        blob = b"\0".join([*spans, bytes(length + 8)])
        codes = np.frombuffer(blob, "u1")[:sizes.sum()].astype("i2") + 1
        codes[first + sizes - 1] = 0
        n = sizes - length
        order = rep.two_stage(codes, blob, first, n, first + sizes - 1, length)
        starts = [p for f, k in zip(first, n) for p in range(f, f + k)]
        assert len(set(order.tolist())) == len(order)
        order = np.array([p for p in order.tolist() if p in set(starts)])
        keys = [blob[p:p + length] for p in order.tolist()]
        assert sorted(order.tolist()) == starts and keys == sorted(keys)
        got = rep.common_prefixes(np.frombuffer(blob, "u1"), order[:-1], order[1:], length)
        for a, b, c in zip(keys, keys[1:], got.tolist()):
            assert c == next((k for k in range(length) if a[k] != b[k]), length)
