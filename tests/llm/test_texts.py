"""Per-text parts of the operators against brute force."""

import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagefold.llm import op1_toxicity as tox
from pagefold.llm import op2_pii as pii
from pagefold.llm import op3_simhash as sim
from pagefold.llm import op6_packing as packing
from pagefold.llm import op7_decontaminate as dec
from pagefold.llm import op9_tokens as tok


# ---- op2 -------------------------------------------------------------------

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and _luhn(digits)
    return kind != "phone" or 8 <= len(digits) <= 15


def brute_spans(text):
    return {k: [m.span() for m in re.finditer(r, text or "") if _valid(k, m[0])] for k, r in RULES.items()}


PARTS = ["a", "b.c", "@", ".", "-", " ", "+", "1", "255", "256", "4485", "4111111111111111", "é", "x@y.zz", "+1 (555) 010-9999",
         "1.2.3.4", "\n", "(", ")", "%", "_", "://", "token = ", "01", "0", "٣", "account no ", "@d.e@f.g", "..", "7"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_base_spans_equal_the_patterns(text):
    found = pii.find(text)
    assert {k: found[k] for k in pii.BASE} == brute_spans(text)


def test_added_kinds_and_redaction():
    text = 'Mail jörg@bücher.example, token = "04dbebab91ab85687d33" at https://bob:pw9@host.example/x, IBAN DE89 3704 0044 0532 0130 00.'
    found = pii.find(text)
    said = {k: [text[a:b] for a, b in v] for k, v in found.items() if v}
    assert said["address"] == ["jörg@bücher.example"]
    assert said["secret"] == ["04dbebab91ab85687d33"]
    assert said["credential"] == ["bob:pw9"]
    assert said["account"] == ["DE89 3704 0044 0532 0130 00"]
    out = pii.redact(text)
    assert "04db" not in out and "[SECRET]" in out and "[ACCOUNT]" in out
    assert pii.redact(None) is None and pii.redact("") == "" and pii.redact("plain words") == "plain words"


def test_long_digit_runs_end():
    assert pii.find("9" * 200_000)["card"] == []
    assert pii.find("1." * 100_000)["ip"] == brute_spans("1." * 100_000)["ip"]


# ---- op3 -------------------------------------------------------------------

def brute_simhash(text, shingle=3):
    import xxhash
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    parts = [" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["A", "b", "É", " ", "\t", "\x1c", "\x0b", " ", "the", "cat  ", "\n"]), max_size=30).map("".join))
def test_simhash(text):
    assert sim.simhash(text) == brute_simhash(text)


def test_bk_tree_finds_all_within_the_radius():
    import numpy as np
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (2 ** 64 - 1) for b in base for _ in range(40)})
    arr = np.array(values, "<u8")
    got = {(n, q) for n, near in sim.BKTree(arr).within(arr, 2) for q in near.tolist()}
    want = {(i, j) for i, a in enumerate(values) for j, b in enumerate(values) if (a ^ b).bit_count() <= 2}
    assert got == want


# ---- op6 -------------------------------------------------------------------

def test_plan_is_whole_and_tight():
    rng = random.Random(3)
    for _ in range(200):
        cap = rng.choice([10, 30, 97])
        counts = {rng.randint(1, cap): rng.randint(1, 40) for _ in range(rng.randint(0, 25))}
        placed, bins = set(), {}
        for length, first, n, bin_, at in packing.plan(counts, cap):
            for k in range(n):
                assert (length, first + k) not in placed
                placed.add((length, first + k))
                bins.setdefault(bin_ + k, []).append((at, length))
        assert len(placed) == sum(counts.values())
        for own in bins.values():
            at = 0
            for start, length in sorted(own):
                assert start == at
                at += length
            assert at <= cap
            assert sum(3 * n > cap for _, n in own) <= 2
        # No worse than plain first-fit decreasing by more than one bin in fifty.
        loads = []
        for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            k = next((i for i, used in enumerate(loads) if used + length <= cap), None)
            if k is None:
                loads.append(length)
            else:
                loads[k] += length
        assert len(bins) <= len(loads) * 1.02 + 1


TOKENS = ["a", "'s", " ", "  ", "   ", "\n", "é", "1", "23", "!", "the", "<|endoftext|>", " ", "\x85", "日本", "​",
          "😀", "'", "l", " the", "\x1c", "́", "\t", "İ", "Σ", "ſ", "ﬁ", " ", "A", "É", "ß", "×", "²", "'LL", "\x00"]


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers
    return packing.WordEncoder(public_tokenizers.path(packing.VOCABULARY), room=50)


@pytest.fixture(scope="module")
def counter():
    import public_tokenizers
    return tok.PrefixCounter(public_tokenizers.path(tok.VOCABULARY), room=50)


@settings(max_examples=150, deadline=None)
@given(text=st.lists(st.sampled_from(TOKENS), max_size=10).map("".join))
def test_word_encoder_equals_the_library(encoder, text):
    assert encoder.encode(text) == encoder.whole(text)


@settings(max_examples=50, deadline=None)
@given(texts=st.lists(st.none() | st.lists(st.sampled_from(TOKENS), max_size=6).map("".join), max_size=6))
def test_texts_of_a_slice_equal_the_library(encoder, texts):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(packing, "BLOCK_RUNS", 2)
        got = [*encoder.encode_all(pa.array([None, *texts, None], pa.string()).slice(1, len(texts)))]
    assert got == [encoder.whole(t or "") for t in texts]


def test_a_run_is_looked_up_once_per_slice():
    import public_tokenizers
    e = packing.WordEncoder(public_tokenizers.path(packing.VOCABULARY), room=0)
    asked, work = [], e.runs.work
    e.runs.work = lambda run: asked.append(run) or work(run)
    assert e.encode("one two, " * 50) == e.whole("one two, " * 50)
    assert sorted(r for r in asked if r) == ["one", "two,"]


# ---- op9 -------------------------------------------------------------------

@settings(max_examples=150, deadline=None)
@given(text=st.lists(st.sampled_from(TOKENS), max_size=10).map("".join), n=st.integers(0, 30))
def test_prefix_counts_equal_the_library(counter, text, n):
    assert counter.total(text) == counter.whole(text)
    ends, total = counter.prefix_table(text)
    assert ends[-1] == len(text) and total[-1] == counter.whole(text)
    if "<|" not in text:
        assert counter.count_at(text, n) == counter.whole(text[:n])
    cut = counter.cut(text, n)
    assert counter.whole(text[:cut]) <= n or cut == 0


@settings(max_examples=400, deadline=None)
@given(text=st.lists(st.sampled_from(TOKENS), max_size=14).map("".join), n=st.integers(0, 40))
def test_cuts_are_the_longest_prefixes(counter, text, n):
    ends, total = table = counter.prefix_table(text)
    assert ends == sorted(set(ends)) and counter.cut(text, n, table) == max(e for e in ends if counter.whole(text[:e]) <= n)
    for at in range(len(text) + 1):
        assert counter.count_at(text, at, table) == counter.whole(text[:at])


def test_long_texts_with_added_tokens_are_cut_at_the_limit(counter):
    text = ("some words <|endoftext|>" * 40 + " and more" * 40) * 9
    cut = counter.cut(text, tok.LIMIT)
    assert counter.whole(text[:cut]) == tok.LIMIT and counter.total(text) == counter.whole(text)
    assert counter.cut("<|endoftext|>" * 600, tok.LIMIT) == tok.LIMIT * len("<|endoftext|>")


# ---- op7 -------------------------------------------------------------------

def brute_hits(docs, items, window=13):
    def ws(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    wins = []
    for item, text in items:
        w = ws(text)
        n = min(window, len(w))
        wins += [(item, w[i:i + n]) for i in range(len(w) - n + 1)] if n else []
    out = []
    for text in docs:
        w = ws(text)
        hit, ids = set(), set()
        for item, win in wins:
            for i in range(len(w) - len(win) + 1):
                if w[i:i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    ids.add(item)
        out.append((len(w), len(hit), sorted(ids)))
    return out


def test_occurrences_equal_brute_force():
    rng = random.Random(9)
    for trial in range(60):
        words = ["a", "b", "B", "é", "c1", "x", "日"][:rng.randint(2, 7)]
        make = lambda most: " ".join(rng.choice(words) + rng.choice(["", "", ",", "\x1c"]) for _ in range(rng.randint(0, most)))
        items = [(str(k), make(20)) for k in range(rng.randint(0, 5))] + [("7", None)]
        docs = [make(60) for _ in range(rng.randint(0, 8))] + [None, "", (items[0][1] or "") * 2]
        got = dec.occurrences(dec.TestSuffixes(items, 13), docs)
        want = brute_hits(docs, items)
        assert [(n, sum(b - a for a, b in zip(s[::2], s[1::2])), i) for n, s, i in got] == want


def brute_matches(docs, items, window=13):
    """Longest verbatim matches: grown from every pair of equal words that the word before does not extend."""
    def ws(t):
        return [w.decode() for w in dec.words(t)]
    out = []
    for text in docs:
        w, own = ws(text), set()
        for item, other in items:
            v = ws(other)
            for i in range(len(w)):
                for j in range(len(v)):
                    n = 0
                    while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                        n += 1
                    if n >= min(window, len(v)) and not (i and j and w[i - 1] == v[j - 1]):
                        own.add((item, i, n))
        out.append((len(w), sorted(own)))
    return out


def test_longest_matches_equal_brute_force():
    rng = random.Random(19)
    for _ in range(40):
        words = ["a", "b", "c1", "x", "é"][:rng.randint(2, 5)]
        make = lambda most: " ".join(rng.choice(words) for _ in range(rng.randint(0, most)))
        items = list({k: (str(k), make(30)) for k in range(rng.randint(0, 5))}.values()) + [("7", None)]
        docs = [make(60) for _ in range(rng.randint(0, 5))] + [None, (items[0][1] or "") + " zz " + (items[0][1] or "")]
        got = [(n, sorted(set(found))) for n, found in dec.longest_matches(dec.TestSuffixes(items, 4), docs)]
        assert got == brute_matches(docs, items, 4)
    long = " ".join(f"w{k}" for k in range(80))
    assert dec.longest_matches(dec.TestSuffixes([("i", "q " + long + " z")], 13), ["start " + long + " end"]) == [(82, [("i", 1, 80)])]


def test_merged_stretches():
    assert dec.merged([5, 7, 0, 2, 2, 4, 6, 9]) == [0, 4, 5, 9]


# ---- op1 -------------------------------------------------------------------

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=100, deadline=None)
@given(st.text("abcx", max_size=11))
def test_automaton_equals_edit_distance(word):
    terms = ("abc", "abcab", "bcabcx", "abcabcabca", "cab", "xxxxxxxxx")
    want = {n: d for n, t in enumerate(terms) if (d := edits(t, word)) <= tox.Matcher.allowed(len(t))}
    assert tox.Matcher(terms).match(word) == want


def test_disguises_and_context():
    m = tox.Matcher(("stupid", "worthless", "scum"))
    for said in ("STUPID!", "stup1d", "st*pid", "s.t.u.p.i.d", "stuuuupid", "w0rthles"):
        assert m(said)[0], said
    assert not m("a student cup spid")[0]
    assert set(m("you are scum")[0].values()) == {1.0}
    assert set(m('the word "scum" is old')[0].values()) == {tox.REPORTED}
    assert set(m("he called them scum yesterday")[0].values()) == {tox.REPORTED}
    assert set(m("he said you are scum")[0].values()) == {1.0}
    assert m(None) == ({}, 0)
