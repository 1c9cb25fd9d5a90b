"""Operators over small tables against brute force: nulls, ties, repeated rows, long texts, extra columns, empty tables."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from pagefold.llm import common
from pagefold.llm import op1_toxicity as tox
from pagefold.llm import op2_pii as pii
from pagefold.llm import op3_simhash as sim
from pagefold.llm import op4_html as html
from pagefold.llm import op5_urls as urls
from pagefold.llm import op6_packing as packing
from pagefold.llm import op7_decontaminate as dec
from pagefold.llm import op8_quality as quality
from pagefold.llm import op9_tokens as tok
from pagefold.llm import op10_chat as chat

from test_texts import brute_hits, brute_simhash, brute_spans

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, spans string, words string"


@pytest.fixture(scope="module")
def docs(spark):
    """Ordinary texts, copies, near copies, nulls in every column, repeated rows and clashing extra columns."""
    rng = random.Random(4)
    words = [a + b for a in ("the", "sun", "Road", "éta", "x1") for b in ("", "s", "ing", "é")]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 40, 200, 900]))) for _ in range(30)]
    texts = [*base, *base[:8], *(b + " tail" for b in base[20:26]), None, "", " \n\t ", "a@b.cc +1 555 010 9999 x 1.2.3.4",
             "9" * 50_000, "word " * 30_000, "#$% " * 60, "one line\n" * 40, "日本語 " * 80]
    rows = [(k, t, "en", "s", len(t) if t else None, 0.5, 1, "s", "w") for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base[5], None, None, None, None, None, None, None), (None, None, *[None] * 7),
             (900, None, *[None] * 7), (901, "fresh words only here", *[None] * 7)]
    return spark.createDataFrame(rows, DOCS), rows


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_components(spark):
    rng = random.Random(1)
    for _ in range(2):
        edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(30)] + [(k, k + 1) for k in range(100, 160)] + [(70, 70)]
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x
        for a, b in edges:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        got = {r["node"]: r["component"] for r in common.connected_components(
            spark.createDataFrame(edges, "src long, dst long")).collect()}
        assert got == {x: find(x) for x in root}
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_personal_data(spark, docs, none):
    df, rows = docs
    got = rows_of(pii.find_personal_data(df).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"))
    want = []
    for r in rows:
        s = brute_spans(r[1])
        base = ",".join(f"{k}:{a}:{b}" for k in pii.BASE for a, b in s[k])
        want.append((r[0], *(len(s[k]) for k in pii.BASE), hashlib.sha256(base.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    out = pii.redact_documents(df)
    assert out.columns == df.columns and out.count() == len(rows)
    assert {r["text"] for r in out.where("doc_id = 47").collect()} == {"[EMAIL] [PHONE] x [IP]"}
    assert pii.find_personal_data(none).count() == 0 and pii.redact_documents(none).count() == 0


def brute_components(rows, shingle=3, radius=2):
    prints = [brute_simhash(r[1], shingle) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    low = {}
    for g, r in zip(group, rows):
        low[g] = min((x for x in (low.get(g), r[0]) if x is not None), default=None)
    return prints, group, [low[g] for g in group]


@pytest.mark.parametrize("tree_size", [4096, 2])
def test_near_duplicates(spark, docs, none, tree_size, monkeypatch):
    df, rows = docs
    prints, group, component = brute_components(rows)
    monkeypatch.setattr(sim, "TREE_SIZE", tree_size)
    found = spark.createDataFrame([(r[0], p - 2 ** 64 if p >> 63 else p) for r, p in zip(rows, prints)], "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in sim.classes(found, 2, tree_size).collect()}
    assert got == {p - 2 ** 64 if p >> 63 else p: c for p, c in zip(prints, component)}
    if tree_size > 2:
        assert rows_of(sim.near_duplicates(df)) == sorted(
            ((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, component)), key=repr)
        kept = sim.keep_one(df)
        assert kept.columns == df.columns
        left = [tuple(r) for r in kept.collect()]
        assert len(left) == len(set(group))
        assert sorted((r[0] for r in left), key=repr) == sorted((component[g] for g in set(group)), key=repr)
        assert sim.near_duplicates(none).count() == 0 and sim.keep_one(none).count() == 0


def test_dense_shard_keeps_every_link(spark):
    """Thousands of fingerprints in one shard: cut again, nothing lost."""
    rng = random.Random(2)
    base = rng.getrandbits(63)
    prints = sorted({base ^ (rng.getrandbits(14)) for _ in range(1500)})
    got = {r["fp"]: r["component_id"] for r in sim.classes(
        spark.createDataFrame([(k, p) for k, p in enumerate(prints)], "doc_id long, fp long"), 2, 64).collect()}
    root = list(range(len(prints)))
    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= 2 and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert got == {p: r for p, r in zip(prints, root)}


def test_packing(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer
    df, rows = docs
    path = public_tokenizers.path(packing.VOCABULARY)
    lib = Tokenizer.from_file(path)
    got = packing.pack_documents(df, path, 256).collect()
    want = []
    for r in rows:
        ids = [*lib.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 256):
            part = ids[k:k + 256]
            want.append((r[0], k // 256, k, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))))
    assert sorted((tuple(g)[:5] for g in got), key=repr) == sorted(want, key=repr)
    bins = {}
    for g in got:
        bins.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(w[3] for w in want)
    assert len(bins) <= 1.02 * max(-(-total // 256), sum(w[3] > 128 for w in want)) + 1
    assert packing.pack_documents(none, path).count() == 0


@pytest.mark.parametrize("chunk", [20_000, 2])
def test_decontamination(spark, docs, none, chunk):
    df, rows = docs
    items = [(1, " ".join((rows[0][1] or "").split()[:30])), (2, rows[4][1]), (2, rows[4][1]), (3, "Sun"), (None, "roads THE"),
             (5, None), (6, ""), (7, " ".join(rows[8][1].split()[:13]))]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, n_words string")
    want = []
    hits = brute_hits([r[1] for r in rows], [("" if i is None else str(i), t) for i, t in items])
    for r, (n, h, ids) in zip(rows, hits):
        want.append((r[0], n, h, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), h > 0 and 20 * h >= n))
    found = df.select("doc_id", dec.contamination(df["text"], bench, chunk_items=chunk).alias("f"))
    assert rows_of(found.selectExpr("doc_id", "f.n_words", "size(f.items)")) == sorted(((w[0], w[1], w[3]) for w in want), key=repr)
    if chunk > 2:
        assert rows_of(dec.report(df, bench)) == sorted(want, key=repr)
        assert dec.report(df, bench.limit(0)).where("contaminated").count() == 0
        assert dec.report(none, bench).count() == 0
    else:
        spans = found.selectExpr("f.spans").collect()
        assert sorted(sum(b - a for a, b in zip(s[0][::2], s[0][1::2])) for s in spans) == sorted(w[2] for w in want)
    left = dec.remove_contaminated(df, bench, chunk)
    assert left.columns == df.columns and left.count() == sum(not w[5] for w in want)
    assert rows_of(dec.report(df, bench, chunk)) == sorted(want, key=repr)


def test_token_counts(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer
    df, rows = docs
    path = public_tokenizers.path(tok.VOCABULARY)
    lib = Tokenizer.from_file(path)
    want = []
    for r in rows:
        n = len(lib.encode(r[1] or "", add_special_tokens=False))
        want.append((r[0], len((r[1] or "").encode()), n, n > 512))
    out = tok.token_counts(df, path)
    assert rows_of(out.drop("cut_chars")) == sorted(want, key=repr)
    assert tok.token_counts(none, path).count() == 0


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    from collections import Counter
    count, cover = Counter(wins), set()
    for i, w in enumerate(wins):
        if count[w] > 1:
            cover |= {i, i + 1, i + 2}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover),
            n < 50 or 100 * len(cover) > 50 * n)


def test_quality(spark, docs, none):
    df, rows = docs
    out = quality.judge(df)
    assert rows_of(out.drop("kept")) == sorted(((r[0], *brute_quality(r[1])) for r in rows), key=repr)
    assert out.where("kept AND base_failed").count() == 0
    assert out.where("kept").count() > 0
    assert quality.judge(none).count() == 0
    # A filter on the verdict stays above the generator, and nothing leaves the JVM.
    plan = out.where("kept")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_cascade_order(spark, docs):
    measured = quality.measures(docs[0]).cache()
    ordered = quality.plan_cascade(measured, quality.rules())
    assert sorted(r.name for r in ordered) == sorted(r.name for r in quality.rules())
    a = measured.select("doc_id", quality.cascade(ordered).alias("k"))
    b = measured.select("doc_id", quality.cascade(quality.rules()).alias("k"))
    assert rows_of(a) == rows_of(b)


def test_toxicity(spark, docs, none):
    rng = random.Random(6)
    plain = ["the", "sun", "and", "road", "of", "green", "walks", "river"]
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        for _ in range(2 if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["gormless", "numbskull", "wretchling"])
        rows.append((k, " ".join(words), float(k)))
        labels.append((k, 1, int(bad)))
    rows += [(1000, "the sun numbskul walks gormles", 0.0), (1001, None, 0.0), (1002, "", 0.0), (None, "the sun", 0.0), (5, rows[5][1], 0.0)]
    labels += [(None, 1, 1), (7, None, None), (8, 1, 1), (8, 1, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {}
    for r in tox.score_documents(df, lab).collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, out.values())) == len(rows)
    held = [r for k in range(400) for r in out[k][:1] if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for k in range(400) for r in out[k])
    assert sum((r["doc_id"] % 4 == 0) == bool(r["predicted"]) for r in held) >= 0.95 * len(held)
    assert out[1000][0]["predicted"] == 1, "misspelled terms"
    assert len({r["score"] for r in out[5]}) == 1
    assert 0 <= out[1001][0]["score"] == out[1002][0]["score"] < 0.7 and out[None][0]["held_out"] is False
    left = tox.remove_toxic(df, lab)
    assert left.columns == df.columns and left.where("doc_id = 1000").count() == 0 and left.where("doc_id IS NULL").count() == 1
    assert tox.score_documents(none, lab).count() == 0
    assert {r["score"] for r in tox.score_documents(df, lab.limit(0)).collect()} == {0.0}


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li>menu</li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>{h}</h1><p>One &amp; {b}<br>two</p><p>Three</p>{x}</article>
<div id="comments"><p>first!</p></div><footer>&copy; me</footer></body></html>"""
SOUP = """<body><div class=header>Site</div><div class=side-menu>a b c</div><div class=main-col><h2>{h}</h2><p>{b}
 words<p>more words here</div><div class=ads>buy</div><form><p>mail us</p></form></body>"""


def test_main_text(spark):
    rows, want = [], []
    for k in range(12):
        h, b = f"Head {k}", "body text " * (k + 1)
        rows.append((k, "https://a.example/%d" % k, PAGE.format(h=h, b=b, x="<div class='promo'>p</div>" if k % 2 else "")))
        want.append(f"{h} One & {' '.join(b.split())} two Three")
    for k in range(12, 18):
        rows.append((k, "http://b.example", SOUP.format(h=f"Head {k}", b="some long body " * k)))
        want.append(f"Head {k} {' '.join(('some long body ' * k).split())} words more words here")
    odd = [(50, None, PAGE.format(h="x", b="y", x="")), (51, "nonsense", None), (52, "http://a.example", ""), (None, "http://a.example", "<p>lone"),
           (53, "http://c.example", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    rows += odd
    want += ["x One & y two Three", "", "", "lone", "deep"]
    rows.append(rows[3])
    want.append(want[3])
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = rows_of(html.extract(df))
    assert got == sorted(((r[0], r[1], w, len(w)) for r, w in zip(rows, want)), key=repr)
    assert html.extract(df.limit(0)).count() == 0


def test_constants_below_the_main_text(spark):
    """Copies of a page and headings of every article stay; template text of a plain container goes."""
    rows, want = [], []
    story = "<h2>Part</h2><p>one text</p><p>two texts</p><blockquote>Said so</blockquote><div class=end><p>Last</p></div>"
    for k in range(6):
        rows += [(f"http://a.example/{k}", f"<body><article>{story}</article></body>"),
                 (f"http://b.example/{k}", f"<body><div class=text>{story}</div></body>"),
                 (f"http://c.example/{k}", f"<body><article><h2>Summary</h2><p>{'own words ' * (k + 1)}</p></article></body>"),
                 (f"http://d.example/{k}", f"<body><div class=text>{story}</div><div class=day>{k}</div></body>"),
                 (f"http://e.example/{k}", f"<body><div class=text><p>{'long own words ' * (k + 2)}</p><div class=box>House rules</div></div></body>")]
        part = "Part one text two texts Said so Last"
        want += [part, part, "Summary" + " own words" * (k + 1), None, ("long own words " * (k + 2)).strip()]
    for k in range(20):
        rows.append((f"http://b.example/x{k}", f"<body><div class=text><p>{'other words ' * (k + 1)}</p></div></body>"))
        want.append(("other words " * (k + 1)).strip())
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    for k, w in enumerate(want):
        if w is None:
            assert got[k].startswith("Part one text two texts Said so Last")
        else:
            assert got[k] == w


def test_wide_pages(spark):
    """Pages of thousands of blocks with classes of their own, which nothing folds."""
    blocks = 2500
    part = lambda k, name: "".join(f"<div class={name}q{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}>w{k}x{i}</div>"
                                   for i in range(blocks))
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(blocks))
    rows = [("http://a.example/", f"<body><div>outside</div><article>{part(0, 's')}</article><p>after</p></body>")]
    rows += [("http://b.example/%d" % k, f"<body><div>outside</div><main>{part(k, 's')}</main><p>after</p></body>") for k in range(3)]
    rows += [("http://c.example/", f"<body><p>outside</p><div class=text>{part(0, 's')}</div><p>after</p></body>")]
    want = [words(0), *map(words, range(3)), words(0)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert [got[k] for k in range(len(rows))] == want
    # Texts of many bodies of their own: nothing is on most pages, so each page is read on its own.
    page = "<html><body class=x><div class=text>{t}</div><div>short</div></body></html>".format(t="own text " * 30)
    far = '{"article": [], "main": [], "at": [], "constants": []}'
    assert html.main_text(page, far) == html.main_text(page, None) == ("own text " * 30).strip()


def test_article_text_with_furniture_words(spark):
    """Words of menus and comments in ids and classes of an article's own parts drop nothing."""
    story = ("<h2 id='related-work'>Related</h2><p id='share'>p one</p><div class='social-policy'>d one</div><div class='share-prices'>d two</div>"
             "<div class='login-guide'>d three</div><p class='ad-hoc'>p two</p><div class='promotion'><p>d four</p></div>"
             "<section id='comments-on-method'>s one</section><h3 class='comments'>Comments</h3><div class='menu'>soup and fish</div>")
    want = "Related p one d one d two d three p two d four s one Comments soup and fish"
    junk = ("<div class='ad'>buy</div><div class='related-posts'><a href=x>more</a></div><ul class='social'><li><a href=x>like</a></ul>"
            "<div class='subscribe'>mail <input name=m></div><section class='comments'><article class='comment'><p>first!</p></article>"
            "<article class='comment'>no</article></section><article class='comment-item'>also</article><p class='newsletter'>weekly</p>")
    rows = [("http://a.example/1", f"<body><nav>n</nav><article><h1>T</h1>{story}{junk}</article><div>out</div></body>", "T " + want),
            ("http://b.example/1", f"<body><main><h1>T</h1>{story}{junk}</main></body>", "T " + want)]
    # An article of another class than the teasers of the host.
    for k in range(4):
        rows.append((f"http://c.example/{k}", f"<body><article class=post><p>{'story words ' * (k + 9)}</p></article></body>", ("story words " * (k + 9)).strip()))
    rows.append(("http://c.example/x", "<body><article class=feature><p>long feature text</p></article><article class=post>teaser</article></body>",
                 "long feature text"))
    rows.append(("http://c.example/y", "<body><article class=feature><p>a feature of some length</p></article>" + "<article class=post><p>teaser text</p></article>" * 4
                 + "</body>", "a feature of some length"))
    rows.append(("http://c.example/z", "<body><article class=post></article><div class=story><p>text that follows an empty article</p></div></body>",
                 "text that follows an empty article"))
    rows.append(("http://d.example/1", "<body><main></main><div><p>text after an empty main</p></div></body>", "text after an empty main"))
    rows.append(("http://d.example/2", "<body><main><p>ordinary text</p></main></body>", "ordinary text"))
    # Doubtful classes with the same text on all pages are template.
    for k in range(7):
        rows.append((f"http://e.example/{k}", f"<body><article><p>{'own text ' * (k + 1)}</p><div class=notice><p>We moved</p></div><div class=box>Kept</div></article></body>",
                     "own text " * (k + 1) + "Kept"))
    df = spark.createDataFrame([(k, *r[:2]) for k, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    for k, r in enumerate(rows):
        assert got[k] == r[2], r[:2]


def test_generated_pages_against_their_blocks(spark):
    """Pages put together from known article blocks and known furniture, on hosts with templates of their own."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randrange(a, b)))
    furniture = [lambda: f"<nav><ul><li><a href=/>{word()}</a></ul></nav>", lambda: f"<div class='sidebar'><p>{words(2, 9)}</p></div>",
                 lambda: f"<footer>&copy; {words(1, 5)}</footer>", lambda: f"<div id='cookie-notice'>{words(3, 9)}</div>",
                 lambda: f"<aside>{words(3, 9)}</aside>", lambda: f"<form><p>{words(1, 4)}<input name=q></form>",
                 lambda: f"<section id=comments><h3>{word()}</h3><article class=comment><p>{words(3, 9)}</p></article></section>",
                 lambda: f"<div class='ad-slot'>{words(2, 6)}</div>", lambda: f"<script>var a = '{word()}</p>';</script>",
                 lambda: f"<!-- {word()} --><style>p {{ }}</style>", lambda: f"<header><h1>{word()}</h1></header>"]

    def block():
        kind = rng.randrange(7)
        a, b, c = words(4, 20), words(1, 6), words(1, 6)
        slug = "-".join(b.split())
        return [(f"<p>{a}</p>", [a]), (f"<p>{a} <b>{b}</b>\n <a href=x>{c}</a>", [f"{a} {b} {c}"]), (f"<h2 id='{slug}-related'>{b}</h2>", [b]),
                (f"<ul><li>{a}<li>{b}</ul>", [a, b]), (f"<blockquote class='share-{slug}'><p>{a}</p></blockquote>", [a]),
                (f"<table><tr><td>{b}</td><td>{c} &amp; co</td></tr></table>", [b, f"{c} & co"]),
                (f"<div class='part'><p>{a}<br>{b}</p><div>{c}</div></div>", [f"{a} {b}", c])][kind]

    rows, want = [], []
    for host in range(12):
        around = [rng.sample(furniture, rng.randrange(1, 6)) for _ in range(2)]
        tag = ["article", "article class=post", "main", "div class=text"][host % 4]
        for k in range(rng.randrange(1, 12)):
            title, blocks = words(2, 6), [block() for _ in range(rng.randrange(3, 15))]
            title, *blocks = (f"<h1>{title}</h1>", [title]), *blocks
            inner = "".join(x for x, _ in blocks)
            if tag != "div class=text" and rng.random() < 0.4:
                inner += rng.choice(furniture[:8])() if tag != "main" else ""
            rows.append((len(rows), f"https://h{host}.example/{k}", "<!DOCTYPE html><html><body>" + "".join(f() for f in around[0])
                         + f"<{tag}>{inner}</{tag.split()[0]}>" + "".join(f() for f in around[1]) + "</body></html>"))
            want.append(" ".join(t for _, ts in blocks for t in ts))
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for r, w in zip(rows, want):
        assert got[r[0]] == w, r[1:]


def test_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        x, y = ([rng.choice("abcd"[:rng.randrange(1, 5)]) for _ in range(rng.randrange(9))] for _ in range(2))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
        pairs = html.common(x, y)
        assert len(pairs) == best[-1][-1] and all(x[i] == y[j] for i, j in pairs)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:]))
    assert len(html.common(list(range(9000)), list(range(1, 9000, 2)))) == 4500


def test_wrapper_alignment():
    page = lambda body: html.skeleton(html.parse(f"<body>{body}</body>"))
    w = html.merge(page("<h1>a</h1><p>1</p><p>2</p><hr><h2>x</h2>"), page("<h1>a</h1><p>3</p><ul><li>q</ul><h2>x</h2>"))
    kids = w[html.KIDS][0][html.KIDS]
    assert [(k[0], k[html.OPTIONAL], k[html.REPEATED]) for k in kids] == [("h1", 0, 0), ("p", 0, 1), ("ul", 1, 0), ("h2", 0, 0)]
    assert kids[0][html.TEXT] is not None and kids[1][html.TEXT] is None
    pairs = page("<h2>a</h2><p>b</p><h2>c</h2><p>d</p><h2>e</h2><p>f</p>")[html.KIDS][0][html.KIDS]
    assert [k[0] for k in pairs] == [html.GROUP] and [k[0] for k in pairs[0][html.KIDS]] == ["h2", "p"]


def test_costly_rules_move_back(spark):
    """Of rules that reject as much the cheap one comes first, of rules that cost as much the sharper one."""
    docs = spark.createDataFrame([(k, f"{k} " + "some words of a text " * 100) for k in range(400)], "doc_id long, text string")
    measured = common.save(quality.measures(docs), "test-quality")
    third, few = F.col("doc_id") % 3 == 0, F.col("doc_id") % 100 == 0
    slow = F.size(F.filter("words", lambda w: w.rlike("(a|b|c)*(x|y)+.*(z|o)$") | w.rlike(".*t.*e.*x.*"))) >= 0
    rules = [quality.Rule("slow", slow & third), quality.Rule("few", few), quality.Rule("quick", third), quality.Rule("never", slow & (F.col("doc_id") < 0))]
    assert [r.name for r in quality.plan_cascade(measured, rules)] == ["quick", "few", "slow", "never"]
    assert len(quality.plan_cascade(measured.limit(0), rules)) == 4


def brute_verdicts(pages, edges):
    def own(host, path):
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    def split(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):])[0]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = []
    for page, url in pages:
        host, path = split(url)
        rule, verdict = own(host, path)
        if verdict is None:
            key = url.split("://", 1)[1].split("#")[0] if host else None
            key = key + "/" if key == host else key
            seen, todo = {key}, [key]
            while todo:
                for x in near.get(todo.pop(), ()):
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            known = {own(*split("x://" + x))[1] for x in seen if x} if key in near else set()
            verdict = "allow" if "allow" in known else "block" if "block" in known else "allow"
        out.append((page, host, path, rule, verdict))
    return sorted(out, key=repr)


def test_url_verdicts(spark):
    link = '<html><head><link rel="canonical" href="{}"></head>'
    pages = [
        (1, "https://a.example.org/x", link.format("https://b.example.org/y")),
        (2, "https://b.example.org/y#top", '<meta http-equiv="refresh" content="0; url=http://c.net/fr/z">'),
        (3, "http://d.example.org/q?a=1", link.format("https://e.example.org/r")),
        (4, "http://e.example.org/r", link.format("https://www.example.com/en/ok")),
        (5, "https://f.example.org/", link.format("//c.net/fr/z") + "<!-- <link rel=canonical href=http://example.com/x> -->"),
        (6, "https://g.example.org/dir/p", link.format("../h")),
        (7, "https://g.example.org/h", "<link href='http://c.net/es/1' rel='nofollow CANONICAL'>"),
        (8, "https://Example.COM/en/p", "x"), (9, "https://www.example.com/en/p", "x"), (10, "https://sub.example.com/en/p", "x"),
        (11, "https://example.com", "x"), (12, "https://q.net/es/", ""), (13, "https://q.net/es", None), (14, None, None),
        (15, "no scheme", link.format("http://c.net/fr/")), (None, "http://lone.example.org", link.format("http://c.net/fr/z")),
        (16, "https://notexample.com/en/x", "x"), (1, "https://a.example.org/x", link.format("https://b.example.org/y")),
        (17, "http://k.example.org/1", "<script>'<link rel=canonical href=http://c.net/fr/z>'</script>"),
        (18, "http://l.example.org/1", link.format("http://m.example.org/2")),
    ]
    edges = [("a.example.org/x", "b.example.org/y"), ("b.example.org/y", "c.net/fr/z"), ("d.example.org/q?a=1", "e.example.org/r"),
             ("e.example.org/r", "www.example.com/en/ok"), ("f.example.org/", "c.net/fr/z"), ("g.example.org/dir/p", "g.example.org/h"),
             ("g.example.org/h", "c.net/es/1"), ("lone.example.org/", "c.net/fr/z"), ("l.example.org/1", "m.example.org/2")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, host string")
    assert rows_of(urls.judge(df)) == brute_verdicts([p[:2] for p in pages], edges)
    assert urls.judge(df.limit(0)).count() == 0


def brute_repair(roles):
    """Least cost over all role choices; the first in the order of preference."""
    import itertools
    best = None
    order = lambda own: list(dict.fromkeys([own, chat.USER, chat.ASSISTANT, chat.SYSTEM]))
    for taken in itertools.product(*([r for r in order(o) if r in (1, 2, 3)] for o in roles)):
        state, cost = chat.START, 0
        for own, role in zip(roles, taken):
            cost += chat.relabel(own, role) + chat.LINKS.get((state, role), (chat.NEVER,))[0]
            state = role
        cost += chat.ENDS[state][0]
        if best is None or cost < best[0]:
            best = (cost, list(taken))
    return best[1] if best else []


def test_role_repair_equals_all_choices():
    rng = random.Random(8)
    for _ in range(300):
        roles = [rng.randint(1, 4) for _ in range(rng.randint(0, 6))]
        assert chat.solve(roles, chat.END) == brute_repair(roles), roles


def test_chat_over_partitions(spark):
    """One conversation with most rows crosses partitions; pieces give the same answer as the whole."""
    rng = random.Random(3)
    names = ["user", "assistant", "system", "Human", None, "bot", "tool"]
    rows = [(7, k // 2 * 2, rng.choice(names), f"t{k:05d}") for k in range(1500)]
    rows += [(c, t, rng.choice(names), None if t == 2 else f"<|im_end|> {t}") for c in range(40) for t in range(rng.randint(1, 5))]
    rows += [(None, None, "user", "x"), (None, 3, "user", "x"), (None, 3, "user", "x"), (8, None, None, None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, position int")
        got = sorted((tuple(r) for r in chat.repair(df).collect()), key=lambda r: (repr(r[0]), r[2]))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    want = []
    low = lambda x: (x is not None, x or "")
    for conv in sorted(groups, key=repr):
        own = sorted(groups[conv], key=lambda r: (r[1] is None, r[1] or 0, low(r[2]), low(r[3])))
        codes = [chat.code(r[2]) for r in own]
        taken = chat.solve(codes, chat.END)
        for k, (r, role, (action, text)) in enumerate(zip(own, taken, chat.render([r[3] for r in own], codes, taken, chat.START, True))):
            want.append((r[0], r[1], k, r[2], chat.NAMES[role], action, text))
    assert got == want
    whole = "".join(r[6] for r in got if r[0] == 7)
    parts = re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", whole, re.S)
    assert "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in parts) == whole
    turns = [a for a, _ in parts if a != "system"]
    assert turns == ["user", "assistant"] * (len(turns) // 2)
    assert chat.repair(df.limit(0)).count() == 0


def test_url_oracle_follows_alias_edges(spark):
    """The registered SQL and the operator agree where pages hold canonical links and redirects."""
    import duckdb
    link = '<html><head><link rel="canonical" href="{}"></head>'
    rows = [(1, "https://a.example.org/x", link.format("https://b.example.org/y")),
            (2, "https://b.example.org/y#top", '<meta http-equiv="refresh" content="0; url=http://c.net/fr/z">'),
            (3, "http://d.example.org/q?a=1", link.format("https://e.example.org/r")),
            (4, "http://e.example.org/r", link.format("https://www.example.com/en/ok")),
            (5, "https://g.example.org/h", "<link href='http://c.net/es/1' rel='nofollow CANONICAL'>"),
            (6, "https://Example.COM/en/p", "x"), (7, "https://example.com", "x"), (8, None, None), (9, "plain", link.format("http://c.net/fr/")),
            (10, "http://k.example.org/1", "<script>'<link rel=canonical href=http://c.net/fr/z>'</script>")]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    got = rows_of(urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")))
    assert got == sorted(con.execute(urls.ORACLE).fetchall(), key=repr)
    assert [r[4] for r in sorted(got)][:5] == ["block", "block", "allow", "allow", "block"]
