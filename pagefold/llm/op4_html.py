"""Main text of web pages by inferred wrappers (operator 4).

A *wrapper* is a union-free regular expression over the block elements of one
host's pages, kept as a tree: every node is an element, optional (``?``) or
repeated (``+``), with a slot for its own text.

1. Each page becomes a wrapper of itself; runs of like siblings, also of like
   groups of up to four, become one repeated node.
2. Wrappers of a host are aligned two at a time.  Children that meet are merged
   again; one that finds no partner becomes optional; runs that arise become
   repeated; texts that differ turn a constant into a slot.  Pages of a host
   with the same text count once: their wrappers are grouped by (host, hash of
   the text).  A slice of a batch is folded, then (host, salt), then the host, so
   a host with a third of all pages never meets in one task and only wrappers,
   not pages, are shuffled.
3. The wrapper shows where the host keeps its main text: every path to an ``article``
   or ``main`` that holds text and is not template, and for a host without any the
   container that holds most of the text that is no link.  Template is a text that is
   the same on ``CONSTANT_PAGES`` or more pages of different text, and on a share of
   ``CONSTANT_SHARE`` of all the host's; below an ``article`` or ``main`` only what also
   has the class of a menu, notice and the like can be template.
4. Every page is read along its host's wrapper.  Of several places it takes the one
   with most text, a single ``article`` before a list of them; where the place holds
   less than ``LITTLE`` of the page's text, or is missing, the page is read along its
   own wrapper.  Below the place stands main text, less menus, headers, footers,
   sidebars, notices, adverts, forms, scripts, styles and reader comments.

An element is furniture by its tag, role or hidden state, or by a whole class (or id,
but not of headings and paragraphs) made of furniture words only: ``related-posts``,
not ``related-work``.  A class of one word that may also name a subject (``social``)
counts below ``article`` and ``main`` only with evidence: mostly links, form fields,
or the same text on the host's pages.

A wrapper grows with the variety of a host's markup, not with its pages; nothing is
cut from it, and alignment is exact at every size.

Cases: null or empty html gives an empty text; a null URL or one without a host
belongs to the host ``""``; null ids and repeated rows give a row each; extra
columns are ignored; broken markup is read as far as it goes; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import json
import re
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.llm.common import arrow_map, read, save
from pagefold.plans.catalog import register

#: Pages of different text on which a single text must be the same to count as part of the template,
#: and their share of the host's pages.
CONSTANT_PAGES = 5
CONSTANT_SHARE = 0.9
#: Share of a page's text below which a place is not taken for its main text.
LITTLE = 0.1
#: Nested elements deeper than this are read as white space between the texts they hold.
MAX_DEPTH = 150
#: Parts into which a host's wrappers are folded before the last fold.
SALTS = 64

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("html head body address article aside blockquote caption center dd details dialog dir div dl dt "
                  "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p "
                  "pre section summary table tbody td tfoot th thead tr ul noscript template select option optgroup "
                  "button object video audio canvas svg script style textarea title iframe".split())
CONTAINERS = frozenset("body article main section div center table tbody tr td".split())
DROPPED = frozenset("head script style noscript template iframe noembed noframes object embed svg canvas audio video "
                    "nav aside footer form fieldset button select option optgroup textarea input dialog menu title".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form".split())
#: Words that make a class or id one of furniture, alone or with the words below.
CLEAR = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo cookie cookies "
                  "consent gdpr newsletter sidebar navbar breadcrumb breadcrumbs pagination pager masthead footer nav "
                  "recommended comment comments commentlist disqus sharing".split())
#: Words that may also name a subject.
DOUBTFUL = frozenset("promotion banner notice notices notification popup modal overlay subscribe menu navigation share "
                     "social related respond reply replies login".split())
#: Words beside them that say nothing.
NEUTRAL = frozenset("a area bar block box button buttons container content form group icons inner item items left link "
                    "links list main outer page post posts right row section side signup site slot small story stories "
                    "strip text top bottom unit widget widgets wrap wrapper articles for us the this".split())
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
PARAGRAPHS = frozenset("p blockquote pre".split())
HEADERS = frozenset(["header", "site-header", "page-header", "global-header", "top-header", "siteheader", "pageheader"])
#: Open elements that an opening tag ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
#: An implied end never leaves one of these.
SCOPE = frozenset("ul ol dl table select body html article section div".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
QUOTED = re.compile(r"[^\"'>]*")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[a-z]+")


class Element:
    __slots__ = ("tag", "label", "drop", "doubt", "fields", "kids")

    def __init__(self, tag: str, label: str, drop: bool, doubt: bool = False):
        self.tag, self.label, self.drop, self.doubt = tag, label, drop, doubt
        self.fields = False
        self.kids: list = []  # Elements, and (text, is link) pairs


def _tag_end(text: str, at: int, shut: set) -> int:
    """Index of the ``>`` that ends a tag, quotes respected; -1 if there is none."""
    while True:
        at = QUOTED.match(text, at).end()
        if at >= len(text):
            return -1
        if text[at] == ">":
            return at
        close = -1 if text[at] in shut else text.find(text[at], at + 1)
        if close < 0:
            shut.add(text[at])  # no such quote follows: an ordinary character from here on
            at += 1
        else:
            at = close + 1


def parse(text: str) -> Element:
    """Block elements of a page as a tree; inline elements are flattened into text."""
    root = Element("#root", "#root", False)
    stack, at, links, low, shut = [root], 0, 0, text.lower(), set()
    same = len(low) == len(text)
    deep: dict[str, int] = {}  # open elements beyond the depth, by tag
    while at < len(text):
        lt = text.find("<", at)
        if lt != at:
            stack[-1].kids.append((text[at:lt if lt >= 0 else len(text)], links > 0))
            if lt < 0:
                break
        if text.startswith("<!--", lt):
            end = text.find("-->", lt + 4)
            at = len(text) if end < 0 else end + 3
            continue
        if text[lt + 1:lt + 2] in ("!", "?"):
            end = text.find(">", lt)
            at = len(text) if end < 0 else end + 1
            continue
        closing = text[lt + 1:lt + 2] == "/"
        name = NAME.match(text, lt + 1 + closing)
        if not name:
            stack[-1].kids.append(("<", links > 0))
            at = lt + 1
            continue
        end = _tag_end(text, name.end(), shut)
        if end < 0:
            break
        tag, at = name[0].lower(), end + 1
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
        if closing:
            if deep.get(tag):
                deep[tag] -= 1
                stack[-1].kids.append((" ", links > 0))
            elif tag in BLOCK:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
            continue
        if tag == "br":
            stack[-1].kids.append((" ", links > 0))
            continue
        if tag in RAW:
            close = low.find(f"</{tag}", at) if same else -1
            if close < 0 and not same:
                m = re.compile(f"</{tag}", re.I).search(text, at)
                close = m.start() if m else -1
            after = text.find(">", close) if close >= 0 else -1
            at = len(text) if after < 0 else after + 1
            if tag not in BLOCK:
                continue
            stack[-1].kids.append(Element(tag, tag, True))
            continue
        if tag == "input":
            stack[-1].fields = True
        if tag not in BLOCK or tag in VOID:
            continue
        if len(stack) > MAX_DEPTH:
            deep[tag] = deep.get(tag, 0) + 1
            stack[-1].kids.append((" ", links > 0))
            continue
        if tag != "p":
            _end(stack, ENDS.get(tag, set()))
        _end(stack, {"p"})
        element = _element(tag, text[name.end():end], stack)
        stack[-1].kids.append(element)
        stack.append(element)
    _judge(root)
    return root


def _judge(e: Element) -> tuple[int, int, bool]:
    """Characters outside links, in links, and whether there are form fields.  Doubtful
    elements become furniture where the page itself gives evidence."""
    plain, linked, fields = 0, 0, e.fields or e.tag in ("button", "select", "textarea")
    for k in e.kids:
        if isinstance(k, tuple):
            size = len(k[0]) - k[0].count(" ")
            plain, linked = plain + size * (not k[1]), linked + size * k[1]
        else:
            p, n, f = _judge(k)
            plain, linked, fields = plain + p, linked + n, fields or f
    e.drop = e.drop or e.doubt and (fields or linked >= plain)
    return plain, linked, fields


def _end(stack: list[Element], tags: set[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
        elif stack[k].tag in SCOPE:
            break


def _element(tag: str, rest: str, stack: list[Element]) -> Element:
    attributes = {}
    if "=" in rest or "hidden" in rest:
        for m in ATTRIBUTE.finditer(rest):
            attributes.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    classes, own = attributes.get("class", "").split(), attributes.get("id", "")
    inside = any(e.tag in ("article", "main") for e in stack)
    names = classes if inside or not own else [*classes, own]
    label = ".".join([tag, *sorted({re.sub(r"\d+", "", n) for n in names})])
    drop = tag in DROPPED or attributes.get("role", "").lower() in ROLES or "hidden" in attributes \
        or attributes.get("aria-hidden", "").lower() == "true" \
        or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I) is not None
    if tag == "header":
        drop = not inside
    if drop or tag in ("html", "body", "main") or tag in HEADINGS:
        return Element(tag, label, drop)
    grade = max(map(_grade, classes if tag in PARAGRAPHS or not own else [*classes, own]), default=0)
    if tag == "article":
        # Comments are articles of their own below the article.
        return Element(tag, label, grade == 2 and inside)
    return Element(tag, label, grade == 2 or grade == 1 and not inside, grade == 1 and inside)


def _grade(name: str) -> int:
    """2 if a class or id names furniture, 1 if it may, else 0."""
    name = name.lower()
    words = WORD.findall(name)
    hints = [w for w in words if w in CLEAR or w in DOUBTFUL]
    if name in HEADERS:
        return 2
    if not hints or not all(w in CLEAR or w in DOUBTFUL or w in NEUTRAL for w in words):
        return 0
    return 2 if len(words) > 1 or hints[0] in CLEAR or hints[0] in COMMENTS else 1


# ---- wrappers --------------------------------------------------------------
# A node is a list: [label, pages, optional, repeated, weight of the text, hash of the text or None, children].
LABEL, PAGES, OPTIONAL, REPEATED, CHARS, TEXT, KIDS = range(7)
#: Weight of a character outside links; one in a link counts 1.
PLAIN = 10
GROUP = "()"


def skeleton(element: Element) -> list:
    """The wrapper of one page."""
    own = "".join(k[0] for k in element.kids if isinstance(k, tuple))
    plain = " ".join(own.split())
    kids = [skeleton(k) for k in element.kids if not isinstance(k, tuple) and not k.drop]
    return [element.label, 1, 0, 0, _own_weight(element) if plain else 0, zlib.crc32(plain.encode("utf-8", "replace")), fold(kids)]


def _own_weight(element: Element) -> int:
    return sum((len(k[0]) - k[0].count(" ")) * (1 if k[1] else PLAIN) for k in element.kids if isinstance(k, tuple))


def weight(element: Element) -> int:
    """Weight of all text below an element that may be main text."""
    own = _own_weight(element) * (element.tag != "body")
    return own + sum(weight(k) for k in element.kids if not isinstance(k, tuple) and not k.drop)


def page_text(element: Element) -> str:
    """All text of a page's blocks that may hold main text, in page order."""
    parts: list[str] = []

    def walk(e):
        for k in e.kids:
            if isinstance(k, tuple):
                parts.append(k[0])
            elif not k.drop:
                parts.append(" ")
                walk(k)
                parts.append(" ")
    walk(element)
    return " ".join("".join(parts).split())


def shape(nodes: list) -> list:
    return [n[LABEL] if n[LABEL] != GROUP else (GROUP, *shape(n[KIDS])) for n in nodes]


def fold(kids: list) -> list:
    """Runs of like siblings, or of like groups of siblings, become one repeated node."""
    for size in range(1, 5):
        out: list = []
        at = 0
        labels = shape(kids)
        while at < len(kids):
            again = 1
            while labels[at:at + size] == labels[at + again * size:at + (again + 1) * size]:
                again += 1
            # A group of one label alone has been folded already.
            if again == 1 or at + size > len(kids):
                out.append(kids[at])
                at += 1
                continue
            group = kids[at:at + size]
            for k in range(1, again):
                group = [merge(a, b, 0) for a, b in zip(group, kids[at + k * size:at + (k + 1) * size])]
            if size == 1:
                group[0][REPEATED] = 1
                out += group
            else:
                out.append([GROUP, max(g[PAGES] for g in group), 0, 1, 0, 0, group])
            at += again * size
        kids = out
    return kids


def merge(a: list, b: list, pages: int = 1) -> list:
    """Two nodes of one label as one; ``pages`` 0 merges siblings of the same page."""
    n = a[PAGES] + b[PAGES] if pages else max(a[PAGES], b[PAGES])
    return [a[LABEL], n, a[OPTIONAL] | b[OPTIONAL], a[REPEATED] | b[REPEATED], a[CHARS] + b[CHARS],
            _same(a[TEXT], b[TEXT], pages), align(a[KIDS], b[KIDS], pages)]


def _same(a: int | None, b: int | None, pages: int) -> int | None:
    """Hash of the text of two merged nodes: None if it differs between pages;
    siblings of one page have one of all their texts."""
    if a == b or (pages or a is None or b is None):
        return a if a == b else None
    return zlib.crc32(f"{a} {b}".encode())


def align(a: list, b: list, pages: int = 1) -> list:
    """Children of two nodes in one order; those without a partner become optional."""
    x, y = shape(a), shape(b)
    if x == y:
        return [merge(p, q, pages) for p, q in zip(a, b)]
    out, i, j = [], 0, 0
    for p, q in [*common(x, y), (len(a), len(b))]:
        for n in (*a[i:p], *b[j:q]):
            out.append([*n[:OPTIONAL], 1, *n[REPEATED:]])
        if p < len(a):
            out.append(merge(a[p], b[q], pages))
        i, j = p + 1, q + 1
    return fold(out)


def common(x: list, y: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, by bit-parallel rows (Hyyro, 2004): a row
    is one integer with a bit per item of ``x``, so long lists cost a few operations an item."""
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    ends = [(len(x) - k, len(y) - k) for k in range(tail, 0, -1)]
    places: dict = {}
    for i, label in enumerate(x[head:len(x) - tail]):
        places[label] = places.get(label, 0) | 1 << i
    # An item that the other list lacks has no partner.
    also = [j for j in range(head, len(y) - tail) if y[j] in places]
    full = (1 << len(x) - tail - head) - 1
    row, rows = full, []
    for j in also:
        hit = row & places[y[j]]
        row = (row + hit | row - hit) & full
        rows.append(row)
    middle, i, k = [], len(x) - tail - head, len(also)
    while i and k:
        if rows[k - 1] >> i - 1 & 1:
            i -= 1
        else:
            k -= 1
            if not k or rows[k - 1] >> i - 1 & 1:
                i -= 1
                middle.append((head + i, also[k]))
    return [*((k, k) for k in range(head)), *reversed(middle), *ends]


def _tag(n: list) -> str:
    return n[LABEL].partition(".")[0]


def _chars(n: list) -> int:
    """Own text of a node that may be main text."""
    return n[CHARS] * (_tag(n) != "body")


def place(wrapper: list) -> dict:
    """Where the main text stands: paths of labels from the root to each ``article`` and
    ``main``, where there is none the container ``at``, and template ``constants``."""
    least = max(CONSTANT_PAGES, CONSTANT_SHARE * wrapper[PAGES])
    out: dict = {"article": [], "main": [], "at": None, "constants": []}

    def text(n):
        return _chars(n) + sum(map(text, n[KIDS]))

    def children(n):
        for k in n[KIDS]:
            yield from (children(k) if k[LABEL] == GROUP else (k,))

    def template(n):
        return n[PAGES] >= least and n[TEXT] is not None and all(map(template, children(n)))

    def named(n, path, tag):
        for k in children(n):
            here = (*path, k[LABEL])
            if _tag(k) != tag:
                yield from named(k, here, tag)
            elif text(k) and not template(k) and not any(w in COMMENTS for w in WORD.findall(k[LABEL])):
                yield here, k

    def constants(n, path, doubtful):
        """Texts of the template below a node; if ``doubtful``, only below elements of such a class."""
        for k in children(n):
            here = (*path, k[LABEL])
            below = doubtful and not any(_grade(c) for c in k[LABEL].split(".")[1:])
            if not below and k[PAGES] >= least and k[TEXT] is not None and k[CHARS] and not k[KIDS] and not k[REPEATED] \
                    and k[LABEL][:2] != "h1":
                out["constants"].append([here, k[TEXT]])
            constants(k, here, below)

    def varies(n):
        return any(k[TEXT] is None or varies(k) for k in children(n))

    for tag in ("article", "main"):
        found: dict = {}
        for path, n in named(wrapper, (), tag):
            if path not in found:
                constants(n, path, True)
            found[path] = found.get(path, 0) + text(n)
        out[tag] = sorted(found, key=lambda p: (-found[p], p))
    at, node = (), wrapper
    while True:
        whole = text(node)
        best = max(children(node), key=lambda k: (text(k), k[LABEL]), default=None)
        if best is None or not whole or 10 * text(best) < 7 * whole or _tag(best) not in CONTAINERS | {"html"}:
            break
        at, node = (*at, best[LABEL]), best
    out["at"] = at
    if not out["article"] and not out["main"] and varies(node):
        constants(node, at, False)
    return out


# ---- reading a page --------------------------------------------------------

def choose(root: Element, spot: dict, own: bool) -> tuple[tuple, list[Element]] | None:
    """The place that this page uses, and its elements there; None if it holds little.
    A page's ``own`` wrapper always leads to its largest container at last."""
    whole = weight(root)
    for tag in ("article", "main"):
        options = []
        for path in map(tuple, spot[tag]):
            found = _below(root, path)
            size = sum(map(weight, found))
            if size:
                options.append((size, len(found) == 1, path, found))
        most = max((o[0] for o in options), default=0)
        if most >= LITTLE * whole and most:
            # The article rather than a list of teasers of about its size.
            single = [o for o in options if o[1] and 3 * o[0] >= most]
            _, _, path, found = max(single or options, key=lambda o: o[0])
            return path, found
    if own or not spot["article"] and not spot["main"]:
        path = tuple(spot["at"])
        found = _below(root, path)
        if own or found and path and sum(map(weight, found)) >= LITTLE * whole:
            return path, found
    return None


def main_text(text: str | None, where: str | None) -> str:
    """Blocks of the page's main text, joined by one space."""
    if not text:
        return ""
    root = parse(text)
    spot = json.loads(where) if isinstance(where, str) else None
    chosen = choose(root, spot, False) if spot else None
    if not chosen:
        spot = place(skeleton(root))
        chosen = choose(root, spot, True)
    start, found = chosen
    template = {(tuple(p), t) for p, t in spot["constants"]}
    blocks: list[str] = []

    def emit(parts):
        block = " ".join(htmllib.unescape("".join(parts)).split())
        if block:
            blocks.append(block)

    def walk(e, path):
        parts: list[str] = []
        for k in e.kids:
            if isinstance(k, tuple):
                parts.append(k[0])
                continue
            emit(parts)
            parts = []
            if not k.drop:
                here = (*path, k.label)
                if not (template and (here, _own(k)) in template):
                    walk(k, here)
        emit(parts)
    for e in found:
        walk(e, start)
    return " ".join(blocks)


def _own(e: Element) -> int:
    own = "".join(k[0] for k in e.kids if isinstance(k, tuple))
    return zlib.crc32(" ".join(own.split()).encode("utf-8", "replace"))


def _below(root: Element, path: tuple) -> list[Element]:
    """Elements at a path of labels, in page order."""
    level = [root]
    for label in path:
        level = [k for e in level for k in e.kids if not isinstance(k, tuple) and k.label == label and not k.drop]
    return level


# ---- Spark -----------------------------------------------------------------

PAGES_SEEN = pa.schema([("host", pa.string()), ("text", pa.binary()), ("wrapper", pa.string())])
WRAPPERS = pa.schema([("host", pa.string()), ("salt", pa.int32()), ("wrapper", pa.string())])


def host_of(url):
    """Lower-cased host of a URL column, '' without one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[^:/?#]*://([^/?#]*)", 1)), F.lit(""))


def _folded(batches: Iterable[pa.RecordBatch], salted: bool) -> Iterator[pa.RecordBatch]:
    """Merge runs of one key in rows sorted by host (and salt); one wrapper is held at a time."""
    key, held = None, None

    def row():
        return pa.RecordBatch.from_pylist([{"host": key[0], "salt": key[1], "wrapper": json.dumps(held)}], WRAPPERS)
    for batch in batches:
        for r in batch.to_pylist():
            now = (r["host"], r["salt"] if salted else 0)
            wrapper = json.loads(r["wrapper"])
            if now == key:
                held = merge(held, wrapper)
            else:
                if held is not None:
                    yield row()
                key, held = now, wrapper
    if held is not None:
        yield row()


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, place``: where each host keeps its main text, as JSON."""
    def first(batch):
        out: dict[str, list] = {"host": [], "text": [], "wrapper": []}
        for host, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            if text:
                root = parse(text)
                out["host"].append(host)
                out["text"].append(hashlib.md5(page_text(root).encode("utf-8", "replace")).digest())
                out["wrapper"].append(json.dumps(skeleton(root)))
        return out

    def slices(batch):
        own: dict[str, list] = {}
        for host, text in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist()):
            page = json.loads(text)
            own[host] = merge(own[host], page) if host in own else page
        texts = [json.dumps(w) for w in own.values()]
        return {"host": list(own), "salt": [zlib.crc32(t.encode()) % SALTS for t in texts], "wrapper": texts}

    kind = "host string, salt int, wrapper string"
    parts = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(
        arrow_map(first, PAGES_SEEN), "host string, text binary, wrapper string")
    # The aggregate is partial first: copies of one page never meet in one task.
    parts = (parts.groupBy("host", "text").agg(F.min("wrapper").alias("wrapper")).select("host", "wrapper")
             .mapInArrow(arrow_map(slices, WRAPPERS), kind))
    for keys in (["host", "salt"], ["host"]):
        salted = len(keys) == 2
        parts = (parts.repartition(*keys).sortWithinPartitions("host", "salt", "wrapper")
                 .mapInArrow(lambda b, salted=salted: _folded(b, salted), kind))

    @F.pandas_udf("string")
    def spot(texts: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(place(json.loads(t))) for t in texts], dtype=object)
    return parts.select("host", spot("wrapper").alias("place"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages(page_id, url, html)``."""
    # Written, so that Spark knows the table's size: it broadcasts a small one
    # and otherwise joins by host, splitting hot hosts.
    places = save(wrappers(pages), "html-places")

    @F.pandas_udf("string")
    def run(texts: pd.Series, spots: pd.Series) -> pd.Series:
        return pd.Series([main_text(t, s) for t, s in zip(texts, spots)], dtype=object)
    joined = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(places, "host", "left")
    out = joined.select("page_id", "url", run("html", "place").alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


@register("op4_html_main_text")
def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(read(spark, sf_dir, "pages", "page_id", "url", "html"))
