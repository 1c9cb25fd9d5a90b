"""HTML -> node table, and relational element queries over it.

``dom_shred`` is the only Python step of the page pipeline: one
``mapInArrow`` pass per partition builds a light tree with the standard
library's ``html.parser`` and emits one row per element (pre-order id,
parent, depth, tag, id, classes, attributes, ancestors, sibling/type
positions) plus text and source offsets.  ``textContent`` and ``outerHTML``
are slices of the page text / page source, so node rows stay small.
Everything after the shred is joins, windows and aggregations keyed by
``page_id`` -- a page is the largest group any operator ever builds.
"""

from __future__ import annotations

import re

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefold.session import materialize as write_once

# HTML void elements and implied-end rules used by the tree
# builder (a subset of the HTML5 tree-construction rules).
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}
P_CLOSERS = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset",
             "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
             "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SCOPE = {"applet", "caption", "html", "table", "td", "th", "marquee", "object", "template", "button"}
SELF_CLOSERS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"},
                "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIST_SCOPE = SCOPE | {"ol", "ul"}

NODE_SCHEMA = (
    "page_id long, node_id int, parent_id int, depth int, tag string, id string, class string, "
    "classes array<string>, attr_names array<string>, attr_values array<string>, ancestors array<int>, "
    "child_count int, child_idx int, type_idx int, text_start int, text_end int, src_start int, src_end int"
)


class _Builder(HTMLParser):
    """Event-driven tree builder producing flat node records."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.html = html
        self.line_starts = [0, *(m.end() for m in re.finditer("\n", html))]
        self.nodes: list[dict] = []
        self.stack: list[int] = []
        self.text_parts: list[str] = []
        self.text_len = 0
        self.child_tags: dict[int, dict[str, int]] = {}
        self.child_count: dict[int, int] = {}

    def _offset(self) -> int:
        line, col = self.getpos()
        return self.line_starts[line - 1] + col

    def _close_top(self, end: int):
        nid = self.stack.pop()
        n = self.nodes[nid]
        n["text_end"] = self.text_len
        n["src_end"] = end

    def _in_scope(self, tags, scope) -> int:
        for i in range(len(self.stack) - 1, -1, -1):
            t = self.nodes[self.stack[i]]["tag"]
            if t in tags:
                return i
            if t in scope:
                return -1
        return -1

    def _close_to(self, idx: int, end: int):
        while len(self.stack) > idx:
            self._close_top(end)

    def handle_starttag(self, tag, attrs):
        start = self._offset()
        end_of_tag = start + len(self.get_starttag_text() or "")
        if tag in P_CLOSERS:
            i = self._in_scope({"p"}, SCOPE)
            if i >= 0:
                self._close_to(i, start)
        if tag in SELF_CLOSERS:
            i = self._in_scope(SELF_CLOSERS[tag], LIST_SCOPE if tag == "li" else SCOPE)
            if i >= 0:
                self._close_to(i, start)
        parent = self.stack[-1] if self.stack else -1
        nid = len(self.nodes)
        names = [k for k, _ in attrs]
        values = ["" if v is None else v for _, v in attrs]
        amap = dict(zip(names, values))
        cls = amap.get("class")
        if parent >= 0:
            self.child_count[parent] = self.child_count.get(parent, 0) + 1
            counts = self.child_tags.setdefault(parent, {})
        else:
            counts = self.child_tags.setdefault(-1, {})
        counts[tag] = counts.get(tag, 0) + 1
        child_idx = (self.child_count.get(parent, 0) - 1) if parent >= 0 else 0
        self.nodes.append({
            "node_id": nid, "parent_id": parent, "depth": len(self.stack), "tag": tag,
            "id": amap.get("id"), "class": cls, "classes": cls.split() if cls else [],
            "attr_names": names, "attr_values": values, "ancestors": list(self.stack),
            "child_idx": child_idx, "type_idx": counts[tag],
            "text_start": self.text_len, "text_end": self.text_len, "src_start": start, "src_end": end_of_tag,
        })
        if tag not in VOID:
            self.stack.append(nid)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.stack[-1] == len(self.nodes) - 1:
            self._close_top(self._offset() + len(self.get_starttag_text() or ""))

    def handle_endtag(self, tag):
        start = self._offset()
        gt = self.html.find(">", start)
        end = gt + 1 if gt >= 0 else len(self.html)
        for i in range(len(self.stack) - 1, -1, -1):
            if self.nodes[self.stack[i]]["tag"] == tag:
                self._close_to(i, end)
                return
        # stray end tag: ignored

    def handle_data(self, data):
        self.text_parts.append(data)
        self.text_len += len(data)

    def finish(self):
        self.close()
        end = len(self.html)
        while self.stack:
            self._close_top(end)
        for n in self.nodes:
            n["child_count"] = self.child_count.get(n["node_id"], 0)
        return self.nodes, "".join(self.text_parts)


def shred_html(html: str) -> tuple[list[dict], str]:
    """Parse one page; never raises (a broken page yields what was parsed)."""
    b = _Builder(html or "")
    try:
        b.feed(html or "")
        return b.finish()
    except Exception:  # noqa: BLE001 -- bad markup must not fail the job
        end = len(b.html)
        while b.stack:
            b._close_top(end)
        for n in b.nodes:
            n["child_count"] = b.child_count.get(n["node_id"], 0)
        return b.nodes, "".join(b.text_parts)


#: Pages parsed at once, and the columns of their elements: bounds what a worker holds beside the Arrow batch.
HTML_SLICE_ROWS = 32
_LISTS = {"classes": pa.string(), "attr_names": pa.string(), "attr_values": pa.string(), "ancestors": pa.int32()}
_NODE_ARROW = pa.schema([
    (name, pa.list_(_LISTS[name]) if name in _LISTS else {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind])
    for name, kind in (c.split() for c in NODE_SCHEMA.split(", "))])
_TEXT_ROW = {"node_id": -1, "parent_id": -2, "depth": 0, "tag": "", "id": None, "class": None, "classes": [], "attr_names": [],
             "attr_values": [], "ancestors": [], "child_count": 0, "child_idx": 0, "type_idx": 0, "text_start": 0, "text_end": 0,
             "src_start": 0, "src_end": 0}


def _spread(pages: DataFrame) -> DataFrame:
    """Pages spread by key over the session's shuffle partitions, so that the
    Python pass has as many tasks as other stages whatever the files look like."""
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pages.select("page_id", "html").repartition(parts, "page_id")


COMBINED_SCHEMA = NODE_SCHEMA + ", page_text string"


def _shredded(with_text: bool):
    """A ``mapInArrow`` function: pages -> elements, column by column in slices of
    ``HTML_SLICE_ROWS`` pages; ``with_text`` adds a row per page with its text."""
    schema = _NODE_ARROW.append(pa.field("page_text", pa.string())) if with_text else _NODE_ARROW

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, HTML_SLICE_ROWS):
                part = batch.slice(at, HTML_SLICE_ROWS)
                owners, rows, texts = [], [], []
                for pid, html in zip(part.column("page_id").to_pylist(), part.column("html").to_pylist()):
                    nodes, text = shred_html(html)
                    rows += nodes
                    texts += [None] * len(nodes)
                    if with_text:
                        rows.append(_TEXT_ROW)
                        texts.append(text)
                    owners += [pid] * (len(rows) - len(owners))
                columns = {"page_id": owners, "page_text": texts}
                yield pa.RecordBatch.from_arrays([
                    pa.array(columns[f.name] if f.name in columns else [n[f.name] for n in rows], f.type) for f in schema], schema=schema)
    return run


def shred_pages(pages: DataFrame, materialize: bool = True) -> tuple[DataFrame, DataFrame]:
    """One Python pass -> (dom_nodes, page texts).

    With ``materialize`` the pass is written once as parquet in the
    session's shared checkpoint folder (survives executor loss, cuts the
    lineage), so plans that read the node table several times -- self joins,
    selector steps -- never re-run the parser.
    """
    out = _spread(pages).mapInArrow(_shredded(True), COMBINED_SCHEMA)
    if materialize:
        out = write_once(out, "dom")
    nodes = out.filter(F.col("node_id") >= 0).drop("page_text").withColumn(
        "attrs", F.map_from_arrays("attr_names", "attr_values")).drop("attr_names", "attr_values")
    texts = out.filter(F.col("node_id") == -1).select("page_id", F.col("page_text").alias("text"))
    return nodes, texts


def dom_shred(pages: DataFrame) -> DataFrame:
    """``dom_shred``: pages(page_id, html) -> dom_nodes (one row per element)."""
    nodes = _spread(pages).mapInArrow(_shredded(False), NODE_SCHEMA)
    return nodes.withColumn("attrs", F.map_from_arrays("attr_names", "attr_values")).drop(
        "attr_names", "attr_values")


def with_text(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Attach ``text_content`` (textContent) to nodes by a page-key join."""
    j = nodes.join(texts, "page_id")
    return j.withColumn("text_content", F.expr("substring(text, text_start + 1, text_end - text_start)")).drop("text")


# ------------------------------------------------------------------ selectors
#
# Selectors are data: rows of (sel_id, alt, step, combinator, tag, id,
# classes, attr, op, value, nth).  ``alt`` separates comma alternatives;
# ``step`` 0 is the left-most compound; ``combinator`` (' ' or '>') links a
# step to the previous one.


class UnsupportedSelector(ValueError):
    """A selector outside the subset; it matches nothing rather than too much."""


_NAME = r"-?[A-Za-z_\u0080-\uffff][\w\u0080-\uffff-]*"
_PARTS = [(kind, re.compile(pattern)) for kind, pattern in (
    ("tag", rf"{_NAME}|\*"), ("id", rf"#({_NAME})"), ("class", rf"\.({_NAME})"),
    ("attr", r"""\[\s*([\w:-]+)\s*(?:([*^$]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\s\]"']+))\s*(i|I)?\s*)?\]"""),
    ("nth", r":nth-of-type\(\s*(\d+)\s*\)"))]


def parse_selector(sel: str) -> list[dict]:
    """Small CSS subset -> step rows: tag, #id, .class, [attr], [attr=v],
    [attr*=v], [attr^=v], [attr$=v], [attr=v i], :nth-of-type(n),
    descendant and child combinators, comma lists.  Quotes and brackets are
    respected; anything else raises ``UnsupportedSelector``."""
    out: list[dict] = []
    at, alt, step, comb = 0, 0, 0, None
    sel = sel.strip()
    while True:
        blank = len(sel[at:]) - len(sel[at:].lstrip())
        at += blank
        ch = sel[at:at + 1]
        if ch in (",", ""):
            if not step or comb == ">":
                raise UnsupportedSelector(f"empty part in {sel!r}")
            if not ch:
                return out
            at, alt, step, comb = at + 1, alt + 1, 0, None
            continue
        if ch == ">":
            if not step or comb == ">":
                raise UnsupportedSelector(f"misplaced '>' in {sel!r}")
            at, comb = at + 1, ">"
            continue
        if step and comb is None:
            if not blank:
                raise UnsupportedSelector(f"{sel[at:]!r} in {sel!r}")
            comb = " "
        row = {"alt": alt, "step": step, "combinator": comb if step else None, "tag": None, "id": None,
               "classes": [], "conds": [], "nth": None}
        start = at
        while True:
            kind, m = next(((k, m) for k, p in _PARTS if (k != "tag" or at == start) and (m := p.match(sel, at))), (None, None))
            if m is None:
                break
            if kind == "tag":
                row["tag"] = None if m[0] == "*" else m[0].lower()
            elif kind == "class":
                row["classes"].append(m[1])
            elif kind == "attr":
                value = next((v for v in m.group(3, 4, 5) if v is not None), None)
                row["conds"].append({"attr": m[1].lower(), "op": m[2] or "exists", "value": value, "ci": m[6] is not None})
            elif row[kind] is not None:
                raise UnsupportedSelector(f"two of {kind} in {sel!r}")
            else:
                row[kind] = int(m[1]) if kind == "nth" else m[1]
            at = m.end()
        if at == start:
            raise UnsupportedSelector(f"{sel[at:]!r} in {sel!r}")
        out.append(row)
        step, comb = step + 1, None


SELECTOR_SCHEMA = ("sel_id string, alt int, step int, combinator string, tag string, id string, "
                   "classes array<string>, conds array<struct<attr:string,op:string,value:string,ci:boolean>>, "
                   "nth int")


def _step_rows(sid: str, sel: str) -> tuple[list[dict], str | None]:
    try:
        return [{"sel_id": sid, **r} for r in parse_selector(sel)], None
    except UnsupportedSelector as e:
        return [], str(e)


def selector_table(spark, selectors: dict[str, str]) -> DataFrame:
    """Parse a fixed set of named selectors into a step table; an unsupported
    one raises, as it is a mistake in the program."""
    rows = [{"sel_id": sid, **r} for sid, sel in selectors.items() for r in parse_selector(sel)]
    df = spark.createDataFrame(rows, SELECTOR_SCHEMA)
    df._pf_max_step = max((r["step"] for r in rows), default=0)  # known on the driver: no job needed
    return df


def selector_steps(selectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parse selectors that are data (column ``selector``) where they live.

    Returns the step table, with the selector itself as ``sel_id``, and
    ``(selector, error)`` for those outside the subset, which match nothing."""
    schema = pa.schema([
        ("sel_id", pa.string()), ("alt", pa.int32()), ("step", pa.int32()), ("combinator", pa.string()), ("tag", pa.string()),
        ("id", pa.string()), ("classes", pa.list_(pa.string())),
        ("conds", pa.list_(pa.struct([("attr", pa.string()), ("op", pa.string()), ("value", pa.string()), ("ci", pa.bool_())]))),
        ("nth", pa.int32()), ("error", pa.string())])

    def parse(batches):
        for batch in batches:
            rows = []
            for sel in batch.column("selector").to_pylist():
                steps, error = _step_rows(sel, sel)
                rows += steps or [{"sel_id": sel, "error": error}]
            yield pa.RecordBatch.from_pylist(rows, schema)
    # Written once: read for every selector step, and its size is then known to the planner.
    out = write_once(selectors.select("selector").distinct().mapInArrow(parse, SELECTOR_SCHEMA + ", error string"), "selectors")
    return (out.filter(F.col("error").isNull()).drop("error"),
            out.filter(F.col("error").isNotNull()).select(F.col("sel_id").alias("selector"), "error"))


def _cond_ok(attrs: Column, cnd) -> Column:
    attr_val = F.try_element_at(attrs, cnd["attr"])
    v = cnd["value"]
    cmp_val = F.when(cnd["ci"], F.lower(v)).otherwise(v)
    cur = F.when(cnd["ci"], F.lower(attr_val)).otherwise(attr_val)
    return F.coalesce(
        F.when(cnd["op"] == "exists", attr_val.isNotNull())
        .when(cnd["op"] == "=", cur == cmp_val)
        .when(cnd["op"] == "*=", cur.contains(cmp_val))
        .when(cnd["op"] == "^=", cur.startswith(cmp_val))
        .when(cnd["op"] == "$=", cur.endswith(cmp_val))
        .otherwise(F.lit(False)), F.lit(False))


def _conds_ok(attrs: Column, conds: Column) -> Column:
    """All attribute conditions hold.  The attribute map is repeated into a
    second array and zipped, so the lambda uses only its own arguments (an
    outer column inside a lambda cannot be bound in a join condition)."""
    oks = F.zip_with(conds, F.array_repeat(attrs, F.size(conds)), lambda c, a: _cond_ok(a, c))
    return ~F.array_contains(oks, F.lit(False))


def _step_match(n, s) -> Column:
    """Does node ``n`` satisfy compound step ``s`` (column getters by name)."""
    return (
        (s("tag").isNull() | (n("tag") == s("tag")))
        & (s("id").isNull() | F.coalesce(n("id") == s("id"), F.lit(False)))
        & (F.size(F.array_except(s("classes"), n("classes"))) == 0)
        & _conds_ok(n("attrs"), s("conds"))
        & (s("nth").isNull() | (n("type_idx") == s("nth")))
    )


def _step_key(prefix: str = "") -> Column:
    """Join key of a selector step: its tag, else first class, else id, else '*'."""
    c = lambda x: F.col(prefix + x)
    return F.coalesce(c("tag"), F.concat(F.lit("."), F.try_element_at(c("classes"), F.lit(1))),
                      F.concat(F.lit("#"), c("id")), F.lit("*"))


def _node_keys() -> Column:
    """All keys under which a node can be found: tag, '*', '#id', '.class'."""
    return F.concat(F.array(F.col("tag"), F.lit("*")),
                    F.when(F.col("id").isNotNull(), F.array(F.concat(F.lit("#"), F.col("id"))))
                    .otherwise(F.array().cast("array<string>")),
                    F.transform("classes", lambda x: F.concat(F.lit("."), x)))


STEP_COLS = ["combinator", "tag", "id", "classes", "conds", "nth"]


def selector_match(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """``selector_match``: (page_id, sel_id, node_id) for every element that
    matches a selector.

    Right to left: nodes matching the last compound of each alternative are
    found by an equi-join on a step key (tag / class / id); each earlier
    compound is then checked on the parent (``>``) or on every ancestor
    (descendant), again by equi-joins on (page_id, node_id).  Whether the step
    table is broadcast is left to Spark, which knows its size.  All partial
    paths are kept (distinct), so a descendant chain is matched exactly.
    """
    c = F.col
    n = nodes.select("page_id", "node_id", "tag", "id", "classes", "attrs", "type_idx", "ancestors")
    last = steps.groupBy("sel_id", "alt").agg(F.max("step").alias("last_step"))
    lst = steps.join(last, ["sel_id", "alt"]).filter(c("step") == c("last_step")).withColumn("k", _step_key())
    nk = n.select("*", F.explode(_node_keys()).alias("k"))
    cand = nk.join(lst, "k").filter(_step_match(lambda x: nk[x], lambda x: lst[x]))
    state = cand.select("page_id", "sel_id", "alt", c("node_id").alias("match_id"),
                        c("node_id").alias("anchor_id"), "step").distinct()
    max_steps = getattr(steps, "_pf_max_step", None)
    if max_steps is None:
        max_steps = steps.agg(F.max("step")).first()[0] or 0  # scalar over the tiny step table
    done = state.filter(c("step") == 0)
    todo = state.filter(c("step") > 0)
    comb = steps.select(c("sel_id"), c("alt"), c("step"), c("combinator").alias("comb"))
    prev = steps.select(c("sel_id").alias("p_sel"), c("alt").alias("p_alt"), c("step").alias("p_step"),
                        *[c(x).alias("p_" + x) for x in STEP_COLS])
    anc_tbl = n.select("page_id", c("node_id").alias("anchor_id"), c("ancestors").alias("anc"))
    node_c = n.select("page_id", c("node_id").alias("cand_id"), c("tag").alias("c_tag"), c("id").alias("c_id"),
                      c("classes").alias("c_classes"), c("attrs").alias("c_attrs"),
                      c("type_idx").alias("c_type_idx"))
    for _ in range(max_steps):
        t = todo.join(comb, ["sel_id", "alt", "step"]).join(anc_tbl, ["page_id", "anchor_id"])
        t = t.select("page_id", "sel_id", "alt", "match_id", "step", F.explode(
            F.when(c("comb") == ">", F.slice(c("anc"), -1, 1)).otherwise(c("anc"))).alias("cand_id"))
        t = t.join(prev, (t["sel_id"] == prev["p_sel"]) & (t["alt"] == prev["p_alt"])
                   & (prev["p_step"] == t["step"] - 1))
        t = t.join(node_c, ["page_id", "cand_id"])
        getters = {"tag": "c_tag", "id": "c_id", "classes": "c_classes", "attrs": "c_attrs", "type_idx": "c_type_idx"}
        t = t.filter(_step_match(lambda x: t[getters[x]], lambda x: t["p_" + x]))
        nxt = t.select("page_id", "sel_id", "alt", "match_id", c("cand_id").alias("anchor_id"),
                       c("p_step").alias("step")).distinct()
        done = done.unionByName(nxt.filter(c("step") == 0))
        todo = nxt.filter(c("step") > 0)
    return done.select("page_id", "sel_id", c("match_id").alias("node_id")).distinct()


# --------------------------------------------------------- element structure


def container_signature(nodes: DataFrame) -> Column:
    """``container_signature``: ``tag.class#id[childCount]``."""
    return F.format_string("%s.%s#%s[%d]", F.col("tag"), F.coalesce("class", F.lit("")),
                           F.coalesce("id", F.lit("")), F.col("child_count"))


def element_path(nodes: DataFrame) -> DataFrame:
    """``element_path``: CSS path root-first, stopping at the nearest id,
    at most two classes per step.  One explode of the ancestor list and a
    page-keyed self-join; the path is rebuilt with an ordered collect."""
    c = F.col
    step_txt = F.when(c("s_id").isNotNull() & (c("s_id") != ""), F.concat(F.lit("#"), c("s_id"))) \
        .otherwise(F.concat(c("s_tag"), F.when(F.size("s_classes") > 0, F.concat(
            F.lit("."), F.array_join(F.slice("s_classes", 1, 2), "."))).otherwise(F.lit(""))))
    chain = nodes.select("page_id", "node_id",
                         F.posexplode(F.concat("ancestors", F.array("node_id"))).alias("lvl", "step_id"))
    s = nodes.select("page_id", F.col("node_id").alias("step_id"), F.col("tag").alias("s_tag"),
                     F.col("id").alias("s_id"), F.col("classes").alias("s_classes"))
    j = chain.join(s, ["page_id", "step_id"]).select("page_id", "node_id", "lvl",
                                                      (c("s_id").isNotNull() & (c("s_id") != "")).alias("has_id"),
                                                      step_txt.alias("txt"))
    # keep steps from the deepest id-bearing ancestor (inclusive) down to the node
    w = Window.partitionBy("page_id", "node_id")
    j = j.withColumn("from_lvl", F.coalesce(F.max(F.when(c("has_id"), c("lvl"))).over(w), F.lit(0)))
    j = j.filter(c("lvl") >= c("from_lvl"))
    g = j.groupBy("page_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("lvl", "txt"))).alias("p"))
    return g.select("page_id", "node_id", F.array_join(F.transform("p", lambda x: x["txt"]), " > ").alias("path"))


# List-container class words.
LIST_CLASS_WORDS = ["list", "items", "entries", "posts", "articles", "news", "events", "grid", "container",
                    "teaserblock", "teaser", "topics", "nachrichten", "meldungen", "beitraege"]


def is_list_container(nodes: DataFrame, class_words=None) -> DataFrame:
    """``is_list_container`` per element: ul/ol/dl; or a list class word; or
    >= 3 children with >= 70 % sharing the first child's tag when that tag
    is not article/li/div; or a first child 'article' with >= 3 articles.
    Children are aggregated per parent (one grouped pass)."""
    words = class_words or LIST_CLASS_WORDS
    kids = nodes.filter(F.col("parent_id") >= 0).groupBy("page_id", F.col("parent_id").alias("node_id")).agg(
        F.count("*").alias("n_kids"),
        F.min_by("tag", "node_id").alias("first_tag"),
        F.collect_list("tag").alias("kid_tags"))
    j = nodes.join(kids, ["page_id", "node_id"], "left")
    cls = F.lower(F.coalesce("class", F.lit("")))
    kw = F.lit(False)
    for w in words:
        kw = kw | cls.contains(w)
    same = F.size(F.filter("kid_tags", lambda t: t == F.col("first_tag")))
    n = F.coalesce("n_kids", F.lit(0))
    rule = (F.col("tag").isin("ul", "ol", "dl") | kw
            | ((n >= 3) & (same >= n * 0.7) & ~F.col("first_tag").isin("article", "li", "div"))
            | ((n >= 3) & (F.col("first_tag") == "article") & (same >= 3)))
    return j.select("page_id", "node_id", "tag", "class", n.alias("n_children"),
                    F.coalesce(rule, F.lit(False)).alias("is_list"))


def container_order(nodes: DataFrame) -> DataFrame:
    """``container_order``: 1-based position among elements with the same tag
    and primary class on the page, and the size of that group."""
    key = [F.col("page_id"), F.col("tag"), F.coalesce(F.try_element_at(F.col("classes"), F.lit(1)), F.lit(""))]
    w = Window.partitionBy(*key).orderBy("node_id")
    return nodes.select("page_id", "node_id", "tag", F.try_element_at(F.col("classes"), F.lit(1)).alias("primary_class"),
                        F.row_number().over(w).alias("order"),
                        F.count("*").over(Window.partitionBy(*key)).alias("n_similar"))


def specific_selector(nodes: DataFrame) -> DataFrame:
    """``specific_selector``: shortest unique selector per element -- a
    class unique on the page; else a unique id; else a unique data-*
    attribute; else ``parent > .class``; else ``tag:nth-of-type(n)``.
    Uniqueness is a count per (page, class | id | attribute) window."""
    c = F.col
    cls = nodes.select("page_id", "node_id", F.explode("classes").alias("cls"))
    cls_n = cls.groupBy("page_id", "cls").agg(F.count("*").alias("n"))
    uniq_cls = cls.join(cls_n, ["page_id", "cls"]).filter(c("n") == 1).groupBy("page_id", "node_id").agg(
        F.min("cls").alias("u_cls"))
    ids = nodes.filter(c("id").isNotNull() & (c("id") != ""))
    id_n = ids.groupBy("page_id", "id").agg(F.count("*").alias("n"))
    uniq_id = ids.join(id_n, ["page_id", "id"]).filter(c("n") == 1).select("page_id", "node_id", c("id").alias("u_id"))
    da = nodes.select("page_id", "node_id", F.explode("attrs").alias("k", "v")).filter(c("k").startswith("data-"))
    da_n = da.groupBy("page_id", "k", "v").agg(F.count("*").alias("n"))
    uniq_da = da.join(da_n, ["page_id", "k", "v"]).filter(c("n") == 1).groupBy("page_id", "node_id").agg(
        F.min_by(F.format_string('[%s="%s"]', c("k"), c("v")), c("k")).alias("u_data"))
    parent = nodes.select("page_id", c("node_id").alias("parent_id"), c("tag").alias("p_tag"),
                          c("classes").alias("p_classes"))
    j = nodes.join(uniq_cls, ["page_id", "node_id"], "left").join(uniq_id, ["page_id", "node_id"], "left") \
        .join(uniq_da, ["page_id", "node_id"], "left").join(parent, ["page_id", "parent_id"], "left")
    p_sel = F.concat(c("p_tag"), F.when(F.size("p_classes") > 0, F.concat(F.lit("."), F.try_element_at("p_classes", F.lit(1))))
                     .otherwise(F.lit("")))
    sel = F.coalesce(
        F.concat(F.lit("."), c("u_cls")),
        F.concat(F.lit("#"), c("u_id")),
        c("u_data"),
        F.when(F.size("classes") > 0, F.concat(p_sel, F.lit(" > ."), F.try_element_at("classes", F.lit(1)))),
        F.format_string("%s:nth-of-type(%d)", c("tag"), c("type_idx")))
    return j.select("page_id", "node_id", sel.alias("selector"))
