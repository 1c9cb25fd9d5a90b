"""Selectors evaluated inside a page: no join per selector step.

``page_trees`` keeps a page's elements as one array in document order, so the
parent and the ancestors of an element are places in the same array.  A selector
is a list of alternatives, each a list of compound steps.  ``matches`` folds over
the steps with one boolean per element ("the steps so far lead to it") and so
decides descendant and child chains exactly; many selectors of a page are one
projection over one scan.  A page is the largest thing a row ever holds.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.operators import dom as M

NODE = ("struct<parent:int,tag:string,id:string,classes:array<string>,attrs:map<string,string>,type_idx:int,"
        "ancestors:array<int>,text_start:int,text_end:int>")
_NODE_ARROW = pa.struct([
    ("parent", pa.int32()), ("tag", pa.string()), ("id", pa.string()), ("classes", pa.list_(pa.string())),
    ("attrs", pa.map_(pa.string(), pa.string())), ("type_idx", pa.int32()), ("ancestors", pa.list_(pa.int32())),
    ("text_start", pa.int32()), ("text_end", pa.int32())])
#: Pages parsed at once; bounds the nodes a worker holds beside the Arrow batch.
SLICE = 64


def _offsets(sizes) -> pa.Array:
    return pa.array([0, *accumulate(sizes)], pa.int32())


def _node_lists(pages: list[list[dict]]) -> pa.Array:
    """Parsed elements of some pages as one Arrow list column, built column by column."""
    nodes = [n for page in pages for n in page]
    columns = {f.name: pa.array([n[f.name] for n in nodes], f.type) for f in _NODE_ARROW if f.name not in ("parent", "attrs")}
    columns["parent"] = pa.array([n["parent_id"] for n in nodes], pa.int32())
    attrs = [dict(zip(n["attr_names"], n["attr_values"])) for n in nodes]  # of a repeated name the last
    columns["attrs"] = pa.MapArray.from_arrays(_offsets(map(len, attrs)), pa.array([k for a in attrs for k in a], pa.string()),
                                               pa.array([v for a in attrs for v in a.values()], pa.string()))
    struct = pa.StructArray.from_arrays([columns[f.name] for f in _NODE_ARROW], fields=[*_NODE_ARROW])
    return pa.ListArray.from_arrays(_offsets(map(len, pages)), struct)


def page_trees(pages: DataFrame) -> DataFrame:
    """All columns of ``pages`` but ``html``, with ``nodes`` (in document order) and ``text``.

    The scan's own splits feed the parser: html is never shuffled.
    """
    kept = [c for c in pages.columns if c != "html"]
    out_fields = [*(f.simpleString().replace(":", " ", 1) for f in pages.schema if f.name != "html"), f"nodes array<{NODE}>", "text string"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found, texts = [], []
                for html in part.column("html").to_pylist():
                    nodes, text = M.shred_html(html)
                    found.append(nodes)
                    texts.append(text)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), _node_lists(found), pa.array(texts, pa.string())],
                                                 names=[*kept, "nodes", "text"])

    return pages.mapInArrow(run, ", ".join(out_fields))


def selector_steps(selectors: DataFrame) -> DataFrame:
    """``selector, alts``: every distinct selector as alternatives of steps; one outside
    the subset has no alternative and matches nothing."""
    steps, _ = M.selector_steps(selectors)
    ordered = steps.groupBy("sel_id", "alt").agg(F.array_sort(F.collect_list(F.struct(
        "step", "combinator", "tag", "id", "classes", "conds", "nth"))).alias("steps"))
    return ordered.groupBy(F.col("sel_id").alias("selector")).agg(F.collect_list("steps").alias("alts"))


def _fits(n: Column, s: Column) -> Column:
    """Element ``n`` satisfies compound step ``s``."""
    return ((s["tag"].isNull() | (n["tag"] == s["tag"]))
            & (s["id"].isNull() | F.coalesce(n["id"] == s["id"], F.lit(False)))
            & (F.size(F.array_except(s["classes"], n["classes"])) == 0)
            & F.forall(s["conds"], lambda c: M._cond_ok(n["attrs"], c))
            & (s["nth"].isNull() | (n["type_idx"] == s["nth"])))


def _reached(nodes: Column, steps: Column) -> Column:
    """One boolean per element: the steps lead to it."""
    def step(before, s):
        def led(n):
            return (F.when(s["combinator"].isNull(), True)
                    .when(s["combinator"] == ">", (n["parent"] >= 0) & F.coalesce(F.get(before, n["parent"]), F.lit(False)))
                    .otherwise(F.exists(n["ancestors"], lambda a: F.coalesce(F.get(before, a), F.lit(False)))))
        return F.transform(nodes, lambda n: _fits(n, s) & led(n))
    return F.aggregate(steps, F.transform(nodes, lambda n: F.lit(True)), step)


def matches(nodes: Column, alts: Column) -> Column:
    """Places of the elements that a selector matches, in document order."""
    reached = F.transform(alts, lambda steps: _reached(nodes, steps))
    places = F.when(F.size(nodes) > 0, F.sequence(F.lit(0), F.size(nodes) - 1)).otherwise(F.array().cast("array<int>"))
    from pagefold.functions.url import let
    return let(reached, lambda r: F.filter(places, lambda k: F.exists(r, lambda x: F.get(x, k))))


def node_text(text: Column, node: Column) -> Column:
    """``textContent`` of an element."""
    return F.substring(text, node["text_start"] + 1, node["text_end"] - node["text_start"])
