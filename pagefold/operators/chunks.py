"""Structural extraction and HTML chunking over the node table.

Element matches come from ``dom.selector_match``; element HTML is a slice
of the page source, taken after one page-keyed join of the match list with
the page (one html value per page, never per node).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagefold.operators import dom as M

# Structural categories and their selectors, in order.
STRUCTURAL = {
    "mainContent": ["main", "article", ".content", ".main-content", '[role="main"]'],
    "navigation": ["nav", ".navigation", ".nav", ".menu", '[role="navigation"]'],
    "advertisements": [".ad", ".advertisement", ".ads", ".banner", '[class*="ad-"]'],
    "footers": ["footer", ".footer", '[role="contentinfo"]'],
    "headers": ["header", ".header", '[role="banner"]'],
    "sidebars": ["aside", ".sidebar", ".side", '[role="complementary"]'],
}
SEMANTIC_TAGS = ["div", "section", "article", "main", "aside", "nav", "header", "footer", "ul", "ol", "table"]
MAX_CHUNK = 2000


def structural_selectors() -> dict[str, str]:
    """sel_id 'cc:ss' (category index, selector index) -> selector."""
    out = {}
    for ci, (cat, sels) in enumerate(STRUCTURAL.items()):
        for si, s in enumerate(sels):
            out[f"{ci:02d}:{si:02d}"] = s
    return out


CATEGORIES = list(STRUCTURAL)


def structural_extract(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """``structural_extract``: one row per (page, category, selector,
    element) in the reference's push order, with the element's outerHTML."""
    spark = nodes.sparkSession
    steps = M.selector_table(spark, structural_selectors())
    hits = M.selector_match(nodes, steps).join(
        nodes.select("page_id", "node_id", "src_start", "src_end"), ["page_id", "node_id"])
    cat_idx = F.split("sel_id", ":").getItem(0).cast("int")
    sel_idx = F.split("sel_id", ":").getItem(1).cast("int")
    per_page = hits.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(
        cat_idx.alias("c"), sel_idx.alias("s"), F.col("node_id").alias("n"), "src_start", "src_end"))).alias("els"))
    j = per_page.join(pages.select("page_id", "html"), "page_id")
    ex = j.select("page_id", "html", F.posexplode("els").alias("seq", "e"))
    cats = F.array(*[F.lit(c) for c in CATEGORIES])
    return ex.select(
        "page_id", "seq", F.element_at(cats, F.col("e.c") + 1).alias("category"),
        F.col("e.n").alias("node_id"),
        F.expr("substring(html, e.src_start + 1, e.src_end - e.src_start)").alias("content"))


#: Pages packed at once, and characters of chunks handed on at once: bounds what a worker
#: holds beside the Arrow batch, as nested elements make a page's chunks larger than the page.
PACK_ROWS, PACK_CHARS = 32, 1 << 22
_CHUNK = pa.schema([("page_id", pa.int64()), ("idx", pa.int32()), ("content", pa.string())])


def _packed(html: str, starts: list[int], ends: list[int]):
    """Greedy packing of element HTML in document order into <= MAX_CHUNK
    chunks (a chunk always takes at least one element)."""
    parts, size = [], 0
    for a, b in zip(starts, ends):
        el = html[a:b]
        if size + len(el) > MAX_CHUNK and size:
            yield "".join(parts)
            parts, size = [], 0
        parts.append(el)
        size += len(el)
    if size:
        yield "".join(parts)


def _pack_batches(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, PACK_ROWS):
            part = batch.slice(at, PACK_ROWS)
            rows, size = [], 0
            for pid, html, starts, ends in zip(*(part.column(c).to_pylist() for c in ("page_id", "html", "starts", "ends"))):
                for idx, chunk in enumerate(_packed(html or "", starts, ends)):
                    rows.append((pid, idx, chunk))
                    size += len(chunk)
                    if size > PACK_CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CHUNK)], schema=_CHUNK)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CHUNK)], schema=_CHUNK)


def chunk_semantic(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """``chunk_semantic``: outerHTML of div, section, article, ... in
    document order, greedily packed into chunks of at most 2000 chars
    (nested elements repeat, as in the reference)."""
    el = nodes.filter(F.col("tag").isin(SEMANTIC_TAGS)).groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("node_id", "src_start", "src_end"))).alias("els"))
    j = el.join(pages.select("page_id", "html"), "page_id")
    packed = j.select("page_id", "html", F.col("els.src_start").alias("starts"), F.col("els.src_end").alias("ends"))
    return packed.mapInArrow(_pack_batches, "page_id long, idx int, content string").select(
        "page_id", "idx", F.concat(F.lit("chunk-"), F.col("idx").cast("string")).alias("chunk_id"),
        F.lit("semantic").alias("type"), F.lit(None).cast("string").alias("category"), "content")


def chunk_structural(structural: DataFrame) -> DataFrame:
    """``chunk_structural``: one chunk per categorized element."""
    return structural.select(
        "page_id", F.col("seq").alias("idx"), F.concat(F.lit("chunk-"), F.col("seq").cast("string")).alias("chunk_id"),
        F.lit("structural").alias("type"), "category", "content")


def chunk_hybrid(semantic: DataFrame, structural: DataFrame) -> DataFrame:
    """``chunk_hybrid``: semantic then structural chunks, deduplicated on
    their first 100 characters (first occurrence wins)."""
    u = semantic.withColumn("part", F.lit(0)).unionByName(structural.withColumn("part", F.lit(1)))
    w = Window.partitionBy("page_id", F.substring("content", 1, 100)).orderBy("part", "idx")
    d = u.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    w2 = Window.partitionBy("page_id").orderBy("part", "idx")
    return d.withColumn("seq", F.row_number().over(w2) - 1)


def chunk_classify(chunks: DataFrame) -> DataFrame:
    """``chunk_classify``: rule classification (the no-model fallback)."""
    main = (F.coalesce(F.col("category") == "mainContent", F.lit(False))
            | F.col("content").contains("<main") | F.col("content").contains("<article"))
    return chunks.withColumn("is_main", main) \
        .withColumn("relevance", F.when(main, 8).otherwise(3)) \
        .withColumn("content_type", F.when(main, "main-content").otherwise("unknown")) \
        .withColumn("keep", main)


def chunk_merge(classified: DataFrame, structural: DataFrame, pages: DataFrame) -> DataFrame:
    """``chunk_merge``: kept chunks + main content wrapped into one document;
    chunk counts and the size ratio per page."""
    kept = classified.groupBy("page_id").agg(
        F.count("*").alias("n_chunks"), F.count_if("keep").alias("n_kept"),
        F.array_sort(F.collect_list(F.when(F.col("keep"), F.struct("seq", "content")))).alias("k"))
    main = structural.filter(F.col("category") == "mainContent").groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda s: s["content"]),
                     "").alias("main"))
    j = kept.join(main, "page_id", "left").join(pages.select("page_id", F.length("html").alias("orig")), "page_id")
    parts = F.concat(F.transform("k", lambda s: s["content"]),
                     F.when(F.coalesce(F.col("main"), F.lit("")) != "", F.array("main"))
                     .otherwise(F.array().cast("array<string>")))
    doc = F.concat(F.lit('<!DOCTYPE html>\n<html>\n<head>\n  <meta charset="UTF-8">\n  <title>Compressed Content</title>\n'
                         '</head>\n<body>\n  '), F.array_join(parts, "\n"), F.lit("\n</body>\n</html>"))
    return j.select("page_id", "n_chunks", "n_kept", (F.col("n_chunks") - F.col("n_kept")).alias("n_removed"),
                    doc.alias("document"), (F.length(doc) / F.col("orig")).alias("size_ratio"))


def focus_content_areas(nodes: DataFrame, pages: DataFrame, selectors: list[str]) -> DataFrame:
    """``focus_content_areas``: only the elements matching the selectors (per
    selector, document order) in a new document; the page unchanged when
    nothing matches."""
    spark = nodes.sparkSession
    steps = M.selector_table(spark, {f"{i:03d}": s for i, s in enumerate(selectors)})
    hits = M.selector_match(nodes, steps).join(nodes.select("page_id", "node_id", "src_start", "src_end"),
                                                ["page_id", "node_id"])
    per = hits.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("sel_id"), F.col("node_id"), "src_start", "src_end"))).alias("els"))
    j = pages.select("page_id", "html").join(per, "page_id", "left")
    body = F.array_join(F.transform(F.col("els"), lambda e: F.substring(
        "html", e["src_start"] + 1, e["src_end"] - e["src_start"])), "")
    focused = F.concat(F.lit("<html><head></head><body>"), body, F.lit("</body></html>"))
    return j.select("page_id", F.when(F.col("els").isNull(), F.col("html")).otherwise(focused).alias("focused"),
                    F.coalesce(F.size("els"), F.lit(0)).alias("n_elements"))
