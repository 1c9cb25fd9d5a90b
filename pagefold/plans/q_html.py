"""Registered page-projection and HTML-transform queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagefold.functions import html as H
from pagefold.functions import url as U
from pagefold.plans import duck as D
from pagefold.plans.catalog import register
from pagefold.sources.tables import pages


def _basic_sql(h: str) -> str:
    e = D.strip(h, [H.RE_COMMENT, H.RE_SCRIPT, H.RE_STYLE, H.RE_LINK, H.RE_META])
    e = D.rx_replace(e, H.RE_WS, " ")
    e = D.rx_replace(e, H.RE_GAP, "><")
    return f"trim({e})"


def _tokens_sql(e: str) -> str:
    return f"CAST(ceil(length({e}) / 3.5) AS BIGINT)"


def _summary(spark, sf_dir, expr, name):
    p = pages(spark, sf_dir)
    return p.select("page_id", expr("html").alias("_o")).select(
        "page_id", F.length("_o").alias(f"{name}_chars"), F.md5("_o").alias(f"{name}_md5"))


def _summary_sql(e: str, name: str) -> str:
    return f"SELECT page_id, length(o) AS {name}_chars, md5(o) AS {name}_md5 FROM (SELECT page_id, {e} AS o FROM pages)"


@register("html_basic_compress", oracle=f"""
SELECT page_id, original_size, compressed_size,
       round((original_size - compressed_size) / original_size, 6) AS compression_ratio,
       {_tokens_sql('c')} AS tokens_estimate, md5(c) AS compressed_md5
FROM (SELECT page_id, length(html) AS original_size, c, length(c) AS compressed_size
      FROM (SELECT page_id, html, {_basic_sql('html')} AS c FROM pages))""")
def html_basic_compress(spark, sf_dir):
    return basic_compress_results(pages(spark, sf_dir)).drop("compressed").withColumn(
        "compression_ratio", F.round("compression_ratio", 6))


def basic_compress_results(p):
    """Compression result rows: sizes, ratio, token estimate (one pass per page)."""
    c = p.select("page_id", F.length("html").alias("original_size"), H.basic_compress("html").alias("compressed"))
    return c.select(
        "page_id", "original_size", F.length("compressed").alias("compressed_size"),
        ((F.col("original_size") - F.length("compressed")) / F.col("original_size")).alias("compression_ratio"),
        H.token_estimate("compressed").alias("tokens_estimate"), F.md5("compressed").alias("compressed_md5"),
        "compressed")


def _ws_sql(h: str) -> str:
    e = D.rx_replace(h, H.RE_WS, " ")
    e = D.rx_replace(e, H.RE_GAP, "><")
    e = D.rx_replace(e, r"^\s+|\s+$", "")
    return D.rx_replace(e, r"\n\s*\n", "\n")


@register("html_strip_whitespace", oracle=_summary_sql(_ws_sql("html"), "stripped"))
def html_strip_whitespace(spark, sf_dir):
    return _summary(spark, sf_dir, H.strip_whitespace, "stripped")


def _trunc_sql(h: str, max_tokens: int) -> str:
    mc = max_tokens * 4
    cut = f"substring({h}, 1, {mc})"
    r = f"instr(reverse({cut}), '>')"
    last = f"(length({cut}) - {r} + 1)"
    backed = f"CASE WHEN {r} > 0 AND ({last} - 1) > {mc * 0.8} THEN substring({cut}, 1, {last}) ELSE {cut} END"
    return f"CASE WHEN ceil(length({h}) / 3.5) <= {max_tokens} THEN {h} ELSE {backed} END"


@register("html_truncate_tokens", oracle=f"""
SELECT page_id, length(o) AS truncated_chars, md5(o) AS truncated_md5
FROM (SELECT page_id, {_trunc_sql('c', 500)} AS o FROM (SELECT page_id, {_basic_sql('html')} AS c FROM pages))""")
def html_truncate_tokens(spark, sf_dir):
    c = pages(spark, sf_dir).select("page_id", H.basic_compress("html").alias("c"))
    return c.select("page_id", H.truncate_tokens("c", 500).alias("o")).select(
        "page_id", F.length("o").alias("truncated_chars"), F.md5("o").alias("truncated_md5"))


@register("token_estimate", oracle=f"SELECT page_id, {_tokens_sql('html')} AS tokens FROM pages")
def token_estimate(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", H.token_estimate("html").alias("tokens"))


@register("html_compress_stats", oracle=f"""
WITH r AS (
  SELECT length(html) AS o, length(c) AS s, {_tokens_sql('c')} AS t
  FROM (SELECT html, {_basic_sql('html')} AS c FROM pages)
)
SELECT count(*) AS n_results,
       round(coalesce(avg((o - s) / o), 0), 6) AS avg_compression_ratio,
       round(coalesce(avg((ceil(o / 3.5) - t) / ceil(o / 3.5)), 0), 6) AS avg_token_reduction,
       CAST(0 AS BIGINT) AS total_elements_removed
FROM r""")
def html_compress_stats(spark, sf_dir):
    r = basic_compress_results(pages(spark, sf_dir))
    orig_tok = F.ceil(F.col("original_size") / F.lit(3.5))
    return r.agg(
        F.count("*").alias("n_results"),
        F.round(F.coalesce(F.avg("compression_ratio"), F.lit(0.0)), 6).alias("avg_compression_ratio"),
        F.round(F.coalesce(F.avg((orig_tok - F.col("tokens_estimate")) / orig_tok), F.lit(0.0)), 6)
        .alias("avg_token_reduction"),
        F.lit(0).cast("bigint").alias("total_elements_removed"))


def _main_sql(h: str, max_len: int = 20000) -> str:
    t = f"trim({D.rx_replace(D.strip(h, [H.RE_COMMENT, H.RE_SCRIPT, H.RE_STYLE]), H.RE_WS, ' ')})"
    return f"""(SELECT CASE WHEN length(o) > {max_len} THEN substring(o, 1, {max_len}) || '...' ELSE o END FROM (
      SELECT CASE WHEN found <> '' THEN found ELSE {D.strip('t', H.NOISE_BLOCKS)} END AS o FROM (
        SELECT t, {' || '.join(f"array_to_string(regexp_extract_all(t, {D.q(p)}, 0), chr(10))" for p in H.MAIN_CONTENT_PATTERNS)} AS found
        FROM (SELECT {t} AS t))))"""


@register("html_main_content", oracle=_summary_sql(_main_sql("html"), "main"))
def html_main_content(spark, sf_dir):
    return _summary(spark, sf_dir, H.main_content, "main")


def _llm_sql(h: str, max_len: int = 12000) -> str:
    e = D.strip(h, [H.RE_COMMENT, H.RE_SCRIPT, H.RE_STYLE])
    e = f"trim({D.rx_replace(D.rx_replace(e, H.RE_WS, ' '), H.RE_GAP, '><')})"
    return f"(SELECT CASE WHEN length(o) > {max_len} THEN substring(o, 1, {max_len}) || '...' ELSE o END FROM (SELECT {e} AS o))"


@register("html_llm_compress", oracle=_summary_sql(_llm_sql("html"), "llm"))
def html_llm_compress(spark, sf_dir):
    return _summary(spark, sf_dir, H.llm_compress, "llm")


def _verbose_sql(h: str) -> str:
    e = D.strip(h, H.VERBOSE_ATTR_PATTERNS)
    e = D.rx_replace(e, H.RE_WS, " ")
    e = D.rx_replace(e, r"\s+>", ">")
    return D.rx_replace(e, r">\s+", ">")


@register("html_drop_verbose_attrs", oracle=_summary_sql(_verbose_sql("html"), "attrs"))
def html_drop_verbose_attrs(spark, sf_dir):
    return _summary(spark, sf_dir, H.drop_verbose_attrs, "attrs")


def _trunc_text_sql(h: str, focused: bool = False) -> str:
    tm, hm = (100, 80) if focused else (150, 120)
    e = D.rx_replace(h, rf"(?i)<(h([1-6])[^>]*)>([^<]{{{hm}}})[^<]+</h[1-6]>", r"<\1>\3...</h\2>")
    e = D.rx_replace(e, r"(?i)<(h([1-6])[^>]*)>([^<]+)</h[1-6]>", r"<\1>\3</h\2>")
    for tag in ["p", "span", "div", "a", "li", "td", "th"]:
        e = D.rx_replace(e, rf"(?i)<({tag}[^>]*)>([^<]{{{tm}}})[^<]+</{tag}>", rf"<\1>\2...</{tag}>")
    return e


@register("html_truncate_text", oracle=_summary_sql(_trunc_text_sql("html"), "trunc"))
def html_truncate_text(spark, sf_dir):
    return _summary(spark, sf_dir, H.truncate_text, "trunc")


def _structure_sql(h: str) -> str:
    e = D.strip(h, [H.RE_COMMENT, H.RE_SCRIPT, H.RE_STYLE, H.RE_SVG,
                    r'(?i)\sstyle\s*=\s*"[^"]*"', r"(?i)\sstyle\s*=\s*'[^']*'"])
    e = f"trim({D.rx_replace(D.rx_replace(e, H.RE_WS, ' '), H.RE_GAP, '><')})"
    return _trunc_text_sql(_verbose_sql(e))


@register("html_structure_compress", oracle=_summary_sql(_structure_sql("html"), "structure"))
def html_structure_compress(spark, sf_dir):
    return _summary(spark, sf_dir, H.structure_compress, "structure")


@register("page_bundle", oracle=f"""
WITH m AS (SELECT page_id, url, {D.host('url')} AS host, {_main_sql('html')} AS trimmed FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS rn FROM m)
SELECT host, count(*) AS n_pages,
       md5(string_agg('<!-- URL: ' || url || ' -->' || chr(10) || trimmed,
                      chr(10) || chr(10) || '<!-- PAGE SEPARATOR -->' || chr(10) || chr(10) ORDER BY rn)) AS bundle_md5
FROM r WHERE rn <= 3 GROUP BY host""")
def page_bundle(spark, sf_dir):
    """First 3 pages of each host joined with URL comments and separators.

    ``row_number() <= 3`` is applied before the grouping, so each group holds
    at most three rows whatever the host size.
    """
    p = pages(spark, sf_dir)
    w = Window.partitionBy("host").orderBy("page_id")
    # Ranked without html (a window-group-limit); only the pages that stay are read and cleaned.
    first = p.select("page_id", U.url_host("url").alias("host")).withColumn(
        "rn", F.row_number().over(w)).filter("rn <= 3")
    r = p.join(first, "page_id").select("page_id", "url", "host", "rn", H.main_content("html").alias("trimmed"))
    part = F.concat(F.lit("<!-- URL: "), F.col("url"), F.lit(" -->\n"), F.col("trimmed"))
    g = r.groupBy("host").agg(F.count("*").alias("n_pages"),
                              F.array_sort(F.collect_list(F.struct("rn", part.alias("t")))).alias("parts"))
    return g.select("host", "n_pages", F.md5(F.array_join(
        F.transform("parts", lambda s: s["t"]), "\n\n<!-- PAGE SEPARATOR -->\n\n")).alias("bundle_md5"))
