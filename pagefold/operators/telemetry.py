"""Recorded model-call telemetry and reply parsing.

Nothing here calls a model: requests and replies are tables.  Pairing is a
left join on the request id with ``max_by`` over response time; session
summaries are grouped aggregates; reply parsing is ``try_parse_json`` +
``try_variant_get`` with the reference's falsy defaults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefold.functions import url as U

JSON_SPAN_RE = r"(?s)\{.*\}"


def llm_pair(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """``llm_pair``: each request with its last response; a placeholder
    (empty content, 0 ms, not successful) when there is none."""
    last = responses.groupBy("request_id").agg(
        F.max_by(F.struct("content", "tokens_used", "duration_ms", "success", "error"), "ts").alias("r"))
    j = requests.join(last, requests["id"] == last["request_id"], "left")
    return j.select(
        "id", "session_id", "ts", "service", "provider", "model",
        F.col("r").isNotNull().alias("has_response"),
        F.coalesce("r.content", F.lit("")).alias("content"),
        F.col("r.tokens_used").alias("tokens_used"),
        F.coalesce("r.duration_ms", F.lit(0)).alias("duration_ms"),
        F.coalesce("r.success", F.lit(False)).alias("success"),
        F.col("r.error").alias("error"))


def llm_context_merge(contexts: DataFrame) -> DataFrame:
    """``llm_context_merge``: shallow merge per request, later keys win."""
    return contexts.groupBy("request_id", "key").agg(F.max_by("value", "seq").alias("value"))


def llm_summary(pairs: DataFrame) -> DataFrame:
    """``llm_summary``: requests, tokens, summed request time, success % per session."""
    return pairs.groupBy("session_id").agg(
        F.count("*").alias("total_requests"),
        F.sum(F.coalesce("tokens_used", F.lit(0))).alias("total_tokens"),
        F.sum("duration_ms").alias("total_duration"),
        (F.count_if("success") / F.count("*") * 100).alias("success_rate"))


def llm_breakdown(requests: DataFrame) -> DataFrame:
    """``llm_breakdown``: request counts by provider and by service per session
    (one grouping-sets aggregation)."""
    by = requests.select("session_id", F.explode(F.array(
        F.struct(F.lit("provider").alias("dimension"), F.col("provider").alias("name")),
        F.struct(F.lit("service").alias("dimension"), F.col("service").alias("name")))).alias("d"))
    return by.groupBy("session_id", "d.dimension", "d.name").agg(F.count("*").alias("count"))


def json_span(text) -> Column:
    """``llm_json_extract``: greedy first '{' to last '}'."""
    t = U._c(text)
    return F.when(t.rlike(JSON_SPAN_RE), F.regexp_extract(t, JSON_SPAN_RE, 0))


def _parsed(text: Column) -> Column:
    return F.try_parse_json(text)


def _ok(v: Column) -> Column:
    return v.isNotNull() & ~F.is_variant_null(v)


def _str_or(v: Column, path: str, default: str) -> Column:
    s = F.try_variant_get(v, path, "string")
    return F.when(s.isNull() | (s == ""), F.lit(default)).otherwise(s)


def _num_or(v: Column, path: str, default: float) -> Column:
    x = F.try_variant_get(v, path, "double")
    return F.when(x.isNull() | (x == 0) | F.isnan(x), F.lit(default)).otherwise(x)


def llm_chunk_parse(reply) -> Column:
    """``llm_chunk_parse``: struct(parsed, relevance, content_type, keep,
    reasoning, n_selectors) from the JSON span of a reply."""
    return U.let(_parsed(json_span(reply)), lambda v: F.struct(
        _ok(v).alias("parsed"),
        F.when(_ok(v), _num_or(v, "$.relevanceScore", 0.0)).alias("relevance"),
        F.when(_ok(v), _str_or(v, "$.contentType", "unknown")).alias("content_type"),
        F.when(_ok(v), F.coalesce(F.try_variant_get(v, "$.shouldKeep", "boolean"), F.lit(False))).alias("keep"),
        F.when(_ok(v), _str_or(v, "$.reasoning", "No reasoning provided")).alias("reasoning"),
        F.when(_ok(v), F.coalesce(F.size(F.try_variant_get(v, "$.extractedSelectors", "array<string>")), F.lit(0)))
        .alias("n_selectors")))


def llm_selectors_parse(reply) -> Column:
    """``llm_selectors_parse``: detail selectors (non-blank strings, trimmed),
    rich fields present in the map (default description), confidence 0.5 or
    0.3 when the reply is not JSON."""
    def body(v):
        raw = F.try_variant_get(v, "$.detailSelectors", "map<string,variant>")
        kept = F.map_filter(raw, lambda k, x: (F.schema_of_variant(x) == "STRING")
                            & (F.trim(F.try_variant_get(x, "$", "string")) != ""))
        sel = F.transform_values(kept, lambda k, x: F.trim(F.try_variant_get(x, "$", "string")))
        sel = F.coalesce(sel, F.create_map().cast("map<string,string>"))
        rich_raw = F.try_variant_get(v, "$.richContentFields", "array<variant>")
        rich = F.when(rich_raw.isNotNull(), F.transform(
            F.filter(rich_raw, lambda x: (F.schema_of_variant(x) == "STRING")
                     & F.map_contains_key(sel, F.try_variant_get(x, "$", "string"))),
            lambda x: F.try_variant_get(x, "$", "string"))) \
            .otherwise(F.when(F.map_contains_key(sel, "description"), F.array(F.lit("description")))
                       .otherwise(F.array().cast("array<string>")))
        return F.when(_ok(v), F.struct(
            F.lit(True).alias("parsed"), sel.alias("selectors"), rich.alias("rich_fields"),
            _num_or(v, "$.confidence", 0.5).alias("confidence"),
            _str_or(v, "$.reasoning", "LLM content analysis completed").alias("reasoning"))) \
            .otherwise(F.struct(
                F.lit(False).alias("parsed"), F.create_map().cast("map<string,string>").alias("selectors"),
                F.array().cast("array<string>").alias("rich_fields"), F.lit(0.3).alias("confidence"),
                F.lit("Failed to parse LLM response").alias("reasoning")))
    return U.let(_parsed(U._c(reply)), body)


def selector_sanitize(sel) -> Column:
    """``selector_sanitize``: '#9x' -> '#id9x'; '#[...]' removed."""
    s = U._c(sel)
    t = F.trim(s)
    t = F.regexp_replace(t, r"#(\d[a-zA-Z0-9]*)", "#id$1")
    t = F.regexp_replace(t, r"#\[[^\]]*\]", "")
    return F.when(s.isNull() | (F.trim(s) == ""), s).otherwise(t)


CONTAINER_FIELDS = ["exampleUrlSelector", "siblingContainerSelector", "contentLinkSelector",
                    "paginationNextSelector"]


def llm_container_parse(reply) -> Column:
    """``llm_container_parse``: six fields with defaults (0.3 on failure),
    selectors sanitized."""
    def body(v):
        fields = [selector_sanitize(F.when(_ok(v), _str_or(v, f"$.{f}", "")).otherwise(F.lit(""))).alias(f)
                  for f in CONTAINER_FIELDS]
        return F.struct(
            _ok(v).alias("parsed"), *fields,
            F.when(_ok(v), _num_or(v, "$.confidence", 0.5)).otherwise(F.lit(0.3)).alias("confidence"),
            F.when(_ok(v), _str_or(v, "$.reasoning", "LLM analysis completed"))
            .otherwise(F.lit("Failed to parse LLM response")).alias("reasoning"))
    return U.let(_parsed(U._c(reply)), body)


def llm_pagination_parse(reply, base_url) -> Column:
    """``llm_pagination_parse``: string links resolved and valid; confidence
    clamped to [0, 1]."""
    base = U._c(base_url)

    def body(v):
        links = F.try_variant_get(v, "$.paginationLinks", "array<variant>")
        strs = F.transform(F.filter(F.coalesce(links, F.array().cast("array<variant>")),
                                    lambda x: F.schema_of_variant(x) == "STRING"),
                           lambda x: F.try_variant_get(x, "$", "string"))
        resolved = F.filter(F.transform(strs, lambda s: U.url_resolve(s, base)), lambda u: U.url_valid(u))
        nxt = F.when(F.schema_of_variant(F.try_variant_get(v, "$.paginationNextSelector", "variant")) == "STRING",
                     _str_or(v, "$.paginationNextSelector", ""))
        conf = F.try_variant_get(v, "$.confidence", "double")
        conf = F.when(conf.isNull() | F.isnan(conf), F.lit(0.0)).otherwise(conf)
        return F.when(_ok(v), F.struct(
            resolved.alias("links"), F.nullif(nxt, F.lit("")).alias("next_selector"),
            F.least(F.greatest(conf, F.lit(0.0)), F.lit(1.0)).alias("confidence")))
    return U.let(_parsed(U._c(reply)), body)


def llm_consent_steps_parse(replies: DataFrame, key: str, reply: str) -> DataFrame:
    """``llm_consent_steps_parse``: one row per step with defaults (number,
    action click, description, wait 1000, fallbacks)."""
    v = F.try_parse_json(F.col(reply))
    steps = replies.select(key, F.posexplode(F.coalesce(F.try_variant_get(v, "$.steps", "array<variant>"),
                                                        F.array().cast("array<variant>"))).alias("idx", "s"))
    s = F.col("s")
    n = F.try_variant_get(s, "$.stepNumber", "bigint")
    wait = F.try_variant_get(s, "$.waitTime", "bigint")
    desc = F.try_variant_get(s, "$.description", "string")
    act = F.try_variant_get(s, "$.action", "string")
    return steps.select(
        key, "idx",
        F.when(n.isNull() | (n == 0), F.col("idx") + 1).otherwise(n).alias("step_number"),
        F.when(act.isNull() | (act == ""), F.lit("click")).otherwise(act).alias("action"),
        F.try_variant_get(s, "$.selector", "string").alias("selector"),
        F.when(desc.isNull() | (desc == ""), F.concat(F.lit("Step "), (F.col("idx") + 1).cast("string")))
        .otherwise(desc).alias("description"),
        F.when(wait.isNull() | (wait == 0), F.lit(1000)).otherwise(wait).alias("wait_time"),
        F.coalesce(F.try_variant_get(s, "$.fallbackSelectors", "array<string>"),
                   F.array().cast("array<string>")).alias("fallback_selectors"))


def llm_progressive_context(chunks: DataFrame, key: str = "page_id", order: str = "seq",
                            max_chars: int = 4000) -> DataFrame:
    """``llm_progressive_context``: per chunk, the kept text of earlier chunks
    (500 chars each, last 4000 chars) and the labels of the previous two.

    Linear in the chunks of a page: a kept chunk's tail is made of the kept chunks just
    before it, of which only so many fit as their headings alone take ``max_chars``; every
    other chunk takes the tail of the last kept one.
    """
    head, foot = "\n\n--- Chunk ", " ---\n"
    reach = -(-max_chars // len(head + foot))
    w_kept = Window.partitionBy(key, "keep").orderBy(order).rowsBetween(-reach, 0)
    w_before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    w_two = Window.partitionBy(key).orderBy(order).rowsBetween(-2, -1)
    piece = F.when(F.col("keep"), F.concat(F.lit(head), F.col("chunk_id"), F.lit(foot), F.substring("content", 1, 500)))
    acc = F.array_join(F.collect_list(piece).over(w_kept), "")
    # keeping only the tail matches trimming after every append: only the
    # last max_chars characters can survive either way
    tail = F.when(F.length(acc) > max_chars, F.substring(acc, -max_chars, max_chars)).otherwise(acc)
    chunks = chunks.withColumn("_tail", F.when(F.col("keep"), tail))
    recent = F.collect_list(F.concat(F.lit("- "), F.col("chunk_id"), F.lit(": "),
                                     F.coalesce("category", F.lit("unknown")), F.lit(" ("),
                                     F.length("content").cast("string"), F.lit(" chars)"))).over(w_two)
    before = F.coalesce(F.last("_tail", ignorenulls=True).over(w_before), F.lit(""))
    return chunks.withColumn("accumulated_context", before).withColumn("recent_chunks", recent).drop("_tail")
