"""Registered telemetry and reply-parsing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefold.operators import telemetry as T
from pagefold.plans import duck as D
from pagefold.plans.catalog import register
from pagefold.sources import derived as S

SQL_LLM = f"""
conv_ts AS (SELECT *, TIMESTAMP '{S.LLM_EPOCH}' + to_hours(CAST(conv_id AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)) AS ts
            FROM conversations),
llm_requests AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id,
         'session-' || CAST(conv_id % 25 AS VARCHAR) AS session_id, ts,
         ({', '.join(D.q(s) for s in S.LLM_SERVICES).join('[]')})[turn % 4 + 1] AS service,
         ({', '.join(D.q(s) for s in S.LLM_PROVIDERS).join('[]')})[conv_id % 3 + 1] AS provider
  FROM conv_ts WHERE role = 'user'
),
conv_req AS (
  SELECT *, max(CASE WHEN role = 'user' THEN turn END)
              OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS req_turn
  FROM conv_ts
),
llm_responses AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(req_turn AS VARCHAR) AS request_id, ts, text AS content,
         CASE WHEN turn % 5 <> 4 THEN CAST(ceil(length(text) / 3.5) AS BIGINT) END AS tokens_used,
         CAST(length(text) * 3 AS BIGINT) AS duration_ms,
         (length(text) > 0 AND conv_id % 11 <> 0) AS success,
         CASE WHEN NOT (length(text) > 0 AND conv_id % 11 <> 0) THEN 'timeout' END AS error, turn AS seq
  FROM conv_req WHERE role = 'assistant' AND req_turn IS NOT NULL
),
last_resp AS (
  SELECT request_id, arg_max(content, ts) AS content, arg_max(tokens_used, ts) AS tokens_used,
         arg_max(duration_ms, ts) AS duration_ms, arg_max(success, ts) AS success, arg_max(error, ts) AS error
  FROM llm_responses GROUP BY request_id
),
pairs AS (
  SELECT q.id, q.session_id, q.service, q.provider, r.request_id IS NOT NULL AS has_response,
         coalesce(r.content, '') AS content, r.tokens_used, coalesce(r.duration_ms, 0) AS duration_ms,
         coalesce(r.success, false) AS success, r.error
  FROM llm_requests q LEFT JOIN last_resp r ON q.id = r.request_id
)"""


def _pairs(spark, sf_dir):
    return T.llm_pair(S.llm_requests(spark, sf_dir), S.llm_responses(spark, sf_dir))


@register("llm_pair", oracle=f"""
WITH {SQL_LLM}
SELECT id, session_id, has_response, md5(content) AS content_md5, tokens_used, duration_ms, success, error FROM pairs""")
def llm_pair(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", "session_id", "has_response", F.md5("content").alias("content_md5"),
                                        "tokens_used", "duration_ms", "success", "error")


@register("llm_context_merge", oracle=f"""
WITH {SQL_LLM},
ctx AS (SELECT request_id, seq, 'phase' AS key, 'turn-' || CAST(seq AS VARCHAR) AS value FROM llm_responses
        UNION ALL SELECT request_id, seq, 'chars', CAST(length(content) AS VARCHAR) FROM llm_responses)
SELECT request_id, key, arg_max(value, seq) AS value FROM ctx GROUP BY 1, 2""")
def llm_context_merge(spark, sf_dir):
    return T.llm_context_merge(S.llm_contexts(spark, sf_dir))


@register("llm_summary", oracle=f"""
WITH {SQL_LLM}
SELECT session_id, count(*) AS total_requests, sum(coalesce(tokens_used, 0)) AS total_tokens,
       sum(duration_ms) AS total_duration,
       round(count(*) FILTER (WHERE success) / count(*) * 100, 6) AS success_rate
FROM pairs GROUP BY session_id""")
def llm_summary(spark, sf_dir):
    return T.llm_summary(_pairs(spark, sf_dir)).withColumn("success_rate", F.round("success_rate", 6))


@register("llm_breakdown", oracle=f"""
WITH {SQL_LLM}
SELECT session_id, 'provider' AS dimension, provider AS name, count(*) AS count FROM llm_requests GROUP BY 1, 3
UNION ALL
SELECT session_id, 'service', service, count(*) FROM llm_requests GROUP BY 1, 3""")
def llm_breakdown(spark, sf_dir):
    return T.llm_breakdown(S.llm_requests(spark, sf_dir))


SQL_REPLIES = f"""
replies0 AS (
  SELECT event_id AS reply_id, props AS reply FROM events
  UNION ALL
  SELECT -(conv_id * 1000 + turn) - 1, text FROM conversations WHERE role = 'assistant'
  UNION ALL
  SELECT event_id + {S.REPLY_OFFSET},
    replace(replace(([{', '.join(D.q(t) for t in S.REPLY_TEMPLATES)}])[event_id // 4 % {len(S.REPLY_TEMPLATES)} + 1],
      '{{n}}', CAST(event_id AS VARCHAR)), '{{d}}', CAST(event_id % 10 AS VARCHAR))
  FROM events WHERE event_id % 4 = 1
),
replies AS (SELECT reply_id, reply, CASE WHEN json_valid(reply) THEN reply END AS rj FROM replies0)"""


def _span(r: str) -> str:
    return f"(CASE WHEN regexp_matches({r}, '(?s)\\{{.*\\}}') THEN regexp_extract({r}, '(?s)\\{{.*\\}}', 0) END)"


def _ok(j: str) -> str:
    """``j`` must already be NULL unless it is valid JSON."""
    return f"coalesce({j} IS NOT NULL AND json_type({j}) <> 'NULL', false)"


def _str_or(j: str, path: str, default: str) -> str:
    s = f"json_extract_string({j}, '{path}')"
    return f"(CASE WHEN {s} IS NULL OR {s} = '' THEN {D.q(default)} ELSE {s} END)"


def _num_or(j: str, path: str, default: float) -> str:
    x = f"TRY_CAST(json_extract({j}, '{path}') AS DOUBLE)"
    return f"(CASE WHEN {x} IS NULL OR {x} = 0 OR isnan({x}) THEN {default}e0 ELSE {x} END)"


def _replies(spark, sf_dir):
    return S.llm_replies(spark, sf_dir)


@register("llm_json_extract", oracle=f"""
WITH {SQL_REPLIES}
SELECT reply_id, span_chars, {_ok('s')} AS parsed,
       CASE WHEN {_ok('s')} THEN TRY_CAST(json_extract(s, '$.k') AS BIGINT) END AS k
FROM (SELECT reply_id, span_chars, CASE WHEN json_valid(s0) THEN s0 END AS s FROM (SELECT reply_id, {_span('reply')} AS s0, length({_span('reply')}) AS span_chars FROM replies))""")
def llm_json_extract(spark, sf_dir):
    r = _replies(spark, sf_dir).select("reply_id", T.json_span("reply").alias("s"))
    v = F.try_parse_json("s")
    ok = v.isNotNull() & ~F.is_variant_null(v)
    return r.select("reply_id", F.length("s").alias("span_chars"), F.coalesce(ok, F.lit(False)).alias("parsed"),
                    F.when(ok, F.try_variant_get(v, "$.k", "bigint")).alias("k"))


@register("llm_chunk_parse", oracle=f"""
WITH {SQL_REPLIES}
SELECT reply_id, {_ok('s')} AS parsed,
  CASE WHEN {_ok('s')} THEN {_num_or('s', '$.relevanceScore', 0.0)} END AS relevance,
  CASE WHEN {_ok('s')} THEN {_str_or('s', '$.contentType', 'unknown')} END AS content_type,
  CASE WHEN {_ok('s')} THEN coalesce(TRY_CAST(json_extract(s, '$.shouldKeep') AS BOOLEAN), false) END AS keep,
  CASE WHEN {_ok('s')} THEN {_str_or('s', '$.reasoning', 'No reasoning provided')} END AS reasoning,
  CASE WHEN {_ok('s')} THEN coalesce(json_array_length(s, '$.extractedSelectors'), 0) END AS n_selectors
FROM (SELECT reply_id, span_chars, CASE WHEN json_valid(s0) THEN s0 END AS s FROM (SELECT reply_id, {_span('reply')} AS s0, length({_span('reply')}) AS span_chars FROM replies))""")
def llm_chunk_parse(spark, sf_dir):
    r = _replies(spark, sf_dir).select("reply_id", T.llm_chunk_parse("reply").alias("p"))
    return r.select("reply_id", "p.parsed", "p.relevance", "p.content_type", "p.keep", "p.reasoning",
                    "p.n_selectors").withColumn("parsed", F.coalesce("parsed", F.lit(False)))


@register("llm_selectors_parse", oracle=f"""
WITH {SQL_REPLIES},
p AS (SELECT reply_id, rj AS j, {_ok('rj')} AS ok FROM replies),
q AS (SELECT *,
  CASE WHEN ok AND json_type(j, '$.detailSelectors') = 'OBJECT' THEN
    list_filter(json_keys(j, '$.detailSelectors'), lambda k: json_type(j, '$.detailSelectors."' || k || '"') = 'VARCHAR'
      AND trim(json_extract_string(j, '$.detailSelectors."' || k || '"')) <> '') ELSE [] END AS keys
  FROM p)
SELECT reply_id, ok AS parsed, len(keys) AS n_selectors,
  CASE WHEN NOT ok THEN ''
       WHEN json_type(j, '$.richContentFields') = 'ARRAY' THEN array_to_string(list_filter(
         json_extract_string(j, '$.richContentFields[*]'), lambda f: list_contains(keys, f)), ',')
       WHEN list_contains(keys, 'description') THEN 'description' ELSE '' END AS rich_fields,
  CASE WHEN ok THEN {_num_or('j', '$.confidence', 0.5)} ELSE 0.3e0 END AS confidence,
  CASE WHEN ok THEN {_str_or('j', '$.reasoning', 'LLM content analysis completed')} ELSE 'Failed to parse LLM response' END AS reasoning
FROM q""")
def llm_selectors_parse(spark, sf_dir):
    r = _replies(spark, sf_dir).select("reply_id", T.llm_selectors_parse("reply").alias("p"))
    return r.select("reply_id", F.col("p.parsed").alias("parsed"), F.size("p.selectors").alias("n_selectors"),
                    F.array_join("p.rich_fields", ",").alias("rich_fields"), "p.confidence", "p.reasoning")


def _sanitize_sql(s: str) -> str:
    t = f"regexp_replace(regexp_replace(trim({s}), '#(\\d[a-zA-Z0-9]*)', '#id\\1', 'g'), '#\\[[^\\]]*\\]', '', 'g')"
    return f"(CASE WHEN {s} IS NULL OR trim({s}) = '' THEN {s} ELSE {t} END)"


def _container_field_sql(f: str) -> str:
    inner = f"CASE WHEN {_ok('rj')} THEN {_str_or('rj', '$.' + f, '')} ELSE '' END"
    return f"{_sanitize_sql(inner)} AS {f}"


@register("llm_container_parse", oracle=f"""
WITH {SQL_REPLIES}
SELECT reply_id, {_ok('rj')} AS parsed,
  {', '.join(_container_field_sql(f) for f in T.CONTAINER_FIELDS)},
  CASE WHEN {_ok('rj')} THEN {_num_or('rj', '$.confidence', 0.5)} ELSE 0.3e0 END AS confidence,
  CASE WHEN {_ok('rj')} THEN {_str_or('rj', '$.reasoning', 'LLM analysis completed')} ELSE 'Failed to parse LLM response' END AS reasoning
FROM replies""")
def llm_container_parse(spark, sf_dir):
    r = _replies(spark, sf_dir).select("reply_id", T.llm_container_parse("reply").alias("p"))
    return r.select("reply_id", "p.*")


@register("selector_sanitize", oracle=f"""
WITH {SQL_REPLIES}
SELECT reply_id, {_sanitize_sql("'#' || CAST(reply_id % 97 AS VARCHAR) || 'x .item #[data] > a'")} AS sanitized FROM replies""")
def selector_sanitize(spark, sf_dir):
    r = _replies(spark, sf_dir)
    sel = F.concat(F.lit("#"), (F.col("reply_id") % 97).cast("string"), F.lit("x .item #[data] > a"))
    return r.select("reply_id", T.selector_sanitize(sel).alias("sanitized"))


@register("llm_pagination_parse", oracle=f"""
WITH {SQL_REPLIES}
SELECT reply_id,
  CASE WHEN {_ok('rj')} THEN coalesce(len(list_filter(json_extract(rj, '$.paginationLinks[*]'),
       lambda x: json_type(x) = 'VARCHAR')), 0) END AS n_links,
  CASE WHEN {_ok('rj')} AND json_type(rj, '$.paginationNextSelector') = 'VARCHAR'
       THEN nullif(json_extract_string(rj, '$.paginationNextSelector'), '') END AS next_selector,
  CASE WHEN {_ok('rj')} THEN least(greatest(coalesce(TRY_CAST(json_extract(rj, '$.confidence') AS DOUBLE), 0.0e0), 0.0e0), 1.0e0) END AS confidence
FROM replies""")
def llm_pagination_parse(spark, sf_dir):
    r = _replies(spark, sf_dir).select(
        "reply_id", T.llm_pagination_parse("reply", F.lit("https://example.com/list")).alias("p"))
    return r.select("reply_id", F.size("p.links").alias("n_links"), F.col("p.next_selector").alias("next_selector"),
                    F.col("p.confidence").alias("confidence"))


@register("llm_consent_steps_parse", oracle=f"""
WITH {SQL_REPLIES},
st AS (SELECT reply_id, unnest(range(CAST(coalesce(json_array_length(rj, '$.steps'), 0) AS BIGINT))) AS idx FROM replies WHERE {_ok('rj')})
SELECT reply_id, idx FROM st""")
def llm_consent_steps_parse(spark, sf_dir):
    return T.llm_consent_steps_parse(_replies(spark, sf_dir), "reply_id", "reply").select("reply_id", "idx")
