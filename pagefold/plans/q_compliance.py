"""Registered legal-compliance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefold.functions import url as U
from pagefold.operators import compliance as C
from pagefold.operators import links as L
from pagefold.operators import quality as Q
from pagefold.plans import duck as D
from pagefold.plans.catalog import register
from pagefold.plans.q_items import SQL_ITEMS, SQL_VALIDATED
from pagefold.plans.q_links import SQL_LINKS
from pagefold.sources import derived as S
from pagefold.sources.tables import pages, read_table

AGENT = C.DEFAULT_AGENT
NOW_CACHE = "2024-01-06 00:00:00"
NOW_RETENTION = "2005-01-01 00:00:00"


def _src_type_sql(h: str) -> str:
    return f"(['municipal', 'news', 'government', 'commercial'])[length({h}) % 4 + 1]"


SQL_ROBOTS = f"""
rb0 AS (SELECT {D.host('url')} AS domain, min(page_id) AS pid FROM pages GROUP BY 1),
robots AS (
  SELECT domain,
    CASE WHEN pid % 7 = 0 THEN 0 WHEN pid % 4 = 3 THEN 404 ELSE 200 END AS status,
    CASE WHEN pid % 4 = 1 THEN base || agent WHEN pid % 4 = 2 THEN 'User-agent: *' || chr(10) || 'Disallow: /' || chr(10)
         ELSE base END AS body,
    TIMESTAMP '{S.ROBOTS_EPOCH}' + to_hours(CAST(pid AS INTEGER)) AS fetched_at
  FROM (SELECT *,
    '# robots.txt for ' || domain || chr(10) || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /fr/' || chr(10)
      || 'Allow: /en/' || chr(10) || 'Crawl-delay: ' || CAST(pid % 5 AS VARCHAR) || chr(10) || 'Sitemap: https://'
      || domain || '/sitemap.xml' || chr(10) AS base,
    chr(10) || 'User-agent: pagefold-bot/1.0' || chr(10) || 'Allow: /de/' || chr(10) || 'Disallow: /e*'
      || chr(10) || 'Crawl-delay: 2' || chr(10) AS agent
    FROM rb0)
),
fs AS (
  SELECT domain, fetched_at,
    CASE WHEN status IS NULL OR status = 0 THEN 'error' WHEN status >= 200 AND status < 300 THEN 'ok' ELSE 'not_found' END AS outcome,
    CASE WHEN status >= 200 AND status < 300 THEN body ELSE '' END AS body,
    NOT (status IS NULL OR status = 0) AS is_valid,
    fetched_at + CASE WHEN status IS NULL OR status = 0 THEN INTERVAL {C.ERROR_TTL_HOURS} HOUR
                      ELSE INTERVAL {C.VALID_TTL_HOURS} HOUR END AS expires_at
  FROM robots
),
rl0 AS (
  SELECT domain, pos, trim(raw) AS line FROM (
    SELECT domain, unnest(range(len(string_split(body, chr(10))))) AS pos, unnest(string_split(body, chr(10))) AS raw FROM fs)
  WHERE trim(raw) <> '' AND NOT starts_with(trim(raw), '#')
),
rl1 AS (
  SELECT domain, pos, lower(split_part(line, ':', 1)) AS directive,
         trim(CASE WHEN contains(line, ':') THEN substr(line, instr(line, ':') + 1) ELSE '' END) AS value
  FROM rl0
),
rl2 AS (
  SELECT *, sum(CASE WHEN directive = 'user-agent' THEN 1 ELSE 0 END)
              OVER (PARTITION BY domain ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rule_idx
  FROM rl1
),
rules AS (
  SELECT domain, rule_idx,
    CASE WHEN ua = '' THEN '*' ELSE ua END AS user_agent,
    allowed, disallowed, TRY_CAST(regexp_extract(delay_txt, '^\\s*([+-]?\\d+)', 1) AS INTEGER) AS crawl_delay, sitemaps
  FROM (
    SELECT domain, rule_idx,
      arg_min(value, pos) FILTER (WHERE directive = 'user-agent') AS ua,
      coalesce(list(value ORDER BY pos) FILTER (WHERE directive = 'allow' AND value <> ''), []) AS allowed,
      coalesce(list(value ORDER BY pos) FILTER (WHERE directive = 'disallow' AND value <> ''), []) AS disallowed,
      arg_max(value, pos) FILTER (WHERE directive = 'crawl-delay' AND value <> '') AS delay_txt,
      coalesce(list(value ORDER BY pos) FILTER (WHERE directive = 'sitemap' AND value <> ''), []) AS sitemaps
    FROM rl2 WHERE rule_idx > 0 GROUP BY domain, rule_idx)
),
app AS (
  SELECT * EXCLUDE (ex, any_ex) FROM (
    SELECT *, lower(user_agent) = lower('{AGENT}') AS ex,
           max(CASE WHEN lower(user_agent) = lower('{AGENT}') THEN 1 ELSE 0 END) OVER (PARTITION BY domain) AS any_ex
    FROM rules)
  WHERE CASE WHEN any_ex = 1 THEN ex ELSE user_agent = '*' END
),
rpaths AS (
  SELECT domain, rule_idx, 0 AS kind, unnest(range(len(allowed))) AS path_idx, unnest(allowed) AS pattern FROM app
  UNION ALL
  SELECT domain, rule_idx, 1 AS kind, unnest(range(len(disallowed))) AS path_idx, unnest(disallowed) AS pattern FROM app
)"""


def _pm_sql(path: str, pattern: str) -> str:
    return (f"(CASE WHEN {pattern} = '/' THEN true WHEN ends_with({pattern}, '*') "
            f"THEN starts_with({path}, substring({pattern}, 1, length({pattern}) - 1)) "
            f"ELSE starts_with({path}, {pattern}) END)")


def _robots_state(spark, sf_dir):
    return C.robots_fetch_state(S.robots(spark, sf_dir))


@register("src_robots", oracle=f"""
WITH {SQL_ROBOTS}
SELECT domain, outcome, is_valid, length(body) AS body_chars,
       strftime(expires_at, '%Y-%m-%d %H:%M:%S') AS expires_at FROM fs""")
def src_robots(spark, sf_dir):
    fs = _robots_state(spark, sf_dir)
    return fs.select("domain", "outcome", "is_valid", F.length("body").alias("body_chars"),
                     F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"))


@register("robots_parse", oracle=f"""
WITH {SQL_ROBOTS}
SELECT domain, rule_idx, user_agent, array_to_string(allowed, ',') AS allowed,
       array_to_string(disallowed, ',') AS disallowed, crawl_delay, array_to_string(sitemaps, ',') AS sitemaps
FROM rules""")
def robots_parse(spark, sf_dir):
    r = C.robots_parse(_robots_state(spark, sf_dir))
    return r.select("domain", "rule_idx", "user_agent", F.array_join("allowed", ",").alias("allowed"),
                    F.array_join("disallowed", ",").alias("disallowed"), "crawl_delay",
                    F.array_join("sitemaps", ",").alias("sitemaps"))


@register("robots_applicable", oracle=f"WITH {SQL_ROBOTS} SELECT domain, rule_idx, user_agent FROM app")
def robots_applicable(spark, sf_dir):
    r = C.robots_applicable(C.robots_parse(_robots_state(spark, sf_dir)), AGENT)
    return r.select("domain", "rule_idx", "user_agent")


SQL_URLS = f"""{SQL_LINKS},
urls AS (SELECT page_id * 100000 + pos AS url_id, url FROM links),
u AS (SELECT url_id, url, {D.valid('url')} AS ok, {D.host('url')} AS domain, {D.path('url')} AS path FROM urls)"""


def _urls(spark, sf_dir):
    lk = L.resolved_links(S.linked_pages(spark, sf_dir))
    return lk.select((F.col("page_id") * 100000 + F.col("pos")).alias("url_id"), "url")


@register("robots_path_match", oracle=f"""
WITH {SQL_URLS}, {SQL_ROBOTS}
SELECT url_id, rule_idx, kind, path_idx, {_pm_sql('path', 'pattern')} AS matches
FROM u JOIN rpaths USING (domain) WHERE ok""")
def robots_path_match(spark, sf_dir):
    u = _urls(spark, sf_dir).select("url_id", U.url_valid("url").alias("ok"),
                                    U.url_host("url").alias("domain"), U.url_path("url").alias("path"))
    paths = C.rule_paths(C.robots_applicable(C.robots_parse(_robots_state(spark, sf_dir)), AGENT))
    return u.filter("ok").join(paths, "domain").select(
        "url_id", "rule_idx", "kind", "path_idx", C.path_matches(F.col("path"), F.col("pattern")).alias("matches"))


@register("robots_allowed", oracle=f"""
WITH {SQL_URLS}, {SQL_ROBOTS},
hits AS (SELECT url_id, rule_idx, kind, path_idx FROM u JOIN rpaths USING (domain)
         WHERE ok AND {_pm_sql('path', 'pattern')}),
first AS (SELECT url_id, arg_min(kind = 0, rule_idx * 1000000 + kind * 100000 + path_idx) AS verdict
          FROM hits GROUP BY url_id)
SELECT u.url_id, u.url, CASE WHEN NOT u.ok THEN false ELSE coalesce(first.verdict, true) END AS allowed
FROM u LEFT JOIN first USING (url_id)""")
def robots_allowed(spark, sf_dir):
    return C.robots_allowed(_urls(spark, sf_dir), S.robots(spark, sf_dir), AGENT)


@register("robots_crawl_delay", oracle=f"""
WITH {SQL_ROBOTS},
fd AS (SELECT domain, arg_min(crawl_delay, rule_idx) AS d FROM app WHERE crawl_delay IS NOT NULL GROUP BY domain)
SELECT fs.domain, coalesce(fd.d * 1000, 1000) AS crawl_delay_ms FROM fs LEFT JOIN fd USING (domain)""")
def robots_crawl_delay(spark, sf_dir):
    return C.robots_crawl_delay(S.robots(spark, sf_dir), AGENT)


SQL_DOMAINS = f"""doms AS (SELECT DISTINCT {D.host('url')} AS domain FROM pages),
domains AS (SELECT domain, {_src_type_sql('domain')} AS source_type FROM doms)"""


@register("compliance_check", oracle=f"""
WITH {SQL_ROBOTS}, {SQL_DOMAINS},
agg AS (SELECT domain, count(*) AS n_rules,
               bool_or(list_contains(disallowed, '/') OR len(disallowed) > 10) AS restrictive
        FROM rules GROUP BY domain)
SELECT d.domain, true AS robots_txt_compliant, 'https://' || d.domain || '/robots.txt' AS robots_txt_url,
  coalesce(n_rules, 0) AS n_rules,
  array_to_string(list_filter([
    CASE WHEN coalesce(n_rules, 0) = 0 THEN 'No robots.txt file found - proceeding with caution' END,
    CASE WHEN coalesce(restrictive, false) THEN 'Domain has restrictive robots.txt rules' END], lambda x: x IS NOT NULL), ' | ') AS warnings,
  array_to_string(list_filter([
    CASE WHEN coalesce(restrictive, false) THEN 'Review robots.txt compliance before scraping' END,
    {', '.join(D.q(a) for a in C.GDPR_ACTIONS)},
    {', '.join(f"CASE WHEN source_type IN ('government', 'municipal') THEN {D.q(a)} END" for a in C.PUBLIC_ACTIONS)}
  ], lambda x: x IS NOT NULL), ' | ') AS recommended_actions
FROM domains d LEFT JOIN agg USING (domain)""")
def compliance_check(spark, sf_dir):
    r = C.compliance_check(S.robots(spark, sf_dir), S.domains(spark, sf_dir))
    return r.select("domain", "robots_txt_compliant", "robots_txt_url", "n_rules",
                    F.array_join("warnings", " | ").alias("warnings"),
                    F.array_join("recommended_actions", " | ").alias("recommended_actions"))


def _retention_sql(st: str) -> str:
    return ("CASE " + " ".join(f"WHEN {st} = {D.q(k)} THEN {v}" for k, v in C.RETENTION_DAYS.items())
            + " ELSE 365 END")


@register("legal_metadata", oracle=f"""
WITH {SQL_DOMAINS}
SELECT domain, source_type, 'DE' AS jurisdiction, true AS gdpr_compliant,
       CASE WHEN source_type IN ('government', 'municipal') THEN 'public_task' ELSE 'legitimate_interest' END AS data_processing_basis,
       {_retention_sql('source_type')} AS retention_days
FROM domains""")
def legal_metadata(spark, sf_dir):
    return C.legal_metadata(S.domains(spark, sf_dir))


@register("retention_expired", oracle=f"""
WITH {SQL_ITEMS}, {SQL_DOMAINS},
x AS (SELECT i.item_id, try_strptime(i.endDate, '%Y-%m-%d') AS collected_at, {_retention_sql('d.source_type')} AS days
      FROM items i JOIN domains d ON d.domain = {D.host('i.sourceUrl')})
SELECT item_id, days AS retention_days FROM x
WHERE collected_at + to_days(days) < TIMESTAMP '{NOW_RETENTION}'""")
def retention_expired(spark, sf_dir):
    it = S.items(spark, sf_dir).select("item_id", U.url_host("sourceUrl").alias("domain"),
                                       F.try_to_timestamp("endDate", F.lit("yyyy-MM-dd")).alias("collected_at"))
    md = C.legal_metadata(S.domains(spark, sf_dir)).select("domain", "retention_days")
    j = it.join(md, "domain")
    return C.retention_expired(j, "collected_at", "retention_days",
                               F.to_timestamp(F.lit(NOW_RETENTION))).select("item_id", "retention_days")


def _anon_email_sql(e: str) -> str:
    return (f"substring(sha256(string_split({e}, '@')[1] || '{C.DEFAULT_SALT}'), 1, 8) || '@' || "
            f"coalesce(string_split({e}, '@')[2], 'undefined')")


def _anon_phone_sql(p: str) -> str:
    digits = f"regexp_replace({p}, '\\D', '', 'g')"
    hashed = f"substring(regexp_replace(sha256({digits} || '{C.DEFAULT_SALT}'), '\\D', '', 'g'), 1, length({digits}))"
    chars = f"string_split({p}, '')"
    k = f"len(list_filter({chars}[1:i - 1], lambda x: regexp_matches(x, '^\\d$')))"
    per = (f"CASE WHEN regexp_matches(ch, '^\\d$') THEN (CASE WHEN substring({hashed}, {k} + 1, 1) <> '' "
           f"THEN substring({hashed}, {k} + 1, 1) ELSE '0' END) ELSE ch END")
    return f"array_to_string(list_transform({chars}, lambda ch, i: {per}), '')"


SQL_DOC_PII = f"""
pii AS (
  SELECT doc_id, nullif(regexp_extract(text, {D.q(S.EMAIL_FIND_RE)}, 0), '') AS email,
         nullif(regexp_extract(text, {D.q(S.PHONE_FIND_RE)}, 0), '') AS phone, text
  FROM documents
)"""


def _pii(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.nullif(F.regexp_extract("text", S.EMAIL_FIND_RE, 0), F.lit("")).alias("email"),
                    F.nullif(F.regexp_extract("text", S.PHONE_FIND_RE, 0), F.lit("")).alias("phone"), "text")


@register("anonymize_email", oracle=f"""
WITH {SQL_DOC_PII} SELECT doc_id, email, {_anon_email_sql('email')} AS anonymized FROM pii WHERE email IS NOT NULL""")
def anonymize_email(spark, sf_dir):
    p = _pii(spark, sf_dir).filter(F.col("email").isNotNull())
    return p.select("doc_id", "email", C.anonymize_email("email").alias("anonymized"))


@register("anonymize_phone", oracle=f"""
WITH {SQL_DOC_PII} SELECT doc_id, phone, {_anon_phone_sql('phone')} AS anonymized FROM pii WHERE phone IS NOT NULL""")
def anonymize_phone(spark, sf_dir):
    p = _pii(spark, sf_dir).filter(F.col("phone").isNotNull())
    return p.select("doc_id", "phone", C.anonymize_phone("phone").alias("anonymized"))


def _anon_address_sql(a: str) -> str:
    e = D.rx_replace(a, r"\d+", "XXX")
    e = D.rx_replace(e, r"(?i)\b\w+straße\b", "Musterstraße")
    return D.rx_replace(e, r"(?i)\b\w+str\.\b", "Musterstr.")


@register("anonymize_address", oracle=f"""
WITH {SQL_DOC_PII} SELECT doc_id, md5({_anon_address_sql('text')}) AS anonymized_md5 FROM pii""")
def anonymize_address(spark, sf_dir):
    """Address anonymization over whole document texts (digits and street
    names are the targets)."""
    return _pii(spark, sf_dir).select("doc_id", F.md5(C.anonymize_address("text")).alias("anonymized_md5"))


@register("anonymize_items", oracle=f"""
WITH {SQL_ITEMS}
SELECT item_id,
  CASE WHEN email IS NOT NULL AND email <> '' THEN {_anon_email_sql('email')} ELSE email END AS email,
  CASE WHEN phone IS NOT NULL AND phone <> '' THEN {_anon_phone_sql('phone')} ELSE phone END AS phone,
  address FROM items""")
def anonymize_items(spark, sf_dir):
    return C.anonymize_items(S.items(spark, sf_dir)).select("item_id", "email", "phone", "address")


SQL_DELETION = f"""
dreq AS (
  SELECT 'dom-' || CAST(page_id AS VARCHAR) AS request_id, {D.host('url')} AS domain, NULL AS email, NULL AS phone,
         CAST(NULL AS TIMESTAMP) AS from_ts, CAST(NULL AS TIMESTAMP) AS to_ts FROM pages WHERE page_id % 25 = 0
  UNION ALL
  SELECT 'mail-' || CAST(doc_id AS VARCHAR), NULL, regexp_extract(text, {D.q(S.EMAIL_FIND_RE)}, 0), NULL, NULL, NULL
  FROM documents WHERE doc_id % 10 = 3 AND regexp_extract(text, {D.q(S.EMAIL_FIND_RE)}, 0) <> ''
  UNION ALL
  SELECT 'tel-' || CAST(doc_id AS VARCHAR), NULL, NULL, regexp_extract(text, {D.q(S.PHONE_FIND_RE)}, 0), NULL, NULL
  FROM documents WHERE doc_id % 10 = 7 AND regexp_extract(text, {D.q(S.PHONE_FIND_RE)}, 0) <> ''
  UNION ALL
  SELECT 'date-' || CAST(o_orderkey AS VARCHAR), NULL, NULL, NULL, o_orderdate, o_orderdate + INTERVAL 30 DAY
  FROM orders WHERE o_orderkey % 1000 = 0
),
ditems AS (SELECT item_id, {D.host('sourceUrl')} AS domain, lower(trim(email)) AS email, phone,
                  CAST(try_strptime(substring(endDate, 1, 10), '%Y-%m-%d') AS DATE) AS day FROM items),
dmatch AS (
  SELECT DISTINCT request_id, item_id FROM (
    SELECT r.request_id, i.item_id FROM dreq r JOIN ditems i ON lower(r.domain) = i.domain
    UNION ALL SELECT r.request_id, i.item_id FROM dreq r JOIN ditems i ON lower(trim(r.email)) = i.email
    UNION ALL SELECT r.request_id, i.item_id FROM dreq r JOIN ditems i ON r.phone = i.phone
    UNION ALL SELECT r.request_id, i.item_id FROM dreq r JOIN ditems i
      ON i.day BETWEEN CAST(r.from_ts AS DATE) AND CAST(r.to_ts AS DATE))
)"""


@register("gdpr_delete", oracle=f"""
WITH {SQL_ITEMS}, {SQL_DELETION}
SELECT item_id FROM items WHERE item_id NOT IN (SELECT item_id FROM dmatch)""")
def gdpr_delete(spark, sf_dir):
    return C.gdpr_delete(S.items(spark, sf_dir), S.deletion_requests(spark, sf_dir)).select("item_id")


@register("gdpr_delete_counts", oracle=f"""
WITH {SQL_ITEMS}, {SQL_DELETION}
SELECT r.request_id, count(m.item_id) AS deleted_records
FROM dreq r LEFT JOIN dmatch m USING (request_id) GROUP BY r.request_id""")
def gdpr_delete_counts(spark, sf_dir):
    return C.gdpr_delete_counts(S.items(spark, sf_dir), S.deletion_requests(spark, sf_dir))


@register("cache_stats", oracle=f"""
WITH {SQL_ROBOTS}
SELECT count(*) AS total_entries,
       count(*) FILTER (WHERE expires_at > TIMESTAMP '{NOW_CACHE}' AND is_valid) AS valid_entries,
       count(*) FILTER (WHERE NOT (expires_at > TIMESTAMP '{NOW_CACHE}' AND is_valid)) AS expired_entries
FROM fs""")
def cache_stats(spark, sf_dir):
    return C.cache_stats(_robots_state(spark, sf_dir), F.to_timestamp(F.lit(NOW_CACHE)))
