"""Registered extraction-run queries.

A run is the set of items extracted from one site (host of the page URL).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefold.functions import url as U
from pagefold.operators import extraction as X
from pagefold.operators import links as L
from pagefold.operators import quality as Q
from pagefold.plans import duck as D
from pagefold.plans.catalog import register
from pagefold.plans.q_items import SQL_ITEMS, SQL_VALIDATED, _iso, _parse_date
from pagefold.plans.q_links import SQL_LINKS
from pagefold.sources import derived as S
from pagefold.sources.tables import pages, read_table


def _items_run(spark, sf_dir):
    return S.items(spark, sf_dir).withColumn("run_key", U.url_host("sourceUrl"))


def _token_lang_sql(t: str, d: str) -> str:
    text = f"lower(coalesce({t}, 'undefined') || ' ' || coalesce({d}, 'undefined'))"
    words = f"string_split_regex({text}, '\\s+')"
    de = f"len(list_filter({words}, lambda w: w IN ({', '.join(D.q(w) for w in X.TOKEN_GERMAN)})))"
    en = f"len(list_filter({words}, lambda w: w IN ({', '.join(D.q(w) for w in X.TOKEN_ENGLISH)})))"
    return f"(CASE WHEN {de} > {en} THEN 'de' ELSE 'en' END)"


SQL_RUN_ONLY = f"""
run_items AS (SELECT *, {D.host('sourceUrl')} AS run_key FROM items),
norm_items AS (
  SELECT * REPLACE ({_token_lang_sql('title', 'description')} AS language,
                    coalesce(dates, []) AS dates, coalesce(images, []) AS images)
  FROM run_items
)"""
SQL_RUN_ITEMS = SQL_ITEMS + "," + SQL_RUN_ONLY


@register("item_normalize_basic", oracle=f"""
WITH {SQL_RUN_ITEMS}
SELECT item_id, language, len(dates) AS n_dates, len(images) AS n_images FROM norm_items""")
def item_normalize_basic(spark, sf_dir):
    n = X.item_normalize_basic(_items_run(spark, sf_dir))
    return n.select("item_id", "language", F.size("dates").alias("n_dates"), F.size("images").alias("n_images"))


def _truthy(c):
    return f"({c} IS NOT NULL AND {c} <> '')"


def _is_iso_sql(c):
    return (f"(regexp_matches({c}, {D.q(X.ISO_MS_RE)}) AND "
            f"try_strptime({c}, '%Y-%m-%dT%H:%M:%S.%gZ') IS NOT NULL)")


def _sandbox_date_sql():
    s = "coalesce(dates[1], startDate)"
    forms = [(r"(\d{1,2})\.(\d{1,2})\.(\d{4})", 3, 2, 1), (r"(\d{4})-(\d{2})-(\d{2})", 1, 2, 3),
             (r"(\d{1,2})/(\d{1,2})/(\d{4})", 3, 2, 1)]
    whens = " ".join(
        f"WHEN regexp_matches({s}, {D.q(p)}) THEN regexp_extract({s}, {D.q(p)}, {y}) || '-' || "
        f"lpad(regexp_extract({s}, {D.q(p)}, {m}), 2, '0') || '-' || lpad(regexp_extract({s}, {D.q(p)}, {d}), 2, '0')"
        f" || ' 00:00:00.000'" for p, y, m, d in forms)
    out = f"(CASE {whens} END)"
    return (f"(CASE WHEN {_truthy(s)} THEN (CASE WHEN {out} IS NOT NULL THEN try_strptime({out}, '%Y-%m-%d %H:%M:%S.%g') "
            f"ELSE {_parse_date(s)} END) END)")


def _float_prefix_sql(s):
    return f"TRY_CAST(regexp_extract({s}, '^[0-9]*\\.?[0-9]*', 0) AS DOUBLE)"


SQL_EXT_ERRORS = f"""
ext AS (
  SELECT run_key, title, place, address, startDate, endDate, dates,
    list_concat(list_filter([
      CASE WHEN title IS NULL OR trim(title) = '' THEN 'Title is required' END,
      CASE WHEN description IS NULL OR trim(description) = '' THEN 'Description is required' END,
      CASE WHEN NOT coalesce(language IN ('de', 'en'), false) THEN 'Language must be "de" or "en"' END,
      {', '.join(f"CASE WHEN {_truthy(f)} AND NOT {_is_iso_sql(f)} THEN '{f} must be in ISO 8601 format' END"
                 for f in ['startDate', 'endDate', 'createdAt'])}
    ], lambda x: x IS NOT NULL),
    list_transform(list_filter(list_zip(coalesce(dates, []), range(len(coalesce(dates, [])))),
                               lambda s: s[1] IS NOT NULL AND NOT coalesce({_is_iso_sql('s[1]')}, false)),
                   lambda s: 'dates[' || CAST(s[2] AS VARCHAR) || '] must be in ISO 8601 format')) AS errs,
    list_filter([
      CASE WHEN NOT {_truthy('place')} AND NOT {_truthy('address')} THEN 'Item "' || coalesce(title, 'undefined') || '" missing location information' END,
      CASE WHEN NOT {_truthy('startDate')} AND NOT {_truthy('endDate')} AND len(coalesce(dates, [])) = 0
           THEN 'Item "' || coalesce(title, 'undefined') || '" missing date information' END
    ], lambda x: x IS NOT NULL) AS warns
  FROM norm_items
),
extv AS (
  SELECT run_key, count(*) AS n_items, count(*) FILTER (WHERE len(errs) = 0) AS valid_items,
         sum(len(errs)) AS n_errors, sum(len(warns)) AS n_warnings,
         count(*) FILTER (WHERE len(errs) = 0) / count(*) AS completeness_score
  FROM ext GROUP BY run_key
)"""


@register("extraction_validate", oracle=f"""
WITH {SQL_RUN_ITEMS}, {SQL_EXT_ERRORS}
SELECT run_key, n_items, valid_items, n_errors, n_warnings, round(completeness_score, 9) AS completeness_score,
       n_errors = 0 AS is_valid FROM extv""")
def extraction_validate(spark, sf_dir):
    n = X.item_normalize_basic(_items_run(spark, sf_dir), now=F.lit(None).cast("string"))
    return X.extraction_validate(n, "run_key").withColumn(
        "completeness_score", F.round("completeness_score", 9))


def _acc_sql():
    opt = " + ".join(f"(CASE WHEN {_truthy(f)} THEN 1 ELSE 0 END)" for f in X.ACCURACY_OPTIONALS)
    return (f"((CASE WHEN {_truthy('title')} THEN 2 ELSE 0 END) + (CASE WHEN {_truthy('description')} THEN 2 ELSE 0 END)"
            f" + {opt}) / 11.0e0")


@register("accuracy_score", oracle=f"""
WITH {SQL_RUN_ITEMS}
SELECT run_key, round(coalesce(avg({_acc_sql()}), 0), 9) AS accuracy_score FROM run_items GROUP BY run_key""")
def accuracy_score(spark, sf_dir):
    return _items_run(spark, sf_dir).groupBy("run_key").agg(
        F.round(F.coalesce(F.avg(X.item_accuracy()), F.lit(0.0)), 9).alias("accuracy_score"))


def _confidence(spark, sf_dir):
    n = X.item_normalize_basic(_items_run(spark, sf_dir), now=F.lit(None).cast("string"))
    v = X.extraction_validate(n, "run_key")
    acc = n.groupBy("run_key").agg(F.avg(X.item_accuracy()).alias("acc"))
    return v.join(acc, "run_key").select("run_key", X.test_confidence(
        F.col("n_items"), F.col("n_errors"), F.col("acc")).alias("test_confidence"))


@register("test_confidence", oracle=f"""
WITH {SQL_RUN_ITEMS}, {SQL_EXT_ERRORS},
acc AS (SELECT run_key, avg({_acc_sql()}) AS acc FROM norm_items GROUP BY run_key)
SELECT run_key, round(CASE WHEN n_errors > 0 OR n_items = 0 THEN 0.0e0
                           ELSE acc * least(n_items / 3.0e0, 1.0e0) END, 9) AS test_confidence
FROM extv JOIN acc USING (run_key)""")
def test_confidence(spark, sf_dir):
    return _confidence(spark, sf_dir).withColumn("test_confidence", F.round("test_confidence", 9))


@register("run_metrics", oracle=f"""
WITH {SQL_RUN_ITEMS},
pg AS (SELECT run_key, count(*) AS pages_processed,
              count(*) FILTER (WHERE {_truthy('title')}) AS successful_pages,
              count(*) FILTER (WHERE NOT {_truthy('title')}) AS errors_encountered
       FROM run_items GROUP BY run_key),
it AS (SELECT run_key, count(*) AS items_extracted, avg({_acc_sql()}) AS accuracy_score
       FROM run_items WHERE {_truthy('title')} GROUP BY run_key)
SELECT run_key, coalesce(items_extracted, 0) AS items_extracted, pages_processed, successful_pages,
       errors_encountered, round(coalesce(accuracy_score, 0.0e0), 9) AS accuracy_score
FROM pg LEFT JOIN it USING (run_key)""")
def run_metrics(spark, sf_dir):
    it = _items_run(spark, sf_dir)
    has = X._truthy(F.col("title"))
    pg = it.select("run_key", "item_id", F.when(has, 1).otherwise(0).alias("n_items"))
    m = X.run_metrics(it.filter(has), pg, "run_key")
    return m.withColumn("accuracy_score", F.round("accuracy_score", 9))


def _dq_sql():
    opt = " + ".join(f"(CASE WHEN {_truthy(f)} THEN 0.5e0 ELSE 0.0e0 END)" for f in X.QUALITY_OPTIONALS)
    return (f"((CASE WHEN title IS NOT NULL AND trim(title) <> '' THEN 1.0e0 ELSE 0.0e0 END) + "
            f"(CASE WHEN description IS NOT NULL AND trim(description) <> '' THEN 1.0e0 ELSE 0.0e0 END) + {opt})")


@register("data_quality", oracle=f"""
WITH {SQL_RUN_ITEMS}
SELECT run_key, round(sum({_dq_sql()}) / (count(*) * 5.0e0), 9) AS data_quality FROM run_items GROUP BY run_key""")
def data_quality(spark, sf_dir):
    return X.data_quality(_items_run(spark, sf_dir), "run_key").withColumn(
        "data_quality", F.round("data_quality", 9))


def _report(spark, sf_dir):
    it = _items_run(spark, sf_dir)
    v = Q.validate_items(it)
    sc = v.groupBy("run_key").agg(
        (F.count_if("is_valid") / F.count("*")).alias("schema_compliance"),
        F.sum(F.when(~F.col("is_valid"), F.size("errors")).otherwise(0) + F.size("warnings")).alias("n_issues"))
    dq = X.data_quality(it, "run_key")
    r = sc.join(dq, "run_key").withColumn(
        "extraction_accuracy", (F.col("schema_compliance") + F.col("data_quality")) / 2)
    return r.withColumn("recommendations", F.array_join(F.array_compact(F.array(
        F.when(F.col("schema_compliance") < 0.8, F.lit("Improve selector accuracy to increase schema compliance")),
        F.when(F.col("data_quality") < 0.7, F.lit("Review data extraction patterns to improve quality")))), " | "))


SQL_REPORT = SQL_VALIDATED + f""",
rv AS (SELECT v.*, {D.host('i.sourceUrl')} AS run_key FROM validated v JOIN items i USING (item_id)),
sc AS (SELECT run_key, count(*) FILTER (WHERE is_valid) / count(*) AS schema_compliance,
              sum(CASE WHEN NOT is_valid THEN len(errors) ELSE 0 END + len(warnings)) AS n_issues
       FROM rv GROUP BY run_key),
dq AS (SELECT {D.host('sourceUrl')} AS run_key, sum({_dq_sql()}) / (count(*) * 5.0e0) AS data_quality
       FROM items GROUP BY 1),
rep AS (SELECT run_key, schema_compliance, n_issues, data_quality,
               (schema_compliance + data_quality) / 2 AS extraction_accuracy
        FROM sc JOIN dq USING (run_key))"""


@register("validation_report", oracle=f"""
WITH {SQL_REPORT}
SELECT run_key, round(schema_compliance, 9) AS schema_compliance, round(data_quality, 9) AS data_quality,
       round(extraction_accuracy, 9) AS extraction_accuracy, n_issues,
       array_to_string(list_filter([
         CASE WHEN schema_compliance < 0.8 THEN 'Improve selector accuracy to increase schema compliance' END,
         CASE WHEN data_quality < 0.7 THEN 'Review data extraction patterns to improve quality' END],
         lambda x: x IS NOT NULL), ' | ') AS recommendations
FROM rep""")
def validation_report(spark, sf_dir):
    r = _report(spark, sf_dir)
    return r.select("run_key", *[F.round(c, 9).alias(c) for c in ["schema_compliance", "data_quality",
                                                                   "extraction_accuracy"]],
                    "n_issues", "recommendations")


@register("overall_confidence", oracle=f"""
WITH {SQL_REPORT}, {SQL_RUN_ONLY}, {SQL_EXT_ERRORS},
acc AS (SELECT run_key, avg({_acc_sql()}) AS acc FROM norm_items GROUP BY run_key),
tc AS (SELECT run_key, CASE WHEN n_errors > 0 OR n_items = 0 THEN 0.0e0
                            ELSE acc * least(n_items / 3.0e0, 1.0e0) END AS tc
       FROM extv JOIN acc USING (run_key))
SELECT run_key, round(tc * 0.6e0 + extraction_accuracy * 0.4e0, 9) AS overall_confidence
FROM tc JOIN rep USING (run_key)""")
def overall_confidence(spark, sf_dir):
    r = _report(spark, sf_dir)
    t = _confidence(spark, sf_dir)
    return t.join(r, "run_key").select(
        "run_key", F.round(F.col("test_confidence") * 0.6 + F.col("extraction_accuracy") * 0.4, 9)
        .alias("overall_confidence"))


@register("items_per_page_cap", oracle=f"""
WITH {SQL_RUN_ITEMS}
SELECT run_key, item_id FROM (
  SELECT run_key, item_id, row_number() OVER (PARTITION BY run_key ORDER BY item_id) AS rn FROM run_items)
WHERE rn <= 5""")
def items_per_page_cap(spark, sf_dir):
    return X.items_per_page_cap(_items_run(spark, sf_dir).select("run_key", "item_id"), "run_key", "item_id", 5)


SQL_CONTENT_JOIN = f"""
tgt AS (SELECT {D.normalize('url')} AS k, max(page_id) AS content_page_id FROM pages GROUP BY 1),
cj AS (
  SELECT l.page_id, l.pos, l.url, t.content_page_id, t.content_page_id IS NOT NULL AS success,
         CASE WHEN t.content_page_id IS NULL THEN 'No content extracted' END AS error
  FROM links_dd l LEFT JOIN tgt t ON {D.normalize('l.url')} = t.k
)"""


def _content_join(spark, sf_dir):
    p = pages(spark, sf_dir)
    lk = L.link_dedupe(L.resolved_links(S.linked_pages(spark, sf_dir)))
    return X.content_page_join(lk.select("page_id", "pos", "url"), p.select("page_id", "url"))


@register("content_page_join", oracle=f"""
WITH {SQL_LINKS}, {SQL_CONTENT_JOIN}
SELECT page_id, pos, url, content_page_id, success, error FROM cj""")
def content_page_join(spark, sf_dir):
    return _content_join(spark, sf_dir).select("page_id", "pos", "url", "content_page_id", "success", "error")


@register("page_results_rollup", oracle=f"""
WITH {SQL_LINKS}, {SQL_CONTENT_JOIN}
SELECT page_id, count(*) AS n_content, count(*) FILTER (WHERE success) AS n_success,
       bool_or(success) AS page_success FROM cj GROUP BY page_id""")
def page_results_rollup(spark, sf_dir):
    return _content_join(spark, sf_dir).groupBy("page_id").agg(
        F.count("*").alias("n_content"), F.count_if("success").alias("n_success"),
        F.bool_or("success").alias("page_success"))


@register("content_coverage", oracle=f"""
WITH {SQL_LINKS}, {SQL_CONTENT_JOIN},
firstk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rn FROM cj) WHERE rn <= 10)
SELECT page_id, count(*) AS analyzed_urls, count(*) FILTER (WHERE success) AS successful_fetches,
       count(*) FILTER (WHERE success) > 0 AS has_content FROM firstk GROUP BY page_id""")
def content_coverage(spark, sf_dir):
    """Requested vs fetched content URLs: the first 10 per page, joined to
    the snapshot; pages without any fetched URL get confidence 0."""
    j = X.items_per_page_cap(_content_join(spark, sf_dir), "page_id", "pos", 10)
    return j.groupBy("page_id").agg(
        F.count("*").alias("analyzed_urls"), F.count_if("success").alias("successful_fetches"),
        (F.count_if("success") > 0).alias("has_content"))


@register("item_clean", oracle=f"""
WITH {SQL_ITEMS}
SELECT item_id,
  CASE WHEN {_truthy('title')} THEN substring(trim(regexp_replace(regexp_replace(title, '\\s+', ' ', 'g'), '[\\r\\n\\t]', ' ', 'g')), 1, 500) END AS title,
  md5(CASE WHEN {_truthy('description')} THEN substring(trim(regexp_replace(regexp_replace(description, '\\s+', ' ', 'g'), '[\\r\\n\\t]', ' ', 'g')), 1, 500) END) AS description_md5,
  CASE WHEN {_truthy('email')} AND regexp_matches(trim(email), {D.q(Q.EMAIL_RE)}) THEN trim(email) END AS email,
  CASE WHEN {_truthy('phone')} THEN trim(regexp_replace(phone, '[^\\d\\+\\-\\(\\)\\s]', '', 'g')) END AS phone,
  CASE WHEN {_truthy('website')} AND {D.valid('website')} THEN website END AS website,
  {_iso(_sandbox_date_sql())} AS startDate
FROM items""")
def item_clean(spark, sf_dir):
    c = X.item_clean(S.items(spark, sf_dir))
    return c.select("item_id", "title", F.md5("description").alias("description_md5"), "email", "phone",
                    "website", "startDate")


@register("field_parsers", oracle=f"""
SELECT doc_id,
  CASE WHEN {_truthy('text')} AND regexp_extract(text, {D.q(X.PRICE_RE)}, 0) <> ''
       THEN {_float_prefix_sql(f"regexp_replace(regexp_extract(text, {D.q(X.PRICE_RE)}, 0), '^([^,]*),', '\\1')")} END AS price,
  CASE WHEN {_truthy('text')} AND regexp_extract(text, {D.q(X.COORD_RE)}, 0) <> ''
       THEN (CASE WHEN starts_with(regexp_extract(text, {D.q(X.COORD_RE)}, 0), '-') THEN -1 ELSE 1 END)
            * {_float_prefix_sql(f"regexp_replace(regexp_extract(text, {D.q(X.COORD_RE)}, 0), '^-', '')")} END AS coordinate,
  CASE WHEN {_truthy('text')} AND regexp_extract(text, {D.q(X.ZIP_RE)}, 0) <> ''
       THEN TRY_CAST(regexp_extract(text, {D.q(X.ZIP_RE)}, 0) AS INTEGER) END AS zipcode,
  nullif(regexp_extract(text, {D.q(X.EMAIL_FIND_RE)}, 0), '') AS email,
  nullif(regexp_extract(text, {D.q(X.PHONE_FIND_RE)}, 0), '') AS phone
FROM documents""")
def field_parsers(spark, sf_dir):
    """Field parsers of the extractors (price, coordinate, zip code, e-mail,
    phone) applied to document text."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", X.parse_price("text").alias("price"), X.parse_coordinate("text").alias("coordinate"),
        X.parse_zipcode("text").alias("zipcode"),
        F.nullif(F.regexp_extract("text", X.EMAIL_FIND_RE, 0), F.lit("")).alias("email"),
        F.nullif(F.regexp_extract("text", X.PHONE_FIND_RE, 0), F.lit("")).alias("phone"))
