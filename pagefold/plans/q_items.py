"""Registered item-validation and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefold.operators import quality as Q
from pagefold.plans import duck as D
from pagefold.plans.catalog import register
from pagefold.sources import derived as S

# ---------------------------------------------------------------- DuckDB side


def _text_of(e: str) -> str:
    return f"trim({D.rx_replace(D.strip_tags(e), chr(92) + 's+', ' ')})"


def _first_text(h: str, pattern: str) -> str:
    return f"CASE WHEN regexp_matches({h}, {D.q(pattern)}) THEN {_text_of(f'regexp_extract({h}, {D.q(pattern)}, 1)')} END"


SQL_PAGE_ITEMS = f"""
page_items AS (
  SELECT page_id AS item_id,
         {_first_text('html', S.H1_RE)} AS title,
         {_first_text('html', S.ARTICLE_RE)} AS description,
         nullif(regexp_extract(html, {D.q(S.LANG_RE)}, 1), '') AS language,
         regexp_extract_all(html, {D.q(S.IMG_RE)}, 1) AS images,
         nullif(regexp_extract(html, {D.q(S.FOOTER_HOST_RE)}, 1), '') AS website,
         url AS sourceUrl
  FROM pages
)"""

SQL_END = ("(CASE WHEN contains(p.sourceUrl, '.org') THEN strftime(l.l_shipdate, '%Y-%m-%dT00:00:00.000Z') "
           "ELSE strftime(l.l_shipdate, '%Y-%m-%d') END)")

SQL_ITEMS = SQL_PAGE_ITEMS + f""",
items AS (
  SELECT p.item_id,
         CASE WHEN p.item_id % 17 = 3 AND NOT contains(p.sourceUrl, '.org') THEN NULL WHEN p.item_id % 17 = 5 THEN ' a '
              WHEN p.item_id % 17 = 7 THEN repeat(p.title || ' ', 60) ELSE p.title END AS title,
         CASE WHEN p.item_id % 4 = 0 THEN 'Ort ' || CAST(p.item_id AS VARCHAR) END AS place,
         CASE WHEN p.item_id % 19 <> 1 OR contains(p.sourceUrl, '.org') THEN p.description END AS description,
         CAST(NULL AS VARCHAR) AS address,
         CASE WHEN p.item_id % 13 = 2 THEN ' Not-an-Email '
              ELSE nullif(regexp_extract(d.text, {D.q(S.EMAIL_FIND_RE)}, 0), '') END AS email,
         nullif(regexp_extract(d.text, {D.q(S.PHONE_FIND_RE)}, 0), '') AS phone,
         CASE p.item_id % 13 WHEN 4 THEN 'http://' WHEN 6 THEN 'bad host/x' ELSE p.website END AS website, l.l_extendedprice AS price,
         CASE WHEN l.l_returnflag = 'R' THEN l.l_extendedprice * (1 + l.l_tax)
              ELSE l.l_extendedprice * (1 - l.l_discount) END AS discountPrice,
         c.c_acctbal / 50 AS longitude,
         CASE WHEN p.item_id % 3 <> 0 THEN c.c_acctbal / 120 END AS latitude,
         CASE WHEN contains(p.sourceUrl, '.org') THEN strftime(o.o_orderdate, '%Y-%m-%dT00:00:00.000Z')
              WHEN p.item_id % 29 = 0 THEN '01.01.1800'
              WHEN p.item_id % 7 = 0 THEN '31.02.' || strftime(o.o_orderdate, '%Y')
              WHEN p.item_id % 2 = 0 THEN strftime(o.o_orderdate, '%d.%m.%Y')
              ELSE strftime(o.o_orderdate, '%Y-%m-%d') END AS startDate,
         {SQL_END} AS endDate,
         CASE WHEN l.l_shipdate IS NULL THEN []
              WHEN p.item_id % 23 = 0 AND NOT contains(p.sourceUrl, '.org') THEN [{SQL_END}, '99.99.2020']
              ELSE [{SQL_END}] END AS dates,
         CAST(NULL AS VARCHAR) AS createdAt,
         CAST((o.o_custkey * 97) % 120000 AS INTEGER) AS zipcode,
         list_concat(list_concat(p.images,
           CASE WHEN p.item_id % 5 = 0 THEN ['/img/' || CAST(p.item_id AS VARCHAR) || '.jpg'] ELSE [] END),
           CASE WHEN p.item_id % 10 = 0 THEN ['http://'] ELSE [] END) AS images,
         CASE WHEN p.item_id % 31 <> 0 THEN p.language END AS language, p.sourceUrl
  FROM page_items p
  LEFT JOIN documents d ON d.doc_id = p.item_id
  LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS rn FROM lineitem) WHERE rn = 1) l ON l.l_orderkey = p.item_id
  LEFT JOIN orders o ON o.o_orderkey = p.item_id
  LEFT JOIN customer c ON c.c_custkey = o.o_custkey
)"""


def _parse_date(s: str) -> str:
    t = f"trim({s})"
    iso_dt = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,3}))?Z$"

    def g(p, i):
        return f"regexp_extract({t}, {D.q(p)}, {i})"
    frac = g(iso_dt, 7)
    ts_text = (f"CASE WHEN regexp_matches({t}, {D.q(iso_dt)}) THEN {g(iso_dt, 1)} || '-' || {g(iso_dt, 2)} || '-' || "
               f"{g(iso_dt, 3)} || ' ' || {g(iso_dt, 4)} || ':' || {g(iso_dt, 5)} || ':' || {g(iso_dt, 6)} || '.' || "
               f"rpad(CASE WHEN {frac} = '' THEN '0' ELSE {frac} END, 3, '0') END")
    forms = [(r"^(\d{4})-(\d{1,2})-(\d{1,2})$", 1, 2, 3), (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", 3, 2, 1),
             (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 3, 2, 1), (r"^(\d{1,2})-(\d{1,2})-(\d{4})$", 3, 2, 1),
             (r"^(\d{4})/(\d{1,2})/(\d{1,2})$", 1, 2, 3)]
    whens = " ".join(
        f"WHEN regexp_matches({t}, {D.q(p)}) THEN {g(p, y)} || '-' || lpad({g(p, m)}, 2, '0') || '-' || "
        f"lpad({g(p, d)}, 2, '0') || ' 00:00:00.000'" for p, y, m, d in forms)
    return f"try_strptime(coalesce({ts_text}, CASE {whens} END), '%Y-%m-%d %H:%M:%S.%g')"


def _iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def _detect(title: str, desc: str) -> str:
    text = f"lower(coalesce({title}, '') || ' ' || coalesce({desc}, ''))"
    de = " + ".join(f"(CASE WHEN contains({text}, {D.q(w)}) THEN 1 ELSE 0 END)" for w in Q.GERMAN_WORDS)
    de = f"({de} + CASE WHEN regexp_matches({text}, '[äöüß]') THEN 3 ELSE 0 END)"
    en = "(" + " + ".join(f"(CASE WHEN contains({text}, {D.q(w)}) THEN 1 ELSE 0 END)" for w in Q.ENGLISH_WORDS) + ")"
    return f"(CASE WHEN trim({text}) = '' THEN NULL WHEN {de} > {en} THEN 'de' WHEN {en} > {de} THEN 'en' END)"


def _truthy(c: str) -> str:
    return f"({c} IS NOT NULL AND {c} <> '')"


def _num(c: str) -> str:
    return f"regexp_replace(CAST({c} AS VARCHAR), '\\.0$', '')"


def _filled(f: str) -> str:
    c = f"n_{f}"
    if f in ("dates", "images"):
        return f"coalesce(len({c}) > 0, false)"
    if f in ("price", "discountPrice", "longitude", "latitude", "zipcode"):
        return f"({c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE)))"
    return f"({c} IS NOT NULL AND trim({c}) <> '')"


EMAIL = D.q(Q.EMAIL_RE)
NOW_YEAR = "year(current_date)"

SQL_VALIDATED = SQL_ITEMS + f""",
v0 AS (
  SELECT *,
    CASE WHEN {_truthy('startDate')} AND trim(startDate) <> '' THEN {_parse_date('startDate')} END AS ts_s,
    CASE WHEN {_truthy('endDate')} AND trim(endDate) <> '' THEN {_parse_date('endDate')} END AS ts_e,
    CASE WHEN {_truthy('createdAt')} AND trim(createdAt) <> '' THEN {_parse_date('createdAt')} END AS ts_c,
    list_transform(list_filter(coalesce(dates, []), lambda d: d IS NOT NULL AND trim(d) <> ''),
                   lambda d: {{'raw': trim(d), 'ts': {_parse_date('d')}}}) AS dts,
    {_detect('title', 'description')} AS detected,
    CASE WHEN starts_with(trim(website), 'http://') OR starts_with(trim(website), 'https://') THEN trim(website)
         ELSE 'https://' || trim(website) END AS site_full,
    regexp_replace(phone, '[\\s\\-\\(\\)\\+]', '', 'g') AS phone_clean,
    CASE WHEN {_truthy('email')} THEN lower(trim(email)) ELSE email END AS n_email
  FROM items
),
img0 AS (
  SELECT item_id, sourceUrl AS base, idx, trim(raw) AS raw FROM (
    SELECT item_id, sourceUrl, unnest(range(len(images))) AS idx, unnest(images) AS raw FROM items)
  WHERE raw IS NOT NULL AND trim(raw) <> ''
),
img1 AS (SELECT *, {D.resolve_join('raw', 'base')} AS j FROM img0),
img2 AS (SELECT *, {D.canonical('j')} AS c FROM img1),
img3 AS (
  SELECT item_id, idx, raw,
         CASE WHEN {D.valid('raw')} THEN raw WHEN base IS NOT NULL THEN {D.resolve_final('raw', 'j', 'c')} END AS abs,
         (NOT {D.valid('raw')} AND base IS NULL) AS no_base
  FROM img2
),
img4 AS (
  SELECT item_id, idx, raw, abs, no_base, (abs IS NOT NULL AND {D.valid('abs')}) AS abs_ok FROM img3
),
imgs AS (
  SELECT item_id,
         list(abs ORDER BY idx) FILTER (WHERE abs_ok) AS n_images,
         list(CASE WHEN no_base THEN 'Cannot convert relative URL to absolute: "' || raw || '" (no base URL provided)'
                   ELSE 'Invalid image URL: "' || raw || '"' END ORDER BY idx)
           FILTER (WHERE no_base OR (abs IS NOT NULL AND NOT abs_ok)) AS img_warn
  FROM img4 GROUP BY item_id
),
v1 AS (
  SELECT v0.*, coalesce(imgs.n_images, []) AS n_images, coalesce(imgs.img_warn, []) AS img_warn,
         {D.valid('site_full')} AS site_ok, {D.canonical('site_full')} AS site_canon,
         regexp_matches(phone_clean, '^\\d{{7,15}}$') AS phone_ok
  FROM v0 LEFT JOIN imgs USING (item_id)
),
v2 AS (
  SELECT item_id,
    CASE WHEN {_truthy('title')} THEN trim(title) ELSE title END AS n_title,
    CASE WHEN {_truthy('description')} THEN trim(description) ELSE description END AS n_description,
    CASE WHEN NOT {_truthy('language')} THEN coalesce(detected, language) ELSE language END AS n_language,
    place AS n_place, address AS n_address, n_email,
    CASE WHEN {_truthy('phone')} AND phone_ok THEN phone_clean ELSE phone END AS n_phone,
    CASE WHEN {_truthy('website')} AND site_ok THEN site_canon ELSE website END AS n_website,
    price AS n_price, discountPrice AS n_discountPrice, longitude AS n_longitude, latitude AS n_latitude,
    {_iso('ts_s')} AS n_startDate, {_iso('ts_e')} AS n_endDate, {_iso('ts_c')} AS n_createdAt,
    list_transform(list_filter(dts, lambda d: d.ts IS NOT NULL), lambda d: {_iso('d.ts')}) AS n_dates,
    zipcode AS n_zipcode, n_images,
    list_concat(
      list_filter([
        CASE WHEN title IS NULL OR trim(title) = '' THEN 'Required field ''title'' is missing or empty' END,
        CASE WHEN description IS NULL OR trim(description) = '' THEN 'Required field ''description'' is missing or empty' END,
        CASE WHEN language IS NULL OR trim(language) = '' THEN 'Required field ''language'' is missing or empty' END,
        CASE WHEN {_truthy('startDate')} AND trim(startDate) <> '' AND ts_s IS NULL THEN 'Invalid date format: "' || trim(startDate) || '"' END,
        CASE WHEN {_truthy('endDate')} AND trim(endDate) <> '' AND ts_e IS NULL THEN 'Invalid date format: "' || trim(endDate) || '"' END,
        CASE WHEN {_truthy('createdAt')} AND trim(createdAt) <> '' AND ts_c IS NULL THEN 'Invalid date format: "' || trim(createdAt) || '"' END
      ], lambda x: x IS NOT NULL),
      list_transform(list_filter(dts, lambda d: d.ts IS NULL), lambda d: 'Invalid date format: "' || d.raw || '"'),
      list_filter([
        CASE WHEN NOT {_truthy('language')} AND detected IS NULL THEN 'Language not specified and could not be auto-detected'
             WHEN {_truthy('language')} AND language NOT IN ('de', 'en') THEN 'Invalid language code: ''' || language || '''. Must be ''de'' or ''en''' END
      ], lambda x: x IS NOT NULL)
    ) AS errors,
    list_concat(
      list_filter([
        CASE WHEN {_truthy('title')} AND length(trim(title)) > 500 THEN 'Title is very long (>500 characters)' END,
        CASE WHEN {_truthy('title')} AND length(trim(title)) < 3 THEN 'Title is very short (<3 characters)' END,
        CASE WHEN {_truthy('description')} AND length(trim(description)) > 5000 THEN 'Description is very long (>5000 characters)' END,
        CASE WHEN ts_s IS NOT NULL AND abs({NOW_YEAR} - year(ts_s)) > 100 THEN 'Date seems unrealistic: ' || {_iso('ts_s')} END,
        CASE WHEN ts_e IS NOT NULL AND abs({NOW_YEAR} - year(ts_e)) > 100 THEN 'Date seems unrealistic: ' || {_iso('ts_e')} END,
        CASE WHEN ts_c IS NOT NULL AND abs({NOW_YEAR} - year(ts_c)) > 100 THEN 'Date seems unrealistic: ' || {_iso('ts_c')} END
      ], lambda x: x IS NOT NULL),
      list_transform(list_filter(dts, lambda d: d.ts IS NOT NULL AND abs({NOW_YEAR} - year(d.ts)) > 100),
                     lambda d: 'Date seems unrealistic: ' || {_iso('d.ts')}),
      list_filter([CASE WHEN ts_s IS NOT NULL AND ts_e IS NOT NULL AND ts_s > ts_e THEN 'Start date is after end date' END],
                  lambda x: x IS NOT NULL),
      img_warn,
      list_filter([
        CASE WHEN NOT {_truthy('language')} AND detected IS NOT NULL THEN 'Language auto-detected as ''' || detected || '''' END,
        CASE WHEN {_truthy('email')} AND NOT regexp_matches(n_email, {EMAIL}) THEN 'Invalid email format: "' || n_email || '"' END,
        CASE WHEN {_truthy('phone')} AND NOT phone_ok THEN 'Phone number format may be invalid: "' || phone || '"' END,
        CASE WHEN {_truthy('website')} AND NOT site_ok THEN 'Invalid website URL: "' || website || '"' END,
        CASE WHEN longitude IS NOT NULL AND (longitude < -180 OR longitude > 180) THEN 'Invalid longitude value: ' || {_num('longitude')} END,
        CASE WHEN latitude IS NOT NULL AND (latitude < -90 OR latitude > 90) THEN 'Invalid latitude value: ' || {_num('latitude')} END,
        CASE WHEN price IS NOT NULL AND price < 0 THEN 'Invalid price value: ' || {_num('price')} END,
        CASE WHEN discountPrice IS NOT NULL AND discountPrice < 0 THEN 'Invalid discount price value: ' || {_num('discountPrice')} END,
        CASE WHEN discountPrice IS NOT NULL AND price IS NOT NULL AND discountPrice > price THEN 'Discount price is higher than regular price' END,
        CASE WHEN zipcode IS NOT NULL AND (zipcode < 0 OR zipcode > 99999) THEN 'Invalid zipcode value: ' || CAST(zipcode AS VARCHAR) END
      ], lambda x: x IS NOT NULL)
    ) AS warnings
  FROM v1
),
v3 AS (
  SELECT *,
    ({' + '.join(f"(CASE WHEN {_filled(f)} THEN {2 if f in Q.REQUIRED else 1} ELSE 0 END)" for f in Q.COMPLETENESS_FIELDS)}) / 21.0e0 AS completeness,
    CASE WHEN a_total > 0 THEN a_pass / a_total ELSE 1.0e0 END AS accuracy,
    CASE WHEN k_total > 0 THEN k_pass / k_total ELSE 1.0e0 END AS consistency
  FROM (SELECT *,
    (CASE WHEN n_startDate IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN n_endDate IS NOT NULL THEN 1 ELSE 0 END)
    + (CASE WHEN n_createdAt IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN {_truthy('n_email')} THEN 1 ELSE 0 END)
    + (CASE WHEN {_truthy('n_website')} THEN 1 ELSE 0 END) + (CASE WHEN n_longitude IS NOT NULL THEN 1 ELSE 0 END)
    + (CASE WHEN n_latitude IS NOT NULL THEN 1 ELSE 0 END) + len(n_images) AS a_total,
    (CASE WHEN n_startDate IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN n_endDate IS NOT NULL THEN 1 ELSE 0 END)
    + (CASE WHEN n_createdAt IS NOT NULL THEN 1 ELSE 0 END)
    + (CASE WHEN {_truthy('n_email')} AND regexp_matches(n_email, {EMAIL}) THEN 1 ELSE 0 END)
    + (CASE WHEN {_truthy('n_website')} AND {D.valid('n_website')} THEN 1 ELSE 0 END)
    + (CASE WHEN n_longitude IS NOT NULL AND n_longitude >= -180 AND n_longitude <= 180 THEN 1 ELSE 0 END)
    + (CASE WHEN n_latitude IS NOT NULL AND n_latitude >= -90 AND n_latitude <= 90 THEN 1 ELSE 0 END)
    + len(list_filter(n_images, lambda i: {D.valid('i')})) AS a_pass,
    (CASE WHEN n_startDate IS NOT NULL AND n_endDate IS NOT NULL THEN 1 ELSE 0 END)
    + (CASE WHEN n_price IS NOT NULL AND n_discountPrice IS NOT NULL THEN 1 ELSE 0 END)
    + (CASE WHEN n_longitude IS NOT NULL OR n_latitude IS NOT NULL THEN 1 ELSE 0 END) AS k_total,
    (CASE WHEN n_startDate IS NOT NULL AND n_endDate IS NOT NULL AND n_startDate <= n_endDate THEN 1 ELSE 0 END)
    + (CASE WHEN n_price IS NOT NULL AND n_discountPrice IS NOT NULL AND n_discountPrice <= n_price THEN 1 ELSE 0 END)
    + (CASE WHEN n_longitude IS NOT NULL AND n_latitude IS NOT NULL THEN 1 ELSE 0 END) AS k_pass
  FROM v2)
),
validated AS (
  SELECT *, floor((completeness * 0.4e0 + accuracy * 0.4e0 + consistency * 0.2e0) * 100.0e0 + 0.5e0) / 100.0e0 AS quality_score,
         len(errors) = 0 AS is_valid
  FROM v3
)"""


# ----------------------------------------------------------------- Spark side


def _validated(spark, sf_dir):
    return Q.validate_items(S.items(spark, sf_dir))


def _joined(col):
    return F.array_join(F.transform(col, lambda m: m["message"]), " | ")


@register("extract_detail", oracle=f"""
WITH {SQL_PAGE_ITEMS}
SELECT item_id, title, description, coalesce(language, 'de') AS language, len(images) AS n_images, sourceUrl
FROM page_items WHERE title IS NOT NULL AND title <> ''""")
def extract_detail(spark, sf_dir):
    """One record per content page: h1 title, article text, language
    (default 'de'), images; title required."""
    from pagefold.sources.tables import pages
    p = S.page_items(pages(spark, sf_dir))
    return p.filter((F.col("title").isNotNull()) & (F.col("title") != "")).select(
        "item_id", "title", "description", F.coalesce("language", F.lit("de")).alias("language"),
        F.size("images").alias("n_images"), "sourceUrl")


NORMALIZED = ("n_title", "n_language", "n_email", "n_phone", "n_website", "n_startDate", "n_endDate")


@register("validate_items", oracle=f"""
WITH {SQL_VALIDATED}
SELECT item_id, is_valid, len(errors) AS n_errors, len(warnings) AS n_warnings,
       array_to_string(errors, ' | ') AS errors, array_to_string(warnings, ' | ') AS warnings,
       quality_score, {', '.join(f"CASE WHEN is_valid THEN {c} END AS {c}" for c in NORMALIZED)},
       CASE WHEN is_valid THEN array_to_string(n_dates, ',') END AS n_dates,
       CASE WHEN is_valid THEN array_to_string(n_images, ',') END AS n_images
FROM validated""")
def validate_items(spark, sf_dir):
    """Verdict per item; the normalized fields of valid items only."""
    v = _validated(spark, sf_dir)
    return v.select(
        "item_id", "is_valid", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"),
        _joined("errors").alias("errors"), _joined("warnings").alias("warnings"), "quality_score",
        *[F.when(F.col("is_valid"), F.col(c)).alias(c) for c in NORMALIZED],
        F.when(F.col("is_valid"), F.array_join("n_dates", ",")).alias("n_dates"),
        F.when(F.col("is_valid"), F.array_join("n_images", ",")).alias("n_images"))


def _field_query(name, cols_sql, spark_cols):
    """Register a projection of the validated items; ``spark_cols`` is a
    function returning the columns (built lazily, inside a session)."""
    @register(name, oracle=f"WITH {SQL_VALIDATED} SELECT item_id, {cols_sql} FROM validated")
    def q(spark, sf_dir):
        return _validated(spark, sf_dir).select("item_id", *spark_cols())
    return q


def _msgs_sql(kind: str, prefix_sql: str) -> str:
    return f"array_to_string(list_filter({kind}, lambda m: {prefix_sql}), ' | ')"


def _msgs(kind: str, pred) -> F.Column:
    return F.array_join(F.transform(F.filter(kind, pred), lambda m: m["message"]), " | ")


_field_query(
    "chk_required",
    "array_to_string(list_filter(errors, lambda m: starts_with(m, 'Required field')), ' | ') AS required_errors", lambda:
    [_msgs("errors", lambda m: m["message"].startswith("Required field")).alias("required_errors")])
_field_query(
    "norm_title", f"n_title, {_msgs_sql('warnings', 'starts_with(m, ' + chr(39) + 'Title' + chr(39) + ')')} AS title_warnings", lambda:
    ["n_title", _msgs("warnings", lambda m: m["field"] == "title").alias("title_warnings")])
_field_query(
    "norm_description",
    f"md5(n_description) AS description_md5, {_msgs_sql('warnings', 'starts_with(m, ' + chr(39) + 'Description' + chr(39) + ')')} AS description_warnings", lambda:
    [F.md5("n_description").alias("description_md5"),
     _msgs("warnings", lambda m: m["field"] == "description").alias("description_warnings")])
_field_query(
    "norm_dates",
    "n_startDate, n_endDate, n_createdAt, array_to_string(n_dates, ',') AS n_dates, "
    "array_to_string(list_filter(errors, lambda m: starts_with(m, 'Invalid date')), ' | ') AS date_errors, "
    "array_to_string(list_filter(warnings, lambda m: starts_with(m, 'Date seems') OR starts_with(m, 'Start date')), ' | ') AS date_warnings", lambda:
    ["n_startDate", "n_endDate", "n_createdAt", F.array_join("n_dates", ",").alias("n_dates"),
     _msgs("errors", lambda m: m["message"].startswith("Invalid date")).alias("date_errors"),
     _msgs("warnings", lambda m: m["message"].startswith("Date seems") | m["message"].startswith("Start date"))
     .alias("date_warnings")])
_field_query(
    "norm_images",
    "array_to_string(n_images, ',') AS n_images, "
    "array_to_string(list_filter(warnings, lambda m: starts_with(m, 'Cannot convert') OR starts_with(m, 'Invalid image')), ' | ') AS image_warnings", lambda:
    [F.array_join("n_images", ",").alias("n_images"), _msgs("warnings", lambda m: m["field"] == "images").alias("image_warnings")])
_field_query(
    "norm_language",
    "n_language, array_to_string(list_filter(list_concat(errors, warnings), lambda m: contains(m, 'anguage')), ' | ') AS language_messages", lambda:
    ["n_language", _msgs(F.concat(F.transform("errors", lambda e: F.struct(e["field"].alias("field"), e["message"].alias("message"))),
                                  F.transform("warnings", lambda e: F.struct(e["field"].alias("field"), e["message"].alias("message")))),
                         lambda m: m["field"] == "language").alias("language_messages")])
_field_query(
    "norm_email",
    "n_email, array_to_string(list_filter(warnings, lambda m: starts_with(m, 'Invalid email')), ' | ') AS email_warnings", lambda:
    ["n_email", _msgs("warnings", lambda m: m["field"] == "email").alias("email_warnings")])
_field_query(
    "norm_phone",
    "n_phone, array_to_string(list_filter(warnings, lambda m: starts_with(m, 'Phone number')), ' | ') AS phone_warnings", lambda:
    ["n_phone", _msgs("warnings", lambda m: m["field"] == "phone").alias("phone_warnings")])
_field_query(
    "norm_website",
    "n_website, array_to_string(list_filter(warnings, lambda m: starts_with(m, 'Invalid website')), ' | ') AS website_warnings", lambda:
    ["n_website", _msgs("warnings", lambda m: m["field"] == "website").alias("website_warnings")])
_field_query(
    "chk_coordinates",
    "array_to_string(list_filter(warnings, lambda m: contains(m, 'itude value')), ' | ') AS coordinate_warnings", lambda:
    [_msgs("warnings", lambda m: m["field"].isin("longitude", "latitude")).alias("coordinate_warnings")])
_field_query(
    "chk_prices",
    "array_to_string(list_filter(warnings, lambda m: contains(m, 'price') OR contains(m, 'Discount')), ' | ') AS price_warnings", lambda:
    [_msgs("warnings", lambda m: m["field"].isin("price", "discountPrice")).alias("price_warnings")])
_field_query(
    "chk_zipcode",
    "array_to_string(list_filter(warnings, lambda m: starts_with(m, 'Invalid zipcode')), ' | ') AS zipcode_warnings", lambda:
    [_msgs("warnings", lambda m: m["field"] == "zipcode").alias("zipcode_warnings")])
_field_query("quality_completeness", "round(completeness, 9) AS completeness", lambda:
             [F.round("completeness", 9).alias("completeness")])
_field_query("quality_accuracy", "round(accuracy, 9) AS accuracy", lambda: [F.round("accuracy", 9).alias("accuracy")])
_field_query("quality_consistency", "round(consistency, 9) AS consistency", lambda:
             [F.round("consistency", 9).alias("consistency")])
_field_query("quality_score", "quality_score, is_valid", lambda: ["quality_score", "is_valid"])


@register("detect_language", oracle=f"""
SELECT doc_id, lang, {_detect('NULL', 'text')} AS detected FROM documents""")
def detect_language(spark, sf_dir):
    from pagefold.sources.tables import read_table
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", Q.detect_language(F.lit(None).cast("string"), F.col("text")).alias("detected"))


@register("batch_stats", oracle=f"""
WITH {SQL_VALIDATED},
e AS (SELECT unnest(errors) AS message FROM validated),
w AS (SELECT unnest(warnings) AS message FROM validated),
ec AS (SELECT message, count(*) AS cnt FROM e GROUP BY 1 ORDER BY cnt DESC, message LIMIT 10),
wc AS (SELECT message, count(*) AS cnt FROM w GROUP BY 1 ORDER BY cnt DESC, message LIMIT 10)
SELECT (SELECT count(*) FROM validated) AS total_items,
       (SELECT count(*) FILTER (WHERE is_valid) FROM validated) AS valid_items,
       (SELECT count(*) FILTER (WHERE NOT is_valid) FROM validated) AS invalid_items,
       (SELECT floor(avg(quality_score) * 100.0e0 + 0.5e0) / 100.0e0 FROM validated) AS average_quality_score,
       (SELECT string_agg(message || '=' || CAST(cnt AS VARCHAR), ' | ' ORDER BY cnt DESC, message) FROM ec) AS common_errors,
       (SELECT string_agg(message || '=' || CAST(cnt AS VARCHAR), ' | ' ORDER BY cnt DESC, message) FROM wc) AS common_warnings
""")
def batch_stats(spark, sf_dir):
    return Q.batch_stats(_validated(spark, sf_dir))
