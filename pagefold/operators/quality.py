"""Item validation, normalization and quality scoring.

One ``select`` per item: every check is a column expression, messages are
built with ``array_compact(array(when ...))`` in the reference's order, and
the per-item result has the same shape as the reference's validation result
(``is_valid``, ``errors``, ``warnings``, ``quality_score``, normalized item).
No shuffle: validation is a map-only stage; only ``batch_stats`` aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefold.functions import url as U

# Required fields and the completeness field list (weight 2 for
# required fields, 1 otherwise; 21 in total).
REQUIRED = ["title", "description", "language"]
COMPLETENESS_FIELDS = [
    "title", "description", "language", "place", "address", "email", "phone",
    "website", "price", "discountPrice", "longitude", "latitude", "startDate",
    "endDate", "dates", "createdAt", "zipcode", "images",
]

# Language words (substring presence) and the umlaut bonus.
GERMAN_WORDS = ["der", "die", "das", "und", "ist", "mit", "für", "von", "auf",
                "zu", "im", "am", "über", "nach", "bei", "durch"]
ENGLISH_WORDS = ["the", "and", "is", "with", "for", "from", "on", "to", "in",
                 "at", "over", "after", "by", "through"]
GERMAN_CHARS = "[äöüß]"

EMAIL_RE = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
ISO_OUT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"

ITEM_SCHEMA = (
    "title string, place string, description string, address string, email string, "
    "phone string, website string, price double, discountPrice double, longitude double, "
    "latitude double, startDate string, endDate string, dates array<string>, "
    "createdAt string, zipcode int, images array<string>, language string, sourceUrl string"
)


def _blank(c: Column) -> Column:
    """JS falsy-or-blank for strings."""
    return c.isNull() | (F.trim(c) == "")


def _truthy(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def num_text(c: Column) -> Column:
    """Number as JavaScript prints it for ordinary magnitudes (no '.0')."""
    s = c.cast("string")
    return F.regexp_replace(s, r"\.0$", "")


def parse_date(s: Column) -> Column:
    """Date text -> timestamp (UTC) or NULL.

    Order: ISO date-time with Z, ISO date, then d.M.yyyy, d/M/yyyy,
    d-M-yyyy, yyyy/M/d.  Impossible calendar dates are NULL (no roll-over).
    """
    t = F.trim(s)
    iso_dt = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,3}))?Z$"

    def g(p, i):
        return F.regexp_extract(t, p, i)

    frac = g(iso_dt, 7)
    ts_text = F.when(t.rlike(iso_dt), F.concat(
        g(iso_dt, 1), F.lit("-"), g(iso_dt, 2), F.lit("-"), g(iso_dt, 3), F.lit(" "),
        g(iso_dt, 4), F.lit(":"), g(iso_dt, 5), F.lit(":"), g(iso_dt, 6), F.lit("."),
        F.rpad(F.when(frac == "", F.lit("0")).otherwise(frac), 3, "0")))
    ymd_forms = [  # (pattern, year group, month group, day group)
        (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", 1, 2, 3),
        (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", 3, 2, 1),
        (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 3, 2, 1),
        (r"^(\d{1,2})-(\d{1,2})-(\d{4})$", 3, 2, 1),
        (r"^(\d{4})/(\d{1,2})/(\d{1,2})$", 1, 2, 3),
    ]
    date_text = None
    for p, yi, mi, di in ymd_forms:
        val = F.concat(g(p, yi), F.lit("-"), F.lpad(g(p, mi), 2, "0"), F.lit("-"),
                       F.lpad(g(p, di), 2, "0"), F.lit(" 00:00:00.000"))
        date_text = F.when(t.rlike(p), val) if date_text is None else date_text.when(t.rlike(p), val)
    return F.try_to_timestamp(F.coalesce(ts_text, date_text), F.lit("yyyy-MM-dd HH:mm:ss.SSS"))


def iso(ts: Column) -> Column:
    return F.date_format(ts, ISO_OUT)


def detect_language(title, description) -> Column:
    """``detect_language``: substring presence of word lists, +3 for umlauts;
    tie (or empty text) -> NULL."""
    text = F.lower(F.concat(F.coalesce(U._c(title), F.lit("")), F.lit(" "),
                            F.coalesce(U._c(description), F.lit(""))))

    def body(t):
        de = sum((F.when(t.contains(w), 1).otherwise(0) for w in GERMAN_WORDS), F.lit(0))
        de = de + F.when(t.rlike(GERMAN_CHARS), 3).otherwise(0)
        en = sum((F.when(t.contains(w), 1).otherwise(0) for w in ENGLISH_WORDS), F.lit(0))
        return (F.when(F.trim(t) == "", F.lit(None).cast("string"))
                .when(de > en, F.lit("de")).when(en > de, F.lit("en")))
    # bind the lower-cased text once: it is scanned 31 times
    return U.let(text, body)


def _err(field: str, message: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), message.alias("message"), F.lit("error").alias("severity"))


def _warn(field: str, message: Column, suggestion: str) -> Column:
    return F.struct(F.lit(field).alias("field"), message.alias("message"), F.lit(suggestion).alias("suggestion"))


def _msg(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


class _Recorder:
    """Records ``withColumn`` / ``select`` calls so the (large) validation
    expressions are built once per Spark application and replayed on every
    input -- building them costs thousands of py4j round trips."""

    def __init__(self):
        self.ops = []

    def withColumn(self, name, col):  # noqa: N802 - DataFrame API name
        self.ops.append(("with", name, col))
        return self

    def select(self, *cols):
        self.ops.append(("select", cols))
        return self


_OPS_CACHE: dict = {}


def validate_items(items: DataFrame, base_url: str | None = "sourceUrl") -> DataFrame:
    """``validate_items``: validate + normalize every item (map-only).

    Adds: errors, warnings, is_valid, completeness, accuracy, consistency,
    quality_score and the normalized fields ``n_*``.  ``base_url`` names the
    column used to resolve relative image URLs (None: no base).
    """
    from pyspark import SparkContext
    sc = SparkContext._active_spark_context
    key = (id(sc), sc.applicationId if sc else None, base_url)
    if key not in _OPS_CACHE:
        rec = _Recorder()
        _build_validation(rec, base_url)
        _OPS_CACHE[key] = rec.ops
    df = items
    for op in _OPS_CACHE[key]:
        df = df.withColumn(op[1], op[2]) if op[0] == "with" else df.select(*op[1])
    return df.drop(*[x for x in df.columns if x.startswith("_")])


def _build_validation(items, base_url):
    """Validation steps applied to ``items`` (a DataFrame or a recorder)."""
    c = F.col
    year_now = F.year(F.current_date())

    # --- dates (normalized ISO strings; invalid -> error + removed) ---------
    df = items
    for f in ["startDate", "endDate", "createdAt"]:
        df = df.withColumn(f"_ts_{f}", F.when(_truthy(c(f)) & (F.trim(c(f)) != ""), parse_date(c(f))))
    df = df.withColumn("_dates_in", F.filter(F.coalesce(c("dates"), F.array().cast("array<string>")),
                                             lambda d: d.isNotNull() & (F.trim(d) != "")))
    df = df.withColumn("_dates_ts", F.transform("_dates_in", lambda d: F.struct(
        F.trim(d).alias("raw"), parse_date(d).alias("ts"))))

    def date_err(f):
        return F.when(_truthy(c(f)) & (F.trim(c(f)) != "") & c(f"_ts_{f}").isNull(),
                      _err(f, _msg('Invalid date format: "', F.trim(c(f)), '"')))

    def date_warn(f):
        ts = c(f"_ts_{f}")
        return F.when(ts.isNotNull() & (F.abs(year_now - F.year(ts)) > 100),
                      _warn(f, _msg("Date seems unrealistic: ", iso(ts)), "Verify date extraction and parsing"))

    dates_err = F.transform(F.filter("_dates_ts", lambda d: d["ts"].isNull()),
                            lambda d: _err("dates", _msg('Invalid date format: "', d["raw"], '"')))
    dates_warn = F.transform(
        F.filter("_dates_ts", lambda d: d["ts"].isNotNull() & (F.abs(year_now - F.year(d["ts"])) > 100)),
        lambda d: _warn("dates", _msg("Date seems unrealistic: ", iso(d["ts"])), "Verify date extraction and parsing"))
    n_dates = F.transform(F.filter("_dates_ts", lambda d: d["ts"].isNotNull()), lambda d: iso(d["ts"]))

    # --- images --------------------------------------------------------------
    base = c(base_url) if base_url else F.lit(None).cast("string")
    imgs = F.filter(F.coalesce(c("images"), F.array().cast("array<string>")),
                    lambda i: i.isNotNull() & (F.trim(i) != ""))
    img_rows = F.transform(imgs, lambda i: U.let(F.trim(i), lambda t: F.struct(
        t.alias("raw"),
        F.when(U.url_valid(t), t).when(base.isNotNull(), U.url_resolve(t, base)).alias("abs"),
        (~U.url_valid(t) & base.isNull()).alias("no_base"))))

    # --- language -----------------------------------------------------------
    detected = detect_language(c("title"), c("description"))
    lang_missing = ~_truthy(c("language"))

    df = df.withColumn("_img", img_rows).withColumn("_detected", detected)

    n_title = F.when(_truthy(c("title")), F.trim(c("title"))).otherwise(c("title"))
    n_desc = F.when(_truthy(c("description")), F.trim(c("description"))).otherwise(c("description"))
    n_email = F.when(_truthy(c("email")), F.lower(F.trim(c("email")))).otherwise(c("email"))
    phone_clean = F.regexp_replace(c("phone"), r"[\s\-\(\)\+]", "")
    phone_ok = phone_clean.rlike(r"^\d{7,15}$")
    n_phone = F.when(_truthy(c("phone")) & phone_ok, phone_clean).otherwise(c("phone"))
    site_t = F.trim(c("website"))
    site_full = F.when(site_t.startswith("http://") | site_t.startswith("https://"), site_t) \
        .otherwise(F.concat(F.lit("https://"), site_t))
    site_ok = U.url_valid(site_full)
    n_site = F.when(_truthy(c("website")) & site_ok, U.url_canonical(site_full)).otherwise(c("website"))
    n_lang = F.when(lang_missing, F.coalesce(c("_detected"), c("language"))).otherwise(c("language"))
    n_images = F.transform(F.filter("_img", lambda r: r["abs"].isNotNull() & U.url_valid(r["abs"])),
                           lambda r: r["abs"])

    def ts_str(f):
        return iso(c(f"_ts_{f}"))

    lon, lat, price, disc, zipc = c("longitude"), c("latitude"), c("price"), c("discountPrice"), c("zipcode")

    errors = F.concat(
        F.array_compact(F.array(*[
            F.when(_blank(c(f)), _err(f, F.lit(f"Required field '{f}' is missing or empty"))) for f in REQUIRED])),
        F.array_compact(F.array(date_err("startDate"), date_err("endDate"), date_err("createdAt"))),
        dates_err,
        F.array_compact(F.array(
            F.when(lang_missing & c("_detected").isNull(),
                   _err("language", F.lit("Language not specified and could not be auto-detected")))
            .when(~lang_missing & ~c("language").isin("de", "en"),
                  _err("language", _msg("Invalid language code: '", c("language"), "'. Must be 'de' or 'en'"))))),
    )
    start_ts, end_ts = c("_ts_startDate"), c("_ts_endDate")
    warnings = F.concat(
        F.array_compact(F.array(
            F.when(_truthy(c("title")) & (F.length(n_title) > 500),
                   _warn("title", F.lit("Title is very long (>500 characters)"),
                         "Consider truncating or reviewing extraction logic")),
            F.when(_truthy(c("title")) & (F.length(n_title) < 3),
                   _warn("title", F.lit("Title is very short (<3 characters)"),
                         "Verify extraction captured complete title")),
            F.when(_truthy(c("description")) & (F.length(n_desc) > 5000),
                   _warn("description", F.lit("Description is very long (>5000 characters)"),
                         "Consider truncating or reviewing extraction logic")),
            date_warn("startDate"), date_warn("endDate"), date_warn("createdAt"))),
        dates_warn,
        F.array_compact(F.array(
            F.when(start_ts.isNotNull() & end_ts.isNotNull() & (start_ts > end_ts),
                   _warn("dates", F.lit("Start date is after end date"), "Verify date extraction logic")))),
        F.transform(F.filter("_img", lambda r: r["no_base"] | (r["abs"].isNotNull() & ~U.url_valid(r["abs"]))),
                    lambda r: F.when(r["no_base"], _warn(
                        "images", _msg('Cannot convert relative URL to absolute: "', r["raw"], '" (no base URL provided)'),
                        "Provide base URL for proper image URL resolution"))
                    .otherwise(_warn("images", _msg('Invalid image URL: "', r["raw"], '"'),
                                     "Verify image URL extraction logic"))),
        F.array_compact(F.array(
            F.when(lang_missing & c("_detected").isNotNull(),
                   _warn("language", _msg("Language auto-detected as '", c("_detected"), "'"),
                         "Verify language detection accuracy")),
            F.when(_truthy(c("email")) & ~n_email.rlike(EMAIL_RE),
                   _warn("email", _msg('Invalid email format: "', n_email, '"'), "Verify email extraction logic")),
            F.when(_truthy(c("phone")) & ~phone_ok,
                   _warn("phone", _msg('Phone number format may be invalid: "', c("phone"), '"'),
                         "Verify phone number extraction and formatting")),
            F.when(_truthy(c("website")) & ~site_ok,
                   _warn("website", _msg('Invalid website URL: "', c("website"), '"'),
                         "Verify website URL extraction logic")),
            F.when(lon.isNotNull() & ((lon < -180) | (lon > 180)),
                   _warn("longitude", _msg("Invalid longitude value: ", num_text(lon)),
                         "Longitude must be between -180 and 180")),
            F.when(lat.isNotNull() & ((lat < -90) | (lat > 90)),
                   _warn("latitude", _msg("Invalid latitude value: ", num_text(lat)),
                         "Latitude must be between -90 and 90")),
            F.when(price.isNotNull() & (price < 0),
                   _warn("price", _msg("Invalid price value: ", num_text(price)),
                         "Price must be a non-negative number")),
            F.when(disc.isNotNull() & (disc < 0),
                   _warn("discountPrice", _msg("Invalid discount price value: ", num_text(disc)),
                         "Discount price must be a non-negative number")),
            F.when(disc.isNotNull() & price.isNotNull() & (disc > price),
                   _warn("discountPrice", F.lit("Discount price is higher than regular price"),
                         "Verify price extraction logic")),
            F.when(zipc.isNotNull() & ((zipc < 0) | (zipc > 99999)),
                   _warn("zipcode", _msg("Invalid zipcode value: ", zipc.cast("string")),
                         "Zipcode must be a number between 0 and 99999")),
        )),
    )

    norm = {
        "title": n_title, "description": n_desc, "language": n_lang, "place": c("place"),
        "address": c("address"), "email": n_email, "phone": n_phone, "website": n_site,
        "price": price, "discountPrice": disc, "longitude": lon, "latitude": lat,
        "startDate": ts_str("startDate"), "endDate": ts_str("endDate"), "dates": n_dates,
        "createdAt": ts_str("createdAt"), "zipcode": zipc, "images": n_images,
    }
    out = df.select("*", *[v.alias(f"n_{k}") for k, v in norm.items()],
                    errors.alias("errors"), warnings.alias("warnings"))
    return add_quality(out)


def _filled(name: str, col: Column) -> Column:
    if name in ("dates", "images"):
        return F.coalesce(F.size(col) > 0, F.lit(False))
    if name in ("price", "discountPrice", "longitude", "latitude", "zipcode"):
        return col.isNotNull() & ~F.isnan(col.cast("double"))
    return col.isNotNull() & (F.trim(col) != "")


def add_quality(df: DataFrame) -> DataFrame:
    """Completeness, accuracy, consistency and the rounded overall score,
    computed on the normalized ``n_*`` fields."""
    c = F.col
    weights = [(f, 2 if f in REQUIRED else 1) for f in COMPLETENESS_FIELDS]
    total = sum(w for _, w in weights)
    filled = sum((F.when(_filled(f, c(f"n_{f}")), w).otherwise(0) for f, w in weights), F.lit(0))
    completeness = filled / F.lit(float(total))

    lon, lat = c("n_longitude"), c("n_latitude")
    checks = [
        (c("n_startDate").isNotNull(), F.lit(True)),
        (c("n_endDate").isNotNull(), F.lit(True)),
        (c("n_createdAt").isNotNull(), F.lit(True)),
        (_truthy(c("n_email")), c("n_email").rlike(EMAIL_RE)),
        (_truthy(c("n_website")), U.url_valid("n_website")),
        (lon.isNotNull(), (lon >= -180) & (lon <= 180)),
        (lat.isNotNull(), (lat >= -90) & (lat <= 90)),
    ]
    n_img = F.coalesce(F.size("n_images"), F.lit(0))
    img_ok = F.size(F.filter("n_images", lambda i: U.url_valid(i)))
    a_total = sum((F.when(p, 1).otherwise(0) for p, _ in checks), F.lit(0)) + n_img
    a_pass = sum((F.when(p & ok, 1).otherwise(0) for p, ok in checks), F.lit(0)) + F.coalesce(img_ok, F.lit(0))
    accuracy = F.when(a_total > 0, a_pass / a_total).otherwise(F.lit(1.0))

    s, e = c("n_startDate"), c("n_endDate")
    pr, dp = c("n_price"), c("n_discountPrice")
    k_checks = [
        (s.isNotNull() & e.isNotNull(), s <= e),  # ISO strings order like instants
        (pr.isNotNull() & dp.isNotNull(), dp <= pr),
        (lon.isNotNull() | lat.isNotNull(), lon.isNotNull() & lat.isNotNull()),
    ]
    k_total = sum((F.when(p, 1).otherwise(0) for p, _ in k_checks), F.lit(0))
    k_pass = sum((F.when(p & ok, 1).otherwise(0) for p, ok in k_checks), F.lit(0))
    consistency = F.when(k_total > 0, k_pass / k_total).otherwise(F.lit(1.0))

    df = df.withColumn("completeness", completeness).withColumn("accuracy", accuracy) \
        .withColumn("consistency", consistency)
    overall = c("completeness") * 0.4 + c("accuracy") * 0.4 + c("consistency") * 0.2
    return df.withColumn("quality_score", round_js(overall, 2)).withColumn(
        "is_valid", F.size("errors") == 0)


def round_js(x: Column, digits: int) -> Column:
    """``Math.round(x * 10^d) / 10^d`` (half up toward +inf)."""
    m = float(10 ** digits)
    return F.floor(x * m + 0.5) / m


def batch_stats(validated: DataFrame, top: int = 10) -> DataFrame:
    """``batch_stats``: totals, valid/invalid, average score and the top
    messages, in one pass over the validated items.

    Each item contributes one 'item' row plus one row per error / warning;
    a single grouped aggregation (partial, map-side) counts messages and
    computes the totals.  The top ``top`` messages per kind are a
    ``row_number() <= top`` window, planned as a window-group-limit (each
    task keeps only ``top`` rows per kind before the shuffle); the few
    remaining rows fold into one result row.  No join."""
    rows = F.concat(
        F.array(F.struct(F.lit("i").alias("kind"), F.lit(None).cast("string").alias("message"))),
        F.transform("errors", lambda e: F.struct(F.lit("e").alias("kind"), e["message"].alias("message"))),
        F.transform("warnings", lambda w: F.struct(F.lit("w").alias("kind"), w["message"].alias("message"))))
    ev = validated.select("is_valid", "quality_score", F.explode(rows).alias("x"))
    g = ev.groupBy(F.col("x.kind").alias("kind"), F.col("x.message").alias("message")).agg(
        F.count("*").alias("count"), F.count_if("is_valid").alias("valid"), F.avg("quality_score").alias("avg"))
    w = Window.partitionBy("kind").orderBy(F.desc("count"), "message")
    msgs = g.filter(F.col("kind") != "i").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    u = g.filter(F.col("kind") == "i").withColumn("rank", F.lit(0)).unionByName(msgs)
    item = F.col("kind") == "i"

    def joined(kind):
        lst = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "message", "count"))))
        return F.nullif(F.array_join(F.transform(lst, lambda s: F.concat(s["message"], F.lit("="),
                                                                          s["count"].cast("string"))), " | "),
                        F.lit(""))
    return u.agg(
        F.coalesce(F.max(F.when(item, F.col("count"))), F.lit(0)).alias("total_items"),
        F.coalesce(F.max(F.when(item, F.col("valid"))), F.lit(0)).alias("valid_items"),
        F.coalesce(F.max(F.when(item, F.col("count") - F.col("valid"))), F.lit(0)).alias("invalid_items"),
        round_js(F.max(F.when(item, F.col("avg"))), 2).alias("average_quality_score"),
        joined("e").alias("common_errors"), joined("w").alias("common_warnings"))
