"""Extraction-run jobs: pages x plans -> items -> run metrics.

A "run" is keyed by ``run_key`` (the site host in the registered queries).
Every per-run number is one ``groupBy(run_key).agg`` over item-level
expressions, so partial aggregation happens map-side and no run's items are
gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefold.functions import url as U
from pagefold.operators import quality as Q

# Token-language words of the executor (exact word matches).
TOKEN_GERMAN = ["der", "die", "das", "und", "ist", "mit", "für", "von", "auf", "zu"]
TOKEN_ENGLISH = ["the", "and", "is", "with", "for", "from", "on", "to", "at", "by"]
ACCURACY_OPTIONALS = ["place", "address", "email", "phone", "website", "startDate", "endDate"]
QUALITY_OPTIONALS = ["place", "address", "email", "phone", "website", "startDate"]
ISO_MS_RE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"

# Field parsers (regexes used by the extractors).
PRICE_RE = r"[\d,]+\.?\d*"
COORD_RE = r"-?\d+\.?\d*"
ZIP_RE = r"\d{4,5}"
EMAIL_FIND_RE = r"[\w\.-]+@[\w\.-]+\.\w+"
PHONE_FIND_RE = r"[\d\s\-\+\(\)\/]{8,}"


def _truthy(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def _float_prefix(s: Column) -> Column:
    """parseFloat: leading decimal number of ``s`` (NULL if none)."""
    return F.regexp_extract(s, r"^[0-9]*\.?[0-9]*", 0).try_cast("double")


def parse_price(text) -> Column:
    """``parse_price``: first ``[\\d,]+\\.?\\d*``, only the first comma removed."""
    m = F.regexp_extract(U._c(text), PRICE_RE, 0)
    return F.when(_truthy(U._c(text)) & (m != ""), _float_prefix(F.regexp_replace(m, r"^([^,]*),", "$1")))


def parse_coordinate(text) -> Column:
    m = F.regexp_extract(U._c(text), COORD_RE, 0)
    neg = m.startswith("-")
    val = _float_prefix(F.regexp_replace(m, "^-", ""))
    return F.when(_truthy(U._c(text)) & (m != ""), F.when(neg, -val).otherwise(val))


def parse_zipcode(text) -> Column:
    m = F.regexp_extract(U._c(text), ZIP_RE, 0)
    return F.when(_truthy(U._c(text)) & (m != ""), m.try_cast("int"))


def token_language(title, description) -> Column:
    """Executor language guess: exact word counts, tie -> 'en'."""
    text = F.lower(F.concat(F.coalesce(U._c(title), F.lit("undefined")), F.lit(" "),
                            F.coalesce(U._c(description), F.lit("undefined"))))
    words = F.split(text, r"\s+")
    de = F.size(F.filter(words, lambda w: w.isin(TOKEN_GERMAN)))
    en = F.size(F.filter(words, lambda w: w.isin(TOKEN_ENGLISH)))
    return F.when(de > en, F.lit("de")).otherwise(F.lit("en"))


def item_normalize_basic(items: DataFrame, now: Column | None = None) -> DataFrame:
    """``item_normalize_basic``: arrays ensured, token language, createdAt."""
    now = now if now is not None else Q.iso(F.current_timestamp())
    return (items
            .withColumn("dates", F.coalesce("dates", F.array().cast("array<string>")))
            .withColumn("images", F.coalesce("images", F.array().cast("array<string>")))
            .withColumn("language", token_language("title", "description"))
            .withColumn("createdAt", F.when(_truthy(F.col("createdAt")), F.col("createdAt")).otherwise(now)))


def _is_iso(c: Column) -> Column:
    return c.rlike(ISO_MS_RE) & F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).isNotNull()


def extraction_errors(df: DataFrame) -> Column:
    """Per-item schema messages of the executor's check."""
    c = F.col
    fixed = F.array_compact(F.array(
        F.when(Q._blank(c("title")), F.lit("Title is required")),
        F.when(Q._blank(c("description")), F.lit("Description is required")),
        F.when(~F.coalesce(c("language").isin("de", "en"), F.lit(False)), F.lit('Language must be "de" or "en"')),
        *[F.when(_truthy(c(f)) & ~_is_iso(c(f)), F.lit(f"{f} must be in ISO 8601 format"))
          for f in ["startDate", "endDate", "createdAt"]],
    ))
    dates = F.transform(
        F.filter(F.zip_with(F.coalesce(c("dates"), F.array().cast("array<string>")),
                            F.sequence(F.lit(0), F.greatest(F.size(F.coalesce(c("dates"), F.array())) - 1, F.lit(0))),
                            lambda d, i: F.struct(d.alias("d"), i.alias("i"))),
                 lambda s: s["d"].isNotNull() & ~F.coalesce(_is_iso(s["d"]), F.lit(False))),
        lambda s: F.concat(F.lit("dates["), s["i"].cast("string"), F.lit("] must be in ISO 8601 format")))
    return F.concat(fixed, dates)


def extraction_validate(items: DataFrame, key: str) -> DataFrame:
    """``extraction_validate``: per run, error/warning counts and
    completeness = valid items / items."""
    c = F.col
    title = F.coalesce(c("title"), F.lit("undefined"))
    per_item = items.select(
        key, extraction_errors(items).alias("errs"),
        F.array_compact(F.array(
            F.when(~_truthy(c("place")) & ~_truthy(c("address")),
                   F.concat(F.lit('Item "'), title, F.lit('" missing location information'))),
            F.when(~_truthy(c("startDate")) & ~_truthy(c("endDate")) & (F.size(F.coalesce(c("dates"), F.array())) == 0),
                   F.concat(F.lit('Item "'), title, F.lit('" missing date information'))))).alias("warns"))
    return per_item.groupBy(key).agg(
        F.count("*").alias("n_items"),
        F.count_if(F.size("errs") == 0).alias("valid_items"),
        F.sum(F.size("errs")).alias("n_errors"),
        F.sum(F.size("warns")).alias("n_warnings"),
        (F.count_if(F.size("errs") == 0) / F.count("*")).alias("completeness_score"),
    ).withColumn("is_valid", F.col("n_errors") == 0)


def item_accuracy(c=F.col) -> Column:
    score = (F.when(_truthy(c("title")), 2).otherwise(0) + F.when(_truthy(c("description")), 2).otherwise(0)
             + sum((F.when(_truthy(c(f)), 1).otherwise(0) for f in ACCURACY_OPTIONALS), F.lit(0)))
    return score / F.lit(11.0)


def run_metrics(items: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """``run_metrics``: items, pages, successful pages, errors, accuracy per run.

    ``pages`` has (key, page_id, n_items) -- one row per processed page.
    """
    it = items.groupBy(key).agg(F.count("*").alias("items_extracted"),
                                F.avg(item_accuracy()).alias("accuracy_score"))
    pg = pages.groupBy(key).agg(F.count("*").alias("pages_processed"),
                                F.count_if(F.col("n_items") > 0).alias("successful_pages"),
                                F.count_if(F.col("n_items") == 0).alias("errors_encountered"))
    return pg.join(it, key, "left").select(
        key, F.coalesce("items_extracted", F.lit(0)).alias("items_extracted"), "pages_processed",
        "successful_pages", "errors_encountered",
        F.coalesce("accuracy_score", F.lit(0.0)).alias("accuracy_score"))


def test_confidence(n_items: Column, n_errors: Column, accuracy: Column) -> Column:
    """``test_confidence``: 0 with errors or no samples, else accuracy*min(n/3,1)."""
    return F.when((n_errors > 0) | (n_items == 0), F.lit(0.0)).otherwise(
        accuracy * F.least(n_items / F.lit(3.0), F.lit(1.0)))


def data_quality(items: DataFrame, key: str) -> DataFrame:
    """``data_quality``: (required + 0.5 per optional) / 5 per item."""
    c = F.col
    score = (F.when(~Q._blank(c("title")), 1.0).otherwise(0.0) + F.when(~Q._blank(c("description")), 1.0).otherwise(0.0)
             + sum((F.when(_truthy(c(f)), 0.5).otherwise(0.0) for f in QUALITY_OPTIONALS), F.lit(0.0)))
    return items.groupBy(key).agg((F.sum(score) / (F.count("*") * 5.0)).alias("data_quality"))


def items_per_page_cap(items: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """``items_per_page_cap``: keep the first ``limit`` items of each key."""
    w = Window.partitionBy(key).orderBy(order)
    return items.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")


def content_page_join(links: DataFrame, pages: DataFrame) -> DataFrame:
    """``content_page_join``: visit each content URL = left join of links to
    the page snapshot on the normalized URL; a miss is a failed row."""
    target = pages.select(F.col("page_id").alias("content_page_id"),
                          U.url_normalize("url").alias("_key"))
    # one snapshot row per normalized URL (latest page id wins)
    target = target.groupBy("_key").agg(F.max("content_page_id").alias("content_page_id"))
    j = links.withColumn("_key", U.url_normalize("url")).join(target, "_key", "left").drop("_key")
    return j.withColumn("success", F.col("content_page_id").isNotNull()).withColumn(
        "error", F.when(~F.col("success"), F.lit("No content extracted")))


def item_clean(items: DataFrame) -> DataFrame:
    """``item_clean``: sandbox clean-up of raw extracted fields."""
    c = F.col

    def clean_text(x):
        return F.substring(F.trim(F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"[\r\n\t]", " ")), 1, 500)

    def truthy_then(x, val):
        return F.when(_truthy(x), val)
    first_img = F.try_element_at(F.coalesce(c("images"), F.array().cast("array<string>")), F.lit(1))
    date_src = F.coalesce(F.try_element_at(c("dates"), F.lit(1)), c("startDate"))
    return items.select(
        "item_id",
        truthy_then(c("title"), clean_text(c("title"))).alias("title"),
        truthy_then(c("description"), clean_text(c("description"))).alias("description"),
        truthy_then(c("address"), clean_text(c("address"))).alias("address"),
        truthy_then(c("place"), clean_text(c("place"))).alias("place"),
        F.when(_truthy(c("email")) & F.trim(c("email")).rlike(Q.EMAIL_RE), F.trim(c("email"))).alias("email"),
        truthy_then(c("phone"), F.trim(F.regexp_replace(c("phone"), r"[^\d\+\-\(\)\s]", ""))).alias("phone"),
        F.when(_truthy(c("website")) & U.url_valid(c("website")), c("website")).alias("website"),
        F.when(_truthy(first_img) & U.url_valid(first_img), F.array(first_img)).alias("images"),
        Q.iso(sandbox_date(date_src)).alias("startDate"),
    )


def sandbox_date(s: Column) -> Column:
    """Sandbox date parser: first of d.M.yyyy / yyyy-MM-dd / d/M/yyyy found
    anywhere in the text, else an ISO timestamp; impossible dates -> NULL."""
    forms = [(r"(\d{1,2})\.(\d{1,2})\.(\d{4})", 3, 2, 1), (r"(\d{4})-(\d{2})-(\d{2})", 1, 2, 3),
             (r"(\d{1,2})/(\d{1,2})/(\d{4})", 3, 2, 1)]
    out = None
    for p, yi, mi, di in forms:
        val = F.concat(F.regexp_extract(s, p, yi), F.lit("-"), F.lpad(F.regexp_extract(s, p, mi), 2, "0"), F.lit("-"),
                       F.lpad(F.regexp_extract(s, p, di), 2, "0"), F.lit(" 00:00:00.000"))
        out = F.when(s.rlike(p), val) if out is None else out.when(s.rlike(p), val)
    parsed = F.try_to_timestamp(out, F.lit("yyyy-MM-dd HH:mm:ss.SSS"))
    return F.when(_truthy(s), F.when(out.isNotNull(), parsed).otherwise(Q.parse_date(s)))
