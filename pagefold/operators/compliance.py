"""Legal compliance: robots rules, verdicts, retention, anonymization, GDPR
deletion (SURVEY 2.7).

robots.txt files are small per domain, so parsing is a ``posexplode`` of the
lines with a running count of ``User-agent`` lines (window partitioned by
domain) -- no domain's data ever meets another's.  Verdicts join URLs to the
rule paths of their own domain (equi-join on domain) and take the first
matching path in rule order with ``min_by``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefold.functions import url as U

DEFAULT_AGENT = "pagefold-bot/1.0"
DEFAULT_SALT = "default-salt"
VALID_TTL_HOURS = 24
ERROR_TTL_HOURS = 1

# Retention days by source type (365 otherwise).
RETENTION_DAYS = {"municipal": 2555, "government": 2555, "news": 1095, "commercial": 730}
GDPR_ACTIONS = ["Apply GDPR anonymization to extracted data", "Set appropriate data retention period",
                "Log data processing activities"]
PUBLIC_ACTIONS = ["Use public_task as legal basis for processing", "Set extended retention period for government data"]


def robots_fetch_state(robots: DataFrame) -> DataFrame:
    """``src_robots``: fetch outcome per domain -> body used for rules and
    cache expiry (ok / not-ok: 24 h, valid; fetch error: 1 h, invalid)."""
    ok = (F.col("status") >= 200) & (F.col("status") < 300)
    error = F.col("status").isNull() | (F.col("status") == 0)
    return robots.select(
        "domain", "fetched_at",
        F.when(error, "error").when(ok, "ok").otherwise("not_found").alias("outcome"),
        F.when(ok & ~error, F.col("body")).otherwise(F.lit("")).alias("body"),
        (~error).alias("is_valid"),
        (F.col("fetched_at") + F.when(error, F.expr(f"INTERVAL {ERROR_TTL_HOURS} HOURS"))
         .otherwise(F.expr(f"INTERVAL {VALID_TTL_HOURS} HOURS"))).alias("expires_at"),
    )


def robots_parse(robots: DataFrame) -> DataFrame:
    """``robots_parse``: body -> one row per rule.

    Every ``User-agent`` line opens a new rule (no grouping of consecutive
    agents); comments and blank lines are skipped; the first ':' splits
    directive and value; lines before the first agent are ignored.
    Output: domain, rule_idx (1-based), user_agent, allowed, disallowed,
    crawl_delay, sitemaps.
    """
    lines = robots.select("domain", F.posexplode(F.split(F.coalesce("body", F.lit("")), "\n")).alias("pos", "raw"))
    lines = lines.select("domain", "pos", F.trim("raw").alias("line")).filter(
        (F.col("line") != "") & ~F.col("line").startswith("#"))
    directive = F.lower(F.substring_index("line", ":", 1))
    value = F.trim(F.when(F.col("line").contains(":"),
                          F.expr("substr(line, instr(line, ':') + 1)")).otherwise(F.lit("")))
    lines = lines.select("domain", "pos", directive.alias("directive"), value.alias("value"))
    w = Window.partitionBy("domain").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("rule_idx", F.sum(F.when(F.col("directive") == "user-agent", 1).otherwise(0)).over(w))
    lines = lines.filter(F.col("rule_idx") > 0)
    d, v = F.col("directive"), F.col("value")

    def ordered(pred):
        return F.transform(F.array_sort(F.collect_list(F.when(pred, F.struct("pos", "value")))),
                           lambda s: s["value"])
    delay_txt = F.max_by(F.when((d == "crawl-delay") & (v != ""), v),
                         F.when((d == "crawl-delay") & (v != ""), F.col("pos")))
    rules = lines.groupBy("domain", "rule_idx").agg(
        F.min_by(F.when(d == "user-agent", v), F.when(d == "user-agent", F.col("pos"))).alias("ua"),
        ordered((d == "allow") & (v != "")).alias("allowed"),
        ordered((d == "disallow") & (v != "")).alias("disallowed"),
        delay_txt.alias("delay_txt"),
        ordered((d == "sitemap") & (v != "")).alias("sitemaps"),
    )
    delay = F.regexp_extract("delay_txt", r"^\s*([+-]?\d+)", 1).try_cast("int")
    return rules.select(
        "domain", "rule_idx",
        F.when(F.col("ua") == "", F.lit("*")).otherwise(F.col("ua")).alias("user_agent"),
        "allowed", "disallowed", delay.alias("crawl_delay"), "sitemaps")


def robots_applicable(rules: DataFrame, agent: str = DEFAULT_AGENT) -> DataFrame:
    """``robots_applicable``: exact (case-insensitive) agent rules, else '*'."""
    exact = F.lower("user_agent") == agent.lower()
    w = Window.partitionBy("domain")
    r = rules.withColumn("_exact", exact).withColumn("_any_exact", F.max(F.col("_exact").cast("int")).over(w))
    keep = F.when(F.col("_any_exact") == 1, F.col("_exact")).otherwise(F.col("user_agent") == "*")
    return r.filter(keep).drop("_exact", "_any_exact")


def path_matches(path: Column, pattern: Column) -> Column:
    """``robots_path_match``: '/' matches all; trailing '*' is a prefix; else prefix."""
    return (F.when(pattern == "/", F.lit(True))
            .when(pattern.endswith("*"), path.startswith(F.substring(pattern, F.lit(1), F.length(pattern) - 1)))
            .otherwise(path.startswith(pattern)))


def rule_paths(applicable: DataFrame) -> DataFrame:
    """Applicable rule paths in checking order: (domain, rule_idx, kind 0 =
    allow / 1 = disallow, path_idx, pattern)."""
    a = applicable.select("domain", "rule_idx", F.lit(0).alias("kind"),
                          F.posexplode("allowed").alias("path_idx", "pattern"))
    d = applicable.select("domain", "rule_idx", F.lit(1).alias("kind"),
                          F.posexplode("disallowed").alias("path_idx", "pattern"))
    return a.unionByName(d)


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str = DEFAULT_AGENT) -> DataFrame:
    """``robots_allowed``: verdict per URL.

    First rule (file order) with a matching path decides; inside a rule
    allows are checked before disallows.  No rules or no match -> allowed;
    unparseable URL -> not allowed.
    """
    rules = robots_parse(robots_fetch_state(robots))
    paths = rule_paths(robots_applicable(rules, agent))
    u = urls.select("url_id", "url", U.url_valid("url").alias("ok"),
                    U.url_host("url").alias("domain"), U.url_path("url").alias("path"))
    hits = u.filter("ok").join(paths, "domain").filter(path_matches(F.col("path"), F.col("pattern")))
    first = hits.groupBy("url_id").agg(
        F.min_by(F.col("kind") == 0, F.struct("rule_idx", "kind", "path_idx")).alias("verdict"))
    return u.join(first, "url_id", "left").select(
        "url_id", "url", F.when(~F.col("ok"), F.lit(False)).otherwise(F.coalesce("verdict", F.lit(True)))
        .alias("allowed"))


def robots_crawl_delay(robots: DataFrame, agent: str = DEFAULT_AGENT) -> DataFrame:
    """``robots_crawl_delay``: first applicable delay x 1000 ms, default 1000."""
    fs = robots_fetch_state(robots)
    rules = robots_applicable(robots_parse(fs), agent)
    first = rules.filter(F.col("crawl_delay").isNotNull()).groupBy("domain").agg(
        F.min_by("crawl_delay", "rule_idx").alias("d"))
    return fs.select("domain").join(first, "domain", "left").select(
        "domain", F.coalesce(F.col("d") * 1000, F.lit(1000)).alias("crawl_delay_ms"))


def source_type_of(host: Column) -> Column:
    """Source type of a host in the derived tables (by host length)."""
    return F.element_at(F.array(*[F.lit(x) for x in ["municipal", "news", "government", "commercial"]]),
                        (F.length(host) % 4 + 1).cast("int"))


def legal_metadata(domains: DataFrame, jurisdiction: str = "DE") -> DataFrame:
    """``legal_metadata``: jurisdiction flags, legal basis, retention days."""
    st = F.col("source_type")
    days = F.create_map(*[x for kv in RETENTION_DAYS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return domains.select(
        "domain", "source_type", F.lit(jurisdiction).alias("jurisdiction"),
        F.lit(jurisdiction in ("DE", "EU")).alias("gdpr_compliant"),
        F.when(st.isin("government", "municipal"), "public_task").otherwise("legitimate_interest")
        .alias("data_processing_basis"),
        F.coalesce(days[st], F.lit(365)).alias("retention_days"))


def compliance_check(robots: DataFrame, domains: DataFrame) -> DataFrame:
    """``compliance_check``: per-domain warnings and recommended actions."""
    rules = robots_parse(robots_fetch_state(robots))
    agg = rules.groupBy("domain").agg(
        F.count("*").alias("n_rules"),
        F.bool_or(F.array_contains("disallowed", "/") | (F.size("disallowed") > 10)).alias("restrictive"))
    j = domains.join(agg, "domain", "left")
    n = F.coalesce("n_rules", F.lit(0))
    restrictive = F.coalesce("restrictive", F.lit(False))
    public = F.col("source_type").isin("government", "municipal")
    warnings = F.array_compact(F.array(
        F.when(n == 0, F.lit("No robots.txt file found - proceeding with caution")),
        F.when(restrictive, F.lit("Domain has restrictive robots.txt rules"))))
    actions = F.array_compact(F.array(
        F.when(restrictive, F.lit("Review robots.txt compliance before scraping")),
        *[F.lit(a) for a in GDPR_ACTIONS],
        *[F.when(public, F.lit(a)) for a in PUBLIC_ACTIONS]))
    return j.select("domain", F.lit(True).alias("robots_txt_compliant"),
                    F.concat(F.lit("https://"), F.col("domain"), F.lit("/robots.txt")).alias("robots_txt_url"),
                    n.alias("n_rules"), warnings.alias("warnings"), actions.alias("recommended_actions"))


def retention_expired(items: DataFrame, collected_at: str, retention_days: str, now: Column) -> DataFrame:
    """``retention_expired``: rows past collectedAt + retention days."""
    return items.filter(F.col(collected_at) + F.make_interval(days=F.col(retention_days)) < now)


def hash_hex(value: Column, salt: str = DEFAULT_SALT) -> Column:
    return F.sha2(F.concat(value, F.lit(salt)), 256)


def anonymize_email(email, salt: str = DEFAULT_SALT, preserve_format: bool = True) -> Column:
    """``anonymize_email``: sha256(local+salt)[:8]@domain (or the full hash)."""
    e = U._c(email)
    if not preserve_format:
        return hash_hex(e, salt)
    parts = F.split(e, "@")
    local = F.element_at(parts, 1)
    domain = F.try_element_at(parts, F.lit(2))
    return F.concat(F.substring(hash_hex(local, salt), 1, 8), F.lit("@"),
                    F.coalesce(domain, F.lit("undefined")))


def anonymize_phone(phone, salt: str = DEFAULT_SALT, preserve_format: bool = True,
                    leak_original: bool = False) -> Column:
    """``anonymize_phone``: every digit replaced by the next digit of the
    hash of all digits; the format is kept.  When the hash has fewer digits
    than the number, the remaining digits become '0' (``leak_original``
    keeps the original digit, as the reference does)."""
    p = U._c(phone)
    if not preserve_format:
        return hash_hex(p, salt)
    digits = F.regexp_replace(p, r"\D", "")
    hashed = F.substring(F.regexp_replace(hash_hex(digits, salt), r"\D", ""), 1, F.length(digits))

    def body(h):
        chars = F.split(p, "")

        def per_char(ch, i):
            k = F.size(F.filter(F.slice(chars, 1, i), lambda x: x.rlike(r"^\d$")))  # digits before i
            sub = F.substring(h, k + 1, 1)
            fallback = ch if leak_original else F.lit("0")
            return F.when(ch.rlike(r"^\d$"), F.when(sub != "", sub).otherwise(fallback)).otherwise(ch)
        return F.array_join(F.transform(chars, per_char), "")
    return U.let(hashed, body)


def anonymize_address(address) -> Column:
    """``anonymize_address``: digits -> XXX, then street-name replacements."""
    a = F.regexp_replace(U._c(address), r"\d+", "XXX")
    a = F.regexp_replace(a, r"(?i)\b\w+straße\b", "Musterstraße")
    return F.regexp_replace(a, r"(?i)\b\w+str\.\b", "Musterstr.")


def anonymize_items(items: DataFrame, emails: bool = True, phones: bool = True,
                    addresses: bool = False, salt: str = DEFAULT_SALT) -> DataFrame:
    """``anonymize_items``: apply the switched-on anonymizers (projection)."""
    c = F.col
    out = items
    if emails:
        out = out.withColumn("email", F.when(c("email").isNotNull() & (c("email") != ""),
                                             anonymize_email(c("email"), salt)).otherwise(c("email")))
    if phones:
        out = out.withColumn("phone", F.when(c("phone").isNotNull() & (c("phone") != ""),
                                             anonymize_phone(c("phone"), salt)).otherwise(c("phone")))
    if addresses:
        out = out.withColumn("address", F.when(c("address").isNotNull() & (c("address") != ""),
                                               anonymize_address(c("address"))).otherwise(c("address")))
    return out


def _item_keys(items: DataFrame) -> DataFrame:
    """``item_id, kind, key``: domain, e-mail, phone and day of every item."""
    def kv(kind, col):
        return F.struct(F.lit(kind).alias("kind"), col.cast("string").alias("key"))
    it = items.select("item_id", F.explode(F.array(
        kv("domain", U.url_host("sourceUrl")), kv("email", F.lower(F.trim("email"))), kv("phone", F.col("phone")),
        kv("day", F.to_date(F.substring("endDate", 1, 10))))).alias("k"))
    return it.select("item_id", "k.kind", "k.key").filter(F.col("key").isNotNull())


def _request_keys(requests: DataFrame) -> DataFrame:
    """``request_id, kind, key``; date ranges are expanded to days, so that
    every criterion is an equality."""
    def kv(kind, col):
        return F.struct(F.lit(kind).alias("kind"), col.cast("string").alias("key"))
    days = F.when(F.col("from_ts").isNotNull() & F.col("to_ts").isNotNull(),
                  F.transform(F.sequence(F.to_date("from_ts"), F.to_date("to_ts")), lambda d: kv("day", d)))
    req = requests.select("request_id", F.explode(F.concat(
        F.array(kv("domain", F.lower("domain")), kv("email", F.lower(F.trim("email"))), kv("phone", F.col("phone"))),
        F.coalesce(days, F.array().cast("array<struct<kind:string,key:string>>")))).alias("k"))
    return req.select("request_id", "k.kind", "k.key").filter(F.col("key").isNotNull()).distinct()


def gdpr_delete(items: DataFrame, requests: DataFrame) -> DataFrame:
    """``gdpr_delete``: items that survive the deletion requests.

    Requests are reduced to their distinct criteria before they meet the items,
    so the work follows items plus requests, never their pairs."""
    keys = _request_keys(requests).select("kind", "key").distinct()
    hit = _item_keys(items).join(keys, ["kind", "key"], "left_semi").select("item_id").distinct()
    return items.join(hit, "item_id", "left_anti")


def gdpr_delete_counts(items: DataFrame, requests: DataFrame) -> DataFrame:
    """Items hit per request.

    An item has one key of a kind, so the counts of a request's keys of one kind
    add up; items are counted per key before the join.  Only requests with
    criteria of several kinds need their pairs, to count an item once."""
    keys = _request_keys(requests)
    kinds = keys.groupBy("request_id").agg(F.count_distinct("kind").alias("kinds"))
    keys = keys.join(kinds, "request_id")
    have = _item_keys(items)
    counts = have.groupBy("kind", "key").agg(F.count_distinct("item_id").alias("n"))
    single = keys.filter("kinds = 1").join(counts, ["kind", "key"]).groupBy("request_id").agg(F.sum("n").alias("n"))
    several = keys.filter("kinds > 1").join(have, ["kind", "key"]).groupBy("request_id").agg(
        F.count_distinct("item_id").alias("n"))
    return requests.select("request_id").join(single.unionByName(several), "request_id", "left").select(
        "request_id", F.coalesce("n", F.lit(0)).cast("long").alias("deleted_records"))


def cache_stats(state: DataFrame, now: Column) -> DataFrame:
    """``cache_stats``: total / valid / expired cache entries at ``now``."""
    valid = (F.col("expires_at") > now) & F.col("is_valid")
    return state.agg(F.count("*").alias("total_entries"), F.count_if(valid).alias("valid_entries"),
                     F.count_if(~valid).alias("expired_entries"))
