"""URL column expressions (all JVM-side, codegen-friendly).

URLs are split with one anchored regular expression instead of
``java.net.URI`` so that malformed input never throws and the split is the
same one a SQL engine with RE2 computes.  Deviations from the WHATWG parser
(no percent-encoding, no IDNA, no IPv6 canonical form) are listed in the
README.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# scheme ":" ["//" authority] path ["?" query] ["#" fragment]
URL_RE = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
SCHEME_RE = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"
SPECIAL_SCHEMES = ["http", "https", "ftp", "ws", "wss", "file"]
DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


SEP = "\u0001"
_HOST_RE = r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)"
_PORT_RE = r"^(?:[^@]*@)?(?:\[[^\]]*\]|[^:]*):([0-9]*)$"


def let(value: Column, fn) -> Column:
    """Bind ``value`` once and use it many times inside ``fn``.

    Catalyst substitutes column aliases into filters and joins; a large URL
    expression referenced N times would be copied N times at every level.
    Wrapping the use in a one-element ``transform`` keeps the plan linear.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)


def url_parts(u) -> Column:
    """One regex pass -> array(scheme, '//'-flag, authority, path, query, fragment).

    Unparseable strings give a one-element array.
    """
    rep = SEP.join(["$1", "$2", "$3", "$4", "$5", "$6"])
    return F.split(F.regexp_replace(_c(u), URL_RE, rep), SEP)


def _p(parts: Column, i: int) -> Column:
    return F.try_element_at(parts, F.lit(i + 1))


def _ok(parts: Column) -> Column:
    return F.size(parts) == 6


def _scheme(p):
    return F.lower(_p(p, 0))


def _host(p):
    return F.lower(F.regexp_extract(_p(p, 2), _HOST_RE, 1))


def _valid(p, u, host=None):
    host = _host(p) if host is None else host
    return F.coalesce(
        u.isNotNull() & _ok(p)
        & (~_scheme(p).isin(SPECIAL_SCHEMES) | ((host != "") & ~host.rlike(r"\s"))),
        F.lit(False))


def _or_empty(p, part: Column) -> Column:
    return F.when(_ok(p), part).otherwise(F.lit(""))


def url_scheme(u) -> Column:
    return let(url_parts(u), lambda p: _or_empty(p, _scheme(p)))


def url_authority(u) -> Column:
    return let(url_parts(u), lambda p: _or_empty(p, _p(p, 2)))


def url_host(u) -> Column:
    """Lower-cased host without user info and port ('' when absent)."""
    return let(url_parts(u), lambda p: _or_empty(p, _host(p)))


def url_path(u) -> Column:
    return let(url_parts(u), lambda p: _or_empty(p, _p(p, 3)))


def url_query(u) -> Column:
    """Query including the leading '?', '' when absent."""
    return let(url_parts(u), lambda p: _or_empty(p, _p(p, 4)))


def url_valid(u) -> Column:
    """``url_valid``: parses as an absolute URL.

    A scheme is required; special schemes (http, https, ...) also need a
    host without white space.
    """
    u = _c(u)
    return let(url_parts(u), lambda p: _valid(p, u))


def url_host_or_self(u) -> Column:
    """``url_host``: host for grouping; the whole string when unparseable."""
    u = _c(u)
    return let(url_parts(u), lambda p: F.when(_valid(p, u), _host(p)).otherwise(u))


def url_normalize(u) -> Column:
    """``url_normalize``: ``scheme://host/path`` (port, query, fragment dropped).

    Unparseable input is returned unchanged.
    """
    u = _c(u)

    def body(p):
        path = _p(p, 3)
        path = F.when((path == "") & _scheme(p).isin(SPECIAL_SCHEMES), F.lit("/")).otherwise(path)
        return F.when(_valid(p, u), F.concat(_scheme(p), F.lit("://"), _host(p), path)).otherwise(u)
    return let(url_parts(u), body)


def remove_dot_segments(path: Column) -> Column:
    """RFC 3986 5.2.4 on an absolute path, as one array fold."""
    segs = F.split(path, "/")
    folded = F.aggregate(
        F.slice(segs, 2, 1 << 30),
        F.array(F.lit("")),
        lambda acc, x: F.when(x == ".", acc)
        .when(x == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(x))),
    )
    joined = F.array_join(folded, "/")
    last = F.element_at(segs, -1)
    joined = F.when(last.isin(".", ".."), F.concat(joined, F.lit("/"))).otherwise(joined)
    joined = F.when(joined == "", F.lit("/")).otherwise(joined)
    return F.when(path.contains("/."), joined).otherwise(path)


def _canonical(p, u):
    """The canonical URL, NULL where ``u`` is not valid."""
    return let(_host(p), lambda host: F.when(_valid(p, u, host), _rebuilt(p, host)))


def _rebuilt(p, host):
    scheme = _scheme(p)
    auth = _p(p, 2)
    port = F.regexp_extract(auth, _PORT_RE, 1)
    default_port = F.create_map(*[x for kv in DEFAULT_PORTS.items() for x in map(F.lit, kv)])
    keep_port = (port != "") & (F.coalesce(default_port[scheme], F.lit("")) != port)
    special = scheme.isin(SPECIAL_SCHEMES)
    path = _p(p, 3)
    path = F.when((path == "") & special, F.lit("/")).otherwise(path)
    path = F.when(special, remove_dot_segments(path)).otherwise(path)
    userinfo = F.regexp_extract(auth, r"^([^@]*@)", 1)
    return F.concat(
        scheme, F.lit(":"),
        F.when(_p(p, 1) != "", F.concat(F.lit("//"), userinfo, host,
                                        F.when(keep_port, F.concat(F.lit(":"), port)).otherwise(F.lit(""))))
        .otherwise(F.lit("")),
        path, _p(p, 4), _p(p, 5),
    )


def url_canonical(u) -> Column:
    """Lower-case scheme and host, drop a default port, '/' for empty path,
    remove dot segments."""
    u = _c(u)
    return let(u, lambda v: let(url_parts(v), lambda p: F.coalesce(_canonical(p, v), v)))


def _resolve_join(h: Column, b: Column) -> Column:
    """Raw ``href`` joined onto ``base`` (NULL when the base is unusable)."""
    def body(bp):
        b_scheme = _scheme(bp)
        b_origin = F.concat(b_scheme, F.lit("://"), _p(bp, 2))
        b_path = F.when(_p(bp, 3) == "", F.lit("/")).otherwise(_p(bp, 3))
        b_dir = F.regexp_extract(b_path, r"^(.*/)", 1)
        no_frag = F.concat(b_origin, b_path, _p(bp, 4))
        base_ok = _valid(bp, b) & b_scheme.isin(SPECIAL_SCHEMES)
        return (
            F.when(h.rlike(SCHEME_RE), h)
            .when(~base_ok, F.lit(None).cast("string"))
            .when(h.startswith("//"), F.concat(b_scheme, F.lit(":"), h))
            .when(h.startswith("/"), F.concat(b_origin, h))
            .when(h.startswith("?"), F.concat(b_origin, b_path, h))
            .when(h.startswith("#"), F.concat(no_frag, h))
            .when(h == "", no_frag)
            .otherwise(F.concat(b_origin, b_dir, h))
        )
    return let(url_parts(b), body)


def url_resolve(href, base) -> Column:
    """``url_resolve``: ``new URL(href, base).href``; ``href`` on failure."""
    href = _c(href)
    joined = let(F.trim(href), lambda h: _resolve_join(h, _c(base)))

    def final(j):
        return let(url_parts(j), lambda p: _canonical(p, j))
    return F.coalesce(let(joined, final), href)


def with_resolved(df, href: str, base: str, out: str = "url"):
    """Add ``out`` = ``url_resolve(href, base)``."""
    return df.withColumn(out, url_resolve(href, base))


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def _query_keys(query: Column) -> Column:
    q = F.regexp_replace(query, r"^\?", "")
    pairs = F.filter(F.split(q, "&"), lambda s: s != "")
    return F.transform(pairs, lambda p: F.regexp_extract(p, r"^([^=]*)", 1))


def _overlap_ratio(a: Column, b: Column) -> Column:
    """Share of ``a`` present in ``b`` over the longer length (1 if both empty)."""
    return let(F.array(a, b), lambda z: _share(z[0], z[1]))


def _share(a: Column, b: Column) -> Column:
    common = F.size(F.filter(a, lambda x: F.array_contains(b, x)))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(common / F.greatest(F.size(a), F.size(b)))
    )


def url_path_similarity(u1, u2) -> Column:
    """``url_path_similarity`` (argument order matters on repeated segments)."""
    return _overlap_ratio(_segments(url_path(u1)), _segments(url_path(u2)))


def url_query_similarity(u1, u2) -> Column:
    """``url_query_similarity`` over query-parameter names."""
    return _overlap_ratio(_query_keys(url_query(u1)), _query_keys(url_query(u2)))


# Fixed values that must equal the reference's (German municipal URL rules).
MUNICIPAL_PATTERNS = [r"\d{4,6}\.htm", r"\+.*\+.*\.htm", r"lnav=\d+"]
MUNICIPAL_KEYWORDS = [
    "sitzung", "tagesordnung", "protokoll", "beschluss", "bericht", "ausschuss",
    "gemeinderat", "stadtrat", "oeffentlich", "öffentlich", "veranstaltung",
]


def url_municipal_pattern(u1, u2) -> Column:
    """``url_municipal_pattern``: one of the patterns holds for both URLs."""
    u1, u2 = _c(u1), _c(u2)
    out = F.lit(False)
    for p in MUNICIPAL_PATTERNS:
        out = out | (u1.rlike(p) & u2.rlike(p))
    return out


def _file_name(u) -> Column:
    return F.regexp_extract(url_path(u), r"([^/]*)$", 1)


def url_municipal_similarity(u1, u2) -> Column:
    """``url_municipal_similarity``: .htm 0.2, numeric id 0.3, plus-text 0.2, keyword 0.1."""
    f1, f2 = _file_name(u1), _file_name(u2)
    l1, l2 = F.lower(f1), F.lower(f2)
    shared_kw = F.lit(False)
    for k in MUNICIPAL_KEYWORDS:
        shared_kw = shared_kw | (l1.contains(k) & l2.contains(k))
    return (
        F.when(f1.contains(".htm") & f2.contains(".htm"), 0.2).otherwise(0.0)
        + F.when(f1.rlike(r"\d{4,6}\.htm") & f2.rlike(r"\d{4,6}\.htm"), 0.3).otherwise(0.0)
        + F.when(f1.rlike(r"\+.*\+") & f2.rlike(r"\+.*\+"), 0.2).otherwise(0.0)
        + F.when(shared_kw, 0.1).otherwise(0.0)
    )


def url_similarity(u1, u2) -> Column:
    """``url_similarity``: min(1, 0.3 same host + path/municipal + 0.2 query)."""
    return let(F.array(_c(u1), _c(u2)), lambda a: _similarity(a[0], a[1]))


def _similarity(u1: Column, u2: Column) -> Column:
    return let(F.array(url_parts(u1), url_parts(u2)), lambda p: _score(u1, u2, p[0], p[1]))


def _score(u1: Column, u2: Column, p1: Column, p2: Column) -> Column:
    score = (
        F.when(_or_empty(p1, _host(p1)) == _or_empty(p2, _host(p2)), 0.3).otherwise(0.0)
        + F.when(url_municipal_pattern(u1, u2), url_municipal_similarity(u1, u2))
        .otherwise(_overlap_ratio(_segments(_or_empty(p1, _p(p1, 3))), _segments(_or_empty(p2, _p(p2, 3)))) * 0.5)
        + _overlap_ratio(_query_keys(_or_empty(p1, _p(p1, 4))), _query_keys(_or_empty(p2, _p(p2, 4)))) * 0.2
    )
    return F.when(_valid(p1, u1) & _valid(p2, u2), F.least(score, F.lit(1.0))).otherwise(F.lit(0.0))


def url_common_path(p1, p2) -> Column:
    """``url_common_path``: '/' + leading common segments of two paths."""
    a, b = _segments(_c(p1)), _segments(_c(p2))
    n = F.least(F.size(a), F.size(b))
    idx = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    # first index where they differ (n+1 when none)
    first_diff = F.aggregate(
        idx, n + 1,
        lambda acc, i: F.when((i <= n) & (acc == n + 1) & (F.try_element_at(a, i) != F.try_element_at(b, i)), i)
        .otherwise(acc),
    )
    common = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.slice(a, 1, first_diff - 1))
    return F.concat(F.lit("/"), F.array_join(common, "/"))
