"""DuckDB SQL snippets for the oracle queries.

These build plain SQL *text* for the independent DuckDB check of each
registered query (``__spark_entry__.oracle_sql``).  They are written
directly in DuckDB's dialect (RE2 regexes, ``list_*`` functions) and share
no code with the Spark implementations.
"""

from __future__ import annotations

from pagefold.functions.url import URL_RE

URL = URL_RE.replace("'", "''")


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rx_replace(e: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({e}, {q(pattern)}, {q(repl)}, 'g')"


def strip(e: str, patterns) -> str:
    for p in patterns:
        e = rx_replace(e, p)
    return e


def scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, '{URL}', 1))"


def authority(u: str) -> str:
    return f"regexp_extract({u}, '{URL}', 3)"


def host(u: str) -> str:
    return f"lower(regexp_extract({authority(u)}, '^(?:[^@]*@)?(\\[[^\\]]*\\]|[^:]*)', 1))"


def port(u: str) -> str:
    return f"regexp_extract({authority(u)}, '^(?:[^@]*@)?(?:\\[[^\\]]*\\]|[^:]*):([0-9]*)$', 1)"


def path(u: str) -> str:
    return f"regexp_extract({u}, '{URL}', 4)"


def query(u: str) -> str:
    return f"regexp_extract({u}, '{URL}', 5)"


def fragment(u: str) -> str:
    return f"regexp_extract({u}, '{URL}', 6)"


SPECIAL = "('http','https','ftp','ws','wss','file')"


def valid(u: str) -> str:
    return (f"coalesce(({u} IS NOT NULL AND regexp_matches({u}, '{URL}') AND "
            f"({scheme(u)} NOT IN {SPECIAL} OR ({host(u)} <> '' AND NOT regexp_matches({host(u)}, '\\s')))), false)")


def host_or_self(u: str) -> str:
    return f"CASE WHEN {valid(u)} THEN {host(u)} ELSE {u} END"


def normalize(u: str) -> str:
    p = path(u)
    return (f"CASE WHEN {valid(u)} THEN {scheme(u)} || '://' || {host(u)} || "
            f"CASE WHEN {p} = '' AND {scheme(u)} IN {SPECIAL} THEN '/' ELSE {p} END ELSE {u} END")


def dot_segments(p: str) -> str:
    """Dot-segment removal: repeated regex passes (enough for 8 levels)."""
    e = p
    for _ in range(8):
        e = f"regexp_replace({e}, '/\\.(/|$)', '/')"
    for _ in range(8):
        e = f"regexp_replace({e}, '/[^/]+/\\.\\.(/|$)', '/')"
    e = f"regexp_replace({e}, '^/\\.\\.(/|$)', '/')"
    e = f"regexp_replace({e}, '^(/\\.\\.)+(/|$)', '/')"
    return f"CASE WHEN contains({p}, '/.') THEN {e} ELSE {p} END"


def canonical(u: str) -> str:
    s = scheme(u)
    h = host(u)
    pt = port(u)
    p = path(u)
    p1 = f"CASE WHEN {p} = '' AND {s} IN {SPECIAL} THEN '/' ELSE {p} END"
    p2 = f"CASE WHEN {s} IN {SPECIAL} THEN {dot_segments(p1)} ELSE {p1} END"
    default = ("CASE {s} WHEN 'http' THEN '80' WHEN 'https' THEN '443' WHEN 'ftp' THEN '21' "
               "WHEN 'ws' THEN '80' WHEN 'wss' THEN '443' ELSE '' END").format(s=s)
    keep_port = f"({pt} <> '' AND {default} <> {pt})"
    userinfo = f"regexp_extract({authority(u)}, '^([^@]*@)', 1)"
    has_auth = f"(regexp_extract({u}, '{URL}', 2) <> '')"
    rebuilt = (f"{s} || ':' || CASE WHEN {has_auth} THEN '//' || {userinfo} || {h} || "
               f"CASE WHEN {keep_port} THEN ':' || {pt} ELSE '' END ELSE '' END || {p2} || {query(u)} || {fragment(u)}")
    return f"CASE WHEN {valid(u)} THEN {rebuilt} ELSE {u} END"


def resolve_join(href: str, base: str) -> str:
    """Stage 1 of URL resolution: raw joined URL, NULL if the base is unusable."""
    h = f"trim({href})"
    bs = scheme(base)
    origin = f"({bs} || '://' || {authority(base)})"
    bp = f"(CASE WHEN {path(base)} = '' THEN '/' ELSE {path(base)} END)"
    bdir = f"regexp_extract({bp}, '^(.*/)', 1)"
    nofrag = f"({origin} || {bp} || {query(base)})"
    sch = "'^[a-zA-Z][a-zA-Z0-9+.\\-]*:'"
    base_ok = f"({valid(base)} AND {bs} IN {SPECIAL})"
    return (f"(CASE WHEN regexp_matches({h}, {sch}) THEN {h} WHEN NOT {base_ok} THEN NULL "
            f"WHEN starts_with({h}, '//') THEN {bs} || ':' || {h} "
            f"WHEN starts_with({h}, '/') THEN {origin} || {h} "
            f"WHEN starts_with({h}, '?') THEN {origin} || {bp} || {h} "
            f"WHEN starts_with({h}, '#') THEN {nofrag} || {h} "
            f"WHEN {h} = '' THEN {nofrag} "
            f"ELSE {origin} || {bdir} || {h} END)")


def resolve_final(href: str, joined: str, canon: str) -> str:
    """Stage 3: canonical URL when valid, else the original href."""
    return f"(CASE WHEN {joined} IS NOT NULL AND {valid(canon)} THEN {canon} ELSE {href} END)"


def segments(p: str) -> str:
    return f"list_filter(string_split({p}, '/'), lambda x: x <> '')"


def query_keys(u: str) -> str:
    qs = f"regexp_replace({query(u)}, '^\\?', '')"
    return (f"list_transform(list_filter(string_split({qs}, '&'), lambda x: x <> ''), "
            f"lambda p: regexp_extract(p, '^([^=]*)', 1))")


def overlap(a: str, b: str) -> str:
    common = f"len(list_filter({a}, lambda x: list_contains({b}, x)))"
    return (f"(CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0e0 "
            f"WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0e0 "
            f"ELSE {common} / greatest(len({a}), len({b})) END)")


def path_similarity(u1: str, u2: str) -> str:
    return overlap(segments(path(u1)), segments(path(u2)))


def query_similarity(u1: str, u2: str) -> str:
    return overlap(query_keys(u1), query_keys(u2))


MUNI = ["\\d{4,6}\\.htm", "\\+.*\\+.*\\.htm", "lnav=\\d+"]
MUNI_KW = ["sitzung", "tagesordnung", "protokoll", "beschluss", "bericht", "ausschuss",
           "gemeinderat", "stadtrat", "oeffentlich", "öffentlich", "veranstaltung"]


def municipal_pattern(u1: str, u2: str) -> str:
    return "(" + " OR ".join(f"(regexp_matches({u1}, {q(p)}) AND regexp_matches({u2}, {q(p)}))" for p in MUNI) + ")"


def municipal_similarity(u1: str, u2: str) -> str:
    f1 = f"regexp_extract({path(u1)}, '([^/]*)$', 1)"
    f2 = f"regexp_extract({path(u2)}, '([^/]*)$', 1)"
    kw = " OR ".join(f"(contains(lower({f1}), {q(k)}) AND contains(lower({f2}), {q(k)}))" for k in MUNI_KW)
    return (f"((CASE WHEN contains({f1}, '.htm') AND contains({f2}, '.htm') THEN 0.2e0 ELSE 0.0e0 END) + "
            f"(CASE WHEN regexp_matches({f1}, '\\d{{4,6}}\\.htm') AND regexp_matches({f2}, '\\d{{4,6}}\\.htm') THEN 0.3e0 ELSE 0.0e0 END) + "
            f"(CASE WHEN regexp_matches({f1}, '\\+.*\\+') AND regexp_matches({f2}, '\\+.*\\+') THEN 0.2e0 ELSE 0.0e0 END) + "
            f"(CASE WHEN {kw} THEN 0.1e0 ELSE 0.0e0 END))")


def similarity(u1: str, u2: str) -> str:
    score = (f"((CASE WHEN {host(u1)} = {host(u2)} THEN 0.3e0 ELSE 0.0e0 END) + "
             f"(CASE WHEN {municipal_pattern(u1, u2)} THEN {municipal_similarity(u1, u2)} "
             f"ELSE {path_similarity(u1, u2)} * 0.5e0 END) + {query_similarity(u1, u2)} * 0.2e0)")
    return f"(CASE WHEN {valid(u1)} AND {valid(u2)} THEN least({score}, 1.0e0) ELSE 0.0e0 END)"


ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
            ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def strip_tags(e: str) -> str:
    t = rx_replace(e, "<[^>]*>")
    for ent, ch in ENTITIES:
        t = f"replace({t}, {q(ent)}, {q(ch)})"
    return t


def contains_any(e: str, words) -> str:
    return "(" + " OR ".join(f"contains({e}, {q(w)})" for w in words) + ")"
