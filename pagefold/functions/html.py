"""HTML string transforms as chained ``regexp_replace`` column expressions.

Only lazy-dot forms are used for script/style/svg removal: the
negative-lookahead form loops for seconds on long scripts in
``java.util.regex`` and can exhaust the stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns (same meaning as the reference's regular expressions).
RE_COMMENT = r"(?s)<!--.*?-->"
RE_SCRIPT = r"(?is)<script\b.*?</script>"
RE_STYLE = r"(?is)<style\b.*?</style>"
RE_SVG = r"(?is)<svg\b.*?</svg>"
RE_LINK = r"(?i)<link[^>]*>"
RE_META = r"(?i)<meta[^>]*>"
RE_WS = r"\s+"
RE_GAP = r">\s+<"

# Main-content patterns, tried in this order and concatenated.
MAIN_CONTENT_PATTERNS = [
    r"(?is)<main.*?</main>",
    r"(?is)<article.*?</article>",
    r"(?is)<section.*?</section>",
    r"(?is)<div[^>]*class[^>]*(?:content|main|article|post|entry)[^>]*>.*?</div>",
]
NOISE_BLOCKS = [
    r"(?is)<header.*?</header>",
    r"(?is)<footer.*?</footer>",
    r"(?is)<nav.*?</nav>",
    r"(?is)<aside.*?</aside>",
]

# Verbose attributes removed before structure analysis (fixed list).
VERBOSE_ATTR_PATTERNS = [
    r'(?i)\s+data-teasertext-[^=]*="[^"]*"',
    r'(?i)\s+data-ionas4-[^=]*="[^"]*"',
    r'(?i)\s+data-more="[^"]*"',
    r'(?i)\s+data-translatable[^=]*="[^"]*"',
    r'(?i)\s+src="[^"]*"',
    r'(?i)\s+srcset="[^"]*"',
    r'(?i)\s+alt="[^"]*"',
    r'(?i)\s+title="[^"]*"',
    r'(?i)\s+aria-label="[^"]*"',
    r'(?i)\s+aria-describedby="[^"]*"',
    r'(?i)\s+role="[^"]*"',
    r'(?i)\s+tabindex="[^"]*"',
    r'(?i)\s+data-track[^=]*="[^"]*"',
    r'(?i)\s+data-analytics[^=]*="[^"]*"',
    r'(?i)\s+data-gtm[^=]*="[^"]*"',
    r"(?i)<span[^>]*>\s*</span>",
    r"(?i)<p[^>]*>\s*<span[^>]*>\s*</span>\s*</p>",
]

TOKEN_CHARS = 3.5


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _strip(h: Column, patterns) -> Column:
    for p in patterns:
        h = F.regexp_replace(h, p, "")
    return h


def token_estimate(text) -> Column:
    """``token_estimate``: ceil(length / 3.5)."""
    return F.ceil(F.length(_c(text)) / F.lit(TOKEN_CHARS)).cast("bigint")


def basic_compress(html) -> Column:
    """``html_basic_compress``: the fixed strip / collapse / trim pipeline."""
    h = _strip(_c(html), [RE_COMMENT, RE_SCRIPT, RE_STYLE, RE_LINK, RE_META])
    h = F.regexp_replace(h, RE_WS, " ")
    h = F.regexp_replace(h, RE_GAP, "><")
    return F.trim(h)


def strip_whitespace(html) -> Column:
    """``html_strip_whitespace``: extra whitespace pass."""
    h = F.regexp_replace(_c(html), RE_WS, " ")
    h = F.regexp_replace(h, RE_GAP, "><")
    h = F.regexp_replace(h, r"^\s+|\s+$", "")
    return F.regexp_replace(h, r"\n\s*\n", "\n")


def truncate_tokens(html, max_tokens: int) -> Column:
    """``html_truncate_tokens``: cut to 4*max chars, back to last '>' past 80 %.

    Applied only when ``max_tokens < 8000`` (the reference's guard).
    """
    h = _c(html)
    if max_tokens >= 8000:
        return h
    max_chars = max_tokens * 4
    cut = F.substring(h, 1, max_chars)
    last_gt = F.length(cut) - F.locate(">", F.reverse(cut)) + 1  # 1-based; len+1 if none
    has_gt = F.locate(">", F.reverse(cut)) > 0
    backed = F.when(has_gt & ((last_gt - 1) > F.lit(max_chars * 0.8)), F.substring(cut, 1, last_gt)).otherwise(cut)
    return F.when(token_estimate(h) <= max_tokens, h).otherwise(backed)


def main_content(html, max_len: int = 20000) -> Column:
    """``html_main_content``: concatenated main/article/section/content-div
    matches; without any, the page minus header/footer/nav/aside."""
    t = _strip(_c(html), [RE_COMMENT, RE_SCRIPT, RE_STYLE])
    t = F.trim(F.regexp_replace(t, RE_WS, " "))
    parts = [F.array_join(F.regexp_extract_all(t, F.lit(p), 0), "\n") for p in MAIN_CONTENT_PATTERNS]
    found = F.concat(*parts)
    fallback = _strip(t, NOISE_BLOCKS)
    out = F.when(found != "", found).otherwise(fallback)
    return F.when(F.length(out) > max_len, F.concat(F.substring(out, 1, max_len), F.lit("..."))).otherwise(out)


def llm_compress(html, max_len: int = 12000) -> Column:
    """``html_llm_compress``: strip + collapse, cap at 12,000 chars + '...'."""
    h = _strip(_c(html), [RE_COMMENT, RE_SCRIPT, RE_STYLE])
    h = F.trim(F.regexp_replace(F.regexp_replace(h, RE_WS, " "), RE_GAP, "><"))
    return F.when(F.length(h) > max_len, F.concat(F.substring(h, 1, max_len), F.lit("..."))).otherwise(h)


def drop_verbose_attrs(html) -> Column:
    """``html_drop_verbose_attrs``."""
    h = _strip(_c(html), VERBOSE_ATTR_PATTERNS)
    h = F.regexp_replace(h, RE_WS, " ")
    h = F.regexp_replace(h, r"\s+>", ">")
    return F.regexp_replace(h, r">\s+", ">")


def truncate_text(html, focused: bool = False) -> Column:
    """``html_truncate_text``: cap text-only h1-6 / p / span / div / a / li / td / th."""
    text_max = 100 if focused else 150
    title_max = 80 if focused else 120
    h = _c(html)
    h = F.regexp_replace(h, rf"(?i)<(h([1-6])[^>]*)>([^<]{{{title_max}}})[^<]+</h[1-6]>", "<$1>$3...</h$2>")
    h = F.regexp_replace(h, r"(?i)<(h([1-6])[^>]*)>([^<]+)</h[1-6]>", "<$1>$3</h$2>")
    for tag in ["p", "span", "div", "a", "li", "td", "th"]:
        h = F.regexp_replace(h, rf"(?i)<({tag}[^>]*)>([^<]{{{text_max}}})[^<]+</{tag}>", f"<$1>$2...</{tag}>")
    return h


def structure_compress(html, focused: bool = False) -> Column:
    """``html_structure_compress``: basic strip plus svg and inline style,
    then verbose attributes and text truncation."""
    h = _strip(_c(html), [RE_COMMENT, RE_SCRIPT, RE_STYLE, RE_SVG,
                          r'(?i)\sstyle\s*=\s*"[^"]*"', r"(?i)\sstyle\s*=\s*'[^']*'"])
    h = F.trim(F.regexp_replace(F.regexp_replace(h, RE_WS, " "), RE_GAP, "><"))
    return truncate_text(drop_verbose_attrs(h), focused)


def js_trim(text) -> Column:
    """String.prototype.trim: strip leading/trailing white space of any kind
    (Spark's ``trim`` removes only spaces)."""
    return F.regexp_replace(_c(text), r"^\s+|\s+$", "")


def strip_tags(html) -> Column:
    """Text of an HTML fragment: tags removed, common entities decoded."""
    t = F.regexp_replace(_c(html), r"<[^>]*>", "")
    return decode_entities(t)


# Fixed entity table (the common named entities plus NBSP).
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
            ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def decode_entities(text) -> Column:
    t = _c(text)
    for ent, ch in ENTITIES:
        t = F.replace(t, F.lit(ent), F.lit(ch))
    return t
