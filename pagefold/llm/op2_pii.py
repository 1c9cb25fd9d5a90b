"""Personal data by anchor expansion (operator 2).

One Aho-Corasick pass per text finds anchors: at-signs, digits, plus signs,
``://`` and identifier cues.  At each anchor a small deterministic parser
expands to the boundaries of the thing and validates it; nothing scans the text
with an unanchored pattern, so a text costs time in proportion to its length.

Base kinds: ``email``, ``ip`` (parts at most 255), ``card`` (16 to 19 digits,
Luhn), ``phone`` (8 to 15 digits), each leftmost and non-overlapping in its
kind, failing matches dropped without a second try.  Added kinds, listed after
them: ``address`` (an email address with letters beyond ASCII), ``credential``
(user and password inside a URL), ``account`` (an identifier after a cue such
as ``account no`` or ``IBAN``, the latter with its check digits) and ``secret``
(a key or token after a cue).

Spans are in code points, end exclusive.  Map only: no shuffle.

Cases: a null text has no spans and stays null when redacted; null ids and
repeated rows give one row per input row; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.llm.common import read, text_column
from pagefold.plans.catalog import register

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "credential", "account", "secret")

ACCOUNT_CUES = ("account", "acct", "iban", "konto", "compte", "cuenta", "passport", "reisepass", "passeport",
                "pasaporte", "ssn", "customer id", "member id", "user id")
SECRET_CUES = ("token", "api key", "api_key", "apikey", "secret", "password", "passwd", "passwort", "private key",
               "access key", "access_key")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
WIDE_DOMAIN = re.compile(r"[^\W_](?:[\w-]{0,62}[^\W_])?(?:\.[^\W_](?:[\w-]{0,62}[^\W_])?)+")
USERINFO = re.compile(r"[^\s/?#@:\"'<>]+:[^\s/?#@\"'<>]+(?=@[A-Za-z0-9])")
AFTER_ACCOUNT = re.compile(r"(?:[ _-]?(?:no|nr|number|num|nummer|id))?\.?[ \t]{0,3}[:=#]{0,2}[ \t]{0,3}[\"']?"
                           r"([A-Za-z0-9](?:[ -]?[A-Za-z0-9]){5,33})(?![A-Za-z0-9])")
AFTER_SECRET = re.compile(r"[\"']?[ \t]{0,3}(?:[:=]|is|=>)[ \t]{0,3}[\"']?([A-Za-z0-9_+/=.-]{12,})")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def iban(text: str) -> bool:
    s = re.sub("[ -]", "", text).upper()
    if not re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


@lru_cache(maxsize=1)
def _anchors():
    """One automaton per worker process; cues in lower, title and upper case."""
    import ahocorasick
    found = ahocorasick.Automaton()
    for sign in "@+0123456789":
        found.add_word(sign, (sign if sign in "@+" else "0", 1))
    found.add_word("://", (":", 3))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.title(), cue.capitalize(), cue.upper()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def find(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, each in order of their start."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return spans
    done = dict.fromkeys(KINDS, 0)  # where the last match of a kind ended, valid or not
    for last, (what, size) in _anchors().iter(text):
        at = last - size + 1
        if what == "0":
            if at and text[at - 1] in DIGITS:
                continue  # inside a run of digits
            if at >= done["ip"] and (m := IP.match(text, at)):
                done["ip"] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                    spans["ip"].append(m.span())
            if at >= done["card"] and (m := CARD.match(text, at)):
                done["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    spans["card"].append(m.span())
        elif what == "+":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                done["phone"] = m.end()
                if 8 <= sum(c in DIGITS for c in m[0]) <= 15:
                    spans["phone"].append(m.span())
        elif what == "@":
            start = at
            while start > done["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                done["email"] = m.end()
                spans["email"].append((start, m.end()))
            _wide(text, at, done, spans)
        elif what == ":":
            if m := USERINFO.match(text, last + 1):
                spans["credential"].append(m.span())
        elif not at or not text[at - 1].isalnum():
            _after_cue(text, last + 1, what, done, spans)
    return spans


def _wide(text: str, at: int, done: dict, spans: dict) -> None:
    """An address with letters beyond ASCII around an at-sign, unless it is a base one as it stands."""
    start, floor = at, done["address"]
    while start > floor and (text[start - 1].isalnum() or text[start - 1] in LOCAL):
        start -= 1
    m = WIDE_DOMAIN.match(text, at + 1) if start < at else None
    if m and not text[start:m.end()].isascii():
        done["address"] = m.end()
        spans["address"].append((start, m.end()))


def _after_cue(text: str, at: int, kind: str, done: dict, spans: dict) -> None:
    m = (AFTER_ACCOUNT if kind == "account" else AFTER_SECRET).match(text, at)
    if not m or m.start(1) < done[kind]:
        return
    value, (a, b) = m[1], m.span(1)
    digits = sum(c in DIGITS for c in value)
    if kind == "account":
        # Up to the first blank that is not between groups of digits or an IBAN's groups.
        if not iban(value):
            value = value.split(" ")[0]
            digits, b = sum(c in DIGITS for c in value), a + len(value)
        if len(value) < 6 or digits < 4:
            return
    else:
        value = value.rstrip(".")
        b = a + len(value)
        if len(value) < 12 or digits < 3 or value.isdigit():
            return
    done[kind] = b
    spans[kind].append((a, b))


def written(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` by kind as listed, then start."""
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def redact(text: str | None) -> str | None:
    """Each span replaced by its kind in brackets; overlapping ones by the first kind listed."""
    if not text:
        return text
    found = sorted((a, -b, n, k) for n, (k, own) in enumerate(find(text).items()) for a, b in own)
    out, at = [], 0
    for a, minus_b, _, kind in found:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, -minus_b)
    return "".join(out) + text[at:]


def spans_of(text: Column) -> Column:
    """Struct column: counts of the base kinds, the base spans and all spans, written out."""
    def each(texts):
        for text in texts:
            s = find(text)
            yield (*(len(s[k]) for k in BASE), written(s, BASE), written(s, KINDS), sum(len(s[k]) for k in KINDS[len(BASE):]))
    counts = [f"n_{k}" for k in BASE]
    return text_column(
        lambda texts: list(each(texts)), ", ".join(f"{c} long" for c in counts) + ", base string, spans string, n_added long",
        pa.struct([*((c, pa.int64()) for c in counts), ("base", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())]))(text)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Counts and spans per row of ``docs(doc_id, text)``."""
    s = docs.select("doc_id", spans_of(F.col("text")).alias("s"))
    return s.select("doc_id", "s.n_email", "s.n_ip", "s.n_card", "s.n_phone",
                    F.sha2("s.base", 256).alias("base_sha256"), "s.spans", "s.n_added")


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with redacted texts; ``n_chars``, where there is one, follows the text."""
    out = docs.withColumn("text", text_column(lambda texts: [redact(t) for t in texts], "string", pa.string())(docs["text"]))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(),
                                               F.char_length("text").cast(docs.schema["n_chars"].dataType))
                             .otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


@register("op2_pii")
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document."""
    return find_personal_data(read(spark, sf_dir, "documents", "doc_id", "text"))
