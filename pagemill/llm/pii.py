r"""Personal data: regular expressions propose spans, checksums confirm them, nearby context words adjust the score.

Every span has a score: what its shape and checksum are worth, raised by words of its kind nearby and lowered by words
that speak of something else, such as order or version numbers. Kinds: email, ip, card (Luhn) and phone stand as
proposed and validated, whatever their score; iban (mod 97), national_id and local_phone are added by the method where
their score reaches ``THRESHOLD`` and no span of the first four kinds covers them. All offsets are code points, the end exclusive. Scanning is linear in the text: patterns are anchored at
``@``, ``+`` or the start of a run of digits.

Defined results: null and empty texts have no spans; matches that fail their check are dropped and not retried,
but an iban is tried without the words that follow it.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "national_id", "local_phone")
BASE = KINDS[:4]
THRESHOLD = 0.5
#: How far before and after a span context words count, in code points.
CONTEXT = 40
SPAN_TYPE = "array<struct<kind:string,start:int,stop:int,score:double>>"

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])")
_WORDS = {
    "email": ("mail", "contact"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "contact"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "national_id": ("ssn", "social", "security", "passport", "identity"),
    "local_phone": ("phone", "tel", "call", "fax", "mobile", "contact"),
}
#: Words that speak against personal data, and what a word for or against is worth.
_AGAINST = ("order", "invoice", "part", "serial", "isbn", "version", "release", "build", "article", "item", "sku", "reference")
_WORTH = 0.3
#: Score before context: a passed checksum counts for more than a shape.
_PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.8, "iban": 0.9, "national_id": 0.4, "local_phone": 0.4}


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an account number without spaces leaves 1 modulo 97, its first four characters moved to the end."""
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _ibans(text: str) -> list[tuple[int, int]]:
    """Account numbers; a word that follows one and was taken with it is left again, group by group."""
    out = []
    for m in _IBAN.finditer(text):
        stop = m.end()
        while not mod97(text[m.start() : stop].replace(" ", "")):
            stop = text.rfind(" ", m.start(), stop)
            if stop < 0:
                break
        else:
            out.append((m.start(), stop))
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    out, free = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            free = m.end()
    return out


def _proposed(text: str) -> list[tuple[str, int, int]]:
    spans = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return spans


def _score(text: str, kind: str, start: int, stop: int) -> float:
    before, after = (re.findall(r"[^\W\d_]+", part.lower()) for part in (text[max(0, start - CONTEXT) : start], text[stop : stop + CONTEXT]))
    # what a number is of stands before it
    told = any(w.startswith(_WORDS[kind]) for w in before + after) - any(w in _AGAINST for w in before[-2:])
    return round(min(1.0, _PRIOR[kind] + _WORTH * told), 2)


def find_spans(text: str | None) -> list[dict]:
    """All spans of one text by kind as listed, then start."""
    if not text:
        return []
    base = _proposed(text)
    more = [("iban", *span) for span in _ibans(text)]
    more += [("national_id", *m.span()) for m in _NATIONAL.finditer(text)] + [("local_phone", *m.span()) for m in _LOCAL_PHONE.finditer(text)]
    out = [(*s, _score(text, *s)) for s in base]
    taken = sorted((a, b) for _, a, b in base)
    for kind, a, b in more:
        score = _score(text, kind, a, b)
        if score >= THRESHOLD and not any(x < b and a < y for x, y in taken):
            out.append((kind, a, b, score))
    out.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
    return [{"kind": k, "start": a, "stop": b, "score": s} for k, a, b, s in out]


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, of the first's kind."""
    spans = sorted((s["start"], s["stop"], s["kind"]) for s in find_spans(text))
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, stop, kind = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < stop:
            i += 1
            stop = max(stop, spans[i][1])
        out += [text[at:start], f"[{kind.upper()}]"]
        at, i = stop, i + 1
    return "".join([*out, text[at:]])


def spans_of(text: str) -> Column:
    """Column of spans of a column of texts."""

    @F.pandas_udf(SPAN_TYPE)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([find_spans(t) for t in texts], dtype=object)

    return spans(text)


def redacted(text: str) -> Column:
    """Column of redacted texts."""

    @F.pandas_udf("string")
    def texts_without(texts: pd.Series) -> pd.Series:
        return pd.Series([redact(t) for t in texts], dtype=object)

    return texts_without(text)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, stop, score) of every row."""
    return docs.select("doc_id", spans_of("text").alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, the hash of the base spans, all spans and their scores as text, of each row of ``find_personal_data``."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    scores = F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",")
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), scores.alias("scores"))


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in text replaced and n_chars counted anew."""
    cols = docs.columns
    out = docs.withColumn("text", redacted("text"))
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).select(*cols) if "n_chars" in cols else out
