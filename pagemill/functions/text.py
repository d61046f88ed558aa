"""Text and Markdown functions as Column expressions."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\[\]()#*\-!:|]|[^ \n\t\r\[\]()#*\-!:|]+"


def token_count(text: Column) -> Column:
    """An approximate count of tokens: Markdown punctuation marks and runs of anything else but white space."""
    return F.regexp_count(text, F.lit(TOKEN)).cast("bigint")


def slugify(text: Column) -> Column:
    """The anchor of a heading: link targets and emphasis marks go, ASCII is lower-cased, gaps become one dash."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\[([^\[\]]*+)\]\([^)]*+\)", "$1"), r"[*_`~]", "")
    plain = F.regexp_replace(plain, r"[^A-Za-z0-9 \t-]", "")
    return F.regexp_replace(F.regexp_replace(F.lower(plain), r"[ \t-]+", "-"), "^-|-$", "")


def anchor(title: Column) -> Column:
    """The anchor of a table of contents: every other character is a dash."""
    return F.regexp_replace(F.lower(title), "[^a-z0-9]", "-")


def strip_markdown(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[*_`]", ""))


def header_level(line: Column) -> Column:
    """1 to 6 for heading lines, else 0."""
    return F.length(F.regexp_extract(line, r"^(#{1,6}) .+", 1))


def bounded_int(text: Column, most: int) -> Column:
    """A plain decimal number up to ``most``; null for anything else."""
    digits = F.regexp_extract(text, r"^[ \t\n\f\r]*\+?([0-9]+)[ \t\n\f\r]*$", 1)
    number = digits.try_cast("decimal(38,0)")
    return F.when((digits != "") & (number <= most), number.cast("bigint"))


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def frontmatter(md: Column) -> Column:
    """The map of the lines ``key: value`` between leading fences; null if there are none."""
    block = F.regexp_extract(md, r"(?s)^---\n(.*?)\n---\n", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: F.instr(x, ":") > 0)
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]*):", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("v")))
    # the last of several lines with one key counts
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.when(md.rlike(r"(?s)^---\n.*?\n---\n"), F.map_from_entries(last))


def serialize_frontmatter(fields: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def body_of(md: Column) -> Column:
    return F.regexp_replace(md, r"(?s)^---\n.*?\n---\n", "")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("([0-9A-F]{4})"), F.lit(1))
    codes = F.transform(units, lambda u: F.conv(u, 16, 10).cast("bigint"))
    return F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda h, x: (h.bitwiseXOR(x) * 16777619).bitwiseAND(F.lit(4294967295)))


def escape_html(text: Column) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;"))


def escape_markdown(text: Column, at_start: bool | Column = False) -> Column:
    """Escapes what Markdown would read as markup; at the start of a line also headings, lists, quotes and rules."""
    out = F.regexp_replace(text, r"([\\*_~`\[]|<(?=[A-Za-z!/?]))", r"\\$1")
    if at_start is False:
        return out
    # one pattern for all line starts: the mark is the first or, for numbered items, the second group
    begins = F.regexp_replace(out, r"^( ?[0-9]{0,9})(?=(?<=[0-9])[.)] |(?<![0-9])(?:#{1,6} |[-+] |>|---))", r"$1\\")
    return begins if at_start is True else F.when(at_start, begins).otherwise(out)


def escape_yaml(value: Column) -> Column:
    escaped = F.replace(value, F.lit('"'), F.lit('\\"'))
    return F.when(value.rlike(r"[\n:# ]"), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(escaped)


def named_references() -> dict[str, str]:
    """Named references by name without semicolon, the frequent ones first: maps are searched from the front."""
    first = ["amp", "lt", "gt", "quot", "nbsp", "copy", "middot", "apos"]
    table = html.entities.html5
    names = first + sorted({k.rstrip(";") for k in table} - set(first))
    return {n: table.get(n + ";") or table[n] for n in names}


#: Names that need no semicolon, longest first.
LEGACY = sorted((k for k in html.entities.html5 if not k.endswith(";")), key=lambda k: (-len(k), k))

#: Windows-1252 stands in for the C1 controls.
C1 = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)]


def decode_entities(text: Column) -> Column:
    """Decodes character references: numbers, names, and the old names that need no semicolon, longest first."""
    # one literal, folded once
    names = F.from_json(F.lit(json.dumps(named_references())), "map<string,string>")
    legacy = "|".join(LEGACY)
    c1 = F.array(*[F.lit(ord(c)).cast("bigint") for c in C1])

    def number(n: Column) -> Column:
        bad = n.isNull() | (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
        code = F.when(bad, F.lit(0xFFFD)).when(n.between(0x80, 0x9F), F.get(c1, (n - 0x80).cast("int"))).otherwise(n)
        return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

    def one(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^&([A-Za-z][A-Za-z0-9]*);$", 1)
        named = F.when(name != "", F.try_element_at(names, name))
        decimal = F.regexp_extract(piece, r"^&#([0-9]+);?$", 1)
        hexed = F.regexp_extract(piece, r"^&#[xX]([0-9A-Fa-f]+);?$", 1)
        old = F.regexp_extract(piece, rf"^&({legacy})", 1)
        by_number = F.when(decimal != "", number(F.when(F.length(decimal) < 10, decimal.try_cast("bigint")))).when(hexed != "", number(F.when(F.length(hexed) < 9, F.conv(hexed, 16, 10).try_cast("bigint"))))
        by_old = F.when(old != "", F.concat(F.try_element_at(names, old), F.substr(piece, F.length(old) + 2)))
        return F.when(piece.startswith("&"), F.coalesce(by_number, named, by_old, piece)).otherwise(piece)

    pieces = F.regexp_extract_all(text, F.lit(r"(&#[0-9]+;?|&#[xX][0-9A-Fa-f]+;?|&[A-Za-z][A-Za-z0-9]*;?|[^&]+|&)"), F.lit(1))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, one), "")).otherwise(text)
