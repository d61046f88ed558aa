"""Cleaning of Markdown as Column expressions: links and images that say nothing or lead nowhere. Fenced code stays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import text as T

_FENCE = "```"
_FRAGMENT_LINK = r"^\[([^\[\]]*)\]\(#([^()\s]*)\)"


def outside_fences(md: Column, f: Callable[[Column], Column]) -> Column:
    """Applies ``f`` to what is between fences: every other piece of a text that is cut at them."""
    pieces = F.transform(F.split(md, _FENCE), lambda s, i: F.when(i % 2 == 0, f(s)).otherwise(s))
    return F.array_join(pieces, _FENCE)


def drop_empty_images(md: Column) -> Column:
    """Images without alternative text go."""
    return F.regexp_replace(md, r"!\[\s*\]\([^()]*\)", "")


def unwrap_empty_links(md: Column) -> Column:
    """Links to ``#`` alone, and those of scripting and data schemes, become their text."""
    return F.regexp_replace(md, r"(?<!!)\[([^\[\]]*)\]\((?:#|\s*+(?i:javascript|data|vbscript):[^()]*+(?:\([^()]*+\)[^()]*+)*+)\)", "$1")


def drop_textless_links(md: Column) -> Column:
    """Links that show nothing go."""
    return F.regexp_replace(md, r"(?<!!)\[\s*\]\([^()]*\)", "")


def unwrap_redundant_links(md: Column) -> Column:
    """Links whose text is their address become that text."""
    return F.regexp_replace(md, r"(?<!!)\[([^\[\]]+)\]\(\1\)", "$1")


def unwrap_self_headings(md: Column) -> Column:
    """Headings that are nothing but a link to a fragment lose the link."""
    return F.regexp_replace(md, r"(?m)^(#{1,6} )\[([^\[\]]*)\]\(#[^()]*\)[ \t]*$", "$1$2")


def heading_slugs(md: Column) -> Column:
    """The anchors of all headings outside fences."""
    free = F.array_join(F.filter(F.split(md, _FENCE), lambda s, i: i % 2 == 0), "\n")
    return F.transform(F.regexp_extract_all(free, F.lit(r"(?m)^#{1,6} (.+)$"), F.lit(1)), T.slugify)


def unwrap_dead_fragments(md: Column) -> Column:
    """Links to a fragment that no heading of the text has become their text."""
    slugs = heading_slugs(md)

    def one(piece: Column) -> Column:
        to = F.regexp_extract(piece, _FRAGMENT_LINK, 2)
        dead = piece.rlike(_FRAGMENT_LINK) & ~F.array_contains(slugs, to)
        return F.when(dead, F.regexp_replace(piece, _FRAGMENT_LINK, "$1")).otherwise(piece)

    def all_of(part: Column) -> Column:
        # a piece is a link or image to a fragment, or ends before what may be one
        pieces = F.regexp_extract_all(part, F.lit(r"(?s)(!?\[[^\[\]]*\]\(#[^()\s]*\)|.[^\[!]*)"), F.lit(1))
        return F.array_join(F.transform(pieces, one), "")

    return F.when(F.contains(md, F.lit("](#")), outside_fences(md, all_of)).otherwise(md)


def hard_wrap(md: Column, width: int) -> Column:
    """Breaks lines between words where they would pass ``width`` characters; quotes and lists go on in their place.

    Headings, table rows, rules and fenced code stay; a word longer than the width has a line of its own.
    """
    if width < 1:
        raise ValueError("width must be at least 1")

    def line(x: Column) -> Column:
        prefix = F.regexp_extract(x, r"^((?:> ?+)*+ *+(?:(?:[-*+]|[0-9]++[.)]) )?+)", 1)
        tail = F.regexp_extract(x, r"(?<! )( *+)$", 1)
        body = F.substring(x, F.length(prefix) + 1, F.length(x) - F.length(prefix) - F.length(tail))
        indent = F.concat(F.lit("\n"), F.regexp_replace(prefix, "[^> ]", " "))
        room = F.greatest(F.lit(1), width - F.length(prefix))
        words = F.concat(F.lit(r"(\S.{0,"), (room - 1).cast("string"), F.lit(r"}|\S+)(?: +|$)"))
        broken = F.regexp_replace(body, words, F.concat(F.lit("$1"), indent))
        broken = F.concat(prefix, F.substring(broken, F.lit(1), F.length(broken) - F.length(indent)), tail)
        stays = (F.length(x) <= width) | x.rlike(r"^[> ]*(?:#{1,6} |\||---)|^\s*$")
        return F.when(stays, x).otherwise(broken)

    return outside_fences(md, lambda part: F.array_join(F.transform(F.split(part, "\n"), line), "\n"))


def fold_blank_lines(md: Column) -> Column:
    """Runs of empty lines become one; lines of white space alone count as empty."""
    return F.regexp_replace(md, r"\n(?:[ \t]*+\n){2,}+", "\n\n")


#: All cleaning steps by name, in the order in which they are applied.
STEPS: dict[str, Callable[[Column], Column]] = {
    "empty_images": drop_empty_images,
    "empty_links": unwrap_empty_links,
    "empty_link_text": drop_textless_links,
    "redundant_links": unwrap_redundant_links,
    "self_link_headings": unwrap_self_headings,
}


def clean_markdown(md: Column, fragments: bool = True, blank_lines: bool = False, **steps: bool) -> Column:
    """Applies all steps but those given as ``False``, then unwraps dead fragments; ``blank_lines`` are folded on demand."""
    unknown = steps.keys() - STEPS.keys()
    if unknown:
        raise ValueError(f"no such cleaning steps: {sorted(unknown)}")

    def each(part: Column) -> Column:
        for name, step in STEPS.items():
            if steps.get(name, True):
                part = step(part)
        return part

    cleaned = outside_fences(md, each)
    if blank_lines:
        cleaned = outside_fences(cleaned, fold_blank_lines)
    return unwrap_dead_fragments(cleaned) if fragments else cleaned
