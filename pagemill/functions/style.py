"""What utility classes say about an element: bold, italic, struck, hidden."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Breakpoint prefixes, the wider ones win; classes that turn a property on and off.
BREAKPOINTS = ("sm", "md", "lg", "xl", "2xl")
PROPERTIES = {
    "bold": (r"^(?:font-(?:bold|semibold|black|extrabold|medium)|bold)$", r"font-"),
    "italic": (r"^italic$", r"^not-italic$"),
    "struck": (r"^(?:line-through|underline)$", r"^no-underline$"),
    "no_display": (r"^hidden$|invisible", r"^(?:block|flex|inline)$"),
    "off_page": (r"^(?:absolute|fixed|sticky)$", r"^(?:static|relative)$"),
}


def properties(classes: Column) -> Column:
    """Struct of booleans bold, italic, struck and hidden of a class attribute; null classes set none.

    Of the classes that set a property the one of the widest breakpoint counts, and of these the last.
    """
    words = F.filter(F.split(F.coalesce(classes, F.lit("")), r"\s+"), lambda c: c != "")
    ranks = F.array(*map(F.lit, BREAKPOINTS))

    def state(on: str, off: str) -> Column:
        def vote(c: Column, i: Column) -> Column:
            rank = F.array_position(ranks, F.regexp_extract(c, r"^([a-z0-9]+):", 1))
            base = F.when(rank > 0, F.regexp_replace(c, r"^[a-z0-9]+:", "")).otherwise(c)
            return F.struct(rank.alias("rank"), i.alias("i"), base.rlike(on).alias("on"), (base.rlike(on) | base.rlike(off)).alias("counts"))

        last = F.array_max(F.filter(F.transform(words, vote), lambda v: v["counts"]))
        return F.coalesce(last["on"], F.lit(False))

    found = {name: state(*pair) for name, pair in PROPERTIES.items()}
    hidden = found.pop("no_display") | found.pop("off_page")
    return F.struct(*[c.alias(name) for name, c in found.items()], hidden.alias("hidden"))


def marks(classes: Column) -> Column:
    """The Markdown marks that open an element of these classes; they close it in reverse."""
    p = properties(classes)
    return F.concat(F.when(p["bold"], "**").otherwise(""), F.when(p["italic"], "*").otherwise(""), F.when(p["struck"], "~~").otherwise(""))
