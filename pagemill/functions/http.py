"""Content negotiation as a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKDOWN = ("text/markdown", "text/plain")
HTML = ("text/html", "application/xhtml+xml")
WILD = ("*/*", "text/*")


def accepted(accept: Column) -> Column:
    """The entries of an Accept header: type, q and position, in order."""
    parts = F.transform(F.split(accept, ","), lambda p, i: F.struct(F.trim(p).alias("p"), i.alias("i")))

    def entry(x: Column) -> Column:
        q = F.regexp_extract(x["p"], r";.*?q=([^; ]*)", 1)
        has_q = x["p"].rlike(r";.*?q=")
        kind = F.lower(F.trim(F.regexp_extract(x["p"], r"^([^;]*)", 1)))
        return F.struct(kind.alias("type"), F.when(has_q, F.coalesce(q.try_cast("double"), F.lit(0.0))).otherwise(F.lit(1.0)).alias("q"), x["i"].alias("position"))

    return F.transform(F.filter(parts, lambda x: x["p"] != ""), entry)


def negotiate(accept: Column, sec_fetch_dest: Column) -> Column:
    """``markdown``, ``html`` or ``not-acceptable``.

    The best Markdown entry wins over the best HTML entry by q, then by position. A wildcard stands in for a type that
    is not listed; a type with q = 0 is refused, and a wildcard does not bring it back.
    """
    entries = accepted(F.coalesce(accept, F.lit("")))

    def best(kinds: tuple[str, ...]) -> Column:
        live = F.filter(entries, lambda e: e["type"].isin(*kinds) & (e["q"] > 0))
        return F.array_max(F.transform(live, lambda e: F.struct(e["q"].alias("q"), (-e["position"]).alias("p"))))

    def refused(kinds: tuple[str, ...]) -> Column:
        return F.exists(entries, lambda e: e["type"].isin(*kinds) & (e["q"] <= 0))

    wild = best(WILD)
    md = F.coalesce(best(MARKDOWN), F.when(~refused(MARKDOWN), wild))
    page = F.coalesce(best(HTML), F.when(~refused(HTML), wild))
    return (
        F.when((F.coalesce(sec_fetch_dest, F.lit("")) == "document") | (F.coalesce(accept, F.lit("")) == ""), "html")
        .when(md.isNotNull() & (page.isNull() | (md > page)), "markdown")
        .when(page.isNotNull(), "html")
        .otherwise("not-acceptable")
    )
