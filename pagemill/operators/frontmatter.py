"""Front matter of pages: title and meta tags of the head as fields and as a YAML block; utility classes applied."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import style
from pagemill.functions import text as T
from pagemill.operators import markup as M

# Meta tags that front matter takes.
META = ("description", "keywords", "author", "date", "og:title", "og:description", "twitter:title", "twitter:description")


def fields(rows: DataFrame, meta: Sequence[str] = (), key: str = "page_id") -> DataFrame:
    """key, title and meta (a map) of every page with rows (``markup.tokens``); the last of several values counts.

    Pages without a title have a null one; pages without meta tags an empty map.
    """
    p = M.in_page()
    rows = rows.withColumn("in_head", M.in_head()).withColumn("in_title", (F.lag("tag").over(p) == "title") & (F.lag("kind").over(p) == "open") & (F.col("kind") == "text"))
    name = F.coalesce(M.attribute(F.col("token"), "name"), M.attribute(F.col("token"), "property"))
    rows = rows.withColumn("name", F.when(F.col("tag") == "meta", name)).withColumn("content", F.when(F.col("tag") == "meta", M.attribute(F.col("token"), "content")))
    said = F.trim(F.regexp_replace(T.decode_entities(F.col("token")), r"[ \t\n\f\r]+", " "))
    title = F.when(F.col("in_head") & F.col("in_title") & (said != ""), F.struct("pos", said.alias("t")))
    taken = F.col("in_head") & F.col("name").isin(*META, *meta) & F.col("content").isNotNull()
    values = F.collect_list(F.when(taken, F.struct("name", "pos", "content")))
    found = rows.groupBy(F.col("key").alias(key)).agg(F.max(title)["t"].alias("title"), F.array_sort(values).alias("all"))
    last = F.filter("all", lambda x, i: ~F.coalesce(F.get("all", i + 1)["name"] == x["name"], F.lit(False)))
    return found.select(key, "title", F.map_from_entries(F.transform(last, lambda x: F.struct(x["name"].alias("k"), x["content"].alias("v")))).alias("meta"))


def yaml(title: Column, meta: Column, more: Mapping[str, str] | None = None) -> Column:
    """The front matter block of a page's title and meta; additional fields and meta come by name. Empty without fields."""
    more = {k: v for k, v in (more or {}).items() if k not in ("title", "description")}
    lines = [F.array(F.concat(F.lit("title: "), T.escape_yaml(title)))] + [F.array(F.concat(F.lit(f"{k}: "), T.escape_yaml(F.lit(more[k])))) for k in sorted(more)]
    entries = F.array_sort(F.map_entries(meta))
    quoted = lambda k: F.when(F.contains(k, F.lit(":")), F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k)
    listed = F.transform(entries, lambda e: F.concat(F.lit("  "), quoted(e["key"]), F.lit(": "), T.escape_yaml(e["value"])))
    lines.append(F.when(F.size(entries) > 0, F.concat(F.array(F.lit("meta:")), listed)).otherwise(F.array().cast("array<string>")))
    said = F.filter(F.concat(*lines), lambda x: x.isNotNull())
    return F.when(F.size(said) > 0, F.concat(F.lit("---\n"), F.array_join(said, "\n"), F.lit("\n---\n\n"))).otherwise(F.lit(""))


def styled(rows: DataFrame) -> DataFrame:
    """Token rows with utility classes applied: hidden elements go, spans that are bold, italic or struck become such.

    A span of several of these takes the first.
    """
    has = F.col("kind").isin("open", "void") & F.contains(F.lower("token"), F.lit("class"))
    rows = rows.withColumn("look", F.when(has, style.properties(M.attribute(F.col("token"), "class"))))
    shown = M.without(rows, F.col("look.hidden"))
    as_tag = F.when(F.col("look.bold"), "strong").when(F.col("look.italic"), "em").when(F.col("look.struck"), "del")
    # an end tag is renamed like its start tag
    named = F.max(F.when(M.is_open("span"), as_tag)).over(Window.partitionBy("key", "el"))
    out = shown.withColumn("tag_now", F.coalesce(F.when(F.col("tag") == "span", named), F.col("tag")))
    return out.select("key", "pos", "token", F.col("tag_now").alias("tag"), "kind", "el", "up", "end")
