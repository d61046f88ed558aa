"""HTML as rows: one row per tag or text run of a page, with its place in the tree found by windows.

A page is cut into tokens by one regular expression, and tags are matched by a stack (``tree``), so that all elements
nest. What else conversion, extraction and filtering need to know of the tree is a running sum or a neighbour within the page:
how deep in lists, whether in a cell. Pages are dealt by their key before they are cut, and again behind the stack, as Spark
forgets how rows lie where they pass through Python. No window or aggregate over token rows shuffles after that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import tree

#: Elements whose content is no markup and goes.
RAW = ("script", "style", "noscript", "iframe", "noframes", "noembed", "datalist")
#: Elements whose content is no markup but text.
PLAIN = ("title", "textarea", "xmp", "plaintext")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Boundaries between blocks of text.
BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title",
    "tr", "ul", *HEADINGS,
)
# Every repeated group is possessive: Java runs others by recursion, and a long page would overflow the stack. A quote
# counts behind an equals sign only; one that is never closed, like a tag that is not, takes the rest of the page.
_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?=["']).*+|[^\s>"'][^\s>]*+)?+)*+"""
# What a script holds: in a comment it may hold scripts of its own.
_INNER = r"(?:[^<-]++|-(?!->)|<(?!/(?i:script)[\s/>]))*+(?:</(?i:script)(?=[\s/>]))?+"
_COMMENT = rf"<!--(?:-?>|(?:[^<-]++|-(?!->)|<(?i:script)(?=[\s/>]){_INNER}|<(?!/?(?i:script)[\s/>]))*+(?:-->)?+)"
_SCRIPT = rf"(?:[^<]++|{_COMMENT}|<(?!/(?i:script)[\s/>]))*+"
TOKEN = (
    r"(?s)<!--(?:-?>|.*?(?:--!?>|\z))|<!\[CDATA\[.*?(?:\]\]>|\z)"
    rf"|<(?i:script)(?=[\s/>]){_REST}(?:(?<!/)>{_SCRIPT}(?:</(?i:script){_REST}>?+|\z)|\z)"
    rf"|<(?i:({'|'.join(RAW[1:])}))(?=[\s/>]){_REST}(?:(?<!/)>.*?(?:</(?i:\1)(?=[\s/>]){_REST}>?+|\z)|\z)"
    rf"|<(?i:({'|'.join(PLAIN)}))(?=[\s/>]){_REST}(?:(?<!/)>.*?(?=</(?i:\2)[\s/>]|\z)|\z)"
    rf"|<[!?][^>]*+(?:>|\z)|</?[a-zA-Z][^\s/>]*+{_REST}(?:>|\z)|[^<]++|<"
)
_PLAIN = rf"(?s)^(<(?i:{'|'.join(PLAIN)})(?=[\s/>]){_REST}(?<!/)>)(.++)"
ATTRIBUTE = r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?"""


def _before(name: str) -> str:
    """What stands in a tag before its first attribute of a name."""
    return rf"""(?is)^<[^\s/>]++(?:[\s/]++(?!{name}[\s=/>])[^\s=/>]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+[\s/]++{name}"""


def has_attribute(tag: Column, name: str) -> Column:
    """Whether a tag's source has an attribute, with a value or without."""
    return tag.rlike(_before(name) + r"(?=[\s=/>])")


def raw_attribute(tag: Column, name: str) -> Column:
    """An attribute of a tag's source as written; null if it has none. The first of several counts."""
    quoted = F.regexp_extract(tag, _before(name) + r"""\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)""", 1)
    bare = F.when(quoted.rlike("^[\"']"), F.substring(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(quoted)
    return F.when(quoted != "", bare)


def attribute(tag: Column, name: str) -> Column:
    """An attribute of a tag's source, decoded."""
    return T.decode_entities(raw_attribute(tag, name))


def attributes(tag: Column) -> Column:
    """All attributes of a tag's source by lower-cased name, values decoded; the first of several counts."""
    inner = F.regexp_replace(F.regexp_replace(tag, r"^<[^\s/>]+", ""), r"/?>$", "")
    found = F.regexp_extract_all(inner, F.lit(f"({ATTRIBUTE})"), F.lit(1))

    def pair(source: Column) -> Column:
        value = F.regexp_extract(source, r"(?s)=\s*(.*)$", 1)
        value = F.when(value.rlike("^[\"']"), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
        return F.struct(F.lower(F.regexp_extract(source, r"^([^\s=]+)", 1)).alias("k"), T.decode_entities(value).alias("v"))

    pairs = F.transform(found, pair)
    return F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, 1, i), lambda q: q["k"] == p["k"])))


def _cut(html: Column) -> Column:
    """The tags and texts of a page's source as (token, mark), for ``tree.nest``."""

    def told(token: Column) -> Column:
        """A token and its head, found once: ``<name`` or ``</name``, lower-cased; empty for other markup, null for text."""
        return F.struct(token.alias("token"), F.when(token.startswith("<"), F.lower(F.regexp_extract(token, r"^</?[a-zA-Z][^\s/>]*", 0))).alias("head"))

    def parts(x: Column) -> Column:
        text = F.regexp_extract(x["token"], _PLAIN, 2)
        as_text = F.struct(text.alias("token"), F.lit("t").alias("mark"))
        split = F.when(text != "", F.array(_marked(F.regexp_extract(x["token"], _PLAIN, 1), x["head"]), as_text))
        whole = F.array(_marked(x["token"], x["head"]))
        return F.when(x["head"].isin(*[f"<{t}" for t in PLAIN]), F.coalesce(split, whole)).otherwise(whole)

    return F.flatten(F.transform(F.transform(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0)), told), parts))


def _marked(token: Column, head: Column) -> Column:
    ended = token.endswith("/>") & ~token.rlike(r"=[^\s\"'>]*/>\z")
    kind = (
        F.when(head.isNull() | (token == "<"), "t")
        .when((head == "") | ~token.endswith(">") | head.isin(*[f"{at}{t}" for t in RAW for at in ("<", "</")]), "x")
        .when(head.startswith("</"), F.substr(head, F.lit(2)))
        .when(head.isin(*[f"<{t}" for t in VOID]), F.concat(F.lit("."), F.substr(head, F.lit(2))))
        .otherwise(F.when(ended, F.concat(F.lit("!"), F.substr(head, F.lit(2)))).otherwise(head))
    )
    return F.struct(token.alias("token"), kind.alias("mark"))


#: Bytes of pages that one task takes: its sorts hold about a hundred times as much.
TASK_BYTES = 4 << 20


def tasks(pages: DataFrame, html: str = "html") -> int:
    """How many tasks convert the pages: as many as the session's shuffles have, more where each would get more than ``TASK_BYTES``.

    Whole pages are measured in one pass, as neither a file's compressed size nor a number of rows tells.
    """
    total = pages.agg(F.sum(F.octet_length(html))).first()[0] or 0
    return max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))


def tokens(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, pos, token, kind (open, close, void or text), tag, el, up and end of every page; comments and raw elements are gone.

    Elements nest: end tags that are left out are rows too, others that match nothing are not. ``el`` is where the row's element begins
    (of a start and an end tag alike), ``up`` where its parent does (-1 without), ``end`` where the element ends.
    """
    dealt = pages.select(F.col(key).alias("key"), F.coalesce(html, F.lit("")).alias("html"))
    n = tasks(pages, html)
    cut = dealt.repartition(n, "key").select("key", _cut(F.col("html")).alias("cut"))
    placed = cut.select("key", "cut", tree.nested(F.transform("cut", lambda c: c["mark"])).alias("nested"))
    # a number that is asked for stays: sized by what was shuffled, too few tasks would share the rows of all tokens
    placed = placed.repartition(n, "key")

    def row(x: Column) -> Column:
        return F.struct(F.get("cut", F.when(x["of"] < 0, -1 - x["of"]).otherwise(x["of"])).alias("given"), x.alias("x"))

    # an outer explode: Spark would test a plain one's array for emptiness below, and cut the page once more for that
    rows = placed.select("key", F.posexplode_outer(F.transform("nested", row)).alias("pos", "row")).where("pos is not null")
    # told behind the explode, where code is compiled
    implied = F.col("row.x.of") < 0
    mark = F.col("row.given.mark")
    tag = F.substr(mark, F.lit(2))
    kind = F.when(implied, "close").when(mark == "t", "text").when(mark.startswith("/"), "close").when(mark.startswith("."), "void").otherwise("open")
    token = F.when(implied, F.concat(F.lit("</"), tag, F.lit(">"))).otherwise(F.col("row.given.token"))
    return rows.select("key", "pos", token.alias("token"), tag.alias("tag"), kind.alias("kind"), "row.x.el", "row.x.up", "row.x.end")


def in_page() -> Window:
    return Window.partitionBy("key").orderBy("pos")


def up_to_here() -> Window:
    """The page up to and including this row."""
    return in_page().rowsBetween(Window.unboundedPreceding, 0)


def so_far(value: Column) -> Column:
    """The sum of a value over the page up to and including this row."""
    return F.sum(value).over(up_to_here())


def is_open(*tags: str) -> Column:
    return (F.col("kind") == "open") & F.col("tag").isin(*tags)


def is_close(*tags: str) -> Column:
    return (F.col("kind") == "close") & F.col("tag").isin(*tags)


def depth(*tags: str) -> Column:
    """How many of the elements are open at this row, the row included."""
    step = F.when(is_open(*tags), 1).when(is_close(*tags), -1).otherwise(0)
    return F.greatest(so_far(step), F.lit(0))


def in_head() -> Column:
    """Whether this row is in a head, its tags included."""
    reach = F.max(F.when(is_open("head"), F.col("end"))).over(in_page().rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(F.col("pos") <= reach, F.lit(False))


def without_head(rows: DataFrame) -> DataFrame:
    """Drops the head, closed or not."""
    return rows.withColumn("in_head", in_head()).where("not in_head").drop("in_head")


def without(rows: DataFrame, chosen: Column) -> DataFrame:
    """Drops the elements whose opening or void tag is ``chosen``, with all they hold."""
    marked = rows.withColumn("hit", F.col("kind").isin("open", "void") & F.coalesce(chosen, F.lit(False)))
    # the furthest end of any chosen element that began before
    reach = F.max(F.when(F.col("hit"), F.col("end"))).over(in_page().rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("reach", reach).where("reach is null or pos > reach").drop("hit", "reach")


def within(rows: DataFrame, chosen: Column) -> DataFrame:
    """Keeps the elements whose opening tag is ``chosen``, with all they hold."""
    marked = rows.withColumn("hit", F.col("kind").isin("open", "void") & F.coalesce(chosen, F.lit(False)))
    reach = F.max(F.when(F.col("hit"), F.col("end"))).over(in_page().rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("reach", reach).where("pos <= reach").drop("hit", "reach")


def isolate_main(rows: DataFrame) -> DataFrame:
    """The head, and what the first ``main`` holds; without one, from the first heading outside headers to the next footer."""
    whole = Window.partitionBy("key")
    marked = rows.withColumn("in_head", in_head()).withColumn("in_header", depth("header") > 0)
    start = F.min(F.when(is_open("main"), F.struct("pos", "end"))).over(whole)
    heading = F.min(F.when(is_open(*HEADINGS) & ~F.col("in_header"), F.col("pos"))).over(whole)
    marked = marked.withColumn("main", start).withColumn("heading", heading)
    footer = F.min(F.when(is_open("footer") & (F.col("pos") > F.col("heading")), F.col("pos"))).over(whole)
    marked = marked.withColumn("footer", footer)
    by_main = F.col("pos").between(F.col("main.pos"), F.col("main.end"))
    # elements that go on beyond the footer are ended all the same, those that began before the heading are not
    begun = (F.col("el") >= F.col("heading")) & F.coalesce(F.col("el") < F.col("footer"), F.lit(True))
    by_heading = (F.col("pos") >= F.col("heading")) & F.when(F.col("kind") == "close", begun).otherwise(F.coalesce(F.col("pos") < F.col("footer"), F.lit(True)))
    keep = F.col("in_head") | F.when(F.col("main").isNotNull(), by_main).when(F.col("heading").isNotNull(), by_heading).otherwise(F.lit(True))
    return marked.where(keep).select("key", "pos", "token", "tag", "kind", "el", "up", "end")


def plain_text(rows: DataFrame) -> DataFrame:
    """Decoded text of each row; null for tags."""
    return rows.withColumn("text", F.when(F.col("kind") == "text", T.decode_entities(F.col("token"))))
