"""Conversion of pages to Markdown, plain text and safe HTML, over the rows of ``markup.tokens``.

Each row becomes a piece: text, or a marker of its tag. How pieces are separated depends on the block boundaries
between them, which windows within the page tell. Pieces are joined in order once per page. Spaces and line breaks
that must survive the final clean-up, and marks of emphasis, are carried as noncharacters.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.functions import url as U
from pagemill.operators import markup as M
from pagemill.operators import selectors as S

# Carriers of what must survive the final clean-up, and of marks until empty pairs of them are gone: noncharacters,
# which no text may hold. A page that does has U+FFFD in their place.
SPACE, BREAK, _STRONG, _EM, _DEL, _STRONG_END, _EM_END, _DEL_END = (chr(c) for c in range(0xFDD0, 0xFDD8))
_MARKS = {_STRONG: "**", _EM: "*", _DEL: "~~", _STRONG_END: "**", _EM_END: "*", _DEL_END: "~~"}
CARRIERS = SPACE + BREAK + "".join(_MARKS)
_OPENING, _CLOSING = _STRONG + _EM + _DEL, _STRONG_END + _EM_END + _DEL_END
#: Two marks with nothing between them: of an empty element, or of two that follow each other.
_NOTHING = f"(?=[{_STRONG}-{_DEL_END}])(?:" + "|".join(a + b + "|" + b + a for a, b in zip(_OPENING, _CLOSING, strict=True)) + ")"
#: What all carriers begin with in UTF-8: found without decoding a text.
_CARRIED = bytes.fromhex("efb7")
#: What a block inside a table cell asks for: less than a line break, a space.
IN_CELL = 0.5
STRONG, EM, DEL, CODE = ("strong", "b", "dfn"), ("em", "i", "cite"), ("del", "s", "strike"), ("code", "kbd", "samp", "var")
KEPT_TAGS = ("sub", "sup", "ins", "mark", "u")
#: Elements that Markdown has no marks for: their tags are written as they are.
RAW_BLOCKS = ("details", "summary", "address", "dl", "dt", "dd")
#: Of a table within a cell, and of other blocks in a cell, tags are written too: a table row is one line.
RAW_IN_TABLE = ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption")
RAW_IN_CELL = ("ul", "ol", "li", "pre", *M.HEADINGS)
#: Elements that add no line break of their own.
FLAT = ("html", "head", "body", "footer", "header", "tbody", "thead", "tfoot", "td", "th")
#: The minimal preset drops these elements.
MINIMAL = ("form", "fieldset", "object", "embed", "footer", "aside", "iframe", "input", "textarea", "select", "button", "nav")

# What safe HTML keeps.
SAFE_TAGS = (
    "a", "article", "aside", "b", "blockquote", "br", "caption", "code", "dd", "del", "details", "div", "dl", "dt", "em", "figcaption", "figure", "footer", "h1", "h2", "h3", "h4", "h5",
    "h6", "header", "hr", "i", "img", "ins", "kbd", "li", "main", "mark", "nav", "ol", "p", "pre", "q", "s", "samp", "section", "small", "strike", "strong", "sub", "summary", "sup",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "u", "ul", "var",
)


# Attributes that rendering looks at.
_ATTRS = ("href", "title", "src", "alt", "align", "start", "colspan")


def _attr(name: str) -> Column:
    return F.get("attrs", _ATTRS.index(name))


def _with_attrs(rows: DataFrame) -> DataFrame:
    """Adds the attributes of tags, decoded together: one decoding expression instead of one an attribute."""
    # looked for first: replacing goes through a text character by character
    rows = rows.withColumn("token", F.when(F.col("token").rlike(f"[{min(CARRIERS)}-{max(CARRIERS)}]"), F.translate("token", CARRIERS, "\ufffd" * 8)).otherwise(F.col("token")))
    raw = F.array(*[M.raw_attribute(F.col("token"), name) for name in _ATTRS])
    return rows.withColumn("attrs", F.when((F.col("kind") != "text") & F.contains(F.col("token"), F.lit("=")), F.transform(raw, lambda a: T.decode_entities(a))))


def _destination(url: Column) -> Column:
    risky = url.rlike(r"[\s()<>\\]")
    return F.when(risky, F.concat(F.lit("<"), F.regexp_replace(url, r"([\\<>])", r"\\$1"), F.lit(">"))).otherwise(url)


def _title(title: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit(' "'), F.replace(title, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(F.lit(""))


# Table rows and blocks are numbered in page order, and a table row begins with a block. So this order is the page's,
# and one sort by it serves windows over pages, over table rows and over blocks.
_ORDER = ("row_no", "block", "pos")


def _in_order() -> Window:
    """The page in order, where rows are dealt by table row and block."""
    return Window.partitionBy("key").orderBy(*_ORDER)


def _in_row() -> Window:
    return Window.partitionBy("key", "row_no").orderBy("block", "pos")


def _in_block() -> Window:
    return Window.partitionBy("key", "row_no", "block").orderBy("pos")


def _structured(rows: DataFrame) -> DataFrame:
    """Adds to each row what rendering needs to know of its place."""
    step = F.when(M.is_open("ul"), 2).when(M.is_close("ul"), -2).when(M.is_open("ol"), 3).when(M.is_close("ol"), -3).otherwise(0)
    boundary = F.col("tag").isin(*M.BLOCKS) & (F.col("kind") != "text")
    p = M.in_page()
    opens_link = M.is_open("a")
    rows = rows.withColumns({"boundary": boundary, "edge": F.when(boundary, F.col("tag"))}).withColumns({
        "lists": M.depth("ul", "ol"),
        "tables": M.depth("table"),
        "in_cell": M.depth("td", "th") > 0,
        "region": M.depth(*RAW_BLOCKS),
        "tight": M.depth("address", "dt") > 0,
        "links": M.depth("a"),
        "pre": M.depth("pre") > 0,
        "spans": F.coalesce(F.last(F.when(opens_link, _attr("href").isNotNull()), ignorenulls=True).over(M.up_to_here()), F.lit(False)),
    })
    # a table's own tags are as deep as what it holds
    deep = F.col("tables") + F.when(M.is_close("table"), 1).otherwise(0)
    cell = (F.col("tables") > 0) & F.col("in_cell")
    tag = F.col("tag")
    in_link = (F.col("links") > 0) & F.col("spans") & ~cell
    raw_tag = (F.col("kind") != "text") & (
        ((deep > 1) & tag.isin(*RAW_IN_TABLE)) | (cell & tag.isin(*RAW_IN_CELL)) | (cell & F.col("pre") & (tag == "code")) | (~F.col("pre") & tag.isin(*RAW_BLOCKS)) | (in_link & tag.isin(*M.HEADINGS))
    )
    rows = rows.withColumns({"deep": deep, "cell": cell, "raw_tag": raw_tag})
    # what follows a raw block's tag is raw, until a blank line
    raw = F.last(F.when(tag.isin(*RAW_BLOCKS) & (F.col("kind") != "text"), ~M.is_close("summary", "details")).when(F.col("boundary") & (_spacing() == 2), F.lit(False)), ignorenulls=True).over(M.up_to_here())
    return rows.withColumns({
        "raw": F.coalesce((F.col("region") > 0) & ~cell & raw, F.lit(False)),
        "indent": F.greatest(M.so_far(step), F.lit(0)),
        "quotes": M.depth("blockquote"),
        # a heading ends where the next one begins, closed or not
        "heading": F.coalesce(F.last(F.when(F.col("tag").isin(*M.HEADINGS) & (F.col("kind") != "text"), F.col("kind") == "open"), ignorenulls=True).over(M.up_to_here()), F.lit(False)),
        "block": M.so_far(F.when(F.col("boundary"), 1).otherwise(0)),
        "row_no": M.so_far(F.when(M.is_open("tr", "table") & (deep == 1), 1).otherwise(0)),
        "table_no": M.so_far(F.when(M.is_open("table") & (deep == 1), 1).otherwise(0)),
        "before": F.lag("edge").over(p),
        "before_kind": F.lag("kind").over(p),
        "before_tag": F.lag("tag").over(p),
        "after_kind": F.lead("kind").over(p),
        "after_tag": F.lead("tag").over(p),
        "nearby": F.coalesce(F.lead(F.when(M.is_open("code"), _language())).over(p), F.lit("")),
        "is_first": F.lag("pos").over(p).isNull(),
        "is_last": F.lead("pos").over(p).isNull(),
        "href": F.last(F.when(opens_link, F.coalesce(_attr("href"), F.lit(BREAK))), ignorenulls=True).over(M.up_to_here()),
        "link_title": F.last(F.when(opens_link, F.coalesce(_attr("title"), F.lit(""))), ignorenulls=True).over(M.up_to_here()),
    })


def _language() -> Column:
    """The language that a tag's source names; empty without one."""
    return F.regexp_extract("token", r"language-([^\s\"'<>&~`]++)", 1)


def _with_items(rows: DataFrame) -> DataFrame:
    """Numbers list items among those of their list, and rows and cells among those of their table."""
    at_depth = Window.partitionBy("key", "lists").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # items are counted by depth, and a list's from the number that it begins with
    rows = rows.withColumn("items", F.sum(F.when(M.is_open("li"), 1).otherwise(0)).over(at_depth))
    opened = F.last(F.when(M.is_open("ul", "ol"), F.struct("tag", T.bounded_int(_attr("start"), 999_999_999).alias("start"), "items")), ignorenulls=True).over(at_depth)
    rows = rows.withColumn("list", opened)
    item = F.col("items") - F.coalesce("list.items", F.lit(0))
    cell = M.is_open("td", "th") & (F.col("deep") <= 1)
    inside = (F.col("tables") > 0) & (F.col("row_no") > 0)
    # a cell over several columns counts as so many, those after it empty
    spans = F.least(F.greatest(F.coalesce(T.bounded_int(_attr("colspan"), 1000), F.lit(1)), F.lit(1)), F.lit(1000)).cast("int")
    rows = rows.withColumns({"item": item - 1 + F.coalesce(F.col("list.start"), F.lit(1)), "span": F.when(cell, spans)})
    row = _in_row().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({
        "cells": F.sum(F.when(cell, 1).otherwise(0)).over(_in_row()),
        "width": F.sum(F.when(cell & inside, 1).otherwise(0)).over(row),
        "last_inside": F.max(F.when(inside, F.col("pos"))).over(row),
        "span_before": F.last("span", ignorenulls=True).over(_in_row().rowsBetween(Window.unboundedPreceding, -1)),
        "aligns": F.collect_list(F.when(cell & inside, F.struct("pos", F.col("span").alias("spans"), F.lower(F.coalesce(_attr("align"), F.lit(""))).alias("a")))).over(row),
    })
    rows = rows.withColumns({"row_end": inside & (F.col("width") > 0) & (F.col("pos") == F.col("last_inside")), "spans": F.coalesce("span", "span_before", F.lit(1)), "spans_before": F.coalesce("span_before", F.lit(1))})
    # a row is its table's first if the row that ended last is of another table
    ended = F.last(F.when(F.col("row_end"), F.col("table_no")), ignorenulls=True).over(_in_order().rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumns({"aligns": F.when(F.col("row_end"), F.col("aligns")), "first_row": ~ended.eqNullSafe(F.col("table_no"))})


def _inline(name: str, tags: tuple[str, ...], mark: str, closing: str | None = None) -> tuple[Column, Column, Column]:
    """How many of an inline element are open in the block, to be added as ``name``; its marker on its own tags; and the one owed where its block ends without a closing tag."""
    closing = mark if closing is None else closing
    step = F.when(M.is_open(*tags), 1).when(M.is_close(*tags), -1).otherwise(0)
    count = F.sum(step).over(_in_block().rowsBetween(Window.unboundedPreceding, 0))
    marker = F.when(M.is_open(*tags) & (F.col(name) == 1), F.lit(mark)).when(M.is_close(*tags) & (F.col(name) == 0), F.lit(closing))
    owed = F.when(F.col("block_end") & (F.col(name) > 0), F.lit(closing)).otherwise(F.lit(""))
    return count, marker, owed


def _joined(rows: DataFrame, spacing: Column, prefix: Column, name: str) -> DataFrame:
    """Joins pieces in page order; ``spacing`` of the boundaries between two pieces decides the breaks between them."""
    rows = rows.withColumns({"is_piece": F.col("piece") != "", "spacing": spacing, "prefix": prefix})
    rows = rows.withColumn("gap", F.coalesce(F.sum(F.when(F.col("is_piece"), 1).otherwise(0)).over(_in_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("breaks", F.max("spacing").over(Window.partitionBy("key", "gap").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where("is_piece or is_last")
    # gaps are numbered in page order too
    p = Window.partitionBy("key").orderBy("gap", "pos")
    # a link's end stands right behind what it shows; breaks before it follow it
    closing = M.is_close("a")
    rows = rows.withColumns({
        "was": F.lag("quotes").over(p),
        "last_marker": F.coalesce(F.lag("is_marker").over(p), F.lit(False)),
        "breaks": F.greatest("breaks", F.lag("after").over(p), F.when(F.lag(closing).over(p), F.lag("breaks").over(p))),
    })
    quoted = F.least(F.col("was"), F.col("quotes"))
    sep = (
        F.when(closing, F.lit(""))
        .when((F.col("gap") == 0) | F.col("last_marker"), F.when((F.col("gap") == 0) & (F.col("quotes") > 0), F.col("prefix")).otherwise(F.lit("")))
        .when(F.col("breaks") >= 2, F.concat(F.lit("\n"), F.rtrim(F.repeat(F.lit(">" + SPACE), quoted), F.lit(SPACE)), F.lit("\n"), "prefix"))
        .when(F.col("breaks") == 1, F.concat(F.lit("\n"), "prefix"))
        .when((F.col("breaks") == IN_CELL) & ~F.col("boundary"), F.lit(" "))
        .otherwise(F.lit(""))
    )
    rows = rows.withColumn("out", F.when(F.col("is_piece"), F.concat(sep, "piece")).otherwise(F.lit("")))
    whole = rows.groupBy("key").agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", "out")))["out"], "").alias(name))
    # line by line, as most lines hold nothing to be changed: spaces within marks go out of them, as marks beside spaces mark nothing
    moved = lambda x: F.regexp_replace(F.regexp_replace(x, f"([{_STRONG}-{_DEL}]++) ++", " $1"), f"(?<! ) ++([{_STRONG_END}-{_DEL_END}]++)", "$1 ")
    lines = F.transform(F.split(name, "\n"), lambda x: F.when(F.contains(x.cast("binary"), F.lit(_CARRIED)), moved(x)).otherwise(x))
    lines = F.transform(lines, lambda x: F.trim(F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, "  ++", " ")).otherwise(x)))
    text = F.array_join(lines, "\n")
    text = F.regexp_replace(text, "\n\n\n++", "\n\n")
    # line breaks at the end of code count among those that follow it
    text = F.regexp_replace(text, rf"{BREAK}(?:({BREAK})\n\n?|(\n)\n|\n(?!\n))", f"{BREAK}$1$2")
    text = F.rtrim(F.ltrim(text, F.lit(" \n")), F.lit(f" \n{SPACE}{BREAK}"))
    text = F.replace(text, F.lit(BREAK * 2 + "```"), F.lit(BREAK + "```"))
    # a pair of marks with nothing between them goes; of nested ones the outer pair after the inner
    text = F.regexp_replace(F.regexp_replace(text, _NOTHING, ""), _NOTHING, "")
    for carrier, mark in _MARKS.items():
        text = F.replace(text, F.lit(carrier), F.lit(mark))
    return whole.withColumn(name, F.replace(F.replace(text, F.lit(SPACE), F.lit(" ")), F.lit(BREAK), F.lit("\n")))


def for_all(pages: DataFrame, converted: DataFrame, key: str = "page_id") -> DataFrame:
    """``converted`` with a row for each row of ``pages``: one that renders nothing, or is null or empty, gets an empty text."""
    texts = converted.withColumnRenamed(key, "of")
    joined = pages.select(key).join(texts, F.col(key).eqNullSafe(F.col("of")), "left").drop("of")
    return joined.select(key, *[F.coalesce(c, F.lit("")).alias(c) for c in converted.columns if c != key])


def _ticked(text: Column) -> Column:
    """Twice the length of a text's longest run of backticks, and one more if it begins or ends with one; 0 without any."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), lambda r: F.length(r))
    return F.when(F.contains(text, F.lit("`")), F.array_max(runs) * 2 + F.when(text.rlike(r"^`|`\z"), 1).otherwise(0)).when(text.isNotNull(), 0)


def _ticks(ticked: Column, least: int) -> Column:
    """How many backticks fence a code text (``_ticked``): one more than its longest run of them, ``least`` at least."""
    return F.greatest(F.lit(least), F.coalesce(F.shiftright(ticked, 1), F.lit(0)) + 1)


def _spacing() -> Column:
    """Line breaks that a boundary asks for."""
    tag, kind = F.col("tag"), F.col("kind")
    return (
        F.when(~F.col("boundary"), 0)
        .when(tag.isin("option", "optgroup", "select"), F.when(kind == "open", IN_CELL).otherwise(0))
        .when(F.col("raw_tag") & (tag.isin(*RAW_BLOCKS)), F.when((kind == "open") & tag.isin("details", "summary") & ~F.col("cell") & ~F.col("tight"), 2).otherwise(0))
        .when(F.col("raw_tag") | ((F.col("deep") > 1) & tag.isin("table", "caption")), 0)
        .when(F.col("tight") & (F.col("tables") == 0), 0)
        .when((F.col("tables") > 0) & tag.isin("td", "th", "tbody", "thead", "tfoot"), 0)
        .when((F.col("tables") > 0) & ~tag.isin("table", "tr", "caption"), IN_CELL)
        .when(M.is_open("tr"), 1)
        .when(tag == "tr", 0)
        .when(M.is_open("li"), 1)
        .when(tag == "li", 0)
        .when(tag.isin("ul", "ol"), F.when(F.col("lists") > F.when(kind == "open", 1).otherwise(0), 0).otherwise(2))
        .when((F.col("lists") > 0) & (tag == "table"), F.when(kind == "open", 1).otherwise(2))
        .when((F.col("lists") > 0) & (tag == "p"), 2)
        .when((F.col("lists") > 0) & (tag == "blockquote"), 1)
        .when(F.col("lists") > 0, 0)
        .when(tag.isin(*FLAT), 0)
        .otherwise(2)
    )


def _spacing_after() -> Column:
    """Line breaks that follow a rule, or an end tag that is written itself."""
    outside = F.col("raw_tag") & ~F.col("cell") & (F.col("kind") == "close")
    rule = (F.col("tag") == "hr") & (F.col("kind") == "void") & (F.col("tables") == 0)
    return F.when(rule | (outside & F.col("tag").isin("details", "summary")), 2).when(outside & F.col("tag").isin("dt", "dd"), 1).otherwise(0)


def _prepared(rows: DataFrame, resolve: Column | None, clean: bool) -> DataFrame:
    rows = _structured(_with_attrs(rows))
    if resolve is not None or clean:
        at = resolve if resolve is not None else F.lit("")
        rows = rows.withColumn("href", F.when(F.col("href") == BREAK, BREAK).otherwise(U.resolve(F.col("href"), at, clean)))
    return rows


def _texts(rows: DataFrame) -> DataFrame:
    """Adds words: a row's text, white space collapsed outside pre, null where only white space meets a boundary."""
    decoded = F.when(F.col("kind") == "text", F.col("token"))
    collapsed = F.regexp_replace(decoded, r"[ \t\n\f\r]+", " ")
    at_edge = F.col("before").isNotNull() | F.col("after_tag").isNull() | (F.col("after_tag").isin(*M.BLOCKS) & (F.col("after_kind") != "text"))
    words = F.when(F.col("pre"), decoded).when((collapsed == " ") & at_edge, F.lit(None)).otherwise(collapsed)
    return rows.withColumn("words", words)


def to_markdown(rows: DataFrame, origin: Column | None = None, clean: bool = False, key: str = "page_id", marks: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """key and markdown of every page that has rows.

    ``marks`` gives inline elements other marks than their own: by tag, what is written where it begins and where it
    ends. An element that its block ends gets its second mark there.
    """
    marks = {t.lower(): m for t, m in (marks or {}).items()}
    own = lambda tags: tuple(t for t in tags if t not in marks) or ("",)
    rows = _texts(_prepared(rows, origin, clean))
    tag, kind = F.col("tag"), F.col("kind")
    # each step is a column of its own: nested in one expression they would be repeated
    rows = rows.withColumns({"plain": T.decode_entities(F.col("words")), "refers": F.contains("words", F.lit("&")), "language": F.when(M.is_open("pre"), _language())})
    # a link that shows nothing but its own address is written <address>
    alone = (F.col("before_tag") == "a") & (F.col("before_kind") == "open") & (F.col("after_tag") == "a") & (F.col("after_kind") == "close")
    auto = alone & (kind == "text") & (F.col("plain") == F.col("href")) & (F.col("link_title") == "") & U.is_autolink(F.col("href")) & ~F.col("pre")
    rows = rows.withColumns({"auto": F.coalesce(auto, F.lit(False)), "said": _ticked(F.when(kind == "text", F.col("plain")))})
    p, said = M.in_page(), F.col("said")
    ticked = lambda c: F.when(c > 0, c)
    rows = rows.withColumns({
        # quotes that the list itself stands in
        "around": F.last(F.when(M.is_open("ul", "ol"), F.col("quotes")), ignorenulls=True).over(M.up_to_here()),
        "auto_opens": F.coalesce(F.lead("auto").over(p), F.lit(False)),
        "auto_ends": F.coalesce(F.lag("auto").over(p), F.lit(False)),
        # code that holds backticks: its text is the next row, or the one after the code tag within pre; it ends a row, or two, before the end
        "ahead": ticked(F.coalesce(F.lead(said).over(p), F.lead(said, 2).over(p))),
        "behind": ticked(F.coalesce(said, F.lag(said).over(p))),
        "inside": ticked(F.when(kind == "close", F.lag(said).over(p)).otherwise(F.lead(said).over(p))),
    })
    rows = _with_items(rows)
    inline = {"n_strong": (own(STRONG), _STRONG, _STRONG_END), "n_em": (own(EM), _EM, _EM_END), "n_del": (own(DEL), _DEL, _DEL_END), "n_code": (own(CODE), "`")}
    for i, (name, ends) in enumerate(sorted(marks.items())):
        inline[f"n_given{i}"] = ((name,), *(m.replace(" ", SPACE).replace("\n", BREAK) for m in ends))
    made = {name: _inline(name, *told) for name, told in inline.items()}
    rows = rows.withColumns({"block_end": F.lead("pos").over(_in_block()).isNull(), **{name: count for name, (count, _, _) in made.items()}})
    strong, em, gone, code, *given = [marker for _, marker, _ in made.values()]
    owed_strong, owed_em, owed_del, owed_code, *owed_given = [owed for _, _, owed in made.values()]

    outside = F.when(F.col("lists") > 0, F.least(F.coalesce("around", F.lit(0)), F.col("quotes"))).otherwise(F.col("quotes"))
    quoted = F.repeat(F.lit(">" + SPACE), outside)
    prefix = F.concat(quoted, F.repeat(F.lit(SPACE), F.col("indent")), F.repeat(F.lit(">" + SPACE), F.col("quotes") - outside))
    starts = F.col("before").isNotNull() & ~F.col("heading") & (F.col("tables") == 0) | F.col("is_first")
    in_code = (F.col("n_code") > 0) & ~F.col("pre")
    folded = F.col("pre") & F.col("cell")
    rows = rows.withColumn("starts", F.coalesce(starts, F.lit(False)))
    rows = rows.withColumn("escaped", T.escape_markdown(F.col("plain"), F.col("starts")))
    rows = rows.withColumn("escaped", F.when(F.col("refers"), _guarded(F.col("escaped"))).otherwise(F.col("escaped")))
    hazards = F.when(F.col("tables") > 0, r"(\|)").when(F.col("quotes") > 0, r"(?<!\\)(>)")
    rows = rows.withColumn("escaped", F.when(hazards.isNotNull(), F.regexp_replace("escaped", hazards, F.lit(r"\\$1"))).otherwise(F.col("escaped")))
    in_link = (F.col("links") > 0) & (F.col("href") != BREAK)
    rows = rows.withColumn("escaped", F.when(in_link, F.replace("escaped", F.lit("]"), F.lit("\\]"))).otherwise(F.col("escaped")))
    ends_heading = F.col("heading") & (F.col("after_kind") == "close") & F.col("after_tag").isin(*M.HEADINGS)
    rows = rows.withColumn("escaped", F.when(ends_heading, F.regexp_replace("escaped", r"(^|[ ])(#+) ?\z", r"$1\\$2")).otherwise(F.col("escaped")))
    # a line break that a reference stands for would end the table's row
    rows = rows.withColumn("escaped", F.when(F.col("tables") > 0, F.replace(F.replace("escaped", F.lit("\n"), F.lit("&#10;")), F.lit("\r"), F.lit("&#13;"))).otherwise(F.col("escaped")))
    as_html = F.replace(F.replace(F.replace("plain", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    as_raw = F.replace(F.replace(as_html, F.lit("\n"), F.lit("&#10;")), F.lit("\r"), F.lit("&#13;"))
    as_raw = F.when(F.col("tables") > 0, F.replace(as_raw, F.lit("|"), F.lit("&#124;"))).when(in_link, F.replace(F.replace(as_raw, F.lit("["), F.lit("&#91;")), F.lit("]"), F.lit("&#93;"))).otherwise(as_raw)
    # code in a cell stays on the row's line; the line breaks next to its tags go
    first = (F.col("before_kind") == "open") & F.col("before_tag").isin("pre", "code")
    last = (F.col("after_kind") == "close") & F.col("after_tag").isin("pre", "code")
    line_up = F.when(first, F.regexp_replace(as_html, r"\A\n", "")).otherwise(as_html)
    line_up = F.when(last, F.regexp_replace(line_up, r"\n\z", "")).otherwise(line_up)
    line_up = F.replace(F.translate(F.replace(line_up, F.lit("|"), F.lit("&#124;")), " ", SPACE), F.lit("\n"), F.lit("<br>"))
    verbatim = F.translate("plain", " \n", SPACE + BREAK)
    verbatim = F.when(in_code & (F.col("tables") > 0), F.replace(F.translate("plain", "\n ", SPACE + SPACE), F.lit("|"), F.lit("\\|"))).otherwise(verbatim)
    text = F.when(folded, line_up).when(F.col("raw") & ~F.col("pre"), as_raw).when(F.col("pre") | in_code, verbatim).otherwise(F.col("escaped"))

    linked = F.col("href") != BREAK
    level = F.substring("tag", 2, 1).cast("int")
    fence = F.concat(F.repeat(F.lit("`"), _ticks(F.col("ahead"), 3)), F.when(F.col("language") != "", F.col("language")).otherwise(F.col("nearby")), F.lit(BREAK))
    number = F.when(F.col("list.tag") == "ol", F.concat(F.col("item").cast("string"), F.lit("." + SPACE))).otherwise(F.lit("-" + SPACE))
    src, alt = _attr("src"), F.coalesce(_attr("alt"), F.lit(""))
    if origin is not None or clean:
        src = U.resolve(src, origin if origin is not None else F.lit(""), clean)
    image = F.concat(F.lit("!["), F.regexp_replace(alt, r"([\[\]\\])", r"\\$1"), F.lit("]("), _destination(F.coalesce(src, F.lit(""))), _title(_attr("title")), F.lit(")"))
    line = F.when(F.col("heading") | (F.col("tables") > 0) | F.col("raw"), F.lit("<br>")).when(F.col("pre") | in_code, F.lit(BREAK)).otherwise(F.concat(F.lit(SPACE * 2 + "\n"), prefix))
    piece = (
        F.when((kind != "text") & tag.isin(*marks), F.coalesce(*given, F.lit("")))
        .when(F.col("auto"), F.col("plain"))
        .when(kind == "text", text)
        .when(F.col("raw_tag"), F.concat(F.when(kind == "close", "</").otherwise("<"), tag, F.lit(">")))
        .when(F.col("pre") & ~tag.isin("pre", "br"), "")
        .when(M.is_open(*M.HEADINGS), F.concat(F.repeat(F.lit("#"), level), F.lit(SPACE)))
        .when(tag == "br", line)
        .when((tag == "hr"), F.when(F.col("tables") > 0, "<hr>").otherwise("---"))
        .when(M.is_open("li"), number)
        .when(M.is_open("pre"), fence)
        .when(M.is_open("a") & F.col("auto_opens"), "<")
        .when(M.is_close("a") & F.col("auto_ends"), ">")
        .when(M.is_open("a") & linked, "[")
        .when(M.is_close("a") & linked, F.concat(F.lit("]("), _destination(F.col("href")), _title(F.col("link_title")), F.lit(")")))
        .when((tag == "img") & ~F.lit(clean), image)
        .when((tag == "img") & (alt != ""), image)
        .when(M.is_open("td", "th"), F.when(F.col("cells") == 1, "|" + SPACE).otherwise(F.concat(F.repeat(F.lit(SPACE + "|"), F.col("spans_before")), F.lit(SPACE))))
        .when(tag == "q", '"')
        .when(tag.isin(*KEPT_TAGS), F.concat(F.when(kind == "close", "</").otherwise("<"), tag, F.lit(">")))
    )
    # inline code that holds backticks has more around it, and a space where it begins or ends with one
    inside = F.col("inside")
    room = F.when(inside % 2 == 1, SPACE).otherwise("")
    opening = F.concat(F.repeat(F.lit("`"), _ticks(inside, 1)), room)
    closing = F.concat(room, F.repeat(F.lit("`"), _ticks(inside, 1)))
    code = F.when(code.isNotNull() & F.col("raw"), F.when(kind == "close", "</code>").otherwise("<code>")).when(code.isNotNull() & inside.isNotNull(), F.when(kind == "close", closing).otherwise(opening)).otherwise(code)
    piece = F.coalesce(piece, strong, em, gone, F.when(~F.col("pre"), code), F.lit(""))
    fence_end = F.when((F.col("after_kind") == "close") & (F.col("after_tag") == "pre") & ~F.col("cell"), F.concat(F.lit(BREAK), F.repeat(F.lit("`"), _ticks(F.col("behind"), 3)))).otherwise(F.lit(""))
    # a link that the page never closes ends with it
    owed_link = F.when(F.col("is_last") & in_link & ~M.is_close("a"), F.concat(F.lit("]("), _destination(F.col("href")), _title(F.col("link_title")), F.lit(")"))).otherwise(F.lit(""))
    owed = F.concat(*owed_given, owed_em, owed_del, owed_strong, owed_code, fence_end, owed_link)
    columns = F.flatten(F.transform(F.sort_array("aligns"), lambda c: F.array_repeat(c, c["spans"])))
    rule = F.array_join(F.transform(columns, lambda c: F.when(c["a"] == "center", ":---:").when(c["a"] == "right", "---:").when(c["a"] == "left", ":---").otherwise("---")), f"{SPACE}|{SPACE}")
    row_end = F.when(F.col("row_end"), F.concat(F.repeat(F.lit(SPACE + "|"), F.col("spans")), F.when(F.col("first_row"), F.concat(F.lit("\n"), prefix, F.lit("|" + SPACE), rule, F.lit(SPACE + "|"))).otherwise(F.lit("")))).otherwise(F.lit(""))
    rows = rows.withColumn("piece", F.concat(piece, owed, row_end))
    markers = (M.is_open("li", "pre", "td", "th", *M.HEADINGS) | (F.col("raw_tag") & F.col("cell") & (kind == "open"))) & ~(F.col("raw_tag") & ~F.col("cell") & ~tag.isin(*M.HEADINGS))
    marked = F.when(M.is_open("li") & ~F.col("cell"), F.concat(quoted, F.repeat(F.lit(SPACE), F.greatest(F.col("indent") - F.when(F.col("list.tag") == "ol", 3).otherwise(2), F.lit(0)))))
    rows = rows.withColumns({"is_marker": markers, "after": _spacing_after()})
    out = _joined(rows, _spacing(), F.coalesce(marked, prefix), "markdown")
    return out.withColumnRenamed("key", key)


def _guarded(text: Column) -> Column:
    """Text whose decoded ampersand would form a new reference gets a backslash before it."""
    return F.regexp_replace(text, r"&(?=#[0-9]+;|#[xX][0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*;)", r"\\&")


def to_text(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """key and text of every page that has rows: no markers, cells by tabs, images by their alternative text."""
    rows = _with_items(_texts(_prepared(rows, None, False)))
    tag, token = F.col("tag"), F.col("token")
    words = T.decode_entities(F.col("words"))
    text = F.when(F.col("pre"), F.translate(words, " \n", SPACE + BREAK)).otherwise(words)
    alt = _attr("alt")
    image = F.coalesce(alt, F.when(token.rlike(r"(?i)\salt[\s=/>]"), F.lit("")), _attr("title"), _attr("src"), F.lit(""))
    piece = (
        F.when(F.col("kind") == "text", text)
        .when(tag == "br", F.when(F.col("pre"), F.lit(BREAK)).otherwise(F.lit("\n")))
        .when(tag == "img", image)
        .when(tag == "q", '"')
        .when(M.is_open("td", "th") & F.when(F.col("deep") > 1, (F.col("before_kind") == "close") & F.col("before_tag").isin("td", "th")).otherwise(F.col("cells") > 1), "\t")
    )
    rows = rows.withColumns({"piece": F.coalesce(piece, F.lit("")), "is_marker": M.is_open("td", "th"), "quotes": F.lit(0), "after": F.lit(0), "raw_tag": F.lit(False)})
    return _joined(rows, _spacing(), F.lit(""), "text").withColumnRenamed("key", key)


def to_html(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """key and safe of every page that has rows: allowed tags and attributes only, text escaped, headings with anchors.

    Elements nest as they do in ``rows``. Code stays as it is; what else stands within pre is its text only. Rows are
    sorted once: what an end tag or a heading must know of other rows is looked up where the page's parts are joined.
    """
    tag, kind, token = F.col("tag"), F.col("kind"), F.col("token")
    p = M.in_page()
    rows = _with_attrs(rows)

    def carried(attr: str, ok: Column | None = None) -> Column:
        value = _attr(attr)
        kept = value.isNotNull() if ok is None else value.isNotNull() & ok
        return F.when(kept, F.concat(F.lit(f' {attr}="'), T.escape_html(value), F.lit('"'))).otherwise(F.lit(""))

    language = F.when(tag.isin("code", "pre") & (kind != "text"), F.coalesce(F.regexp_extract(token, r"language-([^\s\"'<>&~`]++)", 1), F.lit("")))
    attrs = (
        F.when(tag == "a", F.concat(carried("href"), carried("title")))
        .when(tag == "img", F.concat(carried("src"), carried("alt"), carried("title")))
        .when(tag == "ol", carried("start", _attr("start").rlike("^[0-9]++$")))
        .when(tag.isin("td", "th"), F.concat(carried("colspan", _attr("colspan").rlike("^[0-9]++$")), F.lower(carried("align", (tag == "th") & _attr("align").rlike("^(?i:left|center|right)$")))))
    )
    unsafe_link = M.is_open("a") & ~F.coalesce(U.is_safe(_attr("href")), F.lit(False))
    unsafe_image = (tag == "img") & ((kind != "void") | ~F.coalesce(U.is_safe(_attr("src"), link=False), F.lit(False)))
    # windows copy what rows hold: only what is still needed goes on, and a tag's source is not
    rows = rows.select(
        "key", "pos", "end", "tag", "kind", F.when(kind == "text", token).alias("token"), F.when(kind != "text", attrs).alias("attributes"), language.alias("language"),
        F.when(token.startswith("<code"), F.regexp_extract(token, r"^<code[^>]*language-([^\s\"'<>&~`]++)", 1)).alias("of_code"), unsafe_link.alias("unsafe_link"), unsafe_image.alias("unsafe_image"),
    )
    head = tag.isin(*M.HEADINGS) & (kind != "text")
    edge = tag.isin(*M.BLOCKS) & ~tag.isin("select", "option", "optgroup") & (kind != "text")
    rows = rows.withColumn("edge", edge).withColumns({
        "pre": M.depth("pre") > 0, "at_start": F.coalesce(F.lag("edge").over(p), F.lit(True)), "at_end": F.coalesce(F.lead("edge").over(p), F.lit(True)),
        "next_option": F.coalesce(F.lag(M.is_close("option", "optgroup")).over(p) | (F.lag(M.is_open("optgroup")).over(p) & F.lag(M.is_close("option", "optgroup"), 2).over(p)), F.lit(False)),
        "in_heading": F.coalesce(F.last(F.when(head, kind == "open"), ignorenulls=True).over(p.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)),
        "inner": F.coalesce(F.lead("of_code").over(p), F.lit("")),
    })
    decoded = T.decode_entities(token)
    rows = rows.withColumn("words", F.when(kind == "text", F.when(F.col("pre"), decoded).otherwise(F.regexp_replace(decoded, r"[ \t\n\f\r]++", " "))))
    text = F.when(F.col("pre"), F.col("words")).when((F.col("words") == " ") & (F.col("at_start") | F.col("at_end")), "").otherwise(F.col("words"))
    text = F.when(F.col("at_start") & ~F.col("pre"), F.ltrim(text)).otherwise(text)
    text = F.when(F.col("at_end") & ~F.col("pre"), F.rtrim(text)).otherwise(text)
    text = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    name = F.when(tag == "b", "strong").when(tag == "i", "em").when(tag.isin("s", "strike"), "del").otherwise(tag)
    language = F.coalesce("language", F.lit(""))
    classed = lambda c: F.when(c != "", F.concat(F.lit(' class="language-'), c, F.lit('"'))).otherwise(F.lit(""))
    fence = F.concat(F.lit('<pre tabindex="0"><code'), classed(F.when(language != "", language).otherwise(F.col("inner"))), F.lit(">"))
    titled = M.is_open(*M.HEADINGS) & ~F.col("pre")
    piece = (
        F.when(kind == "text", text)
        .when(M.is_open("pre"), fence)
        .when(M.is_close("pre"), "</code></pre>")
        .when(F.col("pre"), F.when(tag == "br", "\n").otherwise(""))
        .when(~tag.isin(*SAFE_TAGS) | F.col("unsafe_link") | F.col("unsafe_image"), "")
        .when(kind == "close", F.concat(F.lit("</"), name, F.lit(">")))
        # a heading's tag goes on with its anchor
        .when(titled, F.concat(F.lit("<"), name))
        .otherwise(F.concat(F.lit("<"), name, F.when(tag == "code", classed(language)).otherwise(F.coalesce("attributes", F.lit(""))), F.lit(">")))
    )
    spaced = F.when(M.is_open("option") & F.col("next_option"), " ").otherwise("")
    # the start tag of a link that goes, itself nothing, stands beside its end tag, which so is known to go too
    parts = {
        "place": F.when(F.col("unsafe_link"), F.col("end")).otherwise(F.col("pos")), "titled": F.when(head, titled),
        "out": F.concat(spaced, piece), "said": F.when((kind == "text") & F.col("in_heading"), F.col("words")),
    }
    # narrow before they are gathered
    rows = rows.select("key", "unsafe_link", *[c.alias(n) for n, c in parts.items()])
    whole = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(*parts))).alias("parts"), F.max("unsafe_link").alias("gone"))
    alone = lambda x, i: ~(F.get("parts", i - 1)["place"].eqNullSafe(x["place"]) | F.get("parts", i + 1)["place"].eqNullSafe(x["place"]))
    whole = whole.withColumn("parts", F.when(F.col("gone"), F.filter("parts", alone)).otherwise(F.col("parts")))
    heads = F.transform("parts", lambda x, i: F.when(x["titled"].isNotNull(), F.struct(i.alias("at"), x["titled"].alias("titled"))))
    whole = whole.withColumn("heads", F.filter(heads, lambda h: h.isNotNull()))

    def joined(start: Column, end: Column, field: str) -> Column:
        return F.array_join(F.transform(F.slice("parts", start + 1, end - start), lambda x: x[field]), "")

    def headed(h: Column, i: Column) -> Column:
        """A heading's tag, with its anchor, and all up to the next one."""
        after = F.coalesce(F.get("heads", i + 1)["at"], F.size("parts"))
        anchor = F.regexp_replace(T.slugify(joined(h["at"] + 1, after, "said")), "^(.+)$", ' id="$1"')
        return F.concat(F.get("parts", h["at"])["out"], F.when(h["titled"], F.concat(anchor, F.lit(">"))).otherwise(F.lit("")), joined(h["at"] + 1, after, "out"))

    safe = F.concat(joined(F.lit(0), F.coalesce(F.get("heads", F.lit(0))["at"], F.size("parts")), "out"), F.array_join(F.transform("heads", headed), ""))
    return whole.select(F.col("key").alias(key), F.trim(safe).alias("safe"))


def minimal(rows: DataFrame) -> DataFrame:
    """The rows that the minimal preset renders: main content without navigation, forms and the like, and no title."""
    return M.without_head(S.exclude(M.isolate_main(rows), MINIMAL))


def renamed(rows: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Token rows whose elements are rendered as others, by name: ``{"x-note": "blockquote"}``."""
    if not names:
        return rows
    known = F.create_map(*[F.lit(x.lower()) for pair in names.items() for x in pair])
    return rows.withColumn("tag", F.coalesce(F.try_element_at(known, F.col("tag")), F.col("tag")))
