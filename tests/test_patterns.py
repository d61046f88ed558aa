"""Every pattern with a repeated group on a megabyte of its worst input: no stack overflow, no quadratic time."""

import time

import pytest
from pyspark.sql import functions as F

from pagemill.functions import clean, style
from pagemill.functions import text as T
from pagemill.functions import url as U
from pagemill.operators import convert, links, markup

MB = 1 << 20


def filled(piece, before="", after="", size=MB):
    return before + piece * (size // len(piece)) + after


def value(spark, text, f):
    """What f makes of the text in a task; the text is a row, so nothing is folded on the driver."""
    began = time.time()
    out = spark.createDataFrame([(text,)], "t string").repartition(1).select(f(F.col("t")).alias("o")).first().o
    assert time.time() - began < 30
    return out


def test_data_links_of_any_length(spark):
    steps = {name: name == "empty_links" for name in clean.STEPS}
    one = lambda c: clean.clean_markdown(c, fragments=False, **steps)
    assert value(spark, filled("x", "[a](data:", ") b"), one) == "a b"
    assert value(spark, filled("(y)", "[a](javascript:f", ") b"), one) == "a b"
    never = filled("(", "[a](data:")
    assert value(spark, never, one) == never


@pytest.mark.parametrize("piece", ["[](", "![](", "[a](#", "[a](a", "[", "](#x)", "```", "# [a](#b)\n"])
def test_all_cleaning_steps(spark, piece):
    text = filled(piece)
    assert len(value(spark, text, lambda c: clean.clean_markdown(c, blank_lines=True))) <= len(text)


def test_blank_lines_and_quotes(spark):
    assert value(spark, filled("\n", "a", "b"), clean.fold_blank_lines) == "a\n\nb"
    assert value(spark, filled(" \t\n", "a\n", "b"), clean.fold_blank_lines) == "a\n\nb"
    for piece in ("> ", " ", "a ", ">", "1", "\n", "- "):
        text = filled(piece, after="x")
        wrapped = value(spark, text, lambda c: clean.hard_wrap(c, 80))
        assert wrapped.replace("\n", "").replace(" ", "").replace(">", "") == text.replace("\n", "").replace(" ", "").replace(">", "")


@pytest.mark.parametrize("piece", ["&", "&amp", "&#", "*_", "a: b\n", "[a](", "(", "-", " "])
def test_text_functions(spark, piece):
    text = filled(piece)
    every = lambda c: F.concat_ws("|", T.decode_entities(c), T.escape_markdown(c, True), T.strip_markdown(c), T.header_level(c).cast("string"), T.token_count(c).cast("string"))
    assert value(spark, text, every)
    assert value(spark, filled(piece, "---\n", "\n---\nbody"), T.body_of) == "body"


@pytest.mark.parametrize("piece", ["?", "a=b&", "/", "#", " ", "%20", "https://"])
def test_address_functions(spark, piece):
    for f in (U.normalize, U.safe_filename, U.strip_tracking, lambda c: U.resolve(c, F.lit("https://x.y")), lambda c: U.is_safe(c).cast("string"), lambda c: U.is_empty_link(c).cast("string")):
        value(spark, filled(piece, "https://x.y/"), f)


def test_utility_classes(spark):
    assert value(spark, filled("font-bold "), lambda c: style.properties(c)["bold"].cast("string")) == "true"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # pages of many tags are shorter: what is tested is that time grows with their length
        (filled('<a "', "k "), "k"),  # a quote that is not behind an equals sign is part of a name, and the tag never ends
        (filled('<a b="', "k "), "k"),
        (filled("<a b='x' ", "k "), "k"),
        (filled("<!--", "k "), "k"),
        (filled("<script>", "k "), "k"),
        (filled("<!-- <script> ", "k <script>"), "k"),
        (filled("<style></styl", "k "), "k"),
        (filled("<textarea", "k "), "k"),
        (filled("<![CDATA[", "k "), "k"),
        (filled("<", "k ", size=MB // 16), None),
        (filled("</", "k ", size=MB // 16), None),
        (filled("<b><i>", "k ", size=MB // 16), "k"),
        (filled("</p>", "k ", size=MB // 16), "k"),
        (filled("<br>", "k ", "z", size=MB // 16), None),
        (filled(" ", "k", "z"), "k z"),
        (filled("<p>x", "", size=MB // 16), None),
    ],
    ids=["quotes", "values", "attributes", "comments", "scripts", "inner", "raw", "plain", "cdata", "signs", "ends", "deep", "stray", "breaks", "spaces", "blocks"],
)
def test_pages(spark, page, text):
    began = time.time()
    pages = spark.createDataFrame([(1, "https://x.y/", page)], "page_id int, url string, html string")
    got = convert.for_all(pages, convert.to_text(markup.tokens(pages))).first().text
    assert time.time() - began < 60
    if text is not None:
        assert got == text
    links.links(pages).count()
