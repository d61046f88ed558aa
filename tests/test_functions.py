"""Column functions on single values."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions import glob, http, text, url


@pytest.fixture
def value(spark):
    return lambda c: spark.range(1).select(c.alias("v")).first().v


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("http://shop.test/tea?utm_term=a&size=2&gclid=9", "http://shop.test/tea?size=2"),
        ("http://shop.test/tea?fbclid=1#price", "http://shop.test/tea#price"),
        ("http://shop.test/tea#how?utm_term=a", "http://shop.test/tea#how?utm_term=a"),
        ("http://shop.test/tea?size=2", "http://shop.test/tea?size=2"),
    ],
)
def test_strip_tracking(value, given, want):
    assert value(url.strip_tracking(F.lit(given))) == want


@pytest.mark.parametrize(("given", "want"), [("//img.shop.test/a.png", "https://img.shop.test/a.png"), ("./cup", "http://shop.test/cup"), ("tel:+4930", "tel:+4930"), ("#top", "#top"), ("/pot/1", "http://shop.test/pot/1"), ("pot", "http://shop.test/pot")])
def test_resolve(value, given, want):
    assert value(url.resolve(F.lit(given), F.lit("http://shop.test/"))) == want


def test_urls(value):
    assert value(url.normalize(F.lit("http://Shop.test/pots/?size=2&glaze=red&ref=mail#all"))) == "http://shop.test/pots/?glaze=red&size=2"
    assert value(url.normalize(F.lit("http://shop.test/pots/#all"))) == "http://shop.test/pots"
    assert value(url.safe_filename(F.lit("http://shop.test/tea pots/no.3/"))) == "tea-pots/no-3.md" and value(url.safe_filename(F.lit("http://shop.test"))) == "index.md"
    assert value(url.is_empty_link(F.lit("\nData:text"))) and not value(url.is_empty_link(F.lit("#part")))
    assert value(url.is_safe(F.lit("./x:y"))) and not value(url.is_safe(F.lit("blob:1"))) and not value(url.is_safe(F.lit("tel:1"), link=False))
    assert value(url.file_to_url(F.lit("guide/pots/index.html"))) == "/guide/pots" and value(url.file_to_url(F.lit("/index.html"))) == "/"


def test_text(value):
    for given, want in (("Snake_Case Name", "snakecase-name"), ("so --- far", "so-far"), ("Who's there? (me)", "whos-there-me"), ("[the pot](/pot) now", "the-pot-now")):
        assert value(text.slugify(F.lit(given))) == want
    assert value(text.bounded_int(F.lit("\t+7"), 9)) == 7 and value(text.bounded_int(F.lit("10"), 9)) is None and value(text.bounded_int(F.lit("-7"), 9)) is None
    assert value(text.frontmatter(F.lit("---\nsize: 2\nat: 10:30\nsize: 3\n---\nrest"))) == {"at": "10:30", "size": "3"}
    assert value(text.decode_entities(F.lit("&#x2;&#133;&#xDFFF;&#000;&amp;gt; &Uuml &none;"))) == "\x02…\ufffd\ufffd&gt; Ü &none;"
    assert value(text.truncate(F.lit("teapot"), 3)) == "tea..."


def test_globs(value):
    m = lambda u, p: value(glob.matches(F.lit(u), p))
    assert m("http://shop.test/pots/red/2", "http://shop.test/pots/**") and not m("http://shop.test/cups", "http://shop.test/pots/**")
    assert m("https://shop.test/pot/x", "shop.test/pot*") and not m("https://shop.test/potted/x", "shop.test/pot*") and not m("https://other.test/pots", "shop.test/pot*")
    e = lambda u, *p: value(glob.excluded(F.lit(u), p))
    assert e("http://shop.test/cart/pay", "/cart/*") and e("http://shop.test/a/list.csv", "**/*.csv") and e("http://shop.test/find?x=1", "/find*") and not e("http://shop.test/pots", "/cups")
    assert glob.starting_url("http://shop.test/pots/r*/2") == "http://shop.test/pots/"
    assert value(glob.registrable_domain(F.lit("tea.shop.com.au"), ["com.au", "au"])) == "shop.com.au"


@pytest.mark.parametrize(
    ("accept", "dest", "want"),
    [
        ("text/markdown", None, "markdown"), ("text/markdown", "document", "html"), ("*/*", None, "html"), ("text/html;q=0.5, text/markdown;q=0.9", None, "markdown"),
        ("text/markdown;q=0, */*", None, "html"), ("application/json", None, "not-acceptable"), (None, None, "html"), ("text/markdown;q=0, text/html;q=0, */*", None, "not-acceptable"),
        ("text/html;q=0, */*", None, "markdown"), ("TEXT/Markdown", None, "markdown"), ("text/html;q=0.5, */*", None, "markdown"), ("text/markdown, */*", None, "markdown"),
    ],
)
def test_negotiation(value, accept, dest, want):
    assert value(http.negotiate(F.lit(accept).cast("string"), F.lit(dest).cast("string"))) == want
