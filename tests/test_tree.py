"""Tags as they nest, and what conversion makes of pages whose tags do not."""

import pytest
from pyspark.sql import functions as F

from pagemill.operators import convert, links, markup, selectors, tree

#: Page, Markdown, safe HTML.
PAGES = [
    ("<a href=/o>out <a href=/i>in</a> tail</a>", "[out ](/o)[in](/i) tail", '<a href="/o">out </a><a href="/i">in</a> tail'),
    ("<ul><li>x<table><tr><td><li>c</table>y<li>z</ul>", "- x\n  | <li>c</li> |\n  | --- |\n\n  y\n- z", "<ul><li>x<table><tr><td><li>c</li></td></tr></table>y</li><li>z</li></ul>"),
    ("<select><option>one<option>two</select><p>after</p>", "one two\n\nafter", "one two<p>after</p>"),
    ("<select><optgroup label=a><option>one<option>two<optgroup><option>three<select><p>after", "one two three\n\nafter", "one two three<p>after</p>"),
    ("<title>a <b>c</title>", "a \\<b>c", "a &lt;b&gt;c"),
    ("<textarea><p>t</p></textarea><p>x", "\\<p>t\\</p>\n\nx", "&lt;p&gt;t&lt;/p&gt;<p>x</p>"),
    ('<script><!-- "<script>" </script> --></script><p>ok</p>', "ok", "<p>ok</p>"),
    ("<script>a</SCRIPT ><script/><style>b</style\n><p>ok", "ok", "<p>ok</p>"),
    ("<style-guide><p>inside</p></style-guide><p>after</p>", "inside\n\nafter", "<p>inside</p><p>after</p>"),
    ("<dl><dt>HTML</dt>\n<dd>Hyper &lt; Text</dd>\n<dt>CSS<dd>Sheets *x*</dl><p>* end</p>", "<dl><dt>HTML</dt>\n<dd>Hyper &lt; Text</dd>\n<dt>CSS</dt>\n<dd>Sheets *x*</dd>\n</dl>\n\n\\* end", None),
    ("<details><summary>S &lt;b&gt; <code>A_B</code></summary><p>* text</p></details><p>n</p>", "<details>\n\n<summary>S &lt;b&gt; <code>A_B</code></summary>\n\n\\* text\n\n</details>\n\nn", None),
    ("<table><tr><td><pre>x\ny|z &lt;i&gt;</pre></td><td>ok</td></tr><tr><td>a&#10;b<td>2</table>", "| <pre>x<br>y&#124;z &lt;i&gt;</pre> | ok |\n| --- | --- |\n| a&#10;b | 2 |", None),
    ("<table><tr><td>q<table><tr><td>in<tr><td>b</table><tr><td>outer</table><p>end", "| q<table><tr><td>in</td></tr><tr><td>b</td></tr></table> |\n| --- |\n| outer |\n\nend", None),
    ("<table><tr><td><details><summary>s</summary>d</details></td><td>ok</td></tr></table>", "| <details><summary>s</summary>d</details> | ok |\n| --- | --- |", None),
    ("<table><caption>C<tr><td>a<tr><td>b</table>", "C\n\n| a |\n| --- |\n| b |", "<table><caption>C</caption><tr><td>a</td></tr><tr><td>b</td></tr></table>"),
    ("<blockquote><table><tr><td>a<tr><td>b</table></blockquote>", "> | a |\n> | --- |\n> | b |", None),
    ("a <b> x </b>c <i>y </i>, <b></b><b>p</b><b>q</b>", "a **x** c *y* , **pq**", None),
    ("<a href=/x><h3>T</h3></a> z", "[<h3>T</h3>](/x) z", None),
    ("<h1>A<h2>B</h1>c<template><p>t<template>u</template></p></template>d", "# A\n\n## Bcd", '<h1 id="a">A</h1><h2 id="bcd">Bcd</h2>'),
    ('<p>x <a "y', "x", "<p>x</p>"),
    ("<p><b>x</p>y</b> z", "**x**\n\ny z", "<p><strong>x</strong></p>y z"),
    ("<pre>a\n\n\n  b</pre>", "```\na\n\n\n  b\n```", '<pre tabindex="0"><code>a\n\n\n  b</code></pre>'),
    ("<p>a<hr>b", "a\n\n---\n\nb", "<p>a</p><hr>b"),
    ("<xmp><b>raw</b></xmp>", "\\<b>raw\\</b>", "&lt;b&gt;raw&lt;/b&gt;"),
    ('<p title="a href=/no>b">x <a title="b href=/no" href="/yes">y</a>', "x [y](/yes \"b href=/no\")", '<p>x <a href="/yes" title="b href=/no">y</a></p>'),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, "https://x.y/", p[0]) for i, p in enumerate(PAGES)], "page_id int, url string, html string")


def test_markdown(pages):
    got = {r.page_id: r.markdown for r in convert.for_all(pages, convert.to_markdown(markup.tokens(pages))).collect()}
    assert {p: got[i] for i, (p, _, _) in enumerate(PAGES)} == {p: md for p, md, _ in PAGES}


def test_safe_html(pages):
    got = {r.page_id: r.safe for r in convert.for_all(pages, convert.to_html(markup.tokens(pages))).collect()}
    assert {p: got[i] for i, (p, _, html) in enumerate(PAGES) if html} == {p: html for p, _, html in PAGES if html}


def test_elements_nest(pages):
    """Every start tag has its end tag, within its parent's; rows of an element share its place."""
    by_page = {}
    for r in markup.tokens(pages).orderBy("key", "pos").collect():
        by_page.setdefault(r.key, []).append(r)
    for rows in by_page.values():
        assert [r.pos for r in rows] == list(range(len(rows)))
        stack = [-1]
        for r in rows:
            if r.kind == "close":
                assert r.el == stack.pop() and rows[r.el].end == r.pos and rows[r.el].tag == r.tag
            assert r.up == stack[-1] or r.kind == "close"
            if r.kind == "open":
                assert r.el == r.pos
                stack.append(r.pos)
        assert stack == [-1]


def ended(marks):
    """The tags as they nest, as text."""
    page = tree.nest(marks.split())
    names = marks.split()
    return " ".join(names[of] if of >= 0 else "/" + names[-1 - of][1:] for of in page.of)


@pytest.mark.parametrize(
    ("marks", "nested"),
    [
        ("<p t <div t", "<p t /p <div t /div"),
        ("<p <button <p t", "<p <button <p t /p /button /p"),
        ("<li <ul <li t <li", "<li <ul <li t /li <li /li /ul /li"),
        ("<dl <dt t <dd <dl <dd t /dl <dt", "<dl <dt t /dt <dd <dl <dd t /dd /dl /dd <dt /dt /dl"),
        ("<table <tbody <tr <td <p t <tr <td /table", "<table <tbody <tr <td <p t /p /td /tr <tr <td /td /tr /tbody /table"),
        ("<table <thead <tr <th <tbody <tr", "<table <thead <tr <th /th /tr /thead <tbody <tr /tr /tbody /table"),
        ("<td t <td", "<td t <td /td /td"),
        ("<a <b <a t", "<a <b /b /a <a t /a"),
        ("<a <div <a t", "<a <div <a t /a /div /a"),
        ("<head <title t /title <div t", "<head <title t /title /head <div t /div"),
        ("<head .meta <head .link <p", "<head .meta /head <head .link /head <p /p"),
        ("<h1 <b <h2 t", "<h1 <b <h2 t /h2 /b /h1"),
        ("/p t /div <b /i t", "t <b t /b"),
        ("<template <p t <template /template t /template t /template", "t"),
        ("<div /template t", "<div t /div"),
        ("!div t !p", "!div /div t !p /p"),
        ("x x", ""),
        ("", ""),
    ],
)
def test_scopes(marks, nested):
    assert ended(marks) == nested


def test_links_are_those_of_the_tree(spark):
    html = '<!-- <a href="/hidden">no</a> --><script>s = "<a href=\'/no\'>"</script><template><a href=/t>t</a></template><a href="/1">one <a href=/2>two<p> x</p><a name=n>none</a><a href=/3><b>th</b>ree</a><a title="href=/no">w</a>'
    pages = spark.createDataFrame([(1, "https://x.y/p", html), (1, "https://z.y/p", "<a href=/4>four"), (None, None, "<a href=/5>5</a>"), (3, "https://x.y/", None)], "page_id int, url string, html string")
    got = sorted((r.page_id or 0, r.pos, r.href, r.url, r.text) for r in links.links(pages).collect())
    assert got == [
        (0, 0, "/5", "/5", "5"), (1, 0, "/1", "https://x.y/1", "one"), (1, 0, "/4", "https://z.y/4", "four"), (1, 1, "/2", "https://x.y/2", "two x"), (1, 2, "/3", "https://x.y/3", "three"),
    ]


def test_element_texts_of_filtered_rows(spark):
    pages = spark.createDataFrame([(1, "<div>a<p hidden>b</p><p>c <i>d</i></p><br>e</div><p>")], "page_id int, html string")
    rows = selectors.exclude(markup.tokens(pages), [])
    got = sorted((r.selector, r.pos, r.text_content) for r in selectors.extract(rows, ["div", "p", "br"]).collect())
    assert [(s, t) for s, _, t in got] == [("br", ""), ("div", "ac de"), ("p", "c d"), ("p", "")]


def test_attributes(spark):
    tags = spark.createDataFrame([('<a href=x>',), ('<a title="href=no" HREF = \'y\' href=z>',), ("<a data-href=no>",), ("<a href>",), ("<a/href=q/>",), ('<a b="1"href="w">',)], "t string")
    got = tags.select(markup.attribute(F.col("t"), "href").alias("v"), markup.has_attribute(F.col("t"), "href").alias("h")).collect()
    assert [(r.v, r.h) for r in got] == [("x", True), ("y", True), (None, False), (None, True), ("q/", True), (None, False)]


def test_tasks_grow_with_pages(spark, monkeypatch):
    """A task's sorts hold what it gets of the pages, so that more pages need more tasks, whatever the session asks for."""
    monkeypatch.setattr(markup, "TASK_BYTES", 1000)
    df = spark.createDataFrame([(i, f"<p>{i} <b>x</b> {'word ' * 100}") for i in range(100)], "page_id long, html string")
    rows = markup.tokens(df)
    assert markup.tasks(df) >= 50
    assert rows.rdd.getNumPartitions() == markup.tasks(df)
    assert rows.where("tag = 'b'").count() == 200


def _sorts(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Sort [") + 10 * plan.count("Join")


def test_safe_html_sorts_rows_once(spark):
    """Links that go and anchors of headings are found where parts are joined: each sort copies every row of every page."""
    html = '<h1>A <i>b</i> c<h2></h2><a href="javascript:x">one<div><a href="/ok">in</a></div><h3>T &amp; u</h3>out</a><a href="vbscript:y">z</a><pre><h4>raw</h4></pre><p hidden><a>h</a></p>﷑'
    pages = spark.createDataFrame([(1, html), (2, "<p>no heading"), (3, "<h2>only")], "page_id int, html string")
    safe = convert.to_html(selectors.exclude(markup.tokens(pages), ()))
    assert _sorts(safe) == 1
    assert {r.page_id: r.safe for r in safe.collect()} == {
        1: '<h1 id="a-b-c">A <em>b</em> c</h1><h2></h2>one<div><a href="/ok">in</a></div><h3 id="t-u">T &amp; u</h3>outz<pre tabindex="0"><code>raw</code></pre>�',
        2: "<p>no heading</p>",
        3: '<h2 id="only">only</h2>',
    }


def test_extraction_sorts_rows_once(spark):
    """Elements meet their ends and texts in their page's arrays: rows are cut and sorted once, not for tags and texts apart."""
    pages = spark.createDataFrame([(1, "<div class=k id=n>a<p>b<br>c<p>d</div>e<div>"), (None, "<p class=k>n"), (3, "text")], "page_id int, html string")
    found = selectors.extract(markup.tokens(pages), ["div", ".k", "br", "p"])
    assert _sorts(found) == 1
    got = sorted((r.key or 0, r.selector, r.pos, r.tag_name, r.text_content, tuple(sorted(r.attributes.items()))) for r in found.collect())
    assert got == [
        (0, ".k", 0, "p", "n", (("class", "k"),)), (0, "p", 0, "p", "n", (("class", "k"),)),
        (1, ".k", 0, "div", "abcd", (("class", "k"), ("id", "n"))), (1, "br", 4, "br", "", ()), (1, "div", 0, "div", "abcd", (("class", "k"), ("id", "n"))), (1, "div", 12, "div", "", ()),
        (1, "p", 2, "p", "bc", ()), (1, "p", 7, "p", "d", ()),
    ]
