"""Conversion, extraction and filtering on small pages with known output."""

import pytest

from pagemill.functions import clean
from pagemill.operators import convert, frontmatter, links, markup, selectors

# Own pages; what is wanted follows from the rules of Markdown.
MARKDOWN = [
    ("<h3>Tea &amp; cake</h3><p>Open daily.</p>", "### Tea & cake\n\nOpen daily."),
    ("<P>The <STRONG>red</STRONG> door</P>", "The **red** door"),
    ("<p>left<br>right<p>next", "left  \nright\n\nnext"),
    ("<ol><li>wash<br>dry<li>fold</ol>", "1. wash  \n   dry\n2. fold"),
    ("<blockquote><p>so it goes<p>and on</blockquote>", "> so it goes\n>\n> and on"),
    ("<ul><li>milk<blockquote>fresh only</blockquote><li>eggs</ul>", "- milk\n  > fresh only\n- eggs"),
    ("<blockquote><ul><li>one<li>two</ul></blockquote>", "> - one\n> - two"),
    ("<p>+ not an item<p>7) nor this<p>> nor a quote", "\\+ not an item\n\n7\\) nor this\n\n\\> nor a quote"),
    ("<p>5 * 3 _x_ `y` ~z~ [w] a&lt;b", "5 \\* 3 \\_x\\_ \\`y\\` \\~z\\~ \\[w] a\\<b"),
    ("<p>say &amp;lt; twice", "say \\&lt; twice"),
    ("<h4>C #</h4>", "#### C \\#"),
    ("<table><tr><th>name<th align=right>sum<tr><td>a|b<td>3</table>", "| name | sum |\n| --- | ---: |\n| a\\|b | 3 |"),
    ("<table><tr><td colspan=2>both<td>c<tr><td>1<td>2<td>3</table>", "| both | | c |\n| --- | --- | --- |\n| 1 | 2 | 3 |"),
    ("<table><tr><td><p>up</p><p>down</p></td></tr></table>", "| up down |\n| --- |"),
    ("<a href=/one href=/two title='the \"way\"'>go [on]</a>", '[go \\[on\\]](/one "the \\"way\\"")'),
    ('<a href="my file">open</a> <a href="">none</a>', "[open](<my file>) [none]()"),
    ("<a href=/cut>never closed<p>more", "[never closed\n\nmore](/cut)"),
    ("<ul><li>fruit<ul><li>pear</ul><li>bread</ul>", "- fruit\n  - pear\n- bread"),
    ("<p>x</p><hr><p>y</p>", "x\n\n---\n\ny"),
    ('<pre><code class="language-sql">select 1\n  from t</code></pre>', "```sql\nselect 1\n  from t\n```"),
    ("<pre>a **** b ~~~~ c</pre>", "```\na **** b ~~~~ c\n```"),
    ("<pre>```\ninner\n```</pre>", "````\n```\ninner\n```\n````"),
    ("<p>use <code>a`b</code> and <code>`c</code> or <code>d</code>", "use ``a`b`` and `` `c `` or `d`"),
    ("<p>a<b></b>b<i><b></b></i>c<del></del> <b>d</b>", "abc **d**"),
    ("<p>icon \ue000 and \ue001 stay", "icon \ue000 and \ue001 stay"),
    ("<p>&#8364; &eacute; &notin; 1 < 2 & 3", "€ é ∉ 1 < 2 & 3"),
    ('<img src=cat.png alt="a [big] cat"><em>hm</em>', "![a \\[big\\] cat](cat.png)*hm*"),
    ("<p>a<!--> b <!-- c -- d --!> e<![CDATA[ f > g ]]> h", "a b e h"),
    ("<p>a</p><script>document.write('<p>no</p>')</script><style>p > a {}</style><p>b</p>", "a\n\nb"),
    ('at <a href="https://a.test/x_y">https://a.test/x_y</a>', "at <https://a.test/x_y>"),
    ("<h2>first<h3>second</h3><p>10 # not a mark #</p>", "## first\n\n### second\n\n10 # not a mark #"),
    ("<!-- nothing -->", ""),
    ("", ""),
    (None, ""),
]


def test_markdown(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(MARKDOWN)], "page_id long, html string")
    got = {r.page_id: r.markdown for r in convert.for_all(df, convert.to_markdown(markup.tokens(df))).collect()}
    assert {MARKDOWN[i][0]: got[i] for i in range(len(MARKDOWN))} == dict(MARKDOWN)


def test_markdown_sorts(spark):
    """Token rows are sorted by page, list depth, table row and gap, and items of lists need no sort of their own; numbers of backticks, not texts, go along."""
    df = spark.createDataFrame([(1, "<ol start=3><li>a<ul><li>b<li>c</ul><li>d</ol><ol><li>e</ol><li>f<pre>`` x</pre><code>`y</code>")], "page_id long, html string")
    md = convert.to_markdown(markup.tokens(df))
    plan = md._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") <= 4 and plan.count("Window [") <= 11
    assert md.first().markdown == "3. a\n   - b\n   - c\n4. d\n\n1. e\n\n- f\n\n```\n`` x\n```\n\n`` `y ``"


def test_text_and_html(spark):
    pages = [(0, '<ol><li>soup</li></ol><p><img src="s.png" alt="A bowl" title="B">'), (1, "<pre>  two\n four</pre>"), (2, '<p onclick=f()><a href="vbscript:x">k</a> <b>b</b> &lt;i</p><h2>A b</h2>')]
    df = spark.createDataFrame(pages, "page_id long, html string")
    text = {r.page_id: r.text for r in convert.to_text(markup.tokens(df)).collect()}
    assert text[0] == "soup\n\nA bowl" and text[1].endswith("two\n four")
    safe = {r.page_id: r.safe for r in convert.to_html(markup.tokens(df)).collect()}
    assert safe[2] == '<p>k <strong>b</strong> &lt;i</p><h2 id="a-b">A b</h2>'


@pytest.fixture
def page(spark):
    html = '<head><title>T &amp; U</title><meta name=description content="d"></head><nav class="top menu" id=n><a href="/x?utm_source=1">x</a></nav><main><h1>H</h1><p data-k="ab-c">t <i>u</i></p><div hidden>z</div></main><footer>f</footer>'
    return spark.createDataFrame([(1, "https://e.org/p", html)], "page_id long, url string, html string")


def test_selectors(page):
    rows = markup.tokens(page)
    wanted = {"nav.menu": 1, "#n": 1, "[data-k]": 1, "p[data-k^=ab]": 1, "[data-k$='c']": 1, "[data-k*=b]": 1, "[data-k|=ab]": 1, "nav p": 0, "a, i": 2, "": 0, ".nope": 0}
    got = {s: selectors.extract(rows, [s]).count() for s in wanted}
    assert got == wanted
    r = selectors.extract(rows, ["p"]).first()
    assert (r.tag_name, r.text_content, r.attributes) == ("p", "t u", {"data-k": "ab-c"})


def test_filters(page):
    rows = markup.tokens(page)
    md = lambda r: (r.first() or [None, None])[1]
    assert md(convert.to_markdown(selectors.exclude(rows, ["nav", "title"]))) == "# H\n\nt *u*\n\nf"
    assert md(convert.to_markdown(selectors.include(rows, ["p"]))) == "t *u*"
    assert md(convert.to_markdown(convert.minimal(rows))) == "# H\n\nt *u*"


def test_metadata(page):
    r = links.metadata(page).first()
    assert (r.title, r.description, r.keywords, r.links) == ("T & U", "d", None, ["https://e.org/x"])


CLEANED = [
    ("![](a.png)x", "x"),
    ("![a](a.png)", "![a](a.png)"),
    ("[t](#) [u](data:x) ![i](#)", "t u ![i](#)"),
    ("a[](u)b", "ab"),
    ("[https://e.org](https://e.org)", "https://e.org"),
    ("## [T u](#t-u)\nsee [T](#t-u) and [V](#v)", "## T u\nsee [T](#t-u) and V"),
    ("```\n[](u)\n# no\n```\n[x](#no)", "```\n[](u)\n# no\n```\nx"),
    ("", ""),
    (None, None),
]


def test_cleaning(spark):
    df = spark.createDataFrame([(i, md) for i, (md, _) in enumerate(CLEANED)], "i int, md string")
    got = {r.i: r.out for r in df.select("i", clean.clean_markdown(df.md).alias("out")).collect()}
    assert got == {i: out for i, (_, out) in enumerate(CLEANED)}
    kept = df.where("i = 3").select(clean.clean_markdown(df.md, empty_link_text=False).alias("out")).first().out
    assert kept == CLEANED[3][0]
    with pytest.raises(ValueError, match="no such"):
        clean.clean_markdown(df.md, blank=True)


WRAPPED = [
    ("aa bb cc dd ee", "aa bb cc\ndd ee"),
    ("abcdefghijk lm", "abcdefghijk\nlm"),
    ("- aa bb cc dd", "- aa bb\n  cc dd"),
    ("> aa bb cc dd  \n> x", "> aa bb\n> cc dd  \n> x"),
    ("# aa bb cc dd ee", "# aa bb cc dd ee"),
    ("| aa | bb | cc |", "| aa | bb | cc |"),
    ("```\naa bb cc dd ee\n```", "```\naa bb cc dd ee\n```"),
    ("            ", "            "),
    ("", ""),
    (None, None),
]


def test_hard_wrap(spark):
    df = spark.createDataFrame([(i, md) for i, (md, _) in enumerate(WRAPPED)], "i int, md string")
    assert {r.i: r.out for r in df.select("i", clean.hard_wrap(df.md, 8).alias("out")).collect()} == {i: out for i, (_, out) in enumerate(WRAPPED)}


def test_front_matter_and_styles(spark):
    html = '<head><title> A: b </title><meta name=keywords content=x><meta property="og:title" content=\'say "hi"\'><meta name=keywords content=y><meta name=other content=z></head><p>a <span class="font-bold">b</span> <span>c</span><i class="md:hidden">d</i></p>'
    rows = markup.tokens(spark.createDataFrame([(1, html), (2, "<p>none")], "page_id long, html string"))
    found = frontmatter.fields(rows)
    got = {r.page_id: r.yaml for r in found.select("page_id", frontmatter.yaml(found.title, found.meta, {"tag": "k"} ).alias("yaml")).collect()}
    assert got[1] == '---\ntitle: "A: b"\ntag: k\nmeta:\n  keywords: y\n  "og:title": "say \\"hi\\""\n---\n\n'
    assert got[2] == "---\ntag: k\n---\n\n"
    md = {r.page_id: r.markdown for r in convert.to_markdown(frontmatter.styled(rows)).collect()}
    assert md[1].endswith("a **b** c") and md[2] == "none"


def test_first_usable_sitemap(spark):
    sites = spark.createDataFrame([("https://a", ["https://a/own.xml"]), ("https://b", ["https://b/bad.xml"]), ("https://c", None)], "origin string, sitemaps array<string>")
    files = spark.createDataFrame([("https://a/own.xml", "<urlset>"), ("https://a/sitemap.xml", "<urlset>"), ("https://b/bad.xml", "<html>"), ("https://b/sitemaps.xml", "<sitemapindex>")], "url string, xml string")
    assert {tuple(r) for r in links.first_sitemaps(sites, files).collect()} == {("https://a", "https://a/own.xml"), ("https://b", "https://b/sitemaps.xml")}


def test_options(spark):
    from pagemill.plans import convert as plans

    page = "<head><title>A: b</title><meta name=author content=Me><body><nav>menu</nav><main><h1>T</h1><x-note>n</x-note><p>a <sup>2</sup> <a href='#'>x</a><p hidden>no</main>"
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    run = lambda o: {r.page_id: r.markdown for r in plans.pages_to_markdown(df, o).collect()}
    got = run(plans.Options.minimal(names={"x-note": "blockquote"}, marks={"sup": ("^", "^")}))
    assert got == {1: '---\ntitle: "A: b"\nmeta:\n  author: Me\n---\n\n# T\n\n> n\n\na ^2^ x', 2: ""}
    assert run(plans.Options.minimal(frontmatter=False, isolate_main=False, exclude=("head", "nav"), cleaning=False))[1] == "# T\n\nn\n\na <sup>2</sup> [x](#)"
    with pytest.raises(TypeError):
        plans.Options.minimal(nonsense=True)
