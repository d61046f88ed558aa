r"""Queries over pages that Spark composes from the rows of ``documents``: every kind of block that conversion knows, with the
whole texts in them, and tags left out as pages leave them out. The SQL writes what should come out straight from the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import convert, links, markup, selectors

#: The page of a document, with the fields in braces: id, lang, source, and its text as HTML.
PAGE = (
    '<!doctype html><body data-x="<p>"><h1>Doc {id}<h2 id="b">Part of {lang}</h1></h2><!-- <a href="/hidden">no</a> --><script>if (a < b) s = "<a href=\'/no\'>"; <!-- <script> </script> --></script>'
    '<p>Text: {text}<div class=box hidden>gone</div><ul><li>lang <b> {lang} </b>of<li>source<ol start="4"><li>{source}<li><i>n</i> {id}</ol></ul>'
    '<table><caption>Cap {id}<tr><th>Key<th align="right">Value<tr><td>a | b<td>T: {text}<tr><td><pre>x\n{id} | y</pre><td><ul><li>one<li>two</ul><tr><td>in<table><tr><td>{id}<td>c</table><td>e<tr><td colspan=2>two</table>'
    '<blockquote><p>Quote: {text}<ul><li>q {id}</ul></blockquote><pre><code class="language-sql">SELECT {id}\n  FROM documents\n</code></pre>'
    '<p><img src="/i/{id}.png" alt="no [{id}]"> <a href="/d/{id}" title="to">link {id}<a href="/e">next <i>e</i></a><br>after <s>x</s><sub>2</sub> <code>a`b</code> "<q>c</q>"<hr>'
    '<x-note>note {id}</x-note><style-guide>, guide</style-guide><details><summary>More &lt;{id}&gt;</summary><p>Body *{id}*</details><dl><dt>lang<dd>{lang} &amp; all</dl>'
    '<p>Pick <select><option>one<option>two</select><textarea><b>raw</textarea><template><p>never</template>'
)
_FIELDS = ("id", "lang", "source", "text")


def _filled(values: dict[str, Column]) -> Column:
    """The page with its fields: pieces between them are literals."""
    parts, rest = [], PAGE
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(before), values[name]]
    return F.concat(*parts, F.lit(rest))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url and html of one page for each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    values = {"id": F.col("doc_id").cast("string"), "lang": F.coalesce("lang", F.lit("none")), "source": F.coalesce("source", F.lit("none")), "text": text}
    return docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("https://e.test/"), values["id"]).alias("url"), _filled(values).alias("html"))


# -- SQL ------------------------------------------------------------------------------------------------------------

_ROWS = """(SELECT doc_id AS page_id, CAST(doc_id AS VARCHAR) AS id, COALESCE(lang, 'none') AS lang, COALESCE(source, 'none') AS source,
  trim(regexp_replace(COALESCE(text, ''), '[ \\t\\n\\f\\r]+', ' ', 'g'), ' ') AS t FROM documents)"""
# as rendering shows them: carriers stand for themselves nowhere
_CARRIED = f"translate({{0}}, '{convert.CARRIERS}', '{chr(0xFFFD) * len(convert.CARRIERS)}') AS {{0}}"
_SHOWN = f"(SELECT * REPLACE ({', '.join(_CARRIED.format(c) for c in ('lang', 'source', 't'))}) FROM {_ROWS})"
# text as Markdown: marks escaped, and signs that would begin a tag or a reference
_ESCAPED = r"""regexp_replace(regexp_replace(regexp_replace(t, '([\\*_~`\[])', '\\\1', 'g'), '<([A-Za-z!/?])', '\\<\1', 'g'), '&(#[0-9]+;|#[xX][0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*;)', '\\&\1', 'g')"""
_HTML = "replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _spaced(x: str) -> str:
    """A text behind a word of its block; no space remains before an empty one."""
    return f"CASE WHEN t = '' THEN '' ELSE ' ' || {x} END"


def _slug(x: str) -> str:
    plain = rf"regexp_replace(regexp_replace({x}, '\[([^\[\]]*)\]\([^)]*\)', '\1', 'g'), '[*_`~]', '', 'g')"
    return rf"regexp_replace(regexp_replace(lower(regexp_replace({plain}, '[^A-Za-z0-9 \t-]', '', 'g')), '[ \t-]+', '-', 'g'), '^-|-$', '', 'g')"


def _sql(template: str, **how: str) -> str:
    """A template as an SQL expression: fields in braces are columns or the expressions given, line breaks are chr(10)."""
    parts, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [before, (f"({how.get(name, name)})",)]
    parts.append(rest)
    quoted = [x[0] if isinstance(x, tuple) else " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in x.split("\n")) for x in parts]
    return " || ".join(quoted)


MARKDOWN = (
    "# Doc {id}\n\n## Part of {tongue}\n\nText:{text}\n\n- lang **{tongue}** of\n- source\n  4. {origin}\n  5. *n* {id}\n\n"
    "Cap {id}\n\n| Key | Value |\n| --- | ---: |\n| a \\| b | T: {cell} |\n| <pre>x<br>{id} &#124; y</pre> | <ul><li>one</li><li>two</li></ul> |\n| in<table><tr><td>{id}</td><td>c</td></tr></table> | e |\n| two | |\n\n"
    "> Quote:{quote}\n>\n> - q {id}\n\n```sql\nSELECT {id}\n  FROM documents\n```\n\n"
    '![no \\[{id}\\]](/i/{id}.png) [link {id}](/d/{id} "to")[next *e*](/e)  \nafter ~~x~~<sub>2</sub> ``a`b`` ""c""\n\n---\n\n'
    "note {id}, guide\n\n<details>\n\n<summary>More &lt;{id}&gt;</summary>\n\nBody \\*{id}\\*\n\n</details>\n\n<dl><dt>lang</dt>\n<dd>{lang} &amp; all</dd>\n</dl>\n\nPick one two\\<b>raw"
)
TEXT = (
    "Doc {id}\n\nPart of {lang}\n\nText:{said}\n\nlang {lang} of\nsource\n{source}\nn {id}\n\n"
    "Cap {id}\n\nKey\tValue\na | b\tT:{said}\nx\n{id} | y\tone two\nin\n{id}\tc\te\ntwo\n\n"
    'Quote:{said}\n\nq {id}\n\nSELECT {id}\n  FROM documents\n\nno [{id}] link {id}next e\nafter x2 a`b ""c""\n\n'
    "note {id}, guide\n\nMore <{id}>\n\nBody *{id}*\n\nlang\n\n{lang} & all\n\nPick one two<b>raw"
)
HTML = (
    '<h1 id="{doc}">Doc {id}</h1><h2 id="{part}">Part of {lang}</h2><p>Text:{html}</p><ul><li>lang <strong> {lang} </strong>of</li><li>source<ol start="4"><li>{source}</li><li><em>n</em> {id}</li></ol></li></ul>'
    '<table><caption>Cap {id}</caption><tr><th>Key</th><th align="right">Value</th></tr><tr><td>a | b</td><td>T:{html}</td></tr><tr><td><pre tabindex="0"><code>x\n{id} | y</code></pre></td><td><ul><li>one</li><li>two</li></ul></td></tr>'
    '<tr><td>in<table><tr><td>{id}</td><td>c</td></tr></table></td><td>e</td></tr><tr><td colspan="2">two</td></tr></table>'
    '<blockquote><p>Quote:{html}</p><ul><li>q {id}</li></ul></blockquote><pre tabindex="0"><code class="language-sql">SELECT {id}\n  FROM documents\n</code></pre>'
    '<p><img src="/i/{id}.png" alt="no [{id}]"> <a href="/d/{id}" title="to">link {id}</a><a href="/e">next <em>e</em></a><br>after <del>x</del><sub>2</sub> <code>a`b</code> "<q>c</q>"</p><hr>'
    "note {id}, guide<details><summary>More &lt;{id}&gt;</summary><p>Body *{id}*</p></details><dl><dt>lang</dt><dd>{lang} &amp; all</dd></dl><p>Pick one two&lt;b&gt;raw</p>"
)
_CELL = rf"replace({_ESCAPED}, '|', '\|')"
_QUOTED = rf"replace({_ESCAPED}, '>', '\>')"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _shown(rows: DataFrame) -> DataFrame:
    return selectors.exclude(rows, ())


@query(f"SELECT page_id, {_sql(MARKDOWN, tongue=_ESCAPED.replace('(t, ', '(lang, '), origin=_ESCAPED.replace('(t, ', '(source, '), text=_spaced(_ESCAPED), cell=_CELL, quote=_spaced(_QUOTED))} AS markdown FROM {_SHOWN}")
def composed_markdown(spark, sf_dir):
    return convert.to_markdown(_shown(markup.tokens(pages(spark, sf_dir))))


@query(f"SELECT page_id, {_sql(TEXT, said=_spaced('t'))} AS text FROM {_SHOWN}")
def composed_text(spark, sf_dir):
    return convert.to_text(_shown(markup.tokens(pages(spark, sf_dir))))


@query(f"SELECT page_id, {_sql(HTML, html=_spaced(_HTML), doc=_slug("'Doc ' || id"), part=_slug("'Part of ' || lang"))} AS safe FROM {_SHOWN}")
def composed_html(spark, sf_dir):
    return convert.to_html(_shown(markup.tokens(pages(spark, sf_dir))))


@query(
    "SELECT page_id, 0 AS pos, '/d/' || id AS href, 'https://e.test/d/' || id AS url, 'link ' || id AS text FROM "
    f"{_ROWS} UNION ALL SELECT page_id, 1, '/e', 'https://e.test/e', 'next e' FROM {_ROWS}"
)
def composed_links(spark, sf_dir):
    return links.links(pages(spark, sf_dir))


@query(
    f"""SELECT page_id, selector, text_content FROM (
  SELECT page_id, 'li' AS selector, unnest(['lang ' || lang || ' of', 'source' || source || 'n ' || id, source, 'n ' || id, 'one', 'two', 'q ' || id]) AS text_content FROM {_ROWS}
  UNION ALL SELECT page_id, 'blockquote > p, blockquote', 'Quote: ' || CASE WHEN t = '' THEN '' ELSE t END || 'q ' || id FROM {_ROWS}
  UNION ALL SELECT page_id, '[hidden].box', 'gone' FROM {_ROWS}
  UNION ALL SELECT page_id, 'option', unnest(['one', 'two']) FROM {_ROWS})"""
)
def composed_elements(spark, sf_dir):
    found = selectors.extract(markup.tokens(pages(spark, sf_dir)), ["li", "blockquote > p, blockquote", "[hidden].box", "option"])
    return found.select(F.col("key").alias("page_id"), "selector", "text_content")
