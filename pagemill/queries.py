"""Registered queries over the pages, documents and events tables, with their SQL equivalents."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill import composed
from pagemill.functions import clean
from pagemill.functions import glob as G
from pagemill.functions import http, style
from pagemill.functions import text as T
from pagemill.functions import url as U
from pagemill.operators import convert, corpus, frontmatter, links, markup, selectors
from pagemill.plans import convert as plans
from pagemill.plans import site
from pagemill.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# SQL fragments
_PATH = r"CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END"
_ORIGIN = r"lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1))"
_QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
_TITLE = r"regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"


# References as ``text.decode_entities`` states them: each name with its semicolon as `` name=text``, the old names that need none, longest
# first, and what Windows-1252 has for the C1 controls. A title that is cut at a length may end within a reference.
_NAMES = "".join(f" {n}={c}" for n, c in T.named_references().items()).replace("'", "''")
_OLD = "|".join(T.LEGACY)
_OLD_NAMES = "".join(f" {n}={T.named_references()[n]}" for n in T.LEGACY)
_C1 = [ord(c) for c in T.C1]
_NUMBER = r"""list_transform([CASE WHEN regexp_matches(r, '^&#[0-9]+;?$') THEN CASE WHEN length(rtrim(r, ';')) < 12 THEN CAST(regexp_extract(r, '[0-9]+') AS BIGINT) END
  WHEN length(rtrim(r, ';')) < 12 THEN CAST('0x' || regexp_extract(r, '^&#[xX]([0-9A-Fa-f]+)', 1) AS BIGINT) END],
  lambda n: chr(CAST(CASE WHEN n IS NULL OR n = 0 OR n > 1114111 OR n BETWEEN 55296 AND 57343 THEN 65533 WHEN n BETWEEN 128 AND 159 THEN {}[n - 127] ELSE n END AS INTEGER)))[1]""".format(_C1)
_DECODED = rf"""CASE WHEN NOT starts_with(r, '&') THEN r WHEN r = '&amp;' THEN '&' WHEN r = '&copy;' THEN '©' WHEN r = '&middot;' THEN '·' WHEN regexp_matches(r, '^&#') THEN {_NUMBER}
  ELSE coalesce(nullif(regexp_extract('{_NAMES} ', ' ' || regexp_extract(r, '^&([A-Za-z0-9]+);$', 1) || '=([^ ]+) ', 1), ''),
    nullif(regexp_extract('{_OLD_NAMES} ', ' ' || regexp_extract(r, '^&({_OLD})', 1) || '=([^ ]+) ', 1), '') || substr(r, length(regexp_extract(r, '^&({_OLD})', 1)) + 2), r) END"""


def _decoded(x: str) -> str:
    return rf"""array_to_string(list_transform(regexp_extract_all({x}, '&#[0-9]+;?|&#[xX][0-9A-Fa-f]+;?|&[A-Za-z][A-Za-z0-9]*;?|[^&]+|&'), lambda r: {_DECODED}), '')"""


def _clean(x: str) -> str:
    return rf"trim(regexp_replace({_decoded(x)}, '[ \t\n\f\r]+', ' ', 'g'))"


def _escaped(x: str) -> str:
    """As Markdown: marks, and signs that would begin a tag or a reference."""
    return rf"""regexp_replace(regexp_replace(regexp_replace({_clean(x)}, '([\\*_~`\[])', '\\\1', 'g'), '<([A-Za-z!/?])', '\\<\1', 'g'), '&(#[0-9]+;|#[xX][0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*;)', '\\&\1', 'g')"""


def _started(x: str) -> str:
    """The same where a block begins: no heading, list, quote or rule either."""
    return rf"regexp_replace(regexp_replace({_escaped(x)}, '^([0-9]{{1,9}})([.)] )', '\1\\\2'), '^(#{{1,6}} |[-+] |>|---)', '\\\1')"


def _headed(x: str) -> str:
    """The same of a heading, which would lose number signs at its end."""
    return rf"regexp_replace({_escaped(x)}, '(^| )(#+)$', '\1\\\2')"


def _labelled(x: str) -> str:
    """The same of a link."""
    return rf"replace({_escaped(x)}, ']', '\]')"


_NORMAL = rf"""regexp_replace({_ORIGIN} || ({_PATH}) || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END, '/$', '')"""
_IGNORED = ", ".join(f"'{p}'" for p in U.IGNORED_PARAMS)
_KEPT = rf"""list_transform(list_sort(list_transform(list_filter(string_split({_QUERY}, '&'), lambda p: p <> '' AND string_split(p, '=')[1] NOT IN ({_IGNORED})),
  lambda p, i: {{'k': string_split(p, '=')[1], 'i': i, 'p': p}})), lambda s: s.p)"""


@query(rf"SELECT page_id, {_TITLE} AS title FROM pages")
def page_titles(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"))


@query("""SELECT regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, count(*) AS n, sum(length(html)) AS chars FROM pages GROUP BY 1""")
def page_langs(spark, sf_dir):
    lang = F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang")
    return _read(spark, sf_dir, "pages").groupBy(lang).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("html")).alias("chars"))


_LINKS = rf"""SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, regexp_extract(a, 'href="([^"]*)"', 1) AS href, regexp_extract(a, '>(.*)</a>', 1) AS text,
  {_ORIGIN} || regexp_extract(a, 'href="([^"]*)"', 1) AS target
  FROM (SELECT page_id, url, unnest(l) AS a, generate_subscripts(l, 1) AS pos FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS l FROM pages))"""


@query(f"SELECT page_id, pos, href, target AS url, text FROM ({_LINKS})")
def page_links(spark, sf_dir):
    return links.links(_read(spark, sf_dir, "pages"))


@query(f"SELECT page_id, count(*) AS n_links, count(DISTINCT href) AS n_targets FROM ({_LINKS}) GROUP BY page_id")
def link_out_degree(spark, sf_dir):
    return links.links(_read(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("href").alias("n_targets"))


@query(f"SELECT href, count(DISTINCT page_id) AS n_pages FROM ({_LINKS}) GROUP BY href")
def link_in_degree(spark, sf_dir):
    return links.links(_read(spark, sf_dir, "pages")).groupBy("href").agg(F.countDistinct("page_id").alias("n_pages"))


@query(r"""SELECT page_id, CASE WHEN NOT regexp_matches(url, '^[^?#]*\?') THEN url ELSE regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN q <> '' THEN '?' || q ELSE '' END || regexp_extract(url, '^[^#]*(#.*)$', 1) END AS url
  FROM (SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=a&id=1#top' AS url FROM pages) u,
  LATERAL (SELECT array_to_string(list_filter(string_split(regexp_extract(u.url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: NOT regexp_matches(p, '^(utm_|fbclid|gclid|mc_eid|msclkid|oly_)')), '&') AS q)""")
def url_strip_tracking(spark, sf_dir):
    url = F.concat("url", F.when(F.contains(F.col("url"), F.lit("?")), "&").otherwise("?"), F.lit("utm_source=a&id=1#top"))
    return _read(spark, sf_dir, "pages").select("page_id", U.strip_tracking(url).alias("url"))


@query(f"SELECT page_id, {_NORMAL} AS url FROM (SELECT page_id, url, {_KEPT} AS kept FROM pages)")
def url_normalize(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", U.normalize(F.col("url")).alias("url"))


@query(rf"""SELECT page_id, origin, path, '/' || array_to_string(segs[1:2], '/') AS prefix2,
  CASE WHEN len(segs) = 0 THEN 'index.md' ELSE array_to_string(list_transform(segs, lambda s: regexp_replace(s, '[^A-Za-z0-9_-]', '-', 'g')), '/') || '.md' END AS file,
  NOT regexp_matches(path, '^(/cdn-cgi/|/_next/|/_nuxt/|/__|/wp-admin/|/wp-json/|/wp-includes/|/wp-content/uploads/|/api/|/assets/|/static/)')
    AND (NOT contains(regexp_extract(path, '([^/]*)$', 1), '.') OR regexp_matches(path, '(?i)\.(html?|php|aspx?|jsp)$')) AS is_content
  FROM (SELECT page_id, {_ORIGIN} AS origin, {_PATH} AS path, list_filter(string_split({_PATH}, '/'), lambda s: s <> '') AS segs FROM pages)""")
def url_parts(spark, sf_dir):
    u = F.col("url")
    return _read(spark, sf_dir, "pages").select(
        "page_id", U.origin_of(u).alias("origin"), U.path_of(u).alias("path"), U.group_prefix(U.path_of(u), 2).alias("prefix2"), U.safe_filename(u).alias("file"), U.is_content(u).alias("is_content")
    )


@query(f"SELECT page_id, norm FROM (SELECT page_id, norm, row_number() OVER (PARTITION BY norm ORDER BY page_id) AS nth FROM (SELECT page_id, {_NORMAL} AS norm FROM (SELECT page_id, url, {_KEPT} AS kept FROM pages))) WHERE nth = 1")
def url_dedup_first(spark, sf_dir):
    return links.first_by_url(_read(spark, sf_dir, "pages")).select("page_id", "norm")


@query(f"SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY {_ORIGIN} || ({_PATH}), contains(url, '?') ORDER BY page_id) AS nth FROM pages) WHERE NOT contains(url, '?') OR nth <= 5")
def url_variant_cap(spark, sf_dir):
    return links.capped_variants(_read(spark, sf_dir, "pages").select("page_id", "url"))


@query(r"""SELECT page_id, regexp_matches(target, '^/en(?:/.*)?$') AS included, regexp_matches(target, '^/[^/]*/[^/]*\.html$') OR regexp_matches(target, '^/de(?:/.*)?$') AS excluded
  FROM (SELECT page_id, """ + _PATH + r""" || regexp_extract(url, '^[^?#]*([?#].*)$', 1) AS target FROM pages)""")
def url_globs(spark, sf_dir):
    u = F.col("url")
    target = F.concat(U.path_of(u), F.regexp_extract(u, r"^[^?#]*([?#].*)$", 1))
    return _read(spark, sf_dir, "pages").select("page_id", target.rlike(G.to_regex("/en/**")).alias("included"), G.excluded(u, ["/*/*.html", "/de/*"]).alias("excluded"))


@query(rf"""SELECT page_id, {composed._slug('t')} AS slug,
  regexp_replace(lower(t), '[^a-z0-9]', '-', 'g') AS anchor FROM (SELECT page_id, {_clean(_TITLE)} AS t FROM pages)""")
def heading_slugs(spark, sf_dir):
    t = F.trim(F.regexp_replace(T.decode_entities(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)), r"[ \t\n\f\r]+", " "))
    return _read(spark, sf_dir, "pages").select("page_id", T.slugify(t).alias("slug"), T.anchor(t).alias("anchor"))


_TOKENS = r"[\[\]()#*\-!:|]|[^ \n\t\r\[\]()#*\-!:|]+"


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{_TOKENS}')) AS BIGINT) AS tokens, trim(regexp_replace(text, '[*_`]', '', 'g'), ' ') AS plain FROM documents")
def document_tokens(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.token_count(F.col("text")).alias("tokens"), T.strip_markdown(F.col("text")).alias("plain"))


@query("SELECT page_id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(url, ''), lambda c: ascii(c)::BIGINT)), lambda h, x: (xor(h, x) * 16777619) & 4294967295) AS fnv FROM pages")
def url_fnv(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", T.fnv1a(F.col("url")).alias("fnv"))


_ARTICLE = r"regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
_BLOCK_LIST = rf"regexp_extract_all({_ARTICLE}, '<p>(?:<b>)?[^<]*')"
_LINK_LIST = r"regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]*</a>')".replace('\\"', '"')
_MD_BLOCKS = rf"array_to_string(list_transform({_BLOCK_LIST}, lambda b: CASE WHEN b LIKE '<p><b>%' THEN '**' || {_escaped('substr(b, 7)')} || '  ' || chr(10) || '**' ELSE {_started('substr(b, 4)')} END), chr(10) || chr(10))"
_MD_LINKS = rf"""array_to_string(list_transform({_LINK_LIST}, lambda a: '- [' || {_labelled("regexp_extract(a, '>([^<]*)<', 1)")} || '](' || regexp_extract(a, 'href="([^"]*)"', 1) || ')'), chr(10))"""
_AD = """regexp_extract(html, '<div class="ad">([^<]*)', 1)"""
_FOOT = "regexp_extract(html, '<footer>([^<]*)', 1)"
_GAP = "chr(10) || chr(10)"


@query(rf"SELECT page_id, {_started(_TITLE)} || {_GAP} || {_MD_LINKS} || {_GAP} || {_started(_AD)} || {_GAP} || '# ' || {_headed(_TITLE)} || {_GAP} || {_MD_BLOCKS} || {_GAP} || {_started(_FOOT)} AS markdown FROM pages")
def convert_markdown(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages")
    return convert.for_all(pages, convert.to_markdown(markup.tokens(pages)))


@query(rf"SELECT page_id, '# ' || {_headed(_TITLE)} || {_GAP} || {_MD_BLOCKS} AS markdown FROM pages")
def convert_minimal(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages")
    return convert.for_all(pages, convert.to_markdown(convert.minimal(markup.tokens(pages))))


_TEXT_BLOCKS = rf"array_to_string(list_transform({_BLOCK_LIST}, lambda b: {_clean('''regexp_replace(b, '<[^>]*>', '', 'g')''')}), chr(10) || chr(10))"
_TEXT_LINKS = rf"""array_to_string(list_transform({_LINK_LIST}, lambda a: {_clean("regexp_extract(a, '>([^<]*)<', 1)")}), chr(10))"""


@query(rf"SELECT page_id, {_clean(_TITLE)} || {_GAP} || {_TEXT_LINKS} || {_GAP} || {_clean(_AD)} || {_GAP} || {_clean(_TITLE)} || {_GAP} || {_TEXT_BLOCKS} || {_GAP} || {_clean(_FOOT)} AS text FROM pages")
def convert_text(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages")
    return convert.for_all(pages, convert.to_text(markup.tokens(pages)))


def _as_html(x: str) -> str:
    return f"replace(replace(replace({_clean(x)}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


_SLUG = composed._slug(_clean(_TITLE))
_HTML_LINKS = rf"""array_to_string(list_transform({_LINK_LIST}, lambda a: '<li><a href="' || regexp_extract(a, 'href="([^"]*)"', 1) || '">' || {_as_html("regexp_extract(a, '>([^<]*)<', 1)")} || '</a></li>'), '')"""
_HTML_BLOCKS = rf"array_to_string(list_transform({_BLOCK_LIST}, lambda b: CASE WHEN b LIKE '<p><b>%' THEN '<p><strong>' || {_as_html('substr(b, 7)')} || '<br></strong></p>' ELSE '<p>' || {_as_html('substr(b, 4)')} || '</p>' END), '')"


@query(rf"""SELECT page_id, {_as_html(_TITLE)} || '<nav><ul>' || {_HTML_LINKS} || '</ul></nav><div>' || {_as_html(_AD)} || '</div><article><h1' || CASE WHEN {_SLUG} <> '' THEN ' id="' || {_SLUG} || '"' ELSE '' END || '>'
  || {_as_html(_TITLE)} || '</h1>' || {_HTML_BLOCKS} || '</article><footer>' || {_as_html(_FOOT)} || '</footer>' AS safe FROM pages""")
def convert_html(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages")
    return convert.for_all(pages, convert.to_html(markup.tokens(pages)))


@query(rf"""SELECT page_id, 'h1' AS selector, {_clean(_TITLE)} AS text_content FROM pages UNION ALL SELECT page_id, '.ad', {_clean(_AD)} FROM pages
  UNION ALL SELECT page_id, 'a[href]', {_clean("regexp_extract(a, '>([^<]*)<', 1)")} FROM (SELECT page_id, unnest({_LINK_LIST}) AS a FROM pages)""")
def extract_elements(spark, sf_dir):
    found = selectors.extract(markup.tokens(_read(spark, sf_dir, "pages")), ["a[href]", "h1", ".ad"])
    return found.select(F.col("key").alias("page_id"), "selector", "text_content")


@query(rf"SELECT page_id, {_clean(_TITLE)} AS title, len(list_distinct(list_transform({_LINK_LIST}, lambda a: regexp_extract(a, 'href=.([^\"]*).>', 1)))) AS n_links FROM pages".replace('\\"', '"'))
def page_metadata(spark, sf_dir):
    return links.metadata(_read(spark, sf_dir, "pages")).select("page_id", "title", F.size("links").alias("n_links"))


@query(r"""SELECT doc_id, CAST(i AS INTEGER) AS line_no, content FROM (SELECT doc_id, unnest(l) AS content, generate_subscripts(l, 1) AS i
  FROM (SELECT doc_id, string_split(regexp_replace(text, '^\s+', ''), chr(10)) AS l FROM documents)) WHERE regexp_replace(content, '\s', '', 'g') <> ''""")
def document_lines(spark, sf_dir):
    return corpus.lines(_read(spark, sf_dir, "documents"))


_SECTIONS = rf"""WITH md AS MATERIALIZED ({ORACLE_SQL["convert_markdown"]}),
  cut AS MATERIALIZED (SELECT page_id, l, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT page_id, string_split(regexp_replace(markdown, '^\s+', ''), chr(10)) AS l FROM md)),
  fenced AS (SELECT *, starts_with(line, '```') AS fence, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) % 2 = 1 AS within FROM cut),
  leveled AS (SELECT *, NOT fence AND NOT within AS free, CASE WHEN NOT fence AND NOT within THEN length(regexp_extract(line, '^(#{{1,6}}) .', 1)) ELSE 0 END AS level FROM fenced),
  begun AS (SELECT *, (level IN (1, 2) AND row_number() OVER (PARTITION BY page_id, level ORDER BY i) > 1) OR (free AND level = 0 AND regexp_matches(trim(line), '^(-{{3,}}|\*{{3,}}|_{{3,}})$')) AS begins FROM leveled),
  parted AS (SELECT *, sum(CAST(begins AS INT)) OVER (PARTITION BY page_id ORDER BY i) AS part, last_value(CASE WHEN level = 1 THEN trim(regexp_replace(substr(line, 3), '[*_`]', '', 'g')) END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i) AS h FROM begun),
  parts AS (SELECT page_id, part, count(*) AS n, regexp_replace(string_agg(line, chr(10) ORDER BY i), '\s+$', '') AS content, arg_max(h, i) AS h1 FROM parted GROUP BY page_id, part)
  SELECT page_id, CAST(row_number() OVER w AS INTEGER) AS nth, content, h1, CAST(1 + coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS loc_from,
  CAST(1 + sum(n) OVER w - CASE WHEN lead(part) OVER w IS NULL THEN 1 ELSE 0 END AS INTEGER) AS loc_to FROM parts WHERE content <> '' WINDOW w AS (PARTITION BY page_id ORDER BY part)"""


@query(_SECTIONS)
def page_sections(spark, sf_dir):
    md = convert.to_markdown(markup.tokens(_read(spark, sf_dir, "pages")))
    found = corpus.sections(md, "page_id", "markdown", levels=(1, 2))
    return found.select("page_id", "nth", "content", F.try_element_at("headers", F.lit("h1")).alias("h1"), "loc_from", "loc_to")


@query()
def document_chunks(spark, sf_dir):
    return corpus.chunks(corpus.sections(_read(spark, sf_dir, "documents")))


_SHINGLES = r"""SELECT DISTINCT doc_id, array_to_string(t[i:i + 5], ' ') AS shingle FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 5, 1) + 1)) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS t FROM documents) WHERE len(t) > 0)"""


@query(f"SELECT shingle, count(*) AS n_docs FROM ({_SHINGLES}) GROUP BY shingle HAVING count(*) > 1")
def boilerplate_frequency(spark, sf_dir):
    return corpus.shingle_frequency(_read(spark, sf_dir, "documents"), least=2)


_STRIP = r"""WITH docs AS (SELECT doc_id, text, regexp_extract_all(text, '\S+') AS t, regexp_extract_all(text, '\s*\S+') AS p FROM documents),
  places AS (SELECT doc_id, i, array_to_string(t[i:i + 5], ' ') AS g FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 5, 1) + 1)) AS i FROM docs WHERE len(t) > 0)),
  common AS (SELECT g FROM places GROUP BY g HAVING count(DISTINCT doc_id) >= greatest(2, ceil(0.01 * (SELECT count(*) FROM documents)))),
  hits AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 6, true) AS gap FROM places WHERE g IN (SELECT g FROM common)),
  runs AS (SELECT doc_id, min(i) AS a, max(i) + 6 AS b FROM (SELECT doc_id, i, sum(CAST(gap AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hits) GROUP BY doc_id, r),
  gone AS (SELECT doc_id, a, least(b, len(p) + 1) AS b FROM runs JOIN docs USING (doc_id) WHERE least(b, len(p) + 1) - a >= 12),
  bounds AS (SELECT doc_id, list_sort(list(a)) AS a, list_sort(list(b)) AS b FROM gone GROUP BY doc_id),
  parts AS (SELECT doc_id, list_filter(list_transform(list_zip(list_prepend(1::BIGINT, b), list_append(a, (len(p) + 1)::BIGINT)), lambda z: array_to_string(p[z[1]:z[2] - 1], '')), lambda s: s <> '') AS parts FROM bounds JOIN docs USING (doc_id))
  SELECT d.doc_id, CASE WHEN parts IS NULL OR len(parts) = 0 THEN text ELSE array_to_string(list_transform(parts, lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), chr(10) || chr(10)) END AS text
  FROM docs d LEFT JOIN parts ON d.doc_id = parts.doc_id"""


@query(_STRIP)
def boilerplate_strip(spark, sf_dir):
    return corpus.boilerplate(_read(spark, sf_dir, "documents"), threshold=0.01)


@query(rf"""SELECT page_id, CASE WHEN len(segs) <= 1 AND NOT nested THEN '' WHEN n2 > 1 THEN p2 ELSE '/' || seg1 END AS grp, array_to_string(segs, '/') AS path FROM (
  SELECT *, count(*) OVER (PARTITION BY p2) AS n2, max(len(segs)) OVER (PARTITION BY seg1) > 1 AS nested FROM (
  SELECT page_id, segs, COALESCE(segs[1], '') AS seg1, '/' || array_to_string(segs[1:2], '/') AS p2 FROM (
  SELECT page_id, list_filter(string_split({_PATH}, '/'), lambda s: s <> '') AS segs FROM pages)))""")
def page_sort_groups(spark, sf_dir):
    rows = corpus.sort_keys(_read(spark, sf_dir, "pages").select("page_id", U.path_of(F.col("url")).alias("path")))
    return rows.select("page_id", F.col("group").alias("grp"), F.array_join("segments", "/").alias("path"))


@query(rf"""SELECT CAST(ord AS BIGINT) AS ord, line FROM (VALUES (-4, '# Pages'), (-3, ''), (-2, '## Pages'), (-1, '')) v(ord, line)
  UNION ALL SELECT page_id, '- [' || {_clean(_TITLE)} || '](' || url || ')' FROM pages""")
def llms_index(spark, sf_dir):
    title = F.trim(F.regexp_replace(T.decode_entities(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)), r"[ \t\n\f\r]+", " "))
    pages = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), title.alias("title"), "url", F.lit(None).cast("string").alias("description"))
    return corpus.llms_lines(pages, "Pages")


@query(rf"""SELECT page_id AS ord, '- [' || t || '](#' || regexp_replace(lower(t), '[^a-z0-9]', '-', 'g') || ')' AS toc, '---' || chr(10) || 'title: ' || t || chr(10) || 'url: ' || url || chr(10) || '---' || {_GAP} || body || {_GAP} || '---' || chr(10) AS block
  FROM (SELECT page_id, url, {_clean(_TITLE)} AS t, CASE WHEN {_headed(_TITLE)} = {_clean(_TITLE)} THEN {_MD_BLOCKS} ELSE '# ' || {_headed(_TITLE)} || {_GAP} || {_MD_BLOCKS} END AS body FROM pages)""")
def llms_full(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages")
    md = convert.for_all(pages, convert.to_markdown(convert.minimal(markup.tokens(pages)))).withColumnRenamed("page_id", "id")
    rows = pages.select("page_id", "url").join(md, F.col("page_id") == F.col("id")).join(links.metadata(pages).select("page_id", "title", "description"), "page_id")
    return corpus.llms_full_blocks(rows.select(F.col("page_id").alias("ord"), "title", "url", "description", F.col("markdown").alias("content")))


_EDGES = rf"""SELECT DISTINCT '/' || regexp_extract({_clean(_TITLE)}, '^([^ ]*)', 1) AS src, regexp_extract(a, 'href="([^"]*)"', 1) AS dst FROM (SELECT html, unnest({_LINK_LIST}) AS a FROM pages)"""


@query(rf"""WITH RECURSIVE edges AS ({_EDGES}), walk(url, depth) AS (SELECT '/The', 0 UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = url WHERE depth < 3)
  SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY url""")
def crawl_frontier(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages")
    word = F.regexp_extract(F.trim(F.regexp_replace(T.decode_entities(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)), r"[ \t\n\f\r]+", " ")), "^([^ ]*)", 1)
    edges = links.links(pages).join(pages.select("page_id", F.concat(F.lit("/"), word).alias("src")), "page_id").select("src", F.col("href").alias("dst")).distinct()
    return links.crawl(spark.createDataFrame([("/The",)], "url string"), edges, 3)


_SITE_EDGES = _EDGES.replace("'/' || regexp_extract", "'https://e.test/' || regexp_extract").replace("""regexp_extract(a, 'href="([^"]*)"', 1) AS dst""", """'https://e.test' || regexp_extract(a, 'href="([^"]*)"', 1) AS dst""")
_WAVE = """SELECT DISTINCT dst AS url FROM edges JOIN {} ON src = url WHERE NOT regexp_matches(dst, '^https://e.test/[^/]*a$') AND NOT contains(regexp_extract(dst, '([^/]*)$', 1), '.') AND dst NOT IN (SELECT url FROM {})"""


@query(rf"""WITH edges AS MATERIALIZED ({_SITE_EDGES}), w0 AS (SELECT 'https://e.test/The' AS url),
  w1 AS MATERIALIZED (SELECT * FROM ({_WAVE.format("w0", "w0")}) ORDER BY url LIMIT 12), s1 AS MATERIALIZED (FROM w0 UNION ALL FROM w1),
  w2 AS MATERIALIZED (SELECT * FROM ({_WAVE.format("w1", "s1")}) ORDER BY url LIMIT 12), s2 AS MATERIALIZED (FROM s1 UNION ALL FROM w2),
  w3 AS MATERIALIZED (SELECT * FROM ({_WAVE.format("w2", "s2")}) ORDER BY url LIMIT least(12, greatest(0, 30 - (SELECT count(*) FROM s2))))
  SELECT url, CAST(0 AS INTEGER) AS depth FROM w0 UNION ALL SELECT url, 1 FROM w1 UNION ALL SELECT url, 2 FROM w2 UNION ALL SELECT url, 3 FROM w3""")
def crawl_limits(spark, sf_dir):
    """A crawl of at most 30 pages, 12 a wave, without addresses that end in "a"."""
    pages = _read(spark, sf_dir, "pages")
    word = F.regexp_extract(F.trim(F.regexp_replace(T.decode_entities(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)), r"[ \t\n\f\r]+", " ")), "^([^ ]*)", 1)
    at = pages.select("page_id", F.concat(F.lit("https://e.test/"), word).alias("src"))
    edges = links.links(pages, F.lit("https://e.test"), clean=False).join(at, "page_id").select("src", F.col("url").alias("dst")).distinct()
    seeds = spark.createDataFrame([("https://e.test/The",)], "url string")
    return links.crawl_site(seeds, edges, links.CrawlConfig(max_depth=3, max_pages=30, per_wave=12, exclude=("/*a",)))


@query(rf"""SELECT page_id, url FROM pages WHERE regexp_matches({_PATH} || regexp_extract(url, '^[^?#]*([?#].*)$', 1), '^/(?:en|de)(?:/.*)?$') AND regexp_matches(url, '^https://(?:[^/?#]*[.])?example[.]com[/?#]')
  AND NOT regexp_matches({_PATH} || regexp_extract(url, '^[^?#]*([?#].*)$', 1), '^/[^/]*/[^/]*\.html$')""")
def sitemap_filter(spark, sf_dir):
    """Addresses of two folders on the subdomains of two sites that a sitemap's filter lets through."""
    suffixes = ("com", "org", "net")
    wanted = G.wanted(F.col("url"), ("https://example.com/en/**", "https://example.com/de/**"), ("/*/*.html",), suffixes)
    return _read(spark, sf_dir, "pages").where(wanted & F.col("url").startswith("https:")).select("page_id", "url")


@query(f"SELECT p.page_id, CAST(count(DISTINCT target) AS INTEGER) AS n_links, min(target) AS least, max(target) AS most FROM pages p LEFT JOIN ({_LINKS}) l USING (page_id) GROUP BY p.page_id")
def host_links(spark, sf_dir):
    """By page: how many addresses of its own host it links to, the first and the last of them by code point."""
    found = links.host_links(_read(spark, sf_dir, "pages"))
    return found.select("page_id", F.size("links").alias("n_links"), F.array_min("links").alias("least"), F.array_max("links").alias("most"))


_FACTS = rf"""SELECT {_ORIGIN} AS origin, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host, page_id, {_clean(_TITLE)} AS t, {_clean(_AD)} AS d, regexp_matches(url, '^[a-z]+://[^/?#]*/?$') AS home FROM pages_at"""


@query(f"""WITH pages_at AS (SELECT page_id, html, CASE WHEN page_id % 5 = 0 THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) ELSE url END AS url FROM pages), f AS ({_FACTS})
  SELECT origin, coalesce(arg_min(t, page_id) FILTER (home), min(host)) AS name, coalesce(arg_min(d, page_id) FILTER (home), arg_min(d, page_id)) AS description FROM f GROUP BY origin""")
def site_facts(spark, sf_dir):
    """Name and description of each site, where some pages stand for home pages."""
    url = F.when(F.col("page_id") % 5 == 0, U.origin_of(F.col("url"))).otherwise(F.col("url"))
    said = lambda tag: F.trim(F.regexp_replace(T.decode_entities(F.regexp_extract("html", tag, 1)), r"[ \t\n\f\r]+", " "))
    pages = _read(spark, sf_dir, "pages")
    return links.site_facts(pages.select("page_id", url.alias("url"), said(r"(?s)<title>(.*?)</title>").alias("title"), said('<div class="ad">([^<]*)').alias("description")))


_GROUPS = ORACLE_SQL["page_sort_groups"]


@query(f"""WITH g AS ({_GROUPS}), sized AS (SELECT grp, count(*) AS n, row_number() OVER (ORDER BY grp <> '', grp) - CASE WHEN (SELECT count(*) FROM g WHERE grp = '') > 0 THEN 1 ELSE 0 END AS nth, lead(grp) OVER (ORDER BY grp <> '', grp) AS nxt FROM g GROUP BY grp)
  SELECT grp, false AS is_blank, path, '- [' || page_id || '](' || url || ')' AS line FROM g JOIN (SELECT page_id, url FROM pages) p USING (page_id)
  UNION ALL SELECT grp, true, NULL, '' FROM sized WHERE nxt IS NOT NULL AND (nth = 0 OR (nth <= 2 AND n > 1))""")
def llms_grouped(spark, sf_dir):
    """An index in the order of a directory tree, with the empty lines that end its first groups."""
    pages = _read(spark, sf_dir, "pages").select(U.path_of(F.col("url")).alias("path"), F.col("page_id").cast("string").alias("title"), "url", F.lit(None).cast("string").alias("description"))
    found = corpus.llms_grouped(pages)
    return found.select("grp", "is_blank", F.array_join("path", "/").alias("path"), "line")


_SECTION = {"title": "Start", "description": ["One.", "Two."], "links": [{"title": "A", "href": "/a", "description": "first"}, {"title": "B", "href": "/b"}]}


@query(rf"""SELECT CAST(ord AS BIGINT) AS ord, line FROM (VALUES (-15, '# N'), (-14, ''), (-13, '> D'), (-12, ''), (-11, 'Canonical Origin: https://o.test'), (-10, ''), (-9, '## Start'), (-8, ''), (-7, 'One.'), (-6, ''), (-5, 'Two.'), (-4, ''), (-3, '- [A](/a): first'), (-2, '- [B](/b)'), (-1, '')) h(ord, line)
  UNION ALL SELECT n_nationkey + 2, '- [' || n_name || '](https://o.test/' || n_nationkey || ')' || CASE WHEN length(repeat(n_name, 13)) > 100 THEN ': ' || repeat(n_name, 13)[1:100] || '...' ELSE ': ' || repeat(n_name, 13) END FROM nation
  UNION ALL SELECT * FROM (VALUES (0, '## Pages'), (1, ''), (4611686018427387904, ''), (4611686018427387905, 'Bye.')) t(ord, line)""")
def llms_sections(spark, sf_dir):
    """An index with a section before its pages and a note after them."""
    nation = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("title"), F.concat(F.lit("/"), F.col("n_nationkey").cast("string")).alias("url"), F.repeat("n_name", F.lit(13)).alias("description"))
    rows = corpus.llms_lines(nation, "N", "D", "https://o.test", sections=[_SECTION], notes="Bye.")
    return rows.select(F.when(F.col("ord") < 1 << 60, F.col("ord") + 2).otherwise(F.col("ord")).alias("ord"), "line")


_ACCEPTS = ("text/markdown", "text/html", "*/*", "text/html;q=0.5, text/markdown;q=0.9", "text/markdown;q=0, */*", "application/json", "", "text/plain, text/html", "text/html, */*;q=0.1")


@query("SELECT event_id, ['markdown', 'html', 'html', 'markdown', 'html', 'not-acceptable', 'html', 'markdown', 'html'][CAST(event_id % 9 AS INTEGER) + 1] AS served FROM events")
def accept_negotiation(spark, sf_dir):
    accept = F.get(F.array(*map(F.lit, _ACCEPTS)), (F.col("event_id") % 9).cast("int"))
    return _read(spark, sf_dir, "events").select("event_id", http.negotiate(accept, F.lit(None).cast("string")).alias("served"))


@query("SELECT page_id, 'urlset' AS kind, url AS loc FROM pages")
def sitemap_locations(spark, sf_dir):
    xml = F.concat(F.lit("<urlset><url><loc> "), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url></urlset>"))
    return links.sitemap_urls(_read(spark, sf_dir, "pages").select("page_id", xml.alias("xml"))).select("page_id", "kind", "loc")


@query("SELECT n_nationkey, ['https://x.org/' || n_name || '.xml', 'https://x.org/all.xml'] AS sitemaps, n_nationkey + 0.5::DOUBLE AS crawl_delay FROM nation")
def robots_files(spark, sf_dir):
    text = F.concat(F.lit("User-agent: *\nCrawl-delay: "), F.col("n_nationkey").cast("string"), F.lit(".5\nSitemap: https://x.org/"), "n_name", F.lit(".xml\nsitemap:https://x.org/all.xml \n"))
    return links.robots(_read(spark, sf_dir, "nation").select("n_nationkey", text.alias("text"))).drop("text")


@query(rf"""SELECT doc_id, md, {{'title': 'Doc ' || doc_id, 'lang': lang}}.title AS title, lang AS fm_lang FROM (SELECT doc_id, lang, '---' || chr(10) || 'title: Doc ' || doc_id || chr(10) || 'lang: ' || lang || chr(10) || '---' || chr(10) AS md FROM documents)""")
def frontmatter_fields(spark, sf_dir):
    md = F.concat(F.lit("---\ntitle: Doc "), F.col("doc_id").cast("string"), F.lit("\nlang: "), "lang", F.lit("\n---\n"))
    rows = _read(spark, sf_dir, "documents").select("doc_id", md.alias("md"))
    fields = T.frontmatter(F.col("md"))
    return rows.select("doc_id", "md", fields["title"].alias("title"), fields["lang"].alias("fm_lang"))


@query(r"""SELECT page_id, '## Page ' || page_id || chr(10) || chr(10) || ' ' || url || ' go [here](#page-' || page_id || ') gone ![x](#none)' || chr(10) || '```' || chr(10) || '[](a)' || chr(10) || '```' AS markdown FROM pages""")
def markdown_cleaning(spark, sf_dir):
    i = F.col("page_id").cast("string")
    md = F.concat(F.lit("## [Page "), i, F.lit("](#x)\n\n![](i.png)[](/t) ["), "url", F.lit("]("), "url", F.lit(") [go](JavaScript:f(1)) [here](#page-"), i, F.lit(") [gone](#none) ![x](#none)\n```\n[](a)\n```"))
    return _read(spark, sf_dir, "pages").select("page_id", clean.clean_markdown(md).alias("markdown"))


@query(rf"SELECT page_id, rtrim(regexp_replace('x ' || {_clean(_TITLE)}, '(\S.{{0,19}}|\S+)(?: +|$)', '\1' || chr(10), 'g'), chr(10)) AS wrapped FROM pages")
def markdown_wrap(spark, sf_dir):
    title = F.trim(F.regexp_replace(T.decode_entities(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)), r"[ \t\n\f\r]+", " "))
    return _read(spark, sf_dir, "pages").select("page_id", clean.hard_wrap(F.concat(F.lit("x "), title), 20).alias("wrapped"))


_LOOKS = ("font-bold lg:font-thin", "italic sm:not-italic italic", "underline hidden md:block", "fixed 2xl:relative xl:absolute", "md:font-bold font-normal no-underline", "")


@query("SELECT event_id, ['', '', '~~', '', '**', ''][CAST(event_id % 6 AS INTEGER) + 1] AS marks, false AS hidden FROM events")
def utility_classes(spark, sf_dir):
    look = F.get(F.array(*map(F.lit, _LOOKS)), (F.col("event_id") % 6).cast("int"))
    return _read(spark, sf_dir, "events").select("event_id", style.marks(look).alias("marks"), style.properties(look)["hidden"].alias("hidden"))


@query(rf"""SELECT page_id, '---' || chr(10) || 'title: ' || CASE WHEN regexp_matches(t, '[\n:# ]') THEN '"' || replace(t, '"', '\"') || '"' ELSE replace(t, '"', '\"') END || chr(10) || '---' || chr(10) || chr(10) AS yaml
  FROM (SELECT page_id, {_clean(_TITLE)} AS t FROM pages)""")
def page_frontmatter(spark, sf_dir):
    found = frontmatter.fields(markup.tokens(_read(spark, sf_dir, "pages")))
    return found.select("page_id", frontmatter.yaml(F.col("title"), F.col("meta")).alias("yaml"))


@query("SELECT event_type, CAST(sum(event_id) AS BIGINT) AS total, min(event_id) AS least, max(event_id) AS most, count(event_id) AS n FROM events GROUP BY event_type")
def fetch_latency(spark, sf_dir):
    return links.latency(_read(spark, sf_dir, "events"), "event_type", F.col("event_id"))


@query(ORACLE_SQL["convert_minimal"].replace("AS markdown", "AS md").join(("SELECT lang, count(*) AS n, CAST(sum(len(regexp_extract_all(md, '" + _TOKENS + "'))) AS BIGINT) AS md_tokens, CAST(sum(html_tokens) AS BIGINT) AS html_tokens FROM (", ") q JOIN (SELECT page_id AS id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, len(regexp_extract_all(html, '" + _TOKENS + "')) AS html_tokens FROM pages) p ON id = page_id GROUP BY lang")))
def token_savings(spark, sf_dir):
    """By language: tokens of the pages as HTML, and as Markdown under the minimal preset."""
    pages = _read(spark, sf_dir, "pages")
    md = convert_minimal(spark, sf_dir).select(F.col("page_id").alias("id"), T.token_count(F.col("markdown")).alias("md"))
    html = pages.select("page_id", F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"), T.token_count(F.col("html")).alias("html"))
    return html.join(md, F.col("id") == F.col("page_id")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("md").alias("md_tokens"), F.sum("html").alias("html_tokens"))


@query(ORACLE_SQL["convert_markdown"])
def stream_markdown(spark, sf_dir):
    """Pages cut into pieces, streamed through per-document state and converted as they end."""
    stream, at = _streamed(spark, sf_dir)
    site.stream_to_markdown(stream, f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("page_id", "markdown")


def _shared(spark) -> str:
    """The folder that all executors share; a temporary one only where none is set on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="pagemill-")
    return folder.rstrip("/")


def _streamed(spark, sf_dir, in_bytes: bool = False, batches: int = 1):
    """A stream of the pages' pieces, and a new folder in the shared place; ``batches`` of them if more than one."""
    at = f"{_shared(spark)}/stream-{uuid.uuid4().hex}"
    pieces = site.pieces_of(spark, _read(spark, sf_dir, "pages"), in_bytes=in_bytes)
    reader = spark.readStream.schema(f"key bigint, seq int, chunk {'binary' if in_bytes else 'string'}, is_last boolean")
    if batches > 1:
        reader = reader.option("maxFilesPerTrigger", _dealt(pieces, f"{at}/pieces", batches))
    else:
        pieces.write.parquet(f"{at}/pieces")
    return reader.parquet(f"{at}/pieces"), at


#: Bytes of pieces in one file.
FILE_BYTES = 64 << 20


def _dealt(pieces: DataFrame, at: str, batches: int) -> int:
    """Writes pieces as files for so many batches, and returns how many files a batch has: more with more text, so that no task writes or reads much."""
    files = max(1, -(-(pieces.agg(F.sum(F.octet_length("chunk"))).first()[0] or 0) // (batches * FILE_BYTES)))
    to = F.pmod("seq", F.lit(batches)) * files + F.pmod(F.hash("key"), F.lit(files))
    pieces.repartitionById(batches * files, to.cast("int")).write.parquet(at)
    return files


@query(ORACLE_SQL["convert_markdown"])
def stream_bytes(spark, sf_dir):
    """Pages as bytes, cut within characters too, streamed and converted as they end."""
    stream, at = _streamed(spark, sf_dir, in_bytes=True)
    site.stream_to_markdown(stream, f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("page_id", "markdown")


@query(ORACLE_SQL["convert_markdown"])
def stream_deltas(spark, sf_dir):
    """Pages whose pieces come in several batches, converted block by block as these are finished, and joined."""
    stream, at = _streamed(spark, sf_dir, batches=3)
    site.stream_to_deltas(stream, f"{at}/out", f"{at}/state").awaitTermination()
    return site.join_deltas(spark.read.parquet(f"{at}/out"))


@query()
def stream_chunks(spark, sf_dir):
    """The documents, in pieces that come in several batches, cut into chunks as their sections are finished."""
    at = f"{_shared(spark)}/stream-{uuid.uuid4().hex}"
    pieces = site.pieces_of(spark, _read(spark, sf_dir, "documents"), key="doc_id", text="text")
    files_a_batch = _dealt(pieces, f"{at}/pieces", 3)
    stream = spark.readStream.schema("key bigint, seq int, chunk string, is_last boolean").option("maxFilesPerTrigger", files_a_batch).parquet(f"{at}/pieces")
    site.stream_to_chunks(stream, f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").drop("batch").withColumnRenamed("key", "doc_id")


@query(ORACLE_SQL["extract_elements"])
def stream_elements(spark, sf_dir):
    """Elements of pages that arrive in pieces."""
    stream, at = _streamed(spark, sf_dir)
    site.stream_to_elements(stream, ["a[href]", "h1", ".ad"], f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").select(F.col("key").alias("page_id"), "selector", "text_content")


@query(rf"""SELECT CAST(ord AS BIGINT) AS ord, line FROM (VALUES (-4, '# Pages'), (-3, ''), (-2, '## Pages'), (-1, '')) v(ord, line)
  UNION ALL SELECT page_id, '- [' || {_clean(_TITLE)} || '](' || url || ')' FROM pages""")
def stream_index(spark, sf_dir):
    """The index of a stream of pages, gathered batch by batch and put in order at its end."""
    _, at = _streamed(spark, sf_dir)
    pages = _read(spark, sf_dir, "pages")
    title = F.trim(F.regexp_replace(T.decode_entities(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)), r"[ \t\n\f\r]+", " "))
    pages.select(F.col("page_id").alias("ord"), title.alias("title"), "url", F.lit(None).cast("string").alias("description"), F.lit("").alias("content")).write.parquet(f"{at}/pages")
    stream = spark.readStream.schema("ord bigint, title string, url string, description string, content string").parquet(f"{at}/pages")
    site.stream_to_index(stream, f"{at}/out", f"{at}/state").awaitTermination()
    return site.close_index(spark, f"{at}/out", "Pages")[0]


@query(f"SELECT page_id, yaml || markdown AS markdown FROM ({ORACLE_SQL['page_frontmatter']}) f JOIN ({ORACLE_SQL['convert_minimal']}) m USING (page_id)")
def convert_preset(spark, sf_dir):
    """The whole minimal preset: main content, filters, front matter, styles and cleaning."""
    return plans.pages_to_markdown(_read(spark, sf_dir, "pages"), plans.Options.minimal())


@query(ORACLE_SQL["convert_minimal"].replace("'**' || ", "'{' || ").replace("|| '**'", "|| '}'").replace("'# ' || ", "'### ' || "))
def convert_overrides(spark, sf_dir):
    """Main content with first headings as third ones, and bold text in braces."""
    options = plans.Options.minimal(frontmatter=False, exclude=(*convert.MINIMAL, "head"), cleaning=False, names={"h1": "h3"}, marks={"b": ("{", "}")})
    return plans.pages_to_markdown(_read(spark, sf_dir, "pages"), options)


@query(f"SELECT page_id, CASE WHEN contains(html, '<html lang=\"de\"') THEN html ELSE markdown END AS markdown FROM pages JOIN ({ORACLE_SQL['convert_markdown']}) m USING (page_id)")
def markdown_answers(spark, sf_dir):
    """Pages converted, but for those that came as Markdown."""
    kind = F.when(F.contains("html", F.lit('<html lang="de"')), "text/markdown; charset=utf-8").otherwise("text/html")
    return plans.answers_to_markdown(_read(spark, sf_dir, "pages").withColumn("content_type", kind))


FLAGSHIP = token_savings


_RETRIED = ", ".join(str(x) for x in files.RETRIED)
_LOG = """SELECT event_id AS id, 'https://h' || user_id % 7 || '.test/' || user_id AS url, ts AS seen, CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 429 ELSE 503 END WHEN 'view' THEN 200 WHEN 'click' THEN 404 WHEN 'purchase' THEN 301 END AS status,
  CASE WHEN event_id % 3 = 0 THEN regexp_extract(props, '([0-9]+)', 1) END AS retry_after FROM events"""


def _fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log of fetches: errors ask to try again, some with a header that says when."""
    status = F.expr("CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 429 ELSE 503 END WHEN 'view' THEN 200 WHEN 'click' THEN 404 WHEN 'purchase' THEN 301 END")
    url = F.concat(F.lit("https://h"), F.col("user_id") % 7, F.lit(".test/"), F.col("user_id"))
    after = F.when(F.col("event_id") % 3 == 0, F.regexp_extract("props", "([0-9]+)", 1))
    return _read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), url.alias("url"), F.col("ts").alias("at"), status.alias("status"), after.alias("retry_after"))


@query(rf"""WITH log AS ({_LOG}), marked AS (SELECT *, status IS NULL OR status IN ({_RETRIED}) AS again, regexp_extract(url, '://([^/]*)', 1) AS host,
    CASE WHEN status = 429 THEN CASE WHEN retry_after IS NULL THEN 2 ELSE coalesce(nullif(CAST(retry_after AS BIGINT), 0), 1) END END AS asked FROM log),
  cut AS (SELECT *, coalesce(sum(CASE WHEN again THEN 0 ELSE 1 END) OVER (PARTITION BY url ORDER BY seen, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part,
    coalesce(max(asked) OVER (PARTITION BY host ORDER BY seen, id), 0) AS delay FROM marked),
  counted AS (SELECT *, row_number() OVER (PARTITION BY url, part ORDER BY seen, id) - 1 AS n FROM cut)
  SELECT id, url, CAST(n % 3 + 1 AS INTEGER) AS attempt, NOT again OR n % 3 = 2 AS final, CAST(delay AS BIGINT) AS host_delay,
    CASE WHEN again AND n % 3 < 2 THEN seen + to_milliseconds(greatest(500, delay * 1000)) END AS next_try FROM counted""")
def fetch_attempts(spark, sf_dir):
    found = files.attempts(_fetch_log(spark, sf_dir), order=("at", "id"))
    return found.select("id", "url", "attempt", "final", "host_delay", "next_try")


@query(f"""WITH tries AS ({ORACLE_SQL["fetch_attempts"]}) SELECT regexp_extract(url, '://([^/]*)', 1) AS host, count(*) AS tries, CAST(count(*) FILTER (WHERE final) AS BIGINT) AS asks, max(host_delay) AS host_delay,
  min(next_try) FILTER (WHERE id IN (SELECT max_by(id, (seen, id)) FROM (SELECT event_id AS id, ts AS seen, user_id FROM events) GROUP BY user_id)) AS next_try FROM tries GROUP BY 1""")
def fetch_hosts(spark, sf_dir):
    return files.next_tries(files.attempts(_fetch_log(spark, sf_dir), order=("at", "id")), order=("at", "id"))


QUERIES.update(composed.QUERIES)
ORACLE_SQL.update(composed.ORACLE_SQL)
