"""Corpus operators, streaming, files, and the registered queries against SQL."""

import random

import duckdb
import pytest

from pagemill import queries
from pagemill.operators import corpus, links
from pagemill.plans import site
from pagemill.sources import files


def plain_strip(docs, threshold, k=6, min_run=12):
    toks = {i: t.split() for i, t in docs}
    grams = {i: [tuple(t[j : j + k]) for j in range(max(1, len(t) - k + 1))] if t else [] for i, t in toks.items()}
    least = max(2, -int(-(threshold * len(docs)) // 1))
    common = {g for g in {x for v in grams.values() for x in v} if sum(g in v for v in grams.values()) >= least}
    out = {}
    for i, text in docs:
        t, cover = toks[i], [False] * len(toks[i])
        for j, g in enumerate(grams[i]):
            if g in common:
                for x in range(j, min(j + k, len(t))):
                    cover[x] = True
        parts, now, x = [], [], 0
        while x < len(t):
            y = x
            while y < len(t) and cover[y] == cover[x]:
                y += 1
            if cover[x] and y - x >= min_run:
                parts, now = [*parts, now], []
            else:
                now += t[x:y]
            x = y
        parts = [" ".join(p) for p in [*parts, now] if p]
        out[i] = text if not parts or parts == [" ".join(t)] else "\n\n".join(parts)
    return out


def test_boilerplate_matches_brute_force(spark):
    rng = random.Random(4)
    nav, foot = " ".join(f"nav{i}" for i in range(15)), " ".join(f"foot{i}" for i in range(13))
    docs = []
    for i in range(12):
        body = " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 40)) for _ in range(rng.randint(0, 40)))
        docs.append((i, " ".join(x for x in (nav if i % 4 else "", body, foot if i % 3 else "short run of it") if x)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    for threshold in (0.5, 0.9):
        assert {r.doc_id: r.text for r in corpus.boilerplate(df, threshold=threshold).collect()} == plain_strip(docs, threshold)
    assert {r.doc_id: r.text for r in corpus.boilerplate(df.limit(2)).collect()} == dict(docs[:2])


def test_sections_and_chunks(spark):
    md = "# T\n\n## A\nx\n\n### S\ny\n\n## B\n```py\n## no\n```\n---\nz"
    rows = corpus.sections(spark.createDataFrame([(1, md), (2, None), (3, " \n")], "doc_id bigint, text string")).collect()
    got = [(r.content, r.headers, r.code, r.loc_from, r.loc_to) for r in sorted(rows, key=lambda r: r.nth)]
    assert got == [
        ("# T\n\n## A\nx\n\n### S\ny", {"h1": "T", "h2": "A", "h3": "S"}, None, 1, 9),
        ("## B\n```py\n## no\n```", {"h1": "T", "h2": "B"}, "py", 9, 13),
        ("---\nz", {"h1": "T", "h2": "B"}, None, 13, 14),
    ]
    text = " ".join(f"w{i}" for i in range(400))
    pieces = corpus.cut_points(text, 100, 20)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(b[0] <= a[1] for a, b in zip(pieces, pieces[1:], strict=False))
    with pytest.raises(ValueError):
        corpus.chunks(spark.createDataFrame([], "content string"), 10, 10)


def test_sitemaps_and_crawl(spark):
    xml = [("i", "<sitemapindex><sitemap><loc>a</loc></sitemap><sitemap><loc>i</loc></sitemap></sitemapindex>"), ("a", "<urlset><url><loc><![CDATA[http://x/1]]></loc></url><url><loc>http://x/?a&amp;b</loc></url></urlset>"), ("n", "no")]
    df = spark.createDataFrame(xml, "url string, xml string")
    assert {r.url for r in links.expand_sitemaps(spark.createDataFrame([("i",)], "url string"), df).collect()} == {"http://x/1", "http://x/?a&b"}


def test_files_and_site(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "index.html").write_text("<h1>Home</h1><p>Welcome to the home page of it all.")
    (tmp_path / "in" / "sub" / "index.html").write_text("<h1>Sub</h1><p>There is more to read below.")
    (tmp_path / "in" / "bad.html").write_bytes(b"\xff\xfe")
    rows = {r.url: r for r in files.read_html(spark, f"{tmp_path}/in/**", f"{tmp_path}/in").union(files.read_html(spark, f"{tmp_path}/in/*.html", f"{tmp_path}/in")).collect()}
    assert rows["/"].valid and not rows["/bad"].valid and rows["/bad"].html is None
    pages = spark.createDataFrame([(i, f"https://e.org{u}", r.html) for i, (u, r) in enumerate(sorted(rows.items())) if r.valid], "page_id bigint, url string, html string")
    kept, index = site.site(pages, "E")
    assert {r.file for r in kept.collect()} == {"index.md", "sub.md"}
    files.write_pages(kept, f"{tmp_path}/md")
    files.write_lines(index, f"{tmp_path}/llms")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/llms").collect()]
    assert "# E" in lines and len(lines) == index.count()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = df.select(*[f"`{c}`" for c in columns]).collect()
    if name not in queries.ORACLE_SQL:
        assert rows
        return
    con = duckdb.connect()
    for table in ("pages", "documents", "events", "nation"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    found = con.sql(queries.ORACLE_SQL[name])
    at = [found.columns.index(c) for c in columns]
    assert sorted(found.columns) == columns
    assert sorted(repr(tuple(r)) for r in rows) == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())


def _explained(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_shingles_are_shuffled_once(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 7, 30))) for i in range(50)] + [(None, "w1 w2 w3 w4 w5 w6"), (3, None)], "doc_id long, text string")
    found = corpus.shingle_frequency(docs, least=2)
    # two exchanges of single shingles, by document and again without it, were there before
    assert _explained(found).count("Exchange hashpartitioning(h#") == 1
    whole = {}
    for r in docs.collect():
        words = (r.text or "").split()
        for i in range(max(1, len(words) - 5) if words else 0):
            whole.setdefault(" ".join(words[i : i + 6]), set()).add(r.doc_id)
    assert {(r.shingle, r.n_docs) for r in found.collect()} == {(s, len(d)) for s, d in whole.items() if len(d) > 1}


def test_frequent_shingles_are_found_in_parts(spark, monkeypatch):
    """A shingle at the threshold, in whatever parts its documents lie, is found without shuffling all shingles."""
    same = " ".join(f"s{j}" for j in range(14))
    rows = [(i, (f"{same} " if i % 5 == 0 else "") + " ".join(f"w{i}x{j}" for j in range(20))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(corpus, "TASK_BYTES", docs.selectExpr("sum(length(text))").first()[0] // 8)
    written = []
    monkeypatch.setattr(corpus, "_written", lambda df: written.append(_explained(df)) or df)
    got = {r.doc_id: r.text for r in corpus.boilerplate(docs, threshold=0.2).collect()}
    assert got == {i: t.removeprefix(f"{same} ") for i, t in rows}
    assert "part#" in written[0] and "Exchange hashpartitioning(part#" not in written[0]
    # one more than there are: nothing is frequent
    got = {r.doc_id: r.text for r in corpus.boilerplate(docs, threshold=0.2025).collect()}
    assert got == dict(rows)


CUT = ["Or token = &quot", "a &am", "b &ampquot; &copy", "1. &lt;b> and &notin; &notit #", "&#8364 &#x80; &#0;&#1114112; c]", "- x &gt", "T [u](v) &nope; &amp;amp; &equals;", "### &lt", "&middot y", "12) > 3"]


@pytest.fixture(scope="module")
def cut_pages(spark, tmp_path_factory):
    """Pages whose title is cut within a reference, or begins or ends like Markdown."""
    at = tmp_path_factory.mktemp("cut")
    html = lambda i, t: f'<!DOCTYPE html><html lang="{"de" if i % 3 else "en"}"><head><meta charset="utf-8"><title>{t}</title></head><body><nav><ul><li><a href="/a">{t}</a></li><li><a href="/b">b</a></li></ul></nav><div class="ad">{t}</div><article><h1>{t}</h1><p><b>{t}<br><p>{t}</p><p>y {t}</p></article><footer>{t}</footer></body></html>'
    rows = [(i, f"https://e.test/p/{i}", html(i, t)) for i, t in enumerate(CUT)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return str(at)


# fmt: off
@pytest.mark.parametrize("name", [
    "convert_html", "convert_markdown", "convert_minimal", "convert_overrides", "convert_preset", "convert_text", "extract_elements", "llms_full", "markdown_answers", "page_frontmatter", "page_metadata", "page_sections",
    "stream_markdown", "heading_slugs", "llms_index", "token_savings",
])
# fmt: on
def test_cut_references_match_sql(spark, cut_pages, name):
    df = queries.QUERIES[name](spark, cut_pages)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{cut_pages}/pages.parquet/*.parquet'")
    found = con.sql(queries.ORACLE_SQL[name])
    got, wanted = ([tuple(r) for r in rows] for rows in (df.collect(), found.select(*[f'"{c}"' for c in df.columns]).fetchall()))
    assert len(got) == len(wanted)
    assert sorted(map(repr, set(got) - set(wanted))) == sorted(map(repr, set(wanted) - set(got)))


ODD = [(1, "", "en", "s"), (2, None, None, None), (-3, " \n\t", "pt_BR", "s"), (4, "a\ufdd0b\ufdd7", "zh-Hans", "s"), (5, "\u00a0", "en", "s"), (6, 'x > y "q" & &lt; &quot <b>', "EN", "s")]


@pytest.mark.parametrize("name", ["composed_html", "composed_text", "composed_markdown"])
def test_odd_documents_match_sql(spark, tmp_path, name):
    spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.sql(queries.ORACLE_SQL[name]).fetchall()) and len(got) == len(ODD)
