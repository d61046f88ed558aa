"""Documents converted block by block as they stream in."""

import pandas as pd
from pyspark.sql import functions as F

from pagemill import composed
from pagemill import queries as Q
from pagemill.operators import convert, corpus, markup
from pagemill.plans import site
from pagemill.streaming import documents
from pagemill.streaming import sections as streamed_sections

from .test_tree import PAGES

LONG = "<body><div>" + "".join(f"<section><h2>Part {i}</h2><p>text {i} <b>of</b> it<ul><li>a<li>b</ul></section>" for i in range(300)) + "</div>tail <i>x</i>"


class State:
    """What a group keeps between batches."""

    def __init__(self):
        self.value = None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None


def streamed(html, size, order=lambda n: range(n)):
    """The parts of a page that comes in pieces of a size, one batch each, and the longest tail that was kept."""
    pieces = [html[i : i + size] for i in range(0, len(html), size)] or [""]
    state, parts, longest = State(), [], 0
    for i in order(len(pieces)):
        batch = pd.DataFrame({"seq": [i], "chunk": [pieces[i]], "is_last": [i == len(pieces) - 1]})
        for out in documents._advance((1,), iter([batch, batch]), state):
            parts += out.to_dict("records")
        longest = max(longest, len(state.value[0]) if state.exists else 0)
    assert not state.exists
    assert [p["nth"] for p in parts] == list(range(len(parts))) and (not parts or parts[-1]["is_last"])
    return [p["html"] for p in parts], longest


def test_parts_convert_to_what_the_page_does(spark):
    filled = composed.PAGE
    for name in composed._FIELDS:
        filled = filled.replace("{" + name + "}", f"{name} <b>1</b>")
    pages = [p for p, _, _ in PAGES] + [filled, LONG, ""]
    rows = []
    for i, html in enumerate(pages):
        rows.append((f"{i}", 0, 0, html))
        for size in (1, 7, 100) if len(html) < 5000 else (97, 1000):
            rows += [(f"{i}", size, nth, part) for nth, part in enumerate(streamed(html, size)[0])]
        rows += [(f"{i}", -50, nth, part) for nth, part in enumerate(streamed(html, 50, lambda n: reversed(range(n)))[0])]
    df = spark.createDataFrame(rows, "page string, size int, nth int, html string").selectExpr("struct(page, size, nth) AS part", "html")
    got = {}
    for r in convert.to_markdown(markup.tokens(df, "part"), key="part").collect():
        got.setdefault((r.part.page, r.part.size), []).append((r.part.nth, r.markdown))
    whole = {page: parts[0][1] for (page, size), parts in got.items() if size == 0}
    for (page, size), parts in got.items():
        assert "\n\n".join(md for _, md in sorted(parts) if md) == whole[page], (pages[int(page)][:80], size)


def test_state_is_the_last_block():
    parts, longest = streamed(LONG, 50)
    assert len(parts) > 300 and longest < 300
    parts, longest = streamed("<p>" + "word " * 20_000, 500)
    assert len(parts) == 1 and longest > 90_000  # one block is never cut


def test_query(spark, sf):
    got = {r.page_id: r.markdown for r in Q.stream_deltas(spark, sf).collect()}
    assert got == {r.page_id: r.markdown for r in Q.convert_markdown(spark, sf).collect()}


MARKDOWN = [
    "# A\n\ntext\n\n## B\n\none\n\n## C *x*\n\ntwo\n### D\nthree\n## E\n\n```py\n## no\n```\n\n---\n\nend\n",
    "\n \n---\ntitle: t\n---\n\n# A\n## B\n## B\n\n***\n___\n\n", "", " \n ", "---\n\na\n---\nb", "no heading", "## A\n## A\n\n\n## A\nx\r\n---\r\ny", "```\n## a\n## a\n", "## `a_b`\n## [l](x) \n####### no\n#no\n# \n## c",
]


def test_sections_equal_those_of_whole_documents(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(MARKDOWN)], "doc_id bigint, text string")
    want = {}
    for r in corpus.sections(docs).collect():
        want.setdefault(r.doc_id, []).append((r.nth, r.content, r.headers, r.code, r.loc_from, r.loc_to))
    for i, text in enumerate(MARKDOWN):
        for size in (1, 3, 1000):
            pieces = [text[j : j + size] for j in range(0, len(text), size)] or [""]
            for order in (range(len(pieces)), reversed(range(len(pieces)))):
                state, got = State(), []
                for j in order:
                    batch = pd.DataFrame({"seq": [j], "chunk": [pieces[j]], "is_last": [j == len(pieces) - 1]})
                    for out in streamed_sections._split((i,), iter([batch, batch]), state, [2, 3, 4, 5, 6]):
                        got += [(r["nth"], r["content"], r["headers"], r["code"], r["loc_from"], r["loc_to"]) for r in out.to_dict("records")]
                assert got == sorted(want.get(i, [])), (text, size)
                assert not state.exists


def test_sections_leave_when_they_are_finished():
    state, longest, n = State(), 0, 0
    for j in range(500):
        batch = pd.DataFrame({"seq": [j], "chunk": [f"## part {j}\n\nsome words\n"], "is_last": [False]})
        n += sum(len(out) for out in streamed_sections._split((1,), iter([batch]), state, [2]))
        longest = max(longest, len(state.value[0]))
    assert n == 498 and longest < 800


def test_chunks_equal_those_of_whole_documents(spark, sf):
    cols = ["doc_id", "nth", "chunk", "content", "code", "loc_from", "loc_to"]
    rows = lambda df: sorted(df.select(*cols, F.to_json("headers")).collect(), key=repr)
    assert rows(Q.stream_chunks(spark, sf)) == rows(Q.document_chunks(spark, sf))


def test_files_of_pieces_grow_in_number(spark, tmp_path, monkeypatch):
    """A batch of a stream has several files where one would be large."""
    monkeypatch.setattr(Q, "FILE_BYTES", 1000)
    docs = spark.createDataFrame([(i, f"{i} " + "word " * 200) for i in range(100)], "doc_id long, text string")
    pieces = site.pieces_of(spark, docs, key="doc_id", text="text")
    files = Q._dealt(pieces, str(tmp_path / "pieces"), 3)
    assert files == 34
    written = spark.read.parquet(str(tmp_path / "pieces"))
    assert len(written.inputFiles()) > 50
    assert sorted(map(tuple, written.collect())) == sorted(map(tuple, pieces.collect()))
