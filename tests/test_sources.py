"""Pages at their paths, fetch logs with attempts."""

import os
from datetime import datetime, timedelta

import pytest

from pagemill.sources import files


def test_pages_at_their_paths(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = [("a/b.md", "# A\n\né"), ("index.md", None), ("a/c/d.md", "x"), (None, "gone"), ("../../up.md", "kept inside"), ("a/b.md", "# A\n\né"), ("./e.md", "e")]
    pages = spark.createDataFrame(rows, "file string, markdown string").repartition(3)
    for _ in range(2):  # a rerun writes the same files again
        files.write_pages(pages, folder)
        found = {os.path.relpath(os.path.join(at, f), folder): open(os.path.join(at, f), encoding="utf-8").read() for at, _, names in os.walk(folder) for f in names}
        assert found == {"a/b.md": "# A\n\né", "index.md": "", "a/c/d.md": "x", "up.md": "kept inside", "e.md": "e", "_SUCCESS": "5"}
    files.write_pages(spark.createDataFrame([("a/b.md", "new")], pages.schema), folder)
    assert open(f"{folder}/a/b.md").read() == "new" and open(f"{folder}/a/c/d.md").read() == "x"


def test_many_pages(spark, tmp_path):
    pages = spark.range(500).selectExpr("concat('p', id % 10, '/', id, '.md') AS file", "repeat('x ', 100) AS markdown").repartition(8)
    files.write_pages(pages, f"file://{tmp_path}/m")
    assert sum(len([f for f in names if f.endswith(".md")]) for _, _, names in os.walk(tmp_path / "m")) == 500
    assert (tmp_path / "m" / "_SUCCESS").read_text() == "500"


START = datetime(2024, 1, 1, 0, 59, 58)


@pytest.fixture
def log(spark):
    second = lambda n: START + timedelta(seconds=n)
    rows = [
        ("https://a.b/1", second(0), 503, None), ("https://a.b/1", second(1), 429, "7"), ("https://a.b/1", second(9), 500, None), ("https://a.b/1", second(20), 200, None),
        ("https://a.b/2", second(3), 404, None), ("https://a.b/3", second(5), None, None), ("https://c.d/1", second(0), 429, None), ("https://c.d/1", second(2), 429, "soon"), ("https://c.d/2", second(1), 429, "0"),
    ]
    return spark.createDataFrame(rows, "url string, at timestamp, status int, retry_after string")


def test_attempts(log):
    got = {(r.url[8:], int((r.at - START).total_seconds())): (r.attempt, r.final, r.host_delay, r.next_try and (r.next_try - r.at).total_seconds()) for r in files.attempts(log).collect()}
    assert got == {
        ("a.b/1", 0): (1, False, 0, 0.5), ("a.b/1", 1): (2, False, 7, 7.0), ("a.b/1", 9): (3, True, 7, None), ("a.b/1", 20): (1, True, 7, None),
        ("a.b/2", 3): (1, True, 7, None), ("a.b/3", 5): (1, False, 7, 7.0), ("c.d/1", 0): (1, False, 2, 2.0), ("c.d/1", 2): (2, False, 2, 2.0), ("c.d/2", 1): (1, False, 2, 2.0),
    }


def test_next_tries(log):
    got = {r.host: (r.tries, r.asks, r.host_delay, (r.next_try - START).total_seconds()) for r in files.next_tries(files.attempts(log)).collect()}
    assert got == {"a.b": (6, 3, 7, 12.0), "c.d": (3, 0, 2, 3.0)}
    assert files.attempts(log.limit(0)).count() == 0
