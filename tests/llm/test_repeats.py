"""Periodic runs against a search of every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from pagemill.llm import queries as Q
from pagemill.llm import repeats

from ..conftest import SF
from .conftest import awkward_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, periods=4, least=6):
    """Every period, shortest first: stretches in which words so far apart are equal, unless a shorter period has them."""
    ids = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    out = []
    for q in range(1, len(words) // periods + 1):
        other = np.flatnonzero(np.concatenate([[True], x[q:] != x[:-q], [True]]))
        for s, e in zip(other[:-1], other[1:], strict=True):
            start, length = int(s), int(e - s - 1 + q)
            if e - s > 1 and length >= max(least, periods * q) and not any(q % p == 0 and a <= start and start + length <= a + n for a, n, p in out):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def edited(words, doc):
    n, h = len(words), zlib.crc32(str(doc).encode())
    g = h // 10
    if doc is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def expected(doc, text):
    words = edited(WORD.findall(text or ""), doc)
    found = plain_runs(words)
    best = None
    for r in found:
        if best is None or Fraction(r[1], r[2]) > Fraction(best[1], best[2]):
            best = r
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    hashes = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, left)]
    return (doc, len(found), *(best or (None,) * 3), best[1] * 1000 // best[2] if best else None, *hashes)


def as_rows(found):
    return [tuple(r) for r in found.tolist()]


def some_words(rng):
    n, k = rng.randint(0, 60), rng.randint(1, 4)
    words = [rng.choice("abcd"[:k]) for _ in range(n)]
    if n > 3 and rng.random() < 0.6:
        a, p = rng.randint(0, n - 1), rng.randint(1, max(1, n // 4))
        words = words[:a] + [words[min(a + (i - a) % p, n - 1)] for i in range(a, n)]
    return [w.encode() for w in words]


def test_runs_of_one_document_at_a_time():
    rng = random.Random(7)
    for _ in range(1500):
        words = some_words(rng)
        assert as_rows(repeats.long_runs([words])[0]) == plain_runs(words)


def test_documents_that_share_a_tree_do_not_mix():
    rng = random.Random(8)
    docs = [some_words(rng) for _ in range(300)]
    assert [as_rows(r) for r in repeats.long_runs(docs)] == [plain_runs(d) for d in docs]


def test_all_runs_of_two_periods_and_more():
    rng = random.Random(9)
    for _ in range(800):
        words = some_words(rng)
        if words:
            start, length, period = repeats.runs_of(np.unique(words, return_inverse=True)[1])
            assert sorted(zip(start.tolist(), period.tolist(), length.tolist(), strict=True)) == sorted((s, q, n) for s, n, q in plain_runs(words, 2, 2))


def test_fibonacci_words_have_runs_but_no_long_ones():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 600:
        a, b = b, b + a
    start, length, period = repeats.runs_of(np.unique(b, return_inverse=True)[1])
    assert sorted(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == sorted(plain_runs(b, 2, 2))
    assert as_rows(repeats.long_runs([b])[0]) == []


def test_very_long_texts_of_few_words():
    assert as_rows(repeats.long_runs([[b"x"] * 150_000])[0]) == [(0, 150_000, 1)]
    words = ([b"p%d" % i for i in range(5_000)] * 5)[:24_000]
    assert as_rows(repeats.long_runs([words])[0]) == [(0, 24_000, 5_000)]


def test_collapsed_keeps_one_period_of_each_run():
    words = "u a b a b a b a b v w w w w w w w".encode().split()
    assert repeats.collapsed(words, repeats.long_runs([words])[0]) == b"u a b v w"
    # of five words alike none is a run: six are asked for
    assert repeats.collapsed([b"w"] * 5, repeats.long_runs([[b"w"] * 5])[0]) == b"w w w w w"


def test_awkward_rows(spark, awkward, empty):
    rows = awkward.unionByName(awkward.limit(2).withColumn("doc_id", F.lit(None).cast("bigint"))).select("doc_id", "text", "n_chars")
    got = sorted((tuple(r) for r in repeats.digest(repeats.collapse_repeats(repeats.repeated_on_purpose(rows))).collect()), key=repr)
    texts = [(r[0], r[1]) for r in awkward_rows()]
    texts += [(None, r.text) for r in rows.where("doc_id is null").collect()]
    assert got == sorted((expected(*t) for t in texts), key=repr)
    assert repeats.digest(repeats.collapse_repeats(repeats.repeated_on_purpose(empty))).count() == 0


def test_real_outputs(spark):
    docs = spark.createDataFrame([(1, "q  a b\ta b\na b a b"), (2, None), (3, "one two")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in repeats.collapse_repeats(docs).collect()}
    assert (got[1].n_words, [tuple(r) for r in got[1].runs], got[1].collapsed) == (9, [(1, 8, 2)], "q a b")
    assert (got[2].n_words, got[2].runs, got[2].collapsed) == (0, [], "")
    assert (got[3].n_words, got[3].runs, got[3].collapsed) == (2, [], "one two")


def test_query_on_the_whole_table(spark, sf):
    rows = Q.op11_periodic_runs(spark, sf)
    assert rows.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {tuple(r) for r in rows.collect()}
    assert got == {expected(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sum(r[1] > 0 for r in got) > 5
