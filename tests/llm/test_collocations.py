"""Collocations against counts of plain Python, and against SQL."""

import random
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.llm import collocations as C
from pagemill.llm import queries as Q

LOWER = str.maketrans(C._UPPER, C._LOWER)


def plain(rows, least, top):
    """The same from the texts of (text, lang), counted one by one."""
    f, n = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cands.items():
            near = any(100 * b >= 80 * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cands.items())
            if not near:
                score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def some_texts(seed, n=300):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "delta", "é", "É", "of", "the", "x y", "🙂"]
    marks = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", "!", " ", " "]
    texts = []
    for i in range(n):
        t = "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(0, 40)))
        texts.append(((t + "new york city hall " * rng.randint(0, 3)) if i % 3 else "in the the the the end", rng.choice(["aa", "bb", None, "und"])))
    return [*texts, (None, "aa"), ("", "bb"), (" \t\n ", "cc"), ("...", "cc"), ("the " * 5000, "aa"), ("a" * 100_000, "bb")]


def run(spark, rows, **how):
    docs = spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], "doc_id bigint, text string, lang string, m string")
    out = C.collocations(docs, **how)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for _, t in out.dtypes} == {"string", "bigint"}
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize(("least", "top"), [(5, 2000), (30, 3)])
def test_small_texts(spark, least, top):
    rows = some_texts(1)
    got = run(spark, rows, least=least, top=top)
    assert got == plain(rows, least, top) and got


def test_results_do_not_depend_on_what_is_spread(spark, monkeypatch):
    rows = some_texts(2)
    want = plain(rows, 10, 2000)
    for share, block in ((1.0, 1 << 18), (0.0, 64)):
        # no pair spread, or every pair that is seen; large blocks, or very small ones
        monkeypatch.setattr(C, "HOT_SHARE", share)
        monkeypatch.setattr(C, "BLOCK", block)
        assert run(spark, rows, least=10) == want


def test_awkward_tables(spark, awkward, empty):
    rows = [(r.text, r.lang) for r in awkward.collect()]
    assert sorted(tuple(r) for r in C.collocations(awkward, least=20).collect()) == plain(rows, 20, C.TOP)
    assert C.collocations(empty).count() == 0
    assert C.collocations(awkward.withColumn("text", F.lit(None).cast("string"))).count() == 0


def test_counts_beyond_64_bits(spark):
    big = 1 << 62
    phrases = spark.createDataFrame([("x", 2, "a b", big), ("x", 1, "a", big + 2), ("x", 1, "b", big + 1), ("x", 3, "a b c", big - big // 4), ("x", 2, "b c", big), ("x", 1, "c", big)], "lang string, n int, phrase string, a bigint")
    got = {r.phrase: r for r in C.scored(phrases).collect()}
    assert got["a b"].score == 2_000_000 * big // (2 * big + 3)
    assert (got["a b c"].l, got["a b c"].r, got["a b c"].score) == (big + 2, big, 2_000_000 * (big - big // 4) // (2 * big + 2))
    left = {r.phrase for r in C.undominated(phrases.where("n > 1")).collect()}
    assert left == {"a b", "b c", "a b c"}  # three quarters are less than 80 of 100


def test_packed_windows_hold_every_place():
    rows = pa.table({"lang": ["x", "y", "x"], "piece": ["a b c d e", "a", "a b a b"], "m": pa.array([2, 5, 3], pa.int64())})
    got = Counter()
    for batch in C.packed_windows(rows, [("x", "a", "b")], 7, 3):
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("rows").to_pylist(), strict=True):
            assert 0 <= bucket < 7
            for r in C.unpacked(pa.py_buffer(blob)).to_pylist():
                got[r["lang"], tuple(r[w] for w in C._WORDS), r["hot"]] += r["m"]
    want = {
        ("x", ("a", "b", "c", "d"), True): 2, ("x", ("b", "c", "d", "e"), False): 2, ("x", ("c", "d", "e", None), False): 2, ("x", ("d", "e", None, None), False): 2,
        ("x", ("a", "b", "a", "b"), True): 3, ("x", ("b", "a", "b", None), False): 3, ("x", ("a", "b", None, None), True): 3,
        ("y", ("a", None, None, None), False): 5, ("x", ("a", None, None, None), False): 8, ("x", ("b", None, None, None), False): 8,
        ("x", ("c", None, None, None), False): 2, ("x", ("d", None, None, None), False): 2, ("x", ("e", None, None, None), False): 2,
    }
    assert got == want


def test_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    want = con.sql(Q.ORACLE_SQL["op12_collocations"])
    rows = Q.op12_collocations(spark, sf)
    assert rows.columns == want.columns
    assert sorted(tuple(r) for r in rows.collect()) == sorted(want.fetchall())


def test_hashes_of_many_words_take_little_room():
    """Beside a session's JVM an executor has little room for a block's words."""
    words = pa.array([f"word{i}" for i in range(200_000)])
    tracemalloc.start()
    found = C._hashes(words)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 5_000_000
    assert found[0] == 0 and found[1:4].tolist() == [(zlib.crc32(w) << 32 | zlib.adler32(w)) + 1 for w in (b"word0", b"word1", b"word2")]
