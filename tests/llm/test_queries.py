"""Each registered query on a whole table, against plain versions of what its rows must be."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagemill.llm import licenses
from pagemill.llm import queries as Q

from ..conftest import SF
from .test_operators import base_spans, plain_components, plain_simhash, words


@pytest.fixture(scope="module")
def docs(spark):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == 200
    return rows


def test_fingerprints(spark, docs):
    rows = {r.doc_id: r for r in Q.op1_fingerprints(spark, SF).collect()}
    order = sorted(docs, reverse=True)
    assert rows.keys() == docs.keys()
    for i, doc in enumerate(order):
        text, after = docs[doc].text, docs[order[(i + 1) % len(order)]].text
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert (rows[doc].n_chars, rows[doc].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
    by_text = defaultdict(set)
    for doc, r in rows.items():
        by_text[docs[doc].text].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in by_text.values())


def test_personal_data(spark, docs):
    kinds = ("email", "ip", "card", "phone")
    rows = Q.op2_personal_data(spark, SF).collect()
    assert {r.doc_id for r in rows} == docs.keys()
    for r in rows:
        spans = sorted(base_spans(docs[r.doc_id].text), key=lambda s: (kinds.index(s[0]), s[1]))
        told = [":".join(map(str, s)) for s in spans]
        count = Counter(s[0] for s in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(count[k] for k in kinds)
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert set(told) <= set(r.spans.split(",")) or not told


def test_sharding(spark, docs):
    rows = Q.op3_sharding(spark, SF).collect()
    assert {r.doc_id for r in rows} == docs.keys() and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    size, slots, of_text = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        raw = docs[r.doc_id].text.encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw)) and 0 <= r.shard < 24
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        of_text[raw].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of_text.values())
    largest = max(Counter(d.text for d in docs.values()).items(), key=lambda x: x[1] * len(x[0].encode()))
    assert max(size.values()) - min(size[s] for s in range(24)) <= max(len(d.text.encode()) for d in docs.values()) + largest[1] * len(largest[0].encode())


def test_license_scan(spark, docs):
    rows = Q.op4_license_scan(spark, SF).collect()
    assert {r.doc_id for r in rows} == docs.keys()
    by_path = {r.path: r for r in rows}
    for r in rows:
        top = f"{docs[r.doc_id].source or 'none'}/{r.doc_id // 1000}"
        assert r.path == (f"{top}/LICENSE.{r.doc_id}" if r.doc_id % 50 == 0 else f"{top}/{r.doc_id // 100}/{r.doc_id}.txt")
        assert (r.license is None) == (r.origin == "none") == (r.licensed_by is None)
        if r.origin == "own":
            assert r.licensed_by == r.path and r.score >= licenses.THRESHOLD
        if r.origin == "inherited":
            giver = by_path[r.licensed_by]
            assert giver.origin == "own" and giver.license == r.license and r.path.startswith(r.licensed_by.rpartition("/")[0] + "/")
    # a directory's own license file is never passed over
    given = {r.path.rpartition("/")[0] for r in rows if "/LICENSE." in r.path and r.origin == "own"}
    assert all(r.origin != "none" for r in rows for d in given if r.path.startswith(d + "/"))


def test_nearest_vectors(spark):
    vectors = {r.vec_id: np.array(r.embedding, dtype=float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = np.array(sorted(vectors))
    unit = np.stack([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
    rows = defaultdict(list)
    for r in Q.op6_nearest_vectors(spark, SF).orderBy("query_id", "rank").collect():
        rows[r.query_id].append(r)
    assert rows.keys() == {i for i in vectors if i % 50 == 0}
    met = 0
    for q, found in rows.items():
        score = unit @ (vectors[q] / np.linalg.norm(vectors[q]))
        best = [i for i in ids[np.lexsort((ids, -score))] if i != q][:5]
        met += len({r.vec_id for r in found} & set(best))
        assert [r.rank for r in found] == [1, 2, 3, 4, 5]
        assert all(np.isclose(r.score, score[np.searchsorted(ids, r.vec_id)]) for r in found)
    assert met / (5 * len(rows)) >= 0.9


def test_language_id(spark, docs):
    rows = Q.op7_language_id(spark, SF).collect()
    assert {r.doc_id for r in rows} == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out]
    assert np.mean(held) > 0.9


def test_simhash_dedup(spark, docs):
    prints = {i: plain_simhash(d.text) for i, d in docs.items()}
    roots = plain_components(prints, 2)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in Q.op8_simhash_dedup(spark, SF).collect()}
    assert got == {(i, f"{prints[i] & (1 << 64) - 1:016x}", roots[i]) for i in docs}


def test_main_text(spark):
    rows = Q.op9_main_text(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count() and all(r.n_chars == len(r.text) > 0 for r in rows)


def test_packing(spark, docs):
    total = Counter()
    for r in Q.op10_packing(spark, SF).collect():
        total[r.doc_id] += r.n_words
    assert total == {i: len(words(d.text)) for i, d in docs.items()}
