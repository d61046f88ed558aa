"""Operators against brute force on small tables."""

import hashlib
import math
import random
import re
import textwrap
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pagemill.llm import ann, fingerprints, langid, licenses, mainhtml, mixing, packing, pii, sharding, simhash

from .conftest import awkward_rows

ROWS = awkward_rows()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


# -- 1: fingerprints


def shingles(text):
    w = words(text)
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])


def jaccard(a, b):
    if not a and not b:
        return 1.0
    return sum((a & b).values()) / sum((a | b).values())


def test_edited_texts_and_likeness(awkward):
    rows = fingerprints.compare_edited(awkward.dropDuplicates(["doc_id"])).collect()
    got = {r.doc_id: r for r in rows}
    order = sorted({r[0]: r[1] or "" for r in ROWS}.items(), reverse=True)
    assert len(rows) == len(order)
    errors, same = [], defaultdict(set)
    for i, (doc, text) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + nxt[:cut]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        same[text].add(r.fingerprint)
        if edited == text:
            assert r.near_edited == 1.0
        if not words(text) and not words(nxt):
            assert r.near_next == 1.0
        errors.append(r.near_edited - jaccard(shingles(text), shingles(edited)))
    assert all(len(v) == 1 for v in same.values())
    assert abs(np.mean(errors)) < 0.05 and np.sqrt(np.mean(np.square(errors))) < 0.15


def test_cut_after_a_line_break(spark):
    docs = spark.createDataFrame([(2, "aaa\nbb"), (1, "bb")], "doc_id bigint, text string")
    got = {r.doc_id: r.near_edited for r in fingerprints.compare_edited(docs).collect()}
    assert got[2] == 1.0


def edits(rows):
    """(doc_id, text, edited text) by the definition, plainly."""
    order = sorted(rows, key=lambda r: -r[0])
    for i, (doc, text) in enumerate(order):
        cut = len(text or "") // 3
        yield doc, text or "", (text or "")[: len(text or "") - cut] + (order[(i + 1) % len(order)][1] or "")[:cut]


def check_edits(spark, docs, rows):
    edited = list(edits(rows))
    texts = spark.createDataFrame([(doc, after) for doc, _, after in edited], "doc_id bigint, text string")
    got = {r.doc_id: r for r in fingerprints.compare_edited(docs).collect()}
    for side, found in (("fingerprint", fingerprints.fingerprints(docs)), ("edited_fingerprint", fingerprints.fingerprints(texts))):
        want = {r.doc_id: r.fingerprint for r in found.collect()}
        assert {i: got[i][side] for i in want} == want and len(want) == len(got)
    assert all(got[doc].edited_sha256 == hashlib.sha256(after.encode()).hexdigest() for doc, _, after in edited)


def test_edited_fingerprint_is_that_of_the_edited_text(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    check_edits(spark, docs, [tuple(r) for r in docs.collect()])


def test_edits_cut_at_every_separator(spark):
    rows, rng = [], random.Random(9)
    for sep in [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\r\n", "\x1c", "\x1f", "\x85", "\xa0", "\u2028", "\u2029", "."]:
        for n in (2, 7, 30):
            text = " ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(n))
            keep = text[: len(text) * 2 // 3] + sep
            # the part kept ends with the separator, and with it and a letter
            rows += [(len(rows), keep + "x" * (len(keep) // 2)), (len(rows) + 1, keep[:-1] + "w" + sep + "x" * (len(keep) // 2))]
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "a")]
    check_edits(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), rows)


def test_null_ids_are_spread_and_all_there(spark):
    docs = spark.createDataFrame([(None if i % 3 else i, f"text number {i % 40} of some") for i in range(400)], "doc_id bigint, text string")
    ordered, _ = fingerprints.in_order(docs, 16)
    assert ordered.where("doc_id is null").select("bucket").distinct().count() > 5
    got = fingerprints.compare_edited(docs).collect()
    assert len(got) == 400 and sum(r.doc_id is None for r in got) == 266


def test_collision_rate_is_weighted_jaccard(spark):
    base = [f"w{i}" for i in range(60)]
    a = " ".join(w for i, w in enumerate(base) for _ in range(1 + i % 4))
    b = " ".join(w for i, w in enumerate(base[20:] + [f"v{i}" for i in range(20)]) for _ in range(1 + (i * 7) % 5))
    found = fingerprints.fingerprints(spark.createDataFrame([(1, a), (2, b)], "doc_id bigint, text string"), 480)
    x, y = (r.fingerprint for r in found.orderBy("doc_id").collect())
    rate = np.mean([x[i : i + 6] == y[i : i + 6] for i in range(0, len(x), 6)])
    assert abs(rate - jaccard(shingles(a), shingles(b))) < 0.07


def test_weights_count(spark):
    """Samples of weighted terms collide as often as min over max of the weights."""
    n = 4000
    terms = spark.range(n).selectExpr("id as doc", "xxhash64(id) as term", "3L as a", "5L as b")
    got = fingerprints.samples_of(terms, ["doc"], {"x": "a", "y": "b"}, 2).collect()
    rate = np.mean([(p & fingerprints.TAG) == (q & fingerprints.TAG) for r in got for p, q in zip(r.x, r.y, strict=True)])
    assert abs(rate - 3 / 5) < 0.03


def test_fingerprints_of_nothing(empty):
    assert fingerprints.compare_edited(empty).count() == 0


# -- 2: personal data

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and plain_luhn(d or "1"), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_spans_match_the_plain_patterns():
    rng = random.Random(5)
    parts = ["a@b.c", "x.y%z@mail-1.example.com", "@", ".", "1.2.3.4", "255.256.1.1", "00012.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "12", " ", "-", "é", "😀", "a.b", "@c.d", "1.2.3", "\n", "+44 20 7946 0958", "5"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        got = [(s["kind"], s["start"], s["stop"]) for s in pii.find_spans(text) if s["kind"] in pii.BASE]
        assert got == base_spans(text), text


def test_method_spans_and_redaction(spark, awkward, empty):
    text = "iban DE89 3704 0044 0532 0130 00 and DE88 3704 0044 0532 0130 00, phone 555-123-4567, order 555-123-4568 of parts"
    kinds = [s["kind"] for s in pii.find_spans(text)]
    assert kinds.count("iban") == 1 and "local_phone" in kinds
    assert not any(s["kind"] == "local_phone" for s in pii.find_spans("phone order 555-123-4567"))
    assert [s["score"] for s in pii.find_spans("release 1.2.3.4 of it")] == [0.4] and [s["score"] for s in pii.find_spans("the host 1.2.3.4 is")] == [1.0]
    assert pii.find_spans("n 078-05-1120 x") == [] and pii.find_spans("his ssn 078-05-1120")[0]["kind"] == "national_id"
    assert pii.redact("mail a@b.co now") == "mail [EMAIL] now" and pii.redact(None) is None
    rows = pii.digest(pii.find_personal_data(awkward)).collect()
    assert len(rows) == len(ROWS) and all(r.n_email == 0 for r in rows)
    assert pii.digest(pii.find_personal_data(empty)).count() == 0
    out = pii.redact_documents(awkward)
    assert out.columns == awkward.columns and out.count() == len(ROWS)
    assert len(pii.find_spans("9" * 300_000)) == 0 and len(pii.find_spans("a" * 300_000 + "@")) == 0


def test_iban_before_a_word_in_capitals():
    for iban, after in (("ES91 2100 0418 4502 0005 1332", " EUR"), ("BE71 0961 2345 6769", " BIC"), ("BE71 0961 2345 6769", " CODE 12"), ("DE89 3704 0044 0532 0130 00", " x")):
        assert [(s["kind"], s["start"], s["stop"]) for s in pii.find_spans("to " + iban + after) if s["kind"] == "iban"] == [("iban", 3, 3 + len(iban))]
        assert pii.redact(iban + after) == "[IBAN]" + after


# -- 3: shards


def test_sharding(spark, awkward, empty):
    rows = sharding.shard_documents(awkward, 5).collect()
    assert len(rows) == len(ROWS)
    text_of = {r[0]: r[1] or "" for r in ROWS}
    slots, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        data = text_of[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(data) + 8, zlib.crc32(data))
        slots[r.shard].append(r.slot)
        groups[text_of[r.doc_id]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(g) == 1 for g in groups.values())
    assert sharding.shard_documents(empty).count() == 0


def test_differencing_balances_in_levels(spark):
    rng = random.Random(2)
    weights = [rng.randint(10, 4000) for _ in range(5000)] + [400_000]
    groups = spark.createDataFrame([(i, -i, w) for i, w in enumerate(weights)], "a bigint, b bigint, w bigint")
    for last in (10_000, 3200):
        sums = Counter()
        for r in sharding.shard_groups(groups, 24, block=500, last=last).collect():
            sums[r.shard] += weights[r.a]
        rest = sorted(sums.values())[:-1] if max(sums.values()) > sum(weights) / 24 * 1.01 else sorted(sums.values())
        assert sum(sums.values()) == sum(weights) and rest[-1] - rest[0] <= 40


# -- 4: licenses


def test_licenses(spark, empty):
    files = [
        (1, "a/LICENSE", "x\nReleased under the MIT License."), (2, "a/b/c.txt", "some words here"), (3, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (4, "a/b/d/e.txt", None), (5, "z.txt", ""), (6, "a/q.txt", "long words and more\nThis work is licensed under the GNU General Public License, version 3.\nend"), (7, None, "nothing"), (8, "ab/x.txt", "the license is good and fine for all of us here today"),
    ]
    docs = spark.createDataFrame(files, "doc_id bigint, path string, text string")
    got = {r.doc_id: (r.license, r.origin, r.licensed_by) for r in licenses.scan(docs).collect()}
    assert got[1] == ("MIT", "own", "a/LICENSE") and got[2] == ("Apache-2.0", "inherited", "a/b/LICENSE")
    assert got[4] == ("Apache-2.0", "inherited", "a/b/LICENSE") and got[6][:2] == ("GPL-3.0", "own")
    assert all(got[i] == (None, "none", None) for i in (5, 7, 8))
    assert licenses.scan(docs.limit(0)).count() == 0


def test_license_scores_match_brute_force(spark):
    texts = [(i, "\n".join(random.Random(i).choice(["the MIT License", "Licensed under CC BY 4.0.", "under the license of all rights", "all rights reserved.", "of the and a b c", "License version 2.0 the Apache under"]) for _ in range(3))) for i in range(30)]
    got = {r.doc: (r.license, r.score) for r in licenses.own_licenses(spark.createDataFrame(texts, "doc_id bigint, text string"), threshold=0.5).collect()}
    split = lambda s: Counter(re.findall(licenses.WORD, s.lower()))
    vectors = [(n, split(w)) for n, w in licenses.TEMPLATES]
    vocabulary = set().union(*(v for _, v in vectors))
    lines = [split(line) for _, t in texts for line in t.split("\n")]
    idf = {t: math.log((1 + len(lines)) / (1 + sum(t in x for x in lines))) + 1 for t in vocabulary}
    unseen = math.log((1 + len(lines)) / 2) + 1
    weigh = lambda v: {t: n * idf.get(t, unseen) for t, n in v.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for i, text in texts:
        best = []
        for line in text.split("\n"):
            x = weigh(split(line))
            for name, v in vectors:
                y = weigh(v)
                best.append((-round(sum(w * y.get(t, 0) for t, w in x.items()) / norm(x) / norm(y), 9), name))
        score, name = min(best)
        if -score >= 0.5 + 1e-8:
            assert got[i][0] == name and abs(got[i][1] + score) < 1e-8
        elif -score < 0.5 - 1e-8:
            assert i not in got


def test_wrapped_licenses(spark):
    bsd2 = """Copyright (c) 2020, A Holder
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
    bsd3 = bsd2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
    gpl2 = """/*
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 */
int main;"""
    files = [(1, "a/LICENSE", bsd3), (2, "b/LICENSE", bsd2), (3, "c/x.c", gpl2), (4, "d/LICENSE", "Mine.\nAll rights reserved."), (5, "a/y.c", "words"), *((i, f"e/{i}", "plain words of no license\nat all in the text") for i in range(10, 200))]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(files, "doc_id bigint, path string, text string")).collect()}
    assert [got[i] for i in range(1, 6)] == ["BSD-3-Clause", "BSD-2-Clause", "GPL-2.0", "Proprietary", "BSD-3-Clause"] and got[10] is None


def test_headers_and_whole_files_are_near_their_texts(spark):
    text = dict(licenses.TEXTS)
    wrap = lambda s, mark, width: "\n".join(mark + line for para in s.split("\n") for line in [*textwrap.wrap(para, width), ""])
    files = [(i, f"d{i}/{'LICENSE' if i % 2 else 'x.py'}", (f"The {name} license\n\nCopyright 2020 A Holder\n\n" + wrap(t, "", 70)) if i % 2 else wrap(t, "# ", 60) + "\n\nimport os\n") for j, (name, t) in enumerate(text.items()) for i in (2 * j + 1, 2 * j + 2)]
    rng = random.Random(3)
    files += [(i, f"e/{i}", "\n".join(" ".join(rng.choice(["some", "plain", "words", "of", "the", "software", "notice", "use", "and"]) for _ in range(9)) for _ in range(6))) for i in range(100, 300)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(files, "doc_id bigint, path string, text string")).collect()}
    for j, name in enumerate(text):
        for i in (2 * j + 1, 2 * j + 2):
            assert got[i].license == name and got[i].score > 0.85, (name, i, got[i])
    assert all(got[i].license is None for i in range(100, 300))


def test_license_scan_of_awkward_rows(spark, awkward):
    """Repeated rows, ties, null paths, a crowded directory, very long text and clashing columns."""
    more = [(None, "Released under the MIT License.", "q/x"), (900, "Released under the MIT License.", "q/LICENSE"), (901, "Licensed under CC BY 4.0.", "q/LICENSE"), (902, "x", "q/r/s/t"), (902, "x", "q/r/s/t"), (903, None, None)]
    docs = awkward.withColumn("path", F.lit("p/f")).withColumn("license", F.lit("clash")).withColumn("dir", F.lit(1)).withColumn("n", F.lit(1))
    given = spark.createDataFrame(more, "doc_id bigint, text string, path string")
    files = docs.unionByName(given, allowMissingColumns=True)
    rows = licenses.scan(files).collect()
    assert len(rows) == len(ROWS) + len(more)
    by = [r for r in rows if r.path.startswith("q/")]
    # of two license files at one path the higher score counts, then the license that sorts first
    assert [(r.license, r.origin) for r in by if r.doc_id == 902] == [("CC-BY-4.0", "inherited")] * 2 or [(r.license, r.origin) for r in by if r.doc_id == 902] == [("MIT", "inherited")] * 2
    assert [(r.origin) for r in by if r.doc_id is None] == ["inherited"]
    assert all(r.license is None and r.origin == "none" for r in rows if r.path in ("p/f", ""))


# -- 5: mixing


def test_mixing(spark, awkward, empty):
    rows = mixing.mix(awkward).collect()
    again = mixing.mix(awkward.repartition(3)).collect()
    assert len(rows) == len(ROWS) and sorted(map(str, rows)) == sorted(map(str, again))
    size_of = defaultdict(int)
    for r in ROWS:
        size_of[r[3]] += len(words(r[1]))
    taken, target = Counter(), {}
    sources = {r[0]: r[3] for r in ROWS}
    for r in rows:
        assert r.taken in (0, r["size"], 2 * r["size"]) and r.source_size == size_of[sources[r.doc_id]]
        taken[sources[r.doc_id]] += r.taken
        target[sources[r.doc_id]] = r.target
    assert abs(sum(target.values()) - 1.5 * sum(size_of.values())) < 1e-6
    assert all(target[s] <= 2 * size_of[s] + 1e-9 for s in target)
    biggest = max(len(words(r[1])) for r in ROWS)
    assert all(abs(taken[s] - target[s]) <= biggest for s in target)
    mixed = mixing.mixed_documents(awkward)
    assert mixed.columns == awkward.columns and sum(len(words(r.text)) for r in mixed.collect()) == sum(taken.values())
    assert mixing.mix(empty).count() == 0


# -- 6: vectors


def test_vector_search(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(1500, 20)).astype(np.float32)
    vectors[100:400] = vectors[100]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(5000, None), (5050, []), (5100, [0.0] * 20), (5150, [float("nan")] * 20), (5200, [None] + [1.0] * 19), (5250, [1.0] * 3), (5300, [float("inf")] * 20)]
    df = spark.createDataFrame([*rows, rows[50]], "vec_id bigint, embedding array<float>")
    got = ann.nearest(df, F.col("vec_id") % 50 == 0, shard=400).collect()
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    by, hits = defaultdict(list), 0
    for r in got:
        by[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(by) == set(range(0, 1500, 50))
    for q, found in by.items():
        s = unit @ unit[q]
        s[q] = -9
        best = np.lexsort((np.arange(1500), -np.round(s, 12)))[:5]
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and all(abs(s[i] - x) < 1e-9 for _, i, x in found)
        hits += len({f[1] for f in found} & set(best.tolist()))
    assert hits / (5 * len(by)) >= 0.9
    assert [f[1] for f in by[100]] == [101, 102, 103, 104, 105]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.nearest(df.where("vec_id in (0, 3)"), F.col("vec_id") % 50 == 0).count() == 1


def test_shards_hold_neighbouring_lists_and_split_crowded_ones():
    coarse = np.random.default_rng(5).normal(size=(40, 6)).astype(np.float32)
    sizes = {i: (1000 if i == 7 else 30 + i) for i in range(40) if i != 3}
    placed = ann.shards_of(coarse, sizes, 200)
    held = defaultdict(int)
    for one, (first, parts) in placed.items():
        for shard in range(first, first + parts):
            held[shard] += sizes[one] / parts
    assert set(placed) == set(sizes) and placed[7][1] == 5 and max(held.values()) <= 200
    assert sorted(held) == list(range(len(held))) and len(held) < len(sizes) / 1.5


def test_search_takes_clashing_columns(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6)], 1, "x", 2.0) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, shard int, list string, score double")
    assert ann.nearest(df, F.col("vec_id") % 50 == 0).count() == 15


def test_lists_stay_below_the_sample(spark):
    vectors = np.random.default_rng(1).normal(size=(4096, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id bigint, vector array<double>")
    index = ann.fit(df, 4096, sample=64)
    assert 32 <= len(index.coarse) <= 4096 // 32 and index.books.any()


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(4000, 16)).astype(np.float32)
    vectors[1000:2000] = vectors[1000] + 0.003 * rng.normal(size=(1000, 16))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")
    found = defaultdict(set)
    for r in ann.nearest(df, F.col("vec_id").between(1000, 1999) & (F.col("vec_id") % 50 == 0)).collect():
        found[r.query_id].add(r.vec_id)
    unit = vectors.astype(np.float64) / np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
    hits = sum(len(found[q] & set(np.argsort(-np.where(np.arange(4000) == q, -9, unit @ unit[q]), kind="stable")[:5].tolist())) for q in range(1000, 2000, 50))
    assert hits / 100 >= 0.95


# -- 7: languages


def test_language_id(spark, awkward, empty, sf):
    rows = langid.identify_languages(awkward).collect()
    assert len(rows) == len(ROWS)
    info = {r[0]: r for r in ROWS}
    for r in rows:
        _, text, lang, *_ = info[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in text or ""):
            assert r.lang_pred == "und"
        elif lang and len(text) > 20:
            assert r.lang_pred == lang
    assert langid.identify_languages(empty).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = dict(docs.select("doc_id", "lang").collect())
    held = [r for r in langid.identify_languages(docs).collect() if r.held_out]
    assert np.mean([r.lang_pred == want[r.doc_id] for r in held]) > 0.97


def test_grams_do_not_depend_on_parts(monkeypatch):
    rng = random.Random(8)
    for text in ["".join(rng.choice("ab é.ÇΣ1\n") for _ in range(n)) for n in (0, 1, 5, 40, 200)]:
        whole = sorted(x for part in langid.grams(text) for x in part.tolist())
        symbols = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        while "  " in symbols:
            symbols = symbols.replace("  ", " ")
        plain = sum(" " not in symbols[i + 1 : i + n - 1] for n in langid.ORDERS for i in range(len(symbols) - n + 1))
        assert len(whole) == plain
        for size in (1, 2, 3, 7):
            monkeypatch.setattr(langid, "CHUNK", size)
            assert sorted(x for part in langid.grams(text) for x in part.tolist()) == whole
        monkeypatch.undo()


def test_rows_without_ids_are_sampled_one_by_one(spark):
    docs = spark.createDataFrame([(None, f"word{'s' * (i % 30)} number {i}", "aa") for i in range(900)], "doc_id bigint, text string, lang string")
    assert langid.fit(docs, F.lit(True), max_docs=100).languages == ("aa",)


def test_predictions_are_plain_counts():
    """Counts by sets of n-grams: the filter may only add false positives, which the correction takes off on average."""
    rng = random.Random(12)
    vocab = {"aa": ["the", "thing", "other", "with"], "bb": ["le", "quelle", "dans", "leur"]}
    train = {lang: " ".join(rng.choice(w) for _ in range(400)) for lang, w in vocab.items()}
    sets = {lang: {x for part in langid.grams(t) for x in part.tolist()} for lang, t in train.items()}
    model = langid.build_filter([(lang, np.uint64(x).astype(np.int64).item()) for lang, s in sets.items() for x in s])
    for text in ("the other thing", "quelle leur", "the le dans", "zzz the"):
        found = [x for part in langid.grams(text) for x in part.tolist()]
        plain = {lang: sum(x in s for x in found) / len(found) for lang, s in sets.items()}
        lang, score = model.predict(text)
        assert lang == max(sorted(plain), key=plain.get) and abs(score - plain[lang]) < 0.05


def test_bit_sliced_filter_returns_all_languages():
    pairs = [(f"l{i % 70:02}", h) for i, h in enumerate(np.random.default_rng(1).integers(-(2**62), 2**62, 7000).tolist())]
    model = langid.build_filter(pairs)
    for lang, h in pairs[:500]:
        bit = model.languages.index(lang)
        places = list(model.places(np.array([h], dtype=np.int64).view(np.uint64)))
        assert all(model.words[bit // 64][p[0]] >> np.uint64(bit % 64) & np.uint64(1) for p in places)
    assert model.false_rate.max() < 0.05


# -- 8: near duplicates


def plain_simhash(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius):
    ids, seen, out = sorted(fps), set(), {}
    for start in ids:
        if start in seen:
            continue
        group, todo = [], [start]
        seen.add(start)
        while todo:
            x = todo.pop()
            group.append(x)
            near = [y for y in ids if y not in seen and (fps[x] ^ fps[y]).bit_count() <= radius]
            seen.update(near)
            todo += near
        out |= dict.fromkeys(group, min(group))
    return out


def test_simhash_groups(awkward, empty):
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(awkward).collect()}
    fps = {r[0]: plain_simhash(r[1]) for r in ROWS}
    parts = plain_components(fps, 2)
    assert got == {i: (fps[i], parts[i]) for i in fps}
    kept = simhash.first_of_group(awkward)
    assert kept.columns == awkward.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(parts.values()))
    assert simhash.near_duplicates(empty).count() == 0


def test_groups_without_ids_keep_a_row(spark):
    far = "a quite different text about rivers and boats"
    rows = [(None, "some words of a text"), (None, "some words of a text"), (None, far), (4, far), (5, None), (6, "one more text"), (6, "another text under the same id")]
    kept = simhash.first_of_group(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(((r.doc_id or 0, r.text or "") for r in kept.collect())) == sorted([(0, "some words of a text"), (4, far), (5, ""), (6, "one more text"), (6, "another text under the same id")])


def test_vantage_point_links_are_exact(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(700)]
    for _ in range(500):
        x = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(1, 3)):
            x ^= 1 << b
        fps.append(x)
    centre = rng.getrandbits(64)
    fps = list({*fps, *(centre ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a))})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    for leaf, block in ((64, 4096), (40, 50)):
        roots = {r.node: r.root for r in simhash.components(simhash.links(df, 2, sample=256, leaf=leaf, block=block)).collect()}
        got = defaultdict(set)
        for x in signed:
            got[roots.get(x, x)].add(x)
        want = defaultdict(set)
        for i, root in plain_components(dict(enumerate(fps)), 2).items():
            want[root].add(signed[i])
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


# -- 9: main text


def test_marginals_are_exact_on_small_trees():
    model = mainhtml.train(mainhtml.labelled_pages(60))
    page = mainhtml.parse("<body><nav><a href=x>y</a></nav><div class=content><p>Some words, here.<p>More</div><div class=ad>z</div>")
    n = len(page.parent)
    chance = lambda k, y: 1 / (1 + math.exp(-model.edge.get(k, model.edge["box"])[y]))
    total, on = 0.0, [0.0] * n
    root = 1 / (1 + math.exp(-model.root))
    told = mainhtml.bounded(page, [sum(model.cue.get(x, 0) for x in c) for c in page.cues])
    for state in range(2**n):
        y = [state >> i & 1 for i in range(n)]
        p = 0.0
        for above, share in ((0, 1 - root), (1, root)):
            q = share
            for i in range(n):
                up = y[page.parent[i]] if page.parent[i] >= 0 else above
                c = chance(page.kind[i], up)
                q *= (c if y[i] else 1 - c) * (math.exp(told[i]) if y[i] else 1)
            p += q
        total += p
        for i in range(n):
            on[i] += p * y[i]
    assert np.allclose([x / total for x in on], model.marginals(page), atol=1e-6)


def test_main_text(spark, sf):
    model = mainhtml.train(mainhtml.labelled_pages())
    wrong = n = 0
    for source in mainhtml.labelled_pages(120, seed=7):
        page = mainhtml.parse(source)
        for text, label, m in zip(page.text, page.label, model.marginals(page), strict=True):
            if text is not None:
                n, wrong = n + 1, wrong + ((m >= 0.5) != label)
    assert wrong / n < 0.03
    for row in mainhtml.extract_pages(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet"), "page_id").collect():
        import html

        article = re.search(r"<article>(.*?)(?:</article>|$)", row.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:h1|p)>", article)]
        assert row.text == "\n\n".join(b for b in blocks if b) and row.n_chars == len(row.text)
    odd = spark.createDataFrame([(1, "u", None, 0), (2, None, "", 0), (None, "u", "<article><p>a &amp; b  c</article>", 0), (4, "u", "<" * 5000, 0), (5, "u", "<p " * 3000, 0)], "page_id bigint, url string, html string, text int")
    got = {r.page_id: r.text for r in mainhtml.extract_pages(odd).collect()}
    assert got[1] == got[2] == "" and len(got) == 5
    assert mainhtml.extract_pages(odd.limit(0)).count() == 0


def test_whole_families_of_blocks_held_out():
    """Blocks of a kind that no training page has are told by links, headings and place."""
    for family in ("nav", "sidebar", "form", "meta", "aside", "unnamed"):
        model = mainhtml.train(mainhtml.labelled_pages(400, families=[f for f in mainhtml.FAMILIES if f != family]))
        wrong = n = 0
        for source in mainhtml.labelled_pages(60, seed=5, families=[family]):
            page = mainhtml.parse(source)
            for text, label, m in zip(page.text, page.label, model.marginals(page), strict=True):
                if text is not None:
                    n, wrong = n + 1, wrong + ((m >= 0.5) != label)
        assert wrong / n < 0.12, family


def test_blocks_without_telling_names():
    article = "<article><h1>The old mill by the river</h1><p>The mill was built long ago, and it still turns on quiet days.</p><p>Many people came to see it every summer.</p></article>"
    want = "The old mill by the river\n\nThe mill was built long ago, and it still turns on quiet days.\n\nMany people came to see it every summer."
    model = mainhtml.train(mainhtml.labelled_pages())
    for block in (
        "<div hidden><p>This is the text that nobody should ever see.</p></div>", '<div style="display: none">Nor this text, which is hidden too.</div>',
        '<div id="disqus_thread"><p>I liked this story very much!</p><p>Me too, it was good.</p></div>', "<div><h3>3 Comments</h3><p><b>anna</b> I liked this story very much!</p><p><b>ben</b> Me too.</p></div>",
        '<div class="xq7z">Copyright 2024 The Company. All rights reserved.</div>', "<svg><title>Icon of a mill</title><text>drawn words</text></svg><video src=x>No video here.</video>",
        '<div role="contentinfo">Call us at the office.</div>', "<!-->", "<!---><!-- a --!>", "<!-- never ended <p>words",
    ):
        assert model.main_text(f"<body>{article}{block}</body>") == want, block
        if block != "<!-- never ended <p>words":
            assert model.main_text(f"<body>{block}{article}</body>") == want, block
    inner = "<article><h1>T of it</h1><p>Some words are here <svg><text>no</text></svg>and more follow.</p></article>"
    assert model.main_text(inner) == "T of it\n\nSome words are here and more follow."


PROSE = "The old mill by the river was built long ago, and it still turns on quiet days. Many people came to see it every summer."
AROUND = "<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/a>A</a></li><li><a href=/b>B</a></li></ul></nav>{}<footer>&copy; 2020 Site. All rights reserved.</footer></body></html>"
SHAPES = [
    (f"<p>{PROSE}</p><p>{PROSE} Two.</p>", f"{PROSE}\n\n{PROSE} Two."),
    (f"<p>{PROSE}</p>", PROSE),
    (f"<div><div><p>{PROSE}</p></div><div>{PROSE} Two.</div></div>", f"{PROSE}\n\n{PROSE} Two."),
    (
        f"<main><h1>Head</h1><p>{PROSE}</p><h2>Related work</h2><p>{PROSE} Two.</p><p>Subscribe</p><p><a href=/x>See also</a></p></main>",
        f"Head\n\n{PROSE}\n\nRelated work\n\n{PROSE} Two.\n\nSubscribe\n\nSee also",
    ),
    ("<article><p>Water is wet</p><sub>H2O</sub><pre>x = 1</pre></article>", "Water is wet\n\nH2O\n\nx = 1"),
    (f"<article><p>{PROSE}</p><dl><dt>Key</dt><dd>Value here</dd></dl></article>", f"{PROSE}\n\nKey\n\nValue here"),
    ("<article><dl><dt>Key</dt><dd>Value here</dd></dl></article>", "Key\n\nValue here"),
    (f"<article><p>{PROSE}</p><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li><li><a href=/3>Three</a></li></ul></article>", f"{PROSE}\n\nOne\n\nTwo\n\nThree"),
]


def test_articles_of_many_shapes(spark):
    pages = spark.createDataFrame([(i, "u", AROUND.format(inner)) for i, (inner, _) in enumerate(SHAPES)] * 2, "page_id int, url string, html string")
    rows = mainhtml.extract_pages(pages).collect()
    assert len(rows) == 2 * len(SHAPES) and {(r.page_id, r.text) for r in rows} == {(i, text) for i, (_, text) in enumerate(SHAPES)}


def test_held_out_articles():
    model = mainhtml.train(mainhtml.labelled_pages())
    wrong = n = 0
    for source in mainhtml.labelled_pages(300, seed=99):
        page = mainhtml.parse(source)
        for text, label, m in zip(page.text, page.label, model.marginals(page), strict=True):
            if text is not None:
                n, wrong = n + 1, wrong + ((m >= 0.5) != label)
    assert wrong / n < 0.03
    # what holds prose is never empty
    for source in (f"<div>{PROSE}</div>", f"<section><b>{PROSE}</b></section>", f"<table><tr><td>{PROSE}</td></tr></table>", f"<center>{PROSE}</center>", PROSE):
        assert model.main_text(source) == PROSE


def test_very_long_pages():
    model = mainhtml.train(mainhtml.labelled_pages(200))
    began = time.time()
    for piece in ('<a "', '<a b="', "<a b=' ", "<!--", "<", "</", "<p>x", "<div>", "&"):
        mainhtml.parse(piece * (300_000 // len(piece)))
    long = model.main_text("<article>" + f"<p>{PROSE}</p>" * 5000 + "</article>")
    assert long == "\n\n".join([PROSE] * 5000)
    assert time.time() - began < 60


# -- 10: packing


def test_repeated_lines_do_not_outvote_an_article():
    model = mainhtml.train(mainhtml.labelled_pages())
    page = "<body><nav><a href=/a>one</a></nav><article><h1>A title of some words.</h1>" + "<p>By To." * 300 + "<p>The last words of it.</article><footer>&copy; us</footer>"
    assert model.main_text(page) == "\n\n".join(["A title of some words.", *["By To."] * 300, "The last words of it."])


def test_packing(awkward, empty):
    rows = packing.pack(awkward, mixing.word_count(), packing.copies_cluster(), capacity=100, max_per_source=3, block=30).collect()
    source, text, copies = {r[0]: r[3] for r in ROWS}, {r[0]: r[1] for r in ROWS}, Counter(r[0] for r in ROWS)
    bins, per_doc = defaultdict(list), Counter()
    for r in rows:
        per_doc[r.doc_id] += r.n_words
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
        else:
            assert r.n_words == 0
    assert all(per_doc[i] == copies[i] * len(words(text[i])) for i in copies)
    for packed in bins.values():
        packed.sort(key=lambda r: r.bin_start)
        at = 0
        for r in packed:
            assert r.bin_start == at
            at += r.n_words
        assert at <= 100
        tails = [r for r in packed if r.n_words < 100]
        assert max(Counter(source[r.doc_id] for r in tails).values(), default=0) <= 3
        assert max(Counter(" ".join(words(text[r.doc_id])).lower() for r in tails).values(), default=0) <= 1
    assert packing.pack(empty, mixing.word_count(), packing.copies_cluster()).count() == 0


def test_ids_beside_nulls_stay_whole(spark):
    big = [2**53 + 1, 2**60 + 3, -(2**62) - 1]
    docs = spark.createDataFrame([(i, "one two", "s") for i in [*big, None, 0]], "doc_id bigint, text string, source string")
    got = packing.pack(docs, mixing.word_count(), packing.copies_cluster(), block=100).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i in [*big, None, 0])


def test_placements_equal_plain_best_fit():
    """Every placement against a search through all open bins: least residual, then the bin that came to it first."""
    rng = random.Random(6)
    for most, capacity in ((1, 50), (3, 100)):
        bins, plain, clock = packing._Bins(capacity, most), [], 0
        sizes = sorted((rng.randint(1, capacity) for _ in range(400)), reverse=True)
        for size in sizes if most == 1 else rng.sample(sizes, len(sizes)):
            source, cluster = 1 << rng.randrange(5), rng.choice([0, 0, 1, 2, 4])
            fits = [(b["left"], b["since"], i) for i, b in enumerate(plain) if b["left"] >= size and b["sources"][source] < most and not b["clusters"] & cluster]
            clock += 1
            if fits:
                i = min(fits)[2]
            else:
                i = len(plain)
                plain.append({"left": capacity, "since": 0, "sources": Counter(), "clusters": 0})
            at = capacity - plain[i]["left"]
            plain[i]["left"] -= size
            plain[i]["since"] = clock
            plain[i]["sources"][source] += 1
            plain[i]["clusters"] |= cluster
            assert bins.place(size, source, cluster) == (i, at)


def test_best_fit_takes_the_tightest_compatible_bin():
    bins = packing._Bins(10, 2)
    assert bins.place(7, 1, 0) == (0, 0) and bins.place(6, 1, 4) == (1, 0)
    assert bins.place(3, 2, 4) == (0, 7)
    assert bins.place(4, 2, 4) == (2, 0) and bins.place(4, 2, 0) == (1, 6)
