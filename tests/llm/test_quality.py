"""Quality scores against densities computed plainly, and held-out accuracy."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from pagemill.llm import quality
from pagemill.llm import queries as Q

from ..conftest import SF


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int, text string")


def test_statistics_of_a_small_text():
    got = dict(zip(quality.STATISTICS, quality.statistics("Ab cd. AB\ncd. 1#\tcd.".encode()), strict=True))
    # words: Ab cd. AB cd. 1# cd. ; shown characters: 6 words of 2, 3, 2, 3, 2, 3
    odds = lambda a, n: np.log((a + 0.5) / (n - a + 0.5))
    assert np.isclose(got["log_bytes"], np.log1p(20)) and np.isclose(got["log_words"], np.log1p(6))
    assert np.isclose(got["word_length"], np.log1p(15 / 6))
    assert np.isclose(got["upper"], odds(3, 10)) and np.isclose(got["digits"], odds(1, 15)) and np.isclose(got["symbols"], odds(1, 15))
    assert np.isclose(got["distinct_words"], odds(4, 6)) and np.isclose(got["distinct_pairs"], odds(5, 5)) and np.isclose(got["distinct_lines"], odds(2, 2))
    assert np.isclose(got["capitalised"], odds(2, 6)) and np.isclose(got["words_by_line"], np.log1p(3))


def test_scores_equal_the_plain_densities():
    rng = np.random.default_rng(3)
    d = len(quality.STATISTICS)
    mix = rng.normal(size=(d, d))
    x = {0: rng.normal(size=(300, d)) @ mix + 1.5, 1: rng.normal(size=(700, d)) * 2}
    model = quality.fit_moments({c: (float(len(v)), v.sum(axis=0), v.T @ v) for c, v in x.items()})
    probe = rng.normal(size=(50, d)) * 3
    # the same by explicit inverses and determinants
    both = np.concatenate([x[0], x[1]])
    centred = [v - v.mean(axis=0) for v in (x[0], x[1])]
    pooled = sum(c.T @ c for c in centred) / len(both)
    scale = np.sqrt(np.diag(pooled))
    logs = []
    for c in (0, 1):
        n = len(x[c])
        own = n / (n + quality.EVEN_ROWS)
        cov = quality.shrunk((own * centred[c].T @ centred[c] / n + (1 - own) * pooled) / np.outer(scale, scale), n)
        far = (probe - x[c].mean(axis=0)) / scale
        logs.append(np.log(n / len(both)) - 0.5 * np.einsum("ij,jk,ik->i", far, np.linalg.inv(cov), far) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.scores(probe), 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))))


def test_shrinkage_stays_positive():
    assert np.linalg.eigvalsh(quality.shrunk(np.zeros((4, 4)), 10)).min() > 0
    one = np.outer([1.0, 2, 3, 4], [1.0, 2, 3, 4])
    assert np.linalg.eigvalsh(quality.shrunk(one, 1000)).min() > 0


def test_held_out_accuracy(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    out = Q.op13_quality_score(spark, sf)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in rows.items())
    told = [(r.quality, rows[r.doc_id]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(q, r) for q, r in told if r.held_out]
    assert np.mean([q == r.predicted for q, r in held]) > 0.97
    good = [r.score for q, r in held if q == 1]
    bad = [r.score for q, r in held if q == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.99


def test_held_out_labels_are_never_learned(spark, awkward):
    out = quality.held_out()
    told = awkward.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), out.alias("held")).distinct()
    turned = told.withColumn("quality", F.when(F.col("held"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r.doc_id, r.score) for r in quality.score_documents(awkward, t).collect()) for t in (told, turned))
    assert a == b and len(a) == awkward.count()


def test_awkward_rows_and_labels(spark, awkward, empty):
    rows = awkward.unionByName(awkward.limit(3).withColumn("doc_id", F.lit(None).cast("bigint")))
    told = labels_of(spark, [(i, i % 2, 0, "clash") for i in range(60)] + [(3, None, 1, "x"), (4, 7, 1, "x"), (None, 1, 0, "x"), (999, 0, 0, "x"), (5, 1, 0, "x"), (5, 1, 0, "x")])
    got = quality.score_documents(rows, told)
    assert got.count() == rows.count()
    by_id = {}
    for r in got.collect():
        by_id.setdefault(r.doc_id, set()).add((r.held_out, r.score, r.predicted))
    assert all(len(v) == 1 for k, v in by_id.items() if k is not None)
    assert not any(h for h, _, _ in by_id[None])
    assert quality.score_documents(empty, told).count() == 0
    # one class only, or no labels: no model
    for none in (told.where("quality = 1"), told.limit(0)):
        assert {(r.score, r.predicted) for r in quality.score_documents(awkward, none).collect()} == {(0.5, 1)}


def test_one_label_an_id(spark):
    rows = [(1, 0, 0, ""), (1, 1, 0, ""), (2, 0, 0, ""), (2, 0, 0, ""), (2, 1, 0, ""), (3, None, 0, ""), (None, 1, 0, "")]
    assert {(r.doc_id, r.label) for r in quality.one_label(labels_of(spark, rows)).collect()} == {(1, 1), (2, 0)}
