"""The pipeline's stages, one after another, on an awkward table."""

import corpus_pipeline
from pagemill.llm import queries

from .conftest import SCHEMA, awkward_rows
from .test_operators import plain_components, plain_simhash


def test_stages_keep_clean_documents(spark, tmp_path):
    rows = awkward_rows()
    rows[10] = (*rows[10][:1], rows[10][1] + " mail me at someone@example.com", *rows[10][2:])
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
        if name == "language_id":
            gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in kept.collect()}
            assert gone == {r[0] for r in rows if sum(c.isalpha() for c in r[1] or "") == 0} | {64}
        if name == "near_dedup":
            parts = plain_components({r.doc_id: plain_simhash(r.text) for r in before.collect()}, 2)
            assert sorted(r.doc_id for r in kept.collect()) == sorted(set(parts.values()))
        if name == "personal_data":
            assert kept.where("text like '%someone@%'").count() == 0 and kept.count() == before.count()
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in final.collect()} == {r.doc_id for r in kept.collect()}


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")] and docs.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered_names():
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and all(name in entry.queries() for name in queries.QUERIES)
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
