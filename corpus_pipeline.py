"""A training-corpus pipeline: language ID, near-dedup, PII redaction, source mixing, packing; Parquet between stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import langid, mixing, packing, pii, simhash
from pagemill.llm._common import kept

#: A document goes only if no language is found in it, or fewer than this share of its n-grams in the best one.
LEAST_SCORE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a learned language.

    Null, empty, blank and letterless texts go, and all rows where no row is labelled. Repeated rows stay or go alike, very
    long texts are read whole; null ids and sources play no part. An empty table stays empty.
    """
    model = langid.fit(docs.select("doc_id", "text", "lang"), ~langid.held_out())
    return langid.of_known_language(docs, model, LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each group of fingerprints linked at 2 or fewer differing bits.

    Only almost equal texts are such: README says why links of a similarity of 0.8 are not taken. Null, empty and wordless
    texts are one group. Of repeated rows one stays; of rows that share an id, that of the least
    text hash; null ids come last, so that a group of such rows keeps one. An empty table stays empty.
    """
    return simhash.first_of_group(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind; every row stays.

    Null texts stay null with n_chars 0, empty ones empty; repeated rows are redacted alike, very long texts whole. An
    empty table stays empty.
    """
    return pii.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it.

    Null, empty and wordless texts have no words and are not taken; the null source is a source of its own. Repeated rows
    and rows without an id are taken one by one, ties in the queue fall by hash. An empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their bins.

    Null, empty and wordless texts give one row without a bin; very long texts fill whole bins. Repeated rows are packed
    one by one, as copies into different bins, rows without an id too. An empty table gives no rows.
    """
    return packing.pack(docs, mixing.word_count(), packing.copies_cluster())


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mix_sources", mix_sources),
    ("packing", pack_documents),
]

#: SQL has neither the trained filter nor the greedy packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written in the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
