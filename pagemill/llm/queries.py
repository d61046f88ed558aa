"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import ann, collocations, fingerprints, langid, licenses, mainhtml, mixing, packing, pii, quality, repeats, sharding, simhash


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(_read(spark, sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(_read(spark, sf_dir, "documents")))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_documents(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a directory per source and thousand ids, another per hundred; every fiftieth id is its
    thousand's license file."""
    i = F.col("doc_id")
    top = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.floor(i / 1000))
    path = F.when(i % 50 == 0, F.concat(top, F.lit("/LICENSE."), i)).otherwise(F.concat(top, F.lit("/"), F.floor(i / 100), F.lit("/"), i, F.lit(".txt")))
    return licenses.scan(_read(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path")))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(_read(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.extract_pages(_read(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return packing.pack(docs, mixing.word_count(), packing.copies_cluster())


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return repeats.digest(repeats.collapse_repeats(repeats.repeated_on_purpose(docs)))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


def op13_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_personal_data": op2_personal_data,
    "op3_sharding": op3_sharding,
    "op4_license_scan": op4_license_scan,
    "op5_source_mix": op5_source_mix,
    "op6_nearest_vectors": op6_nearest_vectors,
    "op7_language_id": op7_language_id,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_main_text": op9_main_text,
    "op10_packing": op10_packing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_collocations": op12_collocations,
    "op13_quality_score": op13_quality_score,
}

ORACLE_SQL: dict[str, str] = {"op5_source_mix": mixing.ORACLE_SQL, "op12_collocations": collocations.ORACLE_SQL}
