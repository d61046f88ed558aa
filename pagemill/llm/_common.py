"""Helpers shared by the operators: tables kept in the cluster's shared folder and bucketed prefix sums."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_KEPT: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary folder only where that is unset on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="pagemill-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again: it cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagemill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _KEPT:
        atexit.register(_drop_kept)
    _KEPT.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _drop_kept() -> None:
    for spark, path in _KEPT:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may be gone at exit
            return


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def uniform_bucket(h: Column, n: int) -> Column:
    """Bucket 0 to n-1 that follows the order of a uniform 64-bit hash, so that buckets are contiguous ranges of it."""
    return F.least(F.lit(n - 1), F.floor((h.cast("double") / F.lit(2.0**64) + 0.5) * n).cast("int"))


def search_bucket(x: Column, bounds: list) -> Column:
    """How many of the ascending ``bounds`` are below ``x``: a binary search in one expression."""
    if not bounds:
        return F.lit(0)
    n = len(bounds)
    steps = [1 << k for k in range(int(math.log2(n)), -1, -1)]
    array = F.array(*[F.lit(b) for b in bounds]) if n <= 64 else F.from_json(F.lit(str(bounds)), "array<bigint>")
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: F.when((at + s <= n) & (F.get(array, at + s - 1) < x), at + s).otherwise(at),
    )


#: A key with more than this share of the rows is joined by broadcast; there are fewer such keys than its inverse.
HOT = 1 / 1024


def hot_keys(counts: DataFrame, n: str, total: int) -> DataFrame:
    """The rows of ``counts`` (one a key) whose count ``n`` is above ``HOT`` of ``total``: less than 1 / HOT of them."""
    return counts.where(F.col(n) > max(1, int(total * HOT)))


def join_by_key(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (one row a key) on ``keys``; the few ``hot`` keys by broadcast, where they lie.

    So no key's rows are gathered in one task, however many it has. ``how`` is inner or left.
    """
    few = F.broadcast(hot.select(*keys))
    large = rows.join(F.broadcast(table.join(few, keys, "left_semi")), keys)
    if how == "left":
        # hot keys without a match are in neither part otherwise
        unmatched = hot.select(*keys).join(table.select(*keys), keys, "left_anti")
        few = F.broadcast(hot.select(*keys).join(F.broadcast(unmatched), keys, "left_anti"))
    small = rows.join(few, keys, "left_anti").join(table, keys, how)
    return large.unionByName(small)


def with_offsets(df: DataFrame, keys: list[str], bucket: str, value: Column, out: str) -> DataFrame:
    """One row per (keys, bucket) of ``df`` with the sum of ``value`` over the earlier buckets of the same keys.

    Rows are summed before the window, so it sees one row per bucket however many rows a key has.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("__sum"))
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, bucket, F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias(out))
