"""Readers of HTML and Markdown files, and writers of converted pages and site indexes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from pagemill.functions import url as U


def read_html(spark: SparkSession, glob: str, base: str = "") -> DataFrame:
    """path, url and html of each file once; ``base`` is the folder that addresses are relative to.

    Files that are not valid UTF-8 come with html null and valid false.
    """
    rows = spark.read.format("binaryFile").load(glob).select("path", "content").dropDuplicates(["path"])
    inner = F.regexp_replace("path", "^[a-z]+:/*", "/")
    relative = F.when(inner.startswith(base), F.substr(inner, F.lit(len(base) + 1))).otherwise(inner) if base else inner
    valid = F.is_valid_utf8("content")
    return rows.select("path", U.file_to_url(relative).alias("url"), F.when(valid, F.decode("content", "UTF-8")).alias("html"), valid.alias("valid"))


class PageFiles(DataSource):
    """Writes rows (file, markdown) as files at exactly these paths below a folder: ``df.write.format("page_files").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def schema(self) -> str:
        return "file string, markdown string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _PageWriter(self.options["path"])


@dataclass
class _Written(WriterCommitMessage):
    files: int


class _PageWriter(DataSourceWriter):
    """Each task writes its files under other names and then moves each to its own: a file is whole or not there.

    A task that runs again, or twice at once, writes the same files again.
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, iterator: Iterator) -> _Written:
        fs, root = FileSystem.from_uri(self.folder) if "://" in self.folder else FileSystem.from_uri(f"file://{self.folder}")
        made, n = set(), 0
        for row in iterator:
            name = _inside(row.file)
            at = f"{root.rstrip('/')}/{name}"
            folder, _, last = at.rpartition("/")
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            part = f"{folder}/.{last}.{uuid.uuid4().hex}"
            with fs.open_output_stream(part) as out:
                out.write((row.markdown or "").encode())
            fs.move(part, at)
            n += 1
        return _Written(n)

    def commit(self, messages: list) -> None:
        fs, root = FileSystem.from_uri(self.folder) if "://" in self.folder else FileSystem.from_uri(f"file://{self.folder}")
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root.rstrip('/')}/_SUCCESS") as out:
            out.write(str(sum(m.files for m in messages if m)).encode())

    def abort(self, messages: list) -> None:
        """Files that are whole stay; the next run writes them again. Without ``_SUCCESS`` the folder is not finished."""


def _inside(name: str) -> str:
    """A relative path without empty, ``.`` and ``..`` parts: nothing is written outside the folder."""
    return "/".join(p for p in name.split("/") if p not in ("", ".", ".."))


def write_pages(pages: DataFrame, folder: str) -> None:
    """Writes (file, markdown) as text files below ``folder``, each at its own path, and ``_SUCCESS`` with their number.

    The folder must be one that all executors reach. Of rows with one path that of the least text hash is written; rows without a path are not.
    """
    pages.sparkSession.dataSource.register(PageFiles)
    one = pages.where("file is not null").groupBy("file").agg(F.min_by("markdown", F.xxhash64("markdown")).alias("markdown"))
    one.write.format("page_files").mode("append").save(folder)


def write_lines(lines: DataFrame, folder: str) -> None:
    """Writes (ord, line) in order: range-partitioned parts whose names sort like their lines."""
    lines.orderBy("ord").select(F.col("line").alias("value")).write.mode("overwrite").text(folder)


def fetched(urls: DataFrame, log: DataFrame) -> DataFrame:
    """The pages of ``log`` (url, html, content_type, status) that ``urls`` ask for: HTML and Markdown answers only."""
    ok = F.col("status").between(200, 299) & F.lower("content_type").rlike(r"^(text/html|application/xhtml\+xml|text/markdown)")
    return log.where(ok).join(urls.select("url").distinct(), "url", "left_semi")


# Answers after which an address is tried again.
RETRIED = (408, 409, 425, 429, 500, 502, 503, 504)
#: Tries after the first, and the least time between two.
RETRIES, PAUSE_MS = 2, 500


def attempts(log: DataFrame, order: Sequence[str] = ("at",), retries: int = RETRIES, pause_ms: int = PAUSE_MS) -> DataFrame:
    """``log`` (url, at, status, retry_after) with host, attempt, final, host_delay and next_try.

    Tries of an address follow each other until one is answered for good or ``retries`` more have failed; ``attempt`` counts them
    from 1 and ``final`` marks the last. A null status is no answer. After 429 a host wants the seconds of its Retry-After header
    between two tries (1 for one that is no number, 2 without one); ``host_delay`` is the most that it has wanted so far. ``next_try``
    is when the address may be tried again, null after a final try. ``order`` must order the log fully.
    """
    again = F.col("status").isNull() | F.col("status").isin(*RETRIED)
    digits = F.regexp_extract("retry_after", r"^\s*([0-9]{1,9})", 1)
    seconds = F.when(digits.try_cast("bigint") > 0, digits.try_cast("bigint")).otherwise(1)
    asked = F.when(F.col("status") == 429, F.when(F.col("retry_after").isNull(), 2).otherwise(seconds))
    rows = log.withColumns({"host": U.host_of(F.col("url")), "again": again, "asked": asked, "hour": F.date_trunc("hour", order[0])})
    # the most of earlier hours is taken from one row an hour, so that a host with most of the log is spread over its hours
    hours = rows.groupBy("host", "hour").agg(F.max("asked").alias("most"))
    before = F.max("most").over(Window.partitionBy("host").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1))
    hours = hours.select(F.col("host").alias("h"), F.col("hour").alias("of"), before.alias("earlier"))
    rows = rows.join(hours, (F.col("host") == F.col("h")) & F.col("hour").eqNullSafe(F.col("of"))).drop("h", "of")
    in_hour = Window.partitionBy("host", "hour").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("host_delay", F.coalesce(F.greatest("earlier", F.max("asked").over(in_hour)), F.lit(0)).cast("bigint"))
    by_url = Window.partitionBy("url").orderBy(*order)
    done = F.coalesce(F.sum((~F.col("again")).cast("int")).over(by_url.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("part", done)
    nth = (F.row_number().over(Window.partitionBy("url", "part").orderBy(*order)) - 1) % (retries + 1)
    rows = rows.withColumn("attempt", (nth + 1).cast("int"))
    rows = rows.withColumn("final", ~F.col("again") | (F.col("attempt") > retries))
    wait = F.greatest(F.lit(pause_ms), F.col("host_delay") * 1000)
    at = F.when(~F.col("final"), F.timestamp_micros(F.unix_micros(F.col(order[0]).cast("timestamp")) + wait * 1000).cast(log.schema[order[0]].dataType))
    return rows.withColumn("next_try", at).drop("again", "asked", "hour", "earlier", "part")


def next_tries(tried: DataFrame, order: Sequence[str] = ("at",)) -> DataFrame:
    """host, tries, asks, host_delay and next_try of each host of ``tried`` (``attempts``): the earliest time at which an address waits to be tried again."""
    last = F.lead("url").over(Window.partitionBy("url").orderBy(*order)).isNull()
    rows = tried.withColumn("waits", F.when(last, F.col("next_try")))
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("tries"), F.count_if("final").alias("asks"), F.max("host_delay").alias("host_delay"), F.min("waits").alias("next_try"))
