"""Whole jobs: pages to Markdown with a site index, and streamed pages converted batch by batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.functions import url as U
from pagemill.operators import convert, corpus, links, markup, selectors
from pagemill.operators.progress import Progress
from pagemill.streaming import documents, sections


def site(pages: DataFrame, site_name: str = "Site", origin: str = "", strip: bool = True, progress: Progress | None = None) -> tuple[DataFrame, DataFrame]:
    """Markdown of the first page of each address (page_id, url, title, file, markdown), and the lines of its index.

    ``progress`` counts the pages that are kept, their characters, and those without a title as the first result is written.
    """
    first = links.first_by_url(pages)
    md = convert.for_all(first, convert.to_markdown(convert.minimal(markup.tokens(first))))
    if strip:
        md = corpus.boilerplate(md, "page_id", "markdown")
    about = links.metadata(first).select("page_id", "title", "description")
    rows = first.select("page_id", "url", U.safe_filename(F.col("url")).alias("file")).join(md, "page_id").join(about, "page_id")
    kept = rows.where(F.length(F.trim(T.body_of(F.col("markdown")))) > 10)
    watched = progress.watch(kept, "pages", characters=F.sum(F.length("markdown")), untitled=F.count_if(F.col("title").isNull())) if progress else kept
    index = corpus.llms_lines(kept.select(F.col("page_id").alias("ord"), "title", "url", "description"), site_name, origin=origin)
    return watched, index


def _each_batch(stream: DataFrame, make, out: str, checkpoint: str):
    """Starts a query that writes ``make`` of each batch into a folder of its own: a batch that is run again replaces it.

    A batch is kept while it is written: ``make`` may read it several times, and its state would be computed each time.
    """

    def write(batch: DataFrame, nth: int) -> None:
        batch.persist()
        try:
            make(batch).write.mode("overwrite").parquet(f"{out}/batch={nth}")
        finally:
            batch.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def stream_to_markdown(stream: DataFrame, out: str, checkpoint: str):
    """Starts a query that converts each finished document of a stream of pieces (text or bytes): page_id, markdown, batch."""

    def converted(batch: DataFrame) -> DataFrame:
        pages = batch.withColumnRenamed("key", "page_id")
        return convert.for_all(pages, convert.to_markdown(markup.tokens(pages)))

    in_bytes = stream.schema["chunk"].dataType.typeName() == "binary"
    return _each_batch(documents.assemble_bytes(stream) if in_bytes else documents.assemble(stream), converted, out, checkpoint)


def stream_to_deltas(stream: DataFrame, out: str, checkpoint: str):
    """Starts a query that converts the finished parts of each document of a stream of pieces as they come: page_id, nth, delta, batch.

    ``join_deltas`` gives the texts so far; a document's state is only its last, unfinished block.
    """

    def converted(batch: DataFrame) -> DataFrame:
        parts = batch.select(F.struct("key", "nth").alias("part"), "html")
        md = convert.to_markdown(markup.tokens(parts, "part"), key="part")
        return md.where("markdown <> ''").select(F.col("part.key").alias("page_id"), F.col("part.nth").alias("nth"), F.col("markdown").alias("delta"))

    return _each_batch(documents.fragments(stream), converted, out, checkpoint)


def join_deltas(deltas: DataFrame) -> DataFrame:
    """page_id and markdown: the deltas of each document in order, parted by empty lines."""
    parts = F.array_sort(F.collect_list(F.struct("nth", "delta")))
    return deltas.groupBy("page_id").agg(F.array_join(F.transform(parts, lambda x: x["delta"]), "\n\n").alias("markdown"))


def stream_to_chunks(stream: DataFrame, out: str, checkpoint: str, size: int = 1000, overlap: int = 200, unit: str = "bytes"):
    """Starts a query that cuts Markdown documents of a stream of pieces into chunks as their sections are finished: the columns of ``corpus.chunks``, batch."""
    return _each_batch(sections.sections(stream), lambda batch: corpus.chunks(batch, size, overlap, unit), out, checkpoint)


def stream_to_elements(stream: DataFrame, chosen: Sequence[str], out: str, checkpoint: str):
    """Starts a query that extracts the elements that selectors choose from each finished document of a stream of pieces."""
    return _each_batch(documents.assemble(stream), lambda batch: selectors.extract(markup.tokens(batch, "key"), chosen), out, checkpoint)


def stream_to_index(pages: DataFrame, out: str, checkpoint: str, origin: str = ""):
    """Starts a query that gathers the index lines and full texts of a stream of pages: ord, line, toc, block, batch.

    ``pages``: ord, title, url, description, content. ``close_index`` puts them in order when the stream has ended.
    """

    def gathered(batch: DataFrame) -> DataFrame:
        return corpus.llms_entries(batch, origin)

    return _each_batch(pages, gathered, out, checkpoint)


def close_index(spark: SparkSession, out: str, site_name: str = "Site", description: str = "", origin: str = "") -> tuple[DataFrame, DataFrame]:
    """The lines (ord, line) of the index and of the full text that ``stream_to_index`` gathered, sorted range by range."""
    rows = spark.read.parquet(out)
    index = corpus.index_lines(rows.select("ord", "line"), site_name, description, origin)
    return index, corpus.full_lines(rows.select("ord", "toc", "block"), site_name, description, origin)


def pieces_of(spark: SparkSession, pages: DataFrame, size: int = 1000, in_bytes: bool = False, key: str = "page_id", text: str = "html") -> DataFrame:
    """Pages (or other texts) cut into pieces (key, seq, chunk, is_last) of text or bytes, as a stream would deliver them."""
    html = F.encode(text, "UTF-8") if in_bytes else F.col(text)
    n = F.greatest(F.coalesce(F.ceil(F.length(html) / size), F.lit(1)), F.lit(1)).cast("int")
    rows = pages.select(F.col(key).alias("key"), html.alias("html"), n.alias("n")).select("key", "html", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("seq"))
    return rows.select("key", "seq", F.substring("html", F.col("seq") * size + 1, F.lit(size)).alias("chunk"), (F.col("seq") == F.col("n") - 1).alias("is_last"))
