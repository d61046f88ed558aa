"""Operators over a whole corpus: boilerplate, site indexes, chunks."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.functions import url as U


def _written(rows: DataFrame) -> DataFrame:
    """The rows as a checkpoint, or persisted in sessions that have no folder for one."""
    spark = rows.sparkSession
    return rows.checkpoint() if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() else rows.persist()


#: Bytes of text whose shingles one task counts.
TASK_BYTES = 16 << 20


def _tasks(docs: DataFrame, text: str) -> int:
    """As many tasks as the session's shuffles have, more where each would count the shingles of more than ``TASK_BYTES``."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))


def _tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key and t: the tokens of every document that has any."""
    return docs.select(F.col(key), F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1)).alias("t"))


def shingles(docs: DataFrame, key: str, text: str, k: int = 6) -> DataFrame:
    """key, pos and shingle: every run of k tokens, or all tokens of a shorter document."""
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("t") - k, F.lit(0))), lambda i: F.array_join(F.slice("t", i + 1, k), " "))
    rows = _tokens(docs, key, text).select(key, F.posexplode_outer(F.when(F.size("t") > 0, runs)).alias("pos", "shingle"))
    return rows.where("shingle is not null")


def _window_hashes(rows: DataFrame, k: int, names: Sequence[str]) -> DataFrame:
    """``rows`` with arrays of hashes, one a token, made arrays of hashes of every k neighbours; of all, where there are fewer.

    Neighbours are hashed by twos, those by twos again, and so on: a few steps a window, each over whole arrays. Each step is a
    column of its own, as one expression would compute it again wherever it is used.
    """

    def paired(left: Column, right: Column, by: int) -> Column:
        return F.zip_with(left, F.slice(right, by + 1, F.greatest(F.size(right) - by, F.lit(0))), lambda x, y: F.xxhash64(x, y))

    size = 1
    while size * 2 <= k:
        rows = rows.withColumns({f"{n}_{size * 2}": paired(F.col(f"{n}_{size}"), F.col(f"{n}_{size}"), size) for n in names})
        size *= 2
    rows = rows.withColumns({f"{n}_all": F.col(f"{n}_{size}") for n in names})
    covered = size
    while size := size // 2:
        if k - covered >= size:
            rows = rows.withColumns({f"{n}_all": paired(F.col(f"{n}_all"), F.col(f"{n}_{size}"), covered) for n in names})
            covered += size
    whole = lambda n: F.when(F.size(f"{n}_1") >= k, F.slice(f"{n}_all", 1, F.greatest(F.size(f"{n}_1") - k + 1, F.lit(1)))).when(F.size(f"{n}_1") > 0, F.array(F.xxhash64(f"{n}_1")))
    return rows.withColumns({n: whole(n) for n in names})


def shingle_hashes(docs: DataFrame, key: str, text: str, k: int = 6) -> DataFrame:
    """key, pos, and two 64-bit hashes h and g of every shingle."""
    tokens = _tokens(docs, key, text).select(F.col(key), F.transform("t", lambda w: F.xxhash64(w)).alias("h_1"), F.transform("t", lambda w: F.xxhash64(F.lit(1), w)).alias("g_1"))
    hashed = _window_hashes(tokens, k, ("h", "g"))
    rows = hashed.select(key, F.posexplode_outer(F.arrays_zip("h", "g")).alias("pos", "x"))
    return rows.where("x is not null").select(key, "pos", "x.h", "x.g")


#: Rows are counted in parts if so many rows of an even part at least must hold what is sought.
LEAST_OF_PART = 4
#: Hashes that may be broadcast, of 8 bytes each.
MOST_BROADCAST = 1 << 20


def _often_seen(docs: DataFrame, key: str, text: str, k: int, least: int) -> DataFrame:
    """key, pos, h and g of the shingles whose h at least so many rows hold: of all that are frequent enough, and of few others.

    One hash a shingle and row is counted first. Second hashes and places are made only of those, which are joined by
    broadcast if they are few; for a share of all rows they are, whatever their number.

    Where the least number allows it, rows are counted in parts, each in one task, and hashes are not shuffled: what ``least`` of all
    rows hold, at least a like share of some part's rows holds.
    """
    parts = _tasks(docs, text)
    part = F.pmod(F.xxhash64(key, text), F.lit(parts)).cast("int").alias("part")
    in_parts = least >= LEAST_OF_PART * parts
    dealt = docs.select(key, text, part).repartitionById(parts, F.col("part")) if in_parts else docs.select(key, text, F.lit(0).alias("part"))
    tokens = dealt.select("part", F.transform(F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1)), lambda w: F.xxhash64(w)).alias("h_1"))
    rows = _window_hashes(tokens, k, ("h",)).select("part", F.explode_outer(F.array_distinct("h")).alias("h")).where("h is not null")
    counts = rows.groupBy("part", "h").agg(F.count(F.lit(1)).alias("n"))
    if in_parts:
        sizes = {r.part: r.n for r in docs.select(part).groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
        total = sum(sizes.values())
        enough = F.array(*[F.lit(-(-least * sizes.get(i, 0) // total)) for i in range(parts)])
        often = _written(counts.where(F.col("n") >= F.get(enough, F.col("part"))).select("h").distinct())
    else:
        often = _written(counts.where(F.col("n") >= least).select("h"))
    few = F.broadcast(often) if often.count() <= MOST_BROADCAST else often
    return _written(shingle_hashes(docs, key, text, k).join(few, "h", "left_semi").select(key, "pos", "h", "g"))


def shingle_frequency(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 6, least: int = 1) -> DataFrame:
    """shingle and n_docs, the number of documents that hold it, of all shingles in at least so many.

    Counted by hashes; only the first place of a shingle that is frequent enough is turned into words. Hashes are dealt once: what is
    told apart by a document, and then counted, lies in one task already. Half of the second hash goes with the place in one number.
    """
    low = F.lit((1 << 32) - 1)
    placed = F.shiftleft("g", 32).bitwiseOR(F.col("pos").cast("bigint")).alias("g_pos")
    dealt = shingle_hashes(docs, key, text, k).select("h", F.col(key).alias("doc"), placed).repartition(_tasks(docs, text), "h")
    once = dealt.groupBy("h", F.shiftright("g_pos", 32).alias("g"), "doc").agg(F.min("g_pos").bitwiseAND(low).cast("int").alias("pos"))
    counts = once.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("doc", "pos")).alias("at")).where(F.col("n_docs") >= least)
    places = counts.select(F.col("at.doc").alias("doc"), F.struct(F.col("at.pos").alias("pos"), "n_docs").alias("x")).groupBy("doc").agg(F.collect_list("x").alias("all"))
    rows = _tokens(docs, key, text).join(places, F.col(key).eqNullSafe(F.col("doc")))
    said = F.transform("all", lambda x: F.struct(F.array_join(F.slice("t", x["pos"] + 1, k), " ").alias("shingle"), x["n_docs"].alias("n_docs")))
    return rows.select(F.explode_outer(said).alias("x")).select("x.*")


def boilerplate(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5, min_docs: int = 3, k: int = 6, min_run: int = 12) -> DataFrame:
    """key and text without runs of tokens that repeat across documents.

    A token is covered if a shingle over it is in at least max(2, threshold x documents) of them; covered runs of
    min_run tokens or more go, survivors are joined by empty lines. Documents that would lose nothing or everything,
    and corpora of fewer than min_docs, stay as they are.
    """
    k = max(2, k)
    min_run = max(k, min_run)
    n = docs.count()
    if n < min_docs:
        return docs.select(key, text)
    least = max(2, -int(-(threshold * n) // 1))
    at = _often_seen(docs, key, text, k, least)
    common = at.select("h", "g", key).distinct().groupBy("h", "g").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= least).select("h", "g")
    hits = at.join(common, ["h", "g"], "left_semi").select(F.col(key).alias("doc"), "pos")
    # runs of places whose shingles touch or overlap, by gaps: [first token, token after the last)
    in_doc = Window.partitionBy("doc").orderBy("pos")
    hits = hits.withColumn("gap", F.coalesce(F.col("pos") - F.lag("pos").over(in_doc) > k, F.lit(True)))
    hits = hits.withColumn("run", F.sum(F.col("gap").cast("int")).over(in_doc))
    found = hits.groupBy("doc", "run").agg(F.min("pos").alias("a"), F.max("pos").alias("last"))
    found = found.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("a", "last"))).alias("found"))
    rows = docs.select(key, text).join(found, F.col(key).eqNullSafe(F.col("doc")), "left")
    # pieces: white space before a token and the token, so that positions and bytes survive
    pieces = F.regexp_extract_all(text, F.lit(r"(\s*\S+)"), F.lit(1))
    rows = rows.withColumn("pieces", F.when(F.col("found").isNotNull(), pieces))
    size = F.size("pieces")
    runs = F.transform("found", lambda r: F.struct(r["a"].alias("a"), F.least(r["last"] + k, size).alias("b")))
    rows = rows.withColumn("runs", F.filter(runs, lambda r: r["b"] - r["a"] >= min_run))
    starts = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["b"]))
    ends = F.concat(F.transform("runs", lambda r: r["a"]), F.array(size))
    kept = F.filter(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: x["e"] > x["s"])
    parts = F.transform(kept, lambda x: F.regexp_replace(F.array_join(F.slice("pieces", x["s"] + 1, x["e"] - x["s"]), ""), r"^\s+|\s+\z", ""))
    rows = rows.withColumn("parts", parts)
    out = F.when(F.col("runs").isNull() | (F.size("runs") == 0) | (F.size("parts") == 0), F.col(text)).otherwise(F.array_join("parts", "\n\n"))
    return rows.select(key, out.alias(text))


def sort_keys(pages: DataFrame, path: str = "path") -> DataFrame:
    """Adds group and segments, by which pages sort like a directory tree: ``orderBy(group <> '', group, segments)``.

    Two leading segments are a group if more than one page shares them, else the first; pages at the root without
    anything below are the first group.
    """
    rows = pages.withColumn("segments", U.segments(F.col(path)))
    first = F.coalesce(F.get("segments", 0), F.lit(""))
    rows = rows.withColumns({"seg1": first, "prefix2": U.group_prefix(F.col(path), 2)})
    rows = rows.withColumns({
        "n2": F.count(F.lit(1)).over(Window.partitionBy("prefix2")),
        "nested": F.max(F.size("segments")).over(Window.partitionBy("seg1")) > 1,
    })
    group = F.when((F.size("segments") <= 1) & ~F.col("nested"), "").when(F.col("n2") > 1, F.col("prefix2")).otherwise(F.concat(F.lit("/"), "seg1"))
    return rows.withColumn("group", group).drop("seg1", "prefix2", "n2", "nested")


def _page_line(origin: str, cut: int) -> Column:
    """The line of a page (title, url, description) in an index."""
    url = F.when(F.col("url").rlike("^https?://"), F.col("url")).otherwise(F.concat(F.lit(origin), F.col("url")))
    said = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(": "), T.truncate(F.col("description"), cut))).otherwise(F.lit(""))
    return F.concat(F.lit("- ["), "title", F.lit("]("), url, F.lit(")"), said)


def _section_lines(section: Mapping) -> list[str]:
    """The lines of one section: title, description (one or several) and links (title, href, description)."""
    said = section.get("description") or []
    listed = [f"- [{x['title']}]({x['href']})" + (f": {x['description']}" if x.get("description") else "") for x in section.get("links", ())]
    return [f"## {section['title']}", "", *(y for x in ([said] if isinstance(said, str) else said) for y in (x, "")), *listed, *([""] if listed else [])]


def _heading(site: str, description: str, origin: str) -> list[str]:
    return [f"# {site}", "", *([f"> {description}", ""] if description else []), *([f"Canonical Origin: {origin}", ""] if origin else [])]


def _framed(lines: DataFrame, head: list[str], name: str, tail: list[str]) -> DataFrame:
    """``lines`` (ord, line) under their title ``name`` if there are any, between the lines ``head`` and ``tail``."""
    fixed = [(i - len(head) - 2, x) for i, x in enumerate(head)] + [((1 << 62) + i, x) for i, x in enumerate(tail)]
    top = lines.sparkSession.createDataFrame(fixed, "ord bigint, line string")
    titled = F.array(*[F.struct(F.lit(i).cast("bigint").alias("ord"), F.lit(x).alias("line")) for i, x in ((-2, f"## {name}"), (-1, ""))])
    title = lines.limit(1).select(F.explode(titled).alias("x")).select("x.ord", "x.line")
    return top.unionByName(title).unionByName(lines)


def index_lines(lines: DataFrame, site: str = "Site", description: str = "", origin: str = "", sections: Sequence[Mapping] = (), notes: str | Sequence[str] = ()) -> DataFrame:
    """ord and line of a site index around the lines of its pages."""
    head = _heading(site, description, origin) + [line for section in sections for line in _section_lines(section)]
    return _framed(lines, head, "Pages", [y for x in ([notes] if isinstance(notes, str) else notes) for y in ("", x)])


def llms_lines(pages: DataFrame, site: str = "Site", description: str = "", origin: str = "", cut: int = 100, sections: Sequence[Mapping] = (), notes: str | Sequence[str] = ()) -> DataFrame:
    """ord and line of a site index: heading, description, origin, sections, one line a page, notes.

    ``pages``: ord, title, url, description. A section has a title and may have a description and links; notes come last.
    """
    return index_lines(pages.select(F.col("ord").cast("bigint"), _page_line(origin, cut).alias("line")), site, description, origin, sections, notes)


def llms_entries(pages: DataFrame, origin: str = "", cut: int = 100) -> DataFrame:
    """ord, line, toc and block of every page: its line of the index, and what a full site text has of it."""
    return _with_blocks(pages, origin).select(F.col("ord").cast("bigint"), _page_line(origin, cut).alias("line"), "toc", "block")


def full_lines(blocks: DataFrame, site: str = "Site", description: str = "", origin: str = "", sections: Sequence[Mapping] = (), notes: str | Sequence[str] = ()) -> DataFrame:
    """ord and line of a full site text: heading, sections, table of contents, the pages, notes. ``blocks``: ord, toc, block.

    Table and pages are two ranges of one order, ord from 0 on: pages come after all entries of the table.
    """
    half = 1 << 61
    toc = blocks.select(F.col("ord").cast("bigint"), F.col("toc").alias("line"))
    rule = F.array(*[F.struct(F.lit(half - 3 + i).alias("ord"), F.lit(x).alias("line")) for i, x in enumerate(("", "---", ""))])
    ruled = blocks.limit(1).select(F.explode(rule).alias("x")).select("x.ord", "x.line")
    pages = blocks.select((F.col("ord") + F.lit(half)).alias("ord"), F.col("block").alias("line"))
    head = _heading(site, description, origin) + [line for section in sections for line in _section_lines(section)]
    tail = [y for x in ([notes] if isinstance(notes, str) else notes) for y in ("", x)]
    return _framed(toc, head, "Table of Contents", tail).unionByName(ruled).unionByName(pages)


def llms_grouped(pages: DataFrame, origin: str = "", cut: int = 160) -> DataFrame:
    """grp, is_blank, path and line of an index in the order of a directory tree: ``orderBy(grp, is_blank, path)``.

    ``pages``: path, title, url, description. An empty line ends the pages of the root, and each of the next two groups
    if it has more than one page, unless nothing follows. Only the sizes of the groups are needed for that.
    """
    rows = sort_keys(pages).withColumnRenamed("group", "grp")
    order = F.struct((F.col("grp") != "").alias("below"), "grp")
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).orderBy(order).limit(4)
    # four rows at most; without pages at the root the first group is number one
    numbered = sizes.withColumns({"nth": F.row_number().over(Window.orderBy(order)), "least": F.min("grp").over(Window.orderBy(order)), "follows": F.lead("grp").over(Window.orderBy(order)).isNotNull()})
    nth = F.col("nth") - F.when(F.col("least") == "", 1).otherwise(0)
    ended = numbered.where("follows").where((nth == 0) | (nth <= 2) & (F.col("n") > 1))
    none = F.lit(None).cast("array<string>")
    blank = ended.select("grp", F.lit(True).alias("is_blank"), none.alias("path"), F.lit("").alias("line"))
    return rows.select("grp", F.lit(False).alias("is_blank"), F.col("segments").alias("path"), _page_line(origin, cut).alias("line")).unionByName(blank)


def llms_full_blocks(pages: DataFrame, origin: str = "") -> DataFrame:
    """ord, toc and block of a full site text. ``pages``: ord, title, url, description, content.

    A page's own front matter is merged under title, url and description; a first line that repeats the title goes.
    """
    return _with_blocks(pages, origin).select("ord", "toc", "block")


def _with_blocks(pages: DataFrame, origin: str) -> DataFrame:
    """Adds toc and block to pages."""
    url = F.when(F.col("url").rlike("^https?://"), F.col("url")).otherwise(F.concat(F.lit(origin), F.col("url")))
    fields = F.filter(F.array(F.struct(F.lit("title").alias("k"), F.col("title").alias("v")), F.struct(F.lit("url").alias("k"), url.alias("v")), F.struct(F.lit("description").alias("k"), F.col("description").alias("v"))), lambda x: F.coalesce(x["v"], F.lit("")) != "")
    own = F.coalesce(F.map_entries(T.frontmatter(F.col("content"))), F.array().cast("array<struct<key:string,value:string>>"))
    value = lambda k: F.filter(fields, lambda f: f["k"] == k)
    merged = F.transform(own, lambda e: F.struct(e["key"].alias("k"), F.coalesce(F.get(value(e["key"]), 0)["v"], e["value"]).alias("v")))
    added = F.filter(fields, lambda f: ~F.exists(own, lambda e: e["key"] == f["k"]))
    head = F.array_join(F.transform(F.concat(merged, added), lambda f: F.concat(f["k"], F.lit(": "), f["v"])), "\n")
    rows = pages.withColumn("body", T.body_of(F.col("content"))).withColumn("head", head)
    trimmed = F.regexp_replace("body", r"^\s+|\s+$", "")
    line = F.regexp_extract(trimmed, r"^([^\n]*)", 1)
    rest = F.regexp_replace(F.regexp_replace(trimmed, r"^[^\n]*\n?", ""), r"^\s+", "")
    body = F.when((line == F.col("title")) | (line == F.concat(F.lit("# "), "title")), rest).otherwise(F.col("body"))
    toc = F.concat(F.lit("- ["), "title", F.lit("](#"), T.anchor(F.col("title")), F.lit(")"))
    block = F.concat(F.lit("---\n"), "head", F.lit("\n---\n\n"), body, F.lit("\n\n---\n"))
    return rows.withColumns({"toc": toc, "block": block})


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no (from 1) and content of every line that is not blank."""
    rows = docs.select(F.col(key), F.posexplode(F.split(F.regexp_replace(text, r"^\s+", ""), "\n")).alias("i", "content"))
    return rows.where(F.trim(F.regexp_replace("content", r"\s", "")) != "").select(key, (F.col("i") + 1).alias("line_no"), "content")


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text", levels: tuple[int, ...] = (2, 3, 4, 5, 6), strip_headers: bool = False) -> DataFrame:
    """Sections of Markdown: key, nth, content, headers (map h1 to h6), code, loc_from and loc_to.

    A heading of a split level begins a section, but for the first of its level; so does a rule. Lines in fences and
    the fences of front matter split nothing. Headings stay in force until a split at their level or above.
    """
    rows = docs.select(F.col(key).alias("key"), F.posexplode_outer(F.split(F.regexp_replace(text, r"^\s+", ""), "\n")).alias("i", "line"))
    rows = rows.where("i is not null")
    doc = Window.partitionBy("key").orderBy("i")
    up_to = doc.rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").startswith("```")
    rows = rows.withColumn("fences", F.sum(fence.cast("int")).over(up_to))
    dashes = F.trim("line") == "---"
    rows = rows.withColumn("nth_rule", F.sum(dashes.cast("int")).over(up_to))
    opens = F.max(F.when((F.col("i") == 0) & dashes, True)).over(Window.partitionBy("key"))
    front = F.coalesce(opens, F.lit(False)) & dashes & (F.col("nth_rule") <= 2)
    free = ~fence & (F.col("fences") % 2 == 0) & ~front
    rows = rows.withColumn("level", F.when(free, T.header_level(F.col("line"))).otherwise(0))
    of_level = F.sum(F.when(F.col("level") > 0, 1).otherwise(0)).over(Window.partitionBy("key", "level").orderBy("i"))
    rows = rows.withColumn("again", F.col("level").isin(*levels) & (of_level > 1))
    rule = free & (F.col("level") == 0) & F.trim("line").rlike(r"^(-{3,}|\*{3,}|_{3,})$")
    rows = rows.withColumn("begins", F.col("again") | rule)
    rows = rows.withColumn("part", F.sum(F.col("begins").cast("int")).over(up_to))
    said = T.strip_markdown(F.regexp_extract("line", r"^#{1,6} (.*)$", 1))
    for n in range(1, 7):
        text_n = F.last(F.when(F.col("level") == n, F.struct("i", said.alias("t"))), ignorenulls=True).over(up_to)
        cleared = F.max(F.when(F.col("again") & (F.col("level") < n), F.col("i"))).over(up_to)
        rows = rows.withColumn(f"h{n}", F.when(F.coalesce(text_n["i"] > cleared, F.lit(True)), text_n["t"]))
    language = F.when(fence & (F.col("fences") % 2 == 1) & (F.length("line") > 3), F.trim(F.substring("line", 4, 1 << 20)))
    kept = F.when(~F.lit(strip_headers) | (F.col("level") == 0), F.struct("i", "line"))
    parts = rows.groupBy("key", "part").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["line"]), "\n").alias("content"),
        F.min(F.when(language != "", F.struct("i", language.alias("l"))))["l"].alias("code"),
        *[F.max(F.struct("i", f"h{n}"))[f"h{n}"].alias(f"h{n}") for n in range(1, 7)],
    )
    parts = parts.withColumn("content", F.regexp_replace("content", r"^\s+|\s+$" if strip_headers else r"\s+$", "")).where("content <> ''")
    in_doc = Window.partitionBy("key").orderBy("part")
    before = F.coalesce(F.sum("n").over(in_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.lead("part").over(in_doc).isNull()
    headers = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(f"h{n}").alias("k"), F.col(f"h{n}").alias("v")) for n in range(1, 7)]), lambda e: e["v"].isNotNull()))
    return parts.select(
        F.col("key").alias(key), F.row_number().over(in_doc).alias("nth"), "content", headers.alias("headers"), "code", (before + 1).cast("int").alias("loc_from"), (before + 1 + F.col("n") - F.when(last, 1).otherwise(0)).cast("int").alias("loc_to")
    )


#: Where a section may be cut, the best first: after an empty line, a closing fence, a line, a space.
_SEPARATORS = ("\n\n", "```\n", "\n", " ")


def _ends(data: np.ndarray, sep: str) -> np.ndarray:
    """The offsets after each occurrence of ``sep``, overlapping ones too."""
    n = len(data) - len(sep) + 1
    if n < 1:
        return np.empty(0, dtype=np.int64)
    return np.flatnonzero(np.logical_and.reduce([data[i : i + n] == ord(c) for i, c in enumerate(sep)])) + len(sep)


def cut_points(text: str, size: int, overlap: int, unit: str = "bytes") -> list[tuple[int, int]]:
    """Ranges, in bytes or characters, of one section's chunks: the best separator whose last place in reach is free decides.

    A place is free if it lies behind the last cut and outside a fence. All places, and how many fences lie before
    each, are found once; a section without a free place is cut after the line that passes ``size``.
    """
    in_bytes = unit == "bytes"
    source = text.encode() if in_bytes else text
    data = np.frombuffer(source, dtype=np.uint8) if in_bytes else np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    fences = np.array([m.end() for m in re.finditer(b"```" if in_bytes else "```", source)], dtype=np.int64)
    places = [(len(sep), _ends(data, sep)) for sep in _SEPARATORS]
    free = [np.searchsorted(fences, ends, side="right") % 2 == 0 for _, ends in places]
    lines = np.union1d(_ends(data, "\n"), [len(data)])

    def best(start: int, least: int) -> int | None:
        for (width, ends), outside in zip(places, free, strict=True):
            at = np.searchsorted(ends, start + size, side="right") - 1
            if at >= 0 and ends[at] - width >= start and ends[at] > least and outside[at]:
                return int(ends[at])
        return None

    out: list[tuple[int, int]] = []
    start, line = 0, 0
    while (line := max(line, int(np.searchsorted(lines, start + size, side="right")))) < len(lines):
        cut = best(start, max(start, out[-1][1] if out else 0)) or int(lines[line])
        out.append((start, cut))
        start = cut - min(overlap, cut - start - 1)
        if in_bytes:
            # not within a character
            start += next((i for i, byte in enumerate(source[start : start + 4]) if byte & 0xC0 != 0x80), len(data) - start)
        line += 1
    return [*out, (start, len(data))] if start < len(data) else out


def chunks(parts: DataFrame, size: int = 1000, overlap: int = 200, unit: str = "bytes") -> DataFrame:
    """Cuts sections longer than ``size`` into overlapping chunks; adds chunk (its number in the section).

    Sizes count bytes (of UTF-8) or characters, as ``unit`` says.
    """
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    if unit not in ("bytes", "characters"):
        raise ValueError("unit must be bytes or characters")

    def pieces(text: str) -> list[str]:
        ranges = cut_points(text, size, overlap, unit)
        if unit == "characters":
            return [text[a:b].rstrip() for a, b in ranges]
        source = text.encode()
        return [source[a:b].decode("utf-8", "ignore").rstrip() for a, b in ranges]

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([pieces(t) for t in texts])

    short = (F.octet_length("content") if unit == "bytes" else F.length("content")) <= size
    long_ones = parts.where(~short).select("*", F.posexplode(cut("content")).alias("chunk", "piece"))
    whole = parts.where(short).select("*", F.lit(0).alias("chunk"), F.col("content").alias("piece"))
    return whole.unionByName(long_ones).where("piece <> ''").drop("content").withColumnRenamed("piece", "content")
