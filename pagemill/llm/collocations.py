r"""Phrase collocations: how much more often words stand together than their parts do, counted exactly.

Texts are lower-cased (A-Z) and cut into pieces at punctuation and line ends; identical pieces of a language become one
with a multiplicity. Every place of a piece gives one window, the place's word and up to three after it; all n-grams that begin at
the place are prefixes of the window. Windows are summed within a task, packed by hash bucket of their first two words
and shuffled as compressed columns, one row a bucket and block of windows. Each bucket's task streams them into duckdb,
which sums windows and prefixes out of core. So all n-grams with the same first two words are counted in one place, and
what occurs too seldom for a candidate never leaves it.

The few word pairs that begin a large share of the windows (found in a bounded sample of documents; missing one
costs time, not results) are spread over all buckets by their whole windows, and their partial sums are added in Spark.

A candidate's parts are themselves frequent, so their counts lie among the n-grams kept: every cut of a candidate asks
for both its parts by a shuffled lookup, very popular parts where the requests lie. The same holds for longer
candidates, which tell each phrase within them how often they occur; the most frequent one decides.

Defined results: null and empty texts have no words; a null language is ``und``, as is a language of that name. Repeated
rows count as often as they stand, ids play no part, very long texts and pieces are read whole. Ties in the ranking fall by
frequency, then by phrase in UTF-8 order, so it is total. Languages without a candidate give no rows, nor does an
empty table.
"""

from __future__ import annotations

import math
import tempfile
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm._common import hot_keys, join_by_key, kept, partitions

LONGEST = 4
LEAST = 30
#: A candidate goes if a longer one that holds it occurs at least so many of 100 times as often.
DOMINATED = 80
SCALE = 2_000_000
TOP = 2000
#: Documents looked at for pairs that begin more than HOT_SHARE of all windows; there are fewer such pairs than its inverse.
SAMPLE_DOCS = 4096
HOT_SHARE = 1 / 2048
#: Windows that are summed and packed together: more of them where there are many buckets.
BLOCK = 1 << 18
#: What duckdb may hold in memory before it writes to the task's scratch folder.
MEMORY = "300MB"
_SPLIT = r"[.,;:!?\x0A-\x0D]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = tuple(f"w{i}" for i in range(1, LONGEST + 1))
_COLUMNS = pa.schema([("lang", pa.string()), *[(w, pa.string()) for w in _WORDS], ("hot", pa.bool_()), ("m", pa.int64())])


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece (its words joined by single spaces) and m, how often it occurs, of ``docs`` (lang, text)."""
    lower = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split(lower, _SPLIT)).alias("piece"))
    tidy = F.trim(F.regexp_replace(F.translate("piece", "\t", " "), " {2,}", " "))
    return rows.select("lang", tidy.alias("piece")).where("piece <> ''").groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("m"))


def hot_pairs(docs: DataFrame) -> list[tuple[str, str, str]]:
    """(lang, first word, second word) of the pairs that begin many windows of a sample of about ``SAMPLE_DOCS`` documents."""
    every = max(1, docs.count() // SAMPLE_DOCS)
    found = pieces(docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)).select("lang", F.split("piece", " ").alias("w"))
    places = F.when(F.size("w") > 1, F.sequence(F.lit(0), F.size("w") - 2)).otherwise(F.array().cast("array<int>"))
    found = found.select("lang", "w", F.explode(places).alias("i")).select("lang", F.get("w", F.col("i")).alias("a"), F.get("w", F.col("i") + 1).alias("b"))
    counts = found.groupBy("lang", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    return [(r.lang, r.a, r.b) for r in counts.where(F.col("n") > total * HOT_SHARE).collect()]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _hashes(words: pa.Array) -> np.ndarray:
    """A hash of each word, the same in every task; 0 stands for no word."""
    binary = words.cast(pa.binary())
    # some words at a time: as one list of objects they would take several times their room
    given = ((zlib.crc32(w) << 32 | zlib.adler32(w)) + 1 for at in range(0, len(binary), 1 << 12) for w in binary.slice(at, 1 << 12).to_pylist())
    return np.concatenate([np.zeros(1, dtype=np.uint64), np.fromiter(given, dtype=np.uint64, count=len(binary))])


def _sums(lang: np.ndarray, at: np.ndarray, m: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of ``at`` (word numbers, 0 for none) by language, and the sum of ``m`` over equal ones."""
    n = np.int64(words + 1)
    _, pair = np.unique((lang * n + at[:, 0]) * n + at[:, 1], return_inverse=True)
    _, first, same = np.unique((pair * n + at[:, 2]) * n + at[:, 3], return_index=True, return_inverse=True)
    total = np.zeros(len(first), dtype=np.int64)
    np.add.at(total, same, m)
    return lang[first], at[first], total


def _packed(bucket: np.ndarray, langs: pa.Array, words: pa.Array, lang: np.ndarray, at: np.ndarray, hot: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    """One row a bucket: the bucket and its windows, each word once and numbered in short, as a compressed Arrow stream."""
    order = np.argsort(bucket, kind="stable")
    ids, starts = np.unique(bucket[order], return_index=True)
    blobs = []
    for begin, end in zip(starts, [*starts[1:], len(order)], strict=True):
        rows = order[begin:end]
        used, number = np.unique(at[rows], return_inverse=True)
        spoken, by = np.unique(lang[rows], return_inverse=True)
        kind = np.uint16 if len(used) < 1 << 16 else np.uint32
        number = number.reshape(-1, LONGEST).astype(kind)
        # first words come in order, so their differences are small; they wrap around where a new language begins
        number[:, 0] = np.diff(number[:, 0], prepend=kind(0))
        columns = {"langs": langs.take(pa.array(spoken)), "words": words.take(pa.array(used - 1, mask=used == 0)), "lang": pa.array(by.astype(np.uint16 if len(spoken) < 1 << 16 else np.uint32))}
        columns |= {w: pa.array(np.ascontiguousarray(number[:, k])) for k, w in enumerate(_WORDS)} | {"hot": pa.array(hot[rows]), "m": pa.array(m[rows])}
        one = pa.record_batch([pa.ListArray.from_arrays([0, len(c)], c) for c in columns.values()], names=list(columns))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, one.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(one)
        blobs.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "rows"])


def unpacked(blob: pa.Buffer) -> pa.RecordBatch:
    """The windows that ``_packed`` has put into one value: lang, words, hot and m."""
    one = pa.ipc.open_stream(blob).read_next_batch()
    column = {name: one.column(name).flatten() for name in one.schema.names}
    number = [np.asarray(column[w]) for w in _WORDS]
    # sums wrap around as the differences did
    number[0] = np.cumsum(number[0], dtype=number[0].dtype)
    words = [column["words"].take(pa.array(n)) for n in number]
    return pa.RecordBatch.from_arrays([column["langs"].take(column["lang"]), *words, column["hot"], column["m"]], schema=_COLUMNS)


def packed_windows(rows: pa.Table, hot: list[tuple[str, str, str]], buckets: int, block: int) -> Iterator[pa.RecordBatch]:
    """Windows of pieces (lang, piece, m), summed and packed block by block; windows of one word count that word."""
    lists = pc.split_pattern(rows["piece"].combine_chunks(), " ")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    coded = lists.flatten().dictionary_encode()
    codes = np.asarray(coded.indices, dtype=np.int64) + 1
    langs = rows["lang"].combine_chunks().dictionary_encode()
    size = np.diff(offsets)
    end = np.repeat(offsets[1:], size)
    lang = np.repeat(np.asarray(langs.indices, dtype=np.int64), size)
    m = np.repeat(np.asarray(rows["m"].combine_chunks(), dtype=np.int64), size)
    names, words = langs.dictionary, coded.dictionary
    h_word, h_lang = _hashes(words), _hashes(names)[1:]
    asked = sorted({w for _, *pair in hot for w in pair})
    number = {w: i + 1 for w, i in zip(asked, pc.index_in(pa.array(asked, pa.string()), value_set=words).to_pylist(), strict=True) if i is not None}
    of_lang = {x: i for i, x in enumerate(names.to_pylist())}
    base = np.int64(len(words) + 1)
    salted = np.array([(of_lang[x] * base + number[a]) * base + number[b] for x, a, b in hot if x in of_lang and a in number and b in number], dtype=np.int64)
    padded = np.concatenate([codes, np.zeros(LONGEST, dtype=np.int64)])
    for start in range(0, len(codes), block):
        i = np.arange(start, min(start + block, len(codes)))
        at = np.stack([np.where(i + k < end[i], padded[i + k], 0) for k in range(LONGEST)], axis=1)
        alone = at.copy()
        alone[:, 1:] = 0
        long = at[:, 1] > 0
        parts = [_sums(lang[i], alone, m[i], len(words)), _sums(lang[i][long], at[long], m[i][long], len(words))]
        of, at, total = (np.concatenate(x) for x in zip(*parts, strict=True))
        is_hot = np.isin((of * base + at[:, 0]) * base + at[:, 1], salted)
        h = _mix(_mix(h_lang[of] + h_word[at[:, 0]]) * np.uint64(3) + h_word[at[:, 1]])
        h = np.where(is_hot, _mix(_mix(h + h_word[at[:, 2]]) * np.uint64(3) + h_word[at[:, 3]]), h)
        yield _packed((h % np.uint64(buckets)).astype(np.int64), names, words, of, at, is_hot, total)


def _counted(blobs: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """lang, n, phrase and a: sums of a bucket's windows and of their prefixes, by duckdb, which may use the task's scratch folder.

    What is complete here comes only from ``least`` on; sums of pairs spread over buckets all come. n is 0 for the number of words.
    """
    import duckdb

    def windows() -> Iterator[pa.RecordBatch]:
        for batch in blobs:
            for blob in batch.column("rows"):
                yield unpacked(blob.as_buffer())

    first = next(blobs, None)
    if first is None:
        return
    blobs = _chain(first, blobs)
    # scratch of this task alone, gone with it: nothing outside reads it
    with tempfile.TemporaryDirectory(prefix="pagemill-duckdb-") as scratch, duckdb.connect(config={"memory_limit": MEMORY, "temp_directory": scratch, "threads": "1", "preserve_insertion_order": "false"}) as con:
        arriving = pa.RecordBatchReader.from_batches(_COLUMNS, windows())
        con.register("arriving", arriving)
        keys = ", ".join(_WORDS)
        con.execute(f"CREATE TABLE windows AS SELECT lang, {keys}, hot, sum(m)::BIGINT AS m FROM arriving GROUP BY ALL")
        con.unregister("arriving")
        queries = ["SELECT lang, 0 AS n, '' AS phrase, sum(m)::BIGINT AS a FROM windows WHERE w2 IS NULL GROUP BY lang"]
        queries.append(f"SELECT lang, 1 AS n, w1 AS phrase, m AS a FROM windows WHERE w2 IS NULL AND m >= {least}")
        for n in range(2, LONGEST):
            names = ", ".join(_WORDS[:n])
            queries.append(f"SELECT lang, {n} AS n, concat_ws(' ', {names}) AS phrase, sum(m)::BIGINT AS a FROM windows WHERE w{n} IS NOT NULL GROUP BY lang, {names}, hot HAVING hot OR sum(m) >= {least}")
        queries.append(f"SELECT lang, {LONGEST} AS n, concat_ws(' ', {keys}) AS phrase, m AS a FROM windows WHERE w{LONGEST} IS NOT NULL AND m >= {least}")
        for query in queries:
            for batch in con.sql(query).to_arrow_reader(1 << 16):
                yield batch.cast(pa.schema([("lang", pa.string()), ("n", pa.int32()), ("phrase", pa.string()), ("a", pa.int64())]))


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, n, phrase and a of all phrases of 1 to ``LONGEST`` words that occur ``least`` times; n is 0 for all words of a language."""
    docs = docs.select("lang", "text")
    hot = hot_pairs(docs)
    buckets = partitions(docs.sparkSession)
    block = max(BLOCK, 64 * buckets)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows * 24 + batch.nbytes
            if size > 16 * block:
                yield from packed_windows(pa.Table.from_batches(waiting), hot, buckets, block)
                waiting, size = [], 0
        if waiting:
            yield from packed_windows(pa.Table.from_batches(waiting), hot, buckets, block)
        # the worker goes on to count buckets, beside which this room would stay taken
        waiting.clear()
        pa.default_memory_pool().release_unused()

    packed = pieces(docs).mapInArrow(pack, "bucket int, rows binary").repartitionById(buckets, F.col("bucket"))
    counted = packed.mapInArrow(lambda b: _counted(b, least), "lang string, n int, phrase string, a bigint")
    whole = counted.groupBy("lang", "n", "phrase").agg(F.sum("a").alias("a"))
    return whole.where((F.col("a") >= least) | (F.col("n") == 0))


def _exact(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, n, a, l, r and score of every candidate of ``phrases`` (``frequent_phrases``): the cut that scores least."""
    words = F.split("phrase", " ")
    found = phrases.where("n > 1")
    cuts = F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k")
    asked = found.select("lang", "phrase", "n", "a", words.alias("w"), cuts).select("lang", "phrase", "n", "a", "k", F.explode(F.array(
        F.struct(F.lit("l").alias("side"), F.array_join(F.slice("w", 1, F.col("k")), " ").alias("part")),
        F.struct(F.lit("r").alias("side"), F.array_join(F.slice("w", F.col("k") + 1, F.col("n")), " ").alias("part")),
    )).alias("ask")).select("lang", "phrase", "n", "a", "k", "ask.side", "ask.part")
    told = phrases.where("n > 0").select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    counts = asked.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("asked"))
    total = asked.count()
    answers = join_by_key(asked, told, ["lang", "part"], kept(hot_keys(counts, "asked", total)))
    sides = [F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{side}{k}") for k in range(1, LONGEST) for side in "lr"]
    by_phrase = answers.groupBy("lang", "phrase", "n", "a").agg(*sides)

    def cut(k: int) -> Column:
        score = F.expr(f"(cast(a as decimal(38,0)) * {SCALE}) div (cast(l{k} as decimal(38,0)) + cast(r{k} as decimal(38,0)))")
        return F.when(F.col(f"l{k}").isNotNull(), F.struct(score.cast("bigint").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))

    best = F.array_min(F.filter(F.array(*[cut(k) for k in range(1, LONGEST)]), lambda c: c.isNotNull()))
    return by_phrase.withColumn("best", best).select("lang", "phrase", "n", "a", "best.l", "best.r", "best.score")


def undominated(candidates: DataFrame) -> DataFrame:
    """The rows of ``candidates`` (lang, phrase, n, a) that no longer one holds and comes near in frequency."""
    words = F.split("phrase", " ")
    longer = candidates.where("n > 2").select("lang", "n", F.col("a").alias("f"), words.alias("w"))

    def inner(size: int) -> DataFrame:
        starts = F.sequence(F.lit(1), F.col("n") - size + 1)
        return longer.where(f"n > {size}").select("lang", "f", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, size), " "))).alias("phrase"))

    within = reduce(DataFrame.unionByName, [inner(size) for size in range(2, LONGEST)])
    most = within.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    rows = candidates.join(most, ["lang", "phrase"], "left")
    return rows.where(F.col("f").isNull() | (_exact(F.col("f")) * 100 < _exact(F.col("a")) * DOMINATED)).drop("f")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first ``top`` phrases of each language of ``docs`` (lang, text)."""
    phrases = kept(frequent_phrases(docs, least))
    totals = phrases.where("n = 0").select("lang", F.col("a").alias("all_words"))
    rows = undominated(scored(phrases)).select("lang", "phrase", "a", "l", "r", "score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the first of parts of a language, then of fewer parts, so that no task sorts a whole language
    parts = partitions(docs.sparkSession)
    for n in (parts, math.isqrt(parts), 1):
        part = F.pmod(F.xxhash64("phrase"), F.lit(n))
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    found = rows.join(totals, "lang")
    return found.select("lang", "rank", "phrase", "a", "l", "r", F.col("all_words").alias("n"), "score")


ORACLE_SQL = rf"""
WITH pieces AS (
  SELECT COALESCE(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(COALESCE(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
worded AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM worded WHERE len(w) > 0),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM places, (VALUES (1), (2), (3), (4)) v(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM grams WHERE k = 1 GROUP BY lang),
frequent AS (SELECT * FROM grams WHERE f >= {LEAST}),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.f AS a, v.cut, array_to_string(string_split(c.phrase, ' ')[:v.cut], ' ') AS head, array_to_string(string_split(c.phrase, ' ')[v.cut + 1:], ' ') AS tail
  FROM frequent c, (VALUES (1), (2), (3)) v(cut) WHERE c.k > 1 AND v.cut < c.k),
told AS (
  SELECT c.*, x.f AS l, y.f AS r, (CAST({SCALE} AS HUGEINT) * c.a) // (x.f + y.f) AS score
  FROM cuts c JOIN frequent x ON x.lang = c.lang AND x.phrase = c.head JOIN frequent y ON y.lang = c.lang AND y.phrase = c.tail),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM told) WHERE nth = 1),
within AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[s.i:s.i + z.size - 1], ' ') AS phrase, max(f) AS f
  FROM frequent, (VALUES (2), (3)) z(size), (VALUES (1), (2), (3)) s(i) WHERE z.size < k AND s.i + z.size - 1 <= k GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN within w ON w.lang = b.lang AND w.phrase = b.phrase WHERE w.f IS NULL OR 100 * w.f < {DOMINATED} * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, CAST(t.n AS BIGINT) AS n, CAST(r.score AS BIGINT) AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= {TOP}
"""
