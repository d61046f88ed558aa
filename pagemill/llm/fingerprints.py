r"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A document is the weighted set of its five-word shingles, the weight being how often a shingle occurs (fewer words:
the whole sequence). For each of ``SAMPLES`` independent samples every shingle draws r and c from Gamma(2, 1) and b
from U(0, 1), all from its hash; with weight S, t = floor(ln S / r + b), ln y = r (t - b) and ln a = ln c - ln y - r.
The shingle of least a, with its t, is the sample. Two documents share a sample with a probability equal to the
generalised Jaccard similarity of their weighted sets, so the share of equal samples estimates it.

Shingles are exploded into rows, so that the draws run in generated code, and are summed under their document's
bucket, by which rows are already dealt: the text is shuffled once. ``likeness`` compares two fingerprints.

Defined results: null, empty and wordless texts have the fingerprint of zeros, and are 1 like each other and 0 like
any other. Equal texts have equal fingerprints. Rows that share a doc_id are ordered by their text's hash.
"""

from __future__ import annotations

import json
import math
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm._common import kept, partitions, search_bucket, uniform_bucket

SAMPLES = 32
SHINGLE = 5
#: Samples that are drawn in one row of a term; SAMPLES is a multiple.
TOGETHER = 2
#: Bits of a packed sample that tell shingle and t apart; those above order the samples by a.
TAG_BITS = 24
TAG = (1 << TAG_BITS) - 1
#: Points of the tables that draws are read from.
GRID_BITS = 12
GRID = 1 << GRID_BITS


def word_hashes(text: Column) -> Column:
    """Array of 64-bit hashes of the words of a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)), lambda w: F.xxhash64(w))


def runs(h: Column, n: int = SHINGLE) -> Column:
    """Hashes of every n neighbours of an array of hashes; nothing for shorter arrays."""
    starts = F.when(F.size(h) >= n, F.sequence(F.lit(1), F.size(h) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, n)))


def shingles(h: Column, n: int = SHINGLE) -> Column:
    """Hashes of the shingles of an array of word hashes: the whole sequence if it has fewer than n words."""
    return F.when((F.size(h) > 0) & (F.size(h) < n), F.array(F.xxhash64(h))).otherwise(runs(h, n))


def term(h: Column) -> Column:
    """What a shingle is known by in all draws: its hash without the lowest two bits, which ``compare_edited`` uses."""
    return F.shiftright(h, 2)


def _table(values: list[float]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<double>")


def _quantile(p: float) -> float:
    """The quantile of Gamma(2, 1), by bisection."""
    low, high = 0.0, 64.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - math.exp(-mid) * (1 + mid) < p else (low, mid)
    return high


@lru_cache(maxsize=1)
def _tables() -> tuple[list[float], list[float]]:
    """-ln u, and ln of the quantiles of Gamma(2, 1), over a grid of u: Spark's own logarithm is ten times as slow."""
    top = _quantile(1 - 1 / (64 * GRID))
    return [-math.log((i + 0.5) / GRID) for i in range(GRID)], [math.log(_quantile(max(i, 1 / 64) / GRID)) for i in range(GRID)] + [math.log(top)]


def _bits(h: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << width) - 1))


def draws(term: str, nth: Column, j: int) -> list[dict[str, Column]]:
    """Columns r, b and ln_c of a term's nth draw, and h2 for its tag, in steps that each use the one before.

    Steps are columns of their own (numbered j), so that generated code computes each once a row. r is the sum of two
    exponential draws; ln c is read between two quantiles, and computed where the lowest would be too coarse.
    """
    logs, quantiles = map(_table, _tables())
    h1, h2, k = F.col(f"h1_{j}"), F.col(f"h2_{j}"), F.col(f"k_{j}")
    part = _bits(h2, 0, 28).cast("double") / float(1 << 28)
    low = F.get(quantiles, k)
    # near 0 the distribution function of Gamma(2, 1) is c * c / 2
    exact = F.log(2.0 * (part + 1e-9) / GRID) / 2.0
    return [
        {f"h1_{j}": F.xxhash64(term, nth), f"h2_{j}": F.xxhash64(nth, term)},
        {f"k_{j}": _bits(h2, 28, GRID_BITS).cast("int")},
        {
            f"r_{j}": F.get(logs, _bits(h1, 0, GRID_BITS).cast("int")) + F.get(logs, _bits(h1, GRID_BITS, GRID_BITS).cast("int")),
            f"b_{j}": (_bits(h1, 2 * GRID_BITS, 32).cast("double") + 0.5) / float(1 << 32),
            f"c_{j}": F.when(k == 0, exact).otherwise(low + part * (F.get(quantiles, k + 1) - low)),
        },
    ]


def packed_sample(t: Column, j: int) -> Column:
    """ln a, quantised, above a tag of (shingle, t): the least packed value of a document is its nth sample."""
    ln_a = F.col(f"c_{j}") - F.col(f"r_{j}") * (t - F.col(f"b_{j}") + 1.0)
    order = ((F.greatest(F.lit(-63.0), ln_a) + 64.0) * float(1 << 31)).cast("bigint")
    told = F.shiftrightunsigned(f"h2_{j}", 64 - TAG_BITS).bitwiseXOR((t * F.lit(40503)).bitwiseAND(F.lit(TAG)))
    return F.shiftleft(order, TAG_BITS).bitwiseOR(told)


def tag(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(TAG))


def as_text(samples: Column, n: int = SAMPLES) -> Column:
    """Hexadecimal text of the tags of a document's samples (array in order); zeros if there are none."""
    width = TAG_BITS // 4
    hexed = F.array_join(F.transform(samples, lambda s: F.lower(F.lpad(F.hex(tag(s)), width, "0"))), "")
    return F.when(F.get(samples, 0).isNotNull(), hexed).otherwise(F.lit("0" * width * n))


def likeness(a: Column, b: Column, n: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints as text, an estimate of generalised Jaccard similarity."""
    width = TAG_BITS // 4
    zeros = F.lit("0" * width * n)
    same = reduce(lambda x, y: x + y, [(F.substring(a, i * width + 1, width) == F.substring(b, i * width + 1, width)).cast("int") for i in range(n)])
    return F.when(a == b, F.lit(1.0)).when((a == zeros) | (b == zeros), F.lit(0.0)).otherwise(same / float(n))


def samples_of(terms: DataFrame, keys: list[str], weights: dict[str, str], n: int = SAMPLES) -> DataFrame:
    """Samples for each document and each weight column.

    ``terms`` has one row per document (keys) and term with the columns ``term`` and the weights; the result has one
    row per document with an array of n packed samples under each name in ``weights`` (null where all weights are 0).
    Documents must be dealt by the first key, else rows are shuffled by keys.
    """
    # the logarithm of a weight is taken once a term; a weight of 0 has none, and null samples are never the least
    logs = {f"ln_{name}": F.when(F.col(weight) > 1, F.log(F.col(weight).cast("double"))).when(F.col(weight) == 1, F.lit(0.0)) for name, weight in weights.items()}
    drawn = terms.select(*keys, "term", *[c.alias(name) for name, c in logs.items()], F.explode(F.sequence(F.lit(0), F.lit(n // TOGETHER - 1))).alias("nth"))
    of = [(name, j) for name in weights for j in range(TOGETHER)]
    for steps in zip(*(draws("term", F.col("nth") * TOGETHER + j, j) for j in range(TOGETHER)), strict=True):
        drawn = drawn.withColumns({k: v for step in steps for k, v in step.items()})
    drawn = drawn.withColumns({f"t_{name}_{j}": F.floor(F.col(f"ln_{name}") / F.col(f"r_{j}") + F.col(f"b_{j}")) for name, j in of})
    drawn = drawn.select(*keys, "nth", *[packed_sample(F.col(f"t_{name}_{j}"), j).alias(f"{name}_{j}") for name, j in of])
    least = drawn.groupBy(*keys, "nth").agg(*[F.min(f"{name}_{j}").alias(f"{name}_{j}") for name, j in of])
    rows = least.select(*keys, "nth", *[F.array(*[f"{name}_{j}" for j in range(TOGETHER)]).alias(name) for name in weights])
    rows = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("nth", *weights))).alias("all"))
    return rows.select(*keys, *[F.flatten(F.col(f"all.{name}")).alias(name) for name in weights])


def fingerprints(docs: DataFrame, n: int = SAMPLES) -> DataFrame:
    """doc_id and fingerprint of every row of ``docs`` (doc_id, text); rows equal in both come once."""
    # words are a column of their own: within the shingles' expression they would be made anew for each
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), word_hashes(F.coalesce("text", F.lit(""))).alias("words"))
    rows = rows.select("doc_id", "row", shingles(F.col("words")).alias("terms")).distinct()
    # an outer explode: Spark would test a plain one's array for emptiness below, and make it once more for that
    terms = rows.select("doc_id", "row", F.explode_outer("terms").alias("x")).where("x is not null").groupBy("doc_id", "row", term(F.col("x")).alias("term")).agg(F.count(F.lit(1)).alias("weight"))
    found = samples_of(terms, ["doc_id", "row"], {"samples": "weight"}, n).select(F.col("doc_id").alias("id"), F.col("row").alias("r"), "samples")
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("r")), "left")
    return rows.select("doc_id", as_text(F.col("samples"), n).alias("fingerprint"))


def in_order(docs: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, text, bucket and nth_row of every row, and b, v: the text of each bucket's first row.

    Buckets are ranges of descending doc_id, nth_row counts in each. Only the bounds of the ranges, at most one per
    bucket, pass through the driver. Null ids come last, in as many ranges of their texts' hashes as their rows need.
    """
    shares = [i / buckets for i in range(1, buckets)]
    asked = [F.percentile_approx("doc_id", shares, 20 * buckets)] if shares else []
    *found, nulls, total = docs.agg(*asked, F.count_if(F.col("doc_id").isNull()), F.count(F.lit(1))).first()
    bounds = sorted({-int(b) for b in (found[0] if found and found[0] else [])})
    spread = max(1, math.ceil(buckets * nulls / max(total, 1)))
    text = F.coalesce(F.col("text"), F.lit(""))
    bucket = F.when(F.col("doc_id").isNull(), len(bounds) + 1 + uniform_bucket(F.xxhash64(text), spread)).otherwise(search_bucket(-F.col("doc_id"), bounds))
    rows = docs.select("doc_id", text.alias("text"), bucket.cast("int").alias("bucket"))
    down = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    # one row a bucket: found by id, so that the texts are shuffled once
    top = rows.groupBy(F.col("bucket").alias("b")).agg(F.max("doc_id").alias("top"))
    heads = rows.join(F.broadcast(top), (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("top")))
    firsts = heads.groupBy("b").agg(F.min_by("text", F.xxhash64("text")).alias("v"))
    return rows.repartition(buckets, "bucket").withColumn("nth_row", F.row_number().over(down)), firsts


def _around(firsts: DataFrame) -> DataFrame:
    """For each bucket of ``firsts`` (b, v: one row a bucket) the next bucket's v; after the last comes the first."""
    # bucket numbers alone pass through one task; values are joined to them
    along = Window.partitionBy(F.lit(0)).orderBy("at")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select(F.col("b").alias("at")).select("at", F.coalesce(F.lead("at").over(along), F.first("at").over(whole)).alias("then"))
    return after.join(firsts, F.col("then") == F.col("b")).select(F.col("at").alias("b"), F.col("v").alias("head"))


def with_next(rows: DataFrame, firsts: DataFrame, value: str, out: str) -> DataFrame:
    """``rows`` (bucket, nth_row) with the next row's ``value``; after the last row comes the first.

    The last row of a bucket takes the value of the next bucket's first row, which ``firsts`` (b, v) gives.
    """
    ahead = F.lead(value).over(Window.partitionBy("bucket").orderBy("nth_row"))
    joined = rows.withColumn("ahead", ahead).join(_around(firsts), F.col("bucket") == F.col("b"))
    return joined.withColumn(out, F.coalesce("ahead", "head")).drop("ahead", "head", "b")


def compare_edited(docs: DataFrame, n: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edit, and how alike they are; see the query ``op1`` for the columns.

    The edit replaces the last third of a text's code points by the first as many of the next document's, by
    descending doc_id.
    """
    buckets = 4 * partitions(docs.sparkSession)
    ordered, firsts = in_order(docs, buckets)
    # one text a bucket, read for its bucket's number and for itself
    rows = with_next(ordered, kept(firsts), "text", "next_text")
    size = F.length("text")
    cut = F.floor(size / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - cut), F.substring("next_text", F.lit(1), cut))
    # Both texts begin alike: shingles of the whole words before the cut are made once. The lowest two bits of a term
    # say which of the texts it is from.
    kept_part = F.substring("text", F.lit(1), size - cut)
    whole = F.regexp_replace(kept_part, r"[^\x20\x09-\x0D]+\z", "")
    rest = F.concat(F.substring(kept_part, F.length(whole) + 1, size), F.substring("next_text", F.lit(1), cut))
    hashed = rows.select("bucket", "nth_row", word_hashes(F.col("text")).alias("words"), F.regexp_count(whole, F.lit(r"[^\x20\x09-\x0D]+")).alias("alike"), word_hashes(rest).alias("rest"))
    alike = F.col("alike")
    before = F.greatest(alike - (SHINGLE - 1), F.lit(0))  # shingles, and words before the first shingle, that both have
    theirs = F.concat(F.slice("words", before + 1, alike - before), F.col("rest"))
    ours = F.slice("words", before + 1, F.size("words") - before)

    def told(h: Column, bits: int) -> Column:
        return F.transform(h, lambda x: x.bitwiseAND(F.lit(-4)).bitwiseOR(F.lit(bits)))

    hashed = hashed.select("bucket", "nth_row", F.slice("words", 1, alike).alias("same"), ours.alias("ours"), theirs.alias("theirs"), (before > 0).alias("long"))
    both = F.when(F.col("long"), F.concat(told(runs(F.col("same")), 3), told(runs(F.col("ours")), 1), told(runs(F.col("theirs")), 2)))
    both = both.otherwise(F.concat(told(shingles(F.col("ours")), 1), told(shingles(F.col("theirs")), 2)))
    # an outer explode: Spark would test a plain one's array for emptiness below, and make it once more for that
    terms = hashed.select("bucket", "nth_row", F.explode_outer(both).alias("x")).where("x is not null")
    in_ours, in_theirs = F.col("x").bitwiseAND(F.lit(1)), F.shiftright("x", 1).bitwiseAND(F.lit(1))
    terms = terms.groupBy("bucket", "nth_row", term(F.col("x")).alias("term")).agg(F.sum(in_ours).alias("ours"), F.sum(in_theirs).alias("theirs"))
    found = samples_of(terms, ["bucket", "nth_row"], {"fingerprint": "ours", "edited_fingerprint": "theirs"}, n)
    found = found.select(F.col("bucket").alias("b"), F.col("nth_row").alias("r"), *[as_text(F.col(c), n).alias(c) for c in ("fingerprint", "edited_fingerprint")])
    zeros = F.lit("0" * (TAG_BITS // 4) * n)
    meta = rows.select("bucket", "nth_row", "doc_id", size.cast("bigint").alias("n_chars"), F.sha2(edited.cast("binary"), 256).alias("edited_sha256"))
    out = meta.join(found, (F.col("bucket") == F.col("b")) & (F.col("nth_row") == F.col("r")), "left").drop("b", "r")
    out = kept(out.withColumns({c: F.coalesce(c, zeros) for c in ("fingerprint", "edited_fingerprint")}))
    firsts = out.where("nth_row = 1").select(F.col("bucket").alias("b"), F.col("fingerprint").alias("v"))
    out = with_next(out, firsts, "fingerprint", "next_fingerprint")
    near = {"near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint"), n), "near_next": likeness(F.col("fingerprint"), F.col("next_fingerprint"), n)}
    return out.withColumns(near).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
