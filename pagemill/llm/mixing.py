r"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source's documents are shuffled by a hash and queued in one or two passes. A document's virtual finish time is
the source's cumulative words up to and including it, divided by the source's target. The queue of all sources is
range-sorted by finish time and cut where the words taken reach the budget. Running sums are taken in two levels, sums
of hash or time ranges first, then rows within one range, so that a source with most of the rows is spread over many
tasks.

Targets share ``BUDGET`` times all words by weight (3, 1, 2 repeating over the sources in code point order, null
last); a target stops at ``MOST`` times its source's words and the excess is shared by weight among the others.

Defined results: null, empty and wordless texts have size 0 and nothing taken; a source without words has target 0.
Repeated rows are queued one by one. An empty table gives no rows. Reruns agree: all orders are total up to rows that
are equal in every output column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm._common import kept, with_offsets

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
#: Equal ratios of finish times that share a range: so many ranges at least for each doubling of them.
RANGES = 256
#: Rows that a part of a source's queue or a range should hold at most; a larger table has more parts and ranges.
PART_ROWS = 65536


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _shuffled() -> Column:
    # rows without an id are told apart by their texts, else they would stand together in the queue
    known = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.col("text_hash").cast("string")))
    return F.md5(F.concat(F.lit("mix:"), known).cast("binary"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, rank, source_size, target and the whole budget of every source of ``sizes`` (source, size). One row per source."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    ranked = ranked.withColumn("weight", F.get(weights, F.col("rank") % len(WEIGHTS))).withColumn("cap", F.col("source_size") * MOST)
    everything = Window.partitionBy(F.lit(0))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "rank")
    # filled in order of cap over weight: a source is capped if the share left for it and all later ones reaches its cap
    level = ranked.withColumns({
        "budget": F.sum("source_size").over(everything) * F.lit(BUDGET),
        "before": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "rest": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
    })
    level = level.withColumn("capped", F.col("cap") * F.col("rest") <= (F.col("budget") - F.col("before")) * F.col("weight"))
    share = (F.col("budget") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))) / F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * share)
    return level.select("source", "rank", "source_size", target.alias("target"), "budget")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, occurrence, size, source_size, target and taken of every row of ``docs`` (doc_id, text, source).

    ``text_hash`` is of text and source; ``occurrence`` numbers rows that share it and the doc_id.
    """
    same = Window.partitionBy("doc_id", "text_hash").orderBy("size")
    sized = docs.select("doc_id", "source", F.xxhash64("text", "source").alias("text_hash"), word_count().alias("size"))
    sized = kept(sized.select("doc_id", "source", "size", "text_hash", F.row_number().over(same).alias("occurrence"), _shuffled().alias("h")))
    total = sized.count()
    digits = max(3, math.ceil(math.log(max(1, total / PART_ROWS), 16)))
    ranges = max(RANGES, total // (16 * PART_ROWS))
    by_source = kept(targets(sized))
    t = by_source.withColumnRenamed("source", "of")
    rows = sized.join(t, F.col("source").eqNullSafe(F.col("of"))).drop("of", "source").withColumn("part", F.substring("h", 1, digits))

    in_source = with_offsets(rows, ["rank"], "part", F.col("size"), "earlier")
    queue = Window.partitionBy("rank", "part").orderBy("h", "doc_id", "size", "text_hash", "occurrence")
    done = F.col("earlier") + F.sum("size").over(queue.rowsBetween(Window.unboundedPreceding, 0))
    queued = rows.join(in_source, ["rank", "part"]).withColumn("done", done)

    passes = queued.where("size > 0").select("*", F.explode(F.array(*[F.lit(i) for i in range(MOST)])).alias("pass"))
    passes = passes.withColumn("finish", (F.col("done") + F.col("pass") * F.col("source_size")) / F.col("target"))
    passes = passes.withColumn("range", F.floor(F.log2("finish") * ranges).cast("int")).withColumn("one", F.lit(0))
    # as many ranges a doubling as asked, times the doublings between the first and the last finish time
    ahead = with_offsets(passes, ["one"], "range", F.col("size"), "ahead").drop("one")
    in_range = Window.partitionBy("range").orderBy("finish", "rank", "pass", "h", "doc_id", "size", "text_hash", "occurrence")
    so_far = F.col("ahead") + F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, 0))
    cut = passes.join(ahead, "range").withColumn("so_far", so_far)
    # a null id is 0 with a flag, so that rows are found again by plain equality
    key = {"id": F.coalesce("doc_id", F.lit(0)), "none": F.col("doc_id").isNull()}
    chosen = cut.where("so_far <= budget").withColumns(key).groupBy("id", "none", "text_hash", "occurrence").agg(F.sum("size").alias("got"))
    out = rows.withColumns(key).join(chosen, ["id", "none", "text_hash", "occurrence"], "left")
    return out.select("doc_id", "text_hash", "occurrence", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken, with the columns of ``docs``.

    Texts are shuffled once: rows are numbered among those that share id, text and source, and joined on the same key.
    """
    own = {name: f"{name}_of_mix" for name in ("id", "none", "hash", "nth", "times", "pass", "all")}
    while set(own.values()) & set(docs.columns):
        own = {k: v + "_" for k, v in own.items()}
    key = [own["id"], own["none"], own["hash"]]
    taken = mix(docs.select("doc_id", "text", "source")).where("taken > 0")
    taken = taken.select(
        F.coalesce("doc_id", F.lit(0)).alias(own["id"]), F.col("doc_id").isNull().alias(own["none"]), F.col("text_hash").alias(own["hash"]),
        F.struct("occurrence", (F.col("taken") / F.col("size")).cast("int").alias("times")).alias("one"),
    )
    taken = taken.groupBy(*key).agg(F.map_from_entries(F.collect_list("one")).alias(own["times"]))
    rows = docs.withColumns({own["id"]: F.coalesce("doc_id", F.lit(0)), own["none"]: F.col("doc_id").isNull(), own["hash"]: F.xxhash64("text", "source")})
    # rows alike in the key may differ in other columns; maps have no hash
    rest = F.xxhash64(*[F.col(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()])
    rows = rows.withColumn(own["nth"], F.row_number().over(Window.partitionBy(*key).orderBy(rest))).join(taken, key)
    times = F.coalesce(F.try_element_at(own["times"], F.col(own["nth"])), F.lit(0))
    return rows.withColumn(own["pass"], F.explode(F.array_repeat(F.lit(0), times))).select(*docs.columns)


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('mix:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
ranked AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM sized GROUP BY source),
weighted AS (SELECT *, [3, 1, 2][rnk % 3 + 1] AS weight, source_size * 2 AS cap FROM ranked),
level AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget,
         COALESCE(sum(cap) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_,
         sum(weight) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM weighted),
capped AS (SELECT *, cap * rest <= (budget - before_) * weight AS is_capped FROM level),
targets AS (
  SELECT source, rnk, source_size, budget, CASE WHEN is_capped THEN CAST(cap AS DOUBLE) ELSE weight * (
    (budget - COALESCE(sum(cap) FILTER (WHERE is_capped) OVER (), 0)) / sum(weight) FILTER (WHERE NOT is_capped) OVER ()) END AS target
  FROM capped),
queued AS (
  SELECT s.doc_id, s.size, s.h, t.rnk, t.source_size, t.target, t.budget,
         sum(s.size) OVER (PARTITION BY t.rnk ORDER BY s.h, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS done
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
passes AS (
  SELECT *, (done + p * source_size) / target AS finish FROM queued, (VALUES (0), (1)) v(p) WHERE size > 0),
cut AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rnk, p, h, doc_id, size ROWS UNBOUNDED PRECEDING) AS so_far FROM passes),
chosen AS (SELECT doc_id, sum(size) AS got FROM cut WHERE so_far <= budget GROUP BY doc_id)
SELECT q.doc_id, CAST(q.size AS BIGINT) AS size, CAST(q.source_size AS BIGINT) AS source_size, q.target,
       CAST(COALESCE(c.got, 0) AS BIGINT) AS taken
FROM queued q LEFT JOIN chosen c ON c.doc_id = q.doc_id
"""
