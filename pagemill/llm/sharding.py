r"""Sharding whole groups of equal texts with near equal bytes, by Karmarkar-Karp differencing.

A task starts with one partial partition for each item and repeatedly combines the two of largest spread, one ordered
against the other, until one is left. To scale, groups are dealt by a hash into blocks of bounded size; each block is
differenced into as many bundles as there are shards, and the bundles are items of the next level. Groups that are
large against a shard, and a bounded hash sample of each level's items, are not bundled but handed up as they are, so
that the last level has items of every magnitude to even out what a huge indivisible group leaves.

Defined results: a null text has size 8 and groups with empty ones; ties and repeated rows share their group's shard;
a group larger than a shard's share is alone with what must join it; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm._common import hot_keys, join_by_key, kept, with_offsets

SHARDS = 24
BLOCK = 4096
#: Items that the last level takes in one task.
LAST = 16384
#: Of each level, about so many items go up unbundled; and every item above 1 / LARGE of a shard's share.
LOOSE = 2048
LARGE = 64
#: Parts that slots of a shard are counted in: so many at least, and as many more as hold about so many rows each.
SLOT_PARTS = 512
SLOT_ROWS = 65536


def difference(weights: list[int], k: int) -> list[int]:
    """Karmarkar-Karp: the part from 0 to k-1 of each of the weights."""
    heap: list[tuple] = []
    for i, w in enumerate(weights):
        heap.append((-w, i, [0] * (k - 1) + [w], [None] * (k - 1) + [i]))
    heapq.heapify(heap)
    seq = len(weights)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        sums = [x + y for x, y in zip(a, reversed(b), strict=True)]
        members = [y if x is None else x if y is None else (x, y) for x, y in zip(in_a, reversed(in_b), strict=True)]
        order = sorted(range(k), key=sums.__getitem__)
        least = sums[order[0]]
        sums = [sums[i] - least for i in order]
        heapq.heappush(heap, (-sums[-1], seq, sums, [members[i] for i in order]))
        seq += 1
    parts = [0] * len(weights)
    for part, tree in enumerate(heap[0][3] if heap else []):
        stack = [] if tree is None else [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                parts[x] = part
    return parts


def _assign(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["w", "level", "a", "b"], ascending=[False, True, True, True])
    return pdf.assign(part=difference([int(w) for w in pdf["w"]], k))


def shard_groups(groups: DataFrame, k: int = SHARDS, block: int = BLOCK, last: int = LAST) -> DataFrame:
    """a, b and shard of every group of ``groups`` (a, b: its key, w: its bytes)."""
    items = groups.select(F.lit(0).alias("level"), "a", "b", "w")
    levels: list[DataFrame] = []
    level, (n, total) = 0, items.agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0))).first()
    while n > last:
        level += 1
        chance = F.pmod(F.xxhash64("level", "a", "b", F.lit(level)), F.lit(n))
        up = (F.col("w") * (k * LARGE) > total) | (chance < LOOSE)
        dealt = items.withColumn("up", up).withColumn("block", F.pmod(F.xxhash64("b", "a", "level", F.lit(-level)), F.lit(-(-n // block))))
        bundled = dealt.where("not up").groupBy("block").applyInPandas(lambda pdf: _assign(pdf, k)[["level", "a", "b", "w", "block", "part"]], "level int, a bigint, b bigint, w bigint, block bigint, part int")
        bundled = kept(bundled)
        levels.append(bundled)
        bundles = bundled.groupBy("block", "part").agg(F.sum("w").alias("w"))
        items = kept(bundles.select(F.lit(level).alias("level"), F.col("block").alias("a"), F.col("part").cast("bigint").alias("b"), "w").unionByName(dealt.where("up").select("level", "a", "b", "w")))
        n = items.count()
    # at most ``last`` rows
    placed = items.groupBy().applyInPandas(lambda pdf: _assign(pdf, k)[["level", "a", "b", "part"]], "level int, a bigint, b bigint, part int").withColumnRenamed("part", "shard")
    placed = kept(placed) if levels else placed
    for i in range(len(levels), 0, -1):
        of_bundle = placed.where(F.col("level") == i).select(F.col("a").alias("block"), F.col("b").cast("int").alias("part"), "shard")
        placed = placed.where(F.col("level") < i).unionByName(levels[i - 1].join(of_bundle, ["block", "part"]).select("level", "a", "b", "shard"))
    return placed.select("a", "b", "shard")


def shard_documents(docs: DataFrame, k: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = kept(docs.select("doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")))
    groups = kept(rows.groupBy("a", "b").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")))
    total = groups.agg(F.sum("n")).first()[0] or 0
    parts = max(SLOT_PARTS, total // (k * SLOT_ROWS))
    # copies share their group: many of them are joined where they lie
    placed = join_by_key(rows, shard_groups(groups, k), ["a", "b"], hot_keys(groups, "n", total))
    placed = kept(placed.withColumn("deal", F.pmod(F.xxhash64("doc_id", "a"), F.lit(parts)).cast("int")))
    before = with_offsets(placed, ["shard"], "deal", F.lit(1), "earlier")
    nth = F.row_number().over(Window.partitionBy("shard", "deal").orderBy("doc_id", "a", "b"))
    out = placed.join(before, ["shard", "deal"]).withColumn("slot", (F.col("earlier") + nth - 1).cast("bigint"))
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")
