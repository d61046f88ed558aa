r"""Best-fit packing with conflicts: bins ordered by residual carry bitmaps of their sources and duplicate clusters.

A document's words are cut into pieces of at most ``capacity`` words; whole pieces fill a bin, the last goes to the
tightest open bin that has room, holds no member of the same duplicate cluster, and fewer than ``max_per_source``
pieces of the same source. Residuals with open bins are the bits of one number: the successor of a size is its lowest
set bit above, and the search goes on from there while all bins of a residual conflict.

Documents are dealt into blocks of about ``block`` by a hash, and each block is packed in one task whose memory is
bounded by it; a hot source or cluster is spread over all blocks, as are the texts of rows without an id.

Defined results: null, empty and wordless texts give one row with part 0, no words and no bin. Repeated rows are
packed one by one and, as copies, into different bins. An empty table gives no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
MAX_PER_SOURCE = 4
BLOCK = 4096
SCHEMA = "doc_id bigint, part int, start bigint, n_words bigint, bin_id bigint, bin_start int"


class _Bins:
    """The bins of one block."""

    def __init__(self, capacity: int, max_per_source: int):
        self.capacity, self.most = capacity, max_per_source
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by residual
        self.some = 0  # bit r: a bin with residual r is open
        self.sources: list[list[int]] = []  # of a bin: bit s of plane i is set if it has more than i pieces of source s
        self.clusters: list[int] = []
        self.full_of: list[tuple[int, int]] = [(-1, -1)] * (capacity + 1)  # bits that all bins of a residual share

    def _add(self, b: int, residual: int) -> None:
        last = self.sources[b][-1]
        x, y = self.full_of[residual] if self.open[residual] else (-1, -1)
        self.full_of[residual] = (x & last, y & self.clusters[b])
        self.open[residual].append(b)
        self.some |= 1 << residual

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset of a piece; source and cluster are bits, cluster 0 if it has no copies here."""
        above = self.some >> size
        residual = size
        found = None
        while above:
            skip = (above & -above).bit_length() - 1
            residual += skip
            x, y = self.full_of[residual]
            if not (x & source or y & cluster):
                found = next((i for i, b in enumerate(self.open[residual]) if not (self.sources[b][-1] & source or self.clusters[b] & cluster)), None)
                if found is not None:
                    break
            above >>= skip + 1
            residual += 1
        if found is None:
            b, residual = len(self.sources), self.capacity
            self.sources.append([0] * self.most)
            self.clusters.append(0)
        else:
            b = self.open[residual].pop(found)
            if not self.open[residual]:
                self.some &= ~(1 << residual)
        plane = next(i for i, bits in enumerate(self.sources[b]) if not bits & source)
        self.sources[b][plane] |= source
        self.clusters[b] |= cluster
        if residual > size:
            self._add(b, residual - size)
        return b, self.capacity - residual


def pack_block(pdf: pd.DataFrame, capacity: int, max_per_source: int) -> pd.DataFrame:
    """Packs the rows (block, doc_id, none, size, source_hash, cluster) of one block; doc_id is 0 where ``none`` holds."""
    bins = _Bins(capacity, max_per_source)
    first = int(pdf["block"].iloc[0]) << 32
    sources = {s: 1 << i for i, s in enumerate(sorted(set(pdf["source_hash"])))}
    copies = pdf["cluster"].value_counts()
    clusters = {c: 1 << i for i, c in enumerate(sorted(copies[copies > 1].index))}
    rows: list[tuple] = []
    tails = []
    # whole numbers all the way: a column with a null would come as floating point
    ids = [None if none else i for i, none in zip(pdf["doc_id"].tolist(), pdf["none"].tolist(), strict=True)]
    for doc, size, source, cluster in zip(ids, pdf["size"].tolist(), pdf["source_hash"], pdf["cluster"], strict=True):
        whole, tail = divmod(size, capacity)
        rows += [(doc, i, i * capacity, capacity, None, 0) for i in range(whole)]
        if tail:
            tails.append((-tail, doc is None, doc or 0, whole, source, cluster))
        elif not whole:
            rows.append((doc, 0, 0, 0, None, None))
    tails.sort()
    packed = []
    for neg, none, doc, part, source, cluster in tails:
        b, at = bins.place(-neg, sources[source], clusters.get(cluster, 0))
        packed.append((None if none else doc, part, part * capacity, -neg, first + b, at))
    n = len(bins.sources)
    for doc, part, start, words, _, at in rows:
        if words:
            packed.append((doc, part, start, words, first + n, at))
            n += 1
        else:
            packed.append((doc, part, start, words, None, None))
    names = ("doc_id", "part", "start", "n_words", "bin_id", "bin_start")
    return pd.DataFrame({name: pd.array([row[i] for row in packed], dtype="Int64") for i, name in enumerate(names)})


def pack(docs: DataFrame, size: Column, cluster: Column, capacity: int = CAPACITY, max_per_source: int = MAX_PER_SOURCE, block: int = BLOCK) -> DataFrame:
    """One row per piece of every row of ``docs`` (doc_id, source): its words, its bin, and where in the bin it begins."""
    n = max(1, -(-docs.count() // block))
    rows = docs.select(
        F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("doc_id"), F.col("doc_id").isNull().alias("none"), size.cast("bigint").alias("size"), F.xxhash64("source").alias("source_hash"), cluster.alias("cluster"), F.pmod(F.xxhash64("doc_id", cluster, F.lit(5)), F.lit(n)).alias("block")
    )
    return rows.groupBy("block").applyInPandas(lambda pdf: pack_block(pdf, capacity, max_per_source), SCHEMA)


def copies_cluster(text: str = "text") -> Column:
    """Equal texts, but for letter case and white space, are one duplicate cluster."""
    return F.xxhash64(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+", " "))
