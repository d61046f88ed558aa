"""SimHash near-duplicates: 64-bit fingerprints, a vantage-point tree over them, and components of linked ones.

Fingerprints are computed in Arrow batches, equal ones are folded into one row before anything is compared. A
vantage-point tree is built from a bounded sample; it only decides how the distinct fingerprints are dealt into
shards, so results are exact whatever the sample. A fingerprint lives in one leaf. By the triangle inequality a link
of at most r bits between leaves can exist only where a distance to a vantage point lies within r of the split, and
only such fingerprints visit the other side. Each leaf yields a spanning forest of its links, never all pairs; the
forests are joined to components by alternating star contractions.

Defined results: null, empty and wordless texts have fingerprint zero and are linked like any other. Repeated rows
are linked through their equal fingerprints. A null doc_id never becomes a component id unless no other is there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm._common import hot_keys, join_by_key, kept

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Fingerprints looked at to place the vantage points, at least and at most; between, so many for each leaf.
SAMPLE = 4096
MOST_SAMPLED = 1 << 20
PER_LEAF = 16
LEAF = 512
#: Fingerprints that are routed through the tree together.
ROUTED = 1 << 20
#: Rows of one side that one comparing task takes; a larger leaf is compared block by block.
BLOCK = 4096


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text as a signed 64-bit number."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text, shingle):
        n += len(hashes)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of a text, repeats included, part by part; fewer words: the whole sequence; none: nothing."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1) if words else 0
    for at in range(0, n, 65536):
        part = words[at : min(n, at + 65536) + shingle - 1]
        hashes = [digest(b" ".join(x), SEED) for x in zip(*(part[i:] for i in range(shingle)), strict=False)] or [digest(b" ".join(words), SEED)]
        yield np.array(hashes, dtype="<u8")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to ``keep`` and fp (bigint) of every row."""

    @F.pandas_udf("bigint")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, shingle) for t in texts], dtype="int64")

    return docs.select("doc_id", *keep, simhash(F.col(text)).alias("fp"))


def _tree(sample: np.ndarray, depth: int, leaf: list[int]) -> tuple | int:
    """Nested (vantage point, split distance, inside, outside); a number is a leaf."""
    if depth > 0 and len(sample) >= 8:
        vantage = sample[0]
        d = np.bitwise_count(sample ^ vantage)
        split = int(np.median(d))
        if d.max() > split:
            return (int(vantage), split, _tree(sample[d <= split], depth - 1, leaf), _tree(sample[d > split], depth - 1, leaf))
    leaf[0] += 1
    return leaf[0] - 1


def _route(node: tuple | int, fps: np.ndarray, home: np.ndarray, radius: int, out: list) -> None:
    """Appends (leaf, fingerprints, whether they live there) for every leaf that the fingerprints reach."""
    if not len(fps):
        return
    if isinstance(node, int):
        out.append((node, fps, home))
        return
    vantage, split, inside, outside = node
    d = np.bitwise_count(fps ^ np.uint64(vantage)).astype(np.int16)
    # a link across the split is found by its inner end, which visits the outer side; visitors go wherever the bound allows
    to_in = (d <= split) | (~home & (d <= split + radius))
    to_out = (d > split) | (d > split - radius)
    _route(inside, fps[to_in], home[to_in], radius, out)
    _route(outside, fps[to_out], (home & (d > split))[to_out], radius, out)


def _forest(fps: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that connect what is within ``radius`` of each other; home ones are compared with all."""
    n = len(fps)
    order = np.argsort(~home, kind="stable")
    fps, residents = fps[order], int(home.sum())
    parent = np.arange(n)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for at in range(0, residents, 256):
        near = np.bitwise_count(fps[at : at + 256, None] ^ fps[None, at:]) <= radius
        rows, cols = np.nonzero(near)
        later = cols > rows
        rows, cols = rows[later] + at, cols[later] + at
        if len(rows) > 8 * 256:  # dense: links to the first neighbour of each column already connect most of them
            _, first = np.unique(cols, return_index=True)
            for i, j in zip(rows[first].tolist(), cols[first].tolist(), strict=True):
                a, b = find(i), find(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            roots = np.array([find(i) for i in range(n)])
            open_ = roots[rows] != roots[cols]
            pairs = np.unique(np.stack([roots[rows[open_]], roots[cols[open_]]]), axis=1)
            rows, cols = pairs[0], pairs[1]
        for i, j in zip(rows.tolist(), cols.tolist(), strict=True):
            a, b = find(i), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    roots = np.array([find(i) for i in range(n)], dtype=np.int64)
    linked = roots != np.arange(n)
    return fps[linked], fps[roots[linked]]


def links(distinct: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``, enough of them to connect all that are within ``radius`` bits."""
    spark = distinct.sparkSession
    total = distinct.count()
    # the tree grows with the table: leaves hold about as many fingerprints whatever its size
    depth = max(0, math.ceil(math.log2(max(1, total) / leaf)))
    wanted = min(MOST_SAMPLED, max(sample, PER_LEAF << depth))
    h = F.xxhash64("fp")
    some = distinct.where(h < F.lit(int(2.0**64 * 2 * wanted / total) - 2**63)) if total > 4 * wanted else distinct
    picked = some.select("fp").orderBy(h, "fp").limit(wanted).toArrow()["fp"].to_numpy() if depth else np.empty(0, dtype=np.int64)
    tree = spark.sparkContext.broadcast(_tree(np.array(picked, dtype=np.int64).view(np.uint64), depth, [0]))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []

        def routed() -> Iterator[pd.DataFrame]:
            out: list = []
            fps = np.concatenate(held).view(np.uint64)
            _route(tree.value, fps, np.ones(len(fps), dtype=bool), radius, out)
            leaves = np.repeat(np.array([n for n, _, _ in out], dtype=np.int32), [len(f) for _, f, _ in out])
            fps, homes = np.concatenate([f for _, f, _ in out]).view(np.int64), np.concatenate([x for _, _, x in out])
            for at in range(0, len(fps), 65536):
                yield pd.DataFrame({"leaf": leaves[at : at + 65536], "fp": fps[at : at + 65536], "home": homes[at : at + 65536]})

        for pdf in batches:
            held.append(pdf["fp"].to_numpy(np.int64))
            if sum(map(len, held)) >= ROUTED:
                yield from routed()
                held = []
        if sum(map(len, held)):
            yield from routed()

    dealt = kept(distinct.select("fp").mapInPandas(deal, "leaf int, fp bigint, home boolean"))
    # the leaves that need more than one block: those of fingerprints that crowd around one point. One row a leaf, of
    # which there are 2 * MOST_SAMPLED / PER_LEAF at most, so they are joined by broadcast, where the rows lie
    sizes = dealt.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("int")).alias("r")).where(F.col("n") > block)
    large = sizes.select("leaf", *[F.greatest(F.lit(1), F.ceil(F.col(c) / block)).cast("int").alias(name) for c, name in (("r", "nh"), ("n", "na"))])
    rows = dealt.join(F.broadcast(large), "leaf", "left").select("leaf", "fp", "home", *[F.coalesce(c, F.lit(1)).alias(c) for c in ("nh", "na")])
    salt = F.xxhash64("fp", F.lit(7))
    rows = rows.select("leaf", "fp", "home", "nh", "na", F.pmod(salt, "nh").cast("int").alias("bh"), F.pmod(salt, "na").cast("int").alias("ba"))
    # block (x, y) of a leaf compares its x-th part of residents with its y-th part of all rows
    residents = rows.where("home").select("leaf", "fp", F.lit(True).alias("home"), F.col("bh").alias("x"), F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("y"))
    everyone = rows.where("not home or nh > 1 or na > 1").select("leaf", "fp", F.lit(False).alias("home"), F.explode(F.sequence(F.lit(0), F.col("nh") - 1)).alias("x"), F.col("ba").alias("y"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = _forest(pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["home"].to_numpy(bool), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    found = residents.unionByName(everyone).groupBy("leaf", "x", "y").applyInPandas(compare, "a bigint, b bigint")
    return found.where("a <> b")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node reachable. Alternating star contractions."""
    stars = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    digest = lambda edges: edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = digest(stars)
    for _ in range(max_rounds):
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: every larger neighbour of a node is linked to the smallest of its neighbourhood
        least = kept(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
        # the centre of a star has many neighbours
        met = join_by_key(both, least.select("a", "m"), ["a"], hot_keys(least, "n", 2 * before[0]))
        large = kept(met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: a node and its smaller neighbours are linked to the smallest of them
        small = kept(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
        met = join_by_key(large, small.select("a", "m"), ["a"], hot_keys(small, "n", before[0]))
        stars = met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(small.select("a", F.col("m").alias("b"))).distinct()
        stars = kept(stars)
        now = digest(stars)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the star contractions did not settle")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))


def grouped(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``prints`` (doc_id, fp and others) with component_id and group: a fingerprint that names the component."""
    distinct = kept(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    roots = components(links(distinct, radius))
    linked = distinct.join(roots.union(roots.select("root", "root").distinct()), F.col("fp") == F.col("node"))
    named = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    member = linked.join(named, "root").select("fp", "component_id", F.col("root").alias("group"))
    ids = distinct.join(member, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("group", "fp").alias("group"))
    # copies share their fingerprint: many of them are joined where they lie
    return join_by_key(prints, ids, ["fp"], hot_keys(distinct, "n", distinct.agg(F.sum("n")).first()[0] or 0))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, text: str = "text") -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links of at most ``radius`` bits) of every row."""
    return grouped(kept(fingerprints(docs, text)), radius).select("doc_id", "fp", "component_id")


def first_of_group(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` (doc_id, text) of each near-duplicate group: that of the smallest doc_id, then text hash.

    Null ids come last, so a group in which no row has an id keeps one too. Of rows equal in both, any one stays.
    """
    text_hash = F.xxhash64("text")
    own = {name: name for name in ("none", "id", "hash")}
    while set(own.values()) & set(docs.columns):
        own = {name: f"{at}_" for name, at in own.items()}
    # a null id is 0 with a flag, so that the rows are found again by plain equality
    key = {own["none"]: F.col("doc_id").isNull(), own["id"]: F.coalesce("doc_id", F.lit(0)).cast("bigint"), own["hash"]: text_hash}
    rows = grouped(kept(fingerprints(docs.select("doc_id", "text", text_hash.alias("hash")), keep=("hash",))), radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias(own["none"]), F.coalesce("doc_id", F.lit(0)).cast("bigint").alias(own["id"]), F.col("hash").alias(own["hash"])))
    keep = rows.groupBy("group").agg(first.alias("first")).select("first.*")
    found = docs.withColumns(key).join(keep, list(key), "left_semi").dropDuplicates(list(key))
    return found.select(*docs.columns)
