r"""Approximate nearest neighbours by cosine: inverted lists, product-quantised residuals, exact reranking.

Coarse centroids and the codebooks of the residuals' sub-vectors are fitted on a bounded hash sample with at least
``PER_LIST`` vectors for each list. How many lists a query must probe is measured: queries held out of the sample are
compared with all vectors, batch by batch, and enough lists are probed to meet most of their nearest ones.

Every vector is encoded and goes to the shard of its list; neighbouring lists share a shard of bounded size, a crowded
list is dealt over several by a hash. A query goes to the shards of the lists it probes and to no others, so what is
shuffled grows with the lists probed, not with all pairs of shards and queries. There it scores each probed list with
its table of inner products (asymmetric distances); the best ``DEPTH`` of a shard, and all that lie within the
quantisation error of the last of them, are reranked with the original vectors in double precision. A shard returns the
``k`` nearest of a query, so that a group of near copies is refined whole however large it is.

Defined results: vectors that are null, empty, zero, of another length than most, or that hold a null or non-finite
component take no part, nor do rows without a vec_id. Rows that share a vec_id are one candidate, with the vector of the
least hash. Ties go to the smaller vec_id. With fewer candidates than asked for, all are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm._common import kept

SAMPLE = 8192
#: Vectors of the sample that each list has at least; a larger table has a larger sample, or else no more lists.
PER_LIST = 32
#: Lists at most, which bounds the sample to PER_LIST times as many vectors.
LISTS = 4096
#: Vectors held out of the sample to measure by.
TESTS = 256
PARTS = 16
CODES = 256
ROUNDS = 8
#: Best candidates of a shard that are reranked, with those that may be as near as the last.
DEPTH = 100
#: Vectors of neighbouring lists that are searched in one task, and queries that ask them together.
SHARD = 16384
QUERY_BLOCK = 16384
#: Shards whose sizes may be joined by broadcast: 12 bytes each.
MOST_BROADCAST = 1 << 20
#: Queries that are scored together, and pairs that are reranked together: they bound a task's memory.
QUERY_BATCH = 256
EXACT_BATCH = 65536
#: Share of a held-out query's nearest that its probed lists must hold.
COVER = 0.98


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(1)
    parts = [(x[at : at + 4096] @ centres.T - half).argmax(1) for at in range(0, len(x), 4096)]
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        near = _closest(x, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


@dataclass(frozen=True)
class Index:
    """Coarse centroids, codebooks by part, the number of lists a query probes, and the error of its scores."""

    coarse: np.ndarray
    books: np.ndarray
    probes: int
    margin: float = 0.0

    def _split(self, x: np.ndarray) -> np.ndarray:
        parts, _, width = self.books.shape
        return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes of unit vectors."""
        lists = self._lists(x)
        rest = self._split(x - self.coarse[lists])
        codes = np.empty(rest.shape[:2], dtype=np.uint8)
        for p, book in enumerate(self.books):
            codes[:, p] = (rest[:, p] @ book.T - 0.5 * (book * book).sum(1)).argmax(1)
        return lists, codes

    def _lists(self, x: np.ndarray) -> np.ndarray:
        return _closest(x, self.coarse)

    def decode(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that lists and codes stand for."""
        rest = self.books[np.arange(codes.shape[1]), codes].reshape(len(codes), -1)
        return self.coarse[lists] + rest[:, : self.coarse.shape[1]]

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, lists: np.ndarray, codes: np.ndarray, vectors: np.ndarray, k: int, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query ids, vector ids and exact scores of the queries' nearest in one shard; both sides are as given.

        A query looks at the lists it probes; the best ``depth`` by its table of inner products, and all within the
        quantisation error of the last of them, are reranked.
        """
        for at in range(0, len(queries), QUERY_BATCH):
            asking = own[at : at + QUERY_BATCH]
            units = _unit(queries[at : at + QUERY_BATCH])
            near = units @ self.coarse.T
            # a row for each vector, so that a code's entries for all queries lie together
            score = np.ascontiguousarray(near.T)[lists]
            for table, code in zip(np.einsum("qpw,pcw->pcq", self._split(units), self.books), codes.T, strict=True):
                score += table[code]
            score[~np.ascontiguousarray(self.probed(near).T)[lists] | (ids[:, None] == asking)] = -9
            score = np.ascontiguousarray(score.T)
            good = score > -9
            if score.shape[1] > depth:
                last = np.partition(score, score.shape[1] - depth, axis=1)[:, score.shape[1] - depth]
                good &= score >= last[:, None] - self.margin
            q, v = np.nonzero(good)
            exact = np.empty(len(q))
            for lot in range(0, len(q), EXACT_BATCH):
                x, y = vectors[v[lot : lot + EXACT_BATCH]].astype(np.float64), queries[at + q[lot : lot + EXACT_BATCH]].astype(np.float64)
                # row sums do not depend on a row's place, so that equal vectors tie
                exact[lot : lot + EXACT_BATCH] = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
            best = np.lexsort((ids[v], -exact, q))
            q, v, exact = q[best], v[best], exact[best]
            top = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
            yield asking[q[top]], ids[v[top]], exact[top]

    def probed(self, near: np.ndarray) -> np.ndarray:
        """Which lists (columns) queries probe, by their products with the centroids."""
        out = np.zeros(near.shape, dtype=bool)
        best = np.argsort(-near, axis=1, kind="stable")[:, : self.probes]
        np.put_along_axis(out, best, True, axis=1)
        return out


def _unit(vectors: pd.Series | np.ndarray) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def dot(x: Column, y: Column) -> Column:
    """Inner product of two arrays of doubles."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, vector (doubles, scaled by a power of two so that squares stay finite) and norm of the rows that take part."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), v.alias("vector")).where("vec_id is not null and size(vector) > 0")
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(F.coalesce(good, F.lit(False)))
    rows = rows.groupBy("vec_id").agg(F.min_by("vector", F.xxhash64("vector")).alias("vector"))
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("vector") == (sizes.d if sizes else 0))
    rows = rows.withColumn("scale", F.pow(F.lit(2.0), -F.floor(F.log2(F.array_max(F.transform("vector", F.abs))))))
    rows = rows.select("vec_id", F.transform("vector", lambda x: x * F.col("scale")).alias("vector"))
    return rows.withColumn("norm", F.sqrt(dot(F.col("vector"), F.col("vector"))))


def fit(rows: DataFrame, total: int, sample: int = SAMPLE, k: int = 5) -> Index:
    """Fits an index for ``total`` vectors on a bounded hash sample of ``rows`` (vec_id, vector)."""
    lists = min(LISTS, 1 << math.ceil(math.log2(max(1, math.isqrt(total)))))
    wanted = max(sample, PER_LIST * lists) + TESTS
    h = F.xxhash64("vec_id")
    # twice the share that is wanted, so that no more than the sample need be sorted
    some = rows.where(h < F.lit(int(2.0**64 * 2 * wanted / total) - 2**63)) if total > 4 * wanted else rows
    picked = some.orderBy(h, "vec_id").limit(wanted).select("vec_id", F.col("vector").cast("array<float>").alias("vector")).toArrow().to_pandas()
    x = _unit(picked["vector"])
    held = min(TESTS, len(x) // 8)
    x, tests, own = x[: len(x) - held], x[len(x) - held :], picked["vec_id"].to_numpy()[len(x) - held :]
    rng = np.random.default_rng(3)
    coarse = _kmeans(x, max(1, min(len(x) // PER_LIST, lists)), rng)
    draft = Index(coarse, np.zeros((1, 1, x.shape[1]), dtype=np.float32), len(coarse))
    parts = min(PARTS, x.shape[1])
    width = -(-x.shape[1] // parts)
    rest = np.pad(x - coarse[draft._lists(x)], ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)
    books = np.zeros((parts, CODES, width), dtype=np.float32)
    for p in range(parts):
        found = _kmeans(rest[:, p], min(CODES, len(x)), rng)
        books[p, : len(found)] = found
        books[p, len(found) :] = found[0]
    index = Index(coarse, books, _probes(rows, draft, tests, own, k) if held else len(coarse))
    # both scores of a comparison may be off: the one that is too low and the one that is too high
    some = tests[:64] if held else x[:64]
    off = np.abs(some @ (x - index.decode(*index.encode(x))).T)
    return replace(index, margin=2 * float(np.quantile(off, COVER)))


def _probes(rows: DataFrame, index: Index, tests: np.ndarray, own: np.ndarray, k: int) -> int:
    """How far down its order of lists a held-out query must go to meet its k nearest of all ``rows``."""
    given = rows.sparkSession.sparkContext.broadcast((index, tests, own, np.argsort(np.argsort(-(tests @ index.coarse.T), axis=1), axis=1)))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, tests, own, ranks = given.value
        for pdf in batches:
            if len(pdf):
                x, ids = _unit(pdf["vector"]), pdf["vec_id"].to_numpy()
                scores = np.where(ids == own[:, None], -2, tests @ x.T)
                top = np.argpartition(-scores, min(k, len(x)) - 1, axis=1)[:, :k]
                at = np.repeat(np.arange(len(tests)), top.shape[1])
                yield pd.DataFrame({"test": at, "vec_id": ids[top.ravel()], "near": scores[at, top.ravel()].astype(np.float64), "nth": ranks[at, index._lists(x)[top.ravel()]]})

    found = rows.select("vec_id", "vector").mapInPandas(best, "test int, vec_id bigint, near double, nth int")
    first = F.row_number().over(Window.partitionBy("test").orderBy(F.desc("near"), "vec_id"))
    met = [r.nth for r in found.withColumn("first", first).where((F.col("first") <= k) & (F.col("near") > -2)).select("nth").collect()]
    return int(np.quantile(met, COVER, method="higher")) + 1 if met else len(index.coarse)


def shards_of(coarse: np.ndarray, sizes: dict[int, int], shard: int) -> dict[int, tuple[int, int]]:
    """For each list its first shard and how many it has: neighbouring lists share one, a crowded list has several.

    Lists are neighbours along the direction in which their centroids differ most.
    """
    lists = np.array(sorted(sizes))
    centred = coarse[lists] - coarse[lists].mean(0)
    along = centred @ np.linalg.svd(centred, full_matrices=False)[2][0]
    out, at, held = {}, -1, shard
    for one in lists[np.argsort(along, kind="stable")].tolist():
        parts = -(-sizes[one] // shard)
        if parts > 1 or held + sizes[one] > shard:
            at, held = at + 1, 0
        out[one] = (at, parts)
        if parts > 1:
            at, held = at + parts - 1, shard
        else:
            held += sizes[one]
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, depth: int = DEPTH, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of every row of ``vectors`` where ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = kept(usable(vectors))
    total = rows.count()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if total < 2:
        return spark.createDataFrame([], schema)
    index = spark.sparkContext.broadcast(fit(rows, total, k=k))
    # floats stay exact in single precision: they are scaled by a power of two only
    kind = np.float32 if dict(vectors.dtypes)["embedding"] == "array<float>" else np.float64

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                lists, codes = index.value.encode(_unit(pdf["vector"]))
                raw = [np.asarray(v, dtype=kind).tobytes() for v in pdf["vector"]]
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "asks": pdf["asks"], "list": lists.astype(np.int32), "code": [c.tobytes() for c in codes], "raw": raw})

    marked = rows.select("vec_id", "vector", F.coalesce(is_query, F.lit(False)).alias("asks"))
    coded = kept(marked.mapInPandas(encode, "vec_id bigint, asks boolean, list int, code binary, raw binary"))
    # one row a list
    sizes = dict(coded.groupBy("list").count().toArrow().to_pandas().itertuples(index=False, name=None))
    placed = spark.sparkContext.broadcast(shards_of(index.value.coarse, sizes, shard))
    n_shards = sum(parts for _, parts in placed.value.values())

    @F.pandas_udf("int")
    def shard_of(lists: pd.Series, dealt: pd.Series) -> pd.Series:
        first, parts = (np.array([placed.value[one][i] for one in lists], dtype=np.int64) for i in (0, 1))
        return pd.Series((first + dealt.to_numpy() % np.maximum(parts, 1)).astype(np.int32))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query goes to the shards of the lists it probes, once to each."""
        for pdf in batches:
            for at in range(0, len(pdf), QUERY_BATCH):
                some = pdf.iloc[at : at + QUERY_BATCH]
                x = np.frombuffer(b"".join(some["raw"]), dtype=kind).reshape(len(some), -1)
                wanted = np.zeros((len(some), n_shards), dtype=bool)
                for one, asking in enumerate(index.value.probed(_unit(x) @ index.value.coarse.T).T):
                    if one in placed.value and asking.any():
                        first, parts = placed.value[one]
                        wanted[asking, first : first + parts] = True
                q, at_shard = np.nonzero(wanted)
                yield pd.DataFrame({"vec_id": some["vec_id"].to_numpy()[q], "raw": some["raw"].to_numpy()[q], "shard": at_shard.astype(np.int32)})

    base = coded.withColumn("shard", shard_of("list", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 31))))
    asked = coded.where("asks").select("vec_id", "raw").mapInPandas(ask, "vec_id bigint, raw binary, shard int")
    # a shard that more queries ask than one task should hold is searched in several
    crowds = asked.groupBy("shard").count().where(F.col("count") > QUERY_BLOCK).select("shard", F.ceil(F.col("count") / QUERY_BLOCK).cast("int").alias("blocks"))
    # one row a shard: as many as the driver has placed
    crowds = kept(crowds)
    crowds = F.broadcast(crowds) if n_shards <= MOST_BROADCAST else crowds
    blocks = F.coalesce("blocks", F.lit(1))
    base = base.join(crowds, "shard", "left").withColumn("block", F.explode_outer(F.sequence(F.lit(0), blocks - 1)))
    asked = asked.join(crowds, "shard", "left").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(2)), blocks).cast("int"))

    def scan(base: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(base) and len(queries):
            codes = np.frombuffer(b"".join(base["code"]), dtype=np.uint8).reshape(len(base), -1)
            x, y = (np.frombuffer(b"".join(side["raw"]), dtype=kind).reshape(len(side), -1) for side in (base, queries))
            out = list(index.value.search(y, queries["vec_id"].to_numpy(), base["vec_id"].to_numpy(), base["list"].to_numpy(), codes, x, k, depth))
        q, v, score = (np.concatenate(c) for c in zip(*out, strict=True)) if out else ([], [], [])
        return pd.DataFrame({"query_id": np.asarray(q, dtype=np.int64), "vec_id": np.asarray(v, dtype=np.int64), "score": np.asarray(score, dtype=np.float64)})

    base = base.select("shard", "block", "vec_id", "list", "code", "raw")
    found = base.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(scan, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
