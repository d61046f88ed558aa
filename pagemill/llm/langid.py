"""Language identification by bit-sliced Bloom filters of character n-grams.

The filter is an array of 64-bit words; bit l of a word belongs to language l. An n-gram sets its language's bit in a
few words, so one AND over these words returns all languages that hold it. A text's n-grams are looked up at once,
counted per language, and each count is corrected for the share of false positives that the filter's fill predicts.

Fitting takes a bounded sample of labelled rows (``max_docs`` per language, chosen by a hash of id and text); the n-grams a
language keeps are those in at least ``min_share`` of its sampled documents, which bounds the model. Prediction reads
nothing but the text, whole.

Defined results: null, empty and letterless texts give ``und`` with score 0, as do all texts if no row is labelled.
Ties go to the language that sorts first.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm._common import kept

MAX_DOCS = 2000
MIN_SHARE = 0.02
ORDERS = (3, 4)
HASHES = 3
BITS_PER_GRAM = 16
UND = "und"
CHUNK = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def grams(text: str, orders: tuple[int, ...] = ORDERS) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of letters and single word gaps, part by part; texts without a letter give nothing.

    A part begins with the last symbols of the one before, so that n-grams do not depend on where the parts are cut.
    """
    letters = _letters()
    text = text.lower()
    seq = np.array([32], dtype=np.uint64)
    for at in range(0, len(text), CHUNK):
        u = np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        u = np.concatenate([np.where(letters[u], u, np.uint32(32)), np.full(int(at + CHUNK >= len(text)), 32, dtype=np.uint32)])
        gap = u == 32
        before = np.concatenate([[seq[-1] == 32], gap[:-1]])
        old = len(seq)
        seq = np.concatenate([seq, u[~(gap & before)].astype(np.uint64)])
        inner = seq != 32
        for n in orders:
            start = max(0, old - n + 1)
            m = len(seq) - n + 1 - start
            if m < 1:
                continue
            h = np.full(m, n, dtype=np.uint64)
            ok = np.ones(m, dtype=bool)
            for i in range(n):
                h = h * np.uint64(0x100000001B3) + seq[start + i : start + i + m]
                if 0 < i < n - 1:
                    ok &= inner[start + i : start + i + m]
            yield _mix(h[ok])
        seq = seq[-(max(orders) - 1) :]


@dataclass(frozen=True)
class LanguageFilter:
    """The fitted filter: languages by bit, words, and each language's rate of false positives."""

    languages: tuple[str, ...]
    words: np.ndarray  # one row per 64 languages
    false_rate: np.ndarray

    def places(self, h: np.ndarray) -> Iterator[np.ndarray]:
        size = np.uint64(self.words.shape[1])
        step = (h >> np.uint64(32)) | np.uint64(1)
        for i in range(HASHES):
            yield ((h + np.uint64(i) * step) % size).astype(np.int64)

    def count(self, text: str) -> tuple[np.ndarray, int]:
        """n-grams of the text found per language, and their number."""
        hits, n = np.zeros(len(self.languages), dtype=np.int64), 0
        for h in grams(text):
            n += len(h)
            places = list(self.places(h))
            for row, words in enumerate(self.words):
                mask = words[places[0]]
                for p in places[1:]:
                    mask = mask & words[p]
                for bit in range(min(64, len(self.languages) - 64 * row)):
                    hits[64 * row + bit] += int(((mask >> np.uint64(bit)) & np.uint64(1)).sum())
        return hits, n

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return UND, 0.0
        hits, n = self.count(text)
        if not n:
            return UND, 0.0
        true = np.clip((hits - n * self.false_rate) / (1 - self.false_rate), 0, n)
        best = int(np.argmax(true))
        return self.languages[best], float(true[best] / n)


def build_filter(found: list[tuple[str, int]]) -> LanguageFilter:
    """The filter of (language, n-gram hash) pairs."""
    languages = tuple(sorted({lang for lang, _ in found}))
    of = {lang: i for i, lang in enumerate(languages)}
    most = max(Counter(lang for lang, _ in found).values(), default=1)
    size = 1 << max(10, (most * BITS_PER_GRAM - 1).bit_length())
    words = np.zeros((max(1, -(-len(languages) // 64)), size), dtype=np.uint64)
    out = LanguageFilter(languages, words, np.zeros(len(languages)))
    for lang in languages:
        row, bit = divmod(of[lang], 64)
        for p in out.places(np.array([h for x, h in found if x == lang], dtype=np.int64).view(np.uint64)):
            words[row, p] |= np.uint64(1 << bit)
    fill = [((words[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))]
    return LanguageFilter(languages, words, np.minimum(0.99, np.array(fill) ** HASHES))


def fit(docs: DataFrame, train: Column, max_docs: int = MAX_DOCS, min_share: float = MIN_SHARE) -> LanguageFilter:
    """Learns from text and non-null lang of the rows where ``train`` holds, about ``max_docs`` of each language at most."""
    usable = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return build_filter([])
    cuts = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, max_docs / n))])
    # of id and text, so that rows without an id are sampled one by one too
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.where(chance < F.element_at(cuts, F.col("lang"))).select("lang", "text")

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, Counter] = {}
        docs_of: Counter = Counter()
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                parts = list(grams(text))
                if parts:
                    docs_of[lang] += 1
                    seen.setdefault(lang, Counter()).update(np.unique(np.concatenate(parts)).view(np.int64).tolist())
        for lang, counts in seen.items():
            yield pd.DataFrame({"lang": lang, "gram": pd.array([*counts, None], dtype="Int64"), "n": [*counts.values(), docs_of[lang]]})

    counts = sample.mapInPandas(tally, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = kept(counts)
    totals = {r.lang: r.n for r in counts.where("gram is null").collect()}
    if not totals:
        return build_filter([])
    least = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, max(1.0, min_share * n))])
    # at most (n-grams of a document) / min_share rows per language
    found = counts.where(F.col("gram").isNotNull() & (F.col("n") >= F.element_at(least, F.col("lang")))).collect()
    return build_filter([(r.lang, r.gram) for r in found])


def predict(docs: DataFrame, model: LanguageFilter, out: str) -> DataFrame:
    """The rows of ``docs`` with the column ``out``, a struct of lang_pred and score; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def identify(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return docs.withColumn(out, identify("text"))


def held_out() -> Column:
    """Rows kept from fitting: crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; the held-out rows take no part in fitting."""
    model = fit(docs.select("doc_id", "text", "lang"), ~held_out())
    rows = predict(docs.select("doc_id", "text"), model, "found")
    return rows.select("doc_id", held_out().alias("held_out"), "found.lang_pred", "found.score")


def of_known_language(docs: DataFrame, model: LanguageFilter, least: float) -> DataFrame:
    """The rows of ``docs`` whose text is of a learned language with at least the score ``least``."""
    out = "found"
    while out in docs.columns:
        out += "_"
    rows = predict(docs, model, out)
    return rows.where((F.col(out)["lang_pred"] != UND) & (F.col(out)["score"] >= least)).select(*docs.columns)
