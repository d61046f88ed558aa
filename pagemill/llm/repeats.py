r"""Periodic runs of words in documents, found by their tandem repeats after Gusfield and Stoye, and collapsed to one period.

A square is a stretch of words followed at once by itself. Three steps find all squares whose half is not itself a
repetition, and from them the runs:

1. Lempel-Ziv blocks, each the longest stretch that also begins earlier. A square's leftmost occurrence has its right half in at most two
   blocks and crosses a boundary, so common extensions at the boundaries give squares of which every other leftmost one is a rotation to the right.
2. Walks in the suffix tree, which is held as suffix array and depths of common prefixes: from a square's place the suffix link drops
   the first word, and a child by that word, if there is one, is the next rotation. Rotations within one stretch are read off its length.
   A walk ends at a square that was met before. So the vocabulary of squares is complete.
3. A square's occurrences are the leaves below its place. Occurrences of one period that begin one word apart are one run.

Common extensions are compared by ranks of all stretches of 1, 2, 4, ... words, from whose last the suffix array is read.

Only runs of at least ``LEAST_PERIODS`` periods and ``LEAST_WORDS`` words are wanted. Every word of such a run occurs at
least so often in it, so words that occur less often in their document, and then in what is left between such words, can be in no run:
they part the document before any tree is built, and most documents need none. Several documents share one tree, with words and
separators of their own.

Documents are read whole, each in one task; memory is a few hundred bytes for each word left between the rare ones. Defined results:
null and empty texts have no runs and an empty collapsed text, as texts without words. Repeated rows and rows without an id
are treated one by one; equal texts give equal results. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_PERIODS = 4
LEAST_WORDS = 6
#: Words that share one tree, and bytes of text looked at together, unless one document has more.
TOGETHER = 1 << 17
TEXT_TOGETHER = 1 << 23
WORDS = r"[^\x20\x09-\x0D]+"


class SuffixTree:
    """The suffix tree of a sequence of numbers as suffix array and depths of common prefixes, with common extensions."""

    def __init__(self, seq: np.ndarray) -> None:
        n = len(seq)
        self.n = n
        ranks = [np.unique(seq, return_inverse=True)[1]]
        while ranks[-1].max() + 1 < n:
            step = 1 << (len(ranks) - 1)
            ahead = np.zeros(n, dtype=np.int64)
            ahead[: n - step] = ranks[-1][step:] + 1
            ranks.append(np.unique(ranks[-1].astype(np.int64) * (n + 1) + ahead, return_inverse=True)[1])
        self.at = np.empty(n, dtype=np.int64)
        self.at[ranks[-1]] = np.arange(n)
        # one more place, behind the end, equal to no other
        self.ranks = [np.append(r, -1).astype(np.int32) for r in ranks]
        self.words, self.rank = self.ranks[0], ranks[-1]
        depth = self.ahead(self.at[:-1], self.at[1:]).astype(np.int32)
        self.least = [depth]
        while 2 << (len(self.least) - 1) <= len(depth):
            last, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-half], last[half:]))

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from i and from j on; i and j differ."""
        a, b = np.array(i, dtype=np.int64), np.array(j, dtype=np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            step = (self.ranks[k][a] == self.ranks[k][b]).astype(np.int64) << k
            a += step
            b += step
        return a - i

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree before i and before j; i is less than j."""
        a, b = np.array(i, dtype=np.int64), np.array(j, dtype=np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            fits = a >= 1 << k
            same = fits & (self.ranks[k][np.where(fits, a - (1 << k), 0)] == self.ranks[k][np.where(fits, b - (1 << k), self.n)])
            step = same.astype(np.int64) << k
            a -= step
            b -= step
        return i - a

    def leaves(self, i: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last leaf below the place of the ``depth`` words from i on."""
        low, high = self.rank[i].astype(np.int64), self.rank[i].astype(np.int64)
        for k in range(len(self.least) - 1, -1, -1):
            table, size = self.least[k], 1 << k
            down = low >= size
            low = np.where(down & (table[np.where(down, low - size, 0)] >= depth), low - size, low)
            up = high + size <= self.n - 1
            high = np.where(up & (table[np.where(up, high, 0)] >= depth), high + size, high)
        return low, high

    def child(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first of the leaves low to high whose word at ``depth`` is ``word``, and whether there is one."""
        low, end = low.copy(), high + 1
        while (low < end).any():
            mid = (low + end) >> 1
            less = (low < end) & (self.words[np.minimum(self.at[np.minimum(mid, self.n - 1)] + depth, self.n)] < word)
            end = np.where((low < end) & ~less, mid, end)
            low = np.where(less, mid + 1, low)
        inside = low <= high
        found = inside & (self.words[np.minimum(self.at[np.minimum(low, self.n - 1)] + depth, self.n)] == word)
        return low, found

    def blocks(self) -> np.ndarray:
        """Where the Lempel-Ziv blocks begin."""
        n = self.n
        before, after = np.full(n + 2, n), np.full(n + 2, n)
        before[self.at[1:]], after[self.at[:-1]] = self.at[:-1], self.at[1:]
        left, right = before.tolist(), after.tolist()
        # taken out from the last on, a position's neighbours in suffix order are the nearest of those before it
        for i in range(n - 1, -1, -1):
            a, b = left[i], right[i]
            right[a] = b
            left[b] = a
        i = np.arange(n)
        longest = np.maximum(self.ahead(i, np.array(left[:n])), self.ahead(i, np.array(right[:n]))).tolist()
        starts, at = [], 0
        while at < n:
            starts.append(at)
            at += max(1, longest[at])
        return np.array(starts)


def _counting(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the numbers first[i], first[i] + 1, ..., count[i] of them, and i beside each."""
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]


def covering_squares(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of squares whose rotations to the right are all leftmost ones."""
    starts = tree.blocks()
    ends = np.append(starts[1:], tree.n)
    after = np.append(ends[1:], tree.n)
    # the right half crosses the end of its centre's block
    of, period = _counting(np.ones_like(starts), ends - starts)
    at = ends[of]
    from_ = at - period
    ok = tree.words[from_] == tree.words[at]
    at, period, from_ = at[ok], period[ok], from_[ok]
    on, back = tree.ahead(from_, at), tree.behind(from_, at)
    ok = (on > 0) & (on + back >= period)
    found = [(np.maximum(from_ - back, from_ - period + 1)[ok], period[ok])]
    # the left half crosses the start of the centre's block
    of, period = _counting(np.ones_like(starts), after - starts)
    at = starts[of]
    to = at + period
    ok = (at > 0) & (tree.words[np.maximum(at - 1, 0)] == tree.words[to - 1])
    at, period, to = at[ok], period[ok], to[ok]
    on, back = tree.ahead(at, to), tree.behind(at, to)
    ok = on + back >= period
    found.append((np.maximum(at - back, at - period)[ok], period[ok]))
    start, period = (np.concatenate(x) for x in zip(*found, strict=True))
    ok = _is_primitive(tree, start, period)
    return start[ok], period[ok]


def _is_primitive(tree: SuffixTree, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the half of each square is no repetition itself: tried by the period's prime factors."""
    ok = np.ones(len(start), dtype=bool)
    if not len(start):
        return ok
    factor = np.arange(period.max() + 1)
    for p in range(2, int(len(factor) ** 0.5) + 1):
        if factor[p] == p:
            part = factor[p * p :: p]
            part[part == np.arange(p * p, len(factor), p)] = p
    rest = period.copy()
    while (rest > 1).any():
        some = np.flatnonzero(rest > 1)
        p = factor[rest[some]]
        d = period[some] // p
        ok[some] &= tree.ahead(start[some], start[some] + d) < 2 * period[some] - d
        rest[some] //= p
    return ok


def vocabulary(tree: SuffixTree, start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First leaf and period of every square: the given ones and all that walks by suffix links reach from them."""
    n = tree.n
    met = np.empty(0, dtype=np.int64)
    while len(start):
        more = np.minimum(tree.ahead(start, start + period) - period, period - 1)
        of, at = _counting(start, more + 1)
        low, _ = tree.leaves(at, 2 * period[of])
        met = np.union1d(met, period[of] * (n + 1) + low)
        # where the stretch ends before all rotations were met, the next one may stand elsewhere
        go_on = more < period - 1
        last, period = (start + more)[go_on], period[go_on]
        low, high = tree.leaves(last + 1, 2 * period - 1)
        leaf, found = tree.child(low, high, 2 * period - 1, tree.words[last])
        key = np.unique((period * (n + 1) + leaf)[found])
        key = key[~np.isin(key, met, assume_unique=True)]
        period, leaf = key // (n + 1), key % (n + 1)
        start = tree.at[leaf]
    return met % (n + 1), met // (n + 1)


def runs_of(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of a sequence, two periods or longer."""
    if len(seq) < 2:
        return (np.empty(0, dtype=np.int64),) * 3
    tree = SuffixTree(seq)
    low, period = vocabulary(tree, *covering_squares(tree))
    _, high = tree.leaves(tree.at[low], 2 * period)
    of, leaf = _counting(low, high - low + 1)
    key = np.sort(period[of] * (tree.n + 1) + tree.at[leaf])
    if not len(key):
        return (np.empty(0, dtype=np.int64),) * 3
    first = np.flatnonzero(np.append(True, np.diff(key) != 1))
    last = np.append(first[1:], len(key)) - 1
    period, start = key[first] // (tree.n + 1), key[first] % (tree.n + 1)
    return start, key[last] - key[first] + 2 * period, period


def _crowded(codes: np.ndarray, least: int) -> np.ndarray:
    """The places whose words are frequent between places that are not: -1 marks those that cannot be in a run."""
    while True:
        gone = codes < 0
        stretch = np.cumsum(gone)
        keep = np.flatnonzero(~gone)
        key = stretch[keep] * (codes.max(initial=0) + 1) + codes[keep]
        _, of, count = np.unique(key, return_inverse=True, return_counts=True)
        rare = keep[count[of] < least]
        if not len(rare):
            return keep
        codes = codes.copy()
        codes[rare] = -1


def long_runs(documents: list[list[bytes]], least_periods: int = LEAST_PERIODS, least_words: int = LEAST_WORDS) -> list[np.ndarray]:
    """Rows (start, length, period) of the long runs of each document's words, by start, then period."""
    coded, base = [], 0
    for words in documents:
        frequent = {w: base + i for i, w in enumerate(w for w, n in Counter(words).items() if n >= least_periods)}
        base += len(frequent)
        coded.append(np.fromiter((frequent.get(w, -1) for w in words), dtype=np.int64, count=len(words)) if frequent else np.full(len(words), -1))
    # a gap after each document, so that no stretch passes its end
    bounds = np.cumsum([0, *[len(c) + 1 for c in coded]])
    codes = np.concatenate([x for c in coded for x in (c, [-1])]).astype(np.int64) if coded else np.empty(0, dtype=np.int64)
    place = _crowded(codes, least_periods)
    none = [np.empty((0, 3), dtype=np.int64)] * len(documents)
    if not len(place):
        return none
    # stretches are joined with separators that equal nothing
    breaks = np.flatnonzero(np.diff(place) > 1) + 1
    seq = np.insert(codes[place], breaks, base + np.arange(len(breaks)))
    origin = np.insert(place, breaks, -1)
    start, length, period = runs_of(seq)
    ok = length >= np.maximum(least_words, least_periods * period)
    start, length, period = origin[start[ok]], length[ok], period[ok]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    doc = np.searchsorted(bounds, start, side="right") - 1
    rows = np.stack([start - bounds[doc], length, period], axis=1)
    cuts = np.searchsorted(doc, np.arange(1, len(documents)))
    return np.split(rows, cuts)


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by single spaces, of each run its first period only."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(change)[:-1] == 0
    return b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


def _groups(texts: pd.Series) -> Iterator[list[list[bytes]]]:
    """Words of documents, so many together as may share a tree."""
    group, n, size = [], 0, 0
    for text in texts:
        words = text.split() if text is not None else []
        if group and (n + len(words) > TOGETHER or size + len(text or b"") > TEXT_TOGETHER):
            yield group
            group, n, size = [], 0, 0
        group.append(words)
        n, size = n + len(words), size + len(text or b"")
    if group:
        yield group


def _found(texts: pd.Series) -> pd.DataFrame:
    runs, left = [], []
    for group in _groups(texts):
        for words, rows in zip(group, long_runs(group), strict=True):
            runs.append([{"start": s, "length": n, "period": p} for s, n, p in rows.tolist()])
            left.append(collapsed(words, rows).decode())
    return pd.DataFrame({"runs": runs, "collapsed": left})


def collapse_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, in order) and the collapsed text of every row of ``docs`` (doc_id, text).

    Of each run only the first period stays; the words that stay are joined by single spaces.
    """
    find = F.pandas_udf(_found, "struct<runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>")
    rows = docs.select("doc_id", "text", find(F.col("text").cast("binary")).alias("found"))
    return rows.select("doc_id", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("bigint").alias("n_words"), "found.runs", "found.collapsed")


def repeated_on_purpose(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text), where one of ten documents repeats a stretch of its words up to its end, in whole and part.

    By h, the CRC-32 of the id as text, and g = floor(h / 10): if h ends in 0, word i from a = g % n on becomes the word
    a + (i - a) % p of the text, p = 1 + floor((n - a) / (3 + g % 8)). Texts without words and rows without an id stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False)) & F.col("text").isNotNull()
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(chosen, F.regexp_extract_all("text", F.lit(f"({WORDS})"), F.lit(1))).alias("words"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    places = F.sequence(F.lit(0).cast("bigint"), F.col("n").cast("bigint") - 1)
    turned = F.transform(places, lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def _more_periodic(a: Column, b: Column) -> Column:
    """Whether run ``a`` has the greater exact ratio of length to period than ``b``."""
    wide = lambda c: c.cast("decimal(19,0)")
    return wide(a["length"]) * wide(b["period"]) > wide(b["length"]) * wide(a["period"])


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of most periods, and hashes of all runs and of the collapsed text, of ``collapse_repeats``."""
    runs = F.col("runs")
    # runs are in order of start, then period: of equal ones the first stays
    best = F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, 0), lambda at, x: F.when(_more_periodic(x, at), x).otherwise(at))
    lines = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    told = F.when(F.size(runs) > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    rows = found.select("doc_id", F.size(runs).cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(told.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    milli = F.expr("(best.length * 1000) div best.period")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
