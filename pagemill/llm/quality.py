"""Quality scores by regularised quadratic discriminant analysis of document statistics.

Each whole text gives a few statistics (sizes, shares of kinds of characters, how far words, pairs of words and lines
repeat), taken to log and log-odds scales so that they lie closer to normal. Both classes are described by a mean and a
covariance, shrunk twice: towards the pooled covariance, by as much as the class has few rows, and towards a multiple of
the identity by the oracle-approximating formula, after all statistics are scaled by their pooled spread. A text's score is
the logistic function of the difference of the two log densities: squared Mahalanobis distances by the inverse of
each class's Cholesky factor and the factor's log determinant, both computed once and kept with the model, plus the log
ratio of class sizes.

Fitting reads counts, sums and sums of products of the statistics of all labelled rows, a few hundred numbers per class
that Spark adds up; no row passes the driver, and no sample is taken. Statistics are computed once, written in the shared folder, and
read for fitting and for scoring.

Defined results: null texts count as empty; empty texts are scored like any other by their statistics. Labels that are
neither 0 nor 1, or null, are not learned from; a document with several labels has the mean of them, rounded half up. A
label whose document does not exist is not used. If no row of a class is labelled, every score is 0.5. Repeated rows are scored (and learned
from) one by one, rows without an id are scored and never learned from. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm._common import hot_keys, join_by_key, kept

#: Rows of a class at which its own covariance counts as much as the pooled one.
EVEN_ROWS = 200
#: Least share of the identity in a covariance: statistics may be constant.
LEAST_RIDGE = 1e-3
#: Kinds of bytes by their characters; bytes above 127 are letters or marks of other scripts.
_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "blank": b" \t\x0b\x0c\r",
    "line": b"\n",
    "stop": b".!?",
    "pause": b",;:'\"()-",
    "symbol": b"#$%&*@^~|<>[]{}=+_/\\`",
}
STATISTICS = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "stops", "pauses", "symbols", "other", "stops_by_word", "distinct_words", "distinct_pairs", "distinct_lines", "words_by_line",
    "capitalised", "wordlike",
)


def _table() -> np.ndarray:
    kinds = np.zeros(256, dtype=np.int64)
    kinds[128:] = 1
    for i, chars in enumerate(_KINDS.values()):
        kinds[list(chars)] = i + 2
    return kinds


_KIND_OF = _table()
_PLACE = {name: i + 2 for i, name in enumerate(_KINDS)}
#: What is left of a text when only letters are kept, to see how far words are made of letters alone.
_NO_MARKS = bytes(b for b in range(128) if not chr(b).isalnum() and b not in b" \t\n\x0b\x0c\r")


def _odds(part: float, whole: float) -> float:
    """Log-odds of a share, smoothed by half a count; 0 where there is nothing to count."""
    return float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5)))


def statistics(text: bytes | None) -> list[float]:
    """The transformed statistics of a whole UTF-8 text, in the order of ``STATISTICS``."""
    text = text or b""
    counts = np.bincount(_KIND_OF, weights=np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256), minlength=len(_KINDS) + 2)
    n = {name: float(counts[i]) for name, i in _PLACE.items()}
    other, high = float(counts[0]), float(counts[1])
    letters = n["upper"] + n["lower"] + high
    shown = float(len(text)) - n["blank"] - n["line"]
    words = text.split()
    m = len(words)
    lines = text.split(b"\n") if text else []
    plain = text.translate(None, _NO_MARKS).split()
    return [
        float(np.log1p(len(text))),
        float(np.log1p(m)),
        float(np.log1p(shown / m)) if m else 0.0,
        _odds(n["upper"], letters),
        _odds(n["digit"], shown),
        _odds(n["stop"], shown),
        _odds(n["pause"], shown),
        _odds(n["symbol"], shown),
        _odds(other, shown),
        _odds(min(n["stop"], m), m),
        _odds(len(set(words)), m),
        _odds(len(set(zip(words, words[1:], strict=False))), max(m - 1, 0)),
        _odds(len(set(lines)), len(lines)),
        float(np.log1p(m / len(lines))) if lines else 0.0,
        _odds(sum(w[:1].isupper() for w in words), m),
        _odds(len(plain), m),
    ]


@dataclass(frozen=True)
class Discriminant:
    """The fitted model: scales of the statistics and, per class, mean, inverse Cholesky factor and constant term."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, ...]
    inverse_factors: tuple[np.ndarray, ...]
    constants: tuple[float, ...]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of statistics: how likely class 1 is."""
        if not self.means:
            return np.full(len(x), 0.5)
        z = (x - self.centre) / self.scale
        logs = [c - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, c in zip(self.means, self.inverse_factors, self.constants, strict=True)]
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def shrunk(cov: np.ndarray, n: float) -> np.ndarray:
    """A covariance of ``n`` rows, shrunk towards a multiple of the identity by the oracle-approximating share."""
    p = len(cov)
    mean = np.trace(cov) / p
    square, trace = (cov**2).sum(), np.trace(cov) ** 2
    below = (n + 1 - 2 / p) * (square - trace / p)
    share = 1.0 if below <= 0 else min(1.0, ((1 - 2 / p) * square + trace) / below)
    share = max(share, LEAST_RIDGE)
    return (1 - share) * cov + share * max(mean, LEAST_RIDGE) * np.eye(p)


def fit_moments(moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Discriminant:
    """The model of per-class counts, sums and sums of products of statistics (classes 0 and 1)."""
    d = len(STATISTICS)
    if any(c not in moments or moments[c][0] < 1 for c in (0, 1)):
        return Discriminant(np.zeros(d), np.ones(d), (), (), ())
    means = [moments[c][1] / moments[c][0] for c in (0, 1)]
    scatter = [moments[c][2] - moments[c][0] * np.outer(m, m) for c, m in enumerate(means)]
    total = sum(moments[c][0] for c in (0, 1))
    pooled = sum(scatter) / total
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-12))
    scale[scale < 1e-6] = 1.0
    centre = sum(moments[c][1] for c in (0, 1)) / total
    by = np.outer(scale, scale)
    factors, constants, centred = [], [], []
    for c in (0, 1):
        n = moments[c][0]
        own = n / (n + EVEN_ROWS)
        cov = shrunk((own * scatter[c] / n + (1 - own) * pooled) / by, n)
        factor = np.linalg.cholesky(cov)
        factors.append(np.linalg.solve(factor, np.eye(d)))
        constants.append(float(np.log(n / total) - np.log(np.diag(factor)).sum()))
        centred.append((means[c] - centre) / scale)
    return Discriminant(centre, scale, tuple(centred), tuple(factors), tuple(constants))


def with_statistics(docs: DataFrame, out: str = "stats") -> DataFrame:
    """doc_id and the statistics of every text of ``docs`` (doc_id, text), as an array."""

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return docs.select("doc_id", measured(F.col("text").cast("binary")).alias(out))


def fit(rows: DataFrame) -> Discriminant:
    """Learns from ``rows`` (stats, label 0 or 1), all of them: tasks add up, and so does Spark, before anything is read."""
    d = len(STATISTICS)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {c: np.zeros(1 + d + d * d) for c in (0, 1)}
        for pdf in batches:
            label = pdf["label"].to_numpy()
            for c, sum_ in sums.items():
                x = pdf["stats"][label == c]
                if len(x):
                    x = np.stack(x.to_numpy())
                    sum_ += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
        for c, sum_ in sums.items():
            yield pd.DataFrame({"label": c, "at": np.arange(len(sum_)), "value": sum_})

    added = rows.select("stats", "label").mapInPandas(add_up, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value"))
    moments = {c: np.zeros(1 + d + d * d) for c in (0, 1)}
    for r in added.collect():  # two classes of 1 + d + d * d numbers
        moments[r.label][r.at] = r.value
    return fit_moments({c: (m[0], m[1 : 1 + d], m[1 + d :].reshape(d, d)) for c, m in moments.items()})


def held_out() -> Column:
    """Rows kept from fitting: crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def one_label(labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id and label of every labelled id: the mean of its labels, rounded half up."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    return usable.groupBy("doc_id").agg(F.floor(F.avg(label) + 0.5).cast("int").alias("label"))


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text).

    ``labels`` (doc_id and ``label``) are learned from only where the row is not held out. Statistics, not texts, are
    joined with labels; ids that repeat very often are joined where their rows lie.
    """
    measured = kept(with_statistics(docs.select("doc_id", "text")).withColumn("held_out", held_out()))
    train = measured.where(~F.col("held_out") & F.col("doc_id").isNotNull()).select("doc_id", "stats")
    counts = train.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    known = one_label(labels.select("doc_id", label), label)
    model = fit(join_by_key(train, known, ["doc_id"], kept(hot_keys(counts, "n", measured.count()))))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(stats: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(np.stack(stats.to_numpy())) if len(stats) else [], dtype="float64")

    scored = measured.select("doc_id", "held_out", score("stats").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
