"""Operator 13, a quality classifier by regularised quadratic discriminant.

Each whole text becomes a vector of FEATURES: its size, and shares of kinds of characters, words, lines and repeats, smoothed and put on scales on
which good texts lie close together. Labelled rows give each class its number, mean and covariance, summed within tasks and then over all of
them. A class covariance is shrunk towards the pooled one, and both towards their diagonal; its Cholesky factor is made once and goes with
the tasks. A score is the logistic of the difference of the classes' log densities, which are Mahalanobis distances by the factors, and of
the logarithms of the classes' shares.

Only the features and the label of learning rows enter the fit, and only the features a score. All learning rows count.

Cases: null and empty texts have the features of a text of nothing and a score; labels that are null or of no document are not learned from; a document with
several labels counts with each; labels other than 0 and 1 are not learned from; with one class only, all scores are 1 or 0 as that class is, and
without any 0.5; a class of few rows leans on the pooled covariance; a constant feature decides nothing; null ids and repeated rows are rows like others; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import cut, small_batches

FEATURES = [
    "chars", "words", "word_length", "word_spread", "letters", "upper", "digits", "stops", "symbols", "letterless", "short_words", "capitalised",
    "distinct_words", "top_word", "repeated_triples", "lines", "line_words", "repeated_lines", "letter_entropy",
]
#: Weight of the pooled covariance in a class's, and of the diagonal in either.
POOLED, DIAGONAL = 0.5, 0.1
#: Least variance of a feature that decides.
LEAST = 1e-9
THRESHOLD = 0.3
#: Odd numbers that mix three words' numbers into one of 64 bits.
MIX = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03], np.uint64)

LETTER, UPPER, DIGIT, STOP, SPACE, SYMBOL = range(6)
_KINDS: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """The kind of each character, made once a worker."""
    if not _KINDS:
        table = np.full(0x110000, SYMBOL, np.uint8)
        for code in range(0x110000):
            c = chr(code)
            if c.isalpha():
                table[code] = UPPER if c.isupper() else LETTER
            elif c.isdigit():
                table[code] = DIGIT
            elif c.isspace():
                table[code] = SPACE
        for c in ".,;:!?'\"()-":
            table[ord(c)] = STOP
        _KINDS.append(table)
    return _KINDS[0]


def share(part: float, whole: float, usual: float, weight: float = 20.0) -> float:
    """A share as an angle, as if `weight` more had been seen of which the usual part counts: little text says little."""
    return float(np.arcsin(np.sqrt((part + usual * weight) / (whole + weight))))


def features(text: str | None) -> list[float]:
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds()[codes]
    letters, upper, digits, stops, spaces, symbols = np.bincount(kind, minlength=6).tolist()
    letters += upper
    seen = letters + digits + stops + symbols
    # words are runs of anything but spaces
    ink = np.flatnonzero(np.diff((kind != SPACE).astype(np.int8), prepend=0, append=0))
    begin, size = ink[::2], np.diff(ink)[::2]
    n = len(size)
    with_letter = np.add.reduceat(kind <= UPPER, begin) if n else np.empty(0, np.int64)
    words = text.split()
    counts = Counter(words)
    number = dict(zip(counts, range(len(counts)), strict=True))
    at = np.fromiter(map(number.__getitem__, words), np.uint64, n)
    triples = len(np.unique((at[:-2] * MIX[0] + at[1:-1]) * MIX[1] + at[2:]))
    lines = [x for x in text.split("\n") if x.strip()]
    at_letters = np.bincount(codes[kind <= UPPER] & 0xFFF, minlength=1)
    p = at_letters[at_letters > 0] / max(1, letters)
    return [
        np.log(len(codes) + 100.0), np.log(n + 20.0), np.log((size.sum() + 100.0) / (n + 20.0)), np.log((size.var() * n if n else 0.0) + 160.0) - np.log(n + 20.0),
        share(letters, seen, 0.95), share(upper, letters, 0.03), share(digits, seen, 0.0), share(stops, seen, 0.03), share(symbols, seen, 0.0),
        share(n - np.count_nonzero(with_letter), n, 0.0), share(np.count_nonzero(size <= 3), n, 0.3), share(np.count_nonzero(kind[begin] == UPPER), n, 0.1),
        np.log((len(counts) + 20.0) / (n + 20.0)), share(max(counts.values(), default=0), n, 0.05), share(max(0, n - 2) - triples, n, 0.0),
        np.log1p(len(lines)), np.log((n + 20.0) / (len(lines) + 1.0)), share(len(lines) - len(set(lines)), len(lines), 0.0),
        (float(-(p * np.log2(p)).sum()) * letters + 4.0 * 200.0) / (letters + 200.0),
    ]


class Discriminant(NamedTuple):
    """What decides, for the classes 0 and 1: the features in use, the logarithm of each class's share, its mean, and the Cholesky factor of its covariance."""

    used: np.ndarray
    log_share: list[float]
    means: list[np.ndarray]
    factors: list[np.ndarray]

    @staticmethod
    def of(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant:
        """sums: for each class that has rows their number, the sum of their features and that of the features' products."""
        n = np.array([sums[k][0] if k in sums else 0 for k in (0, 1)], float)
        with np.errstate(divide="ignore"):
            log_share = np.log(n / max(1.0, n.sum())).tolist()
        if not n.all():
            return Discriminant(np.empty(0, np.int64), log_share, [], [])
        means = [sums[k][1] / n[k] for k in (0, 1)]
        spread = [sums[k][2] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
        shared = (n[0] * spread[0] + n[1] * spread[1]) / n.sum()
        used = np.flatnonzero(np.diag(shared) > LEAST)
        factors = []
        for k in (0, 1):
            own = ((1 - pooled) * spread[k] + pooled * shared)[np.ix_(used, used)]
            factors.append(np.linalg.cholesky((1 - diagonal) * own + diagonal * np.diag(np.diag(own))))
        return Discriminant(used, log_share, [m[used] for m in means], factors)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """How likely label 1 is, for rows of features."""
        if not self.factors:
            return np.full(len(x), 0.5 if self.log_share[0] == self.log_share[1] else float(self.log_share[1] == 0.0))
        density = []
        for log_share, mean, factor in zip(self.log_share, self.means, self.factors, strict=True):
            z = np.linalg.solve(factor, (x[:, self.used] - mean).T)
            density.append(log_share - 0.5 * (z * z).sum(0) - np.log(np.diag(factor)).sum())
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, features) of every text."""
    small_batches(docs.sparkSession, 4)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "features"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(of_batches, "doc_id long, features array<double>")


def fitted(labelled: DataFrame, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant:
    """The discriminant of rows label, features. Each task adds up its rows; the sums of all come to the driver, some hundred numbers a class."""
    d = len(FEATURES)

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {}
        for frame in frames:
            for label, part in frame.groupby("label"):
                x = np.vstack(part["features"].to_numpy())
                total[label] = total.get(label, 0.0) + np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        yield pd.DataFrame([(int(k), i, v) for k, values in total.items() for i, v in enumerate(values.tolist())], columns=["label", "place", "value"])

    rows = labelled.where("label in (0, 1)").select(F.col("label").cast("int").alias("label"), "features")
    parts = rows.mapInPandas(summed, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value")).collect()
    totals: dict[int, np.ndarray] = {}
    for row in parts:
        totals.setdefault(row.label, np.zeros(1 + d + d * d))[row.place] = row.value
    return Discriminant.of({k: (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for k, v in totals.items()}, pooled, diagonal)


def held_out(doc_id: Column) -> Column:
    """Rows that the fit never sees: crc32 of the id as text is divisible by 5. A null id is not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, learned from the rows of labels (id_col, label_col) that are not held out."""
    rows = cut(described(docs, id_col, text_col), "features")
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label")).where(~held_out(F.col("doc_id")))
    model = fitted(rows.join(known, "doc_id"))

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.vstack(frame["features"].to_numpy()) if len(frame) else np.empty((0, len(FEATURES)))
            score = model.scores(x)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "score": score, "predicted": (score >= threshold).astype(np.int32)})

    found = rows.mapInPandas(scored, "doc_id long, score double, predicted int")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
