"""Operator 10: quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - w.x): all grades share one weight vector
over hashed text features, and the thresholds are kept in order by construction.
A text gets its expected grade and the probability of a grade of at least
``select_from``, which selects it.

Features of a text: its words, the shapes of its white-space words (letter case,
ending, length) and coarse statistics of the whole (share of distinct words, of
capitals, of symbols), hashed into one table. Learned
from a bounded sample of rated rows (``max_rows``, ``max_words``, see
``common.sample_rows``; of an id's several ratings the lowest counts); every whole text
is scored in one pass.

Null and empty texts have only the statistics' features. A null id stays null and
is never learned from; repeated rows each get their row; without ratings of two
grades all texts get the mean grade (0 without ratings); an empty table gives an empty
result; other columns are ignored. Time grows with a text's length, memory with the
longest text (some 100 bytes a byte).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, id_and_text, map_arrow, sample_rows
from .words import ALNUM, NOT_SPACE, byte_class, byte_slices, find_words, mix

#: Bounds of what is learned from: rated rows, and words in all; a text of over a tenth of these words is not learned from.
MAX_ROWS, MAX_WORDS = 4000, 1_500_000
BITS = 18
#: Value of a statistic's feature, beside the unit length of all words.
STATISTIC = 0.3
_CAPITAL, _LETTER = byte_class((65, 90)), byte_class((65, 90), (97, 122), (128, 255))
_SALT = {name: np.uint64(i << 56) for i, name in enumerate(("word", "shape", "distinct", "repeat", "capital", "symbol", "size"))}


def _share(inside: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(inside[data])]
    return total[bounds[1:] - 1] - total[bounds[:-1]]


def vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: text, feature, value; words and shapes scaled to unit length, statistics with a value of their own."""
    words, tokens = find_words(texts, ALNUM), find_words(texts, NOT_SPACE, fold=False)
    n = len(texts)
    bounds = np.r_[words.text_start, len(words.data)]
    # shapes: class of the first byte, class of the last two, capitals only, length
    kind = np.zeros(256, dtype=np.int64)
    kind[48:58], kind[97:123], kind[65:91], kind[128:] = 1, 2, 3, 4
    symbols = np.flatnonzero((kind == 0) & (np.arange(256) > 32))
    kind[symbols] = 5 + np.arange(len(symbols))
    first, last = kind[tokens.data[tokens.start]], kind[tokens.data[tokens.end - 1]]
    second = np.where(tokens.end - tokens.start > 1, kind[tokens.data[np.maximum(tokens.end - 2, 0)]], 0)
    capitals = np.r_[0, np.cumsum(_CAPITAL[tokens.data])]
    letters = np.r_[0, np.cumsum(_LETTER[tokens.data])]
    shout = (capitals[tokens.end] - capitals[tokens.start] == letters[tokens.end] - letters[tokens.start]).astype(np.int64)
    length = np.minimum(np.log2(tokens.end - tokens.start).astype(np.int64), 6)
    shape = (((first * 64 + last) * 64 + second) * 2 + shout) * 8 + length

    size = np.bincount(words.text, minlength=n)
    order = np.lexsort((words.hash, words.text))
    fresh = np.r_[True, (words.hash[order][1:] != words.hash[order][:-1]) | (words.text[order][1:] != words.text[order][:-1])] if len(order) else np.zeros(0, dtype=bool)
    distinct = np.bincount(words.text[order][fresh], minlength=n)
    again = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1]))
    repeat = np.bincount(words.text[again], minlength=n)
    width = np.maximum(np.diff(bounds) - 1, 1)
    symbol = np.zeros(256, dtype=bool)
    symbol[symbols] = True
    whole = [("repeat", 20 * repeat // np.maximum(size, 1)), ("distinct", 10 * distinct // np.maximum(size, 1)), ("capital", 20 * _share(_CAPITAL, words.data, bounds) // width), ("symbol", 20 * _share(symbol, words.data, bounds) // width), ("size", np.log2(size + 1).astype(np.int64))]

    text = np.concatenate([words.text, tokens.text])
    raw = np.concatenate([words.hash, mix(shape.astype(np.uint64) ^ _SALT["shape"])])
    key, count = np.unique(text.astype(np.int64) << BITS | (raw >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(key >> BITS, weights=value * value, minlength=n))
    stats = [np.arange(n) << BITS | (mix(v.astype(np.uint64) ^ _SALT[k]) >> np.uint64(64 - BITS)).astype(np.int64) for k, v in whole]
    value = np.concatenate([value / norm[key >> BITS], np.full(n * len(whole), STATISTIC)])
    key = np.concatenate([key, *stats])
    return key >> BITS, key & (1 << BITS) - 1, value


@dataclass
class Ordinal:
    """Shared weights and ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray
    constant: float | None = None

    def latent(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, j in byte_slices(texts):
            text, feature, value = vectors(texts[i:j])
            out[i:j] = np.bincount(text, weights=self.weights[feature] * value, minlength=j - i)
        return out

    def grades(self, texts: list[bytes], select_from: int) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and P(grade >= select_from)."""
        if self.constant is not None:
            return np.full(len(texts), self.constant), np.full(len(texts), float(self.constant >= select_from))
        over = 1 / (1 + np.exp(self.thresholds[None] - self.latent(texts)[:, None]))
        return over.sum(axis=1), over[:, select_from - 1] if select_from > 0 else np.ones(len(texts))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], grades: int, rounds: int = 400, rate: float = 0.3, penalty: float = 3e-6) -> Ordinal:
    """Maximum penalised likelihood from (grade, features, values) by full-batch Adam."""
    grade = np.array([r[0] for r in rows], dtype=np.int64)
    if len(np.unique(grade)) < 2:
        return Ordinal(np.zeros(1 << BITS), np.zeros(grades - 1), float(grade.mean()) if len(grade) else 0.0)
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    used, column = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
    value = np.concatenate([r[2] for r in rows]).astype(np.float64)
    n, k, total = len(used), grades - 1, len(rows)
    share = np.clip(np.searchsorted(np.sort(grade), np.arange(1, grades)) / total, 0.01, 0.99)
    start = np.log(share / (1 - share))
    gap = np.maximum(np.diff(start), 0.1)
    x = np.r_[np.zeros(n), start[0], np.log(np.expm1(gap))]
    m, v = np.zeros_like(x), np.zeros_like(x)

    def sigma(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    for t in range(1, rounds + 1):
        steps = np.logaddexp(0, x[n + 1 :])
        theta = x[n] + np.r_[0, np.cumsum(steps)]
        s = np.bincount(row, weights=x[column] * value, minlength=total)
        bound = np.r_[-np.inf, theta, np.inf]
        upper, lower = sigma(bound[grade + 1] - s), sigma(bound[grade] - s)
        upper[grade == k], lower[grade == 0] = 1.0, 0.0
        chance = np.maximum(upper - lower, 1e-12)
        ds = -(upper + lower - 1) / total
        dtheta = np.zeros(k)
        np.add.at(dtheta, np.minimum(grade, k - 1), np.where(grade < k, -upper * (1 - upper) / chance, 0) / total)
        np.add.at(dtheta, np.maximum(grade - 1, 0), np.where(grade > 0, lower * (1 - lower) / chance, 0) / total)
        dsteps = np.cumsum(dtheta[::-1])[::-1][1:] * sigma(x[n + 1 :])
        g = np.r_[np.bincount(column, weights=ds[row] * value, minlength=n) + penalty * x[:n], dtheta.sum(), dsteps]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(1 << BITS)
    weights[used] = x[:n]
    return Ordinal(weights, x[n] + np.r_[0, np.cumsum(np.logaddexp(0, x[n + 1 :]))])


def train(df: DataFrame, ratings: DataFrame, grade: Column, grades: int, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, remainder: int = 0, max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS) -> Ordinal:
    """Fit on at most ``max_rows`` rated rows; ``grade`` is an expression over the ratings, 0 to grades - 1."""
    rated = ratings.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), grade.cast("int").alias("grade")).where(F.col("doc_id").isNotNull() & F.col("grade").between(0, grades - 1))
    rated = rated.where(~held_out(F.col("doc_id"), modulus, remainder)).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def row(batch: pa.RecordBatch):
        found = [vectors([t])[1:] for t in batch.column(1).to_pylist()]
        features, values = ([x.astype(t).tobytes() for x in column] for column, t in zip(zip(*found, strict=True), (np.int32, np.float32), strict=True)) if found else ([], [])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(features, pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "grade", "features", "scaled"])

    rows = sample_rows(id_and_text(df, id_col, text_col, "binary"), chosen, "grade", max_words, ALNUM)
    found = map_arrow(rows, row, "doc_id long, grade int, features binary, scaled binary").collect()  # max_rows rows of max_words words in all, at most
    table = [(r["grade"], np.frombuffer(bytes(r["features"]), dtype=np.int32), np.frombuffer(bytes(r["scaled"]), dtype=np.float32)) for r in sorted(found, key=lambda r: r["doc_id"])]
    return fit(table, grades)


def quality(df: DataFrame, ratings: DataFrame, grade: Column, grades: int, select_from: int = 1, at_least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, remainder: int = 0) -> DataFrame:
    """Per row: doc_id, held_out, expected_grade, tail_probability (of a grade >= select_from), kept (tail_probability >= at_least)."""
    model = train(df, ratings, grade, grades, id_col, text_col, modulus, remainder)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        expected, tail = shared.value.grades(batch.column(1).to_pylist(), select_from)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected, pa.float64()), pa.array(tail, pa.float64())], names=["doc_id", "expected_grade", "tail_probability"])

    scored = map_arrow(id_and_text(df, id_col, text_col, "binary"), run, "doc_id long, expected_grade double, tail_probability double")
    return scored.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= at_least).alias("kept"))
