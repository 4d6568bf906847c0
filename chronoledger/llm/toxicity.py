"""Operator 3: toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in the set
of its words and word beginnings (stems); the document's is their noisy-or,
1 - prod(1 - p). Weights are trained from document labels alone, through the noisy-or, by full-batch Adam on a bounded
sample of labelled rows (``max_rows`` and ``max_words``, see ``common.sample_rows``; an id
with several labels counts as toxic if one says so). Every whole text is then scored in one pass, and the trained sentence
scores locate the offending sentences.

Inputs of a score are the words of the text, nothing else. Null and empty texts
have no sentence and score 0. A null id stays null and is never learned from;
repeated rows each get their row; without labels of both kinds every score is the
share of positive labels (0 without labels); an empty table gives an empty result;
other columns are ignored. Time grows with a text's length, memory with the longest
text (some 60 bytes a byte).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, id_and_text, map_arrow, sample_rows
from .words import ALNUM, SENTENCE_END, Words, byte_slices, find_words, fold32

#: Bounds of what is learned from: labelled rows, and words in all; a text of over a tenth of these words is not learned from.
MAX_ROWS, MAX_WORDS = 4000, 2_000_000
#: Features are kept whose share of positive bags is over so many times that of all bags.
SCREEN = 3.0
#: Weight of a positive bag in training, beside 1 of a negative one.
POSITIVE = 5.0
#: Lengths in bytes of the word beginnings that are features beside whole words.
STEMS = (4, 5, 6, 7)


def words_of(texts: list[bytes]) -> Words:
    return find_words(texts, ALNUM, prefixes=STEMS)


def features_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """32-bit features, and the word that each stands for."""
    parts = [(np.arange(len(words.hash)), words.hash), *words.prefixes]
    return np.concatenate([fold32(h) for _, h in parts]), np.concatenate([at for at, _ in parts])


def sentences_of(words: Words) -> np.ndarray:
    """The ordinal of each word's sentence, counted through all texts (breaks between texts count)."""
    return np.cumsum(SENTENCE_END[words.data], dtype=np.int32)[words.start]


@dataclass
class NoisyOr:
    """Sorted feature hashes with their weights, and the bias of a sentence."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    constant: float | None = None

    def sentence_logits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each sentence with words: its text, its ordinal and its logit."""
        sentence = sentences_of(words)
        first = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]]) if len(sentence) else np.zeros(0, dtype=np.int64)
        logit = np.full(len(first), self.bias)
        if len(self.features) and len(first):
            ordinal = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(sentence)]))
            feature, word = features_of(words)
            at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
            hit = self.features[at] == feature
            pair = np.unique(ordinal[word[hit]] * len(self.features) + at[hit])
            logit += np.bincount(pair // len(self.features), weights=self.weights[pair % len(self.features)], minlength=len(first))
        return words.text[first], sentence[first], logit

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        if self.constant is not None:
            return out + self.constant
        for i, j in byte_slices(texts):
            text, _, logit = self.sentence_logits(words_of(texts[i:j]))
            out[i:j] = -np.expm1(-np.bincount(text, weights=np.logaddexp(0, logit), minlength=j - i))
        return np.clip(out, 0.0, 1.0)

    def offending(self, text: str, at_least: float = 0.5) -> list[tuple[int, int, float]]:
        """Code-point spans of the sentences with probability ``at_least``, trimmed to their first and last word."""
        words = words_of([text.encode()])
        if self.constant is not None or not len(words.hash):
            return []
        sentence = sentences_of(words)
        chars = np.cumsum(words.data & 0xC0 != 0x80) - 1
        found = []
        for _, s, z in zip(*self.sentence_logits(words), strict=True):
            p = float(1 / (1 + np.exp(-z)))
            if p >= at_least:
                mine = np.flatnonzero(sentence == s)
                found.append((int(chars[words.start[mine[0]]]), int(chars[words.end[mine[-1]]]), p))
        return found


def _adam(gradient, size: int, rounds: int, rate: float, start: np.ndarray) -> np.ndarray:
    x, m, v = start.copy(), np.zeros(size), np.zeros(size)
    for t in range(1, rounds + 1):
        g = gradient(x)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def fit(bags: list[tuple[int, bytes, bytes]], rounds: int = 2000, rate: float = 0.15, penalty: float = 1e-7) -> NoisyOr:
    """Train from bags: label, packed 32-bit features, packed sentence ordinals. Features of few bags are left out."""
    labels = np.array([b[0] for b in bags], dtype=np.float64)
    if not len(labels) or labels.min() == labels.max():
        return NoisyOr(np.zeros(0, dtype=np.uint32), np.zeros(0), 0.0, float(labels.mean()) if len(labels) else 0.0)
    total = len(bags)
    least = max(2, min(5, total // 50), total // 400)

    def screened(in_bags: np.ndarray, in_positive: np.ndarray) -> np.ndarray:
        return (in_bags >= least) & (in_positive > SCREEN * labels.mean() * in_bags)

    # a first screening over hashed counts keeps the memory of the rest small; few features pass it
    narrow = np.uint16 if total < 1 << 16 else np.uint32
    in_bags, in_positive = np.zeros(1 << 24, dtype=narrow), np.zeros(1 << 24, dtype=narrow)
    for y, f, _ in bags:
        hit = np.unique(np.frombuffer(f, dtype=np.uint32) >> np.uint32(8))
        in_bags[hit] += 1
        in_positive[hit] += narrow(y)
    passed = screened(in_bags, in_positive)
    del in_bags, in_positive
    columns, keys, every = [], [], []
    for i, (_, f, s) in enumerate(bags):
        feature, key = np.frombuffer(f, dtype=np.uint32), np.int64(i) << 32 | np.frombuffer(s, dtype=np.int32)
        use = passed[feature >> np.uint32(8)]
        columns.append(feature[use])
        keys.append(key[use])
        every.append(np.unique(key))
    instances = np.concatenate(every)
    features, index = np.unique(np.concatenate(columns), return_inverse=True)
    row = np.searchsorted(instances, np.concatenate(keys))
    bag_of = instances >> 32
    del columns, keys, every, passed
    pair = np.unique(index * total + bag_of[row])
    kept = screened(np.bincount(pair // total, minlength=len(features)), np.bincount(pair // total, weights=labels[pair % total], minlength=len(features)))
    features, used = features[kept], kept[index]
    n = len(features)
    pair = np.unique(row[used] * n + (np.cumsum(kept) - 1)[index[used]])
    row, column = pair // max(n, 1), pair % max(n, 1)
    del index, used, pair

    def gradient(x: np.ndarray) -> np.ndarray:
        z = np.bincount(row, weights=x[column], minlength=len(instances)) + x[n]
        rise = np.logaddexp(0, z)
        mass = np.maximum(np.bincount(bag_of, weights=rise, minlength=total), 1e-9)
        pull = np.where(labels == 1, -POSITIVE / np.expm1(np.minimum(mass, 500)), 1.0)
        dz = pull[bag_of] * -np.expm1(-rise) / total
        return np.r_[np.bincount(column, weights=dz[row], minlength=n), dz.sum()] + np.r_[penalty * x[:n], 0]

    x = _adam(gradient, n + 1, rounds, rate, np.r_[np.zeros(n), -5.0])
    big = np.abs(x[:n]) > 0.02
    return NoisyOr(features[big], x[:n][big], float(x[n]))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 3, remainder: int = 1, max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS) -> NoisyOr:
    """Fit on at most ``max_rows`` labelled rows of at most ``max_words`` words, never on held-out ids."""
    marked = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    marked = marked.where(~held_out(F.col("doc_id"), modulus, remainder)).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def bag(batch: pa.RecordBatch):
        features, ordinals = [], []
        for t in batch.column(1).to_pylist():
            words = words_of([t])
            feature, word = features_of(words)
            features.append(feature.tobytes())
            ordinals.append(sentences_of(words)[word].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(features, pa.binary()), pa.array(ordinals, pa.binary())], names=["doc_id", "label", "features", "ordinals"])

    rows = sample_rows(id_and_text(df, id_col, text_col, "binary"), chosen, "label", max_words, ALNUM)
    found = map_arrow(rows, bag, "doc_id long, label int, features binary, ordinals binary").collect()  # max_rows rows of max_words words in all, at most
    bags = [(r["label"], bytes(r["features"]), bytes(r["ordinals"])) for r in sorted(found, key=lambda r: r["doc_id"])]
    return fit(bags)


def score(df: DataFrame, model: NoisyOr, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and score."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return map_arrow(id_and_text(df, id_col, text_col, "binary"), run, "doc_id long, score double")


def keep_clean(df: DataFrame, model: NoisyOr, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, with a score below the threshold. One pass, no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batch: pa.RecordBatch):
        texts = [(t or "").encode() for t in batch.column(at).to_pylist()]
        yield batch.filter(pa.array(shared.value.score(texts) < threshold))

    return map_arrow(df, run, df.schema)


def locate(df: DataFrame, model: NoisyOr, at_least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per offending sentence: doc_id, begin, end (code points, end exclusive), probability."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows = [(i, *span) for i, t in zip(ids, texts, strict=True) for span in shared.value.offending(t, at_least)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "begin", "end", "probability"])

    return map_arrow(id_and_text(df, id_col, text_col), run, "doc_id long, begin long, end long, probability double")


def toxicity(df: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", modulus: int = 3, remainder: int = 1) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 if score >= threshold)."""
    scored = score(df, train(df, labels, id_col, text_col, modulus=modulus, remainder=remainder), id_col, text_col)
    return scored.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
