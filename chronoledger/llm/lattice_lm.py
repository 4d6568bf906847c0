"""Operator 5: language-model scores by a subword lattice.

The model is a unigram model over the pieces of an existing vocabulary (and single
bytes, so that every text has a segmentation). A text is its words, each with a word
mark before it, then one end. Its probability is the sum over all segmentations;
since no piece crosses a word mark, it is the product of the words' sums, and each
word's sum comes from a forward recursion in log space over its lattice.

The piece probabilities start from the vocabulary's own scores. A vocabulary with log
probabilities would give them as they are; the one at hand is of merges and scores its
pieces by rank, which are read as a Zipf law. They are fitted to the training words by expectation-maximisation over the
table of distinct words with their counts. That table is counted over all training
texts; it is kept in the shared checkpoint folder, since several steps read it.

Counts go back to the texts in two exact ways: words of high count, at most
``frequent`` of them, through a broadcast; all others by a join on the word.

Null text counts as empty (its only token is the end); a null id is scored but its
remainder is that of the empty string; repeated rows each get their row; without
training texts N and V are 0 and the pieces keep their first probabilities; an empty
table gives an empty result; other columns are ignored. Time grows with a text's length;
a long word takes some microseconds and 20 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, id_and_text, pieces
from .words import byte_slices, mix

MARK = "▁".encode()
#: Most words whose counts are broadcast, words that a worker counts before it hands them on, and other words whose sums it remembers.
FREQUENT, HELD_WORDS, MEMORY = 150_000, 250_000, 150_000
#: Bytes from which a word's recursion goes along stretches of its edges, and starts in a stretch.
LONG_WORD, STRETCH = 2000, 20_000
#: Bytes of text scored at a time; bounds a worker's memory.
SCORED_BYTES = 4_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Lattice:
    """Segmentations of words into pieces or single bytes. Piece numbers: the pieces, 256 bytes, the end, none."""

    def __init__(self, pieces: list[bytes]):
        self.n_pieces = len(pieces)
        self.end = self.n_pieces + 256
        self.none = self.end + 1
        self.lengths = sorted({len(p) for p in pieces} - {0})
        hashes = np.array([self._hashes(np.frombuffer(p, dtype=np.uint8)[None], len(p))[0, 0] for p in pieces], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.number = hashes[order], order.astype(np.int32)
        slots = (self.hashes >> np.uint64(44)).astype(np.int64)
        self.first = np.full(1 << 20, -1, dtype=np.int32)  # by a hash's upper bits, the first of its pieces in order
        self.first[slots[::-1]] = np.arange(len(slots) - 1, -1, -1, dtype=np.int32)
        self.shared = int(np.unique(slots, return_counts=True)[1].max(initial=0))  # most pieces of one slot

    def _look_up(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash."""
        found = np.full(h.shape, self.none, dtype=np.int32)
        place = self.first[(h >> np.uint64(44)).astype(np.int64)].ravel()
        at = np.flatnonzero(place >= 0)
        sought, place = h.ravel()[at], place[at]
        for _ in range(self.shared):
            same = self.hashes[place] == sought
            found.ravel()[at[same]] = self.number[place[same]]
            at, sought, place = at[~same], sought[~same], place[~same] + 1
            inside = place < len(self.hashes)
            at, sought, place = at[inside], sought[inside], place[inside]
            if not len(at):
                break
        return found

    @staticmethod
    def _hashes(block: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all substrings of k bytes of equally long rows."""
        n, size = block.shape
        up, down = _powers(size + 1)
        total = np.zeros((n, size + 1), dtype=np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * up[:size], axis=1, out=total[:, 1:])
        return mix((total[:, k:] - total[:, :-k]) * down[: size - k + 1] + np.uint64(k))

    def edges(self, block: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(length, piece at each start) for all lengths; length 1 first, where a byte stands in for a missing piece."""
        n, size = block.shape
        up, down = _powers(size + 1)
        total = np.zeros((n, size + 1), dtype=np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * up[:size], axis=1, out=total[:, 1:])
        out = [(1, self.n_pieces + block.astype(np.int32))]
        for k in self.lengths:
            if k > size:
                break
            h = mix((total[:, k:] - total[:, :-k]) * down[: size - k + 1] + np.uint64(k))
            found = self._look_up(h)
            if (found != self.none).any():
                out.append((k, found))
        return out

    @staticmethod
    def _sum(terms: list[np.ndarray]) -> np.ndarray:
        stack = np.stack(terms)
        top = stack.max(axis=0)
        return top + np.log(np.exp(stack - top).sum(axis=0))

    def forward(self, edges: list[tuple[int, np.ndarray]], weights: list[np.ndarray], size: int) -> np.ndarray:
        alpha = np.zeros((weights[0].shape[0], size + 1))
        for t in range(1, size + 1):
            alpha[:, t] = self._sum([alpha[:, t - k] + w[:, t - k] for (k, _), w in zip(edges, weights, strict=True) if k <= t])
        return alpha

    def backward(self, edges: list[tuple[int, np.ndarray]], weights: list[np.ndarray], size: int) -> np.ndarray:
        beta = np.zeros((weights[0].shape[0], size + 1))
        for t in range(size - 1, -1, -1):
            beta[:, t] = self._sum([beta[:, t + k] + w[:, t] for (k, _), w in zip(edges, weights, strict=True) if k <= size - t])
        return beta

    def stretches(self, data: bytes, backward: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Edges of one long marked word: of every stretch of starts its bounds and, by start, start, length and piece."""
        n, longest = len(data), max([1, *self.lengths])
        starts = range(0, n, STRETCH)
        for s in reversed(starts) if backward else starts:
            e = min(s + STRETCH, n)
            block = np.frombuffer(data[s : e + longest - 1], dtype=np.uint8)[None]
            found = [(at := np.flatnonzero(ids[0, : e - s] != self.none), np.full(len(at), k), ids[0, at]) for k, ids in self.edges(block)]
            at, k, piece = (np.concatenate([f[i] for f in found]) for i in range(3))
            order = np.argsort(at, kind="stable")
            yield s, e, at[order] + s, k[order], piece[order]

    def forward_long(self, data: bytes, log_p: np.ndarray) -> np.ndarray:
        """The forward recursion over one long word, with memory for a stretch of edges besides its result."""
        ring = max([1, *self.lengths]) + 1
        waiting: list[list[float]] = [[] for _ in range(ring)]
        waiting[0].append(0.0)
        alpha = np.zeros(len(data) + 1)

        def summed(t: int) -> float:
            terms, waiting[t % ring] = waiting[t % ring], []
            top = max(terms)
            return top + math.log(sum(math.exp(x - top) for x in terms))

        for s, e, at, k, piece in self.stretches(data):
            edges = iter(zip(at.tolist(), k.tolist(), log_p[piece].tolist(), strict=True))
            edge = next(edges, None)
            out = []
            for t in range(s, e):
                a = summed(t)
                out.append(a)
                while edge is not None and edge[0] == t:
                    waiting[(t + edge[1]) % ring].append(a + edge[2])
                    edge = next(edges, None)
            alpha[s:e] = out
        alpha[-1] = summed(len(data))
        return alpha

    def expected_long(self, data: bytes, count: float, log_p: np.ndarray, out: np.ndarray) -> None:
        """Adds the expected uses of pieces in one long word, seen ``count`` times."""
        alpha, beta = self.forward_long(data, log_p), np.zeros(len(data) + 1)
        scale = math.log(count) - alpha[-1]
        for s, e, at, k, piece in self.stretches(data, backward=True):
            w = log_p[piece]
            edges = np.searchsorted(at, np.arange(s, e + 1)).tolist()
            ends, weights, near = (at + k - s).tolist(), w.tolist(), beta[s : e + max([1, *self.lengths])].tolist()
            for t in range(e - s - 1, -1, -1):
                terms = [weights[i] + near[ends[i]] for i in range(edges[t], edges[t + 1])]
                top = max(terms)
                near[t] = top + math.log(sum(math.exp(x - top) for x in terms))
            beta[s:e] = near[: e - s]
            out += np.bincount(piece, weights=np.exp(alpha[at] + w + beta[at + k] + scale), minlength=len(out))

    def blocks(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Equally long marked words of no more than LONG_WORD bytes, as (ordinals, bytes)."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + len(MARK)
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] <= LONG_WORD]
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for group in np.split(order, cuts) if len(order) else []:
            size = int(lengths[group[0]])
            for part in np.array_split(group, max(1, len(group) * size // 150_000)):
                block = np.empty((len(part), size), dtype=np.uint8)
                block[:, : len(MARK)] = np.frombuffer(MARK, dtype=np.uint8)
                block[:, len(MARK) :] = np.frombuffer(b"".join([words[i] for i in part.tolist()]), dtype=np.uint8).reshape(len(part), -1)
                yield part, block

    def log_sums(self, words: list[bytes], log_p: np.ndarray) -> np.ndarray:
        """Natural log of each word's sum over segmentations."""
        out = np.zeros(len(words))
        for part, block in self.blocks(words):
            edges = self.edges(block)
            out[part] = self.forward(edges, [log_p[ids] for _, ids in edges], block.shape[1])[:, -1]
        for i in self.long(words):
            out[i] = self.forward_long(MARK + words[i], log_p)[-1]
        return out

    @staticmethod
    def long(words: list[bytes]) -> list[int]:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        return np.flatnonzero(lengths + len(MARK) > LONG_WORD).tolist()

    def expected(self, words: list[bytes], counts: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece."""
        out = np.zeros(self.none + 1)
        for part, block in self.blocks(words):
            edges, size = self.edges(block), block.shape[1]
            weights = [log_p[ids] for _, ids in edges]
            alpha, beta = self.forward(edges, weights, size), self.backward(edges, weights, size)
            scale = np.log(counts[part]) - alpha[:, -1]
            for (k, ids), w in zip(edges, weights, strict=True):
                use = np.exp(alpha[:, : size - k + 1] + w + beta[:, k:] + scale[:, None])
                out += np.bincount(ids.ravel(), weights=use.ravel(), minlength=self.none + 1)
        for i in self.long(words):
            self.expected_long(MARK + words[i], float(counts[i]), log_p, out)
        out[self.none] = 0
        return out


def vocabulary(model_path: str) -> list[bytes]:
    """The pieces of a scored vocabulary file, best first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [model.id_to_piece(i).encode() for i in sorted(ids, key=lambda i: (-model.get_score(i), i))]


def first_probabilities(lattice: Lattice) -> np.ndarray:
    """Log probabilities from the vocabulary's ranks: 1 / (rank + 10); bytes share one part in 1000, the end one in 100."""
    p = np.zeros(lattice.none + 1)
    zipf = 1 / (np.arange(lattice.n_pieces) + 10.0)
    p[: lattice.n_pieces] = 0.989 * zipf / zipf.sum()
    p[lattice.n_pieces : lattice.end] = 0.001 / 256
    p[lattice.end] = 0.01
    with np.errstate(divide="ignore"):
        return np.log(p)


def word_counts(df: DataFrame) -> DataFrame:
    """word (binary), n: counts of lower-cased words over all rows of (doc_id, text binary); the end is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in pieces(batches):
            texts = batch.column(1).to_pylist()
            for i, j in byte_slices(texts):
                for t in texts[i:j]:
                    held.update(t.lower().split())
                held[b""] += j - i
                if len(held) > HELD_WORDS:
                    yield handed()
                    held.clear()
        yield handed()

    return df.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit(counts: DataFrame, lattice: Lattice, rounds: int = 2, smoothing: float = 0.1) -> np.ndarray:
    """Log piece probabilities after rounds of expectation-maximisation over the distinct words."""
    log_p = first_probabilities(lattice)
    sc = counts.sparkSession.sparkContext
    for _ in range(rounds):
        shared = sc.broadcast((lattice, log_p))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, log_p = shared.value
            total = np.zeros(lattice.none + 1)
            for batch in batches:
                words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(np.float64)
                real = [i for i, w in enumerate(words) if w]
                total += lattice.expected([words[i] for i in real], n[real], log_p)
                total[lattice.end] += sum(n[i] for i, w in enumerate(words) if not w)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.float64())], names=["piece", "n"])

        rows = counts.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # one row a piece
        total = np.full(lattice.none + 1, smoothing)
        for r in rows:
            total[r["piece"]] += r["n"]
        total[lattice.none] = 0
        if rows:
            with np.errstate(divide="ignore"):
                log_p = np.log(total / total.sum())
        shared.unpersist()
    return log_p


def least_frequent(counts: DataFrame, most: int) -> int:
    """The least power-of-two sixteenth of a count from which up there are no more than ``most`` words."""
    cells = sorted(counts.groupBy(_bucket().alias("bucket")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["bucket"])  # 16 for each doubling of a count
    held, least = 0, 1 << 20
    for r in cells:
        held += r["words"]
        if held > most:
            break
        least = r["bucket"]
    return least


def _bucket() -> Column:
    return F.floor(F.log2("n") * 16).cast("int")


def lattice_scores(df: DataFrame, model_path: str, modulus: int = 7, remainder: int = 2, rounds: int = 2, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram), score (log10 of the lattice model)."""
    spark = df.sparkSession
    lattice = Lattice(vocabulary(model_path))
    docs = id_and_text(df, id_col, text_col, "binary").withColumn("held_out", held_out(F.col("doc_id"), modulus, remainder))
    counts = cut(word_counts(docs.where(~F.col("held_out")).select("doc_id", "text")))
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = size["n"], size["v"]
    log_p = fit(counts, lattice, rounds)
    least = least_frequent(counts, frequent)
    known = {bytes(r["word"]): r["n"] for r in counts.where(_bucket() >= least).collect()}  # at most ``frequent``
    known.pop(b"", None)
    often_sums = lattice.log_sums(list(known), log_p)
    often_counts = np.array([*known.values(), 0], dtype=np.int64)  # the last one of all other words
    often = dict(zip(known, range(len(known)), strict=True))
    ends = counts.where(F.length("word") == 0).first()
    shared = spark.sparkContext.broadcast((lattice, log_p, often, often_sums, often_counts, ends["n"] if ends else 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, log_p, often, often_sums, often_counts, end_count = shared.value
        end_sum = float(log_p[lattice.end])
        place, sums = dict(often), often_sums
        for batch in pieces(batches):
            ids, texts, out, marks = (batch.column(i).to_pylist() for i in range(4))
            for i, j in byte_slices(texts, SCORED_BYTES):
                tables = [Counter(t.lower().split()) for t in texts[i:j]]
                words = list(chain.from_iterable(tables))
                times = np.fromiter(chain.from_iterable(t.values() for t in tables), dtype=np.int64, count=len(words))
                doc = np.repeat(np.arange(j - i), [len(t) for t in tables])
                at = np.fromiter(map(place.get, words, repeat(-1)), dtype=np.int64, count=len(words))
                unseen = np.flatnonzero(at < 0)
                of_unseen = [words[r] for r in unseen.tolist()]
                new = list(dict.fromkeys(of_unseen))
                place.update(zip(new, range(len(sums), len(sums) + len(new)), strict=True))
                sums = np.concatenate([sums, lattice.log_sums(new, log_p)])
                at[unseen] = np.fromiter(map(place.__getitem__, of_unseen), dtype=np.int64, count=len(of_unseen))
                score = np.bincount(doc, weights=times * sums[at], minlength=j - i) + end_sum
                count = often_counts[np.minimum(at, len(often))]
                if len(place) > len(often) + MEMORY:
                    place, sums = dict(often), often_sums
                base = np.bincount(doc, weights=times * np.log10(count + 1), minlength=j - i) + math.log10(end_count + 1)
                seen = np.bincount(doc, weights=times * (count > 0), minlength=j - i).astype(np.int64) + int(end_count > 0)
                tokens = np.bincount(doc, weights=times, minlength=j - i).astype(np.int64) + 1
                # a text's own row bears a word that no text has, so that these rows spread like others
                own = [b" %d" % (m & 0xFFFFFFFFFFFFFFFF) for m in marks[i:j]]
                rest = np.flatnonzero(count == 0)
                back = doc[rest]
                nil = np.zeros(len(rest))
                columns = [
                    pa.array(own + [words[r] for r in rest], pa.binary()),
                    pa.array(ids[i:j] + [ids[i + d] for d in back], pa.int64()),
                    pa.array(out[i:j] + [out[i + d] for d in back], pa.bool_()),
                    pa.array(marks[i:j] + [marks[i + d] for d in back], pa.int64()),
                    pa.array(np.r_[np.zeros(j - i, dtype=np.int64), times[rest]], pa.int64()),
                    pa.array(np.r_[tokens, nil.astype(np.int64)], pa.int64()),
                    pa.array(np.r_[seen, nil.astype(np.int64)], pa.int64()),
                    pa.array(np.r_[base, nil], pa.float64()),
                    pa.array(np.r_[score / math.log(10), nil], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "doc_id", "held_out", "mark", "times", "tokens", "seen", "base", "score"])

    marked = docs.select("doc_id", "text", "held_out", F.xxhash64("text").alias("mark"))
    rows = marked.mapInArrow(run, "word binary, doc_id long, held_out boolean, mark long, times long, tokens long, seen long, base double, score double")
    joined = rows.join(counts.where(_bucket() < least), "word", "left")
    n = F.coalesce("n", F.lit(0))
    folded = joined.groupBy("doc_id", "mark", "held_out").agg(
        F.sum("tokens").alias("tokens"),
        F.sum(F.col("seen") + F.when(n > 0, F.col("times")).otherwise(0)).alias("seen"),
        F.sum(F.col("base") + F.col("times") * F.log10(n + 1)).alias("base"),
        F.sum("score").alias("score"),
        F.sum((F.col("times") == 0).cast("int")).alias("copies"),
    )
    # rows repeated with id and text were summed together; each gets its share back
    share = folded.select("doc_id", "held_out", *((F.col(c) / F.col("copies")).alias(c) for c in ("base", "score")), *((F.col(c) / F.col("copies")).cast("long").alias(c) for c in ("tokens", "seen")), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
    return share.select(
        "doc_id",
        "held_out",
        F.col("tokens").alias("n_tokens"),
        F.col("seen").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("tokens") * F.lit(math.log10(total + distinct + 1))).alias("base_score"),
        "score",
    )
