"""Operator 9: BPE encoding and decoding with a word-end vocabulary, in batched numpy merge rounds.

The symbols of all new words of a slice of texts lie in one flat array; each
round finds every sequence's lowest-rank pair by binary search over the sorted
pair keys and merges it (see ``merges``). Words seen before come from a bounded
memory of the worker, which changes no result.

Null text counts as empty (no ids, empty decoded text); a null id stays null;
repeated rows each get their row; an empty table gives an empty result; other
columns are ignored. Time grows with a text's length, unbroken or not, and a worker's
memory with the longest text (some 60 bytes a byte of its longest word).
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_arrow, text_slices
from .merges import MergeTable

#: White space of Unicode, the vocabulary's word pattern and its word-end mark.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NOT_WHITE = "\x1c\x1d\x1e\x1f"  # these str.split() takes for white space too
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Chunks that a worker remembers with their ids.
MEMORY = 200_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte value in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


def gathered(values: np.ndarray, edges: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of values (run i lies between edges i and i + 1), one after another, and their edges."""
    lengths = edges[which + 1] - edges[which]
    ends = np.r_[0, np.cumsum(lengths)]
    return values[np.repeat(edges[which] - ends[:-1], lengths) + np.arange(ends[-1])], ends


class WordCodec:
    """Encodes and decodes as the vocabulary file's library does with add_special_tokens=False."""

    def __init__(self, vocabulary_path: str):
        with open(vocabulary_path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        spaced = [f" {self.token.get(i, '')}".encode() for i in range(max(self.token) + 1)]
        #: Each token's bytes after a space, and where they begin and end.
        self.shown, self.shown_edges = np.frombuffer(b"".join(spaced), dtype=np.uint8), np.cumsum([0, *map(len, spaced)])
        pairs = [(vocab[a], vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(spec["model"]["merges"])]
        self.table = MergeTable(*np.array(pairs, dtype=np.int64).T)
        shown = byte_symbols()
        self.inner = np.array([vocab[c] for c in shown], dtype=np.int64)
        self.last = np.array([vocab[c + WORD_END] for c in shown], dtype=np.int64)
        self.byte_of = {c: b for b, c in enumerate(shown)}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.white, self.words = re.compile(f"[{WHITE}]+"), regex.compile(WORDS)
        self.forget()

    def chunks(self, text: str) -> list[str]:
        """The normalised text cut at white space; special tokens stand alone, behind a mark that no chunk has."""
        out: list[str] = []
        for i, part in enumerate(self.cut_special.split(text) if any(s in text for s in self.special) else [text]):
            if i % 2:
                out.append("\n" + part)
            elif part:
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()  # lower() would make a final sigma of it
                out += filter(None, self.white.split(part)) if any(c in part for c in NOT_WHITE) else part.split()
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words of the word pattern, and where each one's begin and end."""
        data = [w.encode() for w in words]
        lengths = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        flat = np.frombuffer(b"".join(data), dtype=np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[flat[ends]]
        symbols, sequence = self.table.merge(symbols, np.repeat(np.arange(len(words)), lengths))
        return symbols, np.searchsorted(sequence, np.arange(len(words) + 1))

    def learn(self, chunks: list[str]) -> None:
        """Remember the ids of chunks; most are one word of letters, which needs no pattern."""
        cut = [(c,) if c.isalpha() or c[0] == "\n" else self.words.findall(c) for c in chunks]
        words = list({w for parts in cut for w in parts if w[0] != "\n"})
        ids, edges = self.encode_words(words)
        special = list(self.special)
        ids = np.concatenate([ids, [self.special[s] for s in special]])
        edges = np.concatenate([edges, edges[-1] + 1 + np.arange(len(special))])
        number = dict(zip(chain(words, ["\n" + s for s in special]), range(len(edges)), strict=False))
        ids, edges = gathered(ids, edges, np.fromiter((number[w] for parts in cut for w in parts), dtype=np.int64))
        edges = edges[np.r_[0, np.cumsum(np.fromiter(map(len, cut), dtype=np.int64, count=len(cut)))]]
        self.known.update(zip(chunks, range(len(self.edges) - 1, len(self.edges) - 1 + len(chunks)), strict=True))
        self.ids, self.edges = np.concatenate([self.ids, ids.astype(np.int32)]), np.concatenate([self.edges, len(self.ids) + edges[1:]])

    def forget(self) -> None:
        self.known: dict[str, int] = {}  # chunk: its number in edges
        self.ids, self.edges = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Each text's ids (little-endian unsigned 32-bit) and its decoded text (UTF-8)."""
        out: list[tuple[bytes, bytes]] = []
        for i, j in text_slices(texts):
            cut = [self.chunks(t) for t in texts[i:j]]
            new = list(set().union(*cut).difference(self.known))
            if len(self.known) + len(new) > MEMORY or len(self.ids) > 20 * MEMORY:
                self.forget()
                new = list(set().union(*cut))
            if new:
                self.learn(new)
            flat = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), dtype=np.int64)
            ids, edges = gathered(self.ids, self.edges, flat)
            shown, places = gathered(self.shown, self.shown_edges, ids)
            ends = edges[np.cumsum(np.fromiter(map(len, cut), dtype=np.int64, count=len(cut)))].tolist()
            raw, text, start = ids.astype("<u4").tobytes(), shown.tobytes(), 0
            for end in ends:
                out.append((raw[4 * start : 4 * end], text[places[start] + 1 : places[end]] if end > start else b""))
                start = end
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens, joined by spaces: the vocabulary file names no decoder."""
        return " ".join(self.token[i] for i in ids)

    def words_of(self, ids: list[int]) -> str:
        """The lower-case words that the ids spell, one space between them: the round trip of normalised words."""
        text = "".join(self.token[i] if i not in self.special.values() else "" for i in ids)
        return b" ".join(bytes(self.byte_of[c] for c in w) for w in text.split(WORD_END)).decode().strip()


@lru_cache(maxsize=2)
def codec(vocabulary_path: str) -> WordCodec:
    return WordCodec(vocabulary_path)


def encode(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids (array of int) and decoded (text). One pass, no shuffle."""

    def run(batch: pa.RecordBatch):
        found = codec(vocabulary_path).encode(batch.column(1).to_pylist())
        ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x, _ in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([t.decode() for _, t in found], pa.string())], names=["doc_id", "ids", "decoded"])

    return map_arrow(id_and_text(df, id_col, text_col), run, "doc_id long, ids array<int>, decoded string")


def encode_digests(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 and decoded_sha256, from the same encoder without shipping ids out of the worker."""

    def run(batch: pa.RecordBatch):
        found = codec(vocabulary_path).encode(batch.column(1).to_pylist())
        columns = [pa.array([len(x) // 4 for x, _ in found], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x, _ in found]), pa.array([hashlib.sha256(t).hexdigest() for _, t in found])]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(id_and_text(df, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: doc_id and the decoded text of its ids (null ids: empty)."""
    def run(batch: pa.RecordBatch):
        texts = [codec(vocabulary_path).decode(x or []) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return map_arrow(df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids")), run, "doc_id long, decoded string")
