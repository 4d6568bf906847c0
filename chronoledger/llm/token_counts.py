"""Operator 1: token counts of a scored-piece BPE vocabulary, by rank-synchronous array merging.

A text is cut into pre-tokens that no piece of the vocabulary crosses (a run of
word markers with what follows it; line breaks stand alone). The distinct
pre-tokens of a slice of texts become one ragged array of character symbols;
each round every sequence applies its lowest-rank pair at once; the surviving
symbols are counted. A character outside the vocabulary counts its UTF-8 bytes
(byte fallback).

Null text counts as empty (0 tokens); a null id stays null; repeated rows each
get their row; an empty table gives an empty result; other columns are ignored.
Time grows with a text's length, unbroken or not, and a worker's memory with the
longest text (some 60 bytes a character of its longest pre-token).
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_arrow, text_slices
from .merges import LONG, MergeTable

SPACE = "▁"
#: Pre-tokens that a worker remembers with their counts; past that it starts anew. Results don't depend on it.
MEMORY = 400_000


class PieceCounter:
    """Counts tokens as the vocabulary's own library does, without begin or end tokens."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = [i for i in range(self.model.get_piece_size()) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        pieces = {self.model.id_to_piece(i): -self.model.get_score(i) for i in ids}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece crosses a word boundary; this counter needs pieces within words")
        ranks = {s: r for r, s in enumerate(sorted(set(pieces.values())))}
        chars = sorted({c for p in pieces for c in p})
        self.symbol = {s: i for i, s in enumerate([*chars, *sorted(p for p in pieces if len(p) > 1)])}
        #: By code point: the character's symbol, or minus its bytes in UTF-8 where it is in no piece.
        points = np.arange(0x110000)
        self.of_point = -(1 + (points > 0x7F).astype(np.int32) + (points > 0x7FF) + (points > 0xFFFF))
        self.of_point[[ord(c) for c in chars]] = [self.symbol[c] for c in chars]
        #: What a symbol counts that survives: 1, or its bytes if it is only a part of pieces.
        self.cost = np.array([1 if s in pieces else len(s.encode()) for s in self.symbol], dtype=np.int64)
        pairs = [(self.symbol[a], self.symbol[b], ranks[score], self.symbol[p]) for p, score in pieces.items() for i in range(1, len(p)) if (a := p[:i]) in self.symbol and (b := p[i:]) in self.symbol]
        self.table = MergeTable(*np.array(pairs, dtype=np.int64).reshape(-1, 4).T)
        joined = {c for p in pieces if len(p) > 1 for c in p}
        alone = re.escape("".join(c for c in "\n\r\t" if c not in joined))
        self.cutter = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.plain = self.model.normalize("  a \tÁ ") == f"{SPACE * 3}a{SPACE}\tÁ{SPACE}"
        self.known: dict[str, int] = {}

    def pretokens(self, text: str) -> list[str]:
        if not text:
            return []
        return self.cutter.findall(SPACE + text.replace(" ", SPACE) if self.plain else self.model.normalize(text))

    def count_new(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        symbols = self.of_point[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        sequence = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        symbols, sequence = self.table.merge(symbols, sequence)
        cost = np.where(symbols < 0, -symbols, self.cost[np.maximum(symbols, 0)])
        return np.bincount(sequence, weights=cost, minlength=len(words)).astype(np.int64)

    def counts(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for i, j in text_slices(texts):
            cut = [self.pretokens(t) for t in texts[i:j]]
            new = list(set().union(*cut).difference(self.known))
            if len(self.known) + len(new) > MEMORY:
                self.known.clear()
                new = list(set().union(*cut))
            self.known.update(zip(new, self.count_new(new).tolist(), strict=True))
            get = self.known.__getitem__
            out += [sum(map(get, words)) for words in cut]
            for w in new:
                if len(w) > LONG:
                    del self.known[w]
        return out


@lru_cache(maxsize=2)
def counter(model_path: str) -> PieceCounter:
    return PieceCounter(model_path)


def token_counts(df: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). One pass, no shuffle."""

    def run(batch: pa.RecordBatch):
        found = counter(model_path).counts(batch.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = id_and_text(df, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return map_arrow(rows, run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
