"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import checkpoint_dir, cut
from .words import count_words

__all__ = ["ascii_lower", "checkpoint_dir", "cut", "give_back", "held_out", "id_and_text", "map_arrow", "pieces", "sample_rows", "table", "text_slices"]

#: Characters of text that a Python worker takes up at a time; bounds its memory whatever the batch.
CHUNK_CHARS = 1_000_000
#: Rows of an Arrow batch that become Python objects at a time.
PIECE_ROWS = 2000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII rows take the fast built-in, which agrees on them."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def id_and_text(df: DataFrame, id_col: str, text_col: str, text_type: str = "string") -> DataFrame:
    """The two columns an operator reads, under fixed names; null text is the empty text."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.cast(text_type).alias("text"))


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows, PIECE_ROWS at a time: Python copies of a batch's texts stay small. Gives freed memory back at the end."""
    for batch in batches:
        for i in range(0, batch.num_rows, PIECE_ROWS):
            yield batch.slice(i, PIECE_ROWS)
    give_back()


def give_back() -> None:
    """Return freed memory to the system; a reused Python worker would keep it while other operators run."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema) -> DataFrame:
    """Apply fn to pieces of the rows as Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            yield from fn(piece)

    return df.mapInArrow(run, schema)


def text_slices(texts: list, most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``most`` characters; one longer text makes a range of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's decimal text has the remainder that keeps a row out of training (null id: as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def sample_rows(docs: DataFrame, chosen: DataFrame, value: str, max_words: int, inside: np.ndarray) -> DataFrame:
    """What a model learns from: doc_id, text, value of chosen rows of docs (doc_id, text binary), bounded in rows and in words.

    ``chosen`` (doc_id, value) has a bounded number of ids. Of each id's texts the one of
    least hash counts. Texts of no word or of over a tenth of ``max_words`` are left out; the
    others are taken in the order of a hash of their id until the next one would go over
    ``max_words``. Only a number for each id goes to the driver before these bounds hold.
    """

    def counted(batch: pa.RecordBatch):
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([count_words(t, inside) for t in batch.column(2).to_pylist()], pa.int64())], names=["doc_id", "mark", "words"])

    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", F.xxhash64("text").alias("mark"), "text", value)
    sizes = map_arrow(rows.select("doc_id", "mark", "text"), counted, "doc_id long, mark long, words long")
    found = sizes.groupBy("doc_id").agg(F.min(F.struct("mark", "words")).alias("text")).select("doc_id", "text.mark", "text.words").collect()  # a row for each chosen id at most
    taken, total = [], 0
    for r in sorted(found, key=lambda r: (r["doc_id"] * 0x9E3779B97F4A7C15 & (1 << 64) - 1)):
        if 0 < r["words"] <= max_words // 10:
            total += r["words"]
            if total > max_words:
                break
            taken.append((r["doc_id"], r["mark"]))
    kept = docs.sparkSession.createDataFrame(taken, "doc_id long, mark long")
    return rows.join(F.broadcast(kept), ["doc_id", "mark"]).dropDuplicates(["doc_id"]).select("doc_id", "text", value)
