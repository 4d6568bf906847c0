"""Operator 2: exact deduplication by Grace hash partitioning.

Every input partition first folds its own copies in an open-addressing table, so
that the exchange carries each distinct text at most once a partition. Behind the
exchange on the content's digest, a partition fills another table that compares
complete contents; when the table outgrows its budget, it and the records to come
go to spill files by further bits of the hash, and each file is treated likewise.
Spill files live in a folder of the task's own, under Spark's local folders, and end with
the task: a lost executor only means that the task runs again. The group's decision then returns
to all its rows by a join on the digest, whose hot keys Spark can split.

Texts are equal when identical after deleting the characters 0x20 and 0x09-0x0D.
Null text counts as empty, and empty texts form one group. Of equal texts the row
with the most code points in its original text, then the smallest id, stays; a
null id comes after all others. Repeated rows (same id, same text) are counted
each and share one decision. An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_arrow, pieces

DELETED = b" \t\n\x0b\x0c\r"
#: Bytes of content a table may hold before it spills, and files that a table spills to.
BUDGET, FAN_OUT_BITS = 48_000_000, 4

Record = tuple[bytes, bytes, int, "int | None", int]  # digest, content, code points, id, rows


def better(length: int, doc_id: int | None, than_length: int, than_id: int | None) -> bool:
    if length != than_length:
        return length > than_length
    return doc_id is not None and (than_id is None or doc_id < than_id)


class OpenTable:
    """Open addressing with linear probing; one entry for each distinct content."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.entries: list[list] = []
        self.bytes = 0

    def add(self, record: Record) -> None:
        digest, content, length, doc_id, rows = record
        mask = len(self.slots) - 1
        i = int.from_bytes(digest[:8], "little") & mask
        while (at := self.slots[i]) >= 0:
            entry = self.entries[at]
            if entry[0] == digest and entry[1] == content:
                entry[4] += rows
                if better(length, doc_id, entry[2], entry[3]):
                    entry[2], entry[3] = length, doc_id
                return
            i = (i + 1) & mask
        self.slots[i] = len(self.entries)
        self.entries.append([digest, content, length, doc_id, rows])
        self.bytes += len(content) + 300
        if 2 * len(self.entries) > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for at, entry in enumerate(self.entries):
            i = int.from_bytes(entry[0][:8], "little") & mask
            while self.slots[i] >= 0:
                i = (i + 1) & mask
            self.slots[i] = at


class Spill:
    """Files of records, by the bits of the digest that belong to a level."""

    def __init__(self, folder: str, level: int):
        self.level = level
        self.files = [tempfile.TemporaryFile(dir=folder) for _ in range(1 << FAN_OUT_BITS)]
        self.waiting: list[list[Record]] = [[] for _ in self.files]
        self.held = 0

    def add(self, record: Record) -> None:
        bits = int.from_bytes(record[0][8:16], "little") >> (FAN_OUT_BITS * self.level)
        self.waiting[bits & (len(self.files) - 1)].append(tuple(record))
        self.held += len(record[1])
        if self.held > BUDGET // 8:
            self.flush()

    def flush(self) -> None:
        for f, records in zip(self.files, self.waiting, strict=True):
            if records:
                pickle.dump(records, f, protocol=5)
                records.clear()
        self.held = 0

    def drain(self) -> Iterator[Iterator[Record]]:
        self.flush()
        for f in self.files:
            f.seek(0)
            yield self._read(f)
            f.close()

    @staticmethod
    def _read(f) -> Iterator[Record]:
        while True:
            try:
                yield from pickle.load(f)
            except EOFError:
                return


def spill_root() -> str | None:
    """One of the folders that Spark gives a worker for its spills; None (the system's choice) only outside of Spark."""
    folders = [f for f in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if f]
    return folders[os.getpid() % len(folders)] if folders else None


def grace(records: Iterable[Record], folder: str, budget: int = BUDGET, level: int = 0) -> Iterator[list]:
    """One entry [digest, content, code points, id, rows] for each distinct content."""
    table, spill = OpenTable(), None
    for record in records:
        if spill is not None:
            spill.add(record)
            continue
        table.add(record)
        if table.bytes > budget and len(table.entries) > 1 and FAN_OUT_BITS * level < 64:
            spill = Spill(folder, level)
            for entry in table.entries:
                spill.add(entry)
            table = OpenTable()
    if spill is None:
        yield from table.entries
        return
    for part in spill.drain():
        yield from grace(part, folder, budget, level + 1)


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[Record]:
    for batch in pieces(batches):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(entries: Iterable[list], with_content: bool) -> Iterator[pa.RecordBatch]:
    names = ["digest", "content", "length", "keep_id", "n"]
    types = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    keep = [i for i in range(5) if with_content or i != 1]

    def batch(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in keep], names=[names[i] for i in keep])

    rows: list[list] = []
    size = 0
    for entry in entries:
        rows.append(entry)
        size += len(entry[1])
        if size > 4_000_000 or len(rows) >= 5000:
            yield batch(rows)
            rows, size = [], 0
    if rows:
        yield batch(rows)


def normalised(content: bytes) -> bytes:
    return content.translate(None, DELETED)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """One row for each distinct normalised text: digest, length and keep_id of the row that stays, n rows."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = OpenTable()
        for batch in pieces(batches):
            for doc_id, text, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                content = normalised(text)
                table.add((hashlib.sha256(content).digest(), content, length, doc_id, 1))
                if table.bytes > budget:
                    yield from _batches(table.entries, True)
                    table = OpenTable()
        yield from _batches(table.entries, True)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory(dir=spill_root()) as folder:
            yield from _batches(grace(_records(batches), folder, budget), False)

    text = F.col("text").cast("binary")
    rows = id_and_text(df, id_col, text_col).select("doc_id", text.alias("text"), F.char_length("text").cast("long").alias("length"))
    folded = rows.mapInArrow(fold, "digest binary, content binary, length long, keep_id long, n long")
    return folded.repartition("digest").mapInArrow(meet, "digest binary, length long, keep_id long, n long")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the SHA-256 of each normalised text."""

    def run(batch: pa.RecordBatch):
        found = [hashlib.sha256(normalised(t)).digest() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "digest"])

    return map_arrow(id_and_text(df, id_col, text_col, "binary"), run, "doc_id long, digest binary")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """Per row, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = exact_groups(df, id_col, text_col, budget)
    return digests(df, id_col, text_col).join(groups, "digest").select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
