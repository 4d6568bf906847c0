"""Operator 6: exact self-join on n-gram Jaccard similarity with signature trees.

A text's set holds its distinct word n-grams as 64-bit hashes. Two sets link when
100 * intersection >= 75 * union (``least`` percent in general); linked texts form
components. No link between components is lost:

1. Equal sets collapse to one (its id is a hash of the set; should two different sets
   get one id, which is checked, all starts anew with another seed).
2. Linked sets share an n-gram among their first n - ceil(0.75 n) + 1 in any one order.
   The order puts n-grams of crowded sketch cells last, so that passages which many
   texts share seldom count as candidates. The sketch has a fixed number of cells.
3. The sets behind one such n-gram form a block; equal blocks collapse. A block is
   searched by a signature tree: nodes hold the OR and the AND of their members'
   n-gram bitmaps and their range of sizes. A dual traversal drops node pairs whose
   sizes, or whose greatest possible overlap, rule a link out, or whose members are all
   joined already; what it leaves joins. So a group of copies costs about one
   comparison a member, not all its pairs.
4. The sets that blocks join, over any number of blocks, form a cluster. Every set is in
   one cluster at most, and linked sets are in the same one. Clusters are searched by the
   same trees, now with the whole sets compared exactly.
5. A block or cluster of over ``most`` sets is dealt into chunks: chunks are searched alone,
   then one set for each component, and only if two components are left, pairs of chunks:
   those whose ranges of sizes allow a link, and not two of the largest component. For m
   sets outside of it among n, each set meets about m / ``most`` chunks.

Null and empty texts have no set and link with nothing: each is its own component. A
null id takes part, but is nobody's component_id unless all ids of a component are
null. Repeated rows each get their row; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, id_and_text, pieces
from .words import NOT_SPACE, byte_slices, find_words, mix

#: Words in an n-gram, percent of the union; cells of the sketch (bits); sets searched in one block; sets whose ids may be broadcast.
N, LEAST, CELL_BITS, MOST, BROADCAST = 5, 75, 24, 2048, 500_000
SLICES = 64
#: Links that a task of the component search takes up; rows of a gram from which they are dealt over several tasks.
EDGES, DEALT = 200_000, 4_000_000
#: Sets that a task remembers to have handed on.
REMEMBERED = 200_000
_FACTORS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def sets_of(texts: list[bytes], n: int = N, seed: int = 0) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct word n-grams; fewer words make one gram of the whole."""
    out: list[np.ndarray] = []
    none = np.zeros(0, dtype=np.uint64)
    for i, j in byte_slices(texts):
        words = find_words(texts[i:j], NOT_SPACE)
        size = np.bincount(words.text, minlength=j - i)
        weighted = [words.hash * f for f in _FACTORS[:n]]
        total = len(words.hash)
        sums = np.zeros(max(0, total - n + 1), dtype=np.uint64)
        for k in range(n):
            sums += weighted[k][k : k + len(sums)]
        sums = mix(sums + np.uint64(seed))
        first = np.cumsum(size) - size
        for s, c in zip(first.tolist(), size.tolist(), strict=True):
            if c >= n:
                out.append(np.unique(sums[s : s + c - n + 1]))
            elif c:
                whole = sum((int(weighted[k][s + k]) for k in range(c)), c << 60) + seed & 0xFFFFFFFFFFFFFFFF
                out.append(mix(np.array([whole], dtype=np.uint64)))
            else:
                out.append(none)
    return out


def set_id(s: np.ndarray) -> tuple[int, int]:
    """Two independent 63-bit hashes of a set."""
    a, b = int(mix(s + np.uint64(1)).sum(dtype=np.uint64)), int(mix(s ^ np.uint64(0x5555555555555555)).sum(dtype=np.uint64))
    return int(mix(np.array([a ^ len(s)], dtype=np.uint64))[0] >> np.uint64(1)), b >> 1


def width_of(n: int) -> int:
    """Bits of a bitmap: a power of two of twice the set's size at least, and 64."""
    return max(64, 1 << (2 * n - 1).bit_length())


def bitmap(s: np.ndarray) -> np.ndarray:
    bits = np.zeros(width_of(len(s)), dtype=bool)
    bits[(s & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """A bitmap OR-ed down to so many 64-bit words."""
    return np.bitwise_or.reduce(words.reshape(-1, size), axis=0)


class SignatureTree:
    """Members in order of size; leaves of a few, nodes of four children."""

    LEAF, FAN = 8, 4

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray, percent: int):
        self.sizes, self.bits, self.percent = sizes, bitmaps, percent
        self.levels = [[(i, min(i + self.LEAF, len(sizes))) for i in range(0, len(sizes), self.LEAF)]]
        self.either = [np.stack([np.bitwise_or.reduce(bitmaps[a:b], axis=0) for a, b in self.levels[0]])]
        self.every = [np.stack([np.bitwise_and.reduce(bitmaps[a:b], axis=0) for a, b in self.levels[0]])]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            cuts = range(0, len(below), self.FAN)
            self.levels.append([(below[i][0], below[min(i + self.FAN, len(below)) - 1][1]) for i in cuts])
            self.either.append(np.stack([np.bitwise_or.reduce(self.either[-1][i : i + self.FAN], axis=0) for i in cuts]))
            self.every.append(np.stack([np.bitwise_and.reduce(self.every[-1][i : i + self.FAN], axis=0) for i in cuts]))

    def _need(self, a: np.ndarray | int, b: np.ndarray | int):
        """Least overlap, times (100 + percent), of a link between sizes a and b."""
        return self.percent * (a + b)

    def _possible(self, level: int, a: int, b: int) -> bool:
        (a0, a1), (b0, b1) = self.levels[level][a], self.levels[level][b]
        if 100 * int(self.sizes[a1 - 1]) < self.percent * int(self.sizes[b0]):  # a is before b, so its sizes are the smaller ones
            return False
        if a == b:
            return True
        either, every = self.either[level], self.every[level]
        over_a = int(self.sizes[a1 - 1]) - int(np.bitwise_count(every[a] & ~either[b]).sum())
        over_b = int(self.sizes[b1 - 1]) - int(np.bitwise_count(every[b] & ~either[a]).sum())
        return (100 + self.percent) * min(over_a, over_b) >= self._need(int(self.sizes[a0]), int(self.sizes[b0]))

    def _leaf(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        (a0, a1), (b0, b1) = self.levels[0][a], self.levels[0][b]
        x, y = self.bits[a0:a1, None, :], self.bits[None, b0:b1, :]
        nx, ny = self.sizes[a0:a1, None], self.sizes[None, b0:b1]
        over = np.minimum(nx - np.bitwise_count(x & ~y).sum(axis=2, dtype=np.int64), ny - np.bitwise_count(y & ~x).sum(axis=2, dtype=np.int64))
        ok = ((100 + self.percent) * over >= self._need(nx, ny)) & (100 * np.minimum(nx, ny) >= self.percent * np.maximum(nx, ny))
        for i, j in zip(*np.nonzero(ok), strict=True):
            if a0 + i < b0 + j:
                yield int(a0 + i), int(b0 + j)

    def pairs(self, joined: Callable[[int, int, int, int], bool]) -> Iterator[tuple[int, int]]:
        """Member pairs that may link. ``joined`` says whether two ranges of members are all in one component just now."""
        top = len(self.levels) - 1
        stack = [(top, 0, 0)]
        while stack:
            level, a, b = stack.pop()
            if joined(*self.levels[level][a], *self.levels[level][b]) or not self._possible(level, a, b):
                continue
            if level == 0:
                yield from self._leaf(a, b)
                continue
            below = len(self.levels[level - 1])
            left = range(a * self.FAN, min((a + 1) * self.FAN, below))
            right = range(b * self.FAN, min((b + 1) * self.FAN, below))
            pairs = [(level - 1, i, j) for i in left for j in right if i <= j]
            stack += sorted(pairs, key=lambda p: p[1] - p[2])  # near sizes come off the stack first


def segments(sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Ranges of ascending sizes between which no link can be."""
    gap = np.flatnonzero(100 * sizes[:-1] < percent * sizes[1:]) + 1
    edges = [0, *gap.tolist(), len(sizes)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b - a > 1]


def trees(sizes: np.ndarray, bitmaps: list[np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, SignatureTree]]:
    """For each segment of sizes, the ordinals of its members and their tree."""
    order = np.argsort(sizes, kind="stable")
    for a, b in segments(sizes[order], percent):
        members = order[a:b]
        least = min(len(bitmaps[i]) for i in members)
        yield members, SignatureTree(sizes[members], np.stack([folded(bitmaps[i], least) for i in members]), percent)


def joins_within(sizes: np.ndarray, bitmaps: list[np.ndarray], components: np.ndarray, percent: int = LEAST, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Pairs, each joining two components, that connect what links connect.

    Without sets, a pair that the bitmaps allow to link joins; with sets, only a link does.
    """
    parent = {int(c): int(c) for c in components}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    found = []
    for members, tree in trees(sizes, bitmaps, percent):
        own = [int(components[m]) for m in members]

        def joined(a0: int, a1: int, b0: int, b1: int, own: list[int] = own) -> bool:
            one = root(own[a0])
            return all(root(c) == one for c in own[a0:a1]) and all(root(c) == one for c in own[b0:b1])

        for i, j in tree.pairs(joined):
            a, b = root(own[i]), root(own[j])
            if a == b:
                continue
            if sets is not None:
                x, y = sets[members[i]], sets[members[j]]
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                shared = int((y[at] == x).sum())
                if 100 * shared < percent * (len(x) + len(y) - shared):
                    continue
            parent[max(a, b)] = min(a, b)
            found.append((int(members[i]), int(members[j])))
    return found


# ---- steps on DataFrames -------------------------------------------------------------------------------------------


def _batch(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def _signatures(df: DataFrame, n: int, seed: int) -> DataFrame:
    """Rows of texts (doc_id, mark, size, id, check, bits) and of sketch slices (slice, counts), in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, dtype=np.uint32)
        for batch in pieces(batches):
            ids, texts, marks = (batch.column(i).to_pylist() for i in range(3))
            for i, j in byte_slices(texts):
                sets = sets_of(texts[i:j], n, seed)
                hit, times = np.unique(_cells(np.concatenate(sets)), return_counts=True)
                cells[hit] += times.astype(np.uint32)
                keys = [set_id(s) if len(s) else (None, None) for s in sets]
                yield _batch({"doc_id": (ids[i:j], pa.int64()), "mark": (marks[i:j], pa.int64()), "size": ([len(s) for s in sets], pa.int64()), "id": ([k[0] for k in keys], pa.int64()), "check": ([k[1] for k in keys], pa.int64()), "bits": ([bitmap(s).tobytes() if len(s) else None for s in sets], pa.binary()), "slice": ([None] * (j - i), pa.int32()), "counts": ([None] * (j - i), pa.binary())})
        part = len(cells) // SLICES
        none = [None] * SLICES
        yield _batch({**{k: (none, pa.int64()) for k in ("doc_id", "mark", "size", "id", "check")}, "bits": (none, pa.binary()), "slice": (range(SLICES), pa.int32()), "counts": ([zlib.compress(cells[k * part : (k + 1) * part], 1) for k in range(SLICES)], pa.binary())})

    return df.mapInArrow(run, "doc_id long, mark long, size long, id long, check long, bits binary, slice int, counts binary")


def _crowding(signatures: DataFrame) -> tuple[np.ndarray, int]:
    """For each sketch cell how crowded it is, in half powers of two over what chance makes of the mean; 0 for most cells.

    Also the crowding of a cell with DEALT rows.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(c), dtype=np.uint32).astype(np.uint64)
        yield _batch({"slice": (list(sums), pa.int32()), "counts": ([zlib.compress(s, 1) for s in sums.values()], pa.binary())})

    slices = signatures.where("slice is not null").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(add, "slice int, counts binary")
    total = np.zeros((SLICES, (1 << CELL_BITS) // SLICES), dtype=np.uint64)
    for r in slices.toLocalIterator():  # a fixed number of cells, whatever the input
        total[r["slice"]] += np.frombuffer(zlib.decompress(bytes(r["counts"])), dtype=np.uint64)
    mean = total.mean(dtype=np.float64)
    chance = max(mean + 3 * np.sqrt(mean), 2)
    out = np.empty(total.shape, dtype=np.uint8)
    for k in range(SLICES):
        out[k] = np.minimum(np.ceil(2 * np.log2(np.maximum(total[k] / chance, 1))), 255)
    return out.ravel(), max(1, int(np.ceil(2 * np.log2(max(DEALT, 1) / chance))))


def _cells(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _candidates(df: DataFrame, crowding: np.ndarray, dealt_from: int, n: int, seed: int, percent: int) -> DataFrame:
    """Rows (block, id): the sets that share a gram of their prefixes."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(crowding)

    def shares(crowd: np.ndarray, key: int) -> np.ndarray:
        """Which share of a gram's sets this set is in, from 1; 0 where a gram isn't dealt. Shares double with the rows."""
        over = crowd.astype(np.int64) - dealt_from
        return np.where(over >= 0, 1 + key % (2 << np.minimum(np.maximum(over, 0) // 2, 16)), 0)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowding, seen = shared.value, set()
        for batch in pieces(batches):
            texts = batch.column(0).to_pylist()
            for i, j in byte_slices(texts):
                grams, ids, sizes, tags = [], [], [], []
                for s in sets_of(texts[i:j], n, seed):
                    if not len(s) or (key := set_id(s)) in seen:
                        continue
                    if len(seen) >= REMEMBERED:  # copies that this lets through fall together behind the exchange
                        seen.clear()
                    seen.add(key)
                    crowd = crowding[_cells(s)]
                    order = np.lexsort((s, crowd))[: len(s) - (percent * len(s) + 99) // 100 + 1]
                    grams.append(s[order])
                    ids.append(np.full(len(order), key[0]))
                    sizes.append(np.full(len(order), len(s), dtype=np.int32))
                    tags.append((crowd[order].astype(np.int64) << 20 | shares(crowd[order], key[0])).astype(np.int32))
                if grams:
                    yield _batch({"gram": (np.concatenate(grams).view(np.int64), pa.int64()), "tag": (np.concatenate(tags), pa.int32()), "id": (np.concatenate(ids), pa.int64()), "size": (np.concatenate(sizes), pa.int32())})

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in the order of gram, tag, size and id. Whole grams are taken up, a batch of rows or one gram at a time."""
        held: list[list[np.ndarray]] = []
        for batch in batches:
            got = [c.to_numpy() for c in batch.columns]
            edges = np.flatnonzero((got[0][1:] != got[0][:-1]) | (got[1][1:] != got[1][:-1]))
            cut_at = int(edges[-1]) + 1 if len(edges) else 0
            if held and not cut_at and (held[-1][0][-1], held[-1][1][-1]) != (got[0][0], got[1][0]):
                yield found_in(held)
                held = []
            elif cut_at:
                yield found_in([*held, [g[:cut_at] for g in got]])
                held = []
            held.append([g[cut_at:] for g in got])
        if held:
            yield found_in(held)
        give_back()

    def found_in(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        gram, tag, key, size = (np.concatenate([g[i] for g in parts]) for i in range(4))
        size = size.astype(np.int64)
        fresh = np.r_[True, (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])]
        gram, tag, key, size = gram[fresh], tag[fresh], key[fresh], size[fresh]
        dealt = tag % (1 << 20) > 0
        # a gap of sizes that no link spans ends a block too, but not where a gram's sets are dealt out
        gap = (gram[1:] != gram[:-1]) | (tag[1:] != tag[:-1]) | ((100 * size[:-1] < percent * size[1:]) & ~dealt[1:])
        start = np.flatnonzero(np.r_[True, gap])
        members = np.diff(np.r_[start, len(gram)])
        # a block is named by its members; of a dealt gram, by the gram
        name = mix(np.add.reduceat(mix(key.view(np.uint64)), start)) >> np.uint64(1)
        name = np.where(dealt[start], mix(gram[start].view(np.uint64)) >> np.uint64(1), name)
        kept = np.repeat((members > 1) | dealt[start], members)
        name = np.repeat(name, members)[kept].view(np.int64)
        return _batch({"block": (name, pa.int64()), "id": (key[kept], pa.int64())})

    rows = df.select("text").mapInArrow(prefixes, "gram long, tag int, id long, size int")
    found = rows.repartition("gram", "tag").sortWithinPartitions("gram", "tag", "size", "id").mapInArrow(blocks, "block long, id long")
    return found.distinct()


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list, pa.Table]]:
    """The groups of rows that are equal and adjacent in the first columns."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        names = list(zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True))
        start = 0
        for i in range(1, len(names) + 1):
            if i == len(names) or names[i] != names[start]:
                if current is not None and names[start] != current:
                    yield list(current), pa.Table.from_batches(held)
                    held = []
                current = names[start]
                held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield list(current), pa.Table.from_batches(held)
    give_back()


def _paired(now: DataFrame, sizes: DataFrame, percent: int, most: int) -> DataFrame:
    """Deal the sets of blocks that still hold several components to pairs of cells: (block, low, high, id, component).

    A cell holds about ``most`` sets of one range of sizes, all of the block's largest component or none. Sets of
    ranges that do not touch cannot link, and those of the largest component need not meet each other.
    """
    now = now.join(sizes.select("id", "size"), "id")
    per = now.groupBy("block", "component").agg(F.count("*").alias("n"))
    largest = per.groupBy("block").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count("*").alias("components")).where("components > 1")
    span = F.floor(F.log("size") / math.log(100 / percent) + 1e-9).cast("int").alias("span")
    now = now.join(largest, "block").select("block", "id", "component", (F.col("component") == F.col("largest")).alias("within"), span)
    cells = now.groupBy("block", "within", "span").agg(F.ceil(F.count("*") / most).cast("int").alias("chunks"))
    lists = cells.groupBy("block").agg(F.collect_list(F.struct("within", "span", "chunks")).alias("cells"))
    now = now.join(cells, ["block", "within", "span"])
    own = F.struct("within", "span", F.pmod(F.xxhash64("id"), F.col("chunks").cast("long")).cast("int").alias("chunk"))
    near = F.filter("cells", lambda c: (F.abs(c["span"] - F.col("span")) <= 1) & ~(c["within"] & F.col("within")))
    partners = F.flatten(F.transform(near, lambda c: F.transform(F.sequence(F.lit(0), c["chunks"] - 1), lambda k: F.struct(c["within"].alias("within"), c["span"].alias("span"), k.alias("chunk")))))
    now = now.join(lists, "block").select("block", "id", "component", own.alias("own"), F.explode(partners).alias("other"))
    return now.select("block", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "id", "component")


def _join(blocks: DataFrame, payload: DataFrame, sizes: DataFrame, percent: int, most: int, exact: bool) -> DataFrame:
    """Pairs (a, b) that connect, over all blocks (block, id), what joins_within connects in each."""
    cell = ["block", "low", "high"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _grouped(batches, 3):
            ids, components = group.column(3).to_numpy(), group.column(4).to_numpy()
            held = [np.frombuffer(b, dtype=np.uint64) for b in group.column(6).to_pylist()]
            bits = [bitmap(s) for s in held] if exact else held
            pairs = joins_within(group.column(5).to_numpy(), bits, components, percent, held if exact else None)
            if pairs:
                yield _batch({"a": ([ids[i] for i, _ in pairs], pa.int64()), "b": ([ids[j] for _, j in pairs], pa.int64())})

    def searched(now: DataFrame) -> DataFrame:
        rows = now.join(payload, "id").select(*(F.xxhash64(c).alias(c) if turn == "pairs" and c != "block" else F.col(c) for c in cell), "id", "component", *payload.columns[1:])
        return rows.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(search, "a long, b long").distinct()

    turn = "alone"
    counts = blocks.groupBy("block").agg(F.count("*").alias("members"))
    large = cut(counts.where(F.col("members") > most))
    if large.isEmpty():
        return cut(searched(blocks.select("block", F.lit(0).alias("low"), F.lit(0).alias("high"), "id", F.col("id").alias("component"))))
    pairs, labels = None, None
    for turn in ("alone", "heads", "pairs"):
        now = blocks.join(large if turn != "alone" else counts, "block")
        if labels is None:
            now = now.withColumn("component", F.col("id"))
        else:
            now = now.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        if turn == "heads":
            now = now.groupBy("block", "component").agg(F.min("id").alias("id"), F.max("members").alias("members"))
        if turn == "pairs":
            now = _paired(now, sizes, percent, most)
        else:
            chunk = F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / most).cast("long")).cast("int")
            now = now.select("block", chunk.alias("low"), chunk.alias("high"), "id", "component")
        found = searched(now)
        pairs = cut(found if pairs is None else pairs.unionByName(found))
        labels = components_of(pairs)
    return pairs


def _whole_sets(docs: DataFrame, wanted: DataFrame, n: int, seed: int) -> DataFrame:
    """(id, size, grams) of the wanted sets (id, mark)."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in byte_slices(texts):
                pairs = [(k, s) for k, s in zip(ids[i:j], sets_of(texts[i:j], n, seed), strict=True) if len(s) and set_id(s)[0] == k]
                yield _batch({"id": ([k for k, _ in pairs], pa.int64()), "size": ([len(s) for _, s in pairs], pa.int64()), "grams": ([s.tobytes() for _, s in pairs], pa.binary())})

    if wanted.count() <= BROADCAST:
        wanted = F.broadcast(wanted)
    return docs.join(wanted, "mark").select("id", "text").dropDuplicates(["id"]).mapInArrow(fetch, "id long, size long, grams binary")


def components_of(links: DataFrame) -> DataFrame:
    """(id, component): the least id that links reach, for each id in a link. Alternating large and small stars.

    Tasks are as many as the links need, at ``EDGES`` each: with more, files of almost nothing would fill the disk.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
        before, tasks = now, now["n"] // EDGES + 1
        edges = edges.coalesce(tasks)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct().coalesce(tasks)
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v")
        edges = cut(small.coalesce(tasks).distinct().coalesce(tasks))


def near_components(df: DataFrame, n: int = N, percent: int = LEAST, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id of the component)."""
    docs = id_and_text(df, id_col, text_col).select("doc_id", F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
    seed = 0
    while True:
        signatures = cut(_signatures(docs.select("doc_id", "text", "mark"), n, seed))
        texts = signatures.where("slice is null").select("doc_id", "mark", "size", "id", "check", "bits")
        sizes = texts.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("first_id"), F.min("mark").alias("mark"), F.min("size").alias("size"), F.min("bits").alias("bits"), F.min("check").alias("low"), F.max("check").alias("high"))
        sizes = cut(sizes)
        if sizes.where("low <> high").isEmpty():
            break
        seed += 1
    blocks = cut(_candidates(docs, *_crowding(signatures), n, seed, percent))
    clusters = components_of(_join(blocks, sizes.select("id", "size", "bits"), sizes, percent, most, exact=False))
    clusters = clusters.select(F.col("component").alias("block"), "id")
    wanted = cut(clusters.select("id").join(sizes.select("id", "mark"), "id"))
    labels = components_of(_join(clusters, _whole_sets(docs, wanted, n, seed), sizes, percent, most, exact=True))
    grouped = sizes.select("id", "first_id").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    owner = grouped.join(least, "component").select("id", "component_id")
    own = texts.where("id is null").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return texts.where("id is not null").join(owner, "id").select("doc_id", F.col("size").alias("n_shingles"), "component_id").unionByName(own)
