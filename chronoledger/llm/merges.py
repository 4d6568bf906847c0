"""Byte-pair merges over many sequences at once, in flat numpy arrays.

The symbols of all sequences lie in one array; a second array names each
symbol's sequence. Every adjacent pair is looked up by binary search in the
sorted keys of the merge table, once at the start and again only beside a merge.
A round takes each sequence's lowest rank and merges it in all sequences at the
same time. Sequences without a pair leave the arrays.

Exactness: a sequential encoder merges the leftmost pair of lowest rank. All
non-overlapping places of that merge may be taken in one round unless its result
can form a pair of a lower or equal rank; for such merges (``chain`` below) only
the leftmost place is taken.

Long sequences (over ``LONG`` symbols, as unbroken text gives) would need a round for
each of their ranks. There a round takes every place whose rank is the lowest within
``near`` symbols on either side. That is twice what the longest piece holds, so
whatever merges earlier elsewhere ends in a symbol that cannot reach the place, nor
anything that the place's own merge brings about. Of equal ranks within that distance
all go together, from the left, up to one that must wait for a lower rank or whose merge
may form a pair of no higher rank with its neighbours (a loud one). Rounds then depend on the
pieces' length, not on the text's. Only texts that repeat one loud pattern throughout
would crawl; what such rounds leave goes through a queue by rank and place, so that
time stays in proportion to the text (but for a logarithm), and memory is some 60
bytes a symbol.
"""

from __future__ import annotations

from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np

NONE = np.int64(1) << 60
#: Symbols from which a sequence counts as long; rounds in a row with hardly a merge after which the queue takes over.
LONG, SLOW_ROUNDS = 256, 64
_FAR = -(1 << 60)


class MergeTable:
    """Pairs of symbol ids with their rank and result, sorted by pair."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, result: np.ndarray):
        left, right, rank, result = (np.asarray(x, dtype=np.int64) for x in (left, right, rank, result))
        keys = (left << 32) | right
        order = np.lexsort((rank, keys))
        keys = keys[order]
        first = np.ones(len(keys), dtype=bool)
        first[1:] = keys[1:] != keys[:-1]
        order = order[first]
        self.keys, self.rank, self.result = keys[first], rank[order], result[order]
        self.order = np.r_[self.rank, NONE]  # the last, at -1, is of no entry
        left, right = left[order], right[order]
        size = int(max([0, *(x.max() for x in (left, right, self.result) if len(x))])) + 1
        self.chain = self._chaining(left, right, size)
        self.near = 2 * self._longest(left, right, size) + 2

    def _chaining(self, left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
        """Entries whose result takes part in a pair of no higher rank."""
        lowest = np.full(size, NONE)
        np.minimum.at(lowest, left, self.rank)
        np.minimum.at(lowest, right, self.rank)
        return lowest[self.result] <= self.rank

    def _longest(self, left: np.ndarray, right: np.ndarray, size: int) -> int:
        """Most symbols that a result is made of."""
        holds = np.ones(size, dtype=np.int64)
        for _ in range(1000):
            more = holds.copy()
            np.maximum.at(more, self.result, holds[left] + holds[right])
            if (more == holds).all():
                return int(holds.max())
            holds = more
        raise ValueError("a piece of the merge table is part of itself, or too long")

    def _look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The entry of each pair, -1 where there is none; negative symbols have none."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def _entries(self, symbols: np.ndarray, sequence: np.ndarray) -> np.ndarray:
        """The entry of each symbol's pair with the next one of its sequence."""
        entry = np.full(len(symbols), -1)
        if len(self.keys):
            entry[:-1] = np.where(sequence[:-1] == sequence[1:], self._look(symbols[:-1], symbols[1:]), -1)
        return entry

    def _applied(self, place: np.ndarray, symbols: np.ndarray, sequence: np.ndarray, entry: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
        """The arrays after the merges at ``place``, which do not overlap; pairs beside a merge are looked up anew."""
        symbols[place] = self.result[entry[place]]
        keep = np.ones(len(symbols), dtype=bool)
        keep[place + 1] = False
        symbols, sequence, entry, *others = (x[keep] for x in (symbols, sequence, entry, *others))
        at = place - np.arange(len(place))
        beside = np.concatenate([at, at[at > 0] - 1])
        after = np.minimum(beside + 1, len(symbols) - 1)
        pair = (after > beside) & (sequence[beside] == sequence[after])
        entry[beside] = np.where(pair, self._look(symbols[beside], symbols[after]), -1)
        return [symbols, sequence, entry, *others]

    @staticmethod
    def _alternate(place: np.ndarray) -> np.ndarray:
        """Of overlapping places every second one of a run, from its left end."""
        new_run = np.r_[True, place[1:] != place[:-1] + 1]
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(place)), 0))
        return place[(np.arange(len(place)) - run_start) % 2 == 0]

    def merge(self, symbols: np.ndarray, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge until no pair is left. ``sequence`` ascends; negative symbols never merge.

        Returns the remaining symbols and their sequences, in order.
        """
        symbols, sequence = symbols.astype(np.int64), sequence.astype(np.int64)
        if not len(symbols) or not len(self.keys):
            return symbols, sequence
        starts = np.flatnonzero(np.r_[True, sequence[1:] != sequence[:-1]])
        lengths = np.diff(np.r_[starts, len(symbols)])
        long = np.repeat(lengths > LONG, lengths)
        done = self._short(symbols[~long], sequence[~long])
        if long.any():
            done += self._long(symbols[long], sequence[long])
        symbols, sequence = (np.concatenate([x[i] for x in done]) for i in (0, 1))
        order = np.argsort(sequence, kind="stable")
        return symbols[order], sequence[order]

    def _short(self, symbols: np.ndarray, sequence: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        done = [(symbols[:0], sequence[:0])]
        entry = self._entries(symbols, sequence)
        while len(symbols):
            rank = self.order[entry]
            starts = np.flatnonzero(np.r_[True, sequence[1:] != sequence[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(symbols)]))
            live = least < NONE
            if not live.all():
                done.append((symbols[~live], sequence[~live]))
                symbols, sequence, entry, rank, least = (x[live] for x in (symbols, sequence, entry, rank, least))
                if not len(symbols):
                    break
            place = self._alternate(np.flatnonzero(rank == least))
            chain = self.chain[entry[place]]
            if chain.any():
                place = place[np.r_[True, sequence[place][1:] != sequence[place][:-1]] | ~chain]
            symbols, sequence, entry = self._applied(place, symbols, sequence, entry)
        return done

    @staticmethod
    def _window_least(x: np.ndarray, left: int, right: int) -> np.ndarray:
        """The least of x from ``left`` places before each place to ``right`` after it: of a block's end and the next block's beginning."""
        width, n = left + right + 1, len(x)
        padded = np.full((n + 2 * width) // width * width, NONE)
        padded[left : left + n] = x
        blocks = padded.reshape(-1, width)
        before = np.minimum.accumulate(blocks, axis=1).ravel()
        after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(after[:n], before[width - 1 : width - 1 + n])

    def _ready(self, rank: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Places of the lowest rank near them, but none that is near, and right of, one of its rank that must wait itself."""
        place = np.flatnonzero((rank == low) & (rank < NONE))
        waiting = self._window_least(np.where(rank > low, rank, NONE), self.near, -1)[place] == rank[place]
        number = np.arange(len(place))
        group = np.maximum.accumulate(np.where(np.diff(place, prepend=_FAR) > self.near, number, 0))  # places near each other are of one rank
        return place[np.maximum.accumulate(np.where(waiting, number, -1)) < group]

    def _loud(self, place: np.ndarray, symbols: np.ndarray, sequence: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Places whose merge may form a pair of no higher rank with a neighbour, as it is or as its own merge leaves it."""
        found = entry[place]
        loud = self.chain[found]
        c = np.flatnonzero(loud)
        at, own, result = place[c], self.rank[found[c]], self.result[found]
        hit = np.zeros(len(c), dtype=bool)
        for beside, other, distance in ((at - 1, c - 1, -2), (at + 2, c + 1, 2)):
            inside = np.clip(beside, 0, len(symbols) - 1)
            near = (inside == beside) & (sequence[inside] == sequence[at])
            known = np.clip(other, 0, len(place) - 1)
            merged = near & (known == other) & (place[known] == at + distance)
            for symbol in (np.where(near, symbols[inside], -1), np.where(merged, result[known], -1)):
                left, right = (symbol, result[c]) if distance < 0 else (result[c], symbol)
                hit |= self.order[self._look(left, right)] <= own
        loud[c] = hit
        return loud

    def _long(self, symbols: np.ndarray, sequence: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """As ``_short``; regions of symbols near which nothing merges any more leave the arrays."""
        where, region, first = np.arange(len(symbols)), sequence, sequence
        entry = self._entries(symbols, region)
        done, slow = [], 0
        while True:
            rank = self.order[entry]
            low = self._window_least(rank, self.near, self.near)
            live = low < NONE
            if 2 * np.count_nonzero(live) < len(live):
                done.append((symbols[~live], where[~live]))
                at = np.flatnonzero(live)
                if not len(at):
                    break
                region = np.cumsum(np.r_[True, (at[1:] != at[:-1] + 1) | (region[at[1:]] != region[at[:-1]])])
                symbols, where, entry, rank, low = (x[at] for x in (symbols, where, entry, rank, low))
            place = self._alternate(self._ready(rank, low))
            loud = self._loud(place, symbols, region, entry)
            if loud.any():
                before = np.r_[_FAR, np.maximum.accumulate(np.where(loud, place, _FAR))[:-1]]
                place = place[place - before > self.near]
            slow = slow + 1 if 16 * self.near * len(place) < len(symbols) else 0
            if slow > SLOW_ROUNDS:
                left = self._queue(symbols, region, entry)
                done.append((left[1], where[left[0]]))
                break
            symbols, region, entry, where = self._applied(place, symbols, region, entry, where)
        symbols, where = (np.concatenate([x[i] for x in done]) for i in (0, 1))
        order = np.argsort(where)
        return [(symbols[order], first[where[order]])]

    @cached_property
    def _numbers(self) -> dict[int, int]:
        return {k: i for i, k in enumerate(self.keys.tolist())}

    def _queue(self, symbols: np.ndarray, sequence: np.ndarray, entry: np.ndarray) -> tuple[list[int], list[int]]:
        """One merge at a time, lowest rank and leftmost first: the places and symbols that remain."""
        number, rank, result = self._numbers, self.rank.tolist(), self.result.tolist()
        n, symbol, own = len(symbols), symbols.tolist(), entry.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        same = (sequence[1:] == sequence[:-1]).tolist() + [False]  # whether a symbol's follower is of its sequence
        queue = [rank[e] * n + i for i, e in enumerate(own) if e >= 0]
        heapify(queue)
        while queue:
            r, i = divmod(heappop(queue), n)
            e = own[i]
            if e < 0 or rank[e] != r:
                continue
            j = after[i]
            symbol[i], own[j], same[i] = result[e], -2, same[j]  # -2: gone
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0:
                    own[k] = number.get(symbol[k] << 32 | symbol[after[k]], -1) if same[k] and symbol[k] >= 0 and symbol[after[k]] >= 0 else -1
                    if own[k] >= 0:
                        heappush(queue, rank[own[k]] * n + k)
        kept = [i for i in range(n) if own[i] != -2]
        return kept, [symbol[i] for i in kept]
