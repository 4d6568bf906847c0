"""Words of many texts at once: their places and 64-bit hashes, in flat numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Bytes of text handled at a time; bounds a worker's memory.
SLICE_BYTES = 1_000_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Letters, digits and all bytes of non-ASCII characters; everything but white space; sentence ends.
ALNUM = byte_class((48, 57), (65, 90), (97, 122), (128, 255))
NOT_SPACE = ~byte_class((32, 32), (9, 13))
SENTENCE_END = byte_class((10, 10), (33, 33), (46, 46), (63, 63))

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over 64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE), np.full(size, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@dataclass
class Words:
    """Places are byte offsets into ``data``, the texts joined by line breaks."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    text: np.ndarray  # ordinal of each word's text
    text_start: np.ndarray  # offset of each text
    prefixes: list[tuple[np.ndarray, np.ndarray]]  # for each length asked for: ordinals of words that long, hashes


def fold32(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32)


def find_words(texts: list[bytes], inside: np.ndarray = NOT_SPACE, fold: bool = True, prefixes: tuple[int, ...] = ()) -> Words:
    """The maximal runs of ``inside`` bytes of each text; A-Z count as a-z in hashes if ``fold``.

    ``prefixes`` are lengths in bytes for which words of that length at least also get the hash of their beginning.
    """
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined, dtype=np.uint8)
    data = _FOLD[raw] if fold else raw
    mask = np.zeros(len(raw) + 1, dtype=bool)
    mask[1:] = inside[raw]
    edge = np.flatnonzero(mask[1:] != mask[:-1])
    start, end = edge[0::2], edge[1::2]  # the joined bytes end outside a word
    size = 1 << max(20, (len(raw)).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    value = (total[end] - total[start]) * down[start]
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    ends = np.cumsum(lengths)
    parts = []
    for k in prefixes:
        at = np.flatnonzero(end - start >= k)
        parts.append((at, mix((total[start[at] + k] - total[start[at]]) * down[start[at]] + np.uint64(k << 40))))
    return Words(raw, start, end, mix(value + (end - start).astype(np.uint64)), np.searchsorted(ends, start, side="right"), ends - lengths, parts)


def byte_slices(texts: list[bytes], most: int = SLICE_BYTES):
    """Ranges of rows of about ``most`` bytes; a longer text makes a range of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def count_words(text: bytes, inside: np.ndarray = NOT_SPACE) -> int:
    """How many words find_words has for a text, without finding them."""
    mask = inside[np.frombuffer(text, dtype=np.uint8)]
    return int(np.count_nonzero(mask[1:] & ~mask[:-1])) + int(mask[:1].sum())
