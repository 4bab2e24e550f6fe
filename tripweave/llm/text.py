"""Array helpers over the UTF-8 bytes of an Arrow column: words, word hashes, runs of k words.

All byte tables work on UTF-8 because a byte of 0x80 or more always belongs to a character above 0x7F.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes handled at once; bounds the working arrays of a task (a single longer text is handled whole).
PIECE_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


def free_name(name: str, taken) -> str:
    """A column name that is not taken yet."""
    while name in taken:
        name += "_"
    return name


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table of 256 with the given inclusive ranges set."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z.
ALNUM = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: ``[^\x20\x09-\x0D]``
NOT_BLANK = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: A-Z to a-z, all else itself.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def pieces(batch: pa.RecordBatch, column: str, target: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for row ranges of about ``target`` bytes; null counts as empty."""
    texts = batch.column(column).cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + target, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes inside each text, and each text's first run (n + 1 bounds)."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = member[data]
    first = np.empty(len(data), bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    last = np.empty(len(data), bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    cuts = offsets[1:] - 1
    last[cuts[cuts >= 0]] = True
    starts = np.flatnonzero(inside & first)
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


@lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def power(base: int) -> np.ndarray:
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    return power(_ODD), power(_ODD_INVERSE)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, at least ``size`` of them."""
    return _powers(1 << max(20, int(size).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over the word."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; equal bytes have equal hashes wherever they stand."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k hashes from each position on; shorter than the input by k - 1."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(_ODD) + hashes[j : j + n]
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def starts_within(bounds: np.ndarray, length: int, n: int) -> np.ndarray:
    """Mask over n positions: a run of ``length`` words from here stays inside its text."""
    good = np.zeros(n, bool)
    if not n:
        return good
    row_end = np.repeat(bounds[1:], np.diff(bounds))[:n]
    return np.arange(n) + length <= row_end


def row_of(bounds: np.ndarray) -> np.ndarray:
    """Text number of each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
