"""Fixed-length training rows from documents: token ids, best-fit-decreasing packing, binary matrices.

Every document is encoded whole and closed by an end token; a document longer than a row is cut into parts of one row each and a
rest, so nothing is lost. Parts are packed by decreasing length, each into the fullest open row that still takes it; a
segment tree over free capacities finds that row in logarithmic time. Packing runs inside the input splits, on a window of
tokens at a time: no shuffle, bounded memory, and a lost task packs the same rows again.

A packed row holds its ids (little-endian int32, padded with the end token), the cumulative lengths of its segments and the position of
every token in its segment, which starts anew at each one (int32, 0 on padding).

Null and empty texts are an end token alone. Repeated rows are packed as often as they occur. A null id stays null among a row's ids. Empty tables
give no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

#: Tokens of a row, and tokens that are packed together at least.
CAPACITY, WINDOW = 2048, 2_000_000


class FreeSpace:
    """Segment tree over capacities 0..most: how many open rows have exactly so much room."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, change: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += change
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The least room of ``need`` or more that an open row has."""
        at = need + self.size
        if self.count[at]:
            return need
        while at > 1:  # up to the first right neighbour with rows, then down its left edge
            if not at & 1 and self.count[at + 1]:
                at += 1
                break
            at >>= 1
        else:
            return None
        while at < self.size:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.size


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows as lists of item numbers; every length is between 1 and ``capacity``."""
    free, rows = FreeSpace(capacity), []
    open_rows: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[item]
        room = free.tightest(n)
        if room is None:
            rows.append([])
            row, room = len(rows) - 1, capacity
        else:
            row = open_rows[room].pop()
            free.add(room, -1)
        rows[row].append(item)
        open_rows[room - n].append(row)
        free.add(room - n, 1)
    return rows


@lru_cache(2)
def rank_encoder(path: str, pattern: str) -> tiktoken.Encoding:
    """Encoding of a file of ranks, once per Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


Encode = Callable[[str], list[int]]
SCHEMA = "shard int, row_no long, n_tokens int, cu_seqlens array<int>, doc_ids array<{id}>, parts array<int>, ids binary, positions binary"


def packed(window: list[tuple[object, int, np.ndarray]], capacity: int, end: int) -> Iterator[tuple]:
    """Rows of SCHEMA from ``row`` on, of parts (doc_id, part number, ids)."""
    for items in best_fit_decreasing([len(ids) for _, _, ids in window], capacity):
        lengths = [len(window[i][2]) for i in items]
        total = sum(lengths)
        ids = np.full(capacity, end, "<i4")
        ids[:total] = np.concatenate([window[i][2] for i in items])
        positions = np.zeros(capacity, "<i4")
        positions[:total] = np.concatenate([np.arange(n) for n in lengths])
        yield total, np.cumsum([0, *lengths]).tolist(), [window[i][0] for i in items], [window[i][1] for i in items], ids.tobytes(), positions.tobytes()


def pack(docs: DataFrame, encoder: Callable[[], Encode], end: int, capacity: int = CAPACITY, window: int = WINDOW) -> DataFrame:
    """Packed rows of ``docs`` (doc_id, text); ``encoder`` is called on the executors. (shard, row_no) names a row."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, shard, row_no = encoder(), TaskContext.get().partitionId(), 0
        parts: list[tuple[object, int, np.ndarray]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal row_no, held
            rows = list(packed(parts, capacity, end))
            for low in range(0, len(rows), 256):
                some = rows[low : low + 256]
                columns = list(zip(*some, strict=True))
                types = (pa.int32(), pa.list_(pa.int32()), None, pa.list_(pa.int32()), pa.binary(), pa.binary())
                arrays = [pa.array(c, id_list if t is None else t) for c, t in zip(columns, types, strict=True)]
                numbers = pa.array(range(row_no, row_no + len(some)), pa.int64())
                row_no += len(some)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(some), pa.int32()), numbers, *arrays], names)
            parts.clear()
            held = 0

        for batch in batches:
            id_list = pa.list_(batch.column("doc_id").type)
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end], "<i4")
                parts += [(doc.as_py(), n, ids[at : at + capacity]) for n, at in enumerate(range(0, len(ids), capacity))]
                held += len(ids)
                if held >= window:
                    yield from flush()
        if parts:
            yield from flush()

    schema = SCHEMA.format(id=kind.simpleString())
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def write_packed(rows: DataFrame, path: str) -> None:
    """Packed rows as Parquet files, in the order of their shards."""
    rows.write.mode("overwrite").parquet(path)


def matrix(ids: list[bytes], capacity: int = CAPACITY) -> np.ndarray:
    """The ids or positions of some packed rows as one int32 matrix."""
    return np.frombuffer(b"".join(ids), "<i4").reshape(-1, capacity)
