"""Byte-level BPE by speculation: greedy longest match, a check of every neighbouring pair, exact merging of what fails.

A sequence of tokens is the BPE encoding of its bytes if and only if every two neighbours are the encoding of their own
joint bytes. So a whole batch of distinct words is cut greedily, all neighbouring pairs are tested at once by undoing
their merges, and only words with a failing pair are merged step by step.

Null text is empty; an empty text has no tokens; texts of any length are handled whole; repeated rows stay repeated.
Columns besides the text are kept, and one that has the name of an output column is replaced.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words whose encoding a Python worker remembers; a bound on memory, not on results.
CACHE_WORDS = 150_000
NEVER = np.iinfo(np.int32).max
#: Bytes of the longest word that is merged in a matrix of all failing words; longer ones go through a heap.
MATRIX_BYTES = 32
# fixed values of the byte-level format: its splitting pattern and its printable bytes
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
PATTERN = rf"{CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+|\s+(?!\S)|\s+"
PRINTABLE = [(0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)]


def byte_letters() -> dict[str, int]:
    """Letter that stands for each byte in a vocabulary file -> the byte; unprintable bytes take letters from 256 on."""
    plain = {b for low, high in PRINTABLE for b in range(low, high + 1)}
    spare = iter(range(256, 512))
    return {chr(b if b in plain else next(spare)): b for b in range(256)}


@lru_cache(1)
def latin_pattern() -> re.Pattern:
    """PATTERN for texts without characters above 0xFF, where the plain regular expressions are several times faster."""
    of = lambda kinds: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] in kinds)
    letter, number, white = of("L"), of("N"), "\\t-\\r \\x85\\xa0"
    return re.compile(rf"{CONTRACTIONS}| ?[{letter}]+| ?[{number}]+| ?[^{white}{letter}{number}]+|[{white}]+(?![^{white}])|[{white}]+")


class ByteBpe:
    """Tables of one vocabulary file, and the encoding of word lists."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        spell = lambda token: bytes(letters[c] for c in token)
        vocab = {spell(token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        #: (left, right) -> (rank, token); and by token its rank and its two parts
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.left, self.right = np.arange(size), np.arange(size)
        self.rank = np.full(size, -1)
        for rank, (a, b) in enumerate(merges):
            left, right = vocab[spell(a)], vocab[spell(b)]
            token = vocab[self.bytes_of[left] + self.bytes_of[right]]
            if (left, right) not in self.merge:
                self.merge[left, right] = (rank, token)
            if self.rank[token] < 0:
                self.left[token], self.right[token], self.rank[token] = left, right, rank
        pairs = np.array(sorted((a * size + b, rank, token) for (a, b), (rank, token) in self.merge.items()))
        self.pair_keys, self.pair_ranks, self.pair_tokens = (np.ascontiguousarray(c) for c in pairs.T)
        self.size = size
        self.byte_token = np.array([vocab[bytes([b])] for b in range(256)])
        self._build_trie(vocab)
        self.pattern, self.latin = regex.compile(PATTERN), latin_pattern()
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def _build_trie(self, vocab: dict[bytes, int]) -> None:
        child: dict[int, int] = {}
        token_at = [-1]
        for token, i in vocab.items():
            node = 0
            for b in token:
                key = node * 256 + b
                node = child.setdefault(key, len(token_at))
                if node == len(token_at):
                    token_at.append(-1)
            token_at[node] = i
        self.edge_keys = np.array(sorted(child), np.int64)
        self.edge_nodes = np.array([child[k] for k in self.edge_keys.tolist()], np.int64)
        self.token_at = np.array(token_at, np.int64)
        # most nodes have few edges: a node's edges lie side by side, so its first edge and a byte map narrow the search
        self.root = np.zeros(256, np.int64)
        self.root[self.edge_keys[self.edge_keys < 256]] = self.edge_nodes[self.edge_keys < 256]

    def _longest(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest token from each place: its id and where it ends."""
        node = self.root[data[at]]
        best, stop = self.token_at[node].copy(), at + 1
        alive, where = np.arange(len(at)), at + 1
        keep = where < end
        alive, node, where = alive[keep], node[keep], where[keep]
        while len(alive):
            key = node * 256 + data[where]
            j = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            hit = self.edge_keys[j] == key
            alive, node, where = alive[hit], self.edge_nodes[j[hit]], where[hit] + 1
            token = self.token_at[node]
            known = token >= 0
            best[alive[known]], stop[alive[known]] = token[known], where[known]
            more = where < end[alive]
            alive, node, where = alive[more], node[more], where[more]
        return best, stop

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair (a, b) is the encoding of its joint bytes.

        Undo, latest merge first, what made a's right edge and b's left edge. The two pieces that face each other at any
        time must not be mergeable before the merge that took one of them away.
        """
        good = np.ones(len(a), bool)
        left, right, limit = a.copy(), b.copy(), np.full(len(a), np.iinfo(np.int64).max)
        open_ = np.arange(len(a))
        while len(open_):
            x, y = left[open_], right[open_]
            key = x * self.size + y
            j = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            # twice the rank: of two equal merges the left one comes first, hence the odd limit for the right side
            clash = (self.pair_keys[j] == key) & (2 * self.pair_ranks[j] < limit[open_])
            good[open_[clash]] = False
            rx, ry = self.rank[x], self.rank[y]
            done = clash | ((rx < 0) & (ry < 0))
            undo_left = rx > ry
            limit[open_] = np.where(undo_left, 2 * rx, 2 * ry + 1)
            left[open_] = np.where(undo_left, self.right[x], x)
            right[open_] = np.where(undo_left, y, self.left[y])
            open_ = open_[~done]
        return good

    def merge_exactly(self, word: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals, by a heap over a linked list."""
        ids = self.byte_token[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        if n < 2:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merge = self.merge
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, token = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = token, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merge.get((token, ids[k])):
                    heapq.heappush(heap, (m[0], i, token, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := merge.get((ids[h], token))):
                heapq.heappush(heap, (m[0], h, ids[h], token, m[1]))
        return [t for t in ids if t >= 0]

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and token of merging each pair; NEVER and anything where there is no such merge or a side is missing."""
        key = a.astype(np.int64) * self.size + b
        j = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        found = (self.pair_keys[j] == key) & (a >= 0) & (b >= 0)
        return np.where(found, self.pair_ranks[j], NEVER).astype(np.int32), self.pair_tokens[j].astype(np.int32)

    def merge_all(self, raw: list[bytes]) -> list[list[int]]:
        """Exact merging of many words side by side: each round merges every word's lowest, leftmost pair."""
        lengths = np.array([len(r) for r in raw])
        width = int(lengths.max()) + 1
        ids = np.full((len(raw), width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.byte_token[np.frombuffer(b"".join(raw), np.uint8)]
        rank, token = self.ranks_of(ids[:, :-1].ravel(), ids[:, 1:].ravel())
        rank, token = rank.reshape(len(raw), -1), token.reshape(len(raw), -1)
        done = np.full((len(raw), width), -1, np.int32)
        at = np.arange(len(raw))
        while len(at):
            j = rank.argmin(1)
            row = np.arange(len(at))
            live = rank[row, j] < NEVER
            if not live.all():
                done[at[~live]] = ids[~live]
                at, j, ids, rank, token = at[live], j[live], ids[live], rank[live], token[live]
                row = np.arange(len(at))
                if not len(at):
                    break
            ids[row, j] = token[row, j]
            columns = np.arange(width)
            shift = np.minimum(columns + (columns > j[:, None]), width - 1)
            ids = np.take_along_axis(ids, shift, 1)
            ids[:, -1] = -1
            shift = np.minimum(shift[:, :-1], width - 2)
            rank, token = np.take_along_axis(rank, shift, 1), np.take_along_axis(token, shift, 1)
            rank[:, -1] = NEVER
            rank[row, j], token[row, j] = self.ranks_of(ids[row, j], ids[row, j + 1])
            before = np.maximum(j - 1, 0)
            r, t = self.ranks_of(np.where(j > 0, ids[row, before], ids[row, j]), np.where(j > 0, ids[row, j], ids[row, j + 1]))
            rank[row, before], token[row, before] = r, t
        return [r[:n] for r, n in zip(done.tolist(), (done >= 0).sum(1).tolist(), strict=True)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian int32."""
        raw = [w.encode() for w in words]
        lengths = np.array([len(r) for r in raw])
        end = np.cumsum(lengths)
        data = np.frombuffer(b"".join(raw), np.uint8)
        at, word = end - lengths, np.arange(len(raw))
        got_word, got_id = [], []
        while len(word):
            token, at = self._longest(data, at, end[word])
            got_word.append(word)
            got_id.append(token)
            more = at < end[word]
            word, at = word[more], at[more]
        owner = np.concatenate(got_word)
        order = np.argsort(owner, kind="stable")
        owner, ids = owner[order], np.concatenate(got_id)[order]
        same = owner[:-1] == owner[1:]
        pair, back = np.unique(ids[:-1][same] * self.size + ids[1:][same], return_inverse=True)
        fails = ~self.compatible(pair // self.size, pair % self.size)[back]
        bad = np.unique(owner[:-1][same][fails])
        blob = ids.astype("<i4").tobytes()
        cut = np.searchsorted(owner, np.arange(len(raw) + 1)) * 4
        out = [blob[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        short = bad[lengths[bad] <= MATRIX_BYTES].tolist()
        if short:
            for w, got in zip(short, self.merge_all([raw[w] for w in short]), strict=True):
                out[w] = np.array(got, "<i4").tobytes()
        for w in bad[lengths[bad] > MATRIX_BYTES].tolist():
            out[w] = np.array(self.merge_exactly(raw[w]), "<i4").tobytes()
        return out

    def words(self, text: str) -> list[str]:
        """Words of a text; a special token is a word of its own."""
        if self.splitter and any(s in text for s in self.special):
            return [w for part in self.splitter.split(text) for w in ([part] if part in self.special else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        try:
            text.isascii() or text.encode("latin-1")
        except UnicodeEncodeError:
            return self.pattern.findall(text)
        return self.latin.findall(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the vocabulary's own library gives them without added tokens."""
        split = [self.words(t) for t in texts]
        cache = self.cache
        new = list({w for ws in split for w in ws if w not in cache})
        if len(cache) + len(new) > CACHE_WORDS:
            cache.clear()
            new = list({w for ws in split for w in ws})
        plain = [w for w in new if w not in self.special]
        if plain:
            cache.update(zip(plain, self.encode_words(plain), strict=True))
        for s, i in self.special.items():
            cache[s] = np.array([i], "<i4").tobytes()
        return [np.frombuffer(b"".join(map(cache.__getitem__, ws)), "<i4") for ws in split]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def vocabulary(path: str) -> ByteBpe:
    """Tables of a vocabulary file, once per Python worker."""
    return ByteBpe(path)


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])


def _put(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), values], [*names, name])


def encode(docs: DataFrame, vocab_path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds the token ids of every text and, on request, the text decoded from them in the same pass.

    ``vocab_path`` must be readable on the executors.
    """
    schema = _with(docs, ids, T.ArrayType(T.IntegerType()))
    if decoded:
        schema = T.StructType([*(f for f in schema.fields if f.name != decoded), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(vocab_path)
        for batch in batches:
            for part in _slices(batch, text):
                rows = bpe.encode([t or "" for t in part.column(text).to_pylist()])
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
                part = _put(part, ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())))
                yield _put(part, decoded, _texts(bpe, part.column(ids))) if decoded else part

    return docs.mapInArrow(run, schema)


def _texts(bpe: ByteBpe, column: pa.ListArray) -> pa.Array:
    flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    known = column.is_valid().to_numpy(zero_copy_only=False)
    rows = ((flat[i:j] if ok else flat[:0]) for i, j, ok in zip(offsets[:-1], offsets[1:], known, strict=True))
    return pa.array((bpe.decode(r.tolist()) for r in rows), pa.string(), size=len(column))


def decode(rows: DataFrame, vocab_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text that the token ids stand for; null ids give an empty text, broken UTF-8 the replacement character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(vocab_path)
        for batch in batches:
            yield _put(batch, text, _texts(bpe, batch.column(ids).cast(pa.list_(pa.int32()))))

    return rows.mapInArrow(run, _with(rows, text, T.StringType()))


def _slices(batch: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about ``most`` bytes of text each."""
    sizes = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + most, "right")))
        yield batch.slice(low, high - low)
        low = high


def digests(rows: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Count and checksums of encoded and decoded rows."""
    return rows.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col(ids).cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(decoded, 256).alias("decoded_sha256"),
    )
