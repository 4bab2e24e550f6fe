"""Repeated byte strings of the corpus: enhanced suffix arrays over sampled suffixes and their common-prefix interval trees.

Every window of ``length`` bytes has an anchor: the place of the smallest hash among its strings of ``GRAM`` bytes. Anchors depend on the
window's bytes alone, so equal windows have equal anchors at equal distance, and one suffix per anchor (about one in 140 bytes) stands for
all windows around it. The windows of an anchor cover one stretch of the text, its context.

1. Each document gives its contexts: hash of the anchor's string, 128-bit hash of the context, place. A stretch of equal neighbours (long
   repetitions of a short period) is one row with a count. Anchors whose string occurs once in the corpus go at once.
2. Equal contexts are counted with partial sums. A context that occurs twice is repeated as a whole, in all its places.
3. What is left are different contexts around the same anchor string, as at the edges of a passage. One copy of each meets the others of
   its bucket: a suffix array of what follows the anchor, longest common prefixes of neighbours, and a stack scan that gives the intervals
   of the common-prefix tree. Within an interval the occurrences are ordered by what precedes them; where preceding bytes differ a repeat
   ends to the left, and each occurrence learns how far it extends together with another one of the interval. If both sides make up
   ``length`` bytes, these bytes are repeated.
4. A bucket of more than ``BUCKET`` contexts is split: two occurrences that share ``length`` bytes share either the upper half of what is
   missing on the left, or the lower half on the right. Both halves are buckets of their own, so that a passage in a third of all
   documents halves what is open until a bucket is small or names a whole window, which needs no comparison. Nothing is dropped.
5. The stretches found go back to all places of their context (hot contexts by a bounded broadcast) and on to their documents.

Matches never cross documents and count within one. Rows that repeat doc_id and text are documents of their own with equal results. Null
texts are empty. A long text is worked on in blocks. Empty tables have no rows; further columns are not read. Strings are judged by the input,
never by what is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm import text as tx
from tripweave.llm.skew import lookup
from tripweave.sources.storage import stage, unstage

#: Bytes that must be repeated, bytes of an anchor string, different contexts that one task compares.
LENGTH, GRAM, BUCKET = 400, 128, 1024
#: Windows looked at together; a block number fits beside 40 bits of hash.
BLOCK = 1 << 22

_KEY = "k1 bigint, k2 bigint"
_PLACES = f"{_KEY}, start int, width int, off int, gram bigint, c1 bigint, c2 bigint, reps int, step int"


# ---- contexts of a document ---------------------------------------------------------------------------------------------------------


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, hash of its string) of every run of windows with one anchor; ``ends``: the text's end at each byte."""
    windows = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if windows <= 0:
        return none, none, none, none.astype(np.uint64)
    at = np.arange(len(data) - gram + 1)
    hashes = tx.hash_spans(data, at, at + gram)
    anchor, low = np.empty(windows, np.int64), np.uint64(0xFFFFFF)
    for b in range(0, windows, BLOCK):
        e = min(windows, b + BLOCK)
        part = hashes[b : e + length - gram]
        best = tx.sliding_min((part & ~low) | np.arange(len(part), dtype=np.uint64), length - gram + 1)
        anchor[b:e] = b + (best & low).astype(np.int64)
    s = np.flatnonzero(np.arange(windows) + length <= ends[:windows])
    if not len(s):
        return none, none, none, none.astype(np.uint64)
    p = anchor[s]
    new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)]))
    last = np.concatenate([new[1:], [len(s)]]) - 1
    return s[new], s[last], p[new], hashes[p[new]]


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = data.tobytes()
    both = b"".join(xxhash.xxh3_128_digest(raw[a:e]) for a, e in zip(starts.tolist(), ends.tolist(), strict=True))
    pairs = np.frombuffer(both, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def places(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Contexts of documents (k1, k2, text), equal neighbours as one row."""
    for batch in batches:
        k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
        for low, high, data, offsets in tx.pieces(batch, "text"):
            row_end = np.repeat(offsets[1:], np.diff(offsets))
            first, last, anchor, hashes = anchors(data, row_end, length, gram)
            if not len(first):
                continue
            c1, c2 = _digests(data, first, last + length)
            same = (c1[1:] == c1[:-1]) & (c2[1:] == c2[:-1]) & (first[1:] == last[:-1] + 1)
            head = np.flatnonzero(np.concatenate([[True], ~same]))
            reps = np.diff(np.concatenate([head, [len(first)]]))
            row = np.searchsorted(offsets, first[head], "right") - 1
            out = {
                "k1": k1[low + row], "k2": k2[low + row], "start": (first[head] - offsets[row]).astype(np.int32),
                "width": (last[head] + length - first[head]).astype(np.int32), "off": (anchor[head] - first[head]).astype(np.int32),
                "gram": hashes[head].view(np.int64), "c1": c1[head], "c2": c2[head], "reps": reps.astype(np.int32),
                "step": (last[head] - first[head] + 1).astype(np.int32),
            }
            yield pa.RecordBatch.from_pydict(out)


# ---- one bucket: suffix array, intervals, left extension ----------------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def suffix_array(strings: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the strings, and the common prefix of each with the one before it (0 for the first)."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    lcp = [0] + [common_prefix(strings[a], strings[b]) for a, b in zip(order[:-1], order[1:], strict=True)]
    return np.array(order), np.array(lcp)


def intervals(lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of every node of the common-prefix tree with two members or more, children first, by a stack."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        value, left = int(lcp[i]) if i < len(lcp) else -1, i - 1
        while stack and stack[-1][0] > value:
            depth, left = stack.pop()
            yield depth, left, i - 1
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, left))


class Bucket:
    """Texts around one string, each split where that string starts."""

    def __init__(self, bodies: Sequence[bytes], offs: Sequence[int]):
        self.order, self.lcp = suffix_array([b[o:] for b, o in zip(bodies, offs, strict=True)])
        left_order, self.left_lcp = suffix_array([b[:o][::-1] for b, o in zip(bodies, offs, strict=True)])
        self.left_order = left_order
        self.left_rank = np.empty(len(left_order), np.int64)
        self.left_rank[left_order] = np.arange(len(left_order))
        self.rank = np.empty(len(left_order), np.int64)
        self.rank[self.order] = np.arange(len(left_order))
        self.longest_left = max(offs)

    def by_left(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Members of an interval in the order of what precedes them, and the bytes that neighbours have in common there."""
        ranks = np.sort(self.left_rank[self.order[first : last + 1]])
        return self.left_order[ranks], np.minimum.reduceat(self.left_lcp[: ranks[-1] + 1], ranks[:-1] + 1)

    def covers(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """How far to the left and to the right each member is repeated, in strings of ``length`` bytes or more that hold the anchor; 0, 0 if not."""
        n = len(self.order)
        left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for depth, first, last in intervals(self.lcp):
            if depth + self.longest_left < length:
                continue
            members, shared = self.by_left(first, last)
            reach = np.zeros(len(members), np.int64)
            reach[1:] = shared
            np.maximum(reach[:-1], shared, out=reach[:-1])
            good = reach + depth >= length
            np.maximum.at(left, members[good], reach[good])
            np.maximum.at(right, members[good], depth)
        return left, right

    def maximal_repeats(self, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(bytes before, bytes after the anchor, members): every string of ``length`` bytes or more that cannot be extended on either side
        without losing a member, with all its members."""
        for depth, first, last in intervals(self.lcp):
            if depth + self.longest_left < length:
                continue
            members, shared = self.by_left(first, last)
            for before, a, z in intervals(np.concatenate([[0], shared])):
                ranks = self.rank[members[a : z + 1]]
                if before + depth >= length and self.lcp[ranks.min() + 1 : ranks.max() + 1].min() == depth:
                    yield before, depth, members[a : z + 1]


_COVER = "c1 bigint, c2 bigint, lo int, hi int"


def _members(table: pa.Table) -> tuple[list[tuple[int, int]], list[bytes], list[int]]:
    """The different contexts of a bucket."""
    seen = {}
    for c1, c2, off, body in zip(*(table.column(c).to_pylist() for c in ("c1", "c2", "off", "body")), strict=True):
        seen[c1, c2] = (body, off)
    return list(seen), [b for b, _ in seen.values()], [o for _, o in seen.values()]


def cover_bucket(table: pa.Table, length: int) -> pa.Table:
    """Repeated bytes of each context of a bucket, from the context's start."""
    names, bodies, offs = _members(table)
    left, right = Bucket(bodies, offs).covers(length)
    rows = [(*names[i], offs[i] - int(left[i]), offs[i] + int(right[i])) for i in np.flatnonzero(right)]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["c1", "c2", "lo", "hi"])


def group_bucket(table: pa.Table, length: int) -> pa.Table:
    """Maximal repeats of a bucket: name (hash of the string), its bytes from the context's start, one row a member."""
    names, bodies, offs = _members(table)
    rows = []
    for before, after, members in Bucket(bodies, offs).maximal_repeats(length):
        one = members[0]
        name = md5(bodies[one][offs[one] - before : offs[one] + after]).hexdigest()
        rows += [(name, *names[i], offs[i] - before, offs[i] + after) for i in members]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["repeat", "c1", "c2", "lo", "hi"])


# ---- the corpus ---------------------------------------------------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a 128-bit key of both."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).select("doc_id", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2"), "text")


def repeated_places(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Contexts whose anchor string occurs more than once (staged)."""
    found = docs.filter(F.octet_length("text") >= length).select("k1", "k2", "text")
    found = stage(found.mapInArrow(lambda b: places(b, length, gram), _PLACES), "contexts")
    again = found.groupBy("gram").agg(F.sum("reps").alias("times")).filter("times > 1")
    again = stage(again, "anchors")
    out = stage(lookup(found, again, ["gram"], "times").drop("times"), "repeated-contexts")
    unstage(found, again)
    return out


def with_bodies(contexts: DataFrame, docs: DataFrame) -> DataFrame:
    """(c1, c2, off, gram, body): the bytes of each context, from the document that holds its smallest place."""
    wanted = contexts.select("place.k1", "place.k2", F.struct(F.col("place.start").alias("start"), "width", "off", "gram", "c1", "c2").alias("at"))
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list("at").alias("at"))
    body = F.substring(F.col("text").cast("binary"), F.col("at.start") + 1, F.col("at.width"))
    joined = docs.select("k1", "k2", "text").join(wanted.hint("merge"), ["k1", "k2"])
    return joined.select("text", F.explode("at").alias("at")).select("at.gram", "at.c1", "at.c2", "at.off", body.alias("body"))


def _part(left: Column, right: Column) -> Column:
    """Name of a bucket: the bytes around the anchor that its members share."""
    shared = F.substring(F.col("body"), F.col("off") - left + 1, left + right)
    return F.md5(F.concat(F.concat_ws(",", left, right, F.lit("")).cast("binary"), shared))


def settle(rows: DataFrame, solve: Callable[[pa.Table], pa.Table], schema: str, length: int, gram: int, bucket: int) -> DataFrame:
    """``solve`` for every bucket small enough for one task, and the windows that members of a larger one share as a whole.

    Each round is written before the next, so the plan stays as small however many rounds there are.
    """
    found = []
    rows = stage(rows.withColumns({"l": F.lit(0), "r": F.lit(gram), "bucket": F.col("gram").cast("string")}).drop("gram"), "buckets")
    while True:
        sizes = stage(rows.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1"), "bucket-sizes")
        met = stage(lookup(rows, sizes, ["bucket"], "members"), "bucket-members")
        unstage(rows, sizes)
        large = met.filter(F.col("members") > bucket).drop("members")
        missing = length - F.col("l") - F.col("r")
        solved = met.filter(F.col("members") <= bucket).drop("members").groupBy("bucket").applyInArrow(solve, schema)
        shared = large.filter(missing <= 0).select(F.col("bucket").alias("repeat"), "c1", "c2", (F.col("off") - F.col("l")).alias("lo"), (F.col("off") + F.col("r")).alias("hi"))
        found.append(stage(solved.union(shared.select(*solved.columns)), "bucket-repeats"))
        if large.isEmpty():
            unstage(met)
            break
        half = F.ceil(missing / 2).cast("int")
        left = large.filter(missing > 0).withColumn("l", F.col("l") + half).filter("off >= l")
        right = large.filter(missing > 0).withColumn("r", F.col("r") + missing - half + 1).filter("off + r <= length(body)")
        rows = stage(left.unionByName(right).withColumn("bucket", _part(F.col("l"), F.col("r"))), "buckets")
        unstage(met)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def covered(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """(k1, k2, spans): the repeated stretches of every document that has some, in bytes, unordered and overlapping (staged)."""
    here = repeated_places(docs, length, gram)
    contexts = here.groupBy("gram", "c1", "c2", "width", "off").agg(F.sum("reps").alias("n"), F.min(F.struct("k1", "k2", "start")).alias("place"))
    contexts = stage(contexts, "context-counts")
    mixed = stage(contexts.groupBy("gram").agg(F.count("*").alias("members"), F.min("n").alias("least")).filter("members > 1 and least = 1"), "mixed-anchors")
    edges = lookup(contexts, mixed.drop("least"), ["gram"], "members")
    parts = settle(with_bodies(edges, docs), lambda t: cover_bucket(t, length), _COVER, length, gram, bucket)
    # every stretch of a context holds its anchor string, so their union is one stretch
    found = contexts.filter("n > 1").select("c1", "c2", F.lit(0).alias("lo"), F.col("width").alias("hi")).union(parts)
    found = found.groupBy("c1", "c2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    found = stage(found.join(contexts.select("c1", "c2", "n").hint("merge"), ["c1", "c2"]), "covers")
    span = F.struct((F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + (F.col("reps") - 1) * F.col("step") + F.col("hi")).alias("hi"))
    out = lookup(here, found, ["c1", "c2"], "n").groupBy("k1", "k2").agg(F.collect_list(span).alias("spans"))
    out = stage(out, "repeated-spans")
    unstage(here, contexts, mixed, parts, found)
    return out


def repeat_groups(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """(repeat, doc_id, start, n_bytes): maximal repeated strings around each anchor, every one with all its occurrences.

    Of a bucket that was split, a window that is shared as a whole is a repeat too, whether or not it could be extended."""
    docs = _keyed(docs)
    here = repeated_places(docs, length, gram)
    contexts = here.groupBy("gram", "c1", "c2", "width", "off").agg(F.sum("reps").alias("n"), F.min(F.struct("k1", "k2", "start")).alias("place"))
    parts = settle(with_bodies(contexts, docs), lambda t: group_bucket(t, length), "repeat string, " + _COVER, length, gram, bucket)
    same = contexts.filter("n > 1").select(F.md5(F.concat_ws(",", "c1", "c2")).alias("repeat"), "c1", "c2", F.lit(0).alias("lo"), F.col("width").alias("hi"))
    at = here.select("k1", "k2", "c1", "c2", F.explode(F.expr("transform(sequence(0, reps - 1), i -> start + i * step)")).alias("start"))
    rows = at.join(same.union(parts).distinct().hint("merge"), ["c1", "c2"]).join(docs.select("k1", "k2", "doc_id").hint("merge"), ["k1", "k2"])
    return rows.select("repeat", "doc_id", (F.col("start") + F.col("lo")).alias("start"), (F.col("hi") - F.col("lo")).alias("n_bytes")).distinct()


def cut_spans(raw: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """What is left without the spans, bytes removed, and number of maximal removed runs."""
    kept, end, removed, runs, last = [], 0, 0, 0, -1
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if lo > last:
            runs += 1
            kept.append(raw[end:lo])
        if hi > last:
            removed += hi - max(lo, last) if lo <= last else hi - lo
            last = end = hi
    kept.append(raw[end:])
    return b"".join(kept), removed, runs


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every row of ``docs`` without the bytes of strings of ``length`` that start anywhere else too."""
    gram = min(gram, max(1, length // 2))
    docs = _keyed(docs)
    spans = covered(docs, length, gram, bucket)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [cut_spans(t.encode(), s) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            sizes = [len(k) + n for k, n, _ in rows]
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = docs.join(spans.hint("merge"), ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def digests(left: DataFrame) -> DataFrame:
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
