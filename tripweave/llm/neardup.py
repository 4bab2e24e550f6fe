"""Near duplicates: MinHash bands, sequential Bayesian verification, exact confirmation, connected components.

Words are runs without white space after A-Z became a-z; a document's set holds its distinct runs of SHINGLE words, or its whole word sequence if it
has fewer. Documents with equal sets are one class, named by its smallest doc_id. Classes whose signatures agree in a whole
band share a bucket. A pair from a bucket is compared batch after batch of its signature and given up as soon as the
posterior probability of a similarity of ``at_least`` falls below MISS; what survives is confirmed on the full sets.

Pairs are never rows. First every member meets the smallest one of its bucket. Buckets whose members are then in more than one
component are cut into blocks, and each task holds one block of members outside the bucket's first component beside one block of
all its members: pairs of different components are compared there, one bit of each of BITS values first, and only the links
come out. So every link between two components is found, and a large group of copies costs its members, not its pairs.

With BANDS bands of ROWS, a pair at exactly 0.8 shares no bucket with probability (1 - 0.8^5)^36 = 6e-7.

Rows that repeat a doc_id each get the component of their own text; two texts whose classes bear the same doc_id are one node.
Rows without doc_id, text or words are linked with nothing and kept. Empty tables and further columns are allowed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm import text as tx
from tripweave.llm.graph import components
from tripweave.sources.storage import stage, unstage

SHINGLE = 5
AT_LEAST = 80  # per cent
BANDS, ROWS = 36, 5
#: Probability at which a pair is given up, and signature values compared at a time.
MISS, BATCH = 1e-7, 30
_SLOTS = BANDS * ROWS
BITS = 128
#: Members of a bucket that meet in one task.
BLOCK = 512


@lru_cache(1)
def _multipliers() -> np.ndarray:
    return np.random.default_rng(20240607).integers(0, 1 << 63, _SLOTS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(batch: pa.RecordBatch, column: str, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) for row ranges of a batch."""
    for low, _, data, offsets in tx.pieces(batch, column):
        data = tx.LOWER[data]
        starts, ends, bounds = tx.spans(data, offsets, tx.NOT_BLANK)
        words = tx.hash_spans(data, starts, ends)
        grams = tx.runs(words, size)
        out = []
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if j - i >= size:
                out.append(np.unique(grams[i : j - size + 1]))
            else:
                out.append(tx.runs(words[i:j], j - i) ^ np.uint64(j - i) if j > i else np.zeros(0, np.uint64))
        yield low, out


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """16-bit hashes of the minima of each non-empty set, one column for each slot."""
    ends = np.cumsum([len(s) for s in sets])
    flat, starts = np.concatenate(sets), np.concatenate([[0], ends[:-1]])
    out, room = np.empty((len(sets), _SLOTS), "<u2"), np.empty(len(flat), np.uint64)
    for slot, m in enumerate(_multipliers()):
        np.multiply(flat, m, out=room)
        np.right_shift(room, np.uint64(32), out=room)
        out[:, slot] = (tx.mix(np.minimum.reduceat(room, starts)) & np.uint64(0xFFFF)).astype("<u2")
    return out


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n, d1, d2, sig, s1, s2): set size, 128-bit digest of the set, signature (null for an empty set), its BITS bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, sets in shingle_sets(batch, "text", size):
                n = np.array([len(s) for s in sets])
                some = np.flatnonzero(n)
                sig, d1, d2, bits = [None] * len(sets), np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64), np.zeros((len(sets), BITS // 64), np.int64)
                if len(some):
                    full = [sets[i] for i in some]
                    values = signature(full)
                    bits[some] = np.packbits(values[:, :BITS] & 1, axis=1).view(np.int64)
                    for i, row in zip(some.tolist(), values, strict=True):
                        sig[i] = row.tobytes()
                        d1[i] = tx.mix(sets[i]).sum(dtype=np.uint64).view(np.int64)
                        d2[i] = tx.mix(sets[i] ^ np.uint64(0x5555555555555555)).sum(dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, len(sets)), pa.array(n), pa.array(d1), pa.array(d2), pa.array(sig, pa.binary()), *map(pa.array, bits.T)],
                    ["doc_id", "n", "d1", "d2", "sig", "s1", "s2"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, d1 long, d2 long, sig binary, s1 long, s2 long")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, set): the sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, sets in shingle_sets(batch, "text", size):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "set"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, set binary")


@lru_cache(8)
def least_matches(at_least: int) -> list[tuple[int, int]]:
    """(values compared, matches needed to go on): with a flat prior, P(similarity >= s | m of n) is P(Bin(n + 1, s) <= m)."""
    s, out = at_least / 100, []
    for n in range(BATCH, _SLOTS + 1, BATCH):
        total = 0.0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * s**m * (1 - s) ** (n + 1 - m)
            if total >= MISS:
                break
        out.append((n, m))
    return out


@lru_cache(8)
def most_unlike(at_least: int) -> int:
    """Bits of BITS that may differ: values of sets of similarity s agree in a bit with probability (1 + s) / 2."""
    p, total = (1 - at_least / 100) / 2, 0.0
    for d in range(BITS + 1):
        total += math.comb(BITS, d) * p**d * (1 - p) ** (BITS - d)
        if 1 - total < MISS:
            return d
    return BITS


def prune(pairs: DataFrame, at_least: int) -> DataFrame:
    """Of (a, b, sig_a, sig_b), the pairs that no batch of values rules out."""
    kind = pairs.schema["a"].dataType.simpleString()

    def matrix(column: pa.Array) -> np.ndarray:
        offsets = np.frombuffer(column.buffers()[1], np.int32 if column.type == pa.binary() else np.int64)[column.offset :]
        return np.frombuffer(column.buffers()[2], "<u2", offset=int(offsets[0]), count=len(column) * _SLOTS).reshape(-1, _SLOTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = matrix(batch.column("sig_a")), matrix(batch.column("sig_b"))
            left, matches, seen = np.arange(len(x)), np.zeros(len(x), np.int64), 0
            for n, needed in least_matches(at_least):
                matches[left] += (x[left, seen:n] == y[left, seen:n]).sum(1)
                left, seen = left[matches[left] >= needed], n
            yield batch.select(["a", "b"]).take(pa.array(left))

    return pairs.mapInArrow(run, f"a {kind}, b {kind}")


def similar(p: np.ndarray, q: np.ndarray, at_least: int) -> bool:
    """Whether two sorted sets share at least ``at_least`` per cent of their union."""
    if 100 * min(len(p), len(q)) < at_least * max(len(p), len(q)):
        return False
    same = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
    return 100 * same >= at_least * (len(p) + len(q) - same)


def confirm(pairs: DataFrame, at_least: int) -> DataFrame:
    """Of (a, b, set_a, set_b), the pairs whose sets share at least that part of their union."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for row, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if similar(p, q, at_least):
                    keep.append(row)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return pairs.mapInArrow(run, f"a {kind}, b {kind}")


def bucket_members(reps: DataFrame) -> DataFrame:
    """(id, key, hub, size): the members of every bucket of two or more."""
    width = 2 * ROWS
    keys = F.array(*(F.xxhash64(F.lit(b), F.substring("sig", 1 + b * width, width)) for b in range(BANDS)))
    rows = reps.select("id", F.explode(keys).alias("key"))
    buckets = rows.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("size")).filter("size > 1")
    return rows.join(buckets, "key")


def _tested(pairs: DataFrame, reps: DataFrame, sets: DataFrame, at_least: int) -> DataFrame:
    """The links among candidate pairs (a, b)."""

    def both(frame: DataFrame, table: DataFrame, value: str) -> DataFrame:
        for side in ("a", "b"):
            other = table.select(F.col("id").alias(f"id_{side}"), F.col(value).alias(f"{value}_{side}"))
            frame = frame.join(other, frame[side] == other[f"id_{side}"]).drop(f"id_{side}")
        return frame

    likely = prune(both(pairs, reps, "sig"), at_least)
    return confirm(both(likely, sets, "set"), at_least)


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def near_duplicates(docs: DataFrame, size: int = SHINGLE, at_least: int = AT_LEAST) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row: the smallest doc_id that links lead to, and whether it is this one."""
    docs = docs.select("doc_id", "text")
    marks = stage(signatures(docs, size), "signatures")
    full = marks.filter("n > 0 and doc_id is not null")
    reps = full.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.any_value("sig").alias("sig"), F.any_value("s1").alias("s1"), F.any_value("s2").alias("s2"))
    reps = stage(reps, "classes")
    slim = stage(marks.drop("sig", "s1", "s2"), "documents")
    unstage(marks)
    members = stage(bucket_members(reps), "buckets")
    wanted = members.select("id").distinct()
    sets = stage(full_sets(docs.join(wanted, docs["doc_id"] == wanted["id"], "left_semi"), size), "sets")

    hubs = stage(members.filter("id <> hub").select(*_pair(F.col("id"), F.col("hub"))).distinct(), "hub-pairs")
    links = stage(_tested(hubs, reps, sets, at_least), "links")
    labels = components(links)
    more = stage(block_links(members, reps, sets, labels, at_least), "block-links")
    labels = _merge(labels, more)
    unstage(members, sets, hubs, links)
    return full_labels(slim, reps, labels)


def block_links(members: DataFrame, reps: DataFrame, sets: DataFrame, labels: DataFrame, at_least: int) -> DataFrame:
    """Links (a, b) between members of one bucket that are in different components, enough to unite what is linked."""
    kind = members.schema["id"].dataType.simpleString()
    placed = members.join(labels, members["id"] == labels["node"], "left").select("id", "key", F.coalesce("label", "id").alias("label"))
    lows = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key", "low")
    rows = placed.join(lows, "key").withColumn("other", F.col("label") != F.col("low"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.count_if("other").alias("n_other"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    rows = stage(rows.join(sizes, "key").select("key", "id", "label", "other", blocks("n").alias("alls"), blocks("n_other").alias("others")), "open-buckets")
    draw = F.xxhash64("id")
    left = rows.filter("other").select("key", "id", "label", F.lit(True).alias("left"), F.pmod(draw, "others").alias("i"), F.explode(F.sequence(F.lit(0), F.col("alls") - 1)).alias("j"))
    right = rows.select("key", "id", "label", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("i"), F.pmod(draw, "alls").alias("j"))
    dealt = left.unionByName(right.select(*left.columns)).select("key", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "id", "label", "left")
    facts = reps.select("id", "sig", "s1", "s2").join(sets, "id")
    dealt = dealt.join(facts, "id")

    def meet(group: pa.Table) -> pa.Table:
        side = group.column("left").to_numpy(zero_copy_only=False)
        ids, label = group.column("id").to_pylist(), np.unique(np.array(group.column("label").to_pylist()), return_inverse=True)[1]
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u2").reshape(-1, _SLOTS)
        bits = np.stack([group.column(c).to_numpy() for c in ("s1", "s2")], axis=1).view(np.uint64)
        full = [np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()]
        rights = np.flatnonzero(~side)
        up = list(range(int(label.max()) + 1))

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        found = []
        for x in np.flatnonzero(side).tolist():
            some = rights[label[rights] != label[x]]
            some = some[np.bitwise_count(bits[some] ^ bits[x]).sum(1) <= most_unlike(at_least)]
            matches, seen = np.zeros(len(some), np.int64), 0
            for n, needed in least_matches(at_least):
                matches += (sig[some, seen:n] == sig[x, seen:n]).sum(1)
                some, matches, seen = some[matches >= needed], matches[matches >= needed], n
            # the likeliest first: what is united needs no further look
            for y in some[np.argsort(-matches, kind="stable")].tolist():
                p, q = root(int(label[x])), root(int(label[y]))
                if p != q and similar(full[x], full[y], at_least):
                    up[q] = p
                    found.append((ids[x], ids[y]))
        return pa.table({"a": pa.array([f[0] for f in found], group.column("id").type), "b": pa.array([f[1] for f in found], group.column("id").type)})

    return dealt.groupBy("key", "i", "j").applyInArrow(meet, f"a {kind}, b {kind}").distinct()


def _merge(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after further links: components of the components."""
    if labels is None:
        return components(links)
    if links.isEmpty():
        return labels
    for side in ("a", "b"):
        at = labels.select(F.col("node").alias("at"), F.col("label").alias("at_label"))
        links = links.join(at, links[side] == at["at"], "left").withColumn(side, F.coalesce("at_label", side)).drop("at", "at_label")
    united = components(links).withColumnsRenamed({"node": "old", "label": "new"})
    moved = labels.join(united, labels["label"] == united["old"], "left").select("node", F.coalesce("new", "label").alias("label"))
    lone = united.join(labels, united["old"] == labels["node"], "left_anti").select(F.col("old").alias("node"), F.col("new").alias("label"))
    return stage(moved.union(lone), "labels")


def full_labels(slim: DataFrame, reps: DataFrame, labels: DataFrame) -> DataFrame:
    """Back from classes to documents."""
    names = reps.select("d1", "d2", "id").join(labels, reps["id"] == labels["node"], "left").select("d1", "d2", F.coalesce("label", "id").alias("component"))
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    component = F.when(linked, F.col("component")).otherwise(F.col("doc_id"))
    joined = slim.join(names.withColumnsRenamed({"d1": "c1", "d2": "c2"}), (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def drop_near_duplicates(docs: DataFrame, size: int = SHINGLE, at_least: int = AT_LEAST) -> DataFrame:
    """One document of each group, that with the smallest doc_id; all columns stay."""
    gone = near_duplicates(docs, size, at_least).filter("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    gone = stage(gone, "near-duplicates")
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
