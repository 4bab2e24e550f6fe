"""Phrase collocations: counts of all phrases by weighted acyclic automata, scores by the worst cut.

Every task turns shards of text (a few megabytes each) into count transducers: acyclic automata over words, built from the sorted n-grams of
the shard level by level, a state per prefix, the count on the last arc, all last arcs into one final state. A transducer is cut into prefix ranges,
which are bounded by quantiles of a sample of the n-grams themselves, so a common first word is cut in many. Each range of all shards
is united by one task: states of equal prefix merge, the counts of equal paths add up.

Orders go up one by one. An n-gram can only be frequent if both its parts of n - 1 words are; a Bloom filter of the frequent parts, of a
fixed size whatever the corpus, keeps most others out of the transducers of the next order. It drops no frequent one; what passes wrongly
is counted exactly and falls by its count.

The parts of a candidate's cuts are looked up by composition: the distinct parts of a bucket, as an acceptor, meet the transducer of the
frequent phrases of that bucket. Scores are 38-digit decimals.

Null texts have no words and a null language is ``und``. Repeated rows count as often as they stand there. A long text is a shard of its
own. Ties are ordered by phrase. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripweave.llm import text as tx
from tripweave.llm.skew import lookup
from tripweave.sources.storage import stage, unstage

LEAST, LONGEST, TOP = 100, 5, 2000
#: ``[.,;:!?\x0A-\x0D]``
BREAK = tx.byte_set((0x0A, 0x0D), (0x21, 0x21), (0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F))
WORD = ~(BREAK | tx.byte_set((0x09, 0x09), (0x20, 0x20)))
#: Bytes of text in a shard.
SHARD_BYTES = 4 << 20
#: Bits of the filter between two orders: 8 MB.
FILTER_BITS = 1 << 26
#: n-grams of the sample that bounds the ranges.
SAMPLE = 20_000

_BLOB = "lang string, part int, words array<string>, labels array<array<int>>, fanout array<array<int>>, counts array<bigint>"
_COUNTS = "lang string, phrase string, f bigint"


@dataclass
class Transducer:
    """States of each level in sorted order: label of the arc into it (index into the sorted ``words``), number of arcs out; counts of the last."""

    words: pa.Array
    labels: list[np.ndarray]
    fanout: list[np.ndarray]
    counts: np.ndarray

    @classmethod
    def build(cls, words: pa.Array, grams: Sequence[np.ndarray], counts: np.ndarray | None = None) -> Transducer:
        """From n columns of word numbers, one row an n-gram: equal rows become one path and their counts (else ones) add up."""
        state, size, labels, fanout = np.zeros(len(grams[0]), np.int64), np.int64(max(1, len(words))), [], []
        for column in grams:
            arcs, state_of = np.unique(state * size + column, return_inverse=True)
            if labels:
                fanout.append(np.bincount(arcs // size, minlength=len(labels[-1])))
            labels.append(arcs % size)
            state = state_of.astype(np.int64)
        total = np.zeros(len(labels[-1]), np.int64)
        np.add.at(total, state, 1 if counts is None else counts)
        return cls(words, labels, fanout, total)

    def columns(self) -> list[np.ndarray]:
        """The word numbers of every path, in sorted order."""
        out, at = [self.labels[-1]], np.arange(len(self.labels[-1]))
        for level in range(len(self.labels) - 1, 0, -1):
            at = np.repeat(np.arange(len(self.fanout[level - 1])), self.fanout[level - 1])[at]
            out.insert(0, self.labels[level - 1][at])
        return out

    def cut(self, low: int, high: int) -> Transducer:
        """The paths from ``low`` to ``high`` with the words that they use."""
        columns = [c[low:high] for c in self.columns()] if high > low else [np.zeros(0, np.int64) for _ in self.labels]
        used, numbers = np.unique(np.concatenate(columns), return_inverse=True)
        return Transducer.build(self.words.take(pa.array(used)), np.split(numbers.astype(np.int64), len(columns)), self.counts[low:high])

    def compose(self, grams: Sequence[np.ndarray]) -> np.ndarray:
        """The counts of other n-grams of the same words; 0 where there is no such path."""
        size, state = np.int64(max(1, len(self.words))), np.zeros(len(grams[0]), np.int64)
        alive = np.ones(len(state), bool)
        for level, column in enumerate(grams):
            parent = np.repeat(np.arange(len(self.fanout[level - 1])), self.fanout[level - 1]) if level else np.zeros(len(self.labels[0]), np.int64)
            arcs = parent * size + self.labels[level]
            wanted = state * size + column
            state = np.minimum(np.searchsorted(arcs, wanted), max(0, len(arcs) - 1))
            alive &= (arcs[state] == wanted) if len(arcs) else False
        return np.where(alive, self.counts[state] if len(self.counts) else 0, 0)

    def phrases(self) -> pa.Array:
        return pc.binary_join_element_wise(*(self.words.take(pa.array(c)) for c in self.columns()), " ")


def union(shards: Sequence[Transducer]) -> Transducer:
    """One transducer with the counts of all: words are numbered anew in sorted order, equal paths merge."""
    pool = pa.concat_arrays([s.words for s in shards]).dictionary_encode()
    order = pc.sort_indices(pool.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    numbers = rank[pool.indices.to_numpy()]
    first = np.cumsum([0] + [len(s.words) for s in shards])
    columns = [[] for _ in shards[0].labels]
    for s, at in zip(shards, first, strict=False):
        for level, column in enumerate(s.columns()):
            columns[level].append(numbers[at + column])
    return Transducer.build(pool.dictionary.take(pa.array(order)), [np.concatenate(c) for c in columns], np.concatenate([s.counts for s in shards]))


# ---- filter of frequent parts -------------------------------------------------------------------------------------------------------


def gram_hashes(words: np.ndarray, lang: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each one on, with the language of the first."""
    runs = tx.runs(words, n)
    return tx.mix(runs ^ lang[: len(runs)])


def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash, one row a bit position."""
    bits = np.uint64(FILTER_BITS - 1)
    return hashes & bits, (hashes >> np.uint64(32)) & bits


def lang_hash(lang: str) -> np.uint64:
    data = np.frombuffer(lang.encode() or b"\0", np.uint8)
    return tx.hash_spans(data, np.array([0]), np.array([len(data)]))[0]


def part_filter(frequent: DataFrame) -> np.ndarray:
    """Bloom filter of (lang, phrase): ``FILTER_BITS`` bits, or-ed together by Spark, so the driver gets so many bits at most."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array([lang_hash(x) for x in batch.column("lang").to_pylist()], np.uint64)
            for low, high, data, offsets in tx.pieces(batch, "phrase"):
                starts, ends, bounds = tx.spans(data, offsets, ~tx.byte_set((0x20, 0x20)))
                n = int(bounds[1] - bounds[0])
                hashes = gram_hashes(tx.hash_spans(data, starts, ends), np.repeat(langs[low:high], n), n)[::n]
                at = np.concatenate(_slots(hashes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], ["slot", "mask"])

    rows = frequent.select("lang", "phrase").mapInArrow(bits, "slot bigint, mask bigint").groupBy("slot").agg(F.bit_or("mask").alias("mask")).collect()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    if rows:
        out[[r.slot for r in rows]] = [r.mask for r in rows]
    return out.view(np.uint64)


def _passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    ok = np.ones(len(hashes), bool)
    for at in _slots(hashes):
        ok &= (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return ok


# ---- shards -------------------------------------------------------------------------------------------------------------------------


def shards(batch: pa.RecordBatch, n: int, table: np.ndarray | None) -> Iterator[tuple[str, Transducer]]:
    """(language, transducer of the n-grams whose parts pass the filter) of every shard of a batch (lang, text)."""
    names = batch.column("lang").to_pylist()
    for low, high, raw, offsets in tx.pieces(batch, "text", SHARD_BYTES):
        data = tx.LOWER[raw]
        starts, ends, bounds = tx.spans(data, offsets, WORD)
        if len(starts) < n:
            continue
        hashes = tx.hash_spans(data, starts, ends)
        row = tx.row_of(bounds)
        cuts = np.cumsum(BREAK[data])[starts]
        here = {x: lang_hash(x) for x in set(names[low:high])}
        lang = np.array([here[x] for x in names[low:high]], np.uint64)[row]
        last = len(starts) - n + 1
        good = (row[:last] == row[n - 1 :]) & (cuts[:last] == cuts[n - 1 :])
        if table is not None:
            parts = _passes(table, gram_hashes(hashes, lang, n - 1))
            good &= parts[:last] & parts[1 : last + 1]
        begin = np.flatnonzero(good)
        for name in here:
            of = begin[lang[begin] == here[name]]
            if not len(of):
                continue
            used, numbers = np.unique(np.concatenate([of + i for i in range(n)]), return_inverse=True)
            distinct, at, code = np.unique(hashes[used], return_index=True, return_inverse=True)
            words = [data[starts[w] : ends[w]].tobytes() for w in used[at]]
            order = sorted(range(len(words)), key=words.__getitem__)
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            sorted_words = pa.array([words[i] for i in order], pa.binary()).cast(pa.string())
            yield name, Transducer.build(sorted_words, np.split(rank[code][numbers], n))


def _path(columns: Sequence[np.ndarray], words: list[str], i: int) -> list[bytes]:
    return [words[c[i]].encode() for c in columns]


def ranges(trie: Transducer, bounds: list[list[bytes]]) -> list[tuple[int, int, int]]:
    """(range, low, high) of the paths of a transducer between neighbouring bounds."""
    columns, words = trie.columns(), trie.words.to_pylist()
    cuts = [0]
    for bound in bounds:
        low, high = cuts[-1], len(columns[0])
        while low < high:
            mid = (low + high) // 2
            if _path(columns, words, mid) < bound:
                low = mid + 1
            else:
                high = mid
        cuts.append(low)
    cuts.append(len(columns[0]))
    return [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]


def _blob(lang: str, part: int, t: Transducer) -> dict:
    return {"lang": lang, "part": part, "words": t.words, "labels": [x.astype(np.int32) for x in t.labels], "fanout": [x.astype(np.int32) for x in t.fanout], "counts": t.counts}


_BLOB_ARROW = pa.schema([
    ("lang", pa.string()), ("part", pa.int32()), ("words", pa.list_(pa.string())), ("labels", pa.list_(pa.list_(pa.int32()))),
    ("fanout", pa.list_(pa.list_(pa.int32()))), ("counts", pa.list_(pa.int64())),
])


def _batch(blobs: list[dict]) -> pa.RecordBatch:
    """Blobs as one batch; lists are joined as arrays, not value by value."""

    def nested(arrays: list, kind: pa.DataType) -> pa.Array:
        offsets = pa.array(np.cumsum([0] + [len(a) for a in arrays]), pa.int32())
        flat = pa.concat_arrays([a if isinstance(a, pa.Array) else pa.array(a, kind) for a in arrays]) if arrays else pa.array([], kind)
        return pa.ListArray.from_arrays(offsets, flat)

    columns = [pa.array([b["lang"] for b in blobs], pa.string()), pa.array([b["part"] for b in blobs], pa.int32()), nested([b["words"] for b in blobs], pa.string())]
    columns += [nested([nested(b[c], pa.int32()) for b in blobs], pa.list_(pa.int32())) for c in ("labels", "fanout")]
    columns.append(nested([b["counts"] for b in blobs], pa.int64()))
    return pa.RecordBatch.from_arrays(columns, schema=_BLOB_ARROW)


def _transducers(table: pa.Table) -> list[Transducer]:
    out = []
    for batch in table.to_batches():
        c = {name: batch.column(name) for name in ("words", "labels", "fanout", "counts")}
        for i in range(batch.num_rows):
            levels = [[x.values.to_numpy().astype(np.int64) for x in c[name][i].values] for name in ("labels", "fanout")]
            # slices of nested lists keep their own offsets, so each level is read through its scalar
            out.append(Transducer(c["words"][i].values, [np.asarray(x) for x in levels[0]], levels[1], c["counts"][i].values.to_numpy()))
    return out


# ---- one order after the other ------------------------------------------------------------------------------------------------------


def range_bounds(docs: DataFrame, n: int, table, parts: int, documents: int) -> dict[str, list[list[bytes]]]:
    """Bounds of about ``parts`` ranges, by language, from at most ``SAMPLE`` n-grams of some hundred documents.

    They only decide which task counts what.
    """

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, trie in shards(batch, n, table and table.value):
                words, columns = trie.words.to_pylist(), trie.columns()
                picked = range(0, len(columns[0]), max(1, len(columns[0]) * 100 // SAMPLE))
                grams = [" ".join(words[c[i]] for c in columns) for i in picked]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string())], ["lang", "gram"])

    few = docs.sample(min(1.0, 300 / max(1, documents)), seed=7)
    rows = few.mapInArrow(some, "lang string, gram string").limit(SAMPLE).collect()
    found: dict[str, set] = {}
    for r in rows:
        found.setdefault(r.lang, set()).add(tuple(w.encode() for w in r.gram.split(" ")))
    out = {}
    for lang, grams in found.items():
        ordered, share = sorted(grams), max(1, round(parts * len(grams) / sum(map(len, found.values()))))
        out[lang] = [list(ordered[len(ordered) * i // share]) for i in range(1, share)]
    return out


def unite(table: pa.Table, least: int) -> pa.Table:
    """Frequent phrases of one range of a language, and in a row without phrase the sum of all its counts."""
    whole = union(_transducers(table))
    keep = pa.array(whole.counts >= least)
    phrases = pa.concat_arrays([whole.phrases().filter(keep), pa.array([None], pa.string())])
    counts = pa.concat_arrays([pa.array(whole.counts).filter(keep), pa.array([int(whole.counts.sum())], pa.int64())])
    lang = table.column("lang")[0].as_py()
    return pa.table([pa.array([lang] * len(phrases), pa.string()), phrases, counts], ["lang", "phrase", "f"])


def count_order(docs: DataFrame, n: int, before: DataFrame | None, least: int, parts: int, documents: int) -> DataFrame:
    """(lang, phrase, f) for the phrases of n words with f >= ``least``, and rows without phrase that hold the counts of all."""
    sc = docs.sparkSession.sparkContext
    table = sc.broadcast(part_filter(before)) if before is not None else None
    bounds = range_bounds(docs, n, table, parts, documents)

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, trie in shards(batch, n, table and table.value):
                yield _batch([_blob(lang, part, trie.cut(low, high)) for part, low, high in ranges(trie, bounds.get(lang, []))])

    counted = docs.mapInArrow(blobs, _BLOB).groupBy("lang", "part").applyInArrow(lambda t: unite(t, least), _COUNTS)
    counted = stage(counted, f"phrases-{n}")
    if table:
        table.unpersist()
    return counted


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(lang, phrase, f) of 1 to ``longest`` words, (lang, n) with all words, and the staged tables behind both."""
    documents = docs.count()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tables = [count_order(docs, 1, None, least, parts, documents)]
    totals = tables[0].filter("phrase is null").groupBy("lang").agg(F.sum("f").alias("n"))
    words = totals.agg(F.sum("n")).first()[0] or 0
    parts = max(parts, -(-words // 2_000_000))
    frequent = tables[0].filter("phrase is not null")
    for n in range(2, longest + 1):
        last = tables[-1].filter("phrase is not null")
        if last.isEmpty():
            break
        tables.append(count_order(docs, n, last, least, parts, documents))
        frequent = frequent.union(tables[-1].filter("phrase is not null"))
    return frequent, totals, tables


# ---- cuts, parts and scores ---------------------------------------------------------------------------------------------------------


def _numbers(phrases: list[list[str]], known: dict[str, int]) -> np.ndarray:
    return np.array([[known.get(w, -1) for w in p] for p in phrases], np.int64)


def compose_parts(key: tuple, parts: pa.Table, phrases: pa.Table) -> pa.Table:
    """Counts of the parts of a bucket, from the transducers of its frequent phrases, one a length."""
    out = []
    have = [(r["lang"], *r["phrase"].split(" ")) for r in phrases.select(["lang", "phrase"]).to_pylist()]
    want = [(r["lang"], *r["part"].split(" ")) for r in parts.select(["lang", "part"]).to_pylist()]
    f = phrases.column("f").to_numpy()
    counts = np.zeros(len(want), np.int64)
    for n in {len(w) for w in want}:
        of = [i for i, p in enumerate(have) if len(p) == n]
        asked = [i for i, p in enumerate(want) if len(p) == n]
        words = sorted({w for i in of for w in have[i]} | {w for i in asked for w in want[i]}, key=str.encode)
        known = {w: i for i, w in enumerate(words)}
        if of:
            trie = Transducer.build(pa.array(words, pa.string()), list(_numbers([have[i] for i in of], known).T), f[of])
            counts[asked] = trie.compose(list(_numbers([want[i] for i in asked], known).T))
    out = [parts.column("lang"), parts.column("part"), pa.array(counts), parts.column("asked")]
    return pa.table(out, ["lang", "part", "f", "asked"])


def part_counts(cuts: DataFrame, frequent: DataFrame, buckets: int) -> DataFrame:
    """(lang, part, f, asked) for every distinct part of ``cuts`` (lang, head, rest); ``asked`` says how often it is needed."""
    parts = cuts.select("lang", F.explode(F.array("head", "rest")).alias("part")).groupBy("lang", "part").agg(F.count("*").alias("asked"))
    bucket = lambda c: F.pmod(F.xxhash64("lang", c), F.lit(buckets)).alias("bucket")
    left = parts.select(bucket("part"), "*").groupBy("bucket")
    right = frequent.select(bucket("phrase"), "*").groupBy("bucket")
    return left.cogroup(right).applyInArrow(compose_parts, "lang string, part string, f bigint, asked bigint")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    frequent, totals, tables = frequent_phrases(docs, least, longest)
    totals = stage(totals, "phrase-totals")
    words = F.split("phrase", " ", -1)
    found = frequent.select("lang", "phrase", F.col("f").alias("a"), words.alias("words"), F.size(words).alias("m")).filter("m > 1")

    inner = F.expr("flatten(transform(sequence(2, m - 1), j -> transform(sequence(1, m - j + 1), i -> array_join(slice(words, i, j), ' '))))")
    inside = found.filter("m > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = found.join(inside.hint("merge"), ["lang", "phrase"], "left").filter("longer is null or longer < a").drop("longer")

    cut = F.expr("transform(sequence(1, m - 1), k -> struct(k, array_join(slice(words, 1, k), ' ') as head, array_join(slice(words, k + 1, m - k), ' ') as rest))")
    cuts = stage(kept.select("lang", "phrase", "a", F.explode(cut).alias("c")).select("lang", "phrase", "a", "c.k", "c.head", "c.rest"), "phrase-cuts")
    buckets = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = stage(part_counts(cuts, frequent, buckets), "phrase-parts")
    scored = cuts
    for part, name in (("head", "l"), ("rest", "r")):
        scored = lookup(scored, parts.select("lang", F.col("part").alias(part), F.col("f").alias(name), F.col("asked")), ["lang", part], "asked").drop("asked")
    scored = lookup(scored, totals, ["lang"], "n")
    exact = "(cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    worst = scored.withColumn("score", F.expr(exact)).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("w"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.col("phrase"))
    ranked = worst.select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score").withColumn("rank", F.row_number().over(order).cast("long"))
    out = stage(ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    unstage(*tables, totals, cuts, parts)
    return out
