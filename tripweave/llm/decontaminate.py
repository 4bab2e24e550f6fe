"""Benchmark decontamination by winnowing.

Words are runs of characters outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z became a-z. Every text keeps the smallest hash of
K consecutive words in each window of W such hashes, so two texts that share K + W - 1 words keep a common fingerprint.
Training fingerprints meet the benchmark's distinct ones in one join. Where a fingerprint is common, each window of 13 document words
that it stands for is looked up among the distinct windows of the benchmark; windows found extend to runs of hit words. Documents meet
windows, never items: the items of a window are a list aside, and the list for each set of windows that documents hold is made once.
An item of fewer words than 13 is one window of its own length, and its own fingerprint.

Null or wordless texts have no words. Rows that repeat doc_id and text are one document. Items without an id or
words are ignored; items with the same id count once. Both tables may be empty or have further columns, which are ignored. Texts are
read whole at any length: a task holds one text and the rows of its own windows, which are linear in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripweave.llm import text as tx
from tripweave.sources.storage import stage, unstage

#: Words of a window; a shared run of so many is always found.
WINDOW = 13
#: Words of a hashed gram, and grams of a winnowing window: K + W - 1 = WINDOW.
K = 4
W = WINDOW - K + 1
#: Parts of a hot fingerprint or window; the benchmark's side of a join, which is small, is repeated as often.
SALT = 16
#: A second reading of the bytes, for the second half of a window's hash.
_OTHER = np.array([(b * 167 + 13) % 256 for b in range(256)], np.uint8)


def winnow(hashes: np.ndarray, bounds: np.ndarray, short: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, fingerprint) of texts given by their word hashes: window minima, and all runs of the short lengths."""
    rows, kept = [], []
    owner = tx.row_of(bounds)
    grams = tx.runs(hashes, K)
    low = tx.sliding_min(grams, W) if len(grams) >= W else grams[:0]
    at = np.flatnonzero(tx.starts_within(bounds, WINDOW, len(hashes)))
    value, row = low[at], owner[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    rows.append(row[new])
    kept.append(value[new])
    for length in short:
        at = np.flatnonzero(tx.starts_within(bounds, length, len(hashes)))
        rows.append(owner[at])
        kept.append(short_key(tx.runs(hashes, length)[at], length))
    return np.concatenate(rows), np.concatenate(kept)


def short_key(run: np.ndarray, length: int) -> np.ndarray:
    return tx.mix(run ^ np.uint64(length))


def fingerprints(texts: DataFrame, keys: list[str], text: str, short: tuple[int, ...]) -> DataFrame:
    """Rows (keys, mark, n_words, fp): one marked row for each text, with a random fp, and one for each fingerprint."""
    schema = T.StructType([*(texts.schema[k] for k in keys), *T.StructType.fromDDL("mark boolean, n_words long, fp long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in tx.pieces(batch, text):
                data = tx.LOWER[data]
                starts, ends, bounds = tx.spans(data, offsets, tx.ALNUM)
                row, fp = winnow(tx.hash_spans(data, starts, ends), bounds, short)
                n = high - low
                spread = tx.mix(np.arange(low, high).astype(np.uint64) + bounds[:-1].astype(np.uint64) * np.uint64(77) + np.uint64(len(data)))
                take = np.concatenate([np.arange(n), row])
                columns = [batch.column(k).slice(low, n).take(pa.array(take)) for k in keys]
                mark = np.arange(len(take)) < n
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(mark), pa.array(np.diff(bounds)[take]), pa.array(np.concatenate([spread, fp]).view(np.int64))],
                    schema.fieldNames(),
                )

    return texts.select(*keys, text).mapInArrow(run, schema)


def word_count(text: str) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))


def windows(texts: DataFrame, keys: list[str], lengths: tuple[int, ...], chosen: str | None = None) -> DataFrame:
    """Rows (keys, at, n, h1, h2, fp) of the windows of n words from word ``at`` on, for each of the lengths.

    The two hashes stand for the words, fp is the fingerprint that stands for the window. With ``chosen``, a column of fingerprints by
    text, only windows whose fingerprint is among those of the texts handled together.
    """
    schema = T.StructType([*(texts.schema[k] for k in keys), *T.StructType.fromDDL("at long, n int, h1 long, h2 long, fp long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in tx.pieces(batch, "text"):
                data = tx.LOWER[data]
                starts, ends, bounds = tx.spans(data, offsets, tx.ALNUM)
                first, second = tx.hash_spans(data, starts, ends), tx.hash_spans(_OTHER[data], starts, ends)
                wanted = np.unique(np.array(batch.column(chosen).slice(low, high - low).flatten(), np.int64)).view(np.uint64) if chosen else None
                grams, owner = tx.runs(first, K), tx.row_of(bounds)
                for length in lengths:
                    at = np.flatnonzero(tx.starts_within(bounds, length, len(first)))
                    if not len(at):
                        continue
                    fp = tx.sliding_min(grams, W)[at] if length == WINDOW else short_key(tx.runs(first, length)[at], length)
                    if wanted is not None:
                        among = np.isin(fp, wanted)
                        at, fp = at[among], fp[among]
                    rows = pa.array(owner[at])
                    halves = [tx.runs(h, length)[at].view(np.int64) for h in (first, second)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(batch.column(k).slice(low, high - low).take(rows) for k in keys), pa.array(at - bounds[owner[at]]),
                            pa.array(np.full(len(at), length, np.int32)), *map(pa.array, halves), pa.array(fp.view(np.int64)),
                        ],
                        schema.fieldNames(),
                    )

    return texts.select(*keys, "text", *([chosen] if chosen else [])).mapInArrow(run, schema)


def item_windows(items: DataFrame) -> tuple[DataFrame, tuple[int, ...]]:
    """(item, n, h1, h2, fp) of the items' windows, and the lengths below WINDOW among them, twelve at most."""
    counted = items.withColumn("_n", word_count("text"))
    short = tuple(sorted(r[0] for r in counted.filter(F.col("_n").between(1, WINDOW - 1)).select("_n").distinct().collect()))
    out = windows(counted.filter(F.col("_n") >= WINDOW), ["item"], (WINDOW,))
    for length in short:
        out = out.union(windows(counted.filter(F.col("_n") == length), ["item"], (length,)))
    return out.select("item", "n", "h1", "h2", "fp").distinct(), short


def salted(frame: DataFrame) -> DataFrame:
    """Every row once for each salt."""
    return frame.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def n_covered(intervals: Column) -> Column:
    """Places inside any of the (start, end) intervals."""
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["at"], acc["end"]))).alias("n"), F.greatest(acc["end"], x["end"]).alias("end")
    )
    return F.aggregate(F.array_sort(intervals), begin, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, n_items, items_sha256, items (sorted item ids as strings) for every document.

    items_sha256 is the hash of the comma-joined items. Tables of the benchmark are joined by Spark, which broadcasts them only if their
    written size is below the session's threshold; otherwise they are repeated over salts, so no common fingerprint or window fills a task.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    items = stage(benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("item is not null and text is not null").distinct(), "items")
    owned, short = item_windows(items)
    owned = stage(owned, "item-windows")
    marks = stage(salted(owned.select("fp").distinct()).withColumn("known", F.lit(True)), "item-fingerprints")
    window = ["n", "h1", "h2"]
    # the items of a window, and each different list of items once
    lists = stage(owned.groupBy(*window).agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("list", F.xxhash64("items")), "window-lists")
    listed = stage(salted(lists.select(*window, "list")), "windows")

    keys = ["doc_id", "text_key"]
    salt = F.pmod(F.xxhash64(*keys), F.lit(SALT)).cast("int").alias("salt")
    met = (
        fingerprints(docs, keys, "text", short)
        .select("*", salt)
        .join(marks, ["fp", "salt"], "left")
        .filter("mark or known")
        .groupBy(*keys)
        .agg(F.max("n_words").alias("n_words"), F.collect_set(F.when(~F.col("mark"), F.col("fp"))).alias("fps"))
    )
    met = stage(met, "met")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])
    some = met.filter(F.size("fps") > 0).select(*keys, "fps")
    texts = docs.join(some, same(docs, some)).select(docs["doc_id"], docs["text_key"], "text", "fps")
    hits = (
        windows(texts, keys, (WINDOW, *short), "fps")
        .select(*keys, "at", *window, salt)
        .join(listed, [*window, "salt"])
        .groupBy(*keys)
        .agg(
            n_covered(F.collect_set(F.struct("at", (F.col("at") + F.col("n")).alias("end")))).alias("n_hit"),
            F.sort_array(F.collect_set("list")).alias("lists"),
        )
        .withColumn("held", F.xxhash64("lists"))
    )
    hits = stage(hits, "hits")
    # each different set of lists becomes one list of items, however many documents hold it
    sets = hits.groupBy("held").agg(F.first("lists").alias("lists")).select("held", F.explode("lists").alias("list"))
    sets = (
        sets.join(lists.dropDuplicates(["list"]).select("list", F.explode("items").alias("item")), "list")
        .groupBy("held")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
        .select("held", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "items")
    )
    sets = stage(sets, "item-sets")
    found = hits.select(*keys, "n_hit", "held").join(sets, "held")
    zero = F.lit(0).cast("long")
    out = met.join(found, same(met, found), "left").select(
        met["doc_id"], met["text_key"], "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
    unstage(items, owned, marks, lists, listed)
    return out


def contaminated() -> Column:
    """At least one hit word, and hits make a twentieth of the words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = contamination(docs, benchmark).filter(contaminated()).select(F.col("doc_id").alias("bad_id"), "text_key")
    bad = stage(bad, "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["text_key"]), "left_anti")
