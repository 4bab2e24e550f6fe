import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import same_as_duckdb
from tripweave.llm import decontaminate as dc


def brute(text, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = find(text), set(), set()
    for item, t in items:
        iw = find(t)
        m = min(13, len(iw))
        windows = {tuple(iw[p : p + m]) for p in range(len(iw) - m + 1)} if m else set()
        for p in range(len(words) - m + 1):
            if tuple(words[p : p + m]) in windows:
                hit.update(range(p, p + m))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_same_as_brute_force(spark):
    pick = random.Random(11)
    vocab = ["a", "the", "Of", "né", "x1", "Ünder", "zwei", "K"]
    say = lambda n: " ".join(pick.choice(vocab) for _ in range(n))
    items = [(i, say(pick.choice([1, 2, 3, 5, 12, 13, 14, 20, 40]))) for i in range(30)] + [(30, None), (31, ""), (32, "a a a " * 9), (None, "a b")]
    items += [(5, "other text of the same id")]
    docs = []
    for i in range(120):
        parts = [say(pick.randint(0, 60))] + [pick.choice(items)[1] or "" for _ in range(pick.randint(0, 2))] + [say(pick.randint(0, 30))]
        docs.append((i, "; ".join(parts)))
    docs += [(500, None), (501, ""), (502, "... "), (503, "a a a " * 5000), (0, docs[0][1]), (None, docs[1][1])]
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, item string, mark string").repartition(3)
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, text_key int")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, sorted(r["items"])) for r in dc.contamination(frame, bench).collect())
    known = [(i, t) for i, t in items if i is not None]
    assert got == sorted((str(i), *brute(t, known)) for i, t in set(docs))
    kept = dc.clean(frame, bench)
    assert kept.columns == frame.columns
    assert kept.count() == sum(not (n and 20 * n >= w) for w, n, _ in (brute(t, known) for _, t in docs))


def test_shared_passage_of_many_items_is_met_once(spark):
    """A passage in every item and in every document makes rows for documents and for items, not for pairs."""
    head = " ".join(f"h{i}" for i in range(14))
    items = spark.createDataFrame([(i, f"{head} own{i}") for i in range(3000)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{head} d{i}") for i in range(200)], "doc_id long, text string")
    started = time.monotonic()
    rows = dc.contamination(docs, items).select("n_hit", "n_items", F.size("items").alias("size")).distinct().collect()
    assert [tuple(r) for r in rows] == [(14, 3000, 3000)]
    assert time.monotonic() - started < 30


def test_very_long_text(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "word " * 400_000 + passage)], "doc_id long, text string")
    row = dc.contamination(docs, spark.createDataFrame([(7, passage)], "item_id long, text string")).first()
    assert (row.n_words, row.n_hit, row["items"]) == (400_020, 20, ["7"])


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert dc.contamination(docs, items).first().n_hit == 0
    assert dc.contamination(docs.limit(0), items).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_every_long_shared_span_leaves_a_common_fingerprint(seed):
    import numpy as np

    pick = np.random.default_rng(seed)
    span = pick.integers(0, 9, dc.WINDOW).astype(np.uint64)
    a, b = (np.concatenate([pick.integers(0, 9, n).astype(np.uint64), span, pick.integers(0, 9, m).astype(np.uint64)]) for n, m in pick.integers(0, 40, (2, 2)))
    marks = [set(dc.winnow(x, np.array([0, len(x)]), ())[1].tolist()) for x in (a, b)]
    assert marks[0] & marks[1]


def test_query_matches_duckdb(spark, sf_dir):
    same_as_duckdb(spark, "op2_decontamination", sf_dir)
