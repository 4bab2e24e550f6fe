"""Collocations against plain counters, transducers against dictionaries."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tests.llm.helpers import same_as_duckdb
from tripweave.llm import collocation as co

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, top):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(SMALL)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    cand = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    inside = Counter()
    for (lang, p), a in cand.items():
        for j in range(2, len(p)):
            for i in range(len(p) - j + 1):
                inside[lang, p[i : i + j]] = max(inside[lang, p[i : i + j]], a)
    rows = {}
    for (lang, p), a in cand.items():
        if inside[lang, p] >= a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        rows.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    out = []
    for lang, found in rows.items():
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def corpus(seed, rows=300):
    pick = random.Random(seed)
    words = ["a", "B", "c", "the", "The", "é", "x-y", " ", "a\x00", "zz", "q", "日本"]
    gap = lambda: pick.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?", "\x0b"])
    text = lambda: "".join(pick.choice(words[: pick.choice([3, 6, 12])]) + gap() for _ in range(pick.randint(0, 40)))
    return [(pick.choice(["en", "en", "en", "de", "", None]), pick.choice([text(), text(), text(), None, ""])) for _ in range(rows)]


def run(spark, docs, **more):
    frame = spark.createDataFrame([(i, *d, 1, "x") for i, d in enumerate(docs)], "doc_id long, lang string, text string, n int, phrase string").repartition(4)
    return sorted(tuple(r) for r in co.collocations(frame, **more).collect())


def test_same_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(co, "SHARD_BYTES", 2000)
    docs = corpus(1)
    for least, top in ((4, 2000), (10, 7)):
        want = brute(docs, least, top)
        assert len({r[0] for r in want}) >= 3
        assert run(spark, docs, least=least, top=top) == want


def test_long_text_repeats_and_empty(spark):
    docs = [("en", "new york city " * 30_000), (None, "one two"), ("en", None), ("en", "")] + [("fr", "le chat.")] * 5
    assert run(spark, docs, least=5) == brute(docs, 5, 2000)
    assert run(spark, [], least=1) == []
    assert run(spark, [("en", None), (None, " ,")], least=1) == []


def test_products_beyond_64_bits(spark):
    """Counts as large as a corpus of trillions of words would give."""
    from pyspark.sql import functions as F

    a, n, left, right = 3 * 10**12, 9 * 10**14, 7 * 10**12, 5 * 10**12
    exact = "(cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    frame = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    assert frame.select(F.expr(exact)).first()[0] == 1000 * a * n // (left * right)


def trie(grams):
    words = sorted({w for g in grams for w in g}, key=str.encode)
    number = {w: i for i, w in enumerate(words)}
    table = np.array([[number[w] for w in g] for g in grams], np.int64)
    return co.Transducer.build(pa.array(words, pa.string()), list(table.T))


def weights(t):
    return dict(zip(t.phrases().to_pylist(), t.counts.tolist(), strict=True))


def test_union_cut_and_composition():
    pick = random.Random(4)
    for n in (1, 2, 4):
        parts = [[tuple(pick.choice("abcdeé") * pick.randint(1, 2) for _ in range(n)) for _ in range(pick.randint(1, 200))] for _ in range(5)]
        whole = co.union([trie(p) for p in parts])
        want = Counter(" ".join(g) for p in parts for g in p)
        assert weights(whole) == want
        assert whole.phrases().to_pylist() == sorted(want, key=lambda p: [w.encode() for w in p.split(" ")])
        bounds = sorted({tuple(w.encode() for w in pick.choice(parts[0])) for _ in range(4)})
        cut = [whole.cut(low, high) for _, low, high in co.ranges(whole, [list(b) for b in bounds])]
        assert weights(co.union(cut)) == want and sum(len(c.counts) for c in cut) == len(want)
        back = co._transducers(pa.Table.from_batches([co._batch([co._blob("x", i, c) for i, c in enumerate(cut)])]).slice(1))
        assert [weights(b) for b in back] == [weights(c) for c in cut[1:]]
        words = whole.words.to_pylist()
        asked = [[pick.randrange(len(words)) for _ in range(n)] for _ in range(300)]
        got = whole.compose(list(np.array(asked, np.int64).T))
        assert got.tolist() == [want.get(" ".join(words[i] for i in g), 0) for g in asked]


def test_filter_keeps_every_frequent_part(spark):
    frame = spark.createDataFrame([("en", f"w{i} v{i % 7} é") for i in range(500)], "lang string, phrase string")
    table = co.part_filter(frame)
    texts = pa.RecordBatch.from_pylist([{"text": f"w{i} v{i % 7} é"} for i in range(500)])
    _, _, data, offsets = next(co.tx.pieces(texts, "text"))
    starts, ends, _ = co.tx.spans(data, offsets, co.WORD)
    hashes = co.gram_hashes(co.tx.hash_spans(data, starts, ends), np.full(len(starts), co.lang_hash("en")), 3)
    assert co._passes(table, hashes[::3]).all() and co._passes(table, hashes[1::3]).mean() < 0.05


def test_query_matches_duckdb(spark):
    assert len(same_as_duckdb(spark, "op12_collocations", "/root/testdata/sf0.01")) > 10
