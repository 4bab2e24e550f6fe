import random

import numpy as np
import pytest

from tripweave.llm import packing as pk
from tripweave.llm.queries import op5_packing


def plain_best_fit(lengths, capacity):
    rooms, total = [], 0
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        total += not fits
        rooms.append((min(fits) if fits else capacity) - n)
        if fits:
            rooms.remove(min(fits))
    return total, sorted(rooms)


@pytest.mark.parametrize("seed", range(5))
def test_same_rows_as_plain_best_fit(seed):
    pick = random.Random(seed)
    capacity = pick.choice([1, 7, 64, 100])
    lengths = [pick.randint(1, capacity) for _ in range(pick.randint(0, 300))]
    rows = pk.best_fit_decreasing(lengths, capacity)
    assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
    rooms = [capacity - sum(lengths[i] for i in r) for r in rows]
    assert min(rooms, default=0) >= 0
    assert (len(rows), sorted(rooms)) == plain_best_fit(lengths, capacity)


def restored(rows, capacity, end):
    parts = {}
    for r in rows:
        ids, positions = pk.matrix([r.ids], capacity)[0], pk.matrix([r.positions], capacity)[0]
        assert r.n_tokens == r.cu_seqlens[-1] and (ids[r.n_tokens :] == end).all()
        for doc, part, low, high in zip(r.doc_ids, r.parts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert positions[low:high].tolist() == list(range(high - low))
            parts.setdefault(doc, {}).setdefault(part, []).append(ids[low:high])
    return {doc: np.concatenate([ps[0] for _, ps in sorted(p.items())]).tolist() for doc, p in parts.items()}


def test_lossless_with_overlong_null_and_repeated_rows(spark):
    texts = [(1, "a" * 1000), (2, None), (3, ""), (4, "bc" * 7), (None, "x"), (5, "y" * 31)]
    docs = spark.createDataFrame([(*t, "more") for t in texts], "doc_id long, text string, ids string")
    rows = pk.pack(docs.repartition(2), lambda: lambda t: list(t.encode()), end=0, capacity=32, window=200).collect()
    assert restored(rows, 32, 0) == {i: [*(t or "").encode(), 0] for i, t in texts}
    twice = pk.pack(docs.union(docs).coalesce(1), lambda: lambda t: list(t.encode()), end=0, capacity=32).collect()
    assert sum(r.n_tokens for r in twice) == 2 * sum(len(t or "") + 1 for _, t in texts)
    assert pk.pack(docs.limit(0), lambda: lambda t: [], end=0).count() == 0


def test_query_round_trip(spark, sf_dir):
    import public_tokenizers as P

    rows = op5_packing(spark, sf_dir).collect()
    got = restored(rows, pk.CAPACITY, 50256)
    encode = pk.rank_encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert {d.doc_id: d.text for d in docs} == {i: encode.decode(ids[:-1]) for i, ids in got.items()}
    full = sum(r.n_tokens for r in rows) / (len(rows) * pk.CAPACITY)
    assert full > 0.9
