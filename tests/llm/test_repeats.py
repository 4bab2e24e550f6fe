"""Repeated strings against a plain count of all windows; buckets against all pairs."""

import random
from collections import Counter

import pytest

from tests.llm.helpers import same_as_duckdb
from tripweave.llm import repeats as rp


def brute(docs, length):
    raw = [(t or "").encode() for _, t in docs]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for (doc_id, _), r in zip(docs, raw, strict=True):
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(r), sum(gone), runs, bytes(b for b, g in zip(r, gone, strict=True) if not g)))
    return sorted(map(str, out))


def run(spark, docs, parts=3, **more):
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, start int, gram string").repartition(parts)
    return sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in rp.remove_repeats(frame, **more).collect())


def corpus(seed):
    pick = random.Random(seed)
    word = lambda n: "".join(pick.choice("abé") for _ in range(n))
    passages = [word(pick.randint(15, 60)) for _ in range(5)]
    docs = []
    for i in range(80):
        parts = [word(pick.randint(0, 30)), pick.choice(passages)[pick.choice([0, 0, 3]) :], word(pick.randint(0, 9)), pick.choice(passages) if pick.random() < 0.4 else ""]
        docs.append((i, "".join(parts)))
    return docs + [(100, docs[3][1]), (3, docs[3][1]), (101, None), (None, passages[0]), (102, ""), (103, "ab" * 200), (104, "a" * 90), (105, word(19))]


@pytest.mark.parametrize("seed,bucket", [(1, 1024), (2, 3), (3, 1)])
def test_same_as_brute_force(spark, seed, bucket):
    """With buckets of three or one, every group goes through the halving, down to whole windows."""
    docs = corpus(seed)
    want = brute(docs, 20)
    assert run(spark, docs, length=20, gram=6, bucket=bucket) == want


def test_production_length(spark):
    """A passage of more than 400 bytes in unlike surroundings; one of 399 stays; a very long text; blocks of windows."""
    pick = random.Random(9)
    word = lambda n: "".join(pick.choice("abcdefgh ") for _ in range(n))
    passage, short = word(701), word(399)
    docs = [(i, word(300) + passage[i % 3 :] + word(200)) for i in range(8)] + [(20 + i, word(50) + short + word(50)) for i in range(3)]
    docs += [(40, word(60_000) + passage[:450] + word(30_000)), (41, word(100)), (42, "xyz" * 3000)]
    want = brute(docs, 400)
    assert run(spark, docs) == want
    assert run(spark, docs, bucket=2) == want


def test_blocks_of_windows(monkeypatch, spark):
    monkeypatch.setattr(rp, "BLOCK", 64)
    docs = corpus(4)
    frames = [rp.tx.np.frombuffer(t.encode(), rp.np.uint8) for _, t in docs if t]
    data = rp.np.concatenate(frames)
    ends = rp.np.repeat(rp.np.cumsum([len(f) for f in frames]), [len(f) for f in frames])
    small = rp.anchors(data, ends, 20, 6)
    monkeypatch.setattr(rp, "BLOCK", 1 << 22)
    for a, b in zip(small, rp.anchors(data, ends, 20, 6), strict=True):
        assert a.tolist() == b.tolist()


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "")]) == brute([(1, None), (2, "")], 400)


def pairs(bodies, offs):
    for i, a in enumerate(bodies):
        for j, b in enumerate(bodies):
            if i != j:
                yield i, rp.common_prefix(a[: offs[i]][::-1], b[: offs[j]][::-1]), rp.common_prefix(a[offs[i] :], b[offs[j] :])


@pytest.mark.parametrize("seed", range(6))
def test_bucket_against_all_pairs(seed):
    pick = random.Random(seed)
    texts = {}
    while len(texts) < 40:
        before = "".join(pick.choice("ab") for _ in range(pick.randint(0, 9)))
        texts[before + "#" + "".join(pick.choice("ab") for _ in range(pick.randint(0, 9)))] = len(before)
    bodies, offs = [t.encode() for t in texts], list(texts.values())
    bucket = rp.Bucket(bodies, offs)
    left, right = bucket.covers(7)
    want_left, want_right = [0] * 40, [0] * 40
    for i, before, after in pairs(bodies, offs):
        if before + after >= 7:
            want_left[i], want_right[i] = max(want_left[i], before), max(want_right[i], after)
    assert left.tolist() == want_left and right.tolist() == want_right
    # a maximal repeat holds all its occurrences, and grows on neither side without losing one
    groups = {}
    for before, after, members in bucket.maximal_repeats(7):
        string = bodies[members[0]][offs[members[0]] - before : offs[members[0]] + after]
        assert string not in groups
        groups[string] = sorted(members.tolist())
    for i, before, after in pairs(bodies, offs):
        if before + after >= 7:
            assert bodies[i][offs[i] - before : offs[i] + after] in groups
    for string, members in groups.items():
        at = string.index(b"#")
        assert members == [i for i, b in enumerate(bodies) if b[max(0, offs[i] - at) : offs[i] - at + len(string)] == string]
        assert len({bodies[i][offs[i] - at - 1 : offs[i] - at] for i in members}) > 1 or any(offs[i] == at for i in members)


def test_groups_list_every_occurrence(spark):
    docs = [(1, "q" * 5 + "the same passage here" + "1234567"), (2, "the same passage here"), (3, "zz the same passage here now"), (4, "nothing of it at all, no")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.doc_id, r.start, r.n_bytes) for r in rp.repeat_groups(frame, length=20, gram=6).collect()}
    assert {(1, 5, 21), (2, 0, 21), (3, 3, 21)} <= found and not any(d == 4 for d, _, _ in found)


def test_query_matches_duckdb(spark, sf_dir):
    assert (same_as_duckdb(spark, "op11_repeats", sf_dir).n_removed > 0).any()
