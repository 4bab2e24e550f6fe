import random
import re

from tests.llm.helpers import same_as_duckdb
from tripweave.llm import neardup
from tripweave.llm.graph import components


def shingles(text, size):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(docs, size, at_least):
    sets = {k: shingles(t, size) for k, t in docs}
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= at_least * len(x | y):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return sorted((k, len(sets[k]), root(k), root(k) == k) for k in sets)


def make(seed, groups, most):
    """Groups of copies whose members are edited from one another, so that links form chains, stars and strays."""
    pick = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    docs = []
    for _ in range(groups):
        pool = [[pick.choice(vocab) for _ in range(pick.randint(3, 120))]]
        for _ in range(pick.randint(1, most)):
            text = list(pick.choice(pool))
            for _ in range(pick.randint(0, max(1, len(text) // 30))):
                text[pick.randrange(len(text))] = pick.choice(vocab)
            pool.append(text)
        docs += [" ".join(t) for t in pool]
    pick.shuffle(docs)
    return list(enumerate(docs))


def test_same_components_as_brute_force(spark):
    docs = make(1, 25, 12) + make(2, 1, 150)
    docs = [(i, t) for i, (_, t) in enumerate(docs)] + [(9001, None), (9002, ""), (9003, " "), (9004, "One two"), (9005, "one TWO")]
    frame = spark.createDataFrame([(k, t, 1, "x") for k, t in docs], "doc_id long, text string, n long, sig string").repartition(5)
    got = sorted(tuple(r) for r in neardup.near_duplicates(frame, 4).collect())
    want = brute(docs, 4, 80)
    assert got == want
    kept = neardup.drop_near_duplicates(frame, 4)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [k for k, _, _, keep in want if keep]


def test_nulls_repeats_and_empty(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (None, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str((r.doc_id, r.component_id, r.kept)) for r in got) == ["(1, 1, True)"] * 2 + ["(2, 1, False)"] + ["(None, None, True)"] * 2
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bounds_let_true_pairs_pass():
    import numpy as np

    pick = np.random.default_rng(1)
    runs = np.cumsum(pick.random((200_000, 180)) < 0.8, axis=1)
    lost = np.zeros(len(runs), bool)
    for n, m in neardup.least_matches(80):
        lost |= runs[:, n - 1] < m
    assert lost.sum() <= 2
    assert ((pick.random((200_000, 128)) < 0.1).sum(1) > neardup.most_unlike(80)).sum() <= 1


def test_components_of_a_long_path_and_a_star(spark):
    pick = random.Random(4)
    names = list(range(100, 400))
    pick.shuffle(names)
    links = list(zip(names, names[1:], strict=False)) + [(7, i) for i in range(1000, 1300)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(names, 100), **dict.fromkeys(range(1000, 1300), 7), 7: 7}


def test_query_matches_duckdb(spark, sf_dir):
    got = same_as_duckdb(spark, "op7_near_duplicates", sf_dir)
    assert (~got.kept).sum() > 0
