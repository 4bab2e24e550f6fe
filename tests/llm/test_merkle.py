"""Manifest against a plain recursive build, and its cases."""

import random
from hashlib import sha256

import pytest

from tests.llm.helpers import same_as_duckdb
from tripweave.llm import merkle
from tripweave.llm.merkle import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    """Levels of a tree, lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def steps(levels, i):
    out = []
    for level in levels[:-1]:
        run = i - i % 16
        out.append(("".join(level[run:i]), "".join(level[i + 1 : run + 16])))
        i //= 16
    return out


def brute(rows, changed):
    """doc_id, leaf, subroot, root, proof, folded root of every row; ``changed`` maps a row to the row it is verified from."""
    leaf = lambda r: h(*map(field, r))
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in by_source[s]])
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(by_source[s]):
            path = steps(trees[s], i) + steps(top, k)
            folded = leaf(changed(r))
            for before, after in path:
                folded = h(before, folded, after)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], h(*(a + b for a, b in path)), folded, folded == top[-1][0]))
    return sorted(map(str, out))


def run(spark, rows, **more):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(str(tuple(r)) for r in manifest(frame, **more).collect())


def test_same_as_brute_force(spark):
    pick = random.Random(3)
    sizes = {None: 3, "": 1, "a": 16, "b": 17, "é": 300, "z": 1, "-": 2, "=": 2}
    sizes |= {f"s{i}": 1 for i in range(15)}
    ids = iter(pick.sample(range(10_000), sum(sizes.values())))
    rows = [(next(ids), s, pick.choice(["en", None]), pick.choice([None, 5]), pick.choice([None, "", "Ab", "äÖ", "x" * 5000])) for s, n in sizes.items() for _ in range(n)]
    bad = lambda r: r[0] % 3 == 0
    small = lambda r: (*r[:4], r[4].replace("A", "a") if r[4] else r[4]) if bad(r) else r
    from pyspark.sql import functions as F

    changed = F.when(F.col("doc_id") % 3 == 0, merkle.changed_leaf())
    got = run(spark, rows, changed=changed)
    assert got == brute(rows, small)
    assert any("False" in x for x in got)


def test_several_rounds_of_blocks(spark, monkeypatch):
    """Trees of more leaves than a block: 16^3 + some, so that a version goes on above its block."""
    rows = [(i, "hot" if i < 4500 else f"s{i % 2}", None, i, f"T{i}") for i in range(4600)]
    from pyspark.sql import functions as F

    changed = F.when(F.col("doc_id") % 5 == 0, merkle.changed_leaf())
    assert run(spark, rows, changed=changed) == brute(rows, lambda r: (*r[:4], r[4].lower()) if r[0] % 5 == 0 else r)


def test_nulls_repeats_more_columns_and_empty(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "a", "en", 1, "x"), (1, "a", "en", 1, "x"), (1, "a", "en", 1, "w")]
    assert run(spark, rows) == brute(rows, lambda r: r)
    assert manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame([(*r, 1, "t", "p", 2) for r in rows], SCHEMA + ", pos int, tree string, path string, total int")
    assert sorted(str(tuple(r)) for r in manifest(clash).collect()) == brute(rows, lambda r: r)


def test_a_version_shares_all_but_its_ancestors():
    base = merkle.climb([h(str(i)) for i in range(4096)], 3)
    path = merkle.copied(base, 777, h("x"))
    assert len(path) == 4
    whole = merkle.climb([h("x") if i == 777 else h(str(i)) for i in range(4096)], 3)
    for level, node in enumerate(path):
        i = 777 // 16**level
        assert whole[level][i] == node
        assert [x for j, x in enumerate(whole[level]) if j != i] == [x for j, x in enumerate(base[level]) if j != i]


@pytest.mark.parametrize("total", [1, 2, 16, 17, 256, 4096, 4097])
def test_height(total):
    assert merkle.height(total) == (len(tree(["x"] * total)) - 1 if total <= 4096 else 3)


def test_query_matches_duckdb(spark, sf_dir):
    got = same_as_duckdb(spark, "op13_merkle", sf_dir)
    assert 0 < (~got.verified).sum() < len(got)
