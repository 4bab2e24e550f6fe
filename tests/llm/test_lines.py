import random

from tests.llm.helpers import same_as_duckdb
from tripweave.llm import lines


def brute(docs, min_words):
    """Longest match of every suffix with every earlier, not overlapping one; (doc_id, text) sorted as the operator orders them."""
    seqs = [(k, [(n, x) for n, x in enumerate(t.split("\n")) if x.split()]) for k, t in docs]
    flat = [(d, i) for d, (_, s) in enumerate(seqs) for i in range(len(s))]
    gone = {d: set() for d in range(len(docs))}
    for d, i in flat:
        for e, j in flat:
            if (e, j) >= (d, i):
                break
            a, b, n = seqs[d][1], seqs[e][1], 0
            while i + n < len(a) and j + n < len(b) and a[i + n][1] == b[j + n][1] and (d != e or j + n < i):
                n += 1
            if sum(len(x.split()) for _, x in a[i : i + n]) >= min_words:
                gone[d].update(a[i + q][0] for q in range(n))
    return {docs[d][0]: "\n".join(x for n, x in enumerate(docs[d][1].split("\n")) if n not in gone[d]) for d in gone}


def test_same_as_brute_force(spark):
    pick = random.Random(2)
    line = lambda: pick.choice(["a b", "c", "", "d e f", "g h i j k", " ", "l m\tn"])
    passages = [[line() for _ in range(pick.randint(2, 9))] for _ in range(6)]
    docs = []
    for i in range(60):
        own = [f"own {i} {j}" for j in range(pick.randint(0, 4))]
        body = own + pick.choice(passages) + [f"x{i}"] + (pick.choice(passages) if pick.random() < 0.5 else [])
        docs.append((i, "\n".join(body)))
    docs += [(60, docs[3][1]), (61, ""), (62, "\n\n")]
    want = brute(docs, 8)
    frame = spark.createDataFrame([(k, t, 1, "g") for k, t in docs], "doc_id long, text string, seq int, gone string")
    got = lines.dedup_lines(frame.repartition(3), 8)
    assert got.columns == frame.columns
    assert {r.doc_id: r.text for r in got.collect()} == want


def test_nulls_repeats_and_empty(spark):
    long = "\n".join(f"w{i} x y z" for i in range(40))
    rows = [(1, long), (1, long), (2, None), (None, long), (3, long + "\nend"), (4, "same line here\n" * 500)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 20, removed="n").collect()
    assert sorted(str((r.doc_id, r.text, r.n)) for r in got) == sorted(
        str(r) for r in [(1, "", 40), (1, "", 40), (2, None, 0), (None, long, 0), (3, "end", 40), (4, "same line here\n" * 7, 493)]
    )
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_matches_duckdb(spark, sf_dir):
    assert same_as_duckdb(spark, "op4_line_dedup", sf_dir).n_removed.sum() > 0


def test_plan_is_native(spark, sf_dir):
    from tripweave.llm.queries import op4_line_dedup

    plan = op4_line_dedup(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
