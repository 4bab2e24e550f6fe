import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.helpers import same_as_duckdb
from tripweave.llm import hostrules as hr


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(wins)
    hit = {q for i, w in enumerate(wins) if many[w] > 1 for q in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_counts_match_brute_force(spark):
    pick = random.Random(8)
    say = lambda n: "".join(pick.choice(["a ", "b ", "é", "# ", "\n", "\t", "c|d ", "  "]) for _ in range(n))
    texts = [say(pick.randint(0, 80)) for _ in range(300)] + [None, "", "\n\n", "x " * 100_000, " a\na\n a"]
    frame = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], "doc_id long, text string, extra string, n_words int").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in hr.COUNTS) for r in hr.counted(frame).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_bad_host_takes_its_documents_along(spark):
    fine, bad = " ".join(f"w{i}" for i in range(30)), "spam " * 30
    rows = [(f"good{h}", fine if i else bad) for h in range(20) for i in range(20)]
    rows += [("bad", fine if i < 2 else bad) for i in range(40)] + [("small", bad), ("small", fine), (None, fine), (None, bad)]
    docs = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(rows)], "doc_id long, host string, text string")
    got = hr.apply_rules(docs, F.col("host")).groupBy("host").agg(F.sum(F.col("kept").cast("int")).alias("n")).collect()
    kept = {r.host: r.n for r in got}
    assert kept["bad"] == 0 and kept["small"] == 1 and kept[None] == 1
    assert all(kept[f"good{h}"] == 19 for h in range(20))


def test_each_rule_has_its_own_rate(spark):
    """Hosts of symbols, repeated lines or single letters fall by those rules though none of their documents fails the base."""
    words = lambda d: [f"w{d}x{i}" for i in range(30)]
    kinds = {
        "fine": lambda d: " ".join(words(d)),
        "symbols": lambda d: " # ".join(words(d)),
        "lines": lambda d: "\n".join(x for w in words(d) for x in (w, "same")),
        "letters": lambda d: " ".join(chr(0x4E00 + 40 * d + i) for i in range(30)),
    }
    rows = [(f"{kind}{h}", make(100 * h + d)) for kind, make in kinds.items() for h in range(10 if kind == "fine" else 1) for d in range(20)]
    docs = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(rows)], "doc_id long, host string, text string")
    verdicts = {r.host: r for r in hr.host_verdicts(hr.counted(docs), "host").collect()}
    assert {h for h, r in verdicts.items() if not r.host_ok} == {"symbols0", "lines0", "letters0"}
    high = lambda h: [k for k in hr.rules() if verdicts[h][f"rate_{k}"] > hr.REJECT]
    assert (high("symbols0"), high("lines0"), high("letters0")) == (["symbols"], ["dup_lines"], ["short_words"])
    got = hr.apply_rules(docs, F.col("host"))
    assert got.filter("kept and base_failed").count() == 0
    assert got.filter("kept").count() == 200 and got.filter("not kept and not base_failed").count() == 60


def test_empty_table_and_one_host(spark):
    docs = spark.createDataFrame([], "doc_id long, host string, text string")
    assert hr.apply_rules(docs, F.col("host")).count() == 0
    one = spark.createDataFrame([(1, "h", "a b"), (1, "h", "a b")], "doc_id long, host string, text string")
    assert [r.kept for r in hr.apply_rules(one, F.col("host")).collect()] == [False, False]


def test_query_matches_duckdb(spark, sf_dir):
    same_as_duckdb(spark, "op10_host_rules", sf_dir)
