import numpy as np
import pytest
from pyspark.sql import functions as F

from tripweave.llm import toxicity as tox
from tripweave.llm.queries import op9_toxicity


@pytest.fixture(scope="module")
def scored(spark):
    rows = op9_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    return rows.join(labels, "doc_id").filter("held_out").toPandas()


def test_held_out_labels(scored):
    hit = ((scored.predicted == 1) & (scored.toxic == 1)).sum()
    assert hit / (scored.predicted == 1).sum() > 0.85
    assert hit / (scored.toxic == 1).sum() > 0.85


@pytest.fixture(scope="module")
def chance(spark):
    return tox.language_model(tox.letter_counts(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")))


def test_disguised_words_are_restored(chance):
    read = tox.Restorer(chance)
    for disguised, plain in [
        ("1d10t", "idiot"), ("m0r0n", "moron"), ("$tup1d", "stupid"), ("tr@sh", "trash"), ("i.d.i.o.t", "idiot"), ("i d i o t", "idiot"),
        ("idiooot", "idiot"), ("l0$er", "loser"), ("p4th3t1c", "pathetic"), ("m-o-r-o-n", "moron"), ("he is an 1d10t now", "he is an idiot now"),
    ]:
        assert read.restore(disguised) == plain
        data = tox.fold(np.frombuffer(disguised.encode(), np.uint8))
        assert tox.suspicious(data, np.array([0, len(data)])).tolist() == [True]
    assert read.restore("plain words, of no disguise. 12 300") == "plain words, of no disguise. 12 300"


def test_letter_counts_match_brute_force(spark):
    from collections import Counter

    texts = ["Ab c", None, "", "zzz--é", "a" * 10]
    got = {r.gram: r.n for r in tox.letter_counts(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)).collect()}
    code = [0, 0, 0]
    for t in texts:
        for b in [0, *(t or "").encode(), 0][:-1]:
            code.append(tox._CODE[b] if b else 0)
    code.append(0)
    kept = [c for i, c in enumerate(code) if i < 2 or code[i - 2 : i + 1] != [0, 0, 0]]
    want = Counter(((kept[i] * 28 + kept[i + 1]) * 28 + kept[i + 2]) * 28 + kept[i + 3] for i in range(len(kept) - 3))
    assert got == {int(k): v for k, v in want.items()}


def test_nulls_empty_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "x", 0.5), (1, "x", 0.5), (2, None, 1.0), (None, "", 2.0), (3, "idiot " * 50000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = tox.fit(docs, labels)
    got = tox.score(docs, model, "plain")
    assert got.columns == ["doc_id", "text", "score", "plain"]
    assert [r.score for r in got.collect()] == [0.0] * 5
    some = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 1, "you scum here").otherwise("all is well").alias("text"))
    got = {r.doc_id: r.score for r in tox.score(docs, tox.fit(docs, some)).collect()}
    assert all((got[i] > 0.5) == (i % 2 == 1) for i in got)


def test_long_tokens_and_words_of_a_spaced_phrase(chance):
    read = tox.Restorer(chance)
    for phrase in ("that stupid idiot and this pathetic moron", "this is the idiot " * 40):
        plain = " ".join(phrase.split())
        assert read.restore(" ".join(plain.replace(" ", ""))).split() == plain.split()
    long = ",".join(["1d10t"] * 30)
    assert set(read.decode(long).replace(",", " ").split()) == {"idiot"}
    assert "idiot" in read.decode("x" * 100_000 + "-1d10t")


def test_signs_at_the_end_and_runs_of_separators(chance):
    read = tox.Restorer(chance)
    for disguised, plain in [
        ("idi0+", "idiot"), ("idio7", "idiot"), ("tras#", "trash"), ("id----iot", "idiot"), ("mo....ron", "moron"), ("mo.-.ron", "moron"), ("i  d  i  o  t", "idiot"),
        ("i - d - i - o - t", "idiot"), ("m--o--r--o--n", "moron"), ("well,1d10t)", "well,idiot)"), ("idio7.", "idiot."), ("i d i o t  m o r o n", "idiot moron"),
    ]:
        assert read.restore(disguised) == plain, disguised
    for text in ("a$$", "shi7", "shi+", "idi0+", "id----iot", "mo....ron", "i  d  i  o  t", "i - d - i - o - t", "ééé", "e é e é", "well-known", "wow!", "$tupid"):
        # alone and beside another hit alike
        data = np.frombuffer(text.encode(), np.uint8)
        assert tox.suspicious(data, np.array([0, len(data)])).tolist() == [True], text
        assert read.restore(text + " , 1d10t") == read.restore(text) + " , idiot"
    assert read.restore("of that-this, and 1000 or 2,000") == "of that-this, and 1000 or 2,000"


def test_byte_marks_cover_the_expression():
    draw = np.random.default_rng(3)
    for letters in ("ab1$.-_ *", "aé -.", "a1!, é"):
        for _ in range(3000):
            text = "".join(draw.choice(list(letters), draw.integers(1, 12)))
            data = np.frombuffer(text.encode(), np.uint8)
            assert not tox._DISGUISED.search(text) or tox.suspicious(data, np.array([0, len(data)]))[0], text


def test_rare_signs_are_ranked_by_odds_among_all(spark):
    # 25 000 other words are in more toxic documents than the sign of three, and in as many others
    common = " ".join("".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(25_000))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    sample = tox.labelled_sample(labels, "toxic", tox.held_out(4, 2), tox.TRAIN_ROWS)
    kept = sorted(r.train_id for r in sample.filter("label = 1").collect())[:3]
    docs = spark.createDataFrame([(i, ("scumbag " if i in kept else "") + common) for i in range(60)], "doc_id long, text string")
    assert kept[-1] < 60
    model = tox.fit(docs, labels)
    word = np.frombuffer(b"scumbag", np.uint8)
    (_, _, whole), *_ = tox.signs(word, np.array([0, len(word)]))
    assert whole[0] in model.keys.tolist()
