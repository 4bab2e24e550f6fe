import numpy as np
from pyspark.sql import functions as F

from tripweave.llm import langid
from tripweave.llm.queries import op3_language
from tripweave.llm.sampling import held_out

DIR = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang")
    got = op3_language(spark, DIR).join(docs, "doc_id").filter("held_out").toPandas()
    right = got.lang_pred == got.lang
    assert right.mean() > 0.97
    assert got.score.between(0, 1).all()
    assert right[~got.rejected].mean() > 0.99 and got.rejected.mean() < 0.1


def test_subwords_do_not_cross_texts():
    texts = ["ab cd", "", "  e--f ", "Ünd", "x"]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    together = [(b.tolist(), o.tolist()) for b, o in langid.subwords(data, offsets)]
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        alone = [b.tolist() for b, _ in langid.subwords(raw, np.array([0, len(raw)]))]
        assert alone == [b[o[i] : o[i + 1]] for b, o in together]


def test_und_nulls_repeats_and_nothing_to_learn(spark):
    rows = [(1, "the cat", "en"), (1, "the cat", "en"), (None, "12 --", None), (3, None, None), (4, "", None), (5, "¿¡", None), (6, "日本", None)]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, lang string, score double")
    model = langid.fit(docs, F.lit(False))
    got = langid.predict(docs, model).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: str(r.text))] == ["und", "und", "und", "en", "en", "und", "en"]
    assert langid.fit(docs.limit(0), held_out(4, 2)) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
