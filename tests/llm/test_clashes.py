"""Further columns with the names that operators use inside: none is lost, none makes a query ambiguous."""

from pyspark.sql import functions as F

import corpus_pipeline as cp
from tripweave.llm import hostrules, quality, repeats, toxicity
from tripweave.llm.sampling import held_out

NAMES = ("label", "train_id", "n_removed", "n_removed_", "rule_host", "rated_host", "host_ok", "host", "k1", "k2", "spans", "sign", "bad", "good")


def clashing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 60")
    return docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in NAMES})


def untouched(frame):
    rows = frame.select("doc_id", *NAMES).collect()
    return bool(rows) and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in NAMES)


def test_host_rules_keep_other_columns(spark, sf_dir):
    docs = clashing(spark, sf_dir)
    got = hostrules.apply_rules(docs, F.col("source"))
    assert untouched(got)
    plain = hostrules.apply_rules(docs.select("doc_id", "text", "source"), F.col("source"))
    key = ["doc_id", "base_failed", "rate", "kept"]
    assert sorted(map(str, got.select(*key).collect())) == sorted(map(str, plain.select(*key).collect()))


def test_learning_ignores_columns_named_like_its_own(spark, sf_dir):
    docs, labels = clashing(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert untouched(toxicity.score(docs, toxicity.fit(docs, labels)))
    stats = quality.statistics(docs)
    assert quality.fit(stats, labels, held_out(5, 0)) is not None


def test_pipeline_stages(spark, sf_dir):
    docs = clashing(spark, sf_dir)
    for _, function in cp.STAGES[:-1]:
        left = function(spark, docs, sf_dir)
        assert left.columns == docs.columns and untouched(left)
    assert cp.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_repeats(spark, sf_dir):
    docs = clashing(spark, sf_dir)
    got, want = (sorted(map(str, repeats.remove_repeats(d).collect())) for d in (docs, docs.select("doc_id", "text")))
    assert got == want
