"""The stages one after another against plain Python on the smallest tables."""

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tests.llm import test_decontaminate, test_lines, test_neardup
from tripweave.llm import lines, toxicity
from tripweave.sources.storage import stage


def test_stages_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    functions = dict(cp.STAGES)

    clean = stage(functions["toxicity"](spark, docs, sf_dir), "test")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, model).collect() if r.score >= 0.3}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == set(texts) - bad
    texts = {k: t for k, t in texts.items() if k not in bad}

    single = stage(functions["line_dedup"](spark, clean, sf_dir), "test")
    # every deleted line stands further up, and only repeated passages go
    texts = {k: t for k, t in test_lines.brute(sorted(texts.items()), lines.MIN_WORDS).items()}
    got = {r.doc_id: (r.text, r.n_chars) for r in single.collect()}
    assert single.columns == columns and {k: v[0] for k, v in got.items()} == texts
    assert all(n == len(t) for t, n in got.values())

    distinct = stage(functions["near_duplicates"](spark, single, sf_dir), "test")
    kept = {k for k, _, _, keep in test_neardup.brute(sorted(texts.items()), 5, 80) if keep}
    assert distinct.columns == columns and {r.doc_id for r in distinct.collect()} == kept
    texts = {k: texts[k] for k in kept}

    fresh = stage(functions["decontamination"](spark, distinct, sf_dir), "test")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    judged = {k: test_decontaminate.brute(t, items) for k, t in texts.items()}
    kept = {k for k, (n, hit, _) in judged.items() if not (hit and 20 * hit >= n)}
    assert fresh.columns == columns and {r.doc_id for r in fresh.collect()} == kept

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {k: library.encode(texts[k], add_special_tokens=False).ids for k in kept}
    rows = {r.doc_id: r for r in cp.run(spark, sf_dir).collect()}
    assert set(rows) == kept
    for k, ids in want.items():
        assert (rows[k].n_tokens, rows[k].ids_sha256, rows[k].decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(texts[k]))


def test_stages_take_nulls_and_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (7, None, "en", "s", 0), (8, "", None, None, 0), (9, "a b c", "en", "s", 5), (9, "a b c", "en", "s", 5)], docs.schema)
    for start in (odd, docs.limit(0)):
        left = start
        for name, function in cp.STAGES:
            left = stage(function(spark, left, sf_dir), f"test-{name}")
        assert left.count() == (5 if start is odd else 0)
