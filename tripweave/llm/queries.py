"""The thirteen operators over the whole tables, with production parameters; oracle SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.llm import bpe, collocation, decontaminate, hostrules, htmltext, langid, lines, merkle, neardup, packing, quality, repeats, toxicity
from tripweave.llm import oracles as sql
from tripweave.llm.sampling import held_out
from tripweave.sources.storage import stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Contract columns of op6: encoded, and decoded again from the ids."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.digests(bpe.encode(docs.select("doc_id", "text"), path, decoded="decoded"))


@register()
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


@register(sql.DECONTAMINATION)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", decontaminate.contaminated().alias("contaminated"))


@register(sql.LINE_DEDUP)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text that is left, and how many lines went."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, removed="n_removed")


@register(sql.NEAR_DUPLICATES)
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=4, at_least=80)


#: A document is taken for toxic, or for good, from this score on.
THRESHOLD = 0.3


@register()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@register()
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


@register(sql.HOST_RULES)
def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return hostrules.apply_rules(docs, F.col("source")).select("doc_id", *hostrules.COUNTS, "base_failed", "kept")


@register()
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = held_out(4, 2)
    model = langid.fit(docs.select("doc_id", "text", "lang"), held)
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


@register()
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed rows of 2048 ids; every document ends with the end-of-text id of the vocabulary."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = public_tokenizers.PATTERN
    return packing.pack(table(spark, sf_dir, "documents"), lambda: packing.rank_encoder(path, pattern).encode_ordinary, end=50256)


@register()
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stage(quality.statistics(table(spark, sf_dir, "documents").select("doc_id", "text")), "statistics")
    held = held_out(5, 0)
    model = quality.fit(stats, table(spark, sf_dir, "labels"), held)
    scored = stats.select("doc_id", held.alias("held_out"), quality.compiled(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


@register(sql.MERKLE)
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.changed_leaf())
    return merkle.manifest(table(spark, sf_dir, "documents"), changed=tampered)


@register(sql.COLLOCATIONS)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"))


@register(sql.REPEATS)
def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.remove_repeats(table(spark, sf_dir, "documents")))
