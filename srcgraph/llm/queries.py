"""Named queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from srcgraph.llm import (
    embedding_join, extract_html, language_id, manifest, merkle, mixing, ngram_join, packing, passage_dedup, secrets,
    suffix_dedup, toxicity, twins, whitening)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_extract_html")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return extract_html.extract_main_text(table(spark, sf, "pages"))


@query("op2_scan_secrets")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf, "documents"))


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"))


@query("op8_mix_sources")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@query("op9_toxicity")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_lexicon(docs, table(spark, sf, "labels")))


@query("op3_ngram_jaccard_join", twins.SIMILAR)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.join_similar(table(spark, sf, "documents")).drop("uid")


@query("op7_embedding_near_dedup", twins.EMBEDDINGS)
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_join.link_embeddings(table(spark, sf, "embeddings"))


@query("op10_merkle_fingerprints")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.merkle_fingerprints(table(spark, sf, "documents"))


@query("op5_suffix_array_dedup")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf, "documents")).drop("kept")


@query("op6_substring_dedup", twins.PASSAGES)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return passage_dedup.remove_passages(table(spark, sf, "documents")).drop("kept")


@query("op12_merkle_manifest", twins.MANIFEST)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.verify_manifest(table(spark, sf, "documents"))


@query("op13_language_id")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return language_id.identify_languages(docs, language_id.fit_languages(docs))


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))
