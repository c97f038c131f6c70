"""Registered queries opN_<name> and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hushframe.llm import oracles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _add(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@_add("op1_jump_sharding")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    from hushframe.llm.sharding import document_shards

    return document_shards(documents(spark, sf))


@_add("op7_exact_dedup", oracles.EXACT_DEDUP)
def op7(spark: SparkSession, sf: str) -> DataFrame:
    from hushframe.llm.exact_dedup import document_copies

    return document_copies(documents(spark, sf))


@_add("op5_histogram_packing")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    from hushframe.llm.packing import document_pieces

    return document_pieces(documents(spark, sf))


@_add("op9_wavelet_tokens")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    from hushframe.llm.wavelet import document_tokens

    return document_tokens(documents(spark, sf))


@_add("op3_source_mixing", oracles.SOURCE_MIXING)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    from hushframe.llm.mixing import document_mix

    return document_mix(documents(spark, sf))


@_add("op4_adaptive_quality", oracles.ADAPTIVE_QUALITY)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    from hushframe.llm.quality_rules import document_verdicts

    return document_verdicts(documents(spark, sf))


@_add("op2_ftrl_toxicity")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    from hushframe.llm.toxicity import document_scores

    return document_scores(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


@_add("op8_simhash_variants")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    from hushframe.llm.simhash import document_components

    return document_components(documents(spark, sf))


@_add("op6_linked_secrets")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    from hushframe.llm.secrets import document_secrets

    return document_secrets(documents(spark, sf))


@_add("op10_license_rules")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    from hushframe.llm.licenses import document_licenses

    return document_licenses(documents(spark, sf))


@_add("op13_phrase_collocations", oracles.PHRASES)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    from hushframe.llm.phrases import collocations

    return collocations(documents(spark, sf))


@_add("op12_feast_whitening")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    from hushframe.llm.whitening import vector_components

    return vector_components(spark.read.parquet(f"{sf}/embeddings.parquet"))


@_add("op11_nn_descent")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    from hushframe.llm.neighbours import vector_links

    return vector_links(spark.read.parquet(f"{sf}/embeddings.parquet"))
