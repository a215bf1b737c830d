"""The registered queries of this subpackage, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import caps, jaccard, langid, lm, mixing, oracles, packing, pii, quality, sketch, tokens
from .common import source_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op1_pareto_mix": oracles.OP1, "op3_cap_dedup": oracles.OP3, "op8_jaccard": oracles.OP8}
TOKENIZER = "byte_bpe_50k.json"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(source_rows(spark, sf_dir, "documents"))


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digest(source_rows(spark, sf_dir, "documents"))


@query
def op3_cap_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(source_rows(spark, sf_dir, "embeddings"))


@query
def op4_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited_pairs(source_rows(spark, sf_dir, "documents"))


@query
def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(source_rows(spark, sf_dir, "documents"))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(source_rows(spark, sf_dir, "documents"), source_rows(spark, sf_dir, "labels"))


@query
def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(source_rows(spark, sf_dir, "documents"))


@query
def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(source_rows(spark, sf_dir, "documents"))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(source_rows(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(source_rows(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
