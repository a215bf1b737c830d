"""The corpus pipeline: five stages of the training-data operators in a row.

Each stage takes (spark, docs, sf_dir) and works on all the documents that the
one before it kept; ``run`` writes each result as Parquet in the shared folder
and reads it again as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import jaccard, mixing, packing, pii, quality
from larkspur.llm.common import durable, join_small, source_rows, sweep

TOKENIZER = "byte_bpe_50k.json"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    scored = quality.classify(docs, source_rows(spark, sf_dir, "labels"), keep=COLUMNS)
    return scored.where("predicted = 1").select(COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of near copies;
    of rows that share an id, which are one node of the links, the one of the
    least text stays; a document without an id stays."""
    groups = jaccard.near_duplicates(docs)
    out = groups.where("doc_id <> component_id").select("doc_id").distinct()
    kept = join_small(docs.select(COLUMNS), out, ["doc_id"], "left_anti").select(COLUMNS)
    # ids that several rows share, of which one row each is taken by a partial aggregation
    shared = durable(kept.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id"))
    single = join_small(kept, shared, ["doc_id"], "left_anti")
    first = F.min(F.struct("text", "lang", "source", "n_chars"))
    one = join_small(kept, shared, ["doc_id"], "left_semi").groupBy("doc_id").agg(first.alias("_r")).select("doc_id", "_r.*")
    return single.unionByName(one).select(COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows the text."""
    clean = pii.redact(docs.select(COLUMNS))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mixing.mix(docs.select(COLUMNS), carry=COLUMNS)
    return taken.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents in their sequences."""
    return packing.best_fit_packing(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", one_of_each),
    ("PII", redact),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: The classifier, the boosted spans and the tokenizer are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = source_rows(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
        sweep(spark)
    return docs
