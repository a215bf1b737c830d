"""Queries of sources, stores and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources import formats as S
from larkspur.session import table

from .catalog import query


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.col("source"), F.lit("/d"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 10 == 0, ".meta").otherwise(""))
    return table(spark, sf_dir, "documents").select(key.alias("key"), F.octet_length("text").cast("long").alias("size"), F.col("doc_id").alias("used_at"))


_STORE = "store AS (SELECT source || '/d' || doc_id || CASE WHEN doc_id % 10 = 0 THEN '.meta' ELSE '' END AS key, strlen(text)::BIGINT AS size, doc_id AS used_at FROM documents)"


@query(f"WITH {_STORE} SELECT key, size FROM store WHERE key LIKE 'src1/%' AND key NOT LIKE '%.meta'")
def store_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7, SRC10, LIF18."""
    return S.list_keys(_store(spark, sf_dir), "src1/").select("key", "size")


@query(f"WITH {_STORE} SELECT CASE WHEN key LIKE 'src1%' THEN 'fast' WHEN key LIKE '%.meta' THEN 'meta' ELSE 'default' END AS backend, count(*)::BIGINT AS objects, sum(size)::BIGINT AS bytes FROM store GROUP BY 1")
def store_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC11, SRC12."""
    rules = [("src1*", "fast"), ("*.meta", "meta")]
    return _store(spark, sf_dir).groupBy(S.backend_of(F.col("key"), rules, "default").alias("backend")).agg(F.count(F.lit(1)).alias("objects"), F.sum("size").alias("bytes"))


@query(f"WITH {_STORE} SELECT key FROM (SELECT key, sum(size) OVER (PARTITION BY split_part(key, '/', 1) ORDER BY used_at DESC, key) AS t FROM store) WHERE t <= 50000")
def cache_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC15: 50,000 bytes for each source."""
    rows = _store(spark, sf_dir).withColumn("shard", F.substring_index("key", "/", 1))
    return S.evict(rows, "size", "used_at", 50_000, "shard").select("key")


@query("SELECT event_type, count(*) FILTER (value < 10)::DOUBLE / count(*) AS hit_rate FROM events GROUP BY event_type")
def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC14."""
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") < 10).alias("h"), F.count_if(~(F.col("value") < 10)).alias("m"))
    return rows.select("event_type", S.hit_rate(F.col("h"), F.col("m")).alias("hit_rate"))


@query("SELECT '  \"r' || n_regionkey || '\" -> \"n' || n_nationkey || '\";' AS value FROM nation")
def lineage_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK4."""
    return S.dot(table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst")))


@query("SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS value FROM region")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2."""
    return S.json_lines(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
