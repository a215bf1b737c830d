"""Queries that write files of every format and read them back, walk folders,
import lines, and export reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import detection as D
from larkspur.operators.graph import shared_folder
from larkspur.session import spread, table
from larkspur.sources import formats as S

from . import sql
from .catalog import query
from .sources_q import _STORE, _store

_ORDERS = "o_orderkey, o_custkey, o_totalprice, o_orderstatus"


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _summary(df: DataFrame, kind: str) -> DataFrame:
    return df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.sum(F.col("o_orderkey").cast("long")).alias("keys"), F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("price"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT kind, count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS keys, round(sum(o_totalprice), 2) AS price FROM orders, unnest(['json', 'jsonl', 'csv', 'parquet']) t(kind) GROUP BY kind")
def file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1, SRC3: rows written in each format and read by its name."""
    rows = table(spark, sf_dir, "orders").selectExpr(*_ORDERS.split(", "))
    parts = []
    for kind in ("json", "jsonl", "csv", "parquet"):
        path = _folder(spark)
        if kind == "json":
            # a file is one JSON array; arrays of some hundred rows each
            arrays = rows.groupBy(F.floor(F.col("o_orderkey") / 4000).alias("g")).agg(F.to_json(F.collect_list(F.struct("*"))).alias("value"))
            arrays.write.partitionBy("g").text(path)
        else:
            S.write(rows, path, kind)
        parts.append(_summary(S.read(spark, path, kind, rows.schema).select(*rows.columns), kind))
    return _all(parts)


@query("SELECT kind, count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS keys, round(sum(o_totalprice), 2) AS price FROM orders, unnest(['none', 'gzip', 'zstd', 'snappy', 'lz4']) t(kind) GROUP BY kind")
def file_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC2: every codec of Parquet that Spark's build has."""
    rows = table(spark, sf_dir, "orders").selectExpr(*_ORDERS.split(", "))
    parts = []
    for codec in ("none", "gzip", "zstd", "snappy", "lz4"):
        path = _folder(spark)
        S.write(rows, path, "parquet", "lz4_raw" if codec == "lz4" else codec)
        parts.append(_summary(S.read(spark, path, "parquet", rows.schema), codec))
    return _all(parts)


@query("SELECT conv_id % 7 AS k, count(*)::BIGINT AS records, count(*) FILTER (conv_id % 7 = 3)::BIGINT AS errors FROM conversations WHERE conv_id % 7 <> 5 GROUP BY 1")
def jsonl_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4: lines of JSON with blank ones, which are passed over, and bad ones, which are told apart."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 7).alias("k"))
    line = F.when(F.col("k") == 5, "").when(F.col("k") == 3, "{\"k\": 3").otherwise(F.to_json(F.struct("k")))
    path = _folder(spark)
    c.select(line.alias("value")).write.text(path)
    good, bad = S.import_jsonl(spark, path, "k long")
    errors = bad.where("line LIKE '{%' AND number >= 1").select(F.lit(3).cast("long").alias("k"), F.lit(1).alias("e"))
    rows = good.select("k", F.lit(0).alias("e")).unionByName(errors)
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("records"), F.sum("e").alias("errors"))


@query("SELECT source, lang, count(*)::BIGINT AS n FROM documents WHERE source IS NOT NULL AND lang IN ('en', 'de') AND source <> 'src2' GROUP BY ALL")
def folder_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5, SRC6, SRC9: a folder tree walked by name patterns and size; each
    file's lines are counted."""
    path = _folder(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").where("source IS NOT NULL AND lang IS NOT NULL")
    docs.select("lang", "source", F.concat(F.col("source"), F.lit("\t"), F.col("lang"), F.lit("\t"), F.col("doc_id").cast("string")).alias("value")).write.partitionBy("source", "lang").text(path)
    files = S.walk(spark, path, include=["part-*", "*.txt"], exclude=["*.crc", "_*"], most_mb=50)
    files = files.where(F.contains("path", F.lit("lang=en")) | F.contains("path", F.lit("lang=de"))).where(~F.contains("path", F.lit("source=src2")))
    lines = files.select(F.explode(F.split(F.col("content").cast("string"), "\n")).alias("l")).where("l <> ''")
    p = F.split("l", "\t")
    return lines.select(p[0].alias("source"), p[1].alias("lang")).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name AS name, contains(n_name, 'AN') AS inside, suffix(n_name, 'A') AS ends, starts_with(n_name, 'I') AS starts, n_name = 'CHINA' AS equal FROM nation")
def glob_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC6: the four kinds of patterns."""
    n = F.col("n_name")
    kinds = {"inside": "*AN*", "ends": "*A", "starts": "I*", "equal": "CHINA"}
    return table(spark, sf_dir, "nation").select(n.alias("name"), *[S.name_matches(n, p).alias(k) for k, p in kinds.items()])


@query(f"WITH {_STORE} SELECT count(*)::BIGINT AS objects, sum(size)::BIGINT AS bytes, true AS refused FROM store")
def store_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC8: put within a budget; one byte less is refused."""
    store = _store(spark, sf_dir)
    total = store.agg(F.sum("size")).first()[0]
    first = store.where("used_at % 2 = 0")
    whole = S.put_within(first, store.where("used_at % 2 = 1"), total)
    try:
        S.put_within(first, store.where("used_at % 2 = 1"), total - 1)
        refused = False
    except ValueError:
        refused = True
    return S.store_stats(whole).withColumn("refused", F.lit(refused))


@query("""WITH RECURSIVE q AS (SELECT user_id AS k, event_id, epoch_us(ts) AS t, user_id % 3 <> 0 AS found, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 c(k, i, event_id, f, hit) AS (SELECT k, i, event_id, t, false FROM q WHERE i = 1 UNION ALL SELECT q.k, q.i, q.event_id, CASE WHEN t - f < CASE WHEN found THEN 360000000000 ELSE 36000000000 END THEN f ELSE t END, t - f < CASE WHEN found THEN 360000000000 ELSE 36000000000 END FROM c JOIN q ON q.k = c.k AND q.i = c.i + 1)
 SELECT event_id, CASE WHEN k % 3 = 0 THEN 'negative_' ELSE '' END || CASE WHEN hit THEN 'hit' ELSE 'miss' END AS outcome FROM c""")
def cache_read_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC13: entries live for 100 hours, missing ones for 10."""
    e = table(spark, sf_dir, "events")
    store = e.select("user_id").distinct().where("user_id % 3 <> 0")
    return S.cache_lookups(e.select("event_id", "user_id", "ts"), store, "user_id", "ts", 360_000, 36_000).select("event_id", "outcome")


@query(f"WITH {_STORE} SELECT key FROM store WHERE key NOT LIKE 'src1/%'")
def cache_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC16."""
    return S.invalidate(_store(spark, sf_dir), "src1/").select("key")


@query("WITH RECURSIVE " + sql.hits_cte() + " SELECT doc_id, pii_type, count(*)::BIGINT AS entities, true AS gate FROM hit GROUP BY doc_id, pii_type")
def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1: the report as CSV files, read back, and the gate."""
    hits = D.hit_rows(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"]).select("doc_id", "pii_type")
    path = _folder(spark)
    gate = S.scan_report(hits, ["doc_id", "pii_type"], path)
    return S.read(spark, path, "csv", "doc_id long, pii_type string, entities long").withColumn("gate", F.lit(gate))


@query("SELECT user_id, '[' || string_agg('{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}', ',' ORDER BY event_id) || ']' AS value FROM events GROUP BY user_id")
def audit_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK3: one JSON array for each actor."""
    return S.export_json(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"])
