"""Queries of content addresses, chunks and hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import content as C
from larkspur.session import table

from .catalog import query


@query("SELECT page_id, 'sha256:' || sha256(html) AS address, 'sha256/' || left(sha256(html), 4) || '/' || substr(sha256(html), 5) AS key, 'sha256:' || sha256(html) AS parsed, true AS verified FROM pages")
def content_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CNT1, CNT2, CNT3."""
    addr = C.address(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", addr.alias("address"), C.storage_key(addr).alias("key"), C.parse_key(C.storage_key(addr)).alias("parsed"), C.verified(F.col("html"), addr).alias("verified"))


@query("SELECT sha256(text) AS content_hash, count(*)::BIGINT AS ref_count, any_value(strlen(text))::INT AS size_bytes FROM documents GROUP BY 1")
def record_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET5, AGG34, LIF17."""
    return C.unique_contents(table(spark, sf_dir, "documents"), "text")


_CHUNKS = "c AS (SELECT page_id, unnest(range(0, greatest(ceil(strlen(html) / 1024.0)::INT, 1)))::INT AS idx, strlen(html)::INT AS n FROM pages)"


@query(f"WITH {_CHUNKS} SELECT page_id, idx, idx * 1024 AS \"offset\", least(1024, n - idx * 1024) AS length FROM c")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CNT4."""
    return C.chunk_rows(table(spark, sf_dir, "pages"), ["page_id"], "html", 1024).select("page_id", "idx", "offset", "length")


@query("SELECT page_id, sha256(html) AS data_hash, true AS verified FROM pages")
def chunk_reassemble_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CNT6."""
    chunks = C.chunk_rows(table(spark, sf_dir, "pages"), ["page_id"], "html", 1024)
    return C.reassemble(chunks, ["page_id"]).select("page_id", F.sha2("data", 256).alias("data_hash"), "verified")


@query(f"WITH {_CHUNKS} SELECT page_id, true AS valid, count(*)::BIGINT AS chunks, any_value(n)::BIGINT AS total FROM c GROUP BY page_id")
def manifest_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN10."""
    return C.manifest_check(C.chunk_rows(table(spark, sf_dir, "pages"), ["page_id"], "html", 1024), ["page_id"])


@query("SELECT page_id, 0 AS idx, 0 AS length FROM pages WHERE false UNION ALL SELECT page_id, unnest(range(0, greatest(ceil(strlen(html) / 4096.0)::INT, 1)))::INT AS idx, least(4096, strlen(html) - idx * 4096)::INT FROM pages")
def cdc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CNT5: text has no zero bytes, so its chunks end at the largest size."""
    return C.content_chunks(table(spark, sf_dir, "pages"), "page_id", "html")


@query()
def blake3_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HSH1."""
    return table(spark, sf_dir, "benchmark").select("item_id", C.blake3(F.col("text")).alias("hash"))


# the code by its definition: two hashes over the key padded with zeros and crossed with 36 and 5C
_PADDED = b"whsec_test".ljust(64, b"\0")
_BLOBS = ["".join(f"\\x{b ^ c:02X}" for b in _PADDED) for c in (0x36, 0x5C)]


@query(f"SELECT event_id, 'sha256=' || sha256('{_BLOBS[1]}'::BLOB || unhex(sha256('{_BLOBS[0]}'::BLOB || encode(props)))) AS signature FROM events")
def hmac_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HSH2, CNT12."""
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("sha256="), C.hmac_sha256("whsec_test", F.col("props"))).alias("signature"))


@query("SELECT conv_id, sha256(string_agg(lpad(turn::VARCHAR, 6, '0') || ' ' || role || chr(0) || sha256(text), chr(10) ORDER BY turn, sha256(text))) AS tree_hash FROM conversations GROUP BY conv_id")
def tree_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CNT9, CNT10: one hash of a record's entries in order."""
    entry = F.concat(F.lpad(F.col("turn").cast("string"), 6, "0"), F.lit(" "), F.col("role"), F.lit("\x00"), F.sha2("text", 256))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.sha2("text", 256).alias("h"), entry.alias("e")))), lambda x: x["e"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sha2(F.array_join(parts, "\n"), 256).alias("tree_hash"))


@query("SELECT c_custkey, 'name=' || c_name || ',nation=' || c_nationkey::VARCHAR || ',segment=' || c_mktsegment AS aad FROM customer")
def canonical_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HSH7, CNT13."""
    m = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", C.canonical_context(m).alias("aad"))


@query("SELECT source, sum(strlen(text))::BIGINT AS original, sum(n_chars)::BIGINT AS compressed, CASE WHEN sum(strlen(text)) = 0 THEN 1.0 ELSE sum(n_chars) / sum(strlen(text)) END AS ratio FROM documents GROUP BY source")
def storage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG20, SRC12: sizes and their ratio, 1 for nothing."""
    a, b = F.sum(F.octet_length("text")), F.sum("n_chars")
    return table(spark, sf_dir, "documents").groupBy("source").agg(a.alias("original"), b.alias("compressed"), F.coalesce(F.try_divide(b, a), F.lit(1.0)).alias("ratio"))
