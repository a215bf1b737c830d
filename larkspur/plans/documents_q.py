"""Queries of JSON documents, scores, envelopes, handlers and branches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import documents as J
from larkspur.operators import handlers as H
from larkspur.session import table

from . import sql
from .catalog import query


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(F.struct(F.col("text").alias("body")).alias("a"), F.array("source", "lang").alias("tags"), F.col("n_chars"))).alias("doc"))


@query("WITH RECURSIVE " + sql.hits_cte() + " SELECT doc_id, 'a.body' AS path, st AS start, pii_type, val AS value FROM hit")
def pii_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DET9: hits in nested documents by path."""
    return J.detect_json(_json(spark, sf_dir), ["doc_id"], "doc").select("doc_id", "path", "start", "pii_type", "value")


@query("WITH RECURSIVE " + sql.hits_cte() + ", " + sql.spliced("'[REDACTED]'") + " SELECT d.doc_id, sha256(done.out) AS body_sha256, d.source || ',' || d.lang AS tags, d.n_chars FROM done JOIN documents d USING (doc_id)")
def anon_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANO19: structure, numbers and other strings stay."""
    out = J.anonymize_json(_json(spark, sf_dir), "doc_id", "doc", {}, "redact")
    parsed = F.from_json("doc", "a struct<body:string>, tags array<string>, n_chars long")
    return out.select("doc_id", parsed.alias("p")).select("doc_id", F.sha2("p.a.body", 256).alias("body_sha256"), F.array_join("p.tags", ",").alias("tags"), "p.n_chars")


@query("SELECT doc_id, 2 AS depth FROM documents")
def json_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR2."""
    return _json(spark, sf_dir).select("doc_id", J.json_depth(F.col("doc")).alias("depth"))


@query("SELECT c_custkey, c_name AS plain, c_name AS rotated FROM customer")
def envelope_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HSH8, HSH10: sealed, opened, and opened again after the master key changed."""
    old, new = F.lit("0123456789abcdef"), F.lit("fedcba9876543210")
    rows = table(spark, sf_dir, "customer").select("c_custkey", J.envelope_encrypt(F.col("c_name"), old, F.left(F.sha2(F.concat("c_name", F.lit("dek")), 256), F.lit(16))).alias("s"))
    return rows.select("c_custkey", J.envelope_decrypt(F.col("s"), old).alias("plain"), J.envelope_decrypt(J.rewrap(F.col("s"), old, new), new).alias("rotated"))


@query(
    r"""WITH p AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
 w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(b), '\s+'), lambda x: x <> '')) AS r, list_filter(regexp_split_to_array(lower(a), '\s+'), lambda x: x <> '') AS c FROM p WHERE b IS NOT NULL)
SELECT conv_id, turn, CASE WHEN trim(a) = trim(b) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact, coalesce(len(list_intersect(r, c)) / len(r), 0)::DOUBLE AS rouge1 FROM w"""
)
def evaluation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQL22: each turn against the next one."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "conversations").withColumn("b", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b IS NOT NULL")
    return rows.select("conv_id", "turn", J.exact_match(F.col("text"), F.col("b")).alias("exact"), J.rouge1(F.col("text"), F.col("b")).alias("rouge1"))


_HANDLERS = [("audit", "error", 5, True, True), ("mail", "error", 9, True, False), ("log", "click", 1, True, True), ("off", "error", 7, False, True)]


@query("WITH h(name, event_type, priority) AS (VALUES ('audit', 'error', 5), ('mail', 'error', 9), ('log', 'click', 1)) SELECT event_id, string_agg(name, '>' ORDER BY priority DESC) AS chain FROM events JOIN h USING (event_type) GROUP BY event_id")
def handler_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN6: enabled handlers of each event, the highest priority first."""
    handlers = spark.createDataFrame(_HANDLERS, "name string, event_type string, priority int, enabled boolean, carry_on boolean")
    return H.chains(table(spark, sf_dir, "events"), handlers, "event_id", "event_type")


@query("SELECT * FROM (VALUES ('main', 'blocked'), ('dev', 'moved'), ('none', 'missing')) t(name, outcome)")
def branch_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF20: a protected branch moves only by force."""
    branches = spark.createDataFrame([("main", "c1", True), ("dev", "c1", False)], "name string, target string, protected boolean")
    updates = spark.createDataFrame([("main", "c2", False), ("dev", "c2", False), ("none", "c2", True)], "name string, target string, force boolean")
    return H.move_branches(branches, updates).select("name", "outcome")


@query("SELECT field, CASE WHEN regexp_matches(field, '^user_.*$') THEN 'hash' WHEN regexp_matches(field, 'mail') THEN 'mask' ELSE 'none' END AS strategy FROM (VALUES ('user_name'), ('email'), ('total')) t(field)")
def field_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN11: the first rule whose name pattern fits a field."""
    fields = spark.createDataFrame([("user_name",), ("email",), ("total",)], "field string")
    return fields.select("field", H.field_strategy(F.col("field"), [("user_*", "hash"), ("mail", "mask")], "none").alias("strategy"))


@query("WITH p AS (SELECT page_id, string_split(split_part(url, '://', 2), '/') AS parts, strlen(html) AS n FROM pages) SELECT folder, count(*)::BIGINT AS entries, sum(n)::BIGINT AS bytes FROM (SELECT page_id, n, unnest(list_transform(range(1, len(parts)), lambda i: array_to_string(parts[1:i], '/'))) AS folder FROM p) GROUP BY folder")
def tree_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF19: the folders above all paths, their entries and bytes."""
    path = F.regexp_extract("url", "://([^\\n]*)", 1)
    return H.folders(table(spark, sf_dir, "pages").select(path.alias("path"), F.octet_length("html").alias("size")), "path", "size")
