"""Queries of listings, governed reads and lifecycles."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import lifecycle as L
from larkspur.operators import records as R
from larkspur.session import spread, table

from . import sql
from .catalog import query

HITS = "WITH RECURSIVE " + sql.hits_cte()
_LABELS = "list_filter([CASE WHEN o_totalprice > 150000 THEN 'large' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' END], lambda x: x IS NOT NULL)"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array_compact(F.array(F.when(F.col("o_totalprice") > 150_000, "large"), F.when(F.startswith("o_orderpriority", F.lit("1")), "urgent")))
    gone = F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").withColumn("labels", labels).withColumn("version", (F.col("o_orderkey") % 3).cast("int")).withColumn("deleted_at", gone)


@query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND list_contains({_LABELS}, 'large') ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def record_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT2, SRT5: status, label, sort, limit and offset."""
    return L.list_rows(_orders(spark, sf_dir), "o_orderkey", equal={"o_orderstatus": "O", "o_custkey": None}, label="large", sort_by="o_totalprice", order="desc", limit=25, offset=10).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND (contains(lower(c_name), 'customer#0000000') OR contains(lower(c_mktsegment), 'customer#0000000')) ORDER BY c_name, c_custkey LIMIT 10")
def dataset_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT4: a value and a text in any case, in the usual order."""
    return L.list_rows(table(spark, sf_dir, "customer"), "c_custkey", equal={"c_mktsegment": "BUILDING"}, search="CUSTOMER#0000000", search_cols=["c_name", "c_mktsegment"], sort_by="c_name", limit=10).select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey % 2 = 0 AND o_orderkey % 3 = 1 AND o_orderstatus <> 'P' AND o_totalprice > 50000 ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 50")
def record_query_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQL3, DQL4: a version's rows that are not deleted, the second page by its usual size and order."""
    rows = L.record_query(_orders(spark, sf_dir), F.col("o_custkey") % 2 == 0, [F.col("o_totalprice") > 50_000], version=1)
    return L.page_of(rows, "o_orderdate", "o_orderkey", page=2).select("o_orderkey", "o_orderdate")


@query("SELECT count(*)::BIGINT AS kept, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS gone, count(*) FILTER (o_orderstatus <> 'P' AND o_orderkey % 10 = 3)::BIGINT AS newly FROM orders")
def batch_soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF2: rows stay, deleted ones keep their first time."""
    rows = _orders(spark, sf_dir)
    ids = rows.where("o_orderkey % 10 = 3").select("o_orderkey")
    now = datetime.datetime(2030, 1, 1)
    done = L.soft_delete(rows, ids, "o_orderkey", F.lit(now).cast(rows.schema["deleted_at"].dataType))
    return done.agg(F.count(F.lit(1)).alias("kept"), F.count_if((F.col("o_orderstatus") == "P") & (F.col("deleted_at") == F.col("o_orderdate"))).alias("gone"), F.count_if(F.col("deleted_at") == F.lit(now)).alias("newly"))


@query(HITS + ", " + sql.spliced(f"CASE WHEN pii_type = 'Email' THEN 'user' || left(sha256(val), 8) || '@example.com' WHEN pii_type IN ('Password', 'ApiKey') THEN '[REDACTED]' ELSE {sql.mask('val', 'pii_type')} END") + " SELECT doc_id, source, CASE WHEN source = 'src0' THEN text ELSE out END AS text FROM done JOIN documents USING (doc_id) WHERE source IN ('src0', 'src1') AND n_chars > 100")
def governed_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQL5: granted sources only, raw or anonymized by the grant."""
    grants = spark.createDataFrame([("ada", "src0", "raw"), ("ada", "src0", "safe"), ("ada", "src1", "safe"), ("bo", "src2", "raw")], "principal string, dataset string, level string")
    docs = spread(table(spark, sf_dir, "documents"))
    return L.governed_read(docs, grants, "ada", dataset_col="source", where=F.col("n_chars") > 100).select("doc_id", "source", "text")


@query("SELECT doc_id AS id, source AS dataset, text AS data, sha256(text) AS content_hash, 1 AS version, n_chars AS size FROM documents")
def record_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT25, CNT8."""
    fields = {"id": "doc_id", "dataset": "source", "data": "text", "content_hash": F.sha2("text", 256), "version": F.lit(1), "size": "n_chars"}
    return L.response(table(spark, sf_dir, "documents"), fields)


@query("SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 5000 OR o_orderkey = 7")
def record_where_clause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQL14."""
    return L.selected(table(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice * 2 AS twice"], "o_orderstatus = 'F' AND o_totalprice < 5000 OR o_orderkey = 7")


@query("SELECT (k // 100)::BIGINT AS batch, count(*)::BIGINT AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def record_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQL13: a reader's batches of 100 rows, a partition at a time at the reader."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").orderBy("o_orderkey").select("o_orderkey")
    seen = [(i, len(b), b[0][0], b[-1][0]) for i, b in enumerate(L.batches(rows, 100))]
    return spark.createDataFrame(seen, "batch long, n long, first long, last long")


_NODES = "nodes AS (SELECT event_id AS node, event_type AS node_type, [CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END, 'u' || (user_id % 7)] AS tags, ts AS created_at FROM events)"


@query(f"WITH {_NODES} SELECT node, node_type FROM nodes WHERE node_type IN ('purchase', 'signup') AND list_has_any(tags, ['u3', 'odd']) AND created_at >= TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '2024-01-20'")
def lineage_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT12, FLT19."""
    e = table(spark, sf_dir, "events")
    tags = F.array(F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"), F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")))
    nodes = e.select(F.col("event_id").alias("node"), F.col("event_type").alias("node_type"), tags.alias("tags"), F.col("ts").alias("created_at"))
    return L.node_query(nodes, ["purchase", "signup"], ["u3", "odd"], datetime.datetime(2024, 1, 5), datetime.datetime(2024, 1, 20)).select("node", "node_type")


_EDGES = "edges AS (SELECT n_nationkey AS source, n_regionkey AS target, CASE n_nationkey % 3 WHEN 0 THEN 'DerivedFrom' WHEN 1 THEN 'Contains' ELSE 'Unknown' END AS kind, CASE WHEN n_nationkey % 2 = 0 THEN 0.5::DOUBLE END AS weight FROM nation)"


@query(f"WITH {_EDGES} SELECT r_regionkey AS id, source, target, kind, coalesce(weight, 1.0::DOUBLE) AS weight FROM region JOIN edges ON (source = r_regionkey OR target = r_regionkey) AND kind <> 'Unknown'")
def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN12, GRF22: edges at either end."""
    k = F.col("n_nationkey")
    edges = table(spark, sf_dir, "nation").select(k.alias("source"), F.col("n_regionkey").alias("target"), F.when(k % 3 == 0, "DerivedFrom").when(k % 3 == 1, "Contains").otherwise("Unknown").alias("kind"), F.when(k % 2 == 0, 0.5).alias("weight"))
    return L.relationships_of(edges, table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id")))


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def retention_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT23, STM11: events younger than seven days at a time."""
    return L.kept_since(table(spark, sf_dir, "events"), "ts", datetime.datetime(2024, 1, 31), "7 DAYS").select("event_id")


@query("SELECT c_custkey, count(o_orderkey) >= 12 OR coalesce(sum(o_totalprice), 0) >= 2000000 AS over_quota FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def tenant_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT27: customers as tenants, orders as datasets, prices as bytes."""
    used = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("b"))
    rows = table(spark, sf_dir, "customer").join(used, F.col("c_custkey") == F.col("o_custkey"), "left")
    quota = {"datasets": F.lit(12), "bytes": F.lit(2_000_000)}
    return rows.select("c_custkey", L.over_quota({"datasets": F.col("n"), "bytes": F.col("b")}, quota).alias("over_quota"))


@query("SELECT * FROM (VALUES ('b', 10, 1), ('d', 10, 2), ('a', 5, 3), ('c', 1, 4)) t(name, priority, rank)")
def policy_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT9: ties keep their order."""
    rules = spark.createDataFrame([(0, "a", 5), (1, "b", 10), (2, "c", 1), (3, "d", 10)], "i int, name string, priority int")
    return L.by_priority(rules, "priority", "i").select("name", "priority", "rank")


@query("SELECT 'copy:' || doc_id AS doc_id, 'copy' AS source, sha256(text) AS content_hash FROM documents WHERE source = 'src1'")
def dataset_clone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF7."""
    return L.clone_dataset(table(spark, sf_dir, "documents"), "source", "src1", "copy", "doc_id").select("doc_id", "source", F.sha2("text", 256).alias("content_hash"))


@query(
    HITS
    + ", "
    + sql.spliced(f"CASE WHEN pii_type = 'Email' THEN 'user' || left(sha256(val), 8) || '@example.com' WHEN pii_type IN ('Password', 'ApiKey') THEN '[REDACTED]' ELSE {sql.mask('val', 'pii_type')} END")
    + " SELECT doc_id, any_value(out) AS text, count(*)::INT AS n_changes, list_sort(list_distinct(list(CASE pii_type WHEN 'Email' THEN 'substitute' WHEN 'Password' THEN 'redact' WHEN 'ApiKey' THEN 'redact' ELSE 'mask' END))) AS strategies_used FROM hit JOIN done USING (doc_id) GROUP BY doc_id"
)
def anonymized_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF10."""
    return L.anonymized_records(spread(table(spark, sf_dir, "documents")), "doc_id", "text")


@query("SELECT event_type, count(*)::BIGINT AS accesses, count(DISTINCT user_id)::BIGINT AS actors, TIMESTAMP '2024-01-03' AS period_start, TIMESTAMP '2024-01-17' AS period_end FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-17' GROUP BY event_type")
def compliance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF13: an access report."""
    measures = {"accesses": F.count(F.lit(1)), "actors": F.count_distinct("user_id")}
    return L.compliance_report(table(spark, sf_dir, "events"), "ts", datetime.datetime(2024, 1, 3), datetime.datetime(2024, 1, 17), ["event_type"], measures)


@query("""SELECT o_orderkey, due_at, late AS days_late, CASE WHEN closed IS NOT NULL THEN CASE WHEN late > 0 THEN 'completed_late' ELSE 'completed' END WHEN late > 0 THEN 'overdue' ELSE 'open' END AS status
 FROM (SELECT *, (o_orderdate::DATE + 30)::DATE AS due_at, greatest(date_diff('day', o_orderdate::DATE + 30, coalesce(closed, DATE '1998-08-01')), 0)::INT AS late FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE + (o_orderkey % 60)::INT END AS closed FROM orders))""")
def subject_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF14: orders as requests, due after thirty days."""
    closed = F.when(F.col("o_orderstatus") == "F", F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 60).cast("int")))
    state = L.request_state(F.col("o_orderdate"), closed, F.lit(datetime.date(1998, 8, 1)))
    return table(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(n) for n, c in state.items()])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN TIMESTAMP '2030-01-01' ELSE o_orderdate END AS modified_at FROM orders")
def metadata_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF19."""
    rows = table(spark, sf_dir, "orders").withColumn("modified_at", F.col("o_orderdate"))
    now = F.lit(datetime.datetime(2030, 1, 1)).cast(rows.schema["modified_at"].dataType)
    return L.update_metadata(rows, F.col("o_orderstatus") == "F", {"o_orderpriority": F.lit("done")}, now).select("o_orderkey", "o_orderpriority", "modified_at")


@query("SELECT doc_id, k AS key, CASE WHEN k = 'lang' AND doc_id % 2 = 0 THEN 'xx' WHEN k = 'lang' THEN coalesce(lang, '') WHEN k = 'source' THEN coalesce(source, '') ELSE 'yes' END AS value FROM documents, unnest(['lang', 'source', 'new']) t(k) WHERE k <> 'new' OR doc_id % 2 = 0")
def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET2: the new map's values where both have a key."""
    old = F.create_map(F.lit("lang"), F.coalesce("lang", F.lit("")), F.lit("source"), F.coalesce("source", F.lit("")))
    new = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("lang"), F.lit("xx"), F.lit("new"), F.lit("yes"))).otherwise(F.create_map().cast("map<string,string>"))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(R.upsert_maps(old, new)).alias("key", "value"))


@query("SELECT count(*)::BIGINT AS documents, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O')::BIGINT AS open_orders FROM documents")
def record_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG33."""
    docs = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("documents"), F.lit(0).alias("open_orders"))
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").agg(F.lit(0).alias("documents"), F.count(F.lit(1)).alias("open_orders"))
    return docs.unionByName(orders).agg(F.sum("documents").alias("documents"), F.sum("open_orders").alias("open_orders"))


@query("SELECT source AS version, count(*)::BIGINT AS records, sum(n_chars)::BIGINT AS bytes, count(DISTINCT sha256(text))::BIGINT AS contents FROM documents GROUP BY source")
def version_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG9: the counts of each version, sources as versions."""
    rows = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("version"))
    return rows.agg(F.count(F.lit(1)).alias("records"), F.sum("n_chars").alias("bytes"), F.count_distinct(F.sha2("text", 256)).alias("contents"))


@query("SELECT event_type AS buffer, count(*)::BIGINT AS pending, sum(strlen(props))::BIGINT AS bytes FROM events WHERE value > 50 GROUP BY event_type")
def buffer_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG35: what is pending in each buffer."""
    rows = table(spark, sf_dir, "events").where("value > 50").groupBy(F.col("event_type").alias("buffer"))
    return rows.agg(F.count(F.lit(1)).alias("pending"), F.sum(F.octet_length("props")).alias("bytes"))
