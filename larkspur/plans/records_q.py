"""Queries of records, datasets and their lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import records as R
from larkspur.session import table

from .catalog import query


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE (o_orderstatus IN ('O', 'F') AND o_totalprice >= 100000) OR NOT (o_orderpriority LIKE '%URGENT%' OR o_custkey > 100)")
def filter_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQL1, DQL2, FLT1: a filter tree and a field list."""
    tree = {"or": [{"and": [{"field": "o_orderstatus", "op": "in", "value": ["O", "F"]}, {"field": "o_totalprice", "op": "gte", "value": 100000}]}, {"not": {"or": [{"field": "o_orderpriority", "op": "contains", "value": "URGENT"}, {"field": "o_custkey", "op": "gt", "value": 100}]}}]}
    return R.select_fields(table(spark, sf_dir, "orders").where(R.condition(tree)), "o_orderkey, o_totalprice, o_orderstatus, secret", ["o_orderkey", "o_totalprice", "o_orderstatus"])


@query("SELECT doc_id, source FROM documents WHERE starts_with(text, 'The') AND NOT (lang IN ('de', 'fr')) AND source IS NOT NULL")
def filter_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQL2: flat operators."""
    tree = {"and": [{"field": "text", "op": "starts_with", "value": "The"}, {"field": "lang", "op": "not_in", "value": ["de", "fr"]}, {"field": "source", "op": "is_not_null"}]}
    return table(spark, sf_dir, "documents").where(R.condition(tree)).select("doc_id", "source")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def record_list_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT1, SRT2: the third page of 50."""
    return R.page(table(spark, sf_dir, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, 50).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 26")
def record_list_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT4: the keyset page after 1000."""
    return R.page_after(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1000, 25)


@query("SELECT count(*)::BIGINT AS total, ceil(count(*) / 20.0)::BIGINT AS total_pages, true AS has_prev, 3 < ceil(count(*) / 20.0) AS has_next FROM orders")
def page_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT3."""
    return R.page_info(table(spark, sf_dir, "orders"), 3, 20)


@query(
    """SELECT 'c_acctbal' AS field, count(c_acctbal)::BIGINT AS non_null, count(*) FILTER (c_acctbal IS NULL)::BIGINT AS nulls, count(DISTINCT c_acctbal)::BIGINT AS uniq, avg(c_acctbal) AS avg FROM customer
UNION ALL SELECT 'c_mktsegment', count(c_mktsegment), count(*) FILTER (c_mktsegment IS NULL), count(DISTINCT c_mktsegment), NULL FROM customer"""
)
def field_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQL7, AGG4."""
    return R.field_statistics(table(spark, sf_dir, "customer"), ["c_acctbal", "c_mktsegment"]).drop("min", "max")


@query(
    """SELECT total, completeness, validity, uniqueness, (completeness + validity + uniqueness) / 3 AS overall FROM (
 SELECT count(*)::BIGINT AS total, (count(doc_id) + count(text) + count(lang)) / (count(*) * 3) AS completeness, count(*) FILTER (n_chars >= 100) / count(*) AS validity, count(DISTINCT text) / count(*) AS uniqueness FROM documents)"""
)
def quality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQL8, DQL9."""
    return R.quality_profile(table(spark, sf_dir, "documents"), ["doc_id", "text", "lang"], F.col("n_chars") >= 100, ["text"])


@query("SELECT source, count(*)::BIGINT AS record_count, sum(strlen(text))::BIGINT AS size_bytes, avg(strlen(text)) AS avg_bytes, count(*) FILTER (text LIKE '%@%')::BIGINT AS marked FROM documents GROUP BY source")
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG3, AGG5, DQL6: the maintained statistics of each dataset."""
    size = F.octet_length("text")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("record_count"), F.sum(size).alias("size_bytes"), F.avg(size).alias("avg_bytes"), F.count_if(F.contains("text", F.lit("@"))).alias("marked"))


@query("SELECT doc_id FROM documents ORDER BY sha256('s' || doc_id), doc_id LIMIT 100")
def sample_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQL10."""
    return R.sample_reservoir(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100)


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('s' || doc_id), doc_id) <= 20")
def sample_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQL10."""
    return R.sample_stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", 20)


@query("SELECT o_orderkey FROM orders QUALIFY (row_number() OVER (ORDER BY o_orderkey) - 1) % 50 = 0")
def sample_systematic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQL10: every 50th order."""
    return R.sample_systematic(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 50)


@query("SELECT event_id FROM events WHERE ('0x' || left(sha256('s' || event_id), 8))::BIGINT % 100 < 5")
def sample_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQL10: about a twentieth of the events."""
    return R.sample_ratio(table(spark, sf_dir, "events").select("event_id"), "event_id", 5)


@query("SELECT conv_id, sha256(string_agg(sha256(text), '' ORDER BY turn, sha256(text))) AS checksum FROM conversations GROUP BY conv_id")
def batch_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQL15."""
    return R.batch_checksum(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.sha2("text", 256))


@query(
    """WITH c AS (SELECT c_custkey, c_mktsegment::VARCHAR AS a, CASE WHEN c_custkey % 7 = 0 THEN 'MOVED' ELSE c_mktsegment END AS b, c_nationkey::VARCHAR AS n, (CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey END)::VARCHAR AS m FROM customer)
SELECT c_custkey, 'c_mktsegment' AS field, a AS "old", b AS "new" FROM c WHERE a IS DISTINCT FROM b UNION ALL SELECT c_custkey, 'c_nationkey', n, m FROM c WHERE n IS DISTINCT FROM m"""
)
def change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQL17."""
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    k = F.col("c_custkey")
    new = old.withColumn("c_mktsegment", F.when(k % 7 == 0, "MOVED").otherwise(F.col("c_mktsegment"))).withColumn("c_nationkey", F.when(k % 11 != 0, F.col("c_nationkey")))
    return R.changes(old, new, "c_custkey", ["c_mktsegment", "c_nationkey"])


@query("SELECT doc_id, CASE WHEN text LIKE '%@%' THEN 'restricted' WHEN n_chars > 5000 THEN 'internal' ELSE 'public' END AS class, CASE WHEN text LIKE '%@%' THEN 4 WHEN n_chars > 5000 THEN 2 ELSE 1 END AS sensitivity FROM documents")
def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQL20: the most sensitive class whose rule holds."""
    rules = F.array(
        F.when(F.contains("text", F.lit("@")), F.struct(F.lit(4).alias("sensitivity"), F.lit("restricted").alias("class"))),
        F.when(F.col("n_chars") > 5000, F.struct(F.lit(2).alias("sensitivity"), F.lit("internal").alias("class"))),
        F.struct(F.lit(1).alias("sensitivity"), F.lit("public").alias("class")),
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.array_max(F.array_compact(rules)).alias("_c")).select("doc_id", "_c.class", "_c.sensitivity")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS version, sha256(text) AS content_hash FROM conversations")
def record_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN5, WIN6, CNT7."""
    return R.versions(table(spark, sf_dir, "conversations"), "conv_id", ["turn"]).select("conv_id", "turn", "version", F.sha2("text", 256).alias("content_hash"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations WHERE turn <= 3 GROUP BY conv_id")
def record_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN7: conversations as of turn 3."""
    return R.as_of(table(spark, sf_dir, "conversations"), "conv_id", "turn", 3, ["role"])


@query("WITH cur AS (SELECT conv_id, max(turn) AS v FROM conversations GROUP BY conv_id) SELECT o_orderkey AS conv_id, 3::BIGINT AS expected_version, CASE WHEN v IS NULL THEN 'missing' WHEN v = 3 THEN 'ok' ELSE 'conflict' END AS outcome FROM orders LEFT JOIN cur ON conv_id = o_orderkey")
def optimistic_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF3: updates that expect version 3 of each conversation."""
    current = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("version"))
    updates = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("conv_id"), F.lit(3).cast("long").alias("expected_version"))
    return R.optimistic_update(current, updates, "conv_id")


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, date_trunc('day', ts) ORDER BY ts, event_id) = 1")
def idempotent_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF4: the first event of each user, type and day."""
    rows = table(spark, sf_dir, "events").withColumn("_d", F.date_trunc("day", "ts"))
    return R.idempotent_insert(rows, ["user_id", "event_type", "_d"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query(
    """SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1999-01-01')::INT AS age, CASE WHEN date_diff('day', o_orderdate::DATE, DATE '1999-01-01') > (CASE o_orderstatus WHEN 'O' THEN 24 * 30 WHEN 'F' THEN 4 * 365 END)
 THEN (CASE o_orderstatus WHEN 'O' THEN 'archive' WHEN 'F' THEN 'delete' ELSE 'notify' END) ELSE 'keep' END AS action FROM orders"""
)
def retention_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF11, DQL18, DQL19, GRF23: O after 24 months, F after 4 years, P never."""
    s = F.col("o_orderstatus")
    days = R.retention_days(F.when(s == "O", 24).when(s == "F", 4), F.when(s == "O", "month").when(s == "F", "year").otherwise("indefinite"))
    age = F.datediff(F.lit("1999-01-01").cast("date"), F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", age.alias("age"), R.retention_action(age, days, F.when(s == "O", "archive").when(s == "F", "delete").otherwise("notify")).alias("action"))


@query("SELECT count(*)::BIGINT AS added, count(*) FILTER (length(text) < 20)::BIGINT AS rejected, count(*) BETWEEN 1 AND 1000 AS within_limits FROM documents")
def batch_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF1, SCH6: rows, rejections, and whether the batch is of allowed size."""
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("added"), F.count_if(F.length("text") < 20).alias("rejected"), R.batch_limits(F.count(F.lit(1))).alias("within_limits"))


@query("SELECT l.doc_id, l.quality FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id AND d.doc_id % 10 <> 3 WHERE d.doc_id IS NULL")
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN14: labels of documents that a filtered table lacks."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").where("doc_id % 10 <> 3").select("doc_id"), "doc_id", "left_anti").select("doc_id", "quality")


@query("SELECT text_hash, n FROM (SELECT sha256(text) AS text_hash, count(*)::BIGINT AS n FROM documents GROUP BY 1) WHERE n > 1")
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCH4: values of a unique field that occur more than once."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT tag, value, list_sort(list(doc_id)) AS keys FROM (SELECT doc_id, 'lang' AS tag, lang AS value FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents) GROUP BY tag, value")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT13-FLT16."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("tags"))
    return R.inverted_index(docs, "doc_id", "tags")


@query("SELECT dataset, split, count(*)::BIGINT AS n FROM (SELECT *, CASE WHEN h < 10 THEN 'test' WHEN h < 20 THEN 'validation' ELSE 'training' END AS split FROM (SELECT dataset, ('0x' || left(sha256(dataset || id), 8))::BIGINT % 100 AS h FROM (SELECT 'documents' AS dataset, doc_id AS id FROM documents UNION ALL SELECT 'pages', page_id FROM pages))) GROUP BY ALL")
def corpus_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQL11."""
    parts = {"documents": table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), "pages": table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"))}
    return R.assemble(parts, "id").groupBy("dataset", "split").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, list_sum([(len(string_split(lower(text), w)) - 1) for w in ['the', 'thing']])::INT AS score FROM documents WHERE lower(text) LIKE '%thing%' ORDER BY score DESC, doc_id LIMIT 25")
def dataset_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQL12, FLT3: texts that hold a word, by the number of occurrences of the query's words."""
    low = F.lower("text")
    score = F.regexp_count(low, F.lit("the")) + F.regexp_count(low, F.lit("thing"))
    return table(spark, sf_dir, "documents").where(F.contains(low, F.lit("thing"))).select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(25)


@query("SELECT d.doc_id, quality, toxic, lang FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1")
def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQL23: labels as annotations of documents."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id").select("doc_id", "quality", "toxic", "lang")


@query("SELECT CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 'drop' ELSE 'keep' END AS fate, strftime(o_orderdate, '%Y-%m') AS part, count(*)::BIGINT AS n FROM orders GROUP BY ALL")
def partition_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQL24, DQL28: monthly partitions and what a cutoff does with them."""
    return table(spark, sf_dir, "orders").groupBy(F.when(F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp"), "drop").otherwise("keep").alias("fate"), F.date_format("o_orderdate", "yyyy-MM").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH s AS (SELECT doc_id, CASE WHEN text LIKE '%@%' THEN 'quarantined' ELSE 'active' END AS status FROM documents) SELECT status, count(*)::BIGINT AS n FROM s GROUP BY status")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF5, LIF6, ANO34: records with a mark are quarantined."""
    rows = R.set_status(table(spark, sf_dir, "documents").withColumn("status", F.lit("active")), F.contains("text", F.lit("@")), "quarantined", "personal data")
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
