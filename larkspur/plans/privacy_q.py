"""Queries of privacy measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import privacy as P
from larkspur.session import table

from .catalog import query


@query("SELECT c_nationkey, c_mktsegment, count(*)::BIGINT AS size FROM customer GROUP BY ALL")
def kanon_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG21."""
    return P.classes(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"])


@query("WITH c AS (SELECT count(*)::BIGINT AS n FROM customer GROUP BY c_nationkey, c_mktsegment) SELECT sum(n)::BIGINT AS rows, count(*)::BIGINT AS classes, sum(1.0::DOUBLE / n) / sum(n) AS prosecutor, count(*) FILTER (n = 1) / sum(n)::DOUBLE AS journalist, avg(1.0::DOUBLE / n) AS marketer, sum(n * n)::BIGINT AS discernibility, coalesce(sum(n) FILTER (n < 10), 0)::BIGINT AS rows_below_k FROM c")
def privacy_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG22-AGG24, AGG26."""
    return P.risks(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], 10)


@query(
    """WITH a AS (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n0, count(*) OVER (PARTITION BY c_nationkey // 5, c_mktsegment) AS n1, count(*) OVER (PARTITION BY c_nationkey // 5) AS n2 FROM customer)
SELECT c_custkey, CASE WHEN n0 >= 15 THEN 0 WHEN n1 >= 15 THEN 1 WHEN n2 >= 15 THEN 2 ELSE -1 END AS level, CASE WHEN n0 >= 15 THEN c_nationkey::VARCHAR WHEN n1 >= 15 OR n2 >= 15 THEN (c_nationkey // 5)::VARCHAR END AS c_nationkey, CASE WHEN n0 >= 15 OR n1 >= 15 THEN c_mktsegment WHEN n2 >= 15 THEN '*' END AS c_mktsegment FROM a"""
)
def kanon_generalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG25: 15 rows a class, by three levels."""
    n, s = F.col("c_nationkey"), F.col("c_mktsegment")
    wide = F.floor(n / 5).cast("int")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return P.k_anonymous(rows, [[n, s], [wide, s], [wide, F.lit("*")]], ["c_nationkey", "c_mktsegment"], 15)


@query("SELECT p_partkey, round(coalesce(-list_sum(list_transform(list_distinct(string_split(p_name, '')), lambda c: (len(list_filter(string_split(p_name, ''), lambda d: d = c)) / strlen(p_name)) * log2(len(list_filter(string_split(p_name, ''), lambda d: d = c)) / strlen(p_name)))), 0.0), 9) AS entropy FROM part")
def shannon_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG27 of part names."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(P.entropy(F.col("p_name")), 9).alias("entropy"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, 0.1::DOUBLE + (event_id % 5) / 10.0::DOUBLE AS eps, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
 f AS (SELECT user_id, event_id, r, eps * sqrt(2.0::DOUBLE * 1 * ln(100000.0::DOUBLE)) AS cost, true AS accepted, eps * sqrt(2.0::DOUBLE * 1 * ln(100000.0::DOUBLE)) AS spent, 1 AS k FROM e WHERE r = 1
 UNION ALL SELECT e.user_id, e.event_id, e.r, eps * sqrt(2.0::DOUBLE * (f.k + 1) * ln(100000.0::DOUBLE)), f.spent + eps * sqrt(2.0::DOUBLE * (f.k + 1) * ln(100000.0::DOUBLE)) <= 30,
 CASE WHEN f.spent + eps * sqrt(2.0::DOUBLE * (f.k + 1) * ln(100000.0::DOUBLE)) <= 30 THEN f.spent + eps * sqrt(2.0::DOUBLE * (f.k + 1) * ln(100000.0::DOUBLE)) ELSE f.spent END,
 f.k + (f.spent + eps * sqrt(2.0::DOUBLE * (f.k + 1) * ln(100000.0::DOUBLE)) <= 30)::INT FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
SELECT user_id, event_id, round(cost, 6) AS cost, accepted FROM f"""
)
def privacy_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG28: a budget of 30 for each user."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.lit(0.1) + (F.col("event_id") % 5) / 10.0).alias("eps"))
    return P.budget(rows, "user_id", "event_id", "eps", 30.0).withColumn("cost", F.round("cost", 6))
