"""Queries of access decisions: customers as users, orders as requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import access as X
from larkspur.session import table

from .catalog import query

_ROLES = [("AUTOMOBILE", "editor"), ("BUILDING", "reader"), ("FURNITURE", "admin"), ("MACHINERY", "auditor"), ("HOUSEHOLD", "ghost")]
_PARENTS = [("admin", "editor"), ("editor", "reader"), ("auditor", "reader"), ("reader", "auditor")]
_GRANTS = [("reader", "p_read"), ("editor", "p_write"), ("admin", "p_all"), ("auditor", "p_audit"), ("ghost", "p_missing")]
_PERMS = [("p_read", "dataset", "read", "1*"), ("p_write", "dataset", "write", None), ("p_all", "*", "*", None), ("p_audit", "audit", "read", None)]


def _rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in rows)


_SQL = f"""WITH RECURSIVE seg(seg, role_id) AS (VALUES {_rows(_ROLES)}), par(role_id, parent_id) AS (VALUES {_rows(_PARENTS)}), rp(role_id, permission_id) AS (VALUES {_rows(_GRANTS)}), perm(permission_id, resource, action, pattern) AS (VALUES {_rows(_PERMS)}),
 ur AS (SELECT c_custkey AS user_id, role_id FROM customer JOIN seg ON seg = c_mktsegment), held(user_id, role_id) AS (SELECT user_id, role_id FROM ur UNION SELECT user_id, parent_id FROM held JOIN par USING (role_id)),
 eff AS (SELECT DISTINCT user_id, permission_id, resource, action, pattern FROM held JOIN rp USING (role_id) JOIN perm USING (permission_id)),
 req AS (SELECT o_orderkey, o_custkey AS user_id, CASE WHEN o_orderkey % 3 = 0 THEN 'audit' ELSE 'dataset' END AS resource, CASE WHEN o_orderkey % 2 = 0 THEN 'read' ELSE 'write' END AS action, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey::VARCHAR END AS resource_id, o_orderstatus, o_totalprice FROM orders),
 rbac AS (SELECT req.*, EXISTS (SELECT 1 FROM eff e WHERE e.user_id = req.user_id AND e.resource IN ('*', req.resource) AND e.action IN ('*', req.action) AND (pattern IS NULL OR resource_id IS NULL OR regexp_full_match(resource_id, replace(pattern, '*', '.*')))) AS allowed FROM req)"""


def _granted(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = spark.createDataFrame(_ROLES, "c_mktsegment string, role_id string")
    users = table(spark, sf_dir, "customer").join(F.broadcast(seg), "c_mktsegment").select(F.col("c_custkey").alias("user_id"), "role_id")
    return X.effective_permissions(users, spark.createDataFrame(_PARENTS, "role_id string, parent_id string"), spark.createDataFrame(_GRANTS, "role_id string, permission_id string"), spark.createDataFrame(_PERMS, "permission_id string, resource string, action string, pattern string"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.when(k % 3 == 0, "audit").otherwise("dataset").alias("resource"), F.when(k % 2 == 0, "read").otherwise("write").alias("action"), F.when(k % 7 != 0, k.cast("string")).alias("resource_id"), "o_orderstatus", "o_totalprice")


_POLICIES = [
    {"priority": 10, "effect": "deny", "rule": {"attr": "status", "op": "eq", "value": "P"}},
    {"priority": 5, "effect": "allow", "rule": {"all": [{"attr": "price", "op": "lt", "value": 100000}, {"none": [{"attr": "action", "op": "in", "value": ["write"]}]}]}},
]
_IAM = [
    [{"effect": "deny", "actions": ["wr*"], "resources": ["audit"]}, {"effect": "allow", "actions": ["read"], "resources": []}],
    [{"effect": "deny", "subjects": ["?"], "conditions": [{"attr": "status", "op": "eq", "value": "P"}]}],
]
_ABAC_SQL = "CASE WHEN o_orderstatus = 'P' THEN 'deny' WHEN o_totalprice::BIGINT < 100000 AND action <> 'write' THEN 'allow' ELSE 'deny' END"
_IAM_SQL = "CASE WHEN (action LIKE 'wr%' AND resource = 'audit') OR (length(user_id::VARCHAR) = 1 AND o_orderstatus = 'P') THEN 'deny' WHEN action = 'read' THEN 'allow' ELSE 'none' END"


def _attributes() -> F.Column:
    return F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("price"), F.round("o_totalprice").cast("long").cast("string"), F.lit("action"), F.col("action"))


@query(_SQL + " SELECT * FROM eff")
def rbac_effective_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN1, JN2, SET3, JN15; the roles have a cycle."""
    return _granted(spark, sf_dir)


@query(_SQL + " SELECT o_orderkey, allowed FROM rbac")
def rbac_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN3, JN4, FLT28."""
    return X.check_permissions(_requests(spark, sf_dir), _granted(spark, sf_dir), "o_orderkey").select("o_orderkey", "allowed")


@query(_SQL + f" SELECT o_orderkey, {_ABAC_SQL} AS effect FROM req")
def abac_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ACL1-ACL5."""
    return _requests(spark, sf_dir).select("o_orderkey", X.abac(_POLICIES, _attributes()).alias("effect"))


@query(_SQL + f" SELECT o_orderkey, {_IAM_SQL} AS effect FROM req")
def iam_policy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ACL6-ACL8, STR15."""
    effect = X.iam(_IAM, F.col("user_id").cast("string"), F.col("action"), F.col("resource"), _attributes())
    return _requests(spark, sf_dir).select("o_orderkey", effect.alias("effect"))


@query(
    _SQL
    + f""", d AS (SELECT *, {_ABAC_SQL} AS ab, {_IAM_SQL} AS pol FROM rbac)
SELECT o_orderkey, CASE WHEN user_id = 1 THEN 'allow' WHEN user_id % 50 = 0 THEN (CASE WHEN action = 'read' AND o_orderstatus = 'F' THEN 'allow' ELSE 'deny' END) WHEN pol = 'deny' THEN 'deny' WHEN allowed OR ab = 'allow' OR pol = 'allow' THEN 'allow' ELSE 'deny' END AS decision,
 CASE WHEN user_id = 1 THEN 'system' WHEN user_id % 50 = 0 THEN 'anonymous' WHEN pol = 'deny' THEN 'policy' WHEN allowed THEN 'rbac' WHEN ab = 'allow' THEN 'abac' WHEN pol = 'allow' THEN 'policy' ELSE 'default' END AS source FROM d"""
)
def authorize_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ACL9, ACL10."""
    rows = X.check_permissions(_requests(spark, sf_dir), _granted(spark, sf_dir), "o_orderkey")
    policy = X.iam(_IAM, F.col("user_id").cast("string"), F.col("action"), F.col("resource"), _attributes())
    decision = X.authorize(F.col("user_id") == 1, F.col("user_id") % 50 == 0, (F.col("action") == "read") & (F.col("o_orderstatus") == "F"), policy, F.col("allowed"), X.abac(_POLICIES, _attributes()))
    return rows.select("o_orderkey", decision.alias("_d")).select("o_orderkey", "_d.decision", "_d.source")


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 3 = 0 AND o_custkey % 5 <> 0")
def api_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ACL11, ACL12: requests with a customer's name as their key."""
    c = F.col("c_custkey")
    keys = table(spark, sf_dir, "customer").where(c % 3 == 0).select(F.sha2(F.concat(F.lit("key"), c.cast("string")), 256).alias("key_hash"), (c % 5 != 0).alias("active"), F.lit(None).cast("timestamp").alias("expires_at"))
    requests = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("key"), F.col("o_custkey").cast("string")).alias("secret"))
    return X.valid_keys(requests, keys, "secret", F.lit("2024-01-01").cast("timestamp")).select("o_orderkey")
