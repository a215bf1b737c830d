"""Roles, attributes, policies and decisions over request tables (ACL1-ACL12, JN1-JN6)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.security import glob_regex

from .graph import closure, stored


def effective_permissions(user_roles: DataFrame, role_parents: DataFrame, role_permissions: DataFrame, permissions: DataFrame) -> DataFrame:
    """JN1, JN2, SET3: (user_id, permission_id, resource, action, pattern) over
    roles and all roles they inherit; ids that do not exist grant nothing."""
    edges = role_parents.select(F.col("role_id").alias("src"), F.col("parent_id").alias("dst"))
    roles = closure(edges, user_roles.select(F.col("role_id").alias("start")).distinct(), include_start=True).select(F.col("start").alias("role_id"), F.col("node").alias("held"))
    held = user_roles.join(roles, "role_id").select("user_id", F.col("held").alias("role_id")).distinct()
    return held.join(role_permissions, "role_id").join(permissions, "permission_id").select("user_id", "permission_id", "resource", "action", "pattern").distinct()


def check_permissions(requests: DataFrame, granted: DataFrame, key: str) -> DataFrame:
    """JN3, JN4: each request and whether a permission covers it: the wildcard
    ``*`` for resource or action, and a glob on the id; a null id passes any glob."""
    g = granted.select(F.col("user_id"), F.col("resource").alias("_r"), F.col("action").alias("_a"), F.col("pattern").alias("_p"))
    covers = F.col("_r").isin("*") | (F.col("_r") == F.col("resource"))
    covers = covers & (F.col("_a").isin("*") | (F.col("_a") == F.col("action")))
    covers = covers & (F.col("_p").isNull() | F.col("resource_id").isNull() | F.rlike(F.col("resource_id"), glob_regex(F.col("_p"), question=False, escape_dots=False)))
    ok = requests.join(g, "user_id").where(covers).select(key).distinct().withColumn("_ok", F.lit(True))
    return requests.join(ok, key, "left").withColumn("allowed", F.coalesce("_ok", F.lit(False))).drop("_ok")


def compare(value: Column, op: str, other: object) -> Column:
    """ACL1, DQL21: one comparison; a missing value is false, whatever the operator."""
    o = F.lit(other) if not isinstance(other, (list, tuple)) else None
    n, m = value.try_cast("long"), F.lit(other).try_cast("long") if o is not None else None
    table = {
        "eq": lambda: value == o.cast("string"),
        "ne": lambda: value != o.cast("string"),
        "lt": lambda: n < m,
        "le": lambda: n <= m,
        "gt": lambda: n > m,
        "ge": lambda: n >= m,
        "contains": lambda: F.contains(value, o),
        "starts_with": lambda: F.startswith(value, o),
        "ends_with": lambda: F.endswith(value, o),
        "matches": lambda: value.rlike(str(other)),
        "in": lambda: value.isin(*other) if isinstance(other, (list, tuple)) else F.lit(False),
        "not_in": lambda: ~value.isin(*other) if isinstance(other, (list, tuple)) else F.lit(True),
    }
    return F.coalesce(value.isNotNull() & table[op](), F.lit(False))


def rule(tree: Mapping[str, object], attributes: Column) -> Column:
    """ACL2, ACL3: {"all": [...]}, {"any": [...]}, {"none": [...]} or {"attr", "op",
    "value"} over a map of attributes; an empty list is true."""
    for name in ("all", "any", "none"):
        if name in tree:
            terms = [rule(t, attributes) for t in tree[name]]
            if not terms:
                return F.lit(True)
            out = terms[0]
            for t in terms[1:]:
                out = out & t if name == "all" else out | t
            return ~out if name == "none" else out
    return compare(attributes[tree["attr"]], str(tree["op"]), tree["value"])


def abac(policies: Sequence[Mapping[str, object]], attributes: Column, default: str = "deny") -> Column:
    """ACL4, ACL5: the effect of the first policy, by priority, whose rule holds."""
    out = F.lit(default)
    for p in sorted(policies, key=lambda p: p["priority"]):
        out = F.when(rule(p["rule"], attributes), p["effect"]).otherwise(out)
    return out


def statement(s: Mapping[str, object], subject: Column, action: Column, resource: Column, attributes: Column) -> Column:
    """ACL6, ACL7: whether a statement applies; an empty list means any."""
    out = F.lit(True)
    for name, c in (("subjects", subject), ("actions", action), ("resources", resource)):
        globs = s.get(name) or []
        if globs:
            hit = F.lit(False)
            for g in globs:
                hit = hit | c.rlike("^" + str(g).replace(".", "\\.").replace("*", ".*").replace("?", ".") + "$")
            out = out & hit
    for c in s.get("conditions") or []:
        out = out & compare(attributes[c["attr"]], str(c["op"]), c["value"])
    return F.coalesce(out, F.lit(False))


def iam(policies: Sequence[Sequence[Mapping[str, object]]], subject: Column, action: Column, resource: Column, attributes: Column) -> Column:
    """ACL8: ``deny`` if any policy's first matching statement denies, else
    ``allow`` if one allows, else ``none``."""
    effects = []
    for statements in policies:
        first = F.lit(None).cast("string")
        for s in reversed(statements):
            first = F.when(statement(s, subject, action, resource, attributes), s["effect"]).otherwise(first)
        effects.append(first)
    found = F.array(*effects)
    return F.when(F.array_contains(found, "deny"), "deny").when(F.array_contains(found, "allow"), "allow").otherwise("none")


def authorize(is_system: Column, anonymous: Column, public_read: Column, policy: Column, rbac: Column, abac_effect: Column) -> Column:
    """ACL9, ACL10: (decision, source) by the cascade system, anonymous, policy
    deny, roles, attributes, policy allow, deny. ``policy`` is three-valued, so
    that its default does not hide the steps below it."""

    def out(decision: str, source: str) -> Column:
        return F.struct(F.lit(decision).alias("decision"), F.lit(source).alias("source"))

    return (
        F.when(is_system, out("allow", "system"))
        .when(anonymous & public_read, out("allow", "anonymous"))
        .when(anonymous, out("deny", "anonymous"))
        .when(policy == "deny", out("deny", "policy"))
        .when(rbac, out("allow", "rbac"))
        .when(abac_effect == "allow", out("allow", "abac"))
        .when(policy == "allow", out("allow", "policy"))
        .otherwise(out("deny", "default"))
    )


def valid_keys(requests: DataFrame, keys: DataFrame, secret: str, now: Column) -> DataFrame:
    """ACL11, ACL12: requests whose key's hash is known, active and not expired."""
    hashed = requests.withColumn("_h", F.sha2(F.col(secret), 256))
    good = keys.where(F.col("active") & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    return hashed.join(good.select(F.col("key_hash").alias("_h")), "_h", "left_semi").drop("_h")


__all__ = ["abac", "authorize", "check_permissions", "compare", "effective_permissions", "iam", "rule", "statement", "stored", "valid_keys"]
