"""Queries of events, limits, sessions, deliveries and the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.security import redact_context
from larkspur.operators import events as E
from larkspur.operators import records as R
from larkspur.session import table

from .catalog import query

FAILED = "event_type = 'error'"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("SELECT event_type, count(*)::BIGINT AS published, count(*) FILTER (user_id % 10 = 0)::BIGINT AS dropped FROM events GROUP BY event_type")
def event_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG10, AGG11: events by type and those that no receiver takes."""
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("published"), F.count_if(F.col("user_id") % 10 == 0).alias("dropped"))


@query("SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100")
def event_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT10, FLT21: the newest 100 of each type."""
    return R.top_rows(_events(spark, sf_dir), ["event_type"], [F.desc("ts"), F.desc("event_id")], 100).select("event_id", "event_type")


_SUBS = "(VALUES (1, ['click', 'view'], NULL), (2, ['error'], 7), (3, NULL, 9), (4, NULL, NULL)) s(sub_id, types, sub_user)"


def _subs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, ["click", "view"], None), (2, ["error"], 7), (3, None, 9), (4, None, None)], "sub_id int, types array<string>, sub_user long")


@query(f"SELECT sub_id, count(*)::BIGINT AS n FROM events JOIN {_SUBS} ON (types IS NULL OR list_contains(types, event_type)) AND (sub_user IS NULL OR sub_user = user_id) WHERE NOT (types IS NULL AND event_type IN ('click', 'view', 'error')) GROUP BY sub_id")
def subscription_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN5, FLT11, FLT26: as coded."""
    return E.subscriptions(_events(spark, sf_dir), _subs(spark), "event_type", "user_id").groupBy("sub_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT sub_id, count(*)::BIGINT AS n FROM events JOIN {_SUBS} ON (types IS NULL OR list_contains(types, event_type)) AND (sub_user IS NULL OR sub_user = user_id) GROUP BY sub_id")
def subscription_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN5: every subscription that matches."""
    return E.subscriptions(_events(spark, sf_dir), _subs(spark), "event_type", "user_id", as_coded=False).groupBy("sub_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT event_type, le, count(*) FILTER (value <= le)::BIGINT AS n FROM events, (SELECT unnest([{', '.join(str(b) + '::DOUBLE' for b in E.LATENCY_BOUNDS)}, 'inf'::DOUBLE]) AS le) GROUP BY ALL")
def metrics_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG17."""
    return E.histogram(_events(spark, sf_dir), ["event_type"], "value")


@query("SELECT event_type, v[(n // 2) + 1] AS p50, v[least(n - 1, floor(n * 0.95)::BIGINT) + 1] AS p95, v[least(n - 1, floor(n * 0.99)::BIGINT) + 1] AS p99, n FROM (SELECT event_type, list_sort(list(value)) AS v, count(*)::BIGINT AS n FROM events GROUP BY event_type)")
def percentiles_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG18, AGG19, LIF16."""
    return E.nearest_percentiles(_events(spark, sf_dir), ["event_type"], "value")


@query("SELECT total, ok, client, server, ok / total AS success_rate, (client + server) / total AS error_rate FROM (SELECT count(*)::BIGINT AS total, count(*) FILTER (s BETWEEN 200 AND 299)::BIGINT AS ok, count(*) FILTER (s BETWEEN 400 AND 499)::BIGINT AS client, count(*) FILTER (s BETWEEN 500 AND 599)::BIGINT AS server FROM (SELECT (event_id % 6 + 1) * 100 AS s FROM events))")
def api_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG15, AGG16, AGG13."""
    return E.status_buckets(_events(spark, sf_dir).select(((F.col("event_id") % 6 + 1) * 100).alias("s")), "s")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 f AS (SELECT user_id, event_id, t, k, 1.0::DOUBLE AS tokens, true AS allowed FROM e WHERE k = 1
 UNION ALL SELECT e.user_id, e.event_id, e.t, e.k, least(2.0::DOUBLE, f.tokens + (e.t - f.t) / 1e6::DOUBLE * 0.0001::DOUBLE) - CASE WHEN least(2.0::DOUBLE, f.tokens + (e.t - f.t) / 1e6::DOUBLE * 0.0001::DOUBLE) >= 1 THEN 1 ELSE 0 END,
 least(2.0::DOUBLE, f.tokens + (e.t - f.t) / 1e6::DOUBLE * 0.0001::DOUBLE) >= 1 FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT user_id, event_id, allowed FROM f"""
)
def rate_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM5: two tokens at most, one in 10,000 seconds."""
    return E.token_bucket(_events(spark, sf_dir), "user_id", "ts", "event_id", 2.0, 0.0001)


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 f AS (SELECT user_id, event_id, k, [t] AS log, true AS allowed FROM e WHERE k = 1
 UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN len(list_filter(f.log, lambda x: x > e.t - 86400000000)) < 2 THEN list_append(list_filter(f.log, lambda x: x > e.t - 86400000000), e.t) ELSE list_filter(f.log, lambda x: x > e.t - 86400000000) END,
 len(list_filter(f.log, lambda x: x > e.t - 86400000000)) < 2 FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT user_id, event_id, allowed FROM f"""
)
def rate_sliding_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM7: two accepted events a day."""
    return E.sliding_log(_events(spark, sf_dir), "user_id", "ts", "event_id", 2, 86_400)


@query("SELECT event_type, date_trunc('hour', ts) AS bucket, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def rate_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM8."""
    return E.tumbling(_events(spark, sf_dir), ["event_type"], "ts", "1 hour")


@query("WITH f AS (SELECT *, epoch_us(ts) AS t FROM events WHERE event_type = 'error') SELECT user_id, event_id, failures FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 172800000000 PRECEDING AND CURRENT ROW)::BIGINT AS failures FROM f) WHERE failures >= 3")
def login_lockout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN12, STM9, STM10: three errors in two days."""
    return E.lockouts(_events(spark, sf_dir), "user_id", "ts", F.expr(FAILED), 3, 172_800).select("user_id", "event_id", "failures")


@query("WITH f AS (SELECT *, (event_type = 'error')::INT AS f, sum(1 - (event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id, island ORDER BY ts, event_id)::BIGINT AS streak FROM f) SELECT user_id, max(streak) AS longest, count(*) FILTER (streak >= 2)::BIGINT AS disabled FROM s GROUP BY user_id")
def consecutive_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN11."""
    rows = E.consecutive_failures(_events(spark, sf_dir), "user_id", ["ts", "event_id"], F.expr(FAILED), 2)
    return rows.groupBy("user_id").agg(F.max("streak").alias("longest"), F.count_if("disabled").alias("disabled"))


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, count(*)::BIGINT AS n, min(ts) AS started, max(ts) AS last_seen FROM s GROUP BY user_id, k")
def sessions_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM12, STM13: sessions that six idle hours end."""
    return E.sessions(_events(spark, sf_dir), "user_id", "ts", "6 hours")


@query("SELECT user_id, event_id, attempt, CASE WHEN event_type = 'purchase' THEN 'Delivered' WHEN attempt >= 5 THEN 'PermanentlyFailed' ELSE 'Failed' END AS state, CASE WHEN event_type <> 'purchase' AND attempt < 5 THEN least(300, floor(2 ** (attempt - 1)))::BIGINT END AS retry_in FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS attempt FROM events)")
def delivery_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM16, STM17, FLT22: a user's events as attempts; purchases succeed."""
    rows = _events(spark, sf_dir).withColumn("ok", F.col("event_type") == "purchase")
    return E.delivery_states(rows, "user_id", ["ts", "event_id"], "ok").select("user_id", "event_id", "attempt", "state", "retry_in")


@query("SELECT event_type, category FROM (VALUES ('DatasetCreated', 'dataset'), ('MergeCompleted', 'version'), ('KeyRotated', 'security'), ('PiiDetected', 'compliance'), ('Custom', 'custom'), ('Unknown', NULL)) t(event_type, category)")
def event_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM3."""
    names = [("DatasetCreated",), ("MergeCompleted",), ("KeyRotated",), ("PiiDetected",), ("Custom",), ("Unknown",)]
    return spark.createDataFrame(names, "event_type string").select("event_type", E.category(F.col("event_type")).alias("category"))


@query("SELECT event_id, user_id, ts FROM events WHERE event_type IN ('error', 'signup') AND user_id = 7 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' ORDER BY event_id LIMIT 10")
def audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT5-FLT10, FLT17: filters, an inclusive time range and the first in sequence."""
    found = _events(spark, sf_dir).where(E.matches({"event_type": ["error", "signup"], "user_id": 7, "props": None}))
    return found.where(F.col("ts").between(F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))).orderBy("event_id").limit(10).select("event_id", "user_id", "ts")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
 c AS (SELECT user_id, event_id, k, sha256(concat_ws('|', event_id::VARCHAR, event_type, '')) AS h FROM e WHERE k = 1
 UNION ALL SELECT e.user_id, e.event_id, e.k, sha256(concat_ws('|', e.event_id::VARCHAR, e.event_type, c.h)) FROM c JOIN e ON e.user_id = c.user_id AND e.k = c.k + 1)
SELECT user_id, event_id, h AS entry_hash FROM c"""
)
def audit_chain_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN8: one chain for each user."""
    rows = _events(spark, sf_dir)
    return E.build_chain(rows, "user_id", "event_id", ["event_type"]).select("user_id", "event_id", "entry_hash")


@query("SELECT user_id, min(event_id) FILTER (event_id % 97 = 0) AS first_bad, count(*)::BIGINT AS entries FROM events GROUP BY user_id")
def audit_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN9: every chain, with entries altered after they were hashed."""
    chain = E.build_chain(_events(spark, sf_dir), "user_id", "event_id", ["event_type"])
    altered = chain.withColumn("event_type", F.when(F.col("event_id") % 97 == 0, "forged").otherwise(F.col("event_type")))
    return E.verify_chain(altered, "user_id", "event_id", ["event_type"])


@query("SELECT event_id, '[REDACTED]' AS token, event_type AS kind FROM events")
def audit_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR18."""
    context = F.create_map(F.lit("Token"), F.col("props"), F.lit("kind"), F.col("event_type"))
    out = redact_context(context, ["token", "password", "secret"])
    return _events(spark, sf_dir).select("event_id", out["Token"].alias("token"), out["kind"].alias("kind"))


@query("SELECT user_id, count(*)::BIGINT AS requests, max(ts) AS last_used_at, arg_max(event_type, ts) AS last_type, round(sum(value), 2) AS total_value, count(DISTINCT event_type)::BIGINT AS kinds FROM events GROUP BY user_id")
def usage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG14, LIF12, LIF16."""
    return _events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("requests"), F.max("ts").alias("last_used_at"), F.max_by("event_type", "ts").alias("last_type"), F.round(F.sum("value"), 2).alias("total_value"), F.count_distinct("event_type").alias("kinds"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)")
def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG12, STM21."""
    return E.transitions(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, round(sum(value) OVER w, 2) / count(value) OVER w AS avg_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN13, AGG29: the mean up to each event of its user, of sums to the cent."""
    rows = E.running_mean(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "value")
    return rows.select("user_id", "event_id", (F.round("total", 2) / F.col("n")).alias("avg_value"))


@query("SELECT CASE WHEN user_id % 3 = 0 THEN 'ip:10.0.0.' || (user_id % 5) WHEN user_id % 3 = 1 THEN 'user:' || user_id ELSE 'global' END AS key, count(*)::BIGINT AS n FROM events GROUP BY 1")
def rate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM6."""
    u = F.col("user_id")
    key = E.limit_key(F.when(u % 3 == 1, u), F.when(u % 3 == 0, F.concat(F.lit("10.0.0."), (u % 5).cast("string"))))
    return _events(spark, sf_dir).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 20")
def queue_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF15, SRT11: the next 20 of a queue by priority and time."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(20).select("o_orderkey", "o_orderstatus", "o_orderpriority")


_SESSIONS = """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 s(user_id, i, session, began, ts) AS (SELECT user_id, i, 1, ts, ts FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, CASE WHEN e.ts - s.ts > INTERVAL 6 HOUR OR e.ts - s.began > INTERVAL 12 HOUR THEN session + 1 ELSE session END, CASE WHEN e.ts - s.ts > INTERVAL 6 HOUR OR e.ts - s.began > INTERVAL 12 HOUR THEN e.ts ELSE began END, e.ts FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1),
 o AS (SELECT user_id, session::BIGINT AS session, count(*)::BIGINT AS n, min(ts) AS started, max(ts) AS last_seen FROM s GROUP BY user_id, session)"""


@query(_SESSIONS + " SELECT user_id, session, n, started, last_seen FROM o")
def sessions_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM12: six idle hours or twelve in all end a session."""
    return E.session_ends(_events(spark, sf_dir), "user_id", "ts", "event_id", 6 * 3600, 12 * 3600)


@query(_SESSIONS + """, f AS (SELECT *, CASE WHEN TIMESTAMP '2024-01-31' - started > INTERVAL 10 DAY THEN 'expired' WHEN TIMESTAMP '2024-01-31' - last_seen > INTERVAL 8 DAY THEN 'idle' ELSE 'active' END AS st FROM o)
 SELECT user_id, session, CASE WHEN st = 'active' AND sum((st = 'active')::INT) OVER (PARTITION BY user_id ORDER BY started DESC, session DESC) > 2 THEN 'over_cap' ELSE st END AS state FROM f""")
def sessions_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM13: what becomes of each session at a time; two live ones a user."""
    rows = E.session_ends(_events(spark, sf_dir), "user_id", "ts", "event_id", 6 * 3600, 12 * 3600)
    now = F.lit("2024-01-31").cast("timestamp")
    return E.session_cleanup(rows, "user_id", now, 8 * 86_400, 10 * 86_400, 2).select("user_id", "session", "state")


@query("""WITH e AS (SELECT *, epoch_us(ts) AS t, event_type = 'error' AS f, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 l AS (SELECT *, CASE WHEN f AND count(*) FILTER (f) OVER (PARTITION BY user_id, k ORDER BY t RANGE BETWEEN 432000000000 PRECEDING AND CURRENT ROW) >= 2 THEN t + 172800000000 END AS u FROM e)
 SELECT event_id, f AND coalesce(t < max(u) OVER (PARTITION BY user_id, k ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS locked FROM l""")
def lock_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM10: two errors in five days lock for two days; anything else unlocks."""
    return E.lock_periods(_events(spark, sf_dir), "user_id", "ts", ["ts", "event_id"], F.expr(FAILED), 2, 432_000, 172_800).select("event_id", "locked")


@query("SELECT n_nationkey, true AS in_range, least(30000.0::DOUBLE, 100.0::DOUBLE * 2.0::DOUBLE ** n_nationkey) AS low FROM nation")
def infra_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM18: delays between the capped doubling and 30% more."""
    low = E.infra_backoff(F.col("n_nationkey"), 0.0)
    got = E.infra_backoff(F.col("n_nationkey"), 0.3, 7)
    return table(spark, sf_dir, "nation").select("n_nationkey", low.alias("low"), got.alias("got")).select("n_nationkey", F.col("got").between(F.col("low"), F.col("low") * 1.3).alias("in_range"), "low")
