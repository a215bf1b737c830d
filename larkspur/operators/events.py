"""Events, deliveries, limits and sessions in batch form (AGG10-AGG19, SRT10,
JN5, JN6, WIN11, WIN12, STM1-STM18)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a side that is joined by broadcast at most; larger sides are shuffled.
BROADCAST_ROWS = 200_000

# Event types by category, and the latency bounds in seconds.
CATEGORIES: dict[str, tuple[str, ...]] = {
    "dataset": ("DatasetCreated", "DatasetUpdated", "DatasetDeleted", "DatasetArchived", "DatasetRestored"),
    "record": ("RecordCreated", "RecordUpdated", "RecordDeleted", "RecordAccessed"),
    "version": ("CommitCreated", "BranchCreated", "BranchDeleted", "TagCreated", "MergeCompleted"),
    "access": ("AccessGranted", "AccessRevoked", "RoleAssigned", "RoleRemoved", "PermissionDenied"),
    "security": ("EncryptionCompleted", "DecryptionCompleted", "KeyRotated", "AnomalyDetected"),
    "compliance": ("PiiDetected", "AnonymizationApplied", "DataExportRequested", "DataDeletionRequested"),
    "system": ("SystemStarted", "SystemStopped", "HealthCheckFailed", "MaintenanceStarted"),
    "webhook": ("WebhookCreated", "WebhookUpdated", "WebhookDeleted", "WebhookDeliveryFailed"),
    "custom": ("Custom",),
}
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)


def category(event_type: Column) -> Column:
    """STM3: the category of an event type; null for unknown ones."""
    return F.coalesce(*[F.when(event_type.isin(*types), c) for c, types in CATEGORIES.items()])


def matches(filters: Mapping[str, Sequence[object] | object | None]) -> Column:
    """FLT5, FLT6, FLT11: AND of equalities and IN lists; None passes all."""
    out = F.lit(True)
    for name, v in filters.items():
        if v is None:
            continue
        out = out & (F.col(name).isin(*v) if isinstance(v, (list, tuple)) else F.col(name) == F.lit(v))
    return out


def subscriptions(events: DataFrame, subs: DataFrame, event_type: str, user: str, as_coded: bool = True) -> DataFrame:
    """JN5: (event, subscription) pairs. A null list or user passes all. As coded,
    subscriptions without types are not seen for a type that any other names.
    More than ``BROADCAST_ROWS`` subscriptions are joined by their types and users."""
    hit = (F.col("types").isNull() | F.array_contains("types", F.col(event_type))) & (F.col("sub_user").isNull() | (F.col("sub_user") == F.col(user)))
    few = subs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if few:
        pairs = events.join(F.broadcast(subs), hit)
    else:
        typed = subs.where("types is not null").withColumn("_s", F.explode(F.array_distinct("types")))
        free = subs.where("types is null")
        of_type, of_user = F.col("_s") == F.col(event_type), F.col("sub_user") == F.col(user)
        pairs = events.join(typed.where("sub_user is not null"), of_type & of_user).drop("_s")
        pairs = pairs.unionByName(events.join(typed.where("sub_user is null"), of_type).drop("_s"))
        pairs = pairs.unionByName(events.join(free.where("sub_user is not null"), of_user))
        pairs = pairs.unionByName(events.crossJoin(free.where("sub_user is null")))
    if as_coded:
        named = subs.where("types is not null").select(F.explode("types").alias("_t")).distinct()
        pairs = pairs.join(F.broadcast(named) if few else named, F.col(event_type) == F.col("_t"), "left").where(F.col("_t").isNull() | F.col("types").isNotNull()).drop("_t")
    return pairs


def histogram(df: DataFrame, keys: Sequence[str], value: str, bounds: Sequence[float] = LATENCY_BOUNDS) -> DataFrame:
    """AGG17: cumulative counts at or below each bound, and of all, in one pass."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    one = df.groupBy(*keys).agg(*counts, F.count(F.lit(1)).alias("total"))
    cells = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("n")))
    return one.select(*keys, F.inline(cells))


def nearest_percentiles(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """AGG18: the values at places n/2, 0.95 n and 0.99 n (clipped) of each group
    in order. Places are found by counts of distinct values, so no task holds a
    group's values."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy(value)
    rows = counts.withColumn("_to", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    place = lambda q: F.least(F.col("_all") - 1, F.floor(F.col("_all") * q))
    at = lambda q, name: F.min(F.when(F.col("_to") > place(q), F.col(value))).alias(name)
    return rows.groupBy(*keys).agg(at(0.5, "p50"), at(0.95, "p95"), at(0.99, "p99"), F.max("_all").alias("n"))


def status_buckets(df: DataFrame, status: str) -> DataFrame:
    """AGG15, AGG16: 2xx, 4xx, 5xx and all; the rates are 1 and 0 for nothing."""
    s = F.col(status)
    one = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(s.between(200, 299)).alias("ok"), F.count_if(s.between(400, 499)).alias("client"), F.count_if(s.between(500, 599)).alias("server"))
    return one.withColumn("success_rate", F.coalesce(F.try_divide("ok", "total"), F.lit(1.0))).withColumn("error_rate", F.coalesce(F.try_divide(F.col("client") + F.col("server"), "total"), F.lit(0.0)))


def retry_delay(attempt: Column, base: float = 1.0, factor: float = 2.0, most: float = 300.0) -> Column:
    """STM16: seconds before the next attempt, whole and capped."""
    return F.least(F.lit(most), F.floor(F.lit(base) * F.pow(F.lit(factor), attempt - 1))).cast("long")


def infra_backoff(attempt: Column, jitter: float = 0.3, seed: int | None = None) -> Column:
    """STM18: milliseconds, 100 doubled up to 30,000, and up to ``jitter`` more."""
    return F.least(F.lit(30_000.0), F.lit(100.0) * F.pow(F.lit(2.0), attempt)) * (1 + F.rand(seed) * jitter)


def delivery_states(attempts: DataFrame, key: str, order: Sequence[str], success: str, most: int = 5) -> DataFrame:
    """STM17, FLT22: each attempt's number and the state after it."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = attempts.withColumn("attempt", F.row_number().over(w))
    state = F.when(F.col(success), "Delivered").when(F.col("attempt") >= most, "PermanentlyFailed").otherwise("Failed")
    return rows.withColumn("state", state).withColumn("retry_in", F.when(F.col("state") == "Failed", retry_delay(F.col("attempt"))))


def consecutive_failures(df: DataFrame, key: str, order: Sequence[str], failed: Column, threshold: int) -> DataFrame:
    """WIN11: failures in a row up to each event, which a success ends, and
    whether the key is disabled then."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumn("_f", failed.cast("int")).withColumn("_island", F.sum(1 - F.col("_f")).over(w))
    run = F.sum("_f").over(Window.partitionBy(key, "_island").orderBy(*order))
    return rows.withColumn("streak", run).withColumn("disabled", F.col("streak") >= threshold).drop("_f", "_island")


def lockouts(df: DataFrame, key: str, ts: str, failed: Column, limit: int = 5, window_s: int = 900) -> DataFrame:
    """WIN12, STM9: failures with ``limit`` or more failures in the window up to them."""
    rows = df.where(failed).withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    w = Window.partitionBy(key).orderBy("_t").rangeBetween(-window_s * 1_000_000, 0)
    return rows.withColumn("failures", F.count(F.lit(1)).over(w)).where(F.col("failures") >= limit).drop("_t")


def sessions(df: DataFrame, key: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """STM12: sessions that end after an idle gap."""
    return df.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("started"), F.max(ts).alias("last_seen")).drop("w")


def token_bucket(df: DataFrame, key: str, ts: str, event_id: str, capacity: float, per_second: float) -> DataFrame:
    """STM5: whether each event finds a token. A key's events are folded in
    order over (tokens, time), within the JVM; a bucket starts full."""
    item = F.struct(F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(event_id).alias("id"))
    zero = F.struct(F.lit(float(capacity)).alias("tokens"), F.lit(None).cast("long").alias("t"), F.array().cast(f"array<struct<id:{df.schema[event_id].dataType.simpleString()},allowed:boolean>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        passed = F.coalesce(x["t"] - acc["t"], F.lit(0)) / 1e6
        filled = F.least(F.lit(float(capacity)), acc["tokens"] + passed * per_second)
        ok = filled >= 1.0
        return F.struct((filled - ok.cast("double")).alias("tokens"), x["t"].alias("t"), F.array_append(acc["out"], F.struct(x["id"].alias("id"), ok.alias("allowed"))).alias("out"))

    grouped = df.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("_e"))
    return grouped.select(key, F.inline(F.aggregate("_e", zero, step, lambda acc: acc["out"]))).withColumnRenamed("id", event_id)


def sliding_log(df: DataFrame, key: str, ts: str, event_id: str, limit: int, window_s: int) -> DataFrame:
    """STM7: whether each event finds fewer than ``limit`` accepted ones in the
    window before it; refused events do not count."""
    item = F.struct(F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(event_id).alias("id"))
    zero = F.struct(F.array().cast("array<bigint>").alias("log"), F.array().cast(f"array<struct<id:{df.schema[event_id].dataType.simpleString()},allowed:boolean>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        live = F.filter(acc["log"], lambda t: t > x["t"] - window_s * 1_000_000)
        ok = F.size(live) < limit
        return F.struct(F.when(ok, F.array_append(live, x["t"])).otherwise(live).alias("log"), F.array_append(acc["out"], F.struct(x["id"].alias("id"), ok.alias("allowed"))).alias("out"))

    grouped = df.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("_e"))
    return grouped.select(key, F.inline(F.aggregate("_e", zero, step, lambda acc: acc["out"]))).withColumnRenamed("id", event_id)


def tumbling(df: DataFrame, keys: Sequence[str], ts: str, width: str = "1 minute") -> DataFrame:
    """STM8: events of each key in each window."""
    return df.groupBy(*keys, F.window(ts, width)["start"].alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def limit_key(user: Column, ip: Column) -> Column:
    """STM6."""
    return F.coalesce(F.concat(F.lit("user:"), user.cast("string")), F.concat(F.lit("ip:"), ip), F.lit("global"))


def transitions(df: DataFrame, key: str, order: Sequence[str], status: str) -> DataFrame:
    """AGG12, STM21: rows whose status differs from the key's row before."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_p", F.lag(status).over(w)).where(F.col("_p").isNull() | (F.col("_p") != F.col(status))).drop("_p")


def chain_hash(previous: Column, *fields: Column) -> Column:
    """WIN8: the hash of an entry's fields in order and of the hash before it."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields], F.coalesce(previous, F.lit(""))), 256)


def build_chain(df: DataFrame, chain: str, sequence: str, fields: Sequence[str]) -> DataFrame:
    """WIN8: previous_hash and entry_hash of each chain's entries in sequence, by
    a fold over a chain; chains are built in parallel."""
    kinds = ",".join(f"`{c}`:{df.schema[c].dataType.simpleString()}" for c in [sequence, *fields])
    zero = F.struct(F.lit(None).cast("string").alias("h"), F.array().cast(f"array<struct<{kinds},previous_hash:string,entry_hash:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        h = chain_hash(acc["h"], x[sequence], *[x[f] for f in fields])
        entry = F.struct(x[sequence].alias(sequence), *[x[f].alias(f) for f in fields], acc["h"].alias("previous_hash"), h.alias("entry_hash"))
        return F.struct(h.alias("h"), F.array_append(acc["out"], entry).alias("out"))

    rows = df.groupBy(chain).agg(F.sort_array(F.collect_list(F.struct(sequence, *fields))).alias("_e"))
    return rows.select(chain, F.inline(F.aggregate("_e", zero, step, lambda acc: acc["out"])))


def verify_chain(df: DataFrame, chain: str, sequence: str, fields: Sequence[str], anchor: str | None = None) -> DataFrame:
    """WIN9: (chain, first bad sequence or null). Each entry only needs the one
    before it, so a chain is verified by ``lag``; ``anchor`` is the hash before
    the first retained entry."""
    w = Window.partitionBy(chain).orderBy(sequence)
    before = F.lag("entry_hash", 1, anchor).over(w)
    good = before.eqNullSafe(F.col("previous_hash")) & (F.col("entry_hash") == chain_hash(F.col("previous_hash"), F.col(sequence), *[F.col(f) for f in fields]))
    return df.withColumn("_g", good).groupBy(chain).agg(F.min(F.when(~F.col("_g"), F.col(sequence))).alias("first_bad"), F.count(F.lit(1)).alias("entries"))


def session_ends(df: DataFrame, key: str, ts: str, event_id: str, idle_s: int, most_s: int) -> DataFrame:
    """STM12: (key, session, n, started, last_seen) of sessions that an idle gap or
    their whole length ends. Within the runs that idle gaps part, a walk opens
    a new session once ``most_s`` have passed since the last one's start; its
    state is one time."""
    w = Window.partitionBy(key).orderBy(ts, event_id)
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.select(key, ts, event_id, t.alias("_t"))
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_t") - F.lag("_t").over(w) <= idle_s * 1_000_000, 0).otherwise(1)).over(w))
    # only runs longer than a session are walked; their distinct session starts come back
    span = rows.groupBy(key, "_run").agg(F.min("_t").alias("_a"), F.max("_t").alias("_b"))
    long_runs = span.where(F.col("_b") - F.col("_a") > most_s * 1_000_000)
    times = rows.join(long_runs.select(key, "_run"), [key, "_run"], "left_semi").groupBy(key, "_run").agg(F.sort_array(F.collect_set("_t")).alias("_ts"))
    zero = F.struct(F.lit(None).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = acc["at"].isNull() | (x - acc["at"] > most_s * 1_000_000)
        return F.when(fresh, F.struct(x.alias("at"), F.array_append(acc["out"], x).alias("out"))).otherwise(acc)

    starts = times.select(key, "_run", F.explode(F.aggregate("_ts", zero, step, lambda acc: acc["out"])).alias("_t"))
    starts = starts.unionByName(span.where(F.col("_b") - F.col("_a") <= most_s * 1_000_000).select(key, "_run", F.col("_a").alias("_t"))).withColumn("_new", F.lit(1))
    first = rows.groupBy(key, "_run", "_t").agg(F.min(event_id).alias(event_id))
    marks = starts.join(first, [key, "_run", "_t"]).select(key, event_id, "_new")
    number = F.sum(F.coalesce("_new", F.lit(0))).over(w)
    named = rows.join(marks, [key, event_id], "left").withColumn("session", number)
    return named.groupBy(key, "session").agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("started"), F.max(ts).alias("last_seen"))


def session_cleanup(sessions: DataFrame, key: str, now: Column, idle_s: int, most_s: int, per_user: int) -> DataFrame:
    """STM13: each session's fate at a time: ``expired`` beyond its whole length, ``idle``
    beyond the gap, ``over_cap`` if its user has ``per_user`` newer live ones, else ``active``."""
    age, rest = F.unix_micros(now) - F.unix_micros(F.col("started").cast("timestamp")), F.unix_micros(now) - F.unix_micros(F.col("last_seen").cast("timestamp"))
    state = F.when(age > most_s * 1_000_000, "expired").when(rest > idle_s * 1_000_000, "idle").otherwise("active")
    rows = sessions.withColumn("state", state)
    newer = F.sum((F.col("state") == "active").cast("int")).over(Window.partitionBy(key).orderBy(F.desc("started"), F.desc("session")))
    return rows.withColumn("state", F.when((F.col("state") == "active") & (newer > per_user), "over_cap").otherwise(F.col("state")))


def lock_periods(df: DataFrame, key: str, ts: str, order: Sequence[str], failed: Column, limit: int, window_s: int, lock_s: int) -> DataFrame:
    """STM10: each event's ``locked``: whether a lock covers it. A key is locked
    for ``lock_s`` by its ``limit``-th failure in a window since the last success;
    a success opens it."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_f", failed)
    rows = rows.withColumn("_k", F.sum((~F.col("_f")).cast("int")).over(w))
    near = Window.partitionBy(key, "_k").orderBy("_t").rangeBetween(-window_s * 1_000_000, 0)
    lock = F.when(F.col("_f") & (F.sum(F.col("_f").cast("int")).over(near) >= limit), F.col("_t") + lock_s * 1_000_000)
    before = F.max("_l").over(Window.partitionBy(key, "_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_l", lock)
    return rows.withColumn("locked", F.coalesce(F.col("_t") < before, F.lit(False)) & F.col("_f")).drop("_t", "_f", "_k", "_l")


def running_mean(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """WIN13, AGG29: ``total``, ``n`` and ``mean`` of a key's values up to each row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("total", F.sum(value).over(w)).withColumn("n", F.count(value).over(w))
    return rows.withColumn("mean", F.try_divide("total", "n"))
