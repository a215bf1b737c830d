"""Records: filters, paging, statistics, sampling, versions and lifecycle
(FLT1-FLT4, DQL1-DQL28 but DQL3's soft delete, SRT1-SRT5, WIN5-WIN7, AGG3-AGG5,
LIF1-LIF20 but LIF10, LIF13, LIF14)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def condition(tree: Mapping[str, object]) -> Column:
    """DQL1, DQL2: a Column from a JSON-shaped filter: {"and": [...]}, {"or": [...]},
    {"not": {...}} or {"field", "op", "value"}. An empty list of terms is true."""
    if "and" in tree:
        out = F.lit(True)
        for t in tree["and"]:
            out = out & condition(t)
        return out
    if "or" in tree:
        terms = [condition(t) for t in tree["or"]]
        out = terms[0] if terms else F.lit(True)
        for t in terms[1:]:
            out = out | t
        return out
    if "not" in tree:
        return ~condition(tree["not"])
    c, v = F.col(str(tree["field"])), tree.get("value")
    ops = {
        "eq": lambda: c == F.lit(v),
        "ne": lambda: c != F.lit(v),
        "gt": lambda: c > F.lit(v),
        "gte": lambda: c >= F.lit(v),
        "lt": lambda: c < F.lit(v),
        "lte": lambda: c <= F.lit(v),
        "in": lambda: c.isin(*v),
        "not_in": lambda: ~c.isin(*v),
        "contains": lambda: F.contains(c, F.lit(v)),
        "starts_with": lambda: F.startswith(c, F.lit(v)),
        "ends_with": lambda: F.endswith(c, F.lit(v)),
        "is_null": lambda: c.isNull(),
        "is_not_null": lambda: c.isNotNull(),
    }
    return ops[str(tree["op"])]()


def select_fields(df: DataFrame, fields: str | None, allowed: Sequence[str]) -> DataFrame:
    """FLT1: a comma list of fields; those that are not allowed are left out."""
    names = [x.strip() for x in fields.split(",")] if fields else list(allowed)
    return df.select(*[n for n in names if n in allowed])


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 20, most: int = 100) -> DataFrame:
    """SRT1, SRT2: an offset page; the offset comes of the size as asked, the
    limit of the clamped one."""
    number = max(1, number)
    return df.orderBy(*order).offset((number - 1) * size).limit(min(max(1, size), most))


def page_info(df: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """SRT3: total, pages, has_prev and has_next."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    pages = F.ceil(F.col("total") / size).cast("long")
    return total.select("total", pages.alias("total_pages"), F.lit(number > 1).alias("has_prev"), (F.lit(number) < pages).alias("has_next"))


def page_after(df: DataFrame, key: str, cursor: object | None, size: int) -> DataFrame:
    """SRT4: the keyset page after ``cursor``, with one row more to tell of a next page."""
    rows = df if cursor is None else df.where(F.col(key) > F.lit(cursor))
    return rows.orderBy(key).limit(size + 1)


def top_rows(df: DataFrame, partition: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """SRT10: the first ``n`` rows of each partition."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def field_statistics(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """DQL7, AGG4: one row a field: non_null, nulls, uniq, min, max, avg. One pass."""
    aggs = []
    for f in fields:
        c = F.col(f)
        aggs += [F.count(c).alias(f"n_{f}"), F.count_if(c.isNull()).alias(f"z_{f}"), F.count_distinct(c).alias(f"u_{f}"), F.min(c).cast("string").alias(f"a_{f}"), F.max(c).cast("string").alias(f"b_{f}"), F.avg(c.try_cast("double")).alias(f"m_{f}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"n_{f}").alias("non_null"), F.col(f"z_{f}").alias("nulls"), F.col(f"u_{f}").alias("uniq"), F.col(f"a_{f}").alias("min"), F.col(f"b_{f}").alias("max"), F.col(f"m_{f}").alias("avg")) for f in fields])
    return one.select(F.inline(rows))


def quality_profile(df: DataFrame, required: Sequence[str], valid: Column, unique: Sequence[str]) -> DataFrame:
    """DQL8, DQL9: completeness, validity, uniqueness and their mean."""
    filled = sum((F.count(F.col(c)) for c in required), F.lit(0)) / (F.count(F.lit(1)) * len(required))
    out = df.agg(F.count(F.lit(1)).alias("total"), filled.alias("completeness"), (F.count_if(valid) / F.count(F.lit(1))).alias("validity"), (F.count_distinct(F.struct(*unique)) / F.count(F.lit(1))).alias("uniqueness"))
    return out.withColumn("overall", (F.col("completeness") + F.col("validity") + F.col("uniqueness")) / 3)


def draw(key: Column, seed: str) -> Column:
    """A place in a fixed random order, from the hash of seed and key."""
    return F.sha2(F.concat(F.lit(seed), key.cast("string")), 256)


def sample_reservoir(df: DataFrame, key: str, size: int, seed: str = "s") -> DataFrame:
    """DQL10: ``size`` rows, the first by hash: a top-k that each task cuts first."""
    return df.orderBy(draw(F.col(key), seed), key).limit(size)


def sample_stratified(df: DataFrame, key: str, stratum: str, size: int, seed: str = "s") -> DataFrame:
    """DQL10: ``size`` rows of each stratum, the first by hash."""
    return top_rows(df, [stratum], [draw(F.col(key), seed), F.col(key)], size)


def sample_ratio(df: DataFrame, key: str, percent: int, seed: str = "s") -> DataFrame:
    """DQL10: the rows whose hash falls into ``percent`` hundredths."""
    return df.where(F.conv(F.left(draw(F.col(key), seed), F.lit(8)), 16, 10).cast("long") % 100 < percent)


def sample_systematic(df: DataFrame, key: str, n: int) -> DataFrame:
    """DQL10: every n-th row in order of the key. Places are counted in slices
    of the key's range, so that no task orders all rows."""
    return numbered(df, key).where((F.col("_place") - 1) % n == 0).drop("_place")


def numbered(df: DataFrame, key: str, slices: int = 256) -> DataFrame:
    """``df`` with ``_place``, the row's number from 1 in order of a unique numeric key."""
    ends = df.agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    rows = df.join(F.broadcast(ends)).withColumn("_s", F.floor((F.col(key) - F.col("_lo")) * slices / (F.col("_hi") - F.col("_lo") + 1))).drop("_lo", "_hi")
    sizes = rows.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_s", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_s")) - F.col("_n")).alias("_b"))
    inner = F.row_number().over(Window.partitionBy("_s").orderBy(key))
    return rows.withColumn("_i", inner).join(F.broadcast(before), "_s").withColumn("_place", F.col("_i") + F.col("_b")).drop("_s", "_i", "_b")


def batch_checksum(df: DataFrame, group: Sequence[str], key: str, checksum: Column) -> DataFrame:
    """DQL15: the hash of each group's checksums in order of the key."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(F.col(key), checksum.alias("c")))), lambda x: x["c"])
    return df.groupBy(*group).agg(F.sha2(F.array_join(parts, ""), 256).alias("checksum"))


def changes(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """DQL17: (key, field, old, new) of every field that differs, null-safe."""
    o = old.select(key, *[F.col(f).cast("string").alias(f"o_{f}") for f in fields])
    n = new.select(key, *[F.col(f).cast("string").alias(f"n_{f}") for f in fields])
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o_{f}").alias("old"), F.col(f"n_{f}").alias("new")) for f in fields])
    return o.join(n, key).select(key, F.inline(F.filter(cells, lambda c: ~c["old"].eqNullSafe(c["new"]))))


def versions(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """WIN5: rows numbered from 1 within their record."""
    return df.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def as_of(df: DataFrame, key: str, version: str, at: int, fields: Sequence[str]) -> DataFrame:
    """WIN7: each record as it was at version ``at``."""
    rows = df.where(F.col(version) <= at)
    return rows.groupBy(key).agg(F.max(version).alias(version), F.max_by(F.struct(*fields), version).alias("_s")).select(key, version, "_s.*")


def optimistic_update(current: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """LIF3: each update as ``ok``, ``conflict`` (another version is current) or ``missing``."""
    rows = updates.join(current.select(key, F.col("version").alias("_v")), key, "left")
    return rows.withColumn("outcome", F.when(F.col("_v").isNull(), "missing").when(F.col("_v") == F.col("expected_version"), "ok").otherwise("conflict")).drop("_v")


def idempotent_insert(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """LIF4: the first row of each idempotency key."""
    return top_rows(df, keys, [F.col(c) for c in order], 1)


def batch_limits(n: Column, least: int = 1, most: int = 1000) -> Column:
    """LIF1, LIF2: whether a batch has an allowed number of rows."""
    return n.between(least, most)


def set_status(df: DataFrame, when: Column, status: str, reason: str | None = None) -> DataFrame:
    """LIF5, LIF6: quarantine, release, archive, restore: a new status where asked."""
    out = df.withColumn("status", F.when(when, status).otherwise(F.col("status")))
    return out if reason is None else out.withColumn("reason", F.when(when, reason))


def retention_days(amount: Column, unit: Column) -> Column:
    """DQL18: days of a period; indefinite: null."""
    return F.when(unit == "day", amount).when(unit == "month", amount * 30).when(unit == "year", amount * 365)


def retention_action(age_days: Column, days: Column, action: Column) -> Column:
    """LIF11, DQL19, GRF23: the action once the age is beyond the days, else keep."""
    return F.when(age_days > days, action).otherwise("keep")


def upsert_maps(old: Column, new: Column) -> Column:
    """SET2: both maps' entries, the new one's where both have a key."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(old), lambda e: ~F.map_contains_key(new, e["key"])), F.map_entries(new)))


def inverted_index(df: DataFrame, key: str, tags: str) -> DataFrame:
    """FLT15: (tag, value, keys) of a map column."""
    return df.select(key, F.explode(tags).alias("tag", "value")).groupBy("tag", "value").agg(F.sort_array(F.collect_list(key)).alias("keys"))


def assemble(parts: Mapping[str, DataFrame], key: str, holdout: int = 10) -> DataFrame:
    """DQL11: a corpus of several datasets, split by hash of the key."""
    rows = None
    for name, df in parts.items():
        one = df.withColumn("dataset", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    h = F.conv(F.left(F.sha2(F.concat(F.col("dataset"), F.col(key).cast("string")), 256), F.lit(8)), 16, 10).cast("long") % 100
    return rows.withColumn("split", F.when(h < holdout, "test").when(h < 2 * holdout, "validation").otherwise("training"))
