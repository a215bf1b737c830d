"""Handlers, branch moves, field rules and folder trees (JN6, JN11, GRF19, GRF20, STM23)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .events import BROADCAST_ROWS


def chains(events: DataFrame, handlers: DataFrame, key: str, event_type: str) -> DataFrame:
    """JN6: for each event the enabled handlers of its type, the highest priority
    first, ties by name."""
    on = handlers.where("enabled").select(F.col("event_type").alias("_t"), "name", "priority")
    few = on.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = events.join(F.broadcast(on) if few else on, F.col(event_type) == F.col("_t"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), "name")))
    return rows.groupBy(key).agg(F.array_join(F.transform(order, lambda h: h["name"]), ">").alias("chain"))


def ran(results: Column) -> Column:
    """STM23: of (name, ok, carry_on) in order, the names that run: a failure ends
    the chain unless its handler lets it go on."""
    zero = F.struct(F.lit(True).alias("on"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        return F.struct((acc["on"] & (r["ok"] | r["carry_on"])).alias("on"), F.when(acc["on"], F.array_append(acc["out"], r["name"])).otherwise(acc["out"]).alias("out"))

    return F.aggregate(results, zero, step, lambda acc: acc["out"])


def move_branches(branches: DataFrame, updates: DataFrame) -> DataFrame:
    """GRF20: each update's outcome and the branch's target after it."""
    b = branches.select("name", F.col("target").alias("_old"), "protected")
    rows = updates.join(b, "name", "left")
    outcome = F.when(F.col("_old").isNull(), "missing").when(F.col("protected") & ~F.col("force"), "blocked").otherwise("moved")
    return rows.select("name", outcome.alias("outcome"), F.when(outcome == "moved", F.col("target")).otherwise(F.col("_old")).alias("target"))


def field_strategy(field: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """JN11: the strategy of the first rule that fits a field's name: a pattern
    with ``*`` is a glob over the whole name, any other a regex within it."""
    out = F.lit(default)
    for pattern, strategy in reversed(rules):
        regex = "^" + pattern.replace("*", ".*") + "$" if "*" in pattern else pattern
        out = F.when(field.rlike(regex), strategy).otherwise(out)
    return out


def folders(df: DataFrame, path: str, size: str) -> DataFrame:
    """GRF19: (folder, entries, bytes) of every folder above the paths."""
    parts = F.split(F.col(path), "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))
    return df.select(F.col(size).alias("_s"), F.explode(above).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("entries"), F.sum("_s").alias("bytes"))
