"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, forget


def _stars(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step on pairs (a, b), a > b.

    Large: every node gives the smallest of itself and its neighbours to its
    larger neighbours. Small: it gives it to its smaller neighbours and takes
    it itself.
    """
    if large:
        own = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = own.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        given = own.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = pairs.groupBy("a").agg(F.min("b").alias("m"))
        given = pairs.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return given.where("a > b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``node``, ``component``) of every node that has a link to another one:
    the smallest node that links lead to. Null ends and links of a node with
    itself are ignored. The pairs stay distributed; a round is written as a
    table in the shared folder, and only a count and a checksum come back."""
    low, high = F.least(a, b), F.greatest(a, b)
    pairs = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(high.cast("long").alias("a"), low.cast("long").alias("b")).distinct()
    pairs, before = durable(pairs), None
    while True:
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or tuple(state) == before:
            break
        before = tuple(state)
        new = durable(_stars(_stars(pairs, True), False))
        forget(pairs)
        pairs = new
    roots = pairs.select(F.col("b").alias("node")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
