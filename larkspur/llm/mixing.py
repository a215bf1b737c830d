"""Mixing sources to target weights by Pareto order sampling.

Each source has a target of words. A document's expected copies are the
target's share of its source; their whole part is certain and the rest is an
inclusion probability p. Documents are ranked by Pareto's key

    Q = (U / (1 - U)) / (p / (1 - p)),    U uniform from the hash of the id,

and the sample of fixed size, in words, is the front of that order. Only
DataFrame operations are used.

The front is found without sorting a source in one task: words are summed by
(source, slice of the key), the slice that holds the cut is found from at most
``SLICES`` sums for each source, and only that slice is looked into, by finer
slices and at last by rank. A source with a third of all rows is thereby
spread over all tasks.

Defined cases: a null text has size 0; a null source is a source of its own,
ordered last; repeated rows are separate documents which share a key and follow
each other; documents of size 0 are never taken (0 words); an empty table gives
an empty result; a source without words has target 0. Columns that are not
named are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, join_small

#: Slices of the key on each of the two levels.
SLICES = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words, runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column) -> Column:
    """A number strictly between 0 and 1 from the hash of ``key``, a string."""
    bits = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_repeat: float) -> DataFrame:
    """``_src``, ``source_size``, ``target`` of each source.

    Sources by code point, null last, take the weights in turn. Together they
    get ``share`` times all words in proportion to their weights, none more
    than ``max_repeat`` times its own words; the excess goes to the others by
    weight until none is above. That is the level L of least(cap, L * weight)
    which spends the budget: with the sources by cap / weight, the first k are
    capped for the smallest k whose level fits source k + 1.
    """
    per = sizes.groupBy("_src").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    place = (F.row_number().over(every.orderBy("_null", "_src")) - 1) % len(weights)
    per = per.withColumn("_null", F.when(F.col("_src") == "n", 1).otherwise(0)).withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    per = per.withColumn("_cap", F.col("source_size") * F.lit(float(max_repeat)))
    order = every.orderBy(F.col("_cap") / F.col("_w"), "_null", "_src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    level = left / F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("_level", level).withColumn("_fits", F.col("_level") <= F.col("_cap") / F.col("_w"))
    per = per.withColumn("_chosen", F.max(F.when(F.col("_fits"), F.struct(-F.row_number().over(order), "_level"))).over(every))
    target = F.coalesce(F.least(F.col("_cap"), F.col("_chosen._level") * F.col("_w")), F.col("_cap"))
    return per.select("_src", "source_size", target.alias("target"))


def _cut(rows: DataFrame, slice_of: Column) -> DataFrame:
    """For each source the slice in which the words reach ``_need`` and the
    words that stand before it; none for a source that never reaches it."""
    sums = rows.groupBy("_src", slice_of.alias("_s")).agg(F.sum("size").alias("_words"), F.first("_need").alias("_need"))
    until = Window.partitionBy("_src").orderBy("_s")
    sums = sums.withColumn("_after", F.sum("_words").over(until))
    cut = F.min(F.when(F.col("_after") > F.col("_need"), F.struct("_s", (F.col("_after") - F.col("_words")).alias("before"))))
    return sums.groupBy("_src").agg(cut.alias("_cut")).where(F.col("_cut").isNotNull())


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_repeat: int = 2,
    importance: Column | None = None,
    seed: int = 17,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row for each row of ``df``: its id, size in words, its source's size
    and target, the ``copies`` that the mix takes and the words ``taken``.

    ``importance`` (default 1, at least 0) makes the expected copies within a
    source unequal. The last document of a source's sample is in if that brings
    its words nearer to the target, so they miss it by half a document at most.
    With ``carry`` the rows have these columns of ``df``, ``copies`` and ``taken``;
    they are read from ``df`` again and not shuffled.
    """
    src = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))
    held = [F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)]
    whole = df.select(F.col(id_col).alias("_id"), src.alias("_src"), word_count(F.col(text_col)).alias("size"), (F.lit(1.0) if importance is None else importance.cast("double")).alias("_imp"), *held)
    sized = durable(whole.select("_id", "_src", "size", "_imp"))
    targets = source_targets(sized, weights, share, max_repeat)
    weighted = sized.groupBy("_src").agg(F.sum(F.col("size") * F.col("_imp")).alias("_mass"))
    targets = durable(targets.join(weighted, "_src"))

    expected = F.when((F.col("size") > 0) & (F.col("_mass") > 0), F.least(F.lit(float(max_repeat)), F.col("target") * F.col("_imp") / F.col("_mass"))).otherwise(0.0)
    u = uniform(F.concat_ws(":", F.coalesce(F.col("_id").cast("string"), F.lit("null")), F.lit(str(seed))))

    def keyed(base: DataFrame) -> DataFrame:
        own = join_small(base, targets, ["_src"]).withColumn("_e", expected).withColumn("_whole", F.floor("_e")).withColumn("_p", F.col("_e") - F.col("_whole"))
        q = (u / (1 - u)) / (F.col("_p") / (1 - F.col("_p")))
        return own.withColumn("_q", F.when(F.col("_p") > 0, q)).withColumn("_v", F.col("_q") / (F.col("_q") + 1))

    rows = keyed(sized)
    coarse = F.floor(F.col("_v") * SLICES)
    fine = F.floor(F.col("_v") * SLICES * SLICES) - coarse * SLICES

    certain = rows.groupBy("_src").agg(F.sum(F.col("_whole") * F.col("size")).alias("_certain"))
    need = durable(targets.join(certain, "_src").select("_src", (F.col("target") - F.col("_certain")).alias("_need")))
    rows = join_small(rows, need, ["_src"], "left")
    open_rows = rows.where(F.col("_q").isNotNull())
    first = durable(_cut(open_rows, coarse).select("_src", F.col("_cut._s").alias("_s1"), F.col("_cut.before").alias("_b1")))
    inside = join_small(open_rows, first, ["_src"]).where(coarse == F.col("_s1")).withColumn("_need", F.col("_need") - F.col("_b1"))
    second = durable(_cut(inside, fine).select("_src", F.col("_cut._s").alias("_s2"), F.col("_cut.before").alias("_b2")))

    if carry:
        rows = join_small(keyed(whole), need, ["_src"], "left")
    rows = join_small(join_small(rows, first, ["_src"], "left"), second, ["_src"], "left")
    group = F.when(F.col("_q").isNull(), "no").when(F.col("_s1").isNull() | (coarse < F.col("_s1")), "yes").when(coarse > F.col("_s1"), "no").when(F.col("_s2").isNull() | (fine < F.col("_s2")), "yes").when(fine > F.col("_s2"), "no").otherwise("cut")
    rows = rows.withColumn("_group", group)
    ranked = Window.partitionBy("_src").orderBy("_q", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    decided = rows.where("_group = 'cut'").withColumn("_before", F.coalesce(F.sum("size").over(ranked), F.lit(0)) + F.col("_b1") + F.col("_b2"))
    decided = decided.withColumn("_in", F.when(F.col("_before") + F.col("size") / 2 <= F.col("_need"), 1).otherwise(0)).drop("_before")
    rest = rows.where("_group <> 'cut'").withColumn("_in", F.when(F.col("_group") == "yes", 1).otherwise(0))
    copies = (F.col("_whole") + F.col("_in")).cast("long")
    both = decided.unionByName(rest)
    if carry:
        return both.select(*[F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)], copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    return both.select(F.col("_id").alias(id_col), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))
