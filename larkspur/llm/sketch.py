"""Document fingerprints: threshold-scaled sketches of word shingles.

A fingerprint holds every 64-bit hash of a text's five-word shingles that lies
below a fixed fraction of the hash range, so it grows with the document, two of
them can be merged by union, and the containment of a short document in a long
one is estimated without bias. A text of which no hash lies below the threshold
keeps its smallest one, which a union with any other sketch of such hashes
drops; so no text with words has an empty fingerprint. Only DataFrame
operations are used.

Words are runs of characters other than ASCII white space, lower-cased in A-Z.
A text of one to four words is one shingle. The likeness of two sketches is
|A and B| / min(|A|, |B|) over the hashes below the threshold (over all, where a
sketch only has its smallest hash): 1 for equal texts, and for a text within
another.

Defined cases: a null text counts as empty; the likeness is 1 if both texts are
without words, 0 if one is. With repeated ids the order is by id, then text;
equal rows follow each other. A single document is its own next one. An empty
table gives an empty result. Columns that are not named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, join_small

#: One of so many shingle hashes is kept.
SCALE = 8
WIDTH = 5


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The words of a text as an array; null: none."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def sketch(text: Column, scale: int = SCALE, width: int = WIDTH) -> Column:
    """The sorted distinct kept hashes of ``text``."""
    limit = F.lit(-(1 << 63) + (1 << 64) // scale)
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        runs = F.when(n >= width, F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(width)])))
        return runs.when(n > 0, F.array(F.xxhash64(h, F.lit(width)))).otherwise(F.array().cast("array<bigint>"))

    def keep(s: Column) -> Column:
        low = F.array_distinct(F.filter(s, lambda x: x < limit))
        return F.when((F.size(low) > 0) | (F.size(s) == 0), F.array_sort(low)).otherwise(F.array(F.array_min(s)))

    # each step is bound to a name by a one-element array, or it would be computed at each use
    return F.element_at(F.transform(F.transform(F.array(hashed), shingles), keep), 1)


def as_text(hashes: Column) -> Column:
    """A sketch as text: the hashes in hex, in order, joined by commas."""
    return F.array_join(F.transform(hashes, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ",")


def likeness(a: Column, b: Column) -> Column:
    """Estimated containment of the smaller text's shingles in the other's."""
    least = F.least(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def id_ranges(df: DataFrame, id_col: str, cuts: int = 512, rows: int = 1_000) -> Column:
    """A number that ascends with the id and that about ``rows`` rows share.

    The ids' ``cuts`` quantiles (a bounded list) give the coarse part, equal
    steps between two quantiles the fine one. Null ids are below all others.
    """
    key = F.col(id_col).cast("double")
    steps = F.percentile_approx(key, F.array(*[F.lit(i / cuts) for i in range(cuts + 1)]), 20 * cuts)
    got = df.agg(steps.alias("q"), F.count(F.lit(1)).alias("n")).first()
    bounds = sorted(set(got["q"] or []))
    if not bounds:
        return F.lit(-1).cast("long")
    fine = max(1, -(-got["n"] // (rows * max(1, len(bounds) - 1))))
    listed = F.array(*[F.lit(float(x)) for x in bounds])
    at = F.greatest(F.lit(1), F.least(F.lit(max(1, len(bounds) - 1)), F.size(F.filter(listed, lambda x: x <= key))))
    low, high = F.element_at(listed, at), F.element_at(listed, F.least(at + 1, F.lit(len(bounds))))
    step = F.floor(F.coalesce(F.try_divide(key - low, high - low), F.lit(0.0)) * fine)
    inside = F.greatest(F.lit(0), F.least(F.lit(fine - 1), step))
    return F.coalesce(at * F.lit(fine).cast("long") + inside, F.lit(-1)).cast("long")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE, width: int = WIDTH) -> DataFrame:
    """One row for each row of ``df``: its id and fingerprint as text."""
    return df.select(id_col, as_text(sketch(F.col(text_col), scale, width)).alias("fingerprint"))


def edited_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE, width: int = WIDTH) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last half is
    replaced by the front of the next document's (in descending order of ids)."""
    base = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    base = base.withColumn("_range", id_ranges(base, "_id")).withColumn("_t", F.xxhash64("_text"))
    # the first document of each range, in descending order, follows the last of the range above; one row a range
    front = durable(base.groupBy("_range").agg(F.max(F.struct("_id", "_t")).alias("_f")))
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("_range"))
    all_of = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = front.select("_range", F.coalesce(F.lead("_f").over(down), F.first("_f").over(all_of)).alias("_f"))
    after = durable(after.select(F.col("_range").alias("_above"), F.col("_f._id").alias("_fid"), F.col("_f._t").alias("_ft")))
    # a null id stands for itself as "n", any other as "i" and the id
    same = lambda c: F.coalesce(F.concat(F.lit("i"), F.col(c).cast("string")), F.lit("n"))
    after = after.select("_above", same("_fid").alias("_fid"), "_ft")
    found = join_small(base.select(same("_id").alias("_fid"), F.col("_t").alias("_ft"), F.col("_text").alias("_ftext")), after, ["_fid", "_ft"])
    edge = found.select("_above", "_ftext")
    edge = edge.dropDuplicates(["_above"]).withColumn("_ffp", sketch(F.col("_ftext"), scale, width))

    # one shuffle of the texts, by ranges of ids
    rows = base.repartition("_range").withColumn("_fp", sketch(F.col("_text"), scale, width))
    near = Window.partitionBy("_range").orderBy(F.col("_id").desc_nulls_last(), F.desc("_t"))
    rows = rows.withColumn("_n", F.lead(F.struct("_text", "_fp")).over(near))
    rows = rows.join(edge.hint("merge"), rows["_range"] == edge["_above"], "left")
    paired = rows.select(
        "_id",
        F.length("_text").cast("long").alias("n_chars"),
        F.col("_fp").alias("_a"),
        F.when(F.col("_n").isNotNull(), F.col("_n._fp")).otherwise(F.col("_ffp")).alias("_b"),
        F.expr("left(_text, length(_text) - int(floor(length(_text) / 2)))").alias("_kept"),
        F.expr("left(CASE WHEN _n IS NOT NULL THEN _n._text ELSE _ftext END, int(floor(length(_text) / 2)))").alias("_new"),
    )
    edited = F.concat("_kept", "_new")
    done = paired.select("_id", "n_chars", "_a", "_b", edited.alias("_edited"))
    done = done.withColumn("_c", sketch(F.col("_edited"), scale, width))
    return done.select(
        F.col("_id").alias(id_col),
        "n_chars",
        F.sha2(F.col("_edited"), 256).alias("edited_sha256"),
        as_text(F.col("_a")).alias("fingerprint"),
        as_text(F.col("_c")).alias("edited_fingerprint"),
        likeness(F.col("_a"), F.col("_c")).alias("near_edited"),
        likeness(F.col("_a"), F.col("_b")).alias("near_next"),
    )
