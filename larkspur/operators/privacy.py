"""Privacy measures of tables and texts (AGG21-AGG28)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def classes(df: DataFrame, quasi: Sequence[str]) -> DataFrame:
    """AGG21: equivalence classes of the quasi-identifiers and their sizes."""
    return df.groupBy(*quasi).agg(F.count(F.lit(1)).alias("size"))


def risks(df: DataFrame, quasi: Sequence[str], k: int = 5) -> DataFrame:
    """AGG22-AGG26: prosecutor, journalist and marketer risk, discernibility, and
    the rows and classes below ``k``."""
    n = F.col("size")
    return classes(df, quasi).agg(
        F.sum(n).alias("rows"),
        F.count(F.lit(1)).alias("classes"),
        (F.sum(1 / n) / F.sum(n)).alias("prosecutor"),
        (F.count_if(n == 1) / F.sum(n)).alias("journalist"),
        F.avg(1 / n).alias("marketer"),
        F.sum(n * n).alias("discernibility"),
        F.coalesce(F.sum(F.when(n < k, n)), F.lit(0)).alias("rows_below_k"),
    )


def k_anonymous(df: DataFrame, levels: Sequence[Sequence[Column]], names: Sequence[str], k: int) -> DataFrame:
    """AGG25: each row at the first level of generalization at which its class has
    ``k`` rows; those that never have are suppressed (level -1, null values)."""
    rows = df
    for i, cols in enumerate(levels):
        for name, c in zip(names, cols):
            rows = rows.withColumn(f"_g{i}_{name}", c)
        rows = rows.withColumn(f"_n{i}", F.count(F.lit(1)).over(Window.partitionBy(*[f"_g{i}_{n}" for n in names])))
    level = F.coalesce(*[F.when(F.col(f"_n{i}") >= k, F.lit(i)) for i in range(len(levels))], F.lit(-1))
    rows = rows.withColumn("level", level)
    out = [F.coalesce(*[F.when(F.col("level") == i, F.col(f"_g{i}_{n}").cast("string")) for i in range(len(levels))]).alias(n) for n in names]
    keep = [c for c in df.columns if c not in names]
    return rows.select(*keep, "level", *out)


def entropy(text: Column) -> Column:
    """AGG27: Shannon entropy of a text's characters in bits, their shares taken
    of its length in bytes."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.octet_length(text)
    terms = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n)
    return F.aggregate(terms, F.lit(0.0), lambda acc, p: acc - p * F.log2(p)) + 0.0


def budget(df: DataFrame, key: str, order: str, epsilon: str, limit: float, delta: float = 1e-5) -> DataFrame:
    """AGG28: queries in order against a budget by advanced composition: the k-th
    accepted one costs eps * sqrt(2 k ln(1 / delta)); one over the budget is refused."""
    kind = df.schema[order].dataType.simpleString()
    zero = F.struct(F.lit(0.0).alias("spent"), F.lit(0).alias("k"), F.array().cast(f"array<struct<{order}:{kind},cost:double,accepted:boolean>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        cost = x["e"] * F.sqrt(F.lit(2.0) * (acc["k"] + 1) * F.log(F.lit(1 / delta)))
        ok = acc["spent"] + cost <= limit
        return F.struct(F.when(ok, acc["spent"] + cost).otherwise(acc["spent"]).alias("spent"), (acc["k"] + ok.cast("int")).alias("k"), F.array_append(acc["out"], F.struct(x["o"].alias(order), cost.alias("cost"), ok.alias("accepted"))).alias("out"))

    rows = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(epsilon).alias("e")))).alias("_q"))
    return rows.select(key, F.inline(F.aggregate("_q", zero, step, lambda acc: acc["out"])))
