"""Listings, governed reads and the lifecycle of records, datasets, tenants and
requests (FLT2, FLT4, FLT12, FLT19, FLT23, FLT25, FLT27, JN12, GRF22, DQL3-DQL5,
DQL13, DQL14, LIF2, LIF7, LIF10, LIF13, LIF14, LIF19, SRT5, SRT9)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from larkspur.functions import anonymize as A
from larkspur.functions import detection as D

# The kinds of relationships.
RELATIONSHIPS = ("DerivedFrom", "Contains", "DependsOn", "TransformedBy", "CreatedBy", "ModifiedBy", "VersionOf", "ValidatedBy", "EncryptedWith", "AnonymizedBy")
PAGE, PAGE_MOST = 50, 1000


def sort_columns(by: Sequence[str], order: str = "asc", tie: str | None = None) -> list[Column]:
    """SRT5: the columns in one order; ``tie`` keeps pages apart."""
    out = [F.desc(c) if order == "desc" else F.asc(c) for c in by]
    return out if tie is None or tie in by else [*out, F.asc(tie)]


def list_rows(df: DataFrame, key: str, *, equal: Mapping[str, object] | None = None, label: str | None = None, labels_col: str = "labels", search: str | None = None, search_cols: Sequence[str] = (), sort_by: str | None = None, order: str = "asc", limit: int = 20, offset: int = 0) -> DataFrame:
    """FLT2, FLT4: one page of the rows with all given values, a label, and a
    text, in any case, in one of some columns."""
    for name, value in (equal or {}).items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    if label is not None:
        df = df.where(F.array_contains(labels_col, label))
    if search is not None:
        there = F.lit(False)
        for c in search_cols:
            there = there | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(search.lower())), F.lit(False))
        df = df.where(there)
    return df.orderBy(*sort_columns([sort_by or key], order, key)).offset(offset).limit(limit)


def record_query(df: DataFrame, dataset: Column, where: Sequence[Column] = (), version: int | None = None, include_deleted: bool = False) -> DataFrame:
    """DQL3: rows of a dataset, of one version if named, that pass all filters;
    soft-deleted ones only if asked for."""
    rows = df.where(dataset)
    if version is not None:
        rows = rows.where(F.col("version") == version)
    if not include_deleted:
        rows = rows.where(F.col("deleted_at").isNull())
    for c in where:
        rows = rows.where(c)
    return rows


def page_of(df: DataFrame, by: str, key: str, page: int = 1, size: int | None = None, order: str = "desc") -> DataFrame:
    """DQL4: a page of 50 rows unless asked otherwise, 1,000 at most, the largest first."""
    if page < 1:
        raise ValueError("pages count from 1")
    n = min(PAGE if size is None else max(1, size), PAGE_MOST)
    return df.orderBy(*sort_columns([by], order, key)).offset((page - 1) * n).limit(n)


def governed_read(df: DataFrame, grants: DataFrame, principal: str, *, dataset_col: str, where: Column | None = None, text_col: str = "text", raw_levels: Sequence[str] = ("raw",)) -> DataFrame:
    """DQL5: the rows of the datasets that a principal has a grant for, filtered;
    texts are anonymized unless the grant is for raw ones. Grants are (principal,
    dataset, level); of several, the widest counts."""
    mine = grants.where(F.col("principal") == principal).groupBy("dataset").agg(F.max(F.col("level").isin(*raw_levels)).alias("_raw"))
    rows = df if where is None else df.where(where)
    rows = rows.join(mine.withColumnRenamed("dataset", "_d"), F.col(dataset_col) == F.col("_d")).drop("_d")
    rows = D.detect(rows, text_col, "_hits")
    shown = F.when(F.col("_raw"), F.col(text_col)).otherwise(A.anonymize(F.col(text_col), F.col("_hits")))
    return rows.withColumn(text_col, shown).drop("_raw", "_hits")


def response(df: DataFrame, fields: Mapping[str, str | Column]) -> DataFrame:
    """FLT25: the named columns under the names of a response."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in fields.items()])


def selected(df: DataFrame, fields: Sequence[str], where: str | None = None) -> DataFrame:
    """DQL14: fields and a condition as SQL text over the rows' own columns."""
    rows = df if where is None else df.where(F.expr(where))
    return rows.selectExpr(*fields)


def batches(df: DataFrame, size: int) -> Iterator[list[Row]]:
    """DQL13: the rows to a reader in lists of ``size``; one partition at a time
    is at the reader."""
    held: list[Row] = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def node_query(nodes: DataFrame, types: Sequence[str] = (), tags: Sequence[str] = (), since: object = None, until: object = None) -> DataFrame:
    """FLT12, FLT19: nodes of some types with some of the tags, made in a time
    whose ends count; what is not named is not asked."""
    if types:
        nodes = nodes.where(F.col("node_type").isin(*types))
    if tags:
        nodes = nodes.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if since is not None:
        nodes = nodes.where(F.col("created_at") >= F.lit(since))
    if until is not None:
        nodes = nodes.where(F.col("created_at") <= F.lit(until))
    return nodes


def relationships_of(edges: DataFrame, ids: DataFrame, kinds: Sequence[str] = RELATIONSHIPS) -> DataFrame:
    """JN12, GRF22: (id, source, target, kind, weight) of the edges at either end
    of each id, once each: two joins on keys, not one on a disjunction. Edges
    of unknown kinds are left out; one without a weight weighs 1."""
    known = edges.where(F.col("kind").isin(*kinds)).withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    out = known.join(ids.select(F.col("id").alias("_i")), F.col("source") == F.col("_i"))
    into = known.join(ids.select(F.col("id").alias("_i")), (F.col("target") == F.col("_i")) & ~F.col("source").eqNullSafe(F.col("target")))
    return out.unionByName(into).select(F.col("_i").alias("id"), "source", "target", "kind", "weight")


def kept_since(df: DataFrame, ts: str, now: object, max_age: str) -> DataFrame:
    """FLT23: rows younger than an age at a time."""
    return df.where(F.col(ts) > F.lit(now) - F.expr(f"INTERVAL {max_age}"))


def over_quota(usage: Mapping[str, Column], quota: Mapping[str, Column]) -> Column:
    """FLT27: whether any use has come to its quota; an unknown one has not."""
    out = F.lit(False)
    for name, used in usage.items():
        out = out | F.coalesce(used >= quota[name], F.lit(False))
    return out


def by_priority(rules: DataFrame, priority: str, order: str) -> DataFrame:
    """SRT9: rules by falling priority, ties in the order that they came in, and their ranks."""
    return rules.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(priority), order)))


def soft_delete(df: DataFrame, ids: DataFrame, key: str, now: Column) -> DataFrame:
    """LIF2: rows of the ids get a time of deletion, unless they have one."""
    gone = ids.select(F.col(key)).distinct().withColumn("_gone", F.lit(True))
    rows = df.join(gone, key, "left")
    return rows.withColumn("deleted_at", F.when(F.col("deleted_at").isNull() & F.col("_gone"), now).otherwise(F.col("deleted_at"))).drop("_gone").select(*df.columns)


def clone_dataset(df: DataFrame, dataset_col: str, source: object, name: object, key: str) -> DataFrame:
    """LIF7: copies of a dataset's rows under a new name, with keys of their own."""
    rows = df.where(F.col(dataset_col) == F.lit(source))
    return rows.withColumn(key, F.concat(F.lit(f"{name}:"), F.col(key).cast("string"))).withColumn(dataset_col, F.lit(name))


def anonymized_records(df: DataFrame, key: str, text_col: str, rules: Mapping[str, str] = A.DEFAULTS, default: str = "mask") -> DataFrame:
    """LIF10: one row for each record that something was found in: its key, the
    new text, how many places changed, and the strategies used, each once, in order."""
    rows = D.detect(df.select(key, text_col), text_col, "_hits").where(F.size("_hits") > 0)
    used = F.array_sort(F.array_distinct(F.transform("_hits", lambda h: A.strategy_for(h["pii_type"], rules, default))))
    return rows.select(key, A.anonymize(F.col(text_col), F.col("_hits"), rules, default).alias(text_col), F.size("_hits").alias("n_changes"), used.alias("strategies_used"))


def compliance_report(df: DataFrame, ts: str, since: object, until: object, by: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """LIF13: measures of each group in a range of times, the last excluded, with
    the range: a data inventory, an access report or one of requests, by what is grouped."""
    rows = df.where((F.col(ts) >= F.lit(since)) & (F.col(ts) < F.lit(until)))
    return rows.groupBy(*by).agg(*[c.alias(name) for name, c in measures.items()]).withColumn("period_start", F.lit(since)).withColumn("period_end", F.lit(until))


def request_state(opened: Column, closed: Column, now: Column, days: int = 30) -> dict[str, Column]:
    """LIF14: a data subject's request: when it is due, its status, and how many
    days it is late."""
    due = F.date_add(opened.cast("date"), days)
    day = F.coalesce(closed.cast("date"), now.cast("date"))
    late = F.greatest(F.datediff(day, due), F.lit(0))
    status = F.when(closed.isNotNull(), F.when(late > 0, "completed_late").otherwise("completed")).when(late > 0, "overdue").otherwise("open")
    return {"due_at": due, "status": status, "days_late": late}


def update_metadata(df: DataFrame, when: Column, changes: Mapping[str, Column], now: Column) -> DataFrame:
    """LIF19: new values where asked, and the time of the change beside them."""
    out = df
    for name, value in changes.items():
        out = out.withColumn(name, F.when(when, value).otherwise(F.col(name)))
    return out.withColumn("modified_at", F.when(when, now).otherwise(F.col("modified_at")))


def filtering(predicate: Column, handler: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """UDF6: a handler of micro-batches that only sees the rows that pass."""

    def run(batch: DataFrame, epoch: int) -> None:
        handler(batch.where(predicate), epoch)

    return run
