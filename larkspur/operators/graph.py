"""Lineage and history graphs (GRF1-GRF14, GRF21, AGG6, AGG30-AGG32, SET4, SET6, JN2).

A closure is computed by a loop over its frontier: a join with the edges and an
anti-join with what was seen. Each round is written as a table in the shared
folder, so the lineage stays short and lost executors cost one round; only
counts come back to the driver.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rounds of a closure whose tables are read side by side at most.
MERGE = 10


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or one of this machine where that
    is unset, as in tests."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="larkspur-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def closure(edges: DataFrame, starts: DataFrame, most: int | None = None, include_start: bool = False) -> DataFrame:
    """GRF1, GRF2, GRF9, GRF11: (start, node, depth) of all nodes that edges
    (src, dst) lead to from each start, at their least depth; cycles are safe. ``most`` bounds
    the depth, where it is given.

    The rounds' tables are merged whenever there are ``MERGE`` of them, so plans
    stay short on long chains."""
    frontier = stored(starts.select(F.col("start"), F.col("start").alias("node"), F.lit(0).alias("depth")).distinct())
    seen, depth = frontier, 0
    while most is None or depth < most:
        depth += 1
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("start", F.col("dst").alias("node")).distinct()
        new = stored(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if new.limit(1).count() == 0:
            break
        seen, frontier = seen.unionByName(new), new
        if depth % MERGE == 0:
            seen = stored(seen)
    return seen if include_start else seen.where("depth > 0")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GRF7, GRF14: nodes that no edge leads to."""
    return nodes.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GRF7, GRF14: nodes that no edge leaves."""
    return roots(nodes, reverse(edges))


def impact(edges: DataFrame, starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """AGG30, DQL27: how many nodes of each type stand downstream of each start."""
    return closure(edges, starts).join(nodes, "node").groupBy("start", "node_type").agg(F.count(F.lit(1)).alias("n"))


def creates_cycle(edges: DataFrame, proposed: DataFrame) -> DataFrame:
    """GRF4, GRF5: each proposed (src, dst) and whether dst already leads to src."""
    reach = closure(edges, proposed.select(F.col("dst").alias("start")).distinct(), include_start=True).select(F.col("start").alias("dst"), F.col("node").alias("src"), F.lit(True).alias("_c"))
    return proposed.join(reach, ["src", "dst"], "left").select("src", "dst", F.coalesce("_c", F.lit(False)).alias("cycle"))


def simple_paths(edges: DataFrame, start: Column | str, end: str, most: int = 10) -> DataFrame:
    """GRF6: all paths without repeats of at most ``most`` edges, as arrays."""
    rows = edges.where(F.col("src") == start).select(F.array("src", "dst").alias("path"), F.col("dst").alias("at"))
    found = None
    for _ in range(most):
        rows = stored(rows)
        done = rows.where(F.col("at") == F.lit(end)).select("path")
        found = done if found is None else found.unionByName(done)
        if rows.limit(1).count() == 0:
            break
        open_rows = rows.where(F.col("at") != F.lit(end))
        rows = open_rows.join(edges, (open_rows["at"] == edges["src"]) & ~F.array_contains("path", F.col("dst"))).select(F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("at"))
    return found


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GRF8: nodes and edges without those of ``gone`` and the edges at them."""
    left = edges.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti")
    return nodes.join(gone, "node", "left_anti"), left.select("src", "dst")


def merge_bases(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """GRF12, SET6: for each (a, b) the nearest ancestor of b that a has too,
    itself included; edges lead from a commit to its parents. Ties go to the
    smaller node."""
    up = closure(edges, pairs.select(F.col("a").alias("start")).unionByName(pairs.select(F.col("b").alias("start"))).distinct(), include_start=True)
    of_a, of_b = up.select(F.col("start").alias("a"), "node"), up.select(F.col("start").alias("b"), "node", "depth")
    both = pairs.join(of_a, "a").join(of_b, ["b", "node"])
    return both.groupBy("a", "b").agg(F.min(F.struct("depth", "node"))["node"].alias("base"))


def history_stats(commits: DataFrame) -> DataFrame:
    """AGG6: totals, merges, authors, first and last time."""
    return commits.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.size("parents") > 1).alias("merges"), F.count_distinct("author").alias("authors"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """GRF15, GRF17, JN7, SET1: (path, change, size_change) between trees of
    (name, hash, size). Deleted and added entries of equal hash are renames, each
    used once, paired in order of their names. Entries may have a ``kind`` (blob,
    tree, link); one whose kind changed is ``type_changed``."""
    kind = lambda df: F.col("kind") if "kind" in df.columns else F.lit("blob")
    o = old.select("name", F.col("hash").alias("oh"), F.col("size").alias("os"), kind(old).alias("ok"))
    n = new.select("name", F.col("hash").alias("nh"), F.col("size").alias("ns"), kind(new).alias("nk"))
    both = o.join(n, "name", "full_outer")
    turned = F.when(F.col("ok") != F.col("nk"), "type_changed").otherwise("modified")
    kept = both.where("oh IS NOT NULL AND nh IS NOT NULL AND (oh <> nh OR ok <> nk)").select(F.col("name").alias("path"), F.lit(None).cast("string").alias("old_path"), turned.alias("change"), (F.col("ns") - F.col("os")).alias("size_change"))
    gone, come = both.where("nh IS NULL"), both.where("oh IS NULL")
    g = gone.select(F.col("name").alias("gone"), F.col("oh").alias("h"), "os", F.row_number().over(Window.partitionBy("oh").orderBy("name")).alias("k"))
    c = come.select(F.col("name").alias("come"), F.col("nh").alias("h"), "ns", F.row_number().over(Window.partitionBy("nh").orderBy("name")).alias("k"))
    moved = g.join(c, ["h", "k"], "full_outer")
    change = F.when(F.col("gone").isNull(), "added").when(F.col("come").isNull(), "deleted").otherwise("renamed")
    rest = moved.select(F.coalesce("come", "gone").alias("path"), F.when(F.col("come").isNotNull(), F.col("gone")).alias("old_path"), change.alias("change"), (F.coalesce("ns", F.lit(0)) - F.coalesce("os", F.lit(0))).alias("size_change"))
    return kept.unionByName(rest)


def diff_stats(diff: DataFrame) -> DataFrame:
    """AGG7, AGG8: changes by kind and bytes that came and went."""
    kinds = [F.count_if(F.col("change") == k).alias(k) for k in ("added", "deleted", "modified", "renamed")]
    grown = F.when(F.col("change") != "renamed", F.col("size_change"))
    one = diff.agg(*kinds, F.coalesce(F.sum(F.when(grown > 0, grown)), F.lit(0)).alias("insertions"), F.coalesce(F.sum(F.when(grown < 0, -grown)), F.lit(0)).alias("deletions"))
    return one.withColumn("total_changed", F.col("added") + F.col("deleted") + F.col("modified") + F.col("renamed"))


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """GRF18, DQL25: (name, outcome, hash) of a merge by name: the side that
    changed, or the kind of conflict."""
    b = base.select("name", F.col("hash").alias("b"))
    rows = b.join(ours.select("name", F.col("hash").alias("o")), "name", "full_outer").join(theirs.select("name", F.col("hash").alias("t")), "name", "full_outer")
    b, o, t = F.col("b"), F.col("o"), F.col("t")
    outcome = (
        F.when(o.eqNullSafe(t), "clean")
        .when(b.eqNullSafe(o), "theirs")
        .when(b.eqNullSafe(t), "ours")
        .when(b.isNull(), "both_added")
        .when(o.isNull(), "delete_modify")
        .when(t.isNull(), "modify_delete")
        .otherwise("both_modified")
    )
    rows = rows.select("name", outcome.alias("outcome"), "o", "t")
    return rows.select("name", "outcome", F.when(F.col("outcome").isin("clean", "ours"), F.col("o")).when(F.col("outcome") == "theirs", F.col("t")).alias("hash"))


def resolve_refs(names: DataFrame, refs: DataFrame, commits: DataFrame, head: str) -> DataFrame:
    """JN9: names as HEAD, branch, tag, full ref or commit id, in this order."""
    r = refs.select(F.col("ref"), F.col("target"))
    asked = names.withColumn("_n", F.when(F.col("name") == "HEAD", head).otherwise(F.col("name")))
    out = asked
    for i, prefix in enumerate(("refs/heads/", "refs/tags/", "")):
        out = out.join(r.select(F.col("ref").alias(f"_r{i}"), F.col("target").alias(f"_t{i}")), F.concat(F.lit(prefix), F.col("_n")) == F.col(f"_r{i}"), "left")
    out = out.join(commits.select(F.col("id").alias("_c")), F.col("_n") == F.col("_c"), "left")
    return out.select("name", F.coalesce("_t0", "_t1", "_t2", "_c").alias("commit"))


def ahead_behind(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """DQL26, AGG32, GRF13: commits of a that b has not, and of b that a has not."""
    up = stored(closure(edges, pairs.select(F.col("a").alias("start")).unionByName(pairs.select(F.col("b").alias("start"))).distinct(), include_start=True))

    def only(x: str, y: str, name: str) -> DataFrame:
        mine = pairs.join(up.select(F.col("start").alias(x), "node"), x)
        other = up.select(F.col("start").alias(y), "node")
        return mine.join(other, [y, "node"], "left_anti").groupBy("a", "b").agg(F.count(F.lit(1)).alias(name))

    rows = pairs.join(only("a", "b", "ahead"), ["a", "b"], "left").join(only("b", "a", "behind"), ["a", "b"], "left")
    return rows.select("a", "b", F.coalesce("ahead", F.lit(0)).alias("ahead"), F.coalesce("behind", F.lit(0)).alias("behind"))


def commit_filter(author: str | None = None, message: str | None = None, merges: bool | None = None, since: object = None, until: object = None) -> Column:
    """GRF10, FLT17, FLT18: inclusive times, parts of the author and message."""
    out = F.lit(True)
    if author is not None:
        out = out & (F.contains("author", F.lit(author)) | F.contains("email", F.lit(author)))
    if message is not None:
        out = out & F.contains("message", F.lit(message))
    if merges is not None:
        out = out & ((F.size("parents") > 1) == merges)
    if since is not None:
        out = out & (F.col("ts") >= F.lit(since))
    if until is not None:
        out = out & (F.col("ts") <= F.lit(until))
    return out


def history(
    commits: DataFrame,
    start: str | Sequence[str],
    limit: int | None = None,
    sort: str = "bfs",
    stop_at: Sequence[str] = (),
    skip: int = 0,
    first_parent: bool = False,
    **filters: object,
) -> DataFrame:
    """GRF9, SRT7, WIN14: commits by depth and id from one or several starts,
    with their depth and whether the shortest way to them goes by first parents
    alone. Those of ``stop_at`` are left out and not passed. ``first_parent``
    follows no other parents. Filters come first, then ``skip`` and ``limit``,
    then the sort."""
    spark = commits.sparkSession
    starts = [start] if isinstance(start, str) else list(start)
    walked = commits.where(~F.col("id").isin(*stop_at)) if stop_at else commits
    edges = walked.select(F.col("id").alias("src"), F.posexplode("parents").alias("_i", "dst"))
    edges = stored(edges.where("_i = 0") if first_parent else edges)
    begin = spark.createDataFrame([(s, "all") for s in starts], "node string, start string").select(F.col("node").alias("_n"), "start")
    # all starts are one source: a virtual edge leads from it to each
    virtual = begin.select(F.lit("").alias("src"), F.lit(0).alias("_i"), F.col("_n").alias("dst"))
    joined = stored(edges.unionByName(virtual))
    one = spark.createDataFrame([("",)], "start string")
    reach = closure(joined.select("src", "dst"), one).select(F.col("node").alias("id"), (F.col("depth") - 1).alias("depth"))
    firsts = closure(joined.where("_i = 0").select("src", "dst"), one).select(F.col("node").alias("id"), (F.col("depth") - 1).alias("_f"))
    rows = walked.join(reach, "id").join(firsts, "id", "left").withColumn("first_parent", F.coalesce(F.col("_f") == F.col("depth"), F.lit(False))).drop("_f")
    rows = rows.where(commit_filter(**filters)).orderBy("depth", "id")
    if skip:
        rows = rows.offset(skip)
    if limit is not None:
        rows = rows.limit(limit)
    order = {"bfs": [F.col("depth"), F.col("id")], "asc": [F.col("ts"), F.col("id")], "desc": [F.desc("ts"), F.col("id")]}[sort]
    return rows.orderBy(*order)


def both_ways(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """SET4: nodes upstream or downstream of each start, once, at the least depth."""
    both = closure(edges, starts, most).unionByName(closure(reverse(edges), starts, most))
    return both.groupBy("start", "node").agg(F.min("depth").alias("depth"))


def short_id(commit: Column, length: int = 8) -> Column:
    """CNT11: the first characters of an id."""
    return F.left(commit, F.lit(length))


def summary(message: Column) -> Column:
    """CNT11: the first line of a message."""
    return F.substring_index(message, "\n", 1)
