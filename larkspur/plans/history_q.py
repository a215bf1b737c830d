"""Queries of histories with options, changed types, removal and both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import graph as G
from larkspur.session import table

from .catalog import query
from .graph_q import _COMMITS, _NET, _TREES, _commits, _net, _trees

_WALK = f"""WITH RECURSIVE {_COMMITS}, steps AS (SELECT id AS src, unnest(parents) AS dst, unnest(range(len(parents))) AS i FROM commits WHERE id <> '5.1'),
 c(id, depth) AS (SELECT unnest(['5.3', '10.2']), 0 UNION SELECT dst, depth + 1 FROM c JOIN steps ON src = id), f(id, depth) AS (SELECT unnest(['5.3', '10.2']), 0 UNION SELECT dst, depth + 1 FROM f JOIN steps ON src = id AND i = 0),
 d AS (SELECT id, min(depth)::INT AS depth FROM c WHERE id IN (SELECT id FROM commits) AND id <> '5.1' GROUP BY id), g AS (SELECT id, min(depth) AS depth FROM f GROUP BY id)"""


@query(_WALK + " SELECT d.id, d.depth, coalesce(g.depth = d.depth, false) AS first_parent FROM d LEFT JOIN g USING (id) ORDER BY d.depth, d.id OFFSET 1")
def history_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF9, WIN14: two starts, a boundary and a skip."""
    return G.history(_commits(spark, sf_dir), ["5.3", "10.2"], stop_at=["5.1"], skip=1).select("id", "depth", "first_parent")


@query(f"WITH RECURSIVE {_COMMITS}, c(id, depth) AS (SELECT '5.3', 0 UNION SELECT (SELECT parents[1] FROM commits k WHERE k.id = c.id), depth + 1 FROM c WHERE (SELECT len(parents) FROM commits k WHERE k.id = c.id) > 0) SELECT id, depth::INT AS depth FROM c WHERE id IN (SELECT id FROM commits)")
def history_first_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF9: first parents only."""
    return G.history(_commits(spark, sf_dir), "5.3", first_parent=True).select("id", "depth")


@query(f"WITH {_COMMITS} SELECT id FROM commits WHERE contains(author, 'ser')")
def commits_by_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT18: a part of the name or the address, in its case."""
    return _commits(spark, sf_dir).where(G.commit_filter(author="ser")).select("id")


@query(f"WITH RECURSIVE {_COMMITS}, c(start, id) AS (SELECT id, id FROM commits WHERE id LIKE '%.2' UNION SELECT start, dst FROM c JOIN up ON src = id) SELECT start, count(*)::BIGINT AS ancestors FROM c GROUP BY start")
def commit_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF11: ancestors with the commit itself, of every third turn."""
    commits = _commits(spark, sf_dir)
    edges = G.stored(commits.select(F.col("id").alias("src"), F.explode("parents").alias("dst")))
    found = G.closure(edges, commits.where(F.endswith("id", F.lit(".2"))).select(F.col("id").alias("start")), include_start=True)
    return found.groupBy("start").agg(F.count(F.lit(1)).alias("ancestors"))


@query(f"WITH {_COMMITS} SELECT id AS node, 'root' AS kind FROM commits WHERE len(parents) = 0 UNION ALL SELECT id, 'leaf' FROM commits WHERE id NOT IN (SELECT dst FROM up)")
def commit_roots_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF14: commits without parents, and without children."""
    commits = _commits(spark, sf_dir)
    edges = commits.select(F.explode("parents").alias("src"), F.col("id").alias("dst"))
    nodes = commits.select(F.col("id").alias("node"))
    return G.roots(nodes, edges).withColumn("kind", F.lit("root")).unionByName(G.leaves(nodes, edges).withColumn("kind", F.lit("leaf")))


@query(f"WITH {_NET} SELECT src, dst FROM net WHERE src NOT IN ('p3', 'p7') AND dst NOT IN ('p3', 'p7')")
def lineage_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF8: the edges that are left without two nodes."""
    net = _net(spark)
    gone = spark.createDataFrame([("p3",), ("p7",)], "node string")
    nodes = net.select(F.col("src").alias("node")).unionByName(net.select(F.col("dst").alias("node"))).distinct()
    return G.remove_nodes(nodes, net, gone)[1]


@query(f"WITH RECURSIVE {_NET}, d(node, depth) AS (SELECT 'p6', 0 UNION SELECT dst, depth + 1 FROM d JOIN net ON src = node WHERE depth < 13), u(node, depth) AS (SELECT 'p6', 0 UNION SELECT src, depth + 1 FROM u JOIN net ON dst = node WHERE depth < 13) SELECT 'p6' AS start, node, min(depth)::INT AS depth FROM (FROM d UNION ALL FROM u) WHERE node <> 'p6' GROUP BY node")
def lineage_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET4: upstream and downstream together."""
    return G.both_ways(_net(spark), spark.createDataFrame([("p6",)], "start string"))


@query(f"WITH {_TREES} SELECT n.name AS path, CASE WHEN n.size % 7 = 0 THEN 'type_changed' ELSE 'modified' END AS change, n.size - o.size AS size_change FROM old o JOIN new n USING (name) WHERE o.hash <> n.hash OR n.size % 7 = 0")
def tree_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF15: entries whose kind changed among those that stay."""
    old, new = _trees(spark, sf_dir)
    new = new.withColumn("kind", F.when(F.col("size") % 7 == 0, "link").otherwise("blob"))
    diff = G.tree_diff(old.withColumn("kind", F.lit("blob")), new)
    return diff.where("change IN ('modified', 'type_changed')").select("path", "change", "size_change")


@query("SELECT conv_id || '.' || turn AS id, left(sha256(conv_id || '.' || turn), 8) AS short_id, split_part(text, chr(10), 1) AS summary FROM conversations")
def commit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CNT11: the short id and the first line of a message."""
    name = F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return table(spark, sf_dir, "conversations").select(name.alias("id"), G.short_id(F.sha2(name, 256)).alias("short_id"), G.summary(F.col("text")).alias("summary"))
