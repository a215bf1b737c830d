"""Queries of lineage, history and tree differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import graph as G
from larkspur.session import table

from .catalog import query

# Lineage: region -> nation -> customer, and order -> customer's orders by priority class.
_EDGES = """edges AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
 UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""
_NODES = "nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    n = table(spark, sf_dir, "nation").select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"))
    c = table(spark, sf_dir, "customer").select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst"))
    o = table(spark, sf_dir, "orders").select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"))
    return n.unionByName(c).unionByName(o)


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def _regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"r{i}",) for i in range(5)], "start string")


_DOWN = f"WITH RECURSIVE {_EDGES}, c(start, node, depth) AS (SELECT src, dst, 1 FROM edges WHERE src LIKE 'r%' UNION SELECT start, dst, depth + 1 FROM c JOIN edges ON node = src)"


@query(_DOWN + " SELECT start, left(node, 1) AS kind, depth, count(*)::BIGINT AS n FROM (SELECT start, node, min(depth)::INT AS depth FROM c GROUP BY ALL) GROUP BY ALL")
def lineage_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF2, GRF21: what stands downstream of each region."""
    down = G.closure(_edges(spark, sf_dir), _regions(spark))
    return down.groupBy("start", F.left("node", F.lit(1)).alias("kind"), "depth").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH RECURSIVE {_EDGES}, c(start, node, depth) AS (SELECT dst, src, 1 FROM edges WHERE dst LIKE 'o%' UNION ALL SELECT start, src, depth + 1 FROM c JOIN edges ON node = dst) SELECT node, count(*)::BIGINT AS n FROM c WHERE depth = 3 GROUP BY node")
def lineage_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF1, DQL16: regions three steps above orders, and their orders."""
    edges = G.stored(_edges(spark, sf_dir))
    starts = edges.where("dst LIKE 'o%'").select(F.col("dst").alias("start"))
    return G.closure(G.reverse(edges), starts).where("depth = 3").groupBy("node").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_EDGES}, {_NODES} SELECT 'root' AS kind, node FROM nodes WHERE node NOT IN (SELECT dst FROM edges) UNION ALL SELECT 'leaf', node FROM nodes WHERE node NOT IN (SELECT src FROM edges)")
def lineage_roots_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF7, AGG31."""
    edges = _edges(spark, sf_dir)
    nodes = _nodes(edges)
    return G.roots(nodes, edges).select(F.lit("root").alias("kind"), "node").unionByName(G.leaves(nodes, edges).select(F.lit("leaf").alias("kind"), "node"))


@query(_DOWN + " SELECT start, CASE left(node, 1) WHEN 'n' THEN 'nation' WHEN 'c' THEN 'customer' ELSE 'order' END AS node_type, count(DISTINCT node)::BIGINT AS n FROM c GROUP BY ALL")
def lineage_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG30, DQL27."""
    edges = G.stored(_edges(spark, sf_dir))
    kind = F.left("node", F.lit(1))
    nodes = _nodes(edges).withColumn("node_type", F.when(kind == "n", "nation").when(kind == "c", "customer").when(kind == "r", "region").otherwise("order"))
    return G.impact(edges, _regions(spark), nodes)


_NET = "net(src, dst) AS (SELECT 'p' || i, 'p' || (i + s) FROM range(1, 13) t(i), (VALUES (1), (2), (5)) v(s) WHERE i + s <= 13)"


def _net(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"p{i}", f"p{i + s}") for i in range(1, 13) for s in (1, 2, 5) if i + s <= 13], "src string, dst string")


@query(f"WITH RECURSIVE {_NET}, p(path, fin) AS (SELECT [src, dst], dst FROM net WHERE src = 'p1' UNION ALL SELECT list_append(path, dst), dst FROM p JOIN net ON src = fin WHERE fin <> 'p13' AND NOT list_contains(path, dst) AND len(path) <= 6) SELECT array_to_string(path, '>') AS path, (len(path) - 1)::INT AS edges FROM p WHERE fin = 'p13' AND len(path) <= 7")
def lineage_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF6: simple paths of at most six edges."""
    found = G.simple_paths(_net(spark), "p1", "p13", 6)
    return found.select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("edges"))


@query("SELECT * FROM (VALUES ('p13', 'p1', true), ('p1', 'p13', false), ('p3', 'p3', true), ('p5', 'p4', true)) t(src, dst, cycle)")
def lineage_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF4, GRF5."""
    proposed = spark.createDataFrame([("p13", "p1"), ("p1", "p13"), ("p3", "p3"), ("p5", "p4")], "src string, dst string")
    return G.creates_cycle(_net(spark), proposed)


_COMMITS = """commits AS (SELECT conv_id || '.' || turn AS id, list_filter([CASE WHEN turn > 0 THEN conv_id || '.' || (turn - 1) END, CASE WHEN turn = 2 AND conv_id % 5 = 0 THEN (conv_id + 1) || '.0' END], lambda x: x IS NOT NULL) AS parents, role AS author, TIMESTAMP '2024-01-01' + to_days((conv_id * 10 + turn)::INT) AS ts FROM conversations),
 up AS (SELECT id AS src, unnest(parents) AS dst FROM commits)"""


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    name = lambda a, b: F.concat_ws(".", a.cast("string"), b.cast("string"))
    parents = F.array_compact(F.array(F.when(t > 0, name(c, t - 1)), F.when((t == 2) & (c % 5 == 0), F.concat((c + 1).cast("string"), F.lit(".0")))))
    ts = F.date_add(F.lit("2024-01-01").cast("date"), (c * 10 + t).cast("int")).cast("timestamp_ntz")
    return table(spark, sf_dir, "conversations").select(name(c, t).alias("id"), parents.alias("parents"), F.col("role").alias("author"), F.lit("").alias("email"), F.lit("").alias("message"), ts.alias("ts"))


@query(f"WITH RECURSIVE {_COMMITS}, c(id, depth) AS (SELECT '5.3', 0 UNION SELECT dst, depth + 1 FROM c JOIN up ON src = id) SELECT id, min(depth)::INT AS depth FROM c WHERE id IN (SELECT id FROM commits) GROUP BY id ORDER BY 2, 1 LIMIT 6")
def history_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF9, GRF10, WIN14, SRT7."""
    return G.history(_commits(spark, sf_dir), "5.3", 6).select("id", "depth")


@query(f"WITH {_COMMITS} SELECT count(*)::BIGINT AS total, count(*) FILTER (len(parents) > 1)::BIGINT AS merges, count(DISTINCT author)::BIGINT AS authors, min(ts) AS first_ts, max(ts) AS last_ts FROM commits")
def history_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG6."""
    return G.history_stats(_commits(spark, sf_dir))


@query(f"WITH {_COMMITS} SELECT author, count(*)::BIGINT AS n FROM commits GROUP BY author ORDER BY n DESC, author LIMIT 10")
def top_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT6."""
    return _commits(spark, sf_dir).groupBy("author").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "author").limit(10)


@query(f"""WITH RECURSIVE {_COMMITS}, a(id, depth) AS (SELECT '5.3', 0 UNION SELECT dst, depth + 1 FROM a JOIN up ON src = id), b(id, depth) AS (SELECT '6.2', 0 UNION SELECT dst, depth + 1 FROM b JOIN up ON src = id)
SELECT '5.3' AS a, '6.2' AS b, arg_min(id, depth) AS base, (SELECT count(DISTINCT id) FROM a WHERE id NOT IN (SELECT id FROM b))::BIGINT AS ahead, (SELECT count(DISTINCT id) FROM b WHERE id NOT IN (SELECT id FROM a))::BIGINT AS behind FROM b WHERE id IN (SELECT id FROM a)""")
def merge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF12, GRF13, SET6, AGG32, DQL26."""
    edges = G.stored(_commits(spark, sf_dir).select(F.col("id").alias("src"), F.explode("parents").alias("dst")))
    pairs = spark.createDataFrame([("5.3", "6.2")], "a string, b string")
    return G.merge_bases(edges, pairs).join(G.ahead_behind(edges, pairs), ["a", "b"])


_TREES = """old AS (SELECT 'd' || doc_id AS name, sha256(text) AS hash, n_chars AS size FROM documents WHERE doc_id % 10 <> 1),
 new AS (SELECT CASE WHEN doc_id % 10 = 2 THEN 'moved/' ELSE '' END || 'd' || doc_id AS name, CASE WHEN doc_id % 10 = 4 THEN sha256(text || '!') ELSE sha256(text) END AS hash, n_chars + (doc_id % 10 = 4)::INT AS size FROM documents WHERE doc_id % 10 <> 3)"""


def _trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, m = table(spark, sf_dir, "documents"), F.col("doc_id") % 10
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    old = docs.where(m != 1).select(name.alias("name"), F.sha2("text", 256).alias("hash"), F.col("n_chars").alias("size"))
    new = docs.where(m != 3).select(F.when(m == 2, F.concat(F.lit("moved/"), name)).otherwise(name).alias("name"), F.when(m == 4, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)).alias("hash"), (F.col("n_chars") + (m == 4).cast("int")).alias("size"))
    return old, new


_DIFF = f"""WITH {_TREES}, b AS (SELECT coalesce(o.name, n.name) AS name, o.hash AS oh, n.hash AS nh, o.size AS os, n.size AS ns FROM old o FULL JOIN new n ON o.name = n.name),
 g AS (SELECT name, oh AS h, os, row_number() OVER (PARTITION BY oh ORDER BY name) AS k FROM b WHERE nh IS NULL), c AS (SELECT name, nh AS h, ns, row_number() OVER (PARTITION BY nh ORDER BY name) AS k FROM b WHERE oh IS NULL),
 diff AS (SELECT name AS path, NULL::VARCHAR AS old_path, 'modified' AS change, ns - os AS size_change FROM b WHERE oh <> nh
 UNION ALL SELECT coalesce(c.name, g.name), CASE WHEN c.name IS NOT NULL THEN g.name END, CASE WHEN g.name IS NULL THEN 'added' WHEN c.name IS NULL THEN 'deleted' ELSE 'renamed' END, coalesce(ns, 0) - coalesce(os, 0) FROM g FULL JOIN c ON g.h = c.h AND g.k = c.k)"""


@query(_DIFF + " SELECT path, old_path, change, size_change FROM diff")
def tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF15-GRF17, JN7, SET1, SRT8."""
    return G.tree_diff(*_trees(spark, sf_dir))


@query(_DIFF + " SELECT added, deleted, modified, renamed, insertions, deletions, added + deleted + modified + renamed AS total_changed FROM (SELECT count(*) FILTER (change = 'added')::BIGINT AS added, count(*) FILTER (change = 'deleted')::BIGINT AS deleted, count(*) FILTER (change = 'modified')::BIGINT AS modified, count(*) FILTER (change = 'renamed')::BIGINT AS renamed, coalesce(sum(size_change) FILTER (change <> 'renamed' AND size_change > 0), 0)::BIGINT AS insertions, coalesce(-sum(size_change) FILTER (change <> 'renamed' AND size_change < 0), 0)::BIGINT AS deletions FROM diff)")
def diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG7, AGG8, AGG9."""
    return G.diff_stats(G.tree_diff(*_trees(spark, sf_dir)))


@query(
    """WITH base AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 12 <> 5), o AS (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN h || 'o' ELSE h END AS h FROM base WHERE doc_id % 12 <> 6 UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id % 12 = 5),
 t AS (SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 1) THEN h || 't' ELSE h END AS h FROM base WHERE doc_id % 12 <> 9 UNION ALL SELECT doc_id, 'other' FROM documents WHERE doc_id % 24 = 5)
SELECT d.doc_id::VARCHAR AS name, CASE WHEN o.h IS NOT DISTINCT FROM t.h THEN 'clean' WHEN b.h IS NOT DISTINCT FROM o.h THEN 'theirs' WHEN b.h IS NOT DISTINCT FROM t.h THEN 'ours' WHEN b.h IS NULL THEN 'both_added' WHEN o.h IS NULL THEN 'delete_modify' WHEN t.h IS NULL THEN 'modify_delete' ELSE 'both_modified' END AS outcome
FROM documents d LEFT JOIN base b USING (doc_id) LEFT JOIN o USING (doc_id) LEFT JOIN t USING (doc_id)"""
)
def merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF18, DQL25."""
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    base = docs.where(i % 12 != 5)
    ours = base.where(i % 12 != 6).withColumn("hash", F.when(i % 4 == 1, F.concat("hash", F.lit("o"))).otherwise(F.col("hash"))).unionByName(docs.where(i % 12 == 5).withColumn("hash", F.lit("new")))
    theirs = base.where(i % 12 != 9).withColumn("hash", F.when((i % 6).isin(0, 1), F.concat("hash", F.lit("t"))).otherwise(F.col("hash"))).unionByName(docs.where(i % 24 == 5).withColumn("hash", F.lit("other")))
    named = lambda d: d.select(i.cast("string").alias("name"), "hash")
    return G.three_way(named(base), named(ours), named(theirs)).select("name", "outcome")


@query(f"WITH {_COMMITS} SELECT * FROM (VALUES ('HEAD', '1.2'), ('main', '1.2'), ('v1', '2.1'), ('refs/tags/v1', '2.1'), ('3.0', '3.0'), ('nowhere', NULL)) t(name, \"commit\")")
def ref_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN9, GRF20."""
    refs = spark.createDataFrame([("refs/heads/main", "1.2"), ("refs/tags/v1", "2.1")], "ref string, target string")
    names = spark.createDataFrame([("HEAD",), ("main",), ("v1",), ("refs/tags/v1",), ("3.0",), ("nowhere",)], "name string")
    return G.resolve_refs(names, refs, _commits(spark, sf_dir).select("id"), "main")


@query(f"WITH {_COMMITS} SELECT dst AS id, count(*)::BIGINT AS children FROM up GROUP BY dst")
def commit_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN8, GRF3."""
    return _commits(spark, sf_dir).select(F.explode("parents").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("children"))
