"""Graphs, records, events, access and streams on small tables."""

from pyspark.sql import functions as F

from larkspur.operators import access as X
from larkspur.operators import events as E
from larkspur.operators import graph as G
from larkspur.operators import handlers as H
from larkspur.operators import privacy as P
from larkspur.operators import records as R
from larkspur.plans import catalog
from larkspur.sources import formats as S
from larkspur.streaming import stateful as T

CHAIN = [("source1", "dataset1"), ("dataset1", "dataset2"), ("dataset2", "model1"), ("model1", "output1")]


def test_lineage_chain(spark):
    edges = spark.createDataFrame(CHAIN, "src string, dst string")
    start = lambda n: spark.createDataFrame([(n,)], "start string")
    assert G.closure(G.reverse(edges), start("model1")).count() == 3
    assert G.closure(edges, start("source1")).count() == 4
    nodes = spark.createDataFrame([(n,) for n in {x for e in CHAIN for x in e}], "node string")
    assert [r[0] for r in G.roots(nodes, edges).collect()] == ["source1"]
    assert [r[0] for r in G.leaves(nodes, edges).collect()] == ["output1"]
    loop = edges.unionByName(spark.createDataFrame([("output1", "source1")], "src string, dst string"))
    assert G.closure(loop, start("source1")).count() == 4


def test_long_chains_are_followed_to_their_end(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        edges = G.stored(spark.createDataFrame([(i, i + 1) for i in range(104)], "src int, dst int").coalesce(1))
        assert G.closure(edges, spark.createDataFrame([(0,)], "start int"), most=3).count() == 3
        assert G.creates_cycle(edges, spark.createDataFrame([(104, 0)], "src int, dst int")).first()["cycle"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_diff_of_the_basic_trees(spark):
    old = spark.createDataFrame([("same", "h1", 100), ("mod", "h2", 200), ("del", "h3", 300), ("old", "h4", 400)], "name string, hash string, size int")
    new = spark.createDataFrame([("same", "h1", 100), ("mod", "h2b", 250), ("new", "h4", 400), ("add", "h5", 150)], "name string, hash string, size int")
    d = G.tree_diff(old, new)
    assert {(r["path"], r["change"], r["size_change"]) for r in d.collect()} == {("mod", "modified", 50), ("del", "deleted", -300), ("new", "renamed", 0), ("add", "added", 150)}
    s = G.diff_stats(d).first()
    assert (s["insertions"], s["deletions"], s["total_changed"]) == (200, 300, 4)


def test_many_subscriptions_and_handlers_all_match(spark, monkeypatch):
    events = spark.createDataFrame([(1, "a", 7), (2, "b", 8), (3, None, 7), (4, "a", None)], "id int, kind string, who int")
    rows = [(1, ["a", "a", "b"], None), (2, None, 7), (3, ["a"], 7), (4, None, None), (5, ["c", None], 8), (6, ["b"], 7), (7, [], None)]
    subs = spark.createDataFrame(rows, "sub int, types array<string>, sub_user int")
    for as_coded in (True, False):
        few = E.subscriptions(events, subs, "kind", "who", as_coded).select("id", "sub").collect()
        with monkeypatch.context() as m:
            m.setattr(E, "BROADCAST_ROWS", 3)
            many = E.subscriptions(events, subs, "kind", "who", as_coded).select("id", "sub").collect()
        assert sorted(few) == sorted(many) and len(set(few)) == len(few) > 0
    wide = spark.range(100_001).select(F.col("id").alias("sub"), F.array(F.lit("a")).alias("types"), F.lit(7).alias("sub_user"))
    assert E.subscriptions(events, wide, "kind", "who").count() == 100_001
    on = spark.range(10_001).select(F.lit("a").alias("event_type"), F.col("id").cast("string").alias("name"), F.lit(1).alias("priority"), F.lit(True).alias("enabled"))
    assert {len(r["chain"].split(">")) for r in H.chains(events, on, "id", "kind").collect()} == {10_001}


def test_history_limit_comes_before_the_sort(spark):
    commits = spark.createDataFrame([("c1", [], "a", "", "", 1), ("c2", ["c1"], "a", "", "", 2), ("c3", ["c2"], "a", "", "", 3)], "id string, parents array<string>, author string, email string, message string, ts int")
    assert [r["id"] for r in G.history(commits, "c3", 10).collect()] == ["c3", "c2", "c1"]
    assert [r["id"] for r in G.history(commits, "c3", 2, "asc").collect()] == ["c2", "c3"]


def test_budget_and_entropy(spark):
    rows = spark.createDataFrame([("u", i, 1.0) for i in range(3)], "u string, i int, e double")
    costs = [round(r["cost"], 6) for r in P.budget(rows, "u", "i", "e", 100.0).orderBy("i").collect()]
    assert costs == [4.798526, 6.786140, 8.311291]
    df = spark.createDataFrame([("abcdabcd",), ("aaaa",), ("",)], "t string")
    assert [r[0] for r in df.select(P.entropy(F.col("t"))).collect()] == [2.0, 0.0, 0.0]


def test_optimistic_update_and_paging(spark):
    cur = spark.createDataFrame([(1, 2), (2, 5)], "id int, version int")
    up = spark.createDataFrame([(1, 2), (2, 4), (3, 1)], "id int, expected_version int")
    assert [r["outcome"] for r in R.optimistic_update(cur, up, "id").orderBy("id").collect()] == ["ok", "conflict", "missing"]
    assert R.page(spark.range(300), [F.col("id")], 2, 150).count() == 100
    assert R.numbered(spark.range(5, 1000), "id").where("_place <> id - 4").count() == 0


def test_chain_is_verified(spark):
    rows = spark.createDataFrame([("a", i, f"e{i}") for i in range(5)], "c string, seq int, kind string")
    chain = E.build_chain(rows, "c", "seq", ["kind"])
    assert E.verify_chain(chain, "c", "seq", ["kind"]).first()["first_bad"] is None
    bad = chain.withColumn("kind", F.when(F.col("seq") == 3, "x").otherwise(F.col("kind")))
    assert E.verify_chain(bad, "c", "seq", ["kind"]).first()["first_bad"] == 3
    cut = chain.where("seq >= 2")
    assert E.verify_chain(cut, "c", "seq", ["kind"]).first()["first_bad"] == 2


def test_abac_missing_attribute_is_false(spark):
    df = spark.createDataFrame([({"role": "admin", "level": "5"},), ({},)], "a map<string,string>")
    rows = df.select(X.rule({"attr": "role", "op": "ne", "value": "user"}, F.col("a")), X.rule({"all": []}, F.col("a")), X.compare(F.col("a")["level"], "ge", 5)).collect()
    assert [tuple(r) for r in rows] == [(True, True, True), (False, True, False)]


def test_jsonl_import(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    good, bad = S.import_jsonl(spark, str(tmp_path / "x.jsonl"), "a int")
    assert sorted(r["a"] for r in good.collect()) == [1, 2]
    assert [(r["number"], r["line"]) for r in bad.select("number", "line").collect()] == [(3, "not json")]


def test_walk_and_formats(spark, tmp_path):
    for name in ("a.txt", "b.log", "c.txt"):
        (tmp_path / name).write_text(name)
    assert S.walk(spark, str(tmp_path), ["*.txt"], ["c*"]).count() == 1
    for kind in ("parquet", "jsonl", "csv"):
        S.write(spark.range(3), str(tmp_path / kind), kind)
        assert S.read(spark, str(tmp_path / kind), kind, "id long").count() == 3


def test_token_bucket_batch_and_stream_agree(spark, tmp_path):
    rows = [("u", i, f"2024-01-01 00:00:0{i}") for i in range(6)]
    df = spark.createDataFrame(rows, "u string, i int, t string").withColumn("t", F.col("t").cast("timestamp"))
    want = {r["i"]: r["allowed"] for r in E.token_bucket(df, "u", "t", "i", 2.0, 0.5).collect()}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    T.run_available(T.token_bucket_stream(stream, "u", "t", "i", 2.0, 0.5), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r["event_id"]: r["allowed"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want


def test_whole_tables_are_chained_updated_and_traced(spark):
    sf, q = "/root/testdata/sf0.001", catalog.QUERIES
    rows = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    assert q["audit_chain_build"](spark, sf).count() == rows("events").count()
    assert q["optimistic_update"](spark, sf).count() == rows("orders").count()
    leaves = q["lineage_roots_leaves"](spark, sf).where("kind = 'leaf' AND node LIKE 'o%'")
    assert leaves.count() == rows("orders").count()
