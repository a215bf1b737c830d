"""Sources and sinks (SRC1-SRC16, SNK1-SNK5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larkspur.functions.security import name_matches

# Formats and codecs with their file extensions.
FORMATS = {"json": ".json", "jsonl": ".jsonl", "csv": ".csv", "parquet": ".parquet", "avro": ".avro", "arrow": ".arrow", "text": ".txt", "binary": ".bin"}
CODECS = {"none": "", "gzip": ".gz", "zstd": ".zst", "lz4": ".lz4", "snappy": ".snappy", "brotli": ".br"}


def read(spark: SparkSession, path: str, kind: str, schema: StructType | str | None = None) -> DataFrame:
    """SRC1, SRC3: a DataFrame of files of one format. Avro needs Spark's package
    for it; arrow files are read by the executors."""
    r = spark.read if schema is None else spark.read.schema(schema)
    if kind == "json":
        return r.option("multiLine", "true").json(path)
    if kind == "jsonl":
        return r.json(path)
    if kind == "csv":
        return r.option("header", "true").csv(path)
    if kind == "arrow":
        return _read_arrow(spark, path, schema)
    if kind in ("parquet", "text", "avro"):
        return r.format(kind).load(path)
    if kind == "binary":
        return spark.read.format("binaryFile").load(path)
    raise ValueError(f"unknown format {kind!r}")


def _read_arrow(spark: SparkSession, path: str, schema: StructType | str | None) -> DataFrame:
    """Arrow files, one task for each file's bytes; the schema must be given."""
    if schema is None:
        raise ValueError("arrow files need a schema")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for raw in batch.column(0):
                with pa.ipc.open_file(pa.py_buffer(raw.as_py())) as f:
                    for i in range(f.num_record_batches):
                        yield f.get_batch(i)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def write(df: DataFrame, path: str, kind: str = "parquet", codec: str | None = None, by: Sequence[str] = ()) -> None:
    """SRC2, DQL28: files of one format, compressed, in folders by key."""
    w = df.write.mode("overwrite")
    if codec is not None:
        w = w.option("compression", codec)
    if by:
        w = w.partitionBy(*by)
    if kind == "csv":
        w = w.option("header", "true")
    w.format("json" if kind == "jsonl" else kind).save(path)


def import_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """SRC4: (records, errors) of a file of JSON lines. Blank lines are skipped;
    an error has its file, line number from 1, and text."""
    from pyspark.sql.types import StringType, StructField

    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("_id"))
    # a block's lines have consecutive ids, so its first id and the lines of the blocks before it number them
    blocks = raw.groupBy("file", "block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("block")) - F.col("_n")
    blocks = blocks.select("file", "block", "_first", before.alias("_before"))
    lines = raw.where(F.trim("line") != "")
    full = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    marked = StructType([*full.fields, StructField("_bad", StringType())])
    parsed = lines.withColumn("_r", F.from_json("line", marked, {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("_r").isNull() | F.col("_r._bad").isNotNull()
    return parsed.where(~bad).select(*[F.col(f"_r.{f.name}") for f in full.fields]), parsed.where(bad).join(blocks, ["file", "block"]).select("file", (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("number"), "line")


def walk(spark: SparkSession, path: str, include: Sequence[str] = (), exclude: Sequence[str] = (), most_mb: int | None = None, recursive: bool = True) -> DataFrame:
    """SRC5, SRC6, SRC9: files below a folder by name patterns and size (in whole
    megabytes), with their contents; only matching files' bytes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.substring_index("path", "/", -1)
    if include:
        ok = F.lit(False)
        for p in include:
            ok = ok | name_matches(name, p)
        files = files.where(ok)
    for p in exclude:
        files = files.where(~name_matches(name, p))
    return files if most_mb is None else files.where(F.floor(F.col("length") / (1 << 20)) <= most_mb)


def list_keys(store: DataFrame, prefix: str) -> DataFrame:
    """SRC7, SRC10, LIF18: entries of a table keyed by ``key`` under a prefix, less metadata."""
    return store.where(F.startswith("key", F.lit(prefix)) & ~F.endswith("key", F.lit(".meta")))


def put(store: DataFrame, entries: DataFrame) -> DataFrame:
    """SRC7: the table with entries added or replaced by key."""
    return store.join(entries.select("key"), "key", "left_anti").unionByName(entries)


def delete(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys.select("key"), "key", "left_anti")


def rename(store: DataFrame, old: str, new: str) -> DataFrame:
    return store.where(F.col("key") != new).withColumn("key", F.when(F.col("key") == old, new).otherwise(F.col("key")))


def backend_of(key: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """SRC11: the backend of the first rule whose pattern matches the key."""
    out = F.lit(default)
    for pattern, backend in reversed(rules):
        out = F.when(name_matches(key, pattern), backend).otherwise(out)
    return out


def store_stats(store: DataFrame, size: str = "size") -> DataFrame:
    """SRC12."""
    return store.agg(F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def hit_rate(hits: Column, misses: Column) -> Column:
    """SRC14: 0 without any request."""
    return F.coalesce(F.try_divide(hits, hits + misses), F.lit(0.0))


def evict(entries: DataFrame, size: str, used_at: str, budget: int, shard: str | None = None) -> DataFrame:
    """SRC15: the most recently used entries that fit ``budget`` together, for each shard."""
    w = Window.partitionBy(F.col(shard) if shard else F.lit(0)).orderBy(F.desc(used_at), "key")
    return entries.withColumn("_t", F.sum(size).over(w)).where(F.col("_t") <= budget).drop("_t")


def invalidate(entries: DataFrame, prefix: str) -> DataFrame:
    """SRC16."""
    return entries.where(~F.startswith("key", F.lit(prefix)))


def json_lines(df: DataFrame) -> DataFrame:
    """SNK2: one JSON text a row."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def export_json(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """SNK3: one JSON array for each group, in order of the columns."""
    return df.groupBy(*by).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c not in by])))).alias("value"))


def dot(edges: DataFrame) -> DataFrame:
    """SNK4: the lines of a DOT graph."""
    return edges.select(F.concat(F.lit('  "'), "src", F.lit('" -> "'), "dst", F.lit('";')).alias("value"))


def found_any(hits: DataFrame) -> bool:
    """SNK1: the gate of a scan, whether anything was found."""
    return hits.limit(1).count() > 0


def put_within(store: DataFrame, entries: DataFrame, budget: int, size: str = "size") -> DataFrame:
    """SRC8: ``put`` into a store of bounded size; beyond it nothing is put and an
    error is raised. Only a sum comes back."""
    after = put(store, entries)
    used = after.agg(F.sum(size)).first()[0] or 0
    if used > budget:
        raise ValueError(f"quota exceeded: {used} of {budget} bytes")
    return after


def cache_lookups(requests: DataFrame, store: DataFrame, key: str, ts: str, ttl_s: int = 3600, negative_ttl_s: int = 60) -> DataFrame:
    """SRC13: ``outcome`` of each read through a cache: ``hit`` or ``negative_hit``
    within the time to live of the key's last fetch (found or not), else ``miss``
    or ``negative_miss``, which fetch. Hits do not renew an entry. A walk over a
    key's times keeps one time; keys are walked in parallel."""
    there = requests.join(store.select(key).distinct().withColumn("_s", F.lit(True)), key, "left").withColumn("_s", F.coalesce("_s", F.lit(False)))
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    times = there.select(key, "_s", t.alias("_t")).groupBy(key).agg(F.first("_s").alias("_s"), F.sort_array(F.collect_set("_t")).alias("_ts"))
    live = F.when(F.col("_s"), ttl_s).otherwise(negative_ttl_s).cast("long") * 1_000_000
    zero = F.struct(F.lit(None).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fetch = acc["at"].isNull() | (x - acc["at"] >= F.col("_l"))
        return F.when(fetch, F.struct(x.alias("at"), F.array_append(acc["out"], x).alias("out"))).otherwise(acc)

    fetched = times.withColumn("_l", live).select(key, F.explode(F.aggregate("_ts", zero, step, lambda acc: acc["out"])).alias("_t"), F.lit(True).alias("_fetch"))
    rows = there.withColumn("_t", t).join(fetched, [key, "_t"], "left")
    name = F.concat(F.when(F.col("_s"), "").otherwise("negative_"), F.when(F.col("_fetch"), "miss").otherwise("hit"))
    return rows.withColumn("outcome", name).drop("_s", "_t", "_fetch")


def scan_report(hits: DataFrame, by: Sequence[str], path: str, kind: str = "csv") -> bool:
    """SNK1: the entities of each file as a report in files of one format; true if
    anything was found, on which a gate may fail."""
    report = hits.groupBy(*by).agg(F.count(F.lit(1)).alias("entities"))
    write(report, path, kind)
    return found_any(hits)
