"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from functools import wraps
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that is joined by broadcast at most; larger sides are shuffled.
BROADCAST_ROWS = 200_000
#: Rows of text in an Arrow batch at most.
ARROW_ROWS = 1_000
#: Bytes of an Arrow batch at most, but for one row.
ARROW_BYTES = 4 << 20

#: Seconds between two times that the driver's free native memory is given back.
TRIM_S = 2.0
#: Bytes of texts that a numpy step takes at once, about.
TEXT_BYTES = 1 << 20

Batches = Iterator[pa.RecordBatch]


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or, on a
    local master only, a folder of this machine where that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="larkspur-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: the
    lineage is cut and the rows outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larkspur-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if time.monotonic() - _TRIMMED[0] >= TRIM_S:
        trim_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that ``durable`` wrote and nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/larkspur-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once an application:
    they need not have it installed nor share the driver's folders."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="larkspur-")) / f"{top.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)


def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Make ready for Arrow functions on texts: ship the package and bound the
    rows and the bytes of an Arrow batch, since texts can be long."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def by_bytes(texts: Sequence[str | bytes | None], size: int = TEXT_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, texts as bytes) in groups of about ``size`` bytes."""
    group, held, at = [], 0, 0
    for i, t in enumerate(texts):
        b = t if isinstance(t, bytes) else (t or "").encode()
        group.append(b)
        held += len(b)
        if held >= size:
            yield at, group
            group, held, at = [], 0, i + 1
    if group:
        yield at, group


def thrifty(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` of batches in a worker that is used again: after it, what it no
    longer needs is the machine's again."""

    @wraps(run)
    def task(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def frugal(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The same of a ``run`` without tokenizers: those that earlier tasks of
    other stages left in the worker are dropped first."""

    @wraps(run)
    def task(batches: Batches) -> Batches:
        drop_encoders()
        yield from run(batches)

    return thrifty(task)


def drop_encoders() -> None:
    """Free the tokenizers of this process, if any."""
    module = sys.modules.get(f"{__package__}.tokens")
    if module is not None and module.ENCODERS:
        module.ENCODERS.clear()
        give_back()


def sweep(spark: SparkSession) -> None:
    """Collect the driver's garbage, upon which Spark's cleaner deletes the
    shuffles and broadcasts of finished work on all executors, and the driver's
    memory is the machine's again. For between steps of many jobs."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim_driver(spark)
    give_back()


_TRIMMED = [0.0]


def trim_driver(spark: SparkSession) -> None:
    """What the driver's JVM has freed of its native memory is the machine's
    again, where the JVM can do it (Linux, Java 17.0.9 or later). Each of a driver's
    hundreds of threads allocates apart, so what libc keeps of plans that were
    compiled and of jobs that ran grows with their number, beside the heap."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    _TRIMMED[0] = time.monotonic()
    # the server's own class is closed to Py4J, its interface is not
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    args = context._gateway.new_array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:
        pass


def give_back() -> None:
    """Free memory of this process is the machine's again, where libc can do it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def join_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a table that is usually small: broadcast once its rows are counted
    and within ``limit``, else a shuffled join whose skew Spark splits."""
    few = small.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(small) if few else small.hint("merge"), on, how)


def id_bucket(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id gives 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus, F.lit(0))


def source_rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
