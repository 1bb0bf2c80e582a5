"""Where intermediate tables go, and a few helpers that several operators use."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder that holds this package; executors import it from there.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Rows and bytes of an Arrow batch: whole texts are long, and a batch is held by the executor and by its worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def importable(spark: SparkSession) -> None:
    """Python workers of this session find the package even when only the driver's path names it.

    Where the session says nothing about the size of Arrow batches, BATCH holds.
    """
    for key, value in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{ROOT}:{known}" if known else ROOT


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all machines share; where that is unset a local one, on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = f"{tempfile.gettempdir()}/arborlake-checkpoints-{os.getuid()}"
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_folder(spark)}/arborlake/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stored(df: DataFrame, name: str, like: DataFrame | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it: cuts the lineage and survives lost executors.

    With ``like`` it has as many files at most as tasks_for() says for that table.
    """
    if like is not None:
        df = df.coalesce(tasks_for(like))
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(source: DataFrame, megabytes: int = 64) -> int:
    """How many tasks, and so files, a pass over source should have: one for so many megabytes as stored.

    Twice the session's cores at least. For coalesce(): many small partitions, of the input or of a shuffle,
    then do not make as many small files.
    """
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(2**31 - 1, max(2 * source.sparkSession.sparkContext.defaultParallelism, -(-size // (megabytes << 20))))  # an unknown size is a very large one


def small(table: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A stored table of a few fixed-size columns, to be broadcast if it has so many rows at most; else left to Catalyst."""
    return F.broadcast(table) if table.count() <= rows else table


def joined(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """The inner join on key; right has one row a key, with n, how many of left's rows have it, of ``rows`` in all.

    Keys of over a thousandth of left's rows, of which there are fewer than a thousand, are broadcast, so no
    task gets all rows of a key; the others are left to Catalyst.
    """
    hot = F.broadcast(right.filter(F.col("n") * 1000 > rows))
    rest = left.join(hot.select(key), key, "left_anti").join(right.filter(F.col("n") * 1000 <= rows).drop("n"), key)
    return left.join(hot.drop("n"), key).unionByName(rest)


def give_back() -> None:
    """Gives free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def give_back_driver(spark: SparkSession) -> None:
    """Has the driver's JVM give free native memory back, as that of its compiler's and planner's short-lived threads.

    Only where that JVM offers it (Linux, 17.0.9 or later); elsewhere nothing happens.
    """
    jvm = spark.sparkContext._jvm
    with contextlib.suppress(Py4JError):
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call.invoke(beans, given)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow; at a task's end the worker, which waits for other tasks, gives its free memory back."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def pieces(texts: list[str], limit: int) -> Iterator[slice]:
    """Slices of texts with about limit characters at most, or one text."""
    return slices(map(len, texts), limit)


def slices(sizes: Iterable[int], limit: int) -> Iterator[slice]:
    """Slices of things of these sizes with about limit together at most, or one thing."""
    start = held = i = 0
    for i, size in enumerate(sizes, 1):
        if held and held + size > limit:
            yield slice(start, i - 1)
            start, held = i - 1, 0
        held += size
    if start < i:
        yield slice(start, i)
