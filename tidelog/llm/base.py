"""Shared plumbing of the training-data operators: durable intermediates, connected components, Arrow helpers.

Intermediates are Parquet tables in the folder all executors share (``spark.checkpoint.dir``), so that a lost
executor never costs more than the tasks it was running.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a numpy kernel handles at once; longer single documents are handled whole, alone.
SLICE_BYTES = 1 << 19
#: Bytes that reach a Python worker at once (one longer row comes alone).
BATCH_BYTES = 1 << 23

#: Edges that a file of a component round holds, about.
EDGES = 100_000

_made: list[tuple] = []
#: Paths that the innermost function wrapped by stored() has made so far.
_scope: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scope", default=None)


def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """From now on the session hands at most `size` bytes at once to Python workers: rows hold texts or blocks here."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= size:
        spark.conf.set(key, str(size))


def lean(run):
    """A map over Arrow batches that gives freed memory back when a task ends: its worker lives on for other tasks."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


@contextlib.contextmanager
def wide_rows(spark: SparkSession, rows: int = 32):
    """While it lasts, the Parquet reader takes `rows` rows at once: for tables whose rows hold whole blocks."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextlib.contextmanager
def swept_shuffles(spark: SparkSession):
    """While it lasts, a query's shuffle files are deleted when it ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stable(df: DataFrame, name: str) -> DataFrame:
    """df, stored first if its plan moves rows: what is read twice then has the same rows in the same order."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return materialize(df, name) if any(x in plan for x in ("Exchange", "Limit", "Sample")) else df


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _sweep() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone; its folder is then the cluster's to clean
            pass


def materialize(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    wide: rows hold whole blocks, so row groups are made smaller.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidelog/{name}-{uuid.uuid4().hex}"
    out = df.write.option("parquet.block.size", 16 << 20).option("parquet.enable.dictionary", "false") if wide else df.write
    out.parquet(path)
    if (scope := _scope.get()) is not None:
        scope.append(path)
    if not _made:
        atexit.register(_sweep)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths) -> None:
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch(f):
    """For a function whose result needs none of the tables that it materializes: they are deleted when it ends."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        made: list[str] = []
        token, spark = _scope.set(made), SparkSession.active()
        try:
            return f(*args, **kwargs)
        finally:
            _scope.reset(token)
            _delete(spark, made)

    return run


def stored(name: str):
    """For a function that gives a DataFrame: its result is materialized, and all that it materialized itself deleted."""

    def wrap(f):
        @functools.wraps(f)
        def run(*args, **kwargs):
            made: list[str] = []
            outer, token = _scope.get(), _scope.set(made)
            out, spark = None, SparkSession.active()
            try:
                out = materialize(f(*args, **kwargs), name)
            finally:
                _scope.reset(token)
                _delete(spark, made[:-1] if out is not None else made)
            if outer is not None:
                outer.append(made[-1])
            return out

        return run

    return wrap


@stored("parts")
def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (u, v): a stored table (node, component), component the least node.

    Alternates large-star and small-star steps until the edges are stars around the least nodes, however many rounds
    that takes. Each step is a map-side-combined minimum and a join that adaptive execution may split, so hub nodes do
    not gather in a task. Self-loops keep isolated nodes; nulls and repeated edges are dropped. An empty input gives an
    empty result.
    """

    def tidy(e: DataFrame) -> DataFrame:
        return e.where("u is not null and v is not null").select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    # large() gives (u, v) with u > v, as small() needs it
    def large(e: DataFrame) -> DataFrame:
        both = e.where("u <> v").unionByName(e.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small(e: DataFrame) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        hung = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return hung.unionByName(least.select("u", F.col("m").alias("v")))

    def marked(e: DataFrame) -> tuple[DataFrame, dict]:
        """A stored table, with the number of its rows and a sum of their hashes, taken while they are written."""
        seen = Observation()
        out = materialize(e.observe(seen, F.count("*").alias("n"), F.sum(F.expr("cast(xxhash64(u, v) as decimal(38,0))")).alias("h")), "edges")
        return out, seen.get

    now, mark = marked(tidy(edges))
    first, before = now, None
    while mark != before:
        before = mark
        # a round has no more edges than the one before: few edges, few files
        now, mark = marked(tidy(small(large(now).where("u <> v"))).coalesce(1 + mark["n"] // EDGES))
    loops = first.select(F.col("u").alias("node")).unionByName(first.select(F.col("v").alias("node"))).distinct()
    star = now.where("u <> v").groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return loops.join(star, "node", "left").select("node", F.coalesce("component", "node").alias("component")).coalesce(1 + mark["n"] // EDGES)


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, least id of its component) of the pairs u, v of one task."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    least = np.arange(len(ids))
    while True:
        before = least.copy()
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        least = least[least]
        if (least == before).all():
            return ids, ids[least]


def slices(arr: pa.Array | pa.ChunkedArray):
    """(start row, UTF-8 bytes as uint8, int64 offsets from 0) of successive slices of a string column; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    n = len(arr)
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(arr.buffers()[2], np.uint8) if n and arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + SLICE_BYTES, "right")) - 1)
        yield at, data[offs[at]:offs[end]], offs[at:end + 1] - offs[at]
        at = end
