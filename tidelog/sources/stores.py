"""Tables in the place of small state files: committed offsets, epoch metadata and fences.

Versions are folders that are never changed once Spark has marked them complete, so readers see the newest whole one
and a writer that dies leaves nothing that counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import offsets as O
from . import codec


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions below path, in order."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("version=")]
    return sorted(int(p.getName().split("=")[1]) for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def put(df: DataFrame, path: str) -> int:
    """Writes df as the next version of the table at path; gives its number."""
    made = _versions(df.sparkSession, path)
    number = made[-1] + 1 if made else 0
    df.write.mode("overwrite").parquet(f"{path}/version={number}")
    return number


def get(spark: SparkSession, path: str, number: int | None = None) -> DataFrame | None:
    """A version of the table, the newest complete one unless named; None where there is none."""
    made = _versions(spark, path)
    if not made or number is not None and number not in made:
        return None
    return spark.read.parquet(f"{path}/version={made[-1] if number is None else number}")


class OffsetStore:
    """Committed offsets (topic, grp, pid, off) as an append-only table of commits."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def commit(self, commits: DataFrame) -> None:
        """Appends commits (topic, grp, pid, off, commit_order)."""
        commits.select(*O.KEY, "off", "commit_order").write.mode("append").parquet(self.path)

    def committed(self) -> DataFrame:
        return O.committed(self.spark.read.schema("topic string, grp string, pid int, off long, commit_order long").parquet(self.path))

    def compact(self, to: str) -> OffsetStore:
        """A store elsewhere that holds the last commit of each key only."""
        last = self.spark.read.parquet(self.path).groupBy(*O.KEY).agg(F.max_by("off", "commit_order").alias("off"), F.max("commit_order").alias("commit_order"))
        store = OffsetStore(self.spark, to)
        store.commit(last)
        return store


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """pid, config_version, epoch, start_seq, end_seq, ack_quorum, storage_nodes, tie_breaker from files N.meta."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"pid": pid.as_py(), "config_version": version, **e} for pid, data in zip(b.column(0), b.column(1)) for version, epochs in [codec.read_metadata(data.as_py())] for e in epochs]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(n, t) for n, t in _METADATA]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.meta").load(path)
    named = files.select(F.regexp_extract("path", r"(\d+)\.meta$", 1).cast("int").alias("pid"), "content")
    return named.mapInArrow(run, "pid int, config_version long, epoch long, start_seq long, end_seq long, ack_quorum int, storage_nodes array<int>, tie_breaker long")


_METADATA = [("pid", pa.int32()), ("config_version", pa.int64()), ("epoch", pa.int64()), ("start_seq", pa.int64()), ("end_seq", pa.int64()), ("ack_quorum", pa.int32()), ("storage_nodes", pa.list_(pa.int32())), ("tie_breaker", pa.int64())]


def read_fences(spark: SparkSession, path: str) -> DataFrame:
    """pid, epoch, sealed_end, last, sealed from files partition-N/epoch-N.fence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [codec.read_fence(data.as_py()) for data in b.column(2)]
            cols = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_())], ["pid", "epoch", "sealed_end", "last", "sealed"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.fence").load(path)
    part = lambda i, kind: F.regexp_extract("path", r"partition-(\d+)/epoch-(\d+)\.fence$", i).cast(kind)
    return files.select(part(1, "int").alias("pid"), part(2, "long").alias("epoch"), "content").mapInArrow(run, "pid int, epoch long, sealed_end long, last long, sealed boolean")
