"""Reading and writing segment files.

Files are listed and read by Spark (binaryFile), so any file system that Spark knows serves; decoding is one Arrow
map over file contents. A file is at most one segment (256 MiB by convention), the unit of work.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codec

LAYOUT = r"partition-(\d+)/epoch-(\d+)/"


def read(spark: SparkSession, path: str) -> DataFrame:
    """pid, epoch, segment, seq, pos, payload of all valid records below path (partition-N/epoch-N/*.seg)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pid, epoch, name, data in zip(*(b.column(i) for i in range(4))):
                rows, _ = codec.read_segment(data.as_py())
                for at in range(0, len(rows), 10_000):
                    part = rows[at : at + 10_000]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([pid.as_py()] * n, pa.int32()), pa.array([epoch.as_py()] * n, pa.int64()), pa.array([name.as_py()] * n), pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.binary())],
                        ["pid", "epoch", "segment", "seq", "pos", "payload"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.seg").load(path)
    part = lambda i: F.regexp_extract("path", LAYOUT, i)
    src = files.select(part(1).cast("int").alias("pid"), part(2).cast("long").alias("epoch"), F.regexp_extract("path", r"([^/]+)$", 1).alias("segment"), "content")
    return src.mapInArrow(run, "pid int, epoch long, segment string, seq long, pos long, payload binary")


def encode(packed: DataFrame) -> DataFrame:
    """pid, epoch, seg, content: segment files of records (pid, epoch, seg, seq, payload), for a binary sink."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        data = codec.write_segment([bytes(p) for p in pdf["payload"]], int(pdf["seq"].iloc[0]))
        return pd.DataFrame({"pid": [pdf["pid"].iloc[0]], "epoch": [pdf["epoch"].iloc[0]], "seg": [pdf["seg"].iloc[0]], "content": [data]})

    return packed.where("seg is not null").groupBy("pid", "epoch", "seg").applyInPandas(run, "pid int, epoch long, seg long, content binary")


def read_offset_journal(spark: SparkSession, path: str) -> DataFrame:
    """topic, grp, pid, off, commit_order from journal files; the order is that of file names, then of entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0), b.column(1)):
                rows = list(codec.read_offsets(data.as_py()))
                cols = [*zip(*rows)] or [[], [], [], []]
                order = [f"{name.as_py()}:{i:012d}" for i in range(len(rows))]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(order, pa.string())], ["topic", "grp", "pid", "off", "commit_order"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wal").load(path)
    return files.select("path", "content").mapInArrow(run, "topic string, grp string, pid int, off long, commit_order string")
