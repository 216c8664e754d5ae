"""Physical layout as data: segments, dense and sparse indexes, recovery prefixes, retention."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def pack_segments(log: DataFrame, capacity: int) -> DataFrame:
    """Next-fit packing of each (pid, epoch)'s records, in order, into segments of `capacity` bytes: adds seg (from 0).

    A record larger than an empty segment cannot be stored and gets no segment (null). An epoch is one ordered fold over
    its sizes: sorted, a batch at a time, with two numbers carried on.
    """

    def fold(frames):
        of, seg, used = None, 0, C.HEADER_BYTES
        for pdf in frames:
            out = []
            for pid, epoch, size in zip(pdf["pid"].tolist(), pdf["epoch"].tolist(), pdf["bytes"].tolist()):
                if (pid, epoch) != of:
                    of, seg, used = (pid, epoch), 0, C.HEADER_BYTES
                if size + C.HEADER_BYTES > capacity:
                    out.append(None)
                    continue
                if used + size > capacity:
                    seg, used = seg + 1, C.HEADER_BYTES
                used += size
                out.append(seg)
            yield pdf.assign(seg=pd.array(out, dtype="Int64"))

    sized = log.select("pid", "epoch", "seq", C.record_bytes(F.col("payload")).alias("bytes"))
    return sized.repartition("pid", "epoch").sortWithinPartitions("pid", "epoch", "seq").mapInPandas(fold, "pid int, epoch long, seq long, bytes long, seg long")


def segment_stats(packed: DataFrame) -> DataFrame:
    return packed.where("seg is not null").groupBy("pid", "epoch", "seg").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n"), (F.sum("bytes") + C.HEADER_BYTES).alias("bytes"))


def segment_lookup(wanted: DataFrame, stats: DataFrame) -> DataFrame:
    """Segment of each (pid, epoch, seq): a range join that an equality on (pid, epoch) bounds."""
    s = stats.select("pid", "epoch", "seg", "first_seq", "last_seq")
    return wanted.join(s, ["pid", "epoch"]).where("seq between first_seq and last_seq").select("pid", "epoch", "seq", "seg")


def dense_index(packed: DataFrame) -> DataFrame:
    """pid, epoch, seg, seq, idx, pos: place and byte position of every record in its segment, from pack_segments' rows."""
    w = Window.partitionBy("pid", "epoch", "seg").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    pos = (F.coalesce(F.sum("bytes").over(before), F.lit(0)) + C.HEADER_BYTES).cast("long")
    return packed.where("seg is not null").select("pid", "epoch", "seg", "seq", (F.row_number().over(w) - 1).cast("long").alias("idx"), pos.alias("pos"))


def sparse_hints(index: DataFrame, stride: int = C.HINT_STRIDE) -> DataFrame:
    """The positions of every stride-th record of a segment, its first included."""
    return index.where(F.col("idx") % stride == 0)


def hint_lookup(wanted: DataFrame, hints: DataFrame, stride: int = C.HINT_STRIDE) -> DataFrame:
    """The hint at or before each wanted record (pid, epoch, seg, seq, idx), and how many records are walked from it."""
    h = hints.select("pid", "epoch", "seg", F.col("seq").alias("hint_seq"), F.col("idx").alias("hint_idx"), F.col("pos").alias("hint_pos"))
    w = wanted.withColumn("hint_idx", F.col("idx") - F.col("idx") % stride)
    return w.join(h, ["pid", "epoch", "seg", "hint_idx"]).select("pid", "epoch", "seg", "seq", "hint_seq", "hint_pos", (F.col("seq") - F.col("hint_seq")).alias("walk"))


def valid_prefix(records: DataFrame) -> DataFrame:
    """Records before the first bad one (column ok) of each (pid, epoch): what recovery keeps."""
    bad = records.where("not ok").groupBy("pid", "epoch").agg(F.min("seq").alias("_bad"))
    return records.join(bad, ["pid", "epoch"], "left").where("_bad is null or seq < _bad").drop("_bad")


def retention_age(segments: DataFrame, now, max_age: str) -> DataFrame:
    """Segments to delete because they are older than max_age (an interval) at `now` (a column)."""
    return segments.where(F.col("mtime") < now - F.expr(f"interval {max_age}"))


def retention_size(segments: DataFrame, most: int, order: list[str], within: list[str]) -> DataFrame:
    """Adds drop: oldest first until a partition's total is at most `most` bytes."""
    w = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("bytes").over(Window.partitionBy(*within))
    return segments.withColumn("drop", total - F.coalesce(F.sum("bytes").over(w), F.lit(0)) > most)
