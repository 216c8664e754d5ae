"""Segments, indexes, recovery and retention."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import layout as Y
from ..operators import log as L
from . import tables as T
from .registry import query

CAPACITY = 1024


def _packed(spark, sf):
    return Y.pack_segments(T.events_log(spark, sf), CAPACITY)


@query(f"with {T.SEGMENTS} select * from packing")
def segment_pack(spark, sf):
    return _packed(spark, sf)


@query(f"with {T.SEGMENTS} select * from segs")
def segment_stats(spark, sf):
    return Y.segment_stats(_packed(spark, sf))


@query(f"with {T.SEGMENTS} select w.pid, w.epoch, w.seq, s.seg from log w join segs s on s.pid = w.pid and s.epoch = w.epoch and w.seq between first_seq and last_seq")
def segment_lookup(spark, sf):
    return Y.segment_lookup(T.events_log(spark, sf).select("pid", "epoch", "seq"), Y.segment_stats(_packed(spark, sf)))


@query(f"with {T.SEGMENTS} select pid, epoch, seg, row_number() over (partition by pid order by epoch, first_seq, last_seq) as place from segs")
def segment_order(spark, sf):
    w = Window.partitionBy("pid").orderBy("epoch", "first_seq", "last_seq")
    return Y.segment_stats(_packed(spark, sf)).select("pid", "epoch", "seg", F.row_number().over(w).cast("long").alias("place"))


_DENSE = T.SEGMENTS + ", dense as (select pid, epoch, seg, seq, row_number() over (partition by pid, epoch, seg order by seq) - 1 as idx, cast(26 + coalesce(sum(bytes) over (partition by pid, epoch, seg order by seq rows between unbounded preceding and 1 preceding), 0) as bigint) as pos from packing)"


@query(f"with {_DENSE} select * from dense")
def dense_index(spark, sf):
    return Y.dense_index(_packed(spark, sf))


@query(f"with {_DENSE} select d.* from dense d join log l on l.pid = d.pid and l.epoch = d.epoch and l.seq = d.seq")
def dense_lookup(spark, sf):
    return Y.dense_index(_packed(spark, sf)).join(T.events_log(spark, sf).select("pid", "epoch", "seq"), ["pid", "epoch", "seq"])


@query(f"with {_DENSE} select * from dense where idx % 16 = 0")
def sparse_hints(spark, sf):
    return Y.sparse_hints(Y.dense_index(_packed(spark, sf)), 16)


@query(f"with {_DENSE} select d.pid, d.epoch, d.seg, d.seq, h.seq as hint_seq, h.pos as hint_pos, d.seq - h.seq as walk from dense d join dense h on h.pid = d.pid and h.epoch = d.epoch and h.seg = d.seg and h.idx = d.idx - d.idx % 16")
def hint_lookup(spark, sf):
    index = Y.dense_index(_packed(spark, sf))
    return Y.hint_lookup(index.drop("pos"), Y.sparse_hints(index, 16), 16)


@query(f"with {T.LOG}, b as (select pid, epoch, min(seq) as bad from log where event_id % 211 = 5 group by pid, epoch) select l.pid, l.epoch, l.seq from log l left join b on b.pid = l.pid and b.epoch = l.epoch where bad is null or l.seq < bad")
def valid_prefix(spark, sf):
    log = T.events_log(spark, sf).select("pid", "epoch", "seq", (F.col("event_id") % 211 != 5).alias("ok"))
    return Y.valid_prefix(log).select("pid", "epoch", "seq")


_SEG = T.LOG + ", sg as (select pid, epoch, cast(sum(octet_length(encode(payload)) + 8) + 26 as bigint) as bytes, max(ts) as mtime from log group by pid, epoch)"


def _segments(spark, sf):
    log = T.events_log(spark, sf)
    return log.groupBy("pid", "epoch").agg((F.sum(C.record_bytes(F.col("payload"))) + C.HEADER_BYTES).alias("bytes"), F.max("ts").alias("mtime"))


@query(f"with {_SEG} select pid, epoch, bytes from sg where mtime < timestamp '2024-01-20'")
def retention_age(spark, sf):
    return Y.retention_age(_segments(spark, sf), F.lit("2024-01-30").cast("timestamp_ntz"), "10 days").select("pid", "epoch", "bytes")


@query(f"with {_SEG} select pid, epoch, bytes, sum(bytes) over (partition by pid) - coalesce(sum(bytes) over (partition by pid order by mtime, epoch rows between unbounded preceding and 1 preceding), 0) > 3000 as \"drop\" from sg")
def retention_size(spark, sf):
    return Y.retention_size(_segments(spark, sf), 3000, ["mtime", "epoch"], ["pid"]).select("pid", "epoch", "bytes", "drop")


@query(f"with {_SEG} select pid, cast(sum(bytes) as bigint) as total, count(*) as segments from sg group by pid")
def retention_total(spark, sf):
    return _segments(spark, sf).groupBy("pid").agg(F.sum("bytes").alias("total"), F.count("*").alias("segments"))
