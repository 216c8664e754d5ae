"""Structured Streaming forms, drained over what the tables hold."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import offsets as O
from ..operators import replica as R
from ..streaming import streams as S
from . import tables as T
from .q_cluster import _REQS
from .registry import query


def _arrivals(spark, sf):
    e = S.source(spark, f"{sf}/events.parquet")
    key = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("topic"), F.col("props").alias("payload"), C.key_partition(key.cast("binary"), 16).alias("pid"), F.floor(F.col("event_id") / 2500).cast("long").alias("epoch"), key.alias("key"))


@query(f"with {T.ARRIVALS} select event_id, pid, topic from routed where topic = 'click'")
def stream_subscribe(spark, sf):
    return S.drain(_arrivals(spark, sf).where("topic = 'click'").select("event_id", "pid", "topic"))


@query(f"with {T.ARRIVALS} select distinct pid, user_id, payload from routed")
def stream_dedup(spark, sf):
    return S.drain(S.dedup(_arrivals(spark, sf).select("pid", "user_id", "payload"), ["pid", "user_id", "payload"]))


@query(f"with {T.ARRIVALS} select pid, epoch, max(event_id) as hwm, count(*) as records from routed group by pid, epoch")
def stream_hwm(spark, sf):
    return S.drain(S.high_watermark(_arrivals(spark, sf).withColumn("seq", F.col("event_id"))), "complete")


@query(f"with {T.COMMITS} select topic, grp, pid, arg_max(off, commit_order) as off from commits group by topic, grp, pid")
def stream_commit(spark, sf):
    a = _arrivals(spark, sf)
    c = a.select("topic", F.concat(F.lit("g"), (F.col("user_id") % 4).cast("string")).alias("grp"), "pid", F.struct("event_id", (F.col("event_id") % 1000).alias("off")).alias("at"))
    return S.drain(c.groupBy("topic", "grp", "pid").agg(F.max("at").alias("at")).select("topic", "grp", "pid", "at.off"), "complete")


@query("select a.event_id as correlation_id, b.event_id as ack_id from events a join events b on b.event_id = a.event_id + 1 where a.event_id % 5 <> 3 and b.event_type <> 'error' and b.ts >= a.ts and b.ts <= a.ts + interval 30 days")
def stream_ack_join(spark, sf):
    e = S.source(spark, f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    sent = e.where("event_id % 5 <> 3").select(F.col("event_id").alias("correlation_id"), F.col("ts").alias("sent"))
    acks = e.where("event_type <> 'error'").select((F.col("event_id") - 1).alias("correlation_id"), F.col("event_id").alias("ack_id"), F.col("ts").alias("acked"))
    return S.drain(S.acknowledgements(sent, acks, "60 days", "30 days").select("correlation_id", "ack_id"))


@query(f"with {_REQS.format(n='event_id % 4')} select * from fold")
def stream_replica_append(spark, sf):
    """replica_append_batch's requests, with their duplicates, gaps, stale and sealed epochs, as a stream."""
    path = S.shared(spark, "requests") + "/requests.parquet"
    req = T.append_requests(spark, sf).withColumn("known", F.col("topic") != "purchase")
    req.select("pid", "arrival", "epoch", "base_seq", "n", "sealed_end", "known").write.parquet(path)
    return S.drain(R.append_stream(S.source(spark, path + "/")))


def _delivered(spark, sf):
    """A subscriber takes the log's older epochs, commits, and is started anew over the whole log: what it was given.

    Its second life has a checkpoint of its own, so only the committed offsets tell where to go on.
    """
    path, out, offsets = (S.shared(spark, n) for n in ("subscribed", "delivered", "offsets"))
    log = T.stored_log(spark, sf).select("pid", "epoch", "seq", "topic", "event_id")
    half = log.agg(F.floor(F.max("epoch") / 2).alias("h")).first()["h"]
    for life, part in enumerate((log.where(F.col("epoch") <= half), log.where(F.col("epoch") > half))):
        part.write.mode("append").parquet(path)

        def handle(batch, number, life=life):
            w = Window.partitionBy("pid").orderBy("epoch", "seq")
            batch.withColumn("place", F.row_number().over(w)).withColumn("life", F.lit(life)).write.mode("overwrite").parquet(f"{out}/life={life}/batch={number}")

        def commit(last, number, life=life):
            last.select("topic", "pid", "at.epoch", "at.seq").write.mode("overwrite").parquet(f"{offsets}/life={life}/batch={number}")

        taken = O.last_taken(spark.read.parquet(offsets)) if life else None
        S.subscribe(S.source(spark, path + "/"), handle, commit, S.shared(spark, "state"), "click", taken).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out), O.last_taken(spark.read.parquet(offsets))


_LIVES = T.LOG + ", h as (select max(epoch) // 2 as h from log), lives as (select log.*, case when epoch <= h then 0 else 1 end as life from log, h where topic = 'click')"


@query(f"with {_LIVES} select pid, epoch, seq, event_id, life, cast(row_number() over (partition by pid, life order by epoch, seq) as integer) as place from lives")
def stream_subscribe_resume(spark, sf):
    return _delivered(spark, sf)[0].select("pid", "epoch", "seq", "event_id", "life", "place")


@query(f"with {_LIVES} select topic, pid, max(epoch) as epoch, arg_max(seq, (epoch << 40) | seq) as seq from lives group by topic, pid")
def stream_subscribe_commits(spark, sf):
    return _delivered(spark, sf)[1]


@query(f"with {T.LOG} select pid, epoch, seq, event_id, topic from log")
def stream_ingest(spark, sf):
    """The log, written by a stream in three micro-batches of arrivals."""
    path, out = S.shared(spark, "arrivals"), S.shared(spark, "ingested")
    a = T.routed(spark, sf).select("pid", "epoch", F.col("event_id").alias("arrival"), "event_id", "topic")
    most = a.agg(F.max("arrival")).first()[0] or 0
    state = S.shared(spark, "state")
    for k in range(3):  # a source that grows; every life of the writer goes on where the one before ended
        a.where((F.col("arrival") * 3 >= k * (most + 1)) & (F.col("arrival") * 3 < (k + 1) * (most + 1))).write.mode("append").parquet(path)
        S.ingest(S.source(spark, path + "/"), out, state).awaitTermination()
    return spark.read.parquet(out).select("pid", "epoch", "seq", "event_id", "topic")
