"""Fetching, batching, deduplication, watermarks and offsets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import log as L
from ..operators import offsets as O
from . import tables as T
from .q_scalar import _MSG as _MSG_ID
from .registry import query


@query(f"with {T.LOG} select pid, epoch, seq, event_id, topic, key from log")
def build_log_seq(spark, sf):
    return T.events_log(spark, sf).select("pid", "epoch", "seq", "event_id", "topic", "key")


@query(f"with {T.LOG} select pid, epoch, seq, payload from log where pid = 3 and epoch = 0 and seq >= 20 and seq < 80")
def fetch_range(spark, sf):
    return T.stored_log(spark, sf).where("pid = 3 and epoch = 0").where(L.lsn_range(20, 80)).select("pid", "epoch", "seq", "payload")


@query(f"with {T.LOG} select pid, epoch, seq, payload from log where pid = 3 and epoch = 0 and seq >= 5 order by seq limit 10")
def fetch_limit(spark, sf):
    return L.fetch(T.stored_log(spark, sf), 3, 0, 5, 10).select("pid", "epoch", "seq", "payload")


@query(f"with {T.LOG} select pid, epoch, seq, payload from log where pid = 5 and epoch = (select max(epoch) from log where pid = 5) order by seq limit 25")
def fetch_active_epoch(spark, sf):
    return L.fetch_active(T.stored_log(spark, sf), 5, -1, 25).select("pid", "epoch", "seq", "payload")


@query(f"with {T.LOG} select pid, epoch, seq from (select *, lag(seq) over (partition by pid, epoch order by seq) as p, max(case when event_id % 200 = 77 then 1 else 0 end) over (partition by pid, epoch order by seq rows unbounded preceding) as broken from log) where broken = 0")
def fetch_cross_segment(spark, sf):
    """A scan over all segments that ends at the first missing record (event ids 77 modulo 200 are lost)."""
    return L.until_gap(T.events_log(spark, sf).where("event_id % 200 <> 77")).select("pid", "epoch", "seq")


_REQ = """req as (select event_id as request_id, cast(event_id % 16 as integer) as pid, event_id % 5 as epoch, (event_id * 7) % 300 - 5 as seq, cast(event_id % 9 as integer) as max_messages from events)"""


@query(f"""with {T.EPOCHS}, {_REQ},
j as (select r.*, e.storage_nodes, h.hwm, greatest(r.seq, 0) as s, case when h.hwm >= greatest(r.seq, 0) then least(h.hwm - greatest(r.seq, 0) + 1, r.max_messages) else 0 end as k from req r left join epochs e on e.pid = r.pid and e.epoch = r.epoch left join hw h on h.pid = r.pid and h.epoch = r.epoch),
t as (select *, case when storage_nodes is not null and not list_contains(storage_nodes, 2) then 'NOT_IN_PLACEMENT' when hwm is null then 'EPOCH_MISSING' else 'OK' end as status from j)
select request_id, status, cast(case when status = 'OK' then k else 0 end as bigint) as n, case when status = 'OK' and k > 0 then s end as first_seq, case when status = 'OK' and k > 0 then s + k - 1 end as last_seq, case when status = 'NOT_IN_PLACEMENT' then array_to_string(storage_nodes, ',') else '' end as redirect from t""")
def fetch_status_redirect(spark, sf):
    req = _requests(spark, sf)
    return L.fetch_batch(req, T.stored_log(spark, sf), T.epochs(spark, sf).select("pid", "epoch", "storage_nodes"), 2)


def _requests(spark, sf):
    """A fetch for every event."""
    e = T.table(spark, sf, "events")
    return e.select(F.col("event_id").alias("request_id"), (F.col("event_id") % 16).cast("int").alias("pid"), (F.col("event_id") % 5).alias("epoch"), ((F.col("event_id") * 7) % 300 - 5).alias("seq"), (F.col("event_id") % 9).cast("int").alias("max_messages"))


@query(f"""with {T.EPOCHS}, {_REQ},
j as (select r.*, e.storage_nodes, h.hwm, greatest(r.seq, 0) as s from req r join epochs e on e.pid = r.pid and e.epoch = r.epoch join hw h on h.pid = r.pid and h.epoch = r.epoch where list_contains(e.storage_nodes, 2))
select request_id, l.seq - s as place, l.pid, l.epoch, l.seq, topic, key, payload, (l.epoch << 40) | l.seq as lsn from j join log l on l.pid = j.pid and l.epoch = j.epoch and l.seq >= s and l.seq < s + max_messages""")
def fetch_reply(spark, sf):
    """The records of every OK answer of fetch_status_redirect, in order."""
    log = T.stored_log(spark, sf)
    req = _requests(spark, sf)
    return L.fetch_records(req, log, L.fetch_batch(req, log, T.epochs(spark, sf).select("pid", "epoch", "storage_nodes"), 2))


@query(f"with {T.ARRIVALS} select event_id, cast(case when user_id % 24 > 0 then user_id % 24 % 16 else pid end as integer) as pid from routed")
def publish_pinned(spark, sf):
    """Publishers that name their partition."""
    a = T.arrivals(spark, sf)
    return a.select("event_id", L.pinned_partition(F.col("user_id") % 24, F.col("key").cast("binary"), T.PARTITIONS).alias("pid"))


_BATCH = """changes as (select *, case when {key} then 0 else 1 end as c from (select *, {lags} from routed)),
runs as (select *, sum(c) over (partition by pid order by event_id) as run from changes),
cuts as (select *, case when (row_number() over (partition by pid, run order by event_id) - 1) % {most} = 0 then 1 else 0 end as f from runs),
batches as (select *, cast(sum(f) over (partition by pid order by event_id) as bigint) as batch_id from cuts)"""


@query(f"with {T.ARRIVALS}, " + _BATCH.format(key="topic = pt and event_id // 50 % 2 = pr", lags="lag(topic) over (partition by pid order by event_id) as pt, lag(event_id // 50 % 2) over (partition by pid order by event_id) as pr", most=8) + " select pid, event_id, batch_id from batches")
def publish_batches(spark, sf):
    """Runs of one topic and number of retries."""
    r = T.routed(spark, sf).withColumn("retries", F.floor(F.col("event_id") / 50) % 2)
    return L.publish_batches(r, "event_id", ["topic", "retries"], 8, ["pid"]).select("pid", "event_id", "batch_id")


@query(f"with {T.ARRIVALS}, " + _BATCH.format(key="epoch = pt", lags="lag(epoch) over (partition by pid order by event_id) as pt", most=100) + " select pid, epoch, batch_id, count(*) as n, min(event_id) as first_id, max(event_id) as last_id from batches group by pid, epoch, batch_id")
def writer_batches(spark, sf):
    b = L.publish_batches(T.routed(spark, sf), "event_id", ["epoch"], 100, ["pid"])
    return b.groupBy("pid", "epoch", "batch_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


_REPLY = "select batch_id, bool_and(status = 'SUCCESS') as ok, arg_min(case when status <> 'SUCCESS' then node_id end, case when status <> 'SUCCESS' then event_id end) as first_error from attempts group by batch_id"


@query(f"with {T.ATTEMPTS} {_REPLY}")
def batch_reply(spark, sf):
    bad = F.col("status") != "SUCCESS"
    return T.attempts(spark, sf).groupBy("batch_id").agg(F.bool_and(~bad).alias("ok"), F.min_by(F.when(bad, F.col("node_id")), F.when(bad, F.col("event_id"))).alias("first_error"))


@query(f"with {T.ATTEMPTS} select pid, batch_id, bool_and(status = 'SUCCESS') as ok, count(*) as n from attempts group by pid, batch_id")
def batch_conjunction(spark, sf):
    return T.attempts(spark, sf).groupBy("pid", "batch_id").agg(F.bool_and(F.col("status") == "SUCCESS").alias("ok"), F.count("*").alias("n"))


@query(f"with {T.ARRIVALS} select pid, event_id from (select *, row_number() over (partition by pid, " + _MSG_ID + " order by event_id) as r from routed) where r = 1")
def idempotent_dedup(spark, sf):
    """Message identity is the 64-bit id; different messages that share one count as the same, by definition."""
    r = T.routed(spark, sf).withColumn("msg_id", C.message_id(F.col("pid"), F.col("key").cast("binary"), F.col("payload").cast("binary")))
    return L.dedup(r, "event_id").select("pid", "event_id")


@query(f"with {T.HWM} select * from hw")
def high_watermark(spark, sf):
    return L.high_watermark(T.events_log(spark, sf))


@query(f"with {T.HWM}, {T.PIDS}, w as (select p.pid, e.epoch from pids p cross join (select distinct epoch from log union select max(epoch) + 1 from log) e) select w.pid, w.epoch, coalesce(hwm, -1) as hwm, case when hwm is not null then (w.epoch << 40) | hwm end as lsn from w left join hw on hw.pid = w.pid and hw.epoch = w.epoch")
def epoch_status(spark, sf):
    """Every partition in every epoch that the log has, and in one that it hasn't."""
    known = T.routed(spark, sf).select("epoch").distinct()
    asked = known.unionByName(known.agg((F.max("epoch") + 1).alias("epoch")))
    h = L.high_watermark(T.events_log(spark, sf))
    out = F.broadcast(T.partitions(spark)).crossJoin(asked).join(h, ["pid", "epoch"], "left")  # sixteen partitions
    return out.select("pid", "epoch", F.coalesce("hwm", F.lit(-1)).cast("long").alias("hwm"), C.lsn_encode(F.col("epoch"), F.col("hwm")).alias("lsn"))


@query(f"with {T.HWM} select l.pid, l.epoch, l.seq from log l join hw on hw.pid = l.pid and hw.epoch = l.epoch where l.seq > hwm - 32")
def ring_last_n(spark, sf):
    return L.last_n(T.events_log(spark, sf), 32).select("pid", "epoch", "seq")


@query(f"with {T.HWM}, b as (select pid, epoch, seq // 50 as batch, max(seq) as hwm, max(event_id) as at from log group by pid, epoch, seq // 50) select l.pid, l.epoch, l.seq, min(b.at) as durable_at from log l join b on b.pid = l.pid and b.epoch = l.epoch and b.hwm >= l.seq group by l.pid, l.epoch, l.seq")
def durable_at(spark, sf):
    """When each record's write was durable: the first flush (of 50 records) whose watermark reaches it."""
    log = T.events_log(spark, sf).withColumn("batch", F.floor(F.col("seq") / 50))
    flush = log.groupBy("pid", "epoch", "batch").agg(F.max("event_id").alias("durable_at"))
    return log.join(flush, ["pid", "epoch", "batch"]).select("pid", "epoch", "seq", "durable_at")


@query(f"with {T.COMMITS} select topic, grp, pid, arg_max(off, commit_order) as off from commits group by topic, grp, pid")
def committed_offsets(spark, sf):
    return O.committed(T.commits(spark, sf))


@query(f"with {T.COMMITS}, c as (select topic, grp, pid, arg_max(off, commit_order) as off from commits group by topic, grp, pid), {T.PIDS} select t.topic, g.grp, p.pid, coalesce(c.off, 0) as off from (select distinct topic from routed) t cross join (select distinct grp from commits union select 'late') g cross join pids p left join c on c.topic = t.topic and c.grp = g.grp and c.pid = p.pid")
def committed_default(spark, sf):
    c = T.commits(spark, sf)
    groups = c.select("grp").distinct().unionByName(spark.createDataFrame([("late",)], "grp string"))
    wanted = T.arrivals(spark, sf).select("topic").distinct().crossJoin(groups).crossJoin(T.partitions(spark))
    return O.committed_or_zero(wanted, c)


@query(f"with {T.COMMITS}, h as (select pid, count(*) - 1 as hwm from routed group by pid), c as (select grp, pid, arg_max(off, commit_order) as off from commits group by grp, pid), g as (select distinct grp from c) select h.pid, g.grp, h.hwm, coalesce(c.off, 0) as off, h.hwm + 1 - coalesce(c.off, 0) as lag from h cross join g left join c on c.pid = h.pid and c.grp = g.grp")
def consumer_lag(spark, sf):
    h = T.routed(spark, sf).groupBy("pid").agg((F.count("*") - 1).alias("hwm"))
    c = T.commits(spark, sf).groupBy("grp", "pid").agg(F.max_by("off", "commit_order").alias("off"))
    return O.lag(h, c)


@query(f"with {T.COMMITS} select topic, grp, count(*) as replayed, count(distinct pid) as partitions from commits group by topic, grp")
def replay_count(spark, sf):
    return O.replay_count(T.commits(spark, sf))


@query(f"with {T.ARRIVALS} select event_id, topic from routed where topic in ('click', 'purchase', 'view')")
def topic_admission(spark, sf):
    topics = spark.createDataFrame([("click",), ("purchase",), ("view",)], "topic string")
    return L.admitted(T.arrivals(spark, sf), topics).select("event_id", "topic")


@query(f"with {T.ARRIVALS} select event_id, pid, cast(pid % 5 as integer) as owner, pid % 5 = 1 as is_local from routed")
def publish_route(spark, sf):
    r = T.routed(spark, sf).withColumn("owner", C.partition_owner(F.col("pid"), T.NODES))
    return r.select("event_id", "pid", "owner", (F.col("owner") == 1).alias("is_local"))


@query(f"with {T.ARRIVALS}, n as (select pid, cast(pid % 5 as integer) as owner, 'node-' || (pid % 5) as client from (select cast(range as integer) as pid from range(16))) select event_id, r.pid, client from routed r join n on n.pid = r.pid where owner <> 1")
def forward_join(spark, sf):
    clients = spark.range(T.NODES).select(F.col("id").cast("int").alias("owner"), F.concat(F.lit("node-"), F.col("id").cast("string")).alias("client"))
    r = T.routed(spark, sf).withColumn("owner", C.partition_owner(F.col("pid"), T.NODES)).where("owner <> 1")
    return r.join(F.broadcast(clients), "owner").select("event_id", "pid", "client")  # one row a node


@query("select a.event_id as correlation_id, b.event_id as ack_id, b.value from events a join events b on b.event_id = a.event_id + 1 where a.event_id % 5 <> 3 and b.event_type <> 'error'")
def ack_correlation(spark, sf):
    e = T.table(spark, sf, "events")
    sent = e.where("event_id % 5 <> 3").select(F.col("event_id").alias("correlation_id"))
    acks = e.where("event_type <> 'error'").select((F.col("event_id") - 1).alias("correlation_id"), F.col("event_id").alias("ack_id"), "value")
    return sent.join(acks, "correlation_id")


@query("""with d as (select event_id from events where event_id % 100 <> 7 union all select event_id from events where event_id % 50 = 3 union all select event_id + 100000000 from events where event_id % 1000 = 1),
e as (select event_id, 1 as ne, 0 as nd from events union all select event_id, 0, 1 from d), g as (select event_id, sum(ne) as ne, sum(nd) as nd from e group by event_id)
select count(case when ne > 0 and nd = 0 then 1 end) as missing, count(case when ne = 0 and nd > 0 then 1 end) as extra, count(case when nd > greatest(ne, 1) then 1 end) as duplicated, cast(sum(nd) as bigint) as delivered from g""")
def exactly_once_audit(spark, sf):
    e = T.table(spark, sf, "events").select("event_id")
    got = e.where("event_id % 100 <> 7").unionAll(e.where("event_id % 50 = 3")).unionAll(e.where("event_id % 1000 = 1").select((F.col("event_id") + 100000000).alias("event_id")))
    return L.exactly_once_audit(e, got, "event_id")


@query(f"with {T.ARRIVALS}, d as (select pid, event_id as t, 1 as n, octet_length(encode(payload)) + 8 as b from routed union all select pid, event_id + 40, -1, -(octet_length(encode(payload)) + 8) from routed), s as (select pid, t, cast(sum(n) as bigint) as n, cast(sum(b) as bigint) as b from d group by pid, t) select pid, t, cast(sum(n) over (partition by pid order by t) as bigint) as inflight, cast(sum(b) over (partition by pid order by t) as bigint) as bytes from s")
def inflight_gauges(spark, sf):
    r = T.routed(spark, sf).select("pid", "event_id", C.record_bytes(F.col("payload")).alias("b"))
    d = r.select("pid", F.col("event_id").alias("t"), F.lit(1).alias("n"), "b").unionByName(r.select("pid", (F.col("event_id") + 40).alias("t"), F.lit(-1).alias("n"), (-F.col("b")).alias("b")))
    s = d.groupBy("pid", "t").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    w = Window.partitionBy("pid").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return s.select("pid", "t", F.sum("n").over(w).alias("inflight"), F.sum("b").over(w).alias("bytes"))


@query(f"""with {T.ARRIVALS}, q as (select pid, event_id as t, octet_length(encode(payload)) + 8 as b, row_number() over (partition by pid order by event_id) as i from routed),
f as (with recursive x as (
  select pid, 0::bigint as i, 0::bigint as t, 0::bigint as inflight, 0::bigint as bytes, false as rejected, []::struct(t bigint, b bigint)[] as held from (select distinct pid from q)
  union all select pid, i, t, inflight, bytes, rejected, case when rejected then live else list_append(live, struct_pack(t := t, b := b)) end from (
    select *, inflight >= 3 or bytes + b > 48 as rejected from (
      select *, len(live)::bigint as inflight, coalesce(list_sum(list_transform(live, lambda h: h.b)), 0)::bigint as bytes from (
        select q.pid, q.i, q.t, q.b::bigint as b, list_filter(x.held, lambda h: h.t + 40 >= q.t) as live from x join q on q.pid = x.pid and q.i = x.i + 1))))
  select pid, t, inflight, bytes, rejected from x where i > 0) select * from f""")
def inflight_backpressure(spark, sf):
    """A publish takes 40 arrivals to finish; three of a partition, or 48 bytes, are the most that may be unfinished."""
    r = T.routed(spark, sf).select("pid", F.col("event_id").alias("t"), C.record_bytes(F.col("payload")).alias("b"))
    return L.backpressure(r, 40, 3, 48)


@query(f"with {T.ARRIVALS} select event_id as corr_id, 'PUBLISH' as kind, topic, cast(event_id % 3 as integer) as retries, octet_length(encode(payload)) as size, case when event_id % 11 = 0 then null else octet_length(encode(key)) end as key_size, pid as partition_id from routed")
def publish_envelope(spark, sf):
    r = T.routed(spark, sf).select(F.col("event_id").alias("corr_id"), "topic", (F.col("event_id") % 3).alias("retries"), "payload", F.when(F.col("event_id") % 11 != 0, F.col("key")).alias("key"), "pid")
    m = L.envelopes(r)
    return m.select("corr_id", "kind", "message.topic", "message.retries", F.octet_length("message.payload").cast("long").alias("size"), F.octet_length("message.key").cast("long").alias("key_size"), "message.partition_id")


@query(f"""with {T.ATTEMPTS}, r as (select event_id as corr_id, case event_id % 4 when 0 then 'PUBLISH' when 1 then 'COMMIT' when 2 then 'APPEND' else 'OTHER' end as request, status, latency_ns as off from attempts)
select corr_id, case request when 'PUBLISH' then 'PUBLISH_REPLY' when 'COMMIT' then 'COMMIT_ACK' when 'APPEND' then 'REPLICATION_ACK' else 'ERROR' end as kind, case when request = 'OTHER' then 'INVALID_REQUEST' else status end as status,
  case when request <> 'OTHER' and status = 'SUCCESS' then off else -1 end as "offset", case when request <> 'OTHER' and status = 'SUCCESS' then '' else request || ' failed: ' || status end as error from r""")
def reply_envelope(spark, sf):
    k = F.col("event_id") % 4
    a = T.attempts(spark, sf).select(F.col("event_id").alias("corr_id"), F.when(k == 0, "PUBLISH").when(k == 1, "COMMIT").when(k == 2, "APPEND").otherwise("OTHER").alias("request"), "status", F.col("latency_ns").alias("offset"))
    return L.replies(a)


@query(f"with {T.LOG}, v as (select pid, epoch, seq, octet_length(encode(payload)) as size, payload like '%97}}' as last from log), s as (select pid, epoch, min(case when last then seq end) as stop from v group by pid, epoch) select (v.epoch << 40) | v.seq as lsn, size from v join s on s.pid = v.pid and s.epoch = v.epoch where stop is null or v.seq < stop")
def fetch_visit(spark, sf):
    """A visitor that measures records and ends at the first whose payload ends in 97}."""

    def measure(lsn, key, payload):
        return False if payload.endswith("97}") else (lsn, len(payload.encode()))

    return L.visit(T.stored_log(spark, sf), measure, "lsn long, size long")


@query("select event_id, cast((row_number() over (order by event_id) - 1) % 12 as integer) as pid from events")
def partitioner_registry(spark, sf):
    """The round-robin partitioner, taken from the registry by its name."""
    return L.route(T.table(spark, sf, "events").select("event_id", "event_type", F.col("event_id").alias("rank")), "round_robin", "event_type", "rank", 12).select("event_id", "pid")


@query(f"with {T.ARRIVALS} select pid, event_id, row_number() over (partition by pid order by event_id % 3, event_id) as place from routed")
def pipeline_order(spark, sf):
    """Completions first, then deferred work, then the queue; within each by arrival."""
    w = Window.partitionBy("pid").orderBy(F.col("event_id") % 3, "event_id")
    return T.routed(spark, sf).select("pid", "event_id", F.row_number().over(w).cast("long").alias("place"))


@query(f"with {T.LOG} select pid, epoch, seq, 'old' as part from log where epoch = 0 union all select pid, epoch, seq, 'new' from log where epoch > 0")
def union_epochs(spark, sf):
    log = T.events_log(spark, sf).select("pid", "epoch", "seq")
    return log.where("epoch = 0").withColumn("part", F.lit("old")).unionByName(log.where("epoch > 0").withColumn("part", F.lit("new")))


@query(f"with {T.LOG} select pid, epoch, count(*) as records, min(event_id) as first_id from log group by pid, epoch")
def epoch_discovery(spark, sf):
    return T.routed(spark, sf).groupBy("pid", "epoch").agg(F.count("*").alias("records"), F.min("event_id").alias("first_id"))


@query(f"with {T.LOG}, k as (select * from log where seq % 37 <> 11) select pid, epoch, seq, seq - lag(seq) over (partition by pid, epoch order by seq) as step from k qualify step > 1")
def contiguity_audit(spark, sf):
    w = Window.partitionBy("pid", "epoch").orderBy("seq")
    k = T.events_log(spark, sf).where("seq % 37 <> 11").select("pid", "epoch", "seq")
    return k.withColumn("step", F.col("seq") - F.lag("seq").over(w)).where("step > 1")


@query(f"with {T.ARRIVALS} select topic from routed group by topic")
def topic_list(spark, sf):
    return T.arrivals(spark, sf).select("topic").distinct()


@query(f"with {T.ARRIVALS}, t as (select distinct topic from routed union select 'absent') select t.topic, count(distinct pid) as partitions, count(pid) as records from t left join routed r on r.topic = t.topic group by t.topic")
def topic_describe(spark, sf):
    r = T.routed(spark, sf).groupBy("topic").agg(F.countDistinct("pid").alias("partitions"), F.count("*").alias("records"))
    names = r.select("topic").unionByName(spark.createDataFrame([("absent",)], "topic string"))
    return names.join(r, "topic", "left").select("topic", F.coalesce("partitions", F.lit(0)).alias("partitions"), F.coalesce("records", F.lit(0)).alias("records"))
