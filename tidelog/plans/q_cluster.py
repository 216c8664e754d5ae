"""Membership, placement, quorum, replication and backfill."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as K
from ..operators import replica as R
from . import tables as T
from .registry import query

_BEATS = "beats as (select user_id % 40 as broker_id, case when user_id % 3 = 0 then 'PERSISTENCE' else 'INGESTION' end as role, epoch_ms(ts) // 60000 as ts, cast(user_id % 7 as integer) as vnodes, event_id as arrival from events)"
_LATEST = _BEATS + ", latest as (select broker_id, role, ts, vnodes from beats qualify row_number() over (partition by broker_id order by ts desc, arrival) = 1)"


def _beats(spark, sf):
    e = T.table(spark, sf, "events")
    minute = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 60000)
    return e.select((F.col("user_id") % 40).alias("broker_id"), F.when(F.col("user_id") % 3 == 0, "PERSISTENCE").otherwise("INGESTION").alias("role"), minute.alias("ts"), (F.col("user_id") % 7).cast("int").alias("vnodes"), F.col("event_id").alias("arrival"))


@query(f"with {_LATEST} select * from latest")
def members_latest(spark, sf):
    return K.latest_members(_beats(spark, sf))


@query(f"with {_LATEST}, n as (select max(ts) as now from beats) select broker_id, role from latest, n where (now - ts) * 60000 <= 1800000")
def members_live(spark, sf):
    b = _beats(spark, sf)
    m = K.latest_members(b).withColumn("ts_ms", F.col("ts") * 60000)
    now = b.agg((F.max("ts") * 60000).alias("now"))  # one row
    return K.live(m.crossJoin(F.broadcast(now)), F.col("now"), 1_800_000).select("broker_id", "role")


@query("select event_id, user_id from (select *, max(epoch_ms(ts)) over () as now from events) where now - epoch_ms(ts) <= 86400000")
def heartbeat_filter(spark, sf):
    e = T.table(spark, sf, "events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    now = e.agg(F.max("ts_ms").alias("now"))
    return K.live(e.crossJoin(F.broadcast(now)), F.col("now"), 86_400_000).select("event_id", "user_id")


@query(f"with {T.MEMBERS}, g as (select broker_id + 20 as broker_id, 'PERSISTENCE' as role, 'gossip' as address from members) select coalesce(g.broker_id, m.broker_id) as broker_id, coalesce(g.role, m.role) as role, coalesce(g.address, m.address) as address from members m full join g on g.broker_id = m.broker_id")
def members_overlay(spark, sf):
    m = T.members(spark, sf)
    g = m.select((F.col("broker_id") + 20).alias("broker_id"), F.lit("PERSISTENCE").alias("role"), F.lit("gossip").alias("address"))
    return K.overlay(m, g)


@query(f"with {T.MEMBERS}, {T.PIDS} select pid, broker_id, score from ({T.scores_sql()})")
def hrw_score(spark, sf):
    return K.scored(T.partitions(spark), T.members(spark, sf)).select("pid", "broker_id", "score")


@query(f"with {T.MEMBERS}, {T.PIDS} select pid, cast(row_number() over (partition by pid order by score desc, broker_id) as integer) as place, broker_id, score from ({T.scores_sql()}) where role = 'PERSISTENCE' qualify place <= 3")
def replica_set(spark, sf):
    return K.replica_set(T.partitions(spark), T.members(spark, sf), 3)


@query(f"with {T.MEMBERS}, {T.PIDS} select pid, arg_max(broker_id, score) as \"primary\" from ({T.scores_sql()}) where role = 'INGESTION' group by pid")
def hrw_primary(spark, sf):
    return K.primary(T.partitions(spark), T.members(spark, sf))


@query(f"with {T.MEMBERS}, odd as (select * from members where role = 'INGESTION'), {T.PIDS} select pid, cast(row_number() over (partition by pid order by score desc, broker_id) as integer) as place, broker_id, score from ({T.scores_sql('odd')}) qualify place <= 2")
def role_fallback(spark, sf):
    """No member stores data, so all are eligible."""
    return K.replica_set(T.partitions(spark), T.members(spark, sf).where("role = 'INGESTION'"), 2)


@query(f"with {T.MEMBERS}, {T.PIDS} select broker_id, count(*) as partitions, max(score) as best from ({T.scores_sql()}) group by broker_id")
def member_scores(spark, sf):
    return K.scored(T.partitions(spark), T.members(spark, sf)).groupBy("broker_id").agg(F.count("*").alias("partitions"), F.max("score").alias("best"))


_FOLD = """o as (select *, row_number() over (partition by node_id order by event_id) as i from attempts),
f as (with recursive x as (
  select node_id, 0::bigint as i, 1e6::double as p from (select distinct node_id from o)
  union all select o.node_id, o.i, case when status = 'SUCCESS' then x.p * 0.8::double + latency_ns::double * 0.2::double else greatest(least(x.p * 2, 1e10::double), 1e6::double) end
  from x join o on o.node_id = x.node_id and o.i = x.i + 1) select node_id, arg_max(p, i) as ewma from x group by node_id)"""




@query(f"with {T.ATTEMPTS}, {_FOLD} select node_id, round(ewma, 2) as ewma from f")
def ewma_latency(spark, sf):
    return K.ewma(T.attempts(spark, sf), "event_id").select("node_id", F.round("ewma", 2).alias("ewma"))


@query(f"with {T.ATTEMPTS}, {_FOLD}, {T.PIDS} select pid, node_id, cast(row_number() over (partition by pid order by ewma, (node_id + pid) % 5) as integer) as place from f cross join pids where (node_id + pid) % 4 <> 0")
def fastest_replica(spark, sf):
    n = K.ewma(T.attempts(spark, sf), "event_id").crossJoin(T.partitions(spark)).withColumn("position", (F.col("node_id") + F.col("pid")) % 5)
    return K.fastest(n, (F.col("node_id") + F.col("pid")) % 4 == 0).select("pid", "node_id", "place")


@query(f"with {T.ATTEMPTS} select batch_id, count(*) as n, count(case when status = 'SUCCESS' then 1 end) as successes, least(greatest(3, 1), count(*)) as needed, count(case when status = 'SUCCESS' then 1 end) >= least(3, count(*)) as ok from attempts group by batch_id")
def quorum_status(spark, sf):
    return K.quorum_status(T.attempts(spark, sf), F.lit(3))


@query(f"with {T.ATTEMPTS}, g as (select batch_id, count(*) as n, list_sort(list(latency_ns) filter (status = 'SUCCESS')) as l from attempts group by batch_id) select batch_id, l[least(3, n)] as commit_ns from g")
def quorum_latency(spark, sf):
    return K.quorum_latency(T.attempts(spark, sf), 3)


@query(f"with {T.ATTEMPTS} select a.batch_id, b.node_id as failed_node from (select distinct batch_id from attempts) a left join (select batch_id, node_id from attempts where status <> 'SUCCESS' qualify row_number() over (partition by batch_id order by latency_ns, node_id) = 1) b on b.batch_id = a.batch_id")
def first_failure(spark, sf):
    return K.first_failure(T.attempts(spark, sf))


@query()
def adaptive_replication(spark, sf):
    a = T.attempts(spark, sf)
    b = a.select((F.col("batch_id") % 16).cast("int").alias("pid"), "batch_id", "node_id", (F.col("status") == "SUCCESS").alias("ok"), F.col("latency_ns").cast("double").alias("latency_ns"))
    return K.adaptive_replication(b, 2, deadline=1.5e8)


_REQS = T.LOG + """, rq as (select pid, event_id as arrival, topic, case when event_id % 41 = 0 and epoch > 0 then epoch - 1 else epoch end as epoch,
  greatest(seq - case when event_id % 7 = 0 then 1 else 0 end + case when event_id % 29 = 0 then 2 else 0 end, 0) as base_seq, {n} as n, case when pid % 5 = 0 then 100 end as sealed_end from log),
q as (select *, row_number() over (partition by pid order by arrival) as i from rq),
fold as (with recursive x as (
  select distinct pid, 0::bigint as i, 0::bigint as arrival, -1::bigint as highest, map([]::bigint[], []::bigint[]) as last, ''::varchar as status, 0::bigint as off from q
  union all
  select pid, i, arrival, case when known then greatest(highest, epoch) else highest end,
    case when st = 'APPEND' then map_concat(last, map([epoch], [fin])) else last end,
    case when st = 'APPEND' then 'SUCCESS' else st end,
    case when st = 'INVALID_REQUEST' then -1 when st = 'APPEND' then fin when n = 0 then base_seq - 1 else cur end
  from (select *, base_seq + n - 1 as fin, case when not known or epoch < highest then 'INVALID_REQUEST' when n = 0 then 'SUCCESS'
      when sealed_end is not null and base_seq + n - 1 > sealed_end then 'NOT_READY' when base_seq + n - 1 <= cur then 'SUCCESS' when base_seq > cur + 1 then 'NOT_READY' else 'APPEND' end as st
    from (select q.*, x.highest, x.last, coalesce(x.last[q.epoch], -1) as cur, q.topic <> 'purchase' as known from x join q on q.pid = x.pid and q.i = x.i + 1)))
  select pid, arrival, status, off as \"offset\" from x where i > 0)"""


def _known(spark, sf):
    return T.arrivals(spark, sf).select("topic").distinct().where("topic <> 'purchase'")


@query(f"with {_REQS.format(n='1::bigint')} select * from fold")
def replica_append(spark, sf):
    return R.append(T.append_requests(spark, sf).withColumn("n", F.lit(1).cast("long")), _known(spark, sf))


@query(f"with {_REQS.format(n='event_id % 4')} select * from fold")
def replica_append_batch(spark, sf):
    return R.append(T.append_requests(spark, sf), _known(spark, sf))


@query(f"with {T.EPOCHS}, have as (select pid, epoch from epochs where (pid + epoch) % 3 = 0) select e.pid, e.epoch, e.end_seq from epochs e where end_seq >= 0 and list_contains(storage_nodes, 2) and not exists (select 1 from have h where h.pid = e.pid and h.epoch = e.epoch)")
def backfill_plan(spark, sf):
    e = T.epochs(spark, sf)
    return K.backfill_plan(e, e.where((F.col("pid") + F.col("epoch")) % 3 == 0), 2).select("pid", "epoch", "end_seq")


#: Backfill requests: one for every hundredth arrival's place, from offsets within, at and beyond the end of its epoch.
_BACKFILL = """, br as (select pid * 100000 + epoch * 10 + k as request_id, pid, epoch, cast(k * 60 - 20 as bigint) as "offset" from (select distinct pid, epoch from log) g cross join (select range as k from range(4)) ks),
bp as (select b.*, e.storage_nodes, h.hwm, list_contains(e.storage_nodes, 2) as here, greatest(b."offset", 0) as st from br b join epochs e on e.pid = b.pid and e.epoch = b.epoch join hw h on h.pid = b.pid and h.epoch = b.epoch),
bs as (select p.request_id, l.pid, l.epoch, l.seq, octet_length(encode(payload)) as size, row_number() over (partition by p.request_id order by l.seq) as i from bp p join log l on l.pid = p.pid and l.epoch = p.epoch and l.seq >= p.st and l.seq < p.st + 64 where here),
w as (with recursive x as (
  select request_id, pid, epoch, seq, i, 0::bigint as byte_at, (size + 4 <= 400) as kept, case when size + 4 <= 400 then size + 4 else 0 end::bigint as used from bs where i = 1
  union all select s.request_id, s.pid, s.epoch, s.seq, s.i, x.used, x.used + s.size + 4 <= 400, case when x.used + s.size + 4 <= 400 then x.used + s.size + 4 else x.used end
  from x join bs s on s.request_id = x.request_id and s.i = x.i + 1) select * from x where kept)"""


def _backfill(spark, sf):
    e = T.epochs(spark, sf)
    k = spark.range(4).select(F.col("id").alias("k"))
    r = e.select("pid", "epoch").crossJoin(F.broadcast(k))  # four rows
    r = r.select((F.col("pid") * 100000 + F.col("epoch") * 10 + F.col("k")).cast("long").alias("request_id"), "pid", "epoch", (F.col("k") * 60 - 20).alias("offset"))
    return K.backfill_serve(T.events_log(spark, sf), r, e, 2, 64, 400)


@query(f"with {T.EPOCHS}{_BACKFILL} select request_id, pid, epoch, seq, byte_at from w")
def backfill_serve(spark, sf):
    return _backfill(spark, sf)[0]


@query(f"""with {T.EPOCHS}{_BACKFILL}, sent as (select request_id, count(*) as n from w group by request_id)
select p.request_id, coalesce(s.n, 0) as n, here and hwm < st + 64 as end_of_epoch, case when here then '' else array_to_string(storage_nodes, ',') end as redirect from bp p left join sent s on s.request_id = p.request_id""")
def backfill_reply(spark, sf):
    return _backfill(spark, sf)[1]


@query(f"with {T.LOG} select pid, epoch, seq, event_id from log")
def backfill_apply(spark, sf):
    log = T.events_log(spark, sf).select("pid", "epoch", "seq", "event_id")
    return K.append_missing(log.where("event_id % 5 <> 2"), log.where("event_id % 5 in (2, 3)"), ["pid", "epoch", "seq"])


@query("select o_orderkey, o_custkey from orders where o_orderkey % 2 = 0 or o_orderkey % 3 = 0")
def append_missing(spark, sf):
    o = T.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return K.append_missing(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0"), ["o_orderkey"])


@query(f"with {T.EPOCHS} select l.event_id, l.pid, l.epoch, list_contains(e.storage_nodes, 2) as stored_here, e.end_seq >= 0 as sealed from log l left join epochs e on e.pid = l.pid and e.epoch = l.epoch")
def placement_lookup(spark, sf):
    log, e = T.events_log(spark, sf).select("event_id", "pid", "epoch"), T.epochs(spark, sf)
    return log.join(e, ["pid", "epoch"], "left").select("event_id", "pid", "epoch", F.array_contains("storage_nodes", F.lit(2)).alias("stored_here"), (F.col("end_seq") >= 0).alias("sealed"))
