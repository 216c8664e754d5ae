"""Configurations, fences, epochs and topics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import log as L
from ..operators import metadata as M
from . import tables as T
from .registry import query


@query(f"with {T.CONFIGS} select pid, arrival, config_version, config_version > coalesce(max(config_version) over (partition by pid order by arrival rows between unbounded preceding and 1 preceding), -1) as accepted from configs")
def config_lww(spark, sf):
    return M.accepted_updates(T.configs(spark, sf)).select("pid", "arrival", "config_version", "accepted")


@query(f"with {T.CONFIGS} select pid, config_version, epoch, tie from configs qualify row_number() over (partition by pid order by config_version desc, arrival) = 1")
def newest_config(spark, sf):
    return M.snapshot(T.configs(spark, sf))


@query(f"with {T.CONFIGS} select pid, max(config_version) as config_version, arg_max(epoch, struct_pack(v := config_version, a := -arrival)) as epoch from configs group by pid")
def metadata_snapshot(spark, sf):
    return M.snapshot(T.configs(spark, sf)).select("pid", "config_version", "epoch")


@query(f"with {T.CONFIGS} select pid, arrival, epoch, tie, coalesce(struct_pack(e := epoch, t := tie) > max(struct_pack(e := epoch, t := tie)) over (partition by pid order by arrival rows between unbounded preceding and 1 preceding), true) as accepted from configs")
def open_epoch(spark, sf):
    return M.open_epoch(T.configs(spark, sf)).select("pid", "arrival", "epoch", "tie", "accepted")


@query(f"with {T.CONFIGS}, s as (select *, coalesce(max(epoch) over (partition by pid order by arrival rows between unbounded preceding and 1 preceding), -1) as highest_before from configs) select pid, arrival, epoch, highest_before, epoch < highest_before as stale from s")
def stale_epoch_fence(spark, sf):
    return M.stale(T.configs(spark, sf), "arrival").select("pid", "arrival", "epoch", "highest_before", "stale")


@query(f"with {T.HWM}, act as (select pid, max(epoch) as epoch, arg_max(hwm, epoch) as last_seq from hw group by pid), rq as (select distinct pid, epoch from routed union select pid, epoch + 1 from act) select rq.pid, rq.epoch, case when rq.epoch > act.epoch then 'MISMATCH' when rq.epoch < act.epoch then 'STALE' else 'SEALED' end as status, case when rq.epoch = act.epoch then last_seq end as end_seq from rq left join act on act.pid = rq.pid")
def seal_epoch(spark, sf):
    h = L.high_watermark(T.events_log(spark, sf))
    active = h.groupBy("pid").agg(F.max("epoch").alias("epoch"), F.max_by("hwm", "epoch").alias("last_seq"))
    wanted = h.select("pid", "epoch").unionByName(active.select("pid", (F.col("epoch") + 1).alias("epoch"))).distinct()
    return M.seal(active, wanted)


@query(f"with {T.ARRIVALS} select pid, event_id, (row_number() over (partition by pid order by event_id) - 1) // 200 as epoch, (row_number() over (partition by pid order by event_id) - 1) % 200 as seq from routed")
def epoch_rollover(spark, sf):
    n = F.row_number().over(Window.partitionBy("pid").orderBy("event_id")) - 1
    return T.routed(spark, sf).select("pid", "event_id", M.rollover(n, 200).alias("epoch"), (n % 200).cast("long").alias("seq"))


@query("select o_orderkey, o_custkey % 4 > 0 and (o_orderkey % 5) > 0 and (o_orderkey % 5) <= o_custkey % 4 as placement_ok, (o_orderkey % 3 - 1 >= 0) and (o_custkey % 6 - 2 < 0 or o_custkey % 6 - 2 >= o_orderkey % 3 - 1) as epoch_ok from orders")
def placement_validate(spark, sf):
    o = T.table(spark, sf, "orders")
    size = (F.col("o_custkey") % 4).cast("int")
    nodes = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    return o.select("o_orderkey", M.placement_valid(nodes, F.col("o_orderkey") % 5).alias("placement_ok"), M.epoch_valid(F.col("o_orderkey") % 3 - 1, F.col("o_custkey") % 6 - 2).alias("epoch_ok"))


@query(f"with {T.EPOCHS} select pid, epoch, end_seq, cast(sum(end_seq + 1) over (partition by pid order by epoch) as bigint) as cumulative_end from epochs where end_seq >= 0")
def sealed_epochs(spark, sf):
    w = Window.partitionBy("pid").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    return T.epochs(spark, sf).where("end_seq >= 0").select("pid", "epoch", "end_seq", F.sum(F.col("end_seq") + 1).over(w).alias("cumulative_end"))


@query(f"with {T.EPOCHS} select pid, epoch, cast(row_number() over (partition by pid order by epoch) as bigint) as place, epoch = max(epoch) over (partition by pid) as active from epochs")
def epochs_sorted(spark, sf):
    e = T.epochs(spark, sf)
    w = Window.partitionBy("pid")
    return e.select("pid", "epoch", F.row_number().over(w.orderBy("epoch")).cast("long").alias("place"), (F.col("epoch") == F.max("epoch").over(w)).alias("active"))


@query(f"with {T.EPOCHS} select pid, 1::bigint as config_version, epoch, start_seq, end_seq, ack_quorum, array_to_string(storage_nodes, ',') as nodes, tie_breaker from epochs")
def metadata_explode(spark, sf):
    """To documents and back."""
    doc = M.implode_epochs(T.epochs(spark, sf).withColumn("config_version", F.lit(1).cast("long")))
    nodes = F.array_join(F.transform("storage_nodes", lambda x: x.cast("string")), ",").alias("nodes")
    return M.explode_epochs(doc).select("pid", "config_version", "epoch", "start_seq", "end_seq", "ack_quorum", nodes, "tie_breaker")


@query(f"with {T.HWM} select pid, max(epoch) as highest_epoch, count(*) - 1 as sealed, arg_max(hwm, epoch) as last_seq from hw group by pid")
def fence_state(spark, sf):
    h = L.high_watermark(T.events_log(spark, sf))
    return h.groupBy("pid").agg(F.max("epoch").alias("highest_epoch"), (F.count("*") - 1).alias("sealed"), F.max_by("hwm", "epoch").alias("last_seq"))


@query(f"with {T.EPOCHS} select l.event_id, l.pid, l.epoch, l.seq, case when e.end_seq // 2 >= 0 and e.end_seq >= 0 and l.seq > e.end_seq // 2 then 'NOT_READY' else 'SUCCESS' end as status from log l left join epochs e on e.pid = l.pid and e.epoch = l.epoch")
def sealed_gate(spark, sf):
    """Epochs sealed at half of what they hold refuse the rest."""
    e = T.epochs(spark, sf).select("pid", "epoch", F.when(F.col("end_seq") >= 0, F.floor(F.col("end_seq") / 2)).alias("half"))
    log = T.events_log(spark, sf).join(e, ["pid", "epoch"], "left")
    return log.select("event_id", "pid", "epoch", "seq", F.when(F.col("seq") > F.col("half"), "NOT_READY").otherwise("SUCCESS").alias("status"))


_FLAT = "pid, config_version, epoch, start_seq, end_seq, ack_quorum, nodes, tie_breaker"


def _wanted(spark):
    return T.partitions(spark).select("pid", F.lit(2).alias("ack_quorum"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("storage_nodes"))


def _flat(configs):
    nodes = F.array_join(F.transform("storage_nodes", lambda x: x.cast("string")), ",").alias("nodes")
    return M.explode_epochs(configs).select("pid", "config_version", "epoch", "start_seq", "end_seq", "ack_quorum", nodes, "tie_breaker")


@query(f"with {T.PIDS} select pid, 1::bigint as config_version, 0::bigint as epoch, 0::bigint as start_seq, -1::bigint as end_seq, 2 as ack_quorum, '1,2,3' as nodes, 0::bigint as tie_breaker from pids where pid % 4 <> 1")
def bootstrap_config(spark, sf):
    return _flat(M.bootstrap(_wanted(spark), T.partitions(spark).where("pid % 4 = 1")))


@query(f"""with {T.ARRIVALS}, {T.PIDS}, h as (select pid, count(*) - 1 as last from routed group by pid),
c as (select p.pid, h.last from pids p left join h on h.pid = p.pid and p.pid % 2 = 0)
select pid, case when last is null then 1 else 3 end::bigint as config_version, 0::bigint as epoch, 0::bigint as start_seq, coalesce(last, -1)::bigint as end_seq, 2 as ack_quorum, '1,2,3' as nodes, 0::bigint as tie_breaker from c
union all select pid, 3, 1, last + 1, -1, 2, '2,3,4', 99 from c where last is not null""")
def seal_and_create(spark, sf):
    last = T.routed(spark, sf).where("pid % 2 = 0").groupBy("pid").agg((F.count("*") - 1).alias("end_seq"))
    changes = last.select("pid", "end_seq", F.array(F.lit(2), F.lit(3), F.lit(4)).alias("nodes"), F.lit(2).alias("quorum"), F.lit(99).cast("long").alias("tie"))
    start = M.bootstrap(_wanted(spark), T.partitions(spark).where("false"))
    return _flat(M.seal_and_create(start, changes))


@query("with have as (select distinct event_type as topic, 'have' as schema_json from events where event_type < 'm'), want as (select event_type || '-' || (user_id % 3) as topic, 's' || min(event_id) as schema_json from events group by 1 union all select event_type, 's' from (select distinct event_type from events)) select topic, schema_json from have union all select topic, schema_json from want where topic not in (select topic from have)")
def topic_create(spark, sf):
    e = T.table(spark, sf, "events")
    have = e.where("event_type < 'm'").select(F.col("event_type").alias("topic"), F.lit("have").alias("schema_json")).distinct()
    want = e.select(F.concat_ws("-", "event_type", F.col("user_id") % 3).alias("topic"), F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("schema_json"), F.col("event_id").alias("arrival"))
    plain = e.select(F.col("event_type").alias("topic"), F.lit("s").alias("schema_json"), F.col("event_id").alias("arrival"))
    return M.create_topics(have, want.unionByName(plain))


_CHANGES = "changes as (select event_type || '-' || (user_id % 7) as topic, case event_id % 5 when 0 then 'ADD' when 1 then 'REPLACE' when 2 then 'ADD' when 3 then 'REPLACE' else case when event_id % 35 = 4 then 'REMOVE' else 'REPLACE' end end as op, 's' || event_id as schema_json, event_id as arrival from events)"


@query(f"""with {_CHANGES}, q as (select *, row_number() over (partition by topic order by arrival) as i from changes),
f as (with recursive x as (
  select topic, 0::bigint as i, null::varchar as s from (select distinct topic from q)
  union all select q.topic, q.i, case when op = 'REMOVE' then null when op = 'ADD' and x.s is null then q.schema_json when op = 'REPLACE' and x.s is not null then q.schema_json else x.s end from x join q on q.topic = x.topic and q.i = x.i + 1)
  select topic, arg_max(struct_pack(s := s), i) as l from x group by topic)
select topic, l.s as schema_json from f where l.s is not null""")
def topic_registry(spark, sf):
    """Additions, replacements and removals of topics, in the order of arrival."""
    k = F.col("event_id") % 5
    op = F.when(k.isin(0, 2), "ADD").when((k == 4) & (F.col("event_id") % 35 == 4), "REMOVE").otherwise("REPLACE")
    e = T.table(spark, sf, "events")
    return M.registry(e.select(F.concat_ws("-", "event_type", F.col("user_id") % 7).alias("topic"), op.alias("op"), F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("schema_json"), F.col("event_id").alias("arrival")))


_ROLL = f"""{T.HWM}, {T.PIDS}, act as (select pid, max(epoch) as epoch, arg_max(hwm, epoch) as last_seq from hw group by pid),
rq as (select act.pid, case when act.pid % 3 = 0 then epoch - 1 else epoch end as epoch, act.epoch as active, last_seq, act.pid % 4 as acks from act),
rr as (select *, case when epoch < active then 'STALE' when acks >= 2 then 'ROLLED' else 'NO_QUORUM' end as status from rq)"""


def _rolled(spark, sf):
    h = L.high_watermark(T.events_log(spark, sf))
    active = h.groupBy("pid").agg(F.max("epoch").alias("epoch"), F.max_by("hwm", "epoch").alias("last_seq"))
    asked = F.when(F.col("pid") % 3 == 0, F.col("epoch") - 1).otherwise(F.col("epoch"))
    requests = active.select("pid", asked.alias("epoch"), F.array(F.lit(2), F.lit(3), F.lit(4)).alias("nodes"), F.lit(2).alias("quorum"), F.lit(99).cast("long").alias("tie"), (F.col("pid") % 4).alias("acks"))
    return M.seal_and_roll(M.bootstrap(_wanted(spark), T.partitions(spark).where("false")), active, requests)


@query(f"with {_ROLL} select pid, epoch, status, case when status = 'STALE' then null else last_seq end as end_seq from rr")
def seal_roll_reply(spark, sf):
    return _rolled(spark, sf)[0]


@query(f"""with {_ROLL}, c as (select p.pid, r.last_seq from pids p left join rr r on r.pid = p.pid and r.status = 'ROLLED')
select pid, case when last_seq is null then 1 else 3 end::bigint as config_version, 0::bigint as epoch, 0::bigint as start_seq, coalesce(last_seq, -1)::bigint as end_seq, 2 as ack_quorum, '1,2,3' as nodes, 0::bigint as tie_breaker from c
union all select pid, 3, 1, last_seq + 1, -1, 2, '2,3,4', 99 from c where last_seq is not null""")
def seal_roll_config(spark, sf):
    return _flat(_rolled(spark, sf)[1])
