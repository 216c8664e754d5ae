"""How the star-schema tables play the roles of a log: arrivals, nodes, commits, attempts, configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import log as L

PARTITIONS, EPOCH_EVENTS, NODES = 16, 2500, 5


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """event_id (arrival order), ts, user_id, topic, key, payload, value."""
    e = table(spark, sf, "events")
    return e.select("event_id", "ts", "user_id", F.col("event_type").alias("topic"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("key"), F.col("props").alias("payload"), "value")


def events_log(spark: SparkSession, sf: str) -> DataFrame:
    epoch = F.floor(F.col("event_id") / EPOCH_EVENTS)
    return L.build_log(arrivals(spark, sf), order="event_id", key="key", payload="payload", topic="topic", epoch=epoch, partitions=PARTITIONS)


def routed(spark: SparkSession, sf: str) -> DataFrame:
    """Arrivals with their partition and epoch, before sequencing."""
    return arrivals(spark, sf).withColumns({"pid": C.key_partition(F.col("key").cast("binary"), PARTITIONS), "epoch": F.floor(F.col("event_id") / EPOCH_EVENTS).cast("long")})


def members(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes from suppliers: role by parity."""
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").cast("long").alias("broker_id"), F.when(F.col("s_suppkey") % 2 == 0, "PERSISTENCE").otherwise("INGESTION").alias("role"), F.col("s_name").alias("address"))


def partitions(spark: SparkSession) -> DataFrame:
    return spark.range(PARTITIONS).select(F.col("id").cast("int").alias("pid"))


def commits(spark: SparkSession, sf: str) -> DataFrame:
    """Every event commits an offset for one of four groups."""
    r = routed(spark, sf)
    return r.select(F.col("event_id").alias("commit_order"), "topic", F.concat(F.lit("g"), (F.col("user_id") % 4).cast("string")).alias("grp"), "pid", (F.col("event_id") % 1000).alias("off"))


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Replication attempts: batches of five events, a node each; errors fail."""
    r = routed(spark, sf)
    lat = F.floor(F.abs("value") * 1e6).cast("long")
    return r.select("pid", F.floor(F.col("event_id") / 5).cast("long").alias("batch_id"), (F.col("event_id") % NODES).alias("node_id"), F.when(F.col("topic") == "error", "FAILURE").when(F.col("event_id") % 7 == 0, "FAILURE").otherwise("SUCCESS").alias("status"), lat.alias("latency_ns"), "event_id")


def stored_log(spark: SparkSession, sf: str) -> DataFrame:
    """The log as L.write_log stores it, written once a session and table: fetches read the files they need."""
    from ..streaming.streams import shared

    key = f"{spark.sparkContext.applicationId}:{sf}"
    if key not in _stored:
        _stored[key] = shared(spark, "log")
        L.write_log(events_log(spark, sf).select("pid", "epoch", "seq", "topic", "key", "payload", "event_id"), _stored[key])
    return spark.read.parquet(_stored[key])


_stored: dict[str, str] = {}


def configs(spark: SparkSession, sf: str) -> DataFrame:
    """Configuration updates as they arrive, versions out of order."""
    o = table(spark, sf, "orders")
    return o.select((F.col("o_custkey") % 64).cast("int").alias("pid"), (F.col("o_orderkey") % 97).cast("long").alias("config_version"), F.col("o_orderkey").alias("arrival"), (F.col("o_orderkey") % 11).cast("long").alias("epoch"), (F.col("o_orderkey") % 13).cast("long").alias("tie"))


def epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Epoch metadata of the log: all but the newest epoch of each partition are sealed; three nodes hold each."""
    h = L.high_watermark(events_log(spark, sf))
    newest = h.groupBy("pid").agg(F.max("epoch").alias("newest"))
    h = h.join(newest, "pid")
    node = lambda k: F.pmod(F.col("pid") + F.col("epoch") + k, F.lit(NODES)).cast("int")
    return h.select("pid", "epoch", F.lit(0).cast("long").alias("start_seq"), F.when(F.col("epoch") < F.col("newest"), F.col("hwm")).otherwise(F.lit(-1)).alias("end_seq"), F.lit(2).alias("ack_quorum"), F.array(node(0), node(1), node(2)).alias("storage_nodes"), (F.col("epoch") * 7 + 1).alias("tie_breaker"))


def append_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Replica appends with duplicates, gaps, overlaps, stale epochs and sealed ends, from the log."""
    log = events_log(spark, sf)
    base = F.col("seq") - F.when(F.col("event_id") % 7 == 0, 1).otherwise(0) + F.when(F.col("event_id") % 29 == 0, 2).otherwise(0)
    back = F.when((F.col("event_id") % 41 == 0) & (F.col("epoch") > 0), F.col("epoch") - 1).otherwise(F.col("epoch"))
    return log.select("pid", F.col("event_id").alias("arrival"), "topic", back.cast("long").alias("epoch"), F.greatest(base, F.lit(0)).cast("long").alias("base_seq"), (F.col("event_id") % 4).cast("long").alias("n"), F.when(F.col("pid") % 5 == 0, F.lit(100).cast("long")).alias("sealed_end"))


#: The same roles for SQL: common table expressions to put before a query.
SQL_HASH = "list_reduce(list_prepend(1::bigint, list_transform(range(1, len({0}) + 1), lambda i: ascii({0}[i])::bigint)), lambda a, b: (a * 31 + b) % 4294967296)"
SIGNED = "(case when {0} >= 2147483648 then {0} - 4294967296 else {0} end)"
ARRIVALS = f"""ev as (select event_id, ts, user_id, event_type as topic, 'user-' || user_id as key, props as payload, value from events),
hashed as (select *, {SQL_HASH.format('key')} as h from ev),
routed as (select *, cast((({SIGNED.format('h')}) % 16 + 16) % 16 as integer) as pid, event_id // 2500 as epoch from hashed)"""
LOG = ARRIVALS + """,
log as (select pid, epoch, row_number() over (partition by pid, epoch order by event_id) - 1 as seq, topic, key, payload, value, event_id, user_id, ts from routed)"""
HWM = LOG + ", hw as (select pid, epoch, max(seq) as hwm, count(*) as records from log group by pid, epoch)"
EPOCHS = HWM + """, nw as (select pid, max(epoch) as newest from hw group by pid),
epochs as (select hw.pid, epoch, 0::bigint as start_seq, case when epoch < newest then hwm else -1 end as end_seq, 2 as ack_quorum,
  [cast((hw.pid + epoch) % 5 as integer), cast((hw.pid + epoch + 1) % 5 as integer), cast((hw.pid + epoch + 2) % 5 as integer)] as storage_nodes, epoch * 7 + 1 as tie_breaker from hw join nw on hw.pid = nw.pid)"""
COMMITS = ARRIVALS + ", commits as (select event_id as commit_order, topic, 'g' || (user_id % 4) as grp, pid, event_id % 1000 as off from routed)"
ATTEMPTS = ARRIVALS + """, attempts as (select pid, event_id // 5 as batch_id, event_id % 5 as node_id,
  case when topic = 'error' or event_id % 7 = 0 then 'FAILURE' else 'SUCCESS' end as status, cast(floor(abs(value) * 1e6) as bigint) as latency_ns, event_id from routed)"""
CONFIGS = "configs as (select cast(o_custkey % 64 as integer) as pid, o_orderkey % 97 as config_version, o_orderkey as arrival, o_orderkey % 11 as epoch, o_orderkey % 13 as tie from orders)"
MEMBERS = "members as (select cast(s_suppkey as bigint) as broker_id, case when s_suppkey % 2 = 0 then 'PERSISTENCE' else 'INGESTION' end as role, s_name as address from supplier)"
PIDS = "pids as (select cast(range as integer) as pid from range(16))"
_M = "(({0})::uhugeint * {1}::uhugeint % 18446744073709551616::uhugeint)::ubigint"
_X = "xor({0}, {0} >> 33)"


def _score() -> str:
    """Steps of the rendezvous score over unsigned 64-bit integers, one subquery a step."""
    s = "select pid, broker_id, role, address, xor(" + _M.format("pid", 0x9E3779B97F4A7C15) + ", broker_id::ubigint) as h from pids cross join {members}"
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        s = f"select pid, broker_id, role, address, {_M.format(_X.format('h'), c)} as h from ({s})"
    last = _X.format("h")
    signed = "case when h >= 9223372036854775808 then cast(h::hugeint - 18446744073709551616::hugeint as bigint) else h::bigint end"
    return f"select pid, broker_id, role, address, {signed} as score from (select pid, broker_id, role, address, {last} as h from ({s}))"


def scores_sql(members: str = "members") -> str:
    return _score().replace("{members}", members)


SEGMENTS = HWM + """, sized as (select pid, epoch, seq, octet_length(encode(payload)) + 8 as bytes from log),
packing as (with recursive f as (
  select pid, epoch, seq, bytes, 0::bigint as seg, 26 + bytes as used from sized where seq = 0
  union all
  select s.pid, s.epoch, s.seq, s.bytes, case when f.used + s.bytes > 1024 then f.seg + 1 else f.seg end, case when f.used + s.bytes > 1024 then 26 + s.bytes else f.used + s.bytes end
  from f join sized s on s.pid = f.pid and s.epoch = f.epoch and s.seq = f.seq + 1) select pid, epoch, seq, cast(bytes as bigint) as bytes, seg from f),
segs as (select pid, epoch, seg, min(seq) as first_seq, max(seq) as last_seq, count(*) as n, cast(sum(bytes) + 26 as bigint) as bytes from packing group by pid, epoch, seg)"""
