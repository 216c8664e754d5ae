"""Scalar functions over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.checksum import crc32c_col
from . import tables as T
from .registry import query

_PACK = "(epoch::bigint << 40) | seq"


@query(f"with {T.LOG} select pid, epoch, seq, {_PACK} as lsn from log")
def lsn_encode(spark, sf):
    return T.events_log(spark, sf).select("pid", "epoch", "seq", C.lsn_encode(F.col("epoch"), F.col("seq")).alias("lsn"))


@query("with x as (select ((o_orderkey % 16777216) - case when o_orderkey % 16777216 >= 8388608 then 16777216 else 0 end) * 1099511627776 + o_custkey as lsn from orders) select lsn, (lsn >> 40) & 16777215 as epoch, lsn & 1099511627775 as seq from x")
def lsn_decode(spark, sf):
    """The epoch is the 24 low bits of the key; those of 2**23 and more make the number negative."""
    orders = T.table(spark, sf, "orders")
    lsn = (F.shiftleft(F.col("o_orderkey").cast("long"), 40) + F.col("o_custkey")).alias("lsn")
    x = orders.select(lsn)
    return x.select("lsn", C.lsn_epoch(F.col("lsn")).alias("epoch"), C.lsn_seq(F.col("lsn")).alias("seq"))


@query("""with x as (select o_orderkey, o_orderkey * 997 as epoch, cast(o_totalprice * 10000000 as bigint) - 100000 as seq from orders)
select o_orderkey, epoch between 0 and 16777215 and seq between 0 and 1099511627775 as valid,
  case when epoch between 0 and 16777215 and seq between 0 and 1099511627775 then (case when epoch >= 8388608 then epoch - 16777216 else epoch end) * 1099511627776 + seq end as lsn from x""")
def lsn_bounds(spark, sf):
    x = T.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * 997).alias("epoch"), (F.round(F.col("o_totalprice") * 10000000).cast("long") - 100000).alias("seq"))
    return x.select("o_orderkey", C.lsn_valid(F.col("epoch"), F.col("seq")).alias("valid"), C.lsn_encode(F.col("epoch"), F.col("seq")).alias("lsn"))


@query(f"with {T.ARRIVALS} select event_id, key, pid from routed")
def partition_key_hash(spark, sf):
    return T.routed(spark, sf).select("event_id", "key", "pid")


@query("select event_id, cast((row_number() over (order by event_id) - 1) % 16 as integer) as pid from events")
def partition_round_robin(spark, sf):
    """Arrival rank without one global sort task: ranks within id ranges, offset by a prefix sum over the ranges."""
    from pyspark.sql import Window

    e = T.table(spark, sf, "events").select("event_id").withColumn("_r", F.shiftright("event_id", 20))
    sizes = e.groupBy("_r").agg(F.count("*").alias("n"))
    base = sizes.withColumn("_base", F.coalesce(F.sum("n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_r", "_base")
    rank = F.row_number().over(Window.partitionBy("_r").orderBy("event_id")) - 1 + F.col("_base")
    return e.join(base, "_r").select("event_id", C.round_robin(rank, 16).alias("pid"))


@query(f"with {T.ARRIVALS} select distinct pid, cast(pid % 5 as integer) as owner from routed")
def partition_owner(spark, sf):
    return T.routed(spark, sf).select("pid").distinct().select("pid", C.partition_owner(F.col("pid"), T.NODES).alias("owner"))


_MSG = f"(pid::bigint << 32) | (((({T.SIGNED.format('h')}) * 31 + ({T.SIGNED.format(T.SQL_HASH.format('payload'))})) % 4294967296 + 4294967296) % 4294967296)"


@query(f"with {T.ARRIVALS} select event_id, pid, {_MSG} as msg_id from routed")
def message_id(spark, sf):
    r = T.routed(spark, sf)
    return r.select("event_id", "pid", C.message_id(F.col("pid"), F.col("key").cast("binary"), F.col("payload").cast("binary")).alias("msg_id"))


@query("select o_orderkey, case when o_custkey <= 2 then 2 else cast(1 as bigint) << length(bin(o_custkey - 1)) end as pow2 from orders")
def next_pow2(spark, sf):
    return T.table(spark, sf, "orders").select("o_orderkey", C.next_pow2(F.col("o_custkey")).alias("pow2"))


@query(f"with {T.CONFIGS} select arrival, ((config_version + 1) << 16) | (arrival & 65535) as tie_breaker from configs")
def tie_breaker(spark, sf):
    return T.configs(spark, sf).select("arrival", C.tie_breaker(F.col("config_version"), F.col("arrival")).alias("tie_breaker"))


@query(f"with {T.LOG} select distinct pid, epoch, 'partition-' || pid || '/epoch-' || lpad(epoch::varchar, 10, '0') as dir from log")
def epoch_dir_name(spark, sf):
    r = T.routed(spark, sf).select("pid", "epoch").distinct()
    return r.select("pid", "epoch", F.concat(F.lit("partition-"), F.col("pid").cast("string"), F.lit("/"), C.epoch_dir(F.col("epoch"))).alias("dir"))


@query("""with x as (select o_orderkey, case o_orderkey % 3 when 0 then 'epoch-' || lpad(o_custkey::varchar, 10, '0') when 1 then 'epoch-x' || o_custkey else 'tmp' end as name from orders)
select o_orderkey, name, try_cast(nullif(regexp_extract(name, '^epoch-(\\d+)$', 1), '') as bigint) as epoch, regexp_replace(name || '.seg', '\\.seg$', '') || '.idx' as idx from x""")
def parse_epoch_dir(spark, sf):
    k = F.col("o_orderkey") % 3
    name = F.when(k == 0, C.epoch_dir(F.col("o_custkey"))).when(k == 1, F.concat(F.lit("epoch-x"), F.col("o_custkey").cast("string"))).otherwise(F.lit("tmp"))
    x = T.table(spark, sf, "orders").select("o_orderkey", name.alias("name"))
    return x.select("o_orderkey", "name", C.parse_epoch_dir(F.col("name")).alias("epoch"), C.index_path(F.concat("name", F.lit(".seg"))).alias("idx"))


@query("""with x as (select o_orderkey, case o_orderkey % 4 when 0 then 'persistence' when 1 then 'Ingestion' when 2 then 'other' end as text from orders)
select o_orderkey, case when upper(text) in ('INGESTION', 'PERSISTENCE') then upper(text) else 'INGESTION' end as role from x""")
def role_parse(spark, sf):
    k = F.col("o_orderkey") % 4
    return T.table(spark, sf, "orders").select("o_orderkey", C.parse_role(F.when(k == 0, "persistence").when(k == 1, "Ingestion").when(k == 2, "other")).alias("role"))


@query(f"with {T.LOG} select pid, cast(sum(octet_length(encode(payload)) + 8) as bigint) as bytes, count(*) as records from log group by pid")
def record_bytes(spark, sf):
    return T.routed(spark, sf).groupBy("pid").agg(F.sum(C.record_bytes(F.col("payload"))).alias("bytes"), F.count("*").alias("records"))


@query("""with x as (select l_orderkey, l_linenumber, cast(l_quantity * 20 as bigint) as pos, 1000 as capacity, cast(l_linenumber * 10 as bigint) as size from lineitem)
select l_orderkey, l_linenumber, capacity - pos >= size + 8 as fits, capacity - pos < 9 as is_full, pos <= 26 as is_empty from x""")
def capacity_flags(spark, sf):
    x = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 20).cast("long").alias("pos"), (F.col("l_linenumber") * 10).alias("size"))
    room = F.lit(1000) - F.col("pos")
    return x.select("l_orderkey", "l_linenumber", (room >= F.col("size") + 8).alias("fits"), (room < 9).alias("is_full"), (F.col("pos") <= C.HEADER_BYTES).alias("is_empty"))


@query(f"with {T.ATTEMPTS} select event_id, case status when 'SUCCESS' then 'SUCCESS' else 'ERROR_REPLICA_NOT_READY' end as ack from attempts")
def ack_status_map(spark, sf):
    return T.attempts(spark, sf).select("event_id", F.when(F.col("status") == "SUCCESS", "SUCCESS").otherwise("ERROR_REPLICA_NOT_READY").alias("ack"))


@query(f"with {T.ARRIVALS} select event_id, case when event_id % 8 > 5 then topic || '.DLQ' else topic end as target, event_id % 8 <= 5 or topic in ('click', 'error') as accepted from routed")
def dlq_route(spark, sf):
    """Dead-letter topics exist for two of the topics only; a message without one is refused."""
    r = T.arrivals(spark, sf).withColumn("target", C.dlq_topic(F.col("topic"), F.col("event_id") % 8))
    topics = spark.createDataFrame([("click.DLQ",), ("error.DLQ",)], "target string").withColumn("known", F.lit(True))
    out = r.join(F.broadcast(topics), "target", "left")  # two rows
    return out.select("event_id", "target", ((F.col("target") == F.col("topic")) | F.col("known").isNotNull()).alias("accepted"))


@query("select * from (values ('', 0::bigint), ('a', 3251651376), ('abc', 910901175), ('123456789', 3808858755), ('The quick brown fox jumps over the lazy dog', 576848900)) v(name, crc32c)")
def crc32c_vectors(spark, sf):
    """Published check values of the checksum."""
    names = spark.createDataFrame([(x,) for x in ("", "a", "abc", "123456789", "The quick brown fox jumps over the lazy dog")], "name string")
    return names.select("name", crc32c_col(F.col("name").cast("binary")).alias("crc32c"))


@query()
def crc32c_records(spark, sf):
    return T.events_log(spark, sf).select("pid", "epoch", "seq", crc32c_col(F.col("payload").cast("binary")).alias("crc32c"))
