"""Extensions: general SQL operations over logs that come free with the engine."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import tables as T
from .registry import query


@query("select date_trunc('day', ts) as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def ext_tumbling(spark, sf):
    e = T.table(spark, sf, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type")
    return e.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


@query("with o as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hours then 0 else 1 end as c from events), s as (select *, sum(c) over (partition by user_id order by ts rows unbounded preceding) as k from o) select user_id, min(ts) as started, count(*) as n from s group by user_id, k")
def ext_session(spark, sf):
    e = T.table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("t", "2 hours")).agg(F.min("ts").alias("started"), F.count("*").alias("n"))
    return s.select("user_id", "started", "n")


@query("select l_returnflag, l_linestatus, count(*) as n, cast(sum(l_quantity) as bigint) as qty from lineitem group by cube (l_returnflag, l_linestatus)")
def ext_cube(spark, sf):
    return T.table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("qty"))


@query("select l_returnflag, l_shipdate is not null as shipped, count(distinct l_suppkey) as suppliers from lineitem group by rollup (l_returnflag, l_shipdate is not null)")
def ext_rollup(spark, sf):
    l = T.table(spark, sf, "lineitem").select("l_returnflag", F.col("l_shipdate").isNotNull().alias("shipped"), "l_suppkey")
    return l.rollup("l_returnflag", "shipped").agg(F.countDistinct("l_suppkey").alias("suppliers"))


@query("select a.event_id, b.event_id as previous_error from events a left join lateral (select max(event_id) as event_id from events b where b.user_id = a.user_id and b.event_type = 'error' and b.event_id < a.event_id) b on true")
def ext_asof(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return T.table(spark, sf, "events").select("event_id", F.last(F.when(F.col("event_type") == "error", F.col("event_id")), ignorenulls=True).over(w).alias("previous_error"))


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'F')")
def ext_semi(spark, sf):
    o = T.table(spark, sf, "orders").where("o_orderstatus = 'F'")
    c = T.table(spark, sf, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def ext_anti(spark, sf):
    c, o = T.table(spark, sf, "customer"), T.table(spark, sf, "orders").where("o_orderstatus = 'P'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("select o_custkey from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O'")
def ext_intersect(spark, sf):
    o = T.table(spark, sf, "orders")
    return o.where("o_orderstatus = 'F'").select("o_custkey").intersect(o.where("o_orderstatus = 'O'").select("o_custkey"))


@query()
def ext_approx(spark, sf):
    return T.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.percentile_approx("l_extendedprice", 0.5, 10000).alias("median"))


@query("select l_suppkey, l_orderkey, l_linenumber, cast(rank() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as integer) as place from lineitem qualify place <= 3")
def ext_topk(spark, sf):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return T.table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.rank().over(w).alias("place")).where("place <= 3")


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def ext_json(spark, sf):
    return T.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
