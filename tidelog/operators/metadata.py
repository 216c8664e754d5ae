"""Epoch configurations, fences and topic catalogue as pure transitions over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPOCH = "struct<epoch:bigint,start_seq:bigint,end_seq:bigint,ack_quorum:int,storage_nodes:array<int>,tie_breaker:bigint>"


def placement_valid(nodes: Column, quorum: Column) -> Column:
    return nodes.isNotNull() & (F.size(nodes) > 0) & (quorum > 0) & (quorum <= F.size(nodes))


def epoch_valid(start_seq: Column, end_seq: Column) -> Column:
    """Non-negative start; a sealed epoch (end >= 0) does not end before it starts."""
    return (start_seq >= 0) & ((end_seq < 0) | (end_seq >= start_seq))


def snapshot(configs: DataFrame) -> DataFrame:
    """The newest configuration of each partition: the greatest version, of equal ones the earliest arrival."""
    other = [c for c in configs.columns if c not in ("pid", "config_version", "arrival")]
    best = F.max_by(F.struct(*other), F.struct("config_version", (-F.col("arrival")).alias("a"))).alias("_c")
    return configs.groupBy("pid").agg(F.max("config_version").alias("config_version"), best).select("pid", "config_version", "_c.*")


def accepted_updates(configs: DataFrame) -> DataFrame:
    """Adds accepted: strictly newer than all that arrived before."""
    w = Window.partitionBy("pid").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    return configs.withColumn("accepted", F.col("config_version") > F.coalesce(F.max("config_version").over(w), F.lit(-1)))


def stale(df: DataFrame, order: str) -> DataFrame:
    """Adds stale: a higher epoch of the partition arrived before."""
    w = Window.partitionBy("pid").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max("epoch").over(w), F.lit(-1)).cast("long")
    return df.withColumn("highest_before", seen).withColumn("stale", F.col("epoch") < F.col("highest_before"))


def open_epoch(requests: DataFrame) -> DataFrame:
    """Adds accepted: (epoch, tie) is lexicographically above all requests before."""
    w = Window.partitionBy("pid").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(F.struct("epoch", "tie")).over(w)
    return requests.withColumn("accepted", best.isNull() | (F.struct("epoch", "tie") > best))


def seal(active: DataFrame, requests: DataFrame) -> DataFrame:
    """pid, epoch, status of seal requests against active epochs (pid, epoch, last_seq): SEALED, STALE or MISMATCH."""
    a = active.select("pid", F.col("epoch").alias("_active"), F.col("last_seq").alias("_last"))
    r = requests.join(a, "pid", "left")
    status = F.when(F.col("_active").isNull() | (F.col("epoch") > F.col("_active")), "MISMATCH").when(F.col("epoch") < F.col("_active"), "STALE").otherwise("SEALED")
    return r.select("pid", "epoch", status.alias("status"), F.when(status == "SEALED", F.col("_last")).alias("end_seq"))


def bootstrap(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Configurations of version 1 for partitions that have none."""
    fresh = wanted.join(existing.select("pid"), "pid", "left_anti")
    first = F.struct(F.lit(0).cast("long").alias("epoch"), F.lit(0).cast("long").alias("start_seq"), F.lit(-1).cast("long").alias("end_seq"), F.col("ack_quorum").cast("int").alias("ack_quorum"), F.col("storage_nodes"), F.lit(0).cast("long").alias("tie_breaker"))
    return fresh.select("pid", F.lit(1).cast("long").alias("config_version"), F.array(first).alias("epochs"))


def seal_and_create(configs: DataFrame, changes: DataFrame) -> DataFrame:
    """Seals the active epoch at end_seq and appends the next one; the version rises by 2 (seal, append).

    changes: pid, end_seq, nodes, quorum, tie. Partitions without a change stay as they are.
    """
    c = configs.join(changes, "pid", "left")
    last = F.element_at("epochs", -1)
    sealed = F.concat(F.slice("epochs", 1, F.greatest(F.size("epochs") - 1, F.lit(0))), F.array(last.withField("end_seq", F.col("end_seq").cast("long"))))
    fresh = F.struct((last["epoch"] + 1).alias("epoch"), (F.col("end_seq") + 1).cast("long").alias("start_seq"), F.lit(-1).cast("long").alias("end_seq"), F.col("quorum").cast("int").alias("ack_quorum"), F.col("nodes").alias("storage_nodes"), F.col("tie").cast("long").alias("tie_breaker"))
    changed = F.col("end_seq").isNotNull()
    return c.select("pid", F.when(changed, F.col("config_version") + 2).otherwise(F.col("config_version")).alias("config_version"), F.when(changed, F.concat(sealed.cast(f"array<{EPOCH}>"), F.array(fresh.cast(EPOCH)))).otherwise(F.col("epochs").cast(f"array<{EPOCH}>")).alias("epochs"))


def explode_epochs(configs: DataFrame) -> DataFrame:
    return configs.select("pid", "config_version", F.explode("epochs").alias("e")).select("pid", "config_version", "e.*")


def implode_epochs(epochs: DataFrame) -> DataFrame:
    fields = ("epoch", "start_seq", "end_seq", "ack_quorum", "storage_nodes", "tie_breaker")
    return epochs.groupBy("pid", "config_version").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("epochs"))


def rollover(order_in_pid: Column, threshold: int) -> Column:
    """Epoch of the n-th record (from 0) of a partition that rolls over every `threshold` records."""
    return F.floor(order_in_pid / threshold).cast("long")


def create_topics(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """The catalogue with requested topics that it lacks: the first request of each name."""
    first = requests.groupBy("topic").agg(F.min_by("schema_json", "arrival").alias("schema_json"))
    return catalog.unionByName(first.join(catalog.select("topic"), "topic", "left_anti"))


def registry(changes: DataFrame) -> DataFrame:
    """topic, schema_json of the topics that are there after changes (topic, op, schema_json, arrival).

    ADD takes effect where the topic is absent, REPLACE where it is present, REMOVE takes it away: what counts is the
    last REMOVE, the first ADD behind it, and the last REPLACE behind that. All are aggregates, so a topic that changes
    very often is combined before it is shuffled.
    """
    at = lambda op: F.max(F.when(F.col("op") == op, F.col("arrival")))
    gone = changes.groupBy("topic").agg(F.coalesce(at("REMOVE"), F.lit(-1)).alias("_gone"))
    left = changes.join(gone, "topic").where(F.col("arrival") > F.col("_gone"))
    added = F.min_by(F.when(F.col("op") == "ADD", F.struct("arrival", "schema_json")), F.when(F.col("op") == "ADD", F.col("arrival"))).alias("_a")
    added = left.groupBy("topic").agg(added).where("_a is not null")
    swaps = left.where("op = 'REPLACE'").join(added, "topic").where("arrival > _a.arrival")
    last = swaps.groupBy("topic").agg(F.max_by(F.struct("schema_json"), F.col("arrival")).alias("_r"))
    return added.join(last, "topic", "left").select("topic", F.when(F.col("_r").isNotNull(), F.col("_r.schema_json")).otherwise(F.col("_a.schema_json")).alias("schema_json"))


def seal_and_roll(configs: DataFrame, active: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seals what requests (pid, epoch, nodes, quorum, tie, acks) ask for, and opens the next epoch where it may.

    Gives the replies (pid, epoch, status, end_seq) and the configurations after them. An epoch is rolled only if it is
    the active one and `acks` nodes, a quorum of the new placement, opened the next; sealed without that it stays last.
    """
    done = seal(active, requests.select("pid", "epoch")).join(requests, ["pid", "epoch"])
    rolled = (F.col("status") == "SEALED") & (F.col("acks") >= F.col("quorum")) & placement_valid(F.col("nodes"), F.col("quorum"))
    status = F.when((F.col("status") == "SEALED") & ~rolled, "NO_QUORUM").when(rolled, "ROLLED").otherwise(F.col("status"))
    replies = done.select("pid", "epoch", status.alias("status"), "end_seq")
    return replies, seal_and_create(configs, done.where(rolled).select("pid", "end_seq", "nodes", "quorum", "tie"))
