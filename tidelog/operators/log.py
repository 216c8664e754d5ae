"""Building, routing and reading a partitioned, epoch-structured log."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def assign_seq(df: DataFrame, order: str, name: str = "seq") -> DataFrame:
    """Contiguous 0-based sequence numbers in arrival order within (pid, epoch): one shuffle on the partition key."""
    w = Window.partitionBy("pid", "epoch").orderBy(order)
    return df.withColumn(name, (F.row_number().over(w) - 1).cast("long"))


def build_log(df: DataFrame, *, order: str, key: str, payload: str, topic: str, epoch: Column, partitions: int = 16) -> DataFrame:
    """pid, epoch, seq, topic, key, payload and the arrival order of every message; other columns are kept."""
    out = df.withColumns({"pid": C.key_partition(F.col(key).cast("binary"), partitions), "epoch": epoch.cast("long")})
    out = out.withColumnsRenamed({k: v for k, v in ((key, "key"), (payload, "payload"), (topic, "topic")) if k != v})
    return assign_seq(out, order)


def write_log(log: DataFrame, path: str, mode: str = "append") -> None:
    """Store a log so that fetches prune the directories of other partitions, and row groups of other epochs and places.

    Tasks get ranges of (pid, epoch, seq), so that a partition that holds most of the records is written by many.
    """
    order = ["pid", "epoch", "seq"]
    log.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("pid").parquet(path)


def lsn_range(start: int | None = None, end: int | None = None) -> Column:
    """Condition start <= LSN < end on the physical (epoch, seq) columns, which scans can push down."""
    cond = F.lit(True)
    for lsn, lower in ((start, True), (end, False)):
        if lsn is None:
            continue
        e, s = lsn >> C.SEQ_BITS & C.MAX_EPOCH, lsn & C.MAX_SEQ
        ep, sq = F.col("epoch"), F.col("seq")
        cond &= ((ep >= e) & ((ep > e) | (sq >= s))) if lower else ((ep <= e) & ((ep < e) | (sq < s)))
    return cond


def fetch(log: DataFrame, pid: int, epoch: int, seq: int, limit: int) -> DataFrame:
    """Up to `limit` records of one epoch from `seq` on (a negative one counts as 0), in order."""
    hit = log.where((F.col("pid") == pid) & (F.col("epoch") == epoch) & (F.col("seq") >= max(seq, 0)))
    return hit.orderBy("seq").limit(limit)


def fetch_active(log: DataFrame, pid: int, seq: int, limit: int) -> DataFrame:
    """The same in the partition's newest epoch."""
    own = log.where(F.col("pid") == pid)
    newest = own.agg(F.max("epoch").alias("epoch"))  # one row
    return own.join(F.broadcast(newest), "epoch").where(F.col("seq") >= max(seq, 0)).orderBy("seq").limit(limit)


def until_gap(log: DataFrame) -> DataFrame:
    """Records from seq 0 on before the first missing sequence number of each (pid, epoch)."""
    w = Window.partitionBy("pid", "epoch").orderBy("seq")
    return log.withColumn("_place", F.row_number().over(w) - 1).where("seq = _place").drop("_place")


def fetch_batch(requests: DataFrame, log: DataFrame, placement: DataFrame, node: int, compat: bool = False) -> DataFrame:
    """Answers many fetches at once: request_id, status, n, first_seq, last_seq, redirect.

    requests: request_id, pid, epoch, seq, max_messages; placement: pid, epoch, storage_nodes. A node outside a
    placement redirects; an unknown epoch is missing; a fetch past the end is OK and empty (missing when compat).
    """
    known = log.groupBy("pid", "epoch").agg(F.max("seq").alias("hwm"))
    r = requests.join(placement, ["pid", "epoch"], "left").join(known, ["pid", "epoch"], "left")
    n = F.when(F.col("hwm") >= F.greatest("seq", F.lit(0)), F.least(F.col("hwm") - F.greatest("seq", F.lit(0)) + 1, F.col("max_messages").cast("long"))).otherwise(F.lit(0))
    away = F.col("storage_nodes").isNotNull() & ~F.array_contains("storage_nodes", F.lit(node))
    missing = F.col("hwm").isNull() | (F.lit(compat) & (n == 0) & F.col("storage_nodes").isNotNull())
    status = F.when(away, "NOT_IN_PLACEMENT").when(missing, "EPOCH_MISSING").otherwise("OK")
    out = r.withColumn("status", status).withColumn("n", F.when(F.col("status") == "OK", n).otherwise(F.lit(0)).cast("long"))
    first = F.when(F.col("n") > 0, F.greatest("seq", F.lit(0)).cast("long"))
    redirect = F.when(F.col("status") == "NOT_IN_PLACEMENT", F.array_join(F.transform("storage_nodes", lambda x: x.cast("string")), ",")).otherwise(F.lit(""))
    return out.select("request_id", "status", "n", first.alias("first_seq"), (first + F.col("n") - 1).alias("last_seq"), redirect.alias("redirect"))


def fetch_records(requests: DataFrame, log: DataFrame, answers: DataFrame) -> DataFrame:
    """The records of fetch_batch's answers: request_id, place (from 0), pid, epoch, seq, topic, key, payload, lsn.

    A record is looked up by the numbers that its request was granted, so a record that many ask for is joined by
    equality, in as many tasks as there are partitions of it.
    """
    own = answers.where("n > 0").join(requests.select("request_id", "pid", "epoch"), "request_id")
    rows = own.select("request_id", "pid", "epoch", "first_seq", F.explode(F.sequence("first_seq", "last_seq")).alias("seq"))
    found = rows.join(log.select("pid", "epoch", "seq", "topic", "key", "payload"), ["pid", "epoch", "seq"])
    return found.select("request_id", (F.col("seq") - F.col("first_seq")).alias("place"), "pid", "epoch", "seq", "topic", "key", "payload", C.lsn_encode(F.col("epoch"), F.col("seq")).alias("lsn"))


def pinned_partition(pin: Column, key: Column, partitions: int) -> Column:
    """The partition a publisher names, if it names one above 0; else that of the key."""
    return F.when(pin > 0, F.pmod(pin, F.lit(partitions)).cast("int")).otherwise(C.key_partition(key, partitions))


def backpressure(publishes: DataFrame, takes: int, most: int = 8192, most_bytes: int = 256 << 20) -> DataFrame:
    """pid, t, inflight, bytes, rejected: a publish (pid, t, b) is refused where `most` of its partition's accepted ones
    are unfinished, or its bytes with theirs are over most_bytes. One takes `takes` units of t; refused ones take none.

    A partition is one ordered fold, a sorted batch at a time; what is held are its unfinished publishes, `most` at most.
    """
    import pandas as pd

    def fold(frames):
        of, held, size = None, deque(), 0
        for pdf in frames:
            out = []
            for pid, t, b in zip(pdf["pid"].tolist(), pdf["t"].tolist(), pdf["b"].tolist()):
                if pid != of:
                    of, held, size = pid, deque(), 0
                while held and held[0][0] + takes < t:
                    size -= held.popleft()[1]
                refused = len(held) >= most or size + b > most_bytes
                out.append((pid, t, len(held), size, refused))
                if not refused:
                    held.append((t, b))
                    size += b
            yield pd.DataFrame(out, columns=["pid", "t", "inflight", "bytes", "rejected"])

    own = publishes.select("pid", "t", "b").repartition("pid").sortWithinPartitions("pid", "t")
    return own.mapInPandas(fold, "pid int, t long, inflight long, bytes long, rejected boolean")


def envelopes(df: DataFrame) -> DataFrame:
    """corr_id, kind, message: publishes as the request they travel in; a message without a key has a null one."""
    message = F.struct("topic", F.coalesce("retries", F.lit(0)).cast("int").alias("retries"), F.col("payload").cast("binary").alias("payload"), F.col("key").cast("binary").alias("key"), F.coalesce("pid", F.lit(0)).cast("int").alias("partition_id"))
    return df.select("corr_id", F.lit("PUBLISH").alias("kind"), message.alias("message"))


def replies(acks: DataFrame) -> DataFrame:
    """corr_id, kind, status, offset, error: what answers a request, by its kind; failures carry a text, successes none."""
    ok = F.col("status") == "SUCCESS"
    kind = F.when(F.col("request") == "PUBLISH", "PUBLISH_REPLY").when(F.col("request") == "COMMIT", "COMMIT_ACK").when(F.col("request") == "APPEND", "REPLICATION_ACK").otherwise("ERROR")
    return acks.select("corr_id", kind.alias("kind"), F.when(kind == "ERROR", "INVALID_REQUEST").otherwise(F.col("status")).alias("status"), F.when(ok & (kind != "ERROR"), F.col("offset")).otherwise(F.lit(-1)).cast("long").alias("offset"), F.when(ok & (kind != "ERROR"), "").otherwise(F.concat_ws(" ", F.col("request"), F.lit("failed:"), F.col("status"))).alias("error"))


def visit(log: DataFrame, visitor, schema: str, pid: int | None = None) -> DataFrame:
    """Calls visitor(lsn, key, payload) for every record in (pid, epoch, seq) order; its rows, if any, are the result.

    Records of a (pid, epoch) are visited in one task, a sorted batch at a time; a visitor that returns False ends it.
    """
    import pandas as pd

    def run(frames):
        of, over = None, False
        for pdf in frames:
            out = []
            for pid, epoch, lsn, key, payload in zip(*(pdf[c].tolist() for c in ("pid", "epoch", "lsn", "key", "payload"))):
                if (pid, epoch) != of:
                    of, over = (pid, epoch), False
                if over:
                    continue
                got = visitor(lsn, key, payload)
                if got is False:
                    over = True
                elif got is not None:
                    out.append(got)
            yield pd.DataFrame(out, columns=names)

    names = [f.name for f in log.sparkSession.createDataFrame([], schema).schema]
    own = log if pid is None else log.where(F.col("pid") == pid)
    own = own.select("pid", "epoch", C.lsn_encode(F.col("epoch"), F.col("seq")).alias("lsn"), "seq", "key", "payload")
    return own.repartition("pid", "epoch").sortWithinPartitions("pid", "epoch", "seq").mapInPandas(run, schema)


def check_arguments(*, ring: int = 2, batch: int = 1, partitions: int = 1, quorum: int = 1, nodes: int = 1) -> None:
    """Raises ValueError for what no log can be built with."""
    if ring < 2 or ring & (ring - 1):
        raise ValueError("a ring has a power of two of slots, two at least")
    if not 0 < batch <= ring:
        raise ValueError("a batch has one message at least and no more than the ring has slots")
    if partitions < 1:
        raise ValueError("there is one partition at least")
    if not 0 < quorum <= nodes:
        raise ValueError("a quorum is one node at least and no more than there are")


#: Partitioners by name: functions of (row's key, its arrival rank, partitions) columns; register others here.
PARTITIONERS: dict[str, Callable[[Column, Column, int], Column]] = {
    "key_hash": lambda key, rank, n: C.key_partition(key.cast("binary"), n),
    "round_robin": lambda key, rank, n: C.round_robin(rank, n),
}


def route(df: DataFrame, partitioner: str, key: str, rank: str, partitions: int) -> DataFrame:
    """Adds pid by a registered partitioner."""
    check_arguments(partitions=partitions)
    return df.withColumn("pid", PARTITIONERS[partitioner](F.col(key), F.col(rank), partitions))


def publish_batches(df: DataFrame, order: str, keys: list[str], most: int, within: list[str]) -> DataFrame:
    """Numbers runs of successive rows with equal `keys`, cut at `most` rows: adds batch_id (from 1) per `within`."""
    w = Window.partitionBy(*within).orderBy(order)
    change = F.lit(False)
    for k in keys:
        change |= ~F.col(k).eqNullSafe(F.lag(k).over(w))
    run = df.withColumn("_run", F.sum(F.when(change | (F.row_number().over(w) == 1), 1).otherwise(0)).over(w))
    inner = Window.partitionBy(*within, "_run").orderBy(order)
    cut = run.withColumn("_first", ((F.row_number().over(inner) - 1) % most == 0).cast("int"))
    return cut.withColumn("batch_id", F.sum("_first").over(w)).drop("_run", "_first")


def dedup(df: DataFrame, order: str, id_col: str = "msg_id") -> DataFrame:
    """The first arrival of each (pid, message id): one shuffle, before which tasks drop what they see is later."""
    first = F.row_number().over(Window.partitionBy("pid", id_col).orderBy(order))
    return df.withColumn("_place", first).where("_place = 1").drop("_place")


def high_watermark(log: DataFrame) -> DataFrame:
    return log.groupBy("pid", "epoch").agg(F.max("seq").alias("hwm"), F.count("*").alias("records"))


def last_n(log: DataFrame, n: int) -> DataFrame:
    """The newest n records of each (pid, epoch): what a ring of n slots still shows."""
    top = log.groupBy("pid", "epoch").agg(F.max("seq").alias("_top"))
    return log.join(top, ["pid", "epoch"]).where(F.col("seq") > F.col("_top") - n).drop("_top")


def admitted(df: DataFrame, topics: DataFrame) -> DataFrame:
    """Messages of registered topics; `topics` is a catalogue, broadcast only if statistics prove it small."""
    return df.join(topics.select("topic"), "topic", "left_semi")


def exactly_once_audit(expected: DataFrame, delivered: DataFrame, id_col: str) -> DataFrame:
    """One row: missing, extra and duplicated ids of a delivery."""
    e = expected.groupBy(id_col).agg(F.count("*").alias("ne")).withColumn("nd", F.lit(0).cast("long"))
    d = delivered.groupBy(id_col).agg(F.count("*").alias("nd")).withColumn("ne", F.lit(0).cast("long"))
    both = e.unionByName(d).groupBy(id_col).agg(F.sum("ne").alias("ne"), F.sum("nd").alias("nd"))
    c = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
    return both.agg(c((F.col("ne") > 0) & (F.col("nd") == 0), "missing"), c((F.col("ne") == 0) & (F.col("nd") > 0), "extra"), c(F.col("nd") > F.greatest("ne", F.lit(1)), "duplicated"), F.sum("nd").alias("delivered"))
