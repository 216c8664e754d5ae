"""Membership, rendezvous placement, quorum and latency tracking."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def latest_members(heartbeats: DataFrame) -> DataFrame:
    """One row per node: its newest heartbeat; of equally new ones the earliest arrival (column arrival)."""
    newest = F.max_by(F.struct("role", "ts", "vnodes"), F.struct("ts", (-F.col("arrival")).alias("a"))).alias("m")
    return heartbeats.groupBy("broker_id").agg(newest).select("broker_id", "m.*")


def live(members: DataFrame, now: Column, timeout_ms: int = 3000) -> DataFrame:
    """Members heard from within the timeout; timestamps in epoch milliseconds (ts_ms)."""
    return members.where(now - F.col("ts_ms") <= timeout_ms)


def overlay(static: DataFrame, gossip: DataFrame) -> DataFrame:
    """Static and gossiped members; the gossiped entry wins."""
    s = static.select("broker_id", F.struct("role", "address").alias("s"))
    g = gossip.select("broker_id", F.struct("role", "address").alias("g"))
    return s.join(g, "broker_id", "full_outer").select("broker_id", F.coalesce("g", "s").alias("m")).select("broker_id", "m.*")


def eligible(members: DataFrame, role: str = "PERSISTENCE") -> DataFrame:
    """Members of the role, or all of them where there is none."""
    has = members.agg(F.max((F.col("role") == role).cast("int")).alias("_has"))  # one row
    return members.crossJoin(F.broadcast(has)).where((F.col("role") == role) | (F.col("_has") == 0)).drop("_has")


def scored(partitions: DataFrame, members: DataFrame) -> DataFrame:
    """Every partition with every member and its score; the partitions are a catalogue, not data."""
    return F.broadcast(partitions).crossJoin(members).withColumn("score", C.rendezvous_score(F.col("pid"), F.col("broker_id")))


def replica_set(partitions: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """pid, place (from 1), broker_id: the n best eligible members of every partition."""
    w = Window.partitionBy("pid").orderBy(F.desc("score"), "broker_id")
    return scored(partitions, eligible(members)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("pid", "place", "broker_id", "score")


def primary(partitions: DataFrame, members: DataFrame) -> DataFrame:
    """pid, primary: the best INGESTION member, -1 where there is none."""
    best = scored(partitions, members.where("role = 'INGESTION'")).groupBy("pid").agg(F.max_by("broker_id", F.struct("score", (-F.col("broker_id")).alias("b"))).alias("best"))
    return partitions.join(best, "pid", "left").select("pid", F.coalesce("best", F.lit(-1)).cast("long").alias("primary"))


def quorum_status(attempts: DataFrame, quorum: Column, by: str = "batch_id") -> DataFrame:
    """batch, n, successes, needed, ok: attempts have status and latency_ns; quorum is clamped to 1 .. n."""
    n = F.count("*")
    needed = F.least(F.greatest(F.max(quorum), F.lit(1)), n)
    wins = F.count_if(F.col("status") == "SUCCESS")
    return attempts.groupBy(by).agg(n.alias("n"), wins.alias("successes"), needed.cast("long").alias("needed"), (wins >= needed).alias("ok"))


def quorum_latency(attempts: DataFrame, quorum: int, by: str = "batch_id") -> DataFrame:
    """The latency of the attempt that completed the quorum, null where none did (all attempts start together)."""
    ok = F.array_sort(F.collect_list(F.when(F.col("status") == "SUCCESS", F.col("latency_ns"))))
    return attempts.groupBy(by).agg(F.try_element_at(ok, F.least(F.greatest(F.lit(quorum), F.lit(1)), F.count("*")).cast("int")).alias("commit_ns"))


def first_failure(attempts: DataFrame, by: str = "batch_id") -> DataFrame:
    failed = F.col("status") != "SUCCESS"
    return attempts.groupBy(by).agg(F.min_by(F.when(failed, F.col("node_id")), F.when(failed, F.struct("latency_ns", "node_id"))).alias("failed_node"))


def ewma(attempts: DataFrame, order: str, initial: float = 1e6) -> DataFrame:
    """node_id, ewma: latencies folded in order; failures penalise.

    A node is one ordered fold: its attempts pass through one task, sorted, a batch at a time, and one number is held.
    """

    def fold(frames):
        of, now = None, initial
        for pdf in frames:
            done = []
            for node, ok, lat in zip(pdf["node_id"].tolist(), pdf["ok"].tolist(), pdf["lat"].tolist()):
                if node != of:
                    if of is not None:
                        done.append((of, now))
                    of, now = node, initial
                now = reward(now, lat) if ok else penalize(now)
            yield pd.DataFrame(done, columns=["node_id", "ewma"])
        if of is not None:
            yield pd.DataFrame([(of, now)], columns=["node_id", "ewma"])

    seq = attempts.select("node_id", order, (F.col("status") == "SUCCESS").alias("ok"), F.col("latency_ns").cast("double").alias("lat"))
    return seq.repartition("node_id").sortWithinPartitions("node_id", order).mapInPandas(fold, "node_id long, ewma double")


def reward(previous: float, latency: float) -> float:
    """C.reward for the folds."""
    return previous * 0.8 + latency * 0.2


def penalize(previous: float) -> float:
    """C.penalize for the folds."""
    return max(min(previous * 2, 1e10), 1e6)


def fastest(nodes: DataFrame, tried: Column | None = None) -> DataFrame:
    """nodes in the order in which they are tried: by latency estimate, then by position."""
    pool = nodes if tried is None else nodes.where(~tried)
    return pool.withColumn("place", F.row_number().over(Window.partitionBy("pid").orderBy("ewma", "position")))


def replicate(nodes: list[tuple[int, bool, float]], est: dict[int, float], quorum: int, initial: float, deadline: float) -> tuple[int, bool, float | None, int]:
    """One batch, fastest first: (nodes tried for the quorum, reached, when, nodes left to the background).

    The `quorum` nodes of the best estimates start together; every failure starts the next best. est is brought up to
    date by every answer before the deadline. Where the quorum is reached, the nodes not yet tried get the batch in the
    background: their answers count for the estimates, not for the batch.
    """

    def heard(node: int, ok: bool, lat: float) -> None:
        before = est.get(node, initial)
        est[node] = reward(before, lat) if ok else penalize(before)

    queue = sorted(nodes, key=lambda r: (est.get(r[0], initial), r[0]))
    need = max(1, min(quorum, len(queue)))
    running = [(r[2], r) for r in queue[:need]]
    queue, tried, wins, clock = queue[need:], need, 0, 0.0
    while running and wins < need:
        running.sort(key=lambda x: (x[0], x[1][0]))
        clock, (node, ok, lat) = running.pop(0)
        if clock > deadline:
            return tried, False, None, 0
        heard(node, ok, lat)
        wins += ok
        if not ok and queue:
            r = queue.pop(0)
            tried += 1
            running.append((clock + r[2], r))
    if wins < need:
        return tried, False, None, 0
    for node, ok, lat in [r for _, r in running] + queue:
        heard(node, ok, lat)
    return tried, True, clock, len(queue)


def adaptive_replication(attempts: DataFrame, quorum: int, initial: float = 1e6, deadline: float = float("inf")) -> DataFrame:
    """Simulates fastest-first replication of each partition's batches in order: see replicate().

    attempts: pid, batch_id, node_id, ok, latency_ns: what each node would answer. Gives pid, batch_id, tried, ok,
    commit_ns, background. A partition's batches are folded in one task, sorted, a batch at a time, with one estimate
    for a node.
    """

    def fold(frames):
        at, est, nodes = None, {}, []

        def answer():
            return (*at, *replicate(nodes, est, quorum, initial, deadline))

        for pdf in frames:
            out = []
            for pid, batch, node, ok, lat in zip(*(pdf[c].tolist() for c in ("pid", "batch_id", "node_id", "ok", "latency_ns"))):
                if (pid, batch) != at:
                    if nodes:
                        out.append(answer())
                    if at is None or pid != at[0]:
                        est = {}
                    at, nodes = (pid, batch), []
                nodes.append((node, ok, lat))
            yield frame(out)
        if nodes:
            yield frame([answer()])

    def frame(rows):
        return pd.DataFrame(rows, columns=["pid", "batch_id", "tried", "ok", "commit_ns", "background"])

    own = attempts.select("pid", "batch_id", "node_id", "ok", "latency_ns").repartition("pid").sortWithinPartitions("pid", "batch_id", "node_id", "latency_ns", "ok")
    return own.mapInPandas(fold, "pid int, batch_id long, tried int, ok boolean, commit_ns double, background int")


def backfill_plan(epochs: DataFrame, present: DataFrame, node: int) -> DataFrame:
    """Sealed epochs placed on the node that it does not hold."""
    mine = epochs.where((F.col("end_seq") >= 0) & F.array_contains("storage_nodes", F.lit(node)))
    return mine.join(present.select("pid", "epoch"), ["pid", "epoch"], "left_anti")


def backfill_serve(log: DataFrame, requests: DataFrame, placement: DataFrame, node: int, max_records: int = 64, max_bytes: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Answers backfill requests (request_id, pid, epoch, offset): records, and a reply for every request.

    Records are (request_id, pid, epoch, seq, byte_at). From the offset on max_records are offered; one that no longer fits
    max_bytes is skipped, later smaller ones may still fit. A reply is (request_id, n, end_of_epoch, redirect): it is the
    end where no record behind those offered exists, and a node outside the placement names the nodes in it instead.
    """

    def fold(frames):
        of, used = None, 0
        for pdf in frames:
            keep, at = [], []
            for request, size in zip(pdf["request_id"].tolist(), pdf["size"].tolist()):
                if request != of:
                    of, used = request, 0
                keep.append(used + size + 4 <= max_bytes)
                at.append(used)
                used += (size + 4) * keep[-1]
            yield pdf.assign(byte_at=at)[keep][["request_id", "pid", "epoch", "seq", "byte_at"]]

    r = requests.join(placement.select("pid", "epoch", "storage_nodes"), ["pid", "epoch"], "left")
    away = F.col("storage_nodes").isNotNull() & ~F.array_contains("storage_nodes", F.lit(node))
    here = r.where(~away)
    start = F.greatest("offset", F.lit(0))
    sized = log.select("pid", "epoch", "seq", F.octet_length("payload").cast("long").alias("size"))
    offered = here.join(sized, ["pid", "epoch"]).where((F.col("seq") >= start) & (F.col("seq") < start + max_records))
    offered = offered.select("request_id", "pid", "epoch", "seq", "size").repartition("request_id").sortWithinPartitions("request_id", "seq")
    records = offered.mapInPandas(fold, "request_id long, pid int, epoch long, seq long, byte_at long")
    last = log.groupBy("pid", "epoch").agg(F.max("seq").alias("hwm"))
    sent = records.groupBy("request_id").agg(F.count("*").alias("n"))
    replies = r.join(last, ["pid", "epoch"], "left").join(sent, "request_id", "left")
    end = ~away & (F.coalesce("hwm", F.lit(-1)) < start + max_records)
    redirect = F.when(away, F.array_join(F.transform("storage_nodes", lambda x: x.cast("string")), ",")).otherwise("")
    return records, replies.select("request_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), end.alias("end_of_epoch"), redirect.alias("redirect"))


def append_missing(have: DataFrame, offered: DataFrame, key: list[str]) -> DataFrame:
    """have plus the offered rows whose key it lacks."""
    return have.unionByName(offered.join(have.select(*key), key, "left_anti").select(*have.columns))
