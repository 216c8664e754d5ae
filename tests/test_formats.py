"""Byte formats, recovery after torn writes, and the append state machine."""

import datetime
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tidelog.operators import cluster, layout, log, replica
from tidelog.operators.replica import State
from tidelog.sources import codec, seglog, stores
from tidelog.streaming import streams


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40), max_size=20), st.integers(0, 1 << 40), st.booleans())
def test_segment_round_trip(records, first, checksums):
    rows, size = codec.read_segment(data := codec.write_segment(records, first, checksums))
    assert [r[2] for r in rows] == records and size == len(data)
    assert [r[0] for r in rows] == [first + i for i in range(len(records))]


def test_three_records_and_positions():
    rows, _ = codec.read_segment(codec.write_segment([b"a", b"bb", b"ccc"]))
    assert rows == [(0, 26, b"a"), (1, 35, b"bb"), (2, 45, b"ccc")]


def test_torn_tail_and_corruption():
    data = codec.write_segment([b"ok"])
    assert codec.read_segment(data + b"\xff\xee\xdd") == ([(0, 26, b"ok")], len(data))
    assert codec.read_segment(data + bytes(8))[1] == len(data)
    assert codec.read_segment(data[:-1])[0] == []
    spoiled = bytearray(codec.write_segment([b"one", b"two"]))
    spoiled[-1] ^= 1
    assert [r[2] for r in codec.read_segment(bytes(spoiled))[0]] == [b"one"]
    head = bytearray(data)
    head[10] ^= 1
    assert codec.read_segment(bytes(head)) == ([], 0) and codec.read_segment(b"") == ([], 0)


def test_index_is_valid_for_its_count_only():
    data = codec.write_index([26])
    assert codec.read_index(data, 1) == [26] and codec.read_index(data, 2) is None and codec.read_index(data[:10], 1) is None


def test_offset_journal_with_torn_tail():
    data = codec.write_offset("t", "g", 0, 1) + codec.write_offset("t", "g", 1, 2)
    assert list(codec.read_offsets(data + b"\x01\x02")) == [("t", "g", 0, 1), ("t", "g", 1, 2)]


def test_small_formats():
    epochs = [{"epoch": 0, "start_seq": 0, "end_seq": 42, "tie_breaker": 0, "ack_quorum": 2, "storage_nodes": [1, 2, 3]}, {"epoch": 1, "start_seq": 0, "end_seq": -1, "tie_breaker": 99, "ack_quorum": 2, "storage_nodes": [2, 3, 4]}]
    assert codec.read_metadata(codec.write_metadata(3, epochs)) == (3, epochs)
    assert len(f := codec.write_fence(5, 9, True)) == 17 and codec.read_fence(f) == (5, 9, True)
    assert len(h := codec.write_heartbeat(7, 1, 1234, 2)) == 14 and codec.read_heartbeat(h) == (7, 1, 1234, 2) and codec.read_heartbeat(h[:13]) is None
    assert codec.read_frames(codec.write_frames([b"x", b"", b"yz"]) + b"\x09\x00\x00\x00q") == [b"x", b"", b"yz"]


def test_segment_files_through_spark(spark, tmp_path):
    for pid, epoch, name, records, first in ((0, 0, "a.seg", [b"one"], 0), (0, 0, "b.seg", [b"two"], 1), (2, 1, "c.seg", [], 0), (1, 3, "d.seg", [b"x"] * 30, 7)):
        d = tmp_path / f"partition-{pid}" / f"epoch-{epoch:010d}"
        d.mkdir(parents=True, exist_ok=True)
        (d / name).write_bytes(codec.write_segment(records, first) + b"\xff" * 3)
    log = seglog.read(spark, str(tmp_path))
    assert [bytes(r["payload"]) for r in log.where("pid = 0 and epoch = 0").orderBy("seq").collect()] == [b"one", b"two"]
    assert log.count() == 32 and log.where("pid = 1").agg({"seq": "max"}).first()[0] == 36
    made = seglog.encode(log.where("pid = 1").selectExpr("pid", "epoch", "cast(0 as bigint) as seg", "seq", "payload")).first()
    assert bytes(made["content"]) == codec.write_segment([b"x"] * 30, 7)


def test_journal_files_through_spark(spark, tmp_path):
    (tmp_path / "1.wal").write_bytes(codec.write_offset("orders", "g1", 0, 100))
    (tmp_path / "2.wal").write_bytes(codec.write_offset("orders", "g1", 0, 200) + codec.write_offset("other", "g1", 1, 500) + b"\x07")
    rows = seglog.read_offset_journal(spark, str(tmp_path)).orderBy("commit_order").collect()
    assert [(r["topic"], r["pid"], r["off"]) for r in rows] == [("orders", 0, 100), ("orders", 0, 200), ("other", 1, 500)]


@pytest.mark.parametrize(
    "steps, want",
    [
        ([(0, 0, 3, None), (0, 0, 3, None)], [("SUCCESS", 2), ("SUCCESS", 2)]),  # a duplicate is acknowledged again
        ([(0, 1, 1, None)], [("NOT_READY", -1)]),  # a gap
        ([(0, 0, 2, None), (0, 1, 3, None)], [("SUCCESS", 1), ("SUCCESS", 3)]),  # an overlap
        ([(1, 0, 1, None), (0, 0, 1, None)], [("SUCCESS", 0), ("INVALID_REQUEST", -1)]),  # a stale epoch
        ([(0, 0, 1, 0), (0, 1, 1, 0)], [("SUCCESS", 0), ("NOT_READY", 0)]),  # past a sealed end
        ([(0, 5, 0, None)], [("SUCCESS", 4)]),  # nothing to append
    ],
)
def test_append_states(steps, want):
    state = State()
    assert [state.append(*s) for s in steps] == want


def test_stored_records_never_have_gaps():
    rng, state = random.Random(3), State()
    for _ in range(2000):
        epoch, base, n = rng.randint(0, 3), rng.randint(0, 40), rng.randint(0, 5)
        before = state.last.get(epoch, -1)
        status, _ = state.append(epoch, base, n, None)
        after = state.last.get(epoch, -1)
        assert after >= before and (after == before or status == "SUCCESS" and base <= before + 1)


def test_adaptive_replication_equals_brute_force(spark):
    """Event by event: what starts, what answers, what is left to the background."""
    rng = random.Random(5)
    rows = [(pid, batch, node, rng.random() < 0.7, float(rng.randint(1, 10**8))) for pid in range(3) for batch in range(40) for node in range(5) if rng.random() < 0.9]
    quorum, deadline = 2, 1.2e8
    want = []
    for pid in range(3):
        est = {}
        for batch in sorted({r[1] for r in rows if r[0] == pid}):
            nodes = {r[2]: r[3:] for r in rows if r[:2] == (pid, batch)}
            order = sorted(nodes, key=lambda n: (est.get(n, 1e6), n))
            need, begun, heard, wins, at, end = min(quorum, len(nodes)), {}, set(), 0, 0.0, None
            for n in order[:need]:
                begun[n] = 0.0
            while wins < need and len(heard) < len(begun):
                at, n = min((begun[n] + nodes[n][1], n) for n in begun if n not in heard)
                if at > deadline:
                    break
                heard.add(n)
                wins += nodes[n][0]
                est[n] = 0.8 * est.get(n, 1e6) + 0.2 * nodes[n][1] if nodes[n][0] else max(min(2 * est.get(n, 1e6), 1e10), 1e6)
                more = [x for x in order if x not in begun]
                if not nodes[n][0] and more:
                    begun[more[0]] = at
                if wins == need:
                    end = at
            rest = [n for n in order if n not in begun] if wins == need else []
            if wins == need:
                for n in [x for x in order if x in begun and x not in heard] + rest:
                    est[n] = 0.8 * est.get(n, 1e6) + 0.2 * nodes[n][1] if nodes[n][0] else max(min(2 * est.get(n, 1e6), 1e10), 1e6)
            want.append((pid, batch, len(begun), wins == need, end, len(rest)))
    df = spark.createDataFrame(rows, "pid int, batch_id long, node_id long, ok boolean, latency_ns double").repartition(3)
    got = sorted(tuple(r) for r in cluster.adaptive_replication(df, quorum, deadline=deadline).collect())
    assert got == want and {r[3] for r in got} == {True, False} and any(r[5] for r in got)


def test_partitions_are_folded_across_batches(spark):
    """Ordered folds carry their state from one Arrow batch to the next."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rng = random.Random(2)
    rows = [(p, i, 0, max(0, i // 2 - rng.randint(0, 2)), 1, None) for p in range(3) for i in range(60)]
    schema = "pid int, arrival long, epoch long, base_seq long, n long, sealed_end long"
    df = spark.createDataFrame(rows, schema)
    sized = spark.createDataFrame([(p, 0, i, "x" * rng.randint(0, 9)) for p in range(3) for i in range(200)], "pid int, epoch long, seq long, payload string")
    beats = spark.createDataFrame([(n, i, "SUCCESS" if rng.random() < 0.8 else "FAILURE", rng.randint(1, 10**7)) for n in range(3) for i in range(100)], "node_id long, at long, status string, latency_ns long")
    run = lambda: [sorted(tuple(r) for r in x.collect()) for x in (replica.append(df.withColumn("topic", F.lit("t"))), layout.pack_segments(sized, 120), cluster.ewma(beats, "at"))]
    want = run()
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        assert run() == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for p in range(3):
        state = State()
        assert [r[2:] for r in want[0] if r[0] == p] == [state.append(r[2], r[3], r[4], None) for r in rows if r[0] == p]


def test_what_cannot_be_built_is_refused():
    for bad in ({"ring": 6}, {"ring": 1}, {"ring": 8, "batch": 9}, {"batch": 0}, {"partitions": 0}, {"quorum": 2}, {"quorum": 0}):
        with pytest.raises(ValueError):
            log.check_arguments(**bad)
    log.check_arguments(ring=8, batch=8, partitions=3, quorum=2, nodes=3)


def test_duplicates_within_a_watermark(spark, tmp_path):
    """Late repeats within the delay are dropped; the state behind the watermark is let go."""
    path = str(tmp_path / "in")
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    spark.createDataFrame([(1, at(0)), (1, at(1)), (2, at(5)), (2, at(5))], "id long, ts timestamp").write.parquet(path)
    out = streams.drain(streams.dedup(streams.source(spark, path + "/"), ["id"], "ts", "10 seconds"))
    assert sorted(r.id for r in out.collect()) == [1, 2]


def test_a_subscriber_is_given_what_follows_its_commits(spark, tmp_path):
    path, seen = str(tmp_path / "log"), []
    spark.createDataFrame([("t", 0, 0, i) for i in range(6)] + [("t", 1, 0, i) for i in range(4)] + [("u", 0, 0, 9)], "topic string, pid int, epoch long, seq long").write.parquet(path)
    taken = spark.createDataFrame([("t", 0, 0, 3)], "topic string, pid int, epoch long, seq long")
    commits = []
    run = lambda life, at: streams.subscribe(streams.source(spark, path + "/"), lambda b, n: seen.extend((r.pid, r.seq) for r in b.collect()), lambda c, n: commits.extend((r.pid, r["at"].seq) for r in c.collect()), str(tmp_path / life), "t", at).trigger(availableNow=True).start().awaitTermination()
    run("new", taken)
    assert sorted(seen) == [(0, 4), (0, 5), (1, 0), (1, 1), (1, 2), (1, 3)] and sorted(commits) == [(0, 5), (1, 3)]
    assert [s for p, s in seen if p == 1] == [0, 1, 2, 3]
    run("new", taken)  # the same life has nothing more to take
    assert len(seen) == 6


def test_versions_of_a_table(spark, tmp_path):
    path = str(tmp_path / "table")
    assert stores.get(spark, path) is None
    for k in range(3):
        assert stores.put(spark.range(k + 1), path) == k
    (tmp_path / "table" / "version=3").mkdir()  # begun, never completed
    assert stores.get(spark, path).count() == 3 and stores.get(spark, path, 0).count() == 1 and stores.get(spark, path, 3) is None
    assert stores.put(spark.range(9), path) == 3 and stores.get(spark, path).count() == 9


def test_offset_store(spark, tmp_path):
    store = stores.OffsetStore(spark, str(tmp_path / "offsets"))
    rows = lambda *r: spark.createDataFrame(r, "topic string, grp string, pid int, off long, commit_order long")
    store.commit(rows(("orders/created", "g1", 0, 5, 0), ("orders/created", "g1", 20, 7, 1)))
    store.commit(rows(("orders/created", "g2", 1, 9, 2), ("orders/created", "g1", 0, 3, 3)))
    want = [("orders/created", "g1", 0, 3), ("orders/created", "g1", 20, 7), ("orders/created", "g2", 1, 9)]
    assert sorted(map(tuple, store.committed().collect())) == want
    small = store.compact(str(tmp_path / "compact"))
    assert sorted(map(tuple, small.committed().collect())) == want and spark.read.parquet(small.path).count() == 3


def test_metadata_and_fence_files(spark, tmp_path):
    epochs = [{"epoch": 0, "start_seq": 0, "end_seq": 42, "ack_quorum": 2, "storage_nodes": [1, 2, 3], "tie_breaker": 0}, {"epoch": 1, "start_seq": 43, "end_seq": -1, "ack_quorum": 2, "storage_nodes": [2, 3, 4], "tie_breaker": 99}]
    (tmp_path / "7.meta").write_bytes(codec.write_metadata(3, epochs))
    rows = [r.asDict() for r in stores.read_metadata(spark, str(tmp_path)).orderBy("epoch").collect()]
    assert rows == [{"pid": 7, "config_version": 3, **e} for e in epochs]
    d = tmp_path / "partition-2"
    d.mkdir()
    (d / "epoch-0000000005.fence").write_bytes(codec.write_fence(5, 9, True))
    (d / "epoch-0000000006.fence").write_bytes(codec.write_fence(-1, 11, False))
    assert sorted(map(tuple, stores.read_fences(spark, str(tmp_path)).collect())) == [(2, 5, 5, 9, True), (2, 6, -1, 11, False)]


def test_a_rate_limited_stream_takes_a_file_at_a_time(spark, tmp_path):
    for k in range(3):
        spark.range(4).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    q = streams.source(spark, str(tmp_path / "in") + "/", 1).writeStream.foreachBatch(lambda b, n: seen.append(b.count())).option("checkpointLocation", str(tmp_path / "state")).trigger(**streams.TRIGGERS["drain"]).start()
    q.awaitTermination()
    assert seen == [4, 4, 4]


def test_redelivery_at_the_committed_offset(spark, tmp_path):
    path, seen = str(tmp_path / "log"), []
    spark.createDataFrame([("t", 0, 0, i) for i in range(6)], "topic string, pid int, epoch long, seq long").write.parquet(path)
    taken = spark.createDataFrame([("t", 0, 0, 3)], "topic string, pid int, epoch long, seq long")
    streams.subscribe(streams.source(spark, path + "/"), lambda b, n: seen.extend(r.seq for r in b.collect()), lambda c, n: None, str(tmp_path / "state"), "t", taken, redeliver=True).trigger(availableNow=True).start().awaitTermination()
    assert seen == [3, 4, 5]


def test_approximations_are_near(spark, sf):
    from tidelog.plans import registry

    rows = {r.l_returnflag: r for r in registry.QUERIES["ext_approx"](spark, sf).collect()}
    exact = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("n"), F.percentile("l_extendedprice", 0.5).alias("m")).collect()
    assert len(rows) == len(exact)
    for r in exact:
        assert abs(rows[r.l_returnflag].parts - r.n) <= 0.1 * r.n and abs(rows[r.l_returnflag].median - r.m) <= 0.02 * r.m


def test_checksums_of_all_records(spark, sf):
    from tidelog.functions.checksum import crc32c
    from tidelog.plans import registry, tables

    got = {(r.pid, r.epoch, r.seq): r.crc32c for r in registry.QUERIES["crc32c_records"](spark, sf).collect()}
    log = tables.events_log(spark, sf).select("pid", "epoch", "seq", "payload").collect()

    def slow(data):
        c = 0xFFFFFFFF
        for b in data:
            c ^= b
            for _ in range(8):
                c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    assert got == {(r.pid, r.epoch, r.seq): slow(r.payload.encode()) for r in log} and crc32c(b"abc") == slow(b"abc")
