"""Queries over whole tables, against brute force on tables larger or with greater numbers than the given ones."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidelog.plans import registry, tables

M = (1 << 64) - 1


def score(pid, node):
    h = (pid * 0x9E3779B97F4A7C15 & M) ^ node
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ h >> 33) * c & M
    h ^= h >> 33
    return h - (1 << 64) if h >> 63 else h


def rows(spark, sf, name):
    return [tuple(r) for r in registry.QUERIES[name](spark, sf).collect()]


@pytest.fixture(scope="module")
def nodes(tmp_path_factory):
    path = tmp_path_factory.mktemp("nodes")
    ids = list(range(1, 301))
    pq.write_table(pa.table({"s_suppkey": ids, "s_name": [f"n{i}" for i in ids]}), path / "supplier.parquet")
    return str(path)


def test_all_nodes_are_scored_and_placed(spark, nodes):
    every = {(p, n): score(p, n) for p in range(16) for n in range(1, 301)}
    assert {(p, n): s for p, n, s in rows(spark, nodes, "hrw_score")} == every
    assert sorted(rows(spark, nodes, "member_scores")) == [(n, 16, max(every[p, n] for p in range(16))) for n in range(1, 301)]
    best = lambda p, odd: sorted((n for n in range(1, 301) if n % 2 == odd), key=lambda n: (-every[p, n], n))
    placed = lambda odd, k: sorted((p, i + 1, n, every[p, n]) for p in range(16) for i, n in enumerate(best(p, odd)[:k]))
    assert sorted(rows(spark, nodes, "replica_set")) == placed(0, 3)
    assert sorted(rows(spark, nodes, "role_fallback")) == placed(1, 2)
    assert sorted(rows(spark, nodes, "hrw_primary")) == [(p, best(p, 1)[0]) for p in range(16)]
    assert max(n for _, _, n, _ in placed(0, 3)) > 40
    overlay = [(n, "PERSISTENCE", "gossip") if n > 20 else (n, "PERSISTENCE" if n % 2 == 0 else "INGESTION", f"n{n}") for n in range(1, 321)]
    assert sorted(rows(spark, nodes, "members_overlay")) == overlay


def test_epochs_above_a_signed_23_bits_are_decoded(spark, tmp_path):
    keys = [1, 7_999_999, 8_000_000, 8_388_607, 8_388_608, 16_777_215, 16_777_216, 60_000_000]
    pq.write_table(pa.table({"o_orderkey": keys, "o_custkey": list(range(10, 18))}), tmp_path / "orders.parquet")
    want = []
    for k, seq in zip(keys, range(10, 18)):
        epoch = k % (1 << 24)
        lsn = epoch << 40 | seq
        want.append((lsn - (1 << 64) if lsn >> 63 else lsn, epoch, seq))
    assert sorted(rows(spark, str(tmp_path), "lsn_decode")) == sorted(want)


def test_every_event_is_requested_looked_up_and_committed(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", "user_id").collect()
    n = len(events)
    assert {r[0] for r in rows(spark, sf, "fetch_status_redirect")} == {e.event_id for e in events}
    log = registry.QUERIES["dense_index"](spark, sf).select("pid", "epoch", "seg", "seq").collect()
    place = lambda name, *cols: sorted(tuple(r[c] for c in cols) for r in registry.QUERIES[name](spark, sf).collect())
    assert len(log) == n and place("dense_lookup", "pid", "epoch", "seg", "seq") == sorted(tuple(r) for r in log)
    assert place("segment_lookup", "pid", "epoch", "seg", "seq") == sorted(tuple(r) for r in log)
    pid = {r.event_id: r.pid for r in tables.routed(spark, sf).collect()}
    last = {}
    for e in sorted(events):
        last[e.event_type, f"g{e.user_id % 4}", pid[e.event_id]] = e.event_id % 1000
    want = sorted((*k, v) for k, v in last.items())
    assert place("committed_offsets", "topic", "grp", "pid", "off") == place("stream_commit", "topic", "grp", "pid", "off") == want
    assert sum(r[2] for r in rows(spark, sf, "replay_count")) == n
