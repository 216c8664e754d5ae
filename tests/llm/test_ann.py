import numpy as np
import pytest

from tidelog.llm import ann

SCHEMA = "vec_id long, embedding array<float>, query_id string, score int"


def brute(rows, is_query, top):
    """{query id: [(vec_id, score)]} of usable rows."""
    ok = [(i, np.array(v, np.float32).astype(np.float64)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    ids = np.array([i for i, _ in ok])
    x = np.array([v for _, v in ok])
    out = {}
    for i, v in ok:
        if is_query(i):
            s = x @ v
            best = sorted((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != i)
            out[i] = [(int(b), -a) for a, b in best[:top]]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        own = out.setdefault(r["query_id"], [])
        assert r["rank"] == len(own) + 1
        own.append((r["vec_id"], r["score"]))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    x = centres[rng.integers(0, 12, 900)] + 0.4 * rng.normal(size=(900, 24))
    return [(i, [float(e) for e in v]) for i, v in enumerate(x)]


def test_recall_and_exact_scores(spark, rows):
    got, want = found(ann.search(table(spark, rows), lambda i: i % 20 == 0)), brute(rows, lambda i: i % 20 == 0, 20)
    assert got.keys() == want.keys()
    x = {i: np.array(v, np.float32).astype(np.float64) for i, v in rows}
    hits = 0
    for q, own in got.items():
        assert len(own) == 20 and q not in [v for v, _ in own]
        assert own == sorted(own, key=lambda r: (-r[1], r[0]))
        for v, s in own:
            assert s == pytest.approx(float(x[q] @ x[v]), rel=1e-12)
        hits += len({v for v, _ in own} & {v for v, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.9


def test_one_list_is_exact_with_unusable_rows_and_ties(spark, rows):
    odd = [(10_000, None), (10_020, []), (10_040, [0.0] * 24), (10_060, [float("nan")] * 24), (10_080, [float("inf")] + [1.0] * 23), (10_100, [None] + [1.0] * 23), (None, [1.0] * 24), (10_120, [1.0, 2.0])]
    some = rows[:200] + [(i + 5000, v) for i, v in rows[:200:10]]
    got, want = found(ann.exact(table(spark, some + odd), lambda i: i % 20 == 0)), brute(some, lambda i: i % 20 == 0, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]]


def test_few_candidates_repeats_and_empty(spark):
    got = found(ann.search(table(spark, [(20, [1.0, 0.0]), (3, [2.0, 0.0]), (2, [2.0, 0.0])]), lambda i: i % 20 == 0))
    assert got == {20: [(2, 2.0), (3, 2.0)]}
    # rows of one id are one vector with several places, and no neighbours of themselves
    got = found(ann.search(table(spark, [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (5, [3.0, 1.0]), (5, [3.0, 1.0])]), lambda i: i % 20 == 0))
    assert got == {20: [(5, 3.0)]}
    assert ann.search(table(spark, []), lambda i: i % 20 == 0).count() == 0
    assert ann.search(table(spark, [(1, None)]), lambda i: i % 20 == 0).count() == 0
    assert ann.search(table(spark, [(20, [1.0, 1.0])]), lambda i: i % 20 == 0).count() == 0


def test_abandoning_never_changes_scores():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 32))
    ids = np.arange(500)
    index = ann.Index(ids, x, float(np.sqrt((x * x).sum(1).max())) * 1.001, 8, 5, 0.99)
    q = x[:40]
    i, j, s = ann.scan(index, ids[:40], q, index.floor(ids[:40], q), ids, x)
    truth = q @ x.T
    truth[np.arange(40), np.arange(40)] = -np.inf
    for a in range(40):
        own = j[i == a]
        assert np.allclose(s[i == a], truth[a, own])
        assert len(set(own) & set(np.argsort(-truth[a])[:5])) >= 4


@pytest.mark.parametrize("seeded", [True, False])
def test_recall_with_a_sample_far_smaller_than_the_table(spark, seeded):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 24))
    x = centres[rng.integers(0, 60, 4000)] + 0.5 * rng.normal(size=(4000, 24))
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(x)]
    ask = lambda i: i % 20 == 0
    got, want = found(ann.search(table(spark, rows), ask, lists=32, fit_rows=400, seeded=seeded)), brute(rows, ask, 20)
    hits = sum(len({v for v, _ in got.get(q, [])} & {v for v, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9


@pytest.mark.parametrize("seeded", [True, False])
def test_a_row_repeated_more_often_than_top_hides_no_other(spark, seeded):
    rng = np.random.default_rng(6)
    some = [(i, [float(e) for e in rng.normal(size=8)]) for i in range(1, 60)]
    near = [(1001, [9.0] * 8)] * 30 + [(1003, [8.0] * 8)] * 25
    ask = lambda i: i % 20 == 0
    got, want = found(ann.search(table(spark, some + near), ask, lists=1, seeded=seeded)), brute(some + [near[0], near[30]], ask, 20)
    assert {q: [v for v, _ in own] for q, own in got.items()} == {q: [v for v, _ in own] for q, own in want.items()}


def test_recall_of_the_scan_alone(spark, rows, monkeypatch):
    """Few seed rows, none of them in the result: what is found comes from lists."""
    monkeypatch.setattr(ann, "SEED_ROWS", 64)
    monkeypatch.setattr(ann, "LIST_BLOCKS", 1)
    monkeypatch.setattr(ann, "LIST_ROWS", 16)
    got, want = found(ann.search(table(spark, rows), lambda i: i % 20 == 0, fit_rows=300, seeded=False)), brute(rows, lambda i: i % 20 == 0, 20)
    assert sum(len({v for v, _ in got.get(q, [])} & {v for v, _ in want[q]}) for q in want) / (20 * len(want)) >= 0.9


def test_exact_abandons_nothing(spark, monkeypatch):
    monkeypatch.setattr(ann, "SEED_ROWS", 50)
    x = np.random.default_rng(12).normal(size=(1500, 40))
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(x)]
    got, want = found(ann.exact(table(spark, rows), lambda i: i % 20 == 0)), brute(rows, lambda i: i % 20 == 0, 20)
    assert {q: [v for v, _ in own] for q, own in got.items()} == {q: [v for v, _ in own] for q, own in want.items()}


def test_doubles_are_scored_as_they_are(spark):
    """Differences beyond single precision decide."""
    rows = [(20, [1.0, 0.0]), (1, [1.0 + 1e-12, 5.0]), (2, [1.0 + 2e-12, 7.0]), (3, [1.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(ann.search(df, lambda i: i % 20 == 0)) == {20: [(2, 1.0 + 2e-12), (1, 1.0 + 1e-12), (3, 1.0)]}
