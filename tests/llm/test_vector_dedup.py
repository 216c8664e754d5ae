import numpy as np

from tidelog.llm import vector_dedup as vd


def brute(rows, cosine=0.9):
    """[(vec_id, n_links, component_id, kept)] row by row."""
    ok = [k for k, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([rows[k][1] for k in ok], np.float32).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt((x * x).sum(1))[:, None]
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    part = list(range(len(ok)))
    while True:
        new = [min([part[a], *(part[b] for b in np.flatnonzero(near[a])), *(part[b] for b in range(len(ok)) if rows[ok[b]][0] == rows[ok[a]][0])], key=lambda p: (rows[ok[p]][0], p)) for a in range(len(ok))]
        if new == part:
            break
        part = new
    out = []
    at = {k: a for a, k in enumerate(ok)}
    for k, (i, _) in enumerate(rows):
        if k in at:
            comp = rows[ok[part[at[k]]]][0]
            out.append((i, int(near[at[k]].sum()), comp, i == comp))
        else:
            out.append((i, 0, i, True))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 3, 0.5) for i, v in rows], "vec_id long, embedding array<float>, label int, weight double")
    return sorted(map(tuple, vd.classes(df).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    seeds = rng.normal(size=(40, 64))
    rows = []
    for i in range(600):
        v = rng.normal(size=64) if i % 3 else seeds[i % 40] + rng.normal(size=64) * rng.choice([0.05, 0.2, 0.33, 0.4])
        rows.append((int(i * 7 % 601), [float(e) for e in v.astype(np.float32)]))
    rows += [(1000 + i, [e * 1e-20 for e in rows[3][1]]) for i in range(5)]  # scaled copies
    rows += [(2000 + i, rows[6][1]) for i in range(70)]  # exact copies
    rows += [(3000, None), (3001, []), (3002, [0.0] * 64), (3003, [float("nan")] * 64), (3004, [None] + [1.0] * 63), (3005, [float("inf")] * 64), (None, rows[0][1])]
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_and_ids(spark):
    rows = [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [0.0, 1.0]), (9, [1.0, 0.01]), (7, [-1.0, 0.0])]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (None, None)]) == sorted([(1, 0, 1, True), (None, 0, None, True)], key=str)


def test_pigeonhole_budgets():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 64))
    y = x + 0.3 * rng.normal(size=x.shape)
    plan = vd.Plan(x, 0.9)
    a, b = plan.rotated(x), plan.rotated(y)
    linked = (plan.unit(x) * plan.unit(y)).sum(1) >= 0.9
    within = np.stack([((a[:, s:e] - b[:, s:e]) ** 2).sum(1) <= w for (s, e), w in zip(plan.cols, plan.budget)], axis=1)
    assert linked.any() and within[linked].any(axis=1).all()


def test_nodes_of_one_least_id_are_counted_apart(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (9, [1.0, 0.01])]
    assert run(spark, rows) == brute(rows) == [(5, 0, 5, True), (5, 1, 5, True), (9, 1, 5, False)]
    rng = np.random.default_rng(4)
    seeds = rng.normal(size=(30, 16))
    rows = [(int(rng.integers(0, 250)), [float(e) for e in (seeds[i % 30] + rng.normal(size=16) * rng.choice([0.05, 0.3])).astype(np.float32)]) for i in range(400)]
    rows += [(rows[3][0], rows[7][1]), (-4, rows[8][1]), (-4, rows[9][1])]
    assert run(spark, rows) == brute(rows)


def test_vectors_are_stored_a_few_times_only(spark, monkeypatch):
    """Unlike vectors, whose cells prune nothing: what is stored grows as the input, not as the cells that they are near."""
    from pathlib import Path

    made = []
    materialize = vd.materialize

    def weighed(df, name, **how):
        out = materialize(df, name, **how)
        made.extend(Path(f.removeprefix("file://")).stat().st_size for f in out.inputFiles())
        return out

    monkeypatch.setattr(vd, "materialize", weighed)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 64)).astype(np.float32)
    x[-500:] = x[:500] + 0.1 * rng.normal(size=(500, 64)).astype(np.float32)
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    assert run(spark, rows) == brute(rows)
    assert made and sum(made) < 4 * x.nbytes


def test_groups_that_span_row_blocks(spark, monkeypatch):
    """Dense groups, several row blocks and cells, and a chain whose ends are not linked."""
    monkeypatch.setattr(vd, "ROWS", (16, 64))
    rng = np.random.default_rng(6)
    dense = rng.normal(size=64) + 0.05 * rng.normal(size=(300, 64))
    t = np.linspace(0, 3, 40)
    chain = np.zeros((40, 64))
    chain[:, 0], chain[:, 1] = np.cos(t), np.sin(t)
    spots = rng.normal(size=(6, 64))
    x = np.concatenate([dense, chain, spots[rng.integers(0, 6, 900)] + 0.4 * rng.normal(size=(900, 64)), rng.normal(size=(300, 64))])
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(x)), x.astype(np.float32).tolist())]
    assert run(spark, rows) == brute(rows)
