import random

import numpy as np

from tidelog.llm import minhash


def shingles(text, k):
    import re

    words = [w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k=4, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    ok = [a for a, s in enumerate(sets) if s and rows[a][0] is not None]
    part = {a: a for a in ok}

    def root(a):
        while part[a] != a:
            a = part[a]
        return a

    for n, a in enumerate(ok):
        for b in ok[:n]:
            both = len(sets[a] & sets[b])
            if rows[a][0] == rows[b][0] or 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and both:
                x, y = root(a), root(b)
                if x != y:
                    part[x] = y
    least: dict = {}
    for a in ok:
        least[root(a)] = min(least.get(root(a), rows[a][0]), rows[a][0])
    out = []
    for a, (i, _) in enumerate(rows):
        c = least[root(a)] if a in part else i
        out.append((i, len(sets[a]), c, i is None or c == i))
    return sorted(out, key=str)


def run(spark, rows, k=4):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n int, key int").repartition(3)
    return sorted(map(tuple, minhash.classes(df, k).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
    return " ".join(words)


def test_equals_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for base in range(25):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 30, 120, 300]))]
        rows.append((1000 - len(rows), " ".join(words)))
        for _ in range(rng.randint(0, 6)):
            rows.append((1000 - len(rows), changed(rng, words, rng.choice([0, 1, 2, 4, 8, 16]))))
    # a large group of near copies, some of which link only through others
    words = [f"v{i}" for i in range(200)]
    for i in range(60):
        rows.append((3000 + i, changed(rng, words, 3)))
        if i % 6 == 0:
            words = changed(rng, words, 3).split()
    assert run(spark, rows) == brute(rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One Two"), (5, "one\x0btwo"), (6, "one"), (7, "one two three four"), (8, "one two three four"), (None, "one two"), (None, None), (4, "one two"), (9, "p q r s t"), (9, "one two three four"), (10, "P Q R S T"), (11, "ÀB c d e"), (12, "àb c d e")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 1, True)]
    long = " ".join(f"x{i % 5000}" for i in range(40_000))
    rows = [(5, long), (3, long + " end"), (4, "x1 x2 x3 x4")]
    assert run(spark, rows) == brute(rows)


def test_threshold_is_exact(spark):
    # 9 shingles each: 8 shared of 10 are linked, 7 shared of 11 are not, nor are 7 of 11 by way of another
    a = [f"q{i}" for i in range(12)]
    rows = [(1, " ".join(a)), (2, " ".join(a[:-1] + ["other"])), (3, " ".join(a[:-2] + ["b", "c"]))]
    got = run(spark, rows)
    assert got == brute(rows)
    assert [r[2] for r in got] == [1, 1, 3]


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 300).astype(np.uint64)
    for n in (1, 2, 5, 300):
        s = minhash.sketch([x[:n]], 160)
        assert (s != ~np.uint64(0)).all()  # every coordinate is filled, whatever the size
    a, b = x[:200], np.concatenate([x[:160], x[200:240]])
    got = np.mean([(lambda s: (s[0] == s[1]).mean())(minhash.sketch([a ^ np.uint64(k << 40), b ^ np.uint64(k << 40)], 160)) for k in range(20)])
    assert abs(got - 160 / 240) < 0.05


def test_intersections_equal_brute_force():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for n in (0, 1, 7, 90, 300, 300, 50)]
    want = [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets]
    for columns in (1, 64, 4096):
        assert minhash.intersections(sets, sets[2:], columns).tolist() == want


def test_large_mixed_buckets_are_exact(spark, monkeypatch):
    """Many unlike groups in shared buckets, blocks of a few members, sets that fill a block alone."""
    monkeypatch.setattr(minhash, "BLOCK", 5)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 250)
    rng = random.Random(11)
    rows, words = [], [f"v{i}" for i in range(220)]
    for i in range(150):
        rows.append((i, changed(rng, words, rng.choice([8, 11, 13, 20]))))
        if i % 10 == 0:
            words = changed(rng, words, 6).split() + [f"u{i}"] * (i % 20)
    assert run(spark, rows) == brute(rows)
