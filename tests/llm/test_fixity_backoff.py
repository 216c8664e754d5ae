import math
import random
import re
from collections import Counter

from tidelog.llm import backoff, fixity


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 7) for i, u, h in rows], "page_id long, url string, html string, at int")


def record(u, h):
    body = h or ""
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {u or ''}\r\nContent-Length: {len(body.encode())}\r\n\r\n{body}\r\n\r\n".encode()


def laid(rows):
    """{page: (file, at, size, records)}"""
    by = {}
    for i, u, h in rows:
        if i is not None:
            by.setdefault(i, []).append(record(u, h))
    out, at = {}, Counter()
    for i in sorted(by):
        f, size = i // fixity.FILE_PAGES, sum(map(len, by[i]))
        out[i] = (f, at[f], size, sorted(by[i]))
        at[f] += size
    return out


def brute(one, two):
    a, b = laid(one), laid(two)
    out = []
    for i in sorted(a.keys() | b.keys()):
        x, y = a.get(i), b.get(i)
        if x is None or y is None or x[3] != y[3]:
            status = "missing" if y is None else "extra" if x is None else "changed"
            out.append(((x or y)[0], i, status, *((x[1], x[2]) if x else (None, None)), *((y[1], y[2]) if y else (None, None))))
    return out


def audit(spark, one, two):
    return sorted(map(tuple, fixity.audit(pages(spark, one), pages(spark, two)).collect()), key=lambda r: r[1])


def test_audit_finds_exactly_the_damage(spark):
    rng = random.Random(4)
    one = [(i, f"http://h/{i}", "é" * rng.randint(0, 50)) for i in range(-300, 5000, 3)] + [(7, None, None), (8, "u", None), (None, "x", "y"), (10, "a", "b"), (10, "a", "b"), (13, "a", "b"), (13, "c", "d")]
    two = [r for r in one if r[0] is None or r[0] % 501] + [(90_000, "new", "page")]
    two = [(i, u, (h or "") + "!") if i in (0, 33, 4998, 10) else (i, u, h) for i, u, h in two]
    rng.shuffle(two)
    want = brute(one, two)
    assert len(want) > 10 and audit(spark, one, two) == want


def test_equal_and_empty_replicas(spark):
    some = [(i, "u", "h") for i in range(70)]
    assert audit(spark, some, some[::-1]) == []
    assert audit(spark, [], []) == []
    assert audit(spark, some, []) == brute(some, [])
    assert audit(spark, [], some) == brute([], some)
    assert audit(spark, some, some + some[:1]) == brute(some, some + some[:1])


def test_great_and_mixed_ids_and_long_records(spark):
    big = (1 << 53) + 1
    one = [(i, "u", "x" * n) for i, n in [(-big, 5), (-1, 70_000), (0, 200_000), (1, 3), (2, 90_000), (3, 1), (big, 1), (big + 1, 2), (big + 2, 3)]]
    two = [(i, u, h + "!" if i in (0, big + 1) else h) for i, u, h in one if i != 3]
    want = brute(one, two)
    assert [r[1] for r in want] == [0, 3, big + 1] and audit(spark, one, two) == want


def test_same_leaves_elsewhere_are_no_damage(spark):
    """A record that grows moves those behind it: their ranges differ, they do not."""
    one = [(i, "u", "y" * 3000) for i in range(600)]
    two = [(i, u, h + "z" * 500 if i == 4 else h) for i, u, h in one]
    assert [r[1:3] for r in audit(spark, one, two)] == [(4, "changed")]


def brute_scores(rows, order=3):
    docs = [[w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] for _, t in rows]
    grams = lambda d: Counter(tuple(d[i : i + k]) for k in range(1, order + 1) for i in range(len(d) - k + 1))
    every = Counter()
    for d in docs:
        every.update(grams(d))
    total, out = sum(map(len, docs)), []
    for (i, _), d in zip(rows, docs):
        own = grams(d)
        f = lambda g: every[g] - own[g]  # noqa: B023, E731
        hits, full, s = 0, 0, 0.0
        for at in range(len(d)):
            top = min(order, at + 1)
            k = next((k for k in range(top, 1, -1) if f(tuple(d[at - k + 1 : at + 1])) > 0), 1)
            g = tuple(d[at - k + 1 : at + 1])
            s += math.log(f(g) / f(g[:-1])) if k > 1 else math.log(max(f(g), 0.5) / max(total - len(d), 1))
            s += (top - k) * math.log(0.4)
            hits, full = hits + (k > 1), full + (k == order)
        out.append((i, len(d), hits, full, s))
    return sorted(out, key=str)


def score(spark, rows, order=3):
    df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, n_words int")
    return sorted(((r["doc_id"], r["n_words"], r["n_hits"], r["n_full"], r["log_score"]) for r in backoff.scores(df, order).collect()), key=str)


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (str(r[:4]), r[4])), sorted(want, key=lambda r: (str(r[:4]), r[4]))):
        assert g[:4] == w[:4] and abs(g[4] - w[4]) <= 2e-4 * max(1, abs(w[4]) * 1e-3)


def test_scores_equal_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"W{i}" if i % 5 else f"w{i}é" for i in range(200)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 30, 400])))) for i in range(300)]
    rows += [(900, None), (901, "  \t\n\x0b\x0c\r "), (902, "same same same same"), (902, "same same same same"), (None, "Null Id w5 w10"), (903, "a\x0bb\x0cc\rd e"), (904, "w1 " * 20_000)]
    for order in (1, 2, 3, 4):
        close(score(spark, rows, order), brute_scores(rows, order))


def test_scores_of_a_shuffled_input(spark):
    """Blocks are told apart by their place in a task, so an input whose rows move is stored first."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 60)))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = [tuple(r[c] for c in ("doc_id", "n_words", "n_hits", "n_full", "log_score")) for r in backoff.scores(df).collect()]
    close(got, brute_scores(rows))


def test_small_blocks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(backoff, "BUCKET_BYTES", 500)
    rng = random.Random(10)
    rows = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 60)))) for i in range(300)]
    close(score(spark, rows), brute_scores(rows))


def test_scores_of_empty_table(spark):
    assert score(spark, []) == []
    assert score(spark, [(1, None), (2, "alone")]) == [(1, 0, 0, 0, 0.0), (2, 1, 0, 0, round(math.log(0.5), 4))]
