import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import suffix_dedup as sd


def brute(texts, length):
    seen = Counter()
    raws = [(t or "").encode() for t in texts]
    for raw in raws:
        seen.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    out = []
    for raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[:-1]
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def run(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, 4, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, lo int, t1 int, spans string").repartition(3)
    return [tuple(r)[1:] for r in sorted(sd.digest(df, **kw).collect())]


def corpus(seed, length):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "dé", "ε", "x", "longerword", "7"]) + str(rng.randrange(50))
    passages = [" ".join(word() for _ in range(rng.randint(length // 6, length))) for _ in range(8)]
    texts = []
    for _ in range(120):
        parts = [" ".join(word() for _ in range(rng.randint(0, length // 2)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += [p[a : a + rng.randint(length // 2, 3 * length)], word()]
        texts.append(" ".join(parts))
    return texts + [texts[0], texts[1], texts[1] + "!", None, "", "ab" * (2 * length), "a" * (3 * length), "a" * (length + 1), "é" * length]


@pytest.mark.parametrize("group", [20_000, 3])
def test_equals_brute_force(spark, group):
    texts = corpus(group, 48)
    assert run(spark, texts, length=48, k=16, group=group) == brute(texts, 48)


def test_production_parameters(spark):
    texts = corpus(5, 400)
    assert run(spark, texts) == brute(texts, sd.LENGTH)


def test_border_cases(spark):
    p = "".join(random.Random(3).choice("abcdefgh") for _ in range(400))
    texts = [p, "x" + p, p[:-1], p[1:] + "q", "y" * 10]
    assert run(spark, texts) == brute(texts, 400)
    assert run(spark, []) == []
    assert run(spark, [None, "", "short"]) == brute([None, "", "short"], 400)
    # within one document, overlapping itself
    assert run(spark, ["z" * 401]) == brute(["z" * 401], 400)
    assert run(spark, ["z" * 400]) == brute(["z" * 400], 400)


def test_long_text(spark):
    rng = random.Random(11)
    long = "".join(rng.choice("abcdefghij klmno") for _ in range(300_000))
    texts = [long, long[1000:2000], "q" + long[150_000:150_399], long[299_000:]]
    got = run(spark, texts)
    assert [g[1] for g in got] == [2000, 1000, 0, 1000]


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(min_size=20, max_size=20).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=40), st.sampled_from([4, 8, 16]))
def test_deep_shallow_sorts_with_common_prefixes(rows, shallow):
    a = np.array([list(r) for r in rows], np.uint8)
    order, lcp = sd.deep_shallow(a, shallow)
    got = [rows[i] for i in order]
    assert sorted(order.tolist()) == list(range(len(rows))) and got == sorted(rows)
    assert lcp.tolist()[1:] == [common(x, y) for x, y in zip(got, got[1:])]


def test_deep_groups_use_the_trie():
    rng = random.Random(2)
    head = bytes(rng.randrange(256) for _ in range(100))
    rows = [head[: rng.randrange(60, 100)].ljust(100, bytes([rng.randrange(3)])) + bytes([rng.randrange(2)]) * 4 for _ in range(200)]
    a = np.array([list(r) for r in rows], np.uint8)
    order, lcp = sd.deep_shallow(a, 16)
    got = [rows[i] for i in order]
    assert got == sorted(rows) and lcp.tolist()[1:] == [common(x, y) for x, y in zip(got, got[1:])]


def test_least_positions_by_parts(monkeypatch):
    g = np.random.default_rng(5).integers(0, 2**64, 1000, dtype=np.uint64) >> np.uint64(20)
    want = [i + int(np.argmin(g[i : i + 37] >> np.uint64(28))) for i in range(1000 - 36)]
    assert sd.least_positions(g, 37).tolist() == want
    monkeypatch.setattr(sd, "STARTS", 50)
    assert sd.least_positions(g, 37).tolist() == want
