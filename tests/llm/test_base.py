import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.llm import base


def brute(edges):
    part = {}

    def root(a):
        part.setdefault(a, a)
        while part[a] != a:
            a = part[a]
        return a

    for u, v in edges:
        if u is not None and v is not None:
            x, y = root(u), root(v)
            part[max(x, y)] = min(x, y)
    return sorted((a, root(a)) for a in part)


def run(spark, edges):
    return sorted(tuple(r) for r in base.components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect())


def test_components_of_a_long_path_and_of_a_hub(spark):
    rng = random.Random(1)
    names = rng.sample(range(10**6), 1500)
    path = list(zip(names, names[1:]))
    hub = [(7 * 10**6, 8 * 10**6 + i) for i in range(400)]
    rest = [(rng.randrange(2 * 10**6, 3 * 10**6), rng.randrange(2 * 10**6, 3 * 10**6)) for _ in range(200)]
    edges = path + [(v, u) for u, v in hub] + rest + rest[:5] + [(5 * 10**6, 5 * 10**6), (None, 3), (4, None)]
    rng.shuffle(edges)
    assert run(spark, edges) == brute(edges)
    assert run(spark, []) == []


def test_small_files_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(base, "EDGES", 10)
    edges = [(i, i + 1) for i in range(0, 200, 2)] + [(i, i + 3) for i in range(0, 100, 4)]
    assert run(spark, edges) == brute(edges)


def folders(spark):
    root = base.shared_dir(spark).removeprefix("file://") + "/tidelog"
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_what_an_operator_stored_goes_when_it_ends(spark):
    @base.stored("result")
    def inner(n):
        return base.materialize(spark.range(n), "inner").where("id > 1")

    @base.stored("outer")
    def outer():
        return inner(5).unionByName(inner(4))

    before = folders(spark)
    out = outer()
    assert sorted(r.id for r in out.collect()) == [2, 2, 3, 3, 4]
    assert {n.rsplit("-", 1)[0] for n in folders(spark) - before} == {"outer"}

    @base.stored("failing")
    def fails():
        base.materialize(spark.range(3), "lost")
        raise ValueError("no")

    now = folders(spark)
    with pytest.raises(ValueError):
        fails()
    assert folders(spark) == now


def test_only_shuffled_inputs_are_stored_first(spark, sf):
    plain = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    assert base.stable(plain, "x") is plain
    moved = plain.repartition(5)
    kept = base.stable(moved, "x")
    assert kept is not moved and kept.count() == plain.count()
    assert base.stable(plain.orderBy(F.rand()).limit(9), "x").count() == 9


def test_slices_are_whole_rows():
    texts = ["a" * 100, None, "", "é" * 400_000, "b" * 10] * 3
    got = {}
    for at, data, offs in base.slices(pa.array(texts)):
        for i in range(len(offs) - 1):
            got[at + i] = bytes(np.asarray(data[offs[i] : offs[i + 1]])).decode()
    assert got == {i: t or "" for i, t in enumerate(texts)}
    assert list(base.slices(pa.array([], pa.string()))) == []
