"""The registered queries, on a whole given table, against brute force, the library or SQL."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from test_ann import brute as nearest
from test_minhash import brute as near_duplicates
from test_packing_bpe import check_packed
from test_passages import brute as passages_of
from test_suffix_dedup import brute as repeats
from test_vector_dedup import brute as links
from tokenizers import Tokenizer

from tidelog.llm import queries


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def vectors(spark, sf):
    return [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(queries.vocab_path())
    t.no_truncation()
    t.no_padding()
    return t


def run(spark, sf, name):
    return queries.QUERIES[name](spark, sf).collect()


def test_op1(spark, sf, vectors):
    want = nearest(vectors, lambda i: i % 20 == 0, 20)
    got = {}
    for r in sorted(run(spark, sf, "op1_ann"), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys()
    assert sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))
    x = {i: np.array(v, np.float32).astype(np.float64) for i, v in vectors}
    for q, own in got.items():
        assert own == sorted(own, key=lambda r: (-r[1], r[0])) and len(own) == len(want[q])
        assert all(s == pytest.approx(float(x[q] @ x[v]), rel=1e-12) for v, s in own)


def test_op3(spark, sf, docs, library):
    rows = run(spark, sf, "op3_packing")
    assert check_packed(rows, dict(docs), library) >= 0.95


def test_op4(spark, sf, docs, library):
    want = []
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, run(spark, sf, "op4_bpe"))) == sorted(want)


def test_op5(spark, sf, vectors):
    assert sorted((tuple(r[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in run(spark, sf, "op5_vector_dedup")), key=str) == links(vectors)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(queries.ORACLE[name])
    names = [d[0] for d in cur.description]
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    plain = lambda rows: sorted(tuple(round(x, 3) if isinstance(x, float) else x for x in r) for r in rows)
    assert plain(map(tuple, got.select(*names).collect())) == plain(cur.fetchall())


def test_op8(spark, sf, docs):
    """Labels of held-out rows change nothing; every row has a score; the learned ones are told apart."""
    rows = {r.doc_id: r for r in run(spark, sf, "op8_toxicity")}
    assert rows.keys() == {i for i, _ in docs}
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    taught = [(rows[i].predicted, t) for i, t in toxic.items() if i in rows and not rows[i].held_out]
    assert np.mean([p == t for p, t in taught]) >= 0.85  # a few dozen labelled rows
    held = [(rows[i].predicted, t) for i, t in toxic.items() if i in rows and rows[i].held_out]
    assert sum(p for p, t in held if not t) <= 0.1 * max(1, sum(1 - t for _, t in held))


def test_op9(spark, sf, docs):
    got = sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in run(spark, sf, "op9_minhash")), key=str)
    assert got == near_duplicates(docs, 4, 80)


def test_op10(spark, sf, docs):
    rows = {r.doc_id: r for r in run(spark, sf, "op10_suffix_dedup")}
    want = repeats([t for _, t in docs], 400)
    for (i, t), own, gone in zip(docs, want, passages_of([t for _, t in docs])):
        assert tuple(rows[i])[1:5] == own
        assert (rows[i].n_passage_bytes > 0) == bool(gone)
