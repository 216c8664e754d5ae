import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline as cp
from tidelog.llm import packing, queries, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int"
KEY = "AKIA" + "QWERTYUIOPASDFGH"


def words(rng, n, of=3000):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 7) for i, t in rows], SCHEMA).repartition(3)


def plain(df):
    assert df.columns == cp.COLUMNS
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def without_near_duplicates(rows):
    """Rows of one id are one node; the least id of each class stays, with its distinct texts."""
    real = [(i, shingles(t)) for i, t in rows if i is not None]
    part = {i: i for i, _ in real}
    while True:
        before = dict(part)
        for i, a in real:
            for j, b in real:
                if a and b and 5 * len(a & b) >= 4 * len(a | b):
                    part[i] = part[j] = min(part[i], part[j])
        if part == before:
            break
    own = [r for r in rows if r[0] is not None and part[r[0]] == r[0]]
    return sorted([*set(own), *[r for r in rows if r[0] is None]], key=str)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(40):
        rows.append((i, words(rng, 80)))
        if i % 4 == 0:
            rows.append((100 + i, rows[-1][1] + " more"))
    unlike = [(1, "another text under an id that is there"), (2, None), (2, None), (3, "")]
    rows += [rows[0], rows[0], *unlike, (200, None), (201, ""), (201, ""), (None, words(rng, 30)), (None, "x")]
    got = plain(cp.drop_near_duplicates(spark, table(spark, rows), ""))
    assert got == without_near_duplicates(rows)
    assert {r for r in unlike} <= set(got)
    assert plain(cp.drop_near_duplicates(spark, table(spark, []), "")) == []


def test_secrets_are_masked_and_all_rows_stay(spark):
    rows = [(1, f"key {KEY} end"), (1, f"key {KEY} end"), (2, "nothing"), (3, None), (4, ""), (None, f"{KEY}")]
    got = cp.mask_secrets(spark, table(spark, rows), "")
    own = plain(got)
    assert len(own) == len(rows) and not any(KEY in (t or "") for _, t in own)
    assert {(2, "nothing"), (3, None), (4, "")} <= set(own)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.collect())
    assert plain(cp.mask_secrets(spark, table(spark, []), "")) == []


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    """Documents with toxic words, near-duplicates, a shared passage of 51 words, secrets, nulls and repeated rows."""
    rng = random.Random(7)
    path = tmp_path_factory.mktemp("corpus")
    shared = words(rng, 51)
    rows = [(i, words(rng, 60) + (" vile nasty hateful awful" * 5 if i % 3 == 0 else " fine day")) for i in range(240)]
    rows += [(300, f"{words(rng, 40)} {shared}"), (301, f"{shared} {words(rng, 40)}"), (302, f"my key {KEY} {words(rng, 30)}")]
    rows += [(400, rows[1][1] + " again"), (401, None), (402, ""), rows[2]]
    ids, texts = zip(*rows)
    types = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}
    cols = [ids, texts, ["en"] * len(rows), ["s"] * len(rows), [len(t or "") for t in texts]]
    pq.write_table(pa.table({n: pa.array(c, t) for (n, t), c in zip(types.items(), cols)}), path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(range(240), pa.int64()), "toxic": pa.array([int(i % 3 == 0) for i in range(240)], pa.int32())}), path / "labels.parquet")
    return str(path), rows, shared


def test_toxic_rows_go_by_score(spark, corpus):
    path, rows, _ = corpus
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    score = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    got = plain(cp.drop_toxic(spark, docs, path))
    assert got == sorted((r for r in rows if score[r[0]] < 0.7), key=str)
    assert 0 < len(got) < len(rows)


def test_run_does_every_stage(spark, corpus):
    path, rows, shared = corpus
    kept = set()
    for r in plain(cp.drop_toxic(spark, spark.read.parquet(f"{path}/documents.parquet"), path)):
        kept.add(r)
    want = {i: t for i, t in without_near_duplicates(sorted(kept, key=str))}
    assert 400 not in want
    tokens = {i: len(packing.tokenize(vocab := open(queries.vocab_path(), "rb").read(), t or "")) + 1 for i, t in want.items() if i not in (300, 301, 302)}
    out = cp.run(spark, path).collect()
    length = {}
    for r in out:
        length[r.doc_id] = length.get(r.doc_id, 0) + r.length
    assert {i: n for i, n in length.items() if i not in (300, 301, 302)} == tokens
    for i in {300, 301} & want.keys():  # both copies of the passage are cut
        text = want[i].replace(shared, "") if {300, 301} <= want.keys() else want[i]
        assert length[i] == len(packing.tokenize(vocab, text)) + 1
    assert len(out) == len({(r.sequence_id, r.offset) for r in out})


ODD = [(1, None), (1, None), (2, ""), (3, "same text here"), (3, "same text here"), (None, "no id"), (None, None), (4, "x " * 150_000), (5, "é" * 70_000)]


def odd(spark, rows=ODD):
    """With columns named as those that the stages make themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, blob string, spans int, t1 long, _0 int, h1 long, start int"
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 0.99, "b", 1, 2, 3, 4, 5) for i, t in rows], schema)


def test_toxicity_takes_odd_and_no_rows(spark, corpus, tmp_path):
    path = corpus[0]
    got = plain(cp.drop_toxic(spark, odd(spark), path))  # no row has a label of its own text: the bias decides
    assert got == sorted(ODD, key=str)
    assert plain(cp.drop_toxic(spark, odd(spark, []), path)) == []
    pq.write_table(pa.table({"doc_id": pa.array([], pa.int64()), "toxic": pa.array([], pa.int32())}), tmp_path / "labels.parquet")
    assert plain(cp.drop_toxic(spark, odd(spark), str(tmp_path))) == sorted(ODD, key=str)


@pytest.mark.parametrize("stage", ["near_duplicates", "repeats", "secrets"])
def test_stages_take_odd_and_no_rows(spark, stage):
    f = dict(cp.STAGES)[stage]
    got = plain(f(spark, odd(spark), ""))
    want = list(ODD)
    if stage == "near_duplicates":
        want = without_near_duplicates(ODD)
    elif stage == "repeats":  # texts that are repeats as a whole are left empty and go; these two repeat themselves
        want = [r for r in ODD if r[0] not in (4, 5)]
    assert got == sorted(want, key=str)
    assert plain(f(spark, odd(spark, []), "")) == []


def test_packing_takes_odd_and_no_rows(spark):
    vocab = open(queries.vocab_path(), "rb").read()
    rows = cp.pack(spark, odd(spark), "").collect()
    by = {}
    for r in rows:
        assert r.length == len(r.ids)
        by.setdefault(r.doc_id, []).append(r)
    for i in {i for i, _ in ODD}:
        texts = [t or "" for j, t in ODD if j == i]
        assert sum(r.length for r in by[i]) == sum(len(packing.tokenize(vocab, t)) + 1 for t in texts)
    seq = {}
    for r in rows:
        seq.setdefault(r.sequence_id, []).append(r)
    for own in seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert cp.pack(spark, odd(spark, []), "").count() == 0


def test_packed_ids_are_the_pieces_own(spark):
    """Equal pieces are interchangeable, unlike ones are not: every piece has the ids that its place and checksum name."""
    import zlib

    import numpy as np

    rng = random.Random(3)
    rows = [(i % 20, words(rng, rng.choice([1, 5, 400, 3000]))) for i in range(60)]
    for r in cp.pack(spark, odd(spark, rows), "").collect():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
