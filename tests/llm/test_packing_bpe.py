import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidelog.llm import bpe, packing, queries

TEXTS = [
    None, "", " ", "a", "hello world", "  leading", "trailing  ", "tabs\tand\nnew\r\nlines \n\n x", "I'll don't we've 's", "naïve café 東京タワー 😀😀",
    "x" * 5000, "ab" * 3000, "1234567890" * 50, "<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endoftext|>", " nbsp em　wide \x1c\x1d\x85 z",
    "!!! ??? ... ---", " ".join(["word"] * 3000), "mixed123abc_DEF", "﻿bom ​ zero", "\x00 nul", "a  b   c    d",
]


@pytest.fixture(scope="module")
def vocab():
    return queries.vocab_path()


@pytest.fixture(scope="module")
def library(vocab):
    t = Tokenizer.from_file(vocab)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def encoder(vocab):
    with open(vocab, "rb") as f:
        return bpe.Encoder(f.read())


def frame(spark, texts):
    return spark.createDataFrame([(i if i % 7 else None, t, "c", 5) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")


def test_encoder_equals_library(encoder, library):
    for t in TEXTS:
        if t:
            ids = library.encode(t, add_special_tokens=False).ids
            raw = encoder.encode(t)
            assert np.frombuffer(raw, "<u4").tolist() == ids, t[:40]
            assert encoder.decode(raw) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\tabet'sl1")), max_size=60))
def test_any_text(encoder_library, text):
    encoder, library, content = encoder_library
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want
    assert packing.tokenize(content, text).tolist() == want


@pytest.fixture(scope="module")
def encoder_library(encoder, library, vocab):
    with open(vocab, "rb") as f:
        return encoder, library, f.read()


def test_suffix_automaton_lists_all_that_ends():
    rng = random.Random(4)
    strings = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 7))) for _ in range(60)} | {b"a", b"b"})
    auto = bpe.SuffixAutomaton(strings)
    for _ in range(200):
        text, state, size = bytes(rng.choice(b"ab") for _ in range(30)), 0, 0
        for end, c in enumerate(text, 1):
            while c not in auto.next[state]:
                state = auto.link[state]
                size = auto.length[state]
            state, size = auto.next[state][c], size + 1
            got = auto.ends[state] if size == auto.length[state] else auto.ends[auto.link[state]]
            want = sorted(((k, len(s)) for k, s in enumerate(strings) if text[:end].endswith(s)), key=lambda x: -x[1])
            assert got == want


def test_long_texts_and_gaps(encoder_library):
    """Texts beyond any buffer, runs without spaces, and gaps that the compiled library can't take."""
    encoder, library, content = encoder_library
    rng = random.Random(6)
    words = " ".join(rng.choice(["time", "house", "<|endoftext|>", "naïve", "123", "\n\n", "東京"]) for _ in range(90_000))
    for text in (words, "x" * 300_000, " " * 6000 + "a" + "\n" * 5000, "".join(rng.choice("abcdefgh") for _ in range(280_000)), words[:50_000] + " \t" * 4000 + words[:70_000]):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want
        assert packing.tokenize(content, text).tolist() == want


def test_digest(spark, vocab, library):
    got = Counter(map(tuple, bpe.encode_digest(frame(spark, TEXTS + TEXTS[:3]), vocab).collect()))
    want = Counter()
    for i, t in enumerate(TEXTS + TEXTS[:3]):
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[(i if i % 7 else None, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())] += 1
    assert got == want
    assert bpe.encode_digest(frame(spark, []), vocab).count() == 0


def test_round_trip(spark, vocab):
    for r in bpe.encode_decode(frame(spark, TEXTS), vocab).collect():
        assert r["decoded"] in [t or "" for t in TEXTS]


def check_packed(rows, docs, library, window=2048):
    """The contract: ids whole, windows gapless and not too long."""
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        seq.setdefault(r["sequence_id"], []).append(r)
    assert by.keys() == docs.keys()
    for d, own in by.items():
        ids = np.array([*library.encode(docs[d] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    for own in seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    return sum(r["length"] for r in rows) / (window * len(seq))


def test_pack_documents(spark, vocab, library):
    rng = random.Random(1)
    docs = {i: t for i, t in enumerate(TEXTS)} | {100 + i: " ".join(rng.choice(["time", "house", "river", "water"]) for _ in range(rng.choice([7, 40, 900, 2047, 2048, 4100, rng.randint(1, 3000)]))) for i in range(150)}
    df = spark.createDataFrame([(i, t, 0) for i, t in docs.items()], "doc_id long, text string, offset int")
    full = check_packed(packing.pack_documents(df, vocab).collect(), docs, library)
    assert full >= 0.97


def test_pack_repeats_nulls_and_empty(spark, vocab):
    df = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, None), (None, None)], "doc_id long, text string")
    rows = packing.pack_documents(df, vocab).collect()
    assert len(rows) == 4 and {r["sequence_id"] for r in rows} == {0}
    at = 0
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert r["offset"] == at
        at += r["length"]
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), vocab).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=16, max_size=16))
def test_plan_uses_every_length_exactly(counts):
    units = 16
    counts = np.array([0, *counts])
    used = np.zeros(units + 1, np.int64)
    for content, n in packing.plan(counts, units):
        assert n > 0 and sum(content) <= units
        for size in content:
            used[size] += n
    assert (used == counts).all()


def test_nnls_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.random((8, 20)), rng.random(8) * 10
        x = packing.nnls(a, b)
        grad = a.T @ (b - a @ x)
        assert (x >= 0).all() and (grad <= 1e-5).all() and np.abs(grad[x > 1e-9]).max(initial=0) <= 1e-5


def test_parts_of_words_are_encoded_once(vocab, library, monkeypatch):
    with open(vocab, "rb") as f:
        enc = bpe.Encoder(f.read())
    met, word = Counter(), enc.word
    monkeypatch.setattr(enc, "word", lambda raw: met.update([raw]) or word(raw))
    text = "Qanlirén.\nZovéle qanlirén.\nZovéle tri,\nZovéle Zovéle tri qanlirén,\ntri"
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert max(met.values()) == 1, met


def test_forgetful_encoder_equals_library(vocab, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 24)
    with open(vocab, "rb") as f:
        enc = bpe.Encoder(f.read())
    for t in TEXTS:
        if t:
            assert np.frombuffer(enc.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t[:40]
