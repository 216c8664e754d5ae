import random
from collections import Counter

import pytest

import corpus_pipeline
from tidelog.llm import passages

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(texts, words=51):
    """Word positions that lie in a repeated window of so many words, by text."""
    split = [(t or "").split() for t in texts]
    seen = Counter(tuple(w[i : i + words]) for w in split for i in range(len(w) - words + 1))
    return [{j for i in range(len(w) - words + 1) if seen[tuple(w[i : i + words])] > 1 for j in range(i, i + words)} for w in split]


def corpus():
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "bé", "cc", "ε", "dddd"]) + str(rng.randrange(40))
    shared = [[word() for _ in range(rng.choice([50, 51, 52, 60, 63, 90, 130]))] for _ in range(14)]
    texts = []
    for _ in range(150):
        parts = [word() for _ in range(rng.randint(0, 70))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.choice([0, 0, rng.randrange(len(p))])
            parts += p[a:] + [word() for _ in range(rng.randint(0, 9))]
        texts.append("".join(w + rng.choice([" ", "\n", "  ", " ", "　", " "]) for w in parts))
    return texts + [texts[0], texts[1], None, "", " ", "x " * 52, "y " * 51]


def cut(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], COLUMNS).repartition(3)
    return {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}


@pytest.mark.parametrize("group, take", [(20_000, 1 << 22), (2, 1 << 22), (20_000, 300)])
def test_passages_equal_brute_force(spark, monkeypatch, group, take):
    """Stretches compared together, by hashes in a shuffle, and a few at a time."""
    monkeypatch.setattr(passages, "TAKE", take)
    texts = corpus()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    keyed = passages.suffix_dedup._keyed(docs)
    spans = {(r.t1, r.t2): r.spans for r in passages.repeated_passages(keyed.select("t1", "t2", "text"), group=group).collect()}
    got = {r.doc_id: spans.get((r.t1, r.t2)) for r in keyed.collect()}
    for i, gone in enumerate(brute(texts)):
        raw = (texts[i] or "").encode()
        own, at = set(), 0
        covered = passages.suffix_dedup.merged(got[i])
        for n, w in enumerate((texts[i] or "").split()):
            at = raw.index(w.encode(), at)
            if any(lo <= at and at + len(w.encode()) <= hi for lo, hi in covered):
                own.add(n)
            at += len(w.encode())
        assert own == gone, i


def test_stage_cuts_passages_shorter_than_400_bytes(spark):
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(10**3)}" for _ in range(n))
    p51, p50 = words(51), words(50)
    assert len(p51) < 400
    got = cut(spark, [f"{words(20)} one {p51} two", f"three {p51}", f"{p50} four", f"five {p50} six", p51, None, ""])
    assert [p51 in (got[i].text or "") for i in (0, 1)] == [False, False] and got[1].text == "three " and got[1].n_chars == 6
    assert got[2].text == f"{p50} four" and got[3].text == f"five {p50} six"  # 50 words are not over 50
    assert 4 not in got and got[6].text == ""


def test_stage_still_cuts_400_bytes_of_few_words(spark):
    rng = random.Random(2)
    p = "".join(rng.choice("abcdefgh") for _ in range(400))
    got = cut(spark, [f"x {p}", f"{p} y", "z"])
    assert (got[0].text, got[1].text, got[2].text) == ("x ", " y", "z")


def test_digest_reports_strings_and_passages(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, spans int").repartition(3)
    own = {r.doc_id: r for r in passages.digest(docs).collect()}
    plain = {r.doc_id: r for r in passages.suffix_dedup.digest(docs).collect()}
    assert len(own) == len(texts) and any(r.n_removed for r in own.values())
    for i, gone in enumerate(brute(texts)):
        assert tuple(own[i])[:5] == tuple(plain[i])
        words = (texts[i] or "").split()
        least = sum(len(words[j].encode()) for j in gone)
        assert least <= own[i].n_passage_bytes <= len((texts[i] or "").encode()) and (own[i].n_passage_bytes > 0) == bool(gone)
    assert passages.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
