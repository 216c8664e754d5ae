import math
import random
import zlib

import numpy as np

from tidelog.llm import toxicity as tox

BAD = ["vile", "scum", "loathe", "wretch"]
GOOD = [f"word{i}" for i in range(150)]


def corpus(n=900, seed=2):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        words = [rng.choice(GOOD) for _ in range(rng.randint(5, 60))]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


def frames(spark, docs, labels):
    d = spark.createDataFrame([(i, t, "en", 1.0) for i, t in docs], "doc_id long, text string, lang string, score double")
    return d, spark.createDataFrame([(i, t, 9) for i, t in labels], "doc_id long, toxic int, quality int")


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    truth = dict(labels)
    got = tox.classify(*frames(spark, docs, labels)).collect()
    assert len(got) == len(docs)
    right = []
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        if r["held_out"]:
            right.append(r["predicted"] == truth[r["doc_id"]])
    assert len(right) > 200 and np.mean(right) >= 0.97


def test_held_out_labels_teach_nothing(spark):
    docs, labels = corpus(300)
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]
    score = lambda lab: sorted(map(tuple, tox.classify(*frames(spark, docs, lab)).collect()))
    assert score(labels) == score(turned)


def test_whole_texts_count(spark):
    docs, labels = corpus()
    long = "word1 word2 word3 " * 30_000
    docs += [(5000, long), (5001, long + "vile scum loathe wretch vile"), (5002, "vile scum loathe wretch vile " + long)]
    got = {r["doc_id"]: r["score"] for r in tox.classify(*frames(spark, docs, labels)).collect()}
    assert got[5000] < 0.5 < 0.7 < got[5001] and got[5002] > 0.7


def test_edge_cases(spark):
    docs, labels = corpus(200)
    odd = [(None, "vile"), (None, None), (700, None), (701, ""), (3, "word1 word2"), (3, "word1 word2")]
    got = tox.classify(*frames(spark, docs + odd, labels + [(None, 1), (701, None), (99999, 1)])).collect()
    assert len(got) == len(docs) + len(odd)
    bias = {r["score"] for r in got if r["doc_id"] in (700, 701)}
    assert len(bias) == 1
    assert all(r["held_out"] for r in got if r["doc_id"] is None)
    flat = tox.classify(*frames(spark, docs[:5], [])).collect()
    assert [r["score"] for r in flat] == [0.5] * 5
    assert tox.classify(*frames(spark, [], [])).count() == 0


def test_l1_makes_a_sparse_model():
    rng = np.random.default_rng(0)
    bits = 12
    seen = [(k % 2, np.unique(np.append(rng.integers(0, 1 << bits, 40), [7 if k % 2 else 8, 1 << bits]))) for k in range(800)]
    w = tox.learn_all(seen, bits).weights(np.arange((1 << bits) + 1))
    assert w[7] > 0 > w[8] and np.count_nonzero(w) < 400


def plain_ftrl(seen, bits, epochs, again, min_docs, alpha=1.0, beta=1.0, l1=12.0):
    """The learner in plain Python: coordinate by coordinate, in dictionaries."""
    count = {}
    for _, at in seen:
        for i in at:
            count[i] = count.get(i, 0) + 1
    keep = {i for i, n in count.items() if n >= min_docs} | {1 << bits}
    for most, l in ((epochs, l1), (again, 0.0)):
        z, n = {}, {}

        def weight(i):
            zi = z.get(i, 0.0)
            return 0.0 if abs(zi) <= l else -(zi - math.copysign(l, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha)

        for _ in range(most):
            for label, at in seen:
                own = [i for i in at if i in keep]
                w = {i: weight(i) for i in own}
                g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - label
                for i in own:
                    z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha * w[i]
                    n[i] = n.get(i, 0.0) + g * g
        learned = {i: weight(i) for i in n if weight(i)}
        keep = set(learned) | {1 << bits}
    return learned


def test_learner_equals_plain_python():
    rng = np.random.default_rng(3)
    bits = 9
    seen = [(k % 2, np.unique(np.append(rng.integers(0, 1 << bits, 25), [5 if k % 2 else 6, 1 << bits])).astype(np.int32)) for k in range(250)]
    want = plain_ftrl([(label, at.tolist()) for label, at in seen], bits, tox.EPOCHS, tox.AGAIN, tox.MIN_DOCS)
    at, w = tox.learn_all(seen, bits).model()
    assert set(at.tolist()) == set(want)
    assert np.allclose(w, [want[i] for i in at.tolist()], rtol=1e-6, atol=1e-9)


def test_features_beyond_the_bound_are_not_learned(spark):
    """The learner takes documents in the order of the hash while their features fit; scores still cover all rows."""
    docs, labels = corpus(300)
    d, lab = frames(spark, docs, labels)
    few, all_ = tox.train(d, lab, coordinates=3000), tox.train(d, lab)
    assert len(few[0]) < len(all_[0])
    assert tox.score(d, few).count() == 300
    none = tox.train(d, lab, coordinates=1)
    assert {r.score for r in tox.score(d, none).collect()} == {0.5}


def test_rows_of_one_id_are_learned_in_a_fixed_order(spark):
    docs, labels = corpus(200)
    both = docs + [(i, t + " word1 word2") for i, t in docs[:100]]
    d, lab = frames(spark, both, labels)
    one, two = (tox.train(x, lab) for x in (d.repartition(5), d.orderBy("text")))
    assert (one[0] == two[0]).all() and (one[1] == two[1]).all()
