import hashlib
import re
from dataclasses import replace

from pyspark.sql import functions as F

from tidelog.llm import secret_scan as ss

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
TEXTS = [
    None, "", "nothing here", "password = hunter22hunter", "PASSWD:'abc' Token=\"abcdefgh\"", "😀😀 api_key: ABCDEFGH12 é secret=short",
    "AKIA" + "A1B2C3D4E5F6", "AKIAAKIAAKIA", "x" + "0123456789abcdef" * 3 + "y", "0" * 31, "0" * 32, "F" * 40,
    "token=" + "deadbeef" * 5, "secret= AKIA1234567890ABCD token  :  0123456789abcdef0123456789abcdef", "ſecret=abcdefgh1 ApI_KEY=\x20\x20'zzzzzzzz'",
    "password=password=password=abcdefgh", "token\n=abcdefgh", "a" * 5000 + " secret:abcdefghi " + "é" * 5000 + " token=abcdefghi",
    "password=aaaaaaaa" * 300, "tokentoken:12345678 apikey='1234567'",
]


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    names = ["assign", "access", "hex"]
    return ",".join(f"{names[k]}:{a}:{e}" for a, k, e in sorted(out)), [sum(k == i for _, k, _ in out) for i in range(3)]


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "b", None) for i, t in enumerate(texts)], "path long, text string, blob string, found int")


def test_spans_equal_brute_force(spark):
    found, _ = ss.scan_versions(frame(spark, TEXTS))
    got = {r["doc_id"]: r for r in ss.digest(found).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        want, n = brute(t)
        assert got[i]["spans"] == want, t
        assert [got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]] == n
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_query_equals_brute_force_on_the_table(spark, sf):
    from tidelog.llm import queries

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op2_secrets(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["spans"] == brute(texts[r["doc_id"]])[0]


def test_repeated_null_and_empty(spark):
    rows = [(1, "token=abcdefgh"), (1, "token=abcdefgh"), (None, "token=abcdefgh"), (None, None)]
    found, ledger = ss.scan_versions(spark.createDataFrame(rows, "path long, text string"))
    assert found.count() == 4 and found.where("size(found) = 1").count() == 3
    assert ledger.count() == 2 * len(ss.RULES)
    found, ledger = ss.scan_versions(spark.createDataFrame([], "path long, text string"))
    assert found.count() == 0 and ledger.count() == 0


def test_ledger_scans_only_unseen_pairs(spark):
    _, first = ss.scan_versions(frame(spark, TEXTS[:10]))
    first = spark.createDataFrame(first.collect(), first.schema)
    found, fresh = ss.scan_versions(frame(spark, TEXTS, 100), first)
    blobs = {hashlib.sha256((t or "").encode()).hexdigest() for t in TEXTS}
    seen = {r["blob"] for r in first.collect()}
    pairs = lambda x: sorted((r["blob"], r["kind"]) for r in x.collect())
    assert pairs(fresh) == sorted((b, r.kind) for b in blobs - seen for r in ss.RULES)
    got = {r["doc_id"] - 100: r["spans"] for r in ss.digest(found).collect()}
    assert got == {i: brute(t)[0] for i, t in enumerate(TEXTS)}
    # a changed rule makes every blob unseen for that rule, and for no other
    changed = (ss.RULES[0], replace(ss.RULES[1], revision=2), ss.RULES[2])
    again = spark.createDataFrame(first.unionByName(fresh).unionByName(fresh).collect(), first.schema)
    found, new = ss.scan_versions(frame(spark, TEXTS), again, changed)
    assert pairs(new) == sorted((b, "access") for b in blobs)
    assert {r["doc_id"]: r["spans"] for r in ss.digest(found).collect()} == {i: brute(t)[0] for i, t in enumerate(TEXTS)}
    # rules in another order find the same under their names
    found, new = ss.scan_versions(frame(spark, TEXTS), again, ss.RULES[::-1])
    assert new.count() == 0
    got = {r["doc_id"]: (r["n_hex"], r["n_assign"]) for r in ss.digest(found, ss.RULES[::-1]).collect()}
    assert got == {i: (brute(t)[1][2], brute(t)[1][0]) for i, t in enumerate(TEXTS)}


def test_increments_scan_a_blob_once(spark):
    one, two = frame(spark, TEXTS[:12]), frame(spark, TEXTS + TEXTS[:3], 100)
    found, ledger = ss.scan_increments([one, two, frame(spark, [], 500)])
    assert ledger.count() == len(ss.RULES) * len({t or "" for t in TEXTS})
    got = {r["doc_id"]: r["spans"] for r in ss.digest(found).collect()}
    assert got == {i: brute(t)[0] for i, t in enumerate(TEXTS[:12])} | {100 + i: brute(t)[0] for i, t in enumerate(TEXTS + TEXTS[:3])}


def test_very_many_matches_in_a_text(spark):
    text = "token=abcdefgh1 é" * 20_000
    found, _ = ss.scan_versions(frame(spark, [text, "token=abcdefgh"]))
    rows = {r["path"]: r["found"] for r in found.collect()}
    assert len(rows[0]) == 20_000 and rows[0][-1]["start"] == 17 * 19_999 and rows[0][-1]["end"] == 17 * 19_999 + 15
    assert len(rows[1]) == 1


def test_redact(spark):
    found, _ = ss.scan_versions(frame(spark, TEXTS))
    out = frame(spark, TEXTS).drop("blob", "found").join(found.drop("blob"), "path").withColumn("r", ss.redact(F.col("text"), F.col("found")))
    for r in out.collect():
        text, at, parts = r["text"] or "", 0, []
        for lo, hi in sorted((s["start"], s["end"]) for s in r["found"]):
            if lo >= at:
                parts += [text[at:lo], "[SECRET]"]
            at = max(at, hi)
        assert (r["r"] or "") == "".join([*parts, text[at:]])


def test_plan_has_no_python(spark, capsys):
    found, _ = ss.scan_versions(frame(spark, TEXTS[:3]))
    ss.digest(found).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
