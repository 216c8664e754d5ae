"""Every registered log query against its SQL on the smallest tables."""

import duckdb
import pytest

from tidelog.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return "NULL" if v is None else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    cur = duck.execute(registry.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())


def test_entry_and_keys(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.ORACLE) <= set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_checksums_of_records(spark, sf):
    from tidelog.functions.checksum import crc32c

    assert crc32c(b"123456789") == 0xE3069283  # the published check value
    assert registry.QUERIES["crc32c_records"](spark, sf).count() > 0


def test_range_scan_is_pruned_and_pushed(spark, sf, tmp_path, capsys):
    from tidelog.operators import log as L
    from tidelog.plans import tables

    L.write_log(tables.events_log(spark, sf), str(tmp_path / "log"))
    L.fetch(spark.read.parquet(str(tmp_path / "log")), 3, 0, 5, 10).select("seq", "payload").explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [" in plan and "pid" in plan.split("PartitionFilters: [")[1].split("\n")[0]
    assert "GreaterThanOrEqual(seq,5)" in plan and "TakeOrderedAndProject" in plan
