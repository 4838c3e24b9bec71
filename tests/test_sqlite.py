"""SQLite tables as a source: values, partitions, filters that reach the file, and that nothing is written."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from meterlark.operators import attribution
from meterlark.sources import sqlite as source


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    at = str(tmp_path_factory.mktemp("db") / "odd name ?.db")
    db = sqlite3.connect(at)
    db.execute("CREATE TABLE requests (request_id TEXT, provider TEXT, source TEXT, tokens INTEGER, cost REAL, body BLOB)")
    rows = [(f"r{i}", f"p{i % 3}" if i % 10 else "_none", "proxy" if i % 4 else "import", i, i / 7, bytes([i % 256])) for i in range(5000)]
    db.executemany("INSERT INTO requests VALUES (?, ?, ?, ?, ?, ?)", [*rows, (None, None, None, None, None, None), ("odd", "p1", "proxy", "no number", 3, "text")])
    db.execute("DELETE FROM requests WHERE tokens BETWEEN 1000 AND 1999")
    db.execute("CREATE TABLE keyed (k TEXT PRIMARY KEY, v INTEGER) WITHOUT ROWID")
    db.execute("INSERT INTO keyed VALUES ('a', 1), ('b', 2)")
    db.execute("CREATE TABLE blank (k TEXT)")
    db.commit()
    db.close()
    return at


def test_values_and_partitions(spark, path):
    before = open(path, "rb").read()
    df = source.read_sqlite(spark, path, "requests", partitions=5)
    assert df.dtypes == [("request_id", "string"), ("provider", "string"), ("source", "string"), ("tokens", "bigint"), ("cost", "double"), ("body", "binary")]
    assert df.rdd.getNumPartitions() == 5 and df.count() == 4002
    odd = df.where("request_id = 'odd'").first()
    assert odd["tokens"] is None and odd["cost"] == 3.0 and odd["body"] is None
    assert df.where("request_id IS NULL").count() == 1 and df.agg(F.sum("tokens")).first()[0] == sum(i for i in range(5000) if not 1000 <= i < 2000)
    assert source.read_sqlite(spark, path, "keyed").orderBy("k").collect() == [("a", 1), ("b", 2)] and source.read_sqlite(spark, path, "blank").count() == 0
    assert open(path, "rb").read() == before


def test_conditions_are_applied_in_the_file(spark, path):
    schema = source.read_sqlite(spark, path, "requests").schema
    reader = source.SqliteReader(schema, {"path": path, "table": "requests", "only": '[["request_id", "=", "r7"], ["tokens", "in", [7, 8]], ["cost", "is not null"]]'})
    assert reader.where == [('"request_id" = ?', ["r7"]), ('"tokens" in (?, ?)', [7, 8]), ('"cost" is not null', [])]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 1
    some = source.read_sqlite(spark, path, "requests", [("tokens", ">=", 4990), ("provider", "in", ["p1", "p2"])])
    expected = sum(1 for i in range(4990, 5000) if i % 10 and i % 3) + 1  # and the text that SQLite sorts after numbers
    assert some.count() == expected and some.where("tokens < 4995").count() + some.where("tokens >= 4995 OR tokens IS NULL").count() == expected
    with pytest.raises(ValueError):
        source._condition("a", "= 1 OR", 1)
    with pytest.raises(Exception, match="no table"):
        source.read_sqlite(spark, path, "missing").count()


def test_attribution_from_a_proxy_log(spark, path):
    log = source.proxy_log(spark, path)
    assert log.count() == sum(1 for i in range(5000) if i % 4 and i % 10 and not 1000 <= i < 2000) + 1
    events = spark.createDataFrame([("m", f"r{i}", i, None, None) for i in (1, 4, 10, 1500)], "machine_id string, request_id string, us long, org_id string, account_id string")
    timeline = spark.createDataFrame([("m", 3, "t")], "machine_id string, us long, profile string")
    found = {r["request_id"]: (r["profile"], r["level"]) for r in attribution.attribute_events(events, log, timeline, default_profile="d").collect()}
    assert found == {"r1": ("p1", "proxy"), "r4": ("t", "timeline"), "r10": ("t", "timeline"), "r1500": ("t", "timeline")}
