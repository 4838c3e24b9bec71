"""The segmented scan against window functions over whole keys, and how its rows are spread."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from meterlark.operators.scan import Scan


@pytest.fixture(scope="module")
def series(spark):
    random.seed(4)
    rows = []
    for key, n in (("a", 900), ("b", 120), ("c", 1)):
        times = sorted(random.sample(range(-20_000, 60_000), n))
        rows += [(key, t, random.choice([None, 1.0, 2.0, 5.0]), i) for i, t in enumerate(times)]
    rows += [("d", 5, 1.0, 0), ("d", 5, 2.0, 1), ("d", 5, None, 2), ("d", 4000, 3.0, 3)]
    return spark.createDataFrame(rows, "k string, us long, v double, n long").repartition(5)


def _rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


def _window():
    w = Window.partitionBy("k").orderBy("us", "n")
    return w, w.rowsBetween(Window.unboundedPreceding, 0)


CASES = {
    "lag": (lambda s: s.lag(p="v", q="us"), lambda w, up: {"p": F.lag("v").over(w), "q": F.lag("us").over(w)}),
    "lead": (lambda s: s.lead(p="v", q="us"), lambda w, up: {"p": F.lead("v").over(w), "q": F.lead("us").over(w)}),
    "running": (lambda s: s.running(t=F.col("v"), m=F.lit(1)), lambda w, up: {"t": F.sum(F.coalesce("v", F.lit(0.0))).over(up), "m": F.count("*").over(up)}),
    "last": (lambda s: s.last(x="v"), lambda w, up: {"x": F.last("v", ignorenulls=True).over(up)}),
    "before": (lambda s: s.last(before=True, x="v"), lambda w, up: {"x": F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))}),
    "extreme": (lambda s: s.extreme(x=F.col("v")), lambda w, up: {"x": F.max("v").over(up)}),
}


@pytest.mark.parametrize("width", [1, 700, 10_000_000])
@pytest.mark.parametrize("name", CASES)
def test_steps(series, name, width):
    step, expected = CASES[name][0], CASES[name][1](*_window())
    found = step(Scan(series, ["k"], "us", width, ["n"])).frame()
    assert _rows(found.select("k", "n", *expected)) == _rows(series.withColumns(expected).select("k", "n", *expected))


@pytest.mark.parametrize("width", [1, 500, 10_000_000])
def test_runs(series, width):
    far, up = F.col("us") - F.col("p") > 60, F.col("v") > F.col("q")
    found = Scan(series, ["k"], "us", width, ["n"]).runs({"p": "us", "q": "v"}, segment=far, rises=up).frame()
    w, past = _window()
    lagged = series.withColumns({"p": F.lag("us").over(w), "q": F.lag("v").over(w)})
    expected = lagged.withColumns({"segment": F.sum(F.when(far, 1).otherwise(0)).over(past), "rises": F.sum(F.when(up, 1).otherwise(0)).over(past)})
    assert found.columns == [*series.columns, "p", "q", "segment", "rises"]
    assert _rows(found.select(*expected.columns)) == _rows(expected)


def test_one_key_is_many_tasks(spark):
    one = spark.range(20_000).selectExpr("'a' AS k", "id * 1000 AS us", "CAST(id AS double) AS v")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = Scan(one, ["k"], "us", 100_000).lag(p="v").running(t=F.lit(1)).frame()
        sizes = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("t"), F.sum("p")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert sum(sizes) == 20_000 and len(sizes) == 16 and max(sizes) < 4000


def test_empty(series):
    assert Scan(series.limit(0), ["k"]).lag(p="v").running(t=F.col("v")).last(x="v").runs({"y": "v"}, z=F.col("y") > 0).frame().collect() == []
