"""Streams over files with availableNow, in several batches, against the same work in batch."""

import pytest
from pyspark.sql import functions as F

from meterlark.operators import dedup, ordered
from meterlark.operators import usage as u
from meterlark.sources import raw, synthetic, wire
from meterlark.sources.store import Store
from meterlark.streaming import pipelines as p

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


def _parts(df, path, n=3):
    for i in range(n):
        df.where(F.pmod(F.xxhash64(*[c for c in ("event_id", "us") if c in df.columns]), F.lit(n)) == i).coalesce(1).write.mode("append").parquet(f"{path}/part{i}")


def _stream(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_ingest_store_and_quarantine(spark, tmp_path):
    lines = raw.transport_lines(spark, SF)
    _parts(lines, str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        p.ingest(_stream(spark, lines, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination(180)
    decoded = wire.decode_events(lines)
    stored = p.stored_usage(spark, str(tmp_path / "store"))
    before = _rows(stored)
    assert _rows(stored.select("message_id", "request_id", "output_tokens", "us")) == _rows(decoded.where("event IS NOT NULL").select("event.message_id", "event.request_id", "event.output_tokens", "event.us"))
    assert spark.read.parquet(str(tmp_path / "store/quarantine")).count() == decoded.where("invalid").count() > 0
    records = Store(spark, str(tmp_path / "store"))
    assert records.epochs() == {0, 1, 2}
    records.compact_all()
    assert len(records.version()[1]) == 1 and _rows(p.stored_usage(spark, str(tmp_path / "store"))) == before


def test_guard_refuses_what_is_out_of_time(spark, tmp_path):
    lines = raw.transport_lines(spark, SF)
    _parts(lines, str(tmp_path / "in"), 1)
    times = [r["us"] for r in wire.accepted_events(lines.select("value")).select("us").collect()]
    since, now = sorted(times)[len(times) // 10], sorted(times)[-len(times) // 10]
    p.ingest(_stream(spark, lines, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "cp"), since_us=since, now_us=now - p.AHEAD_US).awaitTermination(180)
    reasons = {r["reason"]: r["count"] for r in spark.read.parquet(str(tmp_path / "store/quarantine")).groupBy("reason").count().collect()}
    assert reasons["future"] == sum(t > now for t in times) > 0 and reasons["before_start"] == sum(t < since for t in times) > 0
    assert p.stored_usage(spark, str(tmp_path / "store")).agg(F.min("us"), F.max("us")).first() == (since, now)


def test_stateful_dedup_ends_with_the_best(spark, tmp_path):
    feed = synthetic.usage_feed(spark, SF)
    _parts(feed, str(tmp_path / "in"))
    p.write_stream(p.best_records(_stream(spark, feed, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"), "update").awaitTermination(300)
    changes = spark.read.parquet(str(tmp_path / "out"))
    best = changes.groupBy("dedup_key").agg(F.max_by("output_tokens", "rank").alias("output_tokens"))
    assert _rows(best) == _rows(dedup.dedup_batch(feed).select("dedup_key", "output_tokens"))
    assert changes.where("change = 'insert'").count() == best.count()


def test_hourly_and_lanes(spark, tmp_path):
    usage = synthetic.usage(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    _parts(usage, str(tmp_path / "in"), 1)
    source = _stream(spark, usage, str(tmp_path / "in"))
    p.write_stream(p.hourly(source), str(tmp_path / "hours"), str(tmp_path / "c1"), "update").awaitTermination(300)
    expected = u.distribution_series(usage.withColumn("cost_usd", F.lit(None).cast("decimal(20,9)")), "model", "hour").groupBy("key").agg(F.sum("events"), F.sum("total_tokens"))
    assert _rows(spark.read.parquet(str(tmp_path / "hours")).groupBy("model").agg(F.sum("events"), F.sum("total_tokens"))) == _rows(expected)
    p.write_stream(p.session_lanes(source), str(tmp_path / "lanes"), str(tmp_path / "c2"), "append").awaitTermination(300)
    late = usage.agg(F.max("us")).first()[0] - 7 * 86_400_000_000
    lanes = ordered.lanes(usage.withColumn("tokens", F.lit(1)))
    closed = spark.read.parquet(str(tmp_path / "lanes"))
    found, all_of = set(_rows(closed)), set(_rows(lanes.select("machine_id", "from_us", "to_us", "events")))
    assert found <= all_of and {x for x in all_of if int(x[2]) < late - 3_600_000_000} <= found


def test_state_store_is_chosen_or_demanded(spark):
    frame, before = spark.range(1), spark.conf.get(p.PROVIDER, p.DEFAULT_PROVIDER)
    try:
        spark.conf.set(p.PROVIDER, p.DEFAULT_PROVIDER)
        p.stateful(frame)
        assert spark.conf.get(p.PROVIDER) == p.COLUMN_FAMILIES
        spark.conf.set(p.PROVIDER, "a.store.without.Families")
        with pytest.raises(ValueError, match="without.Families"):
            p.stateful(frame)
    finally:
        spark.conf.set(p.PROVIDER, before)


def test_changes(spark, tmp_path):
    samples = spark.createDataFrame([("a", i, "p0" if (i // 4) % 2 else "p1") for i in range(40)] + [("b", 1, None), ("b", 2, None), ("b", 3, "x")], "series string, us long, value string")
    for i, (a, b) in enumerate(((0, 9), (9, 23), (23, 99))):
        samples.where((F.col("us") >= a) & (F.col("us") < b)).coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
        source = spark.readStream.schema(samples.schema).parquet(str(tmp_path / "in/*"))
        p.write_stream(p.changes(source), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert _rows(spark.read.parquet(str(tmp_path / "out"))) == _rows(p.changes_batch(samples))


def test_window_updates_and_guard(spark, tmp_path):
    quota = synthetic.quota(spark, SF)
    _parts(quota, str(tmp_path / "in"), 1)
    recompute = lambda touched: dedup.latest_by(quota, ["profile_id", "window_kind"], "us").join(touched, ["profile_id", "window_kind"])
    p.window_updates(_stream(spark, quota, str(tmp_path / "in")), recompute, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    frames = [r["frame"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sum(f.startswith("event: window_update\ndata: {") for f in frames) == 4 and all(f.endswith("}\n\n") for f in frames)
    marked = spark.createDataFrame([(1,), (500,), (400_000_000,)], "us long").select(p.guarded(1000, since_us=10).alias("g")).collect()
    assert [r["g"] for r in marked] == ["before_start", None, "future"]
