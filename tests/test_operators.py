"""Operators against literal vectors, folds and brute force."""

import hashlib
import hmac
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlark.operators import attribution, collectors, dedup, ordered, windows
from meterlark.sources import logs, payloads, tail, wire

MINUTE = 60_000_000


def test_calibration_recovers_the_model(spark):
    rng = random.Random(12)
    limit, weights = 5_810_000, {"a": 3.1, "b": 1.8, "c": 1.0}
    rows = []
    for i in range(60):
        tokens = {m: rng.randint(0, 200_000) for m in weights}
        rows.append(("p", i, sum(weights[m] * t for m, t in tokens.items()) / limit * 100 + rng.uniform(-0.01, 0.01), tokens, i % 20 != 19))
    observed = spark.createDataFrame(rows, "profile_id string, start_us long, delta_pct double, tokens_by_model map<string,long>, single_machine boolean")
    row = attribution.calibration(observed).first()
    clean = [(t, d) for _, _, d, t, one in rows if one]
    by_hand = attribution.calibrate(clean)
    assert row["observations"] == 57 and row["base"] == by_hand["base"]
    assert abs(row["limit_tokens"] - by_hand["limit"]) < 1 and abs(row["residual"] - by_hand["residual"]) < 1e-4 and row["residual"] < 0.05
    base = by_hand["base"]
    for m, w in weights.items():
        assert abs(by_hand["weights"][m] - w / weights[base]) < 0.05
    # Brute force: the best of all sets of models held at zero.
    a, b = np.array([[t.get(m, 0) for m in sorted(weights)] for t, _ in clean], float), np.array([d / 100 for _, d in clean])
    best = None
    for free in itertools.chain.from_iterable(itertools.combinations(range(3), k) for k in range(1, 4)):
        x = np.zeros(3)
        x[list(free)] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
        if (x >= 0).all() and (best is None or np.linalg.norm(a @ x - b) < best):
            best = np.linalg.norm(a @ x - b)
    assert abs(by_hand["residual"] - best / np.linalg.norm(b)) < 1e-5
    assert attribution.calibration(observed.limit(20)).first()["base"] is None


def test_isotonic():
    assert [round(x, 6) for x in attribution.isotonic([0.12, 0.15, 0.24, 0.18, 0.27])] == [0.12, 0.15, 0.21, 0.21, 0.27]


def test_asof_over_buckets_equals_a_scan(spark):
    rng = random.Random(3)
    right = [(k, rng.randrange(0, 400), rng.choice([None, "x", "y", "z"])) for k in "ab" for _ in range(30)]
    left = [(k, i, rng.randrange(-20, 450)) for k in "abc" for i in range(60)]
    found = ordered.asof_backward(spark.createDataFrame(left, "k string, i long, us long"), spark.createDataFrame(right, "k string, us long, v string").groupBy("k", "us").agg(F.min("v").alias("v")), ["k"], "us", "v", bucket_us=50)
    best = {}
    for k, us, v in right:
        if v is not None:
            best[k, us] = min(v, best.get((k, us), "~"))
    for r in found.collect():
        earlier = [(us, v) for (k, us), v in best.items() if k == r["k"] and us <= r["us"]]
        assert r["v"] == (max(earlier)[1] if earlier else None)


def test_increase_rules(spark):
    """Shares 97, 96, 96, 95 of code on weekly 4, 4, 5, 6: a rise needs the week's start to be seen."""
    series = spark.createDataFrame([("p", i * 60 * MINUTE, 0, -(10**12), v) for i, v in enumerate((0.12, 0.16, 0.20, 0.30))], "profile_id string, us long, run long, week_start_us long, value double")
    spans = spark.createDataFrame([("p", 0, 120 * MINUTE), ("p", 60 * MINUTE, 180 * MINUTE), ("p", -5 * MINUTE, 60 * MINUTE), ("p", 50, 50)], "profile_id string, from_us long, to_us long")
    found = {(r["from_us"], r["to_us"]): round(r["increase"], 6) for r in windows.increase_between(spans, series).collect()}
    assert found == {(0, 120 * MINUTE): 0.08, (60 * MINUTE, 180 * MINUTE): 0.14, (-5 * MINUTE, 60 * MINUTE): 0.04, (50, 50): 0.0}
    began = series.withColumn("week_start_us", F.lit(-MINUTE))
    assert round(windows.increase_between(spans.where("from_us < 0"), began).first()["increase"], 6) == 0.16


def test_fused_share_and_median(spark):
    row = spark.range(1).select(windows.fused_other(F.lit(2.0), F.lit(5.0), F.lit(1.0), F.lit(3.4), F.lit(20.0)).alias("a"), windows.fused_other(F.lit(2.0), F.lit(5.0), F.lit(0.0), F.lit(None).cast("double"), F.lit(20.0)).alias("b"), windows.fused_other(F.lit(9.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(4.0)).alias("c")).first()
    assert (round(row["a"], 6), row["b"], row["c"]) == (4.6, 2.0, 4.0)
    values = spark.createDataFrame([("p", i, float(v)) for i, v in enumerate((1000, 40, 10, 20, 30, 50, 60, 70, 80))], "profile_id string, end_us long, v double")
    assert windows.median_of_latest(values, ["profile_id"], "end_us", "v").first()["usd"] == 45.0


def test_curve_ends_at_the_projection(spark):
    one = spark.createDataFrame([("p", "five_hour", 100 * MINUTE, 40.0, 50.0, 130.0, 150.0)], "profile_id string, window_kind string, resets_us long, last_pct double, lo double, mid double, hi double")
    points = windows.projected_curve(one, 0, 11).orderBy("point").collect()
    assert points[0]["mid"] == 40.0 and points[-1]["mid"] == 100.0 and points[-1]["lo"] == 50.0 and points[5]["mid"] == 85.0 and len(points) == 11
    flat = spark.createDataFrame([("p", d, 1.0) for d in range(7)], "profile_id string, weekday int, weight double")
    assert [r["mid"] for r in windows.projected_curve(one, 0, 11, flat).orderBy("point").collect()] == [r["mid"] for r in points]


def test_upsert_of_rows_without_request_ids(spark):
    fields = "event_id long, arrival long, message_id string, request_id string, session_id string, us long, model string, input_tokens long, output_tokens long, thinking_tokens long, cache_read_tokens long, cache_write_5m_tokens long, cache_write_1h_tokens long, output_final boolean, machine_id string"
    row = lambda i, arrival, request, out, final: (i, arrival, "m", request, "s", 1000, "claude", 1, out, 0, 0, 0, 0, final, f"pc{i}")
    feed = spark.createDataFrame([row(1, 0, "r", 5, None), row(2, 1, "r", 9, True), row(3, 2, "r", 9, None), row(4, 0, "", 7, None), row(5, 1, "", 7, True)], fields)
    found = {r["request_id"]: r for r in dedup.dedup_upsert(feed).collect()}
    assert (found["r"]["machine_id"], found["r"]["output_tokens"], found["r"]["output_final"], found["r"]["copies"]) == ("pc1", 9, True, 3)
    assert (found[""]["machine_id"], found[""]["output_final"], found[""]["copies"]) == ("pc4", None, 2)


def test_hmac_and_projects(spark):
    for key in (b"k", b"x" * 100):
        found = spark.createDataFrame([("proj-é",)], "p string").select(wire.hmac_sha256(key, F.col("p")).alias("h")).first()["h"]
        assert found == hmac.new(key, "proj-é".encode(), hashlib.sha256).hexdigest()


def test_transport_round_trip(spark):
    from meterlark.sources import raw

    events = raw.transport_events(spark, "/root/testdata/sf0.001")
    encoded = wire.encode_events(events)
    decoded = wire.decode_events(encoded.select(wire.json_line(encoded).alias("value"))).where("event IS NOT NULL").select("event.*")
    same = ["message_id", "us", "model", "output_tokens", "session_id", "project", "is_sidechain", "output_final"]
    assert sorted(map(str, decoded.select(*same).collect())) == sorted(map(str, events.select(*same).collect()))
    body = wire.batches(encoded, ["machine_id"], 100).first()
    assert body["idempotency_key"] == hashlib.sha256(body["body"].encode()).hexdigest()[:32] and body["body"].count("\n") <= 100


def test_payload_vectors(spark):
    old = {"five_hour": {"utilization": 1, "resets_at": "2026-09-21T10:00:00Z"}, "seven_day": {"utilization_pct": 80.5}, "extra_usage": {"is_enabled": True}}
    new = {"five_hour": {"utilization": 7}, "limits": [{"kind": "session", "percent": 0}, {"kind": "weekly_all", "percent": 80}, {"kind": "weekly_scoped", "percent": 98, "scope": {"model": {"display_name": "Fable"}}}]}
    found = payloads.quota_windows(spark.createDataFrame([(1, json.dumps(old)), (2, json.dumps(new)), (3, "[]"), (4, None)], "id long, raw string"))
    assert sorted((r["id"], r["window_kind"], r["pct"]) for r in found.collect()) == [(1, "five_hour", 1.0), (1, "seven_day", 80.5), (2, "five_hour", 0.0), (2, "seven_day", 80.0), (2, "seven_day_fable", 98.0)]


def test_log_vectors(spark):
    usage = {"input_tokens": 2, "output_tokens": 726, "cache_read_input_tokens": 38256, "cache_creation_input_tokens": 31626, "cache_creation": {"ephemeral_5m_input_tokens": 0, "ephemeral_1h_input_tokens": 31626}, "output_tokens_details": {"thinking_tokens": 295}, "service_tier": "standard"}
    line = {"type": "assistant", "timestamp": "2026-09-21T10:00:00.123Z", "requestId": "r", "sessionId": "s", "message": {"id": "m", "model": "claude-x", "usage": usage}}
    without = {**line, "message": {**line["message"], "usage": {k: v for k, v in usage.items() if k != "cache_creation"}}}
    lines = spark.createDataFrame([("/x/projects/my-proj/a.jsonl", i, json.dumps(x) if x else "{") for i, x in enumerate((line, without, None))], "path string, pos long, value string")
    parsed = logs.parse_requests(lines).orderBy("pos").collect()
    a, b, c = (r["event"] for r in parsed)
    assert (a["cache_write_5m_tokens"], a["cache_write_1h_tokens"], a["project"], a["output_final"], a["thinking_tokens"]) == (0, 31626, "my-proj", False, 295)
    assert b["cache_write_5m_tokens"] == 31626 and parsed[1]["warnings"] == ["missing-cache-breakdown"] and c is None
    assert a["semantic_id"] == hashlib.sha256(b"s|1789984800123|claude-x|2|726|38256|0|31626").hexdigest()[:32]


def test_discovery_skips_missing_roots(spark, tmp_path):
    (tmp_path / "a/deep").mkdir(parents=True)
    (tmp_path / "a/deep/x.jsonl").write_text("one\r\ntwo\n\nthree")
    (tmp_path / "a/skip.txt").write_text("no")
    (tmp_path / "single.jsonl").write_text("four\n")
    found = logs.read_lines(spark, [str(tmp_path / "a"), str(tmp_path / "single.jsonl"), str(tmp_path / "missing")])
    assert [r["value"] for r in logs.number_lines(found).orderBy("path", "ordinal").collect()] == ["one", "two", "", "three", "four"]
    assert logs.read_lines(spark, [str(tmp_path / "missing")]).count() == 0


def test_tail_reads_whole_lines_once(spark, tmp_path):
    spark.dataSource.register(tail.LineTail)
    log, out = tmp_path / "in", tmp_path / "out"
    log.mkdir()

    def run():
        stream = spark.readStream.format("line_tail").option("path", str(log)).load()
        query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).start()
        query.processAllAvailable()
        query.stop()
        return sorted(r["value"] for r in spark.read.parquet(str(out)).collect())

    (log / "a.jsonl").write_text("one\ntwo\nhalf")
    assert run() == ["one", "two"]
    with open(log / "a.jsonl", "a") as f:
        f.write(" done\r\nthree\n")
    (log / "b.jsonl").write_text("first\n")
    assert run() == ["first", "half done", "one", "three", "two"]
    (log / "b.jsonl").write_text("x\n")  # shorter: read from the start
    assert run() == ["first", "half done", "one", "three", "two", "x"]


@pytest.mark.parametrize("zone, hours", [("America/New_York", 23), ("Asia/Shanghai", 24)])
def test_local_day_lengths(spark, zone, hours):
    start, end, weekday = collectors.local_day(F.lit(1772989200000000), zone)  # 2026-03-08 17:00 UTC, a Sunday
    row = spark.range(1).select(((end - start) / 3_600_000_000).alias("h"), weekday.alias("w")).first()
    assert row["h"] == hours and row["w"] == (0 if zone.startswith("A") and hours == 23 else 1)
