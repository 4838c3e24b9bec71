"""The rollout state machine: literal vectors, and the same result in pieces, in batch and in a stream."""

import json

from pyspark.sql import functions as F

from meterlark.operators import rollout as r


def meta(**more):
    return {"type": "session_meta", "timestamp": "2026-09-01T10:00:00Z", "payload": {"id": "s1", "cwd": "/w", "model_provider": "p", **more}}


def turn(turn_id="t1", model="gpt-a", **more):
    return {"type": "turn_context", "payload": {"turn_id": turn_id, "model": model, **more}}


def usage(i, o, cached=0, **more):
    return {"input_tokens": i, "output_tokens": o, "cached_input_tokens": cached, "cache_write_input_tokens": 0, "reasoning_output_tokens": 0, "total_tokens": i + o, **more}


def count(total, last, at="2026-09-01T10:01:00Z"):
    return {"type": "event_msg", "timestamp": at, "payload": {"type": "token_count", "info": {"total_token_usage": total, "last_token_usage": last}}}


def record(response, use, at="2026-09-01T10:00:30Z", **more):
    return {"type": "token_usage_record", "timestamp": at, "payload": {"response_id": response, "usage": use, **more}}


SETTINGS = {"type": "event_msg", "payload": {"type": "thread_settings_applied", "thread_settings": {"service_tier": "priority"}}}


def feed(*docs):
    state, events, warnings, withheld = r.Rollout(), [], [], []
    for doc in docs:
        event, w, h = state.feed(doc if isinstance(doc, str) else json.dumps(doc))
        events += [event] if event else []
        warnings += w
        withheld += h
        state = r.Rollout.from_json(state.to_json())  # as between micro-batches
    return events, warnings, withheld


def test_only_the_last_usage_is_billed():
    events, _, withheld = feed(meta(), turn(), count(usage(100, 20), usage(100, 20)), count(usage(250, 50), usage(150, 30)), count(usage(250, 50), usage(150, 30)))
    assert [(e["input_tokens"], e["output_tokens"], e["total_tokens"]) for e in events] == [(100, 20, 120), (150, 30, 180)]
    assert withheld == [] and events[1]["flags"] == [] and events[0]["model"] == "gpt-a" and events[0]["project"] == "/w"


def test_growth_over_several_requests_is_a_gap():
    events, _, _ = feed(meta(), turn(), count(usage(100, 20), usage(100, 20)), count(usage(300, 60), usage(50, 10)))
    assert events[1]["input_tokens"] == 50 and events[1]["flags"] == ["last_usage_mismatch", "cumulative_gap"]


def test_missing_last_moves_the_baseline():
    events, _, withheld = feed(meta(), turn(), count(usage(100, 20), usage(100, 20)), count(usage(200, 40), None), count(usage(250, 50), usage(50, 10)))
    assert len(events) == 2 and events[1]["flags"] == ["cumulative_gap", "last_usage_unavailable"] and withheld == ["cumulative_gap", "last_usage_unavailable"]


def test_decrease_keeps_the_high_water_mark():
    events, _, withheld = feed(meta(), turn(), count(usage(100, 20), usage(100, 20)), count(usage(10, 2), usage(10, 2)), count(usage(130, 25), usage(30, 5)))
    assert [e["input_tokens"] for e in events] == [100, 30] and withheld == ["counter_decreased"] and events[1]["flags"] == ["counter_decreased"]


def test_detail_revision_is_no_usage():
    events, warnings, _ = feed(meta(), turn(), count(usage(100, 20), usage(100, 20)), count(usage(100, 20, cached=5), usage(100, 20)), count(usage(150, 30, cached=6), usage(50, 10, cached=1)))
    assert len(events) == 2 and "counter_detail_revision_ignored" in warnings and events[1]["flags"] == ["counter_detail_revision_ignored"]


def test_last_only_records_are_told_apart():
    events, _, withheld = feed(meta(), turn(), count(None, usage(10, 1)), count(None, usage(10, 1)), count(None, usage(10, 1), "2026-09-01T10:02:00Z"), count(usage(40, 4), usage(20, 2)))
    assert len(events) == 2 and withheld == ["cumulative_rebaseline_after_last_only"] and "last_usage_only" in events[0]["flags"]


def test_pending_records():
    claimed, _, _ = feed(meta(), turn(), record("a", usage(10, 1)), count(usage(10, 1), usage(10, 1)))
    assert len(claimed) == 1 and claimed[0]["flags"] == []
    alone, _, _ = feed(meta(), turn(), count(usage(5, 1), usage(5, 1)), record("a", usage(10, 1)), count(usage(5, 1), usage(5, 1)), record("b", usage(3, 1)), record("c", usage(4, 1)), {"type": "compacted"})
    assert [e["input_tokens"] for e in alone] == [5, 10, 3, 4]
    assert [e["flags"][-1:] for e in alone[1:]] == [["usage_record_without_token_count"], ["usage_record_without_token_count"], ["compaction_usage_from_record"]]
    unmatched, _, withheld = feed(meta(), turn(), record("a", usage(10, 1)), count(usage(7, 1), usage(7, 1)))
    assert unmatched[0]["flags"] == ["usage_record_unmatched", "cumulative_gap"] and withheld == ["usage_record_unmatched"]


def test_forks():
    inherited = feed(meta(forked_from_id="p", subagent_history_start_ordinal=3), turn(), count(usage(9, 9), usage(9, 9)), count(usage(9, 9), usage(9, 9)), turn("t2"), count(usage(12, 10), usage(3, 1)))
    assert [e["input_tokens"] for e in inherited[0]] == [3] and inherited[2] == ["fork_usage_before_own_context"] and inherited[0][0]["parent_session_id"] == "p"
    unknown = feed(meta(forked_from_id="p"), count(usage(9, 9), usage(9, 9)), SETTINGS, count(usage(9, 9), usage(9, 9)), turn("t2"), count(usage(12, 10), usage(12, 10)))
    assert unknown[2] == ["fork_history_usage_withheld", "fork_usage_before_own_context"]
    assert unknown[0][0]["flags"] == ["fork_boundary_inferred"] and unknown[0][0]["service_tier"] == "priority"
    assert "inherited_session_meta_ignored" in feed(meta(), meta(id="other"))[1]


def test_counters():
    missing = feed(meta(), turn(), count({"output_tokens": 1}, None))
    assert missing[2] == ["usage_counters_unavailable"] and "missing_required_counter" in missing[1]
    derived, _, _ = feed(meta(), turn(), count({"input_tokens": 5, "output_tokens": 1}, {"input_tokens": 5, "output_tokens": 1}))
    assert derived[0]["total_tokens"] == 6 and "cached_input_tokens_unreported" in derived[0]["flags"] and "total_tokens_derived" in derived[0]["flags"]
    assert feed(meta(), turn(), count(usage(-1, 1), None))[1][0] == "invalid_counter"
    odd, _, _ = feed(meta(), turn(), count(usage(5, 1, cached=9), usage(5, 1, cached=9)))
    assert "input_subsets_exceed_total" in odd[0]["flags"]
    assert feed("{x", "[1]", count(usage(1, 1), usage(1, 1)))[2] == ["invalid_json", "invalid_record", "usage_without_session"]


def test_zero_observation_hands_flags_on():
    events, _, _ = feed(meta(), turn(), count(usage(4, 1), usage(0, 0)), count(usage(6, 2), usage(2, 1)))
    assert len(events) == 1 and events[0]["flags"] == ["initial_cumulative_history_unattributed", "cumulative_gap"]


def test_lines_that_no_machine_can_read():
    whole = meta(), turn(), count(usage(4, 1), usage(4, 1))
    huge = json.dumps(count(usage(7, 1), usage(3, 0))).replace('"input_tokens": 7', '"input_tokens": 1e999')
    digits = huge.replace("1e999", "9" * 5000)
    for odd in (huge, digits):
        events, warnings, withheld = feed(*whole, odd, count(usage(9, 2), usage(2, 1)))
        assert len(events) == 2 and "invalid_counter" in warnings and withheld
    for odd in ("[" * 200_000, '{"a":' * 100_000):
        events, _, withheld = feed(*whole, odd, count(usage(6, 2), usage(2, 1)))
        assert [e["input_tokens"] for e in events] == [4, 2] and withheld == ["invalid_json"]
    for at, shown in (("0001-01-01T00:00:00+14:00", "0000-12-31T10:00:00.000Z"), ("9999-12-31T23:59:59.9999-14:00", "+010000-01-01T13:59:59.999Z")):
        events, warnings, _ = feed(*whole, count(usage(6, 2), usage(2, 1), at), count(usage(8, 3), usage(2, 1)))
        assert len(events) == 3 and r._iso(r._moment(at)) == shown and not warnings
    events, warnings, withheld = feed(*whole, count(usage(6, 2), usage(2, 1), "soon"), count(usage(8, 3), usage(2, 1)))
    assert len(events) == 2 and withheld == ["invalid_timestamp"] and withheld[0] in warnings
    assert r._moment("1969-12-31T23:59:59.999Z") == -1 and r._moment("2026-09-01T10:00:00.1239Z") == r._moment("2026-09-01T10:00:00.123Z")


LINES = [meta(), turn(), count(usage(100, 20), usage(100, 20)), "", "{bad", count(usage(250, 50), usage(150, 30)), record("a", usage(9, 1)), count(usage(250, 50), usage(150, 30)), count(usage(300, 60), None), count(usage(310, 61), usage(10, 1))]


def _frame(spark, lines, path="f"):
    return spark.createDataFrame([(path, i, x if isinstance(x, str) else json.dumps(x)) for i, x in lines], "path string, pos long, value string")


def test_batch_equals_the_machine(spark):
    lines = list(enumerate(LINES))
    both = _frame(spark, lines).unionByName(_frame(spark, lines[:6], "g")).repartition(3)
    found = r.parse_rollouts(both).collect()
    expected = feed(*LINES)
    mine = sorted((x for x in found if x["path"] == "f"), key=lambda x: x["ordinal"])
    assert [x["event_id"] for x in mine if x["event_id"]] == [e["event_id"] for e in expected[0]]
    assert [w for x in mine for w in x["warnings"]] == expected[1]
    events = r.rollout_events(r.parse_rollouts(both), since_us=0)
    assert events.where(F.array_contains("flags", "configured_account_history")).count() == len(expected[0]) + 2


def test_stream_equals_batch(spark, tmp_path):
    from meterlark.streaming.pipelines import stream_rollouts

    source, out = tmp_path / "in", tmp_path / "out"
    for part, (a, b) in enumerate(((0, 4), (4, 8), (8, 10))):
        _frame(spark, list(enumerate(LINES))[a:b]).coalesce(1).write.mode("append").json(str(source / f"part{part}"))
        feed_frame = spark.readStream.schema("path string, pos long, value string").json(str(source / "*"))
        stream_rollouts(feed_frame, str(out), str(tmp_path / "checkpoint")).awaitTermination(120)
    found = spark.read.parquet(str(out)).where("event_id IS NOT NULL").orderBy("ordinal").collect()
    assert [x["event_id"] for x in found] == [e["event_id"] for e in feed(*LINES)[0]]
