"""What feeds cost: a line is parsed once, and no key is one task."""

import re

import pytest

from meterlark.plans import registry
from meterlark.sources import raw, wire

SF_DIR = "/root/testdata/sf0.001"


def _times(df, function: str) -> int:
    return len(re.findall(rf"\b{function}\(", df._jdf.queryExecution().optimizedPlan().toString()))


@pytest.mark.parametrize("name", ["wire_decode", "wire_ingest_counts", "log_requests", "log_warnings", "log_statistics"])
def test_each_line_is_parsed_once(spark, name):
    found = registry.queries()[name](spark, SF_DIR)
    # log_statistics reads its lines for two aggregates.
    assert _times(found, "from_json") == (2 if name == "log_statistics" else 1)


def test_each_window_of_a_payload_is_parsed_once(spark):
    # The response, its entries to see whether they are usable, and each entry.
    assert _times(registry.queries()["payload_windows"](spark, SF_DIR), "from_json") <= 3


def test_batches_are_numbered_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(wire, "RANGE_LINES", 50)
    lines = wire.encode_events(raw.transport_events(spark, SF_DIR))
    by_machine: dict[str, list[str]] = {}
    for machine, line in lines.select("machine_id", wire.json_line(lines)).collect():
        by_machine.setdefault(machine, []).append(line)
    expected = {(m, i // 7): "\n".join(sorted(all_)[i : i + 7]) + "\n" for m, all_ in by_machine.items() for i in range(0, len(all_), 7)}
    found = wire.batches(lines, ["machine_id"], rows=7)
    assert {(r["machine_id"], r["batch"]): r["body"] for r in found.collect()} == expected
    # A window by machine alone would sort all lines of one in one task.
    assert "_range" in found._jdf.queryExecution().optimizedPlan().toString()


def _orders(spark, rows, schema, run):
    """What run gives for the rows in several orders."""
    return [sorted(map(tuple, run(spark.createDataFrame(rows[k:] + rows[:k], schema)).collect())) for k in (0, 1, 2)]


def test_append_holds_each_key_once(spark):
    from meterlark.operators.dedup import append_new

    schema = "k string, us long, pct double"
    stored = spark.createDataFrame([("a", 1, 5.0), ("a", 1, 3.0)], schema)
    found = append_new(stored, spark.createDataFrame([("a", 1, 1.0), ("b", 2, 9.0), ("b", 2, 8.0)], schema), ["k", "us"])
    assert sorted(map(tuple, found.collect())) == [("a", 1, 3.0), ("b", 2, 8.0)]


def test_equal_moments_give_one_limit_ratio(spark):
    from meterlark.operators.attribution import limit_ratio

    rows = [("p", 1, 3.0), ("p", 1, 0.0), ("p", 1, 6.0), ("p", 2, 9.0), ("p", 2, 0.0), ("p", 3, 12.0)]
    found = _orders(spark, rows, "profile_id string, us long, pct double", lambda df: limit_ratio(df, df))
    assert found[0] == found[1] == found[2] == [("p", 6.0, 6.0, 1, 1.0)]


def test_equal_moments_are_read_from_low_to_high(spark):
    from meterlark.operators.ordered import cumulative_usage

    rows = [("p", 1, 6.0), ("p", 1, 0.0), ("p", 1, 3.0), ("p", 2, 9.0), ("p", 2, 0.0), ("p", 3, 4.0)]
    found = _orders(spark, rows, "k string, us long, pct double", lambda df: cumulative_usage(df, ["k"]))
    # 0 3 6 | 0 9 | 4
    assert found[0] == found[1] == found[2] == [("p", 19.0, 2, 2, 4.0)]


def test_many_small_runs_are_fitted_in_few_tasks(spark):
    from meterlark.operators.attribution import isotonic, isotonic_fit

    rows = [(i // 3, i, float(i * 7 % 5)) for i in range(600)]
    fit = isotonic_fit(spark.createDataFrame(rows, "k long, us long, v double"), ["k"], "v", 100)
    found = {r["us"]: r["fitted"] for r in fit.collect()}
    expected = [x for k in range(200) for x in isotonic([v for kk, _, v in rows if kk == k])]
    assert [round(found[i], 9) for i in range(600)] == [round(x, 9) for x in expected]


def test_append_keeps_first_arrivals(spark):
    from meterlark.operators.dedup import append_new

    schema = "k string, pct double, n long"
    found = append_new(spark.createDataFrame([("a", 1.0, 7), ("a", 5.0, 4)], schema), spark.createDataFrame([("a", 0.0, 1), ("b", 2.0, 9), ("b", 3.0, 8)], schema), ["k"], ["n"])
    assert found.columns == ["k", "pct", "n"] and sorted(map(tuple, found.collect())) == [("a", 5.0, 4), ("b", 3.0, 8)]
