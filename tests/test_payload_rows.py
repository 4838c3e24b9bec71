"""A payload is judged in its own row: an input whose rows come in another order each time it is read gives the same rows."""

import json

from meterlark.sources import payloads


def _restless(spark, answers):
    """(event_id, raw) of the answers, in an order that is new with every reading."""

    def shuffled(batches):
        import numpy as np
        import pandas as pd

        rows = pd.concat(list(batches))
        yield rows.iloc[np.random.default_rng().permutation(len(rows))]

    schema = "event_id long, raw string"
    return spark.createDataFrame([(i, json.dumps(a)) for i, a in enumerate(answers)], schema).coalesce(1).mapInPandas(shuffled, schema)


def test_client_windows_of_a_restless_feed(spark):
    good = {"rateLimitsByLimitId": {"codex": {"primary": {"usedPercent": 1}, "secondary": {"usedPercent": 2}}, "x y": {"primary": {"usedPercent": 3}}}}
    bad = {"rateLimitsByLimitId": {"codex": {"primary": {"usedPercent": 1}}, "x": {"secondary": {"windowDurationMins": 5}}}}
    found = payloads.ledger_windows_client(_restless(spark, [good if i % 2 else bad for i in range(200)]))
    rows = sorted((r["event_id"], r["window_id"], r["pct"]) for r in found.collect())
    assert rows == [(i, w, p) for i in range(1, 200, 2) for w, p in (("codex:primary", 1.0), ("codex:secondary", 2.0), ("x%20y:primary", 3.0))]


def test_web_windows_of_a_restless_feed(spark):
    window = lambda pct: {"primary_window": {"used_percent": pct, "limit_window_seconds": 61}}
    good = {"rate_limit": window(1), "additional_rate_limits": [{"metered_feature": "m", "limit_name": "M", "rate_limit": window(2)}, {"limit_name": "no id", "rate_limit": window(101)}, None]}
    bad = {"rate_limit": window(1), "additional_rate_limits": [{"metered_feature": "m", "rate_limit": window(101)}]}
    plain = {"rate_limit": window(4), "additional_rate_limits": 7}
    found = payloads.ledger_windows_web(_restless(spark, [(bad, good, plain)[i % 3] for i in range(200)]))
    rows = sorted((r["event_id"], r["window_id"], r["label"], r["pct"], r["minutes"]) for r in found.collect())
    expected = [[], [("codex:primary", None, 1.0, 2), ("m:primary", "M", 2.0, 2)], [("codex:primary", None, 4.0, 2)]]
    assert rows == [(i, *w) for i in range(200) for w in expected[i % 3]]


def test_organisations_of_a_restless_feed(spark):
    team, chat = {"uuid": "t", "capabilities": ["raven", 3]}, {"id": "c", "capabilities": ["chat"]}
    lists = [[chat], [chat, team], [team, team], [{"name": "none"}, 4], {"uuid": "x"}]
    found = payloads.organisations(_restless(spark, [lists[i % 5] for i in range(200)]))
    rows = sorted((r["event_id"], r["org_id"], r["capabilities"], r["unambiguous"]) for r in found.collect())
    expected = [[("c", ["chat"], True)], [("c", ["chat"], False), ("t", ["raven"], True)], [("t", ["raven"], False)] * 2, [], []]
    assert rows == [(i, *o) for i in range(200) for o in expected[i % 5]]
