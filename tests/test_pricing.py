"""Price files of both formats, and a stream whose catalog changes under it."""

import copy
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlark.functions.pricing import EXAMPLE, catalog_table, read_price_file, with_cost
from meterlark.operators.attribution import isotonic, isotonic_fit
from meterlark.sources import synthetic
from meterlark.streaming.pricing import PriceBook, changed_models, checked_catalog, price_stream

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


def _file(catalog, **more):
    flat = {name: {**e["rates"], "tiers": e.get("tiers", []), "aliases": e.get("aliases", [])} for name, e in catalog.items()}
    return json.dumps({"version": "v", "models": flat} | more)


def test_both_formats():
    text = json.dumps({"_note": 1, "$x": 2, "version": "7", "old": {"inputPerMTok": 1, "outputPerMTok": 2, "cacheReadPerMTok": 0, "cacheWrite5mPerMTok": 3, "cacheWrite1hPerMTok": 4},
                       "new": {"input": 8, "output": 40, "cache_write": 5, "_why": "x", "source": "s", "aliases": [" gate "], "tiers": [{"prompt_over": 300, "rates": {"input": 9}}, {"prompt_over": 200, "multiply": {"output": 1.5}}]}})
    catalog, errors = read_price_file(text)
    assert errors == [] and list(catalog) == ["old", "new"]
    assert catalog["old"]["rates"] == {"input": 1.0, "output": 2.0, "cache_read": 0.0, "cache_write_5m": 3.0, "cache_write_1h": 4.0}
    assert [t["prompt_over"] for t in catalog["new"]["tiers"]] == [200, 300] and catalog["new"]["aliases"] == ["gate"] and catalog["new"]["rates"]["cache_write"] == 5.0


@pytest.mark.parametrize("entry, why", [
    (5, "must be an object"), ({"inputPerMTok": 1}, "outputPerMTok must be a non-negative number"), ({"input": 1}, "input and output are required"), ({"input": -1, "output": 1}, "input: must be a non-negative number"),
    ({"input": True, "output": 1}, "must be a non-negative number"), ({"input": 1, "output": 1, "inptu": 2}, 'unknown rate "inptu"'), ({"input": 1, "output": 1, "tiers": {}}, "tiers: must be an array"),
    ({"input": 1, "output": 1, "tiers": [{"prompt_over": 0, "rates": {"input": 1}}]}, "positive integer"), ({"input": 1, "output": 1, "tiers": [{"prompt_over": 5}]}, "needs rates or multiply"),
    ({"input": 1, "output": 1, "tiers": [{"prompt_over": 5, "multiply": {"input": 0}}]}, "must be a positive number"), ({"input": 1, "output": 1, "tiers": [{"prompt_over": 5, "rate": {}}]}, 'unknown field "rate"'),
    ({"input": 1, "output": 1, "tiers": [{"prompt_over": 5, "rates": {"input": 1}}] * 2}, "duplicate prompt_over"), ({"input": 1, "output": 1, "aliases": [""]}, "aliases"),
])
def test_bad_entries_go_alone(entry, why):
    catalog, errors = read_price_file(json.dumps({"models": {"bad": entry, "good": {"input": 1, "output": 2}}}))
    assert list(catalog) == ["good"] and len(errors) == 1 and why in errors[0]


def test_files_that_are_none():
    for text in ("", "[1]", "{", "[" * 100_000):
        assert read_price_file(text)[0] == {} and read_price_file(text)[1]
    assert checked_catalog(None)[0] is None and checked_catalog('{"models": {"a": {"input": 1}, "b": {"input": 1, "output": 2}}}')[0] is None


def test_a_stream_follows_its_catalog(spark, tmp_path):
    feed = synthetic.usage(spark, SF)
    path = tmp_path / "prices.json"
    dearer = copy.deepcopy(EXAMPLE)
    dearer["claude-opus-5"]["rates"]["output"] = 50.0
    # At each batch: the file then, and the catalog that counts.
    steps = [(_file(EXAMPLE), EXAMPLE), (_file(dearer), dearer), ('{"models": {"claude-opus-5": {"input": "x"}}}', dearer), (_file(EXAMPLE), EXAMPLE)]
    for batch, (text, counts) in enumerate(steps):
        path.write_text(text)
        feed.where(F.col("event_id") % 4 == batch).coalesce(1).write.parquet(str(tmp_path / f"in/part{batch}"))
        source = spark.readStream.schema(feed.schema).parquet(str(tmp_path / "in/*"))
        price_stream(source, str(path), str(tmp_path / "book"), str(tmp_path / "cp")).awaitTermination(180)
        book = PriceBook(spark, str(tmp_path / "book"))
        expected = with_cost(feed.where(F.col("event_id") % 4 <= batch), catalog_table(spark, counts))
        assert _rows(book.priced().select("event_id", "cost_usd")) == _rows(expected.select("event_id", "cost_usd"))
    told = book.catalogs.read().orderBy("epoch").collect()
    assert [r["accepted"] for r in told] == [True, True, False, True] and told[2]["errors"]
    # The second batch priced its own rows and those of the changed model again, no others.
    second = spark.read.parquet(str(tmp_path / "book/costs/data/*")).where("epoch = 1")
    assert second.where("event_id % 4 <> 1").select("model").distinct().collect()[0][0] == "claude-opus-5" and second.where("event_id % 4 = 0 AND model <> 'claude-opus-5'").count() == 0
    assert changed_models(EXAMPLE, dearer) == {"claude-opus-5"}


@pytest.mark.parametrize("width", [1, 7, 50, 10_000])
def test_isotonic_from_hulls_of_buckets(spark, width):
    rng = np.random.default_rng(width)
    series = {"up": np.arange(40.0), "down": np.arange(40.0)[::-1], "flat": np.full(30, 3.0), "one": np.array([5.0]), "noise": np.cumsum(rng.normal(0.05, 1, 200)), "steps": np.repeat(rng.integers(0, 9, 20), 10).astype(float)}
    rows = [(k, i * 3, float(v), "x") for k, values in series.items() for i, v in enumerate(values)]
    found = isotonic_fit(spark.createDataFrame(rows, "k string, us long, v double, other string").repartition(3), ["k"], "v", width).orderBy("us").collect()
    for k, values in series.items():
        assert [r["fitted"] for r in found if r["k"] == k] == pytest.approx(isotonic(values.tolist()), abs=1e-9)
