"""The store before, during and after merges; views kept by a stream against a full recomputation."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from meterlark.functions.pricing import EXAMPLE, catalog_table, with_cost
from meterlark.operators import dedup, ordered
from meterlark.operators import usage as u
from meterlark.sources import raw, synthetic
from meterlark.sources.store import Store, merge_sums, stored_records
from meterlark.streaming import views
from meterlark.streaming.pipelines import write_stream

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


def _records(spark, *rows):
    """Events of the transport format from (message, request, content, machine, output, final)."""
    full = raw.transport_events(spark, SF).limit(1).drop("event_id")
    given = spark.createDataFrame(rows, "message_id string, request_id string, semantic_id string, machine_id string, output_tokens long, output_final boolean").coalesce(1)
    rest = [c for c in full.columns if c not in given.columns]
    return given.crossJoin(full.select(*rest)).select(*full.columns)


BATCHES = [
    [("a", "r1", "s1", "m1", 5, False), ("b", "r2", "s2", "m1", 7, True), ("a", "r1", "s1", "m2", 5, False), ("x", "", "c1", "m1", 1, None)],
    [("a", "r1", "s1", "m3", 9, True), ("x", "", "c2", "m2", 2, None), ("y", "", "c2", "m3", 2, None)],
    [("b", "r2", "s2", "m4", 7, True), ("z", "", "c1", "m4", 1, None), ("c", "r3", "s3", "m1", 1, None)],
    [("a", "r1", "s1", "m5", 9, True), ("c", "r3", "s3", "m2", 1, False), ("y", "", "c9", "m5", 3, None)],
]


def _serial():
    """The same rows put into a table one by one."""
    table, messages, contents = {}, set(), set()
    for message, request, content, machine, output, final in itertools.chain(*BATCHES):
        rank = output * 3 + {True: 2, False: 1, None: 0}[final]
        if request == "":
            if message not in messages and content not in contents:
                messages.add(message)
                contents.add(content)
                table[message, request] = (machine, output, final, rank)
        elif (message, request) not in table:
            table[message, request] = (machine, output, final, rank)
        elif rank > table[message, request][3]:
            table[message, request] = (table[message, request][0], output, final, rank)
    return sorted((m, r, *map(str, v[:3])) for (m, r), v in table.items())


def _held(store):
    return _rows(stored_records(store).select("message_id", "request_id", "machine_id", "output_tokens", "output_final"))


def test_reads_are_the_same_before_and_after_merges(spark, tmp_path):
    for fan in (2, 3):
        store = Store(spark, str(tmp_path / f"store{fan}"))
        assert store.read() is None and store.epochs() == set()
        for epoch, rows in enumerate(BATCHES):
            assert store.append_records(_records(spark, *rows), epoch)
            assert not store.append_records(_records(spark, *rows), epoch)  # the batch runs again
        assert _held(store) == _serial() and len(store.version()[1]) == 4
        assert store.compact(fan) == {2: 3, 3: 1}[fan]
        assert _held(store) == _serial() and store.epochs() == {0, 1, 2, 3} and len(store.version()[1]) == {2: 1, 3: 2}[fan]
        assert store.vacuum() == {2: 6, 3: 3}[fan]
        assert _held(store) == _serial() and len(list((tmp_path / f"store{fan}" / "data").iterdir())) == len(store.version()[1])


def test_a_merge_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    for epoch, rows in enumerate(BATCHES):
        store.append_records(_records(spark, *rows), epoch)
    with monkeypatch.context() as m:
        m.setattr(Store, "_commit", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            store.compact_all()
    assert _held(store) == _serial() and len(store.version()[1]) == 4
    (tmp_path / "store/manifest/0000000099.json").write_text('{"parts": [')  # a writer that died at its manifest
    assert _held(store) == _serial()
    store.compact_all()
    assert store.version()[0] == 100 and _held(store) == _serial()
    assert store.vacuum() == 5  # four epochs and what the dead merge left


def test_two_writers(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.append_records(_records(spark, *BATCHES[0]), 0)
    base, parts = store.version()
    store.append_records(_records(spark, *BATCHES[1]), 1)
    with pytest.raises(RuntimeError):
        store._commit(base, parts)


def test_sums_drop_what_cancels_out(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), merge_sums(["k"], ["n"]))
    for epoch, rows in enumerate(([("a", 1), ("b", 2)], [("a", -1), ("c", 4)], [("b", 1)])):
        store.append(spark.createDataFrame(rows, "k string, n long"), epoch)
    assert _rows(store.read()) == [("b", "3"), ("c", "4")]
    store.compact(2)
    assert _rows(store.read()) == [("b", "3"), ("c", "4")]


def test_inserts_one_by_one(spark):
    random.seed(6)
    for n, values in ((60, 12), (200, 30), (40, 3)):
        rows = [(i, f"m{random.randrange(values)}", f"c{random.randrange(values)}") for i in range(n)]
        kept, seen = [], (set(), set())
        for i, m, c in rows:
            if m not in seen[0] and c not in seen[1]:
                kept.append(i)
                seen[0].add(m)
                seen[1].add(c)
        found = dedup.first_inserts(spark.createDataFrame(rows, "i long, m string, c string").repartition(3), ["m", "c"], ["i"])
        assert sorted(r["i"] for r in found.collect()) == kept


def test_hourly_view_follows_every_batch(spark, tmp_path):
    feed = with_cost(synthetic.usage_feed(spark, SF), catalog_table(spark, EXAMPLE)).select(*synthetic.usage_feed(spark, SF).columns, "cost_usd")
    # Repeats in batches of their own, before and after the rows that they repeat.
    place = F.when(F.col("event_id") % 3 == 0, F.col("arrival") * 2).otherwise(F.col("arrival") + 1)
    feed = feed.withColumn("arrival", place)
    view = views.hourly_store(spark, str(tmp_path / "view"))
    for batch in range(3):
        feed.where(F.col("arrival") == batch).coalesce(1).write.parquet(str(tmp_path / f"in/part{batch}"))
        source = spark.readStream.schema(feed.schema).parquet(str(tmp_path / "in/*"))
        views.maintain_hourly(source, str(tmp_path / "view"), str(tmp_path / "cp"), compact_every=2).awaitTermination(180)
        so_far = feed.where(F.col("arrival") <= batch)
        best = dedup.dedup_upsert(so_far)
        costed = with_cost(best.drop("cost_usd"), catalog_table(spark, EXAMPLE))
        assert _rows(views.hourly_view(view)) == _rows(u.hourly_view(costed))
    assert len(view.version()[1]) < 3


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_from_any_order_of_arrival(spark, tmp_path, seed):
    events = synthetic.usage(spark, SF).select("profile_id", F.col("ts").cast("timestamp").alias("ts"), "us").where("us < 1705000000000000")
    shuffled = events.withColumn("part", F.pmod(F.xxhash64("us", F.lit(seed)), F.lit(4)))
    for part in range(4):
        shuffled.where(F.col("part") == part).drop("part").coalesce(1).write.parquet(str(tmp_path / f"in/part{part}"))
        source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in/*"))
        write_stream(views.block_changes(source, late="60 days"), str(tmp_path / "out"), str(tmp_path / "cp"), "update").awaitTermination(180)
    changes = spark.read.parquet(str(tmp_path / "out")).drop("epoch")
    assert _rows(views.current_blocks(changes)) == _rows(ordered.blocks(events.withColumn("tokens", F.lit(0))))
    assert changes.where("change = 'delete'").count() > 0  # late events have split blocks anew


def test_blocks_become_final_in_order(spark, tmp_path):
    events = synthetic.usage(spark, SF).select("profile_id", F.col("ts").cast("timestamp").alias("ts"), "us").where("us < 1704700000000000")
    edges = [0, 1704300000000000, 1704500000000000, 1 << 62]
    for part in range(3):
        events.where((F.col("us") >= edges[part]) & (F.col("us") < edges[part + 1])).coalesce(1).write.parquet(str(tmp_path / f"in/part{part}"))
        source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in/*"))
        write_stream(views.block_changes(source, late="2 hours"), str(tmp_path / "out"), str(tmp_path / "cp"), "update").awaitTermination(180)
    changes = spark.read.parquet(str(tmp_path / "out")).drop("epoch")
    expected = set(_rows(ordered.blocks(events.withColumn("tokens", F.lit(0)))))
    assert set(_rows(views.current_blocks(changes))) == expected
    final = set(_rows(views.current_blocks(changes.where("change = 'final'"))))
    assert final < expected and len(final) > 20
    assert changes.groupBy("profile_id", "start_us").agg(F.count_if(F.col("change") == "final").alias("n")).where("n > 1").count() == 0
