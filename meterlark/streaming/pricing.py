"""Prices in a stream: a catalog that is read anew for each batch, and costs that follow it when it changes.

The catalog file is read by the driver at the start of every micro-batch. A file that cannot be read, or that has any
error, is refused whole: the catalog before it stays in force, and what was wrong is kept beside the costs. When a
catalog is accepted that differs, only rows of models whose entry changed are priced again.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from meterlark.functions.pricing import catalog_table, merge_layers, read_price_file, validate, version_of, with_cost
from meterlark.functions.scalars import normalized_model
from meterlark.sources.store import Store
from meterlark.streaming.pipelines import _started

#: A row of the cost store: the key of a request, what it cost, and at which version that was found.
COST = ("event_id", "model", "cost_usd", "price_version", "epoch")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file that any Hadoop file system can reach, None if it is not there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def checked_catalog(text: str | None) -> tuple[dict | None, list[str]]:
    """(catalog, errors): None with any error, since half a catalog prices some requests by guess."""
    if text is None:
        return None, ["no price file"]
    catalog, errors = read_price_file(text)
    errors += [f'model "{name}": {e}' for name, entry in catalog.items() for e in validate(entry)]
    if not catalog and not errors:
        errors = ["no model has a price"]
    return (None, errors) if errors else (catalog, [])


def changed_models(before: dict | None, after: dict) -> set[str]:
    """Names, aliases among them, that the two catalogs price differently."""
    a, b = merge_layers([before or {}]), merge_layers([after])
    price = lambda c, name: json.dumps([c[name]["rates"], c[name].get("tiers", [])], sort_keys=True) if name in c else None
    return {name for name in {*a, *b} if price(a, name) != price(b, name)}


def merge_costs(rows: DataFrame, whole: bool) -> DataFrame:
    """The newest cost of each request."""
    rest = [c for c in rows.columns if c != "event_id"]
    return rows.groupBy("event_id").agg(F.max_by(F.struct(*rest), "epoch").alias("r")).select("event_id", "r.*").select(*rows.columns)


class PriceBook:
    """The catalog in force under a folder, with the requests it has priced."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.catalogs = Store(spark, f"{self.folder}/catalogs", lambda rows, whole: rows)
        self.costs = Store(spark, f"{self.folder}/costs", merge_costs)
        self.usage = Store(spark, f"{self.folder}/usage", lambda rows, whole: rows)

    def in_force(self, before: int = 1 << 62) -> dict | None:
        """The newest accepted catalog of the epochs before one."""
        rows = self.catalogs.read()
        newest = None if rows is None else rows.where(F.col("accepted") & (F.col("epoch") < before)).orderBy(F.desc("epoch")).select("catalog").first()
        return json.loads(newest[0]) if newest else None

    def take(self, catalog_path: str, epoch: int) -> tuple[dict | None, set[str]]:
        """(catalog in force, names that changed with it) once the file has been looked at for this batch.

        A batch that runs again takes what it found the first time, whatever the file says by then.
        """
        before = self.in_force(epoch)
        if epoch in self.catalogs.epochs():
            found = self.catalogs.read().where(F.col("epoch") == epoch).select("accepted", "catalog").first()
            catalog = json.loads(found["catalog"]) if found and found["accepted"] else None
        else:
            catalog, errors = checked_catalog(read_text(self.spark, catalog_path))
            told = (epoch, catalog is not None, json.dumps(catalog or before or {}), version_of(catalog or before or {}), errors)
            self.catalogs.append(self.spark.createDataFrame([told], "epoch long, accepted boolean, catalog string, version string, errors array<string>").coalesce(1), epoch)
        return (before, set()) if catalog is None else (catalog, changed_models(before, catalog))

    def apply(self, batch: DataFrame, catalog_path: str, epoch: int) -> None:
        """Price a batch of usage, and what is stored of models whose price changed."""
        catalog, changed = self.take(catalog_path, epoch)
        old = self.usage.read()
        again = None
        if old is not None and changed:
            names = [*changed]
            again = old.where(F.col("model").isin(names) | normalized_model().isin(names))
        rows = batch if again is None else batch.unionByName(again)
        if catalog:
            costed = with_cost(rows, catalog_table(self.spark, catalog)).select("event_id", "model", "cost_usd", "price_version")
        else:
            costed = rows.select("event_id", "model", F.lit(None).cast("decimal(20,9)").alias("cost_usd"), F.lit(None).cast("string").alias("price_version"))
        self.costs.append(costed.withColumn("epoch", F.lit(epoch).cast("long")).select(*COST), epoch)
        self.usage.append(batch, epoch)

    def priced(self) -> DataFrame:
        """The newest cost of every request."""
        return self.costs.read()


def price_stream(usage: DataFrame, catalog_path: str, folder: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Keep the costs of a stream of usage (a row for each request, event_id its key) by the catalog as it is at each batch."""
    return _started(usage.writeStream.foreachBatch(lambda batch, epoch: PriceBook(batch.sparkSession, folder).apply(batch, catalog_path, epoch)), checkpoint, interval)
