"""Tables in the folder that driver and executors share: lineage ends there, and a part that many steps read is made once."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER = "spark.checkpoint.dir"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; only a local session makes a folder of its own where none is set."""
    base = spark.conf.get(FOLDER, "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {FOLDER} to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), f"checkpoints-{spark.sparkContext.applicationId}")
        spark.conf.set(FOLDER, base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder; a lost executor costs nothing that is behind it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
