"""SQLite tables as a batch source: read-only, in partitions by row id, with conditions that SQLite itself applies.

    spark.dataSource.register(SqliteTable)
    spark.read.format("sqlite_table").option("path", "/state/proxy.db").option("table", "requests").load()

Conditions are part of the read (`only`, or the option of that name), not taken from later filters: filters that Spark
hands to a Python source stay with it and would hold for every other query of the same frame.

The file must be on a path that driver and executors mount. It is opened read-only in every task; nothing is locked and
nothing is written beside it. Each partition is a range of row ids, so a table without them (WITHOUT ROWID) is one.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

ROWS = 10_000
#: What a condition (column, sign, value) may say.
SIGNS = ("=", ">", ">=", "<", "<=", "in", "is null", "is not null")


def _open(path: str) -> sqlite3.Connection:
    from urllib.parse import quote

    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def _name(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def spark_type(declared: str) -> str:
    """The type of a column by SQLite's own rules of affinity."""
    d = declared.upper()
    if "INT" in d:
        return "bigint"
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return "string"
    if "BLOB" in d or not d:
        return "binary" if "BLOB" in d else "string"
    return "double"


class Rows(InputPartition):
    def __init__(self, first: int | None, end: int | None):
        self.first, self.end = first, end


def _condition(column: str, sign: str, value=None) -> tuple[str, list]:
    """SQL of a condition, and the values that are bound to it."""
    if sign not in SIGNS:
        raise ValueError(f"a condition has one of {SIGNS}, not {sign}")
    if sign.startswith("is"):
        return f"{_name(column)} {sign}", []
    values = list(value) if sign == "in" else [value]
    return f"{_name(column)} {sign} " + (f"({', '.join('?' * len(values))})" if sign == "in" else "?"), values


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.fields = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        self.path, self.table = options["path"], options["table"]
        self.parts = max(1, int(options.get("partitions", 8)))
        self.where = [_condition(*c) for c in json.loads(options.get("only", "[]"))]

    def partitions(self) -> list[InputPartition]:
        with _open(self.path) as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
            except sqlite3.OperationalError:  # WITHOUT ROWID, or a view
                return [Rows(None, None)]
        if low is None:
            return [Rows(0, 0)]
        step = max(1, -(-(high + 1 - low) // self.parts))
        return [Rows(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        where, values = [c for c, _ in self.where], [v for _, vs in self.where for v in vs]
        if partition.first is not None:
            where, values = [*where, "rowid >= ? AND rowid < ?"], [*values, partition.first, partition.end]
        columns = ", ".join(_name(name) for name, _ in self.fields)
        kinds = {"bigint": (pa.int64(), int), "string": (pa.string(), str), "double": (pa.float64(), float), "binary": (pa.binary(), bytes)}
        with _open(self.path) as db:
            db.text_factory = lambda b: b.decode("utf-8", "replace")
            cursor = db.execute(f"SELECT {columns} FROM {_name(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else ""), values)
            while rows := cursor.fetchmany(ROWS):
                # SQLite columns hold values of any type: one that is not of the column's type counts as absent, a whole number as a double.
                arrays = []
                for i, (_, kind) in enumerate(self.fields):
                    arrow, cls = kinds[kind]
                    arrays.append(pa.array([x if isinstance(x, cls) else float(x) if cls is float and isinstance(x, int) else None for x in (r[i] for r in rows)], arrow))
                yield pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in self.fields])


class SqliteTable(DataSource):
    """A table of a SQLite file; options path, table and partitions."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        with _open(self.options["path"]) as db:
            found = db.execute(f"PRAGMA table_info({_name(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']} in {self.options['path']}")
        return ", ".join(f"`{name}` {spark_type(declared)}" for _, name, declared, *_ in found)

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, self.options)


def read_sqlite(spark: SparkSession, path: str, table: str, only: Sequence[tuple] = (), partitions: int = 8) -> DataFrame:
    """A table of a SQLite file, of it the rows that fulfil all conditions (column, sign, value)."""
    spark.dataSource.register(SqliteTable)
    return spark.read.format("sqlite_table").option("path", path).option("table", table).option("only", json.dumps(list(only))).option("partitions", partitions).load()


def proxy_log(spark: SparkSession, path: str, table: str = "requests") -> DataFrame:
    """(request_id, provider, source) of a proxy's log, for attribution: what other sources and placeholder providers say is left out."""
    log = read_sqlite(spark, path, table, [("source", "=", "proxy"), ("request_id", ">", "")])
    return log.where(~F.col("provider").startswith("_")).select("request_id", "provider", "source")
