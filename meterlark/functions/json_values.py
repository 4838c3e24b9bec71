"""Typed reads of JSON text: one parse into a struct, where a value of another type counts as absent.

Numbers are declared as double (a number in quotes is none), objects as structs, and texts as variants, which
tell a string from what only looks like one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def read(text: Column, schema: str) -> Column:
    return F.from_json(text, schema)


def once(df: DataFrame) -> DataFrame:
    """df with its columns computed here, once for each row.

    A filter above a projection is pushed below it with a copy of every expression it reads; a parsed document that
    twenty fields are taken from would be parsed twenty times. Nothing is pushed through the rows of an array.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def entries(text: Column) -> Column:
    """The members of an object as a map of variants, null for anything else."""
    return F.from_json(text, "map<string,variant>")


def text(value: Column) -> Column:
    """The text of a variant that is a JSON string, else null."""
    return F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))


def full_text(value: Column) -> Column:
    """As text(), and null where it is empty."""
    return F.nullif(text(value), F.lit(""))


def number(value: Column) -> Column:
    """The number of a variant that is one, else null."""
    return F.when(F.schema_of_variant(value).rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"), value.cast("double"))


def boolean(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "BOOLEAN", value.cast("boolean"))


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def items(value: Column) -> Column:
    """The elements of a variant that is an array, else null."""
    return F.try_variant_get(value, "$", "array<variant>")


def count(value: Column) -> Column:
    """A count from a double: what is below zero or absent is 0."""
    return F.coalesce(F.when((value >= 0) & (value < 9.2e18), value), F.lit(0.0)).cast("long")


def moment_us(iso: Column) -> Column:
    """Microseconds of an ISO time, null where it is none."""
    return F.unix_micros(F.try_to_timestamp(iso))
