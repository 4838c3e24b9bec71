"""Texts of numbers that lie half-way between two."""

from pyspark.sql import functions as F

from meterlark.functions import presentation as p


def test_half_way_token_texts_are_rounded_as_doubles(spark):
    import duckdb

    numbers = [1_005_000_000, 4_355_000_000, *range(1_005_000_000, 3_000_000_000, 10_000_000), *range(1_050_000, 30_000_000, 100_000), *range(1_500, 9_000, 1_000)]
    found = {r["n"]: r["t"] for r in spark.createDataFrame([(n,) for n in numbers], "n long").select("n", p.tokens_text(F.col("n")).alias("t")).collect()}
    assert (found[1_005_000_000], found[4_355_000_000]) == ("1.00B", "4.36B")
    # The rule of the twin of `formats`.
    rule = "CASE WHEN n >= 1e9 THEN printf('%.2f', round(n / 1e9, 2)) || 'B' WHEN n >= 1e6 THEN printf('%.1f', round(n / 1e6, 1)) || 'M' ELSE CAST(floor(n / 1e3 + 0.5) AS BIGINT) || 'K' END"
    assert found == dict(duckdb.execute(f"SELECT n, {rule} FROM (SELECT unnest(?::BIGINT[]) AS n)", [numbers]).fetchall())
