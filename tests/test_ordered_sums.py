"""Means that do not depend on how the rows are dealt out, and figures beside a rounding border."""

import duckdb
from pyspark.sql import functions as F

from driftlake.operators import comparison
from driftlake.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


def test_bias_is_summed_in_order(spark):
    d = [1e16, 1.0, -1e16, 1.0, 0.0, 0.0, 0.0, 0.0]  # in this order 1, in most others 0 or 2
    rows = [(1, k, 0.0, y) for k, y in enumerate(d)]
    for order in (rows, rows[::2] + rows[1::2], rows[1::2] + rows[::2], rows[::-1]):
        for parts in (1, 3):
            df = spark.createDataFrame(order, "series long, k long, x double, y double").coalesce(1).repartition(parts)
            assert comparison.bland_altman(df).first().bias == 1 / 8
    again = spark.createDataFrame([(1, 0, 0.0, 3.0)] * 8, "series long, k long, x double, y double")  # k need not be unique
    assert comparison.bland_altman(again).first().bias == 3.0


def test_bias_beside_a_rounding_border(spark):
    """The mean of part 1534 is 710.0615 in decimals; its doubles, summed in order, stay below it."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    want = dict(con.sql(f"SELECT series, bias FROM ({ORACLE_SQL['compare_methods']}) WHERE method = 'bland_altman'").fetchall())
    got = {r.series: r.bias for r in QUERIES["compare_methods"](spark, SF).where(F.col("method") == "bland_altman").collect()}
    assert got == want and got[1534] == 710.061


def test_figures_beside_a_rounding_border(spark):
    """On sf0.1 figures of parts 17057 and 17667 are one bit below a border, and their products with a power of ten on it."""
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet'")
    want = con.sql(f"SELECT * FROM ({ORACLE_SQL['compare_methods']}) WHERE series IN (17057, 17667) ORDER BY ALL").fetchall()
    got = QUERIES["compare_methods"](spark, sf).where("series IN (17057, 17667)").collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == want
