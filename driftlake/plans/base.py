"""The given tables as measurement tables, and a registry of queries with their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.functions.columns import to_places

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, with the SQL that gives the same rows where there is one."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series for each event type."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("series"), F.col("event_id").alias("seq"), "ts", "value", "user_id")


def by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One short series for each user."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("series"), F.col("event_id").alias("seq"), "ts", "value")


def by_user_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' series with values missing here and times there."""
    e, at = by_user(spark, sf_dir), F.col("seq")
    return e.withColumn("ts", F.when(at % 29 != 3, F.col("ts"))).withColumn("value", F.when(at % 13 == 5, float("nan")).when(at % 13 != 7, F.col("value")))


def by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit prices by return flag and line status."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_linestatus", "l_returnflag", "l_quantity", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"))


#: The same tables in DuckDB's SQL.
T = "e AS (SELECT event_type AS series, event_id AS seq, ts, value, user_id FROM events)"
U = "e AS (SELECT user_id AS series, event_id AS seq, ts, value FROM events)"

_GAPS = "gaps AS (SELECT user_id AS series, event_id AS seq, CASE WHEN event_id % 29 <> 3 THEN ts END AS ts, CASE WHEN event_id % 13 NOT IN (5, 7) THEN value END AS value FROM events)"
#: With missing values and times: rows that have both, and rows that have a value with their places among all rows.
TIMED = f"{_GAPS}, e AS (SELECT * FROM gaps WHERE ts IS NOT NULL AND value IS NOT NULL)"
PLACED = f"{_GAPS}, h AS (SELECT series, seq, coalesce(ts, TIMESTAMP '0001-01-01') AS ts, value, row_number() OVER (PARTITION BY series ORDER BY ts NULLS FIRST, seq) AS place FROM gaps), e AS (SELECT * FROM h WHERE value IS NOT NULL)"


def r(c: str | object, places: int = 6):
    """To so many places as the SQL does, by the product with a power of ten: doubles beside a border go the same way."""
    return to_places(F.col(c) if isinstance(c, str) else c, places) + 0.0


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to so many places, so that the order of sums does not show."""
    return df.select(*(r(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


#: p of the Kolmogorov-Smirnov distance d of samples of n and m values.
_LAMBDA = "((sqrt(n * m / (n + m)) + 0.12::DOUBLE + 0.11::DOUBLE / sqrt(n * m / (n + m))) * d)"
KS_TAIL = f"(CASE WHEN {_LAMBDA} < 0.3 THEN 1 ELSE least(1, greatest(0, list_sum(list_transform(range(1, 21), lambda k: 2 * (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0::DOUBLE * k * k * {_LAMBDA} * {_LAMBDA}))))) END)"


def t_tail(t: str, df: str) -> str:
    """Both tails of Student's t in SQL: Simpson's rule over the angle whose tangent is t / sqrt(df)."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    weight = "CASE WHEN k = 0 OR k = 400 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    total = f"list_sum(list_transform(range(0, 401), lambda k: ({weight}) * pow(cos({angle} * k / 400.0::DOUBLE), ({df}) - 1)))"
    return f"(1 - 2 * exp(lgamma((({df}) + 1) / 2) - lgamma(({df}) / 2)) / sqrt(pi()) * {angle} / 1200.0::DOUBLE * {total})"


def chi2_tail(x: str, df: str) -> str:
    """The upper tail of chi-square in SQL, by the series of the lower one."""
    term = f"exp((({df}) / 2.0::DOUBLE + jj) * ln(({x}) / 2.0::DOUBLE) - ({x}) / 2.0::DOUBLE - lgamma(({df}) / 2.0::DOUBLE + jj + 1))"
    return f"(CASE WHEN ({x}) <= 0 THEN 1 ELSE 1 - list_sum(list_transform(range(0, 400), lambda jj: {term})) END)"
