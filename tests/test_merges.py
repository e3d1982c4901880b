"""Ordered merges of two tables in ranges of time, with one long series among short ones."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from driftlake.operators import composite, series, story

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "series string, seq long, ts timestamp_ntz, value double"


def measurements():
    rng, rows = np.random.default_rng(3), []
    for name, n, within in (("long", 1500, 900), ("short", 4, 900), ("one time", 200, 1)):
        rows += [(name, i, T0 + dt.timedelta(minutes=int(rng.integers(within))), float(i)) for i in range(n)]
    return rows + [("long", 9000, None, 1.0), ("long", 9001, T0, float("nan")), ("no events", 0, T0, 1.0)]


def test_nearest_of_a_long_series(spark):
    rng, rows = np.random.default_rng(4), measurements()
    events = [(name, T0 + dt.timedelta(seconds=int(rng.integers(-3000, 60000))), f"{name}{k}") for name in ("long", "short", "one time") for k in range(60)] + [("nowhere", T0, "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = composite.nearest(spark.createDataFrame(events, "series string, ts timestamp_ntz, label string"), df).collect()
    got = {(r.series, r.label): r.i for r in found}
    for name, ts, label in events:
        own = sorted((r for r in rows if r[0] == name and r[2] is not None and r[3] == r[3]), key=lambda r: (r[2], r[1]))
        want = min(range(len(own)), key=lambda k: (abs(own[k][2] - ts), k)) + 1 if own else None
        assert got[name, label] == want, (name, label)


def test_segments_of_a_long_series(spark):
    rng, rows = np.random.default_rng(5), [r for r in measurements() if r[2] is not None and r[3] == r[3]]
    marks = [(name, T0 + dt.timedelta(minutes=int(m))) for name in ("long", "short") for m in sorted(set(rng.integers(0, 900, 40).tolist()))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = composite.segments(df, spark.createDataFrame(marks, "series string, ts timestamp_ntz")).collect()
    for r in found:
        own = [v for s, _, ts, v in rows if s == r.series and r.from_ts <= ts <= r.to_ts]
        assert r.n == len(own) and abs(r.mean - np.mean(own)) < 1e-9
    ends = {name: {ts for s, _, ts, _ in rows if s == name} for name in ("long", "short", "one time", "no events")}
    borders = lambda name: sorted({min(ends[name]), max(ends[name])} | {t for s, t in marks if s == name})
    assert sum(r.series == "long" for r in found) == len(borders("long")) - 1
    placed = story.placed(df, spark.createDataFrame([], "series string, segment int, from_ts timestamp_ntz"))
    assert placed.count() == 0


def test_values_are_carried_over_the_borders_of_ranges(spark):
    rows = [("s", k, T0 + dt.timedelta(minutes=k // 3), float(k) if k % 97 == 5 else None) for k in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = series.along(df, "seq", before={"b": F.col("value")}, after={"a": F.col("value")}, passed={"p": F.lit(1)}, rows=10)
    held = [r[3] for r in rows]
    for r in out.collect():
        assert r.b == next((v for v in reversed(held[: r.seq + 1]) if v is not None), None)
        assert r.a == next((v for v in held[r.seq :] if v is not None), None)
        assert r.p == 3 * (r.seq // 3) + 3
    assert series.in_ranges(df, ["series"], F.col("seq"), 10).select("_part").distinct().count() > 50
