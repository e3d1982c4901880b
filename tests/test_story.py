"""Stories of planted changes, report pages and charts."""

import datetime as dt

import numpy as np

from driftlake.operators import story
from driftlake.sources import pages

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def test_planted_story(spark):
    rng = np.random.default_rng(3)
    rows = [("A", i, at(i), float(100 + rng.normal() + 3 * (i >= 60) + (0.15 * (i - 140) if i >= 140 else 0))) for i in range(200)]
    rows += [("B", i, at(i), float(100 + rng.normal())) for i in range(50)] + [("B", 50, at(7), None)]
    df = spark.createDataFrame(rows, "series string, seq bigint, ts timestamp_ntz, value double")
    known = [("A", "lot_change", at(60), "L1 to L2"), ("A", "maintenance", at(0), "service"), ("B", "note", at(25), "x")]
    events = spark.createDataFrame(known, "series string, kind string, ts timestamp_ntz, label string")
    starts = spark.createDataFrame([("A", at(140))], "series string, ts timestamp_ntz")
    hits = spark.createDataFrame([("B", at(40))], "series string, ts timestamp_ntz")
    segments = story.told(df, story.marks(df, events, changepoint=starts), qc_hits=hits, drifts=starts)
    told = story.beats(segments)
    found = {(r.series, r.beat): r.kind for r in told.collect()}
    kinds = {s: [found[k] for k in sorted(found) if k[0] == s] for s in "AB"}
    assert kinds == {"A": ["calibration", "stable", "lot_change", "shift", "changepoint", "drift"], "B": ["stable", "qc"]}
    text = {r.series: r.narrative for r in story.narrative(told).collect()}
    assert text["B"] == "Stable" + story.ARROW + "QC deterioration"


def test_pages_escape_and_thin_out(spark):
    rows = [("<a>", i, at(i), float(i % 7) if i % 50 else float("nan")) for i in range(2000)]
    df = spark.createDataFrame(rows, "series string, seq bigint, ts timestamp_ntz, value double")
    svg = pages.control_chart(df, "<a>")
    assert svg.startswith("<svg") and svg.count("<circle") <= pages.MOST_POINTS and "&lt;a&gt;" in svg
    reports = spark.createDataFrame([("<a>", "stable", 99.0, None)], "series string, status string, score double, note string")
    html = pages.html(reports, {"chart": svg})
    assert "&lt;a&gt;" in html and "<script" not in html and svg in html
    forest = pages.forest_chart(spark.createDataFrame([("s1", 1.0, 0.5, 1.5), ("s2", 2.0, 1.0, 3.0)], "name string, mid double, low double, high double"))
    assert forest.count("<line") >= 2
