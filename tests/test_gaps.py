"""Values and times that are missing: they take no part, places are those of the input, detectors are chosen by what is left."""

import datetime as dt
import math

import numpy as np
import pytest

from driftlake.operators import change_points as cp
from driftlake.operators import composite, drift

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "series string, seq long, ts timestamp_ntz, value double"


def table(spark, values, name="s", times=None):
    times = [T0 + dt.timedelta(hours=i) for i in range(len(values))] if times is None else times
    return spark.createDataFrame([(name, i, t, None if v is None else float(v)) for i, (t, v) in enumerate(zip(times, values))], SCHEMA)


def test_a_null_time_changes_no_drift(spark):
    rng = np.random.default_rng(0)
    x = (0.05 * np.arange(80) + 0.3 * rng.normal(size=80)).tolist()
    clean = table(spark, x)
    holed = clean.union(spark.createDataFrame([("s", 500, None, 77.0), ("s", 501, None, None), ("s", 502, T0, math.nan)], SCHEMA))
    for kind in (*drift.KINDS, "auto"):
        a, b = (drift.detect_drift(df, kind).first().asDict() for df in (holed, clean))
        assert {k: pytest.approx(v) if isinstance(v, float) else v for k, v in a.items()} == b, kind
    assert drift.linear(holed).first().detected and not drift.nonlinear(holed).first().detected


def test_a_probability_that_is_no_number_never_wins(spark):
    rows = [("s", k, False, p, 0.0, "none", 1, 40) for k, p in (("linear", math.nan), ("sudden", 0.3), ("variance", None), ("distribution", 0.2), ("cyclic", 0.1), ("nonlinear", 0.1))]
    found = spark.createDataFrame(rows, "series string, kind string, detected boolean, probability double, magnitude double, direction string, start_index long, n long")
    assert drift.best_of({k: found.where(f"kind = '{k}'") for k in drift.KINDS}).first().kind == "sudden"


@pytest.mark.parametrize("method", ["likelihood", "cusum", "robust_median", "rolling", "pelt", "bayesian", "kernel", "sampled"])
def test_places_are_those_of_the_input(spark, method):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=40), 6 + rng.normal(size=120)])
    holed, place = [], []
    for k, v in enumerate(x):
        holed += ([math.nan, None, math.inf][: 1 + k % 3]) if k in (0, 1, 2, 30, 39, 40, 90) else []
        holed.append(v)
        place.append(len(holed))
    clean, found = (cp.METHODS[method](table(spark, v)).first() for v in (x, holed))
    assert clean.detected and found.indices == [place[i - 1] for i in clean.indices]
    assert (found.statistic, found.confidence) == pytest.approx((clean.statistic, clean.confidence))
    assert cp.detect_changes(table(spark, [math.nan] * 20 + x.tolist()), "likelihood").first().indices == [60]


def test_series_side_by_side_and_null_times(spark):
    rng = np.random.default_rng(6)
    step = np.concatenate([rng.normal(size=40), 5 + rng.normal(size=40)])
    times = [None, None] + [T0 + dt.timedelta(days=i) for i in range(78)]
    both = table(spark, step, "a", times).union(table(spark, [None] * 7 + step.tolist(), "b")).union(table(spark, [None] * 5, "c"))
    for method in ("likelihood", "pelt", "cusum"):
        found = {r.series: r.indices for r in cp.METHODS[method](both).collect()}
        assert 40 in found["a"] and 47 in found["b"] and not found.get("c")


def test_the_report_chooses_by_what_is_left(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=500)
    x[::5] = math.nan
    assert cp.features(table(spark, x)).first().method == "robust_median"  # a fifth is missing
    report = composite.analyze(table(spark, x)).first()
    assert report.change_method == "pelt" and report.missing == pytest.approx(0.2) and report.n == 400
    x = rng.normal(size=420)
    x[:6] = 1e4  # heavy tails, until the outliers are gone
    assert composite.analyze(table(spark, x)).first().change_method == "robust_median"
    assert composite.analyze(table(spark, x), policy="remove").first().change_method == "pelt"
