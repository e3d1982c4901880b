"""Curves that need a series' pairs together: many series at a time, in any batches, as one after the other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlake.operators import comparison

SCHEMA = "series long, k long, x double, y double"


def pairs_of(series=60):
    rng, rows = np.random.default_rng(8), []
    for s in range(series):
        n = 1 + s % 23
        x = rng.integers(0, 12, n) * 1000.0
        y = 500 + 9000 / (1 + (np.maximum(x, 1) / 5000) ** -2.0) + rng.normal(0, 60, n)
        rows += [(s, k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))]
    return rows


@pytest.fixture(params=[100_000, 40])
def dealt(spark, request, monkeypatch):
    """The pairs in a mixed order, in batches of seven rows, with many or with few rows held at a time."""
    monkeypatch.setattr(comparison, "TOGETHER", request.param)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows = pairs_of()
    yield spark.createDataFrame([rows[i] for i in np.random.default_rng(1).permutation(len(rows))], SCHEMA).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def by_series():
    out = {}
    for s, k, x, y in pairs_of():
        out.setdefault(s, []).append((x, y))
    return {s: np.array(v).T for s, v in out.items()}


def test_logistic_fits_of_many_series():
    """Bit by bit those of each series alone, in the order of k."""
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 9, (50, 17)) * 100.0, rng.normal(size=(50, 17))
    assert np.array_equal(comparison.four_parameters(x, y), [comparison.four_parameter(a, b) for a, b in zip(x, y)])


def test_fits_do_not_depend_on_the_order_of_rows(dealt):
    for model in ("fourpl", "spline"):
        got = {(r.series, r.k): r.fit for r in comparison.curve_fits(dealt, model).collect()}
        assert len(got) == len(pairs_of())
        for s, (x, y) in by_series().items():
            if model == "fourpl" and len(x) >= 4:
                want = comparison.logistic_at(comparison.four_parameter(x, y), x)
            elif model == "spline" and len(np.unique(x)) >= 3:
                want = comparison.spline_at(*comparison.natural_spline(x, y), x)
            else:
                continue
            assert [got[s, k] for k in range(len(x))] == want.tolist()


def test_curves_at_new_x(dealt):
    at = dealt.select("series", (F.col("x") + 0.5).alias("x")).distinct()
    for model in ("fourpl", "spline"):
        curves = comparison.calibrate(dealt, model)
        got = {(r.series, r.x): r.fit for r in comparison.predict_response(at, curves).collect()}
        kept = {r.series: r for r in curves.collect()}
        own = {s: v for s, v in by_series().items() if v.shape[1] >= 3}
        assert kept.keys() == own.keys() and len(got) == sum(len(np.unique(x)) for x, _ in own.values())
        for s, (x, y) in own.items():
            c = np.array(kept[s].coefficients)
            for a in np.unique(x) + 0.5:
                assert got[s, a] == comparison.curve_at(model, c, np.array([a]))[0]
            if model == "fourpl":
                assert c.tolist() == comparison.four_parameter(x, y).tolist()
            left = ((y - comparison.curve_at(model, c, x)) ** 2).sum()
            assert kept[s].residual_sd == pytest.approx((left / len(x)) ** 0.5) and kept[s].n == len(x)


def test_no_task_holds_the_points_of_a_line(spark):
    """Polynomials are evaluated where the points are: none goes to a worker, grouped by series or otherwise."""
    df = spark.createDataFrame(pairs_of(4), SCHEMA)
    plan = comparison.predict_response(df.select("series", "x"), comparison.calibrate(df, "polynomial"))._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and "LocalRelation <empty>" in plan
