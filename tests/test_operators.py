"""Identities, known values and edge cases."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlake.functions import columns as fc
from driftlake.functions import units
from driftlake.operators import basics, change_points, comparison, drift, qc, reference, sites
from driftlake.operators import two_sample as ts
from driftlake.plans.base import table
from driftlake.streaming import detectors

START = datetime(2024, 1, 1)


def series(spark, values, name="s"):
    table(spark, "/root/testdata/sf0.001", "events")  # lets workers import the package
    rows = [(name, i, START + timedelta(hours=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, seq long, ts timestamp_ntz, value double")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def number(spark, column):
    return spark.range(1).select(column).first()[0]


def test_special_functions(spark):
    lit = lambda x: F.lit(float(x))
    assert abs(number(spark, fc.normal_sf(lit(1.96))) - 0.0249979) < 1e-6
    assert abs(number(spark, fc.chisq_sf(lit(9.487729), lit(4))) - 0.05) < 1e-7
    assert abs(number(spark, fc.chisq_sf(lit(1.0), lit(3))) - 0.8012520) < 1e-6
    assert abs(number(spark, fc.t_two_sided(lit(1), lit(10))) - 0.3408931) < 1e-6
    assert abs(number(spark, fc.f_sf(lit(8), lit(2), lit(4))) - 0.04) < 1e-6
    assert abs(number(spark, fc.beta_inc(lit(1), lit(1), lit(0.7))) - 0.7) < 1e-9
    assert abs(number(spark, fc.log_gamma(lit(0.5))) - math.log(math.sqrt(math.pi))) < 1e-9
    assert abs(number(spark, fc.normal_quantile(lit(0.975))) - 1.96) < 1e-3
    assert math.isnan(number(spark, fc.inv_boxcox(lit(-10), lit(1))))


def test_missing_is_left_out(spark):
    df = series(spark, [1.0, None, float("nan"), 2.0, float("inf")])
    row = one(basics.baseline(df))
    assert (row.n, row.mean) == (2, 1.5)
    assert one(df.groupBy("series").agg(basics.missing_fraction(F.col("value")).alias("m"))).m == 0.6


def test_theil_sen_on_a_line(spark):
    pairs = spark.createDataFrame([("s", i, float(i), 2.0 * i + 1) for i in range(1, 11)], "series string, k int, x double, y double")
    row = one(basics.theil_sen(pairs))
    assert (row.slope, row.intercept) == (2.0, 1.0)


def test_distances(spark):
    def sides(a, b):
        return spark.createDataFrame([("s", "a", float(x)) for x in a] + [("s", "b", float(x)) for x in b], "series string, side string, value double")

    assert one(ts.ks(sides([1, 2, 3], [1, 2, 3]))).d == 0
    assert one(ts.ks(sides([1, 1], [1]))).d == 0 and one(ts.ks(sides([1, 1], [1]), compat_ties=True)).d == 0.5
    assert one(ts.wasserstein(sides([0], [2]))).w == 2
    assert one(ts.energy(sides([0, 0], [1, 1]))).e == 2
    assert one(ts.jensen_shannon(sides([5, 5], [5]))).js == 0
    assert one(ts.welch(sides(np.random.default_rng(1).normal(0, 1, 200), np.random.default_rng(2).normal(3, 1, 200)))).p < 1e-6


@pytest.mark.parametrize("method", ["cusum", "likelihood", "pelt", "robust_median", "rolling", "bayesian", "sampled"])
def test_a_step_is_found(spark, method):
    rng = np.random.default_rng(5)
    df = series(spark, np.concatenate([rng.normal(0, 1, 60), rng.normal(3, 1, 60)]).tolist())
    row = one(change_points.detect_changes(df, method))
    assert row.detected and min(abs(i - 60) for i in row.indices) <= 25


def test_kernel_finds_a_late_step(spark):
    """Its scale is the split in the middle, so a step just there never stands out."""
    rng = np.random.default_rng(5)
    row = one(change_points.kernel(series(spark, np.concatenate([rng.normal(0, 1, 100), rng.normal(4, 1, 20)]).tolist())))
    assert row.detected and abs(row.indices[0] - 100) <= 5


def test_short_series_and_unknown_methods(spark):
    df = series(spark, [1.0, 2.0])
    for method in ("likelihood", "cusum", "pelt", "bayesian"):
        assert not one(change_points.detect_changes(df, method)).detected
    with pytest.raises(ValueError):
        change_points.detect_changes(df, "nothing")


def test_pelt_is_the_best_partition():
    rng = np.random.default_rng(3)
    for _ in range(10):
        x = np.concatenate([rng.normal(0, 1, rng.integers(10, 30)), rng.normal(4, 1, rng.integers(10, 30)), rng.normal(-1, 1, 20)])
        found, statistic = change_points.pelt_of(x)
        z, n = (x - x.mean()) / x.std(ddof=1), len(x)
        penalty = 3 * math.log(n)
        sse = lambda a, b: ((z[a:b] - z[a:b].mean()) ** 2).sum()  # noqa: E731, B023
        edges = [0, *found, n]
        assert abs(-statistic - (sum(sse(a, b) for a, b in zip(edges, edges[1:])) + (len(found)) * penalty)) < 1e-6


def test_drift_kinds(spark):
    rng = np.random.default_rng(6)
    line = one(drift.detect_drift(series(spark, (100 + 0.08 * np.arange(80) + 0.3 * rng.normal(size=80)).tolist()), "linear"))
    assert line.detected and line.direction == "increase"
    step = one(drift.detect_drift(series(spark, np.concatenate([rng.normal(100, 0.4, 50), rng.normal(108, 0.4, 50)]).tolist()), "sudden"))
    assert step.detected and abs(step.start_index - 50) <= 2
    wide = one(drift.detect_drift(series(spark, np.concatenate([rng.normal(0, 1, 60), rng.normal(0, 3, 60)]).tolist()), "variance"))
    assert wide.detected
    wave = one(drift.detect_drift(series(spark, np.sin(np.arange(96) / 96 * 2 * np.pi * 4).tolist()), "cyclic"))
    assert wave.detected
    assert one(drift.detect_drift(series(spark, (np.arange(60) ** 2.0).tolist()), "auto")).detected


def test_multivariate_shift(spark):
    table(spark, "/root/testdata/sf0.001", "events")
    x = np.random.default_rng(2).normal(size=(80, 2))
    x[40:] += 2.5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "seq long, features array<double>")
    for method in ("mahalanobis", "pca", "energy"):
        assert one(drift.multivariate(df, method)).detected


def test_qc_spike(spark):
    values = [100.0] * 20
    values[9] = 107.0
    spec = spark.createDataFrame([("s", 100.0, 2.0)], "series string, center double, sd double")
    assert [r.i for r in qc.rule_hits(series(spark, values), spec, "1-3s").collect()] == [10]
    runs = qc.rule_hits(series(spark, [101.0] * 12), spec, "10x").collect()
    assert sorted(r.i for r in runs) == [10, 11, 12]
    assert [r.i for r in qc.rule_hits(series(spark, [float(100 + i) / 1 for i in range(7)]), spec, "7T").collect()] == [7]


def test_reference_limits(spark):
    x = np.random.default_rng(9).normal(100, 5, 400).tolist()
    for method in reference.METHODS:
        row = one(reference.reference_interval(series(spark, x), method))
        assert row.lower < row.upper and abs(row.lower - 90.2) < 3 and abs(row.upper - 109.8) < 3


def test_methods_agree(spark):
    rng = np.random.default_rng(8)
    pairs = spark.createDataFrame([("s", i, float(x), float(x + 1.5 + 0.3 * e)) for i, (x, e) in enumerate(zip(rng.uniform(1, 20, 40), rng.normal(size=40)))], "series string, k int, x double, y double")
    assert abs(one(comparison.bland_altman(pairs)).bias - 1.5) < 0.2
    pb = one(comparison.passing_bablok(pairs))
    assert pb.lower <= 1.02 and pb.upper >= 0.98
    assert abs(one(comparison.deming(pairs)).slope - 1) < 0.05


def test_curves():
    x = np.arange(5.0)
    assert np.allclose(comparison.spline_at(*comparison.natural_spline(x, x**3), x), x**3)
    t = np.linspace(0.1, 50, 60)
    assert np.abs(comparison.logistic_at(comparison.four_parameter(t, 1 + 9 / (1 + (t / 8) ** 1.5)), t) - (1 + 9 / (1 + (t / 8) ** 1.5))).max() < 0.5


def test_sites_without_spread(spark):
    rows = [("s", i, START, f"site{i % 2}", 100.0 + 4 * (i % 2)) for i in range(32)]
    df = spark.createDataFrame(rows, "series string, seq long, ts timestamp_ntz, site string, value double")
    got = sites.site_effects(df).collect()
    assert {r.i2 for r in got} == {100.0} and got[0].lower < got[0].upper


def test_units():
    units.check_units("mg/dl", "mg/dL")
    with pytest.raises(units.UnitMismatchError):
        units.check_units("mg/dL", "mmol/L")
    with pytest.raises(units.UnitMismatchError):
        units.converted(None, "mg/dL", "mmol/L")


def test_alert_after_a_shift(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(100, 0.8, 30), np.full(40, 108.0)]).tolist()
    found = detectors.alerts(series(spark, values), detectors.Cusum(baseline={"n": 80, "mean": 100.0, "sd": 0.8})).collect()
    assert len(found) >= 1 and min(r.seq for r in found) >= 30


def test_concordance_has_a_cooldown(spark):
    table(spark, "/root/testdata/sf0.001", "events")
    base = {"n": 30, "mean": 100.0, "sd": 1.0}
    rows = [("study", i, START + timedelta(minutes=i // 2), "ab"[i % 2], 130.0) for i in range(80)]
    schema = "series string, seq long, ts timestamp_ntz, site string, value double"
    assert detectors.concordance(spark.createDataFrame(rows, schema), detectors.Cusum(baseline=base)).count() == 1
    later = [("study", 100 + i, START + timedelta(hours=7, minutes=i), "ab"[i % 2], 130.0) for i in range(6)]
    assert detectors.concordance(spark.createDataFrame(rows + later, schema), detectors.Cusum(baseline=base)).count() >= 2
    with pytest.raises(Exception, match="unknown site"):
        detectors.concordance(spark.createDataFrame(rows, schema), detectors.Cusum(baseline=base), sites={"a"}).collect()


def test_stream_gives_what_the_table_gives(spark):
    from driftlake.plans import QUERIES

    sf = "/root/testdata/sf0.001"
    key = lambda rows: sorted(tuple(r) for r in rows)
    assert key(QUERIES["stream_cusum"](spark, sf).collect()) == key(QUERIES["cusum_replay"](spark, sf).collect())
