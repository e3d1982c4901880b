"""Reference curves over ranges of the covariate against a plain selection of nearest values; bootstrap limits from bins."""

import numpy as np
import pytest

from driftlake.operators import reference


def plain(rows, span, points, method, quantiles=(0.025, 0.5, 0.975), power=None):
    rows = sorted(rows, key=lambda r: (r[2], r[1]))
    x, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    n, out = len(x), []
    for point in range(min(points, n)):
        at = x[0] + (x[-1] - x[0]) * point / (min(points, n) - 1)
        order = np.lexsort((np.arange(n), np.abs(x - at)))[: max(8, int(np.rint(n * span)))]
        local = y[order]
        positive = local[local > 0]
        if method == "lms" and len(positive) >= 8:
            mu = np.median(positive)
            z = np.log(positive / mu) if abs(power) < 1e-8 else ((positive / mu) ** power - 1) / power
            s = z.std(ddof=1) or 0.1
            out.append((point, at, len(positive), *(reference._lms(mu, s, power, q) for q in (-1.9603949169253396, 0.0, 1.9603949169253396))))
        else:
            out.append((point, at, len(local), *np.quantile(local, quantiles)))
    return out


@pytest.mark.parametrize("small", [0, 500, 100_000])
@pytest.mark.parametrize("method", ["quantile", "lms"])
def test_curves_equal_plain_selection(spark, monkeypatch, method, small):
    """All series over ranges, some of them, and none."""
    monkeypatch.setattr(reference, "SMALL", small)
    rng = np.random.default_rng(8)
    rows = [("even", i, float(i), float(rng.normal())) for i in range(400)]
    rows += [("ties", i, float(rng.integers(0, 7)), float(rng.integers(-2, 9))) for i in range(900)]
    rows += [("skewed", i, float(rng.exponential() ** 3), float(abs(rng.normal()) + 0.1)) for i in range(1500)]
    rows += [("flat", i, 2.0, float(i)) for i in range(60)] + [("negative", i, float(i), -1.0 - i) for i in range(50)]
    rows += [("short", i, float(i), 1.0) for i in range(29)] + [("even", 900 + i, float("nan"), 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "series string, seq long, covariate double, value double").repartition(3)
    got = {}
    for r in reference.reference_curve(df, span=0.2, points=20, method=method).collect():
        got.setdefault(r.series, []).append(tuple(r)[1:])
    power = {r.series: r.power for r in reference.boxcox_lambda(df.where("covariate = covariate"), "series", "value").collect()}
    assert set(got) == {"even", "ties", "skewed", "flat", "negative"}
    for name, own in got.items():
        want = plain([r for r in rows if r[0] == name and r[2] == r[2]], 0.2, 20, method, power=power.get(name))
        if method == "lms":  # the medians' own quantile is not quite zero by the approximation
            np.testing.assert_allclose(np.array([(*r[:4], r[5]) for r in sorted(own)], float), np.array([(*w[:4], w[5]) for w in want], float), rtol=1e-3, err_msg=name)
        else:
            np.testing.assert_allclose(np.array(sorted(own), float), np.array(want, float), rtol=1e-9, atol=1e-12, err_msg=name)


@pytest.mark.parametrize("method", reference.METHODS)
def test_limits_of_weighted_values_are_those_of_repeated_ones(method):
    rng = np.random.default_rng(2)
    x, times = np.sort(rng.lognormal(size=300)), rng.integers(0, 4, 300)
    assert reference.edges_of(x, method, times) == pytest.approx(reference.edges_of(np.repeat(x, times), method), rel=1e-9)


def test_bootstrap_from_bins_is_that_of_the_values(spark, monkeypatch):
    """30,000 values in 4,096 bins against draws of the values themselves; few values are drawn as they are."""
    rng = np.random.default_rng(6)
    x = rng.lognormal(size=30_000)
    few = rng.normal(size=200)
    df = spark.createDataFrame([("many", float(v)) for v in x] + [("few", float(v)) for v in few] + [("none", 1.0)] * 5, "series string, value double").repartition(4)
    bins = reference.binned(df).groupBy("series").agg({"c": "sum", "m": "count"}).collect()
    assert {r.series: (r["sum(c)"], r["count(m)"]) for r in bins} == {"many": (30_000, 4096), "few": (200, 200), "none": (5, 5)}
    for method in ("nonparametric", "parametric"):
        got = {r.series: r for r in reference.interval_limits(df, method, times=200).collect()}
        for name, own in (("many", x), ("few", few)):
            draws = np.array([reference.edges_of(own[rng.integers(0, len(own), len(own))], method) for _ in range(200)])
            want = np.quantile(draws, [0.025, 0.975], axis=0)
            width = want[1] - want[0]
            r = got[name]
            assert abs(r.lower_low - want[0, 0]) < 0.35 * width[0] and abs(r.lower_high - want[1, 0]) < 0.35 * width[0]
            assert abs(r.upper_low - want[0, 1]) < 0.35 * width[1] and abs(r.upper_high - want[1, 1]) < 0.35 * width[1]
