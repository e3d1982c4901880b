"""Odd series beside healthy ones, optima by brute force, dispatch, evaluation, reconstruction, streams."""

import itertools
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlake.functions import columns as fc
from driftlake.operators import basics, batches, change_points, comparison, composite, drift, evaluation, qc, reconstruction, reference, series, sites, slopes, story
from driftlake.operators import two_sample as ts
from driftlake.sources.tables import showcase, simulated_assays
from driftlake.streaming import detectors
from tests.test_operators import START, number, one
from tests.test_operators import series as made


def two(spark, **named):
    rows = [(k, i, START + timedelta(hours=i), v) for k, values in named.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, seq long, ts timestamp_ntz, value double")


def by_name(df):
    return {r.series: r for r in df.collect()}


def sides(spark, **named):
    return spark.createDataFrame([(k, s, float(x)) for k, (a, b) in named.items() for s, v in (("a", a), ("b", b)) for x in v], "series string, side string, value double")


def test_series_without_spread_do_not_fail_others(spark):
    rng = np.random.default_rng(1)
    df = two(spark, flat=[5.0] * 30, fine=rng.normal(size=30).tolist())
    chart = qc.levey_jennings(df, qc.spec_of(df)).collect()
    assert len(chart) == 60 and all((r.z is None) == (r.series == "flat") for r in chart)
    assert not by_name(drift.distribution(df))["flat"].detected
    for f in (change_points.cusum, change_points.likelihood, change_points.rolling, drift.linear, drift.nonlinear, drift.sudden, drift.variance, drift.cyclic):
        found = by_name(f(df))
        assert not found["flat"].detected and "fine" in found
    assert set(by_name(ts.jensen_shannon(sides(spark, one=([1, 2], []), both=([1, 2], [2, 3]))))) == {"both"}
    pairs = spark.createDataFrame([("flat", i, 2.0, float(i)) for i in range(9)] + [("fine", i, float(i), 2.0 * i) for i in range(9)], "series string, k int, x double, y double")
    assert by_name(comparison.quadratic(pairs))["flat"].c2 is None and abs(by_name(comparison.quadratic(pairs))["fine"].c1 - 2) < 1e-9
    assert by_name(comparison.passing_bablok(pairs))["flat"].slope == 1.0 and by_name(comparison.passing_bablok(pairs))["fine"].slope == 2.0


def test_kolmogorov_tail_without_a_distance(spark):
    lit = lambda x: F.lit(float(x))
    assert number(spark, fc.kolmogorov_sf(lit(0), lit(30), lit(30))) == 1.0
    assert abs(number(spark, fc.kolmogorov_sf(lit(0.5), lit(30), lit(30))) - 0.0009) < 5e-4


@pytest.mark.parametrize("ties", [False, True])
def test_percentiles_and_ranks_are_exact(spark, monkeypatch, ties):
    monkeypatch.setattr(series, "SKETCH", 50)
    rng = np.random.default_rng(3)
    x = {k: (rng.integers(0, 4, n).astype(float) if ties else rng.normal(size=n)) for k, n in (("a", 997), ("b", 1), ("c", 2), ("d", 400))}
    df = two(spark, **{k: v.tolist() for k, v in x.items()})
    got = by_name(series.percentiles(df, ("series",), "value", low=0.025, mid=0.5, high=0.9, top=1.0))
    for k, v in x.items():
        assert np.allclose([got[k].low, got[k].mid, got[k].high, got[k].top], np.quantile(v, [0.025, 0.5, 0.9, 1.0]))
    ranks = series.ranked(df, ("series",), "value", "seq").collect()
    for k, v in x.items():
        order = {int(s): i + 1 for i, s in enumerate(np.lexsort((np.arange(len(v)), v)))}
        assert {r.seq: r["rank"] for r in ranks if r.series == k} == order


def test_slopes_of_long_series_are_those_of_all_pairs(monkeypatch):
    rng = np.random.default_rng(4)
    for x, y in ((np.arange(300.0), rng.normal(size=300)), (rng.integers(0, 9, 300) * 1.0, rng.integers(0, 5, 300) * 1.0)):
        monkeypatch.setattr(slopes, "PAIRWISE", 1500)
        exact, pb = slopes.Slopes(x, y), slopes.passing_bablok_of(x, y)
        monkeypatch.setattr(slopes, "PAIRWISE", 0)
        assert np.allclose([slopes.Slopes(x, y).at(k) for k in (0, exact.size // 2, exact.size - 1)], [exact.at(k) for k in (0, exact.size // 2, exact.size - 1)])
        assert np.allclose(list(slopes.passing_bablok_of(x, y).values()), list(pb.values()))
    assert slopes.inversions(np.array([3.0, 1.0, 2.0, 2.0, 0.0])) == 7


def test_crossings_are_those_of_one_value_at_a_time():
    rng = np.random.default_rng(5)
    for _ in range(30):
        x, state, up, down, want = rng.normal(0.1, 1.5, 400), {"i": 0, "up": 0.0, "down": 0.0}, 0.0, 0.0, []
        for i, v in enumerate(x, 1):
            up, down = max(0.0, up + v - 0.5), max(0.0, down - v - 0.5)
            if up > 5 or down > 5:
                want.append(i)
                up = down = 0.0
        got = [i for part in np.split(x, [1, 7, 150, 151]) for i in change_points.crossings(part, 0.5, 5.0, state, first=8)["i"].tolist()]
        assert got == want


def best_cost(z, penalty, min_size):
    n = len(z)
    sse = lambda a, b: ((z[a:b] - z[a:b].mean()) ** 2).sum()
    cost = [-penalty] + [np.inf] * n
    for b in range(1, n + 1):
        cost[b] = min(cost[a] + sse(a, b) + penalty for a in range(b) if a == 0 or b - a >= min_size)
    return cost[n]


def test_pelt_reaches_the_least_cost():
    rng = np.random.default_rng(6)
    for _ in range(8):
        x = np.concatenate([rng.normal(m, 1, rng.integers(8, 30)) for m in rng.choice([0, 3, -3], 3)])
        z = (x - x.mean()) / x.std(ddof=1)
        _, statistic = change_points.pelt_of(x, 1)
        assert -statistic == pytest.approx(best_cost(z, 3 * np.log(len(x)), 1))


def test_product_partition_is_the_sum_over_all_partitions():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 1, 6), rng.normal(4, 1, 6)])
    n, size = len(x), 3
    _, mass = change_points.product_partition(x, size)
    hazard, var, mu, k0 = min(0.2, max(1 / np.sqrt(n), 2 / n)), x.var(ddof=1), x.mean(), 0.01

    def segment(a, b):
        d, m = x[a:b] - mu, b - a
        return -0.5 * m * np.log(2 * np.pi * var) + 0.5 * np.log(k0 / (k0 + m)) - ((d**2).sum() - d.sum() ** 2 / (k0 + m)) / (2 * var)

    total = np.zeros(n)
    for r in range(1, n // size):
        for cuts in itertools.combinations(range(size, n - size + 1), r):
            edges = [0, *cuts, n]
            if all(b - a >= size for a, b in zip(edges, edges[1:])):
                weight = np.exp(sum(segment(a, b) + (b - a - 1) * np.log1p(-hazard) for a, b in zip(edges, edges[1:])) + r * np.log(hazard))
                for c in cuts:
                    total[c - 1] += weight
    assert np.allclose(mass, total / total.sum(), atol=1e-9)


def test_energy_of_many_variables_is_that_of_all_pairs(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=(90, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "seq long, features array<double>")
    sums = {(r.a, r.b): (r.total, r.pairs) for r in drift.distance_sums(df.where("seq < 40"), df.where("seq >= 40"), tile=13).collect()}
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for key, block in (((0, 0), far[:40, :40]), ((0, 1), far[:40, 40:]), ((1, 1), far[40:, 40:])):
        assert sums[key][1] == block.size and sums[key][0] == pytest.approx(block.sum(), rel=1e-6)
    mean, cov, n = drift.mean_vector(df.repartition(3).select("features"))
    assert n == 90 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T))


def test_curves_between_knots_and_dispatch(spark):
    x = np.array([0.0, 1.0, 2.5, 4.0, 6.0])
    y = np.array([1.0, 0.0, 2.0, -1.0, 3.0])
    knots, mean, second = comparison.natural_spline(x, y)
    h = np.diff(x)
    dense = np.zeros((5, 5))
    dense[0, 0] = dense[4, 4] = 1.0
    right = np.zeros(5)
    for i in range(1, 4):
        dense[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        right[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    assert np.allclose(second, np.linalg.solve(dense, right))
    # continuous first derivatives at the knots, which values at the knots cannot show
    at = lambda v: comparison.spline_at(knots, mean, second, np.array([v]))[0]
    for k in x[1:-1]:
        assert (at(k) - at(k - 1e-5)) / 1e-5 == pytest.approx((at(k + 1e-5) - at(k)) / 1e-5, abs=1e-3)
    t = np.linspace(0.5, 40, 50)
    pairs = spark.createDataFrame([("s", i, float(v), float(1 + 9 / (1 + (v / 8) ** 1.5))) for i, v in enumerate(t)] + [("q", i, float(v), float(1 + v + 0.5 * v * v)) for i, v in enumerate(t)], "series string, k int, x double, y double")
    new = spark.createDataFrame([("s", 3.3), ("q", 3.3)], "series string, x double")
    want = {"s": 1 + 9 / (1 + (3.3 / 8) ** 1.5), "q": 1 + 3.3 + 0.5 * 3.3**2}
    for model, name, off in (("fourpl", "s", 0.3), ("spline", "s", 0.05), ("polynomial", "q", 1e-6)):
        curves = comparison.calibrate(pairs, model)
        assert by_name(curves)[name].r2 > 0.99
        assert abs(by_name(comparison.predict_response(new, curves))[name].fit - want[name]) < off
    for model in ("linear", "weighted_linear", "robust"):
        assert len(by_name(comparison.calibrate(pairs, model))) == 2
    for method in comparison.METHODS:
        assert by_name(comparison.compare_methods(pairs, method))["q"].n == 50
    for call in (lambda: comparison.calibrate(pairs, "x"), lambda: comparison.compare_methods(pairs, "x"), lambda: batches.corrected(pairs, "x"), lambda: ts.compare_distribution(pairs, "x"), lambda: qc.without_outliers(pairs, "x")):
        with pytest.raises(ValueError):
            call()


def test_limits_have_bootstrap_limits(spark):
    x = np.random.default_rng(9).normal(100, 5, 60)
    for method in reference.METHODS:
        r = one(reference.interval_limits(made(spark, x.tolist()), method, times=60))
        assert r.lower_low <= r.lower <= r.lower_high + 1 and r.upper_low <= r.upper_high and "120" in r.notes
        assert np.allclose(reference.edges_of(x, method), (r.lower, r.upper), rtol=1e-6)


def test_rolling_windows_grow_with_the_series(spark):
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(0, 1, 200), rng.normal(0.8, 1, 200)])
    row = one(change_points.rolling(made(spark, x.tolist())))
    w = 50
    t = []
    for i in range(w, 400 - w + 1):
        a, b = x[i - w : i], x[i : i + w]
        t.append(abs(a.mean() - b.mean()) / np.sqrt(a.var(ddof=1) / w + b.var(ddof=1) / w))
    assert row.detected and row.statistic == pytest.approx(max(t), rel=1e-3)


def test_attribution_of_drift_to_sites(spark):
    rng = np.random.default_rng(11)
    rows = []
    for name, steps in (("shared", (6, 6, 6)), ("own", (6, -6, 0)), ("none", (0, 0, 0))):
        for k, step in enumerate(steps):
            rows += [(name, 100 * k + i, START + timedelta(hours=i), f"site{k}", float(100 + rng.normal() + (step if i >= 30 else 0))) for i in range(60)]
    got = by_name(sites.study(spark.createDataFrame(rows, "series string, seq long, ts timestamp_ntz, site string, value double")))
    assert got["shared"].attribution == "global" and got["shared"].concordance == 1.0 and got["none"].sites_drifting <= 1
    assert got["own"].sites_drifting >= 2 and got["own"].concordance == 0.5 and got["own"].attribution in ("site_specific", "mixed")
    assert number(spark, sites.chi2_tail(F.lit(9.488), F.lit(4))) == pytest.approx(0.05, abs=2e-3) and number(spark, sites.chi2_tail(F.lit(0.0), F.lit(1))) == 1.0
    assert {r.kind for r in reconstruction.study_story(sites.study(spark.createDataFrame(rows, "series string, seq long, ts timestamp_ntz, site string, value double"))).collect()} <= {"stable", "drift", "shift", "changepoint"}


def test_lots(spark):
    rng = np.random.default_rng(12)
    rows = [("two", "AB"[i % 2], float(rng.normal() + i % 2 * 3)) for i in range(60)] + [("three", "ABC"[i % 3], float(rng.normal())) for i in range(60)] + [("one", "A", 1.0)] * 9
    df = spark.createDataFrame(rows, "series string, reagent_lot string, value double")
    got = by_name(comparison.compare_lots(comparison.lots_of(df, "lot", "reagent_lot")))
    assert set(got) == {"two", "three"} and got["two"].ks > 0.6 and got["two"].shift_suspected and got["three"].ks is None


def test_simulations_carry_their_truth(spark):
    df = simulated_assays(spark, 400, ("none", "step", "outliers", "lot", "batch"), copies=2, lots=2, instruments=2)
    assert df.count() == 4000 and df.where("is_outlier").where("series not like 'outliers%'").count() == 0 and df.where("is_outlier").count() > 2
    off = df.where("series like 'step%' and seq >= 200").agg(F.avg(F.col("value") - 100)).first()[0]
    assert abs(off - 8) < 0.5 and df.agg(F.stddev("value")).first()[0] < 6
    year = showcase(spark)
    assert year.count() == 1460 and year.where("failed").count() == 5 and year.select("lot").distinct().count() == 3


def test_detectors_are_scored(spark):
    df = simulated_assays(spark, 160, ("none",), copies=6).select("series", "seq", "ts", "value")
    row = one(evaluation.evaluate(df, ("likelihood",)))
    assert row.sensitivity >= 0.5 and row.false_positive_rate <= 0.5 and row.series == 6

    class Threshold(detectors.Detector):
        """A detector of one's own: far from 100."""

        def step(self, state, x):
            return abs(x - 100) > 9, 0.9, abs(x - 100), "increase" if x > 100 else "decrease"

    own = one(evaluation.evaluate_detector(df, Threshold(), size=6.0))
    assert own.method == "Threshold" and own.sensitivity == 1.0 and own.false_positive_rate < 0.5


def test_report_and_reconstruction(spark):
    rng = np.random.default_rng(13)
    rows = [("A", i, START + timedelta(hours=i), float(100 + rng.normal() + 6 * (i >= 60)), i % 5 == 0, "L1" if i < 60 else "L2", "xy"[i % 2]) for i in range(120)]
    rows += [("flat", i, START + timedelta(hours=i), 5.0, i % 5 == 0, "L1", "x") for i in range(40)] + [("few", 0, START, 1.0, True, None, None)]
    df = spark.createDataFrame(rows, "series string, seq long, ts timestamp_ntz, value double, control boolean, lot string, instrument string")
    reports = composite.analyze(df, lot="lot")
    got = by_name(reports)
    assert got["A"].drift and got["A"].change and got["A"].associated_event == "L1 to L2" and got["A"].status != "stable" and got["A"].limitations[0] == composite.SAFETY
    assert not got["flat"].drift and got["flat"].status == "stable" and got["few"].n == 1
    assert {r.step for r in composite.provenance(df, reports).collect()} >= {"ingest", "drift", "report"}
    told = by_name(reconstruction.reconstruct(df))
    assert "Reagent lot changed (L1 to L2)" in told["A"].narrative and told["A"].lot_shift and told["A"].instruments == 2 and told["A"].lots == 2 and told["flat"].lots is None
    words = story.explained(reports).collect()
    assert all(r.explanation.startswith("Status") for r in words)
    panel = reconstruction.panel_story(reports.withColumn("panel", F.lit("p")), "panel").collect()
    assert len(panel) == 4 and panel[0].basis == "observed"
    assert "found changes" in one(story.explained_changes(change_points.likelihood(df.where("series = 'A'")))).explanation
    assert "drift" in one(story.explained_drifts(drift.sudden(df.where("series = 'A'")))).explanation


def test_studies_on_a_stream_and_callbacks(spark, tmp_path):
    base = {"n": 30, "mean": 100.0, "sd": 1.0}
    rows = [("study", i, START + timedelta(minutes=i // 2), "ab"[i % 2], 130.0) for i in range(80)]
    df = spark.createDataFrame(rows, "series string, seq long, ts timestamp_ntz, site string, value double")
    df.write.parquet(str(tmp_path / "rows"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "rows"))
    seen = []
    query = detectors.on_alert(detectors.streamed_concordance(stream, detectors.Cusum(baseline=base)), lambda batch: seen.extend(batch.collect()), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert seen == detectors.concordance(df, detectors.Cusum(baseline=base)).collect() and len(seen) == 1


def test_adjusted_p_values_over_ranges(spark):
    p = np.sort(np.random.default_rng(14).random(500)) ** 2
    p[:3] = 0.0
    df = spark.createDataFrame([(f"s{i:03d}", float(v)) for i, v in enumerate(p)], "series string, p double")
    want = np.minimum.accumulate((p * 500 / np.arange(1, 501))[::-1])[::-1]
    got = {r.series: r.q for r in basics.bh_adjusted(df, parts=7).collect()}
    assert np.allclose([got[f"s{i:03d}"] for i in range(500)], np.minimum(want, 1))
