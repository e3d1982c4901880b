"""Streams out of order against the table; stretches against single values; detectors seeded by moments."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlake.streaming import detectors, event_time
from driftlake.streaming.detectors import Cusum, Ewma

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "series string, seq long, ts timestamp_ntz, value double, site string"


def one_by_one(detector, x):
    state = detector.start()
    return [detector.step(state, v) for v in x.tolist()], state


@pytest.mark.parametrize("detector", [Cusum(), Cusum(persistence=1), Cusum(persistence=4, h=2), Cusum(baseline={"n": 20, "mean": 0.0, "sd": 1.0}), Ewma(), Ewma(baseline={"n": 9, "mean": 0.1, "sd": 2.0})])
def test_stretches_give_what_single_values_give(detector):
    rng = np.random.default_rng(0)
    steps = np.repeat(3 * rng.normal(size=301), 10)[:3000]
    for x in (rng.normal(size=1), rng.normal(size=2), rng.normal(size=5000), rng.normal(size=3000) + steps, np.full(2000, 5.0), np.concatenate([np.zeros(50), 9 + rng.normal(size=500), rng.normal(size=900)])):
        want, end = one_by_one(detector, x)
        state, parts, cuts = detector.start(), [], sorted(rng.integers(0, len(x) + 1, 3).tolist())
        for a, b in zip([0, *cuts], [*cuts, len(x)]):
            parts.append(detector.steps(state, x[a:b]))
        hit, probability, size, way = (np.concatenate(p).tolist() for p in zip(*parts))
        assert [w[0] for w in want] == hit and [w[1] for w in want] == probability and [w[3] for w in want] == way
        assert [w[2] for w in want] == pytest.approx(size, abs=1e-8)
        assert {k: v if isinstance(v, str) else pytest.approx(v, abs=1e-8) for k, v in state.items()} == end


def test_a_million_values():
    x = np.random.default_rng(3).normal(size=1_000_000)
    for detector in (Cusum(), Ewma()):
        want, _ = one_by_one(detector, x)
        hit, _, size, _ = detector.steps(detector.start(), x)
        assert hit.tolist() == [w[0] for w in want] and np.abs(size - [w[2] for w in want]).max() < 1e-8


def test_moments_seed_a_detector():
    """A detector that starts from the moments of the past equals one that has learned it."""
    rng = np.random.default_rng(5)
    past, now = rng.normal(size=400), 1.0 + rng.normal(size=300)
    state = Cusum(h=1e9).start()
    Cusum(h=1e9).steps(state, past)  # learns all
    seeded = Cusum(baseline={"n": len(past), "mean": past.mean(), "m2": ((past - past.mean()) ** 2).sum()})
    a = Cusum().steps({**state, "up": 0.0, "down": 0.0}, now)
    b = seeded.steps(seeded.start(), now)
    assert a[0].tolist() == b[0].tolist() and a[2] == pytest.approx(b[2]) and a[0].any()


def rows_of_three_series():
    rng, rows = np.random.default_rng(7), []
    for s, name in enumerate("abc"):
        for i in range(200):
            x = rng.normal() + (4 if 80 < i < 90 else 0)
            rows.append((name, 1000 * s + i, T0 + dt.timedelta(hours=i // 2), None if i % 41 == 5 else math.nan if i % 53 == 7 else x, f"site{i % 3}"))
    return rows


def streamed(spark, tmp_path, batches, work, end=True):
    """Rows that come out when the batches arrive one after the other, and at last a sign of life far ahead."""
    for k, v in event_time.ROCKS.items():
        spark.conf.set(k, v)
    try:
        out = None
        for batch in [*batches, *([[(None, 0, T0 + dt.timedelta(days=9999), None, None)]] if end else [])]:
            spark.createDataFrame(batch, SCHEMA).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
            out = work(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
            q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            q.awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect())
    finally:
        for k in event_time.ROCKS:
            spark.conf.unset(k)


def shuffled(rows, parts, seed=1):
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    return [[rows[k] for k in order[p::parts]] for p in range(parts)]


@pytest.mark.parametrize("kind", ["detected", "alerted", "agreed"])
def test_three_shuffled_batches_give_the_table(spark, tmp_path, kind):
    rows = rows_of_three_series()
    table = spark.createDataFrame(rows, SCHEMA)
    plain = {"detected": detectors.replayed, "alerted": detectors.alerts, "agreed": detectors.concordance}[kind]
    want = sorted((*r, False) for r in plain(table, Cusum(persistence=1)).collect())
    got = streamed(spark, tmp_path, shuffled(rows, 3), lambda s: getattr(event_time, kind)(s, Cusum(persistence=1), lateness="300 hours"))
    shown = lambda rows: [tuple(round(c, 9) if isinstance(c, float) else c for c in r) for r in rows]
    assert shown(got) == shown(want) and want


def test_late_rows_come_out_marked_and_change_nothing(spark, tmp_path):
    rows = rows_of_three_series()
    first, then = [r for r in rows if r[1] % 1000 < 150], [r for r in rows if r[1] % 1000 >= 150]
    late = [("a", 5000 + k, T0 + dt.timedelta(hours=k), 50.0, "site0") for k in range(10)] + [("b", 6000, None, 50.0, "site0")]
    got = streamed(spark, tmp_path, [first, late + then], lambda s: event_time.detected(s, Cusum(), lateness="2 hours"))
    want = sorted((*r, False) for r in detectors.replayed(spark.createDataFrame(rows, SCHEMA), Cusum()).collect())
    shown = lambda rows: [tuple(round(c, 9) if isinstance(c, float) else c for c in r) for r in rows]
    assert shown(r for r in got if not r[-1]) == shown(want)
    assert sorted(r[1] for r in got if r[-1]) == [r[1] for r in late] and all(r[3] is None for r in got if r[-1])


def test_a_seeded_stream_equals_one_that_saw_the_past(spark, tmp_path):
    """The past's moments as the first state, over a table and over a stream, against one that learned it value by value."""
    rng = np.random.default_rng(9)
    rows = [(name, i, T0 + dt.timedelta(hours=i), float(rng.normal() + (3 if i > 150 else 0)), None) for name in ("a", "b") for i in range(200)]
    past, now = [r for r in rows if r[1] < 100], [r for r in rows if r[1] >= 100] + [("new", i, T0 + dt.timedelta(hours=i), float(i % 7), None) for i in range(60)]
    seeds = detectors.moments(spark.createDataFrame(past, SCHEMA))
    detector = Cusum(h=4.0)
    want = []
    for name in ("a", "b", "new"):
        x = np.array([r[3] for r in past if r[0] == name])
        state = detector.seeded(len(x), float(x.mean()), float(((x - x.mean()) ** 2).sum())) if len(x) else detector.start()
        own = [r for r in now if r[0] == name]
        want += [(name, r[1], r[2], *detector.step(state, r[3])) for r in own]
    shown = lambda rows: sorted(tuple(round(c, 9) if isinstance(c, float) else c for c in r) for r in rows)
    assert shown(detectors.replayed(spark.createDataFrame(now, SCHEMA), detector, seeds).collect()) == shown(want)
    got = streamed(spark, tmp_path, shuffled(now, 2), lambda s: event_time.detected(s, detector, lateness="900 hours", seeds=seeds))
    assert shown(r[:-1] for r in got) == shown(want) and not any(r[-1] for r in got)


def test_detectors_scored_on_simulated_truth(spark):
    from driftlake.operators import evaluation

    found = {r.method: r for r in evaluation.evaluate_simulated(spark, ("cusum", "likelihood"), n=300, drift_start=200, copies=6).collect()}
    for r in found.values():
        assert r.sensitivity == 1.0 and r.mean_delay <= 20
    own = evaluation.evaluate_simulated_detector(spark, Cusum(), n=300, drift_start=200, copies=6).first()
    assert own.sensitivity == 1.0 and own.series == 6 and 0 <= own.mean_delay < 10
    blind = evaluation.evaluate_simulated_detector(spark, Cusum(h=1e9), n=300, drift_start=200, copies=6).first()
    assert blind.sensitivity == 0.0 and blind.false_positive_rate == 0.0
