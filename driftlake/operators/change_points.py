"""Change-point detectors; each gives one row a series. Values that are missing take no part; `indices` count from 1 among
all rows of a series, missing ones included, so they are places of the input.

Scans that are sums over prefixes are window expressions in two levels (`running`), CUSUM with resets is an ordered pass of
constant memory over Arrow batches, and dynamic programmes (PELT, the product partition) take a series' values as one array.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftlake.functions.columns import t_two_sided
from driftlake.operators.basics import excess_kurtosis, missing_fraction, regular_cadence, robust_mad, standardized
from driftlake.operators.series import blanked, in_order, kept, per_series, running, valid, with_stats

RESULT = "method string, detected boolean, indices array<bigint>, statistic double, confidence double"


def cusum_alarms(df: DataFrame, k: float = 0.5, h: float = 5.0, robust: bool = False) -> DataFrame:
    """(series, i): the places at which two-sided CUSUM of standardised values crosses h and starts again."""
    z = standardized(df, gaps=True)
    if robust:  # standardised again, by median and MAD first: the second step undoes the first one's scale
        z = standardized(standardized(df, robust=True, gaps=True).withColumn("value", F.col("z")).drop("z"), gaps=True)

    kind = dict(df.dtypes)["series"]

    def alarm(state: dict, x: np.ndarray) -> dict[str, np.ndarray]:
        there, before = np.flatnonzero(np.isfinite(x)), state["i"]
        found = crossings(x[there], k, h, state)["i"]
        at = state["rows"] + there[found - before - 1] + 1
        state["rows"] += len(x)
        return {"i": at}

    return in_order(z.withColumn("value", F.col("z")), lambda: {"i": 0, "rows": 0, "up": 0.0, "down": 0.0}, alarm, f"series {kind}, i bigint")


def crossings(x: np.ndarray, k: float, h: float, state: dict, first: int = 64) -> dict[str, np.ndarray]:
    """The places at which two-sided CUSUM of x crosses h and starts again; state goes on from call to call.

    Between alarms a sum held at 0 is the running sum less its least value so far, so whole stretches are looked at at a
    time: a short one after an alarm, then longer ones."""
    found, at, step = [], 0, first
    while at < len(x):
        part = x[at : at + step]
        sums = []
        for sign, held in ((1.0, state["up"]), (-1.0, state["down"])):
            total = np.cumsum(sign * part - k)
            sums.append(total - np.minimum(np.minimum.accumulate(total), -held))
        over = np.flatnonzero((sums[0] > h) | (sums[1] > h))
        if len(over):
            at, step = at + int(over[0]) + 1, first
            found.append(state["i"] + at)
            state["up"] = state["down"] = 0.0
        else:
            at, step = at + len(part), step * 2
            state["up"], state["down"] = float(sums[0][-1]), float(sums[1][-1])
    state["i"] += len(x)
    return {"i": np.array(found, np.int64)}


def first_largest(df: DataFrame, statistic: Column, *more: str) -> DataFrame:
    """The row of the largest statistic of each series, the first of equals."""
    best = Window.partitionBy("series").orderBy(F.desc_nulls_last("_stat"), "i")
    return df.withColumn("_stat", statistic).withColumn("_r", F.row_number().over(best)).where("_r = 1").select("series", "i", F.col("_stat").alias("statistic"), *more)


def cusum(df: DataFrame, k: float = 0.5, h: float = 5.0, robust: bool = False) -> DataFrame:
    """Alarms of CUSUM and the peak of the path of centred sums."""
    values = standardized(df, robust=True, gaps=True).withColumn("value", F.col("z")).drop("z") if robust else blanked(df)
    path = running(with_stats(values, _m=F.avg("value")), {"s": F.col("value") - F.col("_m")}, gaps=True)
    peak = first_largest(path, F.round(F.abs("s"), 9), "place")
    scale = path.groupBy("series").agg(F.stddev_samp("s").alias("sd"), F.count("*").alias("n"))
    alarms = cusum_alarms(df, k, h, robust).groupBy("series").agg(F.array_sort(F.collect_list("i")).alias("alarms"))
    out = peak.join(scale, "series").join(alarms, "series", "left").withColumn("alarms", F.coalesce("alarms", F.array().cast("array<bigint>")))
    n = F.size("alarms")
    detected = (F.col("n") >= 8) & ((n > 0) | (F.col("statistic") > 2 * F.col("sd")))
    confidence = F.when(detected, F.least(F.lit(0.99), 0.55 + 0.08 * n + 0.1 * F.col("statistic") / (F.col("sd") + 2.0**-52))).otherwise(0.2)
    indices = F.when(detected, F.array_sort(F.array_union("alarms", F.array(F.col("place").cast("bigint"))))).otherwise(F.array().cast("array<bigint>"))
    return out.select("series", F.lit("robust_median" if robust else "cusum").alias("method"), detected.alias("detected"), indices.alias("indices"), "statistic", confidence.alias("confidence"))


def robust_median(df: DataFrame) -> DataFrame:
    return cusum(df, k=0.4, h=4.5, robust=True)


def likelihood(df: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """The Gaussian likelihood-ratio scan of one change of mean, from prefix sums of centred values. sums: (series, i, n, s1,
    s2, place), where they are at hand."""
    if sums is None:
        own = with_stats(blanked(df), _m=F.avg("value"))
        d = F.col("value") - F.col("_m")
        sums = running(own, {"s1": d, "s2": d * d}, gaps=True)
    ends = sums.groupBy("series").agg(F.sum(F.when(F.col("i") == F.col("n"), F.col("s1"))).alias("t1"), F.max("s2").alias("t2"))
    n, i = F.col("n"), F.col("i")
    ss = F.col("t2") - F.col("s1") ** 2 / i - (F.col("t1") - F.col("s1")) ** 2 / F.nullif(n - i, F.lit(0))
    lr = F.when((i >= 2) & (i <= n - 2) & (ss > 0) & (F.col("t2") > 0), n / 2.0 * F.ln(F.when(ss > 0, F.col("t2") / ss)))
    best = first_largest(sums.join(ends, "series"), F.round(lr, 9), "n", "place")
    detected = (n >= 8) & F.coalesce(F.col("statistic") > F.ln(n.cast("double")) + 1.5, F.lit(False))
    confidence = F.when(detected, F.least(F.lit(0.99), 1 - F.exp(-F.greatest(F.col("statistic") - F.ln(n.cast("double")), F.lit(0.0)) / 4))).otherwise(0.15)
    return best.select("series", F.lit("likelihood").alias("method"), detected.alias("detected"), F.when(detected, F.array(F.col("place").cast("bigint"))).otherwise(F.array().cast("array<bigint>")).alias("indices"), "statistic", confidence.alias("confidence"))


def rolling(df: DataFrame, window: int | None = None) -> DataFrame:
    """The place at which Welch's test between the windows before and after it has the least p-value. A window has an
    eighth of a series' values, 8 at least, unless its size is given.

    One ordered pass makes sums over the two windows of each place from differences of running sums; of a series it holds
    what the two windows hold."""
    own = with_stats(blanked(df), _m=F.avg("value"), n=F.count("value"))
    size = F.lit(window).cast("bigint") if window else F.greatest(F.lit(8), F.floor(F.col("n") / 8)).cast("bigint")
    own = own.select("series", "seq", "ts", (F.col("value") - F.col("_m")).alias("value"), size.alias("w"))

    def windows(state: dict, x: np.ndarray) -> dict[str, np.ndarray]:
        w, there = state["w"], np.flatnonzero(np.isfinite(x))
        place = np.concatenate([state["place"], state["rows"] + there + 1])
        state["rows"] += len(x)
        s1, s2 = (np.concatenate([s, s[-1] + np.cumsum(v)]) for s, v in ((state["s1"], x[there]), (state["s2"], x[there] ** 2)))
        # s1[k] is the sum up to the k-th value since the first one kept; a place is the end of its left window
        middle = np.arange(w, len(s1) - w)
        out = {"place": place[middle - 1], "w": np.full(len(middle), w)}
        for name, a, b in (("l", middle - w, middle), ("r", middle, middle + w)):
            mean = (s1[b] - s1[a]) / w
            out |= {f"m{name}": mean, f"v{name}": np.maximum(s2[b] - s2[a] - w * mean * mean, 0.0) / max(1, w - 1)}
        first = max(0, len(s1) - 2 * w)  # the next place needs the sums from here on
        state |= {"place": place[first:], "s1": s1[first:] - s1[first], "s2": s2[first:] - s2[first]}
        return out

    start = lambda w: {"w": w, "rows": 0, "place": np.zeros(0, np.int64), "s1": np.zeros(1), "s2": np.zeros(1)}
    series, sums = own, in_order(own, start, windows, "place bigint, w bigint, ml double, vl double, mr double, vr double", seed=("w",))
    own, w = sums.withColumn("i", F.col("place")), F.col("w")
    se = (F.col("vl") + F.col("vr")) / w
    some = se > 1e-18 * (F.abs("ml") + F.abs("mr") + 1e-300)
    t = F.when(some, (F.col("ml") - F.col("mr")) / F.sqrt(F.when(some, se))).otherwise(0.0)
    dof = F.when(some, se * se * (w - 1) / F.nullif((F.col("vl") / w) ** 2 + (F.col("vr") / w) ** 2, F.lit(0.0))).otherwise(1.0)
    own = own.withColumn("t", t).withColumn("dof", dof)
    own = own.withColumn("p", F.when(F.col("t") != 0, t_two_sided(F.col("t"), F.col("dof"))).otherwise(1.0))
    best = first_largest(own, -F.round("p", 12), "place", "t", "p").select("series", "place", "t", "p")
    out = series.where("value is not null").select("series").distinct().join(best, "series", "left")
    detected = F.coalesce(F.col("p") < 0.01, F.lit(False))
    return out.select(
        "series", F.lit("rolling").alias("method"), detected.alias("detected"), F.when(detected, F.array(F.col("place").cast("bigint"))).otherwise(F.array().cast("array<bigint>")).alias("indices"),
        F.coalesce(F.abs("t"), F.lit(0.0)).alias("statistic"), F.when(detected, 1 - F.col("p")).otherwise(0.2).alias("confidence"),
    )


def _standard(x: np.ndarray) -> np.ndarray:
    sd = x.std(ddof=1) if len(x) > 1 else 0.0
    return (x - x.mean()) / (sd if np.isfinite(sd) and sd > 0 else 1.0)


def pelt_of(x: np.ndarray, min_size: int = 8) -> tuple[list[int], float]:
    """Ends of all but the last segment of the best piecewise constant mean with penalty 3 log n, and minus its cost."""
    n = len(x)
    penalty = 3 * np.log(n)
    z = _standard(x)
    s1, s2 = np.concatenate([[0.0], np.cumsum(z)]), np.concatenate([[0.0], np.cumsum(z * z)])
    cost, last = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    cost[0] = -penalty
    alive = np.array([0])
    for end in range(1, n + 1):
        parts = cost[alive] + (s2[end] - s2[alive]) - (s1[end] - s1[alive]) ** 2 / (end - alive)
        usable = (alive == 0) | (end - alive >= min_size)
        if usable.any():
            k = int(np.where(usable, parts, np.inf).argmin())
            cost[end], last[end] = parts[k] + penalty, alive[k]
        else:
            cost[end], last[end] = cost[0] + s2[end] - s1[end] ** 2 / end + penalty, 0
        alive = np.append(alive[parts <= cost[end]], end)
    ends, at = [], n
    while last[at] > 0:
        at = int(last[at])
        ends.append(at)
    return ends[::-1], -float(cost[n])


def _result(method: str, detected: bool, indices: list[int], statistic: float, confidence: float) -> dict:
    return {"method": method, "detected": bool(detected), "indices": [int(i) for i in indices], "statistic": float(statistic), "confidence": float(confidence)}


def pelt(df: DataFrame, min_size: int = 8) -> DataFrame:
    """Several changes of mean by pruned exact linear time."""

    def work(x: np.ndarray) -> dict:
        if len(x) < 8:
            return _result("pelt", False, [], 0.0, 0.0)
        found, statistic = pelt_of(x, min_size)
        return _result("pelt", bool(found), found, statistic, min(0.95, 0.6 + 0.1 * len(found)) if found else 0.2)

    return per_series(blanked(df), work, RESULT)


def product_partition(x: np.ndarray, min_size: int = 8) -> tuple[list[int], np.ndarray]:
    """Posterior mass of a change after each place, and its peaks of at least 0.08 that lie min_size apart.

    Segments have Gaussian values of known variance about a mean with a wide Gaussian prior; changes come with a constant
    hazard. Forward and backward sums over segments, in logarithms."""
    n = len(x)
    hazard = min(0.2, max(1 / np.sqrt(n), 2 / n))
    var, mu0, k0 = float(x.var(ddof=1)), float(x.mean()), 0.01
    var = var if np.isfinite(var) and var > 0 else 1.0
    c1, c2 = np.concatenate([[0.0], np.cumsum(x - mu0)]), np.concatenate([[0.0], np.cumsum((x - mu0) ** 2)])

    def segment(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        m = b - a
        s1, s2 = c1[b] - c1[a], c2[b] - c2[a]
        return -0.5 * m * np.log(2 * np.pi * var) + 0.5 * np.log(k0 / (k0 + m)) - (s2 - s1 * s1 / (k0 + m)) / (2 * var)

    def total(v: np.ndarray) -> float:
        top = v.max()
        return float(top + np.log(np.exp(v - top).sum())) if np.isfinite(top) else -np.inf

    go, stay = np.log(hazard), np.log1p(-hazard)
    forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    forward[0] = backward[n] = 0.0
    for b in range(min_size, n + 1):
        a = np.arange(0, b - min_size + 1)
        forward[b] = total(forward[a] + segment(a, np.full(len(a), b)) + (b - a - 1) * stay + np.where(a > 0, go, 0.0))
    for a in range(n - min_size, -1, -1):
        b = np.arange(a + min_size, n + 1)
        backward[a] = total(backward[b] + segment(np.full(len(b), a), b) + (b - a - 1) * stay + np.where(b < n, go, 0.0))
    mass = np.zeros(n)
    inner = np.arange(min_size, n - min_size + 1)
    if len(inner):
        logs = forward[inner] + backward[inner] + go
        own = np.exp(logs - forward[n])
        mass[inner - 1] = own / own.sum() if own.sum() > 0 else 0.0
    peaks, taken = [], np.zeros(n, bool)
    for i in np.argsort(-mass, kind="stable"):
        if mass[i] < 0.08:
            break
        if not taken[i]:
            peaks.append(int(i) + 1)
            taken[max(0, i - min_size + 1) : i + min_size] = True
    return sorted(peaks), mass


def bayesian(df: DataFrame, min_size: int = 8) -> DataFrame:
    """Changes of mean by the product partition model. Its time grows with the square of a series' length (a minute for
    some 50,000 values), its memory with the length; no series is refused or sampled."""

    def work(x: np.ndarray) -> dict:
        if len(x) < max(8, 2 * min_size):
            return _result("bayesian", False, [], 0.0, 0.0)
        found, mass = product_partition(x, min_size)
        return _result("bayesian", bool(found), found, mass.max(), mass.max() if found else 0.2)

    return per_series(blanked(df), work, RESULT)


def energy_of(a: np.ndarray, b: np.ndarray) -> float:
    """Energy distance from sorted values."""
    pool = np.sort(np.concatenate([a, b]))
    fa, fb = np.searchsorted(np.sort(a), pool, "right") / len(a), np.searchsorted(np.sort(b), pool, "right") / len(b)
    return float(2 * ((fa - fb)[:-1] ** 2 * np.diff(pool)).sum())


def kernel(df: DataFrame) -> DataFrame:
    """The split of largest energy distance among at most about eighty, against that of the middle."""

    def work(x: np.ndarray) -> dict:
        n = len(x)
        splits = range(10, n - 9, max(1, n // 80))
        if not len(splits):
            return _result("kernel", False, [], float("-inf"), 0.2)
        found = [energy_of(x[:t], x[t:]) for t in splits]
        best = int(np.argmax(found))
        middle = energy_of(x[: n // 2], x[n // 2 :])
        hit = found[best] > 1.8 * max(middle, np.finfo(float).eps) and found[best] > 0
        return _result("kernel", hit, [splits[best]] if hit else [], found[best], min(0.9, 0.5 + found[best] / (found[best] + middle + 1)) if hit else 0.2)

    return per_series(blanked(df), work, RESULT)


def metropolis_of(x: np.ndarray, samples: int = 400, seed: int = 7) -> tuple[int, float]:
    """The most frequent single cut of a Metropolis chain over (cut, two means), and its share."""
    rng, n = np.random.default_rng(seed), len(x)
    z = _standard(x)
    s1, s2 = np.concatenate([[0.0], np.cumsum(z)]), np.concatenate([[0.0], np.cumsum(z * z)])

    def fit(t: int) -> float:
        left, right = s2[t] - s1[t] ** 2 / t, s2[n] - s2[t] - (s1[n] - s1[t]) ** 2 / (n - t)
        return -0.5 * n * np.log(max(left + right, 1e-12))

    cut = int(rng.integers(4, n - 3))
    here, seen = fit(cut), []
    for k in range(samples * 5):
        to = int(rng.integers(4, n - 3)) if rng.random() < 0.3 else cut + int(rng.integers(-3, 4))
        if 4 <= to <= n - 4:
            there = fit(to)
            if np.log(rng.random()) < there - here:
                cut, here = to, there
        if k >= samples and k % 4 == 0:
            seen.append(cut)
    values, counts = np.unique(seen, return_counts=True)
    return int(values[counts.argmax()]), float(counts.max() / len(seen))


def sampled_cut(df: DataFrame, samples: int = 400, seed: int = 7) -> DataFrame:
    """A single cut by posterior sampling, with a stated seed."""

    def work(x: np.ndarray) -> dict:
        if len(x) < 8:
            return _result("sampled", False, [], 0.0, 0.0)
        cut, mass = metropolis_of(x, samples, seed)
        return _result("sampled", mass >= 0.08, [cut] if mass >= 0.08 else [], mass, mass)

    return per_series(blanked(df), work, RESULT)


def features(df: DataFrame, has_controls: bool = False) -> DataFrame:
    """What the choice of a detector rests on, one row a series, and the detector chosen. A series has controls if its
    column `control` says so anywhere, or by has_controls."""
    own = valid(df)
    controlled = F.coalesce(F.max(F.col("control").cast("boolean")), F.lit(False)) if "control" in df.columns else F.lit(has_controls)
    base = df.groupBy("series").agg(missing_fraction(F.col("value")).alias("missing"), controlled.alias("controlled"))
    shape = own.groupBy("series").agg(F.count("*").alias("n"), excess_kurtosis(F.col("value")).alias("kurtosis"), F.stddev_samp("value").alias("sd"))
    alarms = cusum_alarms(df).groupBy("series").agg(F.count("*").alias("alarms"))
    out = base.join(shape, "series", "left").join(robust_mad(own), "series", "left").join(regular_cadence(own).select("series", "regular"), "series", "left").join(alarms, "series", "left")
    out = out.fillna({"n": 0, "kurtosis": 0.0, "alarms": 0, "regular": False})
    n, heavy = F.col("n"), (F.col("kurtosis") > 2.5) | F.coalesce((F.col("mad") > 0) & (F.col("sd") / F.nullif(F.col("mad"), F.lit(0.0)) > 1.6), F.lit(False))
    rules = (
        (n < 20, "robust_median", "few values"), (F.col("missing") > 0.15, "robust_median", "many missing values"), (~F.col("regular") & (n < 80), "robust_median", "irregular times"),
        (heavy, "robust_median", "heavy tails"), ((n >= 80) & (F.col("alarms") >= 2), "pelt", "several alarms"), (F.col("controlled") & (n < 400), "likelihood", "controls and moderate length"),
        ((n >= 80) & (n < 400) & F.col("regular"), "bayesian", "regular times and moderate length"), (n >= 400, "pelt", "a long series"),
    )
    method, reason = F.lit("cusum"), F.lit("no other rule holds")
    for condition, name, why in reversed(rules):
        method, reason = F.when(condition, name).otherwise(method), F.when(condition, why).otherwise(reason)
    return out.withColumn("method", method).withColumn("reason", reason).drop("controlled")


METHODS = {"cusum": cusum, "likelihood": likelihood, "pelt": pelt, "robust_median": robust_median, "rolling": rolling, "bayesian": bayesian, "kernel": kernel, "sampled": sampled_cut}


def detect_changes(df: DataFrame, method: str = "auto", has_controls: bool = False, chosen: DataFrame | None = None) -> DataFrame:
    """Results of one method, or of the one chosen for each series; series of fewer than 8 values are not detected.

    chosen: `features` of df, where they are at hand."""
    if method != "auto":
        if method not in METHODS:
            raise ValueError(f"no change-point method {method!r}")
        return METHODS[method](df)
    chosen = kept(features(df, has_controls), "chosen-detectors") if chosen is None else chosen  # one row a series
    names = [r["method"] for r in chosen.select("method").distinct().collect()]  # as many as there are methods
    routed = df.join(chosen.select("series", F.col("method").alias("_chosen")), "series")
    out = None
    for name in sorted(names) or ["cusum"]:
        own = METHODS[name](routed.where(F.col("_chosen") == name).drop("_chosen"))
        out = own if out is None else out.unionByName(own)
    return out
