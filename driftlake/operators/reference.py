"""Reference intervals, partitions and curves. Statistical limits only, not clinical decision limits."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftlake.functions.columns import boxcox, finite, inv_boxcox, lms_quantile, normal_quantile
from driftlake.operators import two_sample as ts
from driftlake.operators.basics import boxcox_lambda
from driftlake.operators.series import kept, median_deviations, percentiles, ranked, with_percentiles, with_stats

METHODS = ("nonparametric", "parametric", "robust", "transformed", "boxcox", "horn", "lms")


def _q(p: float, c: str | Column = "value") -> Column:
    return F.percentile(c, F.lit(p))


def reference_interval(df: DataFrame, method: str = "nonparametric") -> DataFrame:
    """(series, method, n, lower, upper) of series with twenty finite values at least. Methods that take logarithms or
    powers need positive values: series with others are left out."""
    own = df.where(finite(F.col("value"))).select("series", "value")
    own = with_stats(own, n=F.count("*"), _low=F.min("value")).where("n >= 20")
    if method in ("transformed", "boxcox", "lms"):
        own = own.where("_low > 0")
    n = F.first("n").alias("n")
    sizes = own.groupBy("series").agg(n)
    if method == "nonparametric":
        out = sizes.join(percentiles(own, ("series",), "value", lower=0.025, upper=0.975), "series")
    elif method == "parametric":
        m, s = F.avg("value"), F.stddev_samp("value")
        out = own.groupBy("series").agg(n, (m - 1.96 * s).alias("lower"), (m + 1.96 * s).alias("upper"))
    elif method == "robust":
        found = sizes.join(median_deviations(own), "series")
        out = found.select("series", "n", (F.col("med") - 1.96 * F.col("mad")).alias("lower"), (F.col("med") + 1.96 * F.col("mad")).alias("upper"))
    elif method == "transformed":
        m, s = F.avg(F.ln("value")), F.stddev_samp(F.ln("value"))
        out = own.groupBy("series").agg(n, F.exp(m - 1.96 * s).alias("lower"), F.exp(m + 1.96 * s).alias("upper"))
    elif method == "horn":
        own = with_percentiles(own, _a=0.25, _b=0.75)
        wide = 1.5 * (F.col("_b") - F.col("_a"))
        kept = own.where((F.col("value") >= F.col("_a") - wide) & (F.col("value") <= F.col("_b") + wide))
        out = sizes.join(percentiles(kept, ("series",), "value", lower=0.025, upper=0.975), "series")
    elif method in ("boxcox", "lms"):
        own = own.join(boxcox_lambda(own, "series", "value"), "series")
        if method == "boxcox":
            y = boxcox(F.col("value"), F.col("power"))
            fit = own.groupBy("series").agg(n, F.avg(y).alias("m"), F.stddev_samp(y).alias("s"), F.first("power").alias("power"))
            out = fit.select("series", "n", *(inv_boxcox(F.col("m") + z * F.col("s"), F.col("power")).alias(c) for c, z in (("lower", -1.96), ("upper", 1.96))))
        else:
            own = with_percentiles(own, mu=0.5)
            z = boxcox(F.col("value") / F.col("mu"), F.col("power"))
            fit = own.groupBy("series").agg(n, F.first("mu").alias("mu"), F.stddev_samp(z).alias("s"), F.first("power").alias("power"))
            out = fit.select("series", "n", *(lms_quantile(F.col("mu"), F.col("s"), F.col("power"), F.lit(z)).alias(c) for c, z in (("lower", -1.96), ("upper", 1.96))))
    else:
        raise ValueError(f"no method {method!r}")
    return out.select("series", F.lit(method).alias("method"), "n", "lower", "upper")


def partitions(df: DataFrame) -> DataFrame:
    """(series, groups, z, critical, may_partition) of (series, grp, value): two groups by Harris and Boyd, more by
    Kruskal and Wallis (z is h then, critical null)."""
    own = df.where(finite(F.col("value")))
    g = own.groupBy("series", "grp").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    pair = g.groupBy("series").agg(F.count("*").alias("groups"), F.min_by(F.struct("n", "m", "s"), "grp").alias("a"), F.max_by(F.struct("n", "m", "s"), "grp").alias("b"))
    se = F.sqrt(F.col("a.s") ** 2 / F.col("a.n") + F.col("b.s") ** 2 / F.col("b.n"))
    z = F.coalesce((F.col("a.m") - F.col("b.m")) / F.nullif(se, F.lit(0.0)), F.lit(0.0))
    ratio = F.col("a.s") / F.greatest(F.col("b.s"), F.lit(2.0**-52))
    ratio = F.greatest(ratio, 1 / F.nullif(ratio, F.lit(0.0)))
    critical = 3.0 + 0.3 * (ratio - 1)
    kw = ts.kruskal_wallis(own.select("series", "grp", "value")).select("series", "h", "p")
    two = F.col("groups") == 2
    return pair.join(kw, "series").select("series", "groups", F.when(two, z).otherwise(F.col("h")).alias("z"), F.when(two, critical).alias("critical"), F.when(F.col("groups") < 2, F.lit(False)).when(two, F.abs(z) > critical).otherwise(F.col("p") < 0.01).alias("may_partition"))


def local_windows(parts: pa.Table, span: float, points: int) -> pa.Table:
    """The grid of one series and, for each point, which ranges of the covariate hold its nearest values: `inside` ranges
    with all of theirs, `border` ranges with `missing` more values between them. parts: (series, part, c, low, high)."""
    c, low, high = (parts.column(x).to_numpy() for x in ("c", "low", "high"))
    part, n = parts.column("part").to_numpy(), int(c.sum())
    k, size, first, last = min(points, n), max(8, int(np.rint(n * span))), low.min(), high.max()
    rows = []
    for point in range(k):
        at = first + (last - first) * point / (k - 1)
        far = np.maximum(np.abs(low - at), np.abs(high - at))
        near = np.where((low <= at) & (at <= high), 0.0, np.minimum(np.abs(low - at), np.abs(high - at)))
        # the distance of the last value that counts lies between these two
        least, most = (float(np.sort(d)[np.searchsorted(np.cumsum(c[np.argsort(d, kind="stable")]), size)]) for d in (near, far))
        inside = far < least
        border = ~inside & (near <= most)
        rows.append((point, at, size, size - int(c[inside].sum()), part[inside].tolist(), part[border].tolist()))
    names = ("point", "covariate", "n_local", "missing", "inside", "border")
    kinds = (pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    return pa.table({"series": pa.repeat(parts.column("series")[0], k)} | {x: pa.array(v, t) for x, v, t in zip(names, zip(*rows), kinds)})


def nearest_values(own: DataFrame, span: float, points: int, rows_per_part: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """Grid points (series, point, covariate, n_local) and the values (series, point, value) of the nearest part (span) of
    each series' (seq, covariate, value) rows.

    Rows are dealt out in ranges of the covariate of about equal numbers. A point takes whole ranges by their ends, and
    from the few at its border those that are nearest; of equally near ones the first by covariate and seq. No task holds a
    series, and rows are multiplied only where they are counted."""
    kind = dict(own.dtypes)["series"]
    parts = int(min(2048, max(64, own.count() // rows_per_part)))
    cuts = own.groupBy("series").agg(F.percentile_approx("covariate", [k / parts for k in range(1, parts)], 10 * parts).alias("cuts"))
    # written once: cuts of a sketch need not come out the same again
    dealt = kept(own.join(cuts, "series").withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("covariate")))).drop("cuts"), "curve-values")
    figures = dealt.groupBy("series", "part").agg(F.count("*").alias("c"), F.min("covariate").alias("low"), F.max("covariate").alias("high"))
    schema = f"series {kind}, point int, covariate double, n_local bigint, missing bigint, inside array<int>, border array<int>"
    windows = kept(figures.groupBy("series").applyInArrow(lambda t: local_windows(t, span, points), schema), "curve-windows")
    whole = dealt.join(windows.select("series", "point", F.explode("inside").alias("part")), ["series", "part"]).select("series", "point", "value")
    edge = dealt.withColumnRenamed("covariate", "x").join(windows.select("series", "point", "covariate", "missing", F.explode("border").alias("part")), ["series", "part"])
    nearest = Window.partitionBy("series", "point").orderBy(F.abs(F.col("x") - F.col("covariate")), "x", "seq")
    edge = edge.withColumn("i", F.row_number().over(nearest)).where(F.col("i") <= F.col("missing")).select("series", "point", "value")
    return windows.select("series", "point", "covariate", "n_local"), whole.union(kept(edge, "curve-borders"))


#: Series of so many values at most are bent in one task as arrays.
SMALL = 100_000


def reference_curve(df: DataFrame, quantiles: tuple[float, ...] = (0.025, 0.5, 0.975), span: float = 0.3, points: int = 50, method: str = "quantile") -> DataFrame:
    """(series, point, covariate, n_local, q...): local quantiles of (series, seq, covariate, value) over a grid, from the
    nearest part (span) of the values at each point; by Cole's LMS with method lms, where 8 of them are positive. Series of
    fewer than 30 values have no curve; those of more than SMALL are dealt out in ranges, with the same result."""
    own = df.where(finite(F.col("value")) & finite(F.col("covariate")))
    own = with_stats(own.select("series", "seq", F.col("covariate").cast("double").alias("covariate"), F.col("value").cast("double").alias("value")), _n=F.count("*")).where("_n >= 30")
    names = {q: "q" + str(q).replace(".", "_") for q in quantiles}
    small, large = own.where(F.col("_n") <= SMALL).drop("_n"), own.where(F.col("_n") > SMALL).drop("_n")
    found = _small_curves(small, names, span, points, method)
    return found if large.isEmpty() else found.unionByName(_wide_curves(large, names, span, points, method))


def _small_curves(own: DataFrame, names: dict[float, str], span: float, points: int, method: str) -> DataFrame:
    """Curves of series that fit one task each."""
    power = boxcox_lambda(own, "series", "value") if method == "lms" else own.select("series").distinct().withColumn("power", F.lit(None).cast("double"))
    normal = [r[0] for r in own.sparkSession.range(1).select(F.explode(F.array(*[normal_quantile(F.lit(q)) for q in names]))).collect()]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("covariate", "ascending"), ("seq", "ascending")])
        x, y, p = t.column("covariate").to_numpy(), t.column("value").to_numpy(), t.column("power")[0].as_py()
        n, k = len(x), min(points, len(x))
        size, rows = max(8, int(np.rint(n * span))), []
        for point in range(k):
            at = x[0] + (x[-1] - x[0]) * point / (k - 1)
            away = np.abs(x - at)
            edge = np.partition(away, size - 1)[size - 1]
            inside = np.flatnonzero(away < edge)
            # of those just at the edge the first by covariate and seq
            local = y[np.concatenate([inside, np.flatnonzero(away == edge)[: size - len(inside)]])]
            positive = local[local > 0]
            if method == "lms" and len(positive) >= 8:
                mu = float(np.median(positive))
                z = np.log(positive / mu) if abs(p) < 1e-8 else ((positive / mu) ** p - 1) / p
                s = float(z.std(ddof=1))
                s = s if np.isfinite(s) and s > 0 else 0.1
                rows.append((point, at, len(positive), *(_lms(mu, s, p, v) for v in normal)))
            else:
                rows.append((point, at, len(local), *np.quantile(local, list(names)).tolist()))
        kinds = [pa.int32(), pa.float64(), pa.int64(), *[pa.float64()] * len(names)]
        found = {c: pa.array(v, k_) for c, v, k_ in zip(("point", "covariate", "n_local", *names.values()), zip(*rows), kinds)}
        return pa.table({"series": pa.repeat(t.column("series")[0], len(rows))} | found)

    schema = f"series {dict(own.dtypes)['series']}, point int, covariate double, n_local bigint, " + ", ".join(f"{c} double" for c in names.values())
    return own.join(power, "series", "left").groupBy("series").applyInArrow(run, schema)


def _wide_curves(own: DataFrame, names: dict[float, str], span: float, points: int, method: str) -> DataFrame:
    """Curves of series of any size, over ranges of the covariate."""
    grid, local = nearest_values(own, span, points)
    keys = ("series", "point")
    plain = lambda rows: percentiles(rows, keys, "value", **{c: q for q, c in names.items()})
    if method != "lms":
        return grid.join(plain(local), list(keys)).select("series", "point", "covariate", "n_local", *names.values())
    power = boxcox_lambda(own, "series", "value")
    positive = local.where("value > 0")
    enough = positive.groupBy(*keys).agg(F.count("*").alias("_c")).where("_c >= 8")
    middle = kept(percentiles(positive.join(enough, list(keys)), keys, "value", mu=0.5).join(power, "series"), "curve-middles")
    scaled = F.col("value") / F.col("mu")
    z = F.when(F.abs("power") < 1e-8, F.ln(scaled)).otherwise((F.pow(scaled, "power") - 1) / F.col("power"))
    spread = positive.join(middle, list(keys)).groupBy(*keys).agg(F.count("*").alias("n_positive"), F.first("mu").alias("mu"), F.first("power").alias("power"), F.stddev_samp(z).alias("s"))
    s = F.when(finite(F.col("s")) & (F.col("s") > 0), F.col("s")).otherwise(0.1)
    fitted = spread.select(*keys, F.col("n_positive").alias("n_local"), *(lms_quantile(F.col("mu"), s, F.col("power"), normal_quantile(F.lit(q))).alias(c) for q, c in names.items()))
    few = local.join(middle.select(*keys), list(keys), "left_anti")
    rest = grid.join(plain(few), list(keys)).select(*keys, "n_local", *names.values())
    return grid.drop("n_local").join(fitted.unionByName(rest), list(keys)).select("series", "point", "covariate", "n_local", *names.values())


def _lms(mu: float, s: float, power: float, z: float) -> float:
    inner = 1 + power * s * z
    if abs(power) < 1e-8:
        return mu * float(np.exp(s * z))
    return mu * inner ** (1 / power) if inner > 0 else 0.0 if power > 0 else float("nan")


class Weighted:
    """Values, each there a whole number of times."""

    def __init__(self, x: np.ndarray, times: np.ndarray):
        there = times > 0
        self.x, self.times, self.n = x[there], times[there], int(times.sum())

    def of(self, x: np.ndarray) -> Weighted:
        return Weighted(x, self.times)

    def mean(self) -> float:
        return float((self.times * self.x).sum() / self.n)

    def var(self) -> float:
        return float((self.times * (self.x - self.mean()) ** 2).sum() / (self.n - 1))

    def quantile(self, p: float) -> float:
        order = np.argsort(self.x, kind="stable")
        upto, x, at = np.cumsum(self.times[order]), self.x[order], (self.n - 1) * p
        low = int(at)
        a, b = x[np.searchsorted(upto, low, "right")], x[np.searchsorted(upto, min(low + 1, self.n - 1), "right")]
        return float(a + (b - a) * (at - low))


def edges_of(x: np.ndarray, method: str, times: np.ndarray | None = None) -> tuple[float, float]:
    """Lower and upper limit of a sample by one of METHODS; NaN where a method needs positive values. times: how often each
    value is there."""
    own = Weighted(x, np.ones(len(x), np.int64) if times is None else times)
    spread = lambda v: (v.mean() - 1.96 * v.var() ** 0.5, v.mean() + 1.96 * v.var() ** 0.5)
    x = own.x
    if method in ("transformed", "boxcox", "lms") and (x <= 0).any():
        return (float("nan"), float("nan"))
    if method == "parametric":
        return spread(own)
    if method == "robust":
        m = own.quantile(0.5)
        s = 1.4826 * own.of(np.abs(x - m)).quantile(0.5)
        return m - 1.96 * s, m + 1.96 * s
    if method == "transformed":
        return tuple(np.exp(spread(own.of(np.log(x)))))
    if method in ("boxcox", "lms"):
        powers, logs, fits = np.round(np.arange(-40, 41) * 0.05, 10), np.log(x), []
        for p in powers:
            v = own.of(logs if abs(p) < 1e-8 else (x**p - 1) / p).var()
            fits.append(np.round((p - 1) * (own.times * logs).sum() - own.n / 2 * np.log(v), 7) if v > 0 else -np.inf)
        p = float(powers[int(np.argmax(fits))])
        if method == "lms":
            mu = own.quantile(0.5)
            s = own.of(np.log(x / mu) if abs(p) < 1e-8 else ((x / mu) ** p - 1) / p).var() ** 0.5
            return _lms(mu, s, p, -1.96), _lms(mu, s, p, 1.96)
        back = lambda y: float(np.exp(y)) if abs(p) < 1e-8 else (p * y + 1) ** (1 / p) if p * y + 1 > 0 else float("nan")
        return tuple(back(y) for y in spread(own.of(logs if abs(p) < 1e-8 else (x**p - 1) / p)))
    if method == "horn":
        a, b = own.quantile(0.25), own.quantile(0.75)
        inside = (x >= a - 1.5 * (b - a)) & (x <= b + 1.5 * (b - a))
        own = Weighted(x[inside], own.times[inside]) if inside.any() else own
    elif method != "nonparametric":
        raise ValueError(f"no method {method!r}")
    return own.quantile(0.025), own.quantile(0.975)


#: Fixed value: values below which limits by percentiles are said to rest on too few.
RECOMMENDED = 120


#: Bins of equal numbers of values that stand for a sample in a bootstrap; a sample of no more values is whole.
BINS = 4096


def binned(df: DataFrame, bins: int = BINS) -> DataFrame:
    """(series, bin, c, m): each series' values as bins of neighbours in order, with their number and mean."""
    own = df.where(finite(F.col("value"))).select("series", F.col("value").cast("double").alias("value"))
    placed_ = ranked(with_stats(own, _n=F.count("*")), ("series",), "value", name="_i")
    bin_ = F.when(F.col("_n") <= bins, F.col("_i") - 1).otherwise(F.floor((F.col("_i") - 1) * float(bins) / F.col("_n"))).cast("long")
    return placed_.groupBy("series", bin_.alias("bin")).agg(F.count("*").alias("c"), F.avg("value").alias("m"))


def interval_limits(df: DataFrame, method: str = "nonparametric", times: int = 400, level: float = 0.05, seed: int = 7) -> DataFrame:
    """(series, method, n, lower, upper, lower_low, lower_high, upper_low, upper_high, notes): the limits of
    `reference_interval` with percentile bootstrap limits of each, for 30 values or more; null for fewer.

    A task draws how often each bin of a sample occurs, from a stated seed and the series' name: of a sample of BINS values
    or fewer that is drawing the values themselves; of a larger one a limit is right to a BINS-th of the values."""

    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("bin").to_numpy(), kind="stable")
        x, c = t.column("m").to_numpy()[order], t.column("c").to_numpy()[order]
        n = int(c.sum())
        rng = np.random.default_rng([seed, zlib.crc32(str(t.column("series")[0].as_py()).encode())])
        drawn = np.array([edges_of(x, method, rng.multinomial(n, c / n)) for _ in range(times)]) if n >= 30 else np.zeros((0, 2))
        bounds = []
        for side in range(2):
            own = drawn[np.isfinite(drawn[:, side]), side]
            bounds += np.quantile(own, [level / 2, 1 - level / 2]).tolist() if len(own) else [None, None]
        return pa.table({"series": t.column("series").slice(0, 1)} | {c: pa.array([b], pa.float64()) for c, b in zip(("lower_low", "lower_high", "upper_low", "upper_high"), bounds)})

    limits = reference_interval(df, method)
    found = binned(df).join(limits.select("series"), "series", "left_semi").groupBy("series").applyInArrow(run, f"series {dict(df.dtypes)['series']}, lower_low double, lower_high double, upper_low double, upper_high double")
    few = F.when(F.col("n") < RECOMMENDED, F.format_string("%d values are recommended, there are %d.", F.lit(RECOMMENDED), F.col("n")))
    return limits.join(found, "series").withColumn("notes", F.concat_ws(" ", F.lit("Statistical limits only, not clinical ones."), few))
