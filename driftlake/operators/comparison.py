"""Calibration curves, method comparison, lots and sites.

Pairs are rows (series, k, x, y); curves are fitted from sums over the pairs, so the data are read once and nothing but
a few figures a series is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftlake.functions.columns import f_sf, finite
from driftlake.operators import slopes
from driftlake.operators import two_sample as ts
from driftlake.operators.basics import runs_test
from driftlake.operators.slopes import theil_sen
from driftlake.operators.series import with_stats


def valid_pairs(df: DataFrame) -> DataFrame:
    return df.where(finite(F.col("x")) & finite(F.col("y")))


def bland_altman(pairs: DataFrame) -> DataFrame:
    """(series, n, bias, sd, lower, upper, proportional): agreement of y with x, and the trend of their difference."""
    own = valid_pairs(pairs).withColumn("d", F.col("y") - F.col("x"))
    slope = theil_sen(own.select("series", "k", ((F.col("x") + F.col("y")) / 2).alias("x"), F.col("d").alias("y")))
    # summed in the order of k: a mean beside a rounding border is the same however the rows are dealt out
    in_order = Window.partitionBy("series").orderBy("k", "d")
    so_far = F.sum("d").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = own.withColumn("_sum", so_far).withColumn("_row", F.row_number().over(in_order))
    bias = F.max_by("_sum", "_row") / F.count("*")
    agg = own.groupBy("series").agg(F.count("*").alias("n"), bias.alias("bias"), F.stddev_samp("d").alias("sd")).where("n >= 8")
    out = agg.withColumn("lower", F.col("bias") - 1.96 * F.col("sd")).withColumn("upper", F.col("bias") + 1.96 * F.col("sd"))
    return out.join(slope.select("series", F.col("slope").alias("proportional")), "series")


def deming(pairs: DataFrame, ratio: float = 1.0) -> DataFrame:
    """(series, n, slope, intercept): both methods have errors, of variances in the given ratio."""
    m = valid_pairs(pairs).groupBy("series").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_samp("x").alias("xx"), F.var_samp("y").alias("yy"), F.covar_samp("x", "y").alias("xy")).where("n >= 8")
    d = F.col("yy") - ratio * F.col("xx")
    slope = F.coalesce((d + F.sqrt(d * d + 4 * ratio * F.col("xy") ** 2)) / F.nullif(2 * F.col("xy"), F.lit(0.0)), F.lit(1.0))
    return m.withColumn("slope", slope).select("series", "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"))


def passing_bablok(pairs: DataFrame) -> DataFrame:
    """(series, n, slope, intercept, lower, upper): shifted median of all pairs' slopes and its 95 % limits; slope and limits
    are 1 for a series of equal x."""
    own = with_stats(valid_pairs(pairs), _n=F.count("*")).where("_n >= 8")
    return slopes.per_series(own, slopes.passing_bablok_of, "n bigint, slope double, intercept double, lower double, upper double")


def ols(pairs: DataFrame) -> DataFrame:
    """(series, n, slope, intercept, r2, residual_sd)."""
    m = valid_pairs(pairs).groupBy("series").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy")).where("n >= 3")
    m = m.withColumn("slope", F.coalesce(F.col("xy") / F.nullif("xx", F.lit(0.0)), F.lit(0.0)))
    left = F.greatest(F.col("yy") - F.col("slope") * F.col("xy"), F.lit(0.0))
    return m.select("series", "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), F.when(F.col("yy") == 0, 1.0).otherwise(1 - left / F.nullif("yy", F.lit(0.0))).alias("r2"), F.sqrt(left).alias("residual_sd"))


def weighted(pairs: DataFrame, weight: Column | None = None) -> DataFrame:
    """(series, n, slope, intercept): least squares with weights, 1 / (|x| + 0.1) by default."""
    own = valid_pairs(pairs).withColumn("w", weight if weight is not None else 1 / (F.abs("x") + 0.1))
    own = with_stats(own, mx=F.sum(F.col("w") * F.col("x")) / F.sum("w"), my=F.sum(F.col("w") * F.col("y")) / F.sum("w"))
    u, v = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    m = own.groupBy("series").agg(F.count("*").alias("n"), F.sum(F.col("w") * u * u).alias("xx"), F.sum(F.col("w") * u * v).alias("xy"), F.first("mx").alias("mx"), F.first("my").alias("my")).where("n >= 3")
    m = m.withColumn("slope", F.coalesce(F.col("xy") / F.nullif("xx", F.lit(0.0)), F.lit(0.0)))
    return m.select("series", "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"))


def quadratic(pairs: DataFrame) -> DataFrame:
    """(series, n, c0, c1, c2): least-squares parabola, from moments of centred x; null with fewer than three different x."""
    own = with_stats(valid_pairs(pairs), mx=F.avg("x"), my=F.avg("y"))
    u, v = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    m = own.groupBy("series").agg(F.count("*").alias("n"), F.sum(u * u).alias("s2"), F.sum(u * u * u).alias("s3"), F.sum(u * u * u * u).alias("s4"), F.sum(u * v).alias("uy"), F.sum(u * u * v).alias("uuy"), F.first("mx").alias("mx"), F.first("my").alias("my")).where("n >= 3")
    m = m.withColumn("s2", F.nullif("s2", F.lit(0.0)))
    q = F.nullif(F.col("s4") - F.col("s2") ** 2 / F.col("n") - F.col("s3") ** 2 / F.col("s2"), F.lit(0.0))
    m = m.withColumn("c2", (F.col("uuy") - F.col("s3") / F.col("s2") * F.col("uy")) / q)
    m = m.withColumn("b1", (F.col("uy") - F.col("c2") * F.col("s3")) / F.col("s2")).withColumn("b0", F.col("my") - F.col("c2") * F.col("s2") / F.col("n"))
    return m.select("series", "n", (F.col("b0") - F.col("b1") * F.col("mx") + F.col("c2") * F.col("mx") ** 2).alias("c0"), (F.col("b1") - 2 * F.col("c2") * F.col("mx")).alias("c1"), "c2")


def predicted(pairs: DataFrame, curves: DataFrame) -> DataFrame:
    """pairs with fit and residual, from curves with slope and intercept or c0, c1, c2."""
    own = valid_pairs(pairs).join(curves.drop("n"), "series")
    x = F.col("x")
    fit = F.col("c0") + F.col("c1") * x + F.col("c2") * x * x if "c2" in curves.columns else F.col("intercept") + F.col("slope") * x
    return own.withColumn("fit", fit).withColumn("residual", F.col("y") - F.col("fit"))


def diagnostics(pairs: DataFrame, curves: DataFrame, parameters: int = 2, runs: bool = True) -> DataFrame:
    """(series, n, residual_sd, mean_relative_error, lack_of_fit, p, runs, runs_z, runs_p): with replicates, their spread
    against the curve's; and runs of the residuals' signs in the order of x."""
    own = predicted(pairs, curves)
    at_x = own.groupBy("series", "x").agg(F.count("*").alias("m"), F.avg("y").alias("my"), F.coalesce(F.var_pop("y"), F.lit(0.0)).alias("v"), F.first("fit").alias("fit"))
    lof = at_x.groupBy("series").agg(F.sum(F.col("m") * F.col("v")).alias("pure"), F.sum(F.col("m") * (F.col("my") - F.col("fit")) ** 2).alias("lack"), (F.count("*") - parameters).alias("d1"), (F.sum("m") - F.count("*")).alias("d2"))
    base = own.groupBy("series").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("residual") ** 2)).alias("residual_sd"), F.avg(F.abs(F.col("residual") / F.nullif("y", F.lit(0.0)))).alias("mean_relative_error"))
    ok = (F.col("d1") > 0) & (F.col("d2") > 0) & (F.col("pure") > 0)
    f = F.when(ok, (F.col("lack") / F.nullif("d1", F.lit(0))) / (F.nullif("pure", F.lit(0.0)) / F.nullif("d2", F.lit(0))))
    out = base.join(lof, "series").withColumn("lack_of_fit", f).select("series", "n", "residual_sd", "mean_relative_error", "lack_of_fit", F.when(ok, f_sf(F.col("lack_of_fit"), F.col("d1"), F.col("d2"))).alias("p"))
    return out.join(residual_runs(pairs, curves).withColumnsRenamed({"z": "runs_z", "p": "runs_p"}), "series", "left") if runs else out


def residual_runs(pairs: DataFrame, curves: DataFrame) -> DataFrame:
    """(series, runs, z, p): Wald and Wolfowitz's runs of the signs of residuals, by x and k."""
    own = predicted(pairs, curves)
    return runs_test(own.select("series", F.col("k").alias("seq"), F.col("x").alias("ts"), F.col("residual").alias("value")))


def compare_curves(first: DataFrame, second: DataFrame, grid: DataFrame) -> DataFrame:
    """(series, slope_delta, intercept_delta, r2_delta, residual_delta, mean_difference) over the different x of grid."""
    a, b = first.alias("a"), second.alias("b")
    both = a.join(b, F.col("a.series") == F.col("b.series")).select(F.col("a.series").alias("series"), *((F.col(f"b.{c}") - F.col(f"a.{c}")).alias(k) for c, k in (("slope", "slope_delta"), ("intercept", "intercept_delta"), ("r2", "r2_delta"), ("residual_sd", "residual_delta"))))
    at = grid.select("series", "x").distinct().join(both, "series")
    return at.groupBy("series").agg(*(F.first(c).alias(c) for c in ("slope_delta", "intercept_delta", "r2_delta", "residual_delta")), F.avg(F.abs(F.col("intercept_delta") + F.col("slope_delta") * F.col("x"))).alias("mean_difference"))


def natural_spline(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Knots (different x), mean y at each, and second derivatives, zero at both ends."""
    knots, which = np.unique(x, return_inverse=True)
    mean = np.bincount(which, y) / np.bincount(which)
    n, second = len(knots), np.zeros(len(knots))
    if n > 2:
        h = np.diff(knots)
        second[1:-1] = tridiagonal(2 * (h[:-1] + h[1:]), h[1:-1], 6 * np.diff(np.diff(mean) / h))
    return knots, mean, second


def tridiagonal(diagonal: np.ndarray, beside: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solves a symmetric tridiagonal system, elimination and substitution in one pass each."""
    d, r, e = diagonal.tolist(), right.tolist(), beside.tolist()
    for k in range(1, len(d)):
        f = e[k - 1] / d[k - 1]
        d[k] -= f * e[k - 1]
        r[k] -= f * r[k - 1]
    for k in range(len(d) - 1, -1, -1):
        r[k] = (r[k] - (e[k] * r[k + 1] if k + 1 < len(d) else 0.0)) / d[k]
    return np.array(r)


def spline_at(knots: np.ndarray, mean: np.ndarray, second: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The spline's values; straight on beyond the outer knots."""
    k = np.clip(np.searchsorted(knots, at, "right") - 1, 0, len(knots) - 2)
    h = knots[k + 1] - knots[k]
    a, b = (knots[k + 1] - at) / h, (at - knots[k]) / h
    inside = a * mean[k] + b * mean[k + 1] + ((a**3 - a) * second[k] + (b**3 - b) * second[k + 1]) * h * h / 6
    first = (mean[1] - mean[0]) / (knots[1] - knots[0]) - (knots[1] - knots[0]) * (2 * second[0] + second[1]) / 6
    last = (mean[-1] - mean[-2]) / (knots[-1] - knots[-2]) + (knots[-1] - knots[-2]) * (second[-2] + 2 * second[-1]) / 6
    return np.where(at < knots[0], mean[0] + first * (at - knots[0]), np.where(at > knots[-1], mean[-1] + last * (at - knots[-1]), inside))


def four_parameter(x: np.ndarray, y: np.ndarray, steps: int = 40) -> np.ndarray:
    """Asymptotes for small and large x, midpoint and slope of a logistic curve, by damped Gauss-Newton steps.

    Midpoint and slope are kept positive by their logarithms; a step is halved until it leaves less than before."""
    return four_parameters(x[None, :], y[None, :], steps)[0]


def four_parameters(x: np.ndarray, y: np.ndarray, steps: int = 40) -> np.ndarray:
    """The same for many series of one length, a row each; a series that no step betters goes no further."""
    ax, row = np.maximum(x, 1e-9), np.arange(len(x))
    middle = np.array([np.median(v[v > 0]) if (v > 0).any() else 1.0 for v in x])
    p = np.stack([y[row, x.argmin(1)], y[row, x.argmax(1)], middle, np.ones(len(x))], 1).astype(float)
    at = lambda p, own: logistic_at(p.T[:, :, None], x[own])
    left = ((y - at(p, row)) ** 2).sum(1)
    for _ in range(steps):
        own = p[row]
        power = np.exp(np.clip(own[:, 3:] * np.log(ax[row] / own[:, 2:3]), -60, 60))
        slope = (own[:, :1] - own[:, 1:2]) * power / (1 + power) ** 2 * own[:, 3:]
        jacobian = np.stack([1 / (1 + power), 1 - 1 / (1 + power), slope, -slope * np.log(ax[row] / own[:, 2:3])], 2)
        over = y[row] - at(own, row)
        step = np.stack([np.linalg.lstsq(j, r, rcond=None)[0] for j, r in zip(jacobian, over)])
        bettered, open_ = np.zeros(len(row), bool), np.arange(len(row))
        for damping in 0.5 ** np.arange(1, 8):
            move, of = damping * step[open_], row[open_]
            to = np.concatenate([p[of, :2] + move[:, :2], p[of, 2:] * np.exp(np.clip(move[:, 2:], -2, 2))], 1)
            now = ((y[of] - at(to, of)) ** 2).sum(1)
            good = np.isfinite(now) & (now < left[of])
            p[of[good]], left[of[good]], bettered[open_[good]] = to[good], now[good], True
            open_ = open_[~good]
            if not len(open_):
                break
        row = row[bettered]
        if not len(row):
            break
    return p


#: Rows of short series that go through a task's arrays together.
TOGETHER = 100_000


def _whole_series(df: DataFrame, work, schema: str, *order: str) -> DataFrame:
    """What work makes of many whole series at a time, in order: work(table, starts) gets rows of series and the places where
    they begin. Some TOGETHER rows are held, or a series if it has more."""

    most = TOGETHER

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < most:
                continue
            table = pa.Table.from_batches(held)
            starts = np.flatnonzero(table.column("_row").to_numpy() == 1)
            last = int(starts[-1])
            if last:  # the last series may go on
                yield from work(table.slice(0, last), starts[:-1]).to_batches()
            held = table.slice(last).combine_chunks().to_batches()
            rows = table.num_rows - last
        if held:
            table = pa.Table.from_batches(held)
            yield from work(table, np.flatnonzero(table.column("_row").to_numpy() == 1)).to_batches()

    over = Window.partitionBy("series").orderBy(*order)
    # the window keeps a series together and in order, in the partitions where it may be already
    return df.withColumn("_row", F.row_number().over(over)).mapInArrow(run, schema)


def _logistic_fits(x: np.ndarray, y: np.ndarray, starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Four parameters of each series, those of one length together; null rows for series not in which."""
    sizes, found = np.diff([*starts, len(x)]), np.full((len(starts), 4), np.nan)
    for n in np.unique(sizes[which]):
        own = np.flatnonzero(which & (sizes == n))
        place = starts[own][:, None] + np.arange(n)
        found[own] = four_parameters(x[place], y[place])
    return found


def logistic_at(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    return p[1] + (p[0] - p[1]) / (1 + np.exp(np.clip(p[3] * np.log(np.maximum(x, 1e-9) / p[2]), -60, 60)))


def curve_fits(pairs: DataFrame, model: str) -> DataFrame:
    """(series, k, x, y, fit) of models that need a series' pairs together: spline, fourpl; a line where those cannot be."""
    kinds = dict(pairs.dtypes)

    def work(t: pa.Table, starts: np.ndarray) -> pa.Table:
        x, y = t.column("x").to_numpy(), t.column("y").to_numpy()
        sizes, fit = np.diff([*starts, len(x)]), np.empty(len(x))
        whole = (sizes >= 4) & (model == "fourpl")
        if whole.any():
            p = np.repeat(_logistic_fits(x, y, starts, whole), sizes, 0)
            fit = logistic_at(p.T, x)
        for a, n in zip(starts[~whole].tolist(), sizes[~whole].tolist()):
            u, v = x[a : a + n], y[a : a + n]
            if model == "spline" and len(np.unique(u)) >= 3:
                fit[a : a + n] = spline_at(*natural_spline(u, v), u)
            else:
                slope = np.polyfit(u, v, 1) if len(np.unique(u)) > 1 else np.array([0.0, v.mean()])
                fit[a : a + n] = np.polyval(slope, u)
        return t.select(["series", "k", "x", "y"]).append_column("fit", pa.array(fit))

    own = valid_pairs(pairs).select("series", "k", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return _whole_series(own, work, f"series {kinds['series']}, k {kinds['k']}, x double, y double, fit double", "k", "x", "y")


def compare_lots(df: DataFrame) -> DataFrame:
    """(series, lots, h, location_p, variance_f, variance_p, ks, shift_suspected, variance_shift) of (series, grp, value),
    grp being the lot: location by Kruskal and Wallis, variance by Brown and Forsythe, and the Kolmogorov-Smirnov distance
    where there are just two lots. Series of fewer than two lots are left out."""
    own = df.where(F.col("grp").isNotNull() & finite(F.col("value")))
    kw, bf = ts.kruskal_wallis(own).where("k >= 2"), ts.brown_forsythe(own)
    pair = own.groupBy("series").agg(F.min("grp").alias("_first"), F.count_distinct("grp").alias("_k")).where("_k = 2").select("series", "_first")
    two = own.join(pair, "series").select("series", F.when(F.col("grp") == F.col("_first"), "a").otherwise("b").alias("side"), "value")
    out = kw.join(bf.select("series", F.col("f").alias("variance_f"), F.col("p").alias("variance_p")), "series", "left").join(ts.ks(two).select("series", F.col("d").alias("ks")), "series", "left")
    return out.select("series", F.col("k").alias("lots"), "h", F.col("p").alias("location_p"), "variance_f", "variance_p", "ks", (F.col("p") < 0.05).alias("shift_suspected"), (F.col("variance_p") < 0.05).alias("variance_shift"))


def lots_of(df: DataFrame, *columns: str) -> DataFrame:
    """(series, grp, value) with the first of some columns that is known as the lot: lots_of(df, "lot", "reagent_lot")."""
    known = [F.col(c).cast("string") for c in columns if c in df.columns]
    return df.select("series", (F.coalesce(*known) if known else F.lit(None).cast("string")).alias("grp"), "value")


def compare_sites(df: DataFrame) -> DataFrame:
    """(series, sites, h, p, site_effect_suspected) of (series, grp, value), grp being the site; two sites at least."""
    kw = ts.kruskal_wallis(df.where(F.col("grp").isNotNull() & finite(F.col("value")))).where("k >= 2")
    return kw.select("series", F.col("k").alias("sites"), "h", "p", (F.col("p") < 0.05).alias("site_effect_suspected"))


def polynomial(pairs: DataFrame, degree: int = 2) -> DataFrame:
    """(series, n, coefficients): least squares of degree 1 to 5, from power sums of x, centred and scaled; the small
    systems are solved one row a series."""
    degree = max(1, min(5, degree))
    own = with_stats(valid_pairs(pairs), _m=F.avg("x"), _s=F.coalesce(F.nullif(F.stddev_pop("x"), F.lit(0.0)), F.lit(1.0)))
    own = own.withColumn("_u", (F.col("x") - F.col("_m")) / F.col("_s"))
    power = lambda k: F.pow("_u", F.lit(float(k))) if k else F.lit(1.0)
    sums = own.groupBy("series").agg(
        F.count("*").alias("n"), F.first("_m").alias("m"), F.first("_s").alias("s"), F.array(*[F.sum(power(k)) for k in range(2 * degree + 1)]).alias("a"),
        F.array(*[F.sum(power(k) * F.col("y")) for k in range(degree + 1)]).alias("b"),
    ).where("n >= 3")

    def solve(batches):
        for batch in batches:
            found = []
            for m, scale, a, b in zip(*(batch.column(c).to_pylist() for c in ("m", "s", "a", "b"))):
                in_u = np.linalg.lstsq(np.array([[a[i + j] for j in range(degree + 1)] for i in range(degree + 1)]), np.array(b), rcond=None)[0]
                in_x = np.poly1d(in_u[::-1])(np.poly1d([1 / scale, -m / scale]))
                found.append(np.concatenate([in_x.coeffs[::-1], np.zeros(degree + 1)])[: degree + 1].tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["series", "n", "coefficients"])

    return sums.mapInArrow(solve, f"series {dict(pairs.dtypes)['series']}, n bigint, coefficients array<double>")


def _whole_fits(pairs: DataFrame, model: str) -> DataFrame:
    """(series, n, coefficients, r2, residual_sd) of models that need a series' pairs together. spline: knots, values and
    second derivatives after their number (a line for fewer than three different x: intercept and slope after 0); fourpl:
    the four parameters."""

    def work(t: pa.Table, starts: np.ndarray) -> pa.Table:
        x, y = t.column("x").to_numpy(), t.column("y").to_numpy()
        sizes = np.diff([*starts, len(x)])
        enough = sizes >= 3
        logistic = _logistic_fits(x, y, starts, enough) if model == "fourpl" else None
        found, figures = [], []
        for k in np.flatnonzero(enough).tolist():
            u, v = x[starts[k] : starts[k] + sizes[k]], y[starts[k] : starts[k] + sizes[k]]
            if logistic is not None:
                own = logistic[k]
            elif len(np.unique(u)) >= 3:
                knots, mean, second = natural_spline(u, v)
                own = np.concatenate([[len(knots)], knots, mean, second])
            else:
                own = np.array([0.0, *(np.polyfit(u, v, 1)[::-1] if len(np.unique(u)) > 1 else (v.mean(), 0.0))])
            over, spread = ((v - curve_at(model, own, u)) ** 2).sum(), ((v - v.mean()) ** 2).sum()
            found.append(own)
            figures.append((1.0 if spread == 0 else 1 - over / spread, (over / len(u)) ** 0.5))
        r2, left = zip(*figures) if figures else ((), ())
        # no list of a batch's numbers goes through Python
        ends = np.cumsum([0, *map(len, found)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else [], pa.float64()))
        return pa.table({"series": t.column("series").take(pa.array(starts[enough])), "n": pa.array(sizes[enough], pa.int64()), "coefficients": lists, "r2": pa.array(r2, pa.float64()), "residual_sd": pa.array(left, pa.float64())})

    order = [c for c in ("k", "x", "y") if c in pairs.columns]
    own = valid_pairs(pairs).select("series", *(c for c in order if c == "k"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return _whole_series(own, work, f"series {dict(pairs.dtypes)['series']}, n bigint, coefficients array<double>, r2 double, residual_sd double", *order)


def curve_at(model: str, coefficients: np.ndarray, x: np.ndarray) -> np.ndarray:
    if model == "fourpl":
        return logistic_at(coefficients, x)
    n = int(coefficients[0])
    return spline_at(*(coefficients[1 + k * n : 1 + (k + 1) * n] for k in range(3)), x) if n else coefficients[1] + coefficients[2] * x


MODELS = ("linear", "weighted_linear", "polynomial", "robust", "spline", "fourpl")


def calibrate(pairs: DataFrame, model: str = "linear", degree: int = 2, weight: Column | None = None) -> DataFrame:
    """(series, model, n, coefficients, r2, residual_sd): one of MODELS for each series of three pairs at least.

    coefficients of linear, weighted_linear, robust and polynomial ascend by the power of x."""
    line = lambda df: df.select("series", "n", F.array("intercept", "slope").alias("coefficients"))
    if model == "linear":
        fits = line(ols(pairs))
    elif model == "weighted_linear":
        fits = line(weighted(pairs, weight))
    elif model == "robust":
        own = valid_pairs(pairs)
        fits = line(theil_sen(own).join(own.groupBy("series").agg(F.count("*").alias("n")).where("n >= 3"), "series"))
    elif model == "polynomial":
        fits = polynomial(pairs, degree)
    elif model in ("spline", "fourpl"):
        return _whole_fits(pairs, model).select("series", F.lit(model).alias("model"), "n", "coefficients", "r2", "residual_sd")
    else:
        raise ValueError(f"no calibration model {model!r}")
    fits = fits.withColumn("model", F.lit(model))
    left = with_stats(predict_response(valid_pairs(pairs).select("series", "x", "y"), fits), _m=F.avg("y"))
    figures = left.groupBy("series").agg(F.sum((F.col("y") - F.col("fit")) ** 2).alias("_r"), F.sum((F.col("y") - F.col("_m")) ** 2).alias("_t"), F.count("*").alias("_n"))
    r2 = F.when(F.col("_t") == 0, 1.0).otherwise(1 - F.col("_r") / F.nullif("_t", F.lit(0.0)))
    return fits.join(figures, "series").select("series", "model", "n", "coefficients", r2.alias("r2"), F.sqrt(F.col("_r") / F.col("_n")).alias("residual_sd"))


def predict_response(points: DataFrame, curves: DataFrame) -> DataFrame:
    """points (series, x, ...) with fit, from the curves of their series (series, model, coefficients), at any x."""
    lines = curves.where(~F.col("model").isin("spline", "fourpl")).select("series", "coefficients")
    horner = F.aggregate(F.reverse("coefficients"), F.lit(0.0), lambda s, c: s * F.col("x") + c)
    out = points.join(lines, "series").withColumn("fit", horner).drop("coefficients")
    others = curves.where(F.col("model").isin("spline", "fourpl")).select(F.col("series").alias("_key"), "model", "coefficients")
    # only points of such curves go on, each behind the curve of its series, which a task then needs but one at a time
    theirs = points.join(others.select("_key"), F.col("series") == F.col("_key"), "left_semi")
    null = lambda t: F.lit(None).cast(t)
    ahead = others.select(F.col("_key"), F.lit(1).alias("_row"), "model", "coefficients", *(null(t).alias(c) for c, t in points.dtypes))
    behind = theirs.select(F.col("series").alias("_key"), F.lit(2).alias("_row"), null("string").alias("model"), null("array<double>").alias("coefficients"), *points.columns)
    both = ahead.unionByName(behind).repartition("_key").sortWithinPartitions("_key", "_row").drop("_key")
    names = [*points.columns, "fit"]

    def run(batches):
        now = None
        for batch in batches:
            x, first = batch.column("x").cast(pa.float64()).to_numpy(zero_copy_only=False), batch.column("_row").to_numpy(zero_copy_only=False) == 1
            heads, fit = np.flatnonzero(first).tolist(), np.empty(len(x))
            for a, b in zip([0, *heads], [*heads, len(x)]):
                if a < len(x) and first[a]:
                    now, a = (batch.column("model")[a].as_py(), batch.column("coefficients")[a].values.to_numpy()), a + 1
                if a < b:
                    fit[a:b] = curve_at(*now, x[a:b])
            kept = pa.array(np.flatnonzero(~first))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(kept) for c in names[:-1]), pa.array(fit).take(kept)], names)

    return out.unionByName(both.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in [*points.dtypes, ("fit", "double")])))


METHODS = ("bland_altman", "deming", "passing_bablok", "ols", "theil_sen")


def compare_methods(pairs: DataFrame, method: str = "bland_altman", ratio: float = 1.0) -> DataFrame:
    """(series, method, n, bias, proportional, lower, upper, slope, intercept) of y against x, for series of eight pairs at
    least; figures that a method does not give are null. The bias of a line is its intercept, its proportional bias the
    slope less 1."""
    if method == "bland_altman":
        out = bland_altman(pairs)
    elif method in METHODS:
        own = with_stats(valid_pairs(pairs), _n=F.count("*")).where("_n >= 8").drop("_n")
        if method == "theil_sen":
            found = theil_sen(own).join(own.groupBy("series").agg(F.count("*").alias("n")), "series")
        else:
            found = {"deming": lambda p: deming(p, ratio), "passing_bablok": passing_bablok, "ols": ols}[method](own)
        out = found.drop("lower", "upper").withColumn("bias", F.col("intercept")).withColumn("proportional", F.col("slope") - 1)
    else:
        raise ValueError(f"no method {method!r}")
    has = lambda c: F.col(c) if c in out.columns else F.lit(None).cast("double").alias(c)
    return out.select("series", F.lit(method).alias("method"), "n", *(has(c) for c in ("bias", "proportional", "lower", "upper", "slope", "intercept")))
