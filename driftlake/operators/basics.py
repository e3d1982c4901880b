"""Aggregates and sequence operators over measurement tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftlake.functions.columns import boxcox, finite, normal_sf
from driftlake.operators.series import blanked, by_series, median_deviations, running, with_percentiles, with_stats
from driftlake.operators.slopes import theil_sen

__all__ = ["theil_sen"]


def baseline(df: DataFrame) -> DataFrame:
    """n, first and last time, mean, standard deviation, median and MAD of each series."""
    own = df.where(finite(F.col("value")))
    figures = own.groupBy("series").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")
    )
    return figures.join(median_deviations(own).withColumnRenamed("med", "median"), "series")


def robust_mad(df: DataFrame, key: str = "series", value: str = "value") -> DataFrame:
    return median_deviations(df.where(finite(F.col(value))), (key,), value).drop("med")


def excess_kurtosis(value: Column) -> Column:
    """Fourth standardised moment less 3; 0 for fewer than four values or no variance."""
    return F.when(F.count(value) < 4, 0.0).otherwise(F.coalesce(F.kurtosis(value), F.lit(0.0)))


def missing_fraction(value: Column) -> Column:
    return F.coalesce(F.avg((~finite(value)).cast("double")), F.lit(0.0))


def inverse_variance_mean(value: Column, uncertainty: Column) -> Column:
    weight = F.when(finite(uncertainty) & (uncertainty > 0) & finite(value), 1.0 / (uncertainty * uncertainty))
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def uncertainty_budget(df: DataFrame) -> DataFrame:
    """Spread, root mean square of the stated uncertainties, both together, and the standard error of each series."""
    known = F.when(finite(F.col("uncertainty")) & (F.col("uncertainty") > 0), F.col("uncertainty"))
    agg = df.where(finite(F.col("value"))).groupBy("series").agg(
        F.count("*").alias("n"), F.stddev_samp("value").alias("sigma"), F.sqrt(F.avg(known * known)).alias("rms"),
        inverse_variance_mean(F.col("value"), F.col("uncertainty")).alias("weighted_mean"),
    )
    combined = F.sqrt(F.col("sigma") ** 2 + F.coalesce(F.col("rms"), F.lit(0.0)) ** 2)
    return agg.withColumn("combined", combined).withColumn("standard_error", combined / F.sqrt(F.col("n").cast("double")))


def boxcox_lambda(df: DataFrame, key: str, value: str, low: int = -40, high: int = 40, step: float = 0.05) -> DataFrame:
    """(key, power): the grid's power of highest profile likelihood, the first of equals; 0 for fewer than 8 positive values.

    One pass: as many variances in one aggregate as the grid has powers."""
    own = df.where(finite(F.col(value)) & (F.col(value) > 0)).select(key, F.col(value).alias("v"))
    powers = {k: round(k * step, 10) for k in range(low, high + 1)}
    spread = [F.var_samp(boxcox(F.col("v"), F.lit(p))).alias(f"_{i}") for i, p in enumerate(powers.values())]
    sums = own.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.ln("v")).alias("logs"), *spread)
    fit = lambda i, p: F.round((p - 1.0) * F.col("logs") - F.col("n") / 2.0 * F.ln(F.nullif(F.col(f"_{i}"), F.lit(0.0))), 7)
    each = F.array(*[F.struct(F.coalesce(fit(i, p), F.lit(float("-inf"))).alias("fit"), F.lit(-k).alias("k"), F.lit(p).alias("power")) for i, (k, p) in enumerate(powers.items())])
    return sums.select(key, F.when(F.col("n") < 8, 0.0).otherwise(F.array_max(each)["power"]).alias("power"))


def standardized(df: DataFrame, robust: bool = False, gaps: bool = False) -> DataFrame:
    """df with z: value less mean, in standard deviations (robust: median and MAD); a scale of zero counts as one. Rows
    without a finite value are left out; with gaps they stay, without value and z."""
    own = blanked(df) if gaps else df.where(finite(F.col("value")))
    if robust:
        own = own.join(median_deviations(own).withColumnsRenamed({"med": "center", "mad": "scale"}), "series")
    else:
        own = with_stats(own, center=F.avg("value"), scale=F.stddev_samp("value"))
    scale = F.when(finite(F.col("scale")) & (F.col("scale") > 0), F.col("scale")).otherwise(1.0)
    return own.withColumn("z", (F.col("value") - F.col("center")) / scale).drop("center", "scale")


def tied_ranks(df: DataFrame, keys: tuple[str, ...] = ("series",), value: str = "value") -> DataFrame:
    """df with rank: the average rank of equal values. Ranked over the different values, which are far fewer."""
    keys = list(keys)
    distinct = df.groupBy(*keys, value).agg(F.count("*").alias("_times"))
    below = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = distinct.withColumn("rank", F.coalesce(F.sum("_times").over(below), F.lit(0)) + (F.col("_times") + 1) / 2.0)
    return df.join(ranks, [*keys, value])


def regular_cadence(df: DataFrame, tolerance: float = 0.35) -> DataFrame:
    """(series, regular, n_steps, median_step): whether the mean deviation of the time steps from their median, against
    that median, is below the tolerance."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    steps = df.withColumn("dt", seconds - F.lag(seconds).over(by_series()))
    counts = df.groupBy("series").agg(F.count("*").alias("n"))
    own = with_percentiles(steps.where("dt > 0"), value="dt", m=0.5)
    found = own.groupBy("series").agg(F.count("*").alias("n_steps"), F.first("m").alias("median_step"), F.avg(F.abs(F.col("dt") - F.col("m")) / F.col("m")).alias("spread"))
    out = counts.join(found, "series", "left")
    regular = (F.col("n") >= 4) & (F.coalesce("n_steps", F.lit(0)) >= 3) & (F.col("spread") < tolerance)
    return out.select("series", F.coalesce(regular, F.lit(False)).alias("regular"), F.coalesce("n_steps", F.lit(0)).alias("n_steps"), "median_step")


def lot_transitions(df: DataFrame, lot: str = "lot") -> DataFrame:
    """(series, ts, from_value, to_value) wherever the lot differs from the last one known."""
    own = df.where(F.col(lot).isNotNull()).withColumn("from_value", F.lag(lot).over(by_series()))
    return own.where(F.col("from_value") != F.col(lot)).select("series", "ts", "from_value", F.col(lot).alias("to_value"))


def cusum_path(df: DataFrame) -> DataFrame:
    """(series, i, s): running sums of value less the series' mean."""
    own = with_stats(df.where(finite(F.col("value"))), m=F.avg("value"))
    return running(own, {"s": F.col("value") - F.col("m")}).select("series", "i", "s")


def runs_test(df: DataFrame, value: str = "value") -> DataFrame:
    """(series, runs, z, p): Wald-Wolfowitz runs of signs, zeros left out; fewer than 8 signs give z 0 and p 1."""
    signs = df.where(finite(F.col(value)) & (F.col(value) != 0)).withColumn("up", F.col(value) > 0)
    marked = signs.withColumn("new", (F.coalesce(F.lag("up").over(by_series()) != F.col("up"), F.lit(True))).cast("long"))
    agg = marked.groupBy("series").agg(F.sum("new").alias("runs"), F.sum(F.col("up").cast("double")).alias("a"), F.sum((~F.col("up")).cast("double")).alias("b"))
    n = F.col("a") + F.col("b")
    mu = 2 * F.col("a") * F.col("b") / n + 1
    var = (mu - 1) * (mu - 2) / (n - 1)
    z = F.when((n < 8) | (var <= 0), 0.0).otherwise((F.col("runs") - mu) / F.sqrt(F.when(var > 0, var)))
    return agg.select("series", "runs", z.alias("z"), F.when((n < 8) | (var <= 0), 1.0).otherwise(2 * normal_sf(F.abs(z))).alias("p"))


def bh_adjusted(df: DataFrame, p: str = "p", order: str = "series", parts: int = 1024) -> DataFrame:
    """df with q: Benjamini-Hochberg step-up values over all rows.

    Ranked within ranges of p, after the rows of the ranges below; the least value of the ranges above goes to each range,
    so only as many rows as there are ranges meet in one task."""
    own = df.withColumn("_part", F.least(F.floor(F.col(p) * parts), F.lit(parts)).cast("int"))
    all_parts = Window.partitionBy(F.lit(0)).orderBy("_part")
    sizes = own.groupBy("_part").agg(F.count("*").alias("_c"))
    sizes = sizes.withColumn("_base", F.sum("_c").over(all_parts) - F.col("_c")).withColumn("_n", F.sum("_c").over(Window.partitionBy(F.lit(0)))).drop("_c")
    within = Window.partitionBy("_part").orderBy(p, order)
    step = own.withColumn("_r", F.row_number().over(within)).join(F.broadcast(sizes), "_part")
    step = step.withColumn("_q", F.col(p) * F.col("_n") / (F.col("_r") + F.col("_base")))
    above = step.groupBy("_part").agg(F.min("_q").alias("_least"))
    above = above.withColumn("_above", F.min("_least").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1))).drop("_least")
    after = Window.partitionBy("_part").orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    own = step.withColumn("_here", F.min("_q").over(after)).join(F.broadcast(above), "_part")  # one row a range
    return own.withColumn("q", F.least(F.lit(1.0), "_here", F.coalesce("_above", F.lit(1.0)))).drop("_part", "_base", "_n", "_r", "_q", "_here", "_above")


def fingerprint(df: DataFrame) -> DataFrame:
    """(series, n, fingerprint): 16 hex digits of a SHA-256 over a series' values in order, missing ones included. Days are
    digested first and their digests then, so no group holds a whole long series."""
    text = F.when(finite(F.col("value")), F.col("value").cast("string")).otherwise("-")
    rows = F.array_sort(F.collect_list(F.struct("ts", "seq", text.alias("t"))))
    joined = lambda rows, field: F.array_join(F.transform(rows, lambda x: x[field]), ",")
    days = df.groupBy("series", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sha2(joined(rows, "t"), 256).alias("d"))
    in_order = F.array_sort(F.collect_list(F.struct("day", "d")))
    return days.groupBy("series").agg(F.sum("n").alias("n"), F.substring(F.sha2(joined(in_order, "d"), 256), 1, 16).alias("fingerprint"))
