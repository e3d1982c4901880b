"""Batch effects: detection, kept apart from correction, and corrections.

Rows are (series, seq, batch, value) with grp and control where an operator needs them. Corrections add `corrected` and
keep the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftlake.functions.columns import finite
from driftlake.operators import two_sample as ts
from driftlake.operators.series import ranked, with_percentiles, with_stats


def detect(df: DataFrame) -> DataFrame:
    """(series, h, p, adjusted_h, adjusted_p, group_h, group_p, reading): by batch, by batch without the biological
    groups' medians, and by group."""
    own = df.where(finite(F.col("value")))
    less = with_percentiles(own, ("series", "grp"), _m=0.5)
    parts = {
        "": own.select("series", F.col("batch").alias("grp"), "value"), "adjusted_": less.select("series", F.col("batch").alias("grp"), (F.col("value") - F.col("_m")).alias("value")),
        "group_": own.select("series", "grp", "value"),
    }
    out = None
    for k, rows in parts.items():
        t = ts.kruskal_wallis(rows).select("series", F.col("h").alias(f"{k}h"), F.col("p").alias(f"{k}p"))
        out = t if out is None else out.join(t, "series")
    a, b = F.col("adjusted_p") < 0.05, F.col("group_p") < 0.05
    return out.withColumn("reading", F.when(a & b, "both").when(a, "batch").when(b, "biology").otherwise("none"))


def median_centered(df: DataFrame) -> DataFrame:
    own = with_stats(with_percentiles(df.where(finite(F.col("value"))), ("series", "batch"), _m=0.5), _g=F.avg("value"))
    return own.withColumn("corrected", F.col("value") - F.col("_m") + F.col("_g")).drop("_m", "_g")


def quantile_matched(df: DataFrame) -> DataFrame:
    """Each value becomes the pooled value at its quantile within its batch; ties in the order of seq."""
    own = df.where(finite(F.col("value")))
    own = ranked(with_stats(with_stats(own, ("series", "batch"), _n=F.count("*")), _np=F.count("*")), ("series", "batch"), "value", "seq", name="_r")
    q = F.when(F.col("_n") == 1, 0.5).otherwise((F.col("_r") - 0.5) / F.col("_n"))
    own = own.withColumn("_at", F.greatest(F.lit(1), F.least(F.col("_np"), F.bround(q * (F.col("_np") - 1) + 1).cast("bigint"))))
    pooled = ranked(own.select("series", "seq", "value"), ("series",), "value", "seq", name="_at").select("series", F.col("_at").cast("bigint"), F.col("value").alias("corrected"))
    return own.join(pooled, ["series", "_at"]).drop("_r", "_n", "_np", "_at")


def control_adjusted(df: DataFrame) -> DataFrame:
    """Values less what their batch's controls differ by from all controls, where a batch has two controls at least; with
    fewer than four controls in all, median centring."""
    own = with_stats(df.where(finite(F.col("value"))), _gc=F.avg(F.when(F.col("control"), F.col("value"))), _nc=F.count(F.when(F.col("control"), 1)), _g=F.avg("value"))
    own = with_stats(own, ("series", "batch"), _bc=F.avg(F.when(F.col("control"), F.col("value"))), _nb=F.count(F.when(F.col("control"), 1)))
    own = with_percentiles(own, ("series", "batch"), _m=0.5)
    shift = F.when(F.col("_nb") >= 2, F.col("_bc") - F.col("_gc")).otherwise(0.0)
    out = own.withColumn("corrected", F.when(F.col("_nc") >= 4, F.col("value") - shift).otherwise(F.col("value") - F.col("_m") + F.col("_g")))
    return out.drop("_gc", "_nc", "_g", "_bc", "_nb", "_m")


def _posterior(stats: DataFrame, across: tuple[str, ...], steps: int) -> DataFrame:
    """Empirical-Bayes location g and scale d2 from n, zs (sum), zz (sum of squares); priors across the given groups.

    The iterations need the three sums alone, so no pass over the rows is made."""
    n = F.col("n")
    var = F.coalesce((F.col("zz") - F.col("zs") ** 2 / n) / F.nullif(n - 1, F.lit(0)), F.lit(1.0))
    stats = stats.withColumn("gh", F.col("zs") / n).withColumn("dh", F.when(var > 0, var).otherwise(1.0))
    w = Window.partitionBy(*across)
    stats = stats.withColumn("mu", F.avg("gh").over(w)).withColumn("t2", F.greatest(F.coalesce(F.var_samp("gh").over(w), F.lit(0.0)), F.lit(1e-6)))
    stats = stats.withColumn("md", F.avg("dh").over(w)).withColumn("vd", F.coalesce(F.var_samp("dh").over(w), F.lit(0.0)))
    stats = stats.withColumn("l", F.when(F.col("vd") > 1e-12, F.greatest(F.lit(2.01), 2 + F.col("md") ** 2 / F.nullif("vd", F.lit(0.0)))).otherwise(20.0))
    stats = stats.withColumn("th", F.greatest(F.col("md") * (F.col("l") - 1), F.lit(1e-8))).withColumn("d2", F.col("dh"))
    for _ in range(steps):
        data = n / F.greatest("d2", F.lit(1e-8))
        stats = stats.withColumn("g", (data * F.col("gh") + F.col("mu") / F.col("t2")) / (data + 1 / F.col("t2")))
        sse = F.col("zz") - 2 * F.col("g") * F.col("zs") + n * F.col("g") ** 2
        stats = stats.withColumn("d2", (F.col("th") + 0.5 * sse) / F.greatest(F.col("l") + n / 2.0 - 1, F.lit(1e-6)))
    return stats


def combat(df: DataFrame, steps: int = 8) -> DataFrame:
    """Empirical-Bayes location and scale for each batch, groups protected."""
    own = with_stats(df.where(finite(F.col("value"))), ("series", "grp"), _fit=F.avg("value"))
    own = own.withColumn("_e", F.col("value") - F.col("_fit"))
    own = with_stats(own, _sd=F.stddev_samp("_e")).withColumn("_z", F.col("_e") / F.when(F.coalesce("_sd", F.lit(0.0)) > 0, F.col("_sd")).otherwise(1.0))
    stats = own.groupBy("series", "batch").agg(F.count("*").alias("n"), F.sum("_z").alias("zs"), F.sum(F.col("_z") ** 2).alias("zz"))
    found = _posterior(stats, ("series",), steps).select("series", "batch", "g", "d2")
    scale = F.when(F.coalesce("_sd", F.lit(0.0)) > 0, F.col("_sd")).otherwise(1.0)
    return own.join(found, ["series", "batch"]).withColumn("corrected", (F.col("_z") - F.col("g")) / F.sqrt(F.greatest("d2", F.lit(1e-8))) * scale + F.col("_fit")).drop("_fit", "_e", "_sd", "_z", "g", "d2")


def combat_matrix(df: DataFrame, steps: int = 6) -> DataFrame:
    """The same for rows (seq, batch, feature, value): priors across the features of each batch."""
    own = with_stats(df, ("feature",), _m=F.avg("value"), _sd=F.stddev_samp("value"))
    scale = F.when(F.coalesce("_sd", F.lit(0.0)) > 0, F.col("_sd")).otherwise(1.0)
    own = own.withColumn("_z", (F.col("value") - F.col("_m")) / scale)
    stats = own.groupBy("batch", "feature").agg(F.count("*").alias("n"), F.sum("_z").alias("zs"), F.sum(F.col("_z") ** 2).alias("zz"))
    found = _posterior(stats, ("batch",), steps).select("batch", "feature", "g", "d2")
    return own.join(found, ["batch", "feature"]).withColumn("corrected", (F.col("_z") - F.col("g")) / F.sqrt(F.greatest("d2", F.lit(1e-8))) * scale + F.col("_m")).drop("_m", "_sd", "_z", "g", "d2")


def spread_of_means(df: DataFrame, value: Column) -> DataFrame:
    """(series, spread): the standard deviation of the batches' means."""
    means = df.groupBy("series", "batch").agg(F.avg(value).alias("m"))
    return means.groupBy("series").agg(F.stddev_samp("m").alias("spread"))


CORRECTIONS = {"median": median_centered, "quantile": quantile_matched, "ruv": control_adjusted, "combat": combat}


def corrected(df: DataFrame, method: str = "median") -> DataFrame:
    """df's finite rows with `corrected`, by one of CORRECTIONS."""
    if method not in CORRECTIONS:
        raise ValueError(f"no batch correction {method!r}")
    return CORRECTIONS[method](df)
