"""Several sites: partial pooling, and agreement of their drifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftlake.functions.columns import finite, normal_sf
from driftlake.operators import drift
from driftlake.operators.series import kept

EPS = 2.0**-52
#: 97.5 % points of Student's t for 1 to 30 degrees of freedom.
T_975 = (
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131,
    2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
)


def t_critical(df: Column) -> Column:
    table = F.array(*[F.lit(x) for x in T_975])
    return F.when(df > 30, 1.96 + 2.4 / F.greatest(df, F.lit(1))).otherwise(F.element_at(table, F.greatest(F.lit(1), F.least(F.lit(30), df)).cast("int")))


def site_effects(df: DataFrame) -> DataFrame:
    """(series, site, n, mean, sd, se, shrinkage, shrunk_mean, mu, tau2, i2, lower, upper): DerSimonian and Laird's
    between-site variance, prediction limits of a new site, and each site's mean drawn to the common one.

    Two levels of grouping: within sites, then over their few figures. Twelve values and two sites are needed."""
    own = df.where(finite(F.col("value")))
    s = own.groupBy("series", "site").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"))
    w = Window.partitionBy("series")
    s = s.withColumn("k", F.count("*").over(w)).withColumn("total", F.sum("n").over(w)).where("total >= 12 and k >= 2")
    s = s.withColumn("pooled", F.sum((F.col("n") - 1) * F.col("sd") ** 2).over(w) / F.greatest(F.col("total") - F.col("k"), F.lit(1)))
    within = F.col("pooled") > 0
    s = s.withColumn("se", F.when((F.col("n") >= 2) & (F.col("sd") > 0), F.col("sd") / F.sqrt(F.col("n").cast("double"))).when(within, F.sqrt(F.col("pooled") / F.col("n"))).otherwise(0.0))
    s = s.withColumn("w", 1 / F.greatest(F.col("se") ** 2, F.lit(EPS)))
    s = s.withColumn("mu", F.when(within, F.sum(F.col("w") * F.col("mean")).over(w) / F.sum("w").over(w)).otherwise(F.avg("mean").over(w)))
    s = s.withColumn("q", F.sum(F.col("w") * (F.col("mean") - F.col("mu")) ** 2).over(w)).withColumn("c", F.sum("w").over(w) - F.sum(F.col("w") ** 2).over(w) / F.sum("w").over(w))
    excess = F.col("q") - (F.col("k") - 1)
    s = s.withColumn("tau2", F.when(~within, F.coalesce(F.var_samp("mean").over(w), F.lit(0.0))).when(F.col("c") > 0, F.greatest(F.lit(0.0), excess / F.nullif("c", F.lit(0.0)))).otherwise(0.0))
    s = s.withColumn("i2", F.when(~within, 100.0).when(F.col("q") > 0, F.greatest(F.lit(0.0), 100 * excess / F.nullif("q", F.lit(0.0)))).otherwise(0.0))
    s = s.withColumn("sem", F.sqrt(1 / F.sum(1 / (F.col("se") ** 2 + F.col("tau2") + EPS)).over(w)))
    reach = t_critical(F.col("k") - 2) * F.sqrt(F.col("tau2") + F.col("sem") ** 2)
    b = F.when(F.col("tau2") + F.col("se") ** 2 > 0, F.col("tau2") / F.nullif(F.col("tau2") + F.col("se") ** 2, F.lit(0.0))).otherwise(1.0)
    s = s.withColumn("shrinkage", b).withColumn("lower", F.col("mu") - reach).withColumn("upper", F.col("mu") + reach)
    return s.select("series", "site", "n", "mean", "sd", "se", "shrinkage", (F.col("mu") + F.col("shrinkage") * (F.col("mean") - F.col("mu"))).alias("shrunk_mean"), "mu", "tau2", "i2", "lower", "upper")


def surrogate_times(df: DataFrame, start: str = "2020-01-01 00:00:00") -> DataFrame:
    """df with missing times replaced by one hour a place of arrival after the start."""
    hours = F.make_dt_interval(F.lit(0), F.col("seq").cast("int"))
    return df.withColumn("ts", F.coalesce("ts", (F.lit(start).cast("timestamp_ntz") + hours).cast("timestamp_ntz")))


def chi2_tail(q: Column, df: Column) -> Column:
    """Upper tail of chi-square by the cube-root approximation of Wilson and Hilferty; 1 for q or df of 0, null where q is."""
    spread = 2.0 / (9.0 * F.greatest(df, F.lit(1)))
    z = (F.pow(F.greatest(q, F.lit(0.0)) / F.greatest(df, F.lit(1)), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
    return F.when((df <= 0) | (q <= 0), 1.0).when(q.isNotNull(), normal_sf(z))


def heterogeneity(drifting: DataFrame) -> DataFrame:
    """(series, sites_drifting, concordance, drift_q, drift_p) of (series, site, n, magnitude, direction), the sites whose
    drift was detected: Cochran's Q of their magnitudes, weighted by their values, and the share of them that go the way of
    the first by name. Magnitudes that are all unknown leave Q and its p unknown."""
    w = Window.partitionBy("series")
    own = drifting.withColumn("_first", F.min_by("direction", "site").over(w)).withColumn("_mean", F.sum(F.col("n") * F.col("magnitude")).over(w) / F.sum("n").over(w))
    out = own.groupBy("series").agg(F.count("*").alias("sites_drifting"), F.avg((F.col("direction") == F.col("_first")).cast("double")).alias("concordance"), F.sum(F.col("n") * (F.col("magnitude") - F.col("_mean")) ** 2).alias("q"))
    several = F.col("sites_drifting") >= 2
    out = out.withColumn("drift_q", F.when(several, F.col("q")).otherwise(0.0))
    return out.select("series", "sites_drifting", F.when(several, F.col("concordance")).otherwise(1.0).alias("concordance"), "drift_q", chi2_tail(F.col("drift_q"), F.col("sites_drifting") - 1).alias("drift_p"))


def study(df: DataFrame) -> DataFrame:
    """(series, attribution, sites, sites_drifting, global_drift, concordance, drift_q, drift_p, grand_mean, between_sd,
    within_sd, i2, lower, upper): whether drift is one site's or shared by the sites of (series, seq, ts, site, value).

    Each site of 16 values or more has its own drift; the drift of all values is looked for in 16 or more once the sites'
    shrunken means are taken to the common one, where sites have spread. site_specific: two sites or more drift, by
    different amounts (p < 0.05) and in different directions (concordance below 0.75); global: shared drift, or that of two
    sites or more, in one direction; mixed: any other drift; stable: none. A description, not a cause."""
    own = df.where(finite(F.col("value")) & F.col("site").isNotNull())
    effects = kept(site_effects(own), "site-effects")
    # each site is a series of its own, and so is each study as a whole, so that one pass looks for all drifts
    whole = F.struct("series", F.lit(None).cast(dict(df.dtypes)["site"]).alias("site"))
    adjusted = own.join(effects.select("series", "site", (F.col("shrunk_mean") - F.col("mu")).alias("_a")), ["series", "site"])
    both = own.select(F.struct("series", "site").alias("series"), "seq", "ts", "value").unionByName(adjusted.select(whole.alias("series"), "seq", "ts", (F.col("value") - F.col("_a")).alias("value")))
    found = kept(drift.detect_drift(both).where("n >= 16"), "study-drifts").select(F.col("series.series").alias("series"), F.col("series.site").alias("site"), "n", "detected", "magnitude", "direction")
    local = heterogeneity(found.where("site is not null and detected"))
    together = found.where("site is null").select("series", F.col("detected").alias("global_drift"))
    figures = effects.groupBy("series").agg(
        F.count("*").alias("sites"), F.first("mu").alias("grand_mean"), F.sqrt(F.first("tau2")).alias("between_sd"),
        F.sqrt(F.sum((F.col("n") - 1) * F.col("sd") ** 2) / F.greatest(F.sum("n") - F.count("*"), F.lit(1))).alias("within_sd"), F.first("i2").alias("i2"), F.first("lower").alias("lower"), F.first("upper").alias("upper"),
    )
    out = figures.join(local, "series", "left").join(together, "series", "left")
    # of a study without drifting sites; what is unknown of others stays so
    out = out.withColumns({c: F.when(F.col("sites_drifting").isNull(), x).otherwise(F.col(c)) for c, x in (("drift_q", 0.0), ("drift_p", 1.0))})
    out = out.fillna({"sites_drifting": 0, "concordance": 1.0, "global_drift": False})
    n, shared = F.col("sites_drifting"), F.col("global_drift") & (F.col("within_sd") > 0)
    kind = (
        F.when((n == 0) & ~shared, "stable").when((n >= 2) & (F.col("drift_p") < 0.05) & (F.col("concordance") < 0.75), "site_specific")
        .when((shared | (n >= 2)) & (F.col("concordance") >= 0.75), "global").otherwise("mixed")
    )
    return out.select("series", kind.alias("attribution"), "sites", "sites_drifting", shared.alias("global_drift"), "concordance", "drift_q", "drift_p", "grand_mean", "between_sd", "within_sd", "i2", "lower", "upper")
