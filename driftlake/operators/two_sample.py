"""Comparisons of two or more samples: distances, rank tests, variance tests.

Two-sample operators take rows (series, side, value) with side `a` or `b` and give one row a series; group tests take
(series, grp, value). Pooled values are first counted by their different values, so that the ordered passes run over
those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftlake.functions.columns import chisq_sf, f_sf, finite, kolmogorov_sf, normal_sf, t_two_sided
from driftlake.operators.basics import excess_kurtosis, tied_ranks
from driftlake.operators.series import ranked, with_percentiles, with_stats


def _a() -> Column:
    return F.col("side") == "a"


def _b() -> Column:
    return F.col("side") == "b"


def split(df: DataFrame, first: Column) -> DataFrame:
    """(series, side, value): rows for which first holds are side a."""
    return df.where(finite(F.col("value"))).select("series", F.when(first, "a").otherwise("b").alias("side"), "value")


def _counted(pooled: DataFrame) -> DataFrame:
    """(series, value, ca, cb, na, nb, ua, ub): counts at each value, in all, and up to it."""
    counts = pooled.groupBy("series", "value").agg(F.count(F.when(_a(), 1)).alias("ca"), F.count(F.when(_b(), 1)).alias("cb"))
    whole, upto = Window.partitionBy("series"), Window.partitionBy("series").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumns({"na": F.sum("ca").over(whole), "nb": F.sum("cb").over(whole), "ua": F.sum("ca").over(upto), "ub": F.sum("cb").over(upto)})


def ks(pooled: DataFrame, compat_ties: bool = False) -> DataFrame:
    """(series, d, n, m, p): the largest difference of the empirical distributions. compat_ties counts tied values pair
    by pair, as a merge of the two sorted samples would."""
    c = _counted(pooled)
    gap = lambda a, b: F.abs(a / F.col("na") - b / F.col("nb"))
    at = gap(F.col("ua"), F.col("ub"))
    if compat_ties:
        pa, pb, lo = F.col("ua") - F.col("ca"), F.col("ub") - F.col("cb"), F.least("ca", "cb")
        at = F.greatest(at, gap(pa + lo, pb + lo))
    out = c.where("na > 0 and nb > 0").groupBy("series").agg(F.max(at).alias("d"), F.first("na").alias("n"), F.first("nb").alias("m"))
    return out.withColumn("p", kolmogorov_sf(F.col("d"), F.col("n"), F.col("m")))


def wasserstein(pooled: DataFrame) -> DataFrame:
    """(series, w): mean difference of matched quantiles, as many as the larger sample has values."""
    places_of = ranked(pooled, ("series", "side"), "value").withColumn("r", F.col("rank") - 1)
    sizes = pooled.groupBy("series").agg(F.count(F.when(_a(), 1)).alias("na"), F.count(F.when(_b(), 1)).alias("nb")).where("na > 0 and nb > 0")
    n = F.greatest("na", "nb")
    # each place of the larger sample with the one of the smaller sample that stands for its quantile
    own = places_of.join(sizes, "series")
    larger = F.when(F.col("na") >= F.col("nb"), _a()).otherwise(_b())
    many = own.where(larger).withColumn("at", F.floor(F.col("r") * (F.least("na", "nb") - 1) / F.greatest(n - 1, F.lit(1))).cast("long"))
    few = own.where(~larger).select("series", F.col("r").cast("long").alias("at"), F.col("value").alias("other"))
    return many.join(few, ["series", "at"]).groupBy("series").agg(F.avg(F.abs(F.col("value") - F.col("other"))).alias("w"))


def energy(pooled: DataFrame) -> DataFrame:
    """(series, e): 2 E|X-Y| - E|X-X'| - E|Y-Y'|, from ordered values: twice the integral of the squared difference of
    the empirical distributions."""
    c = _counted(pooled)
    step = F.lead("value").over(Window.partitionBy("series").orderBy("value")) - F.col("value")
    gap = F.col("ua") / F.col("na") - F.col("ub") / F.col("nb")
    own = c.where("na > 0 and nb > 0").withColumn("t", 2.0 * gap * gap * F.coalesce(step, F.lit(0.0)))
    return own.groupBy("series").agg(F.sum("t").alias("e"))


def jensen_shannon(pooled: DataFrame, bins: int = 20) -> DataFrame:
    """(series, js): Jensen-Shannon divergence of histograms over the joint range, in nats; series without values on one
    side are left out."""
    own = with_stats(pooled, lo=F.min("value"), hi=F.max("value"), na=F.count(F.when(_a(), 1)), nb=F.count(F.when(_b(), 1))).where("na > 0 and nb > 0")
    bin_ = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.floor((F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins) + 1, F.lit(bins)))
    h = own.groupBy("series", bin_.alias("bin")).agg((F.count(F.when(_a(), 1)) / F.first("na")).alias("p"), (F.count(F.when(_b(), 1)) / F.first("nb")).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.ln(F.when(F.col(x) > 0, F.col(x) / m))).otherwise(0.0)
    return h.groupBy("series").agg((F.sum(part("p")) / 2 + F.sum(part("q")) / 2).alias("js"))


def welch(pooled: DataFrame) -> DataFrame:
    """(series, t, df, p)."""
    m = pooled.groupBy("series").agg(*(f.alias(k + s) for s, c in (("a", _a()), ("b", _b())) for k, f in (("n", F.count(F.when(c, 1))), ("m", F.avg(F.when(c, F.col("value")))), ("v", F.var_samp(F.when(c, F.col("value")))))))
    a, b = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    ok = (F.col("na") >= 2) & (F.col("nb") >= 2) & (a + b > 0)
    m = m.withColumn("t", F.when(ok, (F.col("ma") - F.col("mb")) / F.sqrt(a + b)).otherwise(0.0))
    m = m.withColumn("df", F.when(ok, (a + b) ** 2 / (a * a / (F.col("na") - 1) + b * b / (F.col("nb") - 1))).otherwise(1.0))
    return m.select("series", "t", "df", F.when(ok, t_two_sided(F.col("t"), F.col("df"))).otherwise(1.0).alias("p"))


def mann_whitney(pooled: DataFrame) -> DataFrame:
    """(series, u, z, p): normal approximation without corrections for ties or continuity."""
    r = tied_ranks(pooled).groupBy("series").agg(F.count(F.when(_a(), 1)).cast("double").alias("n"), F.count(F.when(_b(), 1)).cast("double").alias("m"), F.sum(F.when(_a(), F.col("rank"))).alias("ra"))
    r = r.where("n > 0 and m > 0").withColumn("u", F.col("ra") - F.col("n") * (F.col("n") + 1) / 2)
    r = r.withColumn("z", (F.col("u") - F.col("n") * F.col("m") / 2) / F.sqrt(F.col("n") * F.col("m") * (F.col("n") + F.col("m") + 1) / 12))
    return r.select("series", "u", "z", (2 * normal_sf(F.abs("z"))).alias("p"))


def kruskal_wallis(groups: DataFrame) -> DataFrame:
    """(series, h, k, n, p): average ranks, no correction for ties."""
    ranks = tied_ranks(groups.where(finite(F.col("value")))).groupBy("series", "grp").agg(F.count("*").cast("double").alias("n"), F.avg("rank").alias("r"))
    whole = ranks.groupBy("series").agg(F.sum("n").alias("total"))
    own = ranks.join(whole, "series").groupBy("series").agg(F.sum(F.col("n") * (F.col("r") - (F.col("total") + 1) / 2) ** 2).alias("s"), F.first("total").alias("n"), F.count("*").alias("k"))
    own = own.withColumn("h", 12.0 / (F.col("n") * (F.col("n") + 1)) * F.col("s"))
    return own.select("series", "h", "k", F.col("n").cast("long").alias("n"), F.when(F.col("k") < 2, 1.0).otherwise(chisq_sf(F.col("h"), F.greatest(F.col("k") - 1, F.lit(1)))).alias("p"))


def anova(groups: DataFrame) -> DataFrame:
    """(series, f, dfb, dfw, p) of (series, grp, value)."""
    g = groups.groupBy("series", "grp").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.coalesce(F.var_pop("value"), F.lit(0.0)).alias("v"))
    t = g.withColumn("total", F.sum("n").over(Window.partitionBy("series"))).withColumn("grand", F.sum(F.col("n") * F.col("m")).over(Window.partitionBy("series")) / F.col("total"))
    s = t.groupBy("series").agg(F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2).alias("ssb"), F.sum(F.col("n") * F.col("v")).alias("ssw"), (F.count("*") - 1).alias("dfb"), (F.first("total") - F.count("*")).alias("dfw"))
    ok = (F.col("dfb") >= 1) & (F.col("dfw") > 0) & (F.col("ssw") > 0)
    s = s.withColumn("f", F.when(ok, (F.col("ssb") / F.col("dfb")) / (F.nullif(F.col("ssw"), F.lit(0.0)) / F.nullif(F.col("dfw"), F.lit(0)))).otherwise(0.0))
    return s.select("series", "f", "dfb", "dfw", F.when(ok, f_sf(F.col("f"), F.col("dfb"), F.col("dfw"))).otherwise(1.0).alias("p"))


def brown_forsythe(groups: DataFrame) -> DataFrame:
    """The analysis of variance of absolute deviations from group medians, over groups of two values at least."""
    own = groups.where(finite(F.col("value")))
    own = with_percentiles(with_stats(own, ("series", "grp"), _n=F.count("*")).where("_n >= 2"), ("series", "grp"), _m=0.5)
    return anova(own.select("series", "grp", F.abs(F.col("value") - F.col("_m")).alias("value")))


DISTANCES = {"ks": (ks, "d"), "energy": (energy, "e"), "wasserstein": (wasserstein, "w"), "js": (jensen_shannon, "js")}


def compare_distribution(pooled: DataFrame, method: str = "auto") -> DataFrame:
    """(series, method, distance, p) by one method, or by the one chosen for each series: fewer than 20 values in a sample:
    ks; both samples together heavy-tailed: energy; else wasserstein. p is that of ks, else null.

    Both samples need five values; series with fewer are left out."""
    if method != "auto" and method not in DISTANCES:
        raise ValueError(f"no distance {method!r}")
    figures = (F.count(F.when(_a(), 1)).alias("na"), F.count(F.when(_b(), 1)).alias("nb"), excess_kurtosis(F.col("value")).alias("k"))
    sizes = pooled.groupBy("series").agg(*figures).where("na >= 5 and nb >= 5")
    chosen = F.lit(method) if method != "auto" else F.when(F.least("na", "nb") < 20, "ks").when(F.col("k") > 3, "energy").otherwise("wasserstein")
    routed = pooled.join(sizes.select("series", chosen.alias("method")), "series")
    out = None
    for name in ("ks", "energy", "wasserstein") if method == "auto" else (method,):
        work, column = DISTANCES[name]
        found = work(routed.where(F.col("method") == name))
        p = F.col("p") if name == "ks" else F.lit(None).cast("double")
        found = found.select("series", F.lit(name).alias("method"), F.col(column).alias("distance"), p.alias("p"))
        out = found if out is None else out.unionByName(found)
    return out
