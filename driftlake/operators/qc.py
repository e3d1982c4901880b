"""Quality-control rules over control measurements, outliers and control charts.

Specs are one row a series: center and sd. Rules annotate rows; nothing is removed unless asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftlake.functions.columns import finite
from driftlake.operators.series import by_series, median_deviations, with_percentiles, with_stats

#: Severity of each rule when it fires.
SEVERITY = {"1-3s": "critical", "1-2s": "watch", "2-2s": "warning", "R-4s": "warning", "4-1s": "warning", "10x": "warning", "7T": "watch"}
_custom: dict[str, tuple[Callable[[Column, Window], Column], str]] = {}


def spec_of(df: DataFrame) -> DataFrame:
    """(series, center, sd) from the measurements themselves."""
    return df.where(finite(F.col("value"))).groupBy("series").agg(F.avg("value").alias("center"), F.stddev_samp("value").alias("sd"))


def in_sd(df: DataFrame, spec: DataFrame) -> DataFrame:
    """Finite rows with i (their place in the series), center, sd and z (null for a series without spread)."""
    own = df.where(finite(F.col("value"))).join(spec, "series")
    return own.withColumn("i", F.row_number().over(by_series())).withColumn("z", (F.col("value") - F.col("center")) / F.nullif("sd", F.lit(0.0)))


def flagged(df: DataFrame, spec: DataFrame, rules: tuple[str, ...] = tuple(SEVERITY)) -> DataFrame:
    """Rows with their place, z and a flag for each rule (_hit0, _hit1, ...), all from one ordered pass over a series."""
    own, w = in_sd(df, spec), by_series()
    v, m, s = F.col("value"), F.col("center"), F.col("sd")
    side = lambda k: F.when(v > m + k * s, 1).when(v < m - k * s, -1).otherwise(0)
    needed = {"2-2s": {"_s2": side(2)}, "4-1s": {"_s1": side(1)}, "10x": {"_s0": side(0)}, "7T": {"_d": v - F.lag("value").over(w)}}
    own = own.withColumns({k: c for r in rules for k, c in needed.get(r, {}).items()} or {"_none": F.lit(0)})
    # a row in a run of at least so many on one side: so many rows back the side was the same all along
    run = lambda c, n: (F.col(c) != 0) & (F.count("*").over(w.rowsBetween(1 - n, 0)) == n) & (F.min(c).over(w.rowsBetween(1 - n, 0)) == F.max(c).over(w.rowsBetween(1 - n, 0)))
    last = w.rowsBetween(-5, 0)
    hits = {
        "1-3s": lambda: F.abs(v - m) > 3 * s, "1-2s": lambda: F.abs(v - m) > 2 * s, "2-2s": lambda: (F.col("_s2") != 0) & (F.lag("_s2").over(w) == F.col("_s2")),
        "R-4s": lambda: F.abs(v - F.lag("value").over(w)) > 4 * s, "4-1s": lambda: run("_s1", 4), "10x": lambda: run("_s0", 10),
        "7T": lambda: (F.sum((F.col("_d") > 0).cast("int")).over(last) == 6) | (F.sum((F.col("_d") < 0).cast("int")).over(last) == 6),
    }
    out = {}
    for i, rule in enumerate(rules):
        if rule not in hits and rule not in _custom:
            raise ValueError(f"no rule {rule!r}")
        hit = hits[rule]() if rule in hits else _custom[rule][0](F.col("z"), w)
        out[f"_hit{i}"] = F.coalesce(hit, F.lit(False))
    return own.withColumns(out)


def rule_hits(df: DataFrame, spec: DataFrame, rule: str) -> DataFrame:
    """(series, i, ts, value) of the rows at which a rule fires; rules by name, or one registered with `qc_rule`."""
    return flagged(df, spec, (rule,)).where("_hit0").select("series", "i", "ts", "value")


def qc_rule(name: str, severity: str = "warning"):
    """Registers a rule: a function of z and the series' window that gives a condition."""

    def add(fn: Callable[[Column, Window], Column]):
        _custom[name] = fn, severity
        return fn

    return add


def severity_of(rule: str) -> str:
    return SEVERITY.get(rule) or _custom[rule][1]


def monitor(df: DataFrame, spec: DataFrame, rules: tuple[str, ...] = tuple(SEVERITY)) -> DataFrame:
    """(series, rule, severity, n_hits, first_i) for each rule that fires; one pass for all rules."""
    sums = [F.struct(F.lit(r).alias("rule"), F.lit(severity_of(r)).alias("severity"), F.count(F.when(F.col(f"_hit{i}"), 1)).alias("n_hits"), F.min(F.when(F.col(f"_hit{i}"), F.col("i"))).alias("first_i")) for i, r in enumerate(rules)]
    each = flagged(df, spec, rules).groupBy("series").agg(F.array(*sums).alias("each"))
    return each.select("series", F.explode("each").alias("e")).select("series", "e.*").where("n_hits > 0")


def levey_jennings(df: DataFrame, spec: DataFrame) -> DataFrame:
    """Rows with their place, z and the limits of one, two and three standard deviations."""
    own = in_sd(df, spec)
    limits = {f"{sign}{k}": F.col("center") + (k if sign == "p" else -k) * F.col("sd") for k in (1, 2, 3) for sign in "pm"}
    return own.select("series", "i", "ts", "value", "z", "center", *(c.alias(k) for k, c in limits.items()))


def outliers(df: DataFrame, method: str = "mad", k: float | None = None) -> DataFrame:
    """df's finite rows with score and is_outlier. mad (or robust_z), zscore: |score| above k (3.5); iqr: outside the
    quartiles by k (1.5) interquartile ranges."""
    own = df.where(finite(F.col("value")))
    if method == "iqr":
        k = 1.5 if k is None else k
        own = with_percentiles(own, _q1=0.25, _q3=0.75, _m=0.5)
        width = F.col("_q3") - F.col("_q1")
        score = F.when(width == 0, 0.0).otherwise((F.col("value") - F.col("_m")) / F.nullif(width, F.lit(0.0)))
        flag = (F.col("value") < F.col("_q1") - k * width) | (F.col("value") > F.col("_q3") + k * width)
        return own.withColumn("score", score).withColumn("is_outlier", flag).drop("_q1", "_q3", "_m")
    if method not in ("mad", "robust_z", "zscore"):
        raise ValueError(f"no outlier method {method!r}")
    k = 3.5 if k is None else k
    if method == "zscore":
        own = with_stats(own, _c=F.avg("value"), _s=F.stddev_samp("value"))
    else:
        own = own.join(median_deviations(own).withColumnsRenamed({"med": "_c", "mad": "_s"}), "series")
    scale = F.when(finite(F.col("_s")) & (F.col("_s") > 0), F.col("_s")).otherwise(1.0)
    own = own.withColumn("score", (F.col("value") - F.col("_c")) / scale)
    return own.withColumn("is_outlier", F.abs("score") > k).drop("_c", "_s")


def without_outliers(df: DataFrame, policy: str = "annotate", method: str = "mad") -> DataFrame:
    """df's finite rows by a policy: annotate keeps all of them, with score and is_outlier; remove drops outliers."""
    if policy not in ("annotate", "remove"):
        raise ValueError(f"no outlier policy {policy!r}")
    found = outliers(df, method)
    return found if policy == "annotate" else found.where("not is_outlier").drop("score", "is_outlier")
