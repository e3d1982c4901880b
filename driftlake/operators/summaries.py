"""Short forms of reports, panels and studies, one row each, and what they say in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlake.functions.columns import to_places
from driftlake.operators.composite import SAFETY, STATUS_RANKS

#: How a statement's basis is shown.
LEGEND = "Statement legend: [observed] fact from data; [statistical] computed statistic; [algorithmic] conclusion of a rule; [annotation] note of a user."


def status_label(status: Column) -> Column:
    return F.initcap(F.replace(status, F.lit("_"), F.lit(" ")))


def summary(reports: DataFrame) -> DataFrame:
    """(series, status, score, n, drift, method) of `composite.analyze` reports."""
    return reports.select("series", status_label(F.col("status")).alias("status"), to_places(F.col("score"), 1).alias("score"), "n", "drift", F.col("change_method").alias("method"))


def panel_result(reports: DataFrame, panel: str = "panel") -> DataFrame:
    """(panel, analytes, n, drifting, lowest_score, mean_score, worst_status, worst) of reports (series, status, score, n, drift)
    that belong to panels: how many there are, the least stable status (the first of them by name among equals) and whose
    it is. Sums and extremes only, so a panel may have any number of reports."""
    rank = F.element_at(F.create_map(*[F.lit(x) for p in STATUS_RANKS.items() for x in p]), F.col("status"))
    worst = F.min(F.struct((-rank).alias("r"), F.col("status").alias("s"), F.col("series").cast("string").alias("series")))
    own = reports.groupBy(panel).agg(
        F.count("*").alias("analytes"), F.sum("n").alias("n"), F.count(F.when(F.col("drift"), 1)).alias("drifting"), F.min("score").alias("lowest_score"), F.avg("score").alias("mean_score"), worst.alias("w"),
    )
    return own.select(panel, "analytes", "n", "drifting", "lowest_score", "mean_score", status_label(F.col("w.s")).alias("worst_status"), F.col("w.series").alias("worst"))


def study_summary(studies: DataFrame) -> DataFrame:
    """(series, sites, attribution, grand_mean, between_sd, i2, concordance) of `sites.study`."""
    return studies.select("series", "sites", "attribution", *(F.round(c, 3).alias(c) for c in ("grand_mean", "between_sd")), F.round("i2", 1).alias("i2"), F.round("concordance", 2).alias("concordance"))


def explained_panels(results: DataFrame, panel: str = "panel") -> DataFrame:
    """panel_result with an explanation in words."""
    text = F.format_string(
        "Panel %s: %d analytes of %d values in all, %d drift; mean score %.1f, the lowest %.1f. Worst status: %s (%s), of the analytical process, not of a patient.",
        F.col(panel).cast("string"), F.col("analytes"), F.coalesce("n", F.lit(0)), F.col("drifting"), F.col("mean_score"), F.col("lowest_score"), F.col("worst_status"), F.col("worst"),
    )
    return results.withColumn("explanation", text)


def explained_reconstructions(beats: DataFrame) -> DataFrame:
    """(series, explanation) of a reconstruction's beats (series, beat, basis, label): its statements in order, each with its
    basis, and the legend. A story has few beats."""
    line = F.format_string("[%s] %s", F.col("basis"), F.col("label"))
    own = beats.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("beat", line.alias("line")))).alias("lines"))
    return own.select("series", F.concat_ws("\n", F.transform("lines", lambda x: x["line"]), F.lit(LEGEND), F.lit(SAFETY)).alias("explanation"))


def explained_saved(report: dict) -> str:
    """A report read from JSON in words; what it does not hold is left out."""
    parts = []
    name, status, score, n = (report.get(k) for k in ("series", "status", "score", "n"))
    if name is not None:
        parts.append(f"Report of {name}.")
    if status is not None:
        parts.append(f"Status {str(status).replace('_', ' ')}" + (f" with a score of {score:.1f}" if score is not None else "") + (f" over {n} values." if n is not None else "."))
    if report.get("drift") is not None:
        parts.append(f"A {report.get('drift_kind')} drift was detected." if report["drift"] else "No drift was detected.")
    for title in ("evidence", "limitations"):
        parts += [str(x) for x in report.get(title) or []]
    return " ".join([*parts, LEGEND])
