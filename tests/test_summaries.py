"""Summaries, explanations, charts that say what they leave out, and report files of panels and studies."""

import json

from pyspark.sql import functions as F

from driftlake.operators import summaries
from driftlake.sources import pages, tables


def reports(spark):
    rows = [("b", "p", "critical", 20.0, 30, True), ("a", "p", "critical", 25.0, 10, False), ("c", "p", "stable", 95.0, 40, False), ("d", "q", "watch", 80.0, 5, False), ("e", None, "warning", 60.0, None, True)]
    return spark.createDataFrame(rows, "series string, panel string, status string, score double, n long, drift boolean").withColumn("change_method", F.lit("pelt"))


def test_panels_in_short_and_in_words(spark):
    found = {r.panel: r for r in summaries.explained_panels(summaries.panel_result(reports(spark))).collect()}
    p = found["p"]
    assert (p.analytes, p.n, p.drifting, p.lowest_score, p.worst_status, p.worst) == (3, 80, 1, 20.0, "Critical", "a")
    assert "Panel p: 3 analytes" in p.explanation and "not of a patient" in p.explanation and found[None].n is None and "0 values" in found[None].explanation
    short = {r.series: r for r in summaries.summary(reports(spark)).collect()}
    assert short["d"].status == "Watch" and short["d"].method == "pelt"


def test_reconstructions_and_saved_reports_in_words(spark):
    beats = spark.createDataFrame([("s", 2, "algorithmic", "Drift"), ("s", 1, "observed", "Lot changed"), ("t", 1, "statistical", "Stable")], "series string, beat int, basis string, label string")
    text = {r.series: r.explanation for r in summaries.explained_reconstructions(beats).collect()}
    assert text["s"].splitlines()[:2] == ["[observed] Lot changed", "[algorithmic] Drift"] and summaries.LEGEND in text["t"]
    said = summaries.explained_saved({"series": "s", "status": "drift_suspected", "score": 61.24, "n": 9, "drift": True, "drift_kind": "linear", "evidence": ["Seen."]})
    assert "Status drift suspected with a score of 61.2 over 9 values. A linear drift was detected. Seen." in said and summaries.explained_saved({}) == summaries.LEGEND


def test_charts_say_what_they_leave_out(spark):
    own = reports(spark)
    chart = pages.panel_chart(own)
    assert chart.count("<rect") == 5 and "20 critical" in chart and "not shown" not in chart and pages.panel_chart(own.where("false")).startswith("<svg")
    many = spark.range(700).select(F.format_string("%04d", "id").alias("series"), F.lit("watch").alias("status"), F.lit(70.0).alias("score"))
    assert "the first 640 of 700; 60 are not shown" in pages.panel_chart(many)
    rows = spark.range(700).select(F.format_string("%04d", "id").alias("name"), F.lit(1.0).alias("mid"), F.lit(0.0).alias("low"), F.lit(2.0).alias("high"))
    assert "60 are not shown" in pages.forest_chart(rows) and "not shown" not in pages.forest_chart(rows.limit(640))


def test_files_of_panels_and_studies(spark, tmp_path):
    own = reports(spark).orderBy("series")
    studies = spark.createDataFrame([("study", "global", float("nan"))], "series string, attribution string, i2 double")
    for name, more, keys in (("r.json", {}, {"schema_version", "reports"}), ("p.json", {"panel": "panel"}, {"schema_version", "kind", "panels"}), ("s.json", {"study": studies}, {"schema_version", "kind", "studies", "site_reports"})):
        path = str(tmp_path / name)
        tables.save_reports(own, path, **more)
        with open(path) as f:
            held = json.load(f)
        assert set(held) == keys and {r["series"] for r in tables.load_reports(spark, path)} == set("abcde")
    with open(tmp_path / "s.json") as f:
        assert json.load(f)["studies"] == [{"series": "study", "attribution": "global", "i2": None}]


def test_a_missed_rank_raises(spark, monkeypatch):
    import pytest

    from driftlake.operators import series

    rows = spark.range(3000).select(F.lit("s").alias("series"), F.col("id").cast("double").alias("value"))
    assert series.percentiles(rows, ("series",), "value", m=0.5).first().m == 1499.5
    monkeypatch.setattr(series, "SKETCH", 1000)
    plain = F.percentile_approx
    for off in (-0.3, 0.3):  # brackets beside the rank
        monkeypatch.setattr(series.F, "percentile_approx", lambda c, q, n, off=off: plain(c, [min(1.0, max(0.0, x + off)) for x in q], n))
        with pytest.raises(Exception, match="missed the rank"):
            series.percentiles(rows, ("series",), "value", m=0.5).collect()
