"""QC rules, control charts and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlake.operators import qc
from driftlake.plans.base import T, by_type, query, rounded, table
from driftlake.sources.tables import cell_kind, cell_number, cell_time, cell_truth

#: Rules are tried against tighter limits than the series' own spread, so that each of them fires.
_SPEC = "s AS (SELECT series, avg(value) AS m, stddev_samp(value) / 2 AS s FROM e GROUP BY series)"
_Q = f"WITH {T}, {_SPEC}, q AS (SELECT e.series, seq, ts, value, m, s, row_number() OVER w AS i, lag(value) OVER w AS l FROM e JOIN s ON e.series = s.series WINDOW w AS (PARTITION BY e.series ORDER BY ts, seq))"
_OUT = "SELECT series, i, ts, value FROM "


def spec(df):
    return qc.spec_of(df).withColumn("sd", F.col("sd") / 2)


def _side(k: int) -> str:
    return f"CASE WHEN value > m + {k} * s THEN 1 WHEN value < m - {k} * s THEN -1 ELSE 0 END"


def _runs(k: int, n: int) -> str:
    return f"""{_Q}, a AS (SELECT *, {_side(k)} AS d FROM q), b AS (SELECT *, CASE WHEN d IS DISTINCT FROM lag(d) OVER (PARTITION BY series ORDER BY i) THEN 1 ELSE 0 END AS c FROM a),
    g AS (SELECT *, sum(c) OVER (PARTITION BY series ORDER BY i) AS g FROM b), h AS (SELECT *, row_number() OVER (PARTITION BY series, g ORDER BY i) AS k FROM g) {_OUT} h WHERE d <> 0 AND k >= {n}"""


RULES = {
    "1-3s": f"{_Q} {_OUT} q WHERE abs(value - m) > 3 * s",
    "1-2s": f"{_Q} {_OUT} q WHERE abs(value - m) > 2 * s",
    "2-2s": f"{_Q}, d AS (SELECT *, {_side(2)} AS d FROM q), g AS (SELECT *, lag(d) OVER (PARTITION BY series ORDER BY i) AS f FROM d) {_OUT} g WHERE d <> 0 AND d = f",
    "R-4s": f"{_Q} {_OUT} q WHERE abs(value - l) > 4 * s",
    "4-1s": _runs(1, 4),
    "10x": _runs(0, 10),
    "7T": f"{_Q}, d AS (SELECT *, sign(value - l) AS d FROM q), g AS (SELECT *, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) OVER f AS u, sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) OVER f AS v FROM d WINDOW f AS (PARTITION BY series ORDER BY i ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) {_OUT} g WHERE u = 6 OR v = 6",
}


def _rule(name: str):
    @query("qc_" + name.lower().replace("-", "_"), RULES[name])
    def run(spark, sf):
        e = by_type(spark, sf)
        return qc.rule_hits(e, spec(e), name).withColumn("i", F.col("i").cast("bigint"))


for _name in RULES:
    _rule(_name)


@query("levey_jennings", f"{_Q} SELECT series, i, ts, value, round((value - m) / s, 6) AS z, round(m, 6) AS center, round(m + s, 6) AS p1, round(m - s, 6) AS m1, round(m + 2 * s, 6) AS p2, round(m - 2 * s, 6) AS m2, round(m + 3 * s, 6) AS p3, round(m - 3 * s, 6) AS m3 FROM q")
def levey_jennings(spark, sf):
    e = by_type(spark, sf)
    return rounded(qc.levey_jennings(e, spec(e)).withColumn("i", F.col("i").cast("bigint")))


@query("monitor", " UNION ALL ".join(f"SELECT series, '{k}' AS rule, '{qc.SEVERITY[k]}' AS severity, count(*) AS n_hits, min(i) AS first_i FROM ({sql}) GROUP BY series" for k, sql in RULES.items()))
def monitor(spark, sf):
    e = by_type(spark, sf)
    return qc.monitor(e, spec(e)).withColumn("first_i", F.col("first_i").cast("bigint"))


@query("qc_custom_rule", f"{_Q}, z AS (SELECT *, (value - m) / s AS z FROM q), y AS (SELECT *, lag(z) OVER (PARTITION BY series ORDER BY i) AS y FROM z) {_OUT} y WHERE z > 1.5 AND y < -1.5")
def custom_rule(spark, sf):
    @qc.qc_rule("swing")
    def swing(z, w):
        return (z > 1.5) & (F.lag("z").over(w) < -1.5)

    e = by_type(spark, sf)
    return qc.rule_hits(e, spec(e), "swing").withColumn("i", F.col("i").cast("bigint"))


_OUTLIERS = "SELECT seq, round(score, 6) AS score, is_outlier FROM"


@query("outliers_mad", f"WITH {T}, m AS (SELECT *, median(value) OVER (PARTITION BY series) AS m FROM e), d AS (SELECT *, (value - m) / (1.4826::DOUBLE * median(abs(value - m)) OVER (PARTITION BY series)) AS score FROM m) {_OUTLIERS} (SELECT *, abs(score) > 3.5 AS is_outlier FROM d)")
def outliers_mad(spark, sf):
    return rounded(qc.outliers(by_type(spark, sf)).select("seq", "score", "is_outlier"))


@query("outliers_zscore", f"WITH {T}, d AS (SELECT *, (value - avg(value) OVER (PARTITION BY series)) / stddev_samp(value) OVER (PARTITION BY series) AS score FROM e) {_OUTLIERS} (SELECT *, abs(score) > 3.5 AS is_outlier FROM d)")
def outliers_zscore(spark, sf):
    return rounded(qc.outliers(by_type(spark, sf), "zscore").select("seq", "score", "is_outlier"))


_IQR = f"WITH {T}, q AS (SELECT series, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, median(value) AS m FROM e GROUP BY series), d AS (SELECT e.*, (value - m) / (b - a) AS score, value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS is_outlier FROM e JOIN q ON e.series = q.series)"


@query("outliers_iqr", f"{_IQR} {_OUTLIERS} d")
def outliers_iqr(spark, sf):
    return rounded(qc.outliers(by_type(spark, sf), "iqr").select("seq", "score", "is_outlier"))


@query("outlier_policy_remove", f"{_IQR} SELECT series, seq, value FROM d WHERE NOT is_outlier")
def outlier_policy_remove(spark, sf):
    return qc.outliers(by_type(spark, sf), "iqr").where("not is_outlier").select("series", "seq", "value")


#: Cells as files hold them, made of each event: numbers in several forms, times, truths, empty ones and text.
_CELL = """CASE event_id % 9 WHEN 0 THEN ' ' || CAST(CAST(event_id AS BIGINT) AS VARCHAR) || ' ' WHEN 1 THEN '-' || CAST(event_id % 1000 AS VARCHAR) || '.5e1' WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 3 THEN strftime(ts, '%Y-%m-%d') WHEN 4 THEN 'TRUE' WHEN 5 THEN '  ' WHEN 6 THEN 'NA' WHEN 7 THEN '<' || CAST(event_id % 7 AS VARCHAR) ELSE CAST(event_id % 50 AS VARCHAR) || 'f' END"""


@query("cell_rules", f"""WITH c AS (SELECT event_id, nullif(trim({_CELL}), '') AS t FROM events), k AS (SELECT event_id, t, CASE WHEN t IS NULL THEN 'none' WHEN regexp_matches(t, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN 'number' WHEN regexp_matches(t, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'time' WHEN lower(t) IN ('true', 'false') THEN 'truth' ELSE 'text' END AS kind FROM c)
SELECT event_id, kind, CASE WHEN kind = 'number' THEN TRY_CAST(t AS DOUBLE) END AS number, CASE WHEN kind = 'time' THEN TRY_CAST(t AS TIMESTAMP) END AS at, CASE WHEN kind = 'truth' THEN CASE WHEN lower(t) = 'true' THEN 1 ELSE 0 END END AS truth FROM k""")
def cell_rules(spark, sf):
    """What each cell of a text column is, and its value."""
    e, k = table(spark, sf, "events"), F.col("event_id") % 9
    num = lambda c: c.cast("string")
    t = (
        F.when(k == 0, F.concat(F.lit(" "), num(F.col("event_id")), F.lit(" "))).when(k == 1, F.concat(F.lit("-"), num(F.col("event_id") % 1000), F.lit(".5e1"))).when(k == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
        .when(k == 3, F.date_format("ts", "yyyy-MM-dd")).when(k == 4, "TRUE").when(k == 5, "  ").when(k == 6, "NA").when(k == 7, F.concat(F.lit("<"), num(F.col("event_id") % 7))).otherwise(F.concat(num(F.col("event_id") % 50), F.lit("f")))
    )
    e = e.select("event_id", t.alias("t"))
    return e.select("event_id", cell_kind("t").alias("kind"), cell_number("t").alias("number"), cell_time("t").alias("at"), cell_truth("t").cast("int").alias("truth"))
