"""Ingest, aggregates and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlake.functions.columns import truthy
from driftlake.functions.units import converted, normalized_column
from driftlake.operators import basics as ops
from driftlake.operators.series import from_table, in_turn, valid
from driftlake.plans.base import T, U, by_type, by_user, query, r, rounded, table

_HOLES_SQL = "CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 'nan'::DOUBLE WHEN event_id % 19 = 0 THEN 'inf'::DOUBLE ELSE value END"


def with_holes(spark, sf):
    """Values that a sensor could not give: every thirteenth is null, every seventeenth NaN, every nineteenth infinite."""
    seq = F.col("seq")
    holes = F.when(seq % 13 == 0, F.lit(None)).when(seq % 17 == 0, F.lit(float("nan"))).when(seq % 19 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return by_type(spark, sf).withColumn("value", holes)


@query("valid_filter", f"SELECT event_type AS series, event_id AS seq, value FROM (SELECT event_type, event_id, {_HOLES_SQL} AS value FROM events) WHERE value IS NOT NULL AND isfinite(value)")
def valid_filter(spark, sf):
    return valid(with_holes(spark, sf)).select("series", "seq", "value")


@query("column_mapping", "SELECT l_returnflag AS series, CAST(l_quantity AS DOUBLE) AS value, l_shipdate AS ts, l_linestatus AS batch, count(*) AS n FROM lineitem WHERE isfinite(l_quantity) GROUP BY ALL")
def column_mapping(spark, sf):
    rows = from_table(table(spark, sf, "lineitem"), value="l_quantity", time="l_shipdate", series="l_returnflag", batch="l_linestatus")
    return rows.groupBy("series", "value", "ts", "batch").agg(F.count("*").alias("n"))


@query("missing_fraction", f"SELECT event_type AS series, round(avg(CASE WHEN v IS NULL OR NOT isfinite(v) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS missing FROM (SELECT event_type, {_HOLES_SQL} AS v FROM events) GROUP BY event_type")
def missing(spark, sf):
    return rounded(with_holes(spark, sf).groupBy("series").agg(ops.missing_fraction(F.col("value")).alias("missing")))


@query("unit_convert", "SELECT event_id AS seq, round(value * 10.0::DOUBLE / 180.156::DOUBLE, 6) AS mmol, round(value * 100.0::DOUBLE, 6) AS mg, CASE WHEN event_type = 'view' THEN 'mg/dL' ELSE 'mmol/L' END AS unit FROM events")
def unit_convert(spark, sf):
    spelt = F.when(F.col("series") == "view", F.lit("mg/dl")).otherwise(F.lit(" mmol/l"))
    rows = by_type(spark, sf).select("seq", converted(F.col("value"), "mg/dl", "mmol/L", molar_mass=180.156).alias("mmol"), converted(F.col("value"), "g/L", "mg/dL").alias("mg"), normalized_column(spelt).alias("unit"))
    return rounded(rows)


@query("downsample_series", f"WITH {T}, n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts, seq) AS i, count(*) OVER (PARTITION BY series) AS n FROM e) SELECT series, CAST(i AS BIGINT) AS i, value FROM n WHERE (i - 1) % CAST(ceil(n / 640.0) AS BIGINT) = 0")
def downsample(spark, sf):
    from driftlake.operators.series import running

    rows = running(by_type(spark, sf), {"_s": F.lit(0.0)})
    return rows.where((F.col("i") - 1) % F.ceil(F.col("n") / 640.0) == 0).select("series", "i", "value")


@query("truthy_control", "SELECT event_id AS seq, lower(trim(CASE WHEN event_id % 4 = 0 THEN 'QC' WHEN event_id % 4 = 1 THEN ' yes' WHEN event_id % 4 = 2 THEN 'no' ELSE CAST(event_id % 3 AS VARCHAR) END)) IN ('qc', 'yes', '1', '2') AS control FROM events")
def truthy_control(spark, sf):
    said = F.when(F.col("seq") % 4 == 0, "QC").when(F.col("seq") % 4 == 1, " yes").when(F.col("seq") % 4 == 2, "no").otherwise((F.col("seq") % 3).cast("string"))
    return by_type(spark, sf).select("seq", truthy(said).alias("control"))


_MAD = "1.4826::DOUBLE * median(abs(value - m))"


@query("baseline", f"WITH {T}, m AS (SELECT *, median(value) OVER (PARTITION BY series) AS m FROM e) SELECT series, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(any_value(m), 6) AS median, round({_MAD}, 6) AS mad FROM m GROUP BY series")
def baseline(spark, sf):
    return rounded(ops.baseline(by_type(spark, sf)))


@query("robust_mad", f"WITH {U}, m AS (SELECT *, median(value) OVER (PARTITION BY series) AS m FROM e) SELECT series, round({_MAD}, 6) AS mad FROM m GROUP BY series")
def robust_mad(spark, sf):
    return rounded(ops.robust_mad(by_user(spark, sf)))


@query("excess_kurtosis", f"WITH {T} SELECT series, round(coalesce(kurtosis_pop(value), 0), 6) AS kurtosis FROM e GROUP BY series")
def kurtosis(spark, sf):
    return rounded(by_type(spark, sf).groupBy("series").agg(ops.excess_kurtosis(F.col("value")).alias("kurtosis")))


@query("quantiles", f"WITH {T} SELECT series, round(quantile_cont(value, 0.025), 6) AS q025, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.975), 6) AS q975 FROM e GROUP BY series")
def quantiles(spark, sf):
    qs = {"q025": 0.025, "q25": 0.25, "q50": 0.5, "q975": 0.975}
    return rounded(by_type(spark, sf).groupBy("series").agg(*(F.percentile("value", F.lit(q)).alias(k) for k, q in qs.items())))


_UNCERTAIN = "CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 7 + 1) * 0.5::DOUBLE END"


def uncertain(spark, sf):
    return by_type(spark, sf).withColumn("uncertainty", F.when(F.col("seq") % 5 == 0, F.lit(None)).otherwise((F.col("seq") % 7 + 1) * 0.5))


@query("ivw_mean", f"SELECT event_type AS series, round(sum(value / (u * u)) / sum(1.0::DOUBLE / (u * u)), 6) AS weighted_mean FROM (SELECT *, {_UNCERTAIN} AS u FROM events) WHERE u > 0 GROUP BY event_type")
def ivw_mean(spark, sf):
    return rounded(uncertain(spark, sf).groupBy("series").agg(ops.inverse_variance_mean(F.col("value"), F.col("uncertainty")).alias("weighted_mean")))


@query("uncertainty_budget", f"WITH b AS (SELECT event_type AS series, count(*) AS n, stddev_samp(value) AS sigma, sqrt(avg(u * u)) AS rms, sum(value / (u * u)) / sum(1.0::DOUBLE / (u * u)) AS weighted_mean FROM (SELECT *, {_UNCERTAIN} AS u FROM events) GROUP BY event_type) SELECT series, n, round(sigma, 6) AS sigma, round(rms, 6) AS rms, round(weighted_mean, 6) AS weighted_mean, round(sqrt(sigma ** 2 + rms ** 2), 6) AS combined, round(sqrt(sigma ** 2 + rms ** 2) / sqrt(n), 6) AS standard_error FROM b")
def uncertainty_budget(spark, sf):
    return rounded(ops.uncertainty_budget(uncertain(spark, sf)))


_PLACED = "p AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY ts, seq) AS k, value AS y FROM e)"


@query("theil_sen", f"WITH {U}, {_PLACED}, s AS (SELECT a.series, median((b.y - a.y) / (b.k - a.k)) AS slope FROM p a JOIN p b ON a.series = b.series AND a.k < b.k GROUP BY a.series) SELECT p.series, round(any_value(coalesce(slope, 0)), 6) AS slope, round(median(y - coalesce(slope, 0) * k), 6) AS intercept FROM p LEFT JOIN s ON p.series = s.series GROUP BY p.series")
def theil_sen(spark, sf):
    from driftlake.operators.series import by_series

    pairs = by_user(spark, sf).withColumn("k", F.row_number().over(by_series())).select("series", "k", F.col("k").cast("double").alias("x"), F.col("value").alias("y"))
    return rounded(ops.theil_sen(pairs))


@query("boxcox_lambda", "WITH v AS (SELECT o_orderpriority AS series, o_totalprice AS x FROM orders WHERE o_totalprice > 0), g AS (SELECT unnest(range(-40, 41)) AS k), y AS (SELECT series, k, round(k * 0.05::DOUBLE, 10) AS l, x FROM v, g), f AS (SELECT series, k, any_value(l) AS power, (any_value(l) - 1.0::DOUBLE) * sum(ln(x)) - count(*) / 2.0::DOUBLE * ln(var_samp(CASE WHEN abs(l) < 1e-8 THEN ln(x) ELSE (pow(x, l) - 1.0::DOUBLE) / nullif(l, 0) END)) AS ll FROM y GROUP BY series, k) SELECT series, power FROM f QUALIFY row_number() OVER (PARTITION BY series ORDER BY round(ll, 7) DESC, k) = 1")
def boxcox_lambda(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("series"), "o_totalprice")
    return ops.boxcox_lambda(orders, "series", "o_totalprice")


@query("standardize", f"WITH {T}, m AS (SELECT *, avg(value) OVER w AS a, stddev_samp(value) OVER w AS s FROM e WINDOW w AS (PARTITION BY series)) SELECT seq, round((value - a) / s, 6) AS z FROM m")
def standardize(spark, sf):
    return rounded(ops.standardized(by_type(spark, sf)).select("seq", "z"))


@query("standardize_robust", f"WITH {T}, m AS (SELECT *, median(value) OVER (PARTITION BY series) AS m FROM e), d AS (SELECT *, 1.4826::DOUBLE * median(abs(value - m)) OVER (PARTITION BY series) AS s FROM m) SELECT seq, round((value - m) / s, 6) AS z FROM d")
def standardize_robust(spark, sf):
    return rounded(ops.standardized(by_type(spark, sf), robust=True).select("seq", "z"))


@query("tied_ranks", f"WITH {T} SELECT seq, rank() OVER (PARTITION BY series ORDER BY value) + (count(*) OVER (PARTITION BY series, value) - 1) / 2.0::DOUBLE AS rank FROM e")
def tied_ranks(spark, sf):
    return ops.tied_ranks(by_type(spark, sf)).select("seq", F.col("rank").cast("double").alias("rank"))


@query("cadence", f"WITH {U}, d AS (SELECT series, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series ORDER BY ts, seq))) / 1e6::DOUBLE AS dt FROM e), m AS (SELECT series, dt, median(dt) OVER (PARTITION BY series) AS m FROM d WHERE dt > 0), a AS (SELECT series, count(*) AS n_steps, any_value(m) AS median_step, avg(abs(dt - m) / m) AS s FROM m GROUP BY series) SELECT c.series, coalesce(n >= 4 AND n_steps >= 3 AND s < 0.35, FALSE) AS regular, coalesce(n_steps, 0) AS n_steps, round(median_step, 3) AS median_step FROM (SELECT series, count(*) AS n FROM e GROUP BY series) c LEFT JOIN a ON c.series = a.series")
def cadence(spark, sf):
    return rounded(ops.regular_cadence(by_user(spark, sf)), 3)


@query("lot_transitions", f"WITH {T}, l AS (SELECT series, seq, ts, 'W' || CAST(weekofyear(ts) AS VARCHAR) AS lot FROM e WHERE seq % 6 <> 0), g AS (SELECT *, lag(lot) OVER (PARTITION BY series ORDER BY ts, seq) AS f FROM l) SELECT series, ts, f AS from_value, lot AS to_value FROM g WHERE f <> lot")
def lot_transitions(spark, sf):
    lot = F.when(F.col("seq") % 6 != 0, F.concat(F.lit("W"), F.weekofyear("ts").cast("string")))
    return ops.lot_transitions(by_type(spark, sf).withColumn("lot", lot))


@query("cusum_path", f"WITH {T}, m AS (SELECT *, value - avg(value) OVER (PARTITION BY series) AS d FROM e) SELECT series, row_number() OVER w AS i, round(sum(d) OVER w, 4) + 0.0 AS s FROM m WINDOW w AS (PARTITION BY series ORDER BY ts, seq)")
def cusum_path(spark, sf):
    return rounded(ops.cusum_path(by_type(spark, sf)), 4)


_SF = "(0.5::DOUBLE * (t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE))))) * exp(-a * a))"
#: Adds p, twice the normal tail of z, to a relation with z.
TWO_SIDED = "SELECT *, 2 * " + _SF + " AS p FROM (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + 0.3275911::DOUBLE * a) AS t FROM (SELECT *, abs(z) / sqrt(2.0::DOUBLE) AS a FROM {0}))"


@query("runs_test", f"WITH {U}, c AS (SELECT *, value - avg(value) OVER (PARTITION BY series) AS d FROM e), s AS (SELECT *, lag(d > 0) OVER (PARTITION BY series ORDER BY ts, seq) AS l FROM c WHERE d <> 0), g AS (SELECT series, sum(CASE WHEN l IS NULL OR l <> (d > 0) THEN 1 ELSE 0 END)::BIGINT AS runs, sum(CASE WHEN d > 0 THEN 1.0::DOUBLE ELSE 0 END) AS a, sum(CASE WHEN d > 0 THEN 0 ELSE 1.0::DOUBLE END) AS b FROM s GROUP BY series), z AS (SELECT series, runs, a + b AS n, (runs - (1 + 2 * a * b / (a + b))) / sqrt(2 * a * b * (2 * a * b - a - b) / ((a + b) ** 2 * (a + b - 1))) AS z FROM g), p AS ({TWO_SIDED.format('z')}) SELECT series, runs, round(CASE WHEN n < 8 THEN 0 ELSE z END, 6) AS z, round(CASE WHEN n < 8 THEN 1 ELSE p END, 6) AS p FROM p")
def runs_test(spark, sf):
    e = by_user(spark, sf)
    # added in the order of arrival, as a value may be the mean but for its last bits, and has a sign then
    means = in_turn(e, "seq", s=F.col("value")).select("series", (F.col("s") / F.col("n")).alias("m"))
    own = e.join(means, "series").withColumn("d", F.col("value") - F.col("m"))
    return rounded(ops.runs_test(own, "d"))


@query("bh_adjust", f"WITH {U}, p AS (SELECT series, (sum(value) - floor(sum(value))) AS p FROM e GROUP BY series), k AS (SELECT series, round(p, 6) AS p FROM p), r AS (SELECT *, row_number() OVER (ORDER BY p, series) AS r, count(*) OVER () AS n FROM k) SELECT series, p, round(least(1.0, min(p * n / r) OVER (ORDER BY r DESC)), 6) AS q FROM r")
def bh_adjust(spark, sf):
    s = F.col("s")
    return rounded(ops.bh_adjusted(in_turn(by_user(spark, sf), "seq", s=F.col("value")).select("series", r(s - F.floor(s)).alias("p"))))
