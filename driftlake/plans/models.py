"""Calibration, method comparison, batches, reference intervals, sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlake.operators import batches, comparison, reference, sites
from driftlake.plans.base import ORACLE_SQL, T, by_type, by_user, chi2_tail, query, r, rounded, t_tail, table
from driftlake.plans.basics import TWO_SIDED
from driftlake.plans.drifts import auto_sql

#: Two measures of each line of a part: short series, for methods that look at all pairs of a part's lines.
_PAIRS = "p AS (SELECT l_partkey AS series, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS k, l_quantity * 1000.0::DOUBLE AS x, l_extendedprice / 1000.0::DOUBLE * l_tax * 400 + l_quantity * 990.0::DOUBLE AS y FROM lineitem)"


def pairs(spark, sf):
    from pyspark.sql.window import Window

    li = table(spark, sf, "lineitem")
    w = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return li.select(F.col("l_partkey").alias("series"), F.row_number().over(w).alias("k"), (F.col("l_quantity") * 1000.0).alias("x"), (F.col("l_extendedprice") / 1000.0 * F.col("l_tax") * 400 + F.col("l_quantity") * 990.0).alias("y"))


_DIFF = f"{_PAIRS}, d AS (SELECT series, k, (x + y) / 2 AS a, y - x AS d FROM p), s AS (SELECT u.series, median((v.d - u.d) / (v.a - u.a)) AS slope FROM d u JOIN d v ON u.series = v.series AND u.k < v.k AND u.a <> v.a GROUP BY u.series)"


@query("bland_altman", f"WITH {_DIFF}, g AS (SELECT series, count(*) AS n, avg(d) AS bias, stddev_samp(d) AS sd FROM d GROUP BY series) SELECT g.series, n, round(bias, 4) AS bias, round(sd, 4) AS sd, round(bias - 1.96 * sd, 4) AS lower, round(bias + 1.96 * sd, 4) AS upper, round(coalesce(slope, 0), 4) AS proportional FROM g LEFT JOIN s ON s.series = g.series WHERE n >= 8")
def bland_altman(spark, sf):
    return rounded(comparison.bland_altman(pairs(spark, sf)), 4)


@query("deming", f"WITH {_PAIRS}, m AS (SELECT series, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy FROM p GROUP BY series), s AS (SELECT *, coalesce((yy - xx + sqrt((yy - xx) ** 2 + 4 * xy ** 2)) / nullif(2 * xy, 0), 1) AS slope FROM m WHERE n >= 8) SELECT series, n, round(slope, 5) AS slope, round(my - slope * mx, 3) AS intercept FROM s")
def deming(spark, sf):
    return comparison.deming(pairs(spark, sf)).select("series", "n", F.round("slope", 5).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query("passing_bablok", f"""WITH {_PAIRS}, s AS (SELECT a.series, (b.y - a.y) / (b.x - a.x) AS s FROM p a JOIN p b ON a.series = b.series AND a.k < b.k AND a.x <> b.x), r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY s) AS r FROM s),
n AS (SELECT series, count(*)::DOUBLE AS n FROM p GROUP BY series HAVING count(*) >= 8), c AS (SELECT s.series, any_value(n) AS n, count(*)::DOUBLE AS m, count(*) FILTER (s < -1) AS sh FROM s JOIN n ON n.series = s.series GROUP BY s.series),
k AS (SELECT *, 1.96::DOUBLE * sqrt(n * (n - 1) * (2 * n + 5) / 18) AS c FROM c), b AS (SELECT *, greatest(1, least(m, sh + floor((m + 1) / 2))) AS mid, greatest(1, least(m, round_even(sh + (m - c) / 2, 0))) AS lo, greatest(1, least(m, round_even(sh + (m + c) / 2, 0))) AS hi FROM k),
f AS (SELECT r.series, any_value(n)::BIGINT AS n, max(s) FILTER (r = mid) AS slope, max(s) FILTER (r = lo) AS lower, max(s) FILTER (r = hi) AS upper FROM r JOIN b ON b.series = r.series GROUP BY r.series)
SELECT f.series, any_value(n) AS n, round(any_value(slope), 5) AS slope, round(median(y - slope * x), 3) AS intercept, round(any_value(lower), 5) AS lower, round(any_value(upper), 5) AS upper FROM f JOIN p ON p.series = f.series GROUP BY f.series""")
def passing_bablok(spark, sf):
    return comparison.passing_bablok(pairs(spark, sf)).select("series", "n", F.round("slope", 5).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("lower", 5).alias("lower"), F.round("upper", 5).alias("upper"))


_OLS = f"WITH {_PAIRS}, m AS (SELECT series, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM p GROUP BY series HAVING count(*) >= 3), f AS (SELECT *, coalesce(xy / nullif(xx, 0), 0) AS slope FROM m)"


@query("ols_compare", f"{_OLS} SELECT series, n, round(slope, 5) AS slope, round(my - slope * mx, 3) AS intercept, round(CASE WHEN yy = 0 THEN 1 ELSE 1 - greatest(yy - slope * xy, 0) / yy END, 5) AS r2, round(sqrt(greatest(yy - slope * xy, 0)), 2) AS residual_sd FROM f")
def ols_compare(spark, sf):
    return comparison.ols(pairs(spark, sf)).select("series", "n", F.round("slope", 5).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 5).alias("r2"), F.round("residual_sd", 2).alias("residual_sd"))


@query("theil_sen_compare", f"WITH {_PAIRS}, s AS (SELECT a.series, median((b.y - a.y) / (b.x - a.x)) AS slope FROM p a JOIN p b ON a.series = b.series AND a.k < b.k AND a.x <> b.x GROUP BY a.series) SELECT p.series, round(coalesce(any_value(slope), 0), 5) AS slope, round(median(y - coalesce(slope, 0) * x), 3) AS intercept FROM p LEFT JOIN s ON s.series = p.series GROUP BY p.series")
def theil_sen_compare(spark, sf):
    from driftlake.operators.basics import theil_sen

    return theil_sen(pairs(spark, sf)).select("series", F.round("slope", 5).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query("cal_weighted", f"WITH {_PAIRS}, w AS (SELECT *, 1 / (abs(x) + 0.1::DOUBLE) AS w FROM p), m AS (SELECT *, sum(w * x) OVER g / sum(w) OVER g AS mx, sum(w * y) OVER g / sum(w) OVER g AS my FROM w WINDOW g AS (PARTITION BY series)), a AS (SELECT series, count(*) AS n, sum(w * (x - mx) ** 2) AS xx, sum(w * (x - mx) * (y - my)) AS xy, any_value(mx) AS mx, any_value(my) AS my FROM m GROUP BY series HAVING count(*) >= 3) SELECT series, n, round(xy / xx, 5) AS slope, round(my - xy / xx * mx, 3) AS intercept FROM a")
def cal_weighted(spark, sf):
    return comparison.weighted(pairs(spark, sf)).select("series", "n", F.round("slope", 5).alias("slope"), F.round("intercept", 3).alias("intercept"))


#: The same pairs by return flag: long series.
_FLAGS = "p AS (SELECT l_returnflag AS series, l_quantity AS x, l_extendedprice / 1000.0::DOUBLE AS y FROM lineitem)"


def flag_pairs(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_returnflag").alias("series"), F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000.0).alias("y"))


_FIT = f"WITH {_FLAGS}, m AS (SELECT series, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM p GROUP BY series), f AS (SELECT *, xy / xx AS slope, my - xy / xx * mx AS icpt FROM m)"


@query("cal_linear", f"{_FIT} SELECT series, n, round(slope, 6) AS slope, round(icpt, 6) AS intercept, round(1 - (yy - slope * xy) / yy, 6) AS r2, round(sqrt(yy - slope * xy), 6) AS residual_sd FROM f")
def cal_linear(spark, sf):
    return rounded(comparison.ols(flag_pairs(spark, sf)))


@query("cal_poly2", f"WITH {_FLAGS}, m AS (SELECT *, x - avg(x) OVER w AS u, y - avg(y) OVER w AS v, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM p WINDOW w AS (PARTITION BY series)), a AS (SELECT series, count(*) AS n, sum(u * u) AS s2, sum(u ** 3) AS s3, sum(u ** 4) AS s4, sum(u * v) AS uy, sum(u * u * v) AS uuy, any_value(mx) AS mx, any_value(my) AS my FROM m GROUP BY series), b AS (SELECT *, (uuy - s3 / s2 * uy) / (s4 - s2 ** 2 / n - s3 ** 2 / s2) AS c2 FROM a), c AS (SELECT *, (uy - c2 * s3) / s2 AS b1, my - c2 * s2 / n AS b0 FROM b) SELECT series, n, round(b0 - b1 * mx + c2 * mx * mx, 5) AS c0, round(b1 - 2 * c2 * mx, 5) AS c1, round(c2, 5) + 0.0 AS c2 FROM c")
def cal_poly2(spark, sf):
    return rounded(comparison.quadratic(flag_pairs(spark, sf)), 5)


@query("cal_predict", f"{_FIT} SELECT p.series, x, count(*) AS n, round(any_value(icpt + slope * x), 6) AS fit, round(sum(y - icpt - slope * x), 4) + 0.0 AS residual FROM p JOIN f ON f.series = p.series GROUP BY p.series, x")
def cal_predict(spark, sf):
    p = flag_pairs(spark, sf)
    own = comparison.predicted(p, comparison.ols(p)).groupBy("series", "x").agg(F.count("*").alias("n"), F.first("fit").alias("fit"), F.sum("residual").alias("residual"))
    return own.select("series", "x", "n", F.round("fit", 6).alias("fit"), (F.round("residual", 4) + 0.0).alias("residual"))


@query("cal_diagnostics", f"{_FIT}, g AS (SELECT p.series, x, count(*) AS m, avg(y) AS my, var_pop(y) AS v, any_value(icpt + slope * x) AS fit FROM p JOIN f ON f.series = p.series GROUP BY p.series, x), l AS (SELECT series, sum(m * v) AS pure, sum(m * (my - fit) ** 2) AS lack, count(*) - 2 AS d1, sum(m)::BIGINT - count(*) AS d2 FROM g GROUP BY series), b AS (SELECT p.series, count(*) AS n, sqrt(avg((y - icpt - slope * x) ** 2)) AS rs, avg(abs((y - icpt - slope * x) / y)) AS re FROM p JOIN f ON f.series = p.series GROUP BY p.series) SELECT b.series, n, round(rs, 5) AS residual_sd, round(re, 5) AS mean_relative_error, round((lack / d1) / (pure / d2), 5) AS lack_of_fit FROM b JOIN l ON l.series = b.series")
def cal_diagnostics(spark, sf):
    p = flag_pairs(spark, sf)
    return rounded(comparison.diagnostics(p, comparison.ols(p), runs=False).drop("p"), 5)


@query("cal_residual_runs", f"""WITH {_PAIRS}, m AS (SELECT series, avg(x) AS mx, avg(y) AS my, var_pop(x) AS xx, covar_pop(x, y) AS xy FROM p GROUP BY series HAVING count(*) >= 8), f AS (SELECT series, coalesce(xy / nullif(xx, 0), 0) AS slope, my - coalesce(xy / nullif(xx, 0), 0) * mx AS icpt FROM m),
c AS (SELECT p.series, x, k, y - icpt - slope * x AS d FROM p JOIN f ON f.series = p.series), s AS (SELECT *, lag(d > 0) OVER (PARTITION BY series ORDER BY x, k) AS l FROM c WHERE d <> 0), g AS (SELECT series, sum(CASE WHEN l IS NULL OR l <> (d > 0) THEN 1 ELSE 0 END)::BIGINT AS runs, sum(CASE WHEN d > 0 THEN 1.0::DOUBLE ELSE 0 END) AS a, sum(CASE WHEN d > 0 THEN 0 ELSE 1.0::DOUBLE END) AS b FROM s GROUP BY series),
z AS (SELECT series, runs, (runs - (1 + 2 * a * b / (a + b))) / sqrt(2 * a * b * (2 * a * b - a - b) / ((a + b) ** 2 * (a + b - 1))) AS z FROM g), p2 AS ({TWO_SIDED.format('z')}) SELECT series, runs, round(z, 6) AS z, round(p, 6) AS p FROM p2""")
def cal_residual_runs(spark, sf):
    """Runs of the residuals of each part's line, for parts of eight lines or more."""
    own = pairs(spark, sf)
    own = own.join(own.groupBy("series").agg(F.count("*").alias("_n")).where("_n >= 8").select("series"), "series", "left_semi")
    return rounded(comparison.residual_runs(own, comparison.ols(own)))


@query("compare_calibrations", "WITH q AS (SELECT l_returnflag AS series, l_linestatus AS h, l_quantity AS x, l_extendedprice / 1000.0::DOUBLE AS y FROM lineitem), m AS (SELECT series, h, avg(x) AS mx, avg(y) AS my, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM q GROUP BY series, h HAVING count(*) >= 3), f AS (SELECT series, h, xy / xx AS s, my - xy / xx * mx AS i, 1 - (yy - xy * xy / xx) / yy AS r, sqrt(yy - xy * xy / xx) AS e FROM m), d AS (SELECT a.series, b.s - a.s AS ds, b.i - a.i AS di, b.r - a.r AS dr, b.e - a.e AS de FROM f a JOIN f b ON a.series = b.series AND a.h = 'F' AND b.h = 'O'), g AS (SELECT DISTINCT series, x FROM q) SELECT d.series, round(any_value(ds), 5) AS slope_delta, round(any_value(di), 5) AS intercept_delta, round(any_value(dr), 5) AS r2_delta, round(any_value(de), 5) AS residual_delta, round(avg(abs(di + ds * x)), 5) AS mean_difference FROM d JOIN g ON g.series = d.series GROUP BY d.series")
def compare_calibrations(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("series"), "l_linestatus", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000.0).alias("y"))
    a, b = (comparison.ols(li.where(F.col("l_linestatus") == s)) for s in "FO")
    return rounded(comparison.compare_curves(a, b, li), 5)


@query("cal_spline")
def cal_spline(spark, sf):
    return rounded(comparison.curve_fits(pairs(spark, sf), "spline"), 4)


@query("cal_4pl")
def cal_4pl(spark, sf):
    return rounded(comparison.curve_fits(pairs(spark, sf), "fourpl"), 4)


@query("calibrate", f"""{_FIT} SELECT series, 'linear' AS model, n, round(icpt, 5) AS c0, round(slope, 5) AS c1, round(1 - (yy - slope * xy) / yy, 5) AS r2, round(sqrt(yy - slope * xy), 5) AS residual_sd FROM f""")
def calibrate(spark, sf):
    c = comparison.calibrate(flag_pairs(spark, sf))
    return rounded(c.select("series", "model", "n", F.col("coefficients")[0].alias("c0"), F.col("coefficients")[1].alias("c1"), "r2", "residual_sd"), 5)


def _polynomials(most: int) -> str:
    """Least squares of degrees 2 to most by orthogonal polynomials: each comes from the two before it and their sums."""
    parts = [f"{_FLAGS}", "t AS (SELECT DISTINCT series, x + 0.5 AS x FROM p)", "q0 AS (SELECT series, x, y, 0.0::DOUBLE AS b, 1.0::DOUBLE AS a FROM p)", "t0 AS (SELECT series, x, 0.0::DOUBLE AS b, 1.0::DOUBLE AS a, 0.0::DOUBLE AS fit FROM t)", "c0 AS (SELECT series, sum(a * a) AS s, sum(x * a * a) / sum(a * a) AS m, sum(y * a) / sum(a * a) AS c, 0.0::DOUBLE AS k FROM q0 GROUP BY series)"]
    for d in range(most + 1):
        parts.append(f"f{d} AS (SELECT t.series, x, t.a, t.b, fit + c * t.a AS fit, m, k FROM t{d} t JOIN c{d} c ON c.series = t.series)")
        if d < most:
            parts.append(f"q{d + 1} AS (SELECT q.series, x, y, a AS b, (x - m) * a - k * b AS a FROM q{d} q JOIN c{d} c ON c.series = q.series)")
            parts.append(f"t{d + 1} AS (SELECT series, x, a AS b, (x - m) * a - k * b AS a, fit FROM f{d})")
            parts.append(f"c{d + 1} AS (SELECT q.series, sum(a * a) AS s, sum(x * a * a) / sum(a * a) AS m, sum(y * a) / sum(a * a) AS c, sum(a * a) / any_value(c.s) AS k FROM q{d + 1} q JOIN c{d} c ON c.series = q.series GROUP BY q.series)")
    return "WITH " + ",\n".join(parts) + "\n" + " UNION ALL ".join(f"SELECT series, x, round(fit, 4) AS fit, {d} AS degree FROM f{d}" for d in range(2, most + 1))


@query("calibrate_polynomial", _polynomials(5))
def calibrate_polynomial(spark, sf):
    """Degrees 2 to 5, with the fit at new x: the middles between the given ones."""
    p, out = flag_pairs(spark, sf), None
    at = p.select("series", (F.col("x") + 0.5).alias("x")).distinct()
    for degree in (2, 3, 4, 5):
        fit = comparison.predict_response(at, comparison.calibrate(p, "polynomial", degree)).withColumn("degree", F.lit(degree))
        out = fit if out is None else out.unionByName(fit)
    return rounded(out, 4)


@query("calibrate_curves")
def calibrate_curves(spark, sf):
    """Splines and logistic curves of each part's lines, at new x."""
    p = pairs(spark, sf)
    at, out = p.select("series", (F.col("x") + 0.5).alias("x")).distinct(), None
    for model in ("spline", "fourpl"):
        fit = comparison.predict_response(at, comparison.calibrate(p, model)).withColumn("model", F.lit(model))
        out = fit if out is None else out.unionByName(fit)
    return rounded(out, 4)


@query("compare_methods", f"""WITH {_PAIRS}, m AS (SELECT series, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy, avg(y - x) AS bias, stddev_samp(y - x) AS sd FROM p GROUP BY series HAVING count(*) >= 8),
d AS (SELECT *, coalesce((yy - xx + sqrt((yy - xx) ** 2 + 4 * xy ** 2)) / nullif(2 * xy, 0), 1) AS de, coalesce(xy / nullif(xx, 0), 0) AS ol FROM m), s AS (SELECT a.series, median((b.y - a.y) / (b.x - a.x)) AS ts FROM p a JOIN p b ON a.series = b.series AND a.k < b.k AND a.x <> b.x GROUP BY a.series),
i AS (SELECT p.series, any_value(coalesce(ts, 0)) AS ts, median(y - coalesce(ts, 0) * x) AS ti FROM p LEFT JOIN s ON s.series = p.series GROUP BY p.series)
SELECT series, 'deming' AS method, n, round(my - de * mx, 3) AS bias, round(de - 1, 5) AS proportional, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper, round(de, 5) AS slope, round(my - de * mx, 3) AS intercept FROM d
UNION ALL SELECT series, 'ols', n, round(my - ol * mx, 3), round(ol - 1, 5), NULL, NULL, round(ol, 5), round(my - ol * mx, 3) FROM d
UNION ALL SELECT d.series, 'theil_sen', n, round(ti, 3), round(ts - 1, 5), NULL, NULL, round(ts, 5), round(ti, 3) FROM d JOIN i ON i.series = d.series
UNION ALL SELECT series, 'bland_altman', n, round(bias, 3), proportional, lower, upper, NULL, NULL FROM ({ORACLE_SQL["bland_altman"].replace("round(bias, 4)", "bias").replace("round(coalesce(slope, 0), 4)", "round(coalesce(slope, 0), 5)")})
UNION ALL SELECT series, 'passing_bablok', n, intercept, round(slope - 1, 5), NULL, NULL, slope, intercept FROM ({ORACLE_SQL["passing_bablok"]})""")
def compare_methods(spark, sf):
    p, out = pairs(spark, sf), None
    for method in comparison.METHODS:
        found = comparison.compare_methods(p, method)
        out = found if out is None else out.unionByName(found)
    places = {"bias": 3, "intercept": 3, "proportional": 5, "slope": 5, "lower": 4, "upper": 4}
    # rounded as the SQL does, by the product with a power of ten: doubles beside a border go the same way
    round_ = lambda c, n: F.round(c * 10.0**n) / 10.0**n
    # of Passing and Bablok's line the SQL takes the rounded slope less 1
    out = out.withColumn("proportional", F.when(F.col("method") == "passing_bablok", round_(F.col("slope"), 5) - 1).otherwise(F.col("proportional")))
    return out.select(*(round_(F.col(c), places[c]).alias(c) if c in places else F.col(c) for c in out.columns))


_RANKED = "r AS (SELECT *, rank() OVER (PARTITION BY series ORDER BY value) + (count(*) OVER (PARTITION BY series, value) - 1) / 2.0::DOUBLE AS r FROM g), u AS (SELECT series, grp, count(*)::DOUBLE AS n, avg(r) AS r FROM r GROUP BY series, grp), t AS (SELECT *, sum(n) OVER (PARTITION BY series) AS total FROM u), h AS (SELECT series, 12.0::DOUBLE / (any_value(total) * (any_value(total) + 1)) * sum(n * (r - (total + 1) / 2) ** 2) AS h, count(*) AS k FROM t GROUP BY series)"


@query("compare_lots", f"""WITH g AS (SELECT o_orderpriority AS series, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'O' END AS grp, o_totalprice AS value FROM orders), {_RANKED},
d AS (SELECT series, grp, abs(value - median(value) OVER (PARTITION BY series, grp)) AS value FROM g), m AS (SELECT series, grp, count(*)::DOUBLE AS n, avg(value) AS m, var_pop(value) AS v FROM d GROUP BY series, grp), w AS (SELECT *, sum(n) OVER x AS total, sum(n * m) OVER x / sum(n) OVER x AS gm FROM m WINDOW x AS (PARTITION BY series)),
f AS (SELECT series, sum(n * (m - gm) ** 2) / (sum(n * v) / (any_value(total) - 2)) AS f, any_value(total) - 2 AS dfw FROM w GROUP BY series), fp AS (SELECT *, {t_tail("sqrt(f)", "dfw")} AS vp FROM f),
q AS (SELECT series, value, count(*) FILTER (grp = 'F') AS ca, count(*) FILTER (grp = 'O') AS cb FROM g GROUP BY series, value), c AS (SELECT *, sum(ca) OVER o / sum(ca) OVER p AS ua, sum(cb) OVER o / sum(cb) OVER p AS ub FROM q WINDOW o AS (PARTITION BY series ORDER BY value), p AS (PARTITION BY series)), s AS (SELECT series, max(abs(ua - ub)) AS d FROM c GROUP BY series)
SELECT h.series, k AS lots, round(h, 5) AS h, round({chi2_tail("h", "k - 1")}, 5) AS location_p, round(f, 5) AS variance_f, round(vp, 5) AS variance_p, round(d, 5) AS ks, {chi2_tail("h", "k - 1")} < 0.05 AS shift_suspected, vp < 0.05 AS variance_shift FROM h JOIN fp ON fp.series = h.series JOIN s ON s.series = h.series""")
def compare_lots(spark, sf):
    """Orders by priority; two lots: finished and other ones. The F of two groups is the square of a t."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("series"), F.when(F.col("o_orderstatus") == "F", "F").otherwise("O").alias("lot"), F.col("o_totalprice").alias("value"))
    return rounded(comparison.compare_lots(comparison.lots_of(o, "reagent_lot", "lot")), 5)


@query("compare_sites", f"WITH g AS (SELECT event_type AS series, user_id % 5 AS grp, value FROM events), {_RANKED} SELECT series, k AS sites, round(h, 6) AS h, round({chi2_tail('h', 'k - 1')}, 6) AS p, {chi2_tail('h', 'k - 1')} < 0.05 AS site_effect_suspected FROM h")
def compare_sites(spark, sf):
    e = by_type(spark, sf)
    return rounded(comparison.compare_sites(e.select("series", (F.col("user_id") % 5).alias("grp"), "value")))


#: Batches: months; groups: users of even number; controls: every tenth event.
_B = "b AS (SELECT event_type AS series, event_id AS seq, CAST(month(ts) AS VARCHAR) AS batch, user_id % 2 AS grp, event_id % 10 = 0 AS control, value FROM events)"


def batched(spark, sf):
    return by_type(spark, sf).select("series", "seq", F.month("ts").cast("string").alias("batch"), (F.col("user_id") % 2).alias("grp"), (F.col("seq") % 10 == 0).alias("control"), "value")


@query("batch_median", f"WITH {_B} SELECT seq, round(value - median(value) OVER (PARTITION BY series, batch) + avg(value) OVER (PARTITION BY series), 6) AS corrected FROM b")
def batch_median(spark, sf):
    return rounded(batches.median_centered(batched(spark, sf)).select("seq", "corrected"))


@query("batch_quantile", f"WITH {_B}, r AS (SELECT *, row_number() OVER (PARTITION BY series, batch ORDER BY value, seq) AS r, count(*) OVER (PARTITION BY series, batch) AS n, count(*) OVER (PARTITION BY series) AS np, row_number() OVER (PARTITION BY series ORDER BY value, seq) AS pr FROM b), a AS (SELECT *, greatest(1, least(np, round_even((CASE WHEN n = 1 THEN 0.5::DOUBLE ELSE (r - 0.5::DOUBLE) / n END) * (np - 1) + 1, 0))) AS at FROM r) SELECT a.seq, c.value AS corrected FROM a JOIN r c ON c.series = a.series AND c.pr = a.at")
def batch_quantile(spark, sf):
    return batches.quantile_matched(batched(spark, sf)).select("seq", "corrected")


@query("batch_ruv", f"WITH {_B}, c AS (SELECT *, avg(value) FILTER (control) OVER s AS gc, count(*) FILTER (control) OVER s AS nc, avg(value) OVER s AS g, avg(value) FILTER (control) OVER t AS bc, count(*) FILTER (control) OVER t AS nb, median(value) OVER t AS m FROM b WINDOW s AS (PARTITION BY series), t AS (PARTITION BY series, batch)) SELECT seq, round(CASE WHEN nc >= 4 THEN value - (CASE WHEN nb >= 2 THEN bc - gc ELSE 0 END) ELSE value - m + g END, 6) AS corrected FROM c")
def batch_ruv(spark, sf):
    return rounded(batches.control_adjusted(batched(spark, sf)).select("seq", "corrected"))


def _steps(name: str, k: int) -> str:
    out = []
    for i in range(1, k + 1):
        out.append(f"g{i} AS (SELECT *, (n / greatest(d{i - 1}, 1e-8) * gh + mu / t2) / (n / greatest(d{i - 1}, 1e-8) + 1 / t2) AS m{i} FROM {name if i == 1 else f'd{i - 1}t'}), d{i}t AS (SELECT *, (th + 0.5::DOUBLE * (zz - 2 * m{i} * zs + n * m{i} ** 2)) / greatest(l + n / 2 - 1, 1e-6) AS d{i} FROM g{i})")
    return ", ".join(out)


def _prior(over: str, source: str) -> str:
    return f"""v AS (SELECT *, zs / n AS gh, CASE WHEN n > 1 AND (zz - zs ** 2 / n) / (n - 1) > 0 THEN (zz - zs ** 2 / n) / (n - 1) ELSE 1 END AS dh FROM {source}), w AS (SELECT *, avg(gh) OVER p AS mu, greatest(coalesce(var_samp(gh) OVER p, 0), 1e-6) AS t2, avg(dh) OVER p AS md, coalesce(var_samp(dh) OVER p, 0) AS vd FROM v WINDOW p AS (PARTITION BY {over})),
x AS (SELECT *, CASE WHEN vd > 1e-12 THEN greatest(2.01, 2 + md ** 2 / vd) ELSE 20 END AS l, dh AS d0 FROM w), y AS (SELECT *, greatest(md * (l - 1), 1e-8) AS th FROM x)"""


@query("batch_combat", f"WITH {_B}, r AS (SELECT *, avg(value) OVER (PARTITION BY series, grp) AS fit FROM b), e AS (SELECT *, (value - fit) / stddev_samp(value - fit) OVER (PARTITION BY series) AS z, stddev_samp(value - fit) OVER (PARTITION BY series) AS sd FROM r), s AS (SELECT series, batch, count(*)::DOUBLE AS n, sum(z) AS zs, sum(z * z) AS zz FROM e GROUP BY series, batch), {_prior('series', 's')}, {_steps('y', 8)} SELECT seq, round((z - m8) / sqrt(greatest(d8, 1e-8)) * sd + fit, 5) AS corrected FROM e JOIN d8t ON d8t.series = e.series AND d8t.batch = e.batch")
def batch_combat(spark, sf):
    return rounded(batches.combat(batched(spark, sf)).select("seq", "corrected"), 5)


@query("batch_combat_matrix", f"WITH b AS (SELECT vec_id AS seq, label AS batch, unnest(range(0, len(embedding))) AS feature, embedding FROM embeddings), r AS (SELECT seq, batch, feature, CAST(embedding[feature + 1] AS DOUBLE) AS value FROM b), e AS (SELECT *, avg(value) OVER f AS m, stddev_samp(value) OVER f AS sd FROM r WINDOW f AS (PARTITION BY feature)), z AS (SELECT *, (value - m) / sd AS z FROM e), s AS (SELECT batch, feature, count(*)::DOUBLE AS n, sum(z) AS zs, sum(z * z) AS zz FROM z GROUP BY batch, feature), {_prior('batch', 's')}, {_steps('y', 6)} SELECT seq, z.feature::INTEGER AS feature, round((z - m6) / sqrt(greatest(d6, 1e-8)) * sd + m, 5) AS corrected FROM z JOIN d6t ON d6t.batch = z.batch AND d6t.feature = z.feature")
def batch_combat_matrix(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("seq"), F.col("label").alias("batch"), F.posexplode("embedding").alias("feature", "value"))
    return rounded(batches.combat_matrix(e.withColumn("value", F.col("value").cast("double"))).select("seq", "feature", "corrected"), 5)


def _kruskal(name: str, rows: str) -> str:
    """h and p by group of rows (series, grp, value), as CTEs that end in name."""
    return f"""{name}r AS (SELECT *, rank() OVER (PARTITION BY series ORDER BY value) + (count(*) OVER (PARTITION BY series, value) - 1) / 2.0::DOUBLE AS r FROM ({rows})), {name}u AS (SELECT series, grp, count(*)::DOUBLE AS n, avg(r) AS r FROM {name}r GROUP BY series, grp),
{name}t AS (SELECT *, sum(n) OVER (PARTITION BY series) AS total FROM {name}u), {name}h AS (SELECT series, 12.0::DOUBLE / (any_value(total) * (any_value(total) + 1)) * sum(n * (r - (total + 1) / 2) ** 2) AS h, count(*) AS k FROM {name}t GROUP BY series), {name} AS (SELECT series, h, CASE WHEN k < 2 THEN 1 ELSE {chi2_tail("h", "greatest(k - 1, 1)")} END AS p FROM {name}h)"""


@query("batch_detect", f"""WITH {_B}, {_kruskal("x", "SELECT series, batch AS grp, value FROM b")}, {_kruskal("y", "SELECT series, batch AS grp, round(value - median(value) OVER (PARTITION BY series, grp), 9) AS value FROM b")}, {_kruskal("z", "SELECT series, grp, value FROM b")}
SELECT x.series, round(x.h, 5) AS h, round(x.p, 5) AS p, round(y.h, 5) AS adjusted_h, round(y.p, 5) AS adjusted_p, round(z.h, 5) AS group_h, round(z.p, 5) AS group_p, CASE WHEN y.p < 0.05 AND z.p < 0.05 THEN 'both' WHEN y.p < 0.05 THEN 'batch' WHEN z.p < 0.05 THEN 'biology' ELSE 'none' END AS reading FROM x JOIN y ON y.series = x.series JOIN z ON z.series = x.series""")
def batch_detect(spark, sf):
    return rounded(batches.detect(batched(spark, sf)), 5)


@query("batch_spread", f"WITH {_B}, m AS (SELECT series, batch, avg(value) AS m FROM b GROUP BY series, batch) SELECT series, round(stddev_samp(m), 6) AS spread FROM m GROUP BY series")
def batch_spread(spark, sf):
    return rounded(batches.spread_of_means(batched(spark, sf), F.col("value")))


_R = "r AS (SELECT o_orderpriority AS series, o_orderkey AS seq, o_orderstatus AS grp, o_totalprice AS value, epoch_us(o_orderdate) / 8.64e10::DOUBLE AS covariate FROM orders)"


def results(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderpriority").alias("series"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("grp"), F.col("o_totalprice").alias("value"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 8.64e10).alias("covariate"))


_POWER = "g AS (SELECT unnest(range(-40, 41)) AS k), y AS (SELECT series, k, round(k * 0.05::DOUBLE, 10) AS l, value AS x FROM r, g), f AS (SELECT series, k, any_value(l) AS pw, (any_value(l) - 1.0::DOUBLE) * sum(ln(x)) - count(*) / 2.0::DOUBLE * ln(var_samp(CASE WHEN abs(l) < 1e-8 THEN ln(x) ELSE (pow(x, l) - 1.0::DOUBLE) / nullif(l, 0) END)) AS ll FROM y GROUP BY series, k), b AS (SELECT series, pw FROM f QUALIFY row_number() OVER (PARTITION BY series ORDER BY round(ll, 7) DESC, k) = 1)"
_INTERVALS = {
    "nonparametric": "SELECT series, {m}, count(*) AS n, round(quantile_cont(value, 0.025), 6) AS lower, round(quantile_cont(value, 0.975), 6) AS upper FROM r GROUP BY series",
    "parametric": "SELECT series, {m}, count(*) AS n, round(avg(value) - 1.96 * stddev_samp(value), 4) AS lower, round(avg(value) + 1.96 * stddev_samp(value), 4) AS upper FROM r GROUP BY series",
    "robust": "SELECT series, {m}, count(*) AS n, round(any_value(d) - 1.96 * 1.4826::DOUBLE * median(abs(value - d)), 4) AS lower, round(any_value(d) + 1.96 * 1.4826::DOUBLE * median(abs(value - d)), 4) AS upper FROM (SELECT *, median(value) OVER (PARTITION BY series) AS d FROM r) GROUP BY series",
    "transformed": "SELECT series, {m}, count(*) AS n, round(exp(avg(ln(value)) - 1.96 * stddev_samp(ln(value))), 4) AS lower, round(exp(avg(ln(value)) + 1.96 * stddev_samp(ln(value))), 4) AS upper FROM r GROUP BY series",
    "horn": "SELECT r.series, {m}, any_value(n) AS n, round(quantile_cont(value, 0.025), 6) AS lower, round(quantile_cont(value, 0.975), 6) AS upper FROM r JOIN (SELECT series, count(*) AS n, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM r GROUP BY series) q ON q.series = r.series WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) GROUP BY r.series",
    "boxcox": "SELECT series, {m}, n, round(CASE WHEN abs(pw) < 1e-8 THEN exp(m - 1.96 * s) ELSE pow(pw * (m - 1.96 * s) + 1, 1 / nullif(pw, 0)) END, 3) AS lower, round(CASE WHEN abs(pw) < 1e-8 THEN exp(m + 1.96 * s) ELSE pow(pw * (m + 1.96 * s) + 1, 1 / nullif(pw, 0)) END, 3) AS upper FROM (SELECT r.series, count(*) AS n, any_value(pw) AS pw, avg(CASE WHEN abs(pw) < 1e-8 THEN ln(value) ELSE (pow(value, pw) - 1) / nullif(pw, 0) END) AS m, stddev_samp(CASE WHEN abs(pw) < 1e-8 THEN ln(value) ELSE (pow(value, pw) - 1) / nullif(pw, 0) END) AS s FROM r JOIN b ON b.series = r.series GROUP BY r.series)",
    "lms": "SELECT series, {m}, n, round(CASE WHEN abs(pw) < 1e-8 THEN mu * exp(-1.96 * s) ELSE mu * pow(1 - pw * s * 1.96, 1 / nullif(pw, 0)) END, 3) AS lower, round(CASE WHEN abs(pw) < 1e-8 THEN mu * exp(1.96 * s) ELSE mu * pow(1 + pw * s * 1.96, 1 / nullif(pw, 0)) END, 3) AS upper FROM (SELECT series, count(*) AS n, any_value(pw) AS pw, any_value(mu) AS mu, stddev_samp(CASE WHEN abs(pw) < 1e-8 THEN ln(value / mu) ELSE (pow(value / mu, pw) - 1) / nullif(pw, 0) END) AS s FROM (SELECT r.*, pw, median(value) OVER (PARTITION BY r.series) AS mu FROM r JOIN b ON b.series = r.series) GROUP BY series)",
}


def _interval(name: str):
    powers = f", {_POWER}" if name in ("boxcox", "lms") else ""

    @query(f"ri_{name}", f"WITH {_R}{powers} " + _INTERVALS[name].format(m=f"'{name}' AS method"))
    def run(spark, sf):
        return rounded(reference.reference_interval(results(spark, sf), name), 3 if powers else 6 if name in ("nonparametric", "horn") else 4)


for _name in _INTERVALS:
    _interval(_name)


@query("ri_bootstrap")
def ri_bootstrap(spark, sf):
    """Limits by percentiles with their bootstrap limits."""
    return rounded(reference.interval_limits(results(spark, sf)), 4)


@query("partitions", f"WITH {_R}, q AS (SELECT series, CASE WHEN grp = 'F' THEN 'F' ELSE 'O' END AS grp, value FROM r), g AS (SELECT series, grp, count(*) AS n, avg(value) AS m, stddev_samp(value) AS s FROM q GROUP BY series, grp), z AS (SELECT a.series, (a.m - b.m) / sqrt(a.s ** 2 / a.n + b.s ** 2 / b.n) AS z, 3.0::DOUBLE + 0.3 * (greatest(a.s / b.s, b.s / a.s) - 1) AS c FROM g a JOIN g b ON a.series = b.series AND a.grp < b.grp) SELECT series, 2::BIGINT AS groups, round(z, 5) AS z, round(c, 5) AS critical, abs(z) > c AS may_partition FROM z")
def partitions(spark, sf):
    r = results(spark, sf).withColumn("grp", F.when(F.col("grp") == "F", "F").otherwise("O"))
    return rounded(reference.partitions(r), 5)


@query("reference_curve", f"WITH {_R}, s AS (SELECT series, count(*) AS n, min(covariate) AS lo, max(covariate) AS hi FROM r GROUP BY series), g AS (SELECT series, n, lo + (hi - lo) * k / (least(50, n) - 1) AS pos, k FROM (SELECT *, unnest(range(0, least(50, n))) AS k FROM s)), d AS (SELECT r.series, k, pos, n, value, row_number() OVER (PARTITION BY r.series, k ORDER BY abs(covariate - pos), covariate, seq) AS i FROM r JOIN g ON g.series = r.series) SELECT series, k::INTEGER AS point, round(any_value(pos), 6) AS covariate, count(*) AS n_local, round(quantile_cont(value, 0.025), 6) AS q0_025, round(quantile_cont(value, 0.5), 6) AS q0_5, round(quantile_cont(value, 0.975), 6) AS q0_975 FROM d WHERE i <= greatest(8, round_even(n * 0.3::DOUBLE, 0)) GROUP BY series, k")
def reference_curve(spark, sf):
    return rounded(reference.reference_curve(results(spark, sf)))


_CURVE = f"""{_R}, s AS (SELECT series, count(*) AS n, min(covariate) AS lo, max(covariate) AS hi FROM r GROUP BY series), g AS (SELECT series, n, lo + (hi - lo) * k / (least(50, n) - 1) AS pos, k FROM (SELECT *, unnest(range(0, least(50, n))) AS k FROM s)),
d AS (SELECT r.series, k, pos, n, value, row_number() OVER (PARTITION BY r.series, k ORDER BY abs(covariate - pos), covariate, seq) AS i FROM r JOIN g ON g.series = r.series), near AS (SELECT * FROM d WHERE i <= greatest(8, round_even(n * 0.3::DOUBLE, 0)) AND value > 0)"""
_POWER = """gl AS (SELECT unnest(range(-40, 41)) AS k), y AS (SELECT series, gl.k, round(gl.k * 0.05::DOUBLE, 10) AS l, value AS x FROM r, gl WHERE value > 0),
f AS (SELECT series, k, any_value(l) AS power, (any_value(l) - 1.0::DOUBLE) * sum(ln(x)) - count(*) / 2.0::DOUBLE * ln(var_samp(CASE WHEN abs(l) < 1e-8 THEN ln(x) ELSE (pow(x, l) - 1.0::DOUBLE) / nullif(l, 0) END)) AS ll FROM y GROUP BY series, k), pw AS (SELECT series, power FROM f QUALIFY row_number() OVER (PARTITION BY series ORDER BY round(ll, 7) DESC, k) = 1)"""


def _lms_sql(q: float) -> str:
    t = f"sqrt(-2 * ln({min(q, 1 - q)}::DOUBLE))"
    z = f"({'-' if q < 0.5 else ''}({t} - (2.515517 + 0.802853 * {t} + 0.010328 * {t} * {t}) / (1 + 1.432788 * {t} + 0.189269 * {t} * {t} + 0.001308 * {t} * {t} * {t})))"
    return f"round(CASE WHEN abs(power) < 1e-8 THEN mu * exp(s * {z}) WHEN 1 + power * s * {z} > 0 THEN mu * pow(1 + power * s * {z}, 1 / power) WHEN power > 0 THEN 0 END, 4)"


@query("reference_curve_lms", f"""WITH {_CURVE}, {_POWER}, m AS (SELECT near.*, power, median(value) OVER (PARTITION BY near.series, near.k) AS mu FROM near JOIN pw ON pw.series = near.series),
a AS (SELECT series, k, any_value(pos) AS pos, count(*) AS n_local, any_value(mu) AS mu, any_value(power) AS power, stddev_samp(CASE WHEN abs(power) < 1e-8 THEN ln(value / mu) ELSE (pow(value / mu, power) - 1) / nullif(power, 0) END) AS s FROM m GROUP BY series, k)
SELECT series, k::INTEGER AS point, round(pos, 4) AS covariate, n_local, {_lms_sql(0.025)} AS q0_025, {_lms_sql(0.5)} AS q0_5, {_lms_sql(0.975)} AS q0_975 FROM a""")
def reference_curve_lms(spark, sf):
    return rounded(reference.reference_curve(results(spark, sf), method="lms"), 4)


def sited(spark, sf):
    return by_type(spark, sf).withColumn("site", F.concat(F.lit("site"), (F.col("user_id") % 5).cast("string")))


@query("site_effects", f"""WITH {T}, g AS (SELECT series, 'site' || CAST(user_id % 5 AS VARCHAR) AS site, count(*) AS n, avg(value) AS m, stddev_samp(value) AS sd FROM e GROUP BY ALL), s AS (SELECT *, sd / sqrt(n) AS se, count(*) OVER w AS k FROM g WINDOW w AS (PARTITION BY series)),
a AS (SELECT *, sum(m / se ** 2) OVER w / sum(1 / se ** 2) OVER w AS mu FROM s WINDOW w AS (PARTITION BY series)), b AS (SELECT *, sum((m - mu) ** 2 / se ** 2) OVER w AS q, sum(1 / se ** 2) OVER w - sum(1 / se ** 4) OVER w / sum(1 / se ** 2) OVER w AS c FROM a WINDOW w AS (PARTITION BY series)),
t AS (SELECT *, greatest(0, (q - (k - 1)) / c) AS tau2, greatest(0, 100 * (q - (k - 1)) / q) AS i2 FROM b), u AS (SELECT *, 1 / sum(1 / (se ** 2 + tau2)) OVER w AS v, tau2 / (tau2 + se ** 2) AS sh FROM t WINDOW w AS (PARTITION BY series))
SELECT series, site, n, round(m, 5) AS mean, round(sd, 5) AS sd, round(se, 5) AS se, round(sh, 5) AS shrinkage, round(mu + sh * (m - mu), 5) AS shrunk_mean, round(mu, 5) AS mu, round(tau2, 5) AS tau2, round(i2, 5) AS i2, round(mu - 3.182 * sqrt(tau2 + v), 5) AS lower, round(mu + 3.182 * sqrt(tau2 + v), 5) AS upper FROM u""")
def site_effects(spark, sf):
    return rounded(sites.site_effects(sited(spark, sf)), 5)


@query("surrogate_time", "SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2020-01-01 00:00:00' + to_hours(event_id) ELSE ts END AS ts FROM events")
def surrogate_time(spark, sf):
    e = by_type(spark, sf).withColumn("ts", F.when(F.col("seq") % 3 != 0, F.col("ts")))
    return sites.surrogate_times(e).select("seq", "ts")


_W = "e AS (SELECT user_id AS series, event_id AS seq, ts, 'site' || CAST(event_id % 3 AS VARCHAR) AS site, value FROM events)"
_EFFECTS = """g AS (SELECT series, site, count(*) AS n, avg(value) AS m, coalesce(stddev_samp(value), 0) AS sd FROM e GROUP BY ALL), s0 AS (SELECT *, count(*) OVER w AS k, sum(n) OVER w AS total, sum((n - 1) * sd ** 2) OVER w AS ss FROM g WINDOW w AS (PARTITION BY series)),
s AS (SELECT *, ss / greatest(total - k, 1) AS pooled, CASE WHEN n >= 2 AND sd > 0 THEN sd / sqrt(n) ELSE sqrt(ss / greatest(total - k, 1) / n) END AS se FROM s0 WHERE total >= 12 AND k >= 2),
a AS (SELECT *, sum(m / se ** 2) OVER w / sum(1 / se ** 2) OVER w AS mu FROM s WINDOW w AS (PARTITION BY series)), b AS (SELECT *, sum((m - mu) ** 2 / se ** 2) OVER w AS q, sum(1 / se ** 2) OVER w - sum(1 / se ** 4) OVER w / sum(1 / se ** 2) OVER w AS c FROM a WINDOW w AS (PARTITION BY series)),
t AS (SELECT *, greatest(0, (q - (k - 1)) / c) AS tau2, greatest(0, 100 * (q - (k - 1)) / q) AS i2 FROM b), u AS (SELECT *, 1 / sum(1 / (se ** 2 + tau2)) OVER w AS v, tau2 / (tau2 + se ** 2) AS sh FROM t WINDOW w AS (PARTITION BY series)), x AS (SELECT series, site, mu, mu + sh * (m - mu) AS shrunk FROM u)"""
_SITES = "e AS (SELECT CAST(user_id AS VARCHAR) || ':site' || CAST(event_id % 3 AS VARCHAR) AS series, event_id AS seq, ts, value FROM events)"
_TOGETHER = f"e AS (SELECT y.series, seq, ts, value - (shrunk - mu) AS value FROM (WITH {_W} SELECT * FROM e) y JOIN (WITH {_W}, {_EFFECTS} SELECT * FROM x) z ON z.series = y.series AND z.site = y.site)"
_STUDY = f"""WITH l AS (SELECT CAST(split_part(series, ':', 1) AS BIGINT) AS series, split_part(series, ':', 2) AS site, n, detected, magnitude, direction FROM ({auto_sql(_SITES)}) WHERE n >= 16 AND detected),
o AS (SELECT series, detected AS shared FROM ({auto_sql(_TOGETHER)}) WHERE n >= 16),
f AS (SELECT *, first_value(direction) OVER (PARTITION BY series ORDER BY site) AS way, sum(n * magnitude) OVER (PARTITION BY series) / sum(n) OVER (PARTITION BY series) AS mean FROM l),
h AS (SELECT series, count(*) AS nd, avg(CASE WHEN direction = way THEN 1.0::DOUBLE ELSE 0 END) AS conc, sum(n * (magnitude - mean) ** 2) AS q FROM f GROUP BY series),
w AS (SELECT u.series, count(*) AS sites, any_value(mu) AS grand_mean, sqrt(any_value(tau2)) AS between_sd, sqrt(any_value(pooled)) AS within_sd, any_value(i2) AS i2, any_value(v) AS v, any_value(tau2) AS tau2 FROM (WITH {_W}, {_EFFECTS} SELECT * FROM u) u GROUP BY u.series),
r AS (SELECT w.*, coalesce(nd, 0) AS nd, CASE WHEN nd >= 2 THEN conc ELSE 1 END AS conc, CASE WHEN nd >= 2 THEN q ELSE 0 END AS dq, coalesce(shared, FALSE) AND within_sd > 0 AS shared FROM w LEFT JOIN h ON h.series = w.series LEFT JOIN o ON o.series = w.series),
z AS (SELECT *, (pow(dq / greatest(nd - 1, 1), 1 / 3.0::DOUBLE) - (1 - 2 / (9.0::DOUBLE * greatest(nd - 1, 1)))) / sqrt(2 / (9.0::DOUBLE * greatest(nd - 1, 1))) AS z FROM r), p AS ({TWO_SIDED.format("z")}),
k AS (SELECT *, CASE WHEN dq <= 0 THEN 1 WHEN z >= 0 THEN p / 2 ELSE 1 - p / 2 END AS dp FROM p)
SELECT series, CASE WHEN nd = 0 AND NOT shared THEN 'stable' WHEN nd >= 2 AND dp < 0.05 AND conc < 0.75 THEN 'site_specific' WHEN (shared OR nd >= 2) AND conc >= 0.75 THEN 'global' ELSE 'mixed' END AS attribution, sites, nd AS sites_drifting, shared AS global_drift,
round(conc, 5) AS concordance, round(dq, 4) AS drift_q, round(dp, 5) AS drift_p, round(grand_mean, 5) AS grand_mean, round(between_sd, 5) AS between_sd, round(within_sd, 5) AS within_sd, round(i2, 4) AS i2, round(grand_mean - 12.706 * sqrt(tau2 + v), 4) AS lower, round(grand_mean + 12.706 * sqrt(tau2 + v), 4) AS upper FROM k"""


def studies(spark, sf):
    """Each user a study of three sites."""
    return sites.study(by_user(spark, sf).withColumn("site", F.concat(F.lit("site"), (F.col("seq") % 3).cast("string"))))


@query("study", _STUDY)
def study(spark, sf):
    places = {"drift_q": 4, "i2": 4, "lower": 4, "upper": 4}
    found = studies(spark, sf)
    return found.select(*(r(c, places.get(c, 5)).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes))
