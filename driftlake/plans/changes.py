"""Change points."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlake.operators import change_points as cp
from driftlake.plans.base import ORACLE_SQL, PLACED, T, U, by_type, by_user, by_user_with_gaps, query, rounded, t_tail


def shown(df):
    """Results with their places as text."""
    return rounded(df.withColumn("indices", F.array_join(F.col("indices").cast("array<string>"), ",")))


_LR = """d AS (SELECT series, row_number() OVER w AS i, count(*) OVER (PARTITION BY series) AS n, value - avg(value) OVER (PARTITION BY series) AS d FROM e WINDOW w AS (PARTITION BY series ORDER BY ts, seq)),
s AS (SELECT *, sum(d) OVER u AS s1, sum(d) OVER (PARTITION BY series) AS t1, sum(d * d) OVER (PARTITION BY series) AS t2 FROM d WINDOW u AS (PARTITION BY series ORDER BY i)),
l AS (SELECT series, i, n, n / 2.0::DOUBLE * ln(t2 / nullif(t2 - s1 ** 2 / i - (t1 - s1) ** 2 / (n - i), 0)) AS lr FROM s WHERE i >= 2 AND i <= n - 2),
b AS (SELECT *, round(lr, 9) AS statistic FROM l QUALIFY row_number() OVER (PARTITION BY series ORDER BY round(lr, 9) DESC NULLS LAST, i) = 1)
SELECT series, 'likelihood' AS method, coalesce(statistic > ln(n) + 1.5, FALSE) AS detected, CASE WHEN statistic > ln(n) + 1.5 THEN CAST(i AS VARCHAR) ELSE '' END AS indices, round(statistic, 6) AS statistic, round(CASE WHEN statistic > ln(n) + 1.5 THEN least(0.99, 1 - exp(-greatest(statistic - ln(n), 0) / 4)) ELSE 0.15 END, 6) AS confidence FROM b"""
#: The same with places among all rows.
_LR_PLACED = _LR.replace("SELECT series, row_number()", "SELECT series, place, row_number()").replace("SELECT series, i, n, n / 2.0", "SELECT series, place, i, n, n / 2.0").replace("CAST(i AS VARCHAR)", "CAST(place AS VARCHAR)")


@query("cp_likelihood", f"WITH {T}, {_LR}")
def likelihood(spark, sf):
    return shown(cp.likelihood(by_type(spark, sf)))


@query("cp_likelihood_by_user", f"WITH {U}, {_LR}")
def likelihood_by_user(spark, sf):
    return shown(cp.likelihood(by_user(spark, sf)))


@query("cp_likelihood_gaps", f"WITH {PLACED}, {_LR_PLACED}")
def likelihood_gaps(spark, sf):
    return shown(cp.likelihood(by_user_with_gaps(spark, sf)))


#: The sequential pass as a recursion over the rows of all series at once.
_STEPS = """z AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY ts, seq) AS i, (value - avg(value) OVER (PARTITION BY series)) / stddev_samp(value) OVER (PARTITION BY series) AS z FROM e),
c AS (SELECT series, CAST(0 AS BIGINT) AS i, 0.0::DOUBLE AS p, 0.0::DOUBLE AS m, FALSE AS alarm FROM z WHERE i = 1
  UNION ALL SELECT series, i, CASE WHEN greatest(p, m) > {h} THEN 0 ELSE p END, CASE WHEN greatest(p, m) > {h} THEN 0 ELSE m END, greatest(p, m) > {h}
  FROM (SELECT z.series, z.i, greatest(0, c.p + z.z - {k}) AS p, greatest(0, c.m - z.z - {k}) AS m FROM c JOIN z ON z.series = c.series AND z.i = c.i + 1))"""


@query("cusum_alarm_count", f"WITH RECURSIVE {U}, {_STEPS.format(k=0.5, h=5)} SELECT series, count(*) FILTER (alarm) AS alarms FROM c GROUP BY series")
def alarm_count(spark, sf):
    e = by_user(spark, sf)
    found = cp.cusum_alarms(e).groupBy("series").agg(F.count("*").alias("alarms"))
    return e.select("series").distinct().join(found, "series", "left").select("series", F.coalesce("alarms", F.lit(0)).alias("alarms"))


def _cusum_sql(k: float, h: float, method: str, value: str) -> str:
    return f"""WITH RECURSIVE {U}, {_STEPS.format(k=k, h=h)}, a AS (SELECT series, list(i ORDER BY i) FILTER (alarm) AS al FROM c GROUP BY series),
v AS (SELECT *, {value} AS v FROM (SELECT *, 1.4826::DOUBLE * median(abs(value - m)) OVER (PARTITION BY series) AS mad FROM (SELECT *, median(value) OVER (PARTITION BY series) AS m FROM e))),
d AS (SELECT series, row_number() OVER w AS i, v - avg(v) OVER (PARTITION BY series) AS d FROM v WINDOW w AS (PARTITION BY series ORDER BY ts, seq)),
s AS (SELECT series, i, sum(d) OVER (PARTITION BY series ORDER BY i) AS s FROM d), q AS (SELECT series, stddev_samp(s) AS sd, count(*) AS n FROM s GROUP BY series),
b AS (SELECT series, i, round(abs(s), 9) AS statistic FROM s QUALIFY row_number() OVER (PARTITION BY series ORDER BY round(abs(s), 9) DESC, i) = 1),
x AS (SELECT b.series, i, statistic, sd, coalesce(al, []) AS al, n >= 8 AND (len(coalesce(al, [])) > 0 OR statistic > 2 * sd) AS detected FROM b JOIN q ON b.series = q.series LEFT JOIN a ON a.series = b.series)
SELECT series, '{method}' AS method, detected, CASE WHEN detected THEN array_to_string(list_sort(list_distinct(list_append(al, i))), ',') ELSE '' END AS indices, round(statistic, 6) AS statistic,
round(CASE WHEN detected THEN least(0.99, 0.55 + 0.08 * len(al) + 0.1 * statistic / (sd + 2.0::DOUBLE ** -52)) ELSE 0.2 END, 6) AS confidence FROM x"""


@query("cp_cusum", _cusum_sql(0.5, 5, "cusum", "value"))
def cusum(spark, sf):
    return shown(cp.cusum(by_user(spark, sf)))


@query("cp_robust", _cusum_sql(0.4, 4.5, "robust_median", "(value - m) / (CASE WHEN mad > 0 THEN mad ELSE 1 END)"))
def robust(spark, sf):
    return shown(cp.robust_median(by_user(spark, sf)))


_FEATURES = """h AS (SELECT series, avg(CASE WHEN v IS NULL OR NOT isfinite(v) THEN 1.0::DOUBLE ELSE 0 END) AS missing FROM (SELECT series, value AS v FROM e) GROUP BY series),
o AS (SELECT series, count(*) AS n, CASE WHEN count(*) < 4 THEN 0 ELSE coalesce(kurtosis_pop(value), 0) END AS kurtosis, stddev_samp(value) AS sd FROM e GROUP BY series),
y AS (SELECT series, 1.4826::DOUBLE * median(abs(value - m)) AS mad FROM (SELECT *, median(value) OVER (PARTITION BY series) AS m FROM e) GROUP BY series),
dt AS (SELECT series, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series ORDER BY ts, seq))) / 1e6::DOUBLE AS dt FROM e), dm AS (SELECT series, dt, median(dt) OVER (PARTITION BY series) AS m FROM dt WHERE dt > 0),
g AS (SELECT series, count(*) >= 3 AND avg(abs(dt - m) / m) < 0.35 AS regular FROM dm GROUP BY series), al AS (SELECT series, count(*) FILTER (alarm) AS alarms FROM c GROUP BY series),
f AS (SELECT h.series, missing, o.n, kurtosis, sd, mad, coalesce(g.regular AND o.n >= 4, FALSE) AS regular, coalesce(alarms, 0) AS alarms, kurtosis > 2.5 OR coalesce(mad > 0 AND sd / nullif(mad, 0) > 1.6, FALSE) AS heavy
  FROM h JOIN o USING (series) JOIN y USING (series) LEFT JOIN g USING (series) LEFT JOIN al USING (series)),
w AS (SELECT *, CASE WHEN n < 20 THEN 'robust_median:few values' WHEN missing > 0.15 THEN 'robust_median:many missing values' WHEN NOT regular AND n < 80 THEN 'robust_median:irregular times' WHEN heavy THEN 'robust_median:heavy tails'
  WHEN n >= 80 AND alarms >= 2 THEN 'pelt:several alarms' WHEN n >= 80 AND n < 400 AND regular THEN 'bayesian:regular times and moderate length' WHEN n >= 400 THEN 'pelt:a long series' ELSE 'cusum:no other rule holds' END AS c FROM f)
SELECT series, round(missing, 6) AS missing, n, round(kurtosis, 6) AS kurtosis, round(sd, 6) AS sd, round(mad, 6) AS mad, regular, alarms, split_part(c, ':', 1) AS method, split_part(c, ':', 2) AS reason FROM w"""


@query("cp_auto_select", f"WITH RECURSIVE {U}, {_STEPS.format(k=0.5, h=5)}, {_FEATURES}")
def auto_select(spark, sf):
    return rounded(cp.features(by_user(spark, sf)))


@query("cp_rolling", f"""WITH {U}, d AS (SELECT series, row_number() OVER w AS i, count(*) OVER (PARTITION BY series) AS n, value - avg(value) OVER (PARTITION BY series) AS d FROM e WINDOW w AS (PARTITION BY series ORDER BY ts, seq)),
s AS (SELECT series, i, n, greatest(8, n // 8) AS w, sum(d) OVER u AS s1, sum(d * d) OVER u AS s2 FROM d WINDOW u AS (PARTITION BY series ORDER BY i)),
k AS (SELECT s.series, s.i, s.w, (s.s1 - coalesce(a.s1, 0)) / s.w AS ml, (b.s1 - s.s1) / s.w AS mr, s.s2 - coalesce(a.s2, 0) AS ql, b.s2 - s.s2 AS qr FROM s LEFT JOIN s a ON a.series = s.series AND a.i = s.i - s.w JOIN s b ON b.series = s.series AND b.i = s.i + s.w WHERE s.i >= s.w),
v AS (SELECT *, (ql - w * ml ** 2) / (w - 1) AS vl, (qr - w * mr ** 2) / (w - 1) AS vr FROM k), t AS (SELECT *, (ml - mr) / sqrt((vl + vr) / w) AS t, ((vl + vr) / w) ** 2 * (w - 1) / ((vl / w) ** 2 + (vr / w) ** 2) AS f FROM v),
p AS (SELECT series, i, t, {t_tail('t', 'f')} AS p FROM t), b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY series ORDER BY round(p, 9), i) = 1)
SELECT q.series, 'rolling' AS method, coalesce(p < 0.01, FALSE) AS detected, CASE WHEN p < 0.01 THEN CAST(i AS VARCHAR) ELSE '' END AS indices, round(coalesce(abs(t), 0), 6) AS statistic, round(CASE WHEN p < 0.01 THEN 1 - p ELSE 0.2 END, 6) AS confidence FROM (SELECT DISTINCT series FROM e) q LEFT JOIN b ON b.series = q.series""")
def rolling(spark, sf):
    return shown(cp.rolling(by_user(spark, sf)))


#: The pruned dynamic programme as a recursion over the ends of segments: costs, last cuts and living candidates as lists.
_PELT = f"""WITH RECURSIVE {U}, m AS (SELECT *, avg(value) OVER w AS m, stddev_samp(value) OVER w AS sd, row_number() OVER (PARTITION BY series ORDER BY ts, seq) AS i FROM e WINDOW w AS (PARTITION BY series)),
z AS (SELECT series, i, (value - m) / (CASE WHEN sd > 0 THEN sd ELSE 1 END) AS z FROM m), c AS (SELECT series, i, sum(z) OVER w AS s1, sum(z * z) OVER w AS s2 FROM z WINDOW w AS (PARTITION BY series ORDER BY i)),
l AS (SELECT series, count(*) AS n, 3 * ln(count(*)) AS pen, list_prepend(0.0::DOUBLE, list(s1 ORDER BY i)) AS s1, list_prepend(0.0::DOUBLE, list(s2 ORDER BY i)) AS s2 FROM c GROUP BY series HAVING count(*) >= 8),
d AS (SELECT series, CAST(0 AS BIGINT) AS t, [-pen] AS cost, [CAST(0 AS BIGINT)] AS cut, [CAST(0 AS BIGINT)] AS alive FROM l
UNION ALL SELECT series, t, list_append(cost, own), list_append(cut, CASE WHEN best IS NULL THEN 0 ELSE alive[best] END), list_append(list_filter(alive, lambda a, k: parts[k] <= own), t) FROM
(SELECT *, CASE WHEN best IS NULL THEN cost[1] + s2[t + 1] - s1[t + 1] ** 2 / t + pen ELSE fit[best] + pen END AS own FROM (SELECT *, list_position(fit, list_min(fit)) AS best FROM
(SELECT *, list_transform(alive, lambda a, k: CASE WHEN a = 0 OR t - a >= 8 THEN parts[k] END) AS fit FROM (SELECT d.series, d.t + 1 AS t, cost, cut, alive, s1, s2, pen,
list_transform(alive, lambda a: cost[a + 1] + (s2[d.t + 2] - s2[a + 1]) - (s1[d.t + 2] - s1[a + 1]) ** 2 / (d.t + 1 - a)) AS parts FROM d JOIN l ON l.series = d.series AND d.t < l.n))))),
last AS (SELECT d.series, d.cut, -d.cost[l.n + 1] AS statistic, l.n FROM d JOIN l ON l.series = d.series AND l.n = d.t), back AS (SELECT series, cut, cut[n + 1] AS edge FROM last UNION ALL SELECT series, cut, cut[edge + 1] FROM back WHERE edge > 0),
x AS (SELECT series, list(edge ORDER BY edge) FILTER (edge > 0) AS ends FROM back GROUP BY series), a AS (SELECT series, count(*) AS n FROM e GROUP BY series)
SELECT a.series, 'pelt' AS method, coalesce(len(ends), 0) > 0 AS detected, coalesce(array_to_string(ends, ','), '') AS indices, round(coalesce(statistic, 0), 6) AS statistic,
round(CASE WHEN a.n < 8 THEN 0 WHEN coalesce(len(ends), 0) = 0 THEN 0.2 ELSE least(0.95, 0.6 + 0.1 * len(ends)) END, 6) AS confidence FROM a LEFT JOIN last ON last.series = a.series LEFT JOIN x ON x.series = a.series"""


@query("cp_pelt", _PELT)
def pelt(spark, sf):
    return shown(cp.pelt(by_user(spark, sf)))


#: Forward and backward sums over segments as recursions over lists, the mass after each place, and its peaks one by one.
_SEGMENT = "(-0.5::DOUBLE * ({m}) * ln(2 * pi() * v) + 0.5::DOUBLE * ln(0.01::DOUBLE / (0.01::DOUBLE + ({m}))) - ((c2[{b} + 1] - c2[{a} + 1]) - (c1[{b} + 1] - c1[{a} + 1]) ** 2 / (0.01::DOUBLE + ({m}))) / (2 * v) + (({m}) - 1) * stay)"
_TOTAL = "list_max(q) + ln(list_sum(list_transform(q, lambda x: exp(x - list_max(q)))))"


def _bayesian_parts() -> str:
    forward, backward = _SEGMENT.format(m="t - a", a="a", b="t"), _SEGMENT.format(m="t - j", a="(n - t)", b="(n - j)")
    return f"""bm AS (SELECT series, value - avg(value) OVER w AS d, row_number() OVER (PARTITION BY series ORDER BY ts, seq) AS i, var_samp(value) OVER w AS v FROM e WINDOW w AS (PARTITION BY series)),
bc AS (SELECT series, i, v, sum(d) OVER w AS c1, sum(d * d) OVER w AS c2 FROM bm WINDOW w AS (PARTITION BY series ORDER BY i)),
bh AS (SELECT series, count(*) AS n, any_value(CASE WHEN v > 0 THEN v ELSE 1 END) AS v, least(0.2::DOUBLE, greatest(1 / sqrt(count(*)), 2.0::DOUBLE / count(*))) AS h, list_prepend(0.0::DOUBLE, list(c1 ORDER BY i)) AS c1, list_prepend(0.0::DOUBLE, list(c2 ORDER BY i)) AS c2 FROM bc GROUP BY series HAVING count(*) >= 16),
bl AS (SELECT *, ln(h) AS go, ln(1 - h) AS stay FROM bh),
bf AS (SELECT series, CAST(0 AS BIGINT) AS t, [0.0::DOUBLE] AS f FROM bl UNION ALL SELECT series, t, list_append(f, CASE WHEN t < 8 THEN -1e300::DOUBLE ELSE {_TOTAL} END) FROM (SELECT series, t, f, list_transform(range(0, greatest(1, t - 7)), lambda a: f[a + 1] + {forward} + CASE WHEN a > 0 THEN go ELSE 0 END) AS q
  FROM (SELECT bf.series, bf.t + 1 AS t, f, n, v, go, stay, c1, c2 FROM bf JOIN bl ON bl.series = bf.series AND bf.t < bl.n))),
bb AS (SELECT series, CAST(0 AS BIGINT) AS t, [0.0::DOUBLE] AS g FROM bl UNION ALL SELECT series, t, list_append(g, CASE WHEN t < 8 THEN -1e300::DOUBLE ELSE {_TOTAL} END) FROM (SELECT series, t, g, list_transform(range(0, greatest(1, t - 7)), lambda j: g[j + 1] + {backward} + CASE WHEN j > 0 THEN go ELSE 0 END) AS q
  FROM (SELECT bb.series, bb.t + 1 AS t, g, n, v, go, stay, c1, c2 FROM bb JOIN bl ON bl.series = bb.series AND bb.t < bl.n))),
bo AS (SELECT bl.series, i, exp(f[i + 1] + g[bl.n - i + 1] + go - f[bl.n + 1]) AS own FROM bl JOIN bf ON bf.series = bl.series AND bf.t = bl.n JOIN bb ON bb.series = bl.series AND bb.t = bl.n, LATERAL (SELECT unnest(range(8, bl.n - 7)) AS i)),
bp AS (SELECT series, i, own / nullif(sum(own) OVER (PARTITION BY series), 0) AS mass FROM bo), bs AS (SELECT series, max(mass) AS top FROM bp GROUP BY series), bk AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY mass DESC, i) AS k FROM bp WHERE mass >= 0.08),
bt AS (SELECT series, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken FROM bl UNION ALL SELECT bt.series, bk.k, CASE WHEN len(list_filter(taken, lambda x: abs(x - bk.i) < 8)) = 0 THEN list_append(taken, bk.i) ELSE taken END FROM bt JOIN bk ON bk.series = bt.series AND bk.k = bt.k + 1),
bz AS (SELECT series, list_sort(taken) AS taken FROM bt QUALIFY row_number() OVER (PARTITION BY series ORDER BY k DESC) = 1), ba AS (SELECT DISTINCT series FROM e),
by_mass AS (SELECT ba.series, 'bayesian' AS method, coalesce(len(taken), 0) > 0 AS detected, coalesce(array_to_string(taken, ','), '') AS indices, round(coalesce(top, 0), 6) AS statistic, round(CASE WHEN bz.series IS NULL THEN 0 WHEN len(taken) > 0 THEN top ELSE 0.2 END, 6) AS confidence
  FROM ba LEFT JOIN bz ON bz.series = ba.series LEFT JOIN bs ON bs.series = ba.series)"""


@query("cp_bayesian", f"WITH RECURSIVE {U}, {_bayesian_parts()} SELECT * FROM by_mass")
def bayesian(spark, sf):
    return shown(cp.bayesian(by_user(spark, sf)))


_KERNEL = f"""WITH {U}, r AS (SELECT series, value, row_number() OVER (PARTITION BY series ORDER BY ts, seq) AS i, count(*) OVER (PARTITION BY series) AS n FROM e), s AS (SELECT series, n FROM r WHERE i = 1),
t AS (SELECT series, n, unnest(range(10, n - 9, greatest(1, n // 80))) AS t, FALSE AS middle FROM s UNION ALL SELECT series, n, n // 2, TRUE FROM s WHERE n >= 20),
f AS (SELECT r.series, middle, t, sum(CASE WHEN i <= t THEN 1 ELSE 0 END) OVER w / t - sum(CASE WHEN i > t THEN 1 ELSE 0 END) OVER w / (r.n - t) AS d, lead(value) OVER (PARTITION BY r.series, middle, t ORDER BY value, i) - value AS step FROM r JOIN t ON t.series = r.series WINDOW w AS (PARTITION BY r.series, middle, t ORDER BY value)),
g AS (SELECT series, middle, t, 2 * sum(d * d * step) AS e FROM f GROUP BY series, middle, t), b AS (SELECT series, t, e FROM g WHERE NOT middle QUALIFY row_number() OVER (PARTITION BY series ORDER BY round(e, 12) DESC, t) = 1),
x AS (SELECT s.series, s.n, b.t, b.e, m.e AS mid, coalesce(b.e > 1.8 * greatest(m.e, 2.0::DOUBLE ** -52) AND b.e > 0, FALSE) AS hit FROM s LEFT JOIN b ON b.series = s.series LEFT JOIN g m ON m.series = s.series AND m.middle)
SELECT series, 'kernel' AS method, hit AS detected, CASE WHEN hit THEN CAST(t AS VARCHAR) ELSE '' END AS indices, round(e, 6) AS statistic, round(CASE WHEN hit THEN least(0.9, 0.5 + e / (e + mid + 1)) ELSE 0.2 END, 6) AS confidence FROM x"""


@query("cp_kernel", _KERNEL)
def kernel(spark, sf):
    """A series too short for a split has no statistic."""
    return shown(cp.kernel(by_user(spark, sf)).withColumn("statistic", F.when(F.abs("statistic") < float("inf"), F.col("statistic"))))


@query("cp_sampled")
def sampled(spark, sf):
    return shown(cp.sampled_cut(by_user(spark, sf)))


_CHOICES = {"robust_median": "cp_robust", "cusum": "cp_cusum", "pelt": "cp_pelt", "bayesian": "cp_bayesian", "likelihood": "cp_likelihood_by_user"}


@query("cp_auto", " UNION ALL ".join(f"SELECT r.* FROM ({ORACLE_SQL[name]}) r JOIN ({ORACLE_SQL['cp_auto_select']}) c ON c.series = r.series AND c.method = '{method}'" for method, name in _CHOICES.items()))
def auto(spark, sf):
    return shown(cp.detect_changes(by_user(spark, sf)))
