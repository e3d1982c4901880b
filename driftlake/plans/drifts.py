"""Drift of single and of many variables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlake.operators import drift
from driftlake.plans.base import KS_TAIL, T, TIMED, U, by_type, by_user, by_user_with_gaps, query, rounded, table
from driftlake.plans.basics import TWO_SIDED

_SHOWN = ("series", "kind", "detected", "probability", "magnitude", "direction", "start_index", "n")


def shown(df, places: int = 5):
    return rounded(df.select(*_SHOWN), places)


def _way(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN 'increase' WHEN {x} < 0 THEN 'decrease' ELSE 'none' END"


def _line(e: str) -> str:
    """Theil-Sen lines of each series' values against hours, and what they leave."""
    return f"""{e}, p AS (SELECT series, row_number() OVER w AS k, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY series))) / 3.6e9::DOUBLE AS x, value AS y FROM e WINDOW w AS (PARTITION BY series ORDER BY ts, seq)),
s AS (SELECT a.series, median((b.y - a.y) / (b.x - a.x)) AS slope FROM p a JOIN p b ON a.series = b.series AND a.k < b.k AND a.x <> b.x GROUP BY a.series),
c AS (SELECT p.series, coalesce(slope, 0) AS slope, median(y - coalesce(slope, 0) * x) AS icpt FROM p LEFT JOIN s ON s.series = p.series GROUP BY ALL),
q AS (SELECT p.*, slope, y - icpt - slope * x AS e FROM p JOIN c ON c.series = p.series)"""


def _linear(e: str) -> str:
    return f"""WITH {_line(e)}, a AS (SELECT series, any_value(slope) AS slope, stddev_samp(e) AS se, stddev_samp(x) AS sx, count(*) AS n, max(x) - min(x) AS span, avg(y) AS m FROM q GROUP BY series),
z AS (SELECT *, slope * sx * sqrt(n) / (CASE WHEN se = 0 THEN 1 ELSE se END) AS z FROM a), t AS ({TWO_SIDED.format("z")}),
d AS (SELECT *, n >= 8 AND p < 0.01 AND abs(z) > 2.5 AS detected FROM t)
SELECT series, 'linear' AS kind, detected, CASE WHEN n < 8 THEN 0 WHEN detected THEN least(0.99, 1 - p) ELSE greatest(0.05, 1 - p) * 0.4 END AS probability, slope * span / abs(m) AS magnitude, {_way("slope")} AS direction, 1::BIGINT AS start_index, n FROM d"""


def _nonlinear(e: str) -> str:
    return f"""WITH {_line(e)}, m AS (SELECT *, x - avg(x) OVER w AS u, y - avg(y) OVER w AS v, avg(y) OVER w AS my FROM q WINDOW w AS (PARTITION BY series)),
a AS (SELECT series, sum(e * e) AS r1, sum(u * u) AS s2, sum(u ** 3) AS s3, sum(u ** 4) AS s4, sum(u * v) AS uy, sum(u * u * v) AS uuy, sum(v * v) AS yy, count(*) AS n, max(x) - min(x) AS span, any_value(my) AS m FROM m GROUP BY series),
b AS (SELECT *, s4 - s2 * s2 / n - s3 * s3 / s2 AS qq, uuy - s3 / s2 * uy AS qy FROM a), h AS (SELECT *, qy / qq AS cv, yy - uy * uy / s2 - qy * qy / qq AS r2 FROM b),
f AS (SELECT *, (r1 - r2) / (r2 / greatest(n - 3, 1)) AS f FROM h), d AS (SELECT *, n >= 8 AND f > 6 AND r2 < 0.92 * r1 AS detected FROM f)
SELECT series, 'nonlinear' AS kind, detected, CASE WHEN n < 8 THEN 0 WHEN detected THEN least(0.95, 0.5 + f / 40) ELSE 0.15 END AS probability, cv * span ** 2 / abs(m) AS magnitude, {_way("cv")} AS direction, 1::BIGINT AS start_index, n FROM d"""


def _sudden(e: str) -> str:
    return f"""WITH {e}, d AS (SELECT series, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY series) AS n, value - avg(value) OVER (PARTITION BY series) AS d FROM e WINDOW w AS (PARTITION BY series ORDER BY ts, seq)),
s AS (SELECT *, sum(d) OVER u AS s1, sum(d) OVER (PARTITION BY series) AS t1, sum(d * d) OVER (PARTITION BY series) AS t2 FROM d WINDOW u AS (PARTITION BY series ORDER BY i)),
l AS (SELECT series, i, n, n / 2.0::DOUBLE * ln(t2 / (t2 - s1 ** 2 / i - (t1 - s1) ** 2 / (n - i))) AS lr FROM s WHERE i >= 2 AND i <= n - 2),
b AS (SELECT *, n >= 8 AND lr > ln(n) + 1.5 AS hit FROM l QUALIFY row_number() OVER (PARTITION BY series ORDER BY round(lr, 9) DESC, i) = 1),
m AS (SELECT d.series, any_value(b.i) AS tau, any_value(hit) AS hit, any_value(lr) AS lr, any_value(b.n) AS n, avg(value) FILTER (d.i <= b.i) AS a, avg(value) FILTER (d.i > b.i) AS c FROM d JOIN b ON b.series = d.series GROUP BY d.series)
SELECT series, 'sudden' AS kind, hit AS detected, CASE WHEN hit THEN least(0.99, 1 - exp(-greatest(lr - ln(n), 0) / 4)) ELSE 0 END AS probability, CASE WHEN hit THEN (c - a) / abs(a) END AS magnitude, CASE WHEN hit THEN {_way("c - a")} ELSE 'none' END AS direction, CASE WHEN hit THEN tau END AS start_index, n FROM m"""


def _variance(e: str) -> str:
    return f"""WITH {e}, d AS (SELECT series, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY series) AS n, (value - avg(value) OVER (PARTITION BY series)) ** 2 AS d FROM e WINDOW w AS (PARTITION BY series ORDER BY ts, seq)),
s AS (SELECT *, abs(sum(d) OVER (PARTITION BY series ORDER BY i) / sum(d) OVER (PARTITION BY series) - i / n) AS dk FROM d),
b AS (SELECT series, i AS tau, n, sqrt(n / 2) * round(dk, 12) AS stat FROM s QUALIFY row_number() OVER (PARTITION BY series ORDER BY round(dk, 12) DESC, i) = 1),
m AS (SELECT d.series, any_value(tau) AS tau, any_value(stat) AS stat, any_value(b.n) AS n, stddev_samp(value) FILTER (i <= tau) AS a, stddev_samp(value) FILTER (i > tau) AS c FROM d JOIN b ON b.series = d.series GROUP BY d.series)
SELECT series, 'variance' AS kind, n >= 8 AND stat > 1.358 AS detected, CASE WHEN n < 8 THEN 0 WHEN stat > 1.358 THEN least(0.98, 0.5 + (stat - 1.358) / 4) ELSE 0.15 END AS probability, (c - a) / (a + 2.0::DOUBLE ** -52) AS magnitude, {_way("c - a")} AS direction, tau AS start_index, n FROM m"""


def _cyclic(e: str) -> str:
    return f"""WITH {e}, z AS (SELECT series, row_number() OVER w AS i, count(*) OVER (PARTITION BY series) AS n, value - avg(value) OVER (PARTITION BY series) AS z FROM e WINDOW w AS (PARTITION BY series ORDER BY ts, seq)),
k AS (SELECT *, unnest(range(1, least(n // 4, 40) + 1)) AS k FROM z), p AS (SELECT series, k, any_value(n) AS n, (sum(z * cos(2 * pi() * k / n * i)) ** 2 + sum(z * sin(2 * pi() * k / n * i)) ** 2) / any_value(n) AS p FROM k GROUP BY series, k),
g AS (SELECT series, any_value(n) AS n, max(p) / sum(p) AS g FROM p GROUP BY series)
SELECT series, 'cyclic' AS kind, n >= 16 AND g > 0.35 AS detected, CASE WHEN n < 8 THEN 0 WHEN n >= 16 AND g > 0.35 THEN least(0.9, g) ELSE 0.1 END AS probability, g AS magnitude, 'cyclic' AS direction, 1::BIGINT AS start_index, n FROM g"""


def _distribution(e: str) -> str:
    return f"""WITH {e}, o AS (SELECT series, value, count(*) OVER (PARTITION BY series) AS n, row_number() OVER (PARTITION BY series ORDER BY ts, seq) AS i FROM e), p AS (SELECT series, value, CASE WHEN i <= greatest(1, n // 3) THEN 'a' ELSE 'b' END AS side FROM o),
c AS (SELECT series, value, count(*) FILTER (side = 'a') AS ca, count(*) FILTER (side = 'b') AS cb FROM p GROUP BY series, value), f AS (SELECT *, sum(ca) OVER u AS ua, sum(cb) OVER u AS ub, sum(ca) OVER w AS na, sum(cb) OVER w AS nb FROM c WINDOW u AS (PARTITION BY series ORDER BY value), w AS (PARTITION BY series)),
d AS (SELECT series, max(abs(ua / na - ub / nb)) AS d, any_value(na)::BIGINT AS n, any_value(nb)::BIGINT AS m FROM f GROUP BY series), k AS (SELECT *, {KS_TAIL} AS p FROM d),
a AS (SELECT series, avg(value) FILTER (side = 'b') - avg(value) FILTER (side = 'a') AS delta FROM p GROUP BY series), r AS (SELECT k.*, delta, n >= 8 AND m >= 8 AS ok FROM k JOIN a ON a.series = k.series)
SELECT series, 'distribution' AS kind, ok AND p < 0.01 AS detected, CASE WHEN NOT ok THEN 0 WHEN p < 0.01 THEN 1 - p WHEN p < 0.1 THEN 0.4 ELSE 0.15 END AS probability, CASE WHEN ok THEN d END AS magnitude, CASE WHEN ok THEN {_way("delta")} ELSE 'none' END AS direction, CASE WHEN ok THEN n + 1 END AS start_index, n + m AS n FROM r"""


KINDS = {"linear": _linear, "sudden": _sudden, "variance": _variance, "distribution": _distribution, "cyclic": _cyclic, "nonlinear": _nonlinear}


def _rounded(sql: str) -> str:
    return f"SELECT series, kind, detected, round(probability, 5) AS probability, round(magnitude, 5) + 0.0 AS magnitude, direction, start_index, n FROM ({sql})"


def auto_sql(e: str) -> str:
    """The kind of the highest probability for each series."""
    least = {"cyclic": 16, "nonlinear": 20}
    union = " UNION ALL ".join(f"SELECT *, {i} AS o FROM ({sql(e)}) WHERE n >= {least.get(k, 0)}" for i, (k, sql) in enumerate(KINDS.items()))
    return f"SELECT * EXCLUDE (o) FROM ({union}) QUALIFY row_number() OVER (PARTITION BY series ORDER BY round(probability, 9) DESC, o) = 1"


@query("drift_linear", _rounded(_linear(U)))
def linear(spark, sf):
    return shown(drift.linear(by_user(spark, sf)))


@query("drift_linear_gaps", _rounded(_linear(TIMED)))
def linear_gaps(spark, sf):
    return shown(drift.linear(by_user_with_gaps(spark, sf)))


@query("drift_auto_gaps", _rounded(auto_sql(TIMED)))
def auto_gaps(spark, sf):
    return shown(drift.detect_drift(by_user_with_gaps(spark, sf)))


@query("drift_nonlinear", _rounded(_nonlinear(U)))
def nonlinear(spark, sf):
    return shown(drift.nonlinear(by_user(spark, sf)))


@query("drift_sudden", _rounded(_sudden(T)))
def sudden(spark, sf):
    return shown(drift.sudden(by_type(spark, sf)))


@query("drift_variance", _rounded(_variance(T)))
def variance(spark, sf):
    return shown(drift.variance(by_type(spark, sf)))


@query("drift_cyclic", _rounded(_cyclic(T)))
def cyclic(spark, sf):
    return shown(drift.cyclic(by_type(spark, sf)))


@query("drift_distribution", _rounded(_distribution(T)))
def distribution(spark, sf):
    return shown(drift.distribution(by_type(spark, sf)))


@query("drift_auto", _rounded(auto_sql(U)))
def auto(spark, sf):
    return shown(drift.detect_drift(by_user(spark, sf)))


@query("drift_calibration", f"WITH {U} SELECT DISTINCT series, 'calibration' AS kind, FALSE AS detected, 0.0::DOUBLE AS probability, NULL::DOUBLE AS magnitude, 'none' AS direction, NULL::BIGINT AS start_index, NULL::BIGINT AS n FROM e")
def calibration(spark, sf):
    return shown(drift.detect_drift(by_user(spark, sf), "calibration"))


#: The embeddings as vectors, the first two fifths of them being the baseline.
_V = "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f, row_number() OVER (ORDER BY vec_id) AS i, count(*) OVER () AS n FROM embeddings), h AS (SELECT *, i <= greatest(8, round_even(0.4::DOUBLE * n, 0)) AS b FROM v)"


def vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("seq"), F.col("embedding").cast("array<double>").alias("features"))


_CORR = "u AS (SELECT i, b, unnest(range(1, len(f) + 1)) AS a, f FROM h), w AS (SELECT i, b, a, f[a] AS x, f, unnest(range(1, len(f) + 1)) AS c FROM u), r AS (SELECT b, a, c, corr(x, f[c]) AS r FROM w GROUP BY b, a, c)"


@query("mv_covariance", f"WITH {_V}, {_CORR}, d AS (SELECT sqrt(sum((x.r - y.r) ** 2)) / max(x.a) AS d FROM r x JOIN r y ON x.a = y.a AND x.c = y.c AND x.b AND NOT y.b) SELECT 'covariance' AS method, d > 0.25 AS detected, round(CASE WHEN d > 0.25 THEN least(0.9, d) ELSE 0.15 END, 5) AS probability, round(d, 5) AS magnitude, (SELECT count(*) FILTER (b) + 1 FROM h) AS start_index FROM d")
def mv_covariance(spark, sf):
    return rounded(drift.multivariate(vectors(spark, sf), "covariance"), 5)


@query("mv_energy", f"WITH {_V}, p AS (SELECT x.b AS a, y.b AS c, avg(sqrt(list_sum(list_transform(list_zip(x.f, y.f), lambda z: (z[1] - z[2]) ** 2)))) AS d FROM h x, h y GROUP BY ALL), d AS (SELECT sum(CASE WHEN a AND NOT c THEN 2 * d WHEN a = c THEN -d ELSE 0 END) AS d FROM p), l AS (SELECT avg(list_sum(list_transform(f, lambda x: abs(x))) / len(f)) AS l FROM h WHERE b) SELECT 'energy' AS method, d > 0.15 * (l + 1) AS detected, CASE WHEN d > 0.15 * (l + 1) THEN 0.75::DOUBLE ELSE 0.2::DOUBLE END AS probability, round(d, 5) AS magnitude, (SELECT count(*) FILTER (b) + 1 FROM h) AS start_index FROM d, l")
def mv_energy(spark, sf):
    return rounded(drift.multivariate(vectors(spark, sf), "energy"), 5)


#: The inverse of the baseline's covariance by Gauss and Jordan's elimination, a column at a time, and distances by it.
_INVERSE = """p AS (SELECT len(f) AS p FROM h LIMIT 1), ix AS (SELECT unnest(range(1, p + 1)) AS a FROM p), mu AS (SELECT list(m ORDER BY a) AS mu FROM (SELECT a, avg(f[a]) AS m FROM h, ix WHERE b GROUP BY a)),
cv AS (SELECT x.a, y.a AS c, covar_samp(f[x.a], f[y.a]) + CASE WHEN x.a = y.a THEN 1e-6::DOUBLE ELSE 0 END AS v FROM h, ix x, ix y WHERE b GROUP BY x.a, y.a),
g0 AS (SELECT list(r ORDER BY a) AS g FROM (SELECT a, list_concat(list(v ORDER BY c), list(CASE WHEN a = c THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY c)) AS r FROM cv GROUP BY a)),
gj AS (SELECT CAST(1 AS BIGINT) AS k, g FROM g0 UNION ALL SELECT k + 1, list_transform(g, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: x / g[k][k]) ELSE list_transform(r, lambda x, j: x - r[k] * g[k][j] / g[k][k]) END) FROM gj WHERE k <= len(g)),
iv AS (SELECT list_transform(g, lambda r: r[len(g) + 1 : 2 * len(g)]) AS m FROM gj WHERE k = len(g) + 1), df AS (SELECT list_transform(f, lambda x, j: x - mu[j]) AS d FROM h, mu WHERE NOT b),
ds AS (SELECT avg(sqrt(list_sum(list_transform(d, lambda x, i: x * list_sum(list_transform(d, lambda y, j: y * m[i][j])))))) AS v FROM df, iv)"""


@query("mv_mahalanobis", f"WITH RECURSIVE {_V}, {_INVERSE}, r AS (SELECT v / sqrt(p) AS r FROM ds, p) SELECT 'mahalanobis' AS method, r > 1.6 AS detected, round(CASE WHEN r > 1.6 THEN least(0.95, 0.5 + (r - 1) / 3) ELSE 0.2 END, 6) AS probability, round(r, 6) AS magnitude, (SELECT count(*) FILTER (b) + 1 FROM h) AS start_index FROM r")
def mv_mahalanobis(spark, sf):
    return rounded(drift.multivariate(vectors(spark, sf), "mahalanobis"))


@query("mv_pca")
def mv_pca(spark, sf):
    return rounded(drift.multivariate(vectors(spark, sf), "pca"))
