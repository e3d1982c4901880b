"""Two-sample and group comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlake.operators import two_sample as ts
from driftlake.plans.base import KS_TAIL, ORACLE_SQL, by_flag, by_type, by_user, query, rounded, t_tail
from driftlake.plans.basics import TWO_SIDED

#: Side a: users of even number.
_P = "p AS (SELECT event_type AS series, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS side, value FROM events)"
_C = "c AS (SELECT series, value, count(*) FILTER (side = 'a') AS ca, count(*) FILTER (side = 'b') AS cb FROM p GROUP BY series, value), f AS (SELECT *, sum(ca) OVER u AS ua, sum(cb) OVER u AS ub, sum(ca) OVER w AS na, sum(cb) OVER w AS nb FROM c WINDOW u AS (PARTITION BY series ORDER BY value), w AS (PARTITION BY series))"


def pooled(spark, sf):
    return ts.split(by_type(spark, sf), F.col("user_id") % 2 == 0)


_KS = f"WITH {_P}, {_C}, d AS (SELECT series, max(abs(ua / na - ub / nb)) AS d, any_value(na)::BIGINT AS n, any_value(nb)::BIGINT AS m FROM f GROUP BY series)"
_KS_P = f"SELECT series, round(d, 6) AS d, n, m, round({KS_TAIL}, 6) AS p FROM d"


@query("ks", f"{_KS} {_KS_P}")
def ks(spark, sf):
    return rounded(ts.ks(pooled(spark, sf)))


@query("ks_compat_ties", f"WITH {_P}, {_C}, d AS (SELECT series, max(greatest(abs(ua / na - ub / nb), abs((ua - ca + least(ca, cb)) / na - (ub - cb + least(ca, cb)) / nb))) AS d, any_value(na)::BIGINT AS n, any_value(nb)::BIGINT AS m FROM f GROUP BY series) {_KS_P}")
def ks_compat(spark, sf):
    return rounded(ts.ks(pooled(spark, sf), compat_ties=True))


@query("wasserstein", f"WITH {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY series, side ORDER BY value) - 1 AS r FROM p), n AS (SELECT series, count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb FROM p GROUP BY series), i AS (SELECT *, unnest(range(0, greatest(na, nb))) AS i FROM n), k AS (SELECT series, i * (na - 1) // greatest(greatest(na, nb) - 1, 1) AS ra, i * (nb - 1) // greatest(greatest(na, nb) - 1, 1) AS rb FROM i) SELECT k.series, round(avg(abs(a.value - b.value)), 6) AS w FROM k JOIN r a ON a.side = 'a' AND a.series = k.series AND a.r = ra JOIN r b ON b.side = 'b' AND b.series = k.series AND b.r = rb GROUP BY k.series")
def wasserstein(spark, sf):
    return rounded(ts.wasserstein(pooled(spark, sf)))


_PAIR = "(SELECT x.series, sum(x.n * y.n * abs(x.value - y.value)) / (sum(x.n * y.n)) AS d FROM g x JOIN g y ON x.series = y.series AND x.side = '{0}' AND y.side = '{1}' GROUP BY x.series)"


@query("energy", f"WITH {_P}, g AS (SELECT series, side, value, count(*)::DOUBLE AS n FROM p GROUP BY ALL) SELECT ab.series, round(2 * ab.d - aa.d - bb.d, 5) AS e FROM {_PAIR.format('a', 'b')} ab JOIN {_PAIR.format('a', 'a')} aa ON ab.series = aa.series JOIN {_PAIR.format('b', 'b')} bb ON ab.series = bb.series")
def energy(spark, sf):
    return rounded(ts.energy(pooled(spark, sf)), 5)


@query("jensen_shannon", f"WITH {_P}, l AS (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi, count(*) FILTER (side = 'a') OVER w AS na, count(*) FILTER (side = 'b') OVER w AS nb FROM p WINDOW w AS (PARTITION BY series)), h AS (SELECT series, least(floor((value - lo) / (hi - lo) * 20) + 1, 20) AS bin, count(*) FILTER (side = 'a') / any_value(na) AS p, count(*) FILTER (side = 'b') / any_value(nb) AS q FROM l GROUP BY series, bin) SELECT series, round(0.5::DOUBLE * sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END) + 0.5::DOUBLE * sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END), 6) AS js FROM h GROUP BY series")
def jensen_shannon(spark, sf):
    return rounded(ts.jensen_shannon(pooled(spark, sf)))


@query("welch", f"WITH {_P}, m AS (SELECT series, avg(value) FILTER (side = 'a') AS x, avg(value) FILTER (side = 'b') AS y, var_samp(value) FILTER (side = 'a') / count(*) FILTER (side = 'a') AS a, var_samp(value) FILTER (side = 'b') / count(*) FILTER (side = 'b') AS b, count(*) FILTER (side = 'a') AS n, count(*) FILTER (side = 'b') AS k FROM p GROUP BY series) SELECT series, round((x - y) / sqrt(a + b), 6) AS t, round((a + b) ** 2 / (a * a / (n - 1) + b * b / (k - 1)), 4) AS df FROM m")
def welch(spark, sf):
    return ts.welch(pooled(spark, sf)).select("series", F.round("t", 6).alias("t"), F.round("df", 4).alias("df"))


@query("welch_pvalue", f"WITH {_P}, m AS (SELECT series, avg(value) FILTER (side = 'a') AS x, avg(value) FILTER (side = 'b') AS y, var_samp(value) FILTER (side = 'a') / count(*) FILTER (side = 'a') AS a, var_samp(value) FILTER (side = 'b') / count(*) FILTER (side = 'b') AS b, count(*) FILTER (side = 'a') AS n, count(*) FILTER (side = 'b') AS k FROM p GROUP BY series), w AS (SELECT series, (x - y) / sqrt(a + b) AS t, (a + b) ** 2 / (a * a / (n - 1) + b * b / (k - 1)) AS df FROM m) SELECT series, round(t, 6) AS t, round(df, 6) AS df, round({t_tail('t', 'df')}, 6) AS p FROM w")
def welch_p(spark, sf):
    return rounded(ts.welch(pooled(spark, sf)))


@query("mann_whitney", f"WITH {_P}, r AS (SELECT *, rank() OVER (PARTITION BY series ORDER BY value) + (count(*) OVER (PARTITION BY series, value) - 1) / 2.0::DOUBLE AS r FROM p), s AS (SELECT series, count(*) FILTER (side = 'a')::DOUBLE AS n, count(*) FILTER (side = 'b')::DOUBLE AS m, sum(r) FILTER (side = 'a') AS ra FROM r GROUP BY series), z AS (SELECT series, ra - n * (n + 1) / 2 AS u, (ra - n * (n + 1) / 2 - n * m / 2) / sqrt(n * m * (n + m + 1) / 12) AS z FROM s), p2 AS ({TWO_SIDED.format('z')}) SELECT series, u, round(z, 6) AS z, round(p, 6) AS p FROM p2")
def mann_whitney(spark, sf):
    return rounded(ts.mann_whitney(pooled(spark, sf)))


_G = "g AS (SELECT l_linestatus AS series, l_returnflag AS grp, l_extendedprice / l_quantity AS value FROM lineitem)"


def groups(spark, sf):
    return by_flag(spark, sf).select(F.col("l_linestatus").alias("series"), F.col("l_returnflag").alias("grp"), F.col("unit_price").alias("value"))


@query("kruskal_wallis", f"WITH {_G}, r AS (SELECT *, rank() OVER (PARTITION BY series ORDER BY value) + (count(*) OVER (PARTITION BY series, value) - 1) / 2.0::DOUBLE AS r FROM g), m AS (SELECT series, grp, count(*)::DOUBLE AS n, avg(r) AS r FROM r GROUP BY series, grp), t AS (SELECT *, sum(n) OVER (PARTITION BY series) AS total FROM m), h AS (SELECT series, 12.0::DOUBLE / (any_value(total) * (any_value(total) + 1)) * sum(n * (r - (total + 1) / 2) ** 2) AS h, count(*) AS k, any_value(total)::BIGINT AS n FROM t GROUP BY series) SELECT series, round(h, 5) AS h, k, n, CASE WHEN k < 2 THEN 1.0::DOUBLE WHEN k = 3 THEN round(exp(-h / 2), 5) END AS p FROM h")
def kruskal_wallis(spark, sf):
    return rounded(ts.kruskal_wallis(groups(spark, sf)), 5)


_ANOVA = "m AS (SELECT series, grp, count(*)::DOUBLE AS n, avg(value) AS m, var_pop(value) AS v FROM {0} GROUP BY series, grp), t AS (SELECT *, sum(n) OVER w AS total, sum(n * m) OVER w / sum(n) OVER w AS gm FROM m WINDOW w AS (PARTITION BY series)), s AS (SELECT series, sum(n * (m - gm) ** 2) AS ssb, sum(n * v) AS ssw, count(*) - 1 AS dfb, any_value(total)::BIGINT - count(*) AS dfw FROM t GROUP BY series) SELECT series, round(CASE WHEN dfb < 1 THEN 0 ELSE (ssb / nullif(dfb, 0)) / (ssw / dfw) END, 5) AS f, dfb, dfw FROM s"


@query("anova", f"WITH {_G}, " + _ANOVA.format("g"))
def anova(spark, sf):
    return rounded(ts.anova(groups(spark, sf)).drop("p"), 5)


@query("brown_forsythe", f"WITH {_G}, d AS (SELECT series, grp, abs(value - median(value) OVER (PARTITION BY series, grp)) AS value FROM g), " + _ANOVA.format("d"))
def brown_forsythe(spark, sf):
    return rounded(ts.brown_forsythe(groups(spark, sf)).drop("p"), 5)


@query("anova_pvalues", f"WITH {_G}, a AS (WITH " + _ANOVA.format("g").replace(", 5) AS f", ", 12) AS f") + ") SELECT series, round(f, 6) AS f, dfb, dfw, CASE WHEN dfb < 1 THEN 1.0::DOUBLE WHEN dfb = 2 THEN round(pow(1 + 2 * f / dfw, -dfw / 2.0::DOUBLE), 6) END AS p FROM a")
def anova_p(spark, sf):
    return rounded(ts.anova(groups(spark, sf)))


def _as_e(sql: str, column: str, name: str) -> str:
    """A distance's SQL over p, named and with its p-value."""
    return f"SELECT series, '{name}' AS method, {column} AS distance, {'p' if name == 'ks' else 'NULL::DOUBLE'} AS p FROM ({sql})"


_USERS = "p AS (SELECT user_id AS series, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS side, value FROM events)"


def _of_users(sql: str) -> str:
    return sql.replace(_P, _USERS)


@query(
    "compare_distribution_auto",
    f"""WITH {_USERS}, z AS (SELECT series, count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb, coalesce(kurtosis_pop(value), 0) AS k FROM p GROUP BY series HAVING na >= 5 AND nb >= 5),
c AS (SELECT series, CASE WHEN least(na, nb) < 20 THEN 'ks' WHEN k > 3 THEN 'energy' ELSE 'wasserstein' END AS method FROM z),
d AS ({_as_e(_of_users(ORACLE_SQL["ks"].replace(", 6) AS", ", 12) AS")), "d", "ks")} UNION ALL {_as_e(_of_users(ORACLE_SQL["energy"].replace(", 5) AS", ", 12) AS")), "e", "energy")} UNION ALL {_as_e(_of_users(ORACLE_SQL["wasserstein"].replace(", 6) AS", ", 12) AS")), "w", "wasserstein")})
SELECT series, method, round(distance, 7) AS distance, round(p, 7) AS p FROM c JOIN d USING (series, method)""",
)
def compare_distribution(spark, sf):
    """Each user's events of even number against the others."""
    return rounded(ts.compare_distribution(ts.split(by_user(spark, sf), F.col("seq") % 2 == 0)), 7)


@query("compare_distribution_js", f"SELECT series, 'js' AS method, js AS distance, NULL::DOUBLE AS p FROM ({ORACLE_SQL['jensen_shannon']})")
def compare_distribution_js(spark, sf):
    return rounded(ts.compare_distribution(pooled(spark, sf), "js"))
