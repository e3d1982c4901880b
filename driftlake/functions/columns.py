"""Scalar functions as Column expressions; all run inside the JVM.

Missing means null, NaN or infinite everywhere: such values are left out, never taken for zero.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def finite(c: Column) -> Column:
    return F.coalesce(c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < INFINITY), F.lit(False))


def to_places(c: Column, places: int) -> Column:
    """Halves away from zero, of the product with a power of ten; F.round goes by the decimals of the double instead."""
    return F.round(c * 10.0**places) / 10.0**places


def truthy(c: Column) -> Column:
    """Numbers are true unless zero; strings if they say so."""
    text = F.lower(F.trim(c.cast("string")))
    return F.coalesce(text.isin("true", "1", "yes", "control", "qc") | (F.coalesce(c.try_cast("double"), F.lit(0.0)) != 0), F.lit(False))


def erfc(x: Column) -> Column:
    """Complementary error function, rational approximation 7.1.26 of Abramowitz and Stegun."""
    z = F.abs(x)
    t = 1.0 / (1.0 + 0.3275911 * z)
    # fixed values: the coefficients of the approximation
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = poly * F.exp(-z * z)
    return F.when(x >= 0, tail).otherwise(2.0 - tail)


def normal_sf(z: Column) -> Column:
    return 0.5 * erfc(z / math.sqrt(2.0))


def log_gamma(x: Column) -> Column:
    """Stirling's series after moving x above 8."""
    y = x + 8.0
    shift = F.ln(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))) - shift


def gamma_sf(a: Column, x: Column) -> Column:
    """Upper regularised gamma Q(a, x): one less the series of the lower one below a + 1, a continued fraction above."""
    front = F.exp(a * F.ln(x) - x - log_gamma(a))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(300)), F.struct((1.0 / a).alias("term"), (1.0 / a).alias("total")),
        lambda s, k: F.struct((s["term"] * x / (a + k)).alias("term"), (s["total"] + s["term"] * x / (a + k)).alias("total")), lambda s: s["total"],
    )
    # evaluated from the inside out: x + 1 - a - 1(1 - a) / (x + 3 - a - 2(2 - a) / ...)
    fraction = F.aggregate(F.sequence(F.lit(200), F.lit(1), F.lit(-1)), x + 401.0 - a, lambda s, k: x + 2.0 * k - 1.0 - a - k * (k - a) / s)
    return F.when(x <= 0, 1.0).when(x < a + 1, 1.0 - front * series).otherwise(front / fraction)


def chisq_sf(x: Column, df: Column) -> Column:
    return gamma_sf(df.cast("double") / 2.0, x / 2.0)


def beta_inc(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function by its continued fraction, on the side where that converges."""

    def half(p: Column, q: Column, y: Column) -> Column:
        def term(m: Column) -> Column:
            even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
            return even, odd

        def step(s: Column, m: Column) -> Column:
            even, odd = term(m)
            return F.when(m == 0, 1.0 + odd / s).otherwise(1.0 + even / (1.0 + odd / s))

        # from the inside out
        cf = F.aggregate(F.sequence(F.lit(150), F.lit(0), F.lit(-1)), F.lit(1.0), step)
        front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.ln(y) + q * F.ln(1.0 - y))
        return front / (p * cf)

    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), half(a, b, x)).otherwise(1.0 - half(b, a, 1.0 - x))


def t_two_sided(t: Column, df: Column) -> Column:
    return beta_inc(df / 2.0, F.lit(0.5), df / (df + t * t))


def f_sf(f: Column, df1: Column, df2: Column) -> Column:
    return beta_inc(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f))


def kolmogorov_sf(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample p-value with the small-sample factor of Stephens.

    The alternating series ends after twenty terms; below 0.3, where they cancel to nothing, the value is 1 to ten digits."""
    root = F.sqrt(n * m / (n + m))
    lam = (root + 0.12 + 0.11 / root) * d
    total = F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam))
    return F.when(lam < 0.3, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def normal_quantile(p: Column) -> Column:
    """Rational approximation 26.2.23 of Abramowitz and Stegun."""
    q = F.least(p, 1.0 - p)
    t = F.sqrt(-2.0 * F.ln(q))
    # fixed values: the coefficients of the approximation
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1.0 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return F.when(p < 0.5, -z).otherwise(z)


def boxcox(x: Column, lam: Column) -> Column:
    return F.when(F.abs(lam) < 1e-8, F.ln(x)).otherwise((F.pow(x, lam) - 1.0) / lam)


def inv_boxcox(y: Column, lam: Column) -> Column:
    inner = lam * y + 1.0
    return F.when(F.abs(lam) < 1e-8, F.exp(y)).when(inner > 0, F.pow(inner, 1.0 / lam)).otherwise(F.lit(float("nan")))


def lms_quantile(mu: Column, sigma: Column, lam: Column, z: Column) -> Column:
    inner = 1.0 + lam * sigma * z
    return F.when(F.abs(lam) < 1e-8, mu * F.exp(sigma * z)).when(inner > 0, mu * F.pow(inner, 1.0 / lam)).when(lam > 0, 0.0).otherwise(F.lit(float("nan")))


def direction(delta: Column) -> Column:
    return F.when(F.isnan(delta) | delta.isNull(), "none").when(delta > 0, "increase").when(delta < 0, "decrease").otherwise("none")


def status_from_score(score: Column, drift: Column) -> Column:
    return F.when(drift & (score < 70), "drift_suspected").when(score >= 90, "stable").when(score >= 75, "watch").when(score >= 55, "warning").otherwise("critical")


#: The weights of a score's parts.
SCORE_WEIGHTS = {"drift": 0.28, "variance": 0.16, "qc": 0.22, "calibration": 0.10, "distribution": 0.16, "missing": 0.08}


def sentinel_score(penalties: dict[str, Column], weights: dict[str, float] = SCORE_WEIGHTS) -> Column:
    """100 less the weighted mean of the penalties (each held to 0..1) in per cent; absent ones are 0."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))))
    total = sum((w * clamp(penalties[k]) for k, w in weights.items() if k in penalties), F.lit(0.0))
    return 100.0 - 100.0 * total / sum(weights.values())
