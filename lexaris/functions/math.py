"""Scalar mathematics as column expressions; divisions are guarded, as the session is ANSI."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def frac(num: Column, den: Column) -> Column:
    """num / den; 1 for 0 / 0, 0 for any other division by 0."""
    return F.when(den != 0, num / den).when(num == 0, 1.0).otherwise(0.0)


def precision(tp: Column, fp: Column) -> Column:
    return frac(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return frac(tp, tp + fn)


def harmonic(pr: Column, rc: Column) -> Column:
    """Harmonic mean; 0 if either is 0."""
    return F.when((pr == 0) | (rc == 0), 0.0).otherwise(2.0 / (1.0 / pr + 1.0 / rc))


def smoothed(p: Column, eps: float = 1e-5) -> Column:
    return (1 - eps) * p + eps


def f1(pr: Column, rc: Column, eps: float = 1e-5) -> Column:
    a, b = smoothed(pr, eps), smoothed(rc, eps)
    return 2.0 / (1.0 / a + 1.0 / b)


def f_beta(pr: Column, rc: Column, beta: float = 0.5, eps: float = 1e-5) -> Column:
    a, b = smoothed(pr, eps), smoothed(rc, eps)
    return (1 + beta**2) * (a * b) / (beta**2 * a + b)


# fixed values: Abramowitz and Stegun 7.1.26
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    """Error function to 1.5e-7; Spark has none."""
    t = 1.0 / (1.0 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def erf_sql(x: str) -> str:
    """The same expression as SQL text."""
    t = f"(1.0 / (1.0 + {ERF_P} * abs({x})))"
    poly = "0.0"
    for a in reversed(ERF_A):
        poly = f"(({poly} + ({a})) * {t})"
    return f"(sign({x}) * (1.0 - {poly} * exp(-({x}) * ({x}))))"


def gauss_cdf(x: Column, mu: Column | float = 0.0, sigma: Column | float = 1.0) -> Column:
    """Normal distribution function; null where sigma is 0."""
    return 0.5 * (1.0 + erf(F.try_divide(x - mu, F.lit(sigma) * F.lit(2.0**0.5))))


def gauss_width(p: float, sigma: Column | float) -> Column:
    """Half width of the interval around the mean that has probability ``p``."""
    return F.lit(NormalDist().inv_cdf((1 + p) / 2)) * F.lit(sigma)


def si(x: Column) -> Column:
    """A number with an SI unit, such as 1.50K."""
    text = F.format_string("%.2f", x)
    for limit, unit in ((1e3, "K"), (1e6, "M"), (1e9, "G"), (1e12, "T")):
        text = F.when(F.abs(x) >= limit, F.format_string(f"%.2f{unit}", x / limit)).otherwise(text)
    return text


def linear_fit(y: Column, x: Column) -> tuple[Column, Column]:
    """Aggregates (slope, intercept) of the least-squares line."""
    return F.regr_slope(y, x), F.regr_intercept(y, x)


def log_fit(y: Column, x: Column) -> tuple[Column, Column]:
    """Aggregates (exponent, factor) of y = factor * x ** exponent."""
    return F.regr_slope(F.log(y), F.log(x)), F.exp(F.regr_intercept(F.log(y), F.log(x)))


def boltzmann(d: Column, base: float = 2.0, beta: float = -1.0) -> Column:
    """The weight base ** (beta d), not yet normalised."""
    return F.pow(F.lit(base), beta * d)


def gauss_tail(d: Column, mu: Column, sigma: Column) -> Column:
    """The weight 1 - normal distribution function of a distance, not yet normalised."""
    return 1 - gauss_cdf(d, mu, sigma)
