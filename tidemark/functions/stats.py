"""Closed-form statistics as columns: intervals, calibration transform, risk index."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_95 = 1.959963984540054


def _wilson(successes: Column, trials: Column, z: float) -> tuple[Column, Column, Column]:
    n = trials.cast("double")
    p = F.try_divide(successes.cast("double"), n)
    scale = F.lit(1.0) + F.lit(z * z) / n
    center = p + F.lit(z * z) / (F.lit(2.0) * n)
    margin = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + F.lit(z * z) / (F.lit(4.0) * n * n))
    return center, margin, scale


def wilson_low(successes: Column, trials: Column, z: float = Z_95) -> Column:
    """Lower end of the Wilson interval; NULL without trials."""
    n = F.when(trials > 0, trials)
    center, margin, scale = _wilson(successes, n, z)
    return F.when(n.isNotNull(), F.greatest(F.lit(0.0), (center - margin) / scale))


def wilson_high(successes: Column, trials: Column, z: float = Z_95) -> Column:
    """Upper end of the Wilson interval; NULL without trials."""
    n = F.when(trials > 0, trials)
    center, margin, scale = _wilson(successes, n, z)
    return F.when(n.isNotNull(), F.least(F.lit(1.0), (center + margin) / scale))


def clipped(p: Column, eps: float = 1e-6) -> Column:
    """Probability kept away from 0 and 1."""
    return F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps)))


def platt(p: Column, slope: Column | float, offset: Column | float, eps: float = 1e-6) -> Column:
    """Sigmoid of ``slope * logit(p) + offset`` with the argument kept within -40 and 40."""
    q = clipped(p, eps)
    a = slope if isinstance(slope, Column) else F.lit(float(slope))
    b = offset if isinstance(offset, Column) else F.lit(float(offset))
    z = a * F.log(q / (F.lit(1.0) - q)) + b
    z = F.when(z.isNotNull(), F.least(F.greatest(z, F.lit(-40.0)), F.lit(40.0)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def risk_index(p: Column, eps: float = 1e-6) -> Column:
    """Calibrated probability on a 0 to 100 scale."""
    return F.lit(100.0) * clipped(p, eps)


def risk_index_to_probability(index: Column) -> Column:
    """Inverse of ``risk_index``."""
    return index / F.lit(100.0)


def brier_term(y: Column, p: Column) -> Column:
    return (p - y) * (p - y)


def log_loss_term(y: Column, p: Column, eps: float = 1e-15) -> Column:
    q = clipped(p, eps)
    return -(y * F.log(q) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - q))


def _continued(terms, most: int = 500, least: float = 1e-300, close: float = 1e-15) -> float:
    """A continued fraction 1 / (1 + d1 / (1 + d2 / ...)) by the modified Lentz method."""
    c, d, value = 1.0, 0.0, 1.0
    for k, term in enumerate(terms):
        d = 1.0 + term * d
        c = 1.0 + term / c
        d = 1.0 / (d if abs(d) > least else least)
        c = c if abs(c) > least else least
        value *= c * d
        if abs(c * d - 1.0) < close or k > most:
            break
    return 1.0 / value


def beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_share(1.0 - x, b, a)

    def terms():
        m = 0
        while True:
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            m += 1
            yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front / a * _continued(terms())


def f_tail(value: float, first: float, second: float) -> float:
    """Chance of an F statistic above ``value``."""
    return 1.0 if value <= 0 else beta_share(second / (second + first * value), second / 2.0, first / 2.0)


def chi2_tail(value: float, degrees: float) -> float:
    """Chance of a chi-square statistic above ``value``."""
    a, x = degrees / 2.0, value / 2.0
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    # upper tail: x + 1 - a - 1 (1 - a) / (x + 3 - a - 2 (2 - a) / (x + 5 - a - ...))
    b, d = x + 1.0 - a, 1.0 / (x + 1.0 - a)
    c, h = 1e300, d
    for k in range(1, 500):
        n = -k * (k - a)
        b += 2.0
        d = 1.0 / (n * d + b)
        c = b + n / c
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h
