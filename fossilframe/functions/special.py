"""Distribution functions as plain Python, each by its mathematical contract."""

from __future__ import annotations

import math

#: The error-function approximation 7.1.26 of Abramowitz and Stegun.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf_as(x: float) -> float:
    t = 1 / (1 + ERF_P * abs(x))
    y = 1 - t * math.exp(-x * x) * sum(a * t**k for k, a in enumerate(ERF_A))
    return math.copysign(y, x)


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_pdf(x: float) -> float:
    return math.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def _bisect(f, target: float, low: float, high: float) -> float:
    for _ in range(200):
        mid = (low + high) / 2
        if f(mid) < target:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def normal_quantile(p: float) -> float:
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5) if p in (0, 1) else math.nan
    return _bisect(normal_cdf, p, -40, 40)


def lbeta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def gammainc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * front)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc_left(b, a, 1 - x)
    return betainc_left(a, b, x)


def betainc_left(a: float, b: float, x: float) -> float:
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - lbeta(a, b)) / a
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + k * d) or 1e-300)
            c = (1 + k / c) or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h


def beta_quantile(p: float, a: float, b: float) -> float:
    return _bisect(lambda x: betainc(a, b, x), p, 0.0, 1.0)


def beta_pdf(x: float, a: float, b: float) -> float:
    return math.exp((a - 1) * math.log(x) + (b - 1) * math.log1p(-x) - lbeta(a, b)) if 0 < x < 1 else 0.0


def chi2_cdf(x: float, df: float) -> float:
    return gammainc(df / 2, x / 2)


def chi2_sf(x: float, df: float) -> float:
    return 1 - chi2_cdf(x, df)


def chi2_quantile(p: float, df: float) -> float:
    return _bisect(lambda x: chi2_cdf(x, df), p, 0.0, df + 40 * math.sqrt(2 * df) + 200)


def chi2_pdf(x: float, df: float) -> float:
    return math.exp((df / 2 - 1) * math.log(x) - x / 2 - df / 2 * math.log(2) - math.lgamma(df / 2)) if x > 0 else 0.0


def f_cdf(x: float, d1: float, d2: float) -> float:
    return betainc(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2)) if x > 0 else 0.0


def f_sf(x: float, d1: float, d2: float) -> float:
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0


def t_cdf(x: float, df: float) -> float:
    tail = betainc(df / 2, 0.5, df / (df + x * x)) / 2
    return 1 - tail if x > 0 else tail


def t_quantile(p: float, df: float) -> float:
    return _bisect(lambda x: t_cdf(x, df), p, -1e4, 1e4)


def t_pdf(x: float, df: float) -> float:
    return math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - (df + 1) / 2 * math.log1p(x * x / df)) / math.sqrt(df * math.pi)
