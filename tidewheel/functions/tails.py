"""Tail probabilities for test statistics: small numeric helpers used on result rows."""

from __future__ import annotations

import math


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / _away(an * d + b, tiny)
        c = _away(b + an / c, tiny)
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def _away(x: float, tiny: float) -> float:
    return x if abs(x) > tiny else tiny


def beta_lower(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_lower(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 / _away(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 10_000):
        num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / _away(1 + num * d, tiny)
        c = _away(1 + num / c, tiny)
        h *= d * c
        num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / _away(1 + num * d, tiny)
        c = _away(1 + num / c, tiny)
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h / a


def chi2_tail(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def t_two_sided(t: float, df: float) -> float:
    return beta_lower(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_lower(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


# Response-surface polynomials of the unit-root distribution with a
# constant (MacKinnon 1994), lowest power first, and the range they hold for.
ADF_STAR, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def adf_p_value(stat: float) -> float:
    if stat > ADF_MAX:
        return 1.0
    if stat < ADF_MIN:
        return 0.0
    poly = ADF_SMALL if stat <= ADF_STAR else ADF_LARGE
    return normal_cdf(sum(c * stat**i for i, c in enumerate(poly)))
