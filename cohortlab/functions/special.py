"""Tail probabilities in plain Python, for numbers that are already aggregated."""

from __future__ import annotations

from math import exp, lgamma, log, log1p, sqrt

_TINY, _ROUNDS, _EPS = 1e-300, 1000, 1e-15


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    front = exp(a * log(x) - x - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, _ROUNDS):
            term *= x / (a + n)
            total += term
            if term < total * _EPS:
                break
        return max(0.0, 1 - front * total)
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for n in range(1, _ROUNDS):
        k = -n * (n - a)
        b += 2
        d = 1 / (k * d + b or _TINY)
        c = b + k / c or _TINY
        h *= d * c
        if abs(d * c - 1) < _EPS:
            break
    return front * h


def beta_regularised(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b), by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_regularised(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or _TINY)
    h = d
    for m in range(1, _ROUNDS):
        before = h
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d or _TINY)
            c = 1 + k / c or _TINY
            h *= c * d
        if abs(h - before) < abs(h) * _EPS:
            break
    return front * h


def chi2_tail(x: float, dof: int) -> float:
    return gamma_upper(dof / 2, x / 2)


def t_two_sided(t: float, dof: float) -> float:
    return beta_regularised(dof / 2, 0.5, dof / (dof + t * t))


def kolmogorov_tail(x: float) -> float:
    """P(K > x) of the limiting Kolmogorov distribution."""
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * exp(-2 * k * k * x * x) for k in range(1, 101))))


def ks_p_value(d: float, n: int, m: int) -> float:
    """Asymptotic two-sided p of the two-sample statistic."""
    return kolmogorov_tail(d * sqrt(n * m / (n + m)))
