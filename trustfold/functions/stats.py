"""Closed forms on the driver for single numbers: distribution functions that SQL lacks."""

from __future__ import annotations

import math


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_survival_even(x: float, df: int) -> float:
    """Upper tail of chi-squared with an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, df // 2):
        term *= half / i
        total += term
    return math.exp(-half) * total


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d or tiny), 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def ks_p_value(d: float, n: int, m: int) -> float:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value."""
    x = d * math.sqrt(n * m / (n + m))
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def format_p(p: float | None) -> str:
    if p is None:
        return "p = NA"
    return "p < 0.001" if p < 0.001 else f"p = {p:.3f}"
