"""Tail probabilities for a handful of statistics (one number per column pair, on the driver)."""

from __future__ import annotations

import math


def _beta_continued_fraction(a: float, b: float, x: float) -> float:
    tiny, c = 1e-300, 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    result = d
    for m in range(1, 400):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / (c if abs(c) > tiny else tiny)
            result *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return result


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_continued_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_continued_fraction(b, a, 1.0 - x) / b


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation coefficient, Student t with n - 2 degrees of freedom."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1.0:
        return 0.0
    t_squared = r * r * (n - 2) / (1.0 - r * r)
    return incomplete_beta((n - 2) / 2.0, 0.5, (n - 2) / (n - 2 + t_squared))


def k_squared(skewness: float | None, excess_kurtosis: float | None, n: int) -> tuple[float, float] | None:
    """D'Agostino's K-squared and its p from population skewness and excess kurtosis."""
    if skewness is None or excess_kurtosis is None or n < 8:
        return None
    y = skewness * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (beta2 - 1)) - 1
    z_skew = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
    expected = 3.0 * (n - 1) / (n + 1)
    variance = 24.0 * n * (n - 2) * (n - 3) / ((n + 1.0) ** 2 * (n + 3) * (n + 5))
    x = (excess_kurtosis + 3.0 - expected) / math.sqrt(variance)
    b = 6.0 * (n * n - 5 * n + 2) / ((n + 7.0) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3)))
    a = 6 + 8 / b * (2 / b + math.sqrt(1 + 4 / (b * b)))
    term = 1 + x * math.sqrt(2 / (a - 4))
    if term == 0:
        return None
    cube = math.copysign(abs((1 - 2 / a) / term) ** (1 / 3), term)
    z_kurt = (1 - 2 / (9 * a) - cube) / math.sqrt(2 / (9 * a))
    statistic = z_skew**2 + z_kurt**2
    return statistic, math.exp(-statistic / 2)
