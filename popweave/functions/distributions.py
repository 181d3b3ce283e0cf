"""Tail probabilities of the t, F, chi-square and normal distributions.

For the handful of rows that a hypothesis test yields; plain Python, since the
regularised incomplete beta and gamma functions are not among Spark's.
"""

from __future__ import annotations

import math

import numpy as np


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz steps)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    # The steps that are needed grow with the root of the larger parameter.
    for m in range(1, 400 + 8 * math.isqrt(int(max(a, b)))):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + numerator * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + numerator / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return total


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1 - front * _fraction(b, a, 1 - x) / b


def incomplete_gamma_upper(a: float, x: float) -> float:
    """Q(a, x), by the series for small x and the continued fraction otherwise."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, df1: float, df2: float) -> float:
    return incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def chi2_upper(x: float, df: float) -> float:
    return incomplete_gamma_upper(df / 2, x / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


#: Sizes up to which the smaller group of a rank test has its exact law.
EXACT_BELOW = 8


def mann_whitney_exact(u: float, n1: int, n2: int) -> float:
    """P of a U at least as far from its middle, without ties.

    Samples by their U are the coefficients of the product of (1 - q^(n + i)) / (1 - q^i) for i up
    to the smaller size m; only those up to the nearer tail's end are made.
    """
    m, n = min(n1, n2), max(n1, n2)
    tail = int(min(u, n1 * n2 - u))
    ways = np.zeros(tail + 1)
    ways[0] = 1.0
    for i in range(1, m + 1):
        if n + i <= tail:
            ways[n + i :] -= ways[: -(n + i)].copy()
        for start in range(min(i, tail + 1)):
            ways[start::i] = np.cumsum(ways[start::i])
    return min(2 * float(ways.sum()) / math.comb(n1 + n2, m), 1.0)


def mann_whitney_two_sided(u: float, z: float, n1: float, n2: float, ties: float) -> float:
    """The exact law where a group is small and no value is tied, else the normal one of z."""
    if ties == 0 and min(n1, n2) <= EXACT_BELOW:
        return mann_whitney_exact(u, int(n1), int(n2))
    return normal_two_sided(z)


def t_quantile(p: float, df: float) -> float:
    """The t value whose lower tail is p > 1/2, by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        if 1 - t_two_sided(mid, df) / 2 < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2
