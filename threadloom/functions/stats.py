"""Tail probabilities and small rank tests on plain floats, for results of model size."""

from __future__ import annotations

import math


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_sf(x: float, k: float) -> float:
    """Upper tail of chi-squared: the regularised upper incomplete gamma function at (k/2, x/2)."""
    if x <= 0:
        return 1.0
    a, x = k / 2, x / 2
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # series for the lower tail
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - scale * total)
    b = x + 1 - a  # continued fraction for the upper tail
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = c * d
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return scale * h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 1000):
        for an in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + an * d or 1e-300)
            c = 1 + an / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def spearman_p(rho: float, n: int) -> float:
    if n < 3 or math.isnan(rho):
        return math.nan
    return 0.0 if abs(rho) >= 1 else t_two_sided(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)


def mann_whitney_p(u: float, n: int, m: int, ties: list[int], tied: float | None = None) -> float:
    """Two-sided: exact for small samples without ties, else normal with tie and continuity correction.

    ``tied`` is the sum of t^3 - t over the sizes of tied groups; without it ``ties`` lists the sizes.
    """
    if tied is None:
        tied = sum(t**3 - t for t in ties)
    if min(n, m) <= 8 and tied <= 0:
        ways = [1] + [0] * (n * m)
        for i in range(1, n + 1):  # number of ways to each U, by multiplying and dividing Gaussian binomials
            for k in range(n * m, m + i - 1, -1):
                ways[k] -= ways[k - m - i]
            for k in range(i, n * m + 1):
                ways[k] += ways[k - i]
        low = int(min(u, n * m - u))
        return min(1.0, 2 * sum(ways[: low + 1]) / math.comb(n + m, n))
    whole = n + m
    spread = n * m / 12 * (whole + 1 - tied / (whole * (whole - 1)))
    return 1.0 if spread <= 0 else min(1.0, normal_two_sided((abs(u - n * m / 2) - 0.5) / math.sqrt(spread)))
