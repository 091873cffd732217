"""Small numeric functions that Spark has no built-in for: they work on one number or a bounded array."""

from __future__ import annotations

import math


def log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - log_beta(a, b)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / (c if abs(c) > tiny else tiny)
            value *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * value


def beta_quantile(p: float, a: float, b: float) -> float:
    """The x at which beta_cdf is p, by bisection."""
    low, high = 0.0, 1.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, a, b) < p else (low, mid)
    return (low + high) / 2


def clopper_pearson(hits: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """The exact two-sided interval of a share; (0, 1) without trials."""
    if n == 0:
        return 0.0, 1.0
    tail = (1 - level) / 2
    low = 0.0 if hits == 0 else beta_quantile(tail, hits, n - hits + 1)
    high = 1.0 if hits == n else beta_quantile(1 - tail, hits + 1, n - hits)
    return low, high


def upper_bound(hits: int, n: int, level: float = 0.95) -> float:
    """The exact one-sided upper bound of a share."""
    return 1.0 if n == 0 or hits == n else beta_quantile(level, hits + 1, n - hits)


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """The two-sided p of a two-by-two table: tables with its margins that are no likelier than it."""
    row, col, n = a + b, a + c, a + b + c + d
    choose = lambda x, y: math.lgamma(x + 1) - math.lgamma(y + 1) - math.lgamma(x - y + 1)
    weight = lambda k: choose(row, k) + choose(n - row, col - k) - choose(n, col)
    low, high, own = max(0, row + col - n), min(row, col), weight(a)
    return min(1.0, sum(math.exp(w) for k in range(low, high + 1) if (w := weight(k)) <= own + 1e-7))


def isotonic(values: list[float], weights: list[float]) -> list[float]:
    """The non-decreasing fit of values in order, by pooling neighbours that fall."""
    pools: list[list[float]] = []
    for v, w in zip(values, weights):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return [v for v, _, n in pools for _ in range(int(n))]
