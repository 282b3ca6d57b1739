"""Tail probabilities of test statistics, for the one-row summaries of a test."""

from __future__ import annotations

import math

_TINY = 1e-300


def _converge(step, start: int = 1, limit: int = 10_000) -> float:
    """Continued fraction by the modified Lentz method; ``step(i)`` gives (a_i, b_i)."""
    _, b = step(start - 1)
    value = b or _TINY
    c, d = value, 0.0
    for i in range(start, limit):
        a, b = step(i)
        d = 1.0 / ((b + a * d) or _TINY)
        c = (b + a / c) or _TINY
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return value
    # The last bits may go on swinging; anything more is no result.
    if abs(c * d - 1.0) < 1e-12:
        return value
    raise ArithmeticError(f"no convergence after {limit} steps")


def chi2_tail(statistic, dof):
    """P(X >= statistic) for the chi-square distribution."""
    if statistic is None or not dof or dof <= 0:
        return None
    if statistic <= 0:
        return 1.0
    a, x = dof / 2.0, statistic / 2.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1.0
            term *= x / n
            total += term
        return max(0.0, 1.0 - scale * total)
    return scale / _converge(lambda i: (-i * (i - a) if i else 0.0, x + 1.0 - a + 2.0 * i))


def _beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _beta_share(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )

    def step(i: int) -> tuple[float, float]:
        if i == 0:
            return 0.0, 1.0
        m = i // 2
        if i % 2:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    return front / (a * _converge(step))


def t_tail(statistic, dof):
    """Two-sided tail probability of Student's t."""
    if statistic is None or not dof or dof <= 0:
        return None
    return _beta_share(dof / 2.0, 0.5, dof / (dof + statistic * statistic))


def f_tail(statistic, dof1, dof2):
    """P(X >= statistic) for the F distribution."""
    if statistic is None or not dof1 or not dof2 or dof2 <= 0:
        return None
    return _beta_share(dof2 / 2.0, dof1 / 2.0, dof2 / (dof2 + dof1 * statistic))


def t_reach(dof, level=0.95):
    """The t value whose two-sided tail is ``1 - level``."""
    if not dof or dof <= 0:
        return None
    lo, hi = 0.0, 1.0
    while t_tail(hi, dof) > 1.0 - level:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if t_tail(mid, dof) > 1.0 - level else (lo, mid)
    return (lo + hi) / 2.0
