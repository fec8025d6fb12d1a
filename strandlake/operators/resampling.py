"""Exact sampling tests."""

from __future__ import annotations

import math


def hypergeometric_tail(k: int, population: int, marked: int, drawn: int) -> float:
    """P(X >= k) for the marked among those drawn without replacement, by log-gamma terms; the sum ends where terms no longer count."""
    log_choose = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
    low, high = max(0, drawn + marked - population), min(marked, drawn)
    if k <= low:
        return 1.0
    if k > high:
        return 0.0
    total = log_choose(population, drawn)
    term = lambda i: math.exp(log_choose(marked, i) + log_choose(population - marked, drawn - i) - total)
    middle = (marked + 1) * (drawn + 1) // (population + 2)
    if k <= middle:  # the lower tail is the shorter one
        return max(0.0, 1 - math.fsum(_falling(term, range(k - 1, low - 1, -1))))
    return min(1.0, math.fsum(_falling(term, range(k, high + 1))))


def _falling(term, places):
    """Terms while they still count; they fall once past the middle."""
    most = 0.0
    for i in places:
        now = term(i)
        most = max(most, now)
        if now < most * 1e-18:
            return
        yield now
