"""Match weights by expectation maximisation over level patterns.

A pair's probability depends only on its pattern of levels, so the fit runs on pattern counts: exact,
without sampling, on a table bounded by the product of the numbers of levels.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

#: Smallest probability, smoothing count, tolerance of order and span of a weight that says nothing (fixed values).
TINY, PSEUDOCOUNT, ORDER_TOLERANCE, NEUTRAL_SPAN = 1e-12, 0.5, 1e-6, 1e-6


@dataclass
class Fit:
    m: list[np.ndarray]
    u: list[np.ndarray]
    match_share: float
    iterations: int = 0
    converged: bool = False
    status: str = "ok"
    reason: str | None = None
    warnings: list[str] = field(default_factory=list)
    informative: list[bool] = field(default_factory=list)


def _logs(levels: np.ndarray, tables: Sequence[np.ndarray], use: Sequence[bool]) -> np.ndarray:
    out = np.zeros(len(levels))
    for c, table in enumerate(tables):
        if use[c]:
            seen = levels[:, c] > 0
            out[seen] += np.log(np.maximum(table[levels[seen, c]], TINY))
    return out


def _posterior(levels: np.ndarray, m, u, share: float, use: Sequence[bool]) -> np.ndarray:
    x = np.log(max(share, TINY)) - np.log(max(1 - share, TINY)) + _logs(levels, m, use) - _logs(levels, u, use)
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def fit(levels: np.ndarray, counts: np.ndarray, tops: Sequence[int], prior: float = 0.001, max_iter: int = 100, tolerance: float = 1e-3) -> Fit:
    """Tables m and u by level (index 0, missing, is unused), the share of matches and diagnostics."""
    counts = counts.astype(float)
    n = counts.sum()
    seen = [np.bincount(levels[:, c], counts, tops[c] + 1) for c in range(len(tops))]
    for s in seen:
        s[0] = 0
    informative = [int((s > 0).sum()) >= 2 for s in seen]
    m, u = [], []
    for top, s in zip(tops, seen, strict=True):
        a = np.zeros(top + 1)
        a[1:top] = 0.25 / max(top - 1, 1)
        a[top] = 0.7
        b = np.zeros(top + 1)
        b[1:] = s[1:] + PSEUDOCOUNT
        m.append(a / a.sum())
        u.append(b / b.sum())
    for c, ok in enumerate(informative):
        if not ok:
            m[c] = u[c].copy()
    share, out = prior, None
    iterations, converged = 0, False
    for iterations in range(1, max_iter + 1):
        r = _posterior(levels, m, u, share, informative) * counts
        new_share = (r.sum() + 0.5) / (n + 1)
        delta = abs(new_share - share)
        for c, ok in enumerate(informative):
            if not ok:
                continue
            for table, weight in ((m, r), (u, counts - r)):
                t = np.bincount(levels[:, c], weight, tops[c] + 1)
                t[0] = 0
                t[1:] += PSEUDOCOUNT
                t /= t.sum()
                delta = max(delta, float(np.abs(t - table[c]).max()))
                table[c] = t
        share = float(new_share)
        if delta < tolerance:
            converged = True
            break
    out = Fit(m, u, share, iterations, converged, informative=informative)
    _diagnose(out, seen)
    return out


def _diagnose(f: Fit, seen: list[np.ndarray]) -> None:
    usable, inverted = [], []
    for c, ok in enumerate(f.informative):
        if not ok:
            continue
        observed = [i for i in range(1, len(seen[c])) if seen[c][i] > 0]
        weight = np.log(np.maximum(f.m[c][observed], TINY)) - np.log(np.maximum(f.u[c][observed], TINY))
        if weight.max() - weight.min() <= NEUTRAL_SPAN:
            continue
        (inverted if weight[-1] < weight[0] - ORDER_TOLERANCE else usable).append(c)
    if inverted:
        f.status, f.reason = "rejected", "closer levels of a comparison weigh against a match"
    elif not usable:
        f.status, f.reason = "rejected", "no comparison tells matches from others"
    elif not f.converged:
        f.status, f.reason = "warning", None
        f.warnings.append("expectation maximisation did not converge")


def score(levels: np.ndarray, f: Fit) -> np.ndarray:
    """Probabilities of patterns, inside the open interval (0, 1)."""
    use = [not np.array_equal(a, b) for a, b in zip(f.m, f.u, strict=True)]
    low, high = float(np.nextafter(np.float32(0), np.float32(1))), float(np.nextafter(np.float32(1), np.float32(0)))
    return np.clip(_posterior(levels, f.m, f.u, f.match_share, use), low, high)
