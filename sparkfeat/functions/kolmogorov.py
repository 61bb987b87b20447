"""Exact p-value of the two-sample Kolmogorov-Smirnov statistic."""

from __future__ import annotations

import numpy as np


def ks_exact_p(n1: int, n2: int, reach: int) -> float:
    """P(D >= reach / (n1·n2)) when both samples come from one continuous distribution.

    Every order of the pooled sample is a lattice path from (0, 0) to (n1, n2), all equally
    likely; D is reached when the path meets a point with |i·n2 - j·n1| >= reach. The share of
    paths to (i, j) that have met one follows from the points one step before, a diagonal
    i + j = s at a time: the last step came from the first sample with probability i / s.
    """
    if reach <= 0:
        return 1.0
    met = np.zeros(n1 + 1)                                    # by i, on the current diagonal
    i = np.arange(n1 + 1)
    for s in range(1, n1 + n2 + 1):
        lo, hi = max(0, s - n2), min(s, n1)
        own = i[lo:hi + 1]
        before = np.concatenate([[0.0], met[:-1]])[lo:hi + 1]  # one less of the first sample
        here = before * own / s + met[lo:hi + 1] * (s - own) / s
        far = np.abs(own * n2 - (s - own) * n1) >= reach
        met[lo:hi + 1] = np.where(far, 1.0, here)
    return float(min(1.0, max(0.0, met[n1])))
