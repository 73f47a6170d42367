"""p-value of the two-sided two-sample Kolmogorov-Smirnov test.

Up to 10,000 values a sample: the exact probability that a random path over the grid of both samples stays inside
the observed distance. Beyond: the one-sample distribution for the harmonic sample size, by powers of
a matrix (Marsaglia, Tsang and Wang).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EXACT_UP_TO = 10_000


def two_sample(d: float, n: int, m: int) -> float:
    """1 minus the probability of paths with |i / n - j / m| < d everywhere."""
    if d <= 0:
        return 1.0
    i = np.arange(n + 1)
    on = np.zeros(n + 1)  # by i, on the diagonal i + j = t: the share of orders that came there and stayed inside
    on[0] = 1.0
    for t in range(1, n + m + 1):
        j = t - i
        after = on * (np.maximum(j, 0) / t)
        after[1:] += on[:-1] * (i[1:] / t)
        after[(j < 0) | (j > m) | (np.abs(i / n - j / m) >= d - 1e-10)] = 0.0
        on = after
    return float(min(1.0, max(0.0, 1 - on[n])))


def one_sample(d: float, n: int) -> float:
    """P(D_n > d)."""
    if d <= 0 or n < 1:
        return 1.0
    k = int(n * d) + 1
    size, h = 2 * k - 1, k - n * d
    if size > 2000:
        return float(2 * sum((-1) ** (i - 1) * math.exp(-2 * i * i * n * d * d) for i in range(1, 101)))
    at = np.arange(size)
    base = (at[:, None] - at[None, :] + 1 >= 0).astype(float)
    for i in range(size):
        base[i, 0] -= h ** (i + 1)
        base[size - 1, i] -= h ** (size - i)
    base[size - 1, 0] += (2 * h - 1) ** size if 2 * h > 1 else 0
    over = np.maximum(at[:, None] - at[None, :] + 1, 0)
    base /= np.vectorize(lambda x: float(math.factorial(min(int(x), 170))))(over)
    power, exponent = np.eye(size), 0
    square, e2, left = base, 0, n
    while left:
        if left & 1:
            power, exponent = power @ square, exponent + e2
        square, e2, left = square @ square, 2 * e2, left >> 1
        if square.max() > 1e140:
            square, e2 = square * 1e-140, e2 + 140
        if power.max() > 1e140:
            power, exponent = power * 1e-140, exponent + 140
    s, log = power[k - 1, k - 1], exponent
    for i in range(1, n + 1):
        s *= i / n
        if s < 1e-140:
            s, log = s * 1e140, log - 140
    return float(min(1.0, max(0.0, 1 - s * 10.0**log)))


def p_value(d: float, n: int, m: int) -> float:
    if max(n, m) <= EXACT_UP_TO:
        return two_sample(d, n, m)
    return one_sample(d, round(n * m / (n + m)))


@F.pandas_udf(DoubleType())
def ks_p(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([p_value(float(a), int(b), int(c)) for a, b, c in zip(d, n, m, strict=True)])
