"""Student-t tails and binomial draws, the two computations Spark has no built-in for.

Both are elementwise Arrow functions over whole batches; Spark partitions the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

STEPS = 2000
EPSILON = 1e-15


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Log-gamma of positive values: shifted up to at least 10, then Stirling's series."""
    x = np.array(x, dtype=float)
    shift = np.zeros_like(x)
    for _ in range(10):
        small = x < 10.0
        if not small.any():
            break
        shift[small] += np.log(x[small])
        x[small] += 1.0
    y = 1.0 / (x * x)
    series = (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y * (1 / 1188 - y * 691 / 360360))))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - shift


def regularised_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz).

    Elements leave the loop as soon as their fraction has settled.
    """
    x, a, b = (np.array(v, dtype=float).ravel() for v in np.broadcast_arrays(x, a, b))
    flip = x > (a + 1.0) / (a + b + 2.0)
    x, a, b = np.where(flip, 1.0 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    low = np.where(x <= 0.0, 0.0, 1.0)
    at = np.nonzero((x > 0.0) & (x < 1.0))[0]
    xs, aa, bb = x[at], a[at], b[at]
    front = np.exp(aa * np.log(xs) + bb * np.log1p(-xs) - (log_gamma(aa) + log_gamma(bb) - log_gamma(aa + bb))) / aa
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(xs)
    d = 1.0 / guard(1.0 - (aa + bb) * xs / (aa + 1.0))
    h = d.copy()
    for m in range(1, STEPS):
        if not len(at):
            break
        even = m * (bb - m) * xs / ((aa + 2 * m - 1) * (aa + 2 * m))
        d = 1.0 / guard(1.0 + even * d)
        c = guard(1.0 + even / c)
        h = h * (c * d)
        odd = -(aa + m) * (aa + bb + m) * xs / ((aa + 2 * m) * (aa + 2 * m + 1))
        d = 1.0 / guard(1.0 + odd * d)
        c = guard(1.0 + odd / c)
        delta = c * d
        h = h * delta
        done = np.abs(delta - 1.0) < EPSILON
        if done.any() or m == STEPS - 1:
            low[at[done]] = (front * h)[done]
            keep = ~done
            at, xs, aa, bb, front, c, d, h = (v[keep] for v in (at, xs, aa, bb, front, c, d, h))
    if len(at):
        low[at] = front * h
    return np.where(flip, 1.0 - low, low)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= t)."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return regularised_beta(df / (df + t * t), df / 2.0, np.full_like(df, 0.5))


def t_magnitude(p: np.ndarray, df: np.ndarray) -> np.ndarray:
    """|t| whose two-sided tail is p: Newton steps in log-log space, kept inside a bracket."""
    p, df = np.asarray(p, dtype=float), np.asarray(df, dtype=float)
    x = np.zeros_like(p)
    low, high = np.full_like(p, -400.0), np.full_like(p, 400.0)
    constant = log_gamma((df + 1) / 2) - log_gamma(df / 2) - 0.5 * np.log(df * np.pi)
    active = np.arange(len(p))
    for _ in range(200):
        if not len(active):
            break
        v, n, target = x[active], df[active], p[active]
        t = np.exp(v)
        tail = t_two_sided(t, n)
        above = tail > target
        low[active] = np.where(above, v, low[active])
        high[active] = np.where(above, high[active], v)
        with np.errstate(all="ignore"):
            slope = -2.0 * np.exp(constant[active] - (n + 1) / 2 * np.log1p(t * t / n)) * t / tail
            step = v - (np.log(tail) - np.log(target)) / slope
        middle = 0.5 * (low[active] + high[active])
        inside = np.isfinite(step) & (step > low[active]) & (step < high[active])
        fresh = np.where(inside, step, middle)
        x[active] = fresh
        active = active[np.abs(fresh - v) > EPSILON]
    return np.exp(x)


def _nulls(values: np.ndarray) -> pd.Series:
    """Values with NULL for NaN; objects only where there are any."""
    missing = np.isnan(values)
    return pd.Series(values).astype(object).where(~missing, None) if missing.any() else pd.Series(values)


def _standard_error(beta: pd.Series, p: pd.Series, df: pd.Series) -> pd.Series:
    b, q, n = (s.to_numpy(dtype=float, na_value=np.nan) for s in (beta, p, df))
    with np.errstate(all="ignore"):
        usable = np.isfinite(b) & (b != 0) & (q > 0) & (q < 1) & np.isfinite(n) & (n > 0)
        out = np.full(b.shape, np.nan)
        if usable.any():
            # equal pairs of a p-value and its degrees of freedom are inverted once
            pairs, place = np.unique(q[usable] + 1j * n[usable], return_inverse=True)
            out[usable] = np.abs(b[usable]) / t_magnitude(pairs.real, pairs.imag)[place]
        out[~(np.isfinite(out) & (out > 0))] = np.nan
    return _nulls(out)


def _two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    v, n = t.to_numpy(dtype=float, na_value=np.nan), df.to_numpy(dtype=float, na_value=np.nan)
    out = np.full(v.shape, np.nan)
    usable = np.isfinite(v) & (n > 0)
    with np.errstate(all="ignore"):
        if usable.any():
            pairs, place = np.unique(v[usable] + 1j * n[usable], return_inverse=True)
            out[usable] = t_two_sided(pairs.real, pairs.imag)[place]
    return _nulls(out)


def binomial_quantile(u: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """Smallest k with P(X <= k) > u for X ~ Binomial(n, p), by bisection on the exact CDF."""
    u, n = np.asarray(u, dtype=float), np.asarray(n, dtype=np.int64)
    if p >= 1.0:
        return n.copy()
    low, high = np.zeros_like(n), n.copy()
    while np.any(low < high):
        middle = (low + high) // 2
        cdf = np.where(
            middle >= n, 1.0, regularised_beta(1.0 - p, np.maximum(n - middle, 1), middle + 1.0)
        )
        reached = cdf > u
        high, low = np.where(reached, middle, high), np.where(reached, low, middle + 1)
        low = np.minimum(low, high)
    return low


def _thinned(n: pd.Series, u: pd.Series, fraction: pd.Series) -> pd.Series:
    out = np.zeros(len(n), dtype=np.int64)
    for value in fraction.unique():
        rows = (fraction == value).to_numpy()
        out[rows] = binomial_quantile(u[rows].to_numpy(), n[rows].to_numpy(), float(value))
    return pd.Series(out)


# Declared non-deterministic only so that the optimiser neither copies nor moves them.
standard_error = F.pandas_udf(_standard_error, DoubleType()).asNondeterministic()
"""Standard error from an effect, its two-sided p-value and the test's degrees of freedom."""

two_sided_p = F.pandas_udf(_two_sided_p, DoubleType()).asNondeterministic()
"""Two-sided Student-t tail probability."""

thinned = F.pandas_udf(_thinned, LongType()).asNondeterministic()
"""Binomial draw for a count, from a uniform value and a keep fraction."""
