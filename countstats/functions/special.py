"""Tail probabilities: gamma and beta functions by series and continued fractions over whole batches."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300
#: Terms of finite sums that are held at once.
_TERMS = 4_000_000


def _arrays(*values) -> list[np.ndarray]:
    return [np.array(v, dtype=float) for v in np.broadcast_arrays(*(np.atleast_1d(v) for v in values))]


def log_gamma(x) -> np.ndarray:
    """ln of the gamma function for positive x, by Stirling's series from 10 on."""
    (x,) = _arrays(x)
    shift = np.zeros_like(x)
    while (low := x < 10).any():
        shift[low] += np.log(x[low])
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    series = (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y * (1 / 1188 - y * (691 / 360360 - y / 156)))))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series - shift


def _continued(step: Callable[[int], tuple[np.ndarray, np.ndarray]], shape: int, most: int = 500) -> np.ndarray:
    """b0 + a1 / (b1 + a2 / (b2 + ...)) for each place of a batch; ``step(i)`` gives (a_i, b_i)."""
    mend = lambda v: np.where(v == 0, _TINY, v)
    value = mend(np.broadcast_to(step(0)[1], shape).astype(float))
    c, d = value.copy(), np.zeros(shape)
    for i in range(1, most):
        a, b = step(i)
        d = 1 / mend(b + a * d)
        c = mend(b + a / c)
        value = value * c * d
        if (np.abs(c * d - 1) < 1e-15).all():
            break
    return value


def incomplete_beta(a, b, x) -> np.ndarray:
    """The regularised incomplete beta function."""
    a, b, x = _arrays(a, b, x)
    out = np.where(x >= 1, 1.0, 0.0)
    inside = (x > 0) & (x < 1)
    a, b, x = a[inside], b[inside], x[inside]
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)

    def step(i: int) -> tuple[np.ndarray, np.ndarray]:
        if i < 2:
            return np.ones_like(x), np.full_like(x, float(i))
        m, odd = divmod(i - 1, 2)
        top = -(a + m) * (a + b + m) / ((a + 2 * m) * (a + 2 * m + 1)) if odd else m * (b - m) / ((a + 2 * m - 1) * (a + 2 * m))
        return top * x, np.ones_like(x)

    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    found = front * _continued(step, len(x))
    out[inside] = np.where(swap, 1 - found, found)
    return out


def upper_gamma(a, x) -> np.ndarray:
    """The regularised upper incomplete gamma function."""
    a, x = _arrays(a, x)
    out = np.ones_like(x)
    low = (x > 0) & (x < a + 1)
    p, y = a[low], x[low]
    term = 1 / p
    total, n = term.copy(), p.copy()
    while (term > total * 1e-16).any():
        n += 1
        term = term * y / n
        total += term
    out[low] = 1 - np.exp(p * np.log(y) - y - log_gamma(p)) * total
    high = x >= a + 1
    p, y = a[high], x[high]
    steps = lambda i: (np.ones_like(y), np.zeros_like(y)) if i == 0 else (np.ones_like(y), y + 1 - p) if i == 1 else (-(i - 1) * (i - 1 - p), y + 2 * i - 1 - p)
    out[high] = np.exp(p * np.log(np.maximum(y, _TINY)) - y - log_gamma(p)) * _continued(steps, len(y))
    return out


def two_sided_normal(z) -> np.ndarray:
    (z,) = _arrays(z)
    return upper_gamma(0.5, z * z / 2)


def normal_sf(z) -> np.ndarray:
    (z,) = _arrays(z)
    half = two_sided_normal(z) / 2
    return np.where(z > 0, half, 1 - half)


def two_sided_t(t, df) -> np.ndarray:
    t, df = _arrays(t, df)
    return np.where(df > 0, incomplete_beta(np.maximum(df, 1e-9) / 2, 0.5, df / (df + t * t)), np.nan)


def chi2_sf(x, df) -> np.ndarray:
    x, df = _arrays(x, df)
    return upper_gamma(df / 2, x / 2)


def _log_choose(n, k) -> np.ndarray:
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def _summed(low: np.ndarray, high: np.ndarray, term: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each row the sum over i from ``low`` to ``high`` of ``term(row, i)``, some million at a time."""
    out, count = np.zeros(len(low)), np.maximum(high - low + 1, 0).astype(np.int64)
    ends = np.cumsum(count)
    first = 0
    while first < len(out):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _TERMS, "right")))
        for begin in range(0, int(count[first:last].max(initial=0)) if last == first + 1 else 1, _TERMS):
            n = np.minimum(np.maximum(count[first:last] - begin, 0), _TERMS) if last == first + 1 else count[first:last]
            row = np.repeat(np.arange(first, last), n)
            i = low[row] + begin + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            out[first:last] += np.bincount(row - first, weights=term(row, i), minlength=last - first)
        first = last
    return out


def hypergeometric_sf(k, population, marked, drawn) -> np.ndarray:
    """Probability of at least ``k`` marked among ``drawn``."""
    k, population, marked, drawn = _arrays(k, population, marked, drawn)
    whole = _log_choose(population, drawn)
    low, high = np.maximum(np.maximum(k, 0), drawn + marked - population), np.minimum(marked, drawn)
    term = lambda row, i: np.exp(_log_choose(marked[row], i) + _log_choose(population[row] - marked[row], drawn[row] - i) - whole[row])
    return np.minimum(1.0, _summed(low, high, term))


def binomial_two_sided(k, n) -> np.ndarray:
    """Of n with probability 1/2: all outcomes no likelier than ``k``, which are two equal tails."""
    k, n = _arrays(k, n)
    least = np.minimum(k, n - k)
    return np.where(2 * least >= n, 1.0, np.minimum(1.0, 2 * incomplete_beta(n - least, least + 1, 0.5)))


def fisher_two_sided(a, b, c, d) -> np.ndarray:
    """Sum of the probabilities of all tables of the same margins that are no likelier."""
    a, b, c, d = _arrays(a, b, c, d)
    row, column, n = a + b, a + c, a + b + c + d
    log = lambda r, i: _log_choose(row[r], i) + _log_choose(n[r] - row[r], column[r] - i) - _log_choose(n[r], column[r])
    every = np.arange(len(a))
    own = np.exp(log(every, a)) * (1 + 1e-7)

    def term(r: np.ndarray, i: np.ndarray) -> np.ndarray:
        p = np.exp(log(r, i))
        return np.where(p <= own[r], p, 0.0)

    return np.minimum(1.0, _summed(np.maximum(0, column + row - n), np.minimum(row, column), term))


def vectorised(function):
    """A Column function of a function over arrays; null for a null, NaN or infinite argument."""

    @F.pandas_udf("double")
    def run(*series: pd.Series) -> pd.Series:
        values = np.column_stack([s.to_numpy(dtype=float) for s in series])
        good = np.isfinite(values).all(axis=1)
        out = np.full(len(values), np.nan)
        if good.any():
            out[good] = function(*values[good].T)
        return pd.Series(out).astype("Float64").mask(np.isnan(out))

    return lambda *columns: run(*[F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in columns])


def normal_p(z: Column) -> Column:
    return vectorised(two_sided_normal)(z)


def student_p(t: Column, df: Column) -> Column:
    return vectorised(two_sided_t)(t, df)


def chi2_p(x: Column, df: Column) -> Column:
    return vectorised(chi2_sf)(x, df)


def hypergeometric_p(k: Column, population: Column, marked: Column, drawn: Column) -> Column:
    return vectorised(hypergeometric_sf)(k, population, marked, drawn)


def binomial_p(k: Column, n: Column) -> Column:
    return vectorised(binomial_two_sided)(k, n)


def fisher_p(a: Column, b: Column, c: Column, d: Column) -> Column:
    return vectorised(fisher_two_sided)(a, b, c, d)
