"""The bootstrap's numpy kernels: draws from the compressed rows of a gene or pair in a group, and the
regressions of blocks of draws over groups. Nothing here depends on how draws are cut into blocks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np

from ..functions.special import two_sided_normal

#: Most values (rows x draws) that a task holds at once.
CHUNK = 2_000_000
#: Draws that are summed up together, and among which a hierarchical bootstrap picks.
UNIT = 100


def generator(seed: int, *names: object) -> np.random.Generator:
    """A stream of its own for each gene and group, the same in every run and partitioning."""
    digest = hashlib.blake2b(repr((seed, *names)).encode(), digest_size=8).digest()
    return np.random.default_rng(int.from_bytes(digest, "big"))


def resample(rng: np.random.Generator, n: np.ndarray, draws: int, statistic: Callable[[np.ndarray], tuple]) -> tuple[np.ndarray, ...]:
    """H1, H2. ``statistic`` of weights (rows x draws) ~ Multinomial(sum n, n / sum n), in chunks.
    With one distinct row there is nothing to draw from: all nan."""
    if len(n) < 2 or not draws:
        width = len(statistic(n.reshape(-1, 1).astype(float)))
        return tuple(np.full(draws, np.nan) for _ in range(width))
    total, parts, size = int(n.sum()), [], max(1, CHUNK // len(n))
    for first in range(0, draws, size):
        weights = rng.multinomial(total, n / total, size=min(size, draws - first)).T.astype(float)
        parts.append(statistic(weights))
    return tuple(np.concatenate(p) for p in zip(*parts))


def alike(n: np.ndarray, inverse: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows with all rows of zeros as one, largest numbers first: for statistics to which zeros add
    nothing, whatever their size factor. Sums of a multinomial's places are a multinomial again."""
    zero = np.all([v == 0 for v in values], axis=0)
    n, inverse, *values = (np.concatenate([[z], v[~zero]]) for z, v in zip((n[zero].sum(), 1.0, *[0.0] * len(values)), (n, inverse, *values)))
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    return tuple(v[order] for v in (n, inverse, *values))


def fill_invalid(values: np.ndarray, bad: np.ndarray, rng: np.random.Generator | None) -> np.ndarray | None:
    """H3. Invalid draws replaced by random valid ones, or in turn by the first, second ... valid one if
    there is no ``rng``; None if all are invalid."""
    if len(bad) and bad.all():
        return None
    out, valid, missing = values.copy(), values[~bad], int(bad.sum())
    out[bad] = rng.choice(valid, missing) if rng is not None else valid[np.arange(missing) % max(1, len(valid))]
    return out


def residual(mean: np.ndarray, var: np.ndarray, fit: tuple[float, float, float, float]) -> np.ndarray:
    center, c0, c1, c2 = fit
    with np.errstate(invalid="ignore", divide="ignore"):
        z = np.log(mean) - center
        out = np.exp(np.log(var) - (c0 + c1 * z + c2 * z * z))
    return np.where((mean > 0) & (var > 0), out, np.nan)


def _without(values: np.ndarray, covariates: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Residuals of weighted least squares on the covariates and an intercept. Sums go from group to group, so
    that a column has the same numbers whatever stands beside it."""
    x = np.column_stack([np.ones(len(weights)), covariates])
    solver = np.linalg.pinv(x * np.sqrt(weights)[:, None]) * np.sqrt(weights)
    return values - _in_turn(x, _in_turn(solver, values))


def _in_turn(a: np.ndarray, values: np.ndarray) -> np.ndarray:
    """a @ values, each sum from the first row of ``values`` to the last."""
    out = np.zeros((len(a), values.shape[1]))
    for column, row in zip(a.T, values):
        out += column[:, None] * row
    return out


#: (groups, first draw, draws, unit) -> for each group and draw the place of a group and a draw of the unit.
Picks = Callable[[int, int, int], tuple[np.ndarray, np.ndarray]]


def random_picks(seed: int, *names: object) -> Picks:
    """Groups drawn with replacement, each with a random draw of its own, a stream for each unit of draws."""

    def pick(groups: int, unit: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        rng = generator(seed, *names, unit)
        return rng.integers(0, groups, (groups, width)), rng.integers(0, width, (groups, width))

    return pick


def given_picks(groups: int, unit: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The same by a rule that any engine can repeat."""
    g, d = np.arange(groups)[:, None], unit * UNIT + np.arange(width)
    return (3 * g + 5 * d + 1) % groups, (7 * g + 11 * d + 3) % width


def effects(values: np.ndarray, treatments: np.ndarray, covariates: np.ndarray, weights: np.ndarray, picks: Picks | None = None, unit: int = 0) -> np.ndarray:
    """H5, H6. One row of coefficients for each treatment, a column for each column of ``values``.

    ``values`` is groups x draws. Values and treatments are freed of the covariates; the coefficient
    is the weighted slope for each treatment on its own. With treatments all 1 it is the weighted
    mean. With ``picks`` the groups are drawn anew for each column, from draws of the same UNIT columns;
    ``unit`` is the number of the first.
    """
    if (treatments == 1).all():
        return _in_turn((weights / weights.sum())[None, :], values).repeat(treatments.shape[1], axis=0)
    known = np.isfinite(treatments).all(axis=0)
    t, total = np.full(treatments.shape, np.nan), weights.sum()
    t[:, known] = _without(treatments[:, known], covariates, weights)
    spread = (weights[:, None] * t * t).sum(axis=0)
    told = known & (spread > 1e-12 * total)
    out = np.full((t.shape[1], values.shape[1]), np.nan)
    if picks is None:
        # The residuals of a treatment are at right angles to the covariates, so values need not be freed of them.
        out[told] = _in_turn((weights[:, None] * t[:, told] / spread[told]).T, values)
        return out
    y = _without(values, covariates, weights)
    for first in range(0, y.shape[1], UNIT):
        own = y[:, first : first + UNIT]
        pick, column = picks(len(y), unit + first // UNIT, own.shape[1])
        own, w = own[pick, column], weights[pick]
        total = w.sum(axis=0)
        own = own - (w * own).sum(axis=0) / total
        for k in np.flatnonzero(told):
            x = t[:, k][pick]
            x = x - (w * x).sum(axis=0) / total
            spread = (w * x * x).sum(axis=0)
            ok = spread > 1e-12 * total
            out[k, first : first + UNIT][ok] = (w * x * own).sum(axis=0)[ok] / spread[ok]
    return out


def unit_sums(coefficients: np.ndarray, observed: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each row of coefficients and each UNIT of its draws: the number of finite ones, their mean and
    sum of squares around it, and how many lie farther from ``observed`` than that lies from 0."""
    rows, draws = coefficients.shape
    units = -(-draws // UNIT)
    padded = np.full((rows, units * UNIT), np.nan)
    padded[:, :draws] = coefficients
    padded = padded.reshape(rows, units, UNIT)
    ok = np.isfinite(padded)
    n = ok.sum(axis=2)
    mean = np.where(ok, padded, 0.0).sum(axis=2) / np.maximum(n, 1)
    m2 = (np.where(ok, padded - mean[:, :, None], 0.0) ** 2).sum(axis=2)
    with np.errstate(invalid="ignore"):
        beyond = (np.abs(padded - observed[:, None, None]) > np.abs(observed)[:, None, None]).sum(axis=2)
    return n, mean, m2, beyond


def loglinear(y: np.ndarray, x: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """H11. Coefficients and fitted values of a Poisson regression by iterated weighted least squares;
    where that does not settle, least squares of ln y."""
    beta = np.linalg.lstsq(x, np.log(np.maximum(y, 1e-12)) - offset, rcond=None)[0]
    start = beta.copy()
    for _ in range(100):
        fitted = np.exp(np.clip(x @ beta + offset, -700, 700))
        root = np.sqrt(fitted)[:, None]
        target = x @ beta + (y - fitted) / np.maximum(fitted, 1e-300)
        try:
            new = np.linalg.lstsq(x * root, target * root[:, 0], rcond=None)[0]
        except np.linalg.LinAlgError:
            break
        if not np.isfinite(new).all():
            break
        if np.abs(new - beta).max() < 1e-10:
            return new, np.exp(x @ new + offset)
        beta = new
    fitted = np.exp(x @ start + offset)
    return (start, fitted) if np.isfinite(fitted).all() else None


def weighted_line(y: np.ndarray, x: np.ndarray, weights: np.ndarray) -> tuple[float, float, float]:
    """Last coefficient of weighted least squares, its error from inverse variances, and the normal p."""
    beta = np.linalg.pinv((x * weights[:, None]).T @ x) @ (x * weights[:, None]).T @ y
    se = math.sqrt(max(0.0, np.diag(np.linalg.pinv((x * weights[:, None]).T @ x))[-1]))
    return float(beta[-1]), se, float(two_sided_normal(beta[-1] / se)[0]) if se > 0 else math.nan
