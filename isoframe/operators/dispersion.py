"""Negative-binomial fits, and dispersions shrunken to a trend over abundance.

Two trends, each from aggregates over all events:

- local: profile likelihoods are averaged in ranges of mean abundance and smoothed over neighbouring ranges with tricube
  weights that reach a share of all events (weighted likelihood; McCarthy et al. 2012, Chen et al. 2014). An event's own
  profile is added to prior_n times the smoothed one at its abundance.
- parametric: a0 + a1 / mean, a gamma fit to the events' own estimates (Anders and Huber 2010; Love et al. 2014), with a
  log-normal prior around it whose width is what the events' spread leaves after sampling error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoframe.functions import special as sp
from isoframe.sources.store import settle

DISPERSIONS = np.exp(np.linspace(math.log(1e-4), math.log(4.0), 25))
GRID = np.log(DISPERSIONS)
#: Width of a range of log2 abundance, and the share of all events that the smoothing of one range reaches.
RANGE, SPAN = 0.25, 0.3


Pairs = dict[tuple[int, int], np.ndarray]


def _information(w: np.ndarray, x: np.ndarray, ridge: float) -> Pairs:
    """x' w x of each row of weights, with the ridge on its diagonal: an array over rows for each pair of columns (i, j), i >= j, but
    for pairs that are zero whatever the weights, here and in the factors."""
    p = x.shape[1]
    pairs = {(i, j) for i in range(p) for j in range(i + 1) if i == j or (x[:, i] * x[:, j]).any()}
    for j in range(p):
        below = [i for i in range(j + 1, p) if (i, j) in pairs]
        pairs |= {(i, k) for i in below for k in below if i >= k}
    order = sorted(pairs)
    rows = np.stack([x[:, i] * x[:, j] for i, j in order]) @ w.T
    return {(i, j): row + ridge if i == j else row for (i, j), row in zip(order, rows, strict=True)}


def _factors(a: Pairs, p: int) -> tuple[Pairs, np.ndarray]:
    """L (below its diagonal) and D of a = L D L', each step for all rows."""
    a, d = dict(a), []
    for j in range(p):
        d.append(a[j, j])
        below = {i: a[i, j] / d[j] for i in range(j + 1, p) if (i, j) in a}
        for i, row in below.items():
            for k in below:
                if i >= k:
                    a[i, k] = a[i, k] - row * a[k, j]
        a |= {(i, j): row for i, row in below.items()}
    return a, np.stack(d)


def _dense(a: Pairs, p: int, rows: np.ndarray) -> np.ndarray:
    """Whole matrices (rows, p, p) of some rows."""
    out = np.zeros((int(rows.sum()), p, p))
    for (i, j), v in a.items():
        out[:, i, j] = out[:, j, i] = v[rows]
    return out


def _solve(a: Pairs, b: np.ndarray) -> np.ndarray:
    """Solutions (rows, p) for right sides b (p, rows)."""
    p = len(b)
    low, d = _factors(a, p)
    z = list(b)
    for j in range(p):
        for i in range(j + 1, p):
            if (i, j) in low:
                z[i] = z[i] - low[i, j] * z[j]
    z = [v / e for v, e in zip(z, d, strict=True)]
    for j in range(p - 1, -1, -1):
        for i in range(j):
            if (j, i) in low:
                z[i] = z[i] - low[j, i] * z[j]
    out = np.stack(z, axis=1)
    bad = ~(np.isfinite(out).all(axis=1) & (d > 0).all(axis=0))
    if bad.any():  # next to singular: with pivots
        out[bad] = np.linalg.solve(_dense(a, p, bad), b[:, bad].T[..., None])[..., 0]
    return out


def nb_fit(y: np.ndarray, x: np.ndarray, offset: np.ndarray, phi: np.ndarray, steps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and fitted means of NB log-linear models, by damped IRLS over all rows at once."""
    mu = np.maximum(y, 0.25)
    beta = np.log(mu / np.exp(offset)) @ np.linalg.pinv(x).T
    open_ = np.arange(len(y))
    for _ in range(steps):  # of rows that have not settled
        ys, phis, base = y[open_], phi[open_, None], beta[open_]
        eta = np.clip(base @ x.T + offset, -30, 30)
        mu = np.exp(eta)
        w = mu / (1 + phis * mu)
        z = (eta - offset) + (ys - mu) / mu
        with np.errstate(all="ignore"):
            new = _solve(_information(w, x, 1e-8), x.T @ (w * z).T)
        step = np.clip(new - base, -5, 5)
        beta[open_] = base + step
        open_ = open_[np.abs(step).max(axis=1, initial=0) >= 1e-8]
        if not len(open_):
            break
    return beta, np.exp(np.clip(beta @ x.T + offset, -30, 30))


def nb_deviance(y: np.ndarray, mu: np.ndarray, phi: np.ndarray) -> np.ndarray:
    p = phi[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        first = np.where(y > 0, y * np.log(y / mu), 0.0)
        second = np.where(p > 1e-10, (y + 1 / np.maximum(p, 1e-10)) * np.log((1 + p * mu) / (1 + p * y)), mu - y)
    return 2 * (first + second).sum(axis=1)


def nb_profile(y: np.ndarray, x: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Cox-Reid adjusted profile log-likelihoods of each row at DISPERSIONS, some of which are fitted at once."""
    p = x.shape[1]
    # Counts repeat: a logarithm for each that differs.
    known, at = np.unique(y, return_inverse=True)
    at, factorials = at.reshape(y.shape), sp.lgamma(known + 1)
    out = []
    for some in np.array_split(DISPERSIONS, 5):
        phi = np.repeat(some, len(y))
        _, fitted = nb_fit(np.tile(y, (len(some), 1)), x, offset, phi, steps=12)
        with np.errstate(all="ignore"):
            information = _information(fitted / (1 + phi[:, None] * fitted), x, 1e-10)
            diagonal = _factors(information, p)[1]
            logdet = np.log(diagonal).sum(axis=0)
        bad = ~(diagonal > 0).all(axis=0)
        if bad.any():
            logdet[bad] = np.linalg.slogdet(_dense(information, p, bad))[1]
        for d, mu, det in zip(some, fitted.reshape(len(some), *y.shape), logdet.reshape(len(some), len(y)), strict=True):
            r = 1 / d
            ll = ((sp.lgamma(known + r) - sp.lgamma(r) - factorials)[at] + r * np.log(r / (r + mu)) + y * np.log(np.maximum(mu, 1e-30) / (r + mu))).sum(axis=1)
            out.append(ll - 0.5 * det)
    return np.column_stack(out)


def peak(profile: np.ndarray) -> np.ndarray:
    """The log dispersion at which each row of profiles is highest: a parabola through the best point of the grid and its neighbours."""
    k = np.argmax(profile, axis=1)
    inner = np.clip(k, 1, len(GRID) - 2)
    rows = np.arange(len(k))
    lo, mid, hi = (profile[rows, inner + d] for d in (-1, 0, 1))
    bend = lo - 2 * mid + hi
    with np.errstate(divide="ignore", invalid="ignore"):
        shift = np.where(bend < 0, 0.5 * (lo - hi) / bend, 0.0)
    step = GRID[1] - GRID[0]
    return np.where(k == inner, GRID[inner] + np.clip(shift, -1, 1) * step, GRID[k])


def abundance(y: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Mean log2 count of each row, of samples brought to one size."""
    return np.log2((y + 0.5) / scale).mean(axis=1)


@dataclass(frozen=True)
class LocalTrend:
    """Smoothed mean profiles at the middles of ranges of abundance."""

    middle: np.ndarray
    profile: np.ndarray

    def at(self, a: np.ndarray) -> np.ndarray:
        """The profile at each abundance, between the middles of two ranges a mean of both."""
        if len(self.middle) == 1:
            return np.repeat(self.profile, len(a), axis=0)
        right = np.clip(np.searchsorted(self.middle, a), 1, len(self.middle) - 1)
        gap = self.middle[right] - self.middle[right - 1]
        t = np.clip((a - self.middle[right - 1]) / gap, 0, 1)[:, None]
        return (1 - t) * self.profile[right - 1] + t * self.profile[right]

    def dispersions(self, a: np.ndarray) -> np.ndarray:
        return np.exp(peak(self.at(a)))


def smooth(middle: np.ndarray, n: np.ndarray, mean: np.ndarray, span: float = SPAN) -> LocalTrend:
    """Mean profiles of ranges (n events each), averaged with tricube weights out to the distance that `span` of all events takes."""
    order = np.argsort(middle)
    middle, n, mean = middle[order], n[order].astype(float), mean[order]
    out = np.empty_like(mean)
    for k, m in enumerate(middle):
        far = np.abs(middle - m)
        by = np.argsort(far, kind="stable")
        reach = far[by][np.searchsorted(np.cumsum(n[by]), span * n.sum())] + RANGE  # that range and all nearer ones have weight
        w = n * np.clip(1 - (far / reach) ** 3, 0, None) ** 3
        out[k] = w @ mean / w.sum()
    return LocalTrend(middle, out)


def local_trend(profiles: DataFrame, grid: str, a: str, span: float = SPAN) -> LocalTrend:
    """The trend of all events from columns of profiles and abundances: one row for each range that has events passes through the driver."""
    mine = profiles.select(F.floor(F.col(a) / RANGE).alias("k"), F.col(a).alias("a"), F.col(grid).alias("g")).where("k is not null")
    sums = mine.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("a"), *[F.avg(F.col("g")[i]).alias(f"g{i}") for i in range(len(GRID))]).orderBy("k").collect()
    if not sums:
        return LocalTrend(np.zeros(1), np.zeros((1, len(GRID))))
    return smooth(np.array([r["a"] for r in sums]), np.array([r["n"] for r in sums]), np.array([[r[f"g{i}"] for i in range(len(GRID))] for r in sums]), span)


@dataclass(frozen=True)
class ParametricTrend:
    """dispersion = a0 + a1 / mean, and the variance of log dispersions around it: in all, and without sampling error."""

    a0: float
    a1: float
    spread: float
    prior: float

    def dispersions(self, mean: np.ndarray) -> np.ndarray:
        return np.clip(self.a0 + self.a1 / np.maximum(mean, 1e-8), DISPERSIONS[0], None)

    def shrink(self, profile: np.ndarray, mean: np.ndarray) -> np.ndarray:
        """Dispersions that maximise the profile and the prior; those far above the trend keep their own."""
        at, own = np.log(self.dispersions(mean)), peak(profile)
        best = peak(profile - (GRID[None, :] - at[:, None]) ** 2 / (2 * self.prior))
        return np.exp(np.where(own > at + 2 * math.sqrt(self.spread), own, best))


def parametric_trend(own: DataFrame, df: int, steps: int = 60) -> ParametricTrend:
    """The trend of columns `mean` and `own` (each event's dispersion): gamma regression with identity link, reweighted until it
    settles, each step one aggregate of five sums; then the robust spread of log residuals. Events at the lower end of the
    grid have no sign of dispersion and do not count."""
    # Two numbers an event, read at each step; the rows they come from hold whole profiles.
    use = settle(own.where((F.col("mean") > 0) & (F.col("own") > float(DISPERSIONS[0]) * 1.01)).select((1 / F.col("mean")).alias("x"), F.col("own").alias("y")))
    first = use.agg(F.avg("y").alias("m"), F.count(F.lit(1)).alias("n")).first()
    if not first["n"]:
        return ParametricTrend(float(DISPERSIONS[0]), 0.0, 0.25, 0.25)
    a0, a1 = first["m"], 0.0
    for _ in range(steps):
        fit = F.greatest(F.lit(a0) + F.lit(a1) * F.col("x"), F.lit(1e-8))
        w = 1 / (fit * fit)
        seen = use.where((F.col("y") / fit > 1e-4) & (F.col("y") / fit < 15))
        s = seen.agg(*[F.sum(e).alias(k) for k, e in (("w", w), ("wx", w * F.col("x")), ("wxx", w * F.col("x") * F.col("x")), ("wy", w * F.col("y")), ("wxy", w * F.col("x") * F.col("y")))]).first()
        if s["w"] is None:
            break
        det = s["w"] * s["wxx"] - s["wx"] ** 2
        b1 = (s["w"] * s["wxy"] - s["wx"] * s["wy"]) / det if det > 1e-12 * s["w"] * s["wxx"] else 0.0
        b0 = (s["wy"] - b1 * s["wx"]) / s["w"]
        if b1 < 0 or b0 < 0:  # one of the two alone fits better than a negative part
            b0, b1 = (s["wy"] / s["w"], 0.0) if b1 < 0 else (1e-8, s["wxy"] / s["wxx"])
        moved = abs(math.log(max(b0, 1e-8) / max(a0, 1e-8))) + abs(math.log(max(b1, 1e-8) / max(a1, 1e-8)))
        a0, a1 = b0, b1
        if moved < 1e-6:
            break
    fit = F.greatest(F.lit(a0) + F.lit(a1) * F.col("x"), F.lit(float(DISPERSIONS[0])))
    off = use.select((F.ln("y") - F.ln(fit)).alias("r"))
    middle = off.agg(F.percentile_approx("r", 0.5, 100000)).first()[0]
    mad = off.agg(F.percentile_approx(F.abs(F.col("r") - F.lit(middle)), 0.5, 100000)).first()[0]
    spread = (1.4826 * mad) ** 2
    return ParametricTrend(a0, a1, spread, max(spread - float(sp.trigamma(df / 2)), 0.25))
