"""Empirical-Bayes steps over all events whose hyperparameters come from aggregates: log-odds of moderated t, and the
marginal likelihood of residual dispersions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from isoframe.functions import special as sp
from isoframe.operators.tables import number_all
from isoframe.sources.store import settle


# --- B: log-odds of a moderated t ------------------------------------------------------------------------------------


def effect_variance(t: np.ndarray, rank: np.ndarray, n: int, unscaled: float, df: float, share: float) -> np.ndarray:
    """What each of the largest |t| says of the variance of non-null effects: t over the quantile that its rank would have if
    `share` of the n statistics were not null (Smyth 2004, section 6.3)."""
    p = max(math.ceil(share / 2 * n) / n, share)
    tail = sp.t_sf2(np.abs(t), df)
    want = ((rank - 0.5) / n - (1 - p) * tail) / p
    out = np.zeros(len(t))
    more = want > tail
    out[more] = unscaled * ((np.abs(t[more]) / sp.t_isf2(want[more], df)) ** 2 - 1)
    return out


def log_odds(fits: DataFrame, t: str, n: int, unscaled: float, s0: float, d0: float, df: float, share: float = 0.01) -> Column:
    """B of each moderated t in column t (n in all): log of the odds that the effect is not null.

    unscaled: variance of the estimate over that of the residuals. df: degrees of freedom of t. The prior variance of
    effects is a mean over the largest share/2 of all |t|, which are ranked without leaving the executors.
    """
    target = math.ceil(share / 2 * n)
    size = fits.select(F.abs(F.col(t)).alias("_t"), "event_name").where("_t is not null")
    # Statistics well above the one sought are ranked, not all; the approximate quantile leaves a margin.
    least = size.agg(F.percentile_approx("_t", max(0.0, 1 - 2 * share / 2 - 100 / max(n, 1)), 10000)).first()[0]
    if least is None:
        return F.lit(None).cast("double")
    ranked = number_all(size.where(F.col("_t") >= F.lit(least)), [F.col("_t").desc(), "event_name"], "rank").where(F.col("rank") <= target)
    low, high = 0.1**2 / s0, 4**2 / s0

    @F.pandas_udf(DoubleType())
    def variance(v: pd.Series, rank: pd.Series) -> pd.Series:
        return pd.Series(np.clip(effect_variance(v.to_numpy(float), rank.to_numpy(float), n, unscaled, df, share), low, high))

    v0 = ranked.agg(F.avg(variance("_t", "rank"))).first()[0]
    r = (unscaled + v0) / unscaled
    square = F.col(t) * F.col(t)
    kernel = square * (1 - 1 / r) / 2 if d0 > 1e6 else (1 + df) / 2 * F.ln((square + df) / (square / r + df))
    return F.lit(math.log(share / (1 - share)) - math.log(r) / 2) + kernel


# --- dispersions of the double-exponential family --------------------------------------------------------------------


def marginal(sums: dict[int, dict[str, float]], log_s0: float, log_d0: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted log-likelihood that residual dispersions s, with s / s0 ~ F(df, d0), are what they are; its gradient and Hessian.

    sums has for each df the sums over its events of the weights w, w log s, w log(1 + q), w q / (1 + q) and
    w q / (1 + q)^2, where q = df s / (d0 s0).
    """
    d = math.exp(log_d0)
    ll, g, h = 0.0, np.zeros(2), np.zeros((2, 2))
    for df, x in sums.items():
        w, both = x["w"], (df + d) / 2
        psi = float(sp.digamma(both)) - float(sp.digamma(d / 2))
        tri = float(sp.trigamma(both)) - float(sp.trigamma(d / 2))
        ll += w * (math.lgamma(both) - math.lgamma(d / 2) - math.lgamma(df / 2) + df / 2 * (math.log(df) - log_d0 - log_s0)) + (df / 2 - 1) * x["ls"] - both * x["l"]
        g += [both * x["u"] - df / 2 * w, d / 2 * psi * w - df / 2 * w - d / 2 * x["l"] + both * x["u"]]
        h += [[-both * x["v"], d / 2 * x["u"] - both * x["v"]], [d / 2 * x["u"] - both * x["v"], (d / 2 * psi + d * d / 4 * tri) * w - d / 2 * x["l"] + d * x["u"] - both * x["v"]]]
    return ll, g, h


def dispersion_prior(fits: DataFrame, s2: str = "s2", df: str = "df", weight: str = "weight", most: float = 1e6) -> tuple[float, float]:
    """(s0, d0) that maximise the weighted marginal likelihood of all events' residual dispersions.

    Newton steps; each works out the sums of `marginal` in one aggregate, with a row for each number of degrees of freedom.
    Dispersions of zero and events without degrees of freedom say nothing. d0 is sought up to `most`; beyond a tenth of it, it is infinity: no spread is left.
    """
    rows = settle(fits.where((F.col(s2) > 1e-12) & (F.col(df) > 0)).select(F.col(s2).alias("s"), F.col(df).cast("int").alias("df"), F.col(weight).cast("double").alias("w")))

    def at(a: float, b: float) -> dict[int, dict[str, float]]:
        q = F.col("df") * F.col("s") * math.exp(-a - b)
        cols = {"w": F.col("w"), "ls": F.col("w") * F.ln("s"), "l": F.col("w") * F.log1p(q), "u": F.col("w") * q / (1 + q), "v": F.col("w") * q / (1 + q) / (1 + q)}
        return {r["df"]: {k: r[k] for k in cols} for r in rows.groupBy("df").agg(*[F.sum(e).alias(k) for k, e in cols.items()]).collect()}

    start = rows.agg(F.sum("w").alias("w"), F.avg(F.ln("s")).alias("m")).first()
    if not start["w"]:
        return 1.0, math.inf
    now = np.array([start["m"], math.log(4.0)])
    ll, g, h = marginal(at(*now), *now)
    for _ in range(60):
        curve = np.linalg.eigvalsh(h)
        step = np.linalg.solve(h, -g) if curve.max() < 0 else g / max(1.0, np.abs(h).max())
        step *= min(1.0, 2 / max(np.abs(step).max(), 1e-300))
        while True:
            new = now + step
            new[1] = min(new[1], math.log(2 * most))
            found = marginal(at(*new), *new)
            if found[0] >= ll - 1e-12 * abs(ll) or np.abs(step).max() < 1e-9:
                break
            step /= 4
        moved, now, (ll, g, h) = np.abs(new - now).max(), new, found
        if moved < 1e-9 or now[1] >= math.log(most):
            break
    if now[1] < math.log(most / 10):
        return math.exp(now[0]), math.exp(now[1])
    # One dispersion for all: the maximum is their weighted mean.
    return rows.agg(F.sum(F.col("w") * F.col("df") * F.col("s")) / F.sum(F.col("w") * F.col("df"))).first()[0], math.inf
