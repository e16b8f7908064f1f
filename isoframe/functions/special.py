"""Special functions and distributions on numpy arrays, from their series and continued fractions."""

from __future__ import annotations

import math

import numpy as np

lgamma = np.vectorize(math.lgamma, otypes=[float])


def _array(*x):
    return np.broadcast_arrays(*[np.asarray(v, float) for v in x])


def betainc(a, b, x):
    """Regularised incomplete beta function by Lentz's continued fraction."""
    a, b, x = _array(a, b, x)
    x = np.clip(x, 0.0, 1.0)
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
        tiny = 1e-300
        c = np.ones_like(y)
        d = 1 - (p + q) * y / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 400):
            for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                step = c * d
                h = h * step
            if np.all(np.abs(step - 1) < 1e-14):
                break
    out = np.where(y <= 0, 0.0, front * h)
    return np.where(flip, 1 - out, out)


def t_sf2(t, df):
    """Two-sided tail of Student's t."""
    t, df = _array(t, df)
    p = betainc(np.where(np.isfinite(df), df, 1.0) / 2, 0.5, np.where(np.isfinite(df), df / (df + t * t), 0.5))
    return np.where(np.isfinite(df), p, 2 * normal_sf(np.abs(t)))


def f_sf(f, d1, d2):
    """Upper tail of the F distribution."""
    f, d1, d2 = _array(f, d1, d2)
    f = np.maximum(f, 0)
    finite = np.isfinite(d2)
    e = np.where(finite, d2, 1.0)
    return np.where(finite, betainc(e / 2, d1 / 2, e / (e + d1 * f)), chi2_sf(d1 * f, d1))


def normal_sf(x):
    x = np.asarray(x, float)
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(x / math.sqrt(2))


def chi2_sf(x, df):
    """Upper tail of chi-squared, by the series or the continued fraction of the incomplete gamma function."""
    x, df = _array(x, df)
    return np.vectorize(_gamma_q, otypes=[float])(df / 2, np.maximum(x, 0) / 2)


def _gamma_q(a: float, x: float) -> float:
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, front * h)


def t_quantile(p: float, df: float) -> float:
    """Upper quantile t with P(T <= t) = p, by bisection."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - float(t_sf2(mid, df)) / 2 < p else (lo, mid)
    return (lo + hi) / 2


def t_isf2(p, df: float):
    """The t whose two-sided tail is p, by bisection on its logarithm."""
    p = np.asarray(p, float)
    lo, hi = np.full(p.shape, -30.0), np.full(p.shape, 30.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        above = t_sf2(np.exp(mid), df) > p
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return np.exp((lo + hi) / 2)


def hypergeometric_sf(k: int, universe: int, marked: int, drawn: int) -> float:
    """P(X >= k) of marked ones among drawn."""
    choose = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
    whole = choose(universe, drawn)
    low = max(0, drawn - (universe - marked))
    if k <= low:
        return 1.0
    terms = [choose(marked, i) + choose(universe - marked, drawn - i) - whole for i in range(k, min(marked, drawn) + 1)]
    return min(1.0, math.fsum(map(math.exp, terms)))


def hypergeometric_tail(k, universe, marked, drawn, at_once: int = 1 << 20) -> np.ndarray:
    """P(X >= k) of marked ones among drawn, for arrays: all terms at once, up to at_once of them."""
    k, universe, marked, drawn = (np.asarray(v, np.int64) for v in (k, universe, marked, drawn))
    out = np.ones(len(k))
    if not len(k):
        return out
    logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, int(universe.max()) + 1)))))  # of factorials
    choose = lambda n, r: logs[n] - logs[r] - logs[n - r]
    open_ = np.nonzero(k > np.maximum(0, drawn - (universe - marked)))[0]
    terms = np.maximum(np.minimum(marked, drawn)[open_] - k[open_] + 1, 0)
    out[open_] = 0.0
    for part in np.split(np.arange(len(open_)), np.nonzero(np.diff(np.cumsum(terms) // at_once))[0] + 1):
        row = np.repeat(open_[part], terms[part])
        i = k[row] + np.arange(len(row)) - np.repeat(np.cumsum(terms[part]) - terms[part], terms[part])
        p = np.exp(choose(marked[row], i) + choose(universe[row] - marked[row], drawn[row] - i) - choose(universe[row], drawn[row]))
        np.add.at(out, row, p)
    return np.minimum(out, 1.0)


def digamma(x):
    x = np.array(x, float)
    out = np.zeros_like(x)
    while np.any(x < 8):
        out = np.where(x < 8, out - 1 / np.where(x < 8, x, 1), out)
        x = np.where(x < 8, x + 1, x)
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def trigamma(x):
    x = np.array(x, float)
    out = np.zeros_like(x)
    while np.any(x < 8):
        out = np.where(x < 8, out + 1 / np.where(x < 8, x, 1) ** 2, out)
        x = np.where(x < 8, x + 1, x)
    i = 1 / (x * x)
    return out + 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i / 30)))


def trigamma_inverse(y: float) -> float:
    lo, hi = 1e-8, 1e8
    for _ in range(300):
        mid = math.sqrt(lo * hi)
        lo, hi = (mid, hi) if float(trigamma(mid)) > y else (lo, mid)
    return math.sqrt(lo * hi)


def benjamini_hochberg(p: np.ndarray) -> np.ndarray:
    """Adjusted p-values; nan stays nan."""
    p = np.asarray(p, float)
    out = np.full(p.shape, np.nan)
    ok = np.nonzero(~np.isnan(p))[0]
    order = ok[np.argsort(-p[ok], kind="stable")]
    out[order] = np.minimum(1, np.minimum.accumulate(p[order] * len(ok) / np.arange(len(ok), 0, -1)))
    return out
