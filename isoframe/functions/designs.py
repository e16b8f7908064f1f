"""Design matrices: a small formula language, contrasts, and natural splines. All are of the number of samples."""

from __future__ import annotations

import numpy as np


def spline_basis(x: np.ndarray, df: int) -> np.ndarray:
    """A natural cubic spline basis with df columns, knots at quantiles; linear beyond the ends. df is cut to distinct values - 1."""
    x = np.asarray(x, float)
    df = max(1, min(df, len(np.unique(x)) - 1))
    knots = np.quantile(x, np.linspace(0, 1, df + 1))
    if df == 1:
        return ((x - knots[0]) / max(knots[-1] - knots[0], 1e-12))[:, None]
    width = max(knots[-1] - knots[0], 1e-12)
    u, k = (x - knots[0]) / width, (knots - knots[0]) / width
    cube = lambda t: np.maximum(u - t, 0) ** 3
    d = lambda j: (cube(k[j]) - cube(k[-1])) / max(k[-1] - k[j], 1e-12)
    last = d(len(k) - 2)
    return np.column_stack([u, *[d(j) - last for j in range(len(k) - 2)]])


def levels(values: list) -> list:
    return sorted(set(values), key=str)


def _columns(name: str, values: list, drop_first: bool) -> tuple[list[str], np.ndarray]:
    if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
        return [name], np.array(values, float)[:, None]
    kinds = levels(values)[1 if drop_first else 0 :]
    return [f"{name}{k}" for k in kinds], np.array([[float(v == k) for k in kinds] for v in values]).reshape(len(values), -1)


def design(formula: str, data: dict[str, list]) -> tuple[list[str], np.ndarray]:
    """Names and matrix of '~ 1 + a + b + a:b' (or '~ 0 + ...'). Strings are factors against their first level, numbers covariates."""
    terms = [t.strip() for t in formula.lstrip("~ ").split("+") if t.strip()]
    intercept = "0" not in terms
    terms = [t for t in terms if t not in ("0", "1")]
    n = len(next(iter(data.values())))
    names, parts = (["(Intercept)"], [np.ones((n, 1))]) if intercept else ([], [])
    first = not intercept
    for t in terms:
        pieces = [_columns(v.strip(), data[v.strip()], not first or i > 0) for i, v in enumerate(t.split(":"))]
        if ":" in t:
            pieces = [_columns(v.strip(), data[v.strip()], True) for v in t.split(":")]
        own, m = pieces[0]
        for more, x in pieces[1:]:
            own, m = [f"{a}:{b}" for a in own for b in more], np.column_stack([m[:, i] * x[:, j] for i in range(m.shape[1]) for j in range(x.shape[1])])
        first = False
        names += own
        parts.append(m)
    return independent(names, np.column_stack(parts))


def independent(names: list[str], x: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Without columns that those before them span."""
    keep: list[int] = []
    for j in range(x.shape[1]):
        if np.linalg.matrix_rank(x[:, [*keep, j]]) > len(keep):
            keep.append(j)
    return [names[j] for j in keep], x[:, keep]


def contrast(names: list[str], plus: list[str], minus: list[str] = ()) -> np.ndarray:
    """Weights +1 and -1 on named columns; names that the design lacks (reference levels) count nothing."""
    return np.array([float(n in plus) - float(n in minus) for n in names])
