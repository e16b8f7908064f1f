"""Differential splicing: per-event models over samples, with the global steps as small aggregates.

Counts are long: event_name, sample, included, excluded. Events are dealt to groups by a hash, so that one Arrow batch is
a matrix of many events; every fit is vectorised over them. What passes through the driver is of the number of samples,
or a handful of hyperparameters. The engines follow published methods (moderated t, negative-binomial quasi-likelihood
and Wald tests with dispersions shrunken to a trend, double-exponential tests of ratios with a marginal-likelihood prior) and
do not claim identity with any package.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from isoframe.functions import designs as dg
from isoframe.functions import special as sp
from isoframe.operators import dispersion as dp
from isoframe.operators import shrinkage as sh
from isoframe.operators.dispersion import nb_deviance, nb_fit, nb_profile
from isoframe.sources.store import settle

EVENTS_IN_GROUP = 512
#: Events whose included or excluded mean log2 count is at most this above the least of all say nothing of a ratio.
FLOOR = 1.0


def select_events(events: DataFrame, ir_mode: str = "all", drop_anti: tuple[str, ...] = ("anti-over",)) -> DataFrame:
    """Events to test. ir_mode: all (no RI), annotated (no RI, annotated IR only), annotated_binary (no IR)."""
    keep = F.lit(True)
    for name in drop_anti:
        keep = keep & ~F.col("event_name").contains(name)
    if ir_mode == "all":
        keep = keep & (F.col("event_type") != "RI")
    elif ir_mode == "annotated":
        keep = keep & (F.col("event_type") != "RI") & ((F.col("event_type") != "IR") | F.coalesce("is_annotated_ir", F.lit(False)))
    elif ir_mode == "annotated_binary":
        keep = keep & (F.col("event_type") != "IR")
    else:
        raise ValueError("ir_mode is all, annotated or annotated_binary")
    return events.where(keep)


def adjust(df: DataFrame, p: str = "p_value", name: str = "fdr") -> DataFrame:
    """Benjamini-Hochberg adjustment of a column; nulls stay null and do not count.

    Distinct p-values are dealt to ranges. Ranks and running minima are worked out within a range; what the other ranges
    add is one number for each range.
    """
    distinct = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_k"))
    dealt = settle(distinct.repartitionByRange("_p").withColumn("_range", F.spark_partition_id()))
    ranges = Window.orderBy("_range")
    sums = dealt.groupBy("_range").agg(F.sum("_k").alias("_s"))
    sums = sums.select("_range", (F.sum("_s").over(ranges.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")).alias("_before"), F.sum("_s").over(Window.partitionBy()).alias("_m"))
    inside = Window.partitionBy("_range").orderBy("_p")
    # A running frame from the other end: Spark works out a frame that ends with the partition anew for each row.
    down = Window.partitionBy("_range").orderBy(F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rank = F.col("_before") + F.sum("_k").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ranked = dealt.join(sums, "_range").withColumn("_q", F.col("_p") * F.col("_m") / rank)
    ranked = settle(ranked.select("_p", "_range", F.min("_q").over(down).alias("_q")))
    least = ranked.groupBy("_range").agg(F.min("_q").alias("_l"))
    after = least.select("_range", F.min("_l").over(ranges.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    done = ranked.join(after, "_range").select("_p", F.least(F.lit(1.0), "_q", F.coalesce("_after", F.lit(1.0))).alias(name))
    return df.join(done, F.col(p) == F.col("_p"), "left").drop("_p")


def _matrix(counts: DataFrame, samples: Sequence[str]) -> DataFrame:
    """One row for each event with arrays of included and excluded counts in the order of samples."""
    number = F.create_map(*[x for i, s in enumerate(samples) for x in (F.lit(s), F.lit(i))])
    rows = counts.where(F.col("sample").isin(*samples)).select("event_name", number[F.col("sample")].alias("i"), F.coalesce("included", F.lit(0.0)).alias("inc"), F.coalesce("excluded", F.lit(0.0)).alias("exc"))
    packed = rows.groupBy("event_name").agg(F.sort_array(F.collect_list(F.struct("i", "inc", "exc"))).alias("x")).where(F.size("x") == len(samples))
    return packed.select("event_name", F.transform("x", lambda v: v["inc"]).alias("inc"), F.transform("x", lambda v: v["exc"]).alias("exc"))


def _by_group(matrix: DataFrame, fit, schema: str) -> DataFrame:
    """fit(inc, exc, ...) -> columns, over groups of about EVENTS_IN_GROUP events; further array columns are further arguments."""
    n = max(1, math.ceil(matrix.count() / EVENTS_IN_GROUP))
    columns = [c for c in matrix.columns if c != "event_name"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("event_name")
        out = fit(*[np.stack(rows[c].to_list()) for c in columns])
        return pd.DataFrame({"event_name": rows["event_name"].to_numpy(), **out})

    return matrix.withColumn("_g", F.pmod(F.xxhash64("event_name"), F.lit(n))).groupBy("_g").applyInPandas(run, f"event_name string, {schema}")


def library_sizes(counts: DataFrame, samples: Sequence[str]) -> np.ndarray:
    found = {r["sample"]: r["n"] for r in counts.groupBy("sample").agg(F.sum(F.col("included") + F.col("excluded")).alias("n")).collect()}
    return np.array([found.get(s) or 1.0 for s in samples], float)


def tmm_factors(counts: DataFrame, samples: Sequence[str], sizes: np.ndarray, trim_m: float = 0.3, trim_a: float = 0.05) -> np.ndarray:
    """Trimmed means of log ratios against the sample of the most typical upper quartile."""
    long = counts.where(F.col("sample").isin(*samples)).select("event_name", "sample", F.explode(F.array(F.struct(F.lit("i").alias("k"), F.col("included").alias("y")), F.struct(F.lit("e").alias("k"), F.col("excluded").alias("y")))).alias("v")).select("event_name", "v.k", "sample", "v.y")
    size = F.create_map(*[x for s, n in zip(samples, sizes, strict=True) for x in (F.lit(s), F.lit(float(n)))])
    long = long.withColumn("n", size[F.col("sample")])
    q = {r["sample"]: r["q"] for r in long.where("y > 0").groupBy("sample").agg(F.percentile_approx(F.col("y") / F.col("n"), 0.75, 10000).alias("q")).collect()}
    mean = float(np.mean(list(q.values())))
    ref = min(samples, key=lambda s: (abs(q.get(s, 0.0) - mean), s))
    r = long.where(F.col("sample") == ref).select("event_name", "k", F.col("y").alias("yr"), F.col("n").alias("nr"))
    pairs = long.join(r, ["event_name", "k"]).where("y > 0 and yr > 0")
    pairs = pairs.withColumns({"m": F.log2((F.col("y") / F.col("n")) / (F.col("yr") / F.col("nr"))), "a": F.log2((F.col("y") / F.col("n")) * (F.col("yr") / F.col("nr"))) / 2, "v": (F.col("n") - F.col("y")) / (F.col("n") * F.col("y")) + (F.col("nr") - F.col("yr")) / (F.col("nr") * F.col("yr"))})
    cut = pairs.groupBy("sample").agg(*[F.percentile_approx(c, [lo, 1 - lo], 10000).alias(f"q{c}") for c, lo in (("m", trim_m), ("a", trim_a))])
    kept = pairs.join(F.broadcast(cut), "sample").where((F.col("m") >= F.col("qm")[0]) & (F.col("m") <= F.col("qm")[1]) & (F.col("a") >= F.col("qa")[0]) & (F.col("a") <= F.col("qa")[1]))
    f = {x["sample"]: x["f"] for x in kept.groupBy("sample").agg((F.sum(F.col("m") / F.greatest("v", F.lit(1e-12))) / F.sum(1 / F.greatest("v", F.lit(1e-12)))).alias("f")).collect()}
    out = np.array([2.0 ** (f.get(s) or 0.0) for s in samples])
    return out / np.exp(np.mean(np.log(out)))


def size_factors(counts: DataFrame, samples: Sequence[str]) -> np.ndarray:
    """Medians of ratios to the geometric mean of each event's counts."""
    y = F.col("included") + F.col("excluded")
    rows = counts.where(F.col("sample").isin(*samples)).select("event_name", "sample", F.ln(y).alias("l"), (y > 0).alias("ok")).withColumns({"g": F.avg("l").over(Window.partitionBy("event_name")), "all": F.min("ok").over(Window.partitionBy("event_name"))})
    f = {r["sample"]: r["f"] for r in rows.where("all").groupBy("sample").agg(F.exp(F.percentile_approx(F.col("l") - F.col("g"), 0.5, 10000)).alias("f")).collect()}
    return np.array([f.get(s) or 1.0 for s in samples])


# --- designs -------------------------------------------------------------------------------------------------------


def check_design(samples: dict[str, list], factor: str, nominator: str | None, denominator: str | None, batches: Sequence[str] = ()) -> None:
    """Raise unless the factor and the batches are columns, all different, and the levels named are different ones of the factor."""
    named = [factor, *batches]
    if missing := [c for c in named if c not in samples]:
        raise ValueError(f"the samples have no columns {missing}")
    if len(set(named)) < len(named):
        raise ValueError(f"the factor and the batches must differ: {named}")
    if bool(nominator) != bool(denominator) or nominator and nominator == denominator:
        raise ValueError("nominator and denominator are two different levels, or both left out")
    if missing := [level for level in (nominator, denominator) if level and level not in samples[factor]]:
        raise ValueError(f"{factor} has no levels {missing}")


def count_design(samples: dict[str, list], factor: str, nominator: str | None, denominator: str | None, batches: Sequence[str] = (), degrees: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Design over samples and contrast rows: nominator against denominator, all levels, or the spline of a numeric factor."""
    check_design(samples, factor, nominator, denominator, batches)
    data = dict(samples)
    base = "~ 1" + "".join(f" + {b}" for b in batches)
    if degrees is not None:
        basis = dg.spline_basis(np.array(samples[factor], float), degrees)
        names, x = dg.design(base, data)
        wide = [f"s{j}" for j in range(basis.shape[1])]
        all_names, full = dg.independent(names + wide, np.column_stack([x, basis]))
        return full, np.array([[float(n == w) for n in all_names] for w in wide if w in all_names])
    names, x = dg.design(f"{base} + {factor}", data)
    if nominator and denominator:
        return x, dg.contrast(names, [f"{factor}{nominator}"], [f"{factor}{denominator}"])[None, :]
    return x, np.array([[float(n == m) for n in names] for m in names if m.startswith(factor)])


def ratio_design(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The design for included and excluded columns together: each sample's own mean cancels what both share, and the contrast
    tests how the factor moves included against excluded."""
    n = len(x)
    own = np.vstack([np.eye(n), np.eye(n)])
    moved = np.vstack([x, np.zeros_like(x)])
    return np.column_stack([own, moved]), np.column_stack([np.zeros((len(c), n)), c])


# --- linear models ---------------------------------------------------------------------------------------------------


def ols(y: np.ndarray, x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For rows y: contrast estimates, residual variances, the contrasts' unscaled covariance, residual degrees."""
    pinv = np.linalg.pinv(x)
    beta = y @ pinv.T
    rank = np.linalg.matrix_rank(x)
    df = len(x) - rank
    rss = ((y - beta @ x.T) ** 2).sum(axis=1)
    return beta @ c.T, rss / max(df, 1), c @ pinv @ pinv.T @ c.T, df


def moderation(fits: DataFrame, df: int) -> tuple[float, float]:
    """Prior variance and its degrees from the spread of log variances over all events; variances of next to nothing, which would
    swamp it, count as 1e-5 of the median."""
    middle = fits.agg(F.percentile_approx("s2", 0.5, 100000)).first()[0]
    floored = fits.select(F.greatest("s2", F.lit(1e-5 * (middle or 0.0))).alias("s2"))
    r = floored.where("s2 > 1e-15").agg(F.avg(F.ln("s2")).alias("m"), F.var_samp(F.ln("s2")).alias("v")).first()
    if r["m"] is None:
        return 1.0, float("inf")
    e = r["m"] - float(sp.digamma(df / 2)) + math.log(df / 2)
    extra = (r["v"] or 0.0) - float(sp.trigamma(df / 2))
    if extra <= 0:
        return math.exp(e), float("inf")
    d0 = 2 * sp.trigamma_inverse(extra)
    return math.exp(e + float(sp.digamma(d0 / 2)) - math.log(d0 / 2)), d0


def _ordered(df: DataFrame, by: Column, ordered: bool) -> DataFrame:
    return df.orderBy(by, "event_name") if ordered else df


def limma_test(counts: DataFrame, samples: dict[str, list], factor: str, nominator: str | None = None, denominator: str | None = None, batches: Sequence[str] = (), degrees: int | None = None, floor: float = FLOOR, ordered: bool = True) -> DataFrame:
    """Moderated t (or F) tests of log counts per million for included, excluded, and their ratio.

    Returns event_name, log_fc, ave_expr, statistic, p_value, fdr, b, log_fc_inc, log_fc_exc, by falling b (log-odds that the
    effect is not null), or by p where there are several contrasts and hence no b. Mean log counts are measured from the least
    of all events, included and excluded; events of which one is not more than `floor` above it are left out.
    """
    names = samples["sample"]
    x, c = count_design(samples, factor, nominator, denominator, batches, degrees)
    rx, rc = ratio_design(x, c)
    sizes = library_sizes(counts, names)
    k = len(c)

    def fit(inc: np.ndarray, exc: np.ndarray) -> dict:
        cpm = lambda y: np.log2((y + 0.5) / (sizes + 1) * 1e6)
        raw = lambda y: np.log2(y + 0.5)
        bi, *_ = ols(cpm(inc), x, c)
        be, *_ = ols(cpm(exc), x, c)
        br, s2, cov, _ = ols(np.column_stack([raw(inc), raw(exc)]), rx, rc)
        inv = np.linalg.pinv(cov)
        ai, ae = cpm(inc).mean(axis=1), cpm(exc).mean(axis=1)
        return {"log_fc": br[:, 0], "q": np.einsum("ij,jk,ik->i", br, inv, br), "s2": s2, "ave_expr": (ai + ae) / 2, "log_fc_inc": bi[:, 0], "log_fc_exc": be[:, 0], "low": np.minimum(ai, ae)}

    everything = settle(_by_group(settle(_matrix(counts, names)), fit, "log_fc double, q double, s2 double, ave_expr double, log_fc_inc double, log_fc_exc double, low double"))
    least = everything.agg(F.min("low")).first()[0]
    fits = everything.where(F.col("low") - F.lit(least or 0.0) > floor)
    n = fits.count()
    df = len(rx) - int(np.linalg.matrix_rank(rx))
    s0, d0 = moderation(fits, df)
    total = min(d0 + df, float(max(n, 1) * df))

    @F.pandas_udf(DoubleType())
    def tail(f: pd.Series) -> pd.Series:
        return pd.Series(sp.f_sf(f.to_numpy(), k, total))

    post = F.col("s2") if not df else (F.lit(s0) if math.isinf(d0) else (d0 * s0 + df * F.col("s2")) / (d0 + df))
    out = fits.withColumn("_f", F.col("q") / k / post)
    out = out.withColumns({"statistic": F.signum("log_fc") * F.sqrt("_f") if k == 1 else F.col("_f"), "p_value": tail("_f")})
    b = F.lit(None).cast("double")
    if k == 1 and n:
        _, _, cov, _ = ols(np.zeros((1, len(rx))), rx, rc)
        b = sh.log_odds(out, "statistic", n, float(cov[0, 0]), s0, d0, total)
    done = adjust(out.select("event_name", "log_fc", "ave_expr", "statistic", "p_value", b.alias("b"), "log_fc_inc", "log_fc_exc"))
    return _ordered(done, F.col("b").desc() if k == 1 else F.col("p_value"), ordered)


# --- negative-binomial models ----------------------------------------------------------------------------------------


def _null(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The design under which the contrasts are zero."""
    _, s, vt = np.linalg.svd(c)
    rank = int((s > 1e-10).sum())
    return x @ vt[rank:].T


def nb_test(counts: DataFrame, samples: dict[str, list], x: np.ndarray, c: np.ndarray, test: str = "qlf", normalise: str = "tmm", trend: str = "local", ordered: bool = True) -> DataFrame:
    """Included, excluded and ratio tests by NB log-linear models whose dispersions follow a trend over abundance.

    test: qlf (quasi-likelihood F, at the trend), lrt (likelihood ratio) or wald (both at dispersions shrunken to it).
    normalise: tmm, ratio (medians of ratios), none. trend: local (smoothed profiles; the events' weight against it comes from
    the spread of their deviances) or parametric (a0 + a1 / mean with a log-normal prior).
    """
    names = samples["sample"]
    sizes = library_sizes(counts, names)
    scale = {"tmm": lambda: sizes * tmm_factors(counts, names, sizes), "ratio": lambda: size_factors(counts, names), "none": lambda: np.ones(len(names))}[normalise]()
    scale = scale / np.exp(np.mean(np.log(scale)))
    rx, rc = ratio_design(x, c)
    views = {
        "inc": (lambda inc, exc: inc, x, c, scale),
        "exc": (lambda inc, exc: exc, x, c, scale),
        "ratio": (lambda inc, exc: np.column_stack([inc, exc]), rx, rc, np.ones(2 * len(names))),
    }
    used = {k: v for k, v in views.items() if k == "ratio" or len(x) > np.linalg.matrix_rank(x)}
    free = {k: max(len(d) - int(np.linalg.matrix_rank(d)), 1) for k, (_, d, _, _) in used.items()}

    def profiles(inc: np.ndarray, exc: np.ndarray) -> dict:
        out: dict = {"inc": list(inc), "exc": list(exc)}
        for k, (pick, d, _, o) in used.items():
            y = pick(inc, exc)
            grid = nb_profile(y, d, np.log(o))
            out |= {f"grid_{k}": list(grid), f"a_{k}": dp.abundance(y, o), f"mean_{k}": (y / o).mean(axis=1), f"own_{k}": np.exp(dp.peak(grid))}
        return out

    columns = ", ".join(f"grid_{k} array<double>, a_{k} double, mean_{k} double, own_{k} double" for k in used)
    known = settle(_by_group(settle(_matrix(counts, names)), profiles, f"inc array<double>, exc array<double>, {columns}"))

    def at(phi_of, more: bool):
        """Fits of all views at the dispersions phi_of(view, profile, a, mean); the null models too, if more."""

        def fit(inc: np.ndarray, exc: np.ndarray, *facts: np.ndarray) -> dict:
            out: dict = {}
            for j, (k, (pick, d, con, o)) in enumerate(used.items()):
                y, (grid, a, mean, _) = pick(inc, exc), facts[4 * j : 4 * j + 4]
                phi = phi_of(k, grid, a, mean)
                beta, mu = nb_fit(y, d, np.log(o), phi)
                dev = nb_deviance(y, mu, phi)
                out |= {f"s2_{k}": np.maximum(dev, 1e-12) / free[k]}
                if more:
                    _, mu0 = nb_fit(y, _null(d, con), np.log(o), phi)
                    cov = np.linalg.pinv(np.einsum("en,np,nq->epq", mu / (1 + phi[:, None] * mu), d, d))
                    est = beta @ con.T
                    se = np.sqrt(np.maximum(np.einsum("kp,epq,kq->ek", con, cov, con), 1e-30))
                    out |= {f"fc_{k}": est[:, 0] / math.log(2), f"lr_{k}": np.maximum(nb_deviance(y, mu0, phi) - dev, 0), f"z_{k}": est[:, 0] / se[:, 0], f"phi_{k}": phi}
            return out

        names = ("s2", "fc", "lr", "z", "phi") if more else ("s2",)
        return settle(_by_group(known, fit, ", ".join(f"{n}_{k} double" for k in used for n in names)))

    if trend == "parametric":
        curves = {k: dp.parametric_trend(known.select(F.col(f"mean_{k}").alias("mean"), F.col(f"own_{k}").alias("own")), free[k]) for k in used}
        fits = at(lambda k, grid, a, mean: curves[k].shrink(grid, mean), True)
    else:
        local = {k: dp.local_trend(known, f"grid_{k}", f"a_{k}") for k in used}
        if test == "qlf":
            fits = at(lambda k, grid, a, mean: local[k].dispersions(a), True)
        else:
            spread = at(lambda k, grid, a, mean: local[k].dispersions(a), False)
            prior = {k: min(moderation(spread.withColumn("s2", F.col(f"s2_{k}")), free[k])[1] / free[k], 1e4) for k in used}
            fits = at(lambda k, grid, a, mean: np.exp(dp.peak(grid + prior[k] * local[k].at(a))), True)
    k = len(c)
    df = free["ratio"]
    s0, d0 = moderation(fits.withColumn("s2", F.col("s2_ratio")), df) if test == "qlf" else (1.0, 0.0)

    @F.pandas_udf(DoubleType())
    def tail(lr: pd.Series, z: pd.Series, s2: pd.Series) -> pd.Series:
        if test == "wald" and k == 1:
            return pd.Series(2 * sp.normal_sf(np.abs(z.to_numpy())))
        if test == "qlf":
            post = np.full(len(s2), s0) if math.isinf(d0) else (d0 * s0 + df * s2.to_numpy()) / (d0 + df)
            return pd.Series(sp.f_sf(lr.to_numpy() / k / post, k, d0 + df))
        return pd.Series(sp.chi2_sf(lr.to_numpy(), k))

    out = fits.select("event_name", F.col("fc_ratio").alias("log_fc"), F.col("lr_ratio").alias("statistic"), F.col("phi_ratio").alias("dispersion"), tail("lr_ratio", "z_ratio", "s2_ratio").alias("p_value"), *[F.col(f"fc_{v}").alias(f"log_fc_{v}") for v in used if v != "ratio"])
    return _ordered(adjust(out), F.col("p_value"), ordered)


def edger_test(counts: DataFrame, samples: dict[str, list], factor: str, nominator: str | None = None, denominator: str | None = None, batches: Sequence[str] = (), degrees: int | None = None, quasi: bool = True, ordered: bool = True) -> DataFrame:
    """Quasi-likelihood F or likelihood-ratio tests, TMM-normalised, dispersions by a smoothed trend."""
    return nb_test(counts, samples, *count_design(samples, factor, nominator, denominator, batches, degrees), test="qlf" if quasi else "lrt", normalise="tmm", ordered=ordered)


def edger_custom(counts: DataFrame, samples: dict[str, list], full: str, reduced: str | None = None, contrast: dict[str, float] | None = None, quasi: bool = True) -> DataFrame:
    """Tests of a formula against a smaller one, or of a contrast given by column names."""
    names, x = dg.design(full, samples)
    if contrast is not None:
        if unknown := set(contrast) - set(names):
            raise ValueError(f"the design has no columns {sorted(unknown)}; it has {names}")
        c = np.array([[contrast.get(n, 0.0) for n in names]])
    else:
        small, _ = dg.design(reduced or "~ 1", samples)
        c = np.array([[float(n == m) for n in names] for m in names if m not in small])
    return nb_test(counts, samples, x, c, test="qlf" if quasi else "lrt", normalise="tmm")


def deseq_test(counts: DataFrame, samples: dict[str, list], factor: str, nominator: str | None = None, denominator: str | None = None, batches: Sequence[str] = (), degrees: int | None = None, ordered: bool = True) -> DataFrame:
    """Wald tests of two levels, or likelihood ratios of all levels where none are named; medians-of-ratios normalised, dispersions by a
    parametric trend."""
    two = bool(nominator and denominator)
    return nb_test(counts, samples, *count_design(samples, factor, nominator, denominator, batches, degrees), test="wald" if two else "lrt", normalise="ratio", trend="parametric", ordered=ordered).where("p_value is not null")


def double_exponential_test(counts: DataFrame, samples: dict[str, list], factor: str, nominator: str, denominator: str, ordered: bool = True) -> DataFrame:
    """Tests of two levels' inclusion ratios in the double-exponential binomial family; pseudocount 1 on both sides.

    An event's dispersion is its residual deviance over its degrees of freedom. The prior of dispersions maximises their marginal
    likelihood over all events; an event weighs by the share of samples in which it has reads, and samples without reads give
    no degrees of freedom. Tests are F tests at the posterior dispersions.

    Returns event_name, psi_nominator, psi_denominator, mle_log_fc (difference of logits over ln 2), dispersion (posterior),
    p_value, fdr.
    """
    use = [i for i, v in enumerate(samples[factor]) if v in (nominator, denominator)]
    names = [samples["sample"][i] for i in use]
    group = np.array([samples[factor][i] == nominator for i in use])

    def fit(inc: np.ndarray, exc: np.ndarray) -> dict:
        y, m = inc + 1, inc + exc + 2
        seen = (inc + exc > 0).sum(axis=1)
        df = np.maximum(seen - 2, 0)
        p = [(y[:, g].sum(axis=1) / m[:, g].sum(axis=1)) for g in (group, ~group)]
        p0 = y.sum(axis=1) / m.sum(axis=1)

        def deviance(q: np.ndarray) -> np.ndarray:
            return 2 * (y * np.log(y / (m * q)) + (m - y) * np.log((m - y) / (m * (1 - q)))).sum(axis=1)

        full = deviance(np.where(group[None, :], p[0][:, None], p[1][:, None]))
        logit = lambda q: np.log(q / (1 - q))
        return {"psi_nominator": p[0], "psi_denominator": p[1], "mle_log_fc": (logit(p[0]) - logit(p[1])) / math.log(2), "s2": np.maximum(full, 0) / np.maximum(df, 1), "lr": np.maximum(deviance(p0[:, None] * np.ones_like(y)) - full, 0), "df": df.astype(np.int32), "weight": seen / len(names)}

    fits = settle(_by_group(settle(_matrix(counts, names)), fit, "psi_nominator double, psi_denominator double, mle_log_fc double, s2 double, lr double, df int, weight double"))
    s0, d0 = sh.dispersion_prior(fits)
    post = F.lit(s0) if math.isinf(d0) else (d0 * s0 + F.col("df") * F.col("s2")) / (d0 + F.col("df"))

    @F.pandas_udf(DoubleType())
    def tail(f: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(sp.f_sf(f.to_numpy(), 1, d0 + df.to_numpy()))

    out = fits.withColumn("dispersion", post).select("event_name", "psi_nominator", "psi_denominator", "mle_log_fc", "dispersion", tail(F.col("lr") / F.col("dispersion"), F.col("df")).alias("p_value"))
    return _ordered(adjust(out), F.col("p_value"), ordered)


# --- results ---------------------------------------------------------------------------------------------------------


def add_flags(results: DataFrame, events: DataFrame) -> DataFrame:
    """A column flags: Inc-NMD, Exc-NMD, Inc-novel, Exc-novel, joined by ';'."""
    flag = lambda c, text: F.when(F.coalesce(c, F.lit(False)), text)
    made = [flag(F.col("inc_is_nmd"), "Inc-NMD"), flag(F.col("exc_is_nmd"), "Exc-NMD"), flag(F.col("inc_tsl") == "Novel", "Inc-novel"), flag(F.col("exc_tsl") == "Novel", "Exc-novel")]
    return results.join(events.select("event_name", F.array_join(F.array_compact(F.array(*made)), ";").alias("flags")), "event_name", "left")


def add_psi(results: DataFrame, assays: DataFrame, samples: DataFrame, condition: str, nominator: str | None = None, denominator: str | None = None, most_levels: int = 6) -> DataFrame:
    """Mean ratios of each level (avg_psi_*), and delta_psi and abs_delta_psi of two, rounded to 4 places."""
    from isoframe.operators.dataset import mean_psi

    found = [r[0] for r in samples.select(condition).distinct().orderBy(condition).limit(most_levels).collect()]
    named = [nominator, denominator] if nominator and denominator else found
    wide = mean_psi(assays, samples, condition, 0.0).groupBy("event_name").pivot("level", named).agg(F.first("mean"))
    wide = wide.select("event_name", *[F.round(F.col(f"`{n}`"), 4).alias(f"avg_psi_{n}") for n in named])
    if nominator and denominator:
        d = F.round(F.col(f"avg_psi_{nominator}") - F.col(f"avg_psi_{denominator}"), 4)
        wide = wide.withColumns({"delta_psi": d, "abs_delta_psi": F.abs(d)})
    return results.join(wide, "event_name", "left")


def unify(results: DataFrame) -> DataFrame:
    """log_fc, p_value and fdr of whichever engine made the table."""
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in results.columns], F.lit(None).cast("double"))
    return results.select("event_name", pick("log_fc", "mle_log_fc").alias("log_fc"), pick("p_value").alias("p_value"), pick("fdr").alias("fdr"))


def pick_events(results: DataFrame, events: DataFrame, event_types: Sequence[str] | None = None, fdr: float | None = None, p_value: float | None = None, top: int | None = None) -> DataFrame:
    """Results by type and threshold, the first `top` by p."""
    rows = results.join(events.select("event_name", "event_type"), "event_name")
    if event_types is not None:
        rows = rows.where(F.col("event_type").isin(*event_types))
    for name, limit in (("fdr", fdr), ("p_value", p_value)):
        if limit is not None:
            rows = rows.where(F.col(name) <= limit)
    rows = rows.orderBy("p_value", "event_name")
    return rows if top is None else rows.limit(top)


def t_test(mean_a: Column, sd_a: Column, n_a: int, mean_b: Column, sd_b: Column, n_b: int) -> Column:
    """-log10 p of the equal-variance t test from group statistics; 0 where it is not finite."""
    df = n_a + n_b - 2
    pooled = ((n_a - 1) * sd_a * sd_a + (n_b - 1) * sd_b * sd_b) / df
    t = F.try_divide(mean_a - mean_b, F.sqrt(pooled * (1 / n_a + 1 / n_b)))

    @F.pandas_udf(DoubleType())
    def score(x: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            s = -np.log10(sp.t_sf2(x.fillna(0.0).to_numpy(), df))
        return pd.Series(np.where(np.isfinite(s) & x.notna().to_numpy(), s, 0.0))

    return score(t)
