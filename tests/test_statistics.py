import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoframe.functions import designs as dg
from isoframe.functions import special as sp
from isoframe.operators import differential as de
from isoframe.operators import enrichment as en


def test_distributions_known_values():
    assert sp.t_sf2(2.0, 10) == pytest.approx(0.07338803477074037, rel=1e-9)
    assert sp.t_sf2(1.0, 1) == pytest.approx(0.5, rel=1e-9)
    assert sp.f_sf(3.0, 2, 7) == pytest.approx((1 + 2 * 3 / 7) ** -3.5, rel=1e-9)
    assert sp.chi2_sf(3.84145882069412, 1) == pytest.approx(0.05, rel=1e-9)
    assert sp.chi2_sf(10.0, 2) == pytest.approx(math.exp(-5), rel=1e-9)
    assert sp.normal_sf(1.959963984540054) == pytest.approx(0.025, rel=1e-9)
    assert sp.t_quantile(0.975, 5) == pytest.approx(2.570581835636314, rel=1e-6)
    assert sp.digamma(1.0) == pytest.approx(-0.5772156649015329, rel=1e-9)
    assert sp.trigamma(1.0) == pytest.approx(math.pi**2 / 6, rel=1e-9)
    assert float(sp.trigamma(sp.trigamma_inverse(0.3))) == pytest.approx(0.3, rel=1e-6)
    exact = sum(math.comb(5, i) * math.comb(15, 6 - i) for i in range(3, 6)) / math.comb(20, 6)
    assert sp.hypergeometric_sf(3, 20, 5, 6) == pytest.approx(exact, rel=1e-9)


def test_designs():
    names, x = dg.design("~ 1 + b + c + b:c", {"b": ["x", "y", "x", "y"], "c": ["p", "p", "q", "q"]})
    assert names == ["(Intercept)", "by", "cq", "by:cq"] and x.tolist() == [[1, 0, 0, 0], [1, 1, 0, 0], [1, 0, 1, 0], [1, 1, 1, 1]]
    basis = dg.spline_basis(np.arange(8), 3)
    assert basis.shape == (8, 3) and np.linalg.matrix_rank(np.column_stack([np.ones(8), basis])) == 4
    assert dg.spline_basis(np.array([1, 1, 2]), 3).shape == (3, 1)


SAMPLES = {"sample": [f"s{i}" for i in range(6)], "cond": ["A"] * 3 + ["B"] * 3, "batch": ["k", "l", "m"] * 2, "time": [0.0, 1, 2, 3, 4, 5]}


def counts(spark, n=60, moved=6):
    rng = np.random.default_rng(0)
    rows = []
    for e in range(n):
        base = rng.uniform(0.3, 0.7)
        for i, s in enumerate(SAMPLES["sample"]):
            p = (0.85 if i < 3 else 0.15) if e < moved else base
            total = int(rng.integers(80, 200))
            inc = int(rng.binomial(total, p))
            rows.append((f"e{e:03d}", s, float(inc), float(total - inc)))
    return spark.createDataFrame(rows, "event_name string, sample string, included double, excluded double")


@pytest.mark.parametrize("engine", ["limma", "edger", "edger_lrt", "deseq", "double"])
def test_engines_find_what_moved(spark, engine):
    df = counts(spark)
    run = {
        "limma": lambda: de.limma_test(df, SAMPLES, "cond", "A", "B", ["batch"], floor=-1.0),
        "edger": lambda: de.edger_test(df, SAMPLES, "cond", "A", "B"),
        "edger_lrt": lambda: de.edger_custom(df, SAMPLES, "~ 1 + cond", "~ 1", quasi=False),
        "deseq": lambda: de.deseq_test(df, SAMPLES, "cond", "A", "B"),
        "double": lambda: de.double_exponential_test(df, SAMPLES, "cond", "A", "B"),
    }[engine]
    rows = run().collect()
    assert len(rows) == 60 and [r.p_value for r in rows] == sorted(r.p_value for r in rows)
    assert {r.event_name for r in rows[:6]} == {f"e{i:03d}" for i in range(6)}
    assert all(r.fdr < 0.01 for r in rows[:6]) and sum(r.fdr < 0.05 for r in rows) <= 9
    first = rows[0].mle_log_fc if engine == "double" else rows[0].log_fc
    assert abs(first) > 3 and (first > 0) == (engine != "edger_lrt")
    assert np.allclose(sp.benjamini_hochberg(np.array([r.p_value for r in rows])), [r.fdr for r in rows])


def test_time_series_finds_a_trend(spark):
    rng = np.random.default_rng(1)
    rows = []
    for e in range(40):
        for i, s in enumerate(SAMPLES["sample"]):
            inc = int(rng.binomial(150, 0.15 + 0.13 * i if e < 4 else 0.5))
            rows.append((f"e{e:02d}", s, float(inc), 150.0 - inc))
    df = spark.createDataFrame(rows, "event_name string, sample string, included double, excluded double")
    got = de.limma_test(df, SAMPLES, "time", degrees=1, floor=-1.0).collect()
    assert {r.event_name for r in got[:4]} == {"e00", "e01", "e02", "e03"}


def test_ols_equals_t_test():
    y = np.array([[1.0, 2, 3, 5, 6, 9]])
    x = np.column_stack([np.ones(6), [0, 0, 0, 1, 1, 1]])
    est, s2, cov, df = de.ols(y, x, np.array([[0.0, 1.0]]))
    assert est[0, 0] == pytest.approx(20 / 3 - 2) and df == 4
    assert s2[0] == pytest.approx((2 + 26 / 3) / 4) and cov[0, 0] == pytest.approx(2 / 3)


def test_nb_fit_is_poisson_mean_without_dispersion():
    y = np.array([[3.0, 5, 10, 12]])
    x = np.column_stack([np.ones(4), [0, 0, 1, 1]])
    beta, mu = de.nb_fit(y, x, np.zeros(4), np.array([1e-8]))
    assert np.exp(beta[0]) == pytest.approx([4, 11 / 4], rel=1e-5) and mu[0] == pytest.approx([4, 4, 11, 11], rel=1e-5)
    assert de.nb_deviance(y, y, np.array([0.1]))[0] == pytest.approx(0, abs=1e-9)


def test_flags_psi_picks(spark):
    events = spark.createDataFrame([("a", "SE", True, None, "Novel", "1", "g1", None), ("b", "IR", False, True, "NA", "Novel", "g2", "g3")], "event_name string, event_type string, inc_is_nmd boolean, exc_is_nmd boolean, inc_tsl string, exc_tsl string, gene_id string, gene_id_b string")
    results = spark.createDataFrame([("a", 0.01, 0.02), ("b", 0.5, 0.5)], "event_name string, p_value double, fdr double")
    assert {r.event_name: r.flags for r in de.add_flags(results, events).collect()} == {"a": "Inc-NMD;Inc-novel", "b": "Exc-NMD;Exc-novel"}
    cells = spark.createDataFrame([("a", "s1", 30.0, 10.0), ("a", "s2", 10.0, 30.0)], "event_name string, sample string, included double, excluded double")
    samples = spark.createDataFrame([("s1", "A"), ("s2", "B")], "sample string, cond string")
    r = de.add_psi(results, cells, samples, "cond", "A", "B").where("event_name = 'a'").first()
    assert (r.avg_psi_A, r.avg_psi_B, r.delta_psi, r.abs_delta_psi) == (0.75, 0.25, 0.5, 0.5)
    assert [r.event_name for r in de.pick_events(results, events, ["SE"], fdr=0.05, top=5).collect()] == ["a"]
    assert de.select_events(events, "annotated_binary").count() == 1
    assert {r.gene_id for r in en.genes_of_events(events).collect()} == {"g1", "g2", "g3"}


def test_over_representation(spark):
    rng = random.Random(0)
    rows = [(f"g{i}", t, f"term {t}", "BP") for i in range(60) for t in ("t1", "t2", "t3") if (i < 10 if t == "t1" else rng.random() < 0.3)]
    links = spark.createDataFrame(rows * 2, "gene_id string, go_id string, go_term string, ontology string")
    genes = spark.createDataFrame([(f"g{i}",) for i in [*range(8), 40, 41, 999]], "gene_id string")
    pool = spark.createDataFrame([(f"g{i}",) for i in range(60)], "gene_id string")
    got = en.over_representation(genes, en.normalise_terms(links), pool).collect()
    r = got[0]
    exact = sum(math.comb(10, i) * math.comb(50, 10 - i) for i in range(8, 11)) / math.comb(60, 10)
    assert (r.go_id, r["size"], r.overlap, r.expected, r.fold_enrichment) == ("t1", 10, 8, 2, round(8 / 2.001, 2))
    assert r.p_value == pytest.approx(exact, rel=1e-9)
    assert np.allclose(sp.benjamini_hochberg(np.array([x.p_value for x in got])), [x.fdr for x in got])
    events = spark.createDataFrame([("a", "g1", None), ("b", "zz", "g2"), ("c", "zz", None)], "event_name string, gene_id string, gene_id_b string")
    assert sorted(x.event_name for x in en.events_of_term(events, links, "t1").collect()) == ["a", "b"]
    assert en.display(en.over_representation(genes, links, pool), 1).first().label == "term t1"


def test_t_test_column(spark):
    df = spark.createDataFrame([(2.0, 1.0, 6.667, 2.0817), (1.0, 0.0, 1.0, 0.0), (None, 1.0, 2.0, 1.0)], "ma double, sa double, mb double, sb double")
    got = [r[0] for r in df.select(de.t_test(F.col("ma"), F.col("sa"), 3, F.col("mb"), F.col("sb"), 3)).collect()]
    pooled = (1 + 2.0817**2) / 2
    want = -math.log10(float(sp.t_sf2((2 - 6.667) / math.sqrt(pooled * 2 / 3), 4)))
    assert got[0] == pytest.approx(want) and got[1:] == [0.0, 0.0]


def test_designs_are_checked():
    for bad in (("time", "A", "B", ()), ("cond", "A", "C", ()), ("cond", "A", "A", ()), ("cond", "A", None, ()), ("cond", "A", "B", ("cond",)), ("cond", "A", "B", ("batch", "batch")), ("nothing", None, None, ())):
        with pytest.raises(ValueError):
            de.count_design(SAMPLES, *bad)


def test_adjustment_equals_the_formula(spark):
    rng = np.random.default_rng(1)
    p = np.round(rng.random(3000) ** 3, 3)
    got = {r.i: r.fdr for r in de.adjust(spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)] + [(-1, None)], "i int, p_value double")).collect()}
    order = np.argsort(-p, kind="stable")
    best, want = 1.0, {}
    for rank, i in zip(range(len(p), 0, -1), order, strict=True):
        best = min(best, p[i] * len(p) / rank)
        want[int(i)] = best
    last = {}
    for i in order:  # equal p-values share the least
        last[p[i]] = want[int(i)]
    assert got.pop(-1) is None
    assert all(got[int(i)] == pytest.approx(last[p[i]], abs=1e-12) for i in order)


def test_results_of_any_engine_have_one_form(spark):
    df = counts(spark, n=20, moved=2)
    for results in (de.limma_test(df, SAMPLES, "cond", "A", "B", floor=-1.0), de.double_exponential_test(df, SAMPLES, "cond", "A", "B")):
        got = de.unify(results)
        assert got.columns == ["event_name", "log_fc", "p_value", "fdr"] and got.where("log_fc is null or p_value is null or fdr is null").isEmpty()


def test_enrichment_by_other_ids_and_without_versions(spark):
    events = spark.createDataFrame([(f"ENSG{i}.3", None) for i in range(8)], "gene_id string, gene_id_b string")
    all_events = spark.createDataFrame([(f"ENSG{i}.3", None) for i in range(40)], "gene_id string, gene_id_b string")
    links = spark.createDataFrame([(f"x{i}", "t1" if i < 10 else "t2", "name", "BP") for i in range(40)], "gene_id string, go_id string, go_term string, ontology string")
    ids = spark.createDataFrame([(f"ENSG{i}", f"x{i}") for i in range(40)], "gene_id string, other_id string")
    got = {r.go_id: r.overlap for r in en.enrich_events(events, links, all_events, [ids], versions=True).collect()}
    assert got == {"t1": 8}
