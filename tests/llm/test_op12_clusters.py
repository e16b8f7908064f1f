import hashlib

import duckdb
import numpy as np
import pytest

from isoframe.llm.op12_clusters import ORACLE, Bounds, clusters, op12_clusters

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, distance string, v string"


def brute(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * x)) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    now = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        at = [min(range(len(now)), key=lambda j: (far(v, now[j]), j)) for _, v in kept]
        if r < rounds:
            for j in range(len(now)):
                own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
                if own:
                    now[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    d = [far(v, now[a]) for (_, v), a in zip(kept, at, strict=True)]
    sums = {j: sum(x for x, a in zip(d, at, strict=True) if a == j) for j in set(at)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return [(i, a, x, sums[a], sum(d), sha[a]) for (i, _), a, x in zip(kept, at, d, strict=True)]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


def table(spark, rows):
    return spark.createDataFrame([(i, e, 0, "clash", "clash", "clash") for i, e in rows], SCHEMA)


def test_equals_brute_force_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-3, 4, 64) / 64.0 * (1 + i % 3)).tolist()) for i in range(300)]
    rows += [(1000 + i, [float(i % 2)] * 64) for i in range(60)]  # many ties and repeats
    rows += [rows[0], rows[0], (None, rows[5][1]), (None, [0.25] * 64)]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 63), (2003, [0.0] * 65), (2004, [None] + [0.0] * 63), (2005, [float("nan")] + [0.0] * 63), (2006, [float("-inf")] + [0.0] * 63)]
    for parts in (1, 7):
        got = clusters(table(spark, rows + odd).repartition(parts)).collect()
        assert order(got) == order(brute(rows))


def test_few_vectors_and_none(spark):
    rows = [(7, [0.5] * 64), (8, [-0.5] * 64), (9, [0.5] * 64)]
    assert order(clusters(table(spark, rows)).collect()) == order(brute(rows))
    empty = clusters(table(spark, []))
    assert empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert empty.count() == 0
    assert clusters(table(spark, [(1, None)])).count() == 0


def test_far_numbers_stop_at_the_bound(spark):
    got = clusters(table(spark, [(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)]), k=1, rounds=1).collect()
    assert {r.vec_id for r in got} == {1, 2, 3}
    assert all(r.distance >= 0 and r.inertia > 0 for r in got)


@pytest.mark.parametrize("wide", [3, 1 << 27])
def test_bounds_hold_and_skip(wide):
    """After any move the bounds still hold, the assignment is that of all distances, and most distances are skipped."""
    rng = np.random.default_rng(wide)
    middle = rng.integers(-wide, wide + 1, (8, 64))
    x = np.clip(middle[rng.integers(0, 8, 500)] + rng.integers(-2, 3, (500, 64)) * max(1, wide // 40), -wide, wide)
    now = x[:12].copy()
    at, upper, lower = Bounds(now).first(x)
    worked = 0
    for _ in range(4):
        before, now = now, np.stack([x[at == j].sum(axis=0) // max(1, (at == j).sum()) if (at == j).any() else now[j] for j in range(12)])
        at, upper, lower, n = Bounds(now, before).advance(x, at, upper, lower)
        worked += n
        full = np.array([[sum((int(p) - int(q)) ** 2 for p, q in zip(r, c, strict=True)) for c in now] for r in x[::25]], object)
        assert at[::25].tolist() == [min(range(12), key=lambda j: (r[j], j)) for r in full]
        for i, r in enumerate(full):
            assert float(upper[::25][i]) ** 2 >= r[at[::25][i]] * (1 - 1e-15)
            assert all(float(lower[::25][i][j]) ** 2 <= r[j] * (1 + 1e-15) for j in range(12))
    assert worked < 0.6 * 4 * 500 * 12


def test_equals_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{data}/embeddings.parquet'")
    got = op12_clusters(spark, data)
    want = con.execute(f"select {', '.join(got.columns)} from ({ORACLE})").fetchall()
    assert len(want) == 500
    assert order(got.collect()) == order(want)
