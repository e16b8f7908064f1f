"""Ordered look-ups and numberings over many partitions, and updates by overlap."""

import glob
import random

import pyarrow.parquet as pq
import pytest

from isoframe.functions.special import hypergeometric_sf, hypergeometric_tail
from isoframe.operators import intervals as iv
from isoframe.operators import tables as tb


@pytest.fixture(autouse=True)
def many_partitions(request):
    """Small tables in as many partitions as large ones would have."""
    if "spark" not in request.fixturenames:
        yield
        return
    spark = request.getfixturevalue("spark")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_rows_are_numbered_in_order(spark):
    rng = random.Random(0)
    rows = [(rng.choice([None, *range(40)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, i int").repartition(9)
    got = {r.i: r.position for r in tb.number_all(df, ["k", "i"]).collect()}
    assert got == {i: n + 1 for n, (_, i) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))}
    assert tb.number_all(df.limit(0), ["k"]).count() == 0


def test_sums_before(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 9), rng.randint(0, 9)) for i in rng.sample(range(10**6), 2000)]
    got = {r.k: (r.a, r.b) for r in tb.sums_before(spark.createDataFrame(rows, "k int, a long, b long").repartition(5), ["k"], ["a", "b"]).collect()}
    a = b = 0
    for k, x, y in sorted(rows):
        assert got[k] == (a, b)
        a, b = a + x, b + y


def test_look_up_keeps_the_order_of_y(spark, tmp_path):
    rng = random.Random(2)
    x = [(rng.randint(0, 60), i, f"v{i}") for i in range(900)]
    y = [(rng.choice([None, *range(90)]), rng.random(), f"y{i}") for i in range(400)]
    xs = spark.createDataFrame(x, "key int, n int, tag string").repartition(7)
    ys = spark.createDataFrame(y, "key int, at double, tag string").repartition(5)
    out = tb.look_up(xs, ys, ["key"], ["at"], ["n"])
    assert out.columns == ["position", "key", "at", "tag", "n", "tag_x"]
    want = []
    for p, (k, at, tag) in enumerate(sorted(y, key=lambda r: r[1])):
        met = sorted((n, v) for key, n, v in x if key == k) or [(None, None)]
        want += [(p + 1, k, at, tag, n, v) for n, v in met]
    assert [tuple(r) for r in out.collect()] == want  # partitions one after the other are in order
    tb.write_in_order(out, str(tmp_path / "o"), ["position", "n"])
    files = sorted(glob.glob(str(tmp_path / "o" / "part-*")))
    assert len(files) > 1
    assert [p for f in files for p in pq.read_table(f).column("position").to_pylist()] == [r[0] for r in want]


def test_overlap_update_takes_the_last_hit(spark):
    rng = random.Random(3)
    left = [(rng.choice("ab"), s, s + rng.choice([0, 5, 300]), rng.choice("+-*"), i, "old") for i, s in enumerate(rng.choices(range(2000), k=200))]
    right = [(rng.choice("ab"), s, s + rng.choice([0, 20, 900]), rng.choice("+-*"), k, rng.choice([None, f"n{k}"])) for k, s in enumerate(rng.choices(range(2000), k=150))]
    a = spark.createDataFrame(left, "chrom string, start long, end long, strand string, i int, name string").repartition(3)
    b = spark.createDataFrame(right, "chrom string, start long, end long, strand string, ord int, tag string").repartition(4)
    got = {r.i: (r.name, r.nth) for r in iv.overlap_update(a, b, {"name": "tag", "nth": "ord"}, ["ord"]).collect()}
    several = 0
    for c, s, e, strand, i, name in left:
        hits = [(k, t) for cc, ss, ee, st, k, t in right if cc == c and ss <= e and s <= ee and (st == strand or "*" in (st, strand))]
        several += len(hits) > 1
        assert got[i] == ((max(hits)[1], max(hits)[0]) if hits else (name, None))
    assert several > 50


def test_layout_is_that_of_one_task(spark):
    rng = random.Random(4)
    rows = [(v, f"t{v}.{i}", s, s + rng.choice([5, 60, 4000])) for v in range(3) for i, s in enumerate(rng.choices(range(30_000), k=150))]
    df = spark.createDataFrame(rows, "view int, item string, start long, end long").repartition(5)
    want = {}
    for v in range(3):
        ends = []
        for s, e, item in sorted((r[2], r[3], r[1]) for r in rows if r[0] == v):
            level = next((k for k, x in enumerate(ends) if x < s), len(ends))
            ends[level : level + 1] = [e]
            want[item] = level + 1
    for stretch in (1, 1000, 1 << 20):
        got = iv.stack_levels(df, ["view"], "item", stretch)
        assert got.columns == ["view", "item", "start", "end", "level"]
        assert {r.item: r.level for r in got.collect()} == want


def test_hypergeometric_tails_of_arrays():
    rng = random.Random(5)
    cases = []
    for _ in range(300):
        n = rng.randint(1, 400)
        m, d = rng.randint(0, n), rng.randint(0, n)
        cases.append((rng.randint(0, min(m, d) + 1), n, m, d))
    k, n, m, d = zip(*cases, strict=True)
    for at_once in (1, 50, 1 << 20):
        assert hypergeometric_tail(k, n, m, d, at_once) == pytest.approx([hypergeometric_sf(*c) for c in cases], rel=1e-9, abs=1e-300)
