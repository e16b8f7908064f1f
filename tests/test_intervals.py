import random

import pytest
from pyspark.sql import functions as F

from isoframe.functions import coords
from isoframe.operators import intervals as iv
from isoframe.operators import tables

SCHEMA = "chrom string, start long, end long, strand string, name long"


def random_intervals(rng, n, longest=60, chroms="ab"):
    rows = []
    for i in range(n):
        s = rng.randint(1, 600)
        w = rng.choice([1, 5, longest, longest * 8 if rng.random() < 0.1 else 3])
        rows.append((rng.choice(chroms), s, s + rng.randint(0, w), rng.choice("+-*"), i))
    return rows


def meet(a, b, ignore=False):
    return a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2] and (ignore or a[3] == b[3] or "*" in (a[3], b[3]))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("kind", ["any", "within", "equal"])
def test_binned_join_equals_naive(spark, seed, kind):
    rng = random.Random(seed)
    a, b = random_intervals(rng, 80), random_intervals(rng, 80, 400)
    test = {"any": lambda x, y: True, "within": lambda x, y: y[1] <= x[1] and x[2] <= y[2], "equal": lambda x, y: x[1:3] == y[1:3]}[kind]
    left, right = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    for ignore in (False, True):
        want = sorted((x[4], y[4]) for x in a for y in b if meet(x, y, ignore) and test(x, y))
        for base in (None, 16):
            got = iv.overlap_join(left, right, kind, ignore, base=base)
            assert sorted((r.name_a, r.name_b) for r in got.collect()) == want
        hit = {i for i, _ in want}
        assert {r.name for r in iv.semi_overlap(left, right, kind=kind, ignore_strand=ignore).collect()} == hit
        assert {r.name for r in iv.anti_overlap(left, right, kind=kind, ignore_strand=ignore).collect()} == set(range(80)) - hit


def test_plan_has_no_nested_loop(spark):
    rng = random.Random(0)
    left = spark.createDataFrame(random_intervals(rng, 50), SCHEMA)
    plan = iv.overlap_join(left, left)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def bases(rows):
    return {(c, s, p) for c, a, b, s, *_ in rows for p in range(a, b + 1)}


def runs_of(points):
    out = []
    for c, s, p in sorted(points):
        if out and out[-1][:2] == (c, s) and out[-1][3] == p - 1:
            out[-1] = (c, s, out[-1][2], p)
        else:
            out.append((c, s, p, p))
    return sorted(out)


@pytest.mark.parametrize("step", [1 << 16, 50])
def test_set_algebra_equals_bases(spark, step):
    rng = random.Random(4)
    a, b = random_intervals(rng, 60), random_intervals(rng, 40)
    x, y = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    flat = lambda df: sorted((r.chrom, r.strand, r.start, r.end) for r in df.collect())
    assert flat(iv.reduce(x, step=step)) == runs_of(bases(a))
    assert flat(iv.setdiff(x, y, step=step)) == runs_of(bases(a) - bases(b))
    assert flat(iv.intersect(x, y, step=step)) == runs_of(bases(a) & bases(b))
    depth = {}
    for c, s, e, st, _ in a:
        for p in range(s, e + 1):
            depth[c, st, p] = depth.get((c, st, p), 0) + 1
    got = {(r.chrom, r.strand, p): r.depth for r in iv.coverage_runs(x, step=step).collect() for p in range(r.start, r.end + 1)}
    assert got == depth


def test_reduce_gap_widths(spark):
    rows = [("a", 1, 10, "+", 0), ("a", 11, 20, "+", 1), ("a", 30, 40, "+", 2), ("a", 50, 60, "+", 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    ends = lambda gap: sorted((r.start, r.end) for r in iv.reduce(df, gap=gap).collect())
    assert ends(1) == [(1, 20), (30, 40), (50, 60)]
    assert ends(9) == [(1, 20), (30, 40), (50, 60)]
    assert ends(10) == [(1, 60)]


def test_gaps_span_flank_and_stack(spark):
    rows = [("a", 1, 10, "+", 7), ("a", 21, 30, "+", 7), ("a", 25, 40, "+", 7), ("a", 51, 60, "+", 7), ("a", 1, 9, "-", 8)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.name, r.start, r.end) for r in iv.gaps_within(df, ["name"]).collect()) == [(7, 11, 20), (7, 41, 50)]
    assert sorted((r.name, r.start, r.end) for r in iv.span(df, ["name"]).collect()) == [(7, 1, 60), (8, 1, 9)]
    ends = {(r.name, r.strand): (r.start, r.end) for r in iv.flank(iv.span(df, ["name", "strand"]), 5).collect()}
    assert ends == {(7, "+"): (-4, 0), (8, "-"): (10, 14)}
    levels = {r.name: r.level for r in iv.stack_levels(df.withColumn("view", F.lit(1)), ["view"], "name").collect()}
    assert sorted(levels.values()) == [1, 2]


def test_histogram_stats(spark):
    depths = [0, 0, 1, 1, 2, 3, 3, 8, 9, 9]
    blocks = spark.createDataFrame([("a", 1, 10, "+", 5)], SCHEMA)
    runs = spark.createDataFrame([("a", i + 1, i + 1, d) for i, d in enumerate(depths) if d], "chrom string, start long, end long, depth long")
    r = iv.histogram_stats(iv.depth_histogram(runs, blocks, "name"), "name").first()
    assert r["size"] == 10 and r.mean == 3.6 and r.covered == 0.8
    assert r.trimmed_mean == (1 + 2 + 3 + 3) / 4
    at = lambda p: (lambda k, f: depths[k - 1] + f * (depths[k] - depths[k - 1]))(int(11 * p / 100), 11 * p / 100 % 1)
    assert [r.p25, r.p50, r.p75] == [at(25), at(50), at(75)]


def test_coordinates(spark):
    rows = spark.createDataFrame([("chr1:5",), ("c:2-9/-",), ("x:9-2/+",), ("bad",), (None,)], "t string")
    got = [r[0] for r in rows.select(coords.parse_interval("t")).collect()]
    assert got[0] == ("chr1", 5, 5, "*") and got[1] == ("c", 2, 9, "-") and got[2:] == [None] * 3
    assert coords.check_intervals(rows.limit(2), "t").count() == 2
    # One match a text; line ends are no part of what is parsed, but for one at the end.
    assert str(coords.parse_interval("t")).count("regexp_extract") == 0
    odd = ["a:b:3-4/+", "c:5-5/-\n", "c:5-5/-\r\n", "1\n2\n3\n+\nc", "c:1-2\nx", ":5", "c:99999999999999999999", "c:7-99999999999999999999", "c:1-2/", "c:-5"]
    got = [r.p and tuple(r.p) for r in spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").select("i", coords.parse_interval("t").alias("p")).orderBy("i").collect()]
    assert got == [("a:b", 3, 4, "+"), ("c", 5, 5, "-"), ("c", 5, 5, "-"), None, None, None, None, ("c", 7, 7, "*"), None, None]
    with pytest.raises(Exception, match="not an interval"):
        coords.check_intervals(rows, "t").collect()
    one = spark.range(1).select(coords.reverse_complement(F.lit("AACGn")), coords.strip_version(F.lit("ENSG1.4")), coords.strip_version(F.lit("X.1"))).first()
    assert tuple(one) == ("nCGTT", "ENSG1", "X.1")


def test_match_joins(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k long, v string")
    right = spark.createDataFrame([(1, "first", 1), (1, "last", 2), (2, None, 1)], "k long, v2 string, o long")
    assert {r.k: r.v2 for r in tables.first_match_join(left, right, ["k"], ["o"]).collect()} == {1: "first", 2: None, 3: None}
    assert {r.k: r.v2 for r in tables.last_match_join(left, right, ["k"], ["o"]).collect()} == {1: "last", 2: None, 3: None}
    new = right.withColumnRenamed("v2", "v")
    assert {r.k: r.v for r in tables.update_columns(left, new, ["k"], ["v"], ["o"]).collect()} == {1: "last", 2: None, 3: "z"}
    merged = tables.upsert(left, spark.createDataFrame([(3, None), (4, "new")], "k long, v string"), "k")
    assert {r.k: r.v for r in merged.collect()} == {1: "x", 2: "y", 3: "z", 4: "new"}
    pairs = tables.all_pairs(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (2, 1, "c")], "g long, o long, n string"), ["g"], ["o"], "n")
    assert sorted((r.n_a, r.n_b) for r in pairs.collect()) == [("a", "b"), ("b", "a")]


@pytest.mark.parametrize("step", [16, 1 << 16])
def test_covered_bases_are_running_sums(spark, step):
    rng = random.Random(7)
    asked, zones = random_intervals(rng, 60, 400), random_intervals(rng, 40)
    merged = iv.reduce(spark.createDataFrame(zones, SCHEMA), gap=1)
    lie = {(c, k, p) for c, s, e, k, _ in zones for p in range(s, e + 1)}
    want = {x[4]: sum((x[0], x[3], p) in lie for p in range(x[1], x[2] + 1)) for x in asked}
    got = iv.covered_bases(spark.createDataFrame(asked, SCHEMA), merged, step=step)
    assert {r.name: r.covered or 0 for r in got.collect()} == want


def test_short_intervals_are_not_posted_to_hold_long_ones(spark):
    """A long interval and very many short ones in it: for "within", no pair of them is looked at."""
    long = spark.createDataFrame([("a", 1, 1 << 20, "+", 0)], SCHEMA)
    short = spark.range(2000).selectExpr("'a' chrom", "id * 500 start", "id * 500 + 9 end", "'+' strand", "id name")
    both = short.unionByName(long)
    joined = iv.overlap_join(long, both, kind="within")
    assert [r.name_b for r in joined.collect()] == [0]
    right = joined._jdf.queryExecution().optimizedPlan().toString()
    assert right.count("filter(") == 1, "only the left side is posted above its own level"


@pytest.mark.parametrize("gap", [0, 1, 9])
def test_merged_islands_cross_bins_without_a_window_over_contigs(spark, gap):
    rng = random.Random(gap)
    rows = random_intervals(rng, 120, 200)
    merged = iv.reduce(spark.createDataFrame(rows, SCHEMA), gap=gap, step=32)
    want = []
    for c, k in sorted({(r[0], r[3]) for r in rows}):
        for s, e in sorted(r[1:3] for r in rows if (r[0], r[3]) == (c, k)):
            if want and want[-1][:2] == [c, k] and s <= want[-1][3] + gap:
                want[-1][3] = max(want[-1][3], e)
            else:
                want.append([c, k, s, e])
    assert sorted([r.chrom, r.strand, r.start, r.end] for r in merged.collect()) == want
    over = [line for line in merged._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line]
    assert over and all("_step" in line for line in over)


def counted(monkeypatch, df_of):
    """What df_of() gives, and how many tables it wrote on the way."""
    made, settle = [], iv.settle
    monkeypatch.setattr(iv, "settle", lambda df: made.append(1) or settle(df))
    return df_of(), len(made)


def test_depth_histogram_joins_once_and_writes_nothing(spark, monkeypatch):
    rng = random.Random(6)
    a, b = random_intervals(rng, 80), random_intervals(rng, 40, 900)
    x, y = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    hist, written = counted(monkeypatch, lambda: iv.depth_histogram(iv.coverage_runs(x, ("chrom",), step=50), y, "name"))
    plan = hist._jdf.queryExecution().optimizedPlan().toString()
    assert written == 0 and plan.count("Join ") == 1
    for base in (None, 16, 1 << 12):
        got = {(r["name"], r.depth): r.bases for r in iv.depth_histogram(iv.coverage_runs(x, ("chrom",), step=50), y, "name", base=base).collect()}
        want = {}
        for c, s, e, _, n in b:
            for p in range(s, e + 1):
                d = sum(i[0] == c and i[1] <= p <= i[2] for i in a)
                want[n, d] = want.get((n, d), 0) + 1
        assert got == want


def test_runs_cross_empty_bins_and_keep_null_keys(spark):
    rows = [("a", -130, 400, "+", 1), ("a", 5, 9, "+", 2), (None, 10, 300, "+", 3), (None, 10, 20, "+", 4), ("b", 7, None, "+", 5), ("b", 1, 3, "+", 6)]
    x = spark.createDataFrame(rows, SCHEMA)
    got = {(r.chrom, r.start, r.end, r.depth) for r in iv.coverage_runs(x.where("end is not null"), ("chrom",), step=50).collect()}
    assert got == {("a", -130, 4, 1), ("a", 5, 9, 2), ("a", 10, 400, 1), (None, 10, 20, 2), (None, 21, 300, 1), ("b", 1, 3, 1)}
    assert ("b", 1, 3, 1) in {(r.chrom, r.start, r.end, r.depth) for r in iv.coverage_runs(x, ("chrom",), step=50).collect()}


@pytest.mark.parametrize("step", [1 << 16, 50])
def test_depth_sums_equal_bases(spark, step):
    rng = random.Random(7)
    a, b = random_intervals(rng, 80), random_intervals(rng, 40, 900) + [("a", -500, -400, "*", 90), ("b", 9000, 9100, "*", 91), (None, 1, 600, "*", 92), ("a", 1, 5, "*", 93), ("a", 4, 9, "*", 93)]
    x, y = spark.createDataFrame([*a, (None, 1, 50, "+", 0)], SCHEMA), spark.createDataFrame(b, SCHEMA)
    sums = iv.depth_sums(y, iv.changes_of_intervals(x, ("chrom",)), ("chrom",), ("name",), step)
    assert " Join " not in sums._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for c, s, e, _, n in b:
        want[n] = want.get(n, 0) + sum(max(0, min(e, i[2]) - max(s, i[1]) + 1) for i in a if i[0] == c)
    assert {r["name"]: r["sum"] for r in sums.collect()} == want
