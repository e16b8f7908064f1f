import duckdb
import numpy as np
import pytest

from isoframe.llm import op11_negatives as op

SCHEMA = "vec_id long, embedding array<double>, label int, score string, w string, id string"


def brute(rows, every=100):
    v = [(i, lab, [int(np.floor(256 * x)) for x in e]) for i, e, lab in rows if i is not None and lab is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for i, lab, e in {(i, lab, tuple(e)) for i, lab, e in v if i % every == 0}:
        near = [(-sum(a * b for a, b in zip(e, o)), j, m == lab) for j, m, o in v if j != i]  # noqa: B905
        for ps, p, _ in sorted(x for x in near if x[2])[:5]:
            fit = sorted(x[:2] for x in near if not x[2] and 30 * -ps <= 100 * -x[0] <= 90 * -ps)[:10]
            out += [(i, p, r + 1, j, -ps, -s) for r, (s, j) in enumerate(fit)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, e, lab, "clash", "clash", "clash") for i, e, lab in rows], SCHEMA)


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def tight(monkeypatch):
    """Short digits and no slack, so that every digit of score and id is refined."""
    monkeypatch.setattr(op, "DIGIT", 3)
    monkeypatch.setattr(op, "FEW", 1)
    monkeypatch.setattr(op, "AT_ONCE", 2)


def random_rows(seed, n, ids=3):
    rng = np.random.default_rng(seed)
    return [(int(i) * ids - 40, (rng.integers(-2, 3, 6) / 8).tolist(), int(rng.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("block", [1, 1024])
def test_equals_brute_force_digit_by_digit(spark, tight, block):
    rows = random_rows(1, 300)
    assert len(brute(rows, 50)) > 50
    assert got(op.hard_negatives(table(spark, rows).repartition(5), every=50, block=block)) == brute(rows, 50)


def test_a_third_of_the_rows_tie(spark, tight):
    rows = random_rows(2, 200)
    rows += [(1000 + i, [0.25, 0.25, 0.0, 0.0, 0.0, 0.0], 1) for i in range(150)]
    rows += [(1500 + i, [0.25, 0.125, 0.0, 0.0, 0.0, 0.0], 2) for i in range(150)]
    rows += [(1600, [0.5, 0.5, 0.0, 0.0, 0.0, 0.0], 1)] * 2  # a repeated anchor
    rows += [(1501, [0.25, 0.125, 0.0, 0.0, 0.0, 0.0], 2)] * 20  # repeats beyond what is wanted
    want = brute(rows)
    assert len(want) > 50
    for parts in (1, 6):
        assert got(op.hard_negatives(table(spark, rows).repartition(parts))) == want


def test_odd_rows(spark):
    rows = random_rows(3, 150)
    odd = [(None, [1.0] * 6, 1), (100, None, 1), (200, [1.0] * 6, None), (300, [None] + [1.0] * 5, 1), (400, [float("nan")] * 6, 1), (500, [float("inf")] * 6, 1), (600, [], 1), (7, [0.5], 2), (800, [0.5, 0.5], 0)]
    assert got(op.hard_negatives(table(spark, rows + odd))) == brute(rows + odd)
    assert op.hard_negatives(table(spark, [])).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert op.hard_negatives(table(spark, odd)).count() == 0
    assert op.hard_negatives(table(spark, [(100, [1.0], 1), (101, [1.0], 1)])).count() == 0


def test_far_numbers(spark):
    rows = [(0, [60000.0, 1.0], 1), (1, [60000.0, 3.0], 1), (2, [30000.0, 5.0], 2), (3, [29000.0, -1.0], 2), (4, [1.0, 1.0], 2)]
    assert got(op.hard_negatives(table(spark, rows))) == brute(rows)
    assert op.hard_negatives(table(spark, rows + [(5, [1e300, -1e300], 2)])).count() > 0


def test_a_task_reports_no_more_counts_than_rows_wanted(spark):
    rows = [(i, [i / 4000, 0.5], 1) for i in range(2000)]
    df = table(spark, rows).select(op.F.col("vec_id").alias("id"), op.F.col("label").cast("long").alias("label"), op.scaled("embedding", 256, op.MOST).alias("v")).repartition(2)
    wide = op.Windows(np.array([[128, 128]]), np.zeros(1, np.int64), np.array([-(1 << 20)]), np.array([1 << 20]), True, 5, 0, 11)
    assert op._counts(df, wide, np.array([-1]), np.array([1])).groupBy("w").count().first()["count"] <= 2 * 5


def test_equals_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{data}/embeddings.parquet'")
    mine = op.op11_negatives(spark, data)
    want = con.execute(f"select {', '.join(mine.columns)} from ({op.ORACLE})").fetchall()
    assert want
    assert got(mine) == sorted(want)
