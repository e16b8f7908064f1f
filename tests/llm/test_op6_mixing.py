import random
import re
from collections import Counter, defaultdict

import numpy as np

from isoframe.llm import op6_mixing
from isoframe.llm.op6_mixing import flight, mix, mixed_documents

SCHEMA = "doc_id long, text string, source string, size string, target string, x string"


def brute_targets(by_source):
    order = sorted((s for s in by_source if s is not None)) + [None] * (None in by_source)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    share, stopped = 1.5 * sum(by_source.values()), {}
    while True:
        rest = [s for s in order if s not in stopped]
        left = share - sum(stopped.values())
        target = {s: left * weight[s] / sum(weight[t] for t in rest) for s in rest}
        over = [s for s in rest if target[s] > 2 * by_source[s] + 1e-9]
        if not over:
            return stopped | target
        stopped |= {s: 2.0 * by_source[s] for s in over}


def test_flight_keeps_both_sums():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        size = rng.integers(0, 50, n).astype(float).tolist()
        x = rng.random(n).tolist()
        before = (sum(x), sum(a * b for a, b in zip(size, x, strict=True)))
        rest = flight(size, x, rng.random)
        assert len(rest) <= 2
        assert np.allclose(before, (sum(x), sum(a * b for a, b in zip(size, x, strict=True))))
        assert all(x[i] in (0.0, 1.0) for i in range(n) if i not in rest)


def test_flight_keeps_probabilities():
    rng = np.random.default_rng(2)
    total = np.zeros(6)
    for _ in range(4000):
        x = [0.2, 0.5, 0.7, 0.4, 0.6, 0.6]
        flight([3.0, 5.0, 9.0, 4.0, 4.0, 1.0], x, rng.random)
        total += x
    assert np.abs(total / 4000 - [0.2, 0.5, 0.7, 0.4, 0.6, 0.6]).max() < 0.04


def check(rows, got):
    by_source = defaultdict(int)
    size = {}
    for i, t, s, *_ in rows:
        size[i] = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        by_source[s] += size[i]
    want = brute_targets(by_source)
    source = {r[0]: r[2] for r in rows}
    taken = defaultdict(int)
    assert sorted(r.doc_id for r in got) == sorted(source)
    for r in got:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == by_source[s]
        assert abs(r.target - want[s]) < 1e-6 * (1 + want[s])
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r["size"] * r.copies
        taken[s] += r.taken
    return taken, want


def test_targets_and_totals(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        s = rng.choices(["hot", "b", "é", None, "tiny"], [60, 10, 10, 10, 1])[0]
        rows.append((i, "w " * rng.choice([0, 1, 5, 40, 100, 700]), s, "clash", "clash", "clash"))
    rows += [(900, None, "b", None, None, None), (901, "", "empty source", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for bucket in (4096, 64):
        monkeypatch.setattr(op6_mixing, "BUCKET_ROWS", bucket)
        got = mix(df).collect()
        taken, want = check(rows, got)
        for s in want:
            assert abs(taken[s] - want[s]) <= 700
        again = mix(df.repartition(7)).collect()
        assert {r.doc_id: r.taken for r in got} == {r.doc_id: r.taken for r in again}


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b", "s", "", "", "")] * 3 + [(None, "c", None, "", "", "")], SCHEMA)
    got = mix(df).collect()
    assert len(got) == 4 and sum(r.taken for r in got) >= 8
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r.taken for r in mix(spark.createDataFrame([(1, None, "s", "", "", "")], SCHEMA)).collect()] == [0]


def test_one_id_is_no_bucket_and_copies_come_to_what_is_due(spark, monkeypatch):
    """Null ids, one shared id and equal rows, many of each: totals hold, and no flight sees more than a bucket."""
    rng = random.Random(3)
    rows = [(None, "w " * rng.randint(1, 60), rng.choice("ab"), "", "", "") for _ in range(500)]
    rows += [(7, "w " * rng.randint(1, 60), rng.choice("ab"), "", "", "") for _ in range(500)]
    rows += [(8, "w w w", "a", "", "", "")] * 333 + [(None, None, None, None, None, None)] * 20
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(op6_mixing, "BUCKET_ROWS", 64)
    got = mix(df).collect()
    assert len(got) == len(rows)
    by_source = defaultdict(int)
    for _, t, s, *_ in rows:
        by_source[s] += len((t or "").split())
    want, taken = brute_targets(by_source), defaultdict(int)
    for r in got:
        s = next(k for k in by_source if by_source[k] == r.source_size)
        taken[s] += r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    assert all(abs(taken[s] - want[s]) <= 60 for s in want if s)
    assert {r.copies for r in got if r.doc_id == 8} <= {1, 2}
    full = mixed_documents(df)
    assert full.schema == df.schema
    copies = Counter(r.doc_id for r in full.collect())
    due = Counter()
    for r in got:
        due[r.doc_id] += r.copies
    assert copies == due
