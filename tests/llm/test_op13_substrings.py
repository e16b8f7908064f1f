import hashlib
import re

import duckdb
import numpy as np
import pytest

from isoframe.llm import op13_substrings as op

SCHEMA = "doc_id long, text string, none string, spans string, text_hash string"


def brute(rows):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    low = lambda i: (i is None, i or 0)
    least = {}
    for i, w in split:
        for k in range(len(w) - 12):
            win = tuple(w[k : k + 13])
            least[win] = min(least.get(win, low(i)), low(i))
    out = []
    for i, w in split:
        gone = {k + t for k in range(len(w) - 12) if least[tuple(w[k : k + 13])] < low(i) for t in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows], SCHEMA)


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}é" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocab, n))
    passage, phrase = text(40), text(6)
    rows = []
    for i in range(120):
        t = text(int(rng.integers(0, 120)))
        if i % 3 == 0:  # one passage in a third of the documents, at any place
            words = t.split(" ")
            k = int(rng.integers(0, len(words) + 1))
            t = "\t".join(words[:k]) + f" {passage}\n" + " ".join(words[k:])
        if i % 4 == 0:  # one phrase in many surroundings
            t = f"{text(15)} {phrase} {text(15)} {t}"
        rows.append((int(rng.permutation(1000)[0]) - 500, t))
    rows += [(900 + i, rows[7][1]) for i in range(30)]  # copies
    rows += [rows[3], rows[3], (rows[5][0], text(60) + " " + passage)]  # repeated rows, unlike texts of one id
    rows += [(2000, "a " * 400), (2001, "a " * 300 + "b"), (2002, "a b " * 100), (2003, None), (2004, ""), (2005, " \n\t"), (2006, "one two"), (2007, passage), (2008, phrase)]
    rows += [(None, passage), (None, passage), (None, rows[1][1]), (None, None), (2009, " ".join(passage.split()[:13])), (2010, " ".join(passage.split()[:12]))]
    return rows


@pytest.mark.parametrize(("sample", "least_seen"), [(1.0, 1), (1.0, 5), (1.0, 10**9)])
def test_equals_brute_force(spark, sample, least_seen):
    """All minimisers frequent, some, none: the same result."""
    rows = corpus()
    often, _ = op.frequent(op._rows(table(spark, rows), "doc_id", "text"), 8, 13, sample, least_seen)
    assert (len(often) > 0) == (least_seen < 10**9)
    for parts in (1, 6):
        got = op.substring_dedup(table(spark, rows).repartition(parts), sample=sample, least_seen=least_seen).collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_long_text_and_kept_text(spark):
    rng = np.random.default_rng(1)
    long = " ".join(f"x{i}" for i in rng.integers(0, 5000, 200_000))
    words = long.split()
    rows = [(2, long), (1, " ".join(words[100_000:100_050])), (3, " ".join(words[-60:]) + " end")]
    got = {r.doc_id: r for r in op.substring_dedup(table(spark, rows), with_text=True).collect()}
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.values()) == brute(rows)
    assert got[2].kept_text.split() == words[:100_000] + words[100_050:]
    assert got[3].kept_text == "end"


def test_empty(spark):
    got = op.substring_dedup(table(spark, []))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert got.count() == 0


def test_super_k_mers_hold_every_window_once():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"v{i}" for i in rng.integers(0, 30, n)) for n in (0, 12, 13, 14, 300)] + ["z " * 500, None]
    c = op.chunk(texts)
    windows = lambda w: [tuple(w[k : k + 13]) for k in range(len(w) - 12)]
    got = [win for a, n in zip(c.start, c.length, strict=True) for win in windows([c.words[k].decode() for k in c.ids[a : a + n]])]
    assert sorted(got) == sorted(win for t in texts for win in windows((t or "").split()))
    assert c.length.max() <= op.LONGEST + 12
    assert len(c.start) < len(got) / 3  # several windows travel as one
    by = {}
    for a, n, m in zip(c.start, c.length, c.minimiser, strict=True):
        for win in windows([c.words[k] for k in c.ids[a : a + n]]):
            assert by.setdefault(win, m) == m


def test_equal_hashes_of_unlike_windows():
    """With a hash that tells nothing apart, the words themselves are sorted."""
    rows = [(i, t) for i, t in corpus(4) if i is not None and t]
    c = op.chunk([t for _, t in rows])
    ids = np.array([i for i, _ in rows])
    blob = op.pack(c, np.arange(len(c.start)), np.zeros(len(ids), bool), ids, np.arange(len(ids)))
    spans = lambda x: sorted(zip(*(v.tolist() for v in x[1:]), strict=True))
    bad = lambda h, n: op._mix(h, n) % np.uint64(3)
    assert spans(op.count_bucket([blob])) == spans(op.count_bucket([blob], mix=bad))
    assert spans(op.count_bucket([blob]))


def test_equals_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    mine = op.op13_substrings(spark, data)
    want = con.execute(f"select {', '.join(mine.columns)} from ({op.ORACLE})").fetchall()
    assert sum(r[2] for r in want) > 0
    assert sorted(map(tuple, mine.collect())) == sorted(want)
