from collections import Counter

import numpy as np
import pytest
import xxhash

from isoframe.llm.op2_simhash import drop_near_duplicates, near_duplicates, simhash

SCHEMA = "doc_id long, text string, fp string, component_id string"


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", low)]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_prints_and_groups_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    vocab = [f"W{i}é" for i in range(60)]
    texts = [" ".join(rng.choice(vocab, n)) for n in rng.integers(0, 220, 60)]
    for k in range(0, 60, 3):  # near copies, and chains of them
        words = texts[k].split()
        for _ in range(3):
            if len(words) > 20:
                words[int(rng.integers(len(words)))] = "x"
            texts.append("\t".join(words))
    texts += [None, "", " \n", "One", "one TWO", "ONE two", texts[0], texts[0].upper().replace("É", "é"), "a b c d"]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    prints = {i: brute_print(t) for i, t, *_ in rows}
    assert {i: f"{p:016x}" for i, p in prints.items()} == {i: g[0] for i, g in got.items()}
    assert brute_groups(prints) == {i: g[1] for i, g in got.items()}


@pytest.mark.parametrize("most", [1, 5, 40, 512])
def test_full_postings_keep_links(spark, most):
    """Many fingerprints that share four or six bytes: split postings and the look-up by differences connect what pairs would."""
    from isoframe.llm import op2_simhash as op

    rng = np.random.default_rng(most)
    values = [(7 << 16) | v for v in range(0, 4096, 3)] + [1 << 40, 3 << 40]
    values += [int(v) for v in rng.integers(0, 1 << 20, 400) | (5 << 40)]  # four bytes in common and more
    for v in values[-60:]:
        values.append(v ^ 1 << int(rng.integers(63)) ^ 1 << int(rng.integers(63)))
    values = sorted(set(values))
    got = op.links(spark.createDataFrame([(v,) for v in values], "fp long"), most=most)
    root = {v: v for v in values}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in got.collect():
        assert (r.a ^ r.b).bit_count() <= 2
        root[find(r.a)] = find(r.b)
    have = Counter(find(v) for v in values)
    want = Counter(brute_groups(dict(zip(values, values, strict=True))).values())
    assert sorted(have.values()) == sorted(want.values())


def test_pairs_below_the_minimum_of_matches_are_not_retained():
    """Four or five shared bytes meet in a posting and are tallied out; a link always shares six."""
    from isoframe.llm import op2_simhash as op

    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    b = a.copy()
    for k in range(400):  # k % 5 bytes differ, by one bit each
        for p in rng.permutation(8)[: k % 5]:
            b[k] ^= np.uint64(1 << int(8 * p + rng.integers(8)))
    both = np.stack([a, b], axis=1).ravel()
    x, y = op._pairs(np.repeat(np.arange(400), 2), both, 2)
    assert set(zip(x.tolist(), y.tolist(), strict=True)) == {(int(a[k]), int(b[k])) for k in range(400) if k % 5 <= 2}
    assert op.shared_bytes(a ^ b).tolist() == [8 - k % 5 for k in range(400)]


def test_drops_rows_by_their_texts(spark):
    """Unlike texts that share an id all stay; repeated and near rows leave one; ties go by the text, not by chance."""
    rng = np.random.default_rng(1)
    text = lambda: " ".join(f"w{i}" for i in rng.integers(0, 10**6, 80))
    a, b, c = text(), text(), text()
    rows = [(0, a, "x", "1"), (1, a, "x", "2"), (1, b, "y", "3"), (1, b, "z", "4"), (None, b, "n", "5"), (None, c, "n", "6"), (None, c, "n", "7"), (4, c.upper(), "u", "8"), (5, None, "e", "9"), (6, "", "e", "10")]
    chosen = []
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        got = drop_near_duplicates(docs)
        assert got.schema == docs.schema
        kept = sorted((r.doc_id, r.text) for r in got.collect())
        assert kept == sorted([(0, a), (1, b), (4, c.upper()), (5, None)])
        chosen.append(sorted(r.component_id for r in got.collect()))
    assert chosen[0] == chosen[1]
    only_null = spark.createDataFrame([(None, c, "n", "6"), (None, c, "n", "6"), (None, a, "n", "6")], SCHEMA)
    assert sorted(r.text for r in drop_near_duplicates(only_null).collect()) == sorted([a, c])
    assert drop_near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_edges_of_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).count() == 0
    rows = [(1, "a b c", None, None), (1, "a b c", None, None), (None, "a b c", None, None), (None, None, None, None), (5, "word " * 50000, None, None)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id == 1) == [(1, 1), (1, 1)]
    assert [r.component_id for r in got if r.doc_id is None and r.fingerprint != "0" * 16] == [1]
    assert simhash(None) == 0
