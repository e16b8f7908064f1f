import hashlib

import numpy as np
import pytest

from isoframe.llm import op7_sketches as op

SCHEMA = "doc_id long, text string, n_chars string, guest string"


def kept(text, scale=op.SCALE):
    """What a sketch keeps, one hash at a time."""
    words = (text or "").encode().split()
    grams = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    h = {int(op.hash_words(list(g), max(1, len(g)))[0]) for g in grams}
    below = {x for x in h if x < (1 << 64) // scale}
    return below or set(sorted(h)[:1])


def brute(rows, scale=op.SCALE):
    """The figures of the fixed fraction by sets of hashes."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (d, t, *_) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        m = len(t) // 3
        e = t[: len(t) - m] + nxt[:m]
        a, b, c = (kept(x, scale) for x in (t, e, nxt))
        low = lambda x: {v for v in x if v < (1 << 64) // scale}
        jaccard = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        like = lambda x, y: jaccard(low(x), low(y)) if low(x) | low(y) else jaccard(x, y)

        def held(x, y):
            if not x or not y:
                return 0.0 if x else 1.0
            return len(low(x) & y) / len(low(x)) if low(x) else 1.0 if x == y else None

        out[d] = (len(t), hashlib.sha256(e.encode()).hexdigest(), like(a, b), like(a, c), held(a, b), held(a, c))
    return out


@pytest.mark.parametrize("rows_in_range", [500, 7, 1])
def test_equals_brute_force(spark, monkeypatch, rows_in_range):
    monkeypatch.setattr(op, "RANGE_ROWS", rows_in_range)
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["alpha", "béta", "γ", "delta", "x"], n)) for n in rng.integers(0, 300, 60)]
    texts += [None, "", "z", texts[0], "long " * 20000, "🙂" * 9]
    rows = [(int(i), t, "clash", "clash") for i, t in zip(rng.permutation(500)[: len(texts)] - 50, texts, strict=True)]
    got = op.fingerprint_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.contained_in_edited, r.contained_in_next) for r in got} == brute(rows)
    for r, (_, t, *_) in zip(sorted(got, key=lambda r: r.doc_id), sorted(rows), strict=True):
        assert r.fingerprint == op.encode(op.sketch(t))


def test_ties_nulls_and_small_tables(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "d e f g h i"), (None, "n"), (None, None)]
    got = op.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "1", "None", "None"]
    one = op.fingerprint_documents(spark.createDataFrame([(5, "p q r s t u v")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(5, 1.0)]
    assert op.fingerprint_documents(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("scale", [1, 2, 16])
def test_one_fraction_at_every_length(scale):
    """Texts of 1 to 3,000 shingles keep just what lies below the fraction, and a text that grows loses nothing."""
    words = [f"w{i}" for i in np.random.default_rng(9).integers(0, 10**6, 3004)]
    before = set()
    for n in [*range(1, 60), 200, 1023, 1024, 1025, 1026, 3004]:
        text = " ".join(words[:n])
        x = op.sketch(text, scale)
        assert set(x.hashes.tolist()) == kept(text, scale)
        if n >= 5:  # shorter texts have one shingle of their own
            assert before <= set(x.below.tolist())
            before = set(x.below.tolist())
    assert abs(len(before) - 3000 / scale) < 4 * (3000 / scale) ** 0.5 + 1


def same(a, b):
    return a.scale == b.scale and np.array_equal(a.hashes, b.hashes)


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(0)
    a = [f"w{i}" for i in rng.integers(0, 10**6, 20000)]
    small, large = " ".join(a[:4000]), " ".join(a)
    x, y = op.sketch(small), op.sketch(large)
    assert op.containment(x, y) == 1 and abs(op.resemblance(x, y) - 0.2) < 0.02
    half = op.sketch(" ".join(a[2000:6000]))
    assert abs(op.containment(x, half) - 0.5) < 0.04
    for t in (small, "a b", "", None):
        assert same(op.decode(op.encode(op.sketch(t))), op.sketch(t))


def test_containment_of_very_unequal_texts():
    """A few words inside thousands: 1 or undefined, never an invented 0; and 0 where they are not inside."""
    rng = np.random.default_rng(1)
    found = {True: [], False: []}
    for k in range(400):
        words = [f"w{i}" for i in rng.integers(0, 10**6, 2008)]
        at = int(rng.integers(2000))
        inside = bool(k % 2)
        piece = words[at : at + 8] if inside else [f"v{i}" for i in range(k, k + 8)]
        found[inside].append(op.containment(op.sketch(" ".join(piece)), op.sketch(" ".join(words))))
    for inside, share in ((True, 1.0), (False, 0.0)):
        assert set(found[inside]) <= {share, None} and found[inside].count(None) < 30


def test_sketches_merge():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 6000)]
    for sizes in ((1, 9), (6, 7), (300, 500), (900, 3000), (3000, 2500)):
        first, second = words[: sizes[0] + 4], words[sizes[0] : sizes[0] + sizes[1]]  # all shingles of the whole
        for scale in (1, 2, 64):
            assert same(op.merge(op.sketch(" ".join(first), scale), op.sketch(" ".join(second), scale)), op.sketch(" ".join(words[: sizes[0] + sizes[1]]), scale))
    with pytest.raises(ValueError):
        op.merge(op.sketch("a", 4), op.sketch("a", 8))


def test_short_texts():
    """Equal ones have likeness 1 and unlike ones 0, also where no hash lies below the threshold."""
    for k in range(50):
        a, b = op.sketch(f"only{k} words", 64), op.sketch(f"other{k}", 64)
        assert op.resemblance(a, op.sketch(f"only{k}  words", 64)) == 1 and op.resemblance(a, b) == 0
        assert op.resemblance(a, op.sketch("", 64)) == 0 and op.containment(op.sketch(None, 64), a) == 1 and op.containment(a, op.sketch("", 64)) == 0
