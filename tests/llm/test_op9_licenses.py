import random

import numpy as np
import pytest

from isoframe.llm.op9_licenses import BANDS, CONTAINMENT, TEMPLATES, Index, band_hash, fold, hits, scan, scan_documents

SCHEMA = "doc_id long, text string, licenses string, containment string"


def grams(text):
    w = fold(text)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(texts):
    """Every window of two class sizes, from every multiple of the class size, by tuples of words."""
    out = []
    for t in texts:
        h, found = grams(t), {}
        for name, body in TEMPLATES.items():
            want = set(grams(body))
            n = 1 << (len(grams(body)) - 1).bit_length()
            shares = {s: len(want & set(h[s : s + 2 * n])) / len(want) for s in range(0, len(h), n)}
            if max(shares.values(), default=0) >= CONTAINMENT:
                found[name] = {s: x for s, x in shares.items() if x >= CONTAINMENT}
        out.append(found)
    return out


def corpus():
    rng = random.Random(0)
    vocab = [f"w{i}é" for i in range(300)]
    texts = []
    for k in range(160):
        words = rng.choices(vocab, k=rng.randint(0, 250))
        for _ in range(rng.choice([0, 1, 2])):
            body = rng.choice(list(TEMPLATES.values())).split()
            if k % 3 == 0 and len(body) > 30:  # edited, near the limit or beyond it
                for _ in range(rng.randint(0, 2)):
                    body[rng.randrange(len(body))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() if k % 5 == 0 else w for w in body]
        texts.append(" ".join(words))
    return texts


def test_finds_what_brute_force_finds_in_any_batch():
    texts = corpus()
    index = Index(TEMPLATES)
    want = brute(texts)
    assert sum(map(len, want)) > 100
    for rows in (1, 7, 500):
        got = [{index.names[i]: {x.first: x.share for x in f[i]} for i in f} for at in range(0, len(texts), rows) for f in hits(index, texts[at : at + rows])[1]]
        assert got == want


def test_variants_are_told_apart():
    index = Index(TEMPLATES)
    two, three = TEMPLATES["BSD-2-Clause notice"], TEMPLATES["BSD-3-Clause notice"]
    names = lambda t: {index.names[i] for i in scan(index, [t])[0]}
    assert names(two) == {"BSD-2-Clause notice"} and names(f"{two} 3. {three}") == {"BSD-3-Clause notice"}
    assert names("This project is licensed under the MIT license, see LICENSE.") == {"MIT wording"}
    assert names(TEMPLATES["AGPL notice"]) == {"AGPL notice"} and names(TEMPLATES["GPL notice"]) == {"GPL notice"}


def test_notices_at_different_places_are_all_reported():
    """What is near or alike settles by place: another notice far away, or next to it, hides none."""
    index = Index(TEMPLATES)
    names = lambda *parts: {index.names[i] for i in scan(index, [" ".join(parts)])[0]}
    rng = random.Random(1)
    other = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400))
    gpl, lgpl, agpl = (TEMPLATES[f"{x} notice"] for x in ("GPL", "LGPL", "AGPL"))
    words = lgpl.split()
    words[len(words) // 2] = "changed"
    edited = " ".join(words)
    assert names(edited) == {"LGPL notice"}
    for between in (other, "", "x"):
        assert names(gpl, between, edited) == names(edited, between, gpl) == {"GPL notice", "LGPL notice"}
        assert names(gpl, between, edited, between, agpl) == {"GPL notice", "LGPL notice", "AGPL notice"}
    two, three = TEMPLATES["BSD-2-Clause notice"], TEMPLATES["BSD-3-Clause notice"]
    assert names(two, other, "3.", three) == names("3.", three, other, two) == {"BSD-2-Clause notice", "BSD-3-Clause notice"}
    assert names(two, "3.", three, other) == {"BSD-3-Clause notice"}
    assert names(two, other, two, "3.", three) == {"BSD-2-Clause notice", "BSD-3-Clause notice"}


def test_bands_collide_nearly_always():
    rng = np.random.default_rng(0)
    missed = 0
    for _ in range(2000):
        a = rng.integers(0, 1 << 63, 5).astype(np.uint64)
        window = np.concatenate([a[:4], rng.integers(0, 1 << 63, 12).astype(np.uint64)])
        missed += not any(band_hash(a, k).min() == band_hash(window, k).min() for k in range(BANDS))
    assert missed <= 4


def test_documents(spark):
    line = TEMPLATES["MIT line"]
    rows = [(1, f"a b c {line} d e", "clash", "clash"), (2, None, "", ""), (3, "", "", ""), (4, "three words only", "", ""), (5, "long " * 90000 + line, "", ""), (None, line, "", ""), (1, f"a b c {line} d e", "", "")]
    got = scan_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.n_licenses, r.licenses, r.containment) for r in got) == sorted([("1", 1, "MIT line", 1.0), ("1", 1, "MIT line", 1.0), ("2", 0, "", 0.0), ("3", 0, "", 0.0), ("4", 0, "", 0.0), ("5", 1, "MIT line", 1.0), ("None", 1, "MIT line", 1.0)])
    assert scan_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_short_templates_are_refused():
    with pytest.raises(ValueError):
        Index({"x": "All rights reserved."})
