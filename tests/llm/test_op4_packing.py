import os
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from isoframe.llm.op4_packing import CAPACITY, best_fit, pack, plan, reduce_by_dominance, token_ids

SCHEMA = "doc_id long, text string, piece string, length string"


def held(patterns):
    out = Counter()
    for p, n in patterns:
        for w in p:
            out[w] += n
    return out


def optimum(items, capacity):
    """Fewest bins, by trying partitions of a few items."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for r in set(rooms):
            if r >= items[i]:
                rest = list(rooms)
                rest.remove(r)
                go(i + 1, [*rest, r - items[i]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


def lower_bound(counts, k):
    """The bound L2 of Martello and Toth for one threshold."""
    large = sum(n for w, n in counts.items() if w > CAPACITY - k)
    middle = sum(n for w, n in counts.items() if CAPACITY / 2 < w <= CAPACITY - k)
    room = middle * CAPACITY - sum(w * n for w, n in counts.items() if CAPACITY / 2 < w <= CAPACITY - k)
    small = sum(w * n for w, n in counts.items() if k <= w <= CAPACITY / 2)
    return large + middle + max(0, -(-(small - room) // CAPACITY))


@pytest.mark.parametrize("seed", range(60))
def test_reduction_keeps_the_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 20, 50])
    low = rng.choice([1, capacity // 5, capacity // 4])
    items = [rng.randint(low, capacity) for _ in range(rng.randint(1, 10))]
    fixed, left = reduce_by_dominance(dict(Counter(items)), capacity)
    assert held(fixed) + Counter(left) == Counter(items)
    assert all(sum(p) <= capacity for p, _ in fixed)
    rest = list(Counter(left).elements())
    assert sum(n for _, n in fixed) + (optimum(rest, capacity) if rest else 0) == optimum(items, capacity)


@pytest.mark.parametrize("seed", range(20))
def test_best_fit_equals_one_by_one(seed):
    rng = random.Random(seed)
    items = [rng.randint(1, 40) for _ in range(400)]
    rooms = []
    for w in sorted(items, reverse=True):
        fit = min((r for r in rooms if r >= w), default=None)
        if fit is None:
            rooms.append(40 - w)
        else:
            rooms.remove(fit)
            rooms.append(fit - w)
    patterns = best_fit(dict(Counter(items)), 40)
    assert held(patterns) == Counter(items)
    assert sum(n for _, n in patterns) == len(rooms)
    assert all(sum(p) <= 40 for p, _ in patterns)


def test_plan_of_large_counts_is_near_the_bound():
    rng = np.random.default_rng(0)
    counts = {int(w): int(n) for w, n in zip(range(1, 2049), rng.integers(0, 100000, 2048), strict=True)}
    patterns = plan(counts)
    bound = max(lower_bound(counts, k) for k in range(0, CAPACITY // 2 + 1, 16))
    assert held(patterns) == Counter({w: n for w, n in counts.items() if n})
    assert sum(n for _, n in patterns) <= 1.002 * bound


def _tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_the_tokenizer_file():
    t = _tokenizer()
    texts = ["", "A b  c\n\n d'll 12345 ééß 你好 🙂‍", "x<|endoftext|>y", " " * 5000 + "z", "a" * 3000, "\t\r\n mixed space"]
    for x in texts:
        assert token_ids(x).tolist() == [*t.encode(x, add_special_tokens=False).ids, 0]


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=200) | st.text(alphabet=" \t\n\r\x0b\x0c\x1c\x85\xa0\u2003\u2028'sStTlLdDmM12٣½ⅣéÉßǅ\u0301你🙂\u200d!?.,_-", max_size=80))
def test_ids_of_any_text_are_those_of_the_tokenizer_file(text):
    assert token_ids(text).tolist() == [*_slow.encode(text, add_special_tokens=False).ids, 0]


_slow = _tokenizer()


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/documents.parquet"), reason="no tables")
def test_ids_of_the_documents_table_are_those_of_the_tokenizer_file():
    import pyarrow.parquet as pq

    for text in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist():
        assert token_ids(text).tolist() == [*_slow.encode(text or "", add_special_tokens=False).ids, 0]


def test_round_trip(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["the", "of", "zzq", "é"], n)) for n in rng.integers(0, 900, 80)]
    texts += [None, "", "word " * 12000, texts[0], texts[0]]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(None, "null id", None, None), (0, texts[0], "", "")]
    got = pack(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids, times = token_ids(t), 2 if i == 0 else 1
        own = sorted(by[i], key=lambda r: r.piece)
        assert sum(r.length for r in own) == times * len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            assert r.length <= CAPACITY and (r.piece == 0 or r.length == CAPACITY)
    assert len(by[None]) == 1
    at = defaultdict(list)
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= CAPACITY
    assert len(at) <= -(-sum(r.length for r in got) // CAPACITY) + 1


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pairs_helper_agrees_with_brute_force():
    from isoframe.llm.op4_packing import _largest_pair

    rng = random.Random(3)
    for _ in range(200):
        items = [rng.randint(1, 12) for _ in range(rng.randint(2, 8))]
        w, room = rng.choice(items), rng.randint(1, 20)
        others = list(items)
        others.remove(w)
        want = max((a + b for a, b in combinations(others, 2) if a + b <= room), default=0)
        left = Counter(items)
        assert _largest_pair(sorted(left), left, w, room) == want
