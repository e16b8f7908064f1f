import random
import re
from functools import lru_cache

from isoframe.llm import op8_tokens as op
from isoframe.llm.op8_tokens import DEPTH, MARK, Vocabulary, WordTrie, count_tokens, piece_counts, tokens_of, vocabulary

SCHEMA = "doc_id long, text string, n_words string, n_tokens string"


def brute(vocab, text):
    """Fewest tokens of the best segmentation, by trying every last piece."""

    @lru_cache(None)
    def best(i):
        if i == 0:
            return 0, 0
        options = []
        for j in range(i):
            piece = vocab.score.get(text[j:i])
            if piece is not None:
                s, n = best(j)
                options.append((s + (piece + 1) // op.ONE, n - 1))
        s, n = best(i - 1)
        size = len(text[i - 1].encode())
        options.append((s + size * ((vocab.byte + 1) // op.ONE), n - size))
        return max(options)

    return -best(len(text))[1]


def test_trie_equals_brute_force():
    rng = random.Random(0)
    for _ in range(30):
        pieces = list({"".join(rng.choices("abé", k=rng.randint(1, 4))): -rng.randint(1, 9) / 2 for _ in range(12)}.items()) + [(MARK, -1.0), (MARK + "a", -1.5)]
        vocab = Vocabulary(pieces, -6.0)
        trie = WordTrie(vocab)
        for _ in range(60):
            word = "".join(rng.choices("abéx", k=rng.choice([rng.randint(1, 12), DEPTH - 2, DEPTH - 1, DEPTH, DEPTH + 9])))
            assert trie.count(word) == brute(vocab, MARK + word)


def test_counts_of_documents(spark, monkeypatch):
    rng = random.Random(1)
    words = ["the", "internationalisation", "Straße", "naïve", "你好", "🙂", "a" * 200, "zq%x", "\x85odd\xa0"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(30)] + [None, "", " \n", "the " * 50000]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(0, texts[0], "", ""), (None, "the", "", "")]
    counts = piece_counts(spark.createDataFrame(rows, SCHEMA))
    vocab = vocabulary(counts)
    want = {i: (len(w), sum(brute(vocab, MARK + x) if len(x) < 100 else tokens_of(vocab.forward(MARK + x, [0], 0)[-1]) for x in w)) for i, t in list(enumerate(texts))[:-1] for w in [re.findall(r"[^\x20\x09-\x0D]+", t or "")]}
    for nodes in (400_000, 5):
        monkeypatch.setattr(op, "TRIE_NODES", nodes)
        got = count_tokens(spark.createDataFrame(rows, SCHEMA)).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id in want:
                assert (r.n_words, r.n_tokens) == want[r.doc_id]
        assert {r.doc_id: r.n_tokens for r in got}[len(texts) - 1] == 50000 * brute(vocab, MARK + "the")


def test_pieces_are_counted_over_all_documents(spark, monkeypatch):
    """Counts equal those of the tokenizer on every word, repeated rows as often as they occur."""
    from collections import Counter

    monkeypatch.setattr(op, "COUNTED_WORDS", 3)
    texts = ["the cat sat on the mat", "the internationalisation of naïve 你好 🙂", None, "", "zq%x\tthe\u00a0cat"] * 3
    want = Counter()
    for t in texts:
        for w in re.findall(r"[^\x20\x09-\x0D]+", t or ""):
            want.update(op._tokenizer(op.TOKENIZER).encode(w))
    assert piece_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)) == want
    often = {**want, max(want, key=want.get): 10**6}
    assert vocabulary(often).score != vocabulary(want).score


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], SCHEMA)).count() == 0
