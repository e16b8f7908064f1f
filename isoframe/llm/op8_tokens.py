"""Token counts by trie-shared dynamic programming over a unigram vocabulary.

A document is a sequence of pre-tokens, its words between ASCII white space, each with a leading space mark. The unigram
score of a pre-token is that of its best segmentation into vocabulary pieces. The forward score of a prefix does not
depend on what follows, so the distinct pre-tokens of a stretch of input go into one trie, each node's forward score is
computed once for all words below it, and terminals keep their token counts. The pieces come from a public tokenizer
file, as they are; their probabilities are counted over all documents: how often the file's own tokenizer uses each piece
in their words.
"""

from __future__ import annotations

import gc
import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.llm.common import map_arrow, read_table

TOKENIZER = "piece_bpe_32k.model"
MARK = "▁"
#: Nodes at which a task starts a new trie: bounds its memory, and costs no result.
TRIE_NODES = 400_000
#: Prefixes are shared up to this many characters; what a longer word goes on with is scored from there.
DEPTH = 64
#: Distinct words that a task counts before it passes the counts on.
COUNTED_WORDS = 200_000
#: Scores are whole numbers, this many to one unit of log probability, and carry the number of tokens in their low part.
UNIT = 1 << 20
ONE = 1 << 24


class Vocabulary:
    """Pieces with whole-number scores; characters without a piece cost their bytes."""

    def __init__(self, pieces: list[tuple[str, float]], byte_score: float):
        self.score = {p: round(s * UNIT) * ONE - 1 for p, s in pieces if p}
        self.byte = round(byte_score * UNIT) * ONE - 1
        self.single: dict[str, int] = {}
        self.ends: dict = {}  # pieces, read backwards, as nested dictionaries; None leads to the score
        for p, s in self.score.items():
            at = self.ends
            for c in reversed(p):
                at = at.setdefault(c, {})
            at[None] = s

    def one(self, c: str) -> int:
        """The best score of a single character: its piece, or its bytes."""
        found = self.single.get(c)
        if found is None:
            found = self.byte * len(c.encode())
            if c in self.score:
                found = max(found, self.score[c])
            self.single[c] = found
        return found

    def forward(self, text: str, scores: list[int], known: int) -> list[int]:
        """Extend the forward scores of text[:known] (one more than known, the first 0) to the whole text."""
        single, ends = self.single, self.ends
        for i in range(known, len(text)):
            c = text[i]
            s = single.get(c)
            best = scores[i] + (self.one(c) if s is None else s)
            at, j = ends.get(c), i - 1
            while at is not None and j >= 0:
                at = at.get(text[j])
                if at is None:
                    break
                piece = at.get(None)
                if piece is not None:
                    s = scores[j] + piece
                    if s > best:
                        best = s
                j -= 1
            scores.append(best)
        return scores


def tokens_of(score: int) -> int:
    """The number of tokens that a forward score carries."""
    return -score % ONE


@lru_cache(maxsize=2)
def _tokenizer(name: str):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=public_tokenizers.path(name))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each distinct word occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(_words(text))
                if len(seen) > COUNTED_WORDS:
                    yield out()
                    seen.clear()
        yield out()

    return map_arrow(docs.select("text"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def piece_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> dict[int, int]:
    """How often the file's tokenizer uses each piece over all documents: as many numbers as the file has pieces, at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            words = [w.decode() for w in batch.column(0).to_pylist()]
            for ids, n in zip(_tokenizer(tokenizer).encode(words, num_threads=1), batch.column(1).to_pylist(), strict=True):
                for i in ids:
                    seen[i] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["piece", "n"])

    found = map_arrow(word_counts(docs), run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    return {r["piece"]: r["n"] for r in found}


@lru_cache(maxsize=2)
def _vocabulary(name: str, counts: tuple[tuple[int, int], ...]) -> Vocabulary:
    model, seen = _tokenizer(name), dict(counts)
    size = model.get_piece_size()
    total = math.log(sum(seen.values()) + size)
    single = [i for i in range(size) if model.is_byte(i)]
    normal = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    # All bytes cost alike, as much as the rarest piece or more.
    byte = math.log(1 + min((seen.get(i, 0) for i in single), default=0)) - total
    return Vocabulary([(model.id_to_piece(i), math.log(1 + seen.get(i, 0)) - total) for i in normal], byte)


def vocabulary(counts: dict[int, int], name: str = TOKENIZER) -> Vocabulary:
    """The pieces of a public tokenizer file with log probabilities by their counts, one added to each."""
    return _vocabulary(name, tuple(sorted(counts.items())))


class WordTrie:
    """Counts tokens of words; the words inserted share the forward scores of their common prefixes."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.nodes = 1
        self.counts: dict[str, int] = {}
        # A node holds its children by character, under None the forward score of its prefix.
        self.root: dict = {None: 0}

    def count(self, word: str) -> int:
        found = self.counts.get(word)
        if found is not None:
            return found
        text = MARK + word
        node, scores = self.root, [0]
        for i, c in enumerate(text[:DEPTH]):
            after = node.get(c)
            if after is None:
                head = text[:DEPTH]
                self.vocab.forward(head, scores, i)
                for k in range(i, len(head)):
                    node[head[k]] = node = {None: scores[k + 1]}
                self.nodes += len(head) - i
                break
            scores.append(after[None])
            node = after
        if len(text) > DEPTH:
            return tokens_of(self.vocab.forward(text, scores, DEPTH)[-1])
        found = self.counts[word] = tokens_of(scores[-1])
        return found


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, counts: dict[int, int] | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_tokens.

    counts: of pieces, to score them by; those of docs if None, where repeated rows count as often as they occur.
    Null, empty and blank texts have 0 of both. Of segmentations that score alike the one with fewest tokens counts.
    Repeated rows and a null doc_id keep their rows. Other columns of docs are neither read nor returned. An empty table
    gives no rows.
    """

    known = tuple(sorted((piece_counts(docs, tokenizer) if counts is None else counts).items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = WordTrie(_vocabulary(tokenizer, known))
        # A trie has no cycles: its nodes are freed by reference counts, and walks over them by the collector are pure cost.
        collects = gc.isenabled()
        gc.disable()
        try:
            for batch in batches:
                words_of, tokens = [], []
                for text in batch.column(1).to_pylist():
                    words = _words(text)
                    words_of.append(len(words))
                    tokens.append(sum(trie.count(w.decode()) * n for w, n in Counter(words).items()))
                    if trie.nodes > TRIE_NODES:
                        trie.clear()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words_of, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])
        finally:
            if collects:
                gc.enable()

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text")), run, "doc_id long, n_words long, n_tokens long")


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table, counted."""
    return count_tokens(read_table(spark, sf_dir, "documents"))
