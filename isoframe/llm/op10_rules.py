"""Quality rules as a short-circuit cascade.

The rules, base rules included, are an AND, so their order changes the work and never the verdict: each rule's cost and
rejection rate are measured on a hash sample, the rules run in order of rejections per second, and a document that one
rule rejects meets no later one. Counts are worked out when a rule first asks for them.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.llm.common import map_arrow, read_table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
#: Documents whose rule costs and rejections set the order, as expected number.
SAMPLE_ROWS = 2000
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"


class Page:
    """A text, its words and counts, each worked out when a rule first asks for it."""

    def __init__(self, text: str, words: list[bytes] | None = None):
        self.text = text
        if words is not None:
            self.words = words

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeat_words(self.words)

    @property
    def base_failed(self) -> bool:
        return any(rule(self) for rule in BASE.values())


def repeat_words(words: list[bytes], n: int = WINDOW) -> int:
    """Words inside n-word windows that occur twice or more in the text, the first occurrence included."""
    if len(words) <= n:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(number) == len(words):
        return 0
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    key = ids[: len(ids) - n + 1]
    for k in range(1, n):  # number the k+1-word windows from the numbers of the k-word ones
        key = key * len(number) + ids[k : len(ids) - n + 1 + k]
        _, key = np.unique(key, return_inverse=True)
    twice = np.bincount(key)[key] > 1
    inside = np.zeros(len(ids), bool)
    for k in range(n):
        inside[k : len(ids) - n + 1 + k] |= twice
    return int(inside.sum())


CAPITALS = re.compile(r"[A-Z]")


def _capital_words(p: Page) -> bool:
    if not CAPITALS.search(p.text):
        return False
    words = [w.decode() for w in p.words]
    return 10 * sum(w == w.upper() and w != w.lower() for w in words) > 3 * len(words)


def _wordless(p: Page) -> bool:
    """Words without a letter of a basic alphabet, of any accent or script beyond ASCII."""
    return 10 * sum(1 for w in p.words if w.isascii() and not re.search(rb"[A-Za-z]", w)) > 4 * len(p.words)


#: The base rules, and those of the method's verdict: each rejects, by name.
BASE: dict[str, Callable[[Page], bool]] = {
    "few_words": lambda p: len(p.words) < MIN_WORDS,
    "mostly_repeats": lambda p: 100 * p.n_repeat_words > MAX_REPEAT_PERCENT * len(p.words),
}
RULES: dict[str, Callable[[Page], bool]] = {
    "symbols": lambda p: 10 * p.n_symbols > len(p.words),
    "exclamations": lambda p: 10 * p.text.count("!") > len(p.words),
    "repeated_lines": lambda p: 10 * p.n_dup_lines > 4 * len(p.lines),
    "repeated_windows": lambda p: 10 * p.n_repeat_words > 4 * len(p.words),
    "capital_words": _capital_words,
    "wordless": _wordless,
    "word_length": lambda p: not 2 * len(p.words) <= p.word_chars <= 14 * len(p.words),
}


def measure(docs: DataFrame, rules: dict[str, Callable[[Page], bool]] | None = None, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules by falling rejections per second on a hash sample of the documents.

    A rule's cost is that of all it asks for but the words, which nearly every rule needs.
    """
    rules = BASE | RULES if rules is None else rules
    total = docs.select("doc_id").count()
    share = min(1.0, sample_rows / max(total, 1))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("rules")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("text")
    names = list(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judges = BASE | RULES
        spent = dict.fromkeys(names, (0.0, 0, 0))
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = Page(text or "").words
                for name in names:
                    p = Page(text or "", words)
                    t = time.perf_counter()
                    no = judges[name](p)
                    s = spent[name]
                    spent[name] = (s[0] + time.perf_counter() - t, s[1] + no, s[2] + 1)
        cols = [pa.array(names), *(pa.array([s[i] for s in spent.values()], k) for i, k in enumerate((pa.float64(), pa.int64(), pa.int64())))]
        yield pa.RecordBatch.from_arrays(cols, names=["rule", "seconds", "rejected", "seen"])

    rows = map_arrow(sample, run, "rule string, seconds double, rejected long, seen long").groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("r"), F.sum("seen").alias("n")).collect()
    # A rule that rejected nothing in the sample counts half a rejection, so that cheap ones still go first.
    rate = {r["rule"]: (r["r"] + 0.5) / (r["s"] + 1e-9) for r in rows}
    return sorted(names, key=lambda name: -rate.get(name, 0.0))


def apply_rules(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by.

    The counts are due for every row, so the cascade saves what the other rules cost; drop_rejected() saves the counts too.
    Null and empty texts have no words, so they fail the base rule. Words lie between ASCII white space. Repeated rows
    and a null doc_id keep their rows. Other columns of docs are neither read nor returned. An empty table gives no rows.
    """
    names = measure(docs, RULES) if order is None else order
    kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "rejected_by": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                p = Page(text or "")
                failed = p.base_failed
                by = "base" if failed else next((name for name in names if RULES[name](p)), None)
                rows.append((doc_id, len(p.words), p.word_chars, p.n_symbols, p.n_dup_lines, p.n_repeat_words, failed, by is None, by))
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], names=list(kinds))

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text")), run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string")


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table, judged. Which rule rejected a document depends on the measured order, so it is left out."""
    return apply_rules(read_table(spark, sf_dir, "documents")).drop("rejected_by")


def drop_rejected(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The rows of docs, all columns as they are, that the base rules and the others keep, as one cascade.

    Null, empty and wordless texts go. Repeated rows and a null doc_id are judged by their texts like any others. An empty
    table gives an empty one.
    """
    names = measure(docs) if order is None else order
    at = docs.columns.index("text")

    def passes(text: str | None) -> bool:
        p = Page(text or "")
        judges = BASE | RULES
        return not any(judges[name](p) for name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([passes(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT *, len(w) AS n, row_number() OVER () AS r,
    list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS wins
  FROM d
), p AS (
  SELECT r, unnest(wins) AS win, unnest(range(1, len(wins) + 1)) AS i FROM g
), t AS (
  SELECT r, i FROM p QUALIFY count(*) OVER (PARTITION BY r, win) > 1
), c AS (
  SELECT r, count(DISTINCT i + k) AS n FROM t, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
), b AS (
  SELECT doc_id, text, w, g.n AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM g LEFT JOIN c USING (r)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * (length(text) - length(replace(text, '!', ''))) > n_words
    OR 10 * n_dup_lines > 4 * n_lines OR 10 * n_repeat_words > 4 * n_words
    OR 10 * len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x))) > 3 * n_words
    OR 10 * len(list_filter(w, lambda x: NOT regexp_matches(x, '[A-Za-z]') AND strlen(x) = length(x))) > 4 * n_words
    OR word_chars < 2 * n_words OR word_chars > 14 * n_words) AS kept
FROM f
"""
