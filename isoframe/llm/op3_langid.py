"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds every substring of a sample of its labelled text. A document is parsed from
left to right into the longest pieces that the sample contains; each such phrase costs about log2(sample length) bits,
so phrases x log2(sample) / characters estimates the document's cross-entropy against the language (Ziv and Merhav,
1993). The language with the least wins. Samples and documents alike are reduced to lower-case letters and spaces.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.llm.common import crc_mod, map_arrow, read_table

HELD_OUT, HELD_OUT_REST = 3, 1
UNKNOWN = "und"
#: Characters of the sample of one language, at most, and the documents it is drawn from, about; of a document an eighth of
#: the sample or more where there are fewer than eight.
SAMPLE_CHARS, SAMPLE_DOCS, PIECES = 64_000, 120, 8
LETTER = regex.compile(r"\p{L}")
NO_LETTERS = re.compile(r"[\W\d_]+")
#: A parse that is this many bits behind the best can stop: its odds are below what a double can add to 1.
BITS_BEHIND = 600.0
HEAD = 160


def plain(text: str) -> str:
    """Lower case, and one space for each run of other characters than letters: digits and symbols tell no language."""
    return NO_LETTERS.sub(" ", text.lower())


class Node(dict):
    """A state of a suffix automaton under construction: the next characters lead to states."""

    __slots__ = ("length", "link")


def suffix_automaton(text: str) -> dict:
    """The start of the minimal automaton of all substrings of a text, built online, as nested plain dictionaries."""
    root = Node()
    root.length, root.link = 0, None
    last = root
    for c in text:
        new = Node()
        new.length = last.length + 1
        p = last
        while p is not None and c not in p:
            p[c] = new
            p = p.link
        if p is None:
            new.link = root
        elif p[c].length == p.length + 1:
            new.link = p[c]
        else:
            q = p[c]
            split = Node(q)
            split.length, split.link = p.length + 1, q.link
            q.link = new.link = split
            while p is not None and p.get(c) is q:
                p[c] = split
                p = p.link
        last = new
    # Parsing needs the transitions alone; plain dictionaries are smaller and faster to follow.
    plain_of: dict[int, dict] = {id(root): {}}
    todo = [root]
    while todo:
        node = todo.pop()
        for c, after in node.items():
            if id(after) not in plain_of:
                plain_of[id(after)] = {}
                todo.append(after)
            plain_of[id(node)][c] = plain_of[id(after)]
    return plain_of[id(root)]


def phrases(root: dict, text: str, most: float = math.inf) -> int:
    """Number of longest matches that a text parses into; a character that the sample lacks is a phrase.

    The parse ends early once there are more than `most`.
    """
    n = 0
    at = root
    for c in text:
        after = at.get(c)
        if after is None:
            if at is not root:
                n += 1
                after = root.get(c)
            if after is None:
                n += 1
                after = root
            if n > most:
                return n
        at = after
    return n + (at is not root)


@lru_cache(maxsize=2)
def _automata(samples: tuple[tuple[str, str], ...]) -> list[tuple[str, dict, float]]:
    return [(lang, suffix_automaton(text), math.log2(len(text) + 1)) for lang, text in samples]


def predict(samples: tuple[tuple[str, str], ...], text: str | None) -> tuple[str, float]:
    """(language, score) of a text; UNKNOWN with score 0 where it has no letter or nothing was learnt."""
    if not samples or not text or not LETTER.search(text):
        return UNKNOWN, 0.0
    low = plain(text)
    # The likeliest by the head of the text is parsed first, so that the others can stop early.
    order = sorted(_automata(samples), key=lambda a: phrases(a[1], low[:HEAD]) * a[2])
    bits, best = [], math.inf
    for lang, root, cost in order:
        bits.append((phrases(root, low, (best + BITS_BEHIND) / cost) * cost, lang))
        best = min(best, bits[-1][0])
    # Odds of the languages at a tenth of the bits, since phrases of one document are not independent.
    return min(bits)[1], 1 / sum(2 ** (max(-500.0, (best - b) / 10)) for b, _ in bits)


def learn(docs: DataFrame, sample_chars: int = SAMPLE_CHARS) -> tuple[tuple[str, str], ...]:
    """Samples of the languages of labelled rows outside the held-out fold.

    A hash of the text draws about SAMPLE_DOCS different texts of each language (all, where there are no more), of which
    pieces from the start are joined up to sample_chars. What is collected is bounded by the number of languages. Rows
    without letters or a language teach nothing; repeated texts teach once.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text", "lang")
    known = known.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}") & (crc_mod("doc_id", HELD_OUT) != HELD_OUT_REST))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return ()
    draw = F.pmod(F.xxhash64("h", F.lit("language sample")), F.lit(1 << 30))
    # Twice as many where there are many: an estimated count must not leave a language without a text.
    limit = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(int(min(1.0, 2 * SAMPLE_DOCS / n) * (1 << 30)))) for lang, n in counts.items()], F.lit(0))
    # Of a language with many texts an eighth of the sample is used of each at most; four times as much is room for what plain() leaves out.
    many = [lang for lang, n in counts.items() if n >= 2 * PIECES]
    length = F.when(F.col("lang").isin(many), F.lit(4 * sample_chars // PIECES)).otherwise(F.lit(2 * sample_chars))
    drawn = known.where(draw < limit).select("lang", draw.alias("draw"), "h", F.substring("text", F.lit(1), length).alias("text"))
    rows = drawn.groupBy("lang", "draw", "h").agg(F.first("text").alias("text")).groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("draw", "h", "text"))), 1, SAMPLE_DOCS).alias("own")).collect()
    out = []
    for lang, own in sorted((r["lang"], r["own"]) for r in rows):
        piece = sample_chars // max(1, min(PIECES, len(own)))
        text = " ".join(plain(r["text"])[:piece] for r in own)[:sample_chars]
        if LETTER.search(text):
            out.append((lang, text))
    return tuple(out)


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...]) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score (0 to 1).

    Null texts and texts without a letter are UNKNOWN with score 0; ties go to the language first by code point. Repeated
    rows and a null doc_id keep their rows (a null doc_id is not held out). The columns lang and source are not read, nor
    are others. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict(samples, t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array(np.array([s for _, s in found], float))], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(crc_mod("doc_id", HELD_OUT) == HELD_OUT_REST, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", held.alias("held_out"), "text")
    return map_arrow(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table, identified by samples of its labelled rows."""
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
