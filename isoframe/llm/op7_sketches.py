"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash range, 1/SCALE, whatever the length of the
text; so two sketches of whatever sizes keep the same hashes of what their texts share. Sketches merge by union, and
containment and resemblance are ratios of counts. A text none of whose hashes lies below keeps its least one, so that it is
told from an empty text and from others like it; a merge drops that where the other sketch has any below. Such a sketch is
no evidence of how much a longer text contains: that is undefined.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.llm.common import map_arrow, read_table

SHINGLE_WORDS = 5
#: Sketches keep the hashes below 1/SCALE of the range.
SCALE = 2
SEED = 42
#: Rows in one range of doc_id, and the most ranges there are.
RANGE_ROWS, MOST_RANGES = 500, 20_000


def shingle_hashes(text: str | None, n: int = SHINGLE_WORDS) -> np.ndarray:
    """64-bit hashes of the n-word shingles (fewer words: of all; no word: none), in text order, repeats included."""
    return hash_words((text or "").encode().split(), n)


def hash_words(words: list[bytes], n: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of the n-word shingles of a list of words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w, SEED) for w in words], np.uint64)
    if not len(h):
        return h
    n = min(n, len(h))
    mixed = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        mixed = (mixed + h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ mixed >> np.uint64(32)


@dataclass(frozen=True)
class Sketch:
    """Sorted distinct hashes below 1/scale of the range or, where there are none, the least one of the text, if any."""

    hashes: np.ndarray
    scale: int = SCALE

    @property
    def below(self) -> np.ndarray:
        """The hashes below the threshold."""
        return self.hashes[self.hashes <= np.uint64((1 << 64) // self.scale - 1)]


def _of(hashes: np.ndarray, scale: int) -> Sketch:
    below = Sketch(hashes, scale).below
    return Sketch(below if len(below) else hashes[:1], scale)


def sketch(text: str | None, scale: int = SCALE) -> Sketch:
    return _of(np.unique(shingle_hashes(text)), scale)


def _like(a: Sketch, b: Sketch) -> None:
    if a.scale != b.scale:
        raise ValueError("sketches of different scales")


def merge(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of the union of what two sketches stand for."""
    _like(a, b)
    return _of(np.union1d(a.hashes, b.hashes), a.scale)


def resemblance(a: Sketch, b: Sketch) -> float:
    """Estimated Jaccard likeness; 1 for two empty sketches. Without hashes below the threshold on either side, whether the least are equal."""
    _like(a, b)
    x, y = (a.below, b.below) if len(a.below) + len(b.below) else (a.hashes, b.hashes)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def containment(a: Sketch, b: Sketch) -> float | None:
    """Estimated share of a's shingles that b has; 1 for an empty a, 0 in an empty b, None where no hash of a lies below the threshold."""
    _like(a, b)
    if not len(a.hashes):
        return 1.0
    if not len(b.hashes):
        return 0.0
    x = a.below
    return len(np.intersect1d(x, b.hashes, assume_unique=True)) / len(x) if len(x) else 1.0 if np.array_equal(a.hashes, b.hashes) else None


def encode(a: Sketch) -> str:
    """The scale and the hashes in base 64."""
    return f"{a.scale}:{base64.b64encode(a.hashes.astype('<u8').tobytes()).decode()}"


def decode(s: str) -> Sketch:
    head, body = s.split(":")
    return Sketch(np.frombuffer(base64.b64decode(body), "<u8").astype(np.uint64), int(head))


def edited(text: str, following: str) -> str:
    """The text with its last third of code points replaced by the first as many of the following text."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def with_next(docs: DataFrame) -> DataFrame:
    """(range, guest, doc_id, tie, text) in order within ranges of falling doc_id, each range ended by the first of the next one.

    Ranges come from quantiles of the ids alone; only the first row of each range is sent twice. A null doc_id comes last;
    rows with one doc_id are ordered by a hash of their text.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    total = ids.count()
    ranges = max(1, min(MOST_RANGES, total // RANGE_ROWS))
    cuts = np.unique(np.array(ids.where("doc_id is not null").approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else [], np.float64).astype(np.int64))

    def range_of(column: pa.Array) -> np.ndarray:
        missing = column.is_null().to_numpy(zero_copy_only=False)
        at = len(cuts) - np.searchsorted(cuts, column.fill_null(0).to_numpy(zero_copy_only=False), "right")
        return np.where(missing, len(cuts) + 1, at).astype(np.int32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(range_of(batch.column(0))), batch.column(0)], names=["range", "doc_id"])

    # One row for each range, MOST_RANGES + 1 at most.
    firsts = sorted((r["range"], r["first"]) for r in map_arrow(ids, deal, "range int, doc_id long").groupBy("range").agg(F.max("doc_id").alias("first")).collect())
    before = {now[0]: firsts[i - 1][0] for i, now in enumerate(firsts)}
    first = {k: v for k, v in firsts}
    tie = F.xxhash64("text")
    null_tie = docs.where("doc_id is null").agg(F.min(tie)).first()[0] if len(cuts) + 1 in first else None

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = range_of(batch.column(0))
            twice = [i for i, (k, d, t) in enumerate(zip(own.tolist(), batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)) if d == first[k] and (d is not None or t == null_tie)]
            for rows, guest in ((None, False), (twice, True)):
                part = batch if rows is None else batch.take(pa.array(rows, pa.int64()))
                at = own if rows is None else np.array([before[k] for k in own[rows].tolist()], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), guest)), *part.columns], names=["range", "guest", "doc_id", "tie", "text"])

    sent = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), tie.alias("tie"), F.coalesce("text", F.lit("")).alias("text")), send, "range int, guest boolean, doc_id long, tie long, text string")
    return sent.repartition("range").sortWithinPartitions(F.col("range"), F.col("guest"), F.col("doc_id").desc_nulls_last(), F.col("tie"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    contained_in_edited, contained_in_next (null where undefined).

    A null text counts as empty. The next document is the one with the next smaller doc_id (after the least: the
    greatest); rows with one doc_id follow each other by a hash of their text, those with a null doc_id come last. A
    table of one row is its own next. Other columns of docs are neither read nor returned. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def row(now, then) -> tuple:
            changed = edited(now[3], then[3])
            other = sketch(changed)
            return now[1], len(now[3]), hashlib.sha256(changed.encode()).hexdigest(), encode(now[4]), encode(other), resemblance(now[4], other), resemblance(now[4], then[4]), containment(now[4], other), containment(now[4], then[4])

        for batch in batches:
            out = []
            for k, guest, doc_id, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                now = (k, doc_id, guest, text, sketch(text))
                if held is not None and held[0] == k and not held[2]:
                    out.append(row(held, now))
                held = now
            cols = list(zip(*out, strict=True)) or [()] * 9
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_in_edited", "contained_in_next"])

    return map_arrow(with_next(docs), run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_in_edited double, contained_in_next double")


def op7_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table, fingerprinted."""
    return fingerprint_documents(read_table(spark, sf_dir, "documents"))
