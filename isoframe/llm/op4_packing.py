"""Packing documents into fixed-length sequences: dominance reduction, then best fit.

Lengths are whole numbers up to the capacity, so the instance is its histogram of lengths: at most `capacity` counts,
however many documents there are. The reduction and the fitting work on those counts and yield patterns with
multiplicities; the pieces themselves never leave the executors. Each piece gets a rank among the pieces of its length
(local rank in its input partition plus the pieces of earlier partitions), and its rank names its place.

Reduction (Martello and Toth, Knapsack Problems, 1990, ch. 8): for the longest remaining length w, with room r beside it,
  - nothing fits beside it: w alone dominates;
  - some piece is r long: the pair fills the sequence and dominates;
  - one more piece at most fits: the longest that fits dominates;
  - two more at most fit, and no pair of them exceeds the longest single that fits: that single dominates.
Such sets are fixed for good, the instance shrinks, and the rules run again until none applies. Best fit packs the rest.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isoframe.llm.common import cut, map_arrow, read_table

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k"
SEPARATOR_ID = 0
Pattern = tuple[int, ...]


@cache
def _encoders(name: str):
    """The tokenizer of the file, and a faster reader of the same vocabulary for texts without its special strings."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return slow, fast, [t.content for t in slow.get_added_tokens_decoder().values()]


def token_ids(text: str | None, name: str = TOKENIZER) -> np.ndarray:
    """Ids of a whole text (null: empty) and the separator, as little-endian unsigned 32-bit numbers."""
    slow, fast, special = _encoders(name)
    text = text or ""
    if any(s in text for s in special):
        ids = slow.encode(text, add_special_tokens=False).ids
    else:
        try:
            ids = fast.encode_to_numpy(text, disallowed_special=())
        except (ValueError, RuntimeError):  # the pattern matcher gave up on a very long run
            ids = slow.encode(text, add_special_tokens=False).ids
    out = np.empty(len(ids) + 1, "<u4")
    out[:-1] = ids
    out[-1] = SEPARATOR_ID
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): nth counts the pieces of one length within an input partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = token_ids(text, tokenizer)
                end = (len(ids) - 1) % capacity + 1
                start = piece = 0
                while start < len(ids):
                    length = end - start
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[start:end]), part, int(seen[length])))
                    seen[length] += 1
                    start, end, piece = end, end + capacity, piece + 1
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text")), run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Sets that an optimal packing may contain, with multiplicities, and the counts that remain."""
    left = {w: n for w, n in counts.items() if n}
    sizes = sorted(left)
    fixed: list[tuple[Pattern, int]] = []

    def take(w: int, n: int) -> None:
        left[w] -= n
        if not left[w]:
            del left[w]
            sizes.remove(w)

    def smallest(n: int, without: int) -> list[int]:
        out: list[int] = []
        for s in sizes:
            out += [s] * min(n, left[s] - (s == without))
            if len(out) >= n:
                break
        return out[:n]

    changed = True
    while changed:
        changed = False
        for w in sizes[::-1]:
            while left.get(w):
                room = capacity - w
                i = bisect_right(sizes, room) - 1
                while i >= 0 and sizes[i] == w and left[w] < 2:
                    i -= 1
                if i < 0:  # nothing fits beside it
                    fixed.append(((w,), left[w]))
                    take(w, left[w])
                    changed = True
                    break
                k = sizes[i]
                low = smallest(3, w)
                single = len(low) < 2 or sum(low[:2]) > room
                if not (k == room or single):
                    if len(low) > 2 and sum(low) <= room:
                        break
                    if _largest_pair(sizes, left, w, room) > k:
                        break
                n = left[w] // 2 if k == w else min(left[w], left[k])
                fixed.append(((w, k), n))
                take(w, n)
                take(k, n)
                changed = True
    return fixed, left


def _largest_pair(sizes: list[int], left: dict[int, int], w: int, room: int) -> int:
    """The largest sum within room of two pieces other than one of w."""
    best, lo, hi = 0, 0, len(sizes) - 1
    have = lambda s: left[s] - (s == w)
    while lo <= hi:
        a, b = sizes[lo], sizes[hi]
        if a + b > room or have(b) < 1:
            hi -= 1
        elif have(a) < 1 or (lo == hi and have(a) < 2):
            lo += 1
        else:
            best = max(best, a + b)
            lo += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit by decreasing length; sequences with equal contents move together."""
    open_by_room: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []
    done: list[tuple[Pattern, int]] = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if not n:
            return
        if not room:
            done.append((pattern, n))
            return
        if room not in open_by_room:
            open_by_room[room] = []
            insort(rooms, room)
        open_by_room[room].append((pattern, n))

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            i = bisect_left(rooms, w)
            if i < len(rooms):
                room = rooms[i]
                pattern, m = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room]
                    rooms.pop(i)
            else:
                room, pattern, m = capacity, (), n
            each = room // w
            full = min(m, n // each)
            put(room - each * w, pattern + (w,) * each, full)
            n -= full * each
            rest = 0
            if full < m and n:  # the last one takes what is left
                put(room - n * w, pattern + (w,) * n, 1)
                n, rest = 0, 1
            if pattern:
                put(room, pattern, m - full - rest)
    return done + [g for room in rooms for g in open_by_room[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns with multiplicities that hold every piece once."""
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


def _places(patterns: list[tuple[Pattern, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, runs of places: first rank, first sequence, places in one sequence, offset of the first."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, n in patterns:
        offset, i = 0, 0
        while i < len(pattern):
            w, each = pattern[i], 1
            while i + each < len(pattern) and pattern[i + each] == w:
                each += 1
            runs.setdefault(w, []).append((ranks.get(w, 0), sequence, each, offset))
            ranks[w] = ranks.get(w, 0) + n * each
            offset, i = offset + w * each, i + each
        sequence += n
    return {w: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for w, r in runs.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row for each piece of each row of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of the separator alone. Texts longer than the capacity are cut into pieces of
    that length, the first may be shorter. Repeated rows are packed as often as they occur; a null doc_id stays null.
    Other columns of docs are neither read nor returned. An empty table gives no rows.
    """
    # The parts and local ranks are fixed by writing them: no rerun can deal them anew.
    cutup = cut(pieces(docs, capacity, tokenizer))
    counts = cut(cutup.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = _places(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cutup.join(firsts, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.nonzero(np.diff(length[order]))[0] + 1
            for rows in np.split(order, cuts) if len(order) else []:
                w = int(length[rows[0]])
                first, base, each, at = places[w]
                i = np.searchsorted(first, rank[rows], "right") - 1
                nth = rank[rows] - first[i]
                sequence[rows] = base[i] + nth // each[i]
                offset[rows] = at[i] + nth % each[i] * w
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return map_arrow(ranked, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table, packed."""
    return pack(read_table(spark, sf_dir, "documents"))
