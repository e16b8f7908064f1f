"""Repeated passages by super-k-mer partitioning, on words.

A window is 13 words in a row. Its minimiser is the least hash of the 3-word grams in it; consecutive windows that share
one travel as a single packed string, a super-k-mer, of as many words as windows and 12 more, to the bucket that the
minimiser names. Equal windows have equal minimisers and so meet in one bucket, where sorting brings them together and
the least document of each is known; equal hashes are compared word by word, so counts are exact.

A packed string is a run of numbers into the words that its task has seen; those of one task for one bucket share a list
of words, sorted and without the letters that a word shares with the one before, and are compressed together. Few minimisers may hold many super-k-mers (copies of one passage, a common phrase).
These are found on a sample of rows, which decides how the work is spread and no result. Their super-k-mers are told apart
first, so that copies collapse before the shuffle, then cut into windows that are keyed by their own words; what is found
goes back to the copies by a join that Spark can split.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.llm.common import cut, map_arrow, read_table
from isoframe.sources.store import discard

WINDOW, GRAM = 13, 3
#: Windows that one super-k-mer spans at most.
LONGEST = 64
#: Bytes of text that a task packs at once, and super-k-mers that a bucket holds on average.
CHUNK_BYTES, BUCKET_KMERS = 16 << 20, 300_000
#: Share of rows that shows which minimisers are frequent, the least sign of one, and the most there can be.
SAMPLE, LEAST_SEEN, MOST_FREQUENT = 1 / 32, 16, 1 << 18

KEY = "none boolean, doc_id long, text_hash long"
SPAN = "none boolean, doc_id long, text_hash long, start int, stop int"


def _mix(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n entries in a row, one for each place where they fit."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out = (out + h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def _least(g: np.ndarray, n: int) -> np.ndarray:
    """The least of n entries in a row, one for each place where they fit."""
    width = 1
    while 2 * width <= n:
        g, width = np.minimum(g[:-width], g[width:]), 2 * width
    return np.minimum(g[: len(g) - (n - width)], g[n - width :]) if n > width else g


@dataclass
class Chunk:
    """Super-k-mers of some texts: the texts' words as numbers into the sorted `words`, and place, length, text and minimiser
    of each. `shared` is how many bytes a word begins with that the one before begins with too."""

    words: list[bytes]
    shared: np.ndarray
    ids: np.ndarray
    start: np.ndarray
    length: np.ndarray
    text: np.ndarray
    first_word: np.ndarray
    minimiser: np.ndarray


def _in_common(a: bytes, b: bytes) -> int:
    """How many bytes both begin with, 255 at most."""
    most = min(len(a), len(b), 255)
    if a[:most] == b[:most]:
        return most
    n = 0
    while a[n] == b[n]:
        n += 1
    return n


def chunk(texts: list[str | None], window: int = WINDOW, gram: int = GRAM, longest: int = LONGEST) -> Chunk:
    """Cut texts into super-k-mers. Texts of fewer words than a window have none."""
    import xxhash

    split = [(t or "").encode().split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    coded = pa.array([w for s in split for w in s], pa.binary()).dictionary_encode()
    seen = coded.dictionary.to_pylist()
    order = sorted(range(len(seen)), key=seen.__getitem__)
    words = [seen[k] for k in order]
    rank = np.empty(len(seen), np.int32)
    rank[order] = np.arange(len(seen), dtype=np.int32)
    ids = rank[coded.indices.to_numpy()]
    shared = np.fromiter((_in_common(a, b) for a, b in zip([b"", *words], words, strict=False)), np.int64, len(words))
    gram = min(gram, window)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    ends = np.cumsum(sizes)
    text_of = np.repeat(np.arange(len(texts)), sizes)
    if len(ids) < window:
        none = np.zeros(0, np.int64)
        return Chunk(words, shared, ids, none, none, none, ends - sizes, none.astype(np.uint64))
    least = _least(_mix(hashes[ids], gram), window - gram + 1)
    at = np.nonzero(text_of[: len(ids) - window + 1] == text_of[window - 1 :])[0]
    value = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (value[1:] != value[:-1])
    starts = np.nonzero(new)[0]
    within = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    starts = np.nonzero(within % longest == 0)[0]
    length = np.diff(np.append(starts, len(at))) + window - 1
    return Chunk(words, shared, ids, at[starts], length, text_of[at[starts]], ends - sizes, value[starts])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together up to CHUNK_BYTES; one text is never cut."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= CHUNK_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _gather(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs of values, one behind the other."""
    at = np.arange(int(length.sum())) + np.repeat(start - (np.cumsum(length) - length), length)
    return values[at]


def pack(c: Chunk, some: np.ndarray, none: np.ndarray, doc_id: np.ndarray, text_hash: np.ndarray) -> bytes:
    """Some super-k-mers of a chunk with the words they use, compressed."""
    import zstandard

    used, ids = np.unique(_gather(c.ids, c.start[some], c.length[some]), return_inverse=True)
    t = c.text[some]
    first = np.concatenate(([True], t[1:] != t[:-1]))  # each text's facts once
    # What two words that stay have in common is the least that neighbours between them have.
    shared = np.minimum.reduceat(c.shared, np.append(0, used[:-1] + 1)) if len(used) else used
    shared[:1] = 0
    number = ids.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
    parts = [
        b" ".join([c.words[k][n:] for k, n in zip(used.tolist(), shared.tolist(), strict=True)]),
        shared.astype(np.uint8).tobytes(),
        number.view(np.uint8).reshape(len(number), -1).T.tobytes(),
        c.length[some].astype(np.uint16).tobytes(),
        np.diff(c.start[some] - c.first_word[t], prepend=0).astype(np.int32).tobytes(),
        first.tobytes(),
        np.diff(doc_id[t[first]], prepend=0).tobytes(),
        none[t[first]].tobytes(),
        text_hash[t[first]].tobytes(),
    ]
    return zstandard.compress(struct.pack("<10q", len(used), *map(len, parts)) + b"".join(parts), 3)


@dataclass
class Packed:
    """What unpack() reads: words, numbers into them, and of each super-k-mer its length, place and document."""

    words: list[bytes]
    ids: np.ndarray
    length: np.ndarray
    start: np.ndarray
    none: np.ndarray
    doc_id: np.ndarray
    text_hash: np.ndarray


def unpack(blob: bytes) -> Packed:
    import zstandard

    raw = zstandard.decompress(blob)
    used, *sizes = struct.unpack("<10q", raw[:80])
    ends = 80 + np.cumsum(sizes)
    rest, shared, ids, length, start, first, doc_id, none, text_hash = (raw[e - n : e] for e, n in zip(ends.tolist(), sizes, strict=True))
    of = np.cumsum(np.frombuffer(first, bool)) - 1
    words, last = [], b""
    for n, w in zip(shared, rest.split(b" "), strict=False):
        last = last[:n] + w
        words.append(last)
    kind = np.uint16 if used <= 1 << 16 else np.uint32
    return Packed(
        words,
        np.frombuffer(np.frombuffer(ids, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.tobytes(), kind),
        np.frombuffer(length, np.uint16).astype(np.int64),
        np.cumsum(np.frombuffer(start, np.int32).astype(np.int64)),
        np.frombuffer(none, bool)[of],
        np.cumsum(np.frombuffer(doc_id, np.int64))[of],
        np.frombuffer(text_hash, np.int64)[of],
    )


def _same(ids: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    equal = np.ones(len(a), bool)
    for k in range(window):
        equal &= ids[a + k] == ids[b + k]
    return equal


def count_bucket(blobs: list[bytes], window: int = WINDOW, mix: Callable[[np.ndarray, int], np.ndarray] = _mix) -> tuple[np.ndarray, ...]:
    """(none, doc_id, text_hash, start, stop) of the spans of a bucket whose windows start in a lesser document too."""
    number: dict[bytes, int] = {}
    parts = [unpack(b) for b in blobs]
    ids = np.concatenate([np.fromiter((number.setdefault(w, len(number)) for w in p.words), np.int32, len(p.words))[p.ids] for p in parts])
    length, start, none, doc_id, text_hash = (np.concatenate([getattr(p, x) for p in parts]) for x in ("length", "start", "none", "doc_id", "text_hash"))
    del parts
    n = length - window + 1
    kmer = np.repeat(np.arange(len(n), dtype=np.int32), n)
    within = (np.arange(len(kmer)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    at = np.repeat(np.cumsum(length) - length, n) + within
    key = mix(np.random.default_rng(len(number)).integers(0, 1 << 63, len(number)).astype(np.uint64)[ids], window)[at]
    order = np.argsort(key)
    equal = key[order[1:]] == key[order[:-1]]
    pairs = np.nonzero(equal)[0]
    if not _same(ids, at[order[pairs]], at[order[pairs + 1]], window).all():  # unlike windows of one hash: sort the words themselves
        order = np.lexsort([ids[at + k] for k in range(window)])
        equal = _same(ids, at[order[:-1]], at[order[1:]], window)
    begin = np.nonzero(np.concatenate(([True], ~equal)))[0]
    ranked = np.searchsorted(np.unique(doc_id[~none]), doc_id)
    ranked[none] = len(doc_id)  # a null id is greater than any
    mine = ranked[kmer[order]]
    least = np.minimum.reduceat(mine, begin)
    gone = np.zeros(len(kmer), bool)
    gone[order] = mine > np.repeat(least, np.diff(np.append(begin, len(mine))))
    # Runs of windows to remove, each within a super-k-mer.
    k, i = kmer[gone], within[gone]
    head = np.ones(len(k), bool)
    head[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1] + 1)
    heads = np.nonzero(head)[0]
    tails = np.append(heads, len(k))[1:] - 1
    k = k[heads]
    return none[k], doc_id[k], text_hash[k], start[k] + i[heads], start[k] + i[tails] + window


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(none, doc_id, text_hash, text): what tells the rows apart, and the text."""
    own = F.col(id_col).cast("long")
    return docs.select(own.isNull().alias("none"), F.coalesce(own, F.lit(0)).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"))


def _read(t: pa.Table, window: int) -> tuple[Chunk, np.ndarray, np.ndarray, np.ndarray]:
    return chunk(t.column("text").to_pylist(), window), *(t.column(c).to_numpy() for c in ("none", "doc_id", "text_hash"))


def frequent(rows: DataFrame, parts: int, window: int = WINDOW, sample: float = SAMPLE, least_seen: int = LEAST_SEEN) -> tuple[np.ndarray, int]:
    """Minimisers that would fill an eighth of a bucket or more, and the number of buckets, as a sample of rows shows them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches):
            value, n = np.unique(_read(t, window)[0].minimiser, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], names=["minimiser", "n"])

    seen = rows.sample(fraction=sample, seed=1) if sample < 1 else rows
    counts = cut(map_arrow(seen, run, "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    buckets = max(parts, int(total / sample / BUCKET_KMERS))
    # At most MOST_FREQUENT can have that share of all.
    share = max(least_seen, total / buckets / 8, total / MOST_FREQUENT)
    found = counts.where(F.col("n") >= share).select("minimiser").collect()
    discard(counts)
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64)), buckets


def _is_in(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def _by_bucket(rows: DataFrame, often: np.ndarray, buckets: int, window: int) -> DataFrame:
    """Spans of what is not frequent: packed, shuffled, sorted and counted bucket by bucket."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches):
            c, none, doc_id, text_hash = _read(t, window)
            rest = np.nonzero(~_is_in(c.minimiser, often))[0]
            bucket = (c.minimiser[rest] * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            name, begin = np.unique(bucket[order], return_index=True)
            for b, some in zip(name.tolist(), np.split(rest[order], begin[1:]), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([pack(c, some, none, doc_id, text_hash)], pa.binary())], names=["bucket", "packed"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if bucket != now and held:
                    yield _spans(count_bucket(held, window))
                    held = []
                now = bucket
                held.append(blob)
        if held:
            yield _spans(count_bucket(held, window))

    packed = map_arrow(rows, send, "bucket long, packed binary")
    return map_arrow(packed.repartition("bucket").sortWithinPartitions("bucket"), meet, SPAN)


def _spans(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    none, doc_id, text_hash, start, stop = columns
    return pa.RecordBatch.from_arrays([pa.array(none), pa.array(doc_id), pa.array(text_hash), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], names=["none", "doc_id", "text_hash", "start", "stop"])


def _of_frequent(rows: DataFrame, often: np.ndarray, window: int) -> tuple[DataFrame, list[DataFrame]]:
    """Spans of the frequent minimisers: distinct super-k-mers, their windows keyed by their words, and back to the copies.

    Also what was written on the way.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for t in _chunks(batches):
            c, none, doc_id, text_hash = _read(t, window)
            some = np.nonzero(_is_in(c.minimiser, often))[0]
            digests, packed, seen = [], [], set()
            for a, n in zip(c.start[some].tolist(), c.length[some].tolist(), strict=True):
                line = b" ".join([c.words[k] for k in c.ids[a : a + n].tolist()])
                d = xxhash.xxh3_128_digest(line)
                digests.append(d)
                packed.append(None if d in seen else line.decode())
                seen.add(d)
            of = c.text[some]
            columns = [pa.array(digests, pa.binary()), pa.array(packed, pa.string()), pa.array(none[of]), pa.array(doc_id[of]), pa.array(text_hash[of]), pa.array((c.start[some] - c.first_word[of]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "packed", "none", "doc_id", "text_hash", "at"])

    copies = cut(map_arrow(rows, send, f"digest binary, packed string, {KEY}, at int"))
    doc = F.struct("none", "doc_id")
    apart = copies.groupBy("digest").agg(F.max("packed").alias("packed"), F.min(doc).alias("first"), F.max(doc).alias("last"))
    words = F.split("packed", " ")
    cut_up = F.transform(F.sequence(F.lit(0), F.size(words) - window), lambda i: F.array_join(F.slice(words, i + 1, window), " "))
    windows = cut(apart.select("digest", "first", "last", F.posexplode(cut_up).alias("i", "window")))
    least = windows.groupBy("window").agg(F.min("first").alias("least"))
    hits = windows.join(least, "window").where("least < last").groupBy("digest").agg(F.collect_list(F.struct("i", "least")).alias("hits"))
    found = copies.join(hits, "digest").select("none", "doc_id", "text_hash", "at", F.explode("hits").alias("h")).where(F.col("h.least") < doc)
    start = F.col("at") + F.col("h.i")
    return found.select("none", "doc_id", "text_hash", start.cast("int").alias("start"), (start + window).cast("int").alias("stop")), [copies, windows]


def repeated_spans(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", sample: float = SAMPLE, least_seen: int = LEAST_SEEN) -> DataFrame:
    """(none, doc_id, text_hash, spans): of each text with something to remove, its spans of words [start, stop), in no order.

    none tells a null id, whose doc_id is 0 here; text_hash is xxhash64 of the text, so that unlike texts of one id are told
    apart.
    """
    rows = _rows(docs, id_col, text_col)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    often, buckets = frequent(rows, parts, window, sample, least_seen)
    spans, on_the_way = _by_bucket(rows, often, buckets, window), []
    if len(often):
        more, on_the_way = _of_frequent(rows, often, window)
        spans = spans.unionByName(more)
    found = cut(spans.groupBy("none", "doc_id", "text_hash").agg(F.collect_set(F.struct("start", "stop")).alias("spans")))
    for df in on_the_way:
        discard(df)
    return found


def _kept(text: str | None, spans: np.ndarray) -> tuple[int, list[bytes]]:
    """How many words a text has, and those outside the spans."""
    words = (text or "").encode().split()
    if not len(spans):
        return len(words), words
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, spans[:, 0], 1)
    np.add.at(step, spans[:, 1], -1)
    return len(words), [words[i] for i in np.nonzero(np.cumsum(step[:-1]) == 0)[0].tolist()]


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, sample: float = SAMPLE, least_seen: int = LEAST_SEEN) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256 (and kept_text, joined by one space, if asked for).

    Words are what ASCII white space separates, unchanged. A word goes if a window that covers it also starts in a document
    with a smaller id; windows are judged on the texts as they came, so the first of all always stays. A null id is greater
    than any other; rows of one id (repeated rows, and rows with a null id) take nothing from each other. Null and empty
    texts have no words; texts shorter than a window lose none; texts of any length are read whole. Other columns of docs,
    whatever their names, are neither read nor returned. An empty table gives no rows.
    """
    spans = repeated_spans(docs, window, id_col, text_col, sample, least_seen)
    rows = _rows(docs, id_col, text_col).join(spans, ["none", "doc_id", "text_hash"], "left").select("none", "doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: list[list] = [[], [], [], []]
            ends = b.column(3).offsets.to_numpy()
            flat = b.column(3).flatten()
            both = np.stack([flat.field(k).to_numpy() for k in range(2)], axis=1) if len(flat) else np.zeros((0, 2), np.int32)
            ends = ends - ends[0]
            for k, text in enumerate(b.column(2).to_pylist()):
                n, words = _kept(text, both[ends[k] : ends[k + 1]])
                line = b" ".join(words)
                for c, x in zip(columns, (n, n - len(words), hashlib.sha256(line).hexdigest(), line.decode() if with_text else None), strict=True):
                    c.append(x)
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], names=["none", "doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    done = map_arrow(rows, run, "none boolean, doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    own: Column = F.when(~F.col("none"), F.col("doc_id")).alias("doc_id")
    return done.select(own, "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text)


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table without passages that an earlier document has."""
    return substring_dedup(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS MATERIALIZED (
  SELECT doc_id, r, i, array_to_string(w[i:i + 12], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), f AS (
  SELECT win, min(doc_id) AS least FROM p GROUP BY win HAVING count(*) > 1
), g AS (
  SELECT r, list(DISTINCT i + k) AS gone FROM p JOIN f USING (win), (SELECT unnest(range(13)) AS k) WHERE least < doc_id GROUP BY r
), k AS (
  SELECT doc_id, w, coalesce(len(gone), 0) AS n_removed, CASE WHEN gone IS NULL THEN w
    ELSE list_select(w, list_sort(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)))) END AS kept
  FROM d LEFT JOIN g USING (r)
)
SELECT doc_id, len(w) AS n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
