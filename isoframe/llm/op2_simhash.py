"""SimHash near-duplicates through an inverted index on positional bytes, with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints at d differing bits share at least 8 - d of them, so
for d = 2 the guaranteed minimum of matches is six. Single-byte postings would each hold 1/256 of the corpus, so a
posting is keyed by four positional bytes at once: two of the fingerprint's four pairs of bytes. Two differing bits
touch two pairs at most, so every link meets in one of the six such postings. In a posting the shared positional bytes
of each pair are tallied, pairs that reach six are retained, and their bits are compared.

A posting of more than MOST distinct fingerprints is not walked by pairs: its members are posted again with two of the
four bytes left, which every pair that reaches six shares in one of the six ways. Such a posting holds 65,536 distinct
fingerprints at most, whatever the corpus; if it too holds more than MOST, partners are looked up by the 136 possible
one- and two-bit differences. Links are thinned to a spanning forest and joined into components by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.llm.common import cut, map_arrow, read_table, row_hash
from isoframe.llm.components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
#: Postings of more distinct fingerprints than this are split, or searched by bit differences.
MOST = 512
#: The four bytes that key a posting: two of the pairs (0, 1), (2, 3), (4, 5), (6, 7).
KEYS = [(2 * a, 2 * a + 1, 2 * b, 2 * b + 1) for a, b in combinations(range(4), 2)]
#: For each, the two more bytes that key the parts of a posting too large.
SUBKEYS = [list(combinations([p for p in range(8) if p not in k], 2)) for k in KEYS]


def simhash(text: str | None) -> int:
    """The 64-bit SimHash of a text: ASCII lower case, words between ASCII white space, XXH64 of 3-word shingles.

    Null and wordless texts give 0; fewer than three words make one shingle of all of them.
    """
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[: -SHINGLE_WORDS + 1].tolist(), ends[SHINGLE_WORDS - 1 :].tolist(), strict=True)], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) of every row; fp is the fingerprint as a signed long. Other columns of docs are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((simhash(t) for t in batch.column(2).to_pylist()), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, "doc_id long, text_hash long, fp long")


def _mask(positions: tuple[int, ...]) -> int:
    return sum(0xFF << 8 * p for p in positions)


def _masked(positions: tuple[int, ...]) -> Column:
    """The fingerprint's bytes at these positions."""
    m = _mask(positions)
    return F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """The tally of equal positional bytes, of XORed fingerprints."""
    return (x.reshape(-1, 1).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def _pairs(group: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within groups that reach the minimum of shared positional bytes and differ in max_bits at most."""
    found_a, found_b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    at, d = np.arange(len(fp) - 1), 1
    at = at[group[at] == group[at + 1]]
    while len(at):  # all pairs d places apart at once
        x = fp[at] ^ fp[at + d]
        enough = shared_bytes(x) >= 8 - max_bits
        near = at[enough][np.bitwise_count(x[enough]) <= max_bits]
        found_a.append(fp[near])
        found_b.append(fp[near + d])
        d += 1
        at = at[at + d < len(fp)]
        at = at[group[at] == group[at + d]]
    return np.concatenate(found_a), np.concatenate(found_b)


def _by_differences(members: np.ndarray, free: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The same among the sorted members of one posting that agree in all bits but the free ones, hence in six bytes."""
    bits = [np.uint64(1 << b) for b in range(64) if free >> b & 1]
    found_a, found_b = [], []
    for n in range(1, max_bits + 1):
        for c in combinations(bits, n):
            other = members ^ np.bitwise_or.reduce(c)
            at = np.minimum(np.searchsorted(members, other), len(members) - 1)
            hit = (members[at] == other) & (members < other)
            found_a.append(members[hit])
            found_b.append(other[hit])
    return np.concatenate(found_a), np.concatenate(found_b)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links that connect all that the links given connect."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    parent = list(range(len(nodes)))
    kept = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True)):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[y] = x
            kept[i] = True
    return a[kept], b[kept]


def links(distinct: DataFrame, max_bits: int = MAX_BITS, most: int = MOST) -> DataFrame:
    """(a, b): links among distinct fingerprints (column fp) that connect all at max_bits (2 at most) or fewer differing bits."""
    if max_bits > 2:
        raise ValueError("postings by two of four pairs of bytes find links of two differing bits at most")
    posted = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("part"), _masked(k).alias("value")) for i, k in enumerate(KEYS)])).alias("k")).select("fp", "k.part", "k.value")
    large = cut(posted.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("part", "value", F.lit(True).alias("large")))
    whole = F.struct(F.lit(-1).cast("byte").alias("sub"), F.lit(0).cast("long").alias("rest"))
    if large.isEmpty():
        posted = posted.select("part", "value", F.lit(-1).cast("byte").alias("sub"), F.lit(0).cast("long").alias("rest"), "fp")
    else:
        again = F.coalesce(*[F.when(F.col("part") == i, F.array(*[F.struct(F.lit(j).cast("byte").alias("sub"), _masked(s).alias("rest")) for j, s in enumerate(subs)])) for i, subs in enumerate(SUBKEYS)])
        split = posted.join(large, ["part", "value"], "left").select("part", "value", "fp", F.explode(F.when(F.col("large"), again).otherwise(F.array(whole))).alias("s"))
        posted = split.select("part", "value", "s.sub", "s.rest", "fp")
    key = ("part", "value", "sub", "rest")
    posted = posted.repartition(*key).sortWithinPartitions(*key, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] | None = None

        def done(cols: list[np.ndarray]) -> pa.RecordBatch:
            fp = cols[4].view(np.uint64)
            new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)))
            group = np.cumsum(new) - 1
            starts, sizes = np.nonzero(new)[0], np.bincount(group)
            small = sizes[group] <= most
            found = [_pairs(group[small], fp[small], max_bits)]
            for g in np.nonzero(sizes > most)[0].tolist():
                s = int(starts[g])
                part, sub = int(cols[0][s]), int(cols[2][s])
                fixed = KEYS[part] + (SUBKEYS[part][sub] if sub >= 0 else ())
                found.append(_by_differences(np.sort(fp[s : s + int(sizes[g])]), ~_mask(fixed) & (1 << 64) - 1, max_bits))
            a, b = _forest(*(np.concatenate(x) for x in zip(*found, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if left is not None:
                cols = [np.concatenate(x) for x in zip(left, cols, strict=True)]
            if not len(cols[4]):
                continue
            other = np.nonzero(np.any([c != c[-1] for c in cols[:4]], axis=0))[0]
            last = int(other[-1]) + 1 if len(other) else 0
            if last:  # the posting at the end may go on in the next batch
                yield done([c[:last] for c in cols])
            left = [c[last:] for c in cols]
        if left is not None and len(left[4]):
            yield done(left)

    return map_arrow(posted, run, "a long, b long")


def _grouped(docs: DataFrame, max_bits: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, root): root names the component."""
    prints = cut(fingerprints(docs, id_col, text_col))
    distinct = cut(prints.select("fp").distinct())
    roots = connected_components(links(distinct, max_bits))
    return prints.join(roots, prints.fp == roots.node, "left").select("doc_id", "text_hash", "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable).

    Null and wordless texts have fingerprint zero and link to each other like any others. Repeated rows give repeated
    result rows. A null doc_id keeps its row; its component_id is the least non-null id of its component, or null.
    Other columns of docs, whatever their names, are neither read nor returned. An empty table gives no rows.
    """
    rows = _grouped(docs, max_bits, id_col, text_col)
    least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "root").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of docs of each component, all columns as they are: the first by doc_id (nulls last), then by a hash of the text.

    Rows are judged by their texts, so one doc_id with unlike texts keeps a row of each. Of rows with that doc_id and text,
    repeated ones, the first by a hash of all columns stays. Null and empty texts are near-duplicates of each other. Extra
    columns ride along. An empty table gives an empty one.
    """
    rows = _grouped(docs, max_bits)
    one = F.struct(F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("text_hash").alias("_hash"))
    # How often the chosen row occurs is counted with it, so that only repeated ones need a second look.
    kept = cut(rows.groupBy("root", one.alias("k")).agg(F.count(F.lit(1)).alias("_n")).groupBy("root").agg(F.min(F.struct("k", "_n")).alias("m")).select("m.k.*", "m._n"))
    columns = docs.columns
    keyed = docs.select(F.struct("*").alias("_row")).select("_row", F.col("_row.doc_id").isNull().alias("_none"), F.coalesce(F.col("_row.doc_id").cast("long"), F.lit(0)).alias("_id"), F.xxhash64("_row.text").alias("_hash"))
    chosen = keyed.join(kept, ["_none", "_id", "_hash"])
    if kept.where("_n > 1").isEmpty():
        return chosen.select(*[F.col("_row")[c].alias(c) for c in columns])
    again = chosen.where("_n > 1").groupBy("_none", "_id", "_hash").agg(F.min_by("_row", row_hash(docs.schema, "_row")).alias("_row"))
    return chosen.where("_n = 1").select("_row").unionByName(again.select("_row")).select(*[F.col("_row")[c].alias(c) for c in columns])


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table, grouped."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))
