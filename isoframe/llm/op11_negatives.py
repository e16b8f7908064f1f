"""Hard negatives by distributed radix selection.

A set of windows (anchor, bounds of the score, same label or another, how many rows are wanted) meets all vectors, one
bounded block of anchors at a time. In one pass each task counts, for each window, its rows by the leading digit of a
key that sorts better rows first: the top of the window less the score, then the id. The counts, added up, tell the digit
within which the last row wanted lies; only windows whose digit holds many rows are refined by the next digit, first of
the score, then, where scores tie, of the id. The last pass gathers the rows up to the digit found, which is all that is
ever moved or ranked.

A task needs to report its counts only as far as it has the rows wanted by itself, since the digit sought lies no
further: at most that many counts a window and task, however many rows tie.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isoframe.llm.common import cut, map_arrow, read_table, shared_dir
from isoframe.llm.vectors import matrix, scaled, whole

SCALE, POSITIVES, NEGATIVES, EVERY = 256, 5, 10, 100
LOW, HIGH = 30, 90
#: Components stop at this, so that inner products of vectors of up to 16,384 components fit in 64 bits.
MOST = 1 << 24
#: Anchors that meet all vectors in one pass, and those that a task works on at once.
BLOCK, AT_ONCE = 1024, 128
#: Bits of a digit.
DIGIT = 9
#: A digit that holds as many rows is not refined.
FEW = 64


class Windows:
    """The windows of a block of anchors, and how far each is refined.

    A row's key is top - score, then its id less the least id; `done` counts the bits of it that are known, of `bits` for
    the score and `id_bits` for the id, and `prefix` holds them. `least` says how many better rows are settled already.
    """

    def __init__(self, anchors: np.ndarray, of: np.ndarray, low: np.ndarray, top: np.ndarray, same: bool, wanted: int, first_id: int, id_bits: int):
        self.anchors, self.of, self.low, self.top, self.same, self.wanted = anchors, of, low, top, same, wanted
        n = len(of)
        self.bits = max(1, int(max((top - low).max(initial=0), 1)).bit_length())
        self.first_id, self.id_bits, self.digit = first_id, max(1, id_bits), DIGIT
        self.done, self.prefix, self.before = np.zeros(n, np.int64), np.zeros((n, 2), np.int64), np.zeros(n, np.int64)
        self.open = np.ones(n, bool)
        self.whole = np.zeros(n, bool)

    def next_bits(self) -> np.ndarray:
        """How many bits the next digit of each window has."""
        left = np.where(self.done < self.bits, self.bits - self.done, self.bits + self.id_bits - self.done)
        return np.minimum(self.digit, left)

    def found(self, w: np.ndarray, digit: np.ndarray, before: np.ndarray, inside: np.ndarray) -> None:
        """Windows w have the last row wanted within that digit, after as many rows in lesser ones; the other open windows want all."""
        self.whole[self.open] = True
        self.whole[w] = False
        self.open[:] = False
        take = self.next_bits()[w]
        of_id = (self.done[w] >= self.bits).astype(int)
        self.prefix[w, of_id] = self.prefix[w, of_id] << take | digit
        self.done[w] += take
        self.before[w] += before
        self.open[w] = (inside > FEW) & (self.done[w] < self.bits + self.id_bits)


def _products(anchors: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, exact: by floating point where all sums stay below 2^53, else in int64."""
    most = lambda m: int(np.abs(m).max(initial=0))
    if most(anchors) * most(x) * x.shape[1] < 1 << 53:
        return (anchors.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return anchors @ x.T


def _meet(wide: Windows, ids: np.ndarray, labels: np.ndarray, anchor_ids: np.ndarray, anchor_labels: np.ndarray, batch: pa.RecordBatch, some: np.ndarray):
    """For a few windows at a time: (windows, rows, score keys, id keys) of the rows that are in them and on their known path or before it."""
    used = np.unique(wide.of[some])
    x = matrix(batch.column(2), wide.anchors.shape[1])
    for at in range(0, len(used), AT_ONCE):
        mine = used[at : at + AT_ONCE]
        score = _products(wide.anchors[mine], x)
        fits = (labels[None, :] == anchor_labels[mine, None]) == wide.same
        fits &= ids[None, :] != anchor_ids[mine, None]
        w = some[np.isin(wide.of[some], mine)]
        row = np.searchsorted(mine, wide.of[w])
        key = wide.top[w, None] - score[row]
        ok = fits[row] & (key >= 0) & (key <= (wide.top - wide.low)[w, None])
        # Beyond the known prefix of the score no row counts.
        known = np.minimum(wide.done, wide.bits)[w]
        ok &= (key >> (wide.bits - known)[:, None]) <= np.where(wide.whole[w], np.int64(1 << 62), wide.prefix[w, 0])[:, None]
        i, j = np.nonzero(ok)
        yield w[i], j, key[i, j], ids[j] - wide.first_id


def _counts(vectors: DataFrame, wide: Windows, anchor_ids: np.ndarray, anchor_labels: np.ndarray) -> DataFrame:
    """(w, digit, n): rows of each open window by the next digit of their keys."""
    some = np.nonzero(wide.open)[0]
    shared = vectors.sparkSession.sparkContext.broadcast((wide, some, anchor_ids, anchor_labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, some, anchor_ids, anchor_labels = shared.value
        slot = np.zeros(len(wide.of), np.int64)
        slot[some] = np.arange(len(some))
        tally = np.zeros((len(some), 1 << wide.digit), np.int64)
        take, in_id = wide.next_bits(), wide.done >= wide.bits
        for b in batches:
            for w, _, key, own in _meet(wide, b.column(0).to_numpy(), b.column(1).to_numpy(), anchor_ids, anchor_labels, b, some):
                known = np.minimum(wide.done[w], wide.bits)
                on = key >> (wide.bits - known) == wide.prefix[w, 0]
                known_id = np.maximum(wide.done[w] - wide.bits, 0)
                on &= ~in_id[w] | (own >> (wide.id_bits - known_id) == wide.prefix[w, 1])
                w, key, own, known, known_id = w[on], key[on], own[on], known[on], known_id[on]
                shift = np.where(in_id[w], wide.id_bits - known_id, wide.bits - known) - take[w]
                digit = np.where(in_id[w], own, key) >> shift & (1 << take[w]) - 1
                np.add.at(tally, (slot[w], digit), 1)
        # Counts beyond the digit where this task alone has enough cannot matter.
        before = np.cumsum(tally, axis=1) - tally
        k, digit = np.nonzero((tally > 0) & (before < (wide.wanted - wide.before[some])[:, None]))
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(some[k].astype(np.int32)), pa.array(digit.astype(np.int32)), pa.array(tally[k, digit])], names=["w", "digit", "n"])

    return map_arrow(vectors, run, "w int, digit int, n long")


def select(vectors: DataFrame, wide: Windows, anchor_ids: np.ndarray, anchor_labels: np.ndarray) -> DataFrame:
    """(w, id, score, rank): the first rows wanted of each window, by falling score, then by id."""
    after = Window.partitionBy("w").orderBy("digit")
    while wide.open.any():
        need = F.lit(wide.wanted) - F.element_at(F.lit(wide.before.tolist()), F.col("w") + 1) if len(wide.of) else F.lit(0)
        sums = _counts(vectors, wide, anchor_ids, anchor_labels).groupBy("w", "digit").agg(F.sum("n").alias("n"))
        sums = sums.withColumn("upto", F.sum("n").over(after)).withColumn("need", need).where("upto >= need")
        rows = sums.groupBy("w").agg(F.min_by(F.struct("digit", "upto", "n"), "digit").alias("x")).select("w", "x.*").collect()
        w, digit, upto, inside = (np.array([r[c] for r in rows], np.int64) for c in ("w", "digit", "upto", "n"))
        wide.found(w, digit, upto - inside, inside)
    shared = vectors.sparkSession.sparkContext.broadcast((wide, anchor_ids, anchor_labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, anchor_ids, anchor_labels = shared.value
        some = np.arange(len(wide.of))
        best = np.zeros((0, 3), np.int64)
        for b in batches:
            new = [best]
            for w, j, key, own in _meet(wide, b.column(0).to_numpy(), b.column(1).to_numpy(), anchor_ids, anchor_labels, b, some):
                known_id = np.maximum(wide.done[w] - wide.bits, 0)
                keep = wide.whole[w] | (known_id == 0) | (key < wide.prefix[w, 0]) | (own >> (wide.id_bits - known_id) <= wide.prefix[w, 1])
                new.append(np.stack([w, key, own], axis=1)[keep])
            best = np.concatenate(new)
            best = best[np.lexsort((best[:, 2], best[:, 1], best[:, 0]))]
            at = np.arange(len(best)) - np.searchsorted(best[:, 0], best[:, 0])
            best = best[at < wide.wanted]
        if len(best):
            w, key, own = best.T
            yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int32)), pa.array(own + wide.first_id), pa.array(wide.top[w] - key)], names=["w", "id", "score"])

    gathered = map_arrow(vectors, run, "w int, id long, score long")
    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.col("score").desc(), "id"))
    return gathered.withColumn("rank", rank).where(F.col("rank") <= wide.wanted)


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by `every`. An anchor's positives are its best other rows of the same label;
    each has, best first, the rows of other labels whose score is from `low` to `high` percent of the positive's. A score
    is the inner product of floor(scale * x); ties go to the smaller id.

    Rows with a null id, label or vector, or a component that is null or no finite number, take no part. "Other" rows are
    those of another id: repeats of an anchor's row are anchors once and no positives, repeats of other rows count each;
    unlike rows of an anchor's id are anchors each. A shorter vector is as one filled with zeros. Components beyond MOST in
    size count as MOST. Anchors without positives, and positives whose window is empty (their score is negative), have no
    rows. Other columns are neither read nor returned; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & whole(vector_col))
    rows = cut(rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), scaled(vector_col, scale, MOST).alias("v")))
    size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), F.max(F.size("v")).alias("width"), F.max(size).alias("size")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    anchors = rows.where(F.col("id") % every == 0).distinct()
    count = anchors.count() if facts["n"] else 0
    if not count:
        return spark.createDataFrame([], schema)
    width, first_id, id_bits = max(1, facts["width"]), facts["first"], (facts["last"] - facts["first"]).bit_length()
    bound = int(facts["size"] * (1 + 1e-9)) + 1  # no inner product is larger than the largest square
    blocks = -(-count // block)
    anchors = cut(anchors.withColumn("block", F.pmod(F.xxhash64("id", "label", "v"), F.lit(blocks))))
    path = f"{shared_dir(spark)}/negatives-{uuid4().hex}"
    for b in range(blocks):
        mine = anchors.where(F.col("block") == b).orderBy("id", "label", "v").collect()  # about a block's number
        if not mine:
            continue
        ids, labels = (np.array([r[c] for r in mine], np.int64) for c in ("id", "label"))
        x = np.zeros((len(mine), width), np.int64)
        for k, r in enumerate(mine):
            x[k, : len(r["v"])] = r["v"]
        of = np.arange(len(mine))
        wide = Windows(x, of, np.full(len(mine), -bound), np.full(len(mine), bound), True, positives, first_id, id_bits)
        found = select(rows, wide, ids, labels).orderBy("w", "rank").collect()
        found = [(r["w"], r["id"], r["score"]) for r in found if r["score"] >= 0]
        of, positive, score = (np.array([r[k] for r in found], np.int64) for k in range(3))
        wide = Windows(x, of, -(-low * score // 100), high * score // 100, False, negatives, first_id, id_bits)
        if len(of):
            names = spark.createDataFrame([(k, int(ids[a]), p, s) for k, (a, p, s) in enumerate(found)], "w int, anchor_id long, positive_id long, positive_score long")
            out = select(rows, wide, ids, labels).join(F.broadcast(names), "w")  # a block's windows
            out = out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            out.write.mode("append").parquet(path)
        else:
            spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the whole embeddings table; where vec_id is divisible by 7, the label first becomes (label + 1) % 10."""
    rows = read_table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", shifted))


ORACLE = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM v AS a, v AS r WHERE a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10
"""
