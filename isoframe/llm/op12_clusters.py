"""Centroid clustering (Lloyd's rounds) with Elkan's bounds (2003), exact in integers.

Each vector carries its centroid, an upper bound of the distance to it and a lower bound of the distance to every
centroid; both follow the centroids as they move. A centroid is skipped where the upper bound is below its lower bound,
or below half the distance between the two centroids. Bounds are rounded outwards and only a strict comparison skips, so
a tie is never skipped; what is not skipped is worked out in 64-bit integers, and so is every distance returned.

A round is one pass over the vectors with their bounds, written to the shared folder for the next; k centroids of one
vector's length each are all that the driver and the tasks share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.llm.common import cut, map_arrow, read_table
from isoframe.llm.vectors import matrix, scaled, whole
from isoframe.sources.store import discard

WIDTH, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Components stop at this, so that 64 squared differences fit in 64 bits.
MOST = 1 << 27
#: More than the rounding of a conversion, a root and a sum together.
MARGIN = 1e-15

STATE = "vec_id long, v array<int>, cluster int, upper double, lower array<double>"


def _above(x: np.ndarray) -> np.ndarray:
    return x * (1 + MARGIN)


def _below(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) * (1 - MARGIN)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to c (a row, or one for each), exact in int64."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Bounds:
    """What a round knows of its centroids: themselves, half their distances rounded down, how far each has moved."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.now, k = now, len(now)
        apart = np.array([squared(now, c) for c in now]).reshape(k, k)
        self.half = _below(np.sqrt(apart)) / 2
        self.nearest = np.where(np.eye(k, dtype=bool), np.inf, self.half).min(axis=1, initial=np.inf)
        self.moved = None if before is None else _above(np.sqrt(squared(now, before)))

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cluster, upper and lower bounds from all distances."""
        far = np.stack([squared(x, c) for c in self.now], axis=1)
        at = far.argmin(axis=1)  # the first of equals
        root = np.sqrt(far)
        return at, _above(root[np.arange(len(x)), at]), _below(root)

    def advance(self, x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same after the centroids have moved, and how many distances were worked out."""
        at, lower = at.copy(), _below(lower - self.moved)
        upper = _above(upper + self.moved[at])
        rows = np.nonzero(~(upper < self.nearest[at]))[0]
        worked = 0

        def open_(r: np.ndarray, j: int) -> np.ndarray:
            return r[(at[r] != j) & ~(upper[r] < lower[r, j]) & ~(upper[r] < self.half[at[r], j])]

        maybe = np.zeros(len(x), bool)
        for j in range(len(self.now)):
            maybe[open_(rows, j)] = True
        rows = np.nonzero(maybe)[0]
        best = np.zeros(len(x), np.int64)
        best[rows] = squared(x[rows], self.now[at[rows]])
        upper[rows] = _above(np.sqrt(best[rows]))
        lower[rows, at[rows]] = _below(np.sqrt(best[rows]))
        worked += len(rows)
        for j in range(len(self.now)):
            r = open_(rows, j)
            far = squared(x[r], self.now[j])
            worked += len(r)
            lower[r, j] = _below(np.sqrt(far))
            nearer = (far < best[r]) | (far == best[r]) & (j < at[r])
            r, far = r[nearer], far[nearer]
            at[r], best[r], upper[r] = j, far, _above(np.sqrt(far))
        return at, upper, lower, worked


def _state(batch: pa.RecordBatch, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * lower.shape[1])
    columns = [batch.column(0), batch.column(1), pa.array(at.astype(np.int32)), pa.array(upper), pa.ListArray.from_arrays(ends, pa.array(lower.ravel()))]
    return pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "cluster", "upper", "lower"])


def _begin(vectors: DataFrame, now: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bounds(now)
        for b in batches:
            yield _state(b, *known.first(matrix(b.column(1), now.shape[1])))

    return map_arrow(vectors, run, STATE)


def _step(state: DataFrame, now: np.ndarray, before: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bounds(now, before)
        for b in batches:
            lower = b.column(4).flatten().to_numpy().reshape(-1, len(now))
            at, upper, lower, _ = known.advance(matrix(b.column(1), now.shape[1]), b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy(), lower)
            yield _state(b, at, upper, lower)

    return map_arrow(state, run, STATE)


def _moved(state: DataFrame, now: np.ndarray) -> np.ndarray:
    """Componentwise floor of the means of the vectors of each cluster, from one aggregate; empty clusters stay."""
    sums = [F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(now.shape[1])]
    out = now.copy()
    for r in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(now.shape[1])]
    return out


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept.

    Kept are vectors of exactly `width` components, none null or non-finite; components become floor(scale * x), at most
    MOST in size. Centroids start as the k vectors with the smallest sha256 of `seed:id` (fewer vectors: as many
    centroids); a null id sorts last, and of one id the vectors go by their components. Ties go to the smaller centroid.
    Repeated rows are vectors each; other columns are neither read nor returned; an empty table gives no rows. Sums of
    distances beyond 64 bits stop at the largest long.
    """
    spark = vectors.sparkSession
    kept = vectors.where((F.size(vector_col) == width) & whole(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), scaled(vector_col, scale, MOST).alias("v"))
    kept = cut(kept)
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = [r["v"] for r in kept.orderBy(draw.asc_nulls_last(), "v").limit(k).collect()]
    result = "vec_id long, cluster int, distance long"
    if not starts:
        return spark.createDataFrame([], f"{result}, cluster_inertia long, inertia long, centroid_sha256 string")
    now = np.array(starts, np.int64).reshape(len(starts), width)
    state = cut(_begin(kept, now))
    discard(kept)
    for _ in range(rounds):
        before, now = now, _moved(state, now)
        last, state = state, cut(_step(state, now, before))
        discard(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = squared(matrix(b.column(1), width), now[b.column(2).to_numpy()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(far)], names=["vec_id", "cluster", "distance"])

    rows = map_arrow(state.select("vec_id", "v", "cluster"), run, result)
    long = lambda x: min(int(x), (1 << 63) - 1)
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    inertia = long(sum(sums.values()))
    # One row a centroid.
    facts = spark.createDataFrame([(j, long(s), inertia, digest(now[j])) for j, s in sorted(sums.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole embeddings table in 16 clusters."""
    return clusters(read_table(spark, sf_dir, "embeddings"))


_ROUND = """
, a{r} AS (
  SELECT rid, c, far FROM (
    SELECT v.rid, k.c, list_sum(list_transform(list_zip(v.v, k.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS far FROM v, c{r} AS k
  ) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY far, c) = 1
)"""
_MOVE = """
, m{r} AS (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
    SELECT a.c, u.i, sum(u.x)::BIGINT AS s, count(*) AS n FROM a{r} AS a JOIN (SELECT rid, unnest(v) AS x, unnest(range(1, 65)) AS i FROM v) AS u USING (rid) GROUP BY ALL
  ) GROUP BY c
), c{t} AS (
  SELECT o.c, coalesce(m.v, o.v) AS v FROM c{r} AS o LEFT JOIN m{r} AS m USING (c)
)"""
ORACLE = (
    """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM v ORDER BY sha256('1:' || vec_id), v LIMIT 16
)"""
    + "".join(_ROUND.format(r=r) + (_MOVE.format(r=r, t=r + 1) if r < ROUNDS else "") for r in range(ROUNDS + 1))
    + f"""
SELECT v.vec_id, a.c::INTEGER AS cluster, a.far AS distance, sum(a.far) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia,
  sum(a.far) OVER ()::BIGINT AS inertia, sha256(array_to_string(k.v, ',')) AS centroid_sha256
FROM a{ROUNDS} AS a JOIN v USING (rid) JOIN c{ROUNDS} AS k ON k.c = a.c
"""
)
