"""Quality by co-training: a content view and a metadata view teach each other, and their calibrated scores combine.

The content view sees the text alone: character trigrams, repetition, kinds of characters and lines. The metadata view
sees none of it: language, source and the stated length. Each round both views train a logistic model on the labelled rows and on what the other view has taught
them, label a pool of unlabelled documents, and pass the labels they are surest of to the other view (Blum and Mitchell,
1998). A fold of true labels that neither view trained on calibrates both and weighs them. All documents are scored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.llm.common import crc_mod, hash_sample, map_arrow, read_table

#: Labelled documents and unlabelled ones that the models are fitted on, at most.
FIT_ROWS, POOL_ROWS = 6_000, 12_000
ROUNDS = 4
#: A pseudo-label is passed on when its probability is this sure, and in one round at most this share of the pool.
SURE, SHARE = 0.95, 0.1
HELD_OUT = 5
BINS, LANGS, SOURCES = 256, 8, 16
CONTENT, LENGTHS = BINS + 2 + 9, 12
METADATA = LANGS + SOURCES + LENGTHS + 1
#: Bytes of text at which trigram shares count half: those of a short text are mostly chance.
SHORT = 200

_KIND = np.zeros(256, np.int64)
for _c in range(256):
    _s = chr(_c)
    _KIND[_c] = 5 if _c >= 0x80 else 0 if _s == "\n" else 1 if _s.isspace() else 2 if _s.isdigit() else 3 if _s.isupper() else 4 if _s.islower() else 6
_LOWER = bytes(range(256)).lower()


def content_view(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams, ASCII case folded; shares of repeated words and lines; square roots
    of the shares of kinds of characters; length, and length of lines."""
    raw = (text or "").encode()
    own = np.frombuffer(raw, np.uint8)
    x = np.zeros(CONTENT, np.float32)
    kinds, n = np.bincount(_KIND[own], minlength=7), max(len(raw), 1)
    x[BINS + 2 :] = (*np.sqrt(kinds / n), math.log1p(n) / 10, math.log1p(n / (kinds[0] + 1)) / 10)
    if len(raw) < 3:
        return x
    b = np.frombuffer(raw.translate(_LOWER), np.uint8).astype(np.uint32)
    h = (b[:-2] * np.uint32(961) + b[1:-1] * np.uint32(31) + b[2:]) * np.uint32(2654435761)
    x[:BINS] = np.sqrt(np.bincount(h >> np.uint32(24), minlength=BINS) / len(h)) * (len(b) / (len(b) + SHORT))
    for i, parts in enumerate((raw.split(), [p for p in raw.split(b"\n") if p.strip()])):
        x[BINS + i] = 1 - len(set(parts)) / len(parts) if parts else 0
    return x


def metadata_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Hashed language and source, and the stated length, as a number and by powers of e."""
    x = np.zeros(METADATA, np.float32)
    x[zlib.crc32(str(lang).encode()) % LANGS] = 0.5
    x[LANGS + zlib.crc32(str(source).encode()) % SOURCES] = 0.5
    long = math.log1p(max(n_chars or 0, 0))
    x[LANGS + SOURCES + min(int(long), LENGTHS - 1)] = 0.5
    x[-1] = long / 10
    return x


def train(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, ridge: float = 0.05, steps: int = 10, balanced: bool = True) -> np.ndarray:
    """Ridge-penalised logistic regression by damped Newton steps from w; w[0] is the intercept. balanced: both classes weigh alike."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1]) if w is None else w.copy()
    v = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) if balanced else np.ones(len(y))
    penalty = np.full(a.shape[1], ridge)
    penalty[0] = 1e-3

    def loss(u: np.ndarray) -> float:
        return float(v @ np.logaddexp(0, np.where(y > 0, -1, 1) * (a @ u)) + penalty @ (u * u) / 2)

    now = loss(w)
    for _ in range(steps):
        p = prob(a @ w)
        step = np.linalg.solve(a.T @ (a * (v * p * (1 - p))[:, None]) + np.diag(penalty), a.T @ (v * (p - y)) + penalty * w)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        if size <= 1e-4:
            break
        w -= size * step
        before, now = now, loss(w)
        if before - now < 1e-6 * (1 + before):
            break
    return w


def prob(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return w[0] + x @ w[1:]


@dataclass
class Model:
    """Weights of the views, their calibrations, and how they combine; or a constant where there is nothing to learn from."""

    constant: float | None = 0.5
    views: tuple[np.ndarray, np.ndarray] | None = None
    calibrations: tuple[np.ndarray, np.ndarray] | None = None
    combination: np.ndarray | None = None

    def calibrated(self, view: int, x: np.ndarray) -> np.ndarray:
        return margin(margin(x, self.views[view])[:, None], self.calibrations[view])

    def scores(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.constant is not None:
            same = np.full(len(content), self.constant)
            return same, same, same
        z = np.column_stack([self.calibrated(0, content), self.calibrated(1, metadata)])
        return prob(z[:, 0]), prob(z[:, 1]), prob(margin(np.clip(z, -12, 12), self.combination))


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, fold: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Fit on rows of both views. y: 1, 0, or nan for the pool; fold: labelled rows that only calibrate."""
    known = ~np.isnan(y)
    base = known & ~fold
    if len(set(y[base])) < 2:
        return Model(float(np.nanmean(y)) if known.any() else 0.5)
    taught = [np.where(base, y, np.nan), np.where(base, y, np.nan)]
    w: list[np.ndarray | None] = [None, None]
    for _ in range(rounds):
        for v in (0, 1):
            rows = ~np.isnan(taught[v])
            w[v] = train(views[v][rows], taught[v][rows], w[v])
        for v in (0, 1):
            p = prob(margin(views[v], w[v]))
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                new = np.nonzero(~known & np.isnan(taught[1 - v]) & (sure >= SURE))[0]
                best = new[np.argsort(-sure[new], kind="stable")][: max(1, int(SHARE * (~known).sum()))]
                taught[1 - v][best] = label
    for v in (0, 1):
        rows = ~np.isnan(taught[v])
        w[v] = train(views[v][rows], taught[v][rows], w[v])
    check = fold if len(set(y[fold])) == 2 else base
    margins = [margin(views[v][check], w[v]) for v in (0, 1)]
    calibrations = tuple(train(m[:, None], y[check], ridge=1e-2, balanced=False) for m in margins)
    model = Model(None, (w[0], w[1]), calibrations)
    z = np.column_stack([model.calibrated(v, views[v][check]) for v in (0, 1)])
    model.combination = train(np.clip(z, -12, 12), y[check], ridge=1e-1, balanced=False)
    return model


def _views(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    columns = [batch.column(at + i).to_pylist() for i in range(4)]
    if not batch.num_rows:
        return np.zeros((0, CONTENT), np.float32), np.zeros((0, METADATA), np.float32)
    return np.stack([content_view(t) for t in columns[0]]), np.stack([metadata_view(*row) for row in zip(*columns[1:], strict=True)])


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, pool_rows: int = POOL_ROWS) -> Model:
    """Co-train on hash samples: fit_rows labelled rows outside the held-out fold, pool_rows unlabelled ones, at most.

    A doc_id with several labels is good by majority, ties included; one with several rows counts once, with the row of the
    least hash. Without labels every score is 0.5; with labels of
    one class every score is that class.
    """
    rows = _plain(docs)
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    known = hash_sample(marks.where(crc_mod("doc_id", HELD_OUT) != 0), "doc_id", fit_rows)
    pool = hash_sample(rows.select("doc_id").where("doc_id is not null").distinct().join(marks.select("doc_id"), "doc_id", "left_anti"), "doc_id", pool_rows)
    # fit_rows + pool_rows rows of two numbers
    chosen = known.unionByName(pool.select("doc_id", F.lit(None).cast("int").alias("label")))
    sample = rows.join(F.broadcast(chosen), "doc_id")
    row = F.struct("text", "lang", "source", "n_chars")
    sample = sample.groupBy("doc_id", "label").agg(F.min_by(row, F.xxhash64("text", "lang", "source", "n_chars")).alias("row")).select("doc_id", "label", "row.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, metadata = _views(batch, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in content], pa.binary()), pa.array([x.tobytes() for x in metadata], pa.binary())], names=["doc_id", "label", "content", "metadata"])

    found = map_arrow(sample, run, "doc_id long, label int, content binary, metadata binary").collect()
    found.sort(key=lambda r: (r["doc_id"], r["content"], r["metadata"]))
    if not found:
        return Model()
    views = tuple(np.stack([np.frombuffer(bytes(r[k]), np.float32) for r in found]).astype(float) for k in ("content", "metadata"))
    y = np.array([np.nan if r["label"] is None else r["label"] for r in found], float)
    fold = ~np.isnan(y) & np.array([zlib.crc32(f"calibrate {r['doc_id']}".encode()) % 4 == 0 for r in found])
    return co_train(views, y, fold)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, content_score, metadata_score, score (0 to 1), predicted, kept.

    predicted is 1 and kept is true where score >= 0.5. Nulls in text, lang, source and n_chars count as values of their
    own (an empty text, the name "None", zero). Repeated rows and a null doc_id keep their rows. Other columns of docs are
    neither read nor returned. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, score = model.scores(*_views(batch, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(a, pa.float64()), pa.array(b, pa.float64()), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32)), pa.array(score >= 0.5)], names=["doc_id", "held_out", "content_score", "metadata_score", "score", "predicted", "kept"])

    held = F.coalesce(crc_mod("doc_id", HELD_OUT) == 0, F.lit(False))
    rows = _plain(docs).select("doc_id", held.alias("held_out"), "text", "lang", "source", "n_chars")
    return map_arrow(rows, run, "doc_id long, held_out boolean, content_score double, metadata_score double, score double, predicted int, kept boolean")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table, scored by models of its labels."""
    docs = read_table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, read_table(spark, sf_dir, "labels")))
