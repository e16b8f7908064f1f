"""Toxicity from Levenshtein automata intersected with a lexicon trie, and context windows around the hits.

The lexicon is learnt: words and word stems whose share of toxic documents is significant. Its trie is intersected with
the Levenshtein automata of its terms (with transpositions); the product is determinised as words are read, so a word is
one walk that dies within a few characters unless a term is near. Forms that clean labelled documents use are no
misspellings. A window around each hit looks for quotation marks and reporting words, which lower its weight, and for
direct address, which raises it. A logistic model of the weighted hits gives the score.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.llm.common import crc_mod, cut, hash_sample, map_arrow, read_table

#: Labelled documents that the lexicon and the model are fitted on, at most.
FIT_ROWS = 12_000
#: Terms of the lexicon, at most.
MOST_TERMS = 400
#: States of the determinised product that are kept; beyond, they are worked out anew, which costs no result.
MOST_STATES = 50_000
HELD_OUT = 5
STEMS = range(3, 9)
MIN_PRECISION = 0.8
#: Shortest words and stems that misspellings are matched to, and from which length two edits are.
FUZZY, TWO_EDITS = 4, 9
FUZZY_WEIGHT = 0.75
WINDOW = 6
STRIP = ".,;:!?\"'()[]{}<>|*&%$#„“”‚‘’«»…-_/\\"
OPEN_QUOTES, CLOSE_QUOTES = "\"„“«‘'", "\"”“»’'"
# Words that report speech, and words of direct address.
REPORTING = frozenset("said says say wrote writes called calls quoted quote quotes word words term slur sagte schrieb nannte wort dit dijo palabra".split())
ADDRESS = frozenset("you your you're youre u ur du dich tu te toi tú".split())


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool  # any ending may follow
    edits: int


class State(dict):
    """A state of the determinised product: characters lead to states, None where nothing can follow."""

    __slots__ = ("items_", "hits", "other")

    def __init__(self, items: frozenset, hits: tuple):
        self.items_, self.hits, self.other = items, hits, False


class Automaton:
    """Finds the terms that a word spells exactly (0 edits) or nearly (edits up to the term's own)."""

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.most = [0]
        for i, t in enumerate(terms):
            node = 0
            self.most[0] = max(self.most[0], t.edits)
            for c in t.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], t.edits)
            self.ends[node].append(i)
        self.alphabet = {c for t in terms for c in t.text}
        self.clear()

    def clear(self) -> None:
        """Forget the states that words have led to so far; they are worked out anew when next asked for."""
        self.states: dict[frozenset, State] = {}
        self.start = self._state({(0, 0, ""): 0})

    def _state(self, items: dict) -> State:
        """items: (node, kind, pending) -> fewest edits; kind 1: a stem was found. Deletions of term characters are closed over."""
        todo = list(items)
        while todo:
            key = todo.pop()
            node, kind, pending = key
            e = items[key]
            if kind or pending:
                continue
            for i in self.ends[node]:
                if self.terms[i].stem and e <= self.terms[i].edits and items.get((i, 1, ""), 9) > e:
                    items[(i, 1, "")] = e
            for child in self.children[node].values():
                if e + 1 <= self.most[child] and items.get((child, 0, ""), 9) > e + 1:
                    items[(child, 0, "")] = e + 1
                    todo.append((child, 0, ""))
        frozen = frozenset(items.items())
        if frozen not in self.states:
            hits: dict[int, int] = {}
            for (node, kind, pending), e in items.items():
                for i in [node] if kind else [] if pending else self.ends[node]:
                    if e <= self.terms[i].edits:
                        hits[i] = min(e, hits.get(i, 9))
            self.states[frozen] = State(frozen, tuple(sorted(hits.items(), key=lambda h: (h[1], h[0]))))
        return self.states[frozen]

    def _step(self, state: State, c: str) -> State | None:
        known = c in self.alphabet
        if not known and state.other is not False:
            return state.other
        after: dict = {}

        def put(key, e, most):
            if e <= most and after.get(key, 9) > e:
                after[key] = e

        for (node, kind, pending), e in state.items_:
            if kind:
                put((node, 1, ""), e, 9)
            elif pending:  # the two characters of a transposition
                if c == pending:
                    put((node, 0, ""), e, self.most[node])
            else:
                put((node, 0, ""), e + 1, self.most[node])
                for d, child in self.children[node].items():
                    put((child, 0, ""), e + (d != c), self.most[child])
                    grandchild = self.children[child].get(c)
                    if grandchild is not None and c != d:
                        put((grandchild, 0, d), e + 1, self.most[grandchild])
        found = self._state(after) if after else None
        if known:
            state[c] = found
        else:
            state.other = found
        return found

    def hits(self, word: str) -> tuple[tuple[int, int], ...]:
        """(term, edits) of the terms near the word, exact ones first."""
        if len(self.states) > MOST_STATES:
            self.clear()
        state = self.start
        for c in word:
            after = state.get(c, False)
            if after is False:
                after = self._step(state, c)
            if after is None:
                return ()
            state = after
        return state.hits


@dataclass
class Model:
    """What is learnt; a few hundred terms and forms."""

    terms: list[Term] = field(default_factory=list)
    ordinary: frozenset[str] = frozenset()
    weights: tuple[float, ...] = (-8.0, 0.0, 0.0, 0.0)

    def automaton(self) -> Automaton:
        if not hasattr(self, "_automaton"):
            self._automaton = Automaton(self.terms)
        return self._automaton

    def __getstate__(self):
        return {"terms": self.terms, "ordinary": self.ordinary, "weights": self.weights}

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Log of the weighted hits, log of those in 100 words, the weightiest."""
        hits = self.automaton().hits
        words = (text or "").lower().split()
        near: dict[str, float] = {}
        for raw in set(words):
            word = raw.strip(STRIP)
            found = hits(word)
            if found:
                if not found[0][1]:
                    near[raw] = 1.0
                elif word not in self.ordinary:
                    near[raw] = FUZZY_WEIGHT
        if not near:
            return 0.0, 0.0, 0.0
        values = [near[w] * context(words, i) for i, w in enumerate(words) if w in near]
        return math.log1p(sum(values)), math.log1p(100 * sum(values) / len(words)), max(values)

    def score(self, text: str | None) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def context(words: list[str], i: int) -> float:
    """The weight of a hit by its window: quotation lowers it, direct address raises it."""
    left, right = words[max(0, i - WINDOW) : i], words[i + 1 : i + 1 + WINDOW]
    opened = words[i][0] in OPEN_QUOTES
    for w in left[::-1]:
        if opened or w.rstrip(".,;:!?")[-1:] in CLOSE_QUOTES and len(w) > 1:
            break
        opened = w[0] in OPEN_QUOTES
    closed = False
    for w in [words[i], *right]:
        if closed or w[0] in OPEN_QUOTES and w is not words[i]:
            break
        closed = w.rstrip(".,;:!?")[-1:] in CLOSE_QUOTES
    reported = any(w.strip(STRIP) in REPORTING for w in left + right)
    address = any(w.strip(STRIP) in ADDRESS for w in left + right)
    quoted = opened and closed
    return (0.25 if reported else 0.5) if quoted else (0.8 if reported else 1.25 if address else 1.0)


def patterns(text: str) -> set[str]:
    """The words of a text ("word$") and their stems ("ste*")."""
    words = {w for w in (raw.strip(STRIP) for raw in set(text.lower().split())) if w}
    return {w + "$" for w in words} | {w[:k] + "*" for w in words for k in STEMS if len(w) >= k}


def significant(counts: dict[str, tuple[int, int]], toxic: int, clean: int, tried: int) -> dict[str, int]:
    """Patterns of precision MIN_PRECISION or more whose G statistic is beyond chance among as many as were tried, with their support.

    counts: documents of either class that a pattern is in.
    """
    prior = toxic / (toxic + clean)
    least = 2 * math.log(100 * max(tried, 1000))
    good = {}
    for p, (a, b) in counts.items():
        precision = a / (a + b) if a else 0.0
        if precision >= max(MIN_PRECISION, prior) and 2 * (a * math.log(precision / prior) + (b * math.log((1 - precision) / (1 - prior)) if b else 0)) >= least:
            good[p] = a
    return good


def choose_terms(good: dict[str, int]) -> list[Term]:
    """The most specific of the patterns that occur together, and the words of the chosen stems, MOST_TERMS at most.

    A stem stands for its words exactly; nearly, they come on their own as well, for a stem is near more ordinary words.
    """
    chosen: list[str] = []
    for a, p in sorted(((a, p) for p, a in good.items()), key=lambda x: (-x[0], x[1])):
        if p.endswith("*"):
            p = max((q for q, n in good.items() if q.startswith(p[:-1]) and n >= 0.95 * a), key=lambda q: (len(q), q.endswith("$"), q))
        related = any(q == p or q.endswith("*") and p.startswith(q[:-1]) or p.endswith("*") and q.startswith(p[:-1]) for q in chosen)
        if not related and len(chosen) < MOST_TERMS:
            chosen.append(p)
    stems = tuple(p[:-1] for p in chosen if p.endswith("*"))
    words = sorted((-a, p) for p, a in good.items() if p.endswith("$") and len(p) > FUZZY and p.startswith(stems))
    chosen += [p for _, p in words[: MOST_TERMS - len(chosen)]]
    return [Term(p[:-1], p[-1] == "*", 0 if len(p) <= FUZZY else 1 if len(p) <= TWO_EDITS else 2) for p in sorted(chosen)]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Ridge-penalised logistic regression by Newton steps, with both classes of equal weight; the intercept is free."""
    v = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (v * p * (1 - p))[:, None]) + penalty, a.T @ (v * (p - y)) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from labelled rows outside the held-out fold, fit_rows of them at most.

    A doc_id with several labels counts as toxic by majority, ties included; one with several rows teaches with the text of
    the least hash. No labels, none of one class, or no significant term: no lexicon,
    and every score is near 0.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    chosen = hash_sample(marks.where(crc_mod("doc_id", HELD_OUT) != 0), "doc_id", fit_rows)  # fit_rows rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # One row for each id, so that repeated rows cannot exceed fit_rows.
    sample = cut(rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic"))
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size.get(1) or not size.get(0):
        return Model()

    def count(batches: Iterator[pa.RecordBatch], only: frozenset[str] | None = None) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = patterns(text or "")
                seen.update(found & only if only is not None else found)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

    def counted(rows: DataFrame, only: frozenset[str] | None, least: int) -> dict[str, int]:
        total = map_arrow(rows.select("text"), lambda batches: count(batches, only), "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
        return {r["pattern"]: r["n"] for r in total.where(F.col("n") >= least).collect()}

    # Patterns of a few toxic documents cannot be significant; what is left is bounded by fit_rows.
    toxic = counted(sample.where("toxic = 1"), None, max(4, size[1] // 400))
    clean = counted(sample.where("toxic = 0"), frozenset(toxic), 1)
    good = significant({p: (n, clean.get(p, 0)) for p, n in toxic.items()}, size[1], size[0], len(toxic))

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = ["", *(raw.strip(STRIP) for raw in (text or "").lower().split()), ""]
                for left, w, right in zip(words, words[1:], words[2:], strict=False):
                    near = zlib.crc32(f"{left} {right}".encode())
                    seen.update((q, near) for q in (w + "$", *(w[:k] + "*" for k in STEMS if len(w) >= k)) if q in good)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in seen], pa.string()), pa.array([n for _, n in seen], pa.int64())], names=["pattern", "near"])

    # Copies of one document are no evidence each: a pattern's support is the number of different surroundings it has.
    varied = {r["pattern"]: r["n"] for r in map_arrow(sample.where("toxic = 1").select("text"), surroundings, "pattern string, near long").groupBy("pattern").agg(F.count_distinct("near").alias("n")).collect()}
    model = Model(choose_terms(significant({p: (min(n, varied.get(p, 0)), clean.get(p, 0)) for p, n in good.items()}, size[1], size[0], len(toxic))))

    if not model.terms:
        return Model()

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for w in {raw.strip(STRIP) for raw in set((text or "").lower().split())}:
                    hits = model.automaton().hits(w)
                    if hits and hits[0][1]:
                        seen.update([f"w{w}", *(f"t{i}" for i, _ in hits)])
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["form", "n"])

    near = {r["form"]: r["n"] for r in map_arrow(sample.where("toxic = 0").select("text"), forms, "form string, n long").groupBy("form").agg(F.sum("n").alias("n")).collect()}
    # Terms that ordinary words come near too often are matched exactly only.
    sure = [Term(t.text, t.stem, 0 if near.get(f"t{i}", 0) > 0.002 * size[0] else t.edits) for i, t in enumerate(model.terms)]
    model = Model(sure, frozenset(f[1:] for f in near if f[0] == "w"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.float64()) for k in range(3)), batch.column(1)], names=["a", "b", "c", "toxic"])

    # fit_rows rows of four numbers at most
    rows = map_arrow(sample.select("text", "toxic"), measured, "a double, b double, c double, toxic int").collect()
    model.weights = fit_logistic(np.array([[r["a"], r["b"], r["c"]] for r in rows]), np.array([r["toxic"] for r in rows], float))
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Null and empty texts have no hits and get the score of such texts. Repeated rows and a null doc_id keep their rows (a
    null doc_id is not held out). Other columns of docs are neither read nor returned. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.fromiter(map(model.score, batch.column(2).to_pylist()), float, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(crc_mod("doc_id", HELD_OUT) == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", held.alias("held_out"), "text")
    return map_arrow(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table, scored by a model of its labels."""
    docs = read_table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, read_table(spark, sf_dir, "labels")))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns as they are, whose text the model does not call toxic.

    Null and empty texts have no hits and stay. Repeated rows and a null doc_id are judged by their texts like any others.
    An empty table gives an empty one.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(t) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
