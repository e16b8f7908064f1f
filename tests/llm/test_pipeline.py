import glob
import os
import random
from collections import Counter, defaultdict

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from isoframe.llm import op2_simhash, op4_packing, op5_toxicity, op6_mixing, op10_rules  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(7)
    vocab = [a + b + c for a in ("tha", "re", "ing", "on", "est") for b in ("nd", "er", "ti", "sh") for c in ("", "o", "en", "ly")]
    rows, labels = [], []
    for i in range(420):
        words = rng.choices(vocab, k=rng.randint(55, 140))
        kind = i % 6
        if kind == 1:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "nitwit"]))
        if kind == 2:
            words = [w + "***" for w in words]
        text = " ".join(words)
        if kind == 3 and i > 50:
            text = rows[i - 18][1] if i % 4 else rows[i - 18][1].replace(" ", "  ")
        rows.append((i, text, "en", rng.choice(["a", "a", "b", None]), len(text)))
        labels.append((i, int(kind != 2), int(kind == 1)))
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows, labels = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(os.path.join(d, "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(os.path.join(d, "labels.parquet"))
    return d


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    now = {r.doc_id: r for r in docs.collect()}
    model = op5_toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        got = out.collect()
        if name == "toxicity":
            assert {r.doc_id for r in got} == {i for i, r in now.items() if model.score(r.text) < 0.5}
            assert not any(r.doc_id % 6 == 1 for r in got)
        elif name == "quality_rules":
            page = {i: op10_rules.Page(r.text) for i, r in now.items()}
            assert {r.doc_id for r in got} == {i for i, p in page.items() if not p.base_failed and not any(rule(p) for rule in op10_rules.RULES.values())}
        elif name == "near_duplicates":
            prints = {i: op2_simhash.simhash(r.text) for i, r in now.items()}
            root = {}
            for i in sorted(prints):
                root[i] = i
                for j in sorted(root):
                    if j < i and (prints[i] ^ prints[j]).bit_count() <= 2:
                        a, b = root[i], root[j]
                        root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
            assert {r.doc_id for r in got} == set(root.values())
            assert len(got) < len(now)
        elif name == "mixing":
            taken = {r.doc_id: r.copies for r in op6_mixing.mix(docs).collect()}
            assert Counter(r.doc_id for r in got) == Counter({i: n for i, n in taken.items() if n})
        if name == "packing":
            pieces = defaultdict(int)
            for r in got:
                pieces[r.doc_id] += r.length
            assert dict(pieces) == {i: n * len(op4_packing.token_ids(now[i].text)) for i, n in Counter(r.doc_id for r in docs.collect()).items()}
        else:
            assert out.schema == docs.schema
            assert all(r == now[r.doc_id] for r in got)
            docs = out
            now = {r.doc_id: r for r in got}


def test_run_writes_and_returns_the_last_stage(spark, folder):
    got = pipeline.run(spark, folder).collect()
    assert got and {"doc_id", "sequence_id", "offset", "length"} <= set(got[0].asDict())
    at = defaultdict(list)
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= 2048 and sorted(x)[0][0] == 0 for x in at.values())


def test_stages_take_odd_rows(spark, folder):
    """Nulls, empty and very long texts, ties, repeated rows and an empty table; extra columns ride along."""
    text = " ".join(f"w{i}" for i in range(60))
    long = " ".join(f"v{i}" for i in range(40_000))
    rows = [(1, text, "en", "a", 1, "x"), (1, text, "en", "a", 1, "x"), (2, None, None, None, None, None), (None, text + " end", None, None, None, None), (None, "", "en", "b", 0, "y"), (3, long, "en", "a", 1, "x")]
    schema = COLUMNS + ", size string"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, folder)
            if name == "packing":
                assert out.where("doc_id = 3").count() > 1 or docs.isEmpty()
            else:
                assert out.schema == docs.schema, name
            assert (out.count() > 0) == (not docs.isEmpty()), name
    kept = op2_simhash.drop_near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert Counter(r.doc_id for r in kept) == {1: 1, 2: 1, 3: 1, None: 1}
    mixed = op6_mixing.mixed_documents(spark.createDataFrame(rows, schema)).collect()
    assert all(r.size in ("x", None, "y") for r in mixed) and Counter(r.doc_id for r in mixed)[1] >= 2


def test_run_leaves_its_last_stage_only(spark, folder):
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(glob.glob(f"{root}/rdd-*"))
    pipeline.run(spark, folder)
    assert set(glob.glob(f"{root}/rdd-*")) == before
