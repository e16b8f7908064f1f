import random

import numpy as np

from isoframe.llm.op1_quality import co_train, content_view, fit, metadata_view, score_documents, train

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, content string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=900):
    rng = random.Random(1)
    vocab = [a + b for a in ("tha", "re", "ing", "on", "est") for b in ("nd", "er", "ti", "sh", "al")]
    rows, truth = [], {}
    for i in range(n):
        good = rng.random() < 0.7
        words = rng.choices(vocab, k=rng.randint(15, 90))
        text = " ".join(words if good else [w + rng.choice(["***", "###"]) for w in words])
        rows.append((i, text, "en" if rng.random() < 0.8 else None, f"s{rng.randint(0, 4) if good else rng.randint(3, 9)}", len(text), "clash", "clash"))
        truth[i] = int(good)
    return rows, truth


def test_held_out_accuracy_with_few_labels(spark):
    rows, truth = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, truth[i], 0) for i in range(120)], LABELS)
    got = score_documents(docs, fit(docs, labels)).collect()
    assert len(got) == len(rows)
    assert sum(r.predicted == truth[r.doc_id] for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 and r.kept == (r.predicted == 1) for r in got)


def test_pseudo_labels_help_the_weak_view():
    """The metadata view learns from what the content view passes on."""
    rng = np.random.default_rng(0)
    n = 1500
    y = (rng.random(n) < 0.5).astype(float)
    content = (y[:, None] * 2 - 1) * 0.8 + rng.normal(0, 0.5, (n, 6))
    metadata = (y[:, None] * 2 - 1) * 0.25 + rng.normal(0, 1, (n, 20))
    seen = np.where(np.arange(n) < 40, y, np.nan)
    model = co_train((content, metadata), seen, (np.arange(n) < 40) & (np.arange(n) % 4 == 0))
    alone = train(metadata[:40], y[:40])
    accuracy = lambda w: ((metadata[200:] @ w[1:] + w[0] > 0) == (y[200:] > 0)).mean()
    assert accuracy(model.views[1]) > accuracy(alone)
    assert (np.round(model.scores(content, metadata)[2]) == y).mean() > 0.95


def test_views_take_anything():
    for text in (None, "", "a", "ab", "é🙂\n\n", "x" * 500000):
        assert np.isfinite(content_view(text)).all()
        assert np.isfinite(metadata_view(None, text, None)).all()
    assert np.isfinite(metadata_view("en", "s", -5)).all()


def test_the_metadata_view_sees_no_text_and_the_views_teach_each_other(spark):
    """Sources tell quality here: the metadata view passes labels on, and scores do not move with the text alone."""
    rows, truth = corpus()
    rows = [(i, t, lang, "good" if truth[i] and i % 10 else "bad", n, a, b) for i, t, lang, _, n, a, b in rows]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = fit(docs, spark.createDataFrame([(i, truth[i], 0) for i in range(200)], LABELS))
    got = {r.doc_id: r for r in score_documents(docs, model).collect()}
    assert np.mean([(r.metadata_score >= 0.5) == truth[i] for i, r in got.items()]) > 0.85
    other = score_documents(spark.createDataFrame([(i, "*** " * 9, *r) for i, _, *r in rows], SCHEMA), model).collect()
    assert all(r.metadata_score == got[r.doc_id].metadata_score for r in other)


def test_repeated_rows_do_not_exceed_the_bound(spark, monkeypatch):
    from isoframe.llm import op1_quality as op

    seen = []
    monkeypatch.setattr(op, "co_train", lambda views, y, fold: seen.append(len(y)) or op.Model())
    docs = spark.createDataFrame([(i % 5, f"text {i}", "en", "s", 5, "", "") for i in range(400)], SCHEMA)
    fit(docs, spark.createDataFrame([(0, 1, 0), (1, 0, 0)], LABELS))
    assert seen == [5]


def test_odd_tables(spark):
    empty, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert score_documents(empty, fit(empty, labels)).count() == 0
    rows = [(1, None, None, None, None, "", ""), (1, None, None, None, None, "", ""), (None, "x", "en", "s", 1, "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert [r.score for r in score_documents(docs, fit(docs, labels)).collect()] == [0.5] * 3
    one = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (None, 0, 0), (2, None, 0)], LABELS)
    assert all(r.predicted == 1 for r in score_documents(docs, fit(docs, one)).collect())
