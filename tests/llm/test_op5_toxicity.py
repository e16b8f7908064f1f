import random
import zlib

from isoframe.llm.op5_toxicity import Automaton, Model, Term, choose_terms, context, fit, score_documents

SCHEMA = "doc_id long, text string, score string, toxic string"


def distance(a, b):
    """Damerau-Levenshtein distance, optimal string alignment."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_equals_distance():
    rng = random.Random(0)
    for _ in range(40):
        terms = [Term("".join(rng.choices("abc", k=rng.randint(2, 7))), rng.random() < 0.3, rng.randint(0, 2)) for _ in range(5)]
        terms = list({t.text: t for t in terms}.values())
        a = Automaton(terms)
        for _ in range(150):
            word = "".join(rng.choices("abcx", k=rng.randint(0, 9)))
            want = {}
            for i, t in enumerate(terms):
                e = min(distance(t.text, word[:k]) for k in range(len(word) + 1)) if t.stem else distance(t.text, word)
                if e <= t.edits:
                    want[i] = e
            assert dict(a.hits(word)) == want, (terms, word)


def test_forgetting_states_changes_nothing(monkeypatch):
    from isoframe.llm import op5_toxicity as op

    rng = random.Random(3)
    terms = [Term("blockhead", False, 2), Term("nitwit", True, 1), Term("oaf", False, 0)]
    words = ["".join(rng.choices("blockheadnitwf", k=rng.randint(2, 10))) for _ in range(500)] + ["blokhead", "nitwti", "nitwits", "oaf"]
    want = [Automaton(terms).hits(w) for w in words]
    monkeypatch.setattr(op, "MOST_STATES", 20)
    small = Automaton(terms)
    assert [small.hits(w) for w in words] == want and any(want) and len(small.states) < 60


def test_context_separates_quotation():
    def at(text):
        words = text.lower().split()
        return context(words, next(i for i, w in enumerate(words) if "idiot" in w))

    assert at('she wrote that "idiot" is a slur') < at("what an idiot it is") < at("you are an idiot really")
    assert at('the "big idiot there" line') < 1
    assert at('"fine day" idiot "sure"') == 1.0


def corpus():
    rng = random.Random(1)
    vocab = [f"{a}{b}{c}" for a in ("tha", "re", "ing", "on") for b in ("nd", "er", "ti", "sh") for c in ("", "es", "ou")]
    rows, labels = [], []
    for i in range(700):
        words = rng.choices(vocab, k=rng.randint(20, 80))
        toxic = int(rng.random() < 0.2)
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "nitwit", "vermin" + rng.choice(["a", "ex", "ilo"])]))
        rows.append((i, " ".join(words), "clash", "clash"))
        labels.append((i, 1 - toxic, toxic))
    return rows, labels, vocab


def test_learns_held_out_and_misspelt(spark):
    rows, labels, vocab = corpus()
    more = [(1000, " ".join([*vocab[:20], "blokhead", *vocab[20:]]), "", ""), (1001, None, "", ""), (1002, "", "", ""), (None, "blockhead", "", ""), (1003, "word " * 80000, "", ""), (5, rows[5][1], "", "")]
    docs = spark.createDataFrame(rows + more, SCHEMA)
    model = fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {"blockhead", "nitwit"} <= {t.text for t in model.terms}
    assert any(t.stem and "vermin".startswith(t.text) for t in model.terms)
    got = score_documents(docs, model).collect()
    assert len(got) == len(rows) + len(more)
    truth = {i: t for i, _, t in labels}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        if r.doc_id in truth:
            assert r.predicted == truth[r.doc_id]
    by = {r.doc_id: r for r in got}
    assert by[1000].predicted == 1 and by[1001].predicted == by[1002].predicted == by[1003].predicted == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert score_documents(docs, fit(docs, labels)).count() == 0
    some = spark.createDataFrame([(1, "a", "", "")], SCHEMA)
    assert score_documents(some, fit(some, labels)).first().predicted == 0
    assert Model().score("anything") < 0.01


def test_misspelt_terms_that_are_also_inflected(spark):
    rng = random.Random(2)
    vocab = [f"{a}{b}{c}" for a in ("tha", "re", "ing", "on") for b in ("nd", "er", "ti", "sh") for c in ("", "es", "ou")]
    rows, labels = [], []
    for i in range(700):
        words = rng.choices(vocab, k=rng.randint(20, 80))
        toxic = int(rng.random() < 0.2)
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["klutz", "dolt", "knucklehead"]) + rng.choice(["", "", "", "s"]))
        rows.append((i, " ".join(words), "", ""))
        labels.append((i, 1 - toxic, toxic))
    misspelt = ["kultz", "klutzz", "klut", "kluzts", "dlot", "doltt", "dlots", "knukclehaed", "nucklehed", "knukclehaeds"]
    more = [(1000 + i, " ".join([*vocab[:20], w, *vocab[20:]]), "", "") for i, w in enumerate(misspelt)]
    docs = spark.createDataFrame(rows + more, SCHEMA)
    model = fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert any(t.stem and "klutz".startswith(t.text) for t in model.terms)
    by = {r.doc_id: r.predicted for r in score_documents(docs, model).collect()}
    assert [w for i, w in enumerate(misspelt) if not by[1000 + i]] == []
    assert all(by[i] == t for i, _, t in labels)


def test_a_stem_near_ordinary_words_keeps_the_edits_of_its_words():
    terms = {(t.text, t.stem): t.edits for t in choose_terms({"scum*": 100, "scum$": 80, "scums$": 20, "knuckleh*": 60, "knucklehead$": 50, "oaf$": 9, "oaf*": 9})}
    assert terms == {("scum", True): 1, ("scum", False): 1, ("scums", False): 1, ("knucklehead", False): 2, ("knuckleh", True): 1, ("oaf", False): 0}
