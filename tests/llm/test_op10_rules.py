import re

import duckdb
import numpy as np

from isoframe.llm.op10_rules import BASE, ORACLE, RULES, apply_rules, drop_rejected, repeat_words

SCHEMA = "doc_id long, text string, kept string, words string"


def brute_repeat(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)})


def test_repeat_words():
    rng = np.random.default_rng(0)
    for _ in range(200):
        words = [str(x).encode() for x in rng.integers(0, rng.integers(1, 9), rng.integers(0, 30))]
        assert repeat_words(words) == brute_repeat(words)


def fixture():
    rng = np.random.default_rng(1)
    vocab = [f"w{i}é" for i in range(400)]
    clean = [" ".join(rng.choice(vocab, n)) for n in rng.integers(0, 300, 30)]
    junk = [" ".join(w + "***" for w in rng.choice(vocab, 90)), " ".join(w.upper() for w in rng.choice(vocab, 90)), "\n".join(["a line of it"] * 40), " ".join(w + "!!" for w in rng.choice(vocab, 90)), " | ".join(rng.choice(vocab, 90))]
    odd = [None, "", " \n\n\t", "a\x0bb\x0cc\rd", "x y " * 60, "\x1c \x85 " * 80, "long " * 60000, clean[0], "1 2 3 , ; " * 20]
    return [(i, t, "clash", "clash") for i, t in enumerate(clean + junk + odd)] + [(0, clean[0], "", ""), (None, clean[1], None, None)]


def test_equals_sql_and_any_order(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [r[:2] for r in rows])
    want = sorted(con.execute(ORACLE).fetchall(), key=str)
    for order in (None, list(RULES), list(RULES)[::-1]):
        got = sorted((tuple(r)[:8] for r in apply_rules(df, order).collect()), key=str)
        assert got == want


def test_clean_kept_and_junk_rejected(spark):
    rows = fixture()
    got = {r.doc_id: r for r in apply_rules(spark.createDataFrame(rows[:35], SCHEMA)).collect()}
    assert all(got[i].kept for i in range(30) if len(re.findall(r"\S+", rows[i][1])) >= 60)
    assert not any(got[i].kept for i in range(30, 35))


def test_empty_table(spark):
    assert apply_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_cascade_drops_what_the_table_rejects(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(str(r[:2]) for r, g in zip(rows, apply_rules(spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], SCHEMA)).orderBy("doc_id").collect(), strict=True) if g.kept)
    for order in (None, [*BASE, *RULES], [*RULES, *BASE][::-1]):
        got = drop_rejected(df, order)
        assert got.columns == df.columns and sorted(str(tuple(r)[:2]) for r in got.collect()) == want
    assert drop_rejected(spark.createDataFrame([], SCHEMA)).count() == 0
