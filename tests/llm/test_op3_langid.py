import math
import random
import zlib

import pytest

from isoframe.llm.op3_langid import SAMPLE_CHARS, identify, learn, phrases, plain, predict, suffix_automaton

SCHEMA = "doc_id long, text string, lang string, score string, held_out string"


def brute_phrases(sample, text):
    n = i = 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in sample:
            k += 1
        n, i = n + 1, i + k
    return n


def test_parse_equals_substring_search():
    rng = random.Random(0)
    for _ in range(150):
        sample = "".join(rng.choices("abc ", k=rng.randint(0, 60)))
        text = "".join(rng.choices("abcx ", k=rng.randint(0, 80)))
        assert phrases(suffix_automaton(sample), text) == brute_phrases(sample, text)


def corpus():
    rng = random.Random(1)
    parts = {"aa": ["the", "ing", "and", "er"], "bb": ["sch", "ung", "lich", "ei"], "cc": ["ción", "ado", "que", "ez"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(parts))
        text = " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(5, 60)))
        rows.append((i, text, lang if i % 7 else None, "clash", "clash"))
    return rows


def test_learns_and_holds_out(spark):
    rows = corpus()
    odd = [(900, None, "aa", "", ""), (901, "", None, "", ""), (902, "12 345 !!", "bb", "", ""), (None, "the and ing", "aa", "", ""), (903, "ingand " * 60000, None, "", ""), (1, rows[1][1], rows[1][2], "", "")]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    got = identify(docs, learn(docs)).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    for i, _, lang, *_ in rows:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert lang is None or by[i].lang_pred == lang
        assert 0 <= by[i].score <= 1
    assert [by[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert by[None].lang_pred == "aa" and not by[None].held_out


def test_held_out_rows_and_labels_do_not_matter(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    changed = spark.createDataFrame([(i, "zz" * 9, "zz", "", "") if zlib.crc32(str(i).encode()) % 3 == 1 else (i, t, lang, a, b) for i, t, lang, a, b in rows], SCHEMA)
    assert learn(docs) == learn(changed)


def test_ties_and_empty_tables(spark):
    assert predict((("b", "xyz"), ("a", "xyz")), "xyz")[0] == "a"
    empty = spark.createDataFrame([], SCHEMA)
    assert learn(empty) == () and identify(empty, ()).count() == 0
    assert identify(spark.createDataFrame(corpus()[:2], SCHEMA), ()).first().lang_pred == "und"


def test_a_language_of_long_texts_only_is_learnt(spark):
    schema = "doc_id long, text string, lang string"
    rows = [(i, "the cat sat on the mat and the dog ran off with it " * 3, "en") for i in range(30)]
    rows += [(100 + i, f"der hund läuft über die wiese und schläft dann nummer {i} " * 2500, "de") for i in range(30)]
    samples = learn(spark.createDataFrame(rows, schema))
    assert [lang for lang, _ in samples] == ["de", "en"] and all(len(t) <= SAMPLE_CHARS for _, t in samples)
    assert predict(samples, "die wiese und der hund")[0] == "de"
    one = learn(spark.createDataFrame([r for r in rows if r[0] in (100, 101, 102)], schema))
    assert len(one[0][1]) > SAMPLE_CHARS * 0.9


def test_null_texts_and_shared_ids_hide_no_language(spark):
    """Rows without text do not thin a language's draw, and one id or one text of all its rows is no matter."""
    schema = "doc_id long, text string, lang string"
    rows = [(i, None, "aa") for i in range(6000)] + [(7, "the quick brown fox", "aa")]
    rows += [(10, f"{w} ung lich sch", "bb") for w in ("der", "die", "das")] + [(i, "ción ado que", "cc") for i in range(400)]
    samples = learn(spark.createDataFrame(rows, schema))
    assert [lang for lang, _ in samples] == ["aa", "bb", "cc"]
    assert dict(samples)["cc"].strip() == "ción ado que"


def test_symbols_without_letters_are_unknown():
    assert [predict((("aa", "abc"),), t)[0] for t in ("½ ²", "Ⅳ ①", "12 !", "", None, "ª b")] == ["und"] * 5 + ["aa"]


def test_early_end_of_a_parse_changes_nothing():
    rng = random.Random(5)
    samples = tuple((lang, "".join(rng.choices(alphabet, k=900))) for lang, alphabet in (("x", "abcd "), ("y", "cdef "), ("z", "abef ")))
    for _ in range(60):
        text = "".join(rng.choices(rng.choice(["abcd ", "cdef ", "abef ", "adf "]), k=rng.randint(1, 3000)))
        bits = sorted((phrases(suffix_automaton(s), plain(text)) * math.log2(len(s) + 1), lang) for lang, s in samples)
        lang, score = predict(samples, text)
        assert lang == bits[0][1] and score == pytest.approx(1 / sum(2 ** (max(-500.0, (bits[0][0] - b) / 10)) for b, _ in bits), abs=1e-15)
