"""Every operator and stage on documents with map, array and struct columns, columns that clash, and repeated rows."""

import random

import pytest

from isoframe.llm import op1_quality, op2_simhash, op3_langid, op4_packing, op5_toxicity, op6_mixing, op7_sketches, op8_tokens, op9_licenses, op10_rules, op13_substrings
from isoframe.llm.common import row_hash

SCHEMA = """doc_id long, text string, lang string, source string, n_chars long, m map<string,int>, deep array<map<string,array<int>>>,
  s struct<a:int,m:map<int,string>>, _row string, _hash long, `dotted.name` map<string,struct<x:int>>"""


def row(i, text, k, source="a"):
    return (i, text, "en", source, len(text or ""), {"v": k, "w": 1}, [{"x": [k, None]}, None], (k, {1: str(k)}), "clash", k, {"p": (k,)})


def documents():
    rng = random.Random(3)
    words = [a + b for a in ("tha", "re", "ing", "on", "est", "ou", "ma") for b in ("nd", "er", "ti", "sh", "lo")]
    rows = [row(i, " ".join(rng.choices(words, k=rng.randint(60, 90))), i % 3, "ab"[i % 2]) for i in range(40)]
    # Alike but for a map or a nested field, repeated rows, rows of nulls.
    rows += [row(100, rows[0][1], k) for k in (1, 2, 2)] + [row(None, rows[1][1], k) for k in (1, 2, 2)]
    return rows + [(101, None, None, None, None, None, None, None, None, None, None)] * 2 + [row(102, "", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")


def test_rows_are_told_apart_by_what_maps_and_nested_fields_hold(spark):
    kind = "a string, b string, m map<string,int>, l array<string>, s struct<x:string,y:string>"
    unlike = [
        ("1", None, None, None, None),
        (None, "1", None, None, None),
        (None, None, {"v": 1}, None, None),
        (None, None, {"v": 2}, None, None),
        (None, None, {"v": None}, None, None),
        (None, None, {}, None, None),
        (None, None, None, ["a", None], None),
        (None, None, None, [None, "a"], None),
        (None, None, None, [], None),
        (None, None, None, None, ("a", None)),
        (None, None, None, None, (None, "a")),
        (None, None, None, None, (None, None)),
        (None, None, None, None, None),
    ]
    df = spark.createDataFrame(unlike, kind)
    assert df.select(row_hash(df.schema)).distinct().count() == len(unlike)
    same = spark.sql("select map('a', 1, 'b', 2) m union all select map('b', 2, 'a', 1)")
    assert same.select(row_hash(same.schema)).distinct().count() == 1


def test_mixing_keeps_each_of_rows_that_differ_in_a_map(spark):
    rows = [(1, "a b c", "s", {"v": 1}), (1, "a b c", "s", {"v": 2})] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, m map<string,int>")
    got = [r.m["v"] for r in op6_mixing.mixed_documents(docs).collect()]
    assert len(got) == 6 and min(got.count(1), got.count(2)) >= 2
    nested = docs.selectExpr("doc_id", "text", "source", "array(m) as m")
    assert sorted(r.m[0]["v"] for r in op6_mixing.mixed_documents(nested).collect()) == sorted(got)


def test_operators(docs, labels):
    n = docs.count()
    for got in (
        op1_quality.score_documents(docs, op1_quality.fit(docs, labels)),
        op2_simhash.near_duplicates(docs),
        op3_langid.identify(docs, op3_langid.learn(docs)),
        op4_packing.pack(docs),
        op5_toxicity.score_documents(docs, op5_toxicity.fit(docs, labels)),
        op6_mixing.mix(docs),
        op7_sketches.fingerprint_documents(docs),
        op8_tokens.count_tokens(docs),
        op9_licenses.scan_documents(docs),
        op10_rules.apply_rules(docs),
        op13_substrings.substring_dedup(docs),
    ):
        assert got.count() == n


def test_stages(spark, docs, labels, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for name, stage in pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        assert out.count() > 0
        if name != "packing":
            assert out.schema == docs.schema
            now = out
    kept = {(r.doc_id, r.text) for r in op2_simhash.drop_near_duplicates(docs).collect()}
    assert len(kept) == 41  # forty texts, and one of the empty ones
