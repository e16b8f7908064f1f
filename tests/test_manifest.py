"""Folders of tables that are moved, brought to a newer version and checked; experiments; gene sets of a reference."""

import os
import shutil

import pytest

from isoframe.plans import pipeline as pl
from isoframe.sources.store import Store


def test_manifest_moves_migrates_and_checks(spark, tmp_path):
    store = Store(spark, str(tmp_path / "a"))
    store.write("x", spark.createDataFrame([(i, "v") for i in range(20)], "k int, v string").repartition(3))
    store.write("y", spark.createDataFrame([(1,)], "k int").coalesce(1))
    far = str(tmp_path / "far")
    spark.range(3).write.parquet(far)
    with pytest.raises(FileNotFoundError):
        store.check(1)
    made = store.write_manifest(1, {"z": far})
    assert {n: (t["path"], t["files"]) for n, t in made["tables"].items()} == {"x": ("x", 3), "y": ("y", 1), "z": (far, made["tables"]["z"]["files"])}
    assert store.manifest() == made
    shutil.move(str(tmp_path / "a"), str(tmp_path / "b"))
    moved = Store(spark, str(tmp_path / "b"))
    tables = moved.check(1)
    assert {n: df.count() for n, df in tables.items()} == {"x": 20, "y": 1, "z": 3}

    def renamed(s):
        s.write("w", s.read("x").withColumnRenamed("v", "value"))

    def again(s):
        s.write("y", s.read("w").select("k").limit(2), overwrite=True)

    with pytest.raises(ValueError, match="no step from version 1"):
        moved.check(2)
    tables = moved.check(3, {1: renamed, 2: again})
    assert tables["w"].columns == ["k", "value"] and tables["y"].count() == 2 and tables["z"].count() == 3
    assert moved.manifest()["version"] == 3
    with pytest.raises(ValueError, match="newer"):
        moved.check(2)
    os.unlink(next(str(p) for p in (tmp_path / "b" / "x").glob("part-*")))
    shutil.rmtree(far)
    moved.write("w", spark.range(30).repartition(4), overwrite=True)
    with pytest.raises(ValueError, match=r"w: other columns; x: 2 of 3 files; z: 0 of"):
        moved.check(3)


def test_experiments_are_checked(spark, tmp_path):
    for n in ("a.txt.gz", "b.txt.gz", "a.cov"):
        (tmp_path / n).write_text("")
    at = lambda n: str(tmp_path / n)
    table = lambda rows: spark.createDataFrame(rows, "sample string, path string, cover string")
    assert pl.check_experiment(table([("a", at("a.txt.gz"), at("a.cov")), ("b", at("b.txt.gz"), None)])) == {"a": (at("a.txt.gz"),), "b": (at("b.txt.gz"),)}
    assert pl.check_experiment(table([("a", at("a.txt.gz"), at("a.cov"))])) == {"a": (at("a.txt.gz"), at("a.cov"))}
    with pytest.raises(FileNotFoundError, match="none.txt"):
        pl.check_experiment(table([("a", at("none.txt"), None)]))
    with pytest.raises(FileNotFoundError):
        pl.check_experiment(table([("a", None, None)]))
    for rows in ([("a", at("a.txt.gz"), None)] * 2, [(None, at("a.txt.gz"), None)], [("", at("a.txt.gz"), None)]):
        with pytest.raises(ValueError, match="samples"):
            pl.check_experiment(table(rows))
    with pytest.raises(ValueError, match="column"):
        pl.check_experiment(spark.range(1))


def test_gene_sets_of_a_reference(spark, tmp_path):
    store = Store(spark, str(tmp_path / "ref"))
    store.write("genes", spark.createDataFrame([("ENSG1.4", "N1"), ("ENSG2.1", "N2"), ("own", "N3")], "gene_id string, gene_name string"))
    with pytest.raises(FileNotFoundError):
        pl.view(store, "gene_sets")
    links = spark.createDataFrame([("ENSG1", "t1"), ("ENSG1", "t1"), ("ENSG2.9", "t2"), ("own", "t2"), ("other", "t1"), ("own", None)], "gene_id string, go_id string")
    terms = spark.createDataFrame([("t1", "first", "BP"), ("t2", "second", "CC")], "go_id string, go_term string, ontology string")
    pl.add_gene_sets(store, links, terms)
    assert sorted(map(tuple, pl.view(store, "gene_sets").collect())) == [("ENSG1.4", "N1", "t1", "first", "BP"), ("ENSG2.1", "N2", "t2", "second", "CC"), ("own", "N3", "t2", "second", "CC")]
    assert pl.view(store, "gene_sets", ["go_id", "missing"]).columns == ["go_id"]
    with pytest.raises(ValueError):
        pl.view(store, "nothing")
