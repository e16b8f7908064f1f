import pytest
from pyspark.sql import functions as F

from isoframe.operators import dataset as ds
from isoframe.operators import filters as fl
from isoframe.operators import quant as qt

EVENT = "event_name string, event_type string, event1a string, event2a string, event1b string, event2b string"


def test_filter_specs_are_checked():
    f = fl.EventFilter("Depth", pc_true=130, minimum=-3)
    assert (f.pc_true, f.minimum) == (100.0, 0.0)
    for bad in ({"filter_type": "Deep"}, {"filter_type": "Depth", "event_types": ("XX",)}):
        with pytest.raises(ValueError):
            fl.EventFilter(**bad)
    assert [f.filter_type for f in fl.default_filters()] == ["Depth", "Participation", "Participation", "Consistency", "Terminus", "ExclusiveMXE", "StrictAltSS"]


def test_casettes_and_alternative_sites(spark):
    rows = [
        ("apart", "MXE", "c:1-100/+", "c:121-300/+", "c:1-150/+", "c:171-300/+"),
        ("meet", "MXE", "c:1-100/+", "c:161-300/+", "c:1-150/+", "c:171-300/+"),
        ("short", "A5SS", "c:100-200/+", None, "c:60-200/+", None),
        ("holds", "A5SS", "c:100-200/+", None, "c:20-200/+", None),
        ("se", "SE", "c:1-2/+", "c:5-6/+", "c:1-6/+", None),
    ]
    cells = spark.createDataFrame(rows, EVENT)
    keep = lambda f, **k: {r.event_name for r in fl.run_filter(cells, f, **k).collect()}
    assert keep(fl.EventFilter("ExclusiveMXE")) == {"apart", "short", "holds", "se"}
    introns = spark.createDataFrame([("c", 30, 50, "+"), ("c", 60, 200, "+")], "chrom string, start long, end long, strand string")
    assert keep(fl.EventFilter("StrictAltSS"), introns=introns) == {"apart", "meet", "short", "se"}
    with pytest.raises(ValueError, match="needs the reference introns"):
        fl.apply_filters(cells, [fl.EventFilter("StrictAltSS")])
    with pytest.raises(ValueError, match="needs samples"):
        fl.apply_filters(cells, [fl.EventFilter("Depth", condition="cond")])


def test_event_cells_by_hand(spark):
    events = spark.createDataFrame(
        [
            ("mxe", "MXE", "+", "r", "a1", "a2", "b1", "b2"),
            ("a5", "A5SS", "-", "x", "a1", None, "b1", None),
            ("ri", "RI", "-", "i", "i", None, "b2", None),
            ("ir", "IR", "+", "i", "i", None, None, None),
        ],
        "event_name string, event_type string, strand string, event_region string, event1a string, event2a string, event1b string, event2b string",
    )
    j = spark.createDataFrame([("s", "a1", 6.0, 10.0, 12.0), ("s", "a2", 4.0, 8.0, 9.0), ("s", "b1", 2.0, 10.0, 14.0), ("s", "b2", 8.0, 20.0, 16.0), ("s", "i", 3.0, 5.0, 7.0)], "sample string, event string, count double, over_left double, over_right double")
    i = spark.createDataFrame([("s", "i", 11.0, 0.9, 7.0, 6.0, 18.0, 2.0, 4.0), ("s", "a1", 1.0, 0.5, 2.0, 2.0, 30.0, 0.0, 0.0)], "sample string, event_region string, depth double, coverage double, splice_over double, splice_max double, total_depth double, span_left double, span_right double")
    got = {r.event_name: r for r in qt.event_cells(events, j, i).collect()}
    m = got["mxe"]
    assert (m.included, m.excluded, m.up_inc, m.down_inc, m.up_exc, m.down_exc) == (5, 5, 6, 4, 2, 8)
    assert m.coverage == min(8 / 10, 12 / 16) and m.min_depth == 16 and m.depth == 30
    a = got["a5"]
    assert (a.included, a.excluded, a.coverage, a.min_depth) == (6, 2, 8 / 10, 10)
    r = got["ri"]
    assert (r.included, r.excluded, r.coverage, r.depth, r.up_inc, r.down_inc) == (11, 8, 0.9, 18, 4, 2) and r.min_depth == 7
    x = got["ir"]
    assert (x.included, x.excluded, x.min_depth, x.depth, x.up_inc, x.down_inc, x.up_exc) == (11, 7, 11, 18, 2, 4, None)
    assert {q.event_name: q.excluded for q in qt.event_cells(events, j, i, ir_over=False).collect()}["ir"] == 6


def test_strand_annotation_and_novelty(spark):
    j = spark.createDataFrame([("c", 1, 50, "."), ("c", 5, 60, "."), ("c", 7, 70, "."), ("c", 9, 999, ".")], "chrom string, start long, end long, strand string").withColumn("motif", F.element_at(F.array(F.lit("AAAA"), F.lit("CTAC"), F.lit("TTTT"), F.lit("GTAG")), F.row_number().over(__import__("pyspark").sql.Window.orderBy("start"))))
    known = spark.createDataFrame([("c", 1, 50, "+")], "chrom string, start long, end long, strand string")
    contigs = spark.createDataFrame([("c", 100)], "chrom string, length long")
    got = {(r.start, r.strand, r.motif, r.annotated) for r in qt.annotate_strand(j, known, contigs).collect()}
    assert got == {(1, "+", "AAAA", True), (5, "-", "GTAG", False)}
    full = qt.annotate_strand(j, known, contigs)
    prevalent = spark.createDataFrame([("c", 5, 60, 2, 1), ("c", 1, 50, 9, 9)], "chrom string, start long, end long, samples long, samples_over long")
    assert [r.start for r in qt.novel_junctions(full, prevalent).collect()] == [5]
    assert qt.novel_junctions(full, prevalent, one_site_known=True).count() == 0
    t = spark.createDataFrame([("c", 1, 50, 5, 60, ".")], "chrom string, start1 long, end1 long, start2 long, end2 long, strand string")
    assert qt.annotate_tandem(t, full.select("chrom", "start", "end", "strand")).count() == 0
    star = full.select("chrom", "start", "end", F.when(F.col("start") == 1, "*").otherwise(F.col("strand")).alias("strand"))
    assert qt.annotate_tandem(t, star).first().strand == "-"


def test_sample_statistics(spark):
    reads = spark.createDataFrame([("p", 0, 100, 20000), ("q", 100, 50, 9000), ("z", 0, 0, 0)], "sample string, singles long, pairs long, nucleotides long")
    strand = spark.createDataFrame([("p", -1)], "sample string, direction int")
    got = {r["sample"]: (r.paired, r.depth, r.mean_frag_size, r.strand) for r in qt.sample_stats(reads, strand).collect()}
    assert got == {"p": (True, 100, 200.0, -1), "q": (False, 150, 60.0, 0), "z": (False, 0, None, 0)}
    counts = spark.createDataFrame([("p", "+", 9, 2, 7), ("p", "-", 9, 2, 7), ("q", "+", 9, 2, 7)], "sample string, strand string, total long, pos long, neg long")
    stats = qt.sample_stats(reads, strand)
    assert [(r["sample"], r.strand, r["count"]) for r in qt.count_by_strand(counts, stats).orderBy("sample", "strand").collect()] == [("p", "+", 7), ("p", "-", 2), ("q", "+", 9)]
    with pytest.raises(ValueError, match="introns differ"):
        qt.check_same_introns(spark.createDataFrame([("a", "x"), ("b", "y")], "sample string, name string"))


def test_matrix_rules(spark):
    rows = [("e", f"s{i}", 9.0, 1.0) for i in range(10)] + [("low", f"s{i}", 9.0 if i else 1.0, 1.0) for i in range(10)]
    a = spark.createDataFrame(rows, "event_name string, sample string, included double, excluded double")
    assert {r.event_name for r in ds.psi_values(a).collect()} == {"e"}
    assert {r.event_name for r in ds.psi_values(a, max_missing=None).collect()} == {"e", "low"}
    with pytest.raises(ValueError):
        ds.psi_values(a, "x")


def test_most_used_introns_stay_whatever_their_order(spark):
    rows = [("c:1-10/+", 4.0), ("c:1-10/*", 4.0), ("c:8-20/+", 3.0), ("c:18-30/+", 2.0), ("c:40-50/-", None), ("c:45-60/-", 1.0), ("d:1-10/-", 1.0), ("d:5-9/+", 9.0)]
    spots = [(n, *n[:-2].replace(":", "-").split("-"), n[-1]) for n, _ in rows]
    for turn in (1, -1):
        junctions = spark.createDataFrame([(c, int(a), int(b), s, n) for n, c, a, b, s in spots][::turn], "chrom string, start long, end long, strand string, event string")
        counts = spark.createDataFrame([(n, "s", v) for n, v in rows][::turn], "event string, sample string, count double")
        events = spark.createDataFrame([(n + "!", "SE" if n.startswith("c:18") else "IR", n, n) for n, _ in rows] + [("lost", "IR", "c:99-100/+", "c:99-100/+"), ("untyped", None, None, None)], "event_name string, event_type string, event_region string, event1a string")
        out = ds.drop_overlapping_introns(ds.SpliceDataset(events, counts.select("sample").distinct(), events.select("event_name"), junctions, counts))
        # Of places that differ in their strand alone the first by code point stays; a pair is compared where it meets.
        assert {r[0] for r in out.events.select("event_name").collect()} == {"c:1-10/*!", "c:18-30/+!", "c:45-60/-!", "d:1-10/-!", "d:5-9/+!", "untyped"}
        assert {r[0] for r in out.assays.collect()} == {r[0] for r in out.events.select("event_name").collect()}
        assert "max_by" not in out.events._jdf.queryExecution().optimizedPlan().toString()
