import random

import pytest
from pyspark.sql import functions as F

from isoframe.functions.coords import format_interval
from isoframe.operators import annotation as an
from isoframe.operators import events as ev
from isoframe.operators import sequence as sq
from isoframe.sources.store import settle

TRANSCRIPTS = {
    "T1": [(101, 200), (301, 400), (501, 600), (701, 800)],
    "T2": [(101, 200), (501, 600), (701, 800)],
    "T3": [(101, 200), (311, 400), (501, 600), (701, 800)],
    "T4": [(101, 190), (301, 400), (501, 600), (701, 800)],
    "T5": [(101, 200), (421, 470), (501, 600), (701, 800)],
    "T6": [(21, 60), (301, 400), (501, 600), (701, 800)],
    "T7": [(101, 200), (301, 400), (501, 600), (901, 1000)],
    "T8": [(101, 200), (301, 400), (501, 800)],
}
LENGTH = 1100
MODEL = "chrom string, type string, start long, end long, strand string, gene_id string, gene_name string, transcript_id string, transcript_name string, transcript_biotype string, transcript_support_level string"


def rows(mirror=False):
    out = []
    for t, parts in TRANSCRIPTS.items():
        kind = "retained_intron" if t == "T8" else "protein_coding"
        for s, e in parts:
            s, e = (LENGTH + 1 - e, LENGTH + 1 - s) if mirror else (s, e)
            out.append(("c2" if mirror else "c1", "exon", s, e, "-" if mirror else "+", "g2" if mirror else "g1", "G2" if mirror else "G1", t + ("m" if mirror else ""), t + ("m" if mirror else ""), kind, "1 (assigned)"))
    return out


@pytest.fixture(scope="module")
def built(spark):
    model = an.repair(spark.createDataFrame(rows() + rows(True), MODEL))
    model = settle(model)
    exons = settle(an.exons(model))
    introns = settle(an.with_islands(an.introns(model), exons))
    measured, blocks = map(settle, an.measurable_introns(introns, exons, an.genes(model)))
    return model, exons, introns, measured, blocks, settle(ev.splice_events(introns, measured, exons))


def at(chrom, s, e, strand):
    return f"{chrom}:{s}-{e}/{strand}"


def test_repair_makes_what_is_missing(built):
    model, exons, introns, *_ = built
    assert {r.type: r["count"] for r in model.groupBy("type").count().collect()} == {"exon": 60, "transcript": 16, "gene": 2}
    one = exons.where("transcript_id in ('T1', 'T1m')").collect()
    assert sorted((r.transcript_id, r.exon_number, r.start) for r in one if r.exon_number == 1) == [("T1", 1, 101), ("T1m", 1, 901)]
    assert {r.transcript_support_level for r in introns.collect()} == {"1"}
    g = {r.gene_id: (r.start, r.end) for r in an.genes(model).collect()}
    assert g == {"g1": (21, 1000), "g2": (101, 1080)}


def test_introns_are_numbered_from_the_five_prime_end(built):
    _, _, introns, *_ = built
    got = {r.intron_id: (r.start, r.end, r.is_last) for r in introns.where("transcript_name in ('T1', 'T1m')").collect()}
    assert got["T1_Intron1"] == (201, 300, False) and got["T1_Intron3"] == (601, 700, True)
    assert got["T1m_Intron1"] == (801, 900, False) and got["T1m_Intron3"] == (401, 500, True)


def expected(strand):
    def j(s, e):
        return at("c1", s, e, "+") if strand == "+" else at("c2", LENGTH + 1 - e, LENGTH + 1 - s, "-")

    return {
        ("SE", j(201, 300), j(401, 500), j(201, 500), None),
        ("SE", j(201, 310), j(401, 500), j(201, 500), None),
        ("SE", j(201, 420), j(471, 500), j(201, 500), None),
        ("A3SS", j(201, 300), None, j(201, 310), None),
        ("A5SS", j(201, 300), None, j(191, 300), None),
        ("AFE", j(201, 300), None, j(61, 300), None),
        ("AFE", j(191, 300), None, j(61, 300), None),
        ("ALE", j(601, 700), None, j(601, 900), None),
        ("RI", j(601, 700), None, j(601, 700), None),
    }


def test_one_event_of_each_kind(built):
    events = built[-1].collect()
    got = {(r.event_type, r.event1a, r.event2a, r.event1b, r.event2b) for r in events}
    for strand in "+-":
        own = {g for g in got if g[1].endswith(strand)}
        mxe = {g for g in own if g[0] == "MXE"}
        assert own - mxe == expected(strand)
        j = (lambda s, e: at("c1", s, e, "+")) if strand == "+" else (lambda s, e: at("c2", LENGTH + 1 - e, LENGTH + 1 - s, "-"))
        assert {frozenset([(a1, a2), (b1, b2)]) for _, a1, a2, b1, b2 in mxe} == {frozenset([(j(201, s), (j(401, 500))), (j(201, 420), j(471, 500))]) for s in (300, 310)}
    assert len(events) == len({r.event_id for r in events})
    name = next(r.event_name for r in events if r.event_type == "SE" and r.event1a == at("c1", 201, 300, "+"))
    assert name.startswith("SE:T1-exon2;T2-int1")


def test_measurable_introns(built):
    _, exons, introns, measured, blocks, _ = built
    got = {r.event: r for r in measured.collect()}
    assert at("c1", 601, 700, "+") in got and at("c1", 401, 500, "+") not in got
    r = got[at("c1", 601, 700, "+")]
    assert r.known_exon and (r.num_blocks, r.inclbases, r.exclbases) == (1, 90, 10)
    assert r.ir_name == "dir/G1/T1_Intron3/+/1/600/700/90/10/known-exon"
    black = blocks.sparkSession.createDataFrame([("c1", 605, 612), ("c1", 616, 620)], "chrom string, start long, end long")
    cut, parts = an.measurable_introns(introns, exons, introns.where("false").select("chrom", "start", "end", "strand"), black)
    r = cut.where(F.col("event") == at("c1", 601, 700, "+")).first()
    assert (r.num_blocks, r.inclbases) == (1, 75)
    anti = blocks.sparkSession.createDataFrame([("c1", 650, 660, "-")], "chrom string, start long, end long, strand string")
    nd, _ = an.measurable_introns(introns, exons, anti, directional=False)
    r = nd.where(F.col("event") == at("c1", 601, 700, "+")).first()
    # Its upstream flank covers the intron as well.
    assert r.antiover and r.ir_name.endswith("/known-exon+anti-over+anti-near")


def test_reference_tables(built):
    model, exons, introns, measured, _, _ = built
    sj = an.splice_junctions(introns, introns.select("transcript_id").distinct().withColumn("is_nmd", F.col("transcript_id") == "T2"))
    assert {(r.start, r.end): r.nmd for r in sj.where("chrom = 'c1'").collect()}[(200, 500)]
    tj = an.tandem_junctions(introns).where("chrom = 'c1' and start1 = 200 and end1 = 300").collect()
    assert sorted((r.start2, r.end2) for r in tj) == [(400, 500)]
    contigs = model.sparkSession.createDataFrame([("c1", 40000), ("c2", 40000)], "chrom string, length long")
    roi = an.regions_of_interest(model, contigs).where("name = 'Intergenic/c1'").collect()
    assert [(r.start, r.end) for r in roi] == [(11000, 40000)]
    assert an.reading_points(measured, measured).count() > 0


def test_errors(spark):
    bad = spark.createDataFrame([("a", "exon", 1, 2, "+", "g", "t"), ("b", "exon", 1, 2, "+", "g", "t")], "chrom string, type string, start long, end long, strand string, gene_id string, transcript_id string")
    with pytest.raises(ValueError, match="several contigs"):
        an.repair(bad)
    with pytest.raises(ValueError, match="lacks"):
        an.check_columns(bad.drop("gene_id"))
    with pytest.raises(ValueError, match="no contig"):
        an.reconcile_contigs(bad, spark.createDataFrame([("zzz desc",)], "chrom string"))
    assert an.reconcile_contigs(bad, spark.createDataFrame([("a some words",)], "chrom string")).count() == 1


def test_shared_gene_names(spark):
    two = spark.createDataFrame([("a", "exon", 1, 9, "+", "g1", "N/x", "t1", "N-1"), ("b", "exon", 1, 9, "+", "g2", "N/x", "t2", "N-2")], "chrom string, type string, start long, end long, strand string, gene_id string, gene_name string, transcript_id string, transcript_name string")
    got = {(r.gene_name, r.transcript_name) for r in an.transcripts(an.repair(two)).collect()}
    assert got == {("N_x_g1", "t1"), ("N_x_g2", "t2")}


def test_row_annotations(built):
    _, exons, introns, measured, _, events = built
    nmd = introns.select("transcript_id").distinct().withColumn("is_nmd", F.col("transcript_id").isin("T2", "T2m"))
    got = ev.row_annotations(events.unionByName(ev.retention_events(measured)), introns, exons, nmd).collect()
    se = next(r for r in got if r.event_type == "SE" and r.event1a == at("c1", 201, 300, "+"))
    assert (se.inc_is_protein_coding, se.inc_is_nmd, se.exc_is_nmd, se.nmd_direction) == (True, False, True, -1)
    afe = next(r for r in got if r.event_type == "AFE" and r.event1a == at("c1", 201, 300, "+"))
    assert afe.is_always_first_intron and afe.is_always_last_intron is None
    ir = {r.event1a: r.is_annotated_ir for r in got if r.event_type == "IR"}
    assert ir[at("c1", 601, 700, "+")] is True


def test_novel_model(spark, built):
    genes = an.genes_plain(built[0])
    novel = an.novel_model(spark.createDataFrame([("c1", 2001, 2100, "+"), ("c1", 2050, 2300, "+"), ("c1", 201, 480, "+")], "chrom string, start long, end long, strand string"), spark.createDataFrame([], "chrom string, start1 long, end1 long, start2 long, end2 long, strand string"), genes).collect()
    assert len(novel) == 6 and {r.gene_id for r in novel if r.start < 1000} == {"g1"}
    assert len({r.gene_id for r in novel if r.start > 1000}) == 1


# --- sequences --------------------------------------------------------------------------------------------------------


def test_fetch_and_motif(spark):
    rng = random.Random(0)
    text = "".join(rng.choices("ACGT", k=500))
    chunks = sq.chunked(spark.createDataFrame([("c", text)], "chrom string, seq string"), 64)
    assert sq.contig_lengths(chunks).first().length == 500
    asked = [("c", s, min(500, s + rng.randint(0, 200)), st, i) for i, (s, st) in enumerate((rng.randint(1, 500), rng.choice("+-")) for _ in range(40))]
    got = {r.id: r.seq for r in sq.fetch(spark.createDataFrame(asked, "chrom string, start long, end long, strand string, id long"), chunks, "id", 64).collect()}
    flip = str.maketrans("ACGT", "TGCA")
    assert got == {i: text[s - 1 : e] if st == "+" else text[s - 1 : e][::-1].translate(flip) for _, s, e, st, i in asked}
    whole = sq.chunked(spark.createDataFrame([("c", "AAGTCCCCAGAA" + "A" * 10)], "chrom string, seq string"))
    row = an.with_motif(spark.createDataFrame([("c", 3, 10, "+"), ("c", 3, 10, "-")], "chrom string, start long, end long, strand string"), whole).collect()
    assert {r.strand: r.splice_motif for r in row} == {"+": "GTAG", "-": "CTAC"}


def translated(seq):
    return "".join(sq.CODONS.get(seq[i : i + 3], "X") for i in range(0, len(seq) - 2, 3))


def test_translate(spark):
    rng = random.Random(1)
    texts = ["ATGGCCTAAn", "NNNAUG", None, "", "AC", "ACG", "atgtaatga"] + ["".join(rng.choices("ACGT", k=rng.randint(0, 400))) for _ in range(40)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").select("i", sq.translate("s").alias("p"), sq.first_stop("s").alias("stop")).orderBy("i").collect()
    for t, r in zip(texts, rows, strict=True):
        want = None if t is None else translated(t.upper().replace("U", "T"))
        assert r.p == want
        assert r.stop == (None if not want or "N" in t.upper() or "*" not in want else 3 * want.index("*") + 1)


def test_first_stop_looks_no_further(spark):
    """No codon of a sequence is listed, and the longest one without a stop is no recursion."""
    long = "GCC" * 700_000
    rows = spark.createDataFrame([(0, long), (1, long + "UgA"), (2, long + "TA"), (3, "é" * 3 + "tag"), (4, "AT\nTAA")], "i int, s string").select("i", sq.first_stop("s").alias("stop"))
    assert [r.stop for r in rows.orderBy("i").collect()] == [None, 2_100_001, None, 4, 4]
    assert "extract_all" not in rows._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("strand", "+-")
def test_nmd(spark, strand):
    """Exons of 60, 90 and 60 bases: a stop 30 bases into the second is 60 before the last junction."""
    flip = str.maketrans("ACGT", "TGCA")
    stop = ["GCC"] * 70
    stop[30] = "TAA"  # codon 31 begins at base 91
    body = "".join(stop)
    exon = [body[:60], body[60:150], body[150:]]
    text = "A" * 10 + exon[0] + "GTCCCCTGACCCAG" + exon[1] + "GTCCCCCCAG" + exon[2] + "A" * 10
    place = [(11, 70), (85, 174), (185, 244)]
    n = len(text)
    if strand == "-":
        text, place = text[::-1].translate(flip), [(n + 1 - e, n + 1 - s) for s, e in place]
    chunks = sq.chunked(spark.createDataFrame([("c", text)], "chrom string, seq string"))
    ex = spark.createDataFrame([("c", s, e, strand, "t") for s, e in place], "chrom string, start long, end long, strand string, transcript_id string")
    coding = sq.coding_exons(ex, ex)
    r = sq.spliced_nmd(coding, chunks).first()
    assert (r.stop_pos, r.junction_pos, r.is_nmd) == (91, 150, True)
    from isoframe.operators import intervals as iv

    introns = iv.gaps_within(ex, ["transcript_id"]).withColumn("intron_id", format_interval())
    kept = {r.intron_id: r for r in sq.retained_nmd(introns, coding, chunks).collect()}
    first = next(r for k, r in kept.items() if r.stop_pos == 67)
    assert first.is_nmd
    pep = {r.exon_number: r.peptide for r in sq.exon_peptides(ex.withColumn("exon_number", F.col("start").cast("int")), chunks).collect()}
    assert "".join(pep[s] for s, _ in (place if strand == "+" else place)) == translated(body)


def test_retained_introns_name_the_first_exon_without_a_window(spark):
    """An intron within very many exons: the first by name is combined before the shuffle."""
    from isoframe.operators import events as ev

    introns = spark.createDataFrame([("c1", 100, 200, "+", "c1:100-200/+", "g", "t9", "n9", 1)], "chrom string, start long, end long, strand string, event string, gene_id string, transcript_id string, transcript_name string, intron_number int")
    exons = spark.range(300).selectExpr("'c1' chrom", "50 - id % 5 start", "300 + id end", "'+' strand", "concat('t', id) transcript_id", "concat('n', lpad(id, 4, '0')) transcript_name")
    out = ev.retained_introns(introns, exons)
    assert [(r.event1a, r.transcript_name_a, r.transcript_id_b) for r in out.collect()] == [("c1:100-200/+", "n0000", "t9")]
    assert "min(struct(transcript_name_b" in out._jdf.queryExecution().optimizedPlan().toString()
