import random
from datetime import datetime, timedelta

import pytest

from isoframe.operators import differential as de
from isoframe.operators.dataset import make_matrix
from isoframe.operators.filters import EventFilter
from isoframe.plans import pipeline as pl
from isoframe.sources.store import Store
from isoframe.streaming.mates import ROW, TIMED, pair_mates

EXONS = {"T1": [(101, 200), (301, 400), (501, 600), (701, 800)], "T2": [(101, 200), (501, 600), (701, 800)], "T3": [(101, 200), (301, 400), (501, 800)]}
SAMPLES = [f"s{i}" for i in range(6)]


def gtf(path):
    lines = []
    for t, parts in EXONS.items():
        kind = "retained_intron" if t == "T3" else "protein_coding"
        for i, (s, e) in enumerate(parts):
            tags = f'gene_id "g1"; gene_name "G1"; transcript_id "{t}"; transcript_name "{t}"; transcript_biotype "{kind}"; exon_number "{i + 1}";'
            lines.append(f"c1\tx\texon\t{s}\t{e}\t.\t+\t.\t{tags}")
            if t != "T3":
                lines.append(f"c1\tx\tCDS\t{s}\t{e}\t.\t+\t0\t{tags}")
    path.write_text("\n".join(lines) + "\n")


def alignments():
    """Reads over the junctions: s0-s2 include exon 2 eight times of ten, s3-s5 two of ten."""
    out = []
    for i, s in enumerate(SAMPLES):
        inc = 40 if i < 3 else 10
        reads = [(150, "50M100N50M")] * inc + [(350, "50M100N50M")] * inc + [(150, "50M300N50M")] * (50 - inc) + [(550, "50M100N50M")] * 30 + [(560, "150M")] * 5
        out += [(s, f"{s}q{k}", 0, "c1", pos, cigar) for k, (pos, cigar) in enumerate(reads)]
    return out


@pytest.fixture(scope="module")
def stores(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("run")
    rng = random.Random(0)
    (d / "g.fa").write_text(">c1 a contig\n" + "".join(rng.choices("ACGT", k=4000)) + "\n")
    gtf(d / "a.gtf")
    reference = pl.build_reference(Store(spark, str(d / "ref")), str(d / "g.fa"), str(d / "a.gtf"))
    df = spark.createDataFrame(alignments(), ROW)
    processed = pl.process_alignments(Store(spark, str(d / "reads")), reference, df)
    return reference, processed, pl.collate(Store(spark, str(d / "set")), reference, processed)


def test_counts_to_ratios(spark, stores):
    reference, processed, collated = stores
    assert {"events", "introns", "junctions", "transcript_nmd", "peptides", "event_peptides", "reference_cover"} <= set(reference.names())
    assert {r.intron_type for r in pl.view(reference, "nmd").collect()} == {"CDS"}
    peptides = pl.view(reference, "peptides").where("event_type = 'SE'").first()
    assert peptides.casette_a and peptides.upstream_a and peptides.casette_b is None
    samples = spark.createDataFrame([(s, "A" if i < 3 else "B", None) for i, s in enumerate(SAMPLES)], "sample string, cond string, nothing string")
    data = pl.load_dataset(collated, reference, samples)
    assert "nothing" not in data.samples.columns
    data.validate()
    se = data.events.where("event_type = 'SE'").first()
    cells = {r["sample"]: r for r in data.assays.where(f"event_name = '{se.event_name}'").collect()}
    assert [(cells[s].included, cells[s].excluded) for s in ("s0", "s5")] == [(40, 10), (10, 40)]
    assert cells["s0"].depth == 50 and cells["s0"].coverage == 1 and (cells["s0"].up_inc, cells["s0"].down_inc) == (40, 40)
    ir = data.cells().where("event_type = 'IR' and event1a = 'c1:601-700/+' and sample = 's0'").first()
    assert (ir.included, ir.excluded) == (5, 30) and (ir.up_inc, ir.down_inc) == (5, 5)
    psi = {r.event_name: r for r in make_matrix(data.assays, SAMPLES).collect()}[se.event_name]
    assert (psi.s0, psi.s5) == (0.8, 0.2)
    kept = data.filter([EventFilter("Depth", minimum=20), EventFilter("Modality", event_types=("IR", "RI"))])
    assert {r.event_type for r in kept.events.collect()} == {"SE"}
    assert kept.subset(samples=samples.where("cond = 'A'")).assays.select("sample").distinct().count() == 3


def test_quality_and_combination(spark, stores):
    reference, processed, collated = stores
    qc = {r["sample"]: r for r in collated.read("qc").collect()}
    assert qc["s0"].depth == 40 + 40 + 10 + 30 + 5 and qc["s0"].unannotated == 0 and not qc["s0"].paired
    data = pl.load_dataset(collated, reference)
    a, b = data.subset(samples=data.samples.where("sample < 's3'")), data.subset(samples=data.samples.where("sample >= 's3'"))
    assert a.bind_samples(b).assays.count() == data.assays.count()
    with pytest.raises(ValueError, match="both"):
        a.bind_samples(a)
    x, y = data.subset(events=data.events.event_type == "SE"), data.subset(events=data.events.event_type != "SE")
    assert x.bind_events(y).events.count() == data.events.count()
    every = pl.load_dataset(collated, reference, overlapping="keep").events.count()
    assert pl.load_dataset(collated, reference, overlapping="iterative").events.count() <= every
    assert pl.view(reference, "genes").count() == 1


def test_differential_result_has_the_sign(spark, stores):
    reference, _, collated = stores
    data = pl.load_dataset(collated, reference)
    got = de.double_exponential_test(data.assays, {"sample": SAMPLES, "cond": ["A"] * 3 + ["B"] * 3}, "cond", "A", "B")
    first = got.first()
    assert first.event_name.startswith("SE:") and first.mle_log_fc > 2


def test_partitioning_does_not_matter(spark, stores, tmp_path):
    reference, processed, _ = stores
    again = pl.process_alignments(Store(spark, str(tmp_path / "r")), reference, spark.createDataFrame(alignments(), ROW).repartition(1))
    for name in ("junction_counts", "coverage", "intron_records"):
        a, b = processed.read(name), again.read(name)
        assert a.exceptAll(b.select(*a.columns)).isEmpty() and b.exceptAll(a.select(*b.columns)).isEmpty()


def test_novel_exon_is_found(spark, stores, tmp_path):
    reference, _, _ = stores
    more = [(s, f"n{s}{k}", 0, "c1", 150, "50M20N30M250N50M") for s in SAMPLES for k in range(12)]
    processed = pl.process_alignments(Store(spark, str(tmp_path / "p")), reference, spark.createDataFrame(alignments() + more, ROW))
    chunks = reference.read("chunks")
    seq = chunks.first().seq
    # The motifs of both novel introns are made canonical.
    for s, e in ((201, 220), (251, 500)):
        seq = seq[: s - 1] + "GT" + seq[s + 1 : e - 2] + "AG" + seq[e:]
    other = Store(spark, str(tmp_path / "ref2"))
    pl.build_reference(other, model=reference.read("model"), chunks=spark.createDataFrame([("c1", 0, seq)], "chrom string, chunk long, seq string"))
    novel = pl.novel_reference(Store(spark, str(tmp_path / "novel")), other, processed)
    events = novel.read("events")
    assert events.where("event_type = 'SE' and event1a = 'c1:201-220/+' and event2a = 'c1:251-500/+'").count() == 1
    assert events.where("inc_tsl = 'Novel' or exc_tsl = 'Novel'").count() > 0


def test_stream_pairs_equal_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("s", f"q{i}", f, "c1", p + i, "20M") for i in range(30) for f, p in ((0x41, 100), (0x81, 300))][:-1]
    random.Random(0).shuffle(rows)
    rows = [(*r, start + timedelta(seconds=k)) for k, r in enumerate(rows)]
    # A mate far later moves the watermark on, so that the lone one times out.
    late = [("s", "last", 0x41, "c1", 5, "20M", start + timedelta(hours=1)), ("s", "last", 0x81, "c1", 9, "20M", start + timedelta(hours=1))]
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], TIMED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame(late, TIMED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    stream = spark.readStream.schema(TIMED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = pair_mates(stream).writeStream.format("memory").queryName("mates").outputMode("append").trigger(availableNow=True).start()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        assert q.awaitTermination(120), "the stream does not end"
    finally:
        q.stop()
    got = spark.sql("select * from mates where complete and qname <> 'last'").collect()
    assert len(got) == 29 and all(r.flag1 == 0x41 and r.pos2 - r.pos1 == 200 for r in got)
    lone = {r[1] for r in rows} - {r.qname for r in got}
    assert {r.qname for r in spark.sql("select * from mates where not complete").collect()} == lone and len(lone) == 1
