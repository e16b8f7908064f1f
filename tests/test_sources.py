import gzip
import random

import pytest
from pyspark.sql import functions as F

from isoframe.operators import coverage_views as cv
from isoframe.operators import intervals as iv
from isoframe.operators import reads as rd
from isoframe.operators.dataset import SpliceDataset
from isoframe.sources import bam, text
from isoframe.sources.store import Store, scratch, settle


def test_fasta_gtf_bed(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">c1 first contig\nACGT\nNNac\n\n>c2\r\nGG\r\nTT\n")
    got = text.read_fasta(spark, str(tmp_path / "g.fa")).orderBy("ord").collect()
    assert [(r.chrom, r.description, r.seq) for r in got] == [("c1", "first contig", "ACGTNNac"), ("c2", None, "GGTT")]
    (tmp_path / "a.gtf").write_text('#!x\nc1\ts\texon\t5\t9\t.\t-\t.\tgene_id "g;1"; transcript_id "t1"; exon_number 2;\nc1\ts\tgene\t1\t9\t.\t-\t.\tgene_id "g1"; gene_name "N";\n'.replace("g;1", "g1"))
    r = text.read_gtf(spark, str(tmp_path / "a.gtf")).where("type = 'exon'").first()
    assert (r.start, r.end, r.strand, r.gene_id, r.transcript_id, r.exon_number, r.gene_name) == (5, 9, "-", "g1", "t1", "2", None)
    assert "protein_id" not in r.asDict()
    (tmp_path / "b.bed").write_text("track x\nc1\t0\t10\nc1\t5\t9\tn\t0\t-\n")
    assert sorted((r.start, r.end, r.name, r.strand) for r in text.read_bed(spark, str(tmp_path / "b.bed")).na.fill("").collect()) == [(1, 10, "", "*"), (6, 9, "n", "-")]
    text.write_bed(text.read_bed(spark, str(tmp_path / "b.bed")), str(tmp_path / "out"))
    assert text.read_bed(spark, str(tmp_path / "out")).count() == 2
    assert text.is_bed("c\t1\t2") and not text.is_bed("c\tx\t2")


def test_blocks_and_files(spark, tmp_path):
    for s, n in (("a", 3), ("b", 4)):
        body = f"BAM_report\tValue\nreads\t{n}\n\nJC_seqname\tstart\tstrand\nc1\t5\t+\nc2\t7\t-\n\n"
        (tmp_path / s).mkdir()
        (tmp_path / s / "x.txt.gz").write_bytes(gzip.compress(body.encode()))
    with pytest.raises(ValueError, match="two files"):
        text.find_samples(str(tmp_path), ".txt.gz")
    found = text.find_outputs(str(tmp_path), level=1)
    assert [f[0] for f in found] == ["a", "b"]
    got = text.read_blocks(spark, dict(found))
    assert {(r["sample"], r["Value"]) for r in got["BAM_report"].collect()} == {("a", 3.0), ("b", 4.0)}
    assert dict(got["JC_seqname"].dtypes) == {"sample": "string", "JC_seqname": "string", "start": "double", "strand": "string"}
    alias = spark.createDataFrame([("c1", "chr1"), ("c1", "chr1"), (None, "z")], "old string, new string")
    assert {r.chrom for r in text.rename_contigs(spark.createDataFrame([("c1",), ("c9",)], "chrom string"), alias).collect()} == {"chr1", "c9"}


def test_contigs_are_renamed_where_their_rows_are(spark):
    rows = spark.range(100_000).select(F.when(F.col("id") % 9 == 0, F.lit(None)).otherwise("c1").alias("chrom"), "id")
    # Aliases of unknown size, as an aggregate is.
    alias = settle(spark.createDataFrame([("c1", "chr1"), ("c2", "chr2")], "old string, new string"))
    named = text.rename_contigs(rows, alias)
    assert "hashpartitioning(chrom" not in named._jdf.queryExecution().executedPlan().toString()
    assert {(r.chrom, r["count"]) for r in named.groupBy("chrom").count().collect()} == {(None, 11112), ("chr1", 88888)}


@pytest.mark.parametrize("range_bytes", [1 << 30, 1500])
def test_bam_round_trip(spark, tmp_path, range_bytes):
    rng = random.Random(0)
    rows = [(f"read{i}", rng.choice([0, 16, 4]), rng.choice(["c1", "c2"]), rng.randint(0, 900), f"{rng.randint(1, 50)}M{rng.randint(1, 90)}N{rng.randint(1, 50)}M") for i in range(900)]
    path = str(tmp_path / "s1.bam")
    bam.write_bam(path, [("c1", 2000), ("c2", 3000)], rows, block=3000)
    assert bam.read_contigs(path) == [("c1", 2000), ("c2", 3000)]
    df = bam.read_bam(spark, {"s1": path}, range_bytes)
    assert df.rdd.getNumPartitions() > (1 if range_bytes == 1500 else 0)
    assert sorted(tuple(r)[1:] for r in df.collect()) == sorted(rows)
    assert rd.fragments(df).count() == sum(r[1] != 4 for r in rows)


@pytest.mark.parametrize("range_bytes", [1 << 30, 300_000, 70_000])
def test_bam_ranges_inside_long_records(spark, tmp_path, range_bytes):
    """Ranges that begin inside records of a megabyte, with a CIGAR too long for its field, lose nothing."""
    rng = random.Random(1)
    rows = []
    for i in range(20):
        n = 1 if i % 5 else 90_000 if i % 10 else 50_000
        rows.append((f"r{i}", 0, "c1", i, "".join(f"{rng.randint(1, 900)}M{rng.randint(1, 1500)}N" for _ in range(n)) + "7M"))
    path = str(tmp_path / "long.bam")
    bam.write_bam(path, [(f"c{i}", 1 << 30) for i in range(1, 3000)], rows)
    got = bam.read_bam(spark, {"s": path}, range_bytes).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(rows)


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "st"))
    assert s.names() == [] and not s.has("t")
    s.write("t", spark.range(3))
    assert s.write("t", spark.range(9)).count() == 3 and s.write("t", spark.range(9), overwrite=True).count() == 9
    assert s.names() == ["t"] and "bigint" in s.describe()


def test_small_sources(spark, tmp_path):
    from isoframe.operators.annotation import naming_style

    assert naming_style(["chr1", "chr2", "MT"]) == "UCSC" and naming_style(["1", "2", "chrUn"]) == "Ensembl"
    for name in ("a_1.fastq.gz", "a_2.fastq.gz", "b_1.fastq.gz", "b_2.fastq.gz"):
        (tmp_path / name).write_text("")
    assert [r[0] for r in text.find_fastq(str(tmp_path))] == ["a", "b"]
    text.write_bedgraph(spark.createDataFrame([("c", 1, 10, 3)], "chrom string, start long, end long, depth long"), str(tmp_path / "bg"))
    assert [r.value for r in spark.read.text(str(tmp_path / "bg")).collect()] == ["c\t0\t10\t3"]


def test_scratch_is_deleted(spark):
    import glob

    root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = glob.glob(f"{root}/rdd-*")
    kept = settle(spark.range(5))
    with scratch(spark):
        assert settle(kept).count() == 5
        assert len(glob.glob(f"{root}/rdd-*")) == len(before) + 2
    assert len(glob.glob(f"{root}/rdd-*")) == len(before) + 1 and kept.count() == 5


COVER = [("s1", "c", "*", 1, 10, 2), ("s1", "c", "*", 11, 20, 4), ("s2", "c", "*", 5, 14, 10), ("s1", "c", "+", 1, 20, 1), ("s3", "c", "*", 1, 20, 6)]


@pytest.fixture
def cover(spark):
    return spark.createDataFrame(COVER, "sample string, chrom string, strand string, start long, end long, depth long")


def test_region_means_meet_no_runs(spark, cover):
    """Means are looked up in running sums: joins are with the samples only; regions of one name share their sum."""
    rows = [("c", 1, 20, "+", "r"), ("c", 1, 20, "+", "r"), ("d", 1, 9, "+", "far"), (None, 1, 9, "+", "none")]
    regions = spark.createDataFrame(rows, "chrom string, start long, end long, strand string, name string")
    means = cv.region_means(cover, regions)
    plan = means._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == plan.count("Join Cross") > 0
    want = {(s, n): m if n == "r" else 0.0 for s, m in {"s1": 6.0, "s2": 10.0, "s3": 12.0}.items() for n in ("r", "far", "none")}
    assert sorted((r["sample"], r["name"], r["mean"]) for r in means.collect()) == sorted((*k, m) for k, m in want.items() for _ in range(1 + (k[1] == "r")))
    changes = iv.changes_of_runs(cover, ("sample", "chrom", "strand"))
    once = cv.region_means_of_changes(changes, cover.select("sample").distinct(), regions).collect()
    assert {(r["sample"], r["name"]): (r["mean"], r["regions"]) for r in once} == {k: (m, 1 + (k[1] == "r")) for k, m in want.items()} and len(once) == 9


def test_coverage_regions_and_bins(spark, cover):
    base = {(r["sample"], r.x): r.depth for r in cv.coverage_per_base(cover, "c", 8, 22).collect()}
    assert base["s1", 8] == 2 and base["s1", 11] == 4 and base["s1", 21] == 0 and base["s2", 15] == 0 and len(base) == 45
    regions = spark.createDataFrame([("c", 1, 20, "+", "r"), ("c", 15, 30, "-", "q")], "chrom string, start long, end long, strand string, name string")
    got = {(r["sample"], r["name"]): r["mean"] for r in cv.region_means(cover, regions).collect()}
    assert got["s1", "r"] == 3 and got["s2", "r"] == 5 and got["s1", "q"] == 1.5
    assert {(r["sample"], r["name"]): r["mean"] for r in cv.region_means(cover, regions, "forward").collect()}["s1", "r"] == 1
    assert {(r["sample"], r["name"]): r["mean"] for r in cv.region_means(cover, regions, "reverse").collect()}["s1", "r"] == 0
    assert cv.bin_breaks(1, 10, 3) == [(1, 3), (4, 7), (8, 10)] and len(cv.bin_breaks(1, 4001)) == 1334
    bins = {(r["sample"], r.start, r.end): r["mean"] for r in cv.binned_coverage(cover, "c", 1, 20, bins=2).collect()}
    assert bins["s1", 1, 10] == 2 and bins["s2", 11, 20] == 4


def test_view(spark, cover):
    samples = spark.createDataFrame([("s1", "A"), ("s3", "A"), ("s2", "B")], "sample string, cond string")
    events = spark.createDataFrame([("e", "SE", "c:5-12/+", "c:5-12/+", "c:5-20/+")], "event_name string, event_type string, event_region string, event1a string, event1b string")
    assays = spark.createDataFrame([("e", "s1", 10.0), ("e", "s2", 4.0), ("e", "s3", 5.0)], "event_name string, sample string, depth double")
    junctions = spark.createDataFrame([("c", 5, 12, "+", "c:5-12/+")], "chrom string, start long, end long, strand string, event string")
    ja = spark.createDataFrame([("c:5-12/+", s, 0.5, 5.0) for s in ("s1", "s2", "s3")], "event string, sample string, psi double, count double")
    exons = spark.createDataFrame([("c", 1, 4, "+", "t1"), ("c", 13, 20, "+", "t1"), ("c", 1, 4, "+", "t2")], "chrom string, start long, end long, strand string, transcript_id string")
    data = SpliceDataset(events, samples, assays, junctions, ja)
    x = cv.resolve_locus("e", events, flank=2)
    assert (x.chrom, x.start, x.end) == ("c", 3, 14)
    assert cv.resolve_locus("c:10-19", events, zoom=1, flank=0, contig_length=25).end == 25
    with pytest.raises(ValueError, match="no event"):
        cv.resolve_locus("nothing", events)
    view = cv.coverage_data(data, cover, exons, x)
    assert view.exons.select("transcript_id", "level").distinct().count() == 2
    norms = cv.event_norms(view.events, "e")
    assert {r["sample"] for r in norms.collect()} == {"s1", "s3"}
    stats = cv.group_stats(cv.normalise(view.coverage, norms), samples, "cond").where("x = 8").first()
    assert stats["mean"] == pytest.approx((0.2 + 1.2) / 2) and stats["n"] == 2 and stats["ci"] == pytest.approx(stats["sem"] * 12.706204736, rel=1e-6)
    both = cv.group_stats(view.coverage.withColumnRenamed("depth", "value"), samples, "cond")
    assert cv.difference(both, "A", "B", 2, 1).count() == 12
    track = cv.junction_tracks(view.junctions, norms, samples, "cond").first()
    assert track.mean_count == pytest.approx(0.75) and track.height == 1
    # A group's junctions are not one task's: no window, and no shuffle by group alone.
    plan = cv.junction_tracks(view.junctions, norms, samples, "cond")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan
    introns = spark.createDataFrame([("c:5-12/+", "t1")], "event string, transcript_id string")
    assert {r.transcript_id: r.highlight for r in cv.highlight(exons, introns, events).collect()} == {"t1": "a", "t2": None}
    qc = spark.createDataFrame([("s1", 1.0, 5.0, 2.0), ("s2", 2.0, 5.0, 1.0), ("s3", 4.0, 5.0, 7.0)], "sample string, a double, b double, c double")
    assert cv.sample_pca(qc, ["a", "b", "c"]).count() == 3
