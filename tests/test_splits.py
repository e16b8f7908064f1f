"""Sources that split files: FASTA in byte ranges, block-gzip lines."""

import gzip
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from isoframe.operators import sequence as sq
from isoframe.sources import bgzip, blocks, fasta, text


def genome(seed=0):
    rng = random.Random(seed)
    parts, want = [], {}
    for i, n in enumerate((0, 1, 59, 60, 61, 2500, 7, 900)):
        seq = "".join(rng.choice("ACGTNacgt") for _ in range(n))
        name = f"c{i}"
        want[name] = seq
        width = rng.choice([13, 60, 10_000])
        parts.append(f">{name}" + (" about it\tmore" if i % 2 else "") + "\n" + "".join(seq[k : k + width] + rng.choice(["\n", "\r\n", " \n", "\n\n"]) for k in range(0, n, width)))
    return "".join(parts), want


@pytest.mark.parametrize("split", [64, 500, 1 << 20])
def test_fasta_equals_the_whole_file_at_every_split_size(spark, tmp_path, split):
    body, want = genome()
    (tmp_path / "g.fa").write_bytes(body.encode())
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "h.fa").write_text(">other\nACGT\nACG")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        lines = fasta.numbered_lines(spark, str(tmp_path / "g.fa"))
        assert lines.rdd.getNumPartitions() >= min(8, len(body) // split)
        for size in (7, 100):
            got = {}
            for r in sorted(fasta.read_fasta_chunks(spark, str(tmp_path / "g.fa"), size).collect(), key=lambda r: (r.chrom, r.chunk)):
                assert r.chunk * size == len(got.get(r.chrom, "")) and 0 < len(r.seq) <= size
                got[r.chrom] = got.get(r.chrom, "") + r.seq
            assert got == {k: v for k, v in want.items() if v}
        both = fasta.read_fasta_chunks(spark, f"{tmp_path}/{{g.fa,more/h.fa}}", 50)
        assert both.where("chrom = 'other'").first().seq == "ACGTACG" and both.select("chrom").distinct().count() == 8
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    whole = sq.chunked(text.read_fasta(spark, str(tmp_path / "g.fa")), 100)
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in fasta.read_fasta_chunks(spark, str(tmp_path / "g.fa"), 100).collect()}


def test_fasta_errors(spark, tmp_path):
    (tmp_path / "a.fa").write_text("ACGT\n>c\nAA\n")
    with pytest.raises(Exception, match="before the first header"):
        fasta.read_fasta_chunks(spark, str(tmp_path / "a.fa")).collect()
    (tmp_path / "b.fa").write_text(">c\nAAA\n>c\nAA\n")
    with pytest.raises(Exception, match="two contigs named"):
        fasta.read_fasta_chunks(spark, str(tmp_path / "b.fa")).collect()
    (tmp_path / "c.fa").write_text("\n")
    assert fasta.read_fasta_chunks(spark, str(tmp_path / "c.fa")).count() == 0


def texts():
    rng = random.Random(1)
    yield "plain", "".join("x" * rng.randint(0, 90) + "\n" for _ in range(400))
    yield "no end", "a\n\nb\r\nc"
    yield "one long line", "y" * 5000
    yield "long lines", "".join("z" * rng.choice([0, 3, 2000]) + rng.choice(["\n", "\r\n"]) for _ in range(60))
    yield "ends at members", ("q" * 99 + "\n") * 50
    yield "empty", ""


@pytest.mark.parametrize("block", [100, 999])
def test_block_gzip_lines_at_every_range(block):
    for name, body in texts():
        raw = bgzip.compress(body.encode(), block)
        assert gzip.decompress(raw).decode() == body
        want = body.replace("\r\n", "\n").split("\n")
        want = want[:-1] if want[-1] == "" else want
        for width in (1, 50, 333, 10**6):
            got = [row for a in range(0, len(raw), width) for row in bgzip.lines_of(io.BytesIO(raw), a, min(a + width, len(raw)), len(raw))] if width > 1 or len(raw) < 3000 else None
            if got is not None:
                assert [v.decode() for _, v in got] == want, (name, width)
                assert [p for p, _ in got] == sorted({p for p, _ in got})


def test_block_gzip_tables(spark, tmp_path):
    rows = [f"c{i % 5}\t{i}\t{i + 10}" for i in range(5000)]
    path = str(tmp_path / "t.bed.gz")
    (tmp_path / "t.bed.gz").write_bytes(bgzip.compress("\n".join(rows).encode(), 2000))
    (tmp_path / "plain.gz").write_bytes(gzip.compress(b"a"))
    assert bgzip.is_block_gzip(path) and not bgzip.is_block_gzip(str(tmp_path / "plain.gz"))
    df = bgzip.read_lines(spark, path, 3000)
    assert df.rdd.getNumPartitions() > 3
    assert [r.value for r in df.orderBy("file", "at").collect()] == rows


def test_sample_files_are_read_back(spark, tmp_path):
    rng = random.Random(2)
    stats = spark.createDataFrame([(s, f"n{k}", float(rng.randint(0, 99))) for s in ("a", "b", "c") for k in range(3)], "sample string, figure string, value double")
    junctions = spark.createDataFrame([(s, f"c{rng.randint(1, 3)}", k, k + 5, rng.choice(["+", "-"])) for s in ("a", "b") for k in rng.sample(range(10**6), 300)], "sample string, chrom string, start long, end long, strand string").repartition(5)
    folder = str(tmp_path / "out")
    blocks.write_blocks(spark, {"report": stats, "junction": junctions}, folder)
    files = text.find_outputs(folder)
    assert [f[0] for f in files] == ["a", "b", "c"]
    assert all(bgzip.is_block_gzip(p) for _, p in files)
    got = text.read_blocks(spark, dict(files))
    assert {tuple(r) for r in got["report"].collect()} == {tuple(r) for r in stats.collect()}
    assert got["junction"].columns == ["sample", "junction", "start", "end", "strand"]
    assert {tuple(r) for r in got["junction"].collect()} == {(*r[:2], float(r.start), float(r.end), r.strand) for r in junctions.collect()}
    body = gzip.decompress((tmp_path / "out" / "a.txt.gz").read_bytes()).decode()
    assert body.startswith("report\tvalue\n") and body.index("\n\njunction\tstart\tend\tstrand\n") > 0
    starts = [(x.split("\t")[0], int(x.split("\t")[1])) for x in body.split("\n\n")[1].split("\n")[1:] if x]
    assert starts == sorted(starts)
    assert gzip.decompress((tmp_path / "out" / "c.txt.gz").read_bytes()).decode().endswith("junction\tstart\tend\tstrand\n\n")


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    folder = tmp_path / "out"
    good = spark.createDataFrame([("a", 1), ("b", 2)], "sample string, v int")
    bad = spark.createDataFrame([(f"s{i}", i) for i in range(40)], "sample string, v int").repartition(8)
    bad = bad.withColumn("v", F.when(F.col("v") == 33, F.raise_error(F.lit("no"))).otherwise(F.col("v")).cast("int"))
    with pytest.raises(Exception, match="no"):
        blocks.write_blocks(spark, {"t": bad}, str(folder))
    assert os.listdir(folder) == []
    blocks.write_blocks(spark, {"t": good}, str(folder))
    with pytest.raises(Exception, match="a.txt.gz"):
        blocks.write_blocks(spark, {"t": good.where("v = 1")}, str(folder))
    blocks.write_blocks(spark, {"t": good.withColumn("v", F.col("v") + 6)}, str(folder), overwrite=True)
    assert sorted(os.listdir(folder)) == ["a.txt.gz", "b.txt.gz"]
    assert {r.t for r in text.read_blocks(spark, dict(text.find_outputs(str(folder))))["t"].collect()} == {7.0, 8.0}


def test_gtf_in_block_gzip(spark, tmp_path):
    body = "#!x\n" + "".join(f'c1\ts\texon\t{k}\t{k + 9}\t.\t-\t.\tgene_id "g{k % 7}"; transcript_id "t{k}";\n' for k in range(1, 900))
    (tmp_path / "a.gtf").write_text(body)
    (tmp_path / "a.gtf.gz").write_bytes(bgzip.compress(body.encode(), 500))
    (tmp_path / "b.gtf.gz").write_bytes(gzip.compress(body.encode()))
    got = [sorted(map(tuple, text.read_gtf(spark, str(tmp_path / f)).collect()), key=str) for f in ("a.gtf", "a.gtf.gz", "b.gtf.gz")]
    assert got[0] == got[1] == got[2] and len(got[0]) == 899
