"""The stages end to end, each persisted in a Store and skipped where its tables are there: reference, reads, collation, dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.functions.coords import format_interval, strip_version
from isoframe.operators import annotation as an
from isoframe.operators import events as ev
from isoframe.operators import quant as qt
from isoframe.operators import reads as rd
from isoframe.operators import sequence as sq
from isoframe.operators.dataset import SpliceDataset, drop_overlapping_introns, drop_overlapping_introns_iterative
from isoframe.operators.enrichment import normalise_terms
from isoframe.sources import text
from isoframe.sources.fasta import read_fasta_chunks
from isoframe.sources.store import Store, scratch, settle


def get_resources(store: Store, fasta: str, gtf: str, overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """(chunks, model): the genome in chunks and the repaired annotation on its contigs."""
    spark = store.spark
    chunks = store.write("chunks", read_fasta_chunks(spark, fasta), overwrite)
    if overwrite or not store.has("model"):
        store.write("model", an.repair(an.reconcile_contigs(text.read_gtf(spark, gtf), chunks.select("chrom").distinct())), overwrite)
    return chunks, store.read("model")


def build_reference(store: Store, fasta: str | None = None, gtf: str | None = None, *, excluded: DataFrame | None = None, non_polya: DataFrame | None = None, model: DataFrame | None = None, chunks: DataFrame | None = None, overwrite: bool = False) -> Store:
    """All annotation tables. excluded: regions of low mappability or a blacklist (chrom, start, end). model and chunks stand in
    for the files."""
    if store.has("events") and not overwrite:
        return store
    with scratch(store.spark):  # every table is written
        return _build(store, fasta, gtf, excluded, non_polya, model, chunks, overwrite)


def _build(store: Store, fasta: str | None, gtf: str | None, excluded: DataFrame | None, non_polya: DataFrame | None, model: DataFrame | None, chunks: DataFrame | None, overwrite: bool) -> Store:
    if model is None or chunks is None:
        chunks, model = get_resources(store, fasta, gtf, overwrite)
    else:
        chunks, model = store.write("chunks", chunks, True), store.write("model", an.repair(model), True)
    w = lambda name, df: store.write(name, df, True)
    contigs = w("contigs", sq.contig_lengths(chunks))
    genes = w("genes", an.genes(model))
    w("transcripts", an.transcripts(model))
    exons = w("exons", an.exons(model))
    cds = w("proteins", an.proteins(model)) if "phase" in model.columns else None
    w("misc", an.misc(model))
    w("exon_islands", an.exon_islands(exons))
    introns = w("introns", an.with_motif(an.with_islands(an.introns(model), exons), chunks))
    sides = {}
    for name, directional in (("dir", True), ("nd", False)):
        rows, blocks = an.measurable_introns(introns, exons, genes, excluded, directional)
        sides[name] = w(f"introns_{name}", rows)
        w(f"blocks_{name}", blocks)
    nmd = intron_nmd = peptides = None
    if cds is not None and not cds.isEmpty():
        coding = settle(sq.coding_exons(exons, cds))
        nmd = w("transcript_nmd", sq.spliced_nmd(coding, chunks))
        inside = introns.join(nmd.select("transcript_id"), "transcript_id", "left_semi")
        kinds = sq.intron_region(inside.select("transcript_id", "start", "end", "intron_id"), cds, model.where("type like '%prime_utr'")).select("intron_id", "intron_type")
        intron_nmd = w("intron_nmd", sq.retained_nmd(inside, coding, chunks).join(kinds, "intron_id", "left"))
        peptides = w("peptides", sq.exon_peptides(cds, chunks))
    w("junctions", an.splice_junctions(introns, nmd))
    w("tandem", an.tandem_junctions(introns))
    w("reading_points", an.reading_points(sides["dir"], sides["nd"]))
    w("regions", an.regions_of_interest(model, contigs, non_polya))
    w("reference_cover", an.reference_cover(sides["dir"], sides["nd"]))
    found = settle(ev.splice_events(introns, sides["dir"], exons))
    if peptides is not None:
        w("event_peptides", sq.event_peptides(found, introns, peptides))
    w("events", ev.row_annotations(found.unionByName(ev.retention_events(sides["nd"])), introns, exons, nmd, intron_nmd))
    return store


def view(reference: Store, what: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Reader's views of the reference: events, introns, exons, genes, transcripts, proteins, retention, nmd, peptides, gene_sets;
    of the columns asked for, those that the table has."""
    tables = {"events": "events", "introns": "introns", "exons": "exons", "genes": "genes", "transcripts": "transcripts", "proteins": "proteins", "retention": "introns_nd", "nmd": "intron_nmd", "peptides": "event_peptides", "gene_sets": "gene_sets"}
    if what not in tables:
        raise ValueError(f"views are {sorted(tables)}")
    if not reference.has(tables[what]):
        raise FileNotFoundError(f"the reference has no {what}")
    rows = reference.read(tables[what])
    return rows if columns is None else rows.select(*[c for c in columns if c in rows.columns])


def add_gene_sets(reference: Store, links: DataFrame, terms: DataFrame | None = None, overwrite: bool = False) -> DataFrame:
    """Gene sets of the reference's genes: gene_id, gene_name, go_id, go_term, ontology. links as for normalise_terms; versions
    of gene ids do not count."""
    genes = reference.read("genes").select(strip_version("gene_id").alias("_id"), "gene_id", "gene_name").distinct()
    own = normalise_terms(links, terms).withColumn("_id", strip_version("gene_id")).drop("gene_id")
    return reference.write("gene_sets", own.join(genes, "_id").select("gene_id", "gene_name", "go_id", "go_term", "ontology").distinct(), overwrite)


def check_experiment(experiment: DataFrame) -> dict[str, tuple[str, ...]]:
    """sample to its files, from a table whose first column names samples and whose others name files: result tables, then
    coverage. Raised are fewer than two columns, null or repeated samples, and files that do not exist. Its rows are samples, a few
    thousand at most; nulls among files of all samples leave that column out."""
    if len(experiment.columns) < 2:
        raise ValueError("an experiment has a column of samples and one of files at least")
    rows = [tuple(r) for r in experiment.collect()]
    names = [r[0] for r in rows]
    if any(n is None or str(n) == "" for n in names) or len(set(names)) < len(names):
        raise ValueError("samples must be named, each once")
    used = [k for k in range(1, len(experiment.columns)) if k == 1 or not any(r[k] is None for r in rows)]
    spark = experiment.sparkSession

    def there(path: str | None) -> bool:
        if path is None:
            return False
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))

    if gone := sorted(str(r[k]) for r in rows for k in used if not there(r[k])):
        raise FileNotFoundError(f"files of the experiment do not exist: {gone}")
    return {str(r[0]): tuple(r[k] for k in used) for r in rows}


def process_alignments(out: Store, reference: Store, alignments: DataFrame, directional: bool = False, overwrite: bool = False) -> Store:
    """Counts, coverage and intron records of all samples in alignments (sample, qname, flag, chrom, pos, cigar)."""
    if out.has("intron_records") and not overwrite:
        return out
    with scratch(out.spark):
        return _process(out, reference, alignments, directional)


def _process(out: Store, reference: Store, alignments: DataFrame, directional: bool) -> Store:
    w = lambda name, df, **o: out.write(name, df, True, **o)
    frags = w("fragments", rd.fragments(alignments))
    w("read_counts", rd.read_counts(alignments))
    samples = alignments.select("sample").distinct()
    counts = w("junction_counts", rd.junction_counts(frags, reference.read("junctions"), samples))
    w("directionality", rd.directionality(counts))
    w("tandem_counts", rd.tandem_counts(frags))
    spans = w("span_counts", rd.span_counts(frags, reference.read("reading_points")))
    regions = w("region_counts", rd.region_counts(frags, reference.read("regions")))
    w("region_classes", rd.region_classes(regions))
    contigs = w("contig_counts", rd.contig_counts(frags))
    w("contig_classes", rd.contig_classes(contigs))
    cover = w("coverage", rd.coverage(frags), by=("sample",), order=("chrom", "strand", "start"))
    kind = "dir" if directional else "nd"
    rows = reference.read(f"introns_{kind}")
    introns = rows.select(F.col("ir_name").alias("name"), "chrom", (F.col("start") - 1).alias("start"), "end", "strand")
    blocks = reference.read(f"blocks_{kind}").join(rows.select("intron_id", F.col("ir_name").alias("name")), "intron_id").select("name", "chrom", (F.col("start") - 1).alias("start"), "end")
    w("intron_records", rd.intron_records(introns, blocks, cover, counts, spans, directional))
    return out


def coverage_only(out: Store, alignments: DataFrame) -> DataFrame:
    """Coverage without quantitation."""
    return out.write("coverage", rd.coverage(rd.fragments(alignments)), by=("sample",), order=("chrom", "strand", "start"))


def low_mappability(alignments: DataFrame, contigs: DataFrame, threshold: int = 4) -> DataFrame:
    """Regions that synthetic reads, aligned back, cover no deeper than threshold."""
    return rd.uncovered(rd.coverage(rd.fragments(rd.exact_synthetic(alignments))), contigs, threshold)


def novel_reference(out: Store, reference: Store, processed: Store, min_samples: int = qt.NOVEL_MIN_SAMPLES, min_reads: int = qt.NOVEL_MIN_READS, one_site_known: bool = False) -> Store:
    """The reference rebuilt with transcripts for prevalent novel junctions and tandem junctions."""
    if out.has("events"):
        return out
    chunks, contigs, introns = reference.read("chunks"), reference.read("contigs"), reference.read("introns")
    counts = processed.read("junction_counts")
    places = counts.select("chrom", (F.col("start") + 1).alias("start"), "end").distinct()
    motif = an.with_motif(places.withColumn("strand", F.lit("+")), chunks).withColumnRenamed("splice_motif", "motif")
    known = qt.annotate_strand(motif, introns.select("chrom", "start", "end", "strand"), contigs)
    known = settle(known)
    prevalent = qt.prevalence(counts.withColumn("start", F.col("start") + 1), min_reads)
    novel = settle(qt.novel_junctions(known, prevalent, min_samples, one_site_known))
    tandem = processed.read("tandem_counts")
    often = tandem.groupBy("chrom", "start1", "end1", "start2", "end2").agg(F.count_if(F.col("total") > 0).alias("n"), F.count_if(F.col("total") >= min_reads).alias("o")).where((F.col("n") >= min_samples) | (F.col("o") >= 1))
    pairs = qt.annotate_tandem(often.select("chrom", (F.col("start1") + 1).alias("start1"), "end1", (F.col("start2") + 1).alias("start2"), "end2", F.lit(".").alias("strand")), known.select("chrom", "start", "end", "strand"))
    have = reference.read("tandem").select("chrom", (F.col("start1") + 1).alias("start1"), "end1", (F.col("start2") + 1).alias("start2"), "end2", "strand")
    pairs = settle(pairs.join(have, have.columns, "left_anti"))
    more = an.novel_model(novel.select("chrom", "start", "end", "strand"), pairs.select(*have.columns), an.genes_plain(reference.read("model")))
    model = settle(reference.read("model").unionByName(more, allowMissingColumns=True))
    return build_reference(out, model=model.where("type <> 'gene' or gene_id not like 'novelGene%'"), chunks=chunks)


def collate(out: Store, reference: Store, processed: Store, directional: bool = False, ir_over: bool = True, overwrite: bool = False) -> Store:
    """Events x samples assays, junction assays, sample statistics and quality figures."""
    if out.has("assays") and not overwrite:
        return out
    with scratch(out.spark):
        return _collate(out, reference, processed, directional, ir_over)


def _collate(out: Store, reference: Store, processed: Store, directional: bool, ir_over: bool) -> Store:
    w = lambda name, df, **o: out.write(name, df, True, **o)
    stats = w("stats", qt.sample_stats(processed.read("read_counts"), processed.read("directionality")))
    records = processed.read("intron_records")
    qt.check_same_introns(records)
    introns, islands = reference.read("introns"), reference.read("exon_islands")
    counts = processed.read("junction_counts").withColumn("start", F.col("start") + 1)
    known = introns.groupBy("chrom", "start", "end").agg(F.min("strand").alias("_k"))
    counts = counts.join(known, ["chrom", "start", "end"]).withColumn("strand", F.col("_k")).drop("_k")
    places = counts.select("chrom", "start", "end", "strand").distinct()
    sides = settle(qt.site_islands(places, islands, "exon_group", "jg"))
    counted = qt.count_by_strand(counts, stats).join(sides, ["chrom", "start", "end", "strand"])
    junctions = settle(qt.junction_psi(qt.splice_over(settle(counted)))).withColumn("event", format_interval())
    w("junctions", junctions.select("chrom", "start", "end", "strand", "event", "jg_up", "jg_down").distinct())
    w("junction_assays", junctions.select("event", "sample", "psi", "count", F.col("total").cast("double").alias("count_uns")))
    over = junctions.select("sample", "chrom", "start", "end", "strand", "over_left", "over_right")
    ir = records.withColumn("start", F.col("start") + 1).join(over, ["sample", "chrom", "start", "end", "strand"], "left").na.fill(0.0, ["over_left", "over_right"])
    ir = settle(qt.intron_metrics(ir).withColumn("event_region", format_interval()))
    events = reference.read("events")
    names = records.select("name").distinct()
    kept = events.join(names.withColumnRenamed("name", "event_id"), "event_id", "left_semi").unionByName(events.where("event_type <> 'IR'"))
    # Retention counts of an event follow the intron of its region.
    kept = w("events", kept)
    cells = qt.event_cells(kept.select("event_name", "event_type", "strand", "event_region", "event1a", "event2a", "event1b", "event2b"), junctions.select("sample", "event", "count", "over_left", "over_right"), ir.select("sample", "event_region", "depth", "coverage", "splice_over", "splice_max", "total_depth", "span_left", "span_right"), ir_over)
    jc = processed.read("junction_counts")
    known_reads = jc.groupBy("sample").agg(F.sum(F.when(F.col("strand") != ".", F.col("total")).otherwise(0)).alias("annotated"), F.sum(F.when(F.col("strand") == ".", F.col("total")).otherwise(0)).alias("unannotated"), F.sum(F.when(F.col("nmd"), F.col("total")).otherwise(0)).alias("nmd"))
    spans = processed.read("span_counts").groupBy("sample").agg(F.sum("total").alias("spans"))
    parts = known_reads.join(spans, "sample", "left").join(processed.read("region_classes"), "sample", "left").join(processed.read("contig_classes"), "sample", "left").join(rd.burden(records), "sample", "left").na.fill(0)
    w("qc", qt.sample_qc(stats, parts))
    # Last, for its presence says that the rest is there.
    w("assays", cells.select("event_name", "sample", "included", "excluded", "depth", "coverage", "min_depth", "up_inc", "down_inc", "up_exc", "down_exc"), by=("sample",))
    return out


def load_dataset(collated: Store, reference: Store, samples: DataFrame | None = None, overlapping: str = "drop") -> SpliceDataset:
    """The dataset; samples: sample and conditions, of which only those named are kept. overlapping introns: drop, iterative, keep."""
    stats = collated.read("stats").select("sample")
    table = stats if samples is None else samples.join(stats, "sample", "left_semi")
    data = SpliceDataset(collated.read("events"), table, collated.read("assays"), collated.read("junctions"), collated.read("junction_assays"), collated.read("qc"), reference.read("introns").select("chrom", "start", "end", "strand").distinct(), collated.path)
    data = data.clean_samples()
    if samples is not None:
        data = data.subset(samples=data.samples)
    if overlapping == "drop":
        return drop_overlapping_introns(data)
    return drop_overlapping_introns_iterative(data) if overlapping == "iterative" else data


def example_genome(spark: SparkSession, contigs: Sequence[tuple[str, int]], seed: int = 0) -> DataFrame:
    """A synthetic genome for fixtures and demonstrations: chrom, seq, ord."""
    import random

    rng = random.Random(seed)
    return spark.createDataFrame([(c, "".join(rng.choices("ACGT", k=n)), i) for i, (c, n) in enumerate(contigs)], "chrom string, seq string, ord long")
