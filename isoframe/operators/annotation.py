"""Annotation tables from a gene model: repair, genes, transcripts, exons, islands, introns, measurable introns, regions.

A model is a flat table chrom, type, start, end, strand (1-based closed) with gene_id and transcript_id and, where the file
has them, names, biotypes, support level, exon number and ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoframe.functions.coords import flip, format_interval, reverse_complement, width
from isoframe.operators import intervals as iv
from isoframe.operators.quant import islands, site_islands
from isoframe.operators.tables import unique_first, update_columns
from isoframe.sources.store import settle

# Biotypes whose introns are measured, in order of preference.
BIOTYPES = ("protein_coding", "processed_transcript", "lincRNA", "antisense", "nonsense_mediated_decay", "retained_intron", "novel_transcript")
MIN_INTRON, TRIM, MAX_EXCLUDED = 50, 5, 0.3


def check_columns(model: DataFrame) -> None:
    if missing := {"transcript_id", "gene_id"} - set(model.columns):
        raise ValueError(f"the annotation lacks {sorted(missing)}")


def check_one_contig(model: DataFrame, key: str) -> None:
    """Raise if a gene or a transcript lies on two contigs or strands."""
    many = model.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct("chrom", "strand").alias("n")).where("n > 1").select(key).limit(3).collect()
    if many:
        raise ValueError(f"{key} on several contigs: {[r[0] for r in many]}")


def reconcile_contigs(model: DataFrame, contigs: DataFrame) -> DataFrame:
    """Rows on contigs of the genome; raises if there are none. Genome names end at the first white space."""
    names = contigs.select(F.split("chrom", r"\s")[0].alias("chrom")).distinct()
    kept = model.join(names, "chrom", "left_semi")
    if kept.isEmpty():
        raise ValueError("no contig of the annotation is in the genome")
    return kept


def _with(df: DataFrame, name: str, default: Column) -> DataFrame:
    return df.withColumn(name, F.coalesce(F.col(name), default) if name in df.columns else default)


def repair(model: DataFrame) -> DataFrame:
    """The model with everything later steps need: exon numbers and ids, transcript and gene rows, names, biotypes, support levels."""
    check_columns(model)
    for key in ("gene_id", "transcript_id"):
        check_one_contig(model, key)
    df = model
    for old, new in (("transcript_type", "transcript_biotype"), ("gene_type", "gene_biotype")):
        if old in df.columns:
            df = df.withColumn(new, F.coalesce(F.col(new), F.col(old)) if new in df.columns else F.col(old)).drop(old)
    df = _with(df, "gene_name", F.col("gene_id"))
    df = _with(df, "gene_biotype", F.lit("protein_coding"))
    df = _with(df, "transcript_name", F.col("transcript_id"))
    df = _with(df, "transcript_biotype", F.lit("protein_coding"))
    df = _with(df, "transcript_support_level", F.lit("1"))
    for c in ("gene_name", "transcript_name"):
        df = df.withColumn(c, F.translate(c, "/", "_"))
    # Names that two genes share get the gene's id, and their transcripts are named by id.
    shared = df.groupBy("gene_name").agg(F.count_distinct("gene_id").alias("_n"))
    df = df.join(shared, "gene_name").withColumns({
        "transcript_name": F.when(F.col("_n") > 1, F.col("transcript_id")).otherwise(F.col("transcript_name")),
        "gene_name": F.when(F.col("_n") > 1, F.concat_ws("_", "gene_name", "gene_id")).otherwise(F.col("gene_name")),
    }).drop("_n")
    df = df.withColumn("transcript_support_level", F.coalesce(F.split("transcript_support_level", " ")[0], F.lit("NA")))
    exon = F.col("type") == "exon"
    place = Window.partitionBy("transcript_id", "type").orderBy(F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start")))
    df = _with(df, "exon_number", F.lit(None).cast("string")).withColumn("exon_number", F.when(exon, F.coalesce(F.col("exon_number").cast("int"), F.row_number().over(place))).otherwise(F.col("exon_number").cast("int")))
    df = _with(df, "exon_id", F.when(exon, F.concat(F.col("transcript_id"), F.lit("_Exon"), F.col("exon_number").cast("string"))))
    out = df
    meta = {"transcript": ("transcript_id", "transcript_name", "transcript_biotype", "transcript_support_level", "gene_id", "gene_name", "gene_biotype"), "gene": ("gene_id", "gene_name", "gene_biotype")}
    for kind in ("transcript", "gene"):
        key = f"{kind}_id"
        have = df.where(F.col("type") == kind).select(key).distinct()
        made = df.where(exon).join(have, key, "left_anti").groupBy("chrom", "strand", *meta[kind]).agg(F.min("start").alias("start"), F.max("end").alias("end")).withColumn("type", F.lit(kind))
        out = out.unionByName(made, allowMissingColumns=True)
    return out


def genes(model: DataFrame) -> DataFrame:
    """Genes with the island of overlapping ones they are in, by strand and ignoring it."""
    rows = settle(model.where("type = 'gene'").select("chrom", "start", "end", "strand", "gene_id", "gene_name", "gene_biotype"))
    out = rows
    for name, keys in (("gene_group_stranded", ("chrom", "strand")), ("gene_group_unstranded", ("chrom",))):
        isles = islands(rows, name, keys)
        isles = isles if "strand" in isles.columns else isles.withColumn("strand", F.lit("*"))
        hit = iv.overlap_join(rows.select("chrom", "start", "end", "strand", "gene_id"), isles, kind="within", suffixes=("", "_i")).groupBy("gene_id").agg(F.min(f"{name}_i").alias(name))
        out = out.join(hit, "gene_id", "left")
    return out


def transcripts(model: DataFrame) -> DataFrame:
    return model.where("type = 'transcript'").select("chrom", "start", "end", "strand", "gene_id", "gene_name", "gene_biotype", "transcript_id", "transcript_name", "transcript_biotype", "transcript_support_level")


def proteins(model: DataFrame) -> DataFrame:
    """Coding parts; one without a number has that of the exon of its transcript that it lies in."""
    cols = [c for c in ("protein_id", "ccds_id") if c in model.columns]
    rows = model.where("type = 'CDS'").select("chrom", "start", "end", "strand", "gene_id", "transcript_id", "transcript_name", "exon_number", "phase", *cols)
    own = model.where("type = 'exon'").select(F.col("transcript_id").alias("_t"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("exon_number").alias("_n"))
    met = rows.join(own, (F.col("transcript_id") == F.col("_t")) & (F.col("start") >= F.col("_s")) & (F.col("end") <= F.col("_e")), "left")
    return met.withColumn("exon_number", F.coalesce("exon_number", "_n")).select(*rows.columns)


def misc(model: DataFrame) -> DataFrame:
    """Rows of types that no other table holds."""
    return model.where(~F.col("type").isin("gene", "transcript", "exon", "CDS"))


def exons(model: DataFrame) -> DataFrame:
    return model.where("type = 'exon'").select("chrom", "start", "end", "strand", "gene_id", "gene_name", "transcript_id", "transcript_name", "transcript_biotype", "exon_number", "exon_id")


def exon_islands(exon_rows: DataFrame, stranded: bool = True) -> DataFrame:
    """Merged exons, numbered: those of transcripts without retained introns, and others outside their span.

    Columns chrom, start, end, strand ('*' if not stranded), exon_group.
    """
    keys = ("chrom", "strand") if stranded else ("chrom",)
    retained = F.col("transcript_biotype").contains("intron")
    base = exon_rows.where(~retained)
    extent = iv.span(base, ["gene_id", "chrom", "strand"])
    extra = iv.anti_overlap(exon_rows.where(retained).select("chrom", "start", "end", "strand"), extent.select("chrom", "start", "end", "strand"))
    merged = islands(base.select("chrom", "start", "end", "strand").unionByName(extra), "exon_group", keys)
    return merged if stranded else merged.withColumn("strand", F.lit("*"))


def introns(model: DataFrame, biotypes: Sequence[str] | None = None) -> DataFrame:
    """Introns of transcripts with number (from the 5' end), id and event string."""
    rows = exons(model)
    if biotypes is not None:
        rows = rows.where(F.col("transcript_biotype").isin(*biotypes))
    gaps = iv.gaps_within(rows, ["transcript_id"])
    minus = F.col("strand") == "-"
    w = Window.partitionBy("transcript_id")
    number = F.when(minus, F.row_number().over(w.orderBy(F.col("start").desc()))).otherwise(F.row_number().over(w.orderBy("start")))
    gaps = gaps.withColumns({"intron_number": number, "is_last": number == F.count(F.lit(1)).over(w)})
    gaps = gaps.withColumns({"intron_id": F.concat(F.col("transcript_id"), F.lit("_Intron"), F.col("intron_number").cast("string")), "event": format_interval()})
    names = transcripts(model).select("transcript_id", "transcript_name", "transcript_biotype", "transcript_support_level", "gene_id", "gene_name", "gene_biotype")
    out = gaps.join(names, "transcript_id")
    cds = model.where("type = 'CDS'")
    cols = [c for c in ("protein_id", "ccds_id") if c in model.columns]
    if cols:
        out = update_columns(out, cds.select("transcript_id", *cols, "start"), ["transcript_id"], cols, ["start"])
    return out


def with_islands(intron_rows: DataFrame, exon_rows: DataFrame) -> DataFrame:
    """introns with exon islands beside either site: exon_up, exon_down by strand, exon_up_nd, exon_down_nd without."""
    intron_rows = settle(intron_rows)
    stranded = site_islands(intron_rows, settle(exon_islands(exon_rows)), "exon_group", "exon")
    flat = settle(exon_islands(exon_rows, stranded=False))
    either = site_islands(intron_rows.select("chrom", "start", "end", "strand").distinct(), flat, "exon_group", "nd")
    return stranded.join(either.withColumnsRenamed({"nd_up": "exon_up_nd", "nd_down": "exon_down_nd"}), ["chrom", "start", "end", "strand"], "left")


def with_motif(rows: DataFrame, sequences: DataFrame) -> DataFrame:
    """rows with splice_motif, the two donor and two acceptor bases; sequences: chunks as sources.fasta gives them."""
    from isoframe.operators.sequence import fetch

    at = rows.select("chrom", "start", "end", "strand").distinct()
    ends = at.select("*", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("start").alias("s"), (F.col("start") + 1).alias("e")), F.struct(F.lit(1).alias("side"), (F.col("end") - 1).alias("s"), F.col("end").alias("e")))).alias("x"))
    asked = ends.select("chrom", F.col("x.s").alias("start"), F.col("x.e").alias("end"), F.lit("+").alias("strand"), F.struct("chrom", "start", "end", "strand", "x.side").alias("id"))
    got = fetch(asked, sequences, "id").groupBy(F.col("id.chrom").alias("chrom"), F.col("id.start").alias("start"), F.col("id.end").alias("end"), F.col("id.strand").alias("strand")).agg(F.concat(F.max(F.when(F.col("id.side") == 0, F.col("seq"))), F.max(F.when(F.col("id.side") == 1, F.col("seq")))).alias("m"))
    motif = F.when(F.col("strand") == "-", reverse_complement("m")).otherwise(F.col("m"))
    return rows.join(got.select("chrom", "start", "end", "strand", F.upper(motif).alias("splice_motif")), ["chrom", "start", "end", "strand"], "left")


def biotype_rank(column: str = "transcript_biotype") -> Column:
    at = F.array_position(F.array(*map(F.lit, BIOTYPES)), F.col(column))
    return F.when(at > 0, at).otherwise(len(BIOTYPES) + 1)


def measurable_introns(intron_rows: DataFrame, exon_rows: DataFrame, gene_rows: DataFrame, excluded: DataFrame | None = None, directional: bool = True) -> tuple[DataFrame, DataFrame]:
    """(introns, blocks): introns whose retention can be measured, and the stretches to measure.

    One intron for each place, of the best biotype and support; wider than MIN_INTRON; not wholly inside excluded regions
    (chrom, start, end; merged over gaps below 9). Exons, widened by TRIM, and excluded regions are cut out of the intron,
    itself narrowed by TRIM, except that introns within an exon keep their exons; introns that lose MAX_EXCLUDED of their
    width go. Flags: known_exon, and without direction antiover, antinear (over, or within 1 kb upstream or 5 kb downstream
    of, a gene of the other strand).
    """
    kinds = intron_rows.where(F.col("transcript_biotype").isin(*BIOTYPES))
    one = unique_first(kinds, ["chrom", "start", "end", "strand"], [biotype_rank(), "transcript_support_level", "transcript_name", "intron_number"])
    one = one.where(width() > MIN_INTRON)
    outside = (excluded.select("chrom", "start", "end") if excluded is not None else one.select("chrom", "start", "end").where("false")).withColumn("strand", F.lit("*"))
    merged = iv.reduce(outside, gap=9)
    if excluded is not None:
        one = iv.anti_overlap(one, merged, kind="within")
    one, exon_rows = settle(one), settle(exon_rows.select("chrom", "start", "end", "strand").distinct())
    key = ["chrom", "start", "end", "strand"]
    flag = lambda df, hits, name: df.join(hits.select(*key, F.lit(True).alias(name)).distinct(), key, "left").na.fill(False, [name])
    places = one.select(*key)
    ignore = not directional
    one = flag(one, iv.semi_overlap(places, exon_rows.select(*key), kind="within", ignore_strand=ignore), "known_exon")
    if ignore:
        anti = gene_rows.select("chrom", "start", "end", flip().alias("strand"))
        up, down = (iv.flank(gene_rows.select("chrom", "start", "end", "strand"), n, first).withColumn("strand", flip()) for n, first in ((1000, True), (5000, False)))
        one = flag(one, iv.semi_overlap(places, anti), "antiover")
        one = flag(one, iv.semi_overlap(places, up.unionByName(down)), "antinear")
    one = settle(one)
    inner = one.select("chrom", (F.col("start") + TRIM).alias("start"), (F.col("end") - TRIM).alias("end"), "strand", "intron_id", "known_exon")
    padded = exon_rows.select("chrom", (F.col("start") - TRIM).alias("start"), (F.col("end") + TRIM).alias("end"), F.lit("*").alias("strand") if ignore else F.col("strand")).distinct()
    # What is cut out of introns of each strand, and of introns within exons, which keep what exons alone would cut.
    meets = F.when(F.col("strand") == "*", F.array(*map(F.lit, "+-*"))).otherwise(F.array("strand", F.lit("*")))
    either = merged.select("chrom", "start", "end", F.lit("*").alias("strand"))
    cutting = padded.withColumn("known_exon", F.lit(False)).unionByName(either.withColumn("known_exon", F.lit(False))).unionByName(either.withColumn("known_exon", F.lit(True)))
    by = ("chrom", "strand", "known_exon")
    zones = settle(iv.reduce(cutting.withColumn("strand", F.explode(meets)), by))
    # Summed first: introns that lose too much are never cut into blocks.
    left = width() - F.coalesce("covered", F.lit(0))
    sized = iv.covered_bases(inner, zones, by).select("intron_id", left.alias("inclbases")).where("inclbases > 0")
    out = settle(one.join(sized, "intron_id").withColumn("exclbases", width() - F.col("inclbases")).where(F.col("exclbases") / width() < MAX_EXCLUDED))
    inner = inner.join(out.select("intron_id"), "intron_id", "left_semi")
    cuts = iv.overlap_join(inner, zones, suffixes=("", "_z"), keys=by).select("intron_id", F.greatest("start", "start_z").alias("start"), F.least("end", "end_z").alias("end"))
    blocks = settle(iv.setdiff(inner.select("intron_id", "start", "end"), cuts, ("intron_id",)))
    out = out.join(blocks.groupBy("intron_id").agg(F.count(F.lit(1)).alias("num_blocks")), "intron_id")
    return out.withColumn("ir_name", intron_name(directional)), blocks.join(out.select("intron_id", "chrom"), "intron_id")


def intron_name(directional: bool = True) -> Column:
    """dir|nd/gene/intron/strand/blocks/start/end/included/excluded/class."""
    if directional:
        kind = F.when(F.col("known_exon"), "known-exon").otherwise("clean")
    else:
        parts = F.array_compact(F.array(F.when(F.col("known_exon"), "known-exon"), F.when(F.col("antiover"), "anti-over"), F.when(F.col("antinear"), "anti-near")))
        kind = F.when(F.size(parts) == 0, "clean").otherwise(F.array_join(parts, "+"))
    text = lambda c: F.col(c).cast("string")
    return F.concat_ws("/", F.lit("dir" if directional else "nd"), "gene_name", "intron_id", "strand", text("num_blocks"), (F.col("start") - 1).cast("string"), text("end"), text("inclbases"), text("exclbases"), kind)


def reference_cover(directional: DataFrame, other: DataFrame) -> DataFrame:
    return directional.select("chrom", "start", "end", "strand", "ir_name").unionByName(other.select("chrom", "start", "end", "strand", "ir_name")).distinct()


def reading_points(introns_dir: DataFrame, introns_nd: DataFrame) -> DataFrame:
    """Distinct ends of measurable introns, 0-based, where reads may run on."""
    both = introns_dir.select("chrom", "start", "end").unionByName(introns_nd.select("chrom", "start", "end"))
    return both.select("chrom", F.explode(F.array(F.col("start") - 1, F.col("end"))).alias("coord")).distinct()


def splice_junctions(intron_rows: DataFrame, nmd: DataFrame | None = None) -> DataFrame:
    """Annotated junctions (start 0-based), nmd where all their transcripts are."""
    rows = intron_rows if nmd is None else intron_rows.join(nmd.select("transcript_id", F.col("is_nmd").alias("_n")), "transcript_id", "left")
    flag = F.bool_and(F.coalesce("_n", F.lit(False))) if nmd is not None else F.lit(False)
    return rows.groupBy("chrom", (F.col("start") - 1).alias("start"), "end", "strand").agg(flag.alias("nmd"))


def tandem_junctions(intron_rows: DataFrame) -> DataFrame:
    """Distinct pairs of consecutive introns of a transcript (starts 0-based)."""
    w = Window.partitionBy("transcript_id").orderBy("start", "end")
    rows = intron_rows.select("chrom", (F.col("start") - 1).alias("start1"), F.col("end").alias("end1"), (F.lead("start").over(w) - 1).alias("start2"), F.lead("end").over(w).alias("end2"), "strand")
    return rows.where("start2 is not null").distinct()


def regions_of_interest(model: DataFrame, contigs: DataFrame, non_polya: DataFrame | None = None) -> DataFrame:
    """(chrom, start, end, name), 0-based half-open: rRNA transcripts, non-polyA regions, stretches between genes.

    Intergenic: contigs without genes widened by 10 kb and merged over gaps below 1 kb.
    """
    rrna = transcripts(model).where(F.col("transcript_biotype").contains("rRNA")).select("chrom", (F.col("start") - 1).alias("start"), "end", F.concat(F.lit("rRNA/"), "transcript_name").alias("name"))
    wide = genes_plain(model).select("chrom", F.greatest(F.lit(1), F.col("start") - 10000).alias("start"), (F.col("end") + 10000).alias("end"))
    busy = iv.reduce(wide, ("chrom",), 1000)
    whole = contigs.select("chrom", F.lit(1).cast("long").alias("start"), F.col("length").cast("long").alias("end"))
    free = iv.setdiff(whole, busy, ("chrom",)).select("chrom", (F.col("start") - 1).alias("start"), "end", F.concat(F.lit("Intergenic/"), "chrom").alias("name"))
    out = rrna.unionByName(free)
    if non_polya is not None:
        out = out.unionByName(non_polya.select("chrom", (F.col("start") - 1).alias("start"), "end", F.lit("NonPolyA").alias("name")))
    return out


def genes_plain(model: DataFrame) -> DataFrame:
    return model.where("type = 'gene'").select("chrom", "start", "end", "strand", "gene_id", "gene_name")


def naming_style(chroms: Sequence[str]) -> str:
    """UCSC if most contigs begin with chr, else Ensembl."""
    return "UCSC" if sum(c.startswith("chr") for c in chroms) * 2 > len(chroms) else "Ensembl"


def novel_model(junctions: DataFrame, tandem: DataFrame, gene_rows: DataFrame) -> DataFrame:
    """Transcripts for novel junctions and tandem junctions: 50-base pseudo-exons around each intron, as model rows.

    A transcript belongs to the first gene of its strand that it overlaps, others to new genes, one for each island of them.
    junctions: chrom, start, end, strand; tandem: chrom, start1, end1, start2, end2, strand (all 1-based).
    """
    one = junctions.select("chrom", "strand", F.array(F.struct((F.col("start") - 50).alias("start"), (F.col("start") - 1).alias("end")), F.struct((F.col("end") + 1).alias("start"), (F.col("end") + 50).alias("end"))).alias("parts"))
    two = tandem.select("chrom", "strand", F.array(F.struct((F.col("start1") - 50).alias("start"), (F.col("start1") - 1).alias("end")), F.struct((F.col("end1") + 1).alias("start"), (F.col("start2") - 1).alias("end")), F.struct((F.col("end2") + 1).alias("start"), (F.col("end2") + 50).alias("end"))).alias("parts"))
    rows = one.unionByName(two).distinct()
    rows = rows.withColumns({"start": F.col("parts")[0]["start"], "end": F.element_at("parts", -1)["end"]})
    number = F.row_number().over(Window.partitionBy("chrom", "strand").orderBy("start", "end", F.to_json("parts")))
    # Ids count within a contig and strand, so that numbering needs no pass over all.
    rows = settle(rows).withColumn("transcript_id", F.concat(F.lit("novelTr"), "chrom", "strand", F.lpad(number.cast("string"), 6, "0")))
    place = rows.select("chrom", "start", "end", "strand", "transcript_id")
    hit = iv.overlap_join(place, gene_rows.select("chrom", "start", "end", "strand", "gene_id", "gene_name"), suffixes=("", "_g")).groupBy("transcript_id").agg(F.min_by(F.struct(F.col("gene_id_g").alias("gene_id"), F.col("gene_name_g").alias("gene_name")), F.struct("start_g", "end_g", "gene_id_g")).alias("g"))
    alone = place.join(hit, "transcript_id", "left_anti")
    isles = islands(alone, "isle")
    fresh = iv.overlap_join(alone, isles, kind="within", suffixes=("", "_i")).select("transcript_id", F.struct(F.concat(F.lit("novelGene"), F.translate("isle_i", "/", "_")).alias("gene_id"), F.concat(F.lit("novelGene"), F.translate("isle_i", "/", "_")).alias("gene_name")).alias("g"))
    named = rows.join(hit.unionByName(fresh), "transcript_id").select("*", "g.gene_id", "g.gene_name")
    base = named.select("chrom", "strand", "gene_id", "gene_name", "transcript_id", F.col("transcript_id").alias("transcript_name"), F.lit("novel_transcript").alias("transcript_biotype"), F.lit("Novel").alias("transcript_support_level"), F.posexplode("parts").alias("i", "p"))
    return base.select("chrom", "strand", "gene_id", "gene_name", "transcript_id", "transcript_name", "transcript_biotype", "transcript_support_level", F.lit("exon").alias("type"), "p.start", "p.end")
