"""Splice events from introns by equi self-joins: MXE, SE, AFE, ALE, A5SS, A3SS, RI, and the options of each.

introns: as annotation.introns() and with_islands() give them. Of two junctions that share a site, "a" is the shorter one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoframe.functions.coords import acceptor, donor, format_interval, width
from isoframe.operators import intervals as iv
from isoframe.operators.tables import all_pairs, unique_first
from isoframe.sources.store import settle

COLUMNS = ("event_type", "event_id", "event_name", "event1a", "event1b", "event2a", "event2b", "gene_id", "gene_id_b", "event_region", "transcript_id_a", "transcript_name_a", "intron_number_a", "transcript_id_b", "transcript_name_b", "intron_number_b", "strand")
_INTRON = ("event", "gene_id", "transcript_id", "transcript_name", "intron_number")


def skip_coordinates(introns: DataFrame) -> DataFrame:
    """Consecutive introns of a transcript with the junction that would skip what lies between: skip, event1, event2."""
    w = Window.partitionBy("transcript_id").orderBy("intron_number")
    rows = introns.withColumns({"event2": F.lead("event").over(w), "_s": F.lead("start").over(w), "_e": F.lead("end").over(w)}).where("event2 is not null")
    return rows.withColumns({"event1": F.col("event"), "skip": format_interval("chrom", F.least("start", "_s"), F.greatest("end", "_e"))}).drop("_s", "_e")


def _finish(rows: DataFrame, kind: str, name: Column, unique: list[str]) -> DataFrame:
    """One row for each set of junctions, named, and numbered within a contig by gene and transcript name."""
    first = unique_first(rows, unique, ["gene_id", "transcript_name_a", "intron_number_a", "transcript_name_b", "intron_number_b", "transcript_id_a", "transcript_id_b"])
    named = first.withColumns({"event_type": F.lit(kind), "event_name": name})
    # Numbers count within a contig, so that no task sees all events.
    contig = F.regexp_extract(unique[0], r"^(.+):\d+-", 1)
    number = F.row_number().over(Window.partitionBy(contig).orderBy("gene_id", "transcript_name_a", *unique))
    named = named.withColumn("event_id", F.concat(F.lit(kind + "#"), contig, F.lit("/"), number.cast("string")))
    return named.select(*[F.col(c) if c in named.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS])


def _exon(t: str, n: str, add: int = 0) -> Column:
    return F.concat(F.col(t), F.lit("-exon"), (F.col(n) + add).cast("string"))


def mutually_exclusive(introns: DataFrame) -> DataFrame:
    """Pairs of different casettes between the same outer sites."""
    rows = unique_first(skip_coordinates(introns), ["skip", "event1", "event2"], ["transcript_name", "intron_number"])
    rows = rows.select("skip", "strand", "event1", "event2", "gene_id", "transcript_id", "transcript_name", "intron_number", F.concat_ws("|", "event1", "event2").alias("both"))
    pairs = all_pairs(rows, ["skip"], ["gene_id", "transcript_name", "intron_number"], "both").where("event1_a <> event1_b and event2_a <> event2_b")
    pairs = pairs.withColumnsRenamed({"event1_a": "event1a", "event1_b": "event1b", "event2_a": "event2a", "event2_b": "event2b", "gene_id_a": "gene_id", "skip": "event_region", "strand_a": "strand"})
    name = F.concat(F.lit("MXE:"), _exon("transcript_name_a", "intron_number_a", 1), F.lit(";"), _exon("transcript_name_b", "intron_number_b", 1))
    return _finish(pairs, "MXE", name, ["event1a", "event1b", "event2a", "event2b"])


def skipped_exons(introns: DataFrame) -> DataFrame:
    """Two introns around an exon against one intron over both."""
    two = skip_coordinates(introns).select("skip", "strand", F.col("event1").alias("event1a"), F.col("event2").alias("event2a"), "gene_id", F.col("transcript_id").alias("transcript_id_a"), F.col("transcript_name").alias("transcript_name_a"), F.col("intron_number").alias("intron_number_a"))
    one = unique_first(introns, ["event"], ["transcript_name", "intron_number"]).select(F.col("event").alias("skip"), F.col("gene_id").alias("gene_id_b"), F.col("transcript_id").alias("transcript_id_b"), F.col("transcript_name").alias("transcript_name_b"), F.col("intron_number").alias("intron_number_b"))
    rows = two.join(one, "skip").withColumns({"event1b": F.col("skip"), "event_region": F.col("skip")})
    name = F.concat(F.lit("SE:"), _exon("transcript_name_a", "intron_number_a", 1), F.lit(";"), F.col("transcript_name_b"), F.lit("-int"), F.col("intron_number_b").cast("string"))
    return _finish(rows, "SE", name, ["event1a", "event2a", "event1b"])


def _shared_site(introns: DataFrame, kind: str, site: Column, by: list[str], name) -> DataFrame:
    rows = unique_first(introns.withColumn("site", site), ["event"], ["transcript_name", "intron_number"])
    rows = rows.select("chrom", "strand", "site", *by, *_INTRON, width().alias("width"))
    pairs = all_pairs(rows, ["chrom", "strand", "site", *by], ["width", "event"], "event")
    pairs = pairs.withColumnsRenamed({"event_a": "event1a", "event_b": "event1b", "gene_id_a": "gene_id"}).withColumn("event_region", F.col("event1b"))
    return _finish(pairs, kind, name, ["event1a", "event1b"])


def _pair_name(kind: str, what: str, add: int = 0) -> Column:
    side = lambda s: F.concat(F.col(f"transcript_name_{s}"), F.lit(f"-{what}"), (F.col(f"intron_number_{s}") + add).cast("string"))
    return F.concat(F.lit(kind + ":"), side("a"), F.lit(";"), side("b"))


def _known_islands(introns: DataFrame) -> DataFrame:
    return introns.where("exon_up is not null and exon_down is not null")


def alternative_5(introns: DataFrame) -> DataFrame:
    """Two donors in one exon island, one acceptor."""
    return _shared_site(_known_islands(introns), "A5SS", acceptor(), ["exon_up", "exon_down"], _pair_name("A5SS", "exon"))


def alternative_3(introns: DataFrame) -> DataFrame:
    """Two acceptors in one exon island, one donor."""
    return _shared_site(_known_islands(introns), "A3SS", donor(), ["exon_up", "exon_down"], _pair_name("A3SS", "exon", 1))


def alternative_first(introns: DataFrame, a5ss: DataFrame) -> DataFrame:
    """First introns with one acceptor, but for A5SS pairs; novel transcripts have no known first exon."""
    rows = introns.where(~F.col("transcript_biotype").contains("novel_transcript") & (F.col("intron_number") == 1))
    return _shared_site(rows, "AFE", acceptor(), [], _pair_name("AFE", "exon")).join(a5ss.select("event1a", "event1b"), ["event1a", "event1b"], "left_anti").select(*COLUMNS)


def alternative_last(introns: DataFrame, a3ss: DataFrame) -> DataFrame:
    """Last introns with one donor, but for A3SS pairs."""
    rows = introns.where(~F.col("transcript_biotype").contains("novel_transcript") & F.col("is_last"))
    return _shared_site(rows, "ALE", donor(), [], _pair_name("ALE", "exon", 1)).join(a3ss.select("event1a", "event1b"), ["event1a", "event1b"], "left_anti").select(*COLUMNS)


def retained_introns(measurable: DataFrame, exons: DataFrame) -> DataFrame:
    """Measurable introns that lie within an exon."""
    held = iv.overlap_join(measurable.select("chrom", "start", "end", "strand", *_INTRON), exons.select("chrom", "start", "end", "strand", "transcript_id", "transcript_name"), kind="within")
    # The first transcript by name, combined before the shuffle: an intron may lie within very many exons.
    rows = held.groupBy(F.col("event_a").alias("event1a")).agg(F.min(F.struct("transcript_name_b", "transcript_id_b", "gene_id_a", "strand_a", "transcript_id_a", "transcript_name_a", "intron_number_a")).alias("x")).select("event1a", "x.*")
    rows = rows.select("event1a", F.col("event1a").alias("event1b"), F.col("event1a").alias("event_region"), F.col("gene_id_a").alias("gene_id"), F.col("gene_id_a").alias("gene_id_b"), F.col("strand_a").alias("strand"), F.col("transcript_id_b").alias("transcript_id_a"), F.col("transcript_name_b").alias("transcript_name_a"), F.lit(0).alias("intron_number_a"), F.col("transcript_id_a").alias("transcript_id_b"), F.col("transcript_name_a").alias("transcript_name_b"), F.col("intron_number_a").alias("intron_number_b"))
    name = F.concat(F.lit("RI:"), "transcript_name_a", F.lit("-exon;"), "transcript_name_b", F.lit("-int"), F.col("intron_number_b").cast("string"))
    return _finish(rows, "RI", name, ["event1a"])


def splice_events(introns: DataFrame, measurable: DataFrame, exons: DataFrame) -> DataFrame:
    """All events of the annotation."""
    introns, measurable = settle(introns), settle(measurable)
    a5, a3 = settle(alternative_5(introns)), settle(alternative_3(introns))
    out = mutually_exclusive(introns)
    for more in (skipped_exons(introns), alternative_first(introns, a5), alternative_last(introns, a3), a5, a3, retained_introns(measurable, exons)):
        out = out.unionByName(more)
    return out


def retention_events(measurable: DataFrame) -> DataFrame:
    """IR events, one for each measurable intron."""
    rows = measurable.select("event", "gene_id", "transcript_id", "transcript_name", "intron_number", "strand", "ir_name")
    cols = dict(event_type=F.lit("IR"), event_id=F.col("ir_name"), event_name=F.concat(F.col("transcript_name"), F.lit("_Intron"), F.col("intron_number").cast("string"), F.lit("/"), F.element_at(F.split("ir_name", "/"), -1)), event1a=F.col("event"), gene_id=F.col("gene_id"), event_region=F.col("event"), transcript_id_a=F.col("transcript_id"), transcript_name_a=F.col("transcript_name"), intron_number_a=F.col("intron_number"), strand=F.col("strand"))
    return rows.select(*[cols.get(c, F.lit(None).cast("int" if c == "intron_number_b" else "string")).alias(c) for c in COLUMNS])


def options(events: DataFrame, introns: DataFrame, side: str) -> DataFrame:
    """Transcripts that have a side's junctions: event_id, transcript columns, coding, first and last flags.

    The second junction must be in the same transcript as the first; AFE asks for first introns, ALE for last ones.
    """
    one = events.select("event_id", "event_type", F.col(f"event1{side}").alias("event"), F.col(f"event2{side}").alias("event2"))
    have = introns.select("event", "transcript_id", "transcript_name", "transcript_support_level", (F.col("transcript_biotype") == "protein_coding").alias("is_protein_coding"), "intron_number", "is_last")
    rows = one.join(have, "event")
    second = introns.select(F.col("event").alias("event2"), "transcript_id").distinct().withColumn("_two", F.lit(True))
    rows = rows.join(second, ["event2", "transcript_id"], "left").where("event2 is null or _two").drop("_two")
    return rows.where(((F.col("event_type") != "AFE") | (F.col("intron_number") == 1)) & ((F.col("event_type") != "ALE") | F.col("is_last")))


def best_option(rows: DataFrame) -> DataFrame:
    """One transcript for each event: support level as text, coding first, then name."""
    return unique_first(rows, ["event_id"], ["transcript_support_level", F.col("is_protein_coding").desc(), "transcript_name"])


def row_annotations(events: DataFrame, introns: DataFrame, exons: DataFrame, nmd: DataFrame | None = None, intron_nmd: DataFrame | None = None) -> DataFrame:
    """Events with coding, support, NMD and terminus flags of both sides.

    A flag holds if any transcript of the side has it (NMD: if all that were tested have it); support is the least as text.
    nmd: transcript_id, is_nmd. intron_nmd: intron_id, is_nmd of the transcript that retains it.
    """
    events, introns = settle(events), settle(introns)
    out = events
    for side, p in (("a", "inc"), ("b", "exc")):
        rows = options(events, introns, side)
        if nmd is not None:
            rows = rows.join(nmd.select("transcript_id", "is_nmd"), "transcript_id", "left")
        else:
            rows = rows.withColumn("is_nmd", F.lit(None).cast("boolean"))
        flags = rows.groupBy("event_id").agg(F.bool_or("is_protein_coding").alias(f"{p}_is_protein_coding"), F.min("transcript_support_level").alias(f"{p}_tsl"), F.bool_and("is_nmd").alias(f"{p}_is_nmd"))
        out = out.join(flags, "event_id", "left")
    if intron_nmd is not None:
        kept = introns.select("event", "intron_id").join(intron_nmd, "intron_id").groupBy(F.col("event").alias("event1a")).agg(F.bool_and("is_nmd").alias("_n"))
        out = out.join(kept, "event1a", "left").withColumn("inc_is_nmd", F.when(F.col("event_type") == "IR", F.col("_n")).otherwise(F.col("inc_is_nmd"))).drop("_n")
    ends = introns.groupBy("event").agg(F.bool_and(F.col("intron_number") == 1).alias("f"), F.bool_and("is_last").alias("l"))
    for side in "ab":
        out = out.join(ends.select(F.col("event").alias(f"event1{side}"), F.col("f").alias(f"_f{side}"), F.col("l").alias(f"_l{side}")), f"event1{side}", "left")
    both = lambda c: F.coalesce(F.col(f"_{c}a"), F.lit(False)) & F.coalesce(F.col(f"_{c}b"), F.lit(False))
    out = out.withColumns({"is_always_first_intron": F.when(F.col("event_type") == "AFE", both("f")), "is_always_last_intron": F.when(F.col("event_type") == "ALE", both("l"))}).drop("_fa", "_fb", "_la", "_lb")
    from isoframe.functions.coords import parse_interval

    out = settle(out)
    ir = out.where("event_type = 'IR'").select("event_id", parse_interval("event1a").alias("r")).select("event_id", "r.*")
    inside = iv.semi_overlap(ir, exons.select("chrom", "start", "end", "strand"), kind="within").select("event_id", F.lit(True).alias("_in"))
    out = out.join(inside, "event_id", "left").withColumn("is_annotated_ir", F.when(F.col("event_type") == "IR", F.coalesce("_in", F.lit(False)))).drop("_in")
    moved = F.when(F.col("inc_is_nmd") & ~F.col("exc_is_nmd"), 1).when(~F.col("inc_is_nmd") & F.col("exc_is_nmd"), -1).otherwise(0)
    return out.withColumn("nmd_direction", moved)
