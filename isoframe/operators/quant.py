"""Collation: sample statistics, junction and intron counts, event counts, the events x samples assays.

Facts are long tables keyed by sample; nothing relies on row positions. Windows run within one sample's splice sites or
islands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoframe.operators import intervals as iv
from isoframe.sources.store import settle

NOVEL_MIN_SAMPLES, NOVEL_MIN_READS = 3, 10
# Splice motifs read forwards on '+', and the same motifs reverse-complemented, found on '-'.
MOTIFS = {"GTAG": "+", "GCAG": "+", "ATAC": "+", "ATAG": "+", "CTAC": "-", "CTGC": "-", "GTAT": "-", "CTAT": "-"}


def sample_stats(reads: DataFrame, strands: DataFrame) -> DataFrame:
    """(sample, paired, depth, mean_frag_size, strand) from read_counts() and directionality()."""
    s, p = F.col("singles"), F.col("pairs")
    paired = ((s == 0) & (p > 0)) | ((s > 0) & (F.try_divide(p, s) > 10))
    depth = s + p
    base = reads.select("sample", F.coalesce(paired, F.lit(False)).alias("paired"), depth.alias("depth"), F.try_divide("nucleotides", depth).alias("mean_frag_size"))
    return base.join(strands.select("sample", F.col("direction").alias("strand")), "sample", "left").na.fill({"strand": 0})


def sample_qc(stats: DataFrame, qc: DataFrame) -> DataFrame:
    """Fractions of each sample's depth and junction reads.

    qc: sample, intergenic, rrna, nonpolya, mitochondrial, annotated, unannotated, nmd, spans, clean, known_exon, anti_sense.
    """
    part = lambda a, b: F.try_divide(F.col(a).cast("double"), b)
    junctions = F.col("annotated") + F.col("unannotated")
    cols = {f"{c}_fraction": part(c, F.col("depth")) for c in ("intergenic", "rrna", "nonpolya", "mitochondrial")}
    cols |= {"unanno_jn_fraction": part("unannotated", junctions), "nmd_jn_fraction": part("nmd", F.col("annotated")), "splice_fraction": part("annotated", F.col("depth")), "span_fraction": part("spans", F.col("depth"))}
    cols |= {f"ir_burden_{c}": part(c, F.col(c) + F.col("annotated")) for c in ("clean", "known_exon", "anti_sense")}
    return stats.join(qc, "sample").withColumns(cols)


def junction_union(counts: DataFrame) -> DataFrame:
    """Distinct junctions over all samples."""
    return counts.select("chrom", "start", "end", "strand").distinct()


def prevalence(counts: DataFrame, threshold: int = NOVEL_MIN_READS) -> DataFrame:
    """(chrom, start, end, samples, samples_over): in how many samples a junction has reads, and threshold reads or more."""
    return counts.groupBy("chrom", "start", "end").agg(F.count_if(F.col("total") > 0).alias("samples"), F.count_if(F.col("total") >= threshold).alias("samples_over"))


def check_same_introns(records: DataFrame) -> None:
    """Raise unless every sample has the same introns."""
    each = records.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("name").cast("decimal(20,0)")).alias("h"))
    if each.select("n", "h").distinct().limit(2).count() > 1:
        raise ValueError("samples were processed with different references: their introns differ")


def annotate_strand(junctions: DataFrame, annotated: DataFrame, contigs: DataFrame) -> DataFrame:
    """Strand of each junction: as annotated, or else as its motif tells; others, and those outside their contig, go.

    junctions: chrom, start, end (1-based), motif (four bases on '+'). annotated: chrom, start, end, strand. contigs: chrom,
    length. The motif is returned as read on the junction's strand.
    """
    inside = junctions.join(contigs, "chrom").where((F.col("start") >= 1) & (F.col("end") <= F.col("length"))).drop("length", "strand")
    known = annotated.groupBy("chrom", "start", "end").agg(F.min("strand").alias("_known"))
    by_motif = F.coalesce(*[F.when(F.col("motif") == m, s) for m, s in MOTIFS.items()])
    rows = inside.join(known, ["chrom", "start", "end"], "left").withColumn("strand", F.coalesce("_known", by_motif)).where("strand is not null")
    from isoframe.functions.coords import reverse_complement

    return rows.withColumns({"motif": F.when(F.col("strand") == "-", reverse_complement("motif")).otherwise(F.col("motif")), "annotated": F.col("_known").isNotNull()}).drop("_known")


def annotate_tandem(tandem: DataFrame, junctions: DataFrame) -> DataFrame:
    """Tandem junctions of which both junctions are known on one strand, or one of them on '*'."""
    side = lambda i: junctions.select("chrom", F.col("start").alias(f"start{i}"), F.col("end").alias(f"end{i}"), F.col("strand").alias(f"_s{i}"))
    rows = tandem.drop("strand").join(side(1), ["chrom", "start1", "end1"]).join(side(2), ["chrom", "start2", "end2"])
    a, b = F.col("_s1"), F.col("_s2")
    strand = F.when(a == b, a).when(a == "*", b).when(b == "*", a)
    return rows.withColumn("strand", strand).where("strand is not null").drop("_s1", "_s2")


def novel_junctions(junctions: DataFrame, prevalent: DataFrame, min_samples: int = NOVEL_MIN_SAMPLES, one_site_known: bool = False) -> DataFrame:
    """Unannotated junctions in min_samples samples or over the read threshold in one.

    one_site_known also asks that one of the two splice sites is annotated.
    """
    rows = junctions.where("not annotated").join(prevalent, ["chrom", "start", "end"]).where((F.col("samples") >= min_samples) | (F.col("samples_over") >= 1))
    if not one_site_known:
        return rows
    known = junctions.where("annotated")
    left = known.select("chrom", "strand", "start").distinct().withColumn("_l", F.lit(True))
    right = known.select("chrom", "strand", "end").distinct().withColumn("_r", F.lit(True))
    return rows.join(left, ["chrom", "strand", "start"], "left").join(right, ["chrom", "strand", "end"], "left").where("_l or _r").drop("_l", "_r")


def islands(df: DataFrame, name: str, keys: tuple[str, ...] = ("chrom", "strand")) -> DataFrame:
    """Merged islands of intervals, numbered from 1 in order; ids are unique over all keys."""
    merged = iv.reduce(df, keys)
    return merged.withColumn(name, F.concat_ws("/", *keys, F.row_number().over(Window.partitionBy(*keys).orderBy("start")).cast("string")))


def site_islands(introns: DataFrame, exon_islands: DataFrame, name: str, prefix: str) -> DataFrame:
    """introns with {prefix}_up and {prefix}_down: the island beside each splice site."""
    introns = settle(introns)
    out = introns
    for side, up in ((f"{prefix}_up", True), (f"{prefix}_down", False)):
        at = iv.splice_site_points(introns.select("chrom", "start", "end", "strand").withColumns({"_s": F.col("start"), "_e": F.col("end")}), up)
        hit = iv.overlap_join(at, exon_islands, suffixes=("", "_i")).groupBy("chrom", "strand", "_s", "_e").agg(F.min(f"{name}_i").alias(side))
        out = out.join(hit.withColumnsRenamed({"_s": "start", "_e": "end"}), ["chrom", "strand", "start", "end"], "left")
    return out


def count_by_strand(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """A junction's count in each sample by the sample's strandedness: all reads, or those of the right strand."""
    plus, minus = F.col("strand") == "+", F.col("strand") == "-"
    kind = F.col("_strand")
    count = F.when((kind == 0) | ~(plus | minus), F.col("total")).when(kind == -1, F.when(plus, F.col("neg")).otherwise(F.col("pos"))).otherwise(F.when(plus, F.col("pos")).otherwise(F.col("neg")))
    return counts.join(stats.select("sample", F.col("strand").alias("_strand")), "sample").withColumn("count", count.cast("double")).drop("_strand")


def splice_over(counts: DataFrame) -> DataFrame:
    """Adds splice_left, splice_right, over_left, over_right to junction counts with islands jg_up and jg_down.

    splice_*: reads of the sample that share the start or the end. over_* of a junction between two islands: reads that leave
    the island on that side for another one; of one inside an island: reads of all junctions there that overlap it. Neither
    is less than splice_*.
    """
    w = lambda *c: Window.partitionBy("sample", "chrom", "strand", *c)
    minus = F.col("strand") == "-"
    base = counts.withColumns({"splice_left": F.sum("count").over(w("start")), "splice_right": F.sum("count").over(w("end"))})
    # Islands are few and may hold many junctions: their sums are pre-aggregated and joined back.
    for side in ("jg_up", "jg_down"):
        total = counts.where("jg_up <> jg_down").groupBy("sample", "chrom", "strand", side).agg(F.sum("count").alias(f"_{side}"))
        base = base.join(total, ["sample", "chrom", "strand", side], "left")
    up, down = (F.coalesce(f"_{side}", F.lit(0.0)) for side in ("jg_up", "jg_down"))
    base = base.withColumns({"over_left": F.when(minus, down).otherwise(up), "over_right": F.when(minus, up).otherwise(down)}).select(*counts.columns, "splice_left", "splice_right", "over_left", "over_right")
    # The windows are computed once; what overlaps is then asked of the written table.
    base = settle(base)
    inner = base.where("jg_up = jg_down and count > 0").select("sample", "chrom", "start", "end", "strand", "jg_up", "count")
    asked = base.where("jg_up = jg_down").select("sample", "chrom", "start", "end", "strand", "jg_up")
    met = iv.overlap_join(asked, inner, keys=("sample", "chrom", "jg_up"))
    total = met.groupBy(*[F.col(f"{c}_a").alias(c) for c in ("sample", "chrom", "start", "end", "strand")]).agg(F.sum("count_b").alias("_inside"))
    out = base.join(total, ["sample", "chrom", "start", "end", "strand"], "left")
    inside = F.coalesce("_inside", F.lit(0.0))
    return out.withColumns({"over_left": F.greatest("over_left", inside, "splice_left"), "over_right": F.greatest("over_right", inside, "splice_right")}).drop("_inside")


def junction_psi(counts: DataFrame) -> DataFrame:
    """psi of each junction: its count against the reads over either side; 0 where it has none."""
    return counts.withColumn("psi", F.when(F.col("count") == 0, 0.0).otherwise(F.try_divide("count", F.greatest("over_left", "over_right"))))


def intron_metrics(records: DataFrame) -> DataFrame:
    """splice_max, splice_over, overlap_ratio and total_depth of intron records with over_left and over_right."""
    out = records.withColumns({"splice_max": F.greatest("splice_left", "splice_right"), "splice_over": F.greatest("over_left", "over_right")})
    share = lambda x: F.coalesce(F.try_divide(x, x + F.col("splice_over")), F.lit(0.0))
    ratio = F.when(F.col("depth") >= 1, share(F.col("depth"))).when(F.col("depth") > 0, share(F.col("coverage"))).otherwise(0.0)
    return out.withColumns({"overlap_ratio": ratio, "total_depth": F.col("depth") + F.col("splice_over")})


ROLES = ("1a", "2a", "1b", "2b")
SINGLE = ("AFE", "ALE", "A5SS", "A3SS")


def by_role(events: DataFrame, facts: DataFrame, columns: tuple[str, ...], key: str = "event") -> DataFrame:
    """(sample, event_name, {column}_{role}): what each event's junctions count in each sample that has any of them.

    One join on the junction's name and a fold by event, instead of a join for each role.
    """
    asked = events.select("event_name", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"event{r}").alias("event")) for r in ROLES])).alias("x")).select("event_name", "x.*").where("event is not null")
    met = asked.join(facts.select("sample", F.col(key).alias("event"), *columns), "event")
    return met.groupBy("sample", "event_name").agg(*[F.max(F.when(F.col("role") == r, F.col(c))).alias(f"{c}_{r}") for c in columns for r in ROLES])


def event_cells(events: DataFrame, junctions: DataFrame, introns: DataFrame, ir_over: bool = True) -> DataFrame:
    """One row for each event and sample with all assays and partial assays.

    events: event_name, event_type, strand, event_region, event1a, event2a, event1b, event2b (junctions as strings).
    junctions: sample, event, count, over_left, over_right. introns: sample, event_region, depth, coverage, splice_over,
    splice_max, total_depth, span_left, span_right. ir_over: what excludes retention, the reads over the intron or the larger
    of the two splice sites' reads.

    Reads at the upstream and the downstream island (up, down) come from the b junction for single-junction events, else from
    the a ones; participation is the share of them that the event's own junctions carry.
    """
    samples = junctions.select("sample").union(introns.select("sample")).distinct()
    cells = events.crossJoin(samples)  # the cube has a cell for each event and sample by definition
    counts = by_role(events, junctions, ("count", "over_left", "over_right"))
    depths = by_role(events, introns, ("total_depth",), "event_region")
    own = introns.select("sample", "event_region", F.col("depth").alias("_depth"), F.col("coverage").alias("_coverage"), "splice_over", "splice_max", F.col("total_depth").alias("_total"), "span_left", "span_right")
    cells = cells.join(counts, ["sample", "event_name"], "left").join(depths, ["sample", "event_name"], "left").join(own, ["sample", "event_region"], "left")
    kind, minus = F.col("event_type"), F.col("strand") == "-"
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    retained = kind.isin("IR", "RI")
    span_up = F.when(minus, zero("span_right")).otherwise(zero("span_left"))
    span_down = F.when(minus, zero("span_left")).otherwise(zero("span_right"))
    cells = cells.withColumns({
        "c1a": F.when(retained, zero("_depth")).otherwise(zero("count_1a")),
        "c2a": F.when(retained, span_up).otherwise(zero("count_2a")),
        "c1b": zero("count_1b"),
        "c2b": F.when(retained, span_down).otherwise(zero("count_2b")),
        **{f"up_{r}": F.when(minus, zero(f"over_right_{r}")).otherwise(zero(f"over_left_{r}")) for r in ROLES},
        **{f"down_{r}": F.when(minus, zero(f"over_left_{r}")).otherwise(zero(f"over_right_{r}")) for r in ROLES},
    })
    single = kind.isin(*SINGLE)
    cells = cells.withColumns({
        "jg_up": F.when(single, F.col("up_1b")).otherwise(F.col("up_1a")),
        "jg_down": F.when(single, F.col("down_1b")).when(kind == "SE", F.col("down_2a")).when(kind == "MXE", F.col("down_2b")).otherwise(F.col("down_1a")),
        "part_up": F.when(kind.isin("MXE", "SE", "ALE", "A3SS", "RI"), F.col("c1a") + F.col("c1b")).otherwise(0.0),
        "part_down": F.when(kind == "MXE", F.col("c2a") + F.col("c2b")).when(kind == "SE", F.col("c2a") + F.col("c1b")).when(kind.isin("AFE", "A5SS", "RI"), F.col("c1a") + F.col("c1b")).otherwise(0.0),
    })
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    cells = cells.withColumns({"cov_up": share("part_up", "jg_up"), "cov_down": share("part_down", "jg_down")})
    low_up = F.col("cov_up") < F.col("cov_down")
    first = F.greatest(zero("total_depth_1a"), zero("total_depth_1b"))
    second = F.when(kind == "SE", F.greatest(zero("total_depth_1b"), zero("total_depth_2a"))).when(kind == "MXE", F.greatest(zero("total_depth_2a"), zero("total_depth_2b"))).otherwise(first)
    out = {
        "included": F.when(kind.isin("SE", "MXE"), 0.5 * (F.col("c1a") + F.col("c2a"))).otherwise(F.col("c1a")),
        "excluded": F.when(kind == "IR", zero("splice_over" if ir_over else "splice_max")).when(kind == "MXE", 0.5 * (F.col("c1b") + F.col("c2b"))).otherwise(F.col("c1b")),
        "depth": F.coalesce("_total", F.greatest(first, second, "jg_up", "jg_down")),
        "coverage": F.when(retained, zero("_coverage")).when(kind.isin("MXE", "SE"), F.least("cov_up", "cov_down")).when(kind.isin("ALE", "A3SS"), F.col("cov_up")).otherwise(F.col("cov_down")),
        "min_depth": F.when(kind == "IR", zero("_depth")).when(kind.isin("MXE", "SE"), F.when(low_up, F.col("jg_up")).otherwise(F.col("jg_down"))).when(kind.isin("ALE", "A3SS", "RI"), F.col("jg_up")).otherwise(F.col("jg_down")),
        "up_inc": F.when(retained, F.col("c2a")).when(kind.isin("MXE", "SE"), F.col("c1a")),
        "down_inc": F.when(retained, F.col("c2b")).when(kind.isin("MXE", "SE"), F.col("c2a")),
        "up_exc": F.when(kind == "MXE", F.col("c1b")),
        "down_exc": F.when(kind == "MXE", F.col("c2b")),
    }
    return cells.withColumns(out).select("sample", *events.columns, *out)


def psi(included: str | Column = "included", excluded: str | Column = "excluded", min_total: float = 10.0) -> Column:
    """Inclusion ratio; null below min_total reads."""
    i, e = (F.col(x) if isinstance(x, str) else x for x in (included, excluded))
    return F.when(i + e >= min_total, F.try_divide(i, i + e))
