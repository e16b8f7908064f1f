"""Coverage retrieval, regions and bins, and what one view of a locus needs: slices, normalised tracks, group statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoframe.functions.coords import parse_interval, width
from isoframe.functions.special import t_quantile
from isoframe.operators import intervals as iv
from isoframe.operators.differential import t_test
from isoframe.sources.store import settle

MIN_NORM = 5.0


def plane(stranded: str = "unstranded", strand: Column | None = None) -> Column:
    """The coverage plane to read: '*' unstranded; the strand itself forward; the other one reverse."""
    s = F.lit("*") if strand is None else strand
    return F.lit("*") if stranded == "unstranded" else s if stranded == "forward" else F.translate(s, "+-", "-+")


def get_coverage(cover: DataFrame, chrom: str, start: int, end: int, strand: str = "*") -> DataFrame:
    """Runs of a region, cut to it. Literal bounds reach the scan as filters, so sorted files are read by row group only."""
    rows = cover.where((F.col("chrom") == chrom) & (F.col("strand") == strand) & (F.col("end") >= start) & (F.col("start") <= end))
    return rows.withColumns({"start": F.greatest("start", F.lit(start)), "end": F.least("end", F.lit(end))})


def coverage_per_base(cover: DataFrame, chrom: str, start: int, end: int, strand: str = "*", samples: DataFrame | None = None) -> DataFrame:
    """(sample, x, depth) of every base of a region, 0 where nothing covers it; of all samples, which cover has unless they are given."""
    runs = get_coverage(cover, chrom, start, end, strand)
    deep = runs.select("sample", F.explode(F.sequence("start", "end")).alias("x"), "depth")
    named = cover.select("sample").distinct() if samples is None else samples
    every = named.select("sample", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(end).cast("long"))).alias("x"))
    return every.join(deep, ["sample", "x"], "left").select("sample", "x", F.coalesce("depth", F.lit(0).cast("long")).alias("depth"))


def region_means(cover: DataFrame, regions: DataFrame, stranded: str = "unstranded", places: int = 2) -> DataFrame:
    """(sample, name, mean): mean depth of each region (chrom, start, end, strand, name) in each sample, rounded."""
    changes = iv.changes_of_runs(cover, ("sample", "chrom", "strand"))
    means = region_means_of_changes(changes, cover.select("sample").distinct(), regions, stranded, places)
    return means.select("sample", "name", "mean", F.explode(F.array_repeat(F.lit(0), F.col("regions").cast("int")))).drop("col")


def region_means_of_changes(changes: DataFrame, samples: DataFrame, regions: DataFrame, stranded: str = "unstranded", places: int = 2) -> DataFrame:
    """(sample, name, mean, regions): region_means() of coverage that is given as its changes (sample, chrom, strand, pos, d), for the
    samples named; regions of one name are one row, which says how many they are.

    A mean is two running sums looked up at either end of a region, so that no run meets a region.
    """
    each = regions.withColumn("strand", plane(stranded, F.col("strand"))).crossJoin(F.broadcast(samples))  # a mean for each sample by definition
    sums = iv.depth_sums(each, changes, ("sample", "chrom", "strand"), ("sample", "name"))
    mean = F.round(F.coalesce("sum", F.lit(0)) / (F.col("bases") / F.col("n")), places)
    return sums.select("sample", "name", mean.alias("mean"), F.col("n").alias("regions"))


def bin_breaks(start: int, end: int, bins: int = 2000) -> list[tuple[int, int]]:
    """Bins of a region: evenly spaced breaks, rounded, so that widths may differ by one."""
    n = end - start + 1
    count = max(1, math.ceil(n / max(1, math.ceil(n / bins))))
    edges = [start + (2 * i * n + count) // (2 * count) for i in range(count + 1)]
    return [(a, b - 1) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def binned_coverage(cover: DataFrame, chrom: str, start: int, end: int, strand: str = "*", bins: int = 2000, samples: DataFrame | None = None) -> DataFrame:
    """(sample, bin, start, end, mean) over the bins of a region."""
    spark = cover.sparkSession
    breaks = spark.createDataFrame([(chrom, a, b, "*", i) for i, (a, b) in enumerate(bin_breaks(start, end, bins))], "chrom string, start long, end long, strand string, name long")
    runs = get_coverage(cover, chrom, start, end, strand).withColumn("strand", F.lit("*"))
    base = region_means_exact(runs, breaks, cover.select("sample").distinct() if samples is None else samples)
    return base.join(breaks.select(F.col("name").alias("bin"), "start", "end"), "bin")


def region_means_exact(runs: DataFrame, regions: DataFrame, samples: DataFrame) -> DataFrame:
    met = iv.overlap_join(regions, runs, suffixes=("", "_c"))
    total = met.groupBy(F.col("sample_c").alias("sample"), F.col("name").alias("bin")).agg(F.sum(F.col("depth_c") * (F.least("end", "end_c") - F.greatest("start", "start_c") + 1)).alias("_t"))
    every = regions.select(F.col("name").alias("bin"), width().alias("_w")).crossJoin(samples)
    return every.join(total, ["sample", "bin"], "left").select("sample", "bin", (F.coalesce("_t", F.lit(0)) / F.col("_w")).alias("mean"))


@dataclass(frozen=True)
class Locus:
    chrom: str
    start: int
    end: int
    strand: str = "*"


def resolve_locus(where: str, events: DataFrame | None = None, genes: DataFrame | None = None, zoom: int = 0, flank: int = 100, contig_length: int | None = None) -> Locus:
    """An event's region, a gene, or coordinates, widened: length x 3^zoom plus the flank on both sides, cut to the contig."""
    found = None
    if events is not None:
        found = events.where(F.col("event_name") == where).select(parse_interval("event_region").alias("r")).select("r.*").first()
    if found is None and genes is not None:
        found = genes.where((F.col("gene_name") == where) | (F.col("gene_id") == where)).select("chrom", "start", "end", "strand").first()
    if found is None:
        found = (events or genes).sparkSession.range(1).select(parse_interval(F.lit(where)).alias("r")).select("r.*").first()
    if found is None or found["chrom"] is None:
        raise ValueError(f"no event, gene or region is named {where!r}")
    n = found["end"] - found["start"] + 1
    size = n * 3**zoom + 2 * flank
    start = found["start"] - (size - n) // 2
    end = start + size - 1
    return Locus(found["chrom"], max(1, start), min(end, contig_length) if contig_length else end, found["strand"])


@dataclass(frozen=True)
class View:
    """Frames of one locus: coverage (sample, x, depth), junctions, events with depths, transcripts' exons with their rows."""

    locus: Locus
    coverage: DataFrame
    junctions: DataFrame
    events: DataFrame
    exons: DataFrame


def coverage_data(data, cover: DataFrame, exons: DataFrame, locus: Locus, strand: str = "*") -> View:
    """What a plot of a locus needs from a dataset, its coverage and annotation."""
    x = locus
    at = data.samples.sparkSession.createDataFrame([(x.chrom, x.start, x.end, "*")], "chrom string, start long, end long, strand string")
    junctions = iv.semi_overlap(data.junctions, at).join(data.junction_assays, "event")
    inside = data.events.select("event_name", "event_type", parse_interval("event_region").alias("r")).where((F.col("r.chrom") == x.chrom) & (F.col("r.start") >= x.start) & (F.col("r.end") <= x.end)).select("event_name", "event_type")
    depths = inside.join(data.assays.select("event_name", "sample", "depth"), "event_name")
    near = iv.semi_overlap(exons, at)
    levels = iv.stack_levels(near.withColumn("view", F.lit(1)), ["view"], "transcript_id").select("transcript_id", "level")
    return View(x, coverage_per_base(cover, x.chrom, x.start, x.end, strand), junctions, depths, near.join(levels, "transcript_id"))


def event_norms(view_events: DataFrame, event_name: str) -> DataFrame:
    """(sample, norm): depth of an event in each sample; samples below MIN_NORM are left out."""
    return view_events.where((F.col("event_name") == event_name) & (F.col("depth") >= MIN_NORM)).select("sample", F.col("depth").alias("norm"))


def normalise(coverage: DataFrame, norms: DataFrame) -> DataFrame:
    return coverage.join(norms, "sample").withColumn("value", F.col("depth") / F.col("norm"))


def group_stats(tracks: DataFrame, samples: DataFrame, condition: str) -> DataFrame:
    """(group, x, mean, sd, sem, ci, n): ci is the half width of the 95 % interval by Student's t."""
    rows = tracks.join(samples.select("sample", F.col(condition).alias("group")), "sample")
    stats = rows.groupBy("group", "x").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count(F.lit(1)).alias("n"))
    # One quantile for each group size, of which there are as many as groups.
    sizes = [r["n"] for r in samples.groupBy(condition).agg(F.count(F.lit(1)).alias("n")).select("n").distinct().collect()]
    q = F.coalesce(*[F.when(F.col("n") == k, F.lit(t_quantile(0.975, k - 1))) for n in sizes for k in range(2, n + 1)], F.lit(None).cast("double")) if max(sizes, default=0) > 1 else F.lit(None).cast("double")
    sem = F.col("sd") / F.sqrt("n")
    return stats.withColumns({"sem": sem, "ci": sem * q})


def difference(stats: DataFrame, a: str, b: str, n_a: int, n_b: int) -> DataFrame:
    """(x, score): -log10 p of the equal-variance t test of two groups at each base."""
    side = lambda g, s: stats.where(F.col("group") == g).select("x", F.col("mean").alias(f"mean_{s}"), F.col("sd").alias(f"sd_{s}"))
    both = side(a, "a").join(side(b, "b"), "x")
    return both.select("x", t_test(F.col("mean_a"), F.col("sd_a"), n_a, F.col("mean_b"), F.col("sd_b"), n_b).alias("score"))


def junction_tracks(junctions: DataFrame, norms: DataFrame, samples: DataFrame, condition: str, least: float = 0.01) -> DataFrame:
    """(group, chrom, start, end, strand, mean_count, sd_count, mean_psi, sd_psi, height): junctions of each group.

    Counts are normalised; junctions below `least` of the group's largest mean are left out; height falls with the share.
    """
    rows = junctions.join(F.broadcast(norms), "sample").join(F.broadcast(samples.select("sample", F.col(condition).alias("group"))), "sample")
    value = F.col("count") / F.col("norm")
    out = rows.groupBy("group", "chrom", "start", "end", "strand").agg(F.avg(value).alias("mean_count"), F.stddev_samp(value).alias("sd_count"), F.avg("psi").alias("mean_psi"), F.stddev_samp("psi").alias("sd_psi"))
    # A window by group would hold a group's junctions in one task; its largest mean is one row.
    out = settle(out)
    top = out.groupBy(F.col("group").alias("_group")).agg(F.max("mean_count").alias("_top"))
    met = out.join(F.broadcast(top), F.col("group").eqNullSafe(F.col("_group")))
    return met.withColumn("height", F.try_divide("mean_count", "_top")).where(F.col("height") >= least).drop("_group", "_top")


def highlight(exons: DataFrame, introns: DataFrame, event: DataFrame) -> DataFrame:
    """exons with highlight 'a' or 'b' where the transcript has that side's first junction."""
    sides = event.select(F.explode(F.array(F.struct(F.col("event1a").alias("event"), F.lit("a").alias("side")), F.struct(F.col("event1b").alias("event"), F.lit("b").alias("side")))).alias("x")).select("x.*").where("event is not null")
    hit = introns.join(sides, "event").groupBy("transcript_id").agg(F.min("side").alias("highlight"))
    return exons.join(hit, "transcript_id", "left")


def sample_pca(qc: DataFrame, columns: list[str], k: int = 2) -> DataFrame:
    """(sample, pc): scaled principal components of quality figures; columns without variance are left out."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    spread = qc.agg(*[F.var_samp(c).alias(c) for c in columns]).first()
    used = [c for c in columns if spread[c]]
    rows = VectorAssembler(inputCols=used, outputCol="raw").transform(qc.select("sample", *used).na.drop())
    scaled = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True).fit(rows).transform(rows)
    return PCA(k=min(k, len(used)), inputCol="scaled", outputCol="pc").fit(scaled).transform(scaled).select("sample", "pc")
