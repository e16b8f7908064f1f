"""The events x samples dataset: long assays with event and sample tables; subsets, combinations, matrices."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoframe.operators import intervals as iv
from isoframe.operators.filters import EventFilter, apply_filters
from isoframe.operators.quant import psi
from isoframe.sources.store import settle


@dataclass(frozen=True)
class SpliceDataset:
    """events: event_name and annotations; samples: sample and conditions; assays: (event_name, sample) and values.

    junctions (chrom, start, end, strand, event) and junction_assays (event, sample, psi, count, count_uns) cover all
    junctions, whatever events are kept. Frames are lazy; realize() caches them.
    """

    events: DataFrame
    samples: DataFrame
    assays: DataFrame
    junctions: DataFrame | None = None
    junction_assays: DataFrame | None = None
    qc: DataFrame | None = None
    introns: DataFrame | None = None
    source: str | None = None

    def cells(self) -> DataFrame:
        """Assays with the events' columns."""
        return self.assays.join(self.events, "event_name")

    def assay(self, name: str) -> DataFrame:
        return self.assays.select("event_name", "sample", name)

    def assay_names(self) -> list[str]:
        return [c for c in self.assays.columns if c not in ("event_name", "sample")]

    def up_inc(self) -> DataFrame:
        return self.assay("up_inc")

    def down_inc(self) -> DataFrame:
        return self.assay("down_inc")

    def up_exc(self) -> DataFrame:
        return self.assay("up_exc")

    def down_exc(self) -> DataFrame:
        return self.assay("down_exc")

    def with_assay(self, name: str, values: DataFrame) -> SpliceDataset:
        """Values (event_name, sample, name) in place of an assay or beside the others."""
        rest = self.assays.drop(name)
        return replace(self, assays=rest.join(values.select("event_name", "sample", name), ["event_name", "sample"], "left"))

    def row_ranges(self) -> DataFrame:
        from isoframe.functions.coords import parse_interval

        return self.events.select("event_name", parse_interval("event_region").alias("_r")).select("event_name", "_r.*")

    def coverage_files(self) -> DataFrame:
        return self.samples.select("sample", "cov_file")

    def subset(self, events: Column | DataFrame | None = None, samples: Column | DataFrame | None = None) -> SpliceDataset:
        """Events and samples by a condition or a table of names. Junction assays follow the samples only."""
        pick = lambda df, by, key: df if by is None else df.where(by) if isinstance(by, Column) else df.join(by.select(key).distinct(), key, "left_semi")
        e, s = pick(self.events, events, "event_name"), pick(self.samples, samples, "sample")
        rows = self.assays
        if events is not None:
            rows = rows.join(e.select("event_name"), "event_name", "left_semi")
        follow = lambda df: df if df is None or samples is None else df.join(s.select("sample"), "sample", "left_semi")
        return replace(self, events=e, samples=s, assays=follow(rows), junction_assays=follow(self.junction_assays), qc=follow(self.qc))

    def filter(self, filters: list[EventFilter]) -> SpliceDataset:
        kept = apply_filters(self.cells(), filters, self.samples, self.introns)
        return self.subset(events=kept.select("event_name").distinct())

    def bind_samples(self, other: SpliceDataset) -> SpliceDataset:
        """Columns of two datasets of one source side by side; a sample in both is an error."""
        if self.source != other.source:
            raise ValueError("datasets come from different sources")
        if not self.samples.join(other.samples, "sample", "left_semi").isEmpty():
            raise ValueError("a sample is in both datasets")
        both = lambda a, b: a if b is None else b if a is None else a.unionByName(b, allowMissingColumns=True)
        return replace(self, samples=both(self.samples, other.samples), assays=both(self.assays, other.assays), junction_assays=both(self.junction_assays, other.junction_assays), qc=both(self.qc, other.qc))

    def bind_events(self, other: SpliceDataset) -> SpliceDataset:
        """Rows of two datasets of one source; an event in both is an error."""
        if self.source != other.source:
            raise ValueError("datasets come from different sources")
        if not self.events.join(other.events, "event_name", "left_semi").isEmpty():
            raise ValueError("an event is in both datasets")
        return replace(self, events=self.events.unionByName(other.events, allowMissingColumns=True), assays=self.assays.unionByName(other.assays, allowMissingColumns=True))

    def realize(self) -> SpliceDataset:
        """The dataset read from what is written of it now, not worked out again."""
        return replace(self, events=settle(self.events), samples=settle(self.samples), assays=settle(self.assays))

    def validate(self) -> None:
        """Raise unless names are unique and every assay cell belongs to an event and a sample."""
        for df, key in ((self.events, "event_name"), (self.samples, "sample")):
            if not df.groupBy(key).count().where("count > 1").isEmpty():
                raise ValueError(f"{key} is not unique")
        if not self.assays.join(self.events, "event_name", "left_anti").isEmpty() or not self.assays.join(self.samples, "sample", "left_anti").isEmpty():
            raise ValueError("assays have cells outside the dataset")

    def clean_samples(self) -> SpliceDataset:
        """Without sample columns that are null throughout."""
        filled = self.samples.agg(*[F.count(c).alias(c) for c in self.samples.columns]).first().asDict()
        return replace(self, samples=self.samples.select(*[c for c in self.samples.columns if filled[c] or c == "sample"]))


def drop_overlapping_introns(data: SpliceDataset) -> SpliceDataset:
    """Of introns that overlap, keeps retention events of the one with the highest mean count, first by place on ties.

    A retention event stays if, among the junctions that overlap its intron, it is itself the most used one; events whose
    intron is no junction go. Of places alike in all but the strand the first strand by code point counts.

    Junctions meet junctions: one that a more used one overlaps is beaten, so that no pair leaves the join but for its name.
    """
    mean = data.junction_assays.groupBy("event").agg(F.avg("count").alias("mean"))
    used = data.junctions.join(mean, "event").select("chrom", "start", "end", "strand", "event", "mean")
    rank = lambda s: F.struct(F.col(f"mean{s}"), -F.col(f"start{s}"), -F.col(f"end{s}"))
    better = (rank("_j") > rank("")) | ((rank("_j") == rank("")) & (F.col("strand_j") < F.col("strand")))
    met = iv.overlap_join(used, used.drop("event"), suffixes=("", "_j"), bins=iv.choose_bins(data.junctions, data.junctions))
    beaten = met.where(better).select("event").distinct()
    best = used.select("event").join(beaten, "event", "left_anti").select(F.col("event").alias("event1a"))
    ir = F.coalesce(F.col("event_type") == "IR", F.lit(False))
    kept = data.events.where(~ir).unionByName(data.events.where(ir).join(best, "event1a", "left_semi").select(*data.events.columns))
    return replace(data, events=kept, assays=data.assays.join(kept.select("event_name"), "event_name", "left_semi"))


def drop_overlapping_introns_iterative(data: SpliceDataset) -> SpliceDataset:
    """The older rule: of each island of overlapping introns the highest mean ratio stays, and introns that overlap none of those
    that stay come back, until nothing changes. Each round settles one intron of every island, so it ends."""
    from isoframe.functions.coords import parse_interval

    ratio = data.assays.groupBy("event_name").agg(F.avg(F.coalesce(F.try_divide(F.col("included"), F.col("included") + F.col("excluded")), F.lit(0.0))).alias("mean"))
    ir = settle(data.events.where("event_type = 'IR'").select("event_name", parse_interval("event1a").alias("_r")).select("event_name", "_r.*").join(ratio, "event_name"))
    open_, kept = ir, None
    while not open_.isEmpty():
        merged = settle(iv.reduce(open_).withColumn("island", F.monotonically_increasing_id()))
        inside = iv.overlap_join(open_, merged, kind="within", suffixes=("", "_i"))
        best = inside.groupBy("island_i").agg(F.max_by("event_name", F.struct("mean", -F.col("start"), -F.col("end"), "event_name")).alias("event_name"))
        chosen = settle(ir.join(best.select("event_name"), "event_name", "left_semi"))
        kept = chosen if kept is None else settle(kept.unionByName(chosen))
        open_ = settle(iv.anti_overlap(open_, chosen))
    gone = ir.select("event_name") if kept is None else ir.select("event_name").join(kept.select("event_name"), "event_name", "left_anti")
    return data.subset(events=data.events.select("event_name").join(gone, "event_name", "left_anti"))


def with_psi(assays: DataFrame, min_total: float = 10.0) -> DataFrame:
    return assays.withColumn("psi", psi(min_total=min_total))


def _logit(x: Column, limit: float) -> Column:
    inner = F.when(x <= 0, -limit).when(x >= 1, limit).otherwise(F.ln(x / (1 - x)))
    return F.when(x.isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), inner)))


def psi_values(assays: DataFrame, method: str = "PSI", min_total: float = 10.0, max_missing: float | None = 0.1) -> DataFrame:
    """(event_name, sample, value): ratio, its logit clipped to 5, or the event's z-score (null where a sample is missing).

    Events missing (below min_total reads) in max_missing or more of the samples are left out, unless that is None.
    """
    w = Window.partitionBy("event_name")
    rows = with_psi(assays, min_total).withColumns({"_n": F.count(F.lit(1)).over(w), "_missing": F.count_if(F.col("psi").isNull()).over(w)})
    if max_missing is not None:
        rows = rows.where(F.col("_missing") < max_missing * F.col("_n"))
    value = F.col("psi")
    if method == "logit":
        value = _logit(value, 5.0)
    elif method == "Z-score":
        value = F.when(F.col("_missing") == 0, F.try_divide(value - F.avg("psi").over(w), F.stddev_samp("psi").over(w)))
    elif method != "PSI":
        raise ValueError("method is PSI, logit or Z-score")
    return rows.select("event_name", "sample", value.alias("value"))


def make_matrix(assays: DataFrame, samples: list[str], **options) -> DataFrame:
    """psi_values as a matrix: a row for each event, a column for each sample named."""
    return psi_values(assays, **options).groupBy("event_name").pivot("sample", samples).agg(F.first("value"))


def mean_psi(assays: DataFrame, samples: DataFrame, condition: str, min_total: float = 10.0) -> DataFrame:
    """(event_name, level, mean): the mean on the logit scale, clipped to 10, of the samples of each level."""
    rows = with_psi(assays, min_total).join(samples.select("sample", F.col(condition).alias("level")), "sample")
    mean = F.avg(_logit(F.col("psi"), 10.0))
    return rows.groupBy("event_name", "level").agg((1 / (1 + F.exp(-mean))).alias("mean"))
