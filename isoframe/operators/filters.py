"""Event filters: frozen specifications compiled to aggregates over an event's samples.

Data filters keep an event where enough samples pass, over all samples or by the levels of a condition; annotation filters
test the event alone. Events of types that a filter does not name pass it, but for Modality, which drops those it names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoframe.functions.coords import parse_interval
from isoframe.operators import intervals as iv
from isoframe.sources.store import settle

TYPES = ("IR", "MXE", "SE", "A3SS", "A5SS", "AFE", "ALE", "RI")
DATA = ("Depth", "Participation", "Consistency")
ANNOTATION = ("Modality", "Protein_Coding", "NMD", "TSL", "Terminus", "ExclusiveMXE", "StrictAltSS")


@dataclass(frozen=True)
class EventFilter:
    """filter_type is one of DATA or ANNOTATION; percentages are clamped to 0..100, depths to 0 and more."""

    filter_type: str
    pc_true: float = 100.0
    minimum: float = 20.0
    maximum: float = 1.0
    min_depth: float = 5.0
    condition: str | None = None
    min_cond: int = -1
    event_types: tuple[str, ...] = field(default=TYPES)

    def __post_init__(self):
        if self.filter_type not in DATA + ANNOTATION:
            raise ValueError(f"no filter is named {self.filter_type!r}")
        if unknown := set(self.event_types) - set(TYPES):
            raise ValueError(f"no event types: {sorted(unknown)}")
        clamp = lambda x, hi: max(0.0, min(float(x), hi))
        object.__setattr__(self, "pc_true", clamp(self.pc_true, 100.0))
        object.__setattr__(self, "minimum", clamp(self.minimum, 100.0 if self.filter_type == "Participation" else float("inf")))
        object.__setattr__(self, "maximum", clamp(self.maximum, float("inf")))
        object.__setattr__(self, "min_depth", clamp(self.min_depth, float("inf")))


def default_filters() -> list[EventFilter]:
    """The recommended set."""
    return [
        EventFilter("Depth", pc_true=80, minimum=20),
        EventFilter("Participation", pc_true=80, minimum=70, min_depth=5, event_types=("IR", "RI")),
        EventFilter("Participation", pc_true=80, minimum=40, min_depth=20, event_types=("SE", "A5SS", "A3SS", "MXE")),
        EventFilter("Consistency", pc_true=80, maximum=2, min_depth=20, event_types=("MXE", "SE", "RI")),
        EventFilter("Terminus"),
        EventFilter("ExclusiveMXE"),
        EventFilter("StrictAltSS"),
    ]


def _log2(c: str) -> Column:
    return F.log2(F.col(c) + 1)


def passes(f: EventFilter) -> Column:
    """Whether one cell (event and sample) passes a data filter."""
    if f.filter_type == "Depth":
        return F.col("depth") >= f.minimum
    if f.filter_type == "Participation":
        return F.when(F.col("min_depth") < f.min_depth, F.lit(1.0)).otherwise(F.col("coverage")) >= f.minimum / 100
    close = F.lit(True)
    for total, sides, types in (("included", ("up_inc", "down_inc"), ("IR", "MXE", "SE", "RI")), ("excluded", ("up_exc", "down_exc"), ("MXE",))):
        up, down = (F.coalesce(s, F.lit(0.0)) for s in sides)
        whole = F.when(up + down < f.min_depth, F.lit(0.0)).otherwise(F.col(total))
        for side in (up, down):
            close = close & (~F.col("event_type").isin(*types) | (F.log2(whole + 1) - F.log2(side + 1) < f.maximum))
    return close


def run_filter(cells: DataFrame, f: EventFilter, samples: DataFrame | None = None, introns: DataFrame | None = None) -> DataFrame:
    """(event_name) of the events that a filter keeps.

    cells: one row for each event and sample, with event columns, assays and partial assays. samples: sample and the
    condition column, if the filter has one. introns: chrom, start, end, strand of the reference, for StrictAltSS.
    """
    named = F.col("event_type").isin(*f.event_types)
    if f.filter_type in DATA:
        rows = cells.select("event_name", "event_type", "sample", passes(f).alias("ok"))
        enough = F.count_if("ok") * 100 >= f.pc_true * F.count(F.lit(1))
        if f.condition is None:
            kept = rows.groupBy("event_name", "event_type").agg(enough.alias("keep"))
        else:
            levels = rows.join(samples.select("sample", F.col(f.condition).alias("level")), "sample").groupBy("event_name", "event_type", "level").agg(enough.alias("pass"))
            need = F.count(F.lit(1)) if f.min_cond < 0 else F.lit(f.min_cond)
            kept = levels.groupBy("event_name", "event_type").agg((F.count_if("pass") >= need).alias("keep"))
        return kept.where(F.col("keep") | ~named).select("event_name")
    # An event's columns are those of its first sample; where cells have none, a hash of the row decides.
    first = F.col("sample") if "sample" in cells.columns else F.xxhash64(*cells.columns)
    columns = ["event_name", "event_type", "event1a", "event1b"] if f.filter_type == "StrictAltSS" else cells.columns
    events = cells.groupBy("event_name").agg(F.min_by(F.struct(*columns), first).alias("_first")).select("_first.*")
    if f.filter_type == "StrictAltSS":
        return _strict_alt_ss(events, introns, named)
    return events.where(_annotation(f, named)).select("event_name")


def _annotation(f: EventFilter, named: Column) -> Column:
    kind = F.col("event_type")
    if f.filter_type == "Modality":
        return ~named
    if f.filter_type == "Protein_Coding":
        keep = F.coalesce("inc_is_protein_coding", F.lit(False)) | (F.coalesce("exc_is_protein_coding", F.lit(False)) & (kind != "IR"))
    elif f.filter_type == "NMD":
        keep = F.col("inc_is_nmd").isNotNull() & F.col("exc_is_nmd").isNotNull() & (F.col("inc_is_nmd") != F.col("exc_is_nmd"))
    elif f.filter_type == "TSL":
        low = lambda c: F.coalesce(F.col(c).try_cast("double") <= f.minimum, F.lit(False))
        keep = low("inc_tsl") & low("exc_tsl")
    elif f.filter_type == "Terminus":
        keep = ((kind != "AFE") | F.coalesce("is_always_first_intron", F.lit(False))) & ((kind != "ALE") | F.coalesce("is_always_last_intron", F.lit(False)))
    else:
        keep = (kind != "MXE") | ~_casettes_overlap()
    return keep | ~named


def _casettes_overlap() -> Column:
    """Whether the casette exons of a mutually exclusive pair share a base: exon = gap between the two junctions of a side."""
    exon = {}
    for side in "ab":
        one, two = parse_interval(f"event1{side}"), parse_interval(f"event2{side}")
        exon[side] = (F.least(one["end"], two["end"]) + 1, F.greatest(one["start"], two["start"]) - 1)
    return (exon["a"][0] <= exon["b"][1]) & (exon["b"][0] <= exon["a"][1])


def _strict_alt_ss(events: DataFrame, introns: DataFrame, named: Column) -> DataFrame:
    """(event_name) without alternative splice sites whose extra stretch holds a whole reference intron."""
    alt = F.col("event_type").isin("A5SS", "A3SS") & named
    # Settled: places are parsed once an event, not again in each condition on them that reaches down to here.
    sites = settle(events.select("event_name", alt.alias("alt"), *[parse_interval(f"event1{s}").alias(s) for s in "ab"]))
    rest = iv.row_difference(F.col("b.start"), F.col("b.end"), F.col("a.start"), F.col("a.end"))
    extra = sites.where("alt").select("event_name", "b.chrom", "b.strand", rest.alias("r")).where("r is not null").select("event_name", "chrom", "strand", "r.start", "r.end")
    inside = settle(introns.select("chrom", "start", "end", "strand").distinct())
    holds = iv.overlap_join(inside, extra, kind="within").select(F.col("event_name_b").alias("event_name")).distinct()
    return sites.select("event_name").join(holds, "event_name", "left_anti")


def apply_filters(cells: DataFrame, filters: list[EventFilter], samples: DataFrame | None = None, introns: DataFrame | None = None) -> DataFrame:
    """cells of the events that every filter keeps; all filters are checked before any runs."""
    for f in filters:
        if f.condition is not None and (samples is None or f.condition not in samples.columns):
            raise ValueError(f"filter {f.filter_type} needs samples with a column {f.condition!r}")
        if f.filter_type == "StrictAltSS" and introns is None:
            raise ValueError("StrictAltSS needs the reference introns")
    simple = [f for f in filters if f.filter_type in DATA and f.condition is None]
    out = cells
    if simple:  # one aggregate serves all filters over all samples
        checks = [(f"_{i}", f) for i, f in enumerate(simple)]
        per = cells.groupBy("event_name", "event_type").agg(*[((F.count_if(passes(f)) * 100 >= f.pc_true * F.count(F.lit(1))) | ~F.first("event_type").isin(*f.event_types)).alias(n) for n, f in checks])
        ok = F.lit(True)
        for n, _ in checks:
            ok = ok & F.col(n)
        out = out.join(per.where(ok).select("event_name"), "event_name", "left_semi")
    for f in filters:
        if f not in simple:
            out = out.join(run_filter(cells, f, samples, introns), "event_name", "left_semi")
    return out


def filter_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Events kept and removed by type."""
    names = before.select("event_type", "event_name").distinct().join(after.select("event_name", F.lit(True).alias("_k")).distinct(), "event_name", "left")
    return names.groupBy("event_type").agg(F.count_if(F.col("_k").isNotNull()).alias("kept"), F.count_if(F.col("_k").isNull()).alias("removed"))
