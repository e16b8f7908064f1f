"""Interval algebra on flat columns chrom, start, end, strand (1-based closed).

Overlap joins are equi-joins on bins. An interval belongs to the level whose bins are at least as wide as it is long, so
it touches two bins at most, and is also posted at the coarser levels that the other table uses: a pair meets at the
level of the longer one. Merges and coverage
run in two steps, within bins and then across bins, so that one contig is not one task: what is left for the second
step is bounded by the genome, not by the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoframe.functions.coords import strands_meet, width
from isoframe.sources.store import settle

LEVEL_FACTOR = 8
#: Width of the bins that merges and coverage work in first.
STEP = 1 << 16


def _level(base: int, levels: int) -> Column:
    """The least level whose bins are as wide as the interval is long."""
    w = width()
    level = F.lit(levels - 1)
    for n in reversed(range(levels - 1)):
        level = F.when(w <= base * LEVEL_FACTOR**n, F.lit(n)).otherwise(level)
    return level


def _bin(position: str | Column, level: Column, base: int) -> Column:
    p = F.col(position) if isinstance(position, str) else position
    return F.floor(p / (F.lit(base) * F.pow(F.lit(LEVEL_FACTOR), level))).cast("long")


@dataclass(frozen=True)
class Bins:
    """The width of the finest bins, the number of levels, and the levels that the left and the right table use."""

    base: int
    levels: int
    left: frozenset[int]
    right: frozenset[int]


def choose_bins(left: DataFrame, right: DataFrame, base: int | None = None) -> Bins:
    """Bins of about twice the larger mean length, and levels up to the longest interval.

    One aggregate a table, of at most 64 rows: counts by the number of bits of the length.
    """
    bits = [t.groupBy(F.length(F.bin(width() - 1)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(width()).alias("w")).collect() for t in (left, right)]
    means = [sum(r["w"] for r in rows) / sum(r["n"] for r in rows) for rows in bits if rows]
    if base is None:
        base = 1 << max(4, min(17, int(2 * max(means, default=1)).bit_length()))
    level = lambda b: next(n for n in range(64) if 1 << b <= base * LEVEL_FACTOR**n)
    used = [frozenset(level(r["b"]) for r in rows) or frozenset({0}) for rows in bits]
    return Bins(base, max(used[0] | used[1]) + 1, *used)


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    kind: str = "any",
    ignore_strand: bool = False,
    how: str = "inner",
    suffixes: tuple[str, str] = ("_a", "_b"),
    base: int | None = None,
    keys: Sequence[str] = ("chrom",),
    bins: Bins | None = None,
) -> DataFrame:
    """Pairs that share a base ("any"), where left lies within right ("within"), or that are equal ("equal").

    how: "inner" gives each pair once, columns with suffixes; "left_semi" and "left_anti" give rows of left. Strands
    must be equal or one of them '*', unless ignored. base: width of the finest bins, chosen from the data if None.
    """
    if kind == "equal":
        a = left.select(*[F.col(c).alias(c + suffixes[0]) for c in left.columns])
        b = right.select(*[F.col(c).alias(c + suffixes[1]) for c in right.columns])
        on = [F.col(c + suffixes[0]) == F.col(c + suffixes[1]) for c in (*keys, "start", "end")]
        if not ignore_strand:
            on.append(strands_meet("strand" + suffixes[0], "strand" + suffixes[1]))
        joined = a.join(b, on, how)
        return joined if how == "inner" else joined.select(*[F.col(c + suffixes[0]).alias(c) for c in left.columns])
    if kind not in ("any", "within"):
        raise ValueError(f"kind is any, within or equal, not {kind!r}")
    if how != "inner":
        # Whether a row overlaps depends on its coordinates alone, so these are matched once and joined back.
        at = [*keys, "start", "end", "strand"]
        places = settle(left.select(*at).distinct())
        # What overlaps some interval overlaps their union: merged, they meet each place a few times at most.
        others = settle(reduce(right, (*keys, "strand"))) if kind == "any" else right
        hits = overlap_join(places, others.select(*at), kind, ignore_strand, "inner", suffixes, base, keys, bins)
        return left.join(hits.select(*[F.col(c + suffixes[0]).alias(c) for c in at]).distinct(), at, how)
    if bins is None:
        bins = choose_bins(left, right, base)
    base = bins.base

    def posted(df: DataFrame, suffix: str, others: frozenset[int]) -> DataFrame:
        """At its own level and at each coarser one that the other table uses."""
        own = _level(base, bins.levels)
        above = [F.filter(F.array(*map(F.lit, sorted(others))), lambda n: n > own)] if others else []
        rows = df.select("*", F.explode(F.concat(F.array(own), *above)).alias("_level"), own.alias("_own"))
        places = F.array_distinct(F.array(_bin("start", F.col("_level"), base), _bin("end", F.col("_level"), base)))
        rows = rows.select("*", F.explode(places).alias("_bin"))
        return rows.select(*[F.col(c).alias(c if c in ("_level", "_bin") else c + suffix) for c in rows.columns], *[F.col(c).alias(f"_key_{c}") for c in keys])

    # What holds an interval is no shorter, so that such a pair meets at the level of the right one, which has no need of others.
    above = bins.left if kind == "any" else frozenset()
    a, b = posted(left, suffixes[0], bins.right).alias("a"), posted(right, suffixes[1], above).alias("b")
    s = lambda c, i: F.col(c + suffixes[i])
    if kind == "within":
        met = (s("start", 1) <= s("start", 0)) & (s("end", 0) <= s("end", 1))
    else:
        met = (s("start", 0) <= s("end", 1)) & (s("start", 1) <= s("end", 0))
    if not ignore_strand:
        met = met & strands_meet(s("strand", 0), s("strand", 1))
    # A pair counts at the level of the longer one, where either touches two bins at most, and in the first bin they share.
    met = met & (F.col("a._level") == F.greatest(s("_own", 0), s("_own", 1)))
    met = met & (F.col("a._bin") == _bin(F.greatest(s("start", 0), s("start", 1)), F.col("a._level"), base))
    for c in (*[f"_key_{k}" for k in keys], "_level", "_bin"):
        met = met & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    pick = [F.col(c + suffixes[0]) for c in left.columns] + [F.col(c + suffixes[1]) for c in right.columns]
    return a.join(b, met).select(*pick)


def semi_overlap(left: DataFrame, right: DataFrame, **options) -> DataFrame:
    return overlap_join(left, right, how="left_semi", **options)


def anti_overlap(left: DataFrame, right: DataFrame, **options) -> DataFrame:
    return overlap_join(left, right, how="left_anti", **options)


def overlap_update(left: DataFrame, right: DataFrame, columns: Mapping[str, str], order: Sequence[str], **options) -> DataFrame:
    """An update of left by overlap: where some right interval meets a row, its `columns` (left name: right name) become those of
    the hit that is last in `order`, nulls included; other rows keep what they have, or null for a new column.

    A row's hits depend on its place alone, so places are matched once. Each hit carries its ordinal, and the last one of a place
    is one aggregate, combined before the shuffle. Of hits alike in order the greatest by value counts. options: as overlap_join.
    """
    keys = options.get("keys", ("chrom",))
    at = [*keys, "start", "end", "strand"]
    named = {f"_n{i}": F.col(c) for i, c in enumerate(order)} | {f"_v{i}": F.col(c) for i, c in enumerate(columns.values())}
    subjects = right.select(*at, *[c.alias(n) for n, c in named.items()])
    hits = overlap_join(left.select(*at).distinct(), subjects, how="inner", suffixes=("", "_hit"), **options)
    last = hits.groupBy(*at).agg(F.max(F.struct(*[F.col(f"{n}_hit").alias(n) for n in named])).alias("_last"))
    joined = left.join(last, at, "left")
    new = {c: F.col(f"_last._v{i}") for i, c in enumerate(columns)}
    kept = [F.when(F.col("_last").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in left.columns]
    return joined.select(*kept, *[new[c].alias(c) for c in columns if c not in left.columns])


def _islands(df: DataFrame, by: Sequence[str], gap: int) -> DataFrame:
    before = Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    reach = df.withColumn("_reach", F.max("end").over(before))
    opened = reach.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + gap), 1).otherwise(0))
    return opened.withColumn("_island", F.sum("_new").over(upto)).groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def reduce(df: DataFrame, keys: Sequence[str] = ("chrom", "strand"), gap: int = 1, step: int = STEP) -> DataFrame:
    """Merged intervals of each key: those that overlap, touch, or have fewer than `gap` bases between them.

    gap = 1 merges overlapping and adjacent ones. Equal intervals collapse before any sort, then neighbours within bins of
    `step` bases, then islands of neighbouring bins.
    """
    distinct = df.select(*keys, "start", "end").distinct().withColumn("_step", F.floor(F.col("start") / step))
    return _across_bins(_islands(distinct, [*keys, "_step"], gap), keys, gap)


def _across_bins(local: DataFrame, keys: Sequence[str], gap: int) -> DataFrame:
    """Islands of whole contigs from the islands of each bin, (keys, _step, start, end).

    What reaches into a bin is the island that was opened last before it, so a bin needs to know where that began and how far
    earlier ones reach: one row a bin. Only these rows are sorted by contig; islands stay dealt by bin.
    """
    local = settle(local)
    before = Window.partitionBy(*keys).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    per = local.groupBy(*keys, "_step").agg(F.max("end").alias("_top"), F.max("start").alias("_start")).withColumn("_reach", F.max("_top").over(before))
    opens = lambda c: F.col("_reach").isNull() | (F.col(c) > F.col("_reach") + gap)
    per = per.withColumn("_owner", F.max(F.when(opens("_start"), F.col("_start"))).over(before))
    per = per.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate((*keys, "_step"))], "_reach", "_owner")
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate((*keys, "_step"))]
    owned = local.join(per, on).select(*keys, F.when(opens("start"), F.col("start")).otherwise(F.col("_owner")).alias("start"), "end")
    return owned.groupBy(*keys, "start").agg(F.max("end").alias("end"))


def coverage_runs(df: DataFrame, keys: Sequence[str] = ("chrom", "strand"), step: int = STEP) -> DataFrame:
    """Runs of equal depth above zero, as (keys, start, end, depth), end included."""
    return runs_of_changes(changes_of_intervals(df, keys), keys, step)


def changes_of_runs(runs: DataFrame, keys: Sequence[str] = ("chrom", "strand"), weight: str = "depth") -> DataFrame:
    """(keys, pos, d): the places where the depth of runs changes, by how much; runs that touch give a place twice."""
    edge = lambda pos, d: F.struct(pos.alias("pos"), d.cast("long").alias("d"))
    edges = F.array(edge(F.col("start"), F.col(weight)), edge(F.col("end") + 1, -F.col(weight)))
    return runs.select(*keys, F.inline(edges))


def changes_of_intervals(df: DataFrame, keys: Sequence[str] = ("chrom", "strand")) -> DataFrame:
    """(keys, pos, d): one row for each place where the number of intervals that cover it changes by d."""
    edges = changes_of_runs(df.withColumn("_n", F.lit(1)), keys, "_n")
    return edges.groupBy(*keys, "pos").agg(F.sum("d").alias("d")).where("d <> 0")


def runs_of_changes(steps: DataFrame, keys: Sequence[str], step: int = STEP) -> DataFrame:
    """Runs of equal depth above zero from (keys, pos, d), one row for each place where the depth changes by d."""
    return _runs(steps, keys, step).where("depth > 0").drop("_step")


def _runs(steps: DataFrame, keys: Sequence[str], step: int) -> DataFrame:
    """Runs between changes of depth: (keys, _step, start, end, depth), dealt by (keys, _step), the bin that a run starts in.

    What a bin has to know of others, the depth before it and the first change after it, goes into it as one more row, at its head.
    So changes are shuffled once to where they are sorted, and both readers of `steps` share the shuffle that summed them up.
    """
    steps = steps.where("pos is not null").withColumn("_step", F.floor(F.col("pos") / step))
    nothing = F.lit(None).cast("long")
    order = Window.partitionBy(*keys).orderBy("_step")
    per = steps.groupBy(*keys, "_step").agg(F.sum("d").alias("_sum"), F.min("pos").alias("_first"))
    before = F.coalesce(F.sum("_sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(*keys, "_step", nothing.alias("pos"), before.alias("d"), F.lead("_first").over(order).alias("_next"))
    rows = steps.select(*keys, "_step", "pos", "d", nothing.alias("_next")).unionByName(per)
    # The bin first: rows that compare unequal by a number are the cheapest to sort.
    inner = Window.partitionBy("_step", *keys).orderBy(F.col("pos").asc_nulls_first())
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    end = F.coalesce(F.lead("pos").over(inner), F.first("_next").over(upto)) - 1
    runs = rows.select(*keys, "_step", F.col("pos").alias("start"), end.alias("end"), F.sum("d").over(upto).cast("long").alias("depth"))
    return runs.where("start is not null and end is not null")


def _sweep(a: DataFrame, b: DataFrame, keys: Sequence[str], step: int) -> DataFrame:
    """Runs of (keys, _step, start, end) with how often a and b cover them."""
    side = lambda df, i: df.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).alias("pos"), F.lit(-1).alias("d")))).alias("e")).select(*keys, "e.pos", *[(F.col("e.d") if i == n else F.lit(0)).cast("long").alias(f"d{n}") for n in (0, 1)])
    # Both depths travel in one number: b in the low 32 bits.
    packed = side(a, 0).unionByName(side(b, 1)).groupBy(*keys, "pos").agg((F.sum("d0") * (1 << 32) + F.sum("d1")).alias("d"))
    runs = _runs(packed, keys, step)
    return runs.select(*keys, "_step", "start", "end", F.shiftright("depth", 32).alias("a"), F.col("depth").bitwiseAND((1 << 32) - 1).alias("b"))


def _joined(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs that touch as one: first within bins, as they are dealt, then what is left of a contig."""
    return _across_bins(_islands(runs.select(*keys, "_step", "start", "end"), [*keys, "_step"], 1), keys, 1)


def setdiff(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("chrom", "strand"), step: int = STEP) -> DataFrame:
    """Merged parts of a that b does not cover, within each key."""
    return _joined(_sweep(a, b, keys, step).where("a > 0 and b = 0"), keys)


def intersect(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("chrom", "strand"), step: int = STEP) -> DataFrame:
    """Merged parts that a and b both cover, within each key."""
    return _joined(_sweep(a, b, keys, step).where("a > 0 and b > 0"), keys)


def covered_bases(df: DataFrame, zones: DataFrame, keys: Sequence[str] = ("chrom", "strand"), step: int = STEP) -> DataFrame:
    """df with `covered`: how many bases of each row lie in the zones of its key, which must not overlap each other.

    Up to a place x lie the sum of d (x + 1 - p) over the changes d of depth at places p up to x. These are two running sums, within
    bins and over bins, so that a row costs two places and not one pair for each zone that it meets.
    """
    row = lambda pos, d: F.struct(pos.alias("pos"), F.lit(d).cast("long").alias("d"))
    nothing = F.lit(None).cast("long")
    edges = zones.select(*keys, nothing.alias("start"), nothing.alias("end"), F.explode(F.array(row(F.col("start"), 1), row(F.col("end") + 1, -1))).alias("e"))
    edges = edges.select(*keys, "start", "end", "e.*", F.lit(0).cast("long").alias("sign"))
    asked = df.select(*keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).distinct()
    asked = asked.select("*", F.explode(F.array(row(F.col("start") - 1, -1), row(F.col("end"), 1))).alias("e"))
    asked = asked.select(*keys, "start", "end", "e.pos", F.lit(0).cast("long").alias("d"), F.col("e.d").alias("sign"))
    places = edges.unionByName(asked).withColumns({"_step": F.floor(F.col("pos") / step), "p": F.col("d") * F.col("pos")})
    over = Window.partitionBy(*keys).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    per = places.groupBy(*keys, "_step").agg(F.sum("d").alias("_d"), F.sum("p").alias("_p"))
    per = per.select(*keys, "_step", *[F.coalesce(F.sum(f"_{c}").over(over), F.lit(0)).alias(f"_{c}") for c in "dp"])
    inner = Window.partitionBy(*keys, "_step").orderBy("pos", F.abs("sign")).rowsBetween(Window.unboundedPreceding, 0)
    upto = (F.col("pos") + 1) * (F.col("_d") + F.sum("d").over(inner)) - (F.col("_p") + F.sum("p").over(inner))
    found = places.join(per, [*keys, "_step"]).withColumn("_upto", upto).where("sign <> 0").groupBy(*keys, "start", "end").agg(F.sum(F.col("sign") * F.col("_upto")).alias("covered"))
    return df.join(found, [*keys, "start", "end"], "left")


def depth_sums(asked: DataFrame, changes: DataFrame, keys: Sequence[str], by: Sequence[str], step: int = STEP) -> DataFrame:
    """(by, n, bases, sum): the depth of every base of the rows asked for (keys, start, end, by), summed up over all n rows that are
    equal in `by` and have so many bases together.

    changes: (keys, pos, d), where the depth changes by d. Up to a place x the sum is that of d (x + 1 - p) over changes at p up to x:
    two running sums, so that a row costs two places, however many changes it meets. As in `_runs`, what lies before a bin goes into it
    as one more row at its head. Rows with a null among their keys meet nothing, and their sum is 0.
    """
    zero, nothing = F.lit(0).cast("long"), F.lit(None).cast("long")
    binned = lambda df: df.withColumn("_step", F.floor(F.col("pos") / step))
    ends = F.inline(F.array(F.struct((F.col("start") - 1).alias("pos"), F.lit(-1).cast("long").alias("sign")), F.struct(F.col("end").alias("pos"), F.lit(1).cast("long").alias("sign"))))
    asked = binned(asked.select(*dict.fromkeys([*keys, *by]), ends).withColumns({"pos": F.col("pos").cast("long"), "d": zero, "p": zero}))
    known = changes.dropna(subset=[*keys, "pos"])
    places = binned(known.select(*keys, F.col("pos").cast("long").alias("pos"), "d", (F.col("d") * F.col("pos")).alias("p")))
    order = Window.partitionBy(*keys).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    sums = [places.select(*keys, "_step", "d", "p"), asked.select(*keys, "_step", "d", "p")]
    per = sums[0].unionByName(sums[1]).groupBy(*keys, "_step").agg(F.sum("d").alias("_d"), F.sum("p").alias("_p"))
    before = {c: F.coalesce(F.sum(f"_{c}").over(order), zero).alias(c) for c in "dp"}
    heads = per.select(*keys, "_step", nothing.alias("pos"), *before.values())
    rows = asked.unionByName(places.unionByName(heads), allowMissingColumns=True)
    # The bin first: rows that compare unequal by a number are the cheapest to sort. A change at a place counts there.
    inner = Window.partitionBy("_step", *keys).orderBy(F.col("pos").asc_nulls_first(), F.col("sign").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    upto = (F.col("pos") + 1) * F.sum("d").over(inner) - F.sum("p").over(inner)
    found = rows.select(*by, "sign", "pos", upto.alias("_upto")).where("sign is not null")
    signed = lambda c: F.sum(F.col("sign") * F.col(c))
    return found.groupBy(*by).agg(F.count_if(F.col("sign") == 1).alias("n"), signed("pos").alias("bases"), signed("_upto").alias("sum"))


def gaps_within(df: DataFrame, group: Sequence[str], keep: Sequence[str] = ("chrom", "strand")) -> DataFrame:
    """The stretches between the merged intervals of each group (introns between the exons of a transcript)."""
    by = list(dict.fromkeys([*group, *keep]))
    merged = _islands(df.select(*by, "start", "end").distinct(), by, 1)
    before = F.lag("end").over(Window.partitionBy(*by).orderBy("start"))
    return merged.select(*by, (before + 1).alias("_s"), (F.col("start") - 1).alias("_e")).where("_s <= _e").select(*by, F.col("_s").alias("start"), F.col("_e").alias("end"))


def span(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Least start and greatest end of each group."""
    return df.groupBy(*group).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def flank(df: DataFrame, n: int, at_start: bool = True) -> DataFrame:
    """The n bases upstream (at_start) or downstream, by strand; '*' counts as '+'."""
    left = (F.col("strand") != "-") if at_start else (F.col("strand") == "-")
    return df.withColumns({"start": F.when(left, F.col("start") - n).otherwise(F.col("end") + 1), "end": F.when(left, F.col("start") - 1).otherwise(F.col("end") + n)})


def resize(df: DataFrame, by: int) -> DataFrame:
    """Both ends moved outwards by a number of bases (inwards if negative); what vanishes is dropped."""
    return df.withColumns({"start": F.col("start") - by, "end": F.col("end") + by}).where("start <= end")


def row_difference(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """a without b as a struct, row by row, where b covers one end of a or none; null if nothing or two parts are left."""
    left = F.struct(start_a.alias("start"), F.least(end_a, start_b - 1).alias("end"))
    right = F.struct(F.greatest(start_a, end_b + 1).alias("start"), end_a.alias("end"))
    apart = (end_a < start_b) | (end_b < start_a)
    return (
        F.when(apart, F.struct(start_a.alias("start"), end_a.alias("end")))
        .when((start_b <= start_a) & (end_b >= end_a), F.lit(None))
        .when(start_b <= start_a, right)
        .when(end_b >= end_a, left)
    )


def depth_histogram(runs: DataFrame, blocks: DataFrame, key: str, run_keys: Sequence[str] = ("chrom",), base: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(key, by, depth, bases): how many bases of each key's blocks lie at each depth, uncovered ones at depth 0.

    by: columns of the runs (a sample, say) that have a histogram each; keys that no run of theirs meets have none then.

    Both are cut at bins of `base` positions, about twice the mean length of a block if None, and parts meet in their bin. Runs of one
    kind do not overlap, so cutting adds one part a bin at most; of blocks, about as many as there are.
    """
    if base is None:
        mean = blocks.agg(F.avg(width())).first()[0] or 1
        base = 1 << max(8, min(17, int(2 * mean).bit_length()))

    def cut(df: DataFrame, suffix: str, *columns: str) -> DataFrame:
        bins = F.sequence(F.floor(F.col("start") / base), F.floor(F.col("end") / base))
        parts = df.where("start <= end").select(*run_keys, *columns, "start", "end", F.explode(bins).alias("_bin"))
        parts = parts.withColumns({"start": F.greatest("start", F.col("_bin") * base), "end": F.least("end", (F.col("_bin") + 1) * base - 1)})
        return parts.select(*[F.col(c).alias(c if c in (*run_keys, "_bin") else c + suffix) for c in parts.columns])

    met = cut(blocks, "", key).join(cut(runs, "_run", "depth", *by), [*run_keys, "_bin"]).where("start <= end_run and start_run <= end")
    bases = F.least("end", "end_run") - F.greatest("start", "start_run") + 1
    none = F.lit(0).cast("long")
    if not by:
        # What a run covers is not uncovered: one aggregate of all of a key's bases, less those.
        moved = F.inline(F.array(F.struct(F.col("depth_run").alias("depth"), bases.alias("bases")), F.struct(none.alias("depth"), (-bases).alias("bases"))))
        rows = met.select(key, moved).unionByName(blocks.select(key, none.alias("depth"), width().alias("bases")))
        return rows.groupBy(key, "depth").agg(F.sum("bases").alias("bases")).where("bases > 0")
    # Read twice below; the runs and the join are worked out once.
    covered = settle(met.groupBy(key, *[F.col(f"{c}_run").alias(c) for c in by], F.col("depth_run").alias("depth")).agg(F.sum(bases).alias("bases")))
    whole = blocks.groupBy(key).agg(F.sum(width()).alias("_whole"))
    seen = covered.groupBy(key, *by).agg(F.sum("bases").alias("_seen"))
    rest = whole.join(seen, key).select(key, *by, none.alias("depth"), (F.col("_whole") - F.col("_seen")).alias("bases")).where("bases > 0")
    return covered.unionByName(rest)


def histogram_stats(hist: DataFrame, key: str | Sequence[str], trim: int = 30, sums: Sequence[str] = ()) -> DataFrame:
    """Per key: mean, mean of the central part (trim percent cut from either end), covered fraction, quartiles; and sums of columns.

    The trimmed mean cuts floor(size x trim / 100) bases at both ends of the sorted depths. Quartiles interpolate at
    (n + 1) p / 100 among the sorted bases.
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy("depth")
    cum = hist.groupBy(*keys, "depth").agg(*[F.sum(c).alias(c) for c in ("bases", *sums)])
    cum = cum.withColumns({"cum": F.sum("bases").over(w.rowsBetween(Window.unboundedPreceding, 0)), "size": F.sum("bases").over(Window.partitionBy(*keys)), "next": F.lead("depth").over(w)})
    prev = F.col("cum") - F.col("bases")
    skip = F.floor(F.col("size") * trim / 100)
    inside = F.greatest(F.lit(0), F.least(F.col("cum"), F.col("size") - skip) - F.greatest(prev, skip))
    out = [
        F.sum(F.col("depth") * F.col("bases")).try_cast("double").alias("_sum"),
        F.max("size").alias("size"),
        F.sum(F.col("depth") * inside).cast("double").alias("_mid"),
        F.max(F.col("size") - 2 * skip).alias("_kept"),
        F.coalesce(F.sum(F.when(F.col("depth") == 0, F.col("bases"))), F.lit(0)).alias("_zero"),
    ]
    for p in (25, 50, 75):
        at = (F.col("size") + 1) * p / 100
        whole = F.greatest(F.lit(1), F.least(F.floor(at), F.col("size")))
        part = F.when((at < 1) | (at >= F.col("size")), F.lit(0.0)).otherwise(at - F.floor(at))
        # The base number `whole` lies in this bar; its successor in this one or the next.
        here = (whole > prev) & (whole <= F.col("cum"))
        after = F.when(whole < F.col("cum"), F.col("depth")).otherwise(F.coalesce("next", "depth"))
        out.append(F.max(F.when(here, F.col("depth") + part * (after - F.col("depth")))).cast("double").alias(f"p{p}"))
    stats = cum.groupBy(*keys).agg(*out, *[F.sum(c).alias(c) for c in sums])
    return stats.select(*keys, "size", (F.col("_sum") / F.col("size")).alias("mean"), F.try_divide("_mid", "_kept").alias("trimmed_mean"), (1 - F.col("_zero") / F.col("size")).alias("covered"), "p25", "p50", "p75", *sums)


def splice_site_points(introns: DataFrame, upstream: bool) -> DataFrame:
    """The exon base beside an intron on its upstream or downstream side, by strand."""
    left = (F.col("strand") != "-") if upstream else (F.col("strand") == "-")
    at = F.when(left, F.col("start") - 1).otherwise(F.col("end") + 1)
    return introns.withColumns({"start": at, "end": at})


def stack_levels(df: DataFrame, view: Sequence[str], item: str, stretch: int = 1 << 20) -> DataFrame:
    """The row on which each item of a view is drawn, from 1: items that overlap get different rows, first fit by start, end
    and item.

    Islands of overlapping items do not affect each other: each begins with all rows free. So the items are laid out in stretches
    of whole islands, those that begin within `stretch` positions together, and no task holds a view.
    """
    import pandas as pd

    def layout(rows: pd.DataFrame) -> pd.DataFrame:
        ends: list[int] = []
        levels = []
        for r in rows.sort_values(["start", "end", item]).itertuples():
            level = next((i for i, e in enumerate(ends) if e < r.start), len(ends))
            if level == len(ends):
                ends.append(0)
            ends[level] = r.end
            levels.append((r.Index, level + 1))
        out = rows.drop(columns="_stretch")
        out["level"] = pd.Series(dict(levels))
        return out

    spans = settle(df.groupBy(*view, item).agg(F.min("start").alias("start"), F.max("end").alias("end")).withColumn("strand", F.lit("*")))
    islands = settle(reduce(spans, list(view), 0).withColumn("strand", F.lit("*")))
    met = overlap_join(spans, islands, kind="within", keys=view, suffixes=("", "_island"))
    rows = met.select(*view, item, "start", "end", F.floor(F.col("start_island") / stretch).alias("_stretch"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spans.schema if f.name != "strand")
    return rows.groupBy(*view, "_stretch").applyInPandas(layout, f"{kinds}, level long")
