"""Queries of sample statistics, novel junctions, datasets, results, gene sets and tracks of a view, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.functions import coords
from isoframe.operators import coverage_views as cv
from isoframe.operators import dataset as ds
from isoframe.operators import differential as de
from isoframe.operators import enrichment as en
from isoframe.operators import quant as qt
from isoframe.operators import reads as rd
from isoframe.plans.analysis_queries import _contrast
from isoframe.plans.cube_queries import _ANNOTATED, _CELLS, _LOGIT, _annotated, _samples, cells
from isoframe.plans.domain import rounded, view, with_views
from isoframe.sources.store import settle

QUERIES, ORACLES = {}, {}


def query(sql: str, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = with_views(sql, *views)
        return f

    return add


def _name(prefix: str, number: str):
    return F.concat(F.lit(prefix), F.expr(number).cast("string"))


# --- samples: customers are libraries ------------------------------------------------------------------------------------


@query("""SELECT sample, coalesce((singles = 0 AND pairs > 0) OR (singles > 0 AND pairs / nullif(singles, 0) > 10), FALSE) AS paired, singles + pairs AS depth,
  round(nucleotides / nullif(singles + pairs, 0), 6) AS mean_frag_size, CASE WHEN nucleotides % 2 = 0 THEN direction ELSE 0 END AS strand FROM library""", "library")
def sample_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Directions are known for some samples only."""
    rows = view(spark, sf, "library")
    return rounded(qt.sample_stats(rows, rows.where("nucleotides % 2 = 0")), "mean_frag_size")


_PARTS = {"intergenic": "singles % 7", "rrna": "pairs % 5", "nonpolya": "pairs % 3", "mitochondrial": "singles % 4", "annotated": "nucleotides % 100", "unannotated": "nucleotides % 7", "nmd": "nucleotides % 11", "spans": "nucleotides % 13", "clean": "pairs % 17", "known_exon": "singles % 3", "anti_sense": "pairs % 2"}
_FRACTIONS = {"unanno_jn_fraction": ("unannotated", "annotated + unannotated"), "nmd_jn_fraction": ("nmd", "annotated"), "splice_fraction": ("annotated", "depth"), "span_fraction": ("spans", "depth")}
_FRACTIONS |= {f"{c}_fraction": (c, "depth") for c in ("intergenic", "rrna", "nonpolya", "mitochondrial")} | {f"ir_burden_{c}": (c, f"{c} + annotated") for c in ("clean", "known_exon", "anti_sense")}


@query("WITH p AS (SELECT sample, singles + pairs AS depth, " + ", ".join(f"{e} AS {c}" for c, e in _PARTS.items()) + " FROM library) SELECT sample, " + ", ".join(f"round({a} / nullif({b}, 0), 6) AS {c}" for c, (a, b) in _FRACTIONS.items()) + " FROM p", "library")
def sample_quality(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "library")
    parts = rows.select("sample", *[F.expr(e).alias(c) for c, e in _PARTS.items()])
    return rounded(qt.sample_qc(rows.select("sample", (F.col("singles") + F.col("pairs")).alias("depth")), parts).select("sample", *_FRACTIONS), *_FRACTIONS)


_EVIDENCE = "SELECT sample, strand, k % 40 + q AS total, CASE WHEN part % 3 = 0 THEN 1 WHEN part % 3 = 1 THEN k % 40 + q - 1 ELSE (k % 40 + q) // 2 END AS pos FROM lines WHERE supp % 2 = 0 OR (strand = '+') = (part % 3 = 1)"


@query(f"""WITH j AS ({_EVIDENCE}), d AS (SELECT *, total - pos AS neg FROM j), e AS (SELECT *, neg > 4 * pos AS n, pos > 4 * neg AS p FROM d WHERE total > 8),
  c AS (SELECT sample, count_if(n OR p) AS dir, count_if(NOT (n OR p)) AS nondir, count_if((n AND strand = '-') OR (p AND strand = '+')) AS same, count_if((n AND strand = '+') OR (p AND strand = '-')) AS diff, count_if(NOT (n OR p) AND strand IN ('+', '-')) AS nonknown FROM e GROUP BY sample),
  s AS (SELECT *, CAST(floor(dir * 10000 / (dir + nondir + 1)) AS BIGINT) AS score_all, CAST(floor((same + diff) * 10000 / (same + diff + nonknown + 1)) AS BIGINT) AS score_known FROM c)
  SELECT sample, score_all, score_known, CASE WHEN score_known >= 9000 AND same > 100 * diff THEN 1 WHEN score_known >= 9000 AND diff > 100 * same THEN -1 ELSE 0 END AS direction FROM s""", "lines")
def library_strands(spark: SparkSession, sf: str) -> DataFrame:
    total = F.expr("k % 40 + q")
    pos = F.when(F.expr("part % 3 = 0"), 1).when(F.expr("part % 3 = 1"), total - 1).otherwise(F.floor(total / 2)).cast("long")
    rows = view(spark, sf, "lines").where("supp % 2 = 0 or (strand = '+') = (part % 3 = 1)").select("sample", "strand", total.alias("total"), pos.alias("pos"))
    return rd.directionality(rows.withColumn("neg", F.col("total") - F.col("pos"))).select("sample", "score_all", "score_known", "direction")


@query("""SELECT sample, CAST(sum(CASE WHEN part % 5 = 0 THEN q ELSE 0 END) AS BIGINT) AS intergenic, CAST(sum(CASE WHEN part % 5 = 1 THEN q ELSE 0 END) AS BIGINT) AS rrna, CAST(sum(CASE WHEN part % 5 = 2 THEN q ELSE 0 END) AS BIGINT) AS nonpolya,
  CAST(sum(CASE WHEN supp % 4 < 2 THEN q ELSE 0 END) AS BIGINT) AS mitochondrial, CAST(sum(CASE WHEN supp % 4 = 2 THEN q ELSE 0 END) AS BIGINT) AS ercc FROM lines GROUP BY sample""", "lines")
def reads_by_class(spark: SparkSession, sf: str) -> DataFrame:
    """Reads of each sample in regions and contigs that quality figures name."""
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), F.expr(f"int({by} % {len(names)} + 1)"))
    rows = view(spark, sf, "lines").withColumn("total", F.col("q"))
    regions = rd.region_classes(rows.withColumn("name", pick(("Intergenic/1/+", "rRNA/2", "NonPolyA/3", "gene/4", "other rRNA"), "part")))
    return regions.join(rd.contig_classes(rows.withColumn("chrom", pick(("MT", "chrM", "ERCC-00002", "1M"), "supp"))), "sample")


# --- junctions -----------------------------------------------------------------------------------------------------------

_MOTIF = "CASE part % 6 WHEN 0 THEN 'GTAG' WHEN 1 THEN 'CTAC' WHEN 2 THEN 'GCAG' WHEN 3 THEN 'CTGC' WHEN 4 THEN 'AAAA' ELSE 'GTAT' END"


@query(f"""WITH c AS (SELECT DISTINCT chrom, start, "end", {_MOTIF} AS motif FROM lines), l AS (SELECT chrom, max(k) * 36 AS length FROM lines GROUP BY chrom),
  a AS (SELECT chrom, start, "end", min(strand) AS known FROM lines WHERE supp % 5 = 0 GROUP BY ALL),
  s AS (SELECT c.*, known IS NOT NULL AS annotated, coalesce(known, CASE WHEN motif IN ('GTAG', 'GCAG') THEN '+' WHEN motif <> 'AAAA' THEN '-' END) AS strand FROM c JOIN l USING (chrom) LEFT JOIN a USING (chrom, start, "end") WHERE c."end" <= length)
  SELECT chrom, start, "end", strand, annotated, CASE WHEN strand = '-' THEN reverse(translate(motif, 'ACGT', 'TGCA')) ELSE motif END AS motif FROM s WHERE strand IS NOT NULL""", "lines")
def strands_of_junctions(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "lines")
    contigs = rows.groupBy("chrom").agg((F.max("k") * 36).alias("length"))
    found = rows.select("chrom", "start", "end", F.expr(_MOTIF).alias("motif")).distinct().withColumn("strand", F.lit("."))
    return qt.annotate_strand(found, rows.where("supp % 5 = 0"), contigs)


@query("""WITH l AS MATERIALIZED (SELECT * FROM lines), j AS MATERIALIZED (SELECT DISTINCT chrom || ':' || CAST(start AS VARCHAR) || '-' || CAST("end" AS VARCHAR) AS place, strand FROM l WHERE supp % 4 <> 1),
  t AS MATERIALIZED (SELECT DISTINCT a.chrom, a.start AS start1, a."end" AS end1, b.start AS start2, b."end" AS end2 FROM l a JOIN l b ON CAST(a.k AS VARCHAR) || '/' || CAST(a.n + 1 AS VARCHAR) = CAST(b.k AS VARCHAR) || '/' || CAST(b.n AS VARCHAR)),
  x AS MATERIALIZED (SELECT t.*, j.strand AS s1 FROM t JOIN j ON j.place = chrom || ':' || CAST(start1 AS VARCHAR) || '-' || CAST(end1 AS VARCHAR)),
  y AS MATERIALIZED (SELECT x.*, j.strand AS s2 FROM x JOIN j ON j.place = chrom || ':' || CAST(start2 AS VARCHAR) || '-' || CAST(end2 AS VARCHAR))
  SELECT chrom, start1, end1, start2, end2, CASE WHEN s1 <> '*' THEN s1 ELSE s2 END AS strand FROM y WHERE s1 = s2 OR s1 = '*' OR s2 = '*'""", "lines")
def strands_of_tandem_junctions(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring lines of an order as tandem junctions."""
    rows = view(spark, sf, "lines")
    second = rows.select("k", (F.col("n") - 1).alias("n"), F.col("start").alias("start2"), F.col("end").alias("end2"))
    tandem = rows.join(second, ["k", "n"]).select("chrom", F.col("start").alias("start1"), F.col("end").alias("end1"), "start2", "end2", F.lit(".").alias("strand")).distinct()
    return qt.annotate_tandem(tandem, rows.where("supp % 4 <> 1").select("chrom", "start", "end", "strand").distinct())


_SITES = """SELECT chrom, CAST(floor(k / 12) AS BIGINT) * 40 AS start, CAST(floor(k / 12) AS BIGINT) * 40 + 100 + part % 9 * 10 AS "end", CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END AS strand, max(CASE WHEN part % 4 = 0 THEN 1 ELSE 0 END) = 1 AS annotated,
  count(DISTINCT sample) AS samples, CAST(sum(CASE WHEN q >= 49 THEN 1 ELSE 0 END) AS BIGINT) AS samples_over FROM lines WHERE part % 13 < 9 GROUP BY 1, 2, 3, 4"""


@query(f"""WITH s AS ({_SITES}) SELECT * FROM s WHERE NOT annotated AND (samples >= 2 OR samples_over >= 1)
  AND (EXISTS (SELECT 1 FROM s a WHERE a.annotated AND a.chrom = s.chrom AND a.strand = s.strand AND a.start = s.start) OR EXISTS (SELECT 1 FROM s a WHERE a.annotated AND a.chrom = s.chrom AND a.strand = s.strand AND a."end" = s."end"))""", "lines")
def novel_junctions_of_known_sites(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "lines").where("part % 13 < 9")
    s = rows.groupBy("chrom", F.expr("k div 12 * 40").alias("start"), F.expr("k div 12 * 40 + 100 + part % 9 * 10").alias("end"), F.when(F.expr("k % 2 = 0"), "+").otherwise("-").alias("strand"))
    s = settle(s.agg((F.max(F.expr("part % 4 = 0"))).alias("annotated"), F.count_distinct("sample").alias("samples"), F.count_if(F.expr("q >= 49")).alias("samples_over")))
    # Junctions of both strands at one place have one prevalence, so places are told apart by strand.
    at = [F.concat("chrom", "strand").alias("chrom"), "start", "end"]
    found = qt.novel_junctions(s.select(*at, "strand", "annotated"), s.select(*at, "samples", "samples_over"), 2, one_site_known=True)
    return found.withColumn("chrom", F.expr("substring(chrom, 1, length(chrom) - 1)"))


@query("""SELECT k, n, sample, part, CAST(CASE WHEN d = 0 OR strand = '*' THEN q + supp WHEN (d = 1) = (strand = '+') THEN q ELSE supp END AS DOUBLE) AS count FROM (SELECT *, CAST(substr(sample, 1, 1) AS INTEGER) % 3 - 1 AS d FROM lines)""", "lines")
def junction_counts_by_strand(spark: SparkSession, sf: str) -> DataFrame:
    """Reads of the right strand by each sample's strandedness."""
    rows = view(spark, sf, "lines")
    counts = rows.withColumns({"pos": F.col("q"), "neg": F.col("supp"), "total": F.col("q") + F.col("supp")})
    stats = rows.select("sample").distinct().withColumn("strand", F.expr("int(substr(sample, 1, 1)) % 3 - 1"))
    return qt.count_by_strand(counts, stats).select("k", "n", "sample", "part", "count")


@query("""WITH r AS (SELECT k, n, part, greatest(q, n * 9) AS splice_max, greatest(q + supp % 7, n * 9 + part % 11) AS splice_over, part % 5 * 0.5::DOUBLE AS depth, discount * 0.1::DOUBLE AS coverage FROM lines),
  v AS (SELECT *, CASE WHEN depth >= 1 THEN depth WHEN depth > 0 THEN coverage END AS v FROM r)
  SELECT k, n, part, CAST(splice_max AS BIGINT) AS splice_max, CAST(splice_over AS BIGINT) AS splice_over, round(coalesce(v / nullif(v + splice_over, 0), 0), 6) AS overlap_ratio, depth + splice_over AS total_depth FROM v""", "lines")
def intron_measures(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "lines").selectExpr("k", "n", "part", "q AS splice_left", "n * 9 AS splice_right", "q + supp % 7 AS over_left", "n * 9 + part % 11 AS over_right", "part % 5 * 0.5D AS depth", "discount * 0.1D AS coverage")
    return rounded(qt.intron_metrics(rows).select("k", "n", "part", "splice_max", "splice_over", "overlap_ratio", "total_depth"), "overlap_ratio")


@query("""WITH r AS (SELECT *, max("end") OVER (PARTITION BY chrom, strand ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM lines),
  g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, strand ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS i FROM r)
  SELECT chrom, strand, min(start) AS start, max("end") AS "end", chrom || '/' || strand || '/' || CAST(i AS VARCHAR) AS island FROM g GROUP BY chrom, strand, i""", "lines")
def numbered_islands(spark: SparkSession, sf: str) -> DataFrame:
    return qt.islands(view(spark, sf, "lines").select("chrom", "start", "end", "strand"), "island").select("chrom", "strand", "start", "end", "island")


# --- the dataset ---------------------------------------------------------------------------------------------------------


def _dataset(spark: SparkSession, sf: str) -> ds.SpliceDataset:
    c = settle(cells(spark, sf))
    return ds.SpliceDataset(c.select("event_name", "event_type").distinct(), _samples(c), c.drop("event_type"))


@query(_CELLS + "SELECT event_name, event_type, sample, included, depth FROM cells WHERE event_type IN ('SE', 'RI') AND sample < '3'", "assay")
def dataset_subset(spark: SparkSession, sf: str) -> DataFrame:
    kept = _dataset(spark, sf).subset(events=F.col("event_type").isin("SE", "RI"), samples=F.col("condition") == "A")
    return kept.cells().select("event_name", "event_type", "sample", "included", "depth")


@query(_CELLS + "SELECT event_name, sample, included, excluded FROM cells WHERE event_type IN ('SE', 'MXE')", "assay")
def datasets_bound(spark: SparkSession, sf: str) -> DataFrame:
    """A dataset taken apart by type and condition and put together again."""
    whole = _dataset(spark, sf)
    part = lambda kind, condition: whole.subset(F.col("event_type") == kind, F.col("condition") == condition)
    a, b = (part(kind, "A").bind_samples(part(kind, "B")) for kind in ("SE", "MXE"))
    both = a.bind_events(b)
    both.validate()
    return both.cells().select("event_name", "sample", "included", "excluded")


@query("""WITH j AS (SELECT k, chrom, start, "end", avg(q) AS mean FROM lines GROUP BY ALL)
  SELECT chrom || ':' || CAST(start AS VARCHAR) || '-' || CAST("end" AS VARCHAR) || '/+' AS event_name, CASE WHEN k % 4 = 3 THEN 'SE' ELSE 'IR' END AS event_type FROM j
  WHERE k % 4 = 3 OR NOT EXISTS (SELECT 1 FROM j b WHERE b.k = j.k AND b.start <= j."end" AND j.start <= b."end" AND (b.mean > j.mean OR (b.mean = j.mean AND (b.start < j.start OR (b.start = j.start AND b."end" < j."end")))))""", "lines")
def most_used_introns(spark: SparkSession, sf: str) -> DataFrame:
    """Retention events of introns that are the most used junction where they lie; lines of different orders do not overlap."""
    rows = view(spark, sf, "lines").withColumn("strand", F.lit("+")).withColumn("event", coords.format_interval())
    counts = rows.select("event", "sample", F.col("q").alias("count"))
    # Names are written where they are read: what is told apart and settled are places.
    places = settle(rows.select("chrom", "start", "end", F.expr("k % 4 = 3").alias("se")).distinct()).withColumn("strand", F.lit("+")).withColumn("event", coords.format_interval())
    junctions = places.select("chrom", "start", "end", "strand", "event")
    events = places.select(F.col("event").alias("event_name"), F.when(F.col("se"), "SE").otherwise("IR").alias("event_type"), F.col("event").alias("event_region"), F.col("event").alias("event1a"))
    data = ds.SpliceDataset(events, rows.select("sample").distinct(), events.select("event_name"), junctions, counts)
    return ds.drop_overlapping_introns(data).events.select("event_name", "event_type")


_WIDE = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}


@query(_CELLS + "SELECT event_name, " + ", ".join(f"max(CASE WHEN sample = '{s}' THEN round(CASE WHEN depth >= 10 THEN included / depth END, 6) END) AS {c}" for s, c in _WIDE.items()) + " FROM cells GROUP BY event_name HAVING count_if(depth >= 10) > 0.9 * count(*)", "assay")
def psi_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each event, a column for each sample."""
    m = ds.make_matrix(cells(spark, sf), list(_WIDE))
    return rounded(m.select("event_name", *[F.col(f"`{s}`").alias(c) for s, c in _WIDE.items()]), *_WIDE.values())


# --- results of tests ----------------------------------------------------------------------------------------------------


@query(_ANNOTATED + """SELECT event_name, concat_ws(';', CASE WHEN n % 4 <> 0 AND n % 3 = 1 THEN 'Inc-NMD' END, CASE WHEN n % 7 <> 0 AND n % 2 = 1 THEN 'Exc-NMD' END, CASE WHEN n % 6 = 5 THEN 'Inc-novel' END, CASE WHEN n % 4 = 3 THEN 'Exc-novel' END) AS flags FROM a""", "assay")
def flags_of_results(spark: SparkSession, sf: str) -> DataFrame:
    a = _annotated(spark, sf).replace("5", "Novel", "inc_tsl").replace("4", "Novel", "exc_tsl")
    return de.add_flags(a.select("event_name"), a)


@query(_CELLS + f""", p AS (SELECT event_name, CASE WHEN sample < '3' THEN 'A' ELSE 'B' END AS level, included / nullif(included + excluded, 0) AS psi FROM cells),
  m AS (SELECT event_name, level, round(1 / (1 + exp(-avg(CASE WHEN psi IS NOT NULL THEN {_LOGIT.format(m='10.0')} END))), 4) AS mean FROM p GROUP BY 1, 2),
  w AS (SELECT event_name, max(CASE WHEN level = 'A' THEN mean END) AS a, max(CASE WHEN level = 'B' THEN mean END) AS b FROM m GROUP BY 1)
  SELECT event_name, a AS avg_psi_A, b AS avg_psi_B, round(a - b, 4) AS delta_psi, abs(round(a - b, 4)) AS abs_delta_psi FROM w""", "assay")
def mean_psi_of_results(spark: SparkSession, sf: str) -> DataFrame:
    c = settle(cells(spark, sf))
    return de.add_psi(c.select("event_name").distinct(), c, _samples(c), "condition", "A", "B")


_RESULTS = "r AS (SELECT n, event_name, event_type, (n * 7919 % 10007) / 10007.0::DOUBLE AS p_value FROM a)"


@query(_ANNOTATED + f", {_RESULTS} SELECT event_name, event_type, round(p_value, 9) AS p_value FROM r WHERE event_type IN ('SE', 'A5SS') AND p_value <= 0.4 AND least(1.0, p_value * 2) <= 0.5", "assay")
def picked_events(spark: SparkSession, sf: str) -> DataFrame:
    a = _annotated(spark, sf)
    p = F.expr("(int(substr(event_name, 2)) * 7919L % 10007) / 10007D")
    results = a.select("event_name", p.alias("p_value"), F.least(F.lit(1.0), p * 2).alias("fdr"))
    return rounded(de.pick_events(results, a, ["SE", "A5SS"], fdr=0.5, p_value=0.4).select("event_name", "event_type", "p_value"), "p_value", places=9)


@query(_ANNOTATED + """, e AS (SELECT CASE WHEN n % 11 = 0 THEN event_name || '/anti-over' ELSE event_name END AS event_name, event_type, CASE WHEN n % 5 > 0 THEN n % 3 = 0 END AS known FROM a WHERE n % 11 <> 0)
  SELECT 'all' AS mode, event_name FROM e WHERE event_type <> 'RI' UNION ALL SELECT 'annotated', event_name FROM e WHERE event_type <> 'RI' AND (event_type <> 'IR' OR coalesce(known, FALSE)) UNION ALL SELECT 'annotated_binary', event_name FROM e WHERE event_type <> 'IR'""", "assay")
def events_to_test(spark: SparkSession, sf: str) -> DataFrame:
    """Events by mode of intron retention; those over genes of the other strand go."""
    n = F.expr("int(substr(event_name, 2))")
    a = _annotated(spark, sf).select(F.when(n % 11 == 0, F.concat("event_name", F.lit("/anti-over"))).otherwise(F.col("event_name")).alias("event_name"), "event_type", F.when(n % 5 > 0, n % 3 == 0).alias("is_annotated_ir"))
    modes = [de.select_events(a, mode).select(F.lit(mode).alias("mode"), "event_name") for mode in ("all", "annotated", "annotated_binary")]
    return modes[0].unionByName(modes[1]).unionByName(modes[2])


_FULL = ", f AS (SELECT *, CASE WHEN sample < '3' THEN 'A' ELSE 'B' END AS level, count(*) OVER (PARTITION BY event_name) AS k, sum(included + excluded) OVER (PARTITION BY sample) AS size FROM cells)"


@query(_CELLS + _FULL + """, v AS (SELECT event_name, level, log2(included + 0.5) - log2(excluded + 0.5) AS r, log2((included + 0.5) / (size + 1) * 1e6) AS i, log2((excluded + 0.5) / (size + 1) * 1e6) AS e, included, excluded FROM f WHERE k = 5),
  g AS (SELECT event_name, avg(r) FILTER (level = 'A') - avg(r) FILTER (level = 'B') AS log_fc, avg(i) FILTER (level = 'A') - avg(i) FILTER (level = 'B') AS log_fc_inc, avg(e) FILTER (level = 'A') - avg(e) FILTER (level = 'B') AS log_fc_exc, (avg(i) + avg(e)) / 2 AS ave_expr, least(avg(i), avg(e)) AS low FROM v GROUP BY 1)
  SELECT event_name, round(log_fc, 6) AS log_fc, round(log_fc_inc, 6) AS log_fc_inc, round(log_fc_exc, 6) AS log_fc_exc, round(ave_expr, 6) AS ave_expr FROM g WHERE low - (SELECT min(low) FROM g) > 1""", "assay")
def moderated_t_estimates(spark: SparkSession, sf: str) -> DataFrame:
    """What the moderated t test estimates; its p-values are held against references by tests."""
    c, samples = _contrast(spark, sf)
    columns = ("log_fc", "log_fc_inc", "log_fc_exc", "ave_expr")
    return rounded(de.limma_test(c, samples, "cond", "A", "B").select("event_name", *columns), *columns)


@query(_CELLS + _FULL + """, p AS (SELECT event_name, sum(included + 1) FILTER (level = 'A') / sum(included + excluded + 2) FILTER (level = 'A') AS a, sum(included + 1) FILTER (level = 'B') / sum(included + excluded + 2) FILTER (level = 'B') AS b FROM f WHERE k = 5 GROUP BY 1)
  SELECT event_name, round(a, 6) AS psi_nominator, round(b, 6) AS psi_denominator, round((ln(a / (1 - a)) - ln(b / (1 - b))) / ln(2), 6) AS mle_log_fc FROM p""", "assay")
def ratio_test_estimates(spark: SparkSession, sf: str) -> DataFrame:
    c, samples = _contrast(spark, sf)
    columns = ("psi_nominator", "psi_denominator", "mle_log_fc")
    return rounded(de.double_exponential_test(c, samples, "cond", "A", "B").select("event_name", *columns), *columns)


# --- gene sets: customers are genes, orders events -----------------------------------------------------------------------

_GENES = "SELECT DISTINCT 'e' || CAST(k AS VARCHAR) AS event_name, CASE WHEN cust % 7 = 0 THEN 'novelGene' ELSE 'g' END || CAST(cust AS VARCHAR) AS gene_id, CASE WHEN k % 3 = 0 THEN 'g' || CAST(cust + 1 AS VARCHAR) END AS gene_id_b FROM lines"


def _gene_events(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "lines").select(_name("e", "k").alias("event_name"), F.concat(F.when(F.expr("cust % 7 = 0"), "novelGene").otherwise("g"), F.col("cust").cast("string")).alias("gene_id"), F.when(F.expr("k % 3 = 0"), _name("g", "cust + 1")).alias("gene_id_b")).distinct()


@query(f"WITH e AS ({_GENES}) SELECT DISTINCT gene_id FROM (SELECT gene_id FROM e UNION ALL SELECT gene_id_b FROM e) WHERE gene_id IS NOT NULL AND gene_id NOT LIKE 'novelGene%'", "lines")
def genes_with_events(spark: SparkSession, sf: str) -> DataFrame:
    return en.genes_of_events(_gene_events(spark, sf))


@query(f"WITH e AS ({_GENES}), t AS (SELECT DISTINCT 'g' || CAST(cust AS VARCHAR) AS gene_id FROM lines WHERE part % 17 = 3) SELECT event_name, gene_id, gene_id_b FROM e WHERE gene_id IN (SELECT gene_id FROM t) OR gene_id_b IN (SELECT gene_id FROM t)", "lines")
def events_of_gene_set(spark: SparkSession, sf: str) -> DataFrame:
    links = view(spark, sf, "lines").select(_name("g", "cust").alias("gene_id"), _name("t", "part % 17").alias("go_id"))
    return en.events_of_term(_gene_events(spark, sf), links, "t3")


@query("""SELECT DISTINCT 'g' || CAST(cust AS VARCHAR) AS gene_id, 't' || CAST(part % 9 AS VARCHAR) AS go_id, 'term ' || CAST(part % 9 AS VARCHAR) AS go_term, CASE WHEN part % 9 < 3 THEN 'BP' ELSE 'MF' END AS ontology FROM lines WHERE cust % 6 > 0 AND part % 9 < 8 AND part % 9 <> 4""", "lines")
def terms_of_genes(spark: SparkSession, sf: str) -> DataFrame:
    """Links that are repeated, without gene, of unknown terms or of terms without a name."""
    links = view(spark, sf, "lines").select(F.when(F.expr("cust % 6 > 0"), _name("g", "cust")).alias("gene_id"), _name("t", "part % 9").alias("go_id"))
    terms = spark.range(8).select(_name("t", "id").alias("go_id"), F.when(F.col("id") != 4, _name("term ", "id")).alias("go_term"), F.when(F.col("id") < 3, "BP").otherwise("MF").alias("ontology"))
    return en.normalise_terms(links, terms)


@query("""SELECT DISTINCT k, CASE k % 4 WHEN 0 THEN 'ENSG' || CAST(k AS VARCHAR) WHEN 1 THEN 'ENSG' || CAST(k AS VARCHAR) || '.1.2' WHEN 2 THEN 'x' || CAST(k AS VARCHAR) || '.3' ELSE 'ENSG' || CAST(k AS VARCHAR) END AS gene_id FROM lines""", "lines")
def plain_gene_ids(spark: SparkSession, sf: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, (".7", ".1.2", ".3", ""))), F.expr("int(k % 4 + 1)"))
    rows = view(spark, sf, "lines").select("k", F.concat(F.when(F.expr("k % 4 = 2"), "x").otherwise("ENSG"), F.col("k").cast("string"), ending).alias("gene_id")).distinct()
    return rows.select("k", en.plain_gene_id().alias("gene_id"))


# --- tracks of a view: suppliers are samples in two groups of two ---------------------------------------------------------

_TRACKS = """WITH d AS (SELECT 's' || CAST(supp % 4 AS VARCHAR) AS sample, CAST(floor(k / 24) AS BIGINT) AS x, CAST(sum(q) AS BIGINT) AS depth FROM lines GROUP BY 1, 2), z AS (SELECT DISTINCT sample, CAST(substr(sample, 2) AS INTEGER) * 3 + 4 AS norm, CASE WHEN sample < 's2' THEN 'A' ELSE 'B' END AS level FROM d),
  v AS (SELECT level, sample, x, depth / norm AS value FROM d JOIN z USING (sample))"""


def _tracks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(coverage, norms, samples)"""
    d = settle(view(spark, sf, "lines").groupBy(_name("s", "supp % 4").alias("sample"), F.expr("k div 24").alias("x")).agg(F.sum("q").alias("depth")))
    one = d.select("sample").distinct()
    depths = one.select(F.lit("e1").alias("event_name"), "sample", F.expr("int(substr(sample, 2)) * 3 + 4D").alias("depth"))
    return d, cv.event_norms(depths, "e1"), one.withColumn("cond", F.when(F.col("sample") < "s2", "A").otherwise("B"))


@query(_TRACKS + """, g AS (SELECT level AS grp, x, avg(value) AS mean, stddev_samp(value) AS sd, count(*) AS n FROM v WHERE sample <> 's0' GROUP BY 1, 2)
  SELECT grp, x, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sd / sqrt(n), 6) AS sem, round(sd / sqrt(n) * 12.706204736174698, 4) AS ci, n FROM g""", "lines")
def normalised_group_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage over an event's depth, by group, with standard errors and intervals; a sample without depth is left out."""
    d, norms, samples = _tracks(spark, sf)
    stats = cv.group_stats(cv.normalise(d, norms), samples, "cond")
    return rounded(rounded(stats.withColumnRenamed("group", "grp"), "mean", "sd", "sem"), "ci", places=4)


@query(_TRACKS + """, w AS (SELECT level, x, log2(value + 1) AS y FROM v), g AS (SELECT level, x, avg(y) AS mean, stddev_samp(y) AS sd, count(*) AS n FROM w GROUP BY 1, 2),
  t AS (SELECT a.x, abs(a.mean - b.mean) / nullif(sqrt((a.sd * a.sd + b.sd * b.sd) / 2), 0) AS t FROM g a JOIN g b USING (x) WHERE a.level = 'A' AND b.level = 'B')
  SELECT x, round(coalesce(-log10(2 / (sqrt(2 + t * t) * (sqrt(2 + t * t) + t))), 0), 5) AS score FROM t""", "lines")
def base_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Student's t at each base; with two samples a side its tail has a closed form."""
    d, _, samples = _tracks(spark, sf)
    norm = F.expr("int(substr(sample, 2)) * 3 + 4D")
    stats = cv.group_stats(d.withColumn("value", F.log2(F.col("depth") / norm + 1)), samples, "cond")
    return rounded(cv.difference(stats, "A", "B", 2, 2), "score", places=5)


@query("""WITH j AS (SELECT 's' || CAST(supp % 4 AS VARCHAR) AS sample, chrom, CAST(floor(k / 24) AS BIGINT) * 100 AS start, CAST(floor(k / 24) AS BIGINT) * 100 + n * 10 AS "end", CAST(sum(q) AS DOUBLE) AS count, sum(discount) / 1000 AS psi FROM lines GROUP BY 1, 2, 3, 4),
  g AS (SELECT CASE WHEN sample < 's2' THEN 'A' ELSE 'B' END AS grp, chrom, start, "end", avg(count / (CAST(substr(sample, 2) AS INTEGER) * 3 + 4)) AS mean_count, stddev_samp(count / (CAST(substr(sample, 2) AS INTEGER) * 3 + 4)) AS sd_count, avg(psi) AS mean_psi FROM j WHERE sample <> 's0' GROUP BY 1, 2, 3, 4),
  h AS (SELECT *, mean_count / max(mean_count) OVER (PARTITION BY grp) AS height FROM g)
  SELECT grp, chrom, start, "end", round(mean_count, 6) AS mean_count, round(sd_count, 6) AS sd_count, round(mean_psi, 6) AS mean_psi, round(height, 6) AS height FROM h WHERE height >= 0.123456""", "lines")
def junction_tracks_of_groups(spark: SparkSession, sf: str) -> DataFrame:
    _, norms, samples = _tracks(spark, sf)
    rows = view(spark, sf, "lines").groupBy(_name("s", "supp % 4").alias("sample"), "chrom", F.expr("k div 24 * 100").alias("start"), F.expr("k div 24 * 100 + n * 10").alias("end"), F.lit("+").alias("strand")).agg(F.sum("q").cast("double").alias("count"), (F.sum("discount") / 1000).alias("psi"))
    out = cv.junction_tracks(rows, norms, samples, "cond", least=0.123456).withColumnRenamed("group", "grp")
    return rounded(out.select("grp", "chrom", "start", "end", "mean_count", "sd_count", "mean_psi", "height"), "mean_count", "sd_count", "mean_psi", "height")


@query("""WITH i AS (SELECT cust, min(CASE WHEN part % 100 = 3 THEN 'a' ELSE 'b' END) AS highlight FROM lines WHERE part % 100 IN (3, 7) GROUP BY cust)
  SELECT transcript AS transcript_id, start, "end", highlight FROM exons LEFT JOIN i ON cust = transcript""", "exons", "lines")
def isoform_highlights(spark: SparkSession, sf: str) -> DataFrame:
    """Exons of transcripts with either side's first junction."""
    introns = view(spark, sf, "lines").select(F.col("cust").alias("transcript_id"), _name("j", "part % 100").alias("event"))
    event = spark.range(1).select(F.lit("j3").alias("event1a"), F.lit("j7").alias("event1b"))
    exons = view(spark, sf, "exons").select(F.col("transcript").alias("transcript_id"), "start", "end")
    return cv.highlight(exons, introns, event)


@query("""WITH r AS (SELECT DISTINCT 'e' || CAST(k AS VARCHAR) AS event_name, chrom, k * 40 AS start, k * 40 + 500 AS "end", CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END AS strand FROM lines) SELECT * FROM r""", "lines")
def ranges_of_events(spark: SparkSession, sf: str) -> DataFrame:
    """Places of events from their region strings."""
    k = F.col("k")
    region = coords.format_interval("chrom", k * 40, k * 40 + 500, F.when(k % 2 == 0, "+").otherwise("-"))
    events = view(spark, sf, "lines").select(_name("e", "k").alias("event_name"), region.alias("event_region")).distinct()
    data = ds.SpliceDataset(events, events.select(F.lit("s").alias("sample")), events)
    return data.row_ranges()
