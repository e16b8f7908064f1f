"""Queries of the smaller steps between files, annotation, counts and results, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.functions import coords
from isoframe.operators import annotation as an
from isoframe.operators import coverage_views as cv
from isoframe.operators import dataset as ds
from isoframe.operators import differential as de
from isoframe.operators import enrichment as en
from isoframe.operators import intervals as iv
from isoframe.operators import reads as rd
from isoframe.operators import sequence as sq
from isoframe.plans.domain import rounded, table, view, with_views
from isoframe.plans.interval_queries import _GAPS
from isoframe.sources import text
from isoframe.sources.store import settle

QUERIES, ORACLES = {}, {}


def query(sql: str, *views: str):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


@query("""SELECT gene, chrom, start, "end", translate(strand, '+-', '-+') AS strand FROM genes""", "genes")
def flipped_strands(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "genes").select("gene", "chrom", "start", "end", coords.flip().alias("strand"))


@query("""SELECT CASE WHEN chrom = 'R' THEN chrom ELSE 'chr' || chrom END AS chrom, start, count(*) AS n FROM intervals GROUP BY 1, 2""", "intervals")
def renamed_contigs(spark: SparkSession, sf: str) -> DataFrame:
    """Contigs named by an alias table that lacks one of them."""
    rows = view(spark, sf, "intervals").select("chrom", "start")
    alias = rows.where("chrom <> 'R'").select(F.col("chrom").alias("old"), F.concat(F.lit("chr"), "chrom").alias("new"))
    return text.rename_contigs(rows, alias).groupBy("chrom", "start").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH a AS (SELECT sample, k, n, 'RF!' || chrom || '!' || CAST(start + CASE WHEN part % 3 = 0 THEN 2 ELSE 1 END AS VARCHAR) AS qname, chrom, start AS pos, CASE WHEN part % 4 = 0 THEN '30M5N40M' ELSE '70M' END AS cigar FROM lines)
  SELECT k, n, pos FROM a WHERE cigar = '70M' AND qname = 'RF!' || chrom || '!' || CAST(pos + 1 AS VARCHAR)""",
    "lines",
)
def synthetic_reads_in_place(spark: SparkSession, sf: str) -> DataFrame:
    """Alignments of synthetic reads that are one match where they came from."""
    at = F.col("start") + F.when(F.expr("part % 3 = 0"), 2).otherwise(1)
    rows = view(spark, sf, "lines").select("k", "n", F.concat_ws("!", F.lit("RF"), "chrom", at.cast("string")).alias("qname"), "chrom", F.col("start").alias("pos"), F.when(F.expr("part % 4 = 0"), "30M5N40M").otherwise("70M").alias("cigar"))
    return rd.exact_synthetic(rows).select("k", "n", "pos")


@query("SELECT doc_id, w AS word, regexp_matches(w, '^[Nn]+$') AS unknown FROM (SELECT doc_id, translate(substr(text, 1, 4), 'aeioAEIO', 'nnnnNNNN') AS w FROM documents)")
def unknown_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Which sequences are unknown bases throughout."""
    rows = table(spark, sf, "documents").select("doc_id", F.translate(F.substring("text", 1, 4), "aeioAEIO", "nnnnNNNN").alias("word"))
    return rows.withColumn("unknown", sq.all_unknown("word"))


@query(
    _GAPS
    + """, j AS (SELECT chrom, start - 1 AS start, "end", strand, bool_and(transcript % 3 = 1) AS nmd FROM gaps WHERE transcript % 5 > 0 GROUP BY 1, 2, 3, 4)
  SELECT * FROM j""",
    "exons",
)
def annotated_junctions(spark: SparkSession, sf: str) -> DataFrame:
    """Junctions of introns, with whether all their transcripts decay; a transcript that is not judged does not."""
    gaps = iv.gaps_within(view(spark, sf, "exons").where("transcript % 5 > 0"), ["transcript"]).withColumnRenamed("transcript", "transcript_id")
    judged = view(spark, sf, "exons").where("transcript % 7 >= 0").select(F.col("transcript").alias("transcript_id"), F.expr("transcript % 3 = 1").alias("is_nmd")).distinct()
    return an.splice_junctions(gaps, judged.where("is_nmd or transcript_id % 2 = 0"))


@query(_GAPS + """, s AS (SELECT DISTINCT chrom, unnest([start - 1, "end"]) AS coord FROM gaps WHERE transcript % 2 = 0 OR transcript % 5 = 1) SELECT * FROM s""", "exons")
def points_of_introns(spark: SparkSession, sf: str) -> DataFrame:
    """Where reads may run from exons on into introns, of two sets of introns."""
    gaps = settle(iv.gaps_within(view(spark, sf, "exons"), ["transcript"]))
    return an.reading_points(gaps.where("transcript % 2 = 0"), gaps.where("transcript % 5 = 1"))


@query(
    _GAPS
    + """, f AS (SELECT *, transcript % 2 = 0 AS known, transcript % 3 = 0 AS over, transcript % 5 = 0 AS near FROM gaps)
  SELECT 'nd/g' || CAST(transcript AS VARCHAR) || '/i' || CAST(start AS VARCHAR) || '/' || strand || '/2/' || CAST(start - 1 AS VARCHAR) || '/' || CAST("end" AS VARCHAR) || '/' || CAST("end" - start AS VARCHAR) || '/1/' ||
    CASE WHEN NOT (known OR over OR near) THEN 'clean' ELSE array_to_string(list_filter([CASE WHEN known THEN 'known-exon' END, CASE WHEN over THEN 'anti-over' END, CASE WHEN near THEN 'anti-near' END], lambda x: x IS NOT NULL), '+') END AS undirected,
    'dir/g' || CAST(transcript AS VARCHAR) || '/i' || CAST(start AS VARCHAR) || '/' || strand || '/2/' || CAST(start - 1 AS VARCHAR) || '/' || CAST("end" AS VARCHAR) || '/' || CAST("end" - start AS VARCHAR) || '/1/' || CASE WHEN known THEN 'known-exon' ELSE 'clean' END AS directed FROM f""",
    "exons",
)
def names_of_introns(spark: SparkSession, sf: str) -> DataFrame:
    """Names of measurable introns, with and without regard to strand."""
    t = F.col("transcript")
    gaps = iv.gaps_within(view(spark, sf, "exons"), ["transcript"])
    facts = {"gene_name": F.concat(F.lit("g"), t.cast("string")), "intron_id": F.concat(F.lit("i"), F.col("start").cast("string")), "num_blocks": F.lit(2), "inclbases": F.col("end") - F.col("start"), "exclbases": F.lit(1), "known_exon": t % 2 == 0, "antiover": t % 3 == 0, "antinear": t % 5 == 0}
    return gaps.withColumns(facts).select(an.intron_name(False).alias("undirected"), an.intron_name().alias("directed"))


@query(
    """WITH o AS (SELECT g.gene, sum(CASE WHEN i.strand = translate(g.strand, '+-', '-+') THEN least(i."end", g."end") - greatest(i.start, g.start) + 1 ELSE 0 END) AS t FROM genes g JOIN intervals i ON i.chrom = g.chrom AND i.start <= g."end" AND i."end" >= g.start GROUP BY 1)
  SELECT 's' AS sample, g.gene, round(coalesce(o.t, 0) / (g."end" - g.start + 1), 6) AS mean FROM genes g LEFT JOIN o USING (gene)""",
    "genes",
    "intervals",
)
def coverage_of_the_other_strand(spark: SparkSession, sf: str) -> DataFrame:
    """Mean depth of genes in a library whose reads lie on the other strand."""
    cover = settle(iv.coverage_runs(view(spark, sf, "intervals")).withColumn("sample", F.lit("s")))
    regions = view(spark, sf, "genes").withColumn("name", F.col("gene"))
    return cv.region_means(cover, regions.select("chrom", "start", "end", "strand", "name"), "reverse", places=6).select("sample", F.col("name").alias("gene"), "mean")


@query("SELECT 'c' || CAST(c_custkey AS VARCHAR) AS event_name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE c_acctbal / 2 END AS log_fc, c_custkey / 1e6 AS p_value, CASE WHEN c_custkey % 2 = 0 THEN c_custkey / 1e5 END AS fdr FROM customer")
def results_in_one_form(spark: SparkSession, sf: str) -> DataFrame:
    """Results of two engines, of which one has its fold change under another name and one has no adjusted values."""
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(k, F.concat(F.lit("c"), k.cast("string")).alias("event_name"), (k / 1e6).alias("p_value"), (k / 1e5).alias("fdr"), F.col("c_acctbal").alias("x"))
    one = rows.where("c_custkey % 2 = 0").select("event_name", F.col("x").alias("log_fc"), "p_value", "fdr")
    other = rows.where("c_custkey % 2 = 1").select("event_name", (F.col("x") / 2).alias("mle_log_fc"), "p_value")
    return de.unify(one).unionByName(de.unify(other))


@query("""WITH p AS (SELECT p_partkey, p_name, (p_partkey * 7919 % 100003 + 1) / 100004.0::DOUBLE AS p FROM part)
  SELECT 'GO' || CAST(p_partkey AS VARCHAR) AS go_id, CASE WHEN length(p_name) > 9 THEN substr(p_name, 1, 9) || '...' ELSE p_name END AS label, round(-log10(p), 6) AS score FROM p ORDER BY p, go_id LIMIT 12""")
def displayed_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The first terms by p with short names: a top-twelve report."""
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(F.concat(F.lit("GO"), k.cast("string")).alias("go_id"), F.col("p_name").alias("go_term"), ((k * 7919 % 100003 + 1) / 100004.0).alias("p_value"))
    return rounded(en.display(rows, 12, 9).select("go_id", "label", "score"), "score")


@query("SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS sample, max(c_acctbal) AS most, CASE WHEN c_nationkey % 2 = 0 THEN min(c_custkey) END AS some FROM customer GROUP BY c_nationkey")
def samples_without_empty_columns(spark: SparkSession, sf: str) -> DataFrame:
    """A dataset's samples without the columns that are null throughout."""
    rows = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.max("c_acctbal").alias("most"), F.min("c_custkey").alias("least"))
    samples = rows.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("sample"), "most", F.when(F.col("c_nationkey") % 2 == 0, F.col("least")).alias("some"), F.lit(None).cast("string").alias("none"))
    events = samples.select(F.lit("e").alias("event_name")).distinct()
    return ds.SpliceDataset(events, samples, samples.select(F.lit("e").alias("event_name"), "sample")).clean_samples().samples


@query("""WITH a AS (SELECT l_partkey, o_orderpriority, sum(l_quantity) AS included FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
  SELECT 'e' || CAST(l_partkey AS VARCHAR) AS event_name, o_orderpriority AS sample, CASE WHEN l_partkey % 2 = 0 THEN included ELSE included * 2 END AS included FROM a""")
def settled_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """A dataset written out, validated, with one assay replaced."""
    rows = view(spark, sf, "assay").select(F.concat(F.lit("e"), F.col("event").cast("string")).alias("event_name"), "sample", (F.col("included") + F.col("excluded")).alias("included"), "event")
    data = ds.SpliceDataset(rows.select("event_name").distinct(), rows.select("sample").distinct(), rows.select("event_name", "sample", "included", "event")).realize()
    data.validate()
    doubled = data.assays.withColumn("included", F.when(F.col("event") % 2 == 0, F.col("included")).otherwise(F.col("included") * 2))
    return replace(data, assays=doubled).assays.select("event_name", "sample", "included")
