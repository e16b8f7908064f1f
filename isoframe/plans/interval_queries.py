"""Queries of the table joins, the interval algebra and the read counting, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.functions import coords
from isoframe.operators import intervals as iv
from isoframe.operators import reads as rd
from isoframe.operators import tables as tb
from isoframe.plans.domain import rounded, table, view, with_views
from isoframe.sources.store import settle

QUERIES, ORACLES = {}, {}


def query(sql: str | None, *views: str):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


_MEET = "g.chrom = i.chrom AND i.start <= g.\"end\" AND g.start <= i.\"end\""
_STRAND = "(g.strand = i.strand OR g.strand = '*')"


def _per_gene(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("gene_a").alias("gene")).agg(F.count(F.lit(1)).alias("n"), F.min("start_b").alias("first"), F.max("end_b").alias("last"), F.sum("l_partkey_b").cast("long").alias("parts"))


def _per_gene_sql(where: str) -> str:
    return f'SELECT g.gene, count(*) AS n, min(i.start) AS first, max(i."end") AS last, CAST(sum(i.l_partkey) AS BIGINT) AS parts FROM genes g JOIN intervals i ON {where} GROUP BY g.gene'


@query(_per_gene_sql(f"{_MEET} AND {_STRAND}"), "genes", "intervals")
def overlap_any(spark: SparkSession, sf: str) -> DataFrame:
    return _per_gene(iv.overlap_join(view(spark, sf, "genes"), view(spark, sf, "intervals")))


@query(_per_gene_sql(_MEET), "genes", "intervals")
def overlap_ignore_strand(spark: SparkSession, sf: str) -> DataFrame:
    return _per_gene(iv.overlap_join(view(spark, sf, "genes"), view(spark, sf, "intervals"), ignore_strand=True))


@query(f'SELECT g.gene, count(*) AS n, min(i.start) AS first, CAST(sum(i.l_partkey) AS BIGINT) AS parts FROM intervals i JOIN genes g ON g.chrom = i.chrom AND g.start <= i.start AND i."end" <= g."end" AND {_STRAND} GROUP BY g.gene', "genes", "intervals")
def overlap_within(spark: SparkSession, sf: str) -> DataFrame:
    met = iv.overlap_join(view(spark, sf, "intervals"), view(spark, sf, "genes"), kind="within")
    return met.groupBy(F.col("gene_b").alias("gene")).agg(F.count(F.lit(1)).alias("n"), F.min("start_a").alias("first"), F.sum("l_partkey_a").cast("long").alias("parts"))


@query('SELECT a.chrom, a.start, a."end", count(*) AS n FROM intervals a JOIN intervals b ON a.chrom = b.chrom AND a.start = b.start AND a."end" = b."end" AND a.strand = b.strand GROUP BY ALL', "intervals")
def overlap_equal(spark: SparkSession, sf: str) -> DataFrame:
    a = view(spark, sf, "intervals")
    return iv.overlap_join(a, a, kind="equal").groupBy(F.col("chrom_a").alias("chrom"), F.col("start_a").alias("start"), F.col("end_a").alias("end")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT * FROM genes g WHERE EXISTS (SELECT 1 FROM intervals i WHERE {_MEET} AND {_STRAND})", "genes", "intervals")
def overlap_semi(spark: SparkSession, sf: str) -> DataFrame:
    return iv.semi_overlap(view(spark, sf, "genes"), view(spark, sf, "intervals"))


@query(f"SELECT * FROM genes g WHERE NOT EXISTS (SELECT 1 FROM intervals i WHERE {_MEET} AND {_STRAND})", "genes", "intervals")
def overlap_anti(spark: SparkSession, sf: str) -> DataFrame:
    return iv.anti_overlap(view(spark, sf, "genes"), view(spark, sf, "intervals"))


@query(f"""WITH h AS (SELECT g.gene, i.l_partkey, i.l_suppkey, i.start FROM genes g JOIN intervals i ON {_MEET} AND {_STRAND} QUALIFY row_number() OVER (PARTITION BY g.gene ORDER BY i.l_partkey DESC, i.l_suppkey DESC, i.start DESC) = 1)
  SELECT g.gene, g.chrom, coalesce(h.start, g.start) AS start, g.start AS own, h.l_partkey AS part, h.l_suppkey AS supp FROM genes g LEFT JOIN h USING (gene)""", "genes", "intervals")
def overlap_last_hit(spark: SparkSession, sf: str) -> DataFrame:
    """Genes updated from the last of the intervals that they meet, by part, supplier and start."""
    genes = view(spark, sf, "genes")
    out = iv.overlap_update(genes.withColumn("begin", F.col("start")), view(spark, sf, "intervals"), {"begin": "start", "part": "l_partkey", "supp": "l_suppkey"}, ["l_partkey", "l_suppkey", "start"])
    return out.select("gene", "chrom", F.col("begin").alias("start"), F.col("start").alias("own"), "part", "supp")


def _reduce_sql(source: str, gap: int) -> str:
    return f"""WITH r AS (SELECT chrom, strand, start, "end", max("end") OVER (PARTITION BY chrom, strand ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
      n AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, strand ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM r)
      SELECT chrom, strand, min(start) AS start, max("end") AS "end" FROM n GROUP BY chrom, strand, island"""


@query(_reduce_sql("intervals", 1), "intervals")
def merge_adjacent(spark: SparkSession, sf: str) -> DataFrame:
    return iv.reduce(view(spark, sf, "intervals")).select("chrom", "strand", "start", "end")


@query(_reduce_sql("genes", 9), "genes")
def merge_gap_9(spark: SparkSession, sf: str) -> DataFrame:
    return iv.reduce(view(spark, sf, "genes"), gap=9).select("chrom", "strand", "start", "end")


_SWEEP = """WITH e AS (
    SELECT chrom, start AS pos, 1 AS a, 0 AS b FROM intervals UNION ALL SELECT chrom, "end" + 1, -1, 0 FROM intervals
    UNION ALL SELECT chrom, start, 0, 1 FROM genes UNION ALL SELECT chrom, "end" + 1, 0, -1 FROM genes),
  s AS (SELECT chrom, pos, sum(a) AS a, sum(b) AS b FROM e GROUP BY chrom, pos),
  d AS (SELECT chrom, pos, lead(pos) OVER w - 1 AS stop, sum(a) OVER w AS a, sum(b) OVER w AS b FROM s WINDOW w AS (PARTITION BY chrom ORDER BY pos)),
  k AS (SELECT chrom, pos, stop, CASE WHEN lag(stop) OVER (PARTITION BY chrom ORDER BY pos) = pos - 1 THEN 0 ELSE 1 END AS new FROM d WHERE {keep}),
  i AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY pos) AS island FROM k)
  SELECT chrom, min(pos) AS start, max(stop) AS "end" FROM i GROUP BY chrom, island"""


@query(_SWEEP.format(keep="a > 0 AND b = 0"), "intervals", "genes")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    return iv.setdiff(view(spark, sf, "intervals"), view(spark, sf, "genes"), ("chrom",)).select("chrom", "start", "end")


@query(_SWEEP.format(keep="a > 0 AND b > 0"), "intervals", "genes")
def set_intersection(spark: SparkSession, sf: str) -> DataFrame:
    return iv.intersect(view(spark, sf, "intervals"), view(spark, sf, "genes"), ("chrom",)).select("chrom", "start", "end")


_GAPS = """WITH r AS (SELECT *, max("end") OVER (PARTITION BY transcript ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM exons),
  gaps AS (SELECT transcript, chrom, strand, reach + 1 AS start, start - 1 AS "end" FROM r WHERE reach IS NOT NULL AND start > reach + 1)"""


@query(_GAPS + "SELECT * FROM gaps", "exons")
def introns_of_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    return iv.gaps_within(view(spark, sf, "exons"), ["transcript"]).select("transcript", "chrom", "strand", "start", "end")


@query('SELECT transcript, min(start) AS start, max("end") AS "end" FROM exons GROUP BY transcript', "exons")
def transcript_span(spark: SparkSession, sf: str) -> DataFrame:
    return iv.span(view(spark, sf, "exons"), ["transcript"])


@query("""SELECT gene, chrom, strand, CASE WHEN strand <> '-' THEN start - 100 ELSE "end" + 1 END AS start, CASE WHEN strand <> '-' THEN start - 1 ELSE "end" + 100 END AS "end" FROM genes""", "genes")
def upstream_flank(spark: SparkSession, sf: str) -> DataFrame:
    return iv.flank(view(spark, sf, "genes"), 100)


@query('SELECT gene, chrom, strand, start + 20 AS start, "end" - 20 AS "end" FROM genes WHERE start + 20 <= "end" - 20', "genes")
def trimmed_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Both ends moved inwards; what vanishes goes."""
    return iv.resize(view(spark, sf, "genes"), -20)


@query(
    """WITH e AS (SELECT chrom, strand, start AS pos, 1 AS d FROM intervals UNION ALL SELECT chrom, strand, "end" + 1, -1 FROM intervals),
  s AS (SELECT chrom, strand, pos, sum(d) AS d FROM e GROUP BY ALL HAVING sum(d) <> 0),
  r AS (SELECT chrom, strand, pos AS start, lead(pos) OVER w - 1 AS "end", CAST(sum(d) OVER w AS BIGINT) AS depth FROM s WINDOW w AS (PARTITION BY chrom, strand ORDER BY pos))
  SELECT * FROM r WHERE depth > 0""",
    "intervals",
)
def coverage_depth_runs(spark: SparkSession, sf: str) -> DataFrame:
    return iv.coverage_runs(view(spark, sf, "intervals"))


@query(
    """WITH e AS (SELECT chrom, start AS pos, 1 AS d FROM intervals UNION ALL SELECT chrom, "end" + 1, -1 FROM intervals),
  s AS (SELECT chrom, pos, sum(d) AS d FROM e GROUP BY ALL HAVING sum(d) <> 0),
  r AS (SELECT chrom, pos AS start, lead(pos) OVER w - 1 AS stop, CAST(sum(d) OVER w AS BIGINT) AS depth FROM s WINDOW w AS (PARTITION BY chrom ORDER BY pos)),
  o AS (SELECT g.gene, r.depth, least(g."end", r.stop) - greatest(g.start, r.start) + 1 AS bases FROM genes g JOIN r ON r.chrom = g.chrom AND r.depth > 0 AND r.start <= g."end" AND r.stop >= g.start),
  z AS (SELECT gene, 0 AS depth, g."end" - g.start + 1 - coalesce((SELECT sum(bases) FROM o WHERE o.gene = g.gene), 0) AS bases FROM genes g),
  h AS (SELECT gene, depth, sum(bases) AS bases FROM (SELECT * FROM o UNION ALL SELECT * FROM z WHERE bases > 0) GROUP BY gene, depth),
  c AS (SELECT *, sum(bases) OVER (PARTITION BY gene ORDER BY depth) AS cum, sum(bases) OVER (PARTITION BY gene) AS size, lead(depth) OVER (PARTITION BY gene ORDER BY depth) AS nxt FROM h),
  k AS (SELECT *, floor(size * 0.3) AS skip, (size + 1) * 0.25 AS q1, (size + 1) * 0.5 AS q2, (size + 1) * 0.75 AS q3 FROM c)
  SELECT gene, CAST(max(size) AS BIGINT) AS size, round(sum(depth * bases) / max(size), 6) AS mean,
    round(sum(depth * greatest(0, least(cum, size - skip) - greatest(cum - bases, skip))) / max(size - 2 * skip), 6) AS trimmed_mean,
    round(1 - coalesce(sum(CASE WHEN depth = 0 THEN bases END), 0) / max(size), 6) AS covered,
    """
    + ",\n    ".join(
        f"""round(CAST(max(CASE WHEN greatest(1, least(floor({q}), size)) > cum - bases AND greatest(1, least(floor({q}), size)) <= cum
      THEN depth + CASE WHEN {q} < 1 OR {q} >= size THEN 0 ELSE {q} - floor({q}) END * (CASE WHEN floor({q}) < cum THEN depth ELSE coalesce(nxt, depth) END - depth) END) AS DOUBLE), 6) AS p{p}"""
        for p, q in ((25, "q1"), (50, "q2"), (75, "q3"))
    )
    + " FROM k GROUP BY gene",
    "intervals",
    "genes",
)
def depth_statistics(spark: SparkSession, sf: str) -> DataFrame:
    runs = iv.coverage_runs(view(spark, sf, "intervals"), ("chrom",))
    stats = iv.histogram_stats(iv.depth_histogram(runs, view(spark, sf, "genes"), "gene"), "gene")
    return rounded(stats.withColumn("size", F.col("size").cast("long")), "mean", "trimmed_mean", "covered", "p25", "p50", "p75")


@query(
    _GAPS + """SELECT transcript, CASE WHEN strand <> '-' THEN start - 1 ELSE "end" + 1 END AS up, CASE WHEN strand <> '-' THEN "end" + 1 ELSE start - 1 END AS down FROM gaps""",
    "exons",
)
def splice_sites(spark: SparkSession, sf: str) -> DataFrame:
    introns = iv.gaps_within(view(spark, sf, "exons"), ["transcript"]).withColumn("place", F.struct("start", "end"))
    up = iv.splice_site_points(introns, True).select("transcript", "place", F.col("start").alias("up"))
    down = iv.splice_site_points(introns, False).select("transcript", "place", F.col("start").alias("down"))
    return up.join(down, ["transcript", "place"]).drop("place")


@query(
    """SELECT a.start AS s, CASE WHEN NOT meets THEN a.start WHEN covers THEN NULL WHEN b_start <= a.start THEN greatest(a.start, b_end + 1) WHEN b_end >= a."end" THEN a.start END AS left_start,
    CASE WHEN NOT meets THEN a."end" WHEN covers THEN NULL WHEN b_start <= a.start THEN a."end" WHEN b_end >= a."end" THEN least(a."end", b_start - 1) END AS left_end
  FROM (SELECT start, "end", l_partkey % 40 + start - 20 AS b_start, l_partkey % 40 + start - 20 + l_suppkey % 30 AS b_end,
     NOT ("end" < l_partkey % 40 + start - 20 OR l_partkey % 40 + start - 20 + l_suppkey % 30 < start) AS meets,
     (l_partkey % 40 + start - 20 <= start AND l_partkey % 40 + start - 20 + l_suppkey % 30 >= "end") AS covers FROM intervals) a""",
    "intervals",
)
def row_difference(spark: SparkSession, sf: str) -> DataFrame:
    a = view(spark, sf, "intervals").withColumn("b", F.col("l_partkey") % 40 + F.col("start") - 20).withColumn("e", F.col("b") + F.col("l_suppkey") % 30)
    rest = iv.row_difference(F.col("start"), F.col("end"), F.col("b"), F.col("e"))
    return a.select(F.col("start").alias("s"), rest["start"].alias("left_start"), rest["end"].alias("left_end"))


@query("""SELECT c.c_custkey, o.o_orderkey, o.o_totalprice FROM customer c LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1) o ON o.o_custkey = c.c_custkey""")
def first_match(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return tb.first_match_join(table(spark, sf, "customer").select("c_custkey"), orders, ["c_custkey"], ["o_orderdate", "o_orderkey"]).select("c_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT c.c_custkey, o.o_orderkey, o.o_totalprice FROM customer c LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) o ON o.o_custkey = c.c_custkey""")
def last_match(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return tb.last_match_join(table(spark, sf, "customer").select("c_custkey"), orders, ["c_custkey"], ["o_orderdate", "o_orderkey"]).select("c_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT c.c_custkey, coalesce(o.o_totalprice, c.c_acctbal) AS c_acctbal FROM customer c LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) o ON o.o_custkey = c.c_custkey""")
def update_join(spark: SparkSession, sf: str) -> DataFrame:
    new = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), "o_orderkey")
    return tb.update_columns(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), new, ["c_custkey"], ["c_acctbal"], ["o_orderkey"])


@query("""SELECT o_custkey, o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice, o_orderkey) = 1""")
def unique_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return tb.unique_first(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], ["o_totalprice", "o_orderkey"]).select("o_custkey", "o_orderpriority", "o_orderkey")


@query("""SELECT a.o_custkey, a.o_orderkey AS first_order, b.o_orderkey AS second_order FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND (a.o_orderdate < b.o_orderdate OR (a.o_orderdate = b.o_orderdate AND a.o_orderkey < b.o_orderkey)) WHERE a.o_orderpriority <> b.o_orderpriority""")
def ordered_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = tb.all_pairs(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderpriority")
    return pairs.select("o_custkey", F.col("o_orderkey_a").alias("first_order"), F.col("o_orderkey_b").alias("second_order"))


@query("""WITH y AS (SELECT *, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS position FROM customer)
  SELECT position, c_custkey AS cust, c_acctbal, o_orderkey, o_totalprice FROM y LEFT JOIN orders ON o_custkey = c_custkey""")
def look_up_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Orders looked up for customers in the order of their balances; unmatched customers stay."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("cust"), "o_orderkey", "o_totalprice", "o_orderdate")
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("cust"), "c_acctbal")
    return tb.look_up(orders, customers, ["cust"], ["c_acctbal", "cust"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""SELECT coalesce(s.s_nationkey, c.c_nationkey) AS nation, coalesce(s.n, c.n) AS n FROM (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s FULL JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON s.s_nationkey = c.c_nationkey""")
def upsert_tables(spark: SparkSession, sf: str) -> DataFrame:
    new = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    return tb.upsert(table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n")), new, "nation")


@query("""SELECT chrom || ':' || CAST(start AS VARCHAR) || '-' || CAST("end" AS VARCHAR) || '/' || strand AS event, chrom, start, "end", strand, count(*) AS n FROM intervals GROUP BY ALL""", "intervals")
def coordinate_strings(spark: SparkSession, sf: str) -> DataFrame:
    named = view(spark, sf, "intervals").select(coords.format_interval().alias("event")).groupBy("event").agg(F.count(F.lit(1)).alias("n"))
    return coords.check_intervals(named, "event")


def alignments(spark: SparkSession, sf: str) -> DataFrame:
    r = view(spark, sf, "reads")
    part = lambda c, op: F.concat(F.col(c).cast("string"), F.lit(op))
    return r.select("sample", F.lit(None).cast("string").alias("qname"), "flag", "chrom", "pos", F.concat(part("m1", "M"), part("n1", "N"), part("m2", "M"), F.when(F.col("n2") > 0, part("n2", "N")).otherwise("2I"), part("m3", "M")).alias("cigar"))


_PIECES = """WITH p AS (SELECT *, pos + m1 AS j1, pos + m1 + n1 AS k1, CASE WHEN n2 > 0 THEN m2 ELSE m2 + m3 END AS w2,
    pos + m1 + n1 + m2 AS j2, pos + m1 + n1 + m2 + n2 AS k2, CAST(flag = 0 AS BIGINT) AS plus FROM reads),
  b AS (SELECT sample, chrom, plus, pos AS s, j1 AS e FROM p UNION ALL SELECT sample, chrom, plus, k1, k1 + w2 FROM p UNION ALL SELECT sample, chrom, plus, k2, k2 + m3 FROM p WHERE n2 > 0),
  x AS (SELECT sample, chrom, plus, j1 AS s, k1 AS e FROM p WHERE m1 >= 5 AND w2 >= 5 UNION ALL SELECT sample, chrom, plus, j2, k2 FROM p WHERE n2 > 0 AND m2 >= 5 AND m3 >= 5),
  jc AS (SELECT sample, chrom, s, e, count(*) AS total, CAST(sum(plus) AS BIGINT) AS pos, CAST(sum(1 - plus) AS BIGINT) AS neg FROM x GROUP BY ALL)"""


@query(_PIECES + "SELECT sample, chrom, s AS start, e AS \"end\", total, pos, neg FROM jc", "reads")
def junction_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rd.junction_counts(rd.fragments(alignments(spark, sf))).drop("strand", "nmd")


@query(_PIECES + "SELECT sample, chrom, s AS start, CAST(sum(total) AS BIGINT) AS total, CAST(sum(pos) AS BIGINT) AS pos, CAST(sum(neg) AS BIGINT) AS neg FROM jc GROUP BY ALL", "reads")
def junction_left_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rd.junction_side_counts(rd.fragments(alignments(spark, sf)), "start")


@query(_PIECES + "SELECT sample, chrom, j1 AS start1, k1 AS end1, j2 AS start2, k2 AS end2, count(*) AS total, CAST(sum(plus) AS BIGINT) AS pos, CAST(sum(1 - plus) AS BIGINT) AS neg FROM p WHERE n2 > 0 AND m1 >= 5 AND m2 >= 5 AND m3 >= 5 GROUP BY ALL", "reads")
def tandem_junction_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rd.tandem_counts(rd.fragments(alignments(spark, sf)))


@query(_PIECES + """, pt AS (SELECT DISTINCT chrom, start AS coord FROM genes)
  SELECT sample, pt.chrom, coord, count(*) AS total, CAST(sum(plus) AS BIGINT) AS pos, CAST(sum(1 - plus) AS BIGINT) AS neg FROM pt JOIN b ON b.chrom = pt.chrom AND e - s > 9 AND s + 5 <= coord AND coord < e GROUP BY ALL""", "reads", "genes")
def span_point_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rd.span_counts(rd.fragments(alignments(spark, sf)), view(spark, sf, "genes").select("chrom", F.col("start").alias("coord")))


@query(_PIECES + """, f AS (SELECT sample, chrom, plus, pos AS s, CASE WHEN n2 > 0 THEN k2 + m3 ELSE k1 + w2 END AS e FROM p),
  d AS (SELECT DISTINCT chrom, s, e FROM f),
  m AS (SELECT d.chrom, s, e, arg_min(gene, (g."end", g.start, g.gene)) AS gene FROM d JOIN genes g ON g.chrom = d.chrom AND g.start <= s AND e <= g."end" GROUP BY ALL)
  SELECT sample, 'g' || CAST(gene AS VARCHAR) AS name, count(*) AS total, CAST(sum(plus) AS BIGINT) AS pos, CAST(sum(1 - plus) AS BIGINT) AS neg FROM f JOIN m USING (chrom, s, e) GROUP BY ALL""", "reads", "genes")
def fragments_in_regions(spark: SparkSession, sf: str) -> DataFrame:
    regions = view(spark, sf, "genes").select("chrom", "start", "end", "gene")
    named = regions.withColumn("name", F.col("gene"))
    counted = rd.region_counts(rd.fragments(alignments(spark, sf)), named)
    return counted.withColumn("name", F.concat(F.lit("g"), F.col("name").cast("string")))


@query("SELECT sample, chrom, count(*) AS total, CAST(sum(CAST(flag = 0 AS BIGINT)) AS BIGINT) AS pos, CAST(sum(CAST(flag <> 0 AS BIGINT)) AS BIGINT) AS neg FROM reads GROUP BY ALL", "reads")
def fragments_per_contig(spark: SparkSession, sf: str) -> DataFrame:
    return rd.contig_counts(rd.fragments(alignments(spark, sf)))


@query("SELECT sample, count(*) AS total_reads, CAST(sum(m1 + m2 + m3) AS BIGINT) AS nucleotides FROM reads GROUP BY sample", "reads")
def read_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return rd.read_counts(alignments(spark, sf)).select("sample", "total_reads", "nucleotides")


@query(_PIECES + """, k AS (SELECT *, CASE WHEN s % 3 = 0 THEN '+' WHEN s % 3 = 1 THEN '-' ELSE '.' END AS strand, neg > 4 * pos AS n, pos > 4 * neg AS q FROM jc WHERE total > 1),
  c AS (SELECT sample, count_if(n OR q) AS dir_evidence, count_if(NOT (n OR q)) AS nondir_evidence, count_if((n AND strand = '-') OR (q AND strand = '+')) AS dir_same, count_if((n AND strand = '+') OR (q AND strand = '-')) AS dir_diff, count_if(NOT (n OR q) AND strand <> '.') AS nondir_known FROM k GROUP BY sample)
  SELECT sample, CAST(dir_evidence AS BIGINT) AS dir_evidence, CAST(nondir_evidence AS BIGINT) AS nondir_evidence, CAST(dir_same AS BIGINT) AS dir_same, CAST(dir_diff AS BIGINT) AS dir_diff,
    CAST(floor((dir_same + dir_diff) * 10000 / (dir_same + dir_diff + nondir_known + 1)) AS BIGINT) AS score_known FROM c""", "reads")
def strand_evidence(spark: SparkSession, sf: str) -> DataFrame:
    strand = F.when(F.col("start") % 3 == 0, "+").when(F.col("start") % 3 == 1, "-").otherwise(".")
    counts = rd.junction_counts(rd.fragments(alignments(spark, sf))).withColumn("strand", strand)
    # Totals are scaled so that two reads stand for more than eight.
    scaled = counts.withColumns({c: F.col(c) * 8 for c in ("total", "pos", "neg")})
    return rd.directionality(scaled).select("sample", "dir_evidence", "nondir_evidence", "dir_same", "dir_diff", "score_known")


@query(_PIECES + """, e AS (SELECT sample, chrom, s AS site, 1 AS d FROM b UNION ALL SELECT sample, chrom, e, -1 FROM b),
  s AS (SELECT sample, chrom, site, sum(d) AS d FROM e GROUP BY ALL HAVING sum(d) <> 0),
  r AS (SELECT sample, chrom, site + 1 AS start, lead(site) OVER w AS "end", CAST(sum(d) OVER w AS BIGINT) AS depth FROM s WINDOW w AS (PARTITION BY sample, chrom ORDER BY site))
  SELECT * FROM r WHERE depth > 0""", "reads")
def read_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return rd.coverage(rd.fragments(alignments(spark, sf)), ("*",)).drop("strand")


@query("""WITH p AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' AND ts IS NOT NULL GROUP BY user_id, ts)
  SELECT e.user_id, e.event_id, p.value AS value_right FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type <> 'view'""")
def as_of_previous(spark: SparkSession, sf: str) -> DataFrame:
    """The last view of the same user at or before each other event."""
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "value", "event_type")
    return tb.as_of_join(e.where("event_type <> 'view'"), e.where("event_type = 'view'"), ["user_id"], "ts", ["value"]).select("user_id", "event_id", "value_right")


def paired_alignments(spark: SparkSession, sf: str) -> DataFrame:
    """Two alignments of one block for each row of the view pairs."""
    p = view(spark, sf, "pairs")
    mate = lambda n, flag: F.struct(F.lit(flag).alias("flag"), F.col(f"pos{n}").alias("pos"), F.concat(F.col(f"w{n}").cast("string"), F.lit("M")).alias("cigar"))
    strand = F.when(F.col("plus") == 1, F.array(mate(1, 0x61), mate(2, 0x91))).otherwise(F.array(mate(1, 0x51), mate(2, 0xA1)))
    return p.select("sample", "qname", "chrom", F.explode(strand).alias("m")).select("sample", "qname", "m.flag", "chrom", "m.pos", "m.cigar")


_PAIRS = """WITH p AS (SELECT *, pos1 + w1 AS e1, pos2 + w2 AS e2, count(*) OVER (PARTITION BY sample, qname) AS times FROM pairs),
  o AS (SELECT *, pos2 < pos1 OR (pos1 = pos2 AND e1 > e2) AS swapped FROM p WHERE times = 1),
  l AS (SELECT sample, chrom, plus, CASE WHEN swapped THEN pos2 ELSE pos1 END AS lp, CASE WHEN swapped THEN e2 ELSE e1 END AS le, CASE WHEN swapped THEN pos1 ELSE pos2 END AS rp, CASE WHEN swapped THEN e1 ELSE e2 END AS re FROM o),
  f AS (SELECT *, CASE WHEN le < rp THEN 'long' WHEN le >= re THEN 'short' ELSE 'intersect' END AS kind FROM l)"""


@query(_PAIRS + " SELECT sample, chrom, kind, CAST(plus AS INTEGER) AS direction, count(*) AS n, CAST(sum(CASE kind WHEN 'long' THEN le - lp + re - rp WHEN 'short' THEN le - lp ELSE re - lp END) AS BIGINT) AS nucleotides FROM f GROUP BY ALL", "pairs")
def paired_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Mates apart, one within the other, and overlapping ones, with what they cover."""
    size = F.aggregate(F.flatten("reads"), F.lit(0).cast("long"), lambda acc, b: acc + b["end"] - b["start"])
    frags = rd.fragments(paired_alignments(spark, sf))
    return frags.groupBy("sample", "chrom", "kind", "direction").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("nucleotides"))


@query(_PAIRS + """, c AS (SELECT sample, count_if(kind = 'long') AS long_pairs, count_if(kind = 'short') AS short_pairs, count_if(kind = 'intersect') AS intersect_pairs, count(*) AS pairs FROM f GROUP BY sample), t AS (SELECT sample, 2 * count(*) AS total_reads FROM pairs GROUP BY sample)
  SELECT sample, total_reads, CAST(long_pairs AS BIGINT) AS long_pairs, CAST(short_pairs AS BIGINT) AS short_pairs, CAST(intersect_pairs AS BIGINT) AS intersect_pairs, pairs, CAST(0 AS BIGINT) AS unpaired, CAST(0 AS BIGINT) AS chimeric FROM c JOIN t USING (sample)""", "pairs")
def pair_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return rd.read_counts(paired_alignments(spark, sf)).select("sample", "total_reads", "long_pairs", "short_pairs", "intersect_pairs", "pairs", "unpaired", "chimeric")


@query("""WITH m AS (SELECT sample, qname, chrom FROM pairs UNION ALL SELECT sample, qname, CASE WHEN w2 % 5 = 1 THEN 'Z' ELSE chrom END FROM pairs WHERE w2 % 5 > 0),
  n AS (SELECT sample, qname, count(*) AS n, min(chrom) <> max(chrom) AS apart FROM m GROUP BY ALL)
  SELECT sample, CAST(sum(n) AS BIGINT) AS total_reads, CAST(count_if(n = 1) AS BIGINT) AS unpaired, CAST(count_if(n = 2 AND apart) AS BIGINT) AS chimeric FROM n GROUP BY sample""", "pairs")
def stray_mates(spark: SparkSession, sf: str) -> DataFrame:
    """Mates that are missing, and pairs on two contigs."""
    width = F.when(F.col("flag").bitwiseAND(0x80) != 0, F.regexp_extract("cigar", r"^(\d+)", 1).cast("int") % 5)
    rows = paired_alignments(spark, sf).withColumn("w", width).where("w is null or w > 0").withColumn("chrom", F.when(F.col("w") == 1, "Z").otherwise(F.col("chrom")))
    return rd.read_counts(rows).select("sample", "total_reads", "unpaired", "chimeric")


@query(_PIECES + "SELECT sample, chrom, e AS \"end\", CAST(sum(total) AS BIGINT) AS total, CAST(sum(pos) AS BIGINT) AS pos, CAST(sum(neg) AS BIGINT) AS neg FROM jc GROUP BY ALL", "reads")
def junction_right_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rd.junction_side_counts(rd.fragments(alignments(spark, sf)), "end")


@query(_PIECES + """, a AS (SELECT DISTINCT chrom, s, e, CASE WHEN s % 2 = 0 THEN '+' ELSE '-' END AS strand, s % 3 = 0 AS nmd FROM jc WHERE total > 1), n AS (SELECT DISTINCT sample FROM reads),
  w AS (SELECT a.*, n.sample FROM a, n)
  SELECT coalesce(w.sample, jc.sample) AS sample, coalesce(w.chrom, jc.chrom) AS chrom, coalesce(w.s, jc.s) AS start, coalesce(w.e, jc.e) AS "end", coalesce(strand, '.') AS strand, coalesce(nmd, FALSE) AS nmd, coalesce(total, 0) AS total
  FROM w FULL JOIN jc ON w.sample = jc.sample AND w.chrom = jc.chrom AND w.s = jc.s AND w.e = jc.e""", "reads")
def annotated_junction_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts with strand and decay of annotated junctions, which have a row for every sample."""
    frags = rd.fragments(alignments(spark, sf))
    seen = rd.junction_counts(frags).where("total > 1").select("chrom", "start", "end").distinct()
    known = seen.select("chrom", "start", "end", F.when(F.col("start") % 2 == 0, "+").otherwise("-").alias("strand"), (F.col("start") % 3 == 0).alias("nmd"))
    return rd.junction_counts(frags, known, frags.select("sample").distinct()).select("sample", "chrom", "start", "end", "strand", "nmd", "total")


#: Depth of every base of the genes that reads cover, by sample.
_BASES = _PIECES + """, v AS (SELECT gene AS name, chrom, start AS s, "end" AS e, strand FROM genes WHERE "end" - start >= 60),
  ev AS (SELECT sample, chrom, s AS site, 1 AS d FROM b UNION ALL SELECT sample, chrom, e, -1 FROM b), es AS (SELECT sample, chrom, site, sum(d) AS d FROM ev GROUP BY ALL HAVING sum(d) <> 0),
  run AS (SELECT sample, chrom, site AS a, lead(site) OVER w AS z, CAST(sum(d) OVER w AS BIGINT) AS depth FROM es WINDOW w AS (PARTITION BY sample, chrom ORDER BY site)),
  n AS (SELECT DISTINCT sample FROM jc), k AS (SELECT v.*, n.sample FROM v, n),
  parts AS (SELECT sample, name, kind, chrom, pa, pz FROM (SELECT *, 'all' AS kind, s AS pa, e AS pz FROM k UNION ALL SELECT *, 'first', s + 5, s + 55 FROM k UNION ALL SELECT *, 'last', e - 55, e - 5 FROM k)),
  o AS (SELECT p.sample, p.name, p.kind, r.depth, least(p.pz, r.z) - greatest(p.pa, r.a) AS bases FROM parts p JOIN run r ON r.sample = p.sample AND r.chrom = p.chrom AND r.depth > 0 AND r.a < p.pz AND r.z > p.pa),
  h AS (SELECT sample, name, kind, depth, sum(bases) AS bases FROM (SELECT * FROM o UNION ALL SELECT p.sample, p.name, p.kind, 0, p.pz - p.pa - coalesce(t.n, 0) FROM parts p LEFT JOIN (SELECT sample, name, kind, sum(bases) AS n FROM o GROUP BY ALL) t USING (sample, name, kind)) WHERE bases > 0 GROUP BY ALL),
  c AS (SELECT *, sum(bases) OVER (PARTITION BY sample, name, kind ORDER BY depth) AS cum, sum(bases) OVER (PARTITION BY sample, name, kind) AS size FROM h),
  m AS (SELECT sample, name, kind, sum(depth * greatest(0, least(cum, size - floor(size * 0.3)) - greatest(cum - bases, floor(size * 0.3)))) / any_value(size - 2 * floor(size * 0.3)) AS depth,
    1 - coalesce(sum(CASE WHEN depth = 0 THEN bases END), 0) / any_value(size) AS coverage FROM c GROUP BY ALL),
  sl AS (SELECT sample, chrom, s, sum(total) AS n FROM jc GROUP BY ALL), sr AS (SELECT sample, chrom, e, sum(total) AS n FROM jc GROUP BY ALL),
  pt AS (SELECT chrom, s AS coord FROM v UNION SELECT chrom, e FROM v),
  sp AS (SELECT b.sample, pt.chrom, coord, count(*) AS n FROM pt JOIN b ON b.chrom = pt.chrom AND b.e - b.s > 9 AND b.s + 5 <= coord AND coord < b.e GROUP BY ALL),
  rec AS (SELECT k.sample, k.name, coalesce(ma.depth, 0) AS depth, coalesce(ma.coverage, 0) AS coverage, coalesce(mf.depth, 0) AS first50, coalesce(ml.depth, 0) AS last50,
      coalesce(sl.n, 0)::DOUBLE AS splice_left, coalesce(sr.n, 0)::DOUBLE AS splice_right, coalesce(jc.total, 0)::DOUBLE AS splice_exact, coalesce(a.n, 0)::DOUBLE AS span_left, coalesce(z.n, 0)::DOUBLE AS span_right
    FROM k LEFT JOIN m ma ON ma.sample = k.sample AND ma.name = k.name AND ma.kind = 'all' LEFT JOIN m mf ON mf.sample = k.sample AND mf.name = k.name AND mf.kind = 'first' LEFT JOIN m ml ON ml.sample = k.sample AND ml.name = k.name AND ml.kind = 'last'
    LEFT JOIN sl ON sl.sample = k.sample AND sl.chrom = k.chrom AND sl.s = k.s LEFT JOIN sr ON sr.sample = k.sample AND sr.chrom = k.chrom AND sr.e = k.e LEFT JOIN jc ON jc.sample = k.sample AND jc.chrom = k.chrom AND jc.s = k.s AND jc.e = k.e
    LEFT JOIN sp a ON a.sample = k.sample AND a.chrom = k.chrom AND a.coord = k.s LEFT JOIN sp z ON z.sample = k.sample AND z.chrom = k.chrom AND z.coord = k.e),
  fin AS (SELECT *, CASE WHEN depth = 0 AND splice_left = 0 AND splice_right = 0 THEN 0.0 WHEN depth < 1 THEN coverage / nullif(coverage + greatest(splice_left, splice_right), 0) ELSE depth / (depth + greatest(splice_left, splice_right)) END AS ir_ratio,
    CASE WHEN splice_exact + depth < 10 THEN 'LowCover' WHEN splice_exact < 4 THEN 'LowSplicing' WHEN splice_exact * 1.33333333 < greatest(splice_left, splice_right) THEN 'MinorIsoform'
      WHEN (greatest(span_left, span_right) > depth + 2 AND greatest(span_left, span_right) > depth * 1.5) OR (least(span_left, span_right) + 2 < depth AND least(span_left, span_right) * 1.5 < depth) THEN 'NonUniformIntronCover' ELSE '-' END AS warning FROM rec)"""


def _records(spark: SparkSession, sf: str) -> DataFrame:
    introns = view(spark, sf, "genes").where("end - start >= 60").select(F.col("gene").alias("name"), "chrom", "start", "end", "strand")
    return rd.intron_records_of_fragments(rd.fragments(alignments(spark, sf)), introns, introns.select("name", "chrom", "start", "end"))


_RECORD = ("depth", "coverage", "first50", "last50", "ir_ratio")


@query(_BASES + " SELECT sample, name, " + ", ".join(f"round({c}, 6) AS {c}" for c in _RECORD) + ", splice_left, splice_right, splice_exact, span_left, span_right, warning FROM fin", "reads", "genes")
def intron_records(spark: SparkSession, sf: str) -> DataFrame:
    """Genes as introns: depth, edges, spliced and spanning reads, the ratio of retention and its warning."""
    return rounded(_records(spark, sf).select("sample", "name", *_RECORD, "splice_left", "splice_right", "splice_exact", "span_left", "span_right", "warning"), *_RECORD)


@query(_BASES + " SELECT sample, round(sum(CASE WHEN name % 3 = 0 THEN depth ELSE 0 END), 3) AS clean, round(sum(CASE WHEN name % 3 = 1 THEN depth ELSE 0 END), 3) AS known_exon, round(sum(CASE WHEN name % 3 = 2 THEN depth ELSE 0 END), 3) AS anti_sense FROM fin GROUP BY sample", "reads", "genes")
def burden_of_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Summed intron depth by class, which names tell."""
    kind = F.element_at(F.array(F.lit("clean"), F.lit("known-exon"), F.lit("anti-near")), (F.col("name") % 3 + 1).cast("int"))
    return rounded(rd.burden(_records(spark, sf).withColumn("name", kind)), "clean", "known_exon", "anti_sense", places=3)


@query("""WITH r AS (SELECT chrom, start, "end", max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM intervals),
  d AS (SELECT chrom, pos, sum(d) AS d FROM (SELECT chrom, start AS pos, 1 AS d FROM intervals UNION ALL SELECT chrom, "end" + 1, -1 FROM intervals) GROUP BY ALL HAVING sum(d) <> 0),
  x AS (SELECT chrom, pos AS start, lead(pos) OVER w - 1 AS "end", sum(d) OVER w AS depth FROM d WINDOW w AS (PARTITION BY chrom ORDER BY pos)),
  deep AS (SELECT chrom, start, "end", coalesce(lag("end") OVER (PARTITION BY chrom ORDER BY start) + 1 = start, FALSE) AS joined FROM x WHERE depth > 2),
  n AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY start) AS island FROM deep), i AS (SELECT chrom, min(start) AS start, max("end") AS "end" FROM n GROUP BY chrom, island),
  l AS (SELECT chrom, max("end") + 100 AS length FROM intervals GROUP BY chrom), g AS (SELECT chrom, lag("end", 1, 0) OVER (PARTITION BY chrom ORDER BY start) + 1 AS start, start - 1 AS "end" FROM i UNION ALL SELECT l.chrom, coalesce(max(i."end"), 0) + 1, any_value(length) FROM l LEFT JOIN i USING (chrom) GROUP BY l.chrom)
  SELECT chrom, start, "end" FROM g WHERE "end" >= start""", "intervals")
def low_mappability_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Where what is aligned back covers no deeper than a threshold."""
    rows = view(spark, sf, "intervals")
    cover = iv.coverage_runs(rows, ("chrom",)).withColumn("strand", F.lit("*"))
    return rd.uncovered(cover, rows.groupBy("chrom").agg((F.max("end") + 100).alias("length")), 2).select("chrom", "start", "end")
