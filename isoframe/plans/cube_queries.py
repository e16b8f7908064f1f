"""Queries of the events x samples cube: ratios, filters, matrices, collation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.operators import dataset as ds
from isoframe.operators import filters as fl
from isoframe.operators import quant as qt
from isoframe.plans.domain import rounded, table, view, with_views
from isoframe.plans.interval_queries import alignments
from isoframe.sources.store import settle

QUERIES, ORACLES = {}, {}


def query(sql: str | None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


#: Each event has a type by its number; half of its reads count for its flanks.
_CELLS = """WITH cells AS (SELECT 'e' || CAST(event AS VARCHAR(9)) AS event_name,
    CASE event % 8 WHEN 0 THEN 'IR' WHEN 1 THEN 'MXE' WHEN 2 THEN 'SE' WHEN 3 THEN 'A3SS' WHEN 4 THEN 'A5SS' WHEN 5 THEN 'AFE' WHEN 6 THEN 'ALE' ELSE 'RI' END AS event_type,
    sample, included, excluded, included + excluded AS depth, included + excluded AS min_depth, included / nullif(included + excluded, 0) AS coverage,
    included / 2 AS up_inc, included / 5 AS down_inc, excluded / 3 AS up_exc, excluded / 2 AS down_exc FROM assay) """


def cells(spark: SparkSession, sf: str) -> DataFrame:
    a = view(spark, sf, "assay")
    total = F.col("included") + F.col("excluded")
    kinds = ("IR", "MXE", "SE", "A3SS", "A5SS", "AFE", "ALE", "RI")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("event") % 8 + 1).cast("int"))
    return a.select(F.concat(F.lit("e"), F.col("event").cast("string")).alias("event_name"), kind.alias("event_type"), "sample", "included", "excluded", total.alias("depth"), total.alias("min_depth"), F.try_divide("included", total).alias("coverage"), (F.col("included") / 2).alias("up_inc"), (F.col("included") / 5).alias("down_inc"), (F.col("excluded") / 3).alias("up_exc"), (F.col("excluded") / 2).alias("down_exc"))


_PSI = "CASE WHEN included + excluded >= 10 THEN included / (included + excluded) END"


@query(_CELLS + f"SELECT event_name, sample, round({_PSI}, 6) AS psi FROM cells WHERE event_name IN (SELECT event_name FROM cells GROUP BY event_name HAVING count_if(depth >= 20) * 100 >= 80 * count(*))", "assay")
def psi_depth_filtered(spark: SparkSession, sf: str) -> DataFrame:
    kept = fl.apply_filters(cells(spark, sf), [fl.EventFilter("Depth", pc_true=80, minimum=20)])
    return rounded(ds.with_psi(kept).select("event_name", "sample", "psi"), "psi")


@query(_CELLS + f"""SELECT event_name, sample, round(psi, 6) AS value FROM (SELECT *, {_PSI} AS psi, count(*) OVER (PARTITION BY event_name) AS n, count_if({_PSI} IS NULL) OVER (PARTITION BY event_name) AS missing FROM cells) WHERE missing < 0.1 * n""", "assay")
def psi_matrix_values(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ds.psi_values(cells(spark, sf)), "value")


_LOGIT = "CASE WHEN psi <= 0 THEN -{m} WHEN psi >= 1 THEN {m} ELSE greatest(-{m}, least({m}, ln(psi / (1 - psi)))) END"


@query(_CELLS + f"""SELECT event_name, sample, round(CASE WHEN psi IS NULL THEN NULL ELSE {_LOGIT.format(m='5.0')} END, 6) AS value FROM (SELECT *, {_PSI} AS psi, count(*) OVER (PARTITION BY event_name) AS n, count_if({_PSI} IS NULL) OVER (PARTITION BY event_name) AS missing FROM cells) WHERE missing < 0.1 * n""", "assay")
def logit_matrix_values(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ds.psi_values(cells(spark, sf), "logit").withColumn("value", F.col("value").cast("double")), "value")


@query(_CELLS + f"""SELECT event_name, sample, round(CASE WHEN missing = 0 THEN (psi - avg(psi) OVER w) / nullif(stddev_samp(psi) OVER w, 0) END, 5) AS value FROM (SELECT *, {_PSI} AS psi, count(*) OVER (PARTITION BY event_name) AS n, count_if({_PSI} IS NULL) OVER (PARTITION BY event_name) AS missing FROM cells) WHERE missing < 0.1 * n WINDOW w AS (PARTITION BY event_name)""", "assay")
def zscore_matrix_values(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ds.psi_values(cells(spark, sf), "Z-score"), "value", places=5)


@query(_CELLS + f"""SELECT event_name, level, round(1 / (1 + exp(-avg(CASE WHEN psi IS NULL THEN NULL ELSE {_LOGIT.format(m='10.0')} END))), 6) AS mean FROM (SELECT *, {_PSI} AS psi, CASE WHEN sample < '3' THEN 'A' ELSE 'B' END AS level FROM cells) GROUP BY event_name, level""", "assay")
def mean_psi_by_condition(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    return rounded(ds.mean_psi(c, _samples(c), "condition"), "mean")


def _samples(c: DataFrame) -> DataFrame:
    return c.select("sample").distinct().withColumn("condition", F.when(F.col("sample") < "3", "A").otherwise("B"))


_KEEP = "SELECT event_name, count(*) AS n FROM cells WHERE event_name IN ({}) GROUP BY event_name"


def _kept(df: DataFrame) -> DataFrame:
    return df.groupBy("event_name").agg(F.count(F.lit(1)).alias("n"))


@query(_CELLS + _KEEP.format("SELECT event_name FROM cells GROUP BY event_name, event_type HAVING event_type NOT IN ('IR', 'RI') OR count_if(CASE WHEN min_depth < 5 THEN 1 ELSE coverage END >= 0.3) * 100 >= 80 * count(*)"), "assay")
def filter_participation(spark: SparkSession, sf: str) -> DataFrame:
    return _kept(fl.apply_filters(cells(spark, sf), [fl.EventFilter("Participation", pc_true=80, minimum=30, min_depth=5, event_types=("IR", "RI"))]))


_CLOSE = "log2(CASE WHEN up_{s} + down_{s} < 20 THEN 0 ELSE {t} END + 1) - log2({d}_{s} + 1) < 2"


@query(
    _CELLS
    + _KEEP.format(
        "SELECT event_name FROM cells GROUP BY event_name, event_type HAVING event_type NOT IN ('MXE', 'SE', 'RI') OR count_if("
        + " AND ".join(f"({kind} OR {_CLOSE.format(s=s, t=t, d=d)})" for s, t, kind in (("inc", "included", "event_type NOT IN ('IR', 'MXE', 'SE', 'RI')"), ("exc", "excluded", "event_type <> 'MXE'")) for d in ("up", "down"))
        + ") * 100 >= 80 * count(*)"
    ),
    "assay",
)
def filter_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return _kept(fl.apply_filters(cells(spark, sf), [fl.EventFilter("Consistency", pc_true=80, maximum=2, min_depth=20, event_types=("MXE", "SE", "RI"))]))


@query(
    _CELLS
    + """, l AS (SELECT event_name, CASE WHEN sample < '3' THEN 'A' ELSE 'B' END AS level, count_if(depth >= 120) * 100 >= 60 * count(*) AS ok FROM cells GROUP BY 1, 2)
  SELECT event_name FROM l GROUP BY event_name HAVING count_if(ok) >= 1""",
    "assay",
)
def filter_depth_by_condition(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    return fl.run_filter(c, fl.EventFilter("Depth", pc_true=60, minimum=120, condition="condition", min_cond=1), _samples(c))


@query(_CELLS + "SELECT event_type, CAST(count(DISTINCT CASE WHEN ok THEN event_name END) AS BIGINT) AS kept, CAST(count(DISTINCT CASE WHEN ok THEN NULL ELSE event_name END) AS BIGINT) AS removed FROM (SELECT *, event_type NOT IN ('IR', 'AFE') AND count_if(depth >= 100) OVER (PARTITION BY event_name) * 100 >= 80 * count(*) OVER (PARTITION BY event_name) AS ok FROM cells) GROUP BY event_type", "assay")
def filters_applied_summary(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    return fl.filter_summary(c, fl.apply_filters(c, [fl.EventFilter("Modality", event_types=("IR", "AFE")), fl.EventFilter("Depth", pc_true=80, minimum=100)]))


def _annotated(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event").cast("int")
    return view(spark, sf, "assay").select("event").distinct().select(
        F.concat(F.lit("e"), F.col("event").cast("string")).alias("event_name"),
        F.element_at(F.array(*map(F.lit, ("IR", "MXE", "SE", "A3SS", "A5SS", "AFE", "ALE", "RI"))), n % 8 + 1).alias("event_type"),
        (n % 3 == 0).alias("inc_is_protein_coding"),
        (n % 5 == 0).alias("exc_is_protein_coding"),
        F.when(n % 4 != 0, n % 3 == 1).alias("inc_is_nmd"),
        F.when(n % 7 != 0, n % 2 == 1).alias("exc_is_nmd"),
        F.when(n % 6 == 0, "NA").otherwise((n % 6).cast("string")).alias("inc_tsl"),
        (n % 4 + 1).cast("string").alias("exc_tsl"),
        (n % 3 == 0).alias("is_always_first_intron"),
        (n % 9 == 0).alias("is_always_last_intron"),
    )


_ANNOTATED = """WITH a AS (SELECT DISTINCT event AS n, 'e' || CAST(event AS VARCHAR(9)) AS event_name,
  CASE event % 8 WHEN 0 THEN 'IR' WHEN 1 THEN 'MXE' WHEN 2 THEN 'SE' WHEN 3 THEN 'A3SS' WHEN 4 THEN 'A5SS' WHEN 5 THEN 'AFE' WHEN 6 THEN 'ALE' ELSE 'RI' END AS event_type FROM assay) """


@query(
    _ANNOTATED
    + """, k(kind, event_name) AS (
  SELECT 'Protein_Coding', event_name FROM a WHERE n % 3 = 0 OR (n % 5 = 0 AND event_type <> 'IR')
  UNION ALL SELECT 'NMD', event_name FROM a WHERE n % 4 <> 0 AND n % 7 <> 0 AND (n % 3 = 1) <> (n % 2 = 1)
  UNION ALL SELECT 'TSL', event_name FROM a WHERE n % 6 BETWEEN 1 AND 2 AND n % 4 + 1 <= 2
  UNION ALL SELECT 'Terminus', event_name FROM a WHERE (event_type <> 'AFE' OR n % 3 = 0) AND (event_type <> 'ALE' OR n % 9 = 0)
  UNION ALL SELECT 'Modality', event_name FROM a WHERE event_type <> 'SE') SELECT * FROM k""",
    "assay",
)
def annotation_filters(spark: SparkSession, sf: str) -> DataFrame:
    a = _annotated(spark, sf)
    specs = [fl.EventFilter("Protein_Coding"), fl.EventFilter("NMD"), fl.EventFilter("TSL", minimum=2), fl.EventFilter("Terminus"), fl.EventFilter("Modality", event_types=("SE",))]
    out = None
    for f in specs:
        one = fl.run_filter(a, f).select(F.lit(f.filter_type).alias("kind"), "event_name")
        out = one if out is None else out.unionByName(one)
    return out


_FACTS = """WITH f AS (SELECT o_orderpriority AS sample, 'j' || CAST(l_partkey AS VARCHAR(20)) AS event, CAST(sum(l_quantity) AS DOUBLE) AS q, CAST(sum(l_linenumber) AS DOUBLE) AS l, CAST(sum(l_suppkey % 50) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n,
    CAST(sum(round(l_tax * 100)) AS DOUBLE) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
  e AS (SELECT p_partkey AS p, 'e' || CAST(p_partkey AS VARCHAR(20)) AS event_name, CASE p_partkey % 8 WHEN 0 THEN 'IR' WHEN 1 THEN 'MXE' WHEN 2 THEN 'SE' WHEN 3 THEN 'A3SS' WHEN 4 THEN 'A5SS' WHEN 5 THEN 'AFE' WHEN 6 THEN 'ALE' ELSE 'RI' END AS kind,
    CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE '+' END AS strand FROM part),
  n AS (SELECT DISTINCT sample FROM f), k AS (SELECT e.*, n.sample FROM e, n),
  a AS (SELECT k.*, kind IN ('IR', 'RI') AS ret, coalesce(o.t / 10, 0) AS d, coalesce(o.t / 100, 0) AS cov, coalesce(0.7 * o.q, 0) AS sov, coalesce(1.25 * o.q, -1) AS tot, coalesce(3 * o.n, 0) AS sl, coalesce(2 * o.n, 0) AS sr,
    coalesce(a1.q, 0) AS a1, coalesce(a2.q, 0) AS a2, coalesce(b1.q, 0) AS b1, coalesce(b2.q, 0) AS b2,
    coalesce(a1.q + a1.l, 0) AS la1, coalesce(a1.q + a1.s, 0) AS ra1, coalesce(a2.q + a2.l, 0) AS la2, coalesce(a2.q + a2.s, 0) AS ra2, coalesce(b1.q + b1.l, 0) AS lb1, coalesce(b1.q + b1.s, 0) AS rb1, coalesce(b2.q + b2.l, 0) AS lb2, coalesce(b2.q + b2.s, 0) AS rb2,
    coalesce(1.25 * a1.q, 0) AS ta1, coalesce(1.25 * a2.q, 0) AS ta2, coalesce(1.25 * b1.q, 0) AS tb1, coalesce(1.25 * b2.q, 0) AS tb2
    FROM k LEFT JOIN f o ON o.sample = k.sample AND o.event = 'j' || CAST(p AS VARCHAR) LEFT JOIN f a1 ON a1.sample = k.sample AND a1.event = 'j' || CAST(p AS VARCHAR)
    LEFT JOIN f a2 ON a2.sample = k.sample AND a2.event = 'j' || CAST(p + 1 AS VARCHAR) AND kind IN ('SE', 'MXE') LEFT JOIN f b1 ON b1.sample = k.sample AND b1.event = 'j' || CAST(p + 2 AS VARCHAR) AND kind <> 'IR' LEFT JOIN f b2 ON b2.sample = k.sample AND b2.event = 'j' || CAST(p + 3 AS VARCHAR) AND kind = 'MXE'),
  c AS (SELECT *, CASE WHEN ret THEN d ELSE a1 END AS c1a, CASE WHEN ret THEN CASE WHEN strand = '-' THEN sr ELSE sl END ELSE a2 END AS c2a, b1 AS c1b, CASE WHEN ret THEN CASE WHEN strand = '-' THEN sl ELSE sr END ELSE b2 END AS c2b,
    CASE WHEN strand = '-' THEN ra1 ELSE la1 END AS ua, CASE WHEN strand = '-' THEN la1 ELSE ra1 END AS da, CASE WHEN strand = '-' THEN la2 ELSE ra2 END AS da2, CASE WHEN strand = '-' THEN rb1 ELSE lb1 END AS ub, CASE WHEN strand = '-' THEN lb1 ELSE rb1 END AS db, CASE WHEN strand = '-' THEN lb2 ELSE rb2 END AS db2 FROM a),
  g AS (SELECT *, CASE WHEN kind IN ('AFE', 'ALE', 'A5SS', 'A3SS') THEN ub ELSE ua END AS up, CASE WHEN kind IN ('AFE', 'ALE', 'A5SS', 'A3SS') THEN db WHEN kind = 'SE' THEN da2 WHEN kind = 'MXE' THEN db2 ELSE da END AS down,
    CASE WHEN kind IN ('MXE', 'SE', 'ALE', 'A3SS', 'RI') THEN c1a + c1b ELSE 0 END AS pu, CASE WHEN kind = 'MXE' THEN c2a + c2b WHEN kind = 'SE' THEN c2a + c1b WHEN kind IN ('AFE', 'A5SS', 'RI') THEN c1a + c1b ELSE 0 END AS pd FROM c),
  h AS (SELECT *, CASE WHEN up > 0 THEN pu / up ELSE 0 END AS cu, CASE WHEN down > 0 THEN pd / down ELSE 0 END AS cd, greatest(ta1, tb1) AS one FROM g),
  x AS (SELECT *, CASE WHEN kind = 'SE' THEN greatest(tb1, ta2) WHEN kind = 'MXE' THEN greatest(ta2, tb2) ELSE one END AS two FROM h)"""


def _event_facts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts as events, whose junctions are the parts that follow; what lineitem has of a part counts for its junction."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    name = lambda c: F.concat(F.lit("j"), c.cast("string"))
    f = lines.groupBy(F.col("o_orderpriority").alias("sample"), name(F.col("l_partkey")).alias("event")).agg(F.sum("l_quantity").cast("double").alias("q"), F.sum("l_linenumber").cast("double").alias("l"), F.sum(F.col("l_suppkey") % 50).cast("double").alias("s"), F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.round(F.col("l_tax") * 100)).cast("double").alias("t"))
    f = settle(f)
    junctions = f.select("sample", "event", F.col("q").alias("count"), (F.col("q") + F.col("l")).alias("over_left"), (F.col("q") + F.col("s")).alias("over_right"))
    introns = f.select("sample", F.col("event").alias("event_region"), (F.col("t") / 10).alias("depth"), (F.col("t") / 100).alias("coverage"), (F.col("q") * 0.7).alias("splice_over"), (F.col("q") * 0.5).alias("splice_max"), (F.col("q") * 1.25).alias("total_depth"), (F.col("n") * 3).alias("span_left"), (F.col("n") * 2).alias("span_right"))
    p = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("IR", "MXE", "SE", "A3SS", "A5SS", "AFE", "ALE", "RI"))), (p % 8 + 1).cast("int"))
    events = table(spark, sf, "part").select(F.concat(F.lit("e"), p.cast("string")).alias("event_name"), kind.alias("event_type"), F.when(p % 3 == 0, "-").otherwise("+").alias("strand"), name(p).alias("event_region"), name(p).alias("event1a"), F.when(kind.isin("SE", "MXE"), name(p + 1)).alias("event2a"), F.when(kind != "IR", name(p + 2)).alias("event1b"), F.when(kind == "MXE", name(p + 3)).alias("event2b"))
    return events, junctions, introns


_CELL = ("included", "excluded", "depth", "coverage", "min_depth", "up_inc", "down_inc", "up_exc", "down_exc")


@query(_FACTS + """ SELECT sample, event_name, round(CASE WHEN kind IN ('SE', 'MXE') THEN 0.5 * (c1a + c2a) ELSE c1a END, 6) AS included, round(CASE WHEN kind = 'IR' THEN sov WHEN kind = 'MXE' THEN 0.5 * (c1b + c2b) ELSE c1b END, 6) AS excluded,
    round(CASE WHEN tot >= 0 THEN tot ELSE greatest(one, two, up, down) END, 6) AS depth, round(CASE WHEN ret THEN cov WHEN kind IN ('MXE', 'SE') THEN least(cu, cd) WHEN kind IN ('ALE', 'A3SS') THEN cu ELSE cd END, 6) AS coverage,
    round(CASE WHEN kind = 'IR' THEN d WHEN kind IN ('MXE', 'SE') THEN CASE WHEN cu < cd THEN up ELSE down END WHEN kind IN ('ALE', 'A3SS', 'RI') THEN up ELSE down END, 6) AS min_depth,
    CASE WHEN ret THEN c2a WHEN kind IN ('MXE', 'SE') THEN c1a END AS up_inc, CASE WHEN ret THEN c2b WHEN kind IN ('MXE', 'SE') THEN c2a END AS down_inc, CASE WHEN kind = 'MXE' THEN c1b END AS up_exc, CASE WHEN kind = 'MXE' THEN c2b END AS down_exc FROM x""")
def event_cells(spark: SparkSession, sf: str) -> DataFrame:
    """All assays and partial assays of events of the eight kinds."""
    return rounded(qt.event_cells(*_event_facts(spark, sf)).select("sample", "event_name", *_CELL), *_CELL)


_JC = """WITH p AS (SELECT *, pos + m1 AS j1, pos + m1 + n1 AS k1, CASE WHEN n2 > 0 THEN m2 ELSE m2 + m3 END AS w2, pos + m1 + n1 + m2 AS j2, pos + m1 + n1 + m2 + n2 AS k2, CAST(flag = 0 AS BIGINT) AS plus FROM reads),
  x AS (SELECT sample, chrom, plus, j1 AS s, k1 AS e FROM p WHERE m1 >= 5 AND w2 >= 5 UNION ALL SELECT sample, chrom, plus, j2, k2 FROM p WHERE n2 > 0 AND m2 >= 5 AND m3 >= 5),
  jc AS (SELECT sample, chrom, s, e, CASE WHEN s % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(count(*) AS DOUBLE) AS count FROM x GROUP BY ALL)"""


def _junctions(spark: SparkSession, sf: str) -> DataFrame:
    from isoframe.operators import reads as rd

    jc = rd.junction_counts(rd.fragments(alignments(spark, sf)))
    return jc.withColumns({"strand": F.when(F.col("start") % 2 == 0, "+").otherwise("-"), "count": F.col("total").cast("double")})


@query(_JC + "SELECT chrom, s AS start, e AS \"end\", CAST(count_if(count > 0) AS BIGINT) AS samples, CAST(count_if(count >= 2) AS BIGINT) AS samples_over FROM jc GROUP BY ALL", "reads")
def junction_prevalence(spark: SparkSession, sf: str) -> DataFrame:
    return qt.prevalence(_junctions(spark, sf), 2)


@query(_JC + "SELECT DISTINCT chrom, s AS start, e AS \"end\", strand FROM jc", "reads")
def junctions_of_all_samples(spark: SparkSession, sf: str) -> DataFrame:
    return qt.junction_union(_junctions(spark, sf))


@query(_JC + "SELECT sample, chrom, s AS start, e AS \"end\", sum(count) OVER (PARTITION BY sample, chrom, strand, s) AS splice_left, sum(count) OVER (PARTITION BY sample, chrom, strand, e) AS splice_right FROM jc", "reads")
def splice_left_right(spark: SparkSession, sf: str) -> DataFrame:
    counts = _junctions(spark, sf).withColumns({"jg_up": F.lit(None).cast("string"), "jg_down": F.lit(None).cast("string")})
    return qt.splice_over(counts).select("sample", "chrom", "start", "end", "splice_left", "splice_right")


@query(
    _JC
    + """, j AS (SELECT *, s // 500 AS up, e // 500 AS down FROM jc),
  i AS (SELECT a.sample, a.chrom, a.s, a.e, sum(b.count) AS inside FROM j a JOIN j b ON a.sample = b.sample AND a.chrom = b.chrom AND a.up = b.up AND a.strand = b.strand AND a.s <= b.e AND b.s <= a.e WHERE a.up = a.down AND b.up = b.down GROUP BY ALL),
  o AS (SELECT j.*, coalesce(inside, 0) AS inside, sum(count) OVER (PARTITION BY sample, chrom, strand, s) AS sl, sum(count) OVER (PARTITION BY sample, chrom, strand, e) AS sr,
    sum(CASE WHEN up <> down THEN count ELSE 0 END) OVER (PARTITION BY sample, chrom, strand, up) AS cu, sum(CASE WHEN up <> down THEN count ELSE 0 END) OVER (PARTITION BY sample, chrom, strand, down) AS cd FROM j LEFT JOIN i USING (sample, chrom, s, e))
  SELECT sample, chrom, s AS start, e AS "end", greatest(CASE WHEN strand = '-' THEN cd ELSE cu END, inside, sl) AS over_left, greatest(CASE WHEN strand = '-' THEN cu ELSE cd END, inside, sr) AS over_right,
    round(count / greatest(CASE WHEN strand = '-' THEN cd ELSE cu END, CASE WHEN strand = '-' THEN cu ELSE cd END, inside, sl, sr), 6) AS psi FROM o""",
    "reads",
)
def splice_over_and_psi(spark: SparkSession, sf: str) -> DataFrame:
    counts = _junctions(spark, sf).withColumns({"jg_up": F.floor(F.col("start") / 500).cast("string"), "jg_down": F.floor(F.col("end") / 500).cast("string")})
    return rounded(qt.junction_psi(qt.splice_over(counts)).select("sample", "chrom", "start", "end", "over_left", "over_right", "psi"), "psi")
