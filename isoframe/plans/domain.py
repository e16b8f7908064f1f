"""The driver's tables read as splicing data: the same views as DataFrames and as SQL.

lineitem is a set of stranded intervals, orders a set of annotated ones, customers are transcripts whose orders are
exons, parts are events whose included and excluded reads lineitem counts for the samples that order priorities name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Views as SQL that Spark and DuckDB both run; a query names those it needs.
VIEWS = {
    "intervals": """
        SELECT l_returnflag AS chrom, l_orderkey * 40 + l_linenumber * 7 AS start,
          l_orderkey * 40 + l_linenumber * 7 + CAST(l_quantity AS BIGINT) AS "end",
          CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, l_partkey, l_suppkey
        FROM lineitem""",
    "genes": """
        SELECT CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END AS chrom, o_orderkey * 40 AS start,
          o_orderkey * 40 + o_custkey % 90 + CASE WHEN o_custkey % 50 = 0 THEN 4000 ELSE 0 END AS "end",
          CASE WHEN o_orderpriority LIKE '1%' THEN '*' WHEN o_orderpriority < '4' THEN '+' ELSE '-' END AS strand, o_orderkey AS gene
        FROM orders""",
    "exons": """
        SELECT o_custkey AS transcript, 'c' || CAST(o_custkey % 7 AS VARCHAR(9)) AS chrom, o_orderkey * 40 AS start,
          o_orderkey * 40 + 200 + CAST(floor(o_totalprice) AS BIGINT) % 90 AS "end",
          CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand, o_orderkey
        FROM orders""",
    "reads": """
        SELECT o_orderpriority AS sample, l_returnflag AS chrom, l_orderkey * 40 + l_linenumber * 7 AS pos,
          CASE WHEN l_linestatus = 'O' THEN 0 ELSE 16 END AS flag,
          CAST(l_quantity AS BIGINT) % 12 + 2 AS m1, l_linenumber * 10 AS n1, l_partkey % 9 + 2 AS m2, l_suppkey % 5 * 20 AS n2, l_suppkey % 11 + 1 AS m3
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "pairs": """
        SELECT o_orderpriority AS sample, 'q' || CAST(l_orderkey AS VARCHAR(20)) || '.' || CAST(l_linenumber AS VARCHAR(9)) || '.' || CAST(l_partkey AS VARCHAR(20)) || '.' || CAST(l_suppkey AS VARCHAR(20)) AS qname,
          l_returnflag AS chrom, l_orderkey * 40 AS pos1, CAST(l_quantity AS BIGINT) + 20 AS w1, l_orderkey * 40 + l_suppkey % 90 - 10 AS pos2, l_partkey % 40 + 20 AS w2,
          CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS plus
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "model": """
        SELECT o_custkey AS transcript, 'g' || CAST(CAST(floor(o_custkey / 7) AS BIGINT) AS VARCHAR(20)) AS gene_id, 'c' || CAST(CAST(floor(o_custkey / 7) AS BIGINT) % 7 AS VARCHAR(9)) AS chrom, o_orderkey * 40 AS start,
          o_orderkey * 40 + 200 + CAST(floor(o_totalprice) AS BIGINT) % 90 AS "end",
          CASE WHEN CAST(floor(o_custkey / 7) AS BIGINT) % 2 = 0 THEN '+' ELSE '-' END AS strand,
          CASE WHEN o_custkey % 7 = 3 THEN 'retained_intron' ELSE 'protein_coding' END AS biotype
        FROM orders""",
    "library": """
        SELECT 's' || CAST(o_custkey AS VARCHAR(20)) AS sample, CAST(sum(CASE WHEN o_custkey % 4 = 0 THEN 0 ELSE o_orderkey % 3 END) AS BIGINT) AS singles,
          CAST(sum(CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE o_orderkey % 29 END) AS BIGINT) AS pairs, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS nucleotides,
          CAST(min(o_custkey) % 3 - 1 AS INTEGER) AS direction
        FROM orders GROUP BY o_custkey""",
    "lines": """
        SELECT o_orderpriority AS sample, 'c' || CAST(l_orderkey % 3 AS VARCHAR(9)) AS chrom, l_orderkey * 40 + l_linenumber * 7 AS start,
          l_orderkey * 40 + l_linenumber * 7 + CAST(l_quantity AS BIGINT) AS "end", CASE l_suppkey % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '*' END AS strand,
          l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n, l_partkey AS part, l_suppkey AS supp, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount * 100) AS BIGINT) AS discount, o_custkey AS cust
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "assay": """
        SELECT l_partkey AS event, o_orderpriority AS sample,
          CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS DOUBLE) AS included,
          CAST(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END) AS DOUBLE) AS excluded
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS as a DataFrame."""
    sql = VIEWS[name].replace('"end"', "`end`")
    frames = {t: table(spark, sf_dir, t) for t in ("lineitem", "orders") if t in sql}
    for t in frames:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(sql, **frames)


def with_views(sql: str, *names: str) -> str:
    """SQL over the views it names, for the oracle."""
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = sql.lstrip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{views}, {body[len(start):]}"
    return f"WITH {views}\n{sql}"


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})
