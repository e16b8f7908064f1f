"""Over-representation of gene sets."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from isoframe.functions.coords import strip_version
from isoframe.functions.special import hypergeometric_tail
from isoframe.operators.differential import adjust
from isoframe.sources.store import settle


def normalise_terms(links: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Distinct complete (gene_id, go_id, go_term, ontology)."""
    rows = links if terms is None else links.select("gene_id", "go_id").join(terms.select("go_id", "go_term", "ontology"), "go_id")
    return rows.select("gene_id", "go_id", "go_term", "ontology").na.drop().distinct()


def gene_terms(links: DataFrame, genes: DataFrame, *maps: DataFrame, least: float = 0.1) -> DataFrame:
    """Links by gene_id; if they name less than `least` of the genes, by the first id map (gene_id, other_id) that names enough."""
    wanted = genes.select("gene_id").distinct()
    total = wanted.count()
    for table in (None, *maps):
        mapped = links if table is None else links.withColumnRenamed("gene_id", "other_id").join(table.select("gene_id", "other_id"), "other_id").drop("other_id")
        if wanted.join(mapped.select("gene_id").distinct(), "gene_id", "left_semi").count() >= least * total:
            return mapped
    return links


def genes_of_events(events: DataFrame) -> DataFrame:
    """Distinct genes of events, both of two-gene ones, without novel genes."""
    both = events.select(F.explode(F.array("gene_id", "gene_id_b")).alias("gene_id")).where("gene_id is not null").distinct()
    return both.where(~F.col("gene_id").startswith("novelGene"))


@F.pandas_udf(DoubleType())
def _tail(k: pd.Series, universe: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
    return pd.Series(hypergeometric_tail(k, universe, marked, drawn))


def over_representation(genes: DataFrame, links: DataFrame, universe: DataFrame | None = None, ontology: str | None = None) -> DataFrame:
    """Per term: size, overlap, expected, fold_enrichment, p_value, fdr, by p; genes outside the universe do not count.

    expected = ceil(genes x size / universe), fold_enrichment = overlap / (expected + 0.001) rounded to 2 places.
    """
    rows = links.where(F.col("ontology") == ontology) if ontology else links
    pool = (universe if universe is not None else rows).select("gene_id").distinct()
    rows = rows.select("gene_id", "go_id", "go_term").distinct().join(pool, "gene_id", "left_semi")
    chosen = genes.select("gene_id").distinct().join(pool, "gene_id", "left_semi")
    n_pool, n = pool.count(), chosen.count()
    marked = rows.join(chosen.withColumn("_in", F.lit(1)), "gene_id", "left")
    per = marked.groupBy("go_id", "go_term").agg(F.count(F.lit(1)).alias("size"), F.coalesce(F.sum("_in"), F.lit(0)).alias("overlap")).where("overlap > 0")
    expected = F.ceil(F.lit(n) * F.col("size") / F.lit(max(n_pool, 1)))
    per = per.withColumns({"expected": expected.cast("long"), "fold_enrichment": F.round(F.col("overlap") / (expected + 0.001), 2)})
    # One row a term, which the adjustment reads twice.
    per = settle(per.withColumn("p_value", _tail("overlap", F.lit(n_pool).cast("long"), "size", F.lit(n).cast("long"))))
    return adjust(per).orderBy("p_value", "go_id")


def enrich_events(events: DataFrame, links: DataFrame, background: DataFrame | None = None, id_maps: Sequence[DataFrame] = (), versions: bool = False, **options) -> DataFrame:
    """over_representation of the genes of events, against those of background events.

    id_maps: tables (gene_id, other_id) for links by other ids, of which the first that names enough genes is used.
    versions: whether gene ids carry Ensembl-style versions, which are cut.
    """
    plain = lambda df: df.select(plain_gene_id().alias("gene_id")).distinct() if versions else df
    found = plain(genes_of_events(events))
    pool = plain(genes_of_events(background)) if background is not None else None
    return over_representation(found, gene_terms(links, found if pool is None else pool, *id_maps), pool, **options)


def events_of_term(events: DataFrame, links: DataFrame, go_id: str) -> DataFrame:
    """Events of which either gene is in a term."""
    genes = links.where(F.col("go_id") == go_id).select("gene_id").distinct()
    a = events.join(genes, "gene_id", "left_semi")
    b = events.join(genes.withColumnRenamed("gene_id", "gene_id_b"), "gene_id_b", "left_semi").select(*events.columns)
    return a.unionByName(b).distinct()


def display(results: DataFrame, terms: int = 20, longest: int = 50) -> DataFrame:
    """The first terms by p with short names and -log10 p."""
    name = F.when(F.length("go_term") > longest, F.concat(F.substring("go_term", 1, longest), F.lit("..."))).otherwise(F.col("go_term"))
    return results.orderBy("p_value", "go_id").limit(terms).withColumns({"label": name, "score": -F.log10("p_value")})


def plain_gene_id(gene_id: str | Column = "gene_id") -> Column:
    return strip_version(gene_id)
