"""From raw documents to packed training sequences: toxicity, quality rules, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns
of documents. run() writes what a stage returns to the shared folder and reads it back for the next one; what a stage
left there on its way is deleted once its rows are written.

In every stage other columns ride along, whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from isoframe.llm import op2_simhash, op4_packing, op5_toxicity, op6_mixing, op10_rules
from isoframe.llm.common import read_table, shared_dir
from isoframe.sources.store import delete, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of the labels does not call toxic. Null and empty texts stay; without labels all stay."""
    return op5_toxicity.drop_toxic(docs, op5_toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule cascade keeps. Null, empty and wordless texts go; repeated rows are judged alike."""
    return op10_rules.drop_rejected(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the least doc_id (nulls last), then by a hash of the text; repeated rows
    are near-duplicates, and so are null and empty texts."""
    return op2_simhash.drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them, twice at most. A null source is a source; texts without words
    take part; equal rows are taken as often as all of them."""
    return op6_mixing.mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences. A null or empty text is one piece; repeated rows are packed each."""
    return op4_packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL expresses neither the learnt stage nor the hashes, so tests hold the stages against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the whole documents table."""
    base = f"{shared_dir(spark)}/pipeline-{uuid4().hex}"
    docs, written = read_table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if written is not None:  # only this stage needed it
            delete(spark, written)
        docs, written = spark.read.parquet(path), path
    return docs
