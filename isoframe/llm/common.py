"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType

from isoframe.sources.store import settle as cut
from isoframe.sources.store import shared_dir

__all__ = ["cut", "shared_dir", "read_table", "prepare", "map_arrow", "hash_sample", "crc_mod", "row_hash"]

#: Rows of text in one Arrow batch; with documents of a few kB this keeps a batch near a few MB.
TEXT_BATCH_ROWS = 1000
#: Bytes in one Arrow batch, where Spark knows the setting.
TEXT_BATCH_BYTES = 16 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes and rows, so that long texts cannot fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BATCH_BYTES))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow under the batch bounds of prepare(). Columns that it cannot name travel under others, where fn keeps all columns."""
    prepare(df.sparkSession)
    if isinstance(schema, StructType) and schema.names == df.columns and any(c in "".join(df.columns) for c in ".`"):
        plain = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema)])
        return df.toDF(*plain.names).mapInArrow(fn, plain).toDF(*df.columns)
    return df.mapInArrow(fn, schema)


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows, those of the smallest hashes of key: the same ones in each run and at any partitioning.

    Only rows below a threshold on the hash, about two for each one wanted, are sorted.
    """
    draw = F.xxhash64(F.col(key), F.lit("sample"))
    total = df.count()
    if total > 2 * rows + 1000:
        df = df.where(F.shiftright(draw, 1) < int((2 * rows + 1000) / total * 2**63) - 2**62)
    return df.orderBy(draw, F.col(key)).limit(rows)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the decimal text of a column, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def _plain(c: Column, kind: DataType) -> Column:
    """A nested value with its maps, at any depth, as sorted lists of JSON entries."""
    if isinstance(kind, MapType):
        entry = lambda e: F.to_json(F.struct(_plain(e["key"], kind.keyType).alias("k"), _plain(e["value"], kind.valueType).alias("v")), {"ignoreNullFields": "false"})
        return F.array_sort(F.transform(F.map_entries(c), entry))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _plain(x, kind.elementType))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[_plain(c[f.name], f.dataType).alias(f"f{i}") for i, f in enumerate(kind)]))
    return c


def row_hash(schema: StructType, of: str | None = None) -> Column:
    """A hash of all columns (or of all fields of the struct column `of`): which are null, and what the others hold.

    Maps count as sets of entries; null fields and elements count in their places.
    """
    parts = []
    for f in schema:
        c = F.col(of)[f.name] if of else F.col("`" + f.name.replace("`", "``") + "`")
        nested = isinstance(f.dataType, (MapType, ArrayType, StructType))
        parts += [c.isNull(), F.to_json(F.struct(_plain(c, f.dataType).alias("v")), {"ignoreNullFields": "false"}) if nested else c]
    return F.xxhash64(*parts)
