"""Mixing sources to target weights by the cube method (Deville and Tille, 2004).

Every document of a source is due target/size copies on average: a whole number for all, and a fraction that the
sample settles. The flight phase moves the fractions of three documents at a time along the null space of the two
balancing equations (documents, words) until one of them is settled (Chauvet and Tille, 2006), which leaves two open
at most. It runs in buckets of a bounded number of documents, then over what the buckets left open, until one bucket
holds what is left of a source; the landing phase settles those one or two so that the words miss the target least.
Rows alike in every column are one unit of the sample with as many copies due as all of them; units are dealt to buckets
by hashes of doc_id and of the row, so that no id, null included, is a bucket, and a rerun agrees at any partitioning.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isoframe.llm.common import cut, read_table, row_hash

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BUCKET_ROWS = 4096
WORD = r"[^\x20\x09-\x0D]+"
EPS = 1e-9


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, n) from rows of (source, size, times); n counts the units.

    Sources by code point, null last, weigh 3, 1, 2, repeating. Targets share SHARE of all sizes by weight; where one
    would exceed MOST times its source's size it stops there and the rest is shared again, which is filling to a level.
    """
    total = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).cast("long").alias("source_size"), F.count(F.lit(1)).alias("n"))
    # One row for each source from here on; the windows see no documents.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    filled = total.select("*", weight.alias("weight"), (F.lit(MOST) * F.col("source_size")).alias("most"))
    filled = filled.withColumn("stop", F.col("most") / F.col("weight"))
    below = Window.orderBy("stop", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("stop", F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    filled = filled.withColumn("level", (F.lit(SHARE) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(below), F.lit(0.0))) / F.sum("weight").over(after))
    level = F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "level"))).over(everything)["level"]
    return filled.select("source", "source_size", "n", F.coalesce(F.least(F.col("most"), F.col("weight") * level), F.col("most")).alias("target"))


def flight(size: list[float], x: list[float], draw) -> list[int]:
    """Settle fractions in x in place; the open ones, two at most, are returned. draw() gives uniform numbers."""
    open_: list[int] = []
    for k in range(len(x)):
        if EPS < x[k] < 1 - EPS:
            open_.append(k)
        else:
            x[k] = float(round(x[k]))
        if len(open_) == 3 or len(open_) == 2 and size[open_[0]] == size[open_[1]]:
            a, b = open_[0], open_[1]
            if size[a] == size[b]:
                way = ((a, 1.0), (b, -1.0))
            else:
                c = open_[2]
                way = ((a, size[c] - size[b]), (b, size[a] - size[c]), (c, size[b] - size[a]))
            up = min((1 - x[i]) / u if u > 0 else x[i] / -u for i, u in way if u)
            down = min(x[i] / u if u > 0 else (1 - x[i]) / -u for i, u in way if u)
            step = up if draw() * (up + down) < down else -down
            for i, u in way:
                x[i] += step * u
                if not EPS < x[i] < 1 - EPS:
                    x[i] = float(round(x[i]))
                    open_.remove(i)
    return open_


def landing(size: list[float], x: list[float], open_: list[int], draw) -> None:
    """Settle the open fractions so that words, then documents, differ least from what is due."""
    best = min(product((0.0, 1.0), repeat=len(open_)), key=lambda v: (abs(sum(size[k] * (y - x[k]) for k, y in zip(open_, v, strict=True))), abs(sum(y - x[k] for k, y in zip(open_, v, strict=True))), draw()))
    for k, y in zip(open_, best, strict=True):
        x[k] = y


def _settle(units: DataFrame, level: int) -> DataFrame:
    """One round of flights over buckets; sources that have one bucket land. Adds what is open to the next round."""

    def run(table: pa.Table) -> pa.Table:
        size, x = table.column("size").to_pylist(), table.column("x").to_pylist()
        ids = table.column("order").to_numpy()
        order = np.lexsort((table.column("row_hash").to_numpy(), table.column("size").to_numpy(), ids)).tolist()
        s, y = [size[i] for i in order], [x[i] for i in order]
        rng = np.random.Generator(np.random.Philox([int(ids.view(np.uint64).sum(dtype=np.uint64)), len(s), level]))
        rest = flight(s, y, rng.random)
        if table.column("buckets")[0].as_py() == 1:
            landing(s, y, rest, rng.random)
        for i, v in zip(order, y, strict=True):
            x[i] = v
        return table.set_column(table.schema.get_field_index("x"), "x", pa.array(x, pa.float64()))

    buckets = F.ceil(F.col("left") / F.lit(BUCKET_ROWS)).cast("long")
    dealt = units.withColumn("buckets", F.greatest(buckets, F.lit(1))).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row_hash", F.lit(level)), F.col("buckets"))).withColumn("order", F.xxhash64("doc_id", "row_hash", F.lit(f"order {level}")))
    schema = "doc_id long, row_hash long, source string, size long, times long, source_size long, target double, whole long, x double, left long, buckets long, bucket long, order long"
    return dealt.groupBy("source", "bucket").applyInArrow(run, schema).drop("order", "bucket")


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _settled(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, size, source_size, target, times, total): units of `times` equal rows and the copies of all of them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs.schema).alias("row_hash"), F.col("source").cast("string").alias("source"), _size().alias("size"))
    sizes = cut(rows.groupBy("doc_id", "row_hash", "source", "size").agg(F.count(F.lit(1)).alias("times")))
    targets = cut(source_targets(sizes))
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * F.col("times")
    t = targets.withColumnRenamed("source", "of")
    units = sizes.join(t, sizes.source.eqNullSafe(t.of)).drop("of").withColumn("whole", F.floor(due + F.lit(EPS)))
    units = units.withColumn("x", F.greatest(due - F.col("whole"), F.lit(0.0))).withColumnRenamed("n", "left")
    units = units.select("doc_id", "row_hash", "source", "size", "times", "source_size", "target", "whole", "x", "left")
    most = targets.agg(F.max("n")).first()[0] or 0
    done: list[DataFrame] = []
    level = 0
    while True:
        settled = _settle(units, level)
        if most <= BUCKET_ROWS:
            done.append(settled.drop("left", "buckets"))
            break
        settled = cut(settled)
        still = (F.col("x") > EPS) & (F.col("x") < 1 - EPS)
        done.append(settled.where(~still).drop("left", "buckets"))
        # A bucket leaves two open at most, so the next round is smaller by half a bucket's size.
        most = 2 * math.ceil(most / BUCKET_ROWS)
        units = settled.where(still).withColumn("left", 2 * F.col("buckets")).drop("buckets")
        level += 1
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    return rows.select("doc_id", "row_hash", "size", "source_size", "target", "times", (F.col("whole") + F.round("x").cast("long")).cast("long").alias("total"))


def _counted(df: DataFrame, count: str, name: str) -> DataFrame:
    """Each row as often as its count says, numbered from 0; no array is longer than the square root of a count or so."""
    n = F.col(count).cast("long")
    blocks = df.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / BUCKET_ROWS))).alias("_block"))
    first = F.col("_block") * BUCKET_ROWS
    return blocks.select("*", F.explode(F.sequence(first, F.least(first + BUCKET_ROWS, n) - 1)).alias(name)).drop("_block")


def mix(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken, copies (how often the mix has it).

    size counts words between ASCII white space (null text: 0). A null source is a source of its own, the last. Repeated
    rows share the copies due to all of them evenly; rows with a null doc_id are documents of their own. A source without
    words has target 0. Other columns of docs tell rows apart and are not returned. An empty table gives no rows.
    """
    # The copies of a unit are dealt to its rows as evenly as can be.
    rows = _counted(_settled(docs), "times", "k")
    each, more = F.floor(F.col("total") / F.col("times")), F.col("total") % F.col("times")
    rows = rows.withColumn("copies", (each + F.when(F.col("k") < more, 1).otherwise(0)).cast("long"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, each as often as the mix takes it.

    Null texts have no words but take part; repeated rows are as one that is taken as often as all of them; rows with a
    null doc_id are told apart by their other columns. An empty table gives an empty one.
    """
    taken = cut(_settled(docs).where("total > 0").select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.col("row_hash").alias("_hash"), "times", "total"))
    rows = docs.select(F.struct("*").alias("_row"), row_hash(docs.schema).alias("_hash"))
    rows = rows.select("_row", F.coalesce(F.col("_row.doc_id").cast("long"), F.lit(0)).alias("_id"), F.col("_row.doc_id").isNull().alias("_none"), "_hash")
    key = ["_id", "_none", "_hash"]
    met = rows.join(taken, key)
    once = met.where("times = 1").select("_row", "total")
    if not taken.where("times > 1").isEmpty():
        # Equal rows: one stands for all of them, picked before the shuffle.
        once = once.unionByName(met.where("times > 1").groupBy(*key, "total").agg(F.first("_row").alias("_row")).select("_row", "total"))
    return _counted(once, "total", "_k").select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the whole documents table."""
    return mix(read_table(spark, sf_dir, "documents"))
