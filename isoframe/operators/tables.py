"""Joins and picks with first- and last-match semantics, made deterministic by an explicit order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoframe.sources.store import settle

Order = Sequence[str | Column]


def _reverse(order: Order) -> list[Column]:
    return [F.desc_nulls_last(c) if isinstance(c, str) else c for c in order]


def unique_first(df: DataFrame, by: Sequence[str], order: Order) -> DataFrame:
    """The first row of each key in the order given."""
    ranked = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where("_nth = 1").drop("_nth")


def unique_last(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in the order of the columns given."""
    return unique_first(df, by, _reverse(order))


def first_match_join(left: DataFrame, right: DataFrame, on: Sequence[str], order: Order) -> DataFrame:
    """Every row of left once, with the columns of the first right row of its key, or nulls."""
    return left.join(unique_first(right, on, order), list(on), "left")


def last_match_join(left: DataFrame, right: DataFrame, on: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Every row of left once, with the columns of the last right row of its key, or nulls."""
    return left.join(unique_last(right, on, order), list(on), "left")


def update_columns(left: DataFrame, right: DataFrame, on: Sequence[str], columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """An update join: where the key is in right, columns of left take the values of its last row there, nulls included."""
    hit = unique_last(right, on, order).select(*on, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = left.join(hit, list(on), "left")
    kept = [F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in left.columns]
    return joined.select(*kept, *[F.col(f"_new_{c}").alias(c) for c in columns if c not in left.columns])


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A full outer merge by key in which new values win where they are not null."""
    columns = list(dict.fromkeys(old.columns + new.columns))
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    pick = lambda c: F.coalesce(*[F.col(f"{t}.{c}") for t, df in (("n", new), ("o", old)) if c in df.columns])
    return joined.select(*[pick(c).alias(c) for c in columns])


def all_pairs(df: DataFrame, by: Sequence[str], rank: Order, key: str) -> DataFrame:
    """Ordered pairs of different keys within a group: columns *_a come before *_b in rank.

    One equi-join on the group with a rank condition. Groups are splice sites or skipped regions, whose members are the
    introns annotated there.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*rank)))
    side = lambda s: ranked.select(*by, *[F.col(c).alias(f"{c}_{s}") for c in ranked.columns if c not in by])
    return side("a").join(side("b"), list(by)).where((F.col("_rank_a") < F.col("_rank_b")) & (F.col(f"{key}_a") != F.col(f"{key}_b"))).drop("_rank_a", "_rank_b")


def number_rows(df: DataFrame, by: Sequence[str], order: Order, name: str) -> DataFrame:
    """A 1-based counter within groups."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def number_all(df: DataFrame, order: Order, name: str = "position") -> DataFrame:
    """All rows numbered from 1 in the order given. Rows are dealt to ranges of the order and numbered within; what comes before a
    range is one sum. Rows alike in order keep the numbers that they are dealt once."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = settle(df.repartitionByRange(*columns).sortWithinPartitions(*columns).select("*", F.monotonically_increasing_id().alias("_id")).withColumn("_range", F.shiftright("_id", 33)))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # one row a range
    # An id counts from 0 within its range.
    number = F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1
    return dealt.join(F.broadcast(sizes), "_range").withColumn(name, number).drop("_range", "_id", "_before")


def sums_before(df: DataFrame, order: Order, columns: Sequence[str]) -> DataFrame:
    """Each of `columns` becomes the sum over the rows that come before in the order given, 0 for the first. Rows are dealt to
    ranges of the order; what comes before a range is one row of sums."""
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = settle(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_s{i}") for i, c in enumerate(columns)])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sums = sums.select("_range", *[F.coalesce(F.sum(f"_s{i}").over(earlier), F.lit(0)).alias(f"_b{i}") for i in range(len(columns))])
    inside = Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumns({f"_w{i}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for i, c in enumerate(columns)}).join(F.broadcast(sums), "_range")
    return summed.select(*[(F.col(f"_w{columns.index(c)}") + F.col(f"_b{columns.index(c)}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def look_up(x: DataFrame, y: DataFrame, on: Sequence[str], y_order: Order, x_order: Order) -> DataFrame:
    """X[Y]: every row of y in y's order, once for each row of x of its key in x's order, or once with nulls in x's columns.

    Columns: position (of y's row, from 1), `on`, the others of y, the others of x; those with a name that y has too get the suffix
    _x. A null key has no match. The position goes through the join, and the result is sorted by it over ranges, so that its
    partitions, read one after the other, are in order.
    """
    rest = {c: c if c not in y.columns else f"{c}_x" for c in x.columns if c not in on}
    placed = number_all(y, y_order)
    xs = x.select(*on, *[F.col(c).alias(n) for c, n in rest.items()], F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(x_order)]).alias("_nth"))
    met = placed.join(xs, list(on), "left")
    out = met.repartitionByRange("position", "_nth").sortWithinPartitions("position", "_nth")
    return out.select("position", *on, *[c for c in y.columns if c not in on], *rest.values())


def write_in_order(df: DataFrame, path: str, order: Order) -> None:
    """Rows written as Parquet so that the part files, by name, hold ranges of the order one after the other, each sorted."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    df.repartitionByRange(*columns).sortWithinPartitions(*columns).write.mode("overwrite").parquet(path)


def as_of_join(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, columns: Sequence[str]) -> DataFrame:
    """Every row of left once, with `columns` of the right row of its key that is last at or before its time, or nulls.

    Of right rows at one time the greatest by `columns` counts. Both tables meet in one sort by key and time; a null time
    has no match.
    """
    value = F.struct(*[F.col(c).alias(f"_as_of_{c}") for c in columns])
    events = right.where(F.col(at).isNotNull()).groupBy(*by, at).agg(F.max(value).alias("_value")).withColumn("_left", F.lit(None))
    rows = left.select(*by, at, F.struct(*left.columns).alias("_left")).withColumn("_value", F.lit(None))
    both = events.select(*by, at, "_value", "_left").unionByName(rows)
    w = Window.partitionBy(*by).orderBy(F.col(at).asc_nulls_first(), F.col("_left").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_found", F.last("_value", ignorenulls=True).over(w)).where("_left is not null")
    return met.select("_left.*", *[F.col(f"_found._as_of_{c}").alias(c if c not in left.columns else f"{c}_right") for c in columns])
