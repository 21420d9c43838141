"""Rows by key and by rank without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mergeloom.session import cut

#: Bits of the hash that name a bin of `distributed_rank`; a group of n rows has bins of about n / 4096.
BIN_BITS = 12


def first_arrival(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the least by `order`, then by the values themselves.

    The least row is found by partial aggregation, so a key with very many rows needs no single
    task. NULL sorts first. NULL keys form one key like any other value. Columns must be orderable.
    """
    kept = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    one = df.groupBy(*[F.col(k) for k in keys]).agg(F.min(kept).alias("__kept"))
    return one.select(*keys, *[F.col(f"__kept.c{i}").alias(c) for i, c in enumerate(columns)])


def distributed_rank(df: DataFrame, groups: Sequence[str], ident: Sequence[str], seed: int, name: str = "rank") -> DataFrame:
    """Add the rank, from 0, of every row in its group by a seeded hash of `ident`, ties by `ident`.

    Exact for groups of any size: rows are counted by group and hash bin, the counts summed over
    the few bins, and only the rows of one bin are sorted together.
    """
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in ident])
    rows = df.withColumn("__h", h).withColumn("__bin", F.shiftrightunsigned(F.col("__h"), 64 - BIN_BITS).cast("int"))
    bins = rows.groupBy(*groups, "__bin").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bins.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__bin").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    same = F.col("__bin") == F.col("__b")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    inside = Window.partitionBy(*groups, "__bin").orderBy("__h", *ident)
    joined = rows.join(offsets, same).withColumn(name, F.col("__off") + F.row_number().over(inside) - 1)
    return joined.select(*df.columns, name)


def running_sum(df: DataFrame, order: Sequence[str], value: str, name: str, groups: Sequence[str] = ()) -> DataFrame:
    """Add the sum of `value` up to and with each row in the order of `order`, over the whole table or within each group.

    Rows are put into ranges of the order; sums of whole ranges, one row per partition and group,
    are added up first, and only rows of one range are sorted together. `order` should be unique.
    """
    placed = cut(df.repartitionByRange(*groups, *order).withColumn("__part", F.spark_partition_id()))
    sums = placed.groupBy(*groups, "__part").agg(F.sum(value).alias("__s"))
    before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__part").alias("__p"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__off"))
    same = F.col("__part") == F.col("__p")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    inside = Window.partitionBy(*groups, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(offsets, same).withColumn(name, F.col("__off") + F.sum(value).over(inside))
    return joined.select(*df.columns, name)
