"""Percentiles of very large columns from mergeable counts in signed logarithmic buckets."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergeloom.session import cut

#: Relative error of a percentile.
ALPHA = 0.01
#: Groups with more than one row in HOT are dealt to SALTS places.
HOT, SALTS = 200, 64
#: Asked buckets (some 50 bytes each) that are broadcast; more are joined by merging.
BROADCAST_BUCKETS = 100_000
#: Added to a bucket's number so that those of positive values are positive; doubles need less.
SHIFT = 1 << 24


def bucket_of(value: Column, alpha: float = ALPHA) -> Column:
    """The signed bucket of a number: 0 for 0, growing with the value. NULL and NaN have none.

    Bucket i > 0 holds gamma^(i - SHIFT - 1) < v <= gamma^(i - SHIFT), gamma = (1 + alpha) / (1 - alpha);
    negative values mirror it.
    """
    v = value.cast("double")
    i = (F.ceil(F.log(F.abs(v)) / F.lit(math.log((1 + alpha) / (1 - alpha)))) + F.lit(SHIFT)).cast("bigint")
    return F.when(v == 0, F.lit(0).cast("bigint")).when((v > 0) & ~F.isnan(v), i).when(v < 0, -i)


def value_of(bucket: Column, alpha: float = ALPHA) -> Column:
    """A value within alpha of everything in the bucket."""
    gamma = (1 + alpha) / (1 - alpha)
    size = F.lit(2 / (gamma + 1)) * F.pow(F.lit(gamma), (F.abs(bucket) - F.lit(SHIFT)).cast("double"))
    return F.when(bucket == 0, F.lit(0.0)).otherwise(F.signum(bucket.cast("double")) * size)


def sketch(df: DataFrame, groups: Sequence[str], value: str, alpha: float = ALPHA) -> DataFrame:
    """Columns (groups, bucket, n, least, most): bucket counts, which add up over days and partitions.

    NULL and NaN values are left out. Counting is partial before the shuffle, so a group that holds
    a third of all rows sends no more than its few thousand buckets per task.
    """
    rows = df.select(*groups, F.col(value).cast("double").alias("__v")).withColumn("bucket", bucket_of(F.col("__v"), alpha)).where("bucket is not null")
    return rows.groupBy(*groups, "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("least"), F.max("__v").alias("most"))


def distinct_by_group(df: DataFrame, groups: Sequence[str], ident: str) -> DataFrame:
    """Distinct rows, those of a group lying together, so that a group's buckets are counted before they are shuffled.

    A group that holds more than one row in HOT, of which there are fewer than HOT, is dealt to
    SALTS places by a hash of `ident`.
    """
    counts = cut(df.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n")))
    total = counts.agg(F.sum("__n")).head()[0] or 0
    hot = counts.where(F.col("__n") * HOT > total)
    same = None
    for i, g in enumerate(groups):
        one = F.col(g).eqNullSafe(F.col(f"__g{i}"))
        same = one if same is None else same & one
    marked = F.broadcast(hot.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.lit(True).alias("__hot")))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(ident), F.lit(SALTS))).otherwise(F.lit(0).cast("bigint"))
    rows = df.join(marked, same, "left").select(*df.columns, salt.alias("__salt"))
    return rows.repartition(*groups, "__salt").dropDuplicates([*df.columns, "__salt"]).select(*df.columns)


def merge(sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Sketches put together: counts of the same bucket are added."""
    return sketches.groupBy(*groups, "bucket").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def percentiles(sketches: DataFrame, groups: Sequence[str], wanted: Mapping[str, int], alpha: float = ALPHA) -> DataFrame:
    """Columns (groups, n, and per wanted percentile p: p, p_low, p_high, p_bucket, p_below).

    The nearest rank of percent q among n values is ceil(q n / 100), in integers. `p` is within
    alpha (that of the sketch) of the exact value, which lies between `p_low` and `p_high`, the least and the greatest
    value counted in its bucket; `p_below` values lie in lower buckets. A group has at most about
    2 * log(range) / (2 alpha) buckets, whatever the number of values.
    """
    whole = Window.partitionBy(*groups)
    upto = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = sketches.select(*groups, "bucket", "n", "least", "most").withColumn("upto", F.sum("n").over(upto)).withColumn("all_n", F.sum("n").over(whole))
    out = []
    for name, q in wanted.items():
        rank = F.floor((F.lit(q) * F.col("all_n") + 99) / 100)
        here = (F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)
        out += [F.max(F.when(here, F.col(c))).alias(f"{name}_{s}") for c, s in (("least", "low"), ("most", "high"), ("bucket", "bucket"))]
        out.append(F.max(F.when(here, F.col("upto") - F.col("n"))).alias(f"{name}_below"))
    got = rows.groupBy(*groups).agg(F.first("all_n").alias("n"), *out)
    for name in wanted:
        got = got.withColumn(name, F.least(F.col(f"{name}_high"), F.greatest(F.col(f"{name}_low"), value_of(F.col(f"{name}_bucket"), alpha))))
    return got


def exact_in_buckets(df: DataFrame, places: DataFrame, groups: Sequence[str], value: str, alpha: float = ALPHA) -> DataFrame:
    """The exact values at given ranks: `places` has (groups, bucket, place), place counting from 1 within the bucket.

    Returns (groups, bucket, place, exact). Only values of the asked buckets are counted again: up
    to BROADCAST_BUCKETS of them leave the others behind where the rows are read.
    """
    keys = places.select(*[F.col(g).alias(f"__k{i}") for i, g in enumerate(groups)], F.col("bucket").alias("__kb")).distinct()
    keys = F.broadcast(keys) if keys.limit(BROADCAST_BUCKETS + 1).count() <= BROADCAST_BUCKETS else keys.hint("merge")
    rows = df.select(*groups, F.col(value).alias("__v")).withColumn("bucket", bucket_of(F.col("__v"), alpha))
    same = F.col("bucket") == F.col("__kb")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__k{i}"))
    counted = rows.join(keys, same, "left_semi").groupBy(*groups, "bucket", "__v").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*groups, "bucket").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = counted.withColumn("upto", F.sum("n").over(upto))
    asked = places.select(*[F.col(g).alias(f"__k{i}") for i, g in enumerate(groups)], F.col("bucket").alias("__kb"), "place").distinct()
    hit = counted.join(asked, same & (F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("n") < F.col("place")))
    return hit.select(*groups, "bucket", "place", F.col("__v").alias("exact"))
