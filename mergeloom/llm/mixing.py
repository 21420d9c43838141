"""Mixing categories to target weights: Sainte-Laguë apportionment of equal blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mergeloom.operators.ranking import distributed_rank, first_arrival

#: Blocks that a mix is divided into.
BLOCKS = 1000


def sainte_lague(shares: DataFrame, capacity: str, seats: str) -> DataFrame:
    """Columns (mix_id, category, seats) for rows (mix_id, category, w, n_blocks, `capacity`).

    The n_blocks seats of a mix go to the highest quotients w / (2k + 1), k from 0 to capacity - 1,
    ties to the category first in order. Seats beyond all capacities stay empty.

    A fractional filling at two levels, half a seat per category below and above the goal, brackets
    every category's seats, so about three seats per category are ranked, not all of them.
    """
    mix = Window.partitionBy("mix_id")
    by_fill = mix.orderBy("fill", "category")
    rows = (
        shares.select("mix_id", "category", "w", "n_blocks", F.col(capacity).alias("cap"))
        .where((F.col("w") > 0) & (F.col("cap") > 0))
        .withColumn("fill", F.col("cap") / F.col("w"))
        .withColumn("full", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("w").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("n", F.count(F.lit(1)).over(mix))
        .withColumn("goal", F.least("n_blocks", F.sum("cap").over(mix)))
        .withColumn("at_fill", F.col("full") + F.col("fill") * F.col("open"))
    )
    for name, m in (("low", F.col("goal") - F.col("n") / 2 - 1), ("high", F.col("goal") + F.col("n") / 2 + 1)):
        level = F.when(F.col("at_fill") >= m, (m - F.col("full")) / F.col("open"))
        rows = rows.withColumn(name, F.min_by(level, F.when(level.isNotNull(), F.struct("fill", "category"))).over(mix))
    low = F.when(F.col("low").isNull(), F.col("cap")).otherwise(F.least("cap", F.greatest(F.lit(0), F.floor(F.col("low") * F.col("w") + 0.5) - 1)))
    high = F.when(F.col("high").isNull(), F.col("cap")).otherwise(F.least("cap", F.floor(F.col("high") * F.col("w") + 0.5) + 1))
    rows = rows.withColumn("sure", low.cast("bigint")).withColumn("most", F.greatest(high.cast("bigint"), F.col("sure")))
    rows = rows.withColumn("left_over", F.col("goal") - F.sum("sure").over(mix))
    tried = rows.select("mix_id", "category", "sure", "left_over", "w", F.explode_outer(F.when(F.col("most") > F.col("sure"), F.sequence(F.col("sure"), F.col("most") - 1))).alias("k"))
    tried = tried.withColumn("quotient", F.col("w") / (2 * F.col("k") + 1))
    place = F.row_number().over(mix.orderBy(F.col("quotient").desc_nulls_last(), "category", "k"))
    won = tried.withColumn("won", (F.col("k").isNotNull() & (place <= F.col("left_over"))).cast("bigint"))
    return won.groupBy("mix_id", "category").agg((F.first("sure") + F.sum("won")).alias(seats))


def category_key(column: str):
    """Categories are the same apart from case and outer blanks."""
    return F.lower(F.regexp_replace(F.col(column), r"^[\s ]+|[\s ]+$", ""))


def _once(sources: DataFrame) -> DataFrame:
    rows = sources.select("source_id", "corpus_id", "category", F.get("contribution", F.lit(0)).alias("train"), "registered_at")
    return first_arrival(rows, ["source_id"], ["corpus_id", "category", "train"], ["registered_at"])


def mix_shares(sources: DataFrame, mix_targets: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """What every category gives to every mix, one row per (mix_id, category) of `mix_targets`.

    Available bytes are the train part of `contribution` over the corpus's sources of the category;
    a source that is listed twice under one id counts once, NULL counts as 0. A category may give
    `available * max_repeats` bytes at most. The mix is `blocks` equal blocks; they are apportioned
    by Sainte-Laguë, first without that limit (`fair_blocks`), then with it (`blocks`). A category
    is `short` if it is granted fewer seats than are fair; see below for the last block's rest.

    NULL or negative weights and repeats count as 0; a category without a source gives nothing; a
    mix without weights has NULL shares. The repeats are passes over the category's bytes.
    """
    have = _once(sources).groupBy("corpus_id", category_key("category").alias("ckey")).agg(F.sum(F.coalesce("train", F.lit(0))).alias("available_bytes"))
    mix = Window.partitionBy("mix_id")
    rows = (
        first_arrival(mix_targets.select("mix_id", "corpus_id", "category", "weight", "max_repeats", "total_bytes"), ["mix_id", "category"], ["corpus_id", "weight", "max_repeats", "total_bytes"])
        .withColumn("ckey", category_key("category"))
        .join(have, ["corpus_id", "ckey"], "left")
        .withColumn("available_bytes", F.coalesce("available_bytes", F.lit(0)))
        .withColumn("capacity_bytes", F.col("available_bytes") * F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)))
        .withColumn("w", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
        .withColumn("all_w", F.sum("w").over(mix))
        .withColumn("target_share", F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w")))
        .withColumn("target_bytes", F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w") * F.col("total_bytes")))
        .withColumn("block_bytes", F.greatest(F.lit(1), F.ceil(F.col("total_bytes") / F.lit(blocks))))
        .withColumn("n_blocks", F.ceil(F.coalesce("total_bytes", F.lit(0)) / F.coalesce("block_bytes", F.lit(1))))
        .withColumn("capacity_blocks", F.greatest(F.lit(0), F.ceil(F.col("capacity_bytes") / F.coalesce("block_bytes", F.lit(1)))))
    )
    fair = sainte_lague(rows, "n_blocks", "fair_blocks")
    given = sainte_lague(rows, "capacity_blocks", "blocks")
    out = rows.join(fair, ["mix_id", "category"], "left").join(given, ["mix_id", "category"], "left")
    out = out.withColumn("fair_blocks", F.coalesce("fair_blocks", F.lit(0))).withColumn("blocks", F.coalesce("blocks", F.lit(0)))
    out = out.withColumn("given_bytes", F.least(F.col("blocks") * F.coalesce("block_bytes", F.lit(1)), F.greatest("capacity_bytes", F.lit(0))))
    all_given = F.sum("given_bytes").over(mix)
    # A divisor's rounding moves every category by half a block at most, so fair seats are within (categories + 1) / 2 blocks of the exact share,
    # and blocks that don't divide the mix add one. Seats further apart than that decide; only a limit inside the last blocks is settled in bytes.
    slack = F.count(F.lit(1)).over(mix) / 2 + 2
    whole = F.floor(F.col("capacity_bytes") / F.coalesce("block_bytes", F.lit(1)))
    short = F.when(F.col("blocks") + slack < F.col("fair_blocks"), True).when(whole > F.col("fair_blocks") + slack, False).otherwise(F.col("capacity_bytes") < F.col("target_bytes"))
    return out.select(
        "mix_id", "category", "corpus_id", "target_share", "target_bytes", "available_bytes", "capacity_bytes", "block_bytes", "fair_blocks", "blocks", "given_bytes",
        F.when(F.col("available_bytes") > 0, F.col("given_bytes") / F.col("available_bytes")).alias("repeats"),
        F.when(all_given > 0, F.col("given_bytes") / all_given).alias("reached_share"),
        F.coalesce(short, F.lit(False)).alias("short"),
    )


def mix_blocks(sources: DataFrame, shares: DataFrame, seed: int = 0) -> DataFrame:
    """The blocks of every source that a mix takes: (mix_id, category, source_id, block_no, copies).

    A source's train bytes are blocks of the mix's block size, the last one shorter. A quota of q
    blocks over m distinct ones takes each q div m times and, by a seeded hash, q mod m of them
    once more. Ranks are found by hash bins, so a category with most blocks needs no single task.
    """
    files = _once(sources).where("train > 0").withColumn("ckey", category_key("category"))
    quota = shares.where("blocks > 0").select("mix_id", "category", F.col("corpus_id").alias("mix_corpus"), category_key("category").alias("mix_ckey"), "blocks", "block_bytes")
    own = files.join(quota, (files.corpus_id == quota.mix_corpus) & (files.ckey == quota.mix_ckey))
    one = own.select("mix_id", quota.category, "source_id", "blocks", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("train") / F.col("block_bytes")) - 1)).alias("block_no"))
    ranked = distributed_rank(one, ["mix_id", "category"], ["source_id", "block_no"], seed)
    sizes = one.groupBy("mix_id", "category").agg(F.count(F.lit(1)).alias("m"))
    copies = F.floor(F.col("blocks") / F.col("m")) + (F.col("rank") < F.col("blocks") % F.col("m")).cast("bigint")
    return ranked.join(sizes, ["mix_id", "category"]).select("mix_id", "category", "source_id", "block_no", copies.alias("copies")).where("copies > 0")
