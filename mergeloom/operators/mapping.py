"""Mappings between global ids and (pack, local)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Ids of a vocabulary.
MAX_IDS = 1_000_000


def bounded(rows: DataFrame, limit: int) -> DataFrame:
    """The rows, after a check that there are at most `limit`."""
    n = rows.limit(limit + 1).count()
    if n > limit:
        raise ValueError(f"more than {limit} rows")
    return rows


def vocabulary(rows: DataFrame) -> DataFrame:
    """A vocabulary's table, broadcast after its size was checked."""
    return F.broadcast(bounded(rows, MAX_IDS))


def flatten(packs: DataFrame) -> DataFrame:
    """Columns (global_id, pack_id, local_id): all ids of packs (pack_id, local_token_count) in (pack, local) order.

    A vocabulary has at most 1,000,000 ids, so one ordering over all of them is bounded.
    """
    before = Window.orderBy("pack_id").rowsBetween(Window.unboundedPreceding, -1)
    based = packs.withColumn("base", F.coalesce(F.sum("local_token_count").over(before), F.lit(0)))
    rows = based.select("pack_id", "base", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("local_token_count").cast("bigint") - 1)).alias("local_id"))
    return rows.select((F.col("base") + F.col("local_id")).cast("int").alias("global_id"), "pack_id", F.col("local_id").cast("int").alias("local_id"))


def balanced(expansions: DataFrame, packs: int) -> DataFrame:
    """Columns (global_id, pack_id, local_id): ids (global_id, expansion BINARY) dealt out in order of their bytes.

    The rank by (expansion, id) modulo `packs` is the pack; local ids count up within it.
    """
    rank = F.row_number().over(Window.orderBy("expansion", "global_id")) - 1
    ranked = expansions.select("global_id", rank.alias("r"))
    return ranked.select("global_id", (F.col("r") % packs).cast("int").alias("pack_id"), F.floor(F.col("r") / packs).cast("int").alias("local_id"))


def mapping_problems(mapping: DataFrame) -> DataFrame:
    """Columns (problem, n) of what keeps a mapping from being a bijection on contiguous local domains; none if it is one."""
    parts = [
        mapping.groupBy("global_id").count().where("count > 1").agg(F.lit("global id twice").alias("problem"), F.count(F.lit(1)).alias("n")),
        mapping.groupBy("pack_id", "local_id").count().where("count > 1").agg(F.lit("local id twice").alias("problem"), F.count(F.lit(1)).alias("n")),
        mapping.groupBy("pack_id").agg(F.max("local_id").alias("m"), F.countDistinct("local_id").alias("c")).where("m + 1 <> c").agg(F.lit("gap in local ids").alias("problem"), F.count(F.lit(1)).alias("n")),
        mapping.agg(F.max("global_id").alias("m"), F.countDistinct("global_id").alias("c")).where("m + 1 <> c").agg(F.lit("gap in global ids").alias("problem"), F.count(F.lit(1)).alias("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("n > 0")


def to_packed(tokens: DataFrame, mapping: DataFrame, token: str = "token") -> DataFrame:
    """Add (pack_id, local_id) to rows with a global id; both NULL for an unknown one."""
    m = vocabulary(mapping.select(F.col("global_id").alias("__g"), F.col("pack_id"), F.col("local_id")))
    return tokens.join(m, F.col(token) == F.col("__g"), "left").drop("__g")


def to_global(tokens: DataFrame, mapping: DataFrame, pack: str = "pack_id", local: str = "local_id") -> DataFrame:
    """Add global_id to rows with (pack, local); NULL for an unknown pair."""
    m = vocabulary(mapping.select(F.col("pack_id").alias("__p"), F.col("local_id").alias("__l"), "global_id"))
    return tokens.join(m, (F.col(pack) == F.col("__p")) & (F.col(local) == F.col("__l")), "left").drop("__p", "__l")


def unknown_tokens(tokens: DataFrame, mapping: DataFrame, token: str = "token") -> DataFrame:
    """Rows whose id the mapping doesn't have."""
    return tokens.join(vocabulary(mapping.select(F.col("global_id").alias("__g"))), F.col(token) == F.col("__g"), "left_anti")


def embedding_order(mapping: DataFrame) -> DataFrame:
    """Columns (row, global_id): global ids in packed order."""
    return mapping.select((F.row_number().over(Window.orderBy("pack_id", "local_id")) - 1).cast("int").alias("row"), "global_id")


def remap(tokens: DataFrame, mapping: DataFrame, variant: str) -> DataFrame:
    """Rows (.., pack, local) with (mapped_pack, mapped_local) of a variant's model.

    B turns flat ids into the mapping's packs, C turns packs into flat ids of pack 0, A and D change
    nothing. Ids that the mapping lacks are NULL.
    """
    if variant not in ("A", "B", "C", "D"):
        raise ValueError(f"unknown variant {variant}")
    if variant == "B":
        m = vocabulary(mapping.select(F.col("global_id").alias("__g"), F.col("pack_id").alias("mapped_pack"), F.col("local_id").alias("mapped_local")))
        return tokens.join(m, F.col("local") == F.col("__g"), "left").drop("__g")
    if variant == "C":
        m = vocabulary(mapping.select(F.col("pack_id").alias("__p"), F.col("local_id").alias("__l"), F.col("global_id").alias("mapped_local")))
        joined = tokens.join(m, (F.col("pack") == F.col("__p")) & (F.col("local") == F.col("__l")), "left").drop("__p", "__l")
        return joined.withColumn("mapped_pack", F.when(F.col("mapped_local").isNotNull(), 0)).select(*tokens.columns, "mapped_pack", "mapped_local")
    return tokens.withColumn("mapped_pack", F.col("pack")).withColumn("mapped_local", F.col("local"))


def unmap(tokens: DataFrame, mapping: DataFrame, variant: str) -> DataFrame:
    """The inverse of remap: rows (.., mapped_pack, mapped_local) with the original (pack, local)."""
    back = {"A": "A", "B": "C", "C": "B", "D": "D"}[variant]
    rest = [c for c in tokens.columns if c not in ("mapped_pack", "mapped_local", "pack", "local")]
    given = tokens.select(*rest, F.col("mapped_pack").alias("pack"), F.col("mapped_local").alias("local"))
    return remap(given, mapping, back).select(*rest, F.col("mapped_pack").alias("pack"), F.col("mapped_local").alias("local"))
