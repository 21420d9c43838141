"""Routing texts into lexical packs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from mergeloom.artifact import NUMBER, PACK_NAMES, ROUTER, STRUCTURE, TEXT
from mergeloom.errors import EncodeError
from mergeloom.functions.merge_columns import _pieces
from mergeloom.functions.routing import span_borders

#: One character class per pack, so that long spans need no recursion in the pattern engine.
SPAN = r"[A-Za-z[^\x00-\x7F]]+|[0-9]+|[\x00-\x7F&&[^A-Za-z0-9]]+"


def spans(text: Column) -> Column:
    """The spans of a text in order, as strings; JVM only."""
    return F.regexp_extract_all(text, F.lit(SPAN), F.lit(0))


def pack_of(span: Column) -> Column:
    """Pack of a span, from its first character; NULL for the empty string."""
    c = F.ascii(F.substring(span, 1, 1))
    letter = ((c >= 65) & (c <= 90)) | ((c >= 97) & (c <= 122)) | (c >= 128)
    return F.when(span == "", None).when(letter, TEXT).when((c >= 48) & (c <= 57), NUMBER).otherwise(STRUCTURE)


def pack_name(pack: Column) -> Column:
    """Name of a pack id; UNKNOWN_PACK for others, NULL for NULL."""
    known = F.create_map(*[F.lit(x) for p, n in PACK_NAMES.items() for x in (p, n)])
    return F.when(pack.isNotNull(), F.coalesce(F.try_element_at(known, pack.cast("int")), F.lit("UNKNOWN_PACK")))


def span_rows(df: DataFrame, ident: str, text: str) -> DataFrame:
    """Columns (ident, span_no, pack_id, span), one row per span; empty and NULL texts have none."""
    rows = df.select(F.col(ident), F.posexplode(spans(F.col(text))).alias("span_no", "span"))
    return rows.select(ident, "span_no", pack_of(F.col("span")).alias("pack_id"), "span")


@F.arrow_udf(ArrayType(StructType([StructField("pack", IntegerType()), StructField("start", LongType()), StructField("end", LongType())])))
def routed(texts: pa.Array) -> pa.Array:
    """Spans of every text with byte offsets, as ARRAY<STRUCT<pack, start, end>>; NULL gives no spans."""
    pack, start, end, lists = [], [], [], [np.zeros(1, np.int64)]
    for data, offsets in _pieces(texts):
        packs, border = span_borders(data, offsets)
        at = np.flatnonzero(border)
        base = offsets[np.searchsorted(offsets, at, side="right") - 1]
        pack.append(packs[at])
        start.append(at - base)
        end.append(np.append(at[1:], len(data)) - base if len(at) else at)
        lists.append(np.searchsorted(at, offsets)[1:] + lists[-1][-1])
    cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    values = pa.StructArray.from_arrays([pa.array(cat(pack, np.int32)), pa.array(cat(start, np.int64)), pa.array(cat(end, np.int64))], names=["pack", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(lists).astype(np.int32)), values)


def span_offsets(df: DataFrame, ident: str, text: str) -> DataFrame:
    """Columns (ident, span_no, pack_id, start_byte, end_byte), offsets in UTF-8 bytes."""
    rows = df.select(F.col(ident), F.posexplode(routed(F.col(text))).alias("span_no", "s"))
    return rows.select(ident, "span_no", F.col("s.pack").alias("pack_id"), F.col("s.start").alias("start_byte"), F.col("s.end").alias("end_byte"))


def span_problems(df: DataFrame, ident: str, text: str, spans_col: str) -> DataFrame:
    """Columns (ident, problem): texts whose ARRAY<STRUCT<pack, start, end>> doesn't cover them, in order, in known packs, at character borders."""
    s, n = F.col(spans_col), F.octet_length(F.col(text))
    starts, ends = F.transform(s, lambda x: x["start"]), F.transform(s, lambda x: x["end"])
    gap = F.exists(F.zip_with(F.slice(starts, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(ends, 1, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: a != b), lambda x: x)
    inside = F.exists(starts, lambda b: F.hex(F.substring(F.col(text).cast("binary"), b.cast("int") + 1, F.lit(1))).rlike("^[89AB]"))
    problem = (
        F.when((F.size(s) == 0) & (n > 0), "no spans")
        .when(F.exists(s, lambda x: x["end"] <= x["start"]), "empty span")
        .when((F.size(s) > 0) & ((F.try_element_at(starts, F.lit(1)) != 0) | gap), "gap or overlap")
        .when((F.size(s) > 0) & (F.try_element_at(ends, F.lit(-1)) != n), "not covered")
        .when(F.exists(s, lambda x: ~x["pack"].isin(TEXT, NUMBER, STRUCTURE)), "unknown pack")
        .when(inside, "inside a character")
    )
    return df.select(ident, problem.alias("problem")).where("problem is not null")


def pack_totals(df: DataFrame, text: str) -> DataFrame:
    """Columns (pack_id, pack_name, spans, routed_bytes), one row per pack, those without spans too."""
    exploded = df.select(F.explode(spans(F.col(text))).alias("span")).select(pack_of(F.col("span")).alias("p"), F.octet_length("span").alias("bytes"))
    sums = exploded.groupBy("p").agg(F.count(F.lit(1)).alias("spans"), F.sum("bytes").alias("routed_bytes"))
    return all_packs(df).join(sums, F.col("pack_id") == F.col("p"), "left").select("pack_id", "pack_name", F.coalesce("spans", F.lit(0)).alias("spans"), F.coalesce("routed_bytes", F.lit(0)).alias("routed_bytes"))


def all_packs(df: DataFrame) -> DataFrame:
    """The four packs as a dimension (pack_id, pack_name)."""
    return df.sparkSession.createDataFrame(list(PACK_NAMES.items()), "pack_id int, pack_name string")


#: Routers by policy id: functions of (bytes, offsets of texts) to (pack of every byte, whether a span begins there).
_ROUTERS = {ROUTER: span_borders}


def register_router(policy: str, function) -> None:
    """Make a router known to encoders by its policy id. An id is given once."""
    if policy in _ROUTERS:
        raise ValueError(f"router {policy} exists")
    _ROUTERS[policy] = function


def router(policy: str):
    """The router of a policy id; unknown ids are refused."""
    if policy not in _ROUTERS:
        raise EncodeError("unknown router", policy=policy)
    return _ROUTERS[policy]


def registry_problems(packs: DataFrame, specials: DataFrame, fallback: int = 65535) -> DataFrame:
    """Columns (problem, item) of rules that packs (pack_id, name, local_token_count) and specials (pack, local, name) break."""
    p, s = packs.select("pack_id", "name", "local_token_count"), specials.select("pack", "local", "name")
    say = lambda df, what, item: df.select(F.lit(what).alias("problem"), item.cast("string").alias("item"))
    home = s.join(p.select("pack_id", F.col("local_token_count").alias("n")), F.col("pack") == F.col("pack_id"), "left")
    sizes = p.where(F.col("pack_id") == fallback)
    parts = [
        say(p.groupBy("pack_id").count().where("count > 1"), "duplicate pack id", F.col("pack_id")),
        say(p.groupBy("name").count().where("count > 1"), "duplicate pack name", F.col("name")),
        say(p.where("name = ''"), "empty pack name", F.col("pack_id")),
        say(p.where("local_token_count < 1"), "empty pack", F.col("pack_id")),
        say(sizes.agg(F.max("local_token_count").alias("n")).where("n is null or n <> 256"), "byte fallback", F.coalesce("n", F.lit(0))),
        say(s.groupBy("pack", "local").count().where("count > 1"), "duplicate special id", F.concat_ws(":", "pack", "local")),
        say(s.groupBy("name").count().where("count > 1"), "duplicate special name", F.col("name")),
        say(s.where("name = ''"), "empty special name", F.concat_ws(":", "pack", "local")),
        say(s.where(F.col("pack") == fallback), "special token in byte fallback", F.col("local")),
        say(home.where("pack_id is null"), "special token of unknown pack", F.col("pack")),
        say(home.where("local >= n"), "special token out of range", F.concat_ws(":", "pack", "local")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
