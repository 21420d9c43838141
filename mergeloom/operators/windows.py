"""Windows over token sequences, byte offsets and steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from mergeloom.functions.values import lists_of, unsigned_modulo, xorshift
from mergeloom.operators.ranking import running_sum

#: What byte_match gives.
MATCH = "raw_byte_start bigint, raw_target_bytes bigint, raw_byte_end bigint, a_start_token int, a_end_token int, c_start_token int, c_end_token int"
MATCH_ARROW = pa.struct([(n, pa.int64() if kind == "bigint" else pa.int32()) for n, kind in (c.split(" ") for c in MATCH.split(", "))])


def adjacent_pairs(tokens: Column) -> Column:
    """Neighbours of an array as ARRAY<STRUCT<l, r>>."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, 1, n), F.slice(tokens, 2, n), lambda a, b: F.struct(a.alias("l"), b.alias("r")))


def sliding_contexts(df: DataFrame, ident: str, tokens: str, width: int = 16) -> DataFrame:
    """Columns (ident, pos, context ARRAY, target): every token but the first with at most `width` tokens before it."""
    t = F.col(tokens)
    rows = df.select(F.col(ident), t.alias("__t"), F.explode(F.when(F.size(t) > 1, F.sequence(F.lit(1), F.size(t) - 1))).alias("pos"))
    start = F.greatest(F.col("pos") - width, F.lit(0))
    return rows.select(ident, F.col("pos"), F.slice("__t", start + 1, F.col("pos") - start).alias("context"), F.get("__t", F.col("pos")).alias("target"))


def tumbling_windows(df: DataFrame, ident: str, tokens: str, width: int = 256) -> DataFrame:
    """Columns (ident, window_no, inputs, targets): non-overlapping windows of targets 1.., the last one shorter."""
    t, n = F.col(tokens), F.size(tokens)
    rows = df.select(F.col(ident), t.alias("__t"), F.explode(F.when(n > 1, F.sequence(F.lit(0), F.floor((n - 2) / width).cast("int")))).alias("window_no"))
    size = F.least(F.lit(width), F.size("__t") - 1 - F.col("window_no") * width)
    return rows.select(ident, "window_no", F.slice("__t", F.col("window_no") * width + 1, size).alias("inputs"), F.slice("__t", F.col("window_no") * width + 2, size).alias("targets"))


def random_windows(df: DataFrame, ident: str, tokens: str, n_bytes: str, seeds: DataFrame, width: int = 16) -> DataFrame:
    """Columns (ident, draw, start, inputs, targets, target_bytes): windows at generator state mod (n - width).

    `seeds` has (ident, draw, state BIGINT), the state before the draw; sequences of `width` tokens
    or fewer have no window.
    """
    s = seeds.select(F.col(ident).alias("__i"), "draw", xorshift(F.col("state")).alias("__x"))
    rows = df.select(F.col(ident), F.col(tokens).alias("__t"), F.col(n_bytes).alias("__b")).where(F.size("__t") > width).join(s, F.col(ident) == F.col("__i"))
    rows = rows.withColumn("start", unsigned_modulo(F.col("__x"), (F.size("__t") - width).cast("bigint")).cast("int"))
    targets = F.slice("__b", F.col("start") + 2, width)
    return rows.select(ident, "draw", "start", F.slice("__t", F.col("start") + 1, width).alias("inputs"), F.slice("__t", F.col("start") + 2, width).alias("targets"), F.aggregate(targets, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("target_bytes"))


@F.arrow_udf(ArrayType(LongType()))
def borders(lengths: pa.Array) -> pa.Array:
    """0 and the running sums of every array; NULL counts as empty."""
    out = [np.concatenate(([0], np.cumsum(np.asarray(x.values, np.int64)))) if x.is_valid else np.zeros(1, np.int64) for x in lengths]
    return lists_of(out)


def prefix_offsets(df: DataFrame, ident: str, n_bytes: str) -> DataFrame:
    """Columns (ident, tokens_before, offset): byte offset of every token border, 0 included.

    Sums run inside each row's array, without a shuffle.
    """
    return df.select(F.col(ident), F.posexplode(borders(F.col(n_bytes))).alias("tokens_before", "offset"))


def blocks(value: Column, size: int = 4096) -> Column:
    """Blocks of BINARY: at least `size` bytes, extended through the next line feed; as ARRAY<STRING> of one character per byte."""
    latin = F.decode(value, "ISO-8859-1")
    return F.regexp_extract_all(latin, F.lit("(?s).{%d}[^\\n]*\\n?|.{1,%d}" % (size, size - 1)), F.lit(0))


def split_of(index: Column) -> Column:
    """Of twenty blocks the last but one is validation, the last test."""
    return F.when(index % 20 == 18, "validation").when(index % 20 == 19, "test").otherwise("train")


def block_rows(df: DataFrame, ident: str, content: str, size: int = 4096, whole_corpus: bool = False) -> DataFrame:
    """Columns (ident, block_no, start_byte, end_byte, content, split).

    Blocks count per source, or over the whole corpus in order of `ident`; then the counts of the
    sources before are summed over one row per source.
    """
    cuts = blocks(F.col(content).cast("binary"), size)
    sums = df.select(F.col(ident), cuts.alias("__b")).withColumn("__e", borders(F.transform("__b", lambda b: F.length(b))))
    rows = sums.select(ident, "__e", F.posexplode("__b").alias("block_no", "b"))
    rows = rows.select(ident, "block_no", "b", F.get("__e", F.col("block_no")).alias("start_byte"), F.get("__e", F.col("block_no") + 1).alias("end_byte"))
    index = F.col("block_no")
    if whole_corpus:
        per = rows.groupBy(F.col(ident).alias("__i")).agg(F.count(F.lit(1)).alias("__c"))
        before = running_sum(per, ["__i"], "__c", "__upto").select("__i", (F.col("__upto") - F.col("__c")).alias("__before"))
        rows = rows.join(before, F.col(ident) == F.col("__i"))
        index = F.col("block_no") + F.col("__before")
    return rows.select(ident, index.cast("bigint").alias("block_no"), "start_byte", "end_byte", F.encode("b", "ISO-8859-1").alias("content"), split_of(index).alias("split"))


def padded_batches(df: DataFrame, ident: str, tokens: str, first: int | Column = 1, targets: int | Column | None = None, width: int = 256, rows: int = 8, pad: int = 0) -> DataFrame:
    """Columns (ident, batch, row, inputs, targets, length): consecutive windows of a range of `targets` targets from token `first`, padded to `width`, `rows` to a batch.

    Columns give every sequence a range of its own; without `targets` it reaches to the sequence's end.
    """
    size = F.greatest(F.size(tokens), F.lit(0)) if targets is None else targets + 1
    windows = tumbling_windows(df.select(F.col(ident), F.slice(tokens, first, size).alias("__r")), ident, "__r", width)
    fill = lambda c: F.concat(c, F.array_repeat(F.lit(pad), F.lit(width) - F.size(c)))
    return windows.select(ident, F.floor(F.col("window_no") / rows).cast("int").alias("batch"), (F.col("window_no") % rows).alias("row"), fill(F.col("inputs")).alias("inputs"), fill(F.col("targets")).alias("targets"), F.size("targets").alias("length"))


def byte_match(a: Column, c: Column, limit: int) -> Column:
    """STRUCT of the longest interval between byte borders that two encodings of one text share, of at most `limit` bytes, the earliest of equals.

    `a` and `c` are the encodings' ARRAY<INT> of bytes per token. The first border is never used.
    NULL where there is no such interval or an encoding is NULL. Borders are met within the row,
    without a shuffle.
    """

    @F.arrow_udf(MATCH)
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([_match(x, y, limit) for x, y in zip(left, right)], MATCH_ARROW)

    return run(a, c)


def _match(left: pa.ListScalar, right: pa.ListScalar, limit: int) -> dict[str, int] | None:
    if not (left.is_valid and right.is_valid):
        return None
    upto = [np.cumsum(np.asarray(x.values, np.int64)) for x in (left, right)]
    shared, i, j = np.intersect1d(*upto, assume_unique=True, return_indices=True)
    if len(shared) < 2:
        return None
    end = np.searchsorted(shared, shared + limit, side="right") - 1
    at = int((shared[end] - shared).argmax())
    to = int(end[at])
    if to == at:
        return None
    values = (shared[at], shared[to] - shared[at], shared[to], i[at] + 1, i[to] + 1, j[at] + 1, j[to] + 1)
    return {f.name: int(v) for f, v in zip(MATCH_ARROW, values)}


def checkpoint_steps(steps: DataFrame, every: int, total: int) -> DataFrame:
    """Steps (step) at which a run is saved: the first, every k-th, the quarters of the budget, the last."""
    s = F.col("step")
    return steps.where((s >= 1) & (s <= total) & ((s == 1) | (s % every == 0) | s.isin([total // 4, total // 2, total * 3 // 4]) | (s == total)))
