"""Columns made by a merge table: tokens and token counts of a text, batch by batch over Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergeloom.functions.automaton import MAX_MERGES, MergeAutomaton, chunks


def load_automaton(merges: DataFrame, rank: str = "merge_rank", left: str = "left_id", right: str = "right_id", result: str = "result_id") -> MergeAutomaton:
    """The automaton of a merge table. Repeated rows count once.

    The table is a vocabulary, so its size is bounded: more than MAX_MERGES merges raise ValueError.
    """
    rows = merges.select(F.col(rank).alias("r"), F.col(left).alias("a"), F.col(right).alias("b"), F.col(result).alias("x")).where("r is not null and a is not null and b is not null and x is not null").distinct().limit(MAX_MERGES + 1).collect()
    if len(rows) > MAX_MERGES:
        raise ValueError(f"more than {MAX_MERGES} merges")
    rows.sort(key=lambda r: (r.r, r.a, r.b))
    return MergeAutomaton(np.array([(r.a, r.b, r.x) for r in rows], np.int32).reshape(-1, 3))


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of the texts, in chunks; NULL is like an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    binary = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "").cast(pa.large_binary())
    n = len(binary)
    if not n:
        return
    _, offs, data = binary.buffers()
    offsets = np.frombuffer(offs, np.int64)[binary.offset : binary.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    for i, j in chunks(offsets):
        o = offsets[i : j + 1]
        yield raw[o[0] : o[-1]], o - o[0]


def token_count(sc, automaton: MergeAutomaton) -> Callable[[Column], Column]:
    """A column function: tokens of a STRING or BINARY as BIGINT; NULL and the empty text have 0."""
    shared = sc.broadcast(automaton)

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        parts = [shared.value.counts(d, o) for d, o in _pieces(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())

    return count


def token_ids(sc, automaton: MergeAutomaton) -> Callable[[Column], Column]:
    """A column function: the token ids of a STRING or BINARY as ARRAY<INT>; NULL stays NULL."""
    shared = sc.broadcast(automaton)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        values, lists = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for d, o in _pieces(texts):
            v, begin = shared.value.tokens(d, o)
            lists.append(begin[1:] + lists[-1][-1])
            values.append(v)
        nulls = np.asarray(texts.is_null())
        return pa.ListArray.from_arrays(pa.array(np.concatenate(lists).astype(np.int32), pa.int32()), pa.array(np.concatenate(values), pa.int32()), mask=pa.array(nulls) if nulls.any() else None)

    return ids
