"""Encoding and decoding: byte fallback, flat and pack-local merges, lengths and statistics."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from mergeloom.artifact import BYTE_FALLBACK, ROUTER, Artifact
from mergeloom.errors import DecodeError, EncodeError
from mergeloom.functions.automaton import expansions
from mergeloom.functions.merge_columns import _pieces, load_automaton, token_ids
from mergeloom.functions.packed import Expander, PackedAutomaton
from mergeloom.operators.mapping import MAX_IDS, bounded, vocabulary
from mergeloom.operators.route import all_packs, router

TOKEN = "struct<pack:int,local:bigint>"
STATS = ("routed_bytes", "spans", "tokens", "token_bytes")
PackMerges = Mapping[int, list[tuple[int, int, int]]]


@F.arrow_udf(ArrayType(IntegerType()))
def _byte_ids(values: pa.Array) -> pa.Array:
    rows = values.to_pylist()
    begin = np.concatenate(([0], np.cumsum([len(v or b"") for v in rows]))).astype(np.int32)
    ids = np.frombuffer(b"".join(v or b"" for v in rows), np.uint8).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(begin), pa.array(ids), mask=pa.array([v is None for v in rows], pa.bool_()))


def byte_ids(value: Column) -> Column:
    """Bytes of a STRING or BINARY as ARRAY<INT>, the local ids of the byte-fallback pack; NULL stays NULL."""
    return _byte_ids(value.cast("binary"))


@F.arrow_udf(BinaryType())
def _bytes_of(lists: pa.Array) -> pa.Array:
    flat = lists.flatten()
    bad = pc.indices_nonzero(pc.fill_null(pc.or_(pc.less(flat, 0), pc.greater(flat, 255)), True))
    if len(bad):
        raise ValueError(f"byte id out of range: {'NULL' if (x := flat[bad[0].as_py()].as_py()) is None else x}")
    data = np.asarray(flat).astype(np.uint8).tobytes()
    size = pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
    begin = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    return pa.array([data[i:j] if there else None for i, j, there in zip(begin[:-1], begin[1:], pc.is_valid(lists).to_pylist())], pa.binary())


def bytes_of(ids: Column) -> Column:
    """BINARY of byte ids; an id outside 0-255 raises an error that names it; NULL stays NULL."""
    return _bytes_of(ids)


def decode_text(value: Column) -> Column:
    """STRING of BINARY; raises an error where the bytes are no UTF-8."""
    return F.validate_utf8(value.cast("string"))


def valid_up_to(value: Column) -> Column:
    """Bytes up to the first that is no UTF-8; NULL where all are."""

    @F.arrow_udf("bigint")
    def first_bad(values: pa.Array) -> pa.Array:
        out = []
        for v in values.to_pylist():
            try:
                out.append(None if v is None or v.decode() is not None else None)
            except UnicodeDecodeError as e:
                out.append(e.start)
        return pa.array(out, pa.int64())

    return first_bad(value.cast("binary"))


def encode_flat(df: DataFrame, ident: str, text: str, merges: DataFrame) -> DataFrame:
    """Columns (ident, tokens ARRAY<INT>) under a flat merge table (merge_rank, left_id, right_id, result_id)."""
    return df.select(F.col(ident), token_ids(df.sparkSession.sparkContext, load_automaton(merges))(F.col(text)).alias("tokens"))


def pack_merges(merges: DataFrame) -> dict[int, list[tuple[int, int, int]]]:
    """Merges by pack from a table (pack_id, merge_rank, left_id, right_id, result_id); a vocabulary, so bounded."""
    rows = merges.select("pack_id", "merge_rank", "left_id", "right_id", "result_id").distinct().limit(3 * 65_536 + 1).collect()
    if len(rows) > 3 * 65_536:
        raise ValueError("too many merges")
    out: dict[int, list[tuple[int, int, int]]] = {}
    for r in sorted(rows):
        out.setdefault(r.pack_id, []).append((r.left_id, r.right_id, r.result_id))
    return out


def artifact_merges(artifact: Artifact) -> dict[int, list[tuple[int, int, int]]]:
    if not artifact.packed:
        return {}
    return {p.pack_id: [(a, b, 256 + r) for r, (a, b) in enumerate(p.merges)] for p in artifact.packed.packs}


def encode_packed(df: DataFrame, ident: str, text: str, merges: PackMerges, policy: str = ROUTER) -> DataFrame:
    """Columns (ident, tokens ARRAY<STRUCT<pack, local>>).

    A STRING or BINARY column; merges stay inside spans of the router with that policy id, a byte
    left alone is (65535, byte). Bytes that are no UTF-8 go through the byte fallback as a whole.
    NULL gives no tokens. A router that names no pack or leaves a span open raises EncodeError.
    """
    shared = df.sparkSession.sparkContext.broadcast(PackedAutomaton(merges, router(policy)))

    @F.arrow_udf(f"array<{TOKEN}>")
    def run(values: pa.Array, valid: pa.Array) -> pa.Array:
        ok = np.asarray(valid.fill_null(True))
        pack, local, lists, row = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], 0
        for data, offsets in _pieces(values):
            n = len(offsets) - 1
            p, loc, begin = shared.value.tokens(data, offsets, ok[row : row + n])
            row += n
            pack.append(p.astype(np.int32))
            local.append(loc.astype(np.int64))
            lists.append(begin[1:] + lists[-1][-1])
        items = pa.StructArray.from_arrays([pa.array(np.concatenate(pack)), pa.array(np.concatenate(local))], names=["pack", "local"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(lists).astype(np.int32)), items)

    value = F.col(text)
    return df.select(F.col(ident), run(value, F.is_valid_utf8(value.cast("string"))).alias("tokens"))


def encode_artifact(df: DataFrame, ident: str, text: str, artifact: Artifact, policy: str = ROUTER) -> DataFrame:
    """encode_packed with an artifact's merges; a router other than the artifact's raises EncodeError."""
    if not artifact.packed:
        raise EncodeError("no pack model")
    if policy != artifact.packed.router:
        raise EncodeError("router differs from the artifact's", policy=policy, artifact=artifact.packed.router)
    return encode_packed(df, ident, text, artifact_merges(artifact), policy)


def _flat_lists(arrays: pa.Array) -> tuple[pa.Array, np.ndarray]:
    if isinstance(arrays, pa.ChunkedArray):
        arrays = arrays.combine_chunks()
    offsets = np.asarray(arrays.offsets, np.int64)
    return arrays.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]


def _binary(data: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer(begin.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def decode_flat(sc, merges: list[tuple[int, int, int]]):
    """A column function: BINARY of flat token ids; NULL gives no bytes, unknown ids raise DecodeError."""
    shared = sc.broadcast(Expander.flat(merges))

    @F.arrow_udf("binary")
    def run(tokens: pa.Array) -> pa.Array:
        values, begin = _flat_lists(tokens.fill_null([]) if tokens.null_count else tokens)
        ids = np.asarray(values.fill_null(-1), np.int64)
        return _binary(*shared.value.expand(shared.value.codes(np.zeros(len(ids), np.int64), ids), begin))

    return run


def decode_packed(sc, merges: PackMerges):
    """A column function: BINARY of (pack, local) tokens; never routes again, unknown ids raise DecodeError."""
    shared = sc.broadcast(Expander.packed(merges))

    @F.arrow_udf("binary")
    def run(tokens: pa.Array) -> pa.Array:
        values, begin = _flat_lists(tokens.fill_null([]) if tokens.null_count else tokens)
        pack, local = (np.asarray(values.field(i).fill_null(-1), np.int64) for i in (0, 1))
        return _binary(*shared.value.expand(shared.value.codes(pack, local), begin))

    return run


def decode_flat_or_error(sc, merges: list[tuple[int, int, int]]):
    """A column function: STRUCT<bytes BINARY, error STRING, error_index INT> of flat token ids.

    A row with an unknown id has no bytes but the error and the place of the first such token, from
    0; other rows are not touched by it. NULL gives no bytes and no error.
    """
    shared = sc.broadcast(Expander.flat(merges))

    @F.arrow_udf("struct<bytes:binary,error:string,error_index:int>")
    def run(tokens: pa.Array) -> pa.Array:
        table, out = shared.value, []
        for t in tokens:
            ids = np.asarray(t.values.fill_null(-1), np.int64) if t.is_valid else np.zeros(0, np.int64)
            try:
                raw = table.expand(table.codes(np.zeros(len(ids), np.int64), ids), np.array([0, len(ids)]))[0].tobytes()
                out.append({"bytes": raw, "error": None, "error_index": None})
            except DecodeError as e:
                out.append({"bytes": None, "error": e.kind, "error_index": e.details["index"]})
        return pa.array(out, pa.struct([("bytes", pa.binary()), ("error", pa.string()), ("error_index", pa.int32())]))

    return run


def adapt(df: DataFrame, ident: str, text: str, merges: PackMerges, mapping: DataFrame) -> DataFrame:
    """Columns (ident, tokens ARRAY<INT> global ids, n_bytes ARRAY<INT>, same, covered): encode, check, number and measure in one pass.

    `mapping` (global_id, pack_id, local_id) is a vocabulary of at most a million ids; a token it
    lacks is NULL. `same` is whether the tokens decode to the text, `covered` whether their lengths
    add up to its bytes. NULL has no tokens and counts as the empty text.
    """
    known = {(r.pack_id, r.local_id): r.global_id for r in bounded(mapping.select("pack_id", "local_id", "global_id"), MAX_IDS).collect()}
    expander = Expander.packed(merges)
    ids = np.array([known.get(k, -1) for k in sorted(expander.code)], np.int32)
    shared = df.sparkSession.sparkContext.broadcast((PackedAutomaton(merges), expander, ids))

    @F.arrow_udf("struct<tokens:array<int>,n_bytes:array<int>,same:boolean,covered:boolean>")
    def run(values: pa.Array, valid: pa.Array) -> pa.Array:
        automaton, table, numbers = shared.value
        ok, row = np.asarray(valid.fill_null(True)), 0
        parts = []
        for data, offsets in _pieces(values):
            n = len(offsets) - 1
            pack, local, begin = automaton.tokens(data, offsets, ok[row : row + n])
            row += n
            codes = table.codes(pack, local)
            back, at = table.expand(codes, begin)
            size = np.concatenate(([0], np.cumsum(table.size[codes])))
            same = [back[at[i] : at[i + 1]].tobytes() == data[offsets[i] : offsets[i + 1]].tobytes() for i in range(n)]
            given = numbers[codes]
            token = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(given, mask=given < 0))
            length = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(table.size[codes].astype(np.int32)))
            parts.append(pa.StructArray.from_arrays([token, length, pa.array(same, pa.bool_()), pa.array(size[begin[1:]] - size[begin[:-1]] == np.diff(offsets))], names=["tokens", "n_bytes", "same", "covered"]))
        kind = pa.struct([("tokens", pa.list_(pa.int32())), ("n_bytes", pa.list_(pa.int32())), ("same", pa.bool_()), ("covered", pa.bool_())])
        return pa.concat_arrays(parts).cast(kind) if parts else pa.array([], kind)

    value = F.col(text)
    return df.select(F.col(ident), run(value, F.is_valid_utf8(value.cast("string"))).alias("__a")).select(ident, "__a.*")


def length_frame(spark, merges: PackMerges, flat: bool = False) -> DataFrame:
    """Bytes of every token: (token, n_bytes, hex) for a flat table, else (pack_id, local_id, n_bytes, hex)."""
    if flat:
        rows = [(i, len(x), x.hex()) for m in merges.values() for i, x in expansions(m).items()]
        return spark.createDataFrame(rows, "token int, n_bytes int, hex string")
    rows = [(BYTE_FALLBACK, b, 1, f"{b:02x}") for b in range(256)]
    rows += [(p, i - 256, len(x), x.hex()) for p, m in merges.items() for i, x in expansions(m).items() if i >= 256]
    return spark.createDataFrame(rows, "pack_id int, local_id bigint, n_bytes int, hex string")


def token_rows(encoded: DataFrame, ident: str, lengths: DataFrame, key: str = "token") -> DataFrame:
    """Columns (ident, pos, token, n_bytes) of flat encodings; an id without a length has NULL there."""
    rows = encoded.select(F.col(ident), F.posexplode("tokens").alias("pos", "token"))
    return rows.join(vocabulary(lengths.select(F.col(key).alias("__t"), "n_bytes")), F.col("token") == F.col("__t"), "left").select(ident, F.col("pos").cast("bigint").alias("pos"), "token", "n_bytes")


def encode_stats(df: DataFrame, ident: str, text: str, merges: PackMerges, policy: str = ROUTER) -> DataFrame:
    """Columns (pack_id, pack_name, routed_bytes, spans, tokens, token_bytes), one row for each of the four packs.

    Spans and routed bytes count under the pack they were routed to, tokens and their bytes under
    the pack they came out in. Texts are read once; a task sends one row per pack.
    """
    shared = df.sparkSession.sparkContext.broadcast(PackedAutomaton(merges, router(policy)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            ok, row = np.asarray(b.column(1).fill_null(True)), 0
            for data, offsets in _pieces(b.column(0)):
                n = len(offsets) - 1
                for p, sums in shared.value.sums(data, offsets, ok[row : row + n]).items():
                    total[p] = total.get(p, 0) + sums
                row += n
        columns = [pa.array(list(total), pa.int32()), *[pa.array([int(s[i]) for s in total.values()], pa.int64()) for i in range(4)]]
        yield pa.RecordBatch.from_arrays(columns, names=["p", *STATS])

    value = F.col(text)
    parts = df.select(value.alias("v"), F.is_valid_utf8(value.cast("string")).alias("ok")).mapInArrow(count, "p int, " + ", ".join(f"{c} bigint" for c in STATS))
    sums = parts.groupBy("p").agg(*[F.sum(c).alias(c) for c in STATS])
    return all_packs(df).join(sums, F.col("pack_id") == F.col("p"), "left").select("pack_id", "pack_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in STATS])


def pack_transitions(tokens: Column) -> Column:
    """How often neighbouring tokens of an ARRAY<STRUCT<pack, local>> differ in pack."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    packs = F.transform(tokens, lambda t: t["pack"])
    return F.size(F.filter(F.zip_with(F.slice(packs, 1, n), F.slice(packs, 2, n), lambda a, b: a != b), lambda x: x))


def roundtrip_failures(df: DataFrame, ident: str, text: str, merges: PackMerges) -> DataFrame:
    """Rows (ident) whose text is not what its own tokens decode to; none if all is well. Compared row by row, without a join."""
    both = encode_packed(df.select(F.struct(F.col(ident).alias("i"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("raw")).alias("__row"), text), "__row", text, merges)
    back = decode_packed(df.sparkSession.sparkContext, merges)(F.col("tokens"))
    return both.where(F.col("__row.raw") != back).select(F.col("__row.i").alias(ident))
