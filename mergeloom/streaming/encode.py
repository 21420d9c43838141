"""Encoding of streams: the batch plans are maps over an immutable vocabulary, so they run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergeloom.operators.encode import PackMerges, encode_packed
from mergeloom.operators.route import pack_of, spans


def encode_stream(stream: DataFrame, ident: str, text: str, merges: PackMerges) -> DataFrame:
    """Columns (ident, tokens) of a streaming DataFrame; stateless."""
    return encode_packed(stream, ident, text, merges)


def pack_counts_stream(stream: DataFrame, text: str) -> DataFrame:
    """Running (pack_id, spans, routed_bytes); for output mode update or complete, state of four rows."""
    rows = stream.select(F.explode(spans(F.col(text))).alias("s"))
    return rows.groupBy(pack_of(F.col("s")).alias("pack_id")).agg(F.count(F.lit(1)).alias("spans"), F.sum(F.octet_length("s")).alias("routed_bytes"))
