"""Queries of the tokenization operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mergeloom.artifact import NUMBER, STRUCTURE, TEXT
from mergeloom.functions import values as V
from mergeloom.functions.automaton import expansions
from mergeloom.functions.merge_columns import load_automaton, token_count, token_ids
from mergeloom.functions.routing import PACK_OF_BYTE, whole_text
from mergeloom.operators import corpus, encode, lm, mapping, route, stats, train, windows
from mergeloom.operators.ranking import first_arrival, running_sum
from mergeloom.plans import corpus_build, experiments
from mergeloom.session import cut
from mergeloom.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents spread over all cores; a small file is one partition otherwise."""
    rows = t(spark, d, "documents")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores, "doc_id") if rows.rdd.getNumPartitions() < cores else rows


def once_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Sequences by id, once, with as many tokens as lengths and no NULL among them."""
    rows = first_arrival(t(spark, d, "sequences").select("seq_id", "corpus_id", "split", "tokens", "n_bytes", "encoded_at"), ["seq_id"], ["corpus_id", "split", "tokens", "n_bytes"], ["encoded_at"])
    return rows.where("tokens is not null and n_bytes is not null and size(tokens) = size(n_bytes) and not exists(tokens, x -> x is null) and not exists(n_bytes, x -> x is null)")


def once_units(spark: SparkSession, d: str) -> DataFrame:
    """Units by id, once, with a body and a split (spelled in any way that TESTDATA.md allows)."""
    rows = first_arrival(t(spark, d, "units"), ["unit_id"], ["corpus_id", "source", "start_byte", "end_byte", "proposed", "kept", "body"], ["ingested_at"])
    return rows.where("body is not null and unit_id is not null").withColumn("split", corpus.split_name(F.col("proposed"))).where("split in ('train', 'validation', 'test')")


def flat_merges(spark: SparkSession, d: str) -> list[tuple[int, int, int]]:
    return [tuple(map(int, m)) for m in load_automaton(t(spark, d, "merges")).merges]


def own_pack_merges(merges: list[tuple[int, int, int]]) -> dict[int, list[tuple[int, int, int]]]:
    """Merges whose bytes lie in one pack, as pack-local tables: rank and ids count up within each pack."""
    spelled, out, new = expansions(merges), {TEXT: [], NUMBER: [], STRUCTURE: []}, {b: b for b in range(256)}
    for left, right, result in merges:
        packs = {int(PACK_OF_BYTE[b]) for b in spelled[result]}
        if len(packs) == 1:
            own = out[packs.pop()]
            new[result] = 256 + len(own)
            own.append((new[left], new[right], new[result]))
    return out


def packs_of(spark: SparkSession, d: str) -> dict[int, list[tuple[int, int, int]]]:
    return own_pack_merges(flat_merges(spark, d))


# --- routing and bytes


@query
def route_pack_stats(spark, d):
    return route.pack_totals(docs(spark, d), "text")


@query
def route_spans(spark, d):
    return route.span_offsets(docs(spark, d), "doc_id", "text")


@query
def route_spans_text(spark, d):
    return route.span_rows(docs(spark, d), "doc_id", "text").groupBy("pack_id", "span").agg(F.count(F.lit(1)).alias("n")).select("pack_id", route.pack_name(F.col("pack_id")).alias("pack_name"), V.sha256_hex(F.col("span")).alias("span_sha"), "n")


@query
def span_validation(spark, d):
    """Spans without their last one are found to be incomplete."""
    s = F.col("spans")
    rows = docs(spark, d).select("doc_id", "text", route.routed(F.col("text")).alias("spans")).select("doc_id", "text", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))).alias("spans"))
    return route.span_problems(rows, "doc_id", "text", "spans")


@query
def byte_encode_counts(spark, d):
    ids = encode.byte_ids(F.col("text"))
    rows = docs(spark, d).select("doc_id", ids.alias("ids"))
    return rows.select("doc_id", F.size("ids").alias("n"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query
def byte_decode_roundtrip(spark, d):
    back = encode.decode_text(encode.bytes_of(encode.byte_ids(F.col("text"))))
    return docs(spark, d).select(back.alias("back"), "text").groupBy().agg(F.count(F.lit(1)).alias("docs"), F.sum((F.col("back") == F.col("text")).cast("bigint")).alias("same"))


@query
def fnv1a64_docs(spark, d):
    return docs(spark, d).select("doc_id", V.fnv1a64(F.col("text")).alias("h"))


@query
def sha256_docs(spark, d):
    return docs(spark, d).select("doc_id", V.sha256_hex(F.col("text")).alias("sha"))


@query
def rolling_distinct(spark, d):
    return docs(spark, d).select("doc_id", F.size(V.rolling(32, distinct=True)(F.col("text"))).cast("bigint").alias("windows"))


@query
def escape_docs(spark, d):
    rows = docs(spark, d).select("doc_id", V.escape_bytes(F.col("text")).alias("escaped"))
    return rows.select("doc_id", F.length("escaped").alias("chars"), F.sha2("escaped", 256).alias("sha"))


@query
def doc_records(spark, d):
    rows = docs(spark, d).select("doc_id", F.explode(stats.records(F.col("text"))).alias("r"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("r")).alias("n_bytes"), F.max(F.octet_length("r")).alias("longest"))


@query
def marked_bodies(spark, d):
    framed = F.concat(F.lit("header\n*** START OF "), F.col("source"), F.lit("\n"), F.col("text"), F.lit("*** END OF IT"))
    return docs(spark, d).select("doc_id", F.sha2(corpus.marked_body(framed), 256).alias("sha"))


# --- pair statistics and training


@query
def pair_freq_flat(spark, d):
    return train.pair_counts(docs(spark, d).select(encode.byte_ids(F.col("text")).alias("s")), "s")


@query
def pair_freq_by_pack(spark, d):
    rows = train.distinct_spans(docs(spark, d), "text").select("pack_id", encode.byte_ids(F.col("span")).alias("s"), "mult")
    return train.pair_counts(rows, "s", "mult", "pack_id")


@query
def best_pair_by_pack(spark, d):
    return train.best_pairs(pair_freq_by_pack(spark, d))


@query
def global_best_pair(spark, d):
    return train.best_pair(pair_freq_by_pack(spark, d))


@query
def merge_round_16(spark, d):
    """The pair that would be learned after the first 16 merges."""
    coded = encode.encode_flat(docs(spark, d), "doc_id", "text", t(spark, d, "merges").where("merge_rank < 16"))
    return train.best_pair(train.pair_counts(coded, "tokens"))


@query
def bpe_train_packs(spark, d):
    model = train.train_packs(docs(spark, d), "text")
    rows = [(p.pack_id, r, a, b) for p in model.packs for r, (a, b) in enumerate(p.merges)]
    return spark.createDataFrame(rows, "pack_id int, merge_rank int, left_id int, right_id int")


@query
def bpe_train_flat(spark, d):
    model = train.train_flat(docs(spark, d), "text", train.TrainingConfig(512, 256, 2), "document")
    return spark.createDataFrame([(r, *m) for r, m in enumerate(model.merges)], "merge_rank int, left_id int, right_id int, result_id int")


@query
def bpe_first_merges(spark, d):
    """The first 12 merges of flat training over all documents."""
    return bpe_train_flat(spark, d).where("merge_rank < 12")


@query
def bpe_first_pack_merges(spark, d):
    """The first 4 merges of every pack, of pack training over all documents."""
    return bpe_train_packs(spark, d).where("merge_rank < 4")


# --- encoding


@query
def flat_encode_tokens(spark, d):
    coded = encode.encode_flat(docs(spark, d), "doc_id", "text", t(spark, d, "merges"))
    rows = coded.select("doc_id", F.size("tokens").cast("bigint").alias("n"), F.aggregate(F.transform("tokens", lambda x, i: x.cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("checksum"))
    return rows


@query
def flat_token_counts(spark, d):
    coded = encode.encode_flat(docs(spark, d), "doc_id", "text", t(spark, d, "merges"))
    return coded.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query
def flat_decode_roundtrip(spark, d):
    merges = t(spark, d, "merges")
    coded = docs(spark, d).select("text", token_ids(spark.sparkContext, load_automaton(merges))(F.col("text")).alias("tokens"))
    back = encode.decode_flat(spark.sparkContext, flat_merges(spark, d))(F.col("tokens"))
    return coded.select((back == F.col("text").cast("binary")).alias("same"), F.octet_length("text").alias("b")).groupBy().agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("same").cast("bigint")).alias("same"), F.sum("b").alias("n_bytes"))


@query
def pack_encode_tokens(spark, d):
    coded = encode.encode_packed(docs(spark, d), "doc_id", "text", packs_of(spark, d))
    add = lambda f: F.aggregate(F.transform("tokens", f), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return coded.select("doc_id", F.size("tokens").cast("bigint").alias("n"), add(lambda x, i: (x["local"] + 1) * (i + 1)).alias("checksum"), add(lambda x, i: x["pack"].cast("bigint")).alias("packs"), encode.pack_transitions(F.col("tokens")).cast("bigint").alias("transitions"))


@query
def pack_encode_stats(spark, d):
    return encode.encode_stats(docs(spark, d), "doc_id", "text", packs_of(spark, d))


route.register_router("whole-text", whole_text)


@query
def pack_encode_router(spark, d):
    """With another router and all merges in one pack the tokens are those of the flat table."""
    coded = encode.encode_packed(docs(spark, d), "doc_id", "text", {TEXT: flat_merges(spark, d)}, "whole-text")
    local = lambda x, i: (x["local"] + F.when(x["pack"] == TEXT, 256).otherwise(0)) * (i + 1)
    return coded.select("doc_id", F.size("tokens").cast("bigint").alias("n"), F.aggregate(F.transform("tokens", local), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("checksum"))


@query
def adapter_sequences(spark, d):
    """Documents as checked sequences of global ids with their lengths."""
    merges = packs_of(spark, d)
    counts = spark.createDataFrame([(p, len(m)) for p, m in merges.items() if m] + [(65535, 256)], "pack_id int, local_token_count bigint")
    rows = encode.adapt(docs(spark, d), "doc_id", "text", merges, mapping.flatten(counts))
    ids = F.aggregate(F.transform("tokens", lambda x, i: x.cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select("doc_id", F.size("tokens").cast("bigint").alias("n"), ids.alias("checksum"), _sum(F.col("n_bytes")).alias("n_bytes"), "same", "covered")


@query
def decode_errors(spark, d):
    """All sequences decoded under `merges`; rows with an unknown id have the place of the first one."""
    rows = first_arrival(t(spark, d, "sequences"), ["seq_id"], ["tokens"], ["encoded_at"])
    got = rows.select("seq_id", encode.decode_flat_or_error(spark.sparkContext, flat_merges(spark, d))(F.col("tokens")).alias("r"))
    return got.select("seq_id", F.octet_length("r.bytes").alias("n_bytes"), "r.error", "r.error_index")


@query
def pack_invalid_bytes(spark, d):
    """Documents with a byte that is no UTF-8 put after them: byte tokens throughout."""
    broken = docs(spark, d).select("doc_id", F.concat(F.coalesce(F.col("text"), F.lit("")).cast("binary"), F.lit(b"\xff")).alias("raw"))
    coded = encode.encode_packed(broken, "doc_id", "raw", packs_of(spark, d))
    return coded.select("doc_id", F.size("tokens").cast("bigint").alias("n"), F.forall("tokens", lambda x: x["pack"] == 65535).alias("bytes_only"), _sum(F.transform("tokens", lambda x: x["local"])).alias("total"))


@query
def bytes_hex_docs(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(V.bytes_hex(F.col("text")), 256).alias("sha"))


@query
def pack_decode_roundtrip(spark, d):
    return encode.roundtrip_failures(docs(spark, d), "doc_id", "text", packs_of(spark, d)).groupBy().agg(F.count(F.lit(1)).alias("failures"))


@query
def token_lengths(spark, d):
    return encode.length_frame(spark, {0: flat_merges(spark, d)}, flat=True)


@query
def encoding_ratios(spark, d):
    flat = token_count(spark.sparkContext, load_automaton(t(spark, d, "merges")))(F.col("text"))
    rows = docs(spark, d).select(F.struct(flat.alias("flat"), F.octet_length("text").cast("bigint").alias("raw")).alias("own"), "text")
    both = encode.encode_packed(rows, "own", "text", packs_of(spark, d))
    fallback = F.size(F.filter("tokens", lambda x: x["pack"] == 65535)).cast("bigint")
    return stats.encoding_ratios(both.select("own.*", F.size("tokens").cast("bigint").alias("packed"), fallback.alias("fallback")), "raw", "packed", "flat", "fallback")


@query
def flat_model_problems(spark, d):
    """Merges that break a rule: none."""
    m = t(spark, d, "merges")
    own = m.where((F.col("result_id") != F.col("merge_rank") + 256) | (F.col("left_id") >= F.col("result_id")) | (F.col("right_id") >= F.col("result_id"))).agg(F.lit("order").alias("problem"), F.count(F.lit(1)).alias("n"))
    twice = m.groupBy("left_id", "right_id").count().where("count > 1").agg(F.lit("duplicate pair").alias("problem"), F.count(F.lit(1)).alias("n"))
    return own.unionByName(twice)


@query
def merges_first(spark, d):
    return t(spark, d, "merges").orderBy("merge_rank").limit(50).select("merge_rank", V.format_symbol(F.col("left_id")).alias("left_symbol"), V.format_symbol(F.col("right_id")).alias("right_symbol"))


# --- mappings


@query
def id_map_flatten(spark, d):
    packs = t(spark, d, "id_map").groupBy("pack_id").agg(F.count(F.lit(1)).alias("local_token_count"))
    return mapping.flatten(packs)


@query
def id_map_balanced(spark, d):
    rows = [(i, bytearray(x)) for i, x in expansions(flat_merges(spark, d)).items()]
    return mapping.balanced(spark.createDataFrame(rows, "global_id int, expansion binary"), 3)


@query
def id_map_problems(spark, d):
    broken = t(spark, d, "id_map").select("global_id", "pack_id", F.when(F.col("local_id") == 1, 0).otherwise(F.col("local_id")).alias("local_id"))
    return mapping.mapping_problems(broken)


def _tokens(spark, d):
    return first_arrival(t(spark, d, "sequences"), ["seq_id"], ["tokens"], ["encoded_at"]).select("seq_id", F.posexplode("tokens").alias("pos", "token"))


@query
def tokens_to_packed(spark, d):
    return mapping.to_packed(_tokens(spark, d), t(spark, d, "id_map"))


@query
def tokens_unknown(spark, d):
    return mapping.unknown_tokens(_tokens(spark, d).where("token is not null"), t(spark, d, "id_map"))


@query
def tokens_back_to_global(spark, d):
    m = t(spark, d, "id_map")
    rows = mapping.to_packed(_tokens(spark, d), m).where("pack_id is not null")
    return mapping.to_global(rows, m).groupBy("pack_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("global_id") == F.col("token")).cast("bigint")).alias("same"))


@query
def embedding_order(spark, d):
    return mapping.embedding_order(t(spark, d, "id_map"))


@query
def remap_variant_b(spark, d):
    m = t(spark, d, "id_map")
    rows = _tokens(spark, d).where("token between 0 and 511").select("seq_id", "pos", F.lit(0).alias("pack"), F.col("token").alias("local"))
    there = mapping.remap(rows, m, "B")
    back = mapping.unmap(there, m, "B")
    return there.groupBy("mapped_pack").agg(F.count(F.lit(1)).alias("n"), F.sum("mapped_local").alias("locals")).join(back.groupBy(F.col("pack").alias("zero")).agg(F.sum("local").alias("globals")), F.col("zero") == 0).select("mapped_pack", "n", "locals", "globals")


@query
def remap_variants(spark, d):
    """Ids of all variants there and back: A and D stay, C turns packs into flat ids."""
    m = t(spark, d, "id_map")
    flat = _tokens(spark, d).where("token between 0 and 511").select(F.lit(0).alias("pack"), F.col("token").alias("local"))
    own = mapping.to_packed(_tokens(spark, d).where("token between 0 and 511"), m).select(F.col("pack_id").alias("pack"), F.col("local_id").alias("local"))
    out = None
    for v, rows in (("A", flat), ("C", own), ("D", own)):
        there = mapping.remap(rows, m, v)
        back = mapping.unmap(there, m, v)
        one = there.agg(F.lit(v).alias("variant"), F.count(F.lit(1)).alias("n"), F.sum("mapped_pack").alias("packs"), F.sum("mapped_local").alias("locals")).crossJoin(back.agg(F.sum("pack").alias("back_packs"), F.sum("local").alias("back_locals")))  # one row each
        out = one if out is None else out.unionByName(one)
    return out


@query
def tokens_formatted(spark, d):
    rows = t(spark, d, "id_map").select("global_id", V.format_token(F.col("pack_id"), F.col("local_id")).alias("shown"))
    p = V.parse_token(F.col("shown"))
    return rows.select("global_id", "shown", p["pack"].alias("pack"), p["local"].alias("local"))


# --- sequences and windows


@query
def record_length_summary(spark, d):
    rows = t(spark, d, "record_lengths").where("rec_len >= 1").select("record_id", "run_id", "tokenizer", "rec_len").distinct()
    return stats.length_summary(rows, "rec_len", ["run_id", "tokenizer"])


@query
def sequence_problems(spark, d):
    """Sequences that can't be used, with the rule they break."""
    rows = first_arrival(t(spark, d, "sequences"), ["seq_id"], ["tokens", "n_bytes"], ["encoded_at"])
    bad = F.when(F.col("tokens").isNull() | F.col("n_bytes").isNull(), "missing").when(F.size("tokens") != F.size("n_bytes"), "lengths differ").when(F.exists("tokens", lambda x: x.isNull() | (x < 0) | (x >= 512)), "token out of range").when(F.exists("n_bytes", lambda x: x.isNull() | (x < 1)), "no bytes")
    return rows.select("seq_id", bad.alias("problem")).where("problem is not null")


def _sum(c):
    return F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)


@query
def sliding_windows(spark, d):
    rows = windows.sliding_contexts(once_sequences(spark, d), "seq_id", "tokens")
    return rows.select("seq_id", "pos", F.size("context").alias("width"), _sum(F.col("context")).alias("context_sum"), "target")


@query
def tumbling_windows(spark, d):
    rows = windows.tumbling_windows(once_sequences(spark, d), "seq_id", "tokens", 16)
    return rows.select("seq_id", "window_no", F.size("targets").alias("width"), _sum(F.col("inputs")).alias("inputs"), _sum(F.col("targets")).alias("targets"))


@query
def random_windows(spark, d):
    seqs = once_sequences(spark, d)
    seeds = seqs.select("seq_id", F.lit(0).alias("draw"), (F.col("seq_id") * F.lit(2654435761) + 1).alias("state"))
    rows = windows.random_windows(seqs, "seq_id", "tokens", "n_bytes", seeds, 8)
    return rows.select("seq_id", "draw", "start", _sum(F.col("inputs")).alias("inputs"), _sum(F.col("targets")).alias("targets"), "target_bytes")


@query
def padded_batches(spark, d):
    rows = windows.padded_batches(once_sequences(spark, d), "seq_id", "tokens", width=16, rows=2)
    return rows.select("seq_id", "batch", "row", F.size("inputs").alias("width"), _sum(F.col("targets")).alias("targets"), "length")


@query
def prefix_offsets(spark, d):
    return windows.prefix_offsets(once_sequences(spark, d), "seq_id", "n_bytes")


@query
def sequence_target_bytes(spark, d):
    rows = once_sequences(spark, d).select("seq_id", F.posexplode("n_bytes").alias("pos", "n_bytes"))
    return stats.target_bytes(rows, "seq_id")


@query
def head_targets(spark, d):
    rows = mapping.to_packed(_tokens(spark, d), t(spark, d, "id_map")).withColumn("pack", F.col("pack_id"))
    return stats.head_statistics(rows, "seq_id")


@query
def byte_match(spark, d):
    """Of every document, the longest stretch of at most 64 bytes between borders that its flat and its pack-local tokens share; NULLs if there is none."""
    merges, packs = flat_merges(spark, d), packs_of(spark, d)
    flat = F.array(*[F.lit(len(x)) for _, x in sorted(expansions(merges).items())])
    local = {p: F.array(*[F.lit(len(x)) for i, x in sorted(expansions(m).items()) if i >= 256]) for p, m in packs.items()}

    def packed_bytes(token):
        n = F.lit(1)  # byte fallback
        for p, lengths in local.items():
            n = F.when(token["pack"] == p, F.get(lengths, token["local"].cast("int"))).otherwise(n)
        return n

    tokens = token_ids(spark.sparkContext, load_automaton(t(spark, d, "merges")))(F.col("text"))
    both = encode.encode_packed(docs(spark, d).select(F.struct("doc_id", tokens.alias("flat")).alias("doc"), "text"), "doc", "text", packs)
    a = F.transform(F.col("doc.flat"), lambda x: F.get(flat, x))
    rows = both.select(F.col("doc.doc_id").alias("doc_id"), windows.byte_match(a, F.transform("tokens", packed_bytes), 64).alias("m"))
    return rows.select("doc_id", "m.*")


@query
def checkpoint_steps(spark, d):
    return windows.checkpoint_steps(spark.range(1, 1001).withColumnRenamed("id", "step"), 300, 1000)


@query
def pair_windows(spark, d):
    rows = once_sequences(spark, d).select(F.explode(windows.adjacent_pairs(F.col("tokens"))).alias("p"))
    return rows.select("p.*").groupBy("l", "r").agg(F.count(F.lit(1)).alias("n"))


# --- corpus


@query
def blocks_split(spark, d):
    rows = windows.block_rows(docs(spark, d), "doc_id", "text", 96)
    return rows.select("doc_id", "block_no", "start_byte", "end_byte", F.sha2("content", 256).alias("sha"), "split")


@query
def blocks_split_whole(spark, d):
    rows = windows.block_rows(docs(spark, d), "doc_id", "text", 128, whole_corpus=True)
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.col("end_byte") - F.col("start_byte")).alias("n_bytes"))


@query
def split_composition(spark, d):
    rows = once_units(spark, d).withColumn("size", F.octet_length("body").cast("bigint"))
    return corpus.composition(rows, "source", "split", "size", "kept")


@query
def shared_passages(spark, d):
    return corpus.splits_share_passage(once_units(spark, d), "split", "body")


@query
def drop_leaky_blocks(spark, d):
    return corpus.drop_leaky_blocks(once_units(spark, d), "unit_id", "split", "body")


@query
def near_dup_pairs(spark, d):
    return corpus.near_duplicate_pairs(docs(spark, d).select("doc_id", "text"), "doc_id", "text")


@query
def accept_blocks(spark, d):
    return corpus.accept_blocks(once_units(spark, d), "unit_id", "split", "body")


@query
def unit_spans(spark, d):
    units = once_units(spark, d).select("corpus_id", F.col("unit_id").alias("ord"), "source", F.col("start_byte").alias("start"), F.col("end_byte").alias("end"), F.col("split").alias("proposed"), "kept")
    sources = first_arrival(t(spark, d, "sources"), ["corpus_id", "name"], ["category"], ["source_id"])
    rows = corpus.unit_spans(units, sources, "train", "corpus_id")
    return rows.select("corpus_id", "start_byte", "end_byte", "category", V.domain_of(F.col("category")).alias("domain"))


@query
def unit_span_report(spark, d):
    """Kept units of every corpus and split against the contributions that the sources state."""
    units = once_units(spark, d).select("corpus_id", "source", F.col("start_byte").alias("start"), F.col("end_byte").alias("end"), F.col("split").alias("proposed"), "kept")
    sources = first_arrival(t(spark, d, "sources"), ["source_id"], ["corpus_id", "name", "contribution"], ["registered_at"])
    given = sources.select("corpus_id", F.posexplode("contribution").alias("k", "size")).where("k < 3").groupBy("corpus_id", "k").agg(F.sum("size").alias("size"))
    stated = given.select("corpus_id", F.get(F.array(*map(F.lit, ("train", "validation", "test"))), F.col("k")).alias("split"), F.coalesce("size", F.lit(0)).alias("size"))
    return corpus.span_report(units, sources, stated, "corpus_id")


def _files(spark, d):
    return docs(spark, d).select(F.format_string("%012d", "doc_id").alias("name"), F.col("text").cast("binary").alias("content"))


@query
def corpus_build_units(spark, d):
    """Documents as the files of a corpus, in blocks of 96 bytes, leaked ones marked."""
    units = corpus_build.build_units(_files(spark, d), "passages", 96)
    return units.select("source", "start", "end", "proposed", "kept", "sha256")


@query
def corpus_build_splits(spark, d):
    """The near-duplicate builder over all documents in blocks of 256 bytes: its splits."""
    return corpus_build.split_rows(corpus_build.build_units(_files(spark, d), "near", 256))


@query
def corpus_build_sources(spark, d):
    files_ = _files(spark, d)
    rows = corpus_build.source_rows(files_, corpus_build.build_units(files_, "passages", 96))
    return rows.select("name", "raw_bytes", "raw_sha256", *[F.get("contribution", F.lit(i)).alias(s) for i, s in enumerate(("train", "validation", "test"))])


@query
def corpus_build_guard(spark, d):
    """No two splits of a built corpus share a 128-byte passage."""
    shared = corpus_build.shared_passages(corpus_build.build_units(_files(spark, d), "near", 512))
    return shared.agg(F.count(F.lit(1)).alias("sharing_splits"))


@query
def sampled_windows(spark, d):
    return experiments.sampled_windows(once_sequences(spark, d), "seq_id", "n_bytes", [17, 29, 43], 2, 8, 2)


def _doc_spans(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "domain", F.octet_length("text").cast("bigint").alias("n")).where("n > 0")
    return running_sum(rows, ["doc_id"], "n", "end_byte").select((F.col("end_byte") - F.col("n")).alias("start_byte"), "end_byte", "domain")


#: Cells in which tokens meet spans: about as long as a document, so that few spans share one.
SPAN_CELL = 512


def _flat_places(spark, d):
    """(pos, start_byte, end_byte, token) of the flat tokens of all documents joined in order of doc_id; pos is the start."""
    merges = flat_merges(spark, d)
    sizes = F.lit([len(x) for _, x in sorted(expansions(merges).items())])
    tokens = token_ids(spark.sparkContext, load_automaton(t(spark, d, "merges")))(F.col("text"))
    rows = docs(spark, d).where("octet_length(text) > 0").select("doc_id", F.octet_length("text").cast("bigint").alias("n"), tokens.alias("tokens"))
    placed = running_sum(rows, ["doc_id"], "n", "upto").select("doc_id", (F.col("upto") - F.col("n")).alias("first"), "tokens", F.transform("tokens", lambda x: F.get(sizes, x)).alias("n_bytes"))
    ends = F.slice(windows.borders(F.col("n_bytes")), 2, F.size("tokens"))
    one = placed.select("first", F.explode(F.arrays_zip(ends.alias("end"), F.col("tokens").alias("token"), F.col("n_bytes").alias("size"))).alias("x"))
    start = F.col("first") + F.col("x.end") - F.col("x.size")
    return one.select(start.alias("pos"), start.alias("start_byte"), (F.col("first") + F.col("x.end")).alias("end_byte"), F.col("x.token").alias("token"))


@query
def domain_of_token(spark, d):
    """Domains of the flat tokens of all documents joined."""
    return corpus.token_domains(_flat_places(spark, d).select("pos", "start_byte", "end_byte"), cut(_doc_spans(spark, d)), SPAN_CELL)


def _grains(spark, d):
    """Scores of all flat tokens under their own frequencies."""
    tokens = _flat_places(spark, d)
    counts = encode.encode_flat(docs(spark, d), "doc_id", "text", t(spark, d, "merges")).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    priced = cut(counts.select("token", (-F.log(F.col("c") / F.sum("c").over(Window.partitionBy()))).alias("nll")))  # a row per id
    scored = tokens.join(mapping.vocabulary(priced), "token").select("pos", "start_byte", "end_byte", "nll")
    domains = corpus.require_mapped(corpus.token_domains(scored, cut(_doc_spans(spark, d)), SPAN_CELL, ["nll"]))
    rows = domains.select("domain", "start_byte", (F.col("end_byte") - F.col("start_byte")).alias("n_bytes"), "nll")
    return stats.score_grains(rows)


@query
def domain_rollup(spark, d):
    return _grains(spark, d).withColumn("nll", F.round("nll", 4))


@query
def domain_report(spark, d):
    names = [(x,) for x in sorted({*V.DOMAINS.values(), "structured", "mixed-domain", "none"})]
    rows = stats.domain_report(_grains(spark, d), spark.createDataFrame(names, "domain string"))
    return rows.withColumn("nll", F.round("nll", 4)).withColumn("bits_per_byte", F.round("bits_per_byte", 7))


@query
def domain_reconciliation(spark, d):
    return stats.reconcile(_grains(spark, d))


@query
def bootstrap_ci(spark, d):
    return stats.bootstrap(_grains(spark, d))


@query
def bootstrap_order(spark, d):
    """Blocks of every domain, and whether its bounds hold the domain's own bits per byte."""
    grains = cut(_grains(spark, d))
    own = grains.where("grain = 'domain'").select(F.col("domain").alias("d"), V.bits_per_byte(F.col("nll"), F.col("bytes")).alias("bits"))
    rows = stats.bootstrap(grains).join(own, F.col("domain") == F.col("d"))
    inside = (F.col("ci95_low") <= F.col("bits")) & (F.col("bits") <= F.col("ci95_high"))
    return rows.select("domain", "blocks", F.when(F.col("blocks") > 1, inside).alias("inside"))


@query
def capped_sources(spark, d):
    rows = first_arrival(t(spark, d, "sources"), ["source_id"], ["name", "raw_bytes"], ["registered_at"]).where("raw_bytes is not null")
    return corpus.capped_files(rows.select(F.format_string("%010d", "source_id").alias("path"), "raw_bytes"), "path", "raw_bytes", 200_000)


@query
def synthetic_json(spark, d):
    return corpus.synthetic_json(spark, 2000)


@query
def synthetic_unicode(spark, d):
    return corpus.synthetic_unicode(spark, 2000).select("i", F.sha2("line", 256).alias("sha"))


@query
def split_token_sets(spark, d):
    """Distinct tokens of train and of the held-out splits: both, either, train only."""
    rows = once_sequences(spark, d).select(F.lower(F.trim("split")).alias("split"), F.explode("tokens").alias("token")).distinct()
    a, b = rows.where("split = 'train'").select("token"), rows.where("split <> 'train'").select("token").distinct()
    one = lambda df, name: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
    return one(a.intersect(b), "both").unionByName(one(a.union(b).distinct(), "either")).unionByName(one(a.subtract(b), "train only"))


@query
def shared_passages_128(spark, d):
    return corpus.splits_share_passage(once_units(spark, d), "split", "body", corpus.PASSAGE)


@query
def unit_hash_problems(spark, d):
    """Units whose body hasn't the stated hash; upper case makes no difference."""
    rows = first_arrival(t(spark, d, "units"), ["unit_id"], ["sha256", "body"], ["ingested_at"]).where("body is not null and sha256 is not null").select(F.col("unit_id").cast("string").alias("path"), "sha256", F.col("body").cast("binary").alias("content"))
    return files.verify_hashes(rows.select("path", "content"), rows.select("path", "sha256", F.length("content").alias("size")))


@query
def near_neighbours(spark, d):
    """Whether every document is a near-duplicate of the one with the next id."""
    sets = corpus.shingle_sets(docs(spark, d), "doc_id", "text")
    after = sets.select((F.col("doc_id") - 1).alias("before"), F.col("shingles").alias("next"))
    return sets.join(after.hint("merge"), F.col("doc_id") == F.col("before")).select("doc_id", V.near(F.col("shingles"), F.col("next")).alias("near"))


@query
def train_paths(spark, d):
    return t(spark, d, "sources").select(V.train_path(F.col("name")).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


# --- numbers of experiments


@query
def metric_mean_sd(spark, d):
    rows = first_arrival(t(spark, d, "domain_metrics"), ["metric_id"], ["domain", "blocks"], ["reported_at"])
    return stats.mean_sd(rows.select("domain", F.col("blocks").cast("double").alias("v")), "v", ["domain"]).select("domain", "n", *[F.round(c, 9).alias(c) for c in ("mean", "variance", "sd")])


@query
def metric_bits(spark, d):
    rows = first_arrival(t(spark, d, "domain_metrics"), ["metric_id"], ["nll", "target_bytes"], ["reported_at"])
    return rows.select("metric_id", F.round(V.bits_per_byte(F.col("nll"), F.col("target_bytes")), 9).alias("bits"), F.round(V.nll_per_byte(F.col("nll"), F.col("target_bytes")), 9).alias("nats"))


@query
def throughputs(spark, d):
    """MiB a second if every block took a second."""
    rows = first_arrival(t(spark, d, "domain_metrics"), ["metric_id"], ["target_bytes", "blocks"], ["reported_at"])
    return rows.select("metric_id", F.round(V.mib_per_second(F.col("target_bytes"), F.col("blocks")), 9).alias("mib_per_second"))


@query
def close_metrics(spark, d):
    """Which stated bits per byte are those of the stated losses, within the tolerance."""
    rows = first_arrival(t(spark, d, "domain_metrics"), ["metric_id"], ["nll", "target_bytes", "bits_per_byte"], ["reported_at"])
    return rows.select("metric_id", experiments.close(F.col("bits_per_byte"), V.bits_per_byte(F.col("nll"), F.col("target_bytes"))).alias("close"))


@query
def metrics_progress(spark, d):
    """Where a run's log ends, by run of the summaries as log lines."""
    rows = first_arrival(t(spark, d, "sequence_lengths"), ["summary_id"], ["cnt"], ["written_at"])
    lines = rows.select(F.col("summary_id").alias("ord"), F.format_string('{"stage":"train","step":%d,"wall_seconds":%d.5,"peak_vram_mib":%d}', F.col("summary_id"), F.coalesce("cnt", F.lit(0)), F.col("summary_id") % 13).alias("value"))
    return files.progress(files.metrics_log(lines)).select("step", "wall_seconds", "peak_vram_mib")


@query
def schedule_plan(spark, d):
    """What 100 batches cover of every split's tokens."""
    rows = once_sequences(spark, d).select(corpus.split_name(F.col("split")).alias("split"), F.size("tokens").alias("n")).groupBy("split").agg(F.sum("n").alias("tokens"))
    return experiments.schedules(rows, "split", "tokens", 100, 16, 4).withColumn("passes", F.round("passes", 9))


@query
def weighted_loss(spark, d):
    rows = first_arrival(t(spark, d, "sequence_lengths"), ["summary_id"], ["tokenizer", "mean", "cnt"], ["written_at"]).where("mean is not null and cnt is not null")
    return stats.weighted_loss(rows, "mean", "cnt", ["tokenizer"]).select("tokenizer", F.round("loss", 6).alias("loss"))


@query
def paired_contrasts(spark, d):
    runs = first_arrival(t(spark, d, "sequence_lengths"), ["summary_id"], ["run_id", "tokenizer", "rec_date", "cnt"], ["written_at"]).where("rec_date is null")
    rows = runs.select(F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("run_id") % 4 + 1).cast("int")).alias("variant"), F.col("tokenizer").alias("regime"), F.floor(F.col("run_id") / 4).alias("seed"), F.col("cnt").cast("double").alias("bits"))
    return stats.paired_contrasts(rows)


@query
def loss_events(spark, d):
    rows = first_arrival(t(spark, d, "sequence_lengths"), ["summary_id"], ["tokenizer", "cnt"], ["written_at"]).where("cnt is not null")
    return stats.loss_events(rows.select("tokenizer", "summary_id", F.col("cnt").cast("double").alias("loss")), "tokenizer", "summary_id", "loss")


@query
def stagnation(spark, d):
    rows = spark.range(1, 401).select(F.lit("r").alias("run"), F.col("id").alias("step"), F.greatest(F.lit(1.0), F.lit(4.0) - F.col("id") * 0.01).alias("loss"))
    return stats.stagnation(rows, "run", "step", "loss")


@query
def log_summary(spark, d):
    rows = first_arrival(t(spark, d, "sequence_lengths"), ["summary_id"], ["tokenizer", "run_id", "cnt"], ["written_at"]).where("cnt is not null and run_id is not null")
    lines = rows.select(F.format_string("variant=%s run=%d updates=%d", "tokenizer", "run_id", "cnt").alias("line"))
    return stats.log_table(lines, "line", ["variant"], ["updates"]).select("variant", F.round("updates_mean", 6).alias("updates_mean"), F.round("updates_sd", 6).alias("updates_sd"))


@query
def metrics_truncated(spark, d):
    rows = first_arrival(t(spark, d, "sequence_lengths"), ["summary_id"], ["cnt"], ["written_at"])
    lines = rows.select(F.col("summary_id").alias("ord"), F.when(F.col("summary_id") % 10 == 9, '{"step": 1').otherwise(F.format_string('{"stage":"train","step":%d,"wall_seconds":%d.5,"peak_vram_mib":%d}', F.col("summary_id"), F.coalesce("cnt", F.lit(0)), F.col("summary_id") % 13)).alias("value"))
    return files.truncate_metrics(files.metrics_log(lines), 30).select("ord", "stage", "step", "wall_seconds", "peak_vram_mib")


@query
def lr_schedule(spark, d):
    s = spark.range(101).select(F.col("id").alias("step"))
    return s.select("step", F.round(V.learning_rate(F.col("step"), 0.0003, 10, 100, "cosine"), 12).alias("cosine"), F.round(V.learning_rate(F.col("step"), 0.0003, 10, 100, "constant"), 12).alias("constant"))


@query
def xorshift_states(spark, d):
    s = spark.range(1000).select(F.col("id").alias("seed"), V.xorshift(F.col("id") * F.lit(6364136223846793)).alias("x1"))
    return s.select("seed", "x1", V.xorshift(F.col("x1")).alias("x2"), V.unsigned_modulo(F.col("x1"), F.lit(1009).cast("bigint")).alias("pick"))


@query
def parameter_counts(spark, d):
    rows = spark.createDataFrame([(512, 16, 16, 4), (512, 64, 32, 4), (340, 8, 16, 3)], "v bigint, d bigint, c bigint, p bigint")
    v, h, c, p = (F.col(x) for x in "vdcp")
    flat, fact = V.flat_parameters(v, h, c), V.factorized_parameters(v, p, h, c)
    return rows.select("v", "d", flat.alias("flat"), fact.alias("factorized"), V.serialized_size(flat, F.lit(1)).alias("flat_bytes"), V.serialized_size(fact, p).alias("factorized_bytes"), V.transformer_parameters(v, F.lit(384), F.lit(8), F.lit(1536), F.lit(256)).cast("bigint").alias("transformer"))


@query
def mac_estimate(spark, d):
    sizes = t(spark, d, "id_map").groupBy("pack_id").agg(F.count(F.lit(1)).alias("rows"))
    return sizes.select("pack_id", V.window_macs(F.lit(16).cast("bigint"), F.lit(16), F.lit(512)).alias("flat"), V.window_macs(F.lit(16).cast("bigint"), F.lit(16), F.col("rows") + 4).alias("packed"))


@query
def softmax_ce(spark, d):
    target = F.col("label") % F.size("embedding")
    return t(spark, d, "embeddings").select("vec_id", F.round(V.softmax_loss(F.col("embedding"), target), 6).alias("loss"), V.argmax(F.col("embedding")).alias("best"))


@query
def evaluation_plan(spark, d):
    return experiments.evaluation_plan(once_sequences(spark, d), "seq_id", "n_bytes", 16)


@query
def byte_regime(spark, d):
    return experiments.byte_regime(once_sequences(spark, d), "seq_id", "tokens", width=16, rows=2)


@query
def source_identities(spark, d):
    rows = first_arrival(t(spark, d, "sources"), ["source_id"], ["name", "raw_sha256"], ["registered_at"])
    return rows.select("source_id", experiments.identity(F.col("name"), F.col("raw_sha256")).alias("identity"))


@query
def registry_problems(spark, d):
    """Packs of the id map without the byte fallback's 256 ids, and special tokens that break rules."""
    packs = t(spark, d, "id_map").groupBy("pack_id").agg(F.count(F.lit(1)).alias("local_token_count")).where("pack_id <> 65535").withColumn("name", F.lit("same"))
    specials = spark.createDataFrame([(0, 0, "a"), (0, 0, "a"), (0, 99999, ""), (77, 1, "u")], "pack int, local int, name string")
    return route.registry_problems(packs, specials)


# --- the small language model


def _lm(spark, d):
    pairs = t(spark, d, "id_map").orderBy("global_id").select("pack_id", "local_id").collect()
    counts: dict[int, int] = {}
    for p, _ in pairs:
        counts[p] = counts.get(p, 0) + 1
    return lm.RecurrentModel(16, 16, tuple(counts.items()), seed=17), pairs


def _packed_sequences(spark, d):
    """Usable sequences with (pack, local) tokens, looked up by position in the id map."""
    rows = mapping.bounded(t(spark, d, "id_map").select("global_id", "pack_id", "local_id"), mapping.MAX_IDS).orderBy("global_id").collect()
    packs, locals_ = F.lit([r.pack_id for r in rows]), F.lit([r.local_id for r in rows])
    tokens = F.transform("tokens", lambda x: F.struct(F.get(packs, x).alias("pack"), F.get(locals_, x).cast("bigint").alias("local")))
    return once_sequences(spark, d).where("not exists(tokens, x -> x < 0 or x >= 512)").select("seq_id", "split", tokens.alias("tokens"), "n_bytes")


@query
def rnn_score(spark, d):
    model, _ = _lm(spark, d)
    return lm.evaluation(lm.score(_packed_sequences(spark, d), model, "seq_id", "tokens"), len(model.packs))


@query
def rnn_split_score(spark, d):
    """Metrics of every split on its own."""
    model, _ = _lm(spark, d)
    rows = _packed_sequences(spark, d).select(F.struct("seq_id", corpus.split_name(F.col("split")).alias("split")).alias("i"), "tokens")
    scored = lm.score(rows, model, "i", "tokens").select(F.col("i.split").alias("split"), "nll", "right")
    return scored.groupBy("split").agg(F.count(F.lit(1)).alias("targets"), (F.avg("nll") > 0).alias("scored"))


@query
def rnn_targets(spark, d):
    """What of the scores doesn't depend on the weights: targets, head sizes, sums of heads and accuracies in bounds, by pack."""
    model, _ = _lm(spark, d)
    scored = lm.score(_packed_sequences(spark, d), model, "seq_id", "tokens")
    sane = (F.col("pack_nll") > 0) & (F.col("token_nll") > 0) & (F.abs(F.col("nll") - F.col("pack_nll") - F.col("token_nll")) < 1e-9) & (F.col("right") == (F.col("pack_right") & F.col("local_right")))
    return scored.groupBy("pack").agg(F.count(F.lit(1)).alias("targets"), F.max("active").alias("head_size"), F.bool_and(sane).alias("sane"))


@query
def rnn_active_head(spark, d):
    """Mean size of the active head and the pack head's share of all logits."""
    model, _ = _lm(spark, d)
    got = lm.evaluation(lm.score(_packed_sequences(spark, d), model, "seq_id", "tokens"), len(model.packs))
    return got.select("targets", F.round("active_head_mean", 6).alias("active_head_mean"), F.round("pack_logit_share", 9).alias("pack_logit_share"))


@query
def head_transitions(spark, d):
    rows = _packed_sequences(spark, d)
    return stats.head_transitions(rows, F.transform("tokens", lambda x: x["pack"])).withColumn("fallback_share", F.round("fallback_share", 9))


@query
def rnn_pack_accuracy(spark, d):
    model, _ = _lm(spark, d)
    return lm.pack_accuracy(lm.score(_packed_sequences(spark, d), model, "seq_id", "tokens"))


def _joined_tokens(coded: DataFrame) -> DataFrame:
    """(pos, pack, local) of rows (doc_id, tokens ARRAY<STRUCT<pack, local>>), joined in order of doc_id."""
    sized = coded.withColumn("n", F.size("tokens").cast("bigint"))
    return running_sum(sized, ["doc_id"], "n", "upto").select((F.col("upto") - F.col("n")).alias("first"), F.posexplode("tokens").alias("k", "x")).select((F.col("first") + F.col("k")).alias("pos"), F.col("x.pack").alias("pack"), F.col("x.local").alias("local"))


@query
def rnn_train_runs(spark, d):
    """The factorized model on windows drawn from all tokens of the train split, sequences joined in order of seq_id."""
    model, _ = _lm(spark, d)
    rows = _packed_sequences(spark, d).where(corpus.split_name(F.col("split")) == "train").select(F.col("seq_id").alias("doc_id"), "tokens")
    tokens, seeds = cut(_joined_tokens(rows)), (17, 29, 43)
    draws = lm.window_draws(spark, [(str(s), s, 20) for s in seeds], tokens.count(), model.context, 4)
    got = lm.train_drawn(draws, tokens, {str(s): replace(model, seed=s, weights={}) for s in seeds})
    return got.select(F.col("run").cast("bigint").alias("seed"), "step", "loss_per_token", "gradient_norm", "macs")


ABLATION_SEEDS, ABLATION_UPDATES = (17, 29, 43), 12


@query
def rnn_ablation(spark, d):
    """Variants A to D over all documents, three seeds, two budgets: equal updates, and equal multiplications to A's.

    A: flat tokens, flat head. B: flat tokens in balanced packs. C: pack tokens, flattened, flat head. D: pack tokens in their packs.
    """
    merges, packs = flat_merges(spark, d), packs_of(spark, d)
    flat = docs(spark, d).select("doc_id", F.transform(token_ids(spark.sparkContext, load_automaton(t(spark, d, "merges")))(F.col("text")), lambda x: F.struct(F.lit(0).alias("pack"), x.cast("bigint").alias("local"))).alias("tokens"))
    a = cut(_joined_tokens(flat))
    own = cut(_joined_tokens(encode.encode_packed(docs(spark, d), "doc_id", "text", packs)))
    spelled = spark.createDataFrame([(i, bytearray(x)) for i, x in expansions(merges).items()], "global_id int, expansion binary")
    sizes = {p: len(m) for p, m in packs.items() if m} | {65535: 256}
    flattened = mapping.flatten(spark.createDataFrame(list(sizes.items()), "pack_id int, local_token_count bigint"))
    mapped = lambda rows, m, v: mapping.remap(rows, m, v).select("pos", F.col("mapped_pack").alias("pack"), F.col("mapped_local").cast("bigint").alias("local"))
    v = 256 + len(merges)
    balanced = {p: len(range(p, v, 3)) for p in range(3)}
    tokens = {"A": a, "B": mapped(a, mapping.balanced(spelled, 3), "B"), "C": mapped(own, flattened, "C"), "D": own}
    model = {"A": lm.RecurrentModel(16, 16, (), v, 17), "B": lm.RecurrentModel(16, 16, tuple(balanced.items()), 0, 17), "C": lm.RecurrentModel(16, 16, (), sum(sizes.values()), 17), "D": lm.RecurrentModel(16, 16, tuple(sizes.items()), 0, 17)}
    window = np.zeros((4, 16), np.int64)
    cost = {k: m.macs(window, window) for k, m in model.items()}
    out = None
    for name, rows in tokens.items():
        budgets = {"updates": ABLATION_UPDATES, "macs": max(1, round(ABLATION_UPDATES * cost["A"] / cost[name]))}
        runs = [(f"{name} {regime} {seed}", seed, n) for regime, n in budgets.items() for seed in ABLATION_SEEDS]
        got = lm.train_drawn(lm.window_draws(spark, runs, rows.count(), 16, 4), rows, {r: replace(model[name], seed=s, weights={}) for r, s, _ in runs})
        out = got if out is None else out.unionByName(got)
    parts = F.split("run", " ")
    last = out.groupBy("run").agg(F.max("step").alias("updates"), F.max_by("loss_per_token", "step").alias("last_loss"), F.sum("macs").alias("macs"))
    return last.select(parts[0].alias("variant"), parts[1].alias("regime"), parts[2].cast("bigint").alias("seed"), "updates", "last_loss", "macs")


@query
def rnn_ablation_plan(spark, d):
    """Updates of every run of the ablation, and the multiplications of flat heads, which don't depend on what is drawn."""
    rows = rnn_ablation(spark, d)
    return rows.select("variant", "regime", "seed", "updates", F.when(F.col("variant").isin("A", "C"), F.col("macs")).alias("macs"), (F.col("last_loss") > 0).alias("scored"))


@query
def train_run_steps(spark, d):
    return rnn_train_runs(spark, d).groupBy("seed").agg(F.max("step").alias("steps"), F.bool_and((F.col("loss_per_token") > 0) & (F.col("gradient_norm") > 0)).alias("finite"))


@query
def generated_lengths(spark, d):
    return rnn_generate(spark, d).select("seq_id", F.size("tokens").alias("n"))


@query
def generated_packs(spark, d):
    """Distribution of packs over all greedy continuations."""
    return rnn_generate(spark, d).select(F.explode("tokens").alias("x")).groupBy(F.col("x.pack").alias("pack")).agg(F.count(F.lit(1)).alias("n"))


@query
def rnn_generate(spark, d):
    model, _ = _lm(spark, d)
    prompts = _packed_sequences(spark, d).where("size(tokens) > 0").select("seq_id", "tokens")
    return lm.generate(prompts, model, "seq_id", "tokens", 4)
