"""Tiny tables with the columns of TESTDATA.md, for cases that the given data lack."""

from __future__ import annotations

import datetime as dt

SCHEMAS = {
    "sources": "source_id bigint, corpus_id int, name string, category string, author string, entity_id bigint, raw_bytes bigint, raw_sha256 string, body_start bigint, body_end bigint, contribution array<bigint>, registered_at timestamp",
    "units": "unit_id bigint, corpus_id int, source string, start_byte bigint, end_byte bigint, proposed string, kept boolean, reason string, sha256 string, body string, ingested_at timestamp",
    "sequences": "seq_id bigint, corpus_id int, source string, split string, tokens array<int>, n_bytes array<int>, encoded_at timestamp",
    "pack_stats": "seq_id bigint, pack_id int, routed_bytes bigint, spans bigint, tokens bigint, token_bytes bigint",
    "record_lengths": "record_id bigint, run_id int, tokenizer string, source string, rec_date date, rec_len bigint, logged_at timestamp",
    "sequence_lengths": "summary_id bigint, run_id int, tokenizer string, rec_date date, cnt bigint, len_min bigint, median bigint, p95 bigint, len_max bigint, mean double, written_at timestamp",
    "domain_metrics": "metric_id bigint, corpus_id int, source string, lang string, domain string, available boolean, target_bytes bigint, tokens bigint, nll double, bits_per_byte double, blocks bigint, ci95_low double, ci95_high double, reported_at timestamp",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, corpus_id int, domain string, added_at timestamp",
    "mix_targets": "mix_id int, corpus_id int, category string, weight double, max_repeats int, total_bytes bigint",
    "eval_items": "item_id int, text string, lang string, split string, source string",
    "merges": "merge_rank int, left_id int, right_id int, result_id int",
    "context_sizes": "context_name string, capacity_tokens int",
    "split_targets": "split string, target_share double",
}
NOW = dt.datetime(2031, 3, 3)
#: Names that operators use inside, as columns of every table.
CLASHES = ("key", "w", "n", "rank", "bucket", "tokens_", "look", "raw", "size", "__kept", "__h", "__bin", "split_", "root", "a", "b")


def columns(table: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in SCHEMAS[table].split(", ")]


def row(table: str, **values):
    return tuple(values.get(c) for c in columns(table))


def frame(spark, table: str, rows: list[dict], extra: bool = False):
    df = spark.createDataFrame([row(table, **r) for r in rows], SCHEMAS[table])
    if extra:
        from pyspark.sql import functions as F

        for c in CLASHES:
            df = df.withColumn(c, F.lit("x"))
    return df


def write(spark, folder, tables: dict[str, list[dict]], extra: bool = False) -> str:
    """All tables as parquet; those not given are empty."""
    for t in SCHEMAS:
        frame(spark, t, tables.get(t, []), extra).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
    return str(folder)
