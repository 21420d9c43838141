"""Every training-data query on empty tables, NULLs everywhere, repeated rows and clashing columns."""

from __future__ import annotations

import pytest

from mergeloom.llm.queries import queries
from tests.tables import NOW, SCHEMAS, write

MERGES = [dict(merge_rank=0, left_id=97, right_id=98, result_id=256), dict(merge_rank=1, left_id=256, right_id=99, result_id=257)]
LONG = " ".join(f"word{i % 997} abc" for i in range(60_000))
PASSAGE = " ".join(f"alpha{i}" for i in range(20))
TABLES = {
    "sources": [
        dict(source_id=1, corpus_id=1, name="A.txt", category="Prose ", author="Ann Lee", entity_id=7, raw_bytes=10, contribution=[100, 0, 0], registered_at=NOW),
        dict(source_id=1, corpus_id=1, name="A.txt", category="Prose ", author="Ann Lee", entity_id=7, raw_bytes=10, contribution=[100, 0, 0], registered_at=NOW.replace(day=4)),
        dict(source_id=2, corpus_id=1, name="./a.TXT", category="prose", author="unknown", contribution=[50, 0, 0]),
        dict(source_id=3, corpus_id=1, name="b.txt", category="code", author="LEE, Ann", contribution=None),
        dict(source_id=4, corpus_id=2, name="b.txt", category="code", author="n/a", contribution=[]),
        dict(source_id=5),
    ],
    "units": [
        dict(unit_id=10, corpus_id=1, source=" a.txt", proposed="Train ", body="one two three four five six seven", ingested_at=NOW),
        dict(unit_id=11, corpus_id=1, source="b.txt", proposed="val", body="ONE two, three four five six seven"),
        dict(unit_id=12, corpus_id=1, source="zz.txt", proposed=None, body="one two three four five six seven"),
        dict(unit_id=13, corpus_id=2, source="b.txt", proposed="test", body="one two three four five six seven"),
        dict(unit_id=14, corpus_id=1, source="c.txt", proposed="test", body=""),
        dict(unit_id=15, corpus_id=1, source="c.txt", proposed="train", body=""),
        dict(unit_id=16, corpus_id=1, source="c.txt", proposed="train", body=LONG),
        dict(unit_id=17, corpus_id=1, source="c.txt", proposed="test", body=LONG + " more"),
        dict(unit_id=18),
        dict(corpus_id=1, source="c.txt", proposed="train", body="x"),
    ],
    "sequences": [dict(seq_id=1, tokens=[1, 1, None, 2]), dict(seq_id=1, tokens=[1, 1, None, 2]), dict(seq_id=2, tokens=[]), dict(seq_id=3), dict(tokens=[5]), dict(seq_id=4, tokens=[-9])],
    "pack_stats": [dict(seq_id=1, pack_id=0, tokens=3), dict(seq_id=1, pack_id=0, tokens=3), dict(seq_id=1, pack_id=1), dict(tokens=4)],
    "record_lengths": [dict(record_id=i, run_id=1, tokenizer="M0", rec_date=NOW.date(), rec_len=v) for i, v in enumerate([5, 5, 5, 9, 1000, None, 0, -3])] + [dict(), dict(record_id=0, run_id=1, tokenizer="M0", rec_date=NOW.date(), rec_len=5)],
    "sequence_lengths": [
        dict(summary_id=1, run_id=1, tokenizer="M0", rec_date=NOW.date(), median=5, p95=1000),
        dict(summary_id=2, run_id=1, tokenizer="M0", median=6, p95=1000),
        dict(summary_id=3, run_id=1, tokenizer="M0", median=5, p95=1051),
        dict(summary_id=4, run_id=1, tokenizer="M0", median=None, p95=1),
        dict(summary_id=5, run_id=2, tokenizer="M0", median=5, p95=1),
        dict(summary_id=5, run_id=2, tokenizer="M0", median=5, p95=1),
        dict(),
    ],
    "domain_metrics": [dict(metric_id=1, corpus_id=1, source="s", domain="d", tokens=1), dict(metric_id=2, corpus_id=1, source="s", lang="en", domain="d", tokens=99), dict(metric_id=3), dict(metric_id=4, tokens=7)],
    "documents": [
        dict(doc_id=1, text="abcab", corpus_id=1, source="s", domain="d"),
        dict(doc_id=1, text="abcab", corpus_id=1, source="s", domain="d"),
        dict(doc_id=2, text="ａbсab", corpus_id=1, source="s", lang="en", domain="d"),
        dict(doc_id=3, text=""),
        dict(doc_id=4),
        dict(doc_id=5, text=LONG),
        dict(doc_id=6, text="So " + PASSAGE.upper().replace(" ", ", ").replace("A1", "А1")),
        dict(doc_id=7, text="x²"),
        dict(doc_id=8, text="x2"),
        dict(text="no id"),
    ],
    "mix_targets": [dict(mix_id=1, corpus_id=1, category="PROSE", weight=2.0, max_repeats=2, total_bytes=900), dict(mix_id=1, corpus_id=1, category="code", weight=1.0, max_repeats=1, total_bytes=900), dict(mix_id=2, corpus_id=9, category="none", weight=None, max_repeats=None, total_bytes=None), dict()],
    "eval_items": [dict(item_id=1, text=PASSAGE), dict(item_id=1, text=PASSAGE), dict(item_id=2, text="short"), dict(item_id=3), dict(item_id=4, text="")],
    "merges": MERGES,
    "context_sizes": [dict(context_name="c", capacity_tokens=4), dict(context_name="big", capacity_tokens=1000), dict(context_name="bad", capacity_tokens=0), dict()],
    "split_targets": [dict(split="train", target_share=0.5), dict(split="test", target_share=0.25), dict(split="validation", target_share=0.25)],
}
EXPECTED = {
    "p1_found": {(1, "PROSE"), (1, "code")},
    "p2_found": {(1,), (2,), (3,)},
    "p3_found": {("sequences.tokens", 1, "common"), ("sequences.tokens", 2, "common"), ("sequences.tokens", -9, "common"), ("pack_stats.tokens", 3, "common")},
    "p4_found": {(2,), (3,)},
    "p5_found": {(1,), (2,), (4,)},
    "p6_found": {(10, 11), (14, 15), (16, 17)},
    "p8_found": {(6, 1)},
    "p9_found": {(1, 2)},
}


@pytest.fixture(scope="module")
def full(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("full"), TABLES)


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("clash"), TABLES, extra=True)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), {})


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_hard_rows_and_clashing_columns(spark, full, clashing, name):
    got = queries()[name](spark, full)
    result = got.collect()
    assert sorted(map(repr, result)) == rows(queries()[name](spark, clashing))
    if name in EXPECTED:
        assert {tuple(r) for r in result} == EXPECTED[name] and len(result) == len(EXPECTED[name])


def test_every_table_is_covered():
    assert set(TABLES) == set(SCHEMAS)
