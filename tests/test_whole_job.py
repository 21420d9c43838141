"""Queries over rows that an earlier form of them left out."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from mergeloom.operators import lm, windows
from tests.tables import NOW, frame


def run(spark, folder, name, **tables):
    for table, rows in tables.items():
        frame(spark, table, rows).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return [tuple(r) for r in entry_point.queries()[name](spark, str(folder)).collect()]


def body(seed: int) -> str:
    return " ".join(f"w{seed * 1000 + i}" for i in range(60))


def unit(i: int, proposed: str | None, text: str, **more) -> dict:
    return dict(unit_id=i, corpus_id=1, source="a.txt", start_byte=0, end_byte=len(text), proposed=proposed, kept=True, body=text, ingested_at=NOW) | more


def test_val_is_validation(spark, tmp_path):
    units = [unit(1, "train", body(1)), unit(2, "val", body(1)), unit(3, " Val\t", body(2)), unit(4, " TEST\n", body(2)), unit(5, "test", body(3)), unit(6, None, body(4))]
    kept = [(1, "train", True), (2, "validation", False), (3, "validation", True), (4, "test", False), (5, "test", True)]
    assert sorted(run(spark, tmp_path, "drop_leaky_blocks", units=units)) == kept
    assert sorted(r[:3] for r in run(spark, tmp_path, "accept_blocks")) == kept
    assert {r[:2] for r in run(spark, tmp_path, "shared_passages")} == {("train", "validation"), ("test", "validation")}
    assert run(spark, tmp_path, "split_composition") == [("a.txt", len(body(1)), 2 * len(body(1)), 2 * len(body(1)), 0)]


def test_unit_spans_of_every_corpus(spark, tmp_path):
    units = [unit(i, "train", "x" * n, corpus_id=c) for i, c, n in ((1, 1, 5), (2, 2, 7), (3, 1, 3), (4, 2, 2), (5, None, 4), (6, 2, 6))]
    sources = [dict(source_id=1, corpus_id=1, name="a.txt", category="code"), dict(source_id=2, corpus_id=2, name="a.txt", category="german-prose")]
    got = run(spark, tmp_path, "unit_spans", units=units, sources=sources)
    one, two = ("code", "rust-source"), ("german-prose", "german-prose")
    assert set(got) == {(1, 0, 5, *one), (1, 5, 8, *one), (2, 0, 7, *two), (2, 7, 9, *two), (2, 9, 15, *two), (None, 0, 4, None, None)} and len(got) == 6


def test_generation_continues_the_whole_sequence(spark, tmp_path):
    spark.createDataFrame([(i, i % 3, i // 3, 1) for i in range(512)], "global_id int, pack_id int, local_id int, n_bytes int").write.parquet(f"{tmp_path}/id_map.parquet")
    rng = random.Random(7)
    tokens = {1: [rng.randrange(512) for _ in range(40)], 2: [rng.randrange(512) for _ in range(16)], 3: [rng.randrange(512) for _ in range(5000)], 4: [9]}
    got = dict(run(spark, tmp_path, "rnn_generate", sequences=[dict(seq_id=i, corpus_id=1, split="train", tokens=x, n_bytes=[1] * len(x), encoded_at=NOW) for i, x in tokens.items()]))
    model = lm.RecurrentModel(16, 16, ((0, 171), (1, 171), (2, 170)), seed=17)
    assert {i: [tuple(t) for t in x] for i, x in got.items()} == {i: model.generate([(t % 3, t // 3) for t in x[-16:]], 4) for i, x in tokens.items()}


def test_batches_hold_every_target(spark, tmp_path):
    sizes = {1: 100, 2: 41, 3: 42, 4: 2, 5: 1, 6: 0}
    got = run(spark, tmp_path, "padded_batches", sequences=[dict(seq_id=i, corpus_id=1, split="train", tokens=list(range(n)), n_bytes=[1] * n, encoded_at=NOW) for i, n in sizes.items()])
    want = [(i, k // 2, k % 2, 16, sum(range(16 * k + 1, min(16 * k + 17, n))), min(16, n - 1 - 16 * k)) for i, n in sizes.items() for k in range((n + 14) // 16) if n > 1]
    assert sorted(got) == sorted(want) and sum(r[-1] for r in got) == 99 + 40 + 41 + 1
    assert sorted(run(spark, tmp_path, "byte_regime")) == [(1, 4, 99, 13), (2, 2, 40, 8), (3, 2, 41, 7), (4, 1, 1, 15)]
    rows = spark.createDataFrame([(1, list(range(50)), 11, 3), (2, list(range(50)), 1, 20)], "seq_id int, tokens array<int>, first int, n int")
    own = windows.padded_batches(rows, "seq_id", "tokens", F.col("first"), F.col("n"), 16, 2).select("seq_id", "targets", "length").collect()
    assert sorted((r.seq_id, r.targets[0], r.length) for r in own) == [(1, 11, 3), (2, 1, 16), (2, 17, 4)]


def slow_match(a, c, limit):
    borders = lambda x: {sum(x[:k]): k for k in range(len(x) + 1)}
    pa, pc = borders(a), borders(c)
    shared = [(o, pa[o], pc[o]) for o in sorted(pa) if o in pc][1:]
    found = [(r[0] - s[0], -s[0], s, r) for k, s in enumerate(shared) for r in shared[k + 1 :] if r[0] - s[0] <= limit]
    if not found:
        return (None,) * 7
    size, _, s, r = max(found)
    return s[0], size, r[0], s[1], r[1], s[2], r[2]


def test_byte_match_of_every_row(spark):
    rng = random.Random(3)
    cases = [([rng.randint(1, 5) for _ in range(rng.randint(0, 30))], [rng.randint(1, 5) for _ in range(rng.randint(0, 30))]) for _ in range(300)] + [(None, [1]), ([1, 2], [1, 2]), ([100, 1], [100, 1]), ([1, 100], [1, 100])]
    df = spark.createDataFrame([(i, a, c) for i, (a, c) in enumerate(cases)], "i int, a array<int>, c array<int>")
    got = {r.i: tuple(r)[1:] for r in df.select("i", windows.byte_match(F.col("a"), F.col("c"), 12).alias("m")).select("i", "m.*").collect()}
    assert got == {i: slow_match(a or [], c or [], 12) for i, (a, c) in enumerate(cases)}


def test_byte_match_reads_every_document(spark, tmp_path):
    merges = [dict(merge_rank=0, left_id=97, right_id=98, result_id=256), dict(merge_rank=1, left_id=256, right_id=49, result_id=257)]
    texts = {1: "abab1ab", 2: "x" * 100, 3: "", 4: None, 5: "ab1", 6: "1ab1a"}
    documents = [dict(doc_id=i, text=x, corpus_id=1 + i % 2, added_at=NOW) for i, x in texts.items()]
    got = {r[0]: r[1:] for r in run(spark, tmp_path, "byte_match", documents=documents, merges=merges)}
    none = (None,) * 7
    # flat: ab|ab1|ab, x..., -, -, ab1, 1|ab1|a; by packs: ab|ab|1|ab, x..., -, -, ab|1, 1|ab|1|a
    assert got == {1: (2, 5, 7, 1, 3, 1, 4), 2: (1, 64, 65, 1, 65, 1, 65), 3: none, 4: none, 5: none, 6: (1, 4, 5, 1, 3, 1, 4)}


def test_training_reads_the_train_split(spark, tmp_path):
    spark.createDataFrame([(i, i % 3, i // 3, 1) for i in range(512)], "global_id int, pack_id int, local_id int, n_bytes int").write.parquet(f"{tmp_path}/id_map.parquet")
    row = lambda i, split, x: dict(seq_id=i, corpus_id=1, split=split, tokens=x, n_bytes=[1] * len(x), encoded_at=NOW)
    got = run(spark, tmp_path, "rnn_train_runs", sequences=[row(1, "Train ", [5, 8] * 20), row(2, "test", list(range(400))), row(3, "train", [5, 8] * 20), row(4, "train", [])])
    model, train = lm.RecurrentModel(16, 16, ((0, 171), (1, 171), (2, 170)), seed=17), [(t % 3, t // 3) for t in [5, 8] * 40]
    want = lm.training_runs(spark.createDataFrame([(17,), (29,), (43,)], "seed bigint"), model, train, 20).collect()
    assert sorted(got) == sorted(map(tuple, want))
