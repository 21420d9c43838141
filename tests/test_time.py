"""Work that grew too fast with the input: training as few jobs, byte texts without a call per byte."""

from __future__ import annotations

import random
import time
from functools import partial

import numpy as np
from pyspark.sql import functions as F

from mergeloom.functions import values
from mergeloom.operators import encode, train
from mergeloom.plans.queries import QUERIES
from tests.tables import NOW, frame


def jobs_of(spark, f):
    """The result of f and the number of jobs it ran."""
    sc, group = spark.sparkContext, f"jobs-{random.random()}"
    sc.setJobGroup(group, "")
    try:
        return f(), len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def texts(n: int) -> list[str]:
    rng = random.Random(11)
    return ["".join(rng.choice("aab1 ä") for _ in range(rng.randrange(60))) for _ in range(n)] * 2


def test_training_of_many_tasks_is_a_few_jobs(spark, monkeypatch):
    df = spark.createDataFrame([(x,) for x in texts(40)], "v string").repartition(3)
    cfg = train.TrainingConfig(512, 30, 2)
    few = train.TrainingConfig(512, 2, 2)
    for learn, rounds in ((partial(train.train_packs, df, "v", cfg), partial(train.train_packs, df, "v", few)), (partial(train.train_flat, df, "v", cfg, "document"), partial(train.train_flat, df, "v", few, "document"))):
        want = learn()
        got, jobs = jobs_of(spark, partial(learn, local_bytes=0))
        assert got == want and jobs <= 15
        with monkeypatch.context() as m:
            m.setattr(train, "TASK_BYTES", 0)
            assert rounds(local_bytes=0) == rounds()


def test_changed_counts_are_the_counts(monkeypatch):
    rng, pick = random.Random(2), np.random.default_rng(2)
    for block in (7, 1 << 18):
        monkeypatch.setattr(train, "BLOCK", block)
        for _ in range(60):
            size = pick.integers(0, 12, 20)
            begin = np.concatenate(([0], np.cumsum(size)))
            s = train.Sequences(pick.integers(97, 100, begin[-1]), begin, pick.integers(1, 4, 20) if rng.random() < 0.5 else np.ones(20, np.int64))
            total, ids = s.counts(2000), [97, 98, 99]
            for result in (256, 257, 258, 259):
                left, right = rng.choice(ids), rng.choice(ids)
                total = train._tally([total, s.replace(left, right, result, 2000)], 2000)
                want = train.Sequences(*s.lists(), np.ones(20, np.int64)).counts(2000) if all(w is None for _, w, _ in s.blocks) else s.counts(2000)
                assert [x.tolist() for x in total] == [x.tolist() for x in want]
                ids.append(result)


def test_ids_beyond_16_bits():
    s = train.Sequences(np.array([97, 98, 97, 98, 99]), np.array([0, 4, 5]), np.array([1, 1]))
    s.replace(97, 98, 256)
    s.replace(256, 256, 70_000)
    assert [x.tolist() for x in s.lists()] == [[70_000, 99], [0, 1, 2]]


def seconds(f):
    began = time.time()
    return f(), time.time() - began


def test_escaping_one_long_text(spark):
    data = bytes(range(256)) * 1600
    df = spark.createDataFrame([(bytearray(data),), (bytearray(b""),), (None,)], "v binary")
    got, took = seconds(lambda: [r[0] for r in df.select(values.escape_bytes(F.col("v"))).collect()])
    named = {92: "\\\\", 34: '\\"', 10: "\\n", 13: "\\r", 9: "\\t"}
    assert got == ["".join(named.get(b) or (chr(b) if 32 <= b <= 126 else f"\\x{b:02X}") for b in data), "", None]
    assert took < 30


def test_bytes_of_one_long_text(spark):
    data = bytes(range(256)) * 1600
    rows = [data, b"", None, "ä\0".encode()]
    df = spark.createDataFrame([(None if x is None else bytearray(x),) for x in rows], "v binary")
    ids = encode.byte_ids(F.col("v"))
    got, took = seconds(lambda: df.select(ids.alias("ids"), encode.bytes_of(ids).alias("back")).collect())
    assert [r.ids for r in got] == [None if x is None else list(x) for x in rows]
    assert [None if r.back is None else bytes(r.back) for r in got] == rows
    assert took < 30


def test_first_merges_of_many_tasks_are_a_few_jobs(spark, tmp_path, monkeypatch):
    frame(spark, "documents", [dict(doc_id=i, text=x, corpus_id=1, added_at=NOW) for i, x in enumerate([*texts(20), None])]).write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda: [tuple(r) for r in QUERIES["bpe_first_merges"](spark, str(tmp_path)).collect()]
    want = run()
    monkeypatch.setattr(train, "train_flat", partial(train.train_flat, local_bytes=0))
    got, jobs = jobs_of(spark, run)
    assert got == want and len(got) == 12 and jobs <= 15
