"""The corpus builder with its commands, span checks, drawn windows and shared passages, against slow versions."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest

from mergeloom import cli
from mergeloom.artifact import Artifact, PackedModel, PackModel, write_new
from mergeloom.errors import CorpusError, LanguageModelError
from mergeloom.functions import values as V
from mergeloom.operators import corpus, lm
from mergeloom.plans import corpus_build
from mergeloom.sources import files


def some_files(n: int = 30, seed: int = 3) -> dict[str, bytes]:
    rng = random.Random(seed)
    shared = bytes(rng.choice(b"abcdefgh \n") for _ in range(400))
    out = {}
    for i in range(n):
        body = bytes(rng.choice(b"abcdefgh \n") for _ in range(rng.randint(0, 6000)))
        out[f"d/f{i:02}.txt"] = body[:1000] + (shared if i % 3 == 0 else b"") + body[1000:] + "é漢".encode()
    return out


def frame(spark, contents):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "name string, content binary")


@pytest.mark.parametrize("mode", ["passages", "near"])
def test_built_corpus_covers_its_files_and_shares_no_passage(spark, mode):
    contents = some_files()
    df = frame(spark, contents)
    units = corpus_build.build_units(df, mode, 128).collect()
    for name, raw in contents.items():
        own = sorted((u for u in units if u.source == name), key=lambda u: u.start)
        assert b"".join(bytes(u.body) for u in own) == raw and [u.start for u in own] == [0, *[u.end for u in own[:-1]]]
    kept = {s: [bytes(u.body) for u in units if u.kept and u.proposed == s] for s in ("train", "validation", "test")}
    grams = {s: {b[i : i + 128] for b in bs for i in range(len(b) - 127)} for s, bs in kept.items()}
    assert not (grams["train"] & grams["validation"] or grams["train"] & grams["test"] or grams["validation"] & grams["test"])
    dropped = [u for u in units if not u.kept]
    assert all(u.proposed != "train" and u.reason != "accepted" for u in dropped) and all(u.reason == "accepted" for u in units if u.kept)
    with pytest.raises(CorpusError):
        corpus_build.build_units(df, "other")


def test_commands_build_prepare_verify_and_plan(spark, tmp_path, capsys):
    source = tmp_path / "in"
    for name, raw in some_files(12).items():
        (source / name).parent.mkdir(parents=True, exist_ok=True)
        (source / name).write_bytes(raw)
    artifact, folder = str(tmp_path / "a"), str(tmp_path / "out")
    write_new(artifact, Artifact.of_packs(PackedModel((PackModel(0, ((97, 98), (256, 99))), PackModel(2, ((32, 10),)))), {}).to_bytes())
    assert cli.main(["corpus", str(source), folder, "--block-bytes", "256"]) == 0
    manifest = json.loads((tmp_path / "out/manifest.json").read_text())
    assert manifest["shared_passages"] == 0 and sum(v["bytes"] for v in manifest["splits"].values()) > 10_000
    assert cli.main(["prepare", folder, artifact]) == 0 and cli.main(["verify-prepared", folder]) == 0
    capsys.readouterr()
    assert cli.main(["plan", folder]) == 0
    parsed = [dict(x.split("=") for x in line.split(" ")) for line in capsys.readouterr().out.splitlines()]
    lines = {x["split"]: x for x in parsed}
    assert set(lines) == set(manifest["splits"])
    rows = spark.read.parquet(f"{folder}/prepared").collect()
    assert all(int(lines[s]["tokens"]) == sum(len(r.tokens) for r in rows if r.split == s) for s in lines)
    assert {s: sum(sum(r.n_bytes) for r in rows if r.split == s) for s in lines} == {s: v["bytes"] for s, v in manifest["splits"].items()}
    spark.createDataFrame([r.asDict() | {"sha256": "00"} if r.start == 0 else r.asDict() for r in rows], spark.read.parquet(f"{folder}/prepared").schema).write.mode("overwrite").parquet(f"{folder}/prepared")
    assert cli.main(["verify-prepared", folder]) == 1
    assert cli.main(["corpus", str(source), folder]) == 1  # nothing is overwritten


def test_span_report_names_what_is_missing(spark):
    units = spark.createDataFrame([(1, "a", 0, 5, "train", True), (1, "b", 0, 4, "train", True), (1, "a", 5, 5, "test", True), (1, "a", 5, 9, "test", False), (None, "a", 0, 3, "test", True)], "c int, source string, start bigint, end bigint, proposed string, kept boolean")
    sources = spark.createDataFrame([(1, "a"), (None, "a")], "c int, name string")
    stated = spark.createDataFrame([(1, "train", 9), (2, "validation", 7), (None, "test", 3)], "c int, split string, size int")
    rows = {(r.c, r.split): r for r in corpus.span_report(units, sources, stated, "c").collect()}
    got = {k: (r.units, r.unit_bytes, r.empty_units, r.unknown_sources, r.stated_bytes, r.covered) for k, r in rows.items()}
    assert got == {(1, "train"): (2, 9, 0, 1, 9, False), (1, "test"): (1, 0, 1, 0, 0, False), (2, "validation"): (0, 0, 0, 0, 7, False), (None, "test"): (1, 3, 0, 0, 3, True)}
    with pytest.raises(CorpusError):
        corpus.require_covered(corpus.span_report(units, sources, stated, "c"))
    gap = spark.createDataFrame([(0, 0, 4, None)], "pos int, start_byte int, end_byte int, domain string")
    with pytest.raises(Exception, match="no span at byte 0"):
        corpus.require_mapped(gap).collect()


def test_anchors_stand_in_for_all_windows():
    rng = random.Random(7)
    for k in (4, 32, 33, 128):
        a, b = (bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 400))) for _ in range(2))
        mid = bytes(rng.choice(b"abc") for _ in range(k + 5))
        a, b = a + mid + a[:50], b[:77] + mid + b
        one, two = ({x[i : i + k]: int(n) for i, n in enumerate(V.window_anchors(x, k))} for x in (a, b))
        assert all(one[w] == two[w] for w in one.keys() & two.keys()) and len(V.window_anchors(a, k)) == len(a) - k + 1
        assert len(V.window_anchors(b"x" * (k - 1), k)) == 0


def test_drawn_windows_train_like_the_whole_split(spark):
    rng = np.random.default_rng(1)
    pack, local = rng.integers(0, 2, 300), rng.integers(0, 5, 300)
    tokens = spark.createDataFrame([(i, int(p), int(x)) for i, (p, x) in enumerate(zip(pack, local))], "pos bigint, pack int, local bigint")
    model = lm.RecurrentModel(4, 6, ((0, 5), (1, 5)), 0, 17)
    draws = lm.window_draws(spark, [("r", 17, 5)], 300, 6, 3)
    got = [r.loss_per_token for r in lm.train_drawn(draws, tokens, {"r": model}).orderBy("step").collect()]
    want = lm.training_runs(spark.createDataFrame([(17,)], "seed bigint"), model, np.stack([pack, local], 1), 5, 3).orderBy("step").collect()
    assert got == pytest.approx([r.loss_per_token for r in want])
    with pytest.raises(LanguageModelError):
        lm.window_draws(spark, [("r", 17, 5)], 6, 6, 3)
    with pytest.raises(LanguageModelError):
        lm.window_draws(spark, [("r", 17, 10**6)], 300, 6, 3)


def test_progress_is_the_last_row_with_the_highest_peak(spark):
    log = spark.createDataFrame([(2, "t", 7, None, 1.0, 1.0, 3.0, 5), (1, "t", 3, None, 1.0, 1.0, 2.0, 9)], f"ord int, {files.METRICS}")
    assert [tuple(r) for r in files.progress(log).collect()] == [(7, 1.0, 1.0, 3.0, 9)]
    assert files.progress(log.where("ord > 5")).count() == 0
