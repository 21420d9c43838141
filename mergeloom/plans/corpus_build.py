"""Building a corpus: files to blocks, splits, leakage and near-duplicate filters, composition and manifest; and preparing it for training."""

from __future__ import annotations

import json
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.errors import CorpusError
from mergeloom.operators import corpus
from mergeloom.operators.encode import adapt, artifact_merges
from mergeloom.operators.mapping import flatten
from mergeloom.operators.windows import block_rows
from mergeloom.plans.experiments import evaluation_plan
from mergeloom.session import stored
from mergeloom.sources.files import verify_hashes, write_report

# Block sizes of the two builders.
BLOCKS = {"passages": 4096, "near": 8192}


def build_units(files: DataFrame, mode: str = "near", size: int | None = None) -> DataFrame:
    """Columns (ord, source, start, end, proposed, kept, reason, sha256, body), one row per block of `files` (name, content).

    `passages`: blocks of 4,096 bytes, splits counted within each file, held-out blocks with a
    128-byte passage of train (and test blocks with one of validation) are dropped. `near`: blocks
    of 8,192 bytes, splits counted over all files in order of their names, and near-duplicates of
    blocks accepted before are dropped too. `ord` is the order of blocks in a joined split. Empty
    and NULL contents have no block.
    """
    if mode not in BLOCKS:
        raise CorpusError("unknown mode", mode=mode)
    rows = block_rows(files, "name", "content", size or BLOCKS[mode], whole_corpus=mode == "near")
    place = F.struct("name", "start_byte")
    rows = stored(rows.select(place.alias("ord"), F.col("name").alias("source"), F.col("start_byte").alias("start"), F.col("end_byte").alias("end"), F.col("split").alias("proposed"), F.sha2("content", 256).alias("sha256"), F.col("content").alias("body")))
    if mode == "passages":
        decided = corpus.drop_leaky_blocks(rows, "ord", "proposed", "body").select(F.col("ord").alias("o"), "kept", F.when(F.col("kept"), "accepted").otherwise(corpus.SHARED).alias("reason"))
    else:
        decided = corpus.accept_blocks(rows, "ord", "proposed", "body").select(F.col("ord").alias("o"), "kept", "reason")
    return rows.join(decided, F.col("ord") == F.col("o")).select("ord", "source", "start", "end", "proposed", "kept", "reason", "sha256", "body")


def source_rows(files: DataFrame, units: DataFrame) -> DataFrame:
    """Columns (name, raw_bytes, raw_sha256, contribution ARRAY): what every file gives to train, validation and test."""
    at = lambda s: F.coalesce(F.sum(F.when(F.col("kept") & (F.col("proposed") == s), F.col("end") - F.col("start"))), F.lit(0))
    given = units.groupBy(F.col("source").alias("__s")).agg(F.array(at("train"), at("validation"), at("test")).alias("contribution"))
    own = files.select("name", F.length("content").cast("bigint").alias("raw_bytes"), F.sha2("content", 256).alias("raw_sha256"))
    none = F.array_repeat(F.lit(0).cast("bigint"), 3)
    return own.join(given, F.col("name") == F.col("__s"), "left").select("name", "raw_bytes", "raw_sha256", F.coalesce("contribution", none).alias("contribution"))


def split_rows(units: DataFrame) -> DataFrame:
    """Columns (split, blocks, dropped, size) of a built corpus."""
    kept = F.col("kept")
    return units.groupBy(F.col("proposed").alias("split")).agg(F.sum(kept.cast("bigint")).alias("blocks"), F.sum((~kept).cast("bigint")).alias("dropped"), F.coalesce(F.sum(F.when(kept, F.col("end") - F.col("start"))), F.lit(0)).alias("size"))


def shared_passages(units: DataFrame) -> DataFrame:
    """Rows of splits that still share a 128-byte passage in kept blocks: none in a well built corpus."""
    return corpus.splits_share_passage(units.where("kept"), "proposed", "body", corpus.PASSAGE, "ord")


def _write_new(df: DataFrame, path: str, *by: str) -> None:
    """A new Parquet folder; CorpusError if it is there."""
    try:
        df.write.mode("errorifexists").partitionBy(*by).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        raise CorpusError("folder exists", path=path) from None


def write_corpus(files: DataFrame, folder: str, mode: str = "near", size: int | None = None) -> dict:
    """Build into a new folder: `units` (Parquet, by split), `sources`, and manifest.json with the splits' sizes. Returns the manifest."""
    units = stored(build_units(files, mode, size))
    _write_new(units, f"{folder}/units", "proposed")
    _write_new(source_rows(files, units), f"{folder}/sources")
    splits = {r.split: {"blocks": r.blocks, "dropped": r.dropped, "bytes": r.size} for r in split_rows(units).collect()}  # three rows
    manifest = {"mode": mode, "block_bytes": size or BLOCKS[mode], "splits": splits, "shared_passages": shared_passages(units).count()}
    write_report(f"{folder}/manifest.json", manifest)
    return manifest


def prepare(spark: SparkSession, folder: str, artifact) -> DataFrame:
    """Encode the kept blocks of a built corpus into `prepared` (Parquet): (split, source, start, sha256, tokens, n_bytes). Tokens are global ids of the artifact's packs.

    A block that doesn't decode to itself, or whose token lengths don't add up to its bytes, is an error.
    """
    merges = artifact_merges(artifact)
    counts = spark.createDataFrame([(p.pack_id, p.local_token_count) for p in artifact.registry.packs], "pack_id int, local_token_count bigint")
    units = spark.read.parquet(f"{folder}/units").where("kept").withColumn("__u", F.struct("proposed", "source", "start", "sha256"))
    done = stored(adapt(units, "__u", "body", merges, flatten(counts)))
    bad = done.where("not same or not covered or exists(tokens, t -> t is null)").select("__u.source", "__u.start").limit(1).collect()
    if bad:
        raise CorpusError("block isn't covered by its tokens", source=bad[0].source, start=bad[0].start)
    rows = done.select(F.col("__u.proposed").alias("split"), "__u.source", "__u.start", "__u.sha256", "tokens", "n_bytes")
    _write_new(rows, f"{folder}/prepared")
    return rows


def verify_prepared(spark: SparkSession, folder: str) -> DataFrame:
    """Columns (path, problem): blocks of which the hash, the size or the prepared row is wrong or missing; none if all is well."""
    units = spark.read.parquet(f"{folder}/units").where("kept")
    name = F.concat_ws("@", "source", F.col("start").cast("string"))
    ready = spark.read.parquet(f"{folder}/prepared").select(name.alias("path"), "sha256", F.aggregate("n_bytes", F.lit(0), lambda a, x: a + x).alias("size"))
    problems = verify_hashes(units.select(name.alias("path"), F.col("body").alias("content")), ready)
    with open(os.path.join(folder, "manifest.json")) as f:
        said = json.load(f)["splits"]
    have = {r.split: r.n for r in units.groupBy(F.col("proposed").alias("split")).agg(F.sum(F.col("end") - F.col("start")).alias("n")).collect()}
    wrong = [(s, "split size differs") for s in sorted({*said, *have}) if said.get(s, {}).get("bytes", 0) != have.get(s, 0)]
    return problems.unionByName(spark.createDataFrame(wrong, "path string, problem string"))


def plan(spark: SparkSession, folder: str, width: int = 256) -> DataFrame:
    """Columns (split, sequences, tokens, targets, target_bytes, windows) of a prepared corpus."""
    rows = spark.read.parquet(f"{folder}/prepared")
    own = evaluation_plan(rows.select("split", "n_bytes"), "split", "n_bytes", width)
    return own.groupBy("split").agg(F.count(F.lit(1)).alias("sequences"), *[F.sum(c).alias(c) for c in ("tokens", "targets", "target_bytes", "windows")])
