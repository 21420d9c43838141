"""Plans, identities and records of experiments: what a run would read and do, computed before it runs."""

from __future__ import annotations

import os
import platform
import resource

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.functions.values import Xorshift, lists_of
from mergeloom.operators.windows import padded_batches

# Fixed values of the architecture and the two regimes' rows per batch.
ARCHITECTURE = {"layers": 8, "hidden": 384, "heads": 6, "inner": 1536, "context": 256, "vocabulary": 512}
ROWS = 8


def evaluation_plan(sequences: DataFrame, ident: str, n_bytes: str, width: int = ARCHITECTURE["context"]) -> DataFrame:
    """Columns (ident, tokens, targets, target_bytes, windows): what scoring a sequence in non-overlapping windows covers."""
    b = F.coalesce(F.col(n_bytes), F.array().cast("array<int>"))
    n = F.size(b)
    targets = F.greatest(n - 1, F.lit(0))
    covered = F.aggregate(F.slice(b, 2, F.greatest(n, F.lit(1))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return sequences.select(ident, n.alias("tokens"), targets.alias("targets"), covered.alias("target_bytes"), F.ceil(targets / width).cast("int").alias("windows"))


def schedule_plan(spark: SparkSession, tokens: int, steps: int, context: int = ARCHITECTURE["context"], rows: int = ROWS) -> DataFrame:
    """One row: positions a run of `steps` batches trains on, and its share of the split."""
    return spark.range(1).select(F.lit(steps).cast("bigint").alias("steps"), F.lit(steps * rows * context).cast("bigint").alias("positions"), F.lit(steps * rows * context / max(tokens, 1)).alias("passes"))


def schedules(totals: DataFrame, split: str, tokens: str, steps: int, context: int = ARCHITECTURE["context"], rows: int = ROWS) -> DataFrame:
    """Columns (split, steps, positions, passes): the same for every row of a table of splits and their tokens."""
    positions = steps * rows * context
    return totals.select(split, F.lit(steps).cast("bigint").alias("steps"), F.lit(positions).cast("bigint").alias("positions"), (F.lit(positions) / F.greatest(F.col(tokens), F.lit(1))).alias("passes"))


def byte_regime(sequences: DataFrame, ident: str, tokens: str, first: int | Column = 1, targets: int | Column | None = None, width: int = ARCHITECTURE["context"], rows: int = ROWS) -> DataFrame:
    """Columns (batches, positions, padded): size of the padded batches over a range of targets, as in padded_batches."""
    b = padded_batches(sequences, ident, tokens, first, targets, width, rows)
    return b.groupBy(ident).agg((F.max("batch") + 1).alias("batches"), F.sum("length").alias("positions"), F.sum(F.lit(width) - F.col("length")).alias("padded"))


#: Added to a seed for the generator of the sampled windows (a fixed value).
SAMPLE_SALT = 0xA341316C9E3779B9


def sampled_windows(lengths: DataFrame, ident: str, n_bytes: str, seeds: list[int], steps: int, context: int, rows: int) -> DataFrame:
    """Columns (ident, seed, draws, target_bytes): bytes of the windows that each seed draws from a sequence in `steps` batches of `rows`.

    The generator is replayed for every sequence and seed over the running sums of the sequence's
    own token lengths, inside the row; sequences of `context` tokens or fewer have no row.
    """

    @F.arrow_udf("array<bigint>")
    def drawn(values: pa.Array) -> pa.Array:
        starts = [Xorshift(s ^ SAMPLE_SALT) for s in seeds]
        draws = np.array([[g.next() for _ in range(steps * rows)] for g in starts], np.uint64).reshape(len(seeds), steps * rows)
        out = []
        for v in values:
            upto = np.concatenate(([0], np.cumsum(np.asarray(v.values, np.int64))))
            at = (draws % np.uint64(len(upto) - 1 - context)).astype(np.int64)
            out.append((upto[at + context + 1] - upto[at + 1]).sum(1).astype(np.int64))
        return lists_of(out)

    long = lengths.where(F.size(n_bytes) > context).select(F.col(ident), drawn(F.col(n_bytes)).alias("__s"))
    given = F.array(*[F.lit(s).cast("bigint") for s in seeds])
    return long.select(ident, F.posexplode("__s").alias("__k", "target_bytes")).select(ident, F.get(given, F.col("__k")).alias("seed"), F.lit(steps * rows).alias("draws"), "target_bytes")


def identity(*parts: Column) -> Column:
    """SHA-256 of byte strings put together: of a tokenizer, its artifact and its mapping."""
    return F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)


def frozen_problems(actual: dict, frozen: dict, prefix: str = "") -> list[str]:
    """Names of settings that differ from a frozen configuration or are missing in either."""
    out = []
    for k in sorted({*actual, *frozen}):
        a, b = actual.get(k), frozen.get(k)
        if isinstance(a, dict) and isinstance(b, dict):
            out += frozen_problems(a, b, f"{prefix}{k}.")
        elif k not in actual or k not in frozen or a != b:
            out.append(prefix + k)
    return out


def close(a: Column, b: Column, absolute: float = 1e-5, relative: float = 1e-3) -> Column:
    """Whether a differs from the reference b by no more than absolute + relative * |b|."""
    return F.abs(a - b) <= absolute + relative * F.abs(b)


def environment(spark: SparkSession) -> dict[str, str]:
    """What a report names: versions, machine, processors, and the process's peak memory."""
    return {
        "spark": spark.version, "pyspark": pyspark.__version__, "python": platform.python_version(), "system": platform.platform(), "machine": platform.machine(),
        "processors": str(os.cpu_count()), "parallelism": str(spark.sparkContext.defaultParallelism), "peak_memory_bytes": str(peak_memory()),
    }


def peak_memory() -> int:
    """Largest resident size of this process in bytes."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024


def write_manifest(units: DataFrame, sources: DataFrame, folder: str) -> None:
    """New JSON-lines folders `units` (by split) and `sources`; existing ones are refused."""
    units.write.mode("errorifexists").partitionBy("proposed").json(f"{folder}/units")
    sources.write.mode("errorifexists").json(f"{folder}/sources")
