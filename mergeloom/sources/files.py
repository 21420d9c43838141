"""Corpus files, sequence files and logs: readers and writers."""

from __future__ import annotations

import json
import os
import stat
import struct
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from mergeloom.artifact import read_artifact, write_new
from mergeloom.errors import CorpusError
from mergeloom.functions.values import FNV_START, fnv1a64_bytes

#: Files of one corpus.
MAX_FILES = 65_000
#: First eight bytes of sequence files written here; the reader keeps those of a file.
SEQUENCE_MAGIC = b"MRGLOMS\0"


def corpus_files(root: str, extensions: Sequence[str] = ()) -> list[tuple[str, int]]:
    """(relative path with /, size) of all regular files below a local folder, sorted; the file itself if it is one.

    Symlinks, special files and names that are no Unicode are refused, and more than MAX_FILES.
    """
    out, stack = [], [""]
    top = os.lstat(root)
    if stat.S_ISREG(top.st_mode):
        return [(os.path.basename(root), top.st_size)]
    if not stat.S_ISDIR(top.st_mode):
        raise CorpusError("neither file nor folder", path=root)
    while stack:
        folder = stack.pop()
        for entry in os.scandir(os.path.join(root, folder)):
            rel = f"{folder}/{entry.name}" if folder else entry.name
            try:
                rel.encode()
            except UnicodeEncodeError:
                raise CorpusError("name is not Unicode", path=repr(rel)) from None
            mode = entry.stat(follow_symlinks=False)
            if stat.S_ISDIR(mode.st_mode):
                stack.append(rel)
            elif not stat.S_ISREG(mode.st_mode):
                raise CorpusError("not a regular file", path=rel)
            elif not extensions or rel.rpartition(".")[2] in extensions:
                out.append((rel, mode.st_size))
                if len(out) > MAX_FILES:
                    raise CorpusError("too many files", limit=MAX_FILES)
    return sorted(out)


def load_corpus(spark: SparkSession, root: str, extensions: Sequence[str] = ()) -> DataFrame:
    """Columns (ord, rel_path, size, content BINARY) in path order. Contents are read by the executors."""
    files = corpus_files(root, extensions)
    base = os.path.dirname(root) if os.path.isfile(root) else root
    listing = spark.createDataFrame([(i, p, n) for i, (p, n) in enumerate(files)], "ord int, rel_path string, size bigint")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = f"file:{os.path.abspath(base)}/"
    rel = F.substring(F.col("path"), F.lit(len(prefix) + 1), F.length("path"))
    joined = listing.join(raw.select(rel.alias("__r"), F.col("content").alias("__c")), F.col("rel_path") == F.col("__r"), "left")
    # the reader leaves empty files out
    content = F.when(F.col("size") == 0, F.lit(b"")).otherwise(F.coalesce("__c", F.raise_error(F.concat(F.lit("file vanished: "), F.col("rel_path"))).cast("binary")))
    return joined.select("ord", "rel_path", "size", content.alias("content"))


def provenance(corpus: DataFrame, source: str) -> DataFrame:
    """One row (input, files, total_bytes, fnv1a64): the hash of all contents joined in order.

    A hash over a byte string is sequential, so one task streams the files in order, and only the
    hash reaches the driver; about 10 MB a second.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, total, h = [], 0, FNV_START
        for b in batches:
            for path, content in zip(b.column("rel_path").to_pylist(), b.column("content")):
                raw = content.as_py()
                files.append(path)
                total += len(raw)
                h = fnv1a64_bytes(raw, h)
        yield pa.RecordBatch.from_arrays([pa.array([source]), pa.array([files], pa.list_(pa.string())), pa.array([total], pa.int64()), pa.array([f"{h:016x}"])], names=["input", "files", "total_bytes", "fnv1a64"])

    rows = corpus.select("ord", "rel_path", "content").repartition(1).sortWithinPartitions("ord")
    return rows.mapInArrow(run, "input string, files array<string>, total_bytes bigint, fnv1a64 string")


def write_sequence(path: str, tokens: Sequence[int], n_bytes: Sequence[int], magic: bytes = SEQUENCE_MAGIC) -> None:
    """A new file of (token, byte length) pairs."""
    if len(tokens) != len(n_bytes) or any(not 0 <= t < 512 for t in tokens) or any(n < 1 for n in n_bytes):
        raise CorpusError("invalid sequence", tokens=len(tokens), lengths=len(n_bytes))
    pairs = np.column_stack((np.asarray(tokens, "<u4"), np.asarray(n_bytes, "<u4"))).astype("<u4")
    write_new(path, magic + struct.pack("<Q", len(tokens)) + pairs.tobytes())


class SequenceSource(DataSource):
    """spark.read.format("tokensequence").load(file): columns (pos, token, n_bytes), split into ranges."""

    @classmethod
    def name(cls) -> str:
        return "tokensequence"

    def schema(self) -> str:
        return "pos bigint, token int, n_bytes int"

    def reader(self, schema):
        return _SequenceReader(self.options["path"], int(self.options.get("rows", 1 << 20)))


class _SequenceReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self):
        size = os.path.getsize(self.path)
        with open(self.path, "rb") as f:
            head = f.read(16)
        n = struct.unpack("<Q", head[8:])[0] if len(head) == 16 else -1
        if size != 16 + 8 * n:
            raise CorpusError("malformed sequence file", size=size)
        return [InputPartition((a, min(a + self.rows, n))) for a in range(0, max(n, 1), self.rows)]

    def read(self, partition):
        a, b = partition.value
        with open(self.path, "rb") as f:
            f.seek(16 + 8 * a)
            pairs = np.frombuffer(f.read(8 * (b - a)), "<u4").reshape(-1, 2)
        if (pairs[:, 0] >= 512).any() or (pairs[:, 1] < 1).any():
            raise CorpusError("invalid sequence", path=self.path)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), pa.array(pairs[:, 0].astype(np.int32)), pa.array(pairs[:, 1].astype(np.int32))], names=["pos", "token", "n_bytes"])


class MergeSource(DataSource):
    """spark.read.format("mergetable").load(artifact): columns (pack_id, merge_rank, left_id, right_id, result_id)."""

    @classmethod
    def name(cls) -> str:
        return "mergetable"

    def schema(self) -> str:
        return "pack_id int, merge_rank int, left_id int, right_id int, result_id int"

    def reader(self, schema):
        return _MergeReader(self.options["path"])


class _MergeReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def read(self, partition):
        a = read_artifact(self.path)
        if a.packed:
            for p in a.packed.packs:
                for r, (left, right) in enumerate(p.merges):
                    yield p.pack_id, r, left, right, 256 + r
        for r, m in enumerate(a.flat.merges if a.flat else ()):
            yield 0, r, *m


def register(spark: SparkSession) -> None:
    """Make both formats known to the session."""
    spark.dataSource.register(SequenceSource)
    spark.dataSource.register(MergeSource)


def write_or_verify(path: str, raw: bytes) -> bool:
    """Write a new file, or check that the one there has these bytes; whether it was written."""
    try:
        write_new(path, raw)
        return True
    except FileExistsError:
        with open(path, "rb") as f:
            if f.read(len(raw) + 1) != raw:
                raise CorpusError("file differs", path=path) from None
        return False


def replace_atomically(path: str, raw: bytes, check=None) -> None:
    """Write beside the target, flush, read back, optionally `check(bytes)`, then rename over it."""
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(raw)
            f.flush()
            os.fsync(f.fileno())
        with open(temp, "rb") as f:
            back = f.read()
        if back != raw:
            raise CorpusError("file differs after writing", path=path)
        if check:
            check(back)
        os.replace(temp, path)
    except BaseException:
        os.unlink(temp)
        raise


def append_jsonl(path: str, record: dict) -> None:
    with open(path, "a") as f:
        f.write(json.dumps(record, sort_keys=True) + "\n")


def write_report(path: str, record: dict) -> bool:
    """A JSON report; writing the same again changes nothing, another one is refused."""
    return write_or_verify(path, (json.dumps(record, sort_keys=True, indent=2) + "\n").encode())


def write_frame_or_verify(df: DataFrame, path: str) -> bool:
    """Write a new Parquet folder, or check that it holds the same rows."""
    try:
        df.write.mode("errorifexists").parquet(path)
        return True
    except Exception as e:
        if "ALREADY_EXISTS" not in str(e):
            raise
    old = df.sparkSession.read.parquet(path).select(*df.columns)
    if not old.exceptAll(df).isEmpty() or not df.exceptAll(old).isEmpty():
        raise CorpusError("rows differ", path=path)
    return False


METRICS = "stage string, step bigint, checkpoint_step bigint, training_seconds double, pipeline_seconds double, wall_seconds double, peak_vram_mib bigint"


def metrics_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """Rows of a JSONL metrics log with their line number as given (`ord`, line); broken lines, like an unfinished last one, are left out."""
    parsed = lines.select("ord", F.from_json(F.col(line), METRICS, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json(F.col(line)).isNotNull().alias("ok"))
    return parsed.where("ok").select("ord", "r.*")


def truncate_metrics(log: DataFrame, step: int) -> DataFrame:
    """Rows up to a step: what a resumed run keeps. Rows without a step count by their checkpoint's."""
    return log.where(F.coalesce("step", "checkpoint_step") <= step)


def progress(log: DataFrame) -> DataFrame:
    """One row: the last step with its counters, and the highest memory peak."""
    counters = F.struct(F.coalesce("step", "checkpoint_step").alias("step"), "training_seconds", "pipeline_seconds", "wall_seconds")
    return log.groupBy().agg(F.max_by(counters, "ord").alias("c"), F.max("peak_vram_mib").alias("peak_vram_mib")).where("c is not null").select("c.*", "peak_vram_mib")


def verify_hashes(actual: DataFrame, declared: DataFrame) -> DataFrame:
    """Columns (path, problem) from actual (path, content) and declared (path, sha256, size): missing, undeclared, declared twice, or other bytes."""
    have = actual.select(F.col("path").alias("a"), F.sha2("content", 256).alias("h"), F.length("content").alias("n"))
    want = declared.groupBy(F.col("path").alias("b")).agg(F.count(F.lit(1)).alias("times"), F.first("sha256").alias("sha256"), F.first("size").alias("size"))
    both = have.join(want, F.col("a") == F.col("b"), "full_outer")
    problem = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "undeclared").when(F.col("times") > 1, "declared twice").when(F.col("n") != F.col("size"), "size differs").when(F.lower("sha256") != F.col("h"), "hash differs")
    return both.select(F.coalesce("a", "b").alias("path"), problem.alias("problem")).where("problem is not null")


def units_of_manifest(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, sources) of a manifest read by spark.read.json(multiLine=True): (ord, source, start, end, proposed, kept), (name, category)."""
    units = manifest.select(F.posexplode("units").alias("ord", "u")).select("ord", "u.source", "u.start", "u.end", "u.proposed", "u.kept")
    return units, manifest.select(F.inline("sources")).select("name", "category")
