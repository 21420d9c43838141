"""Learning merge tables from pair statistics: flat, and pack-local over distinct spans."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from multiprocessing.connection import Client, Listener

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mergeloom.artifact import BYTE_COUNT, BYTE_FALLBACK, MAX_TOKEN_BYTES, PACK_NAMES, ROUTER, Artifact, FlatModel, PackedModel, PackModel
from mergeloom.errors import TrainingError
from mergeloom.operators.encode import byte_ids
from mergeloom.operators.route import pack_of, spans
from mergeloom.session import cut, stored

#: Bytes of distinct sequences up to which the rounds run in one task.
LOCAL_BYTES = 64 << 20
#: Bytes a task up to which tasks that run at once hold larger ones, and the most such tasks; beyond, every round is a distributed job.
TASK_BYTES, MOST_TASKS = 192 << 20, 64
#: Symbols of a block, which are gone through together.
BLOCK = 1 << 18
#: Rounds between lineage cuts of the distributed loop.
CUT_EVERY = 16


#: Pair codes and their counts, by pack.
Counts = dict[int, tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class TrainingConfig:
    """Defaults: 512 ids in all, 256 of them learned, from pairs seen twice."""

    target_vocab_size: int = 512
    max_merges: int = 256
    min_pair_frequency: int = 2

    def __post_init__(self) -> None:
        if self.target_vocab_size < BYTE_COUNT:
            raise TrainingError("target vocabulary below 256", target=self.target_vocab_size)
        if not 0 <= self.max_merges <= self.target_vocab_size - BYTE_COUNT:
            raise TrainingError("more merges than the target allows", max_merges=self.max_merges)
        if self.min_pair_frequency < 1:
            raise TrainingError("minimum frequency is not positive", min_pair_frequency=self.min_pair_frequency)


def pair_counts(sequences: DataFrame, symbols: str, mult: str | None = None, pack: str | None = None) -> DataFrame:
    """Columns ([pack,] left_id, right_id, freq): overlapping neighbours in ARRAY<INT> sequences, weighted by `mult`.

    Pairs are counted per partition before the shuffle. Sequences shorter than two have none.
    """
    n = F.greatest(F.size(symbols) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(symbols, 1, n), F.slice(symbols, 2, n), lambda a, b: F.struct(a.alias("left_id"), b.alias("right_id")))
    keys = ["pack_id"] if pack else []
    weight = F.col(mult) if mult else F.lit(1)
    rows = sequences.select(*[F.col(pack).alias("pack_id") for _ in keys], weight.cast("bigint").alias("m"), F.explode(pairs).alias("p"))
    return rows.select(*keys, "m", "p.*").groupBy(*keys, "left_id", "right_id").agg(F.sum("m").alias("freq"))


def best_pairs(counts: DataFrame, min_frequency: int = 2) -> DataFrame:
    """The best pair of every pack: most frequent, then the least (left, right)."""
    per = Window.partitionBy("pack_id").orderBy(F.desc("freq"), "left_id", "right_id")
    return counts.where(F.col("freq") >= min_frequency).withColumn("place", F.row_number().over(per)).where("place = 1").drop("place")


def best_pair(counts: DataFrame, min_frequency: int = 2) -> DataFrame:
    """The best pair of all: most frequent, then the least pack, left, right."""
    keys = [c for c in ("pack_id", "left_id", "right_id") if c in counts.columns]
    return counts.where(F.col("freq") >= min_frequency).orderBy(F.desc("freq"), *keys).limit(1)


def distinct_spans(df: DataFrame, text: str) -> DataFrame:
    """Columns (pack_id, span BINARY, mult): merges never cross spans, so these say all that training needs."""
    rows = df.select(F.explode(spans(F.col(text))).alias("s"))
    return rows.groupBy("s").agg(F.count(F.lit(1)).alias("mult")).select(pack_of(F.col("s")).alias("pack_id"), F.col("s").cast("binary").alias("span"), "mult")


def _tally(parts: list[tuple[np.ndarray, np.ndarray]], v: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending codes below v * v with the sums of their weights, without those that sum to 0."""
    codes, weights = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)]) for i in (0, 1))
    if v <= 1024:
        total = np.bincount(codes, weights=weights.astype(np.float64), minlength=1)  # exact below 2^53
        at = np.flatnonzero(total)
        return at, total[at].astype(np.int64)
    at, inverse = np.unique(codes, return_inverse=True)
    total = np.zeros(len(at), np.int64)
    np.add.at(total, inverse, weights)
    return at[total != 0], total[total != 0]


class Sequences:
    """Symbol sequences of one pack with multiplicities, in blocks.

    In a block the greatest number, a mark, lies before, between and after its sequences; the number
    below it is a hole that a replaced pair left. Holes are passed over, and closed when there are many.
    """

    def __init__(self, values: np.ndarray = np.zeros(0, np.uint8), begin: np.ndarray = np.zeros(1, np.int64), mult: np.ndarray = np.zeros(0, np.int64)):
        self.blocks: list[tuple[np.ndarray, np.ndarray | None, int]] = []
        self.add(values, begin, mult)

    def add(self, values: np.ndarray, begin: np.ndarray, mult: np.ndarray) -> None:
        """More sequences, one after another in `values`; `begin` has their borders."""
        begin = begin.astype(np.int64) - begin[0]
        cuts = np.unique([0, *np.searchsorted(begin, np.arange(BLOCK, begin[-1], BLOCK)), len(mult)])
        for i, j in zip(cuts[:-1], cuts[1:]):
            own, size = values[begin[i] : begin[j]], np.diff(begin[i : j + 1])
            kind = np.uint16 if not len(own) or own.max() < 0xFFFE else np.uint32
            s = np.full(len(own) + len(size) + 1, _mark(kind), kind)
            symbol = np.ones(len(s), bool)
            symbol[np.concatenate(([0], np.cumsum(size + 1)))] = False
            s[symbol] = own
            m = mult[i:j].astype(np.min_scalar_type(int(mult[i:j].max())))  # a byte a symbol where multiplicities are small
            self.blocks.append((s, None if (m == 1).all() else np.repeat(np.concatenate((m[:1], m)), np.append(1, size + 1)), 0))

    def counts(self, v: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes left * v + right and their weighted overlapping counts."""
        self.blocks = [_closed(*b) for b in self.blocks]
        return _tally([_tally([_coded(s, w, slice(None, -1), slice(1, None), v, 1)], v) for s, w, _ in self.blocks], v)

    def replace(self, left: int, right: int, result: int, v: int = 0) -> tuple[np.ndarray, np.ndarray] | None:
        """Left to right without overlap, inside each sequence. With `v`, the changes of counts(v): only pairs at the places replaced are counted."""
        changes = []
        for b, (s, w, holes) in enumerate(self.blocks):
            hit = np.flatnonzero(s == left)
            second = _passed(s, hit, 1)  # a mark comes last, so each has a successor
            here = s[second] == right
            hit, second = hit[here], second[here]
            if not len(hit):
                continue
            if left == right:
                run = np.concatenate(([0], np.flatnonzero(second[:-1] != hit[1:]) + 1))
                first = np.repeat(run, np.diff(np.append(run, len(hit))))
                here = (np.arange(len(hit)) - first) % 2 == 0
                hit, second = hit[here], second[here]
            if result >= _mark(s.dtype) - 1:
                gone = _mark(np.uint32) - _mark(s.dtype)
                s = np.where(s >= _mark(s.dtype) - 1, s + np.uint32(gone), s).astype(np.uint32)
            if v:
                after = _passed(s, second, 1)
                lone = np.append(True, after[:-1] != hit[1:])  # the pair before another hit is that of the last hit's end
                start = hit[lone]
                before = _passed(s, start, -1)
                changes += [_coded(s, w, hit, second, v, -1), _coded(s, w, second, after, v, -1), _coded(s, w, before, start, v, -1)]
            s[hit], s[second] = result, _mark(s.dtype) - 1
            if v:
                changes += [_coded(s, w, hit, after, v, 1), _coded(s, w, before, start, v, 1)]
            holes += len(hit)
            self.blocks[b] = _closed(s, w, holes) if holes * 8 > len(s) else (s, w, holes)
        return _tally(changes, v) if v else None

    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        own = [_closed(*b)[0] for b in self.blocks]
        marks = [s == _mark(s.dtype) for s in own]
        values = np.concatenate([np.zeros(0, np.int32), *(s[~m].astype(np.int32) for m, s in zip(marks, own))])
        return values, np.cumsum(np.concatenate([np.zeros(1, np.int64), *(np.diff(np.flatnonzero(m)) - 1 for m in marks)]))


def _mark(kind: type) -> int:
    return int(np.iinfo(kind).max)


def _closed(s: np.ndarray, w: np.ndarray | None, holes: int) -> tuple[np.ndarray, np.ndarray | None, int]:
    """A block without holes."""
    if not holes:
        return s, w, 0
    keep = s != _mark(s.dtype) - 1
    return s[keep], None if w is None else w[keep], 0


def _passed(s: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """The places next to `at` in the direction of `step` that are no holes."""
    out, hole = at + step, _mark(s.dtype) - 1
    rest = np.flatnonzero(s[out] == hole)
    while len(rest):
        out[rest] += step
        rest = rest[s[out[rest]] == hole]
    return out


def _coded(s: np.ndarray, w: np.ndarray | None, at, after, v: int, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the pairs (s[at], s[after]) without marks, and their weights."""
    a, b, end = s[at], s[after], _mark(s.dtype)
    real = (a != end) & (b != end)
    return a[real].astype(np.int64) * v + b[real], np.full(int(real.sum()), sign, np.int64) if w is None else w[at][real].astype(np.int64) * sign


def _choose(codes: np.ndarray, counts: np.ndarray, v: int, length: list[int], least: int) -> tuple[int, int, int] | None:
    """(freq, left, right) of the most frequent pair that is frequent and short enough, ties to the least pair."""
    good = counts >= least
    sizes = np.array(length, np.int64)
    good &= sizes[codes // v] + sizes[codes % v] <= MAX_TOKEN_BYTES
    if not good.any():
        return None
    top = counts[good].max()
    code = int(codes[good & (counts == top)].min())
    return int(top), code // v, code % v


def learn(packs: dict[int, Sequences], cfg: TrainingConfig, share: Callable[[Counts, int], Counts] = lambda own, v: own) -> list[tuple[int, int, int, int]]:
    """Merges (pack, left, right, result) in the order learned; one budget for all packs.

    Pairs are counted once, then every round adds what its replacement changed. `share` sums counts
    over all tasks that hold a part of the sequences.
    """
    v = BYTE_COUNT + cfg.max_merges + 1
    total = share({p: s.counts(v) for p, s in packs.items()}, v)
    length = {p: [1] * BYTE_COUNT for p in total}
    best = {p: _choose(*c, v, length[p], cfg.min_pair_frequency) for p, c in total.items()}
    out: list[tuple[int, int, int, int]] = []
    while len(out) < cfg.max_merges:
        known = [(-b[0], p, b[1], b[2]) for p, b in best.items() if b]
        if not known:
            break
        _, p, left, right = min(known)
        result = len(length[p])
        length[p].append(length[p][left] + length[p][right])
        out.append((p, left, right, result))
        changed = share({p: packs[p].replace(left, right, result, v)} if p in packs else {}, v)
        total[p] = _tally([total[p], changed[p]], v)
        best[p] = _choose(*total[p], v, length[p], cfg.min_pair_frequency)
    return out


def _held(batches: Iterator[pa.RecordBatch]) -> dict[int, Sequences]:
    """Sequences by pack of (pack_id, span, mult)."""
    packs: dict[int, Sequences] = {}

    def put(some: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(some)
        for p in pc.unique(table["pack_id"]).to_pylist():
            part = table.filter(pc.equal(table["pack_id"], p)).combine_chunks()
            for spans, mult in zip(part["span"].chunks, part["mult"].chunks):
                begin = np.frombuffer(spans.buffers()[1], np.int32)[spans.offset : spans.offset + len(spans) + 1]
                data = spans.buffers()[2]
                packs.setdefault(p, Sequences()).add(np.frombuffer(data, np.uint8)[begin[0] : begin[-1]] if data else np.zeros(0, np.uint8), begin, np.asarray(mult))

    some, size = [], 0
    for batch in batches:
        some, size = [*some, batch], size + batch.nbytes
        if size >= BLOCK:
            put(some)
            some, size = [], 0
    if some:
        put(some)
    return packs


def _sharing(task: BarrierTaskContext) -> Callable[[Counts, int], Counts]:
    """The sum of what all tasks of the stage give, by connections to the first one; allGather would take a second each time."""
    own, key, listener = task.getTaskInfos()[task.partitionId()].address.rsplit(":", 1)[0], os.urandom(32).hex(), None
    if task.partitionId() == 0:
        listener = Listener(("", 0), backlog=len(task.getTaskInfos()), authkey=key.encode())
    said = task.allGather(f"{own} {listener.address[1]} {key}" if listener else "")
    if listener:
        others = [listener.accept() for _ in said[1:]]

        def share(counts: Counts, v: int) -> Counts:
            parts = [counts, *(c.recv() for c in others)]
            total = {p: _tally([x[p] for x in parts if p in x], v) for p in sorted({p for x in parts for p in x})}
            for c in others:
                c.send(total)
            return total

        return share
    host, port, key = next(x for x in said if x).split(" ")
    first = Client((host, int(port)), authkey=key.encode())

    def ask(counts: Counts, v: int) -> Counts:
        first.send(counts)
        return first.recv()

    return ask


def _learn_held(rows: DataFrame, cfg: TrainingConfig, tasks: int) -> list[tuple[int, int, int, int]]:
    """The rounds in executor tasks that hold the sequences; several run at once and sum their counts after each round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = BarrierTaskContext.get() if tasks > 1 else None
        got = learn(_held(batches), cfg, _sharing(task)) if task else learn(_held(batches), cfg)
        if not task or task.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.int32()) for i in range(4)], names=["p", "l", "r", "x"])

    own = rows.select("pack_id", "span", "mult")
    own = own.coalesce(1) if tasks == 1 else own.repartition(tasks)
    return [tuple(r) for r in own.mapInArrow(run, "p int, l int, r int, x int", barrier=tasks > 1).collect()]


def _slots(spark: SparkSession) -> int:
    """Tasks that can run at once; 0 where executors come and go, so that tasks can't wait for each other."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 0
    sc = spark.sparkContext._jsc.sc()
    return sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile())


def _learn_rounds(rows: DataFrame, cfg: TrainingConfig) -> list[tuple[int, int, int, int]]:
    """The rounds as jobs: pair counts are summed per partition, then over all; sequences are rewritten where they lie."""
    state = cut(rows.select("pack_id", byte_ids(F.col("span")).alias("s"), "mult"))
    length: dict[int, list[int]] = {}
    out: list[tuple[int, int, int, int]] = []
    held: list[DataFrame] = []
    while len(out) < cfg.max_merges:
        counts = pair_counts(state, "s", "mult", "pack_id").where(F.col("freq") >= cfg.min_pair_frequency)
        long = [(p, i) for p, ls in length.items() for i, n in enumerate(ls) if n > MAX_TOKEN_BYTES // 2]
        if long:  # only these can be parts of a token that is too long
            sizes = {p: F.array(*map(F.lit, ls)) for p, ls in length.items()}
            for p, a in sizes.items():
                counts = counts.where((F.col("pack_id") != p) | (F.element_at(a, F.col("left_id") + 1) + F.element_at(a, F.col("right_id") + 1) <= MAX_TOKEN_BYTES))
        top = best_pair(counts, cfg.min_pair_frequency).collect()
        while len(held) > 1:  # the state just counted is kept, the one it came from is not needed again
            held.pop(0).unpersist()
        if not top:
            break
        p, left, right = top[0].pack_id, top[0].left_id, top[0].right_id
        own = length.setdefault(p, [1] * BYTE_COUNT)
        result = len(own)
        own.append(own[left] + own[right])
        out.append((p, left, right, result))
        state = state.select("pack_id", F.when(F.col("pack_id") == p, _rewritten(left, right, result)(F.col("s"))).otherwise(F.col("s")).alias("s"), "mult")
        if len(out) % CUT_EVERY:
            held.append(state := state.persist())
        else:
            state = cut(state)
    for df in held:
        df.unpersist()
    return out


def _rewritten(left: int, right: int, result: int):
    @F.arrow_udf("array<int>")
    def run(lists: pa.Array) -> pa.Array:
        offsets = np.asarray(lists.offsets, np.int64)
        values = np.asarray(lists.values.slice(offsets[0], offsets[-1] - offsets[0]), np.int32)
        seqs = Sequences(values, offsets - offsets[0], np.ones(len(lists), np.int64))
        seqs.replace(left, right, result)
        s, begin = seqs.lists()
        return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(s))

    return run


def _learn(rows: DataFrame, cfg: TrainingConfig, local_bytes: int) -> list[tuple[int, int, int, int]]:
    rows = stored(rows)
    size = rows.agg(F.sum(F.length("span"))).head()[0] or 0
    if size <= local_bytes:
        return _learn_held(rows, cfg, 1)
    slots = min(_slots(rows.sparkSession), MOST_TASKS)
    return _learn_held(rows, cfg, slots) if size <= slots * TASK_BYTES else _learn_rounds(rows, cfg)


def train_packs(df: DataFrame, text: str, cfg: TrainingConfig = TrainingConfig(), local_bytes: int = LOCAL_BYTES) -> PackedModel:
    """Pack-local merges of a corpus. Texts must be UTF-8; packs without merges vanish."""
    learned = _learn(distinct_spans(df, text), cfg, local_bytes)
    packs: dict[int, list[tuple[int, int]]] = {}
    for p, left, right, _ in learned:
        packs.setdefault(p, []).append((left, right))
    return PackedModel(tuple(PackModel(p, tuple(m)) for p, m in packs.items()))


def train_flat(df: DataFrame, content: str, cfg: TrainingConfig = TrainingConfig(), boundary: str = "concat", order: tuple[str, ...] = (), local_bytes: int = LOCAL_BYTES) -> FlatModel:
    """A flat merge table.

    boundary="concat": the corpus is one sequence, its rows joined in `order`, as one task of
    local_bytes at most; a larger corpus raises TrainingError. boundary="document": rows are
    sequences of their own; equal rows are counted once with their multiplicity, at any size.
    """
    value = F.col(content).cast("binary")
    if boundary == "document":
        rows = df.where(F.col(content).isNotNull()).groupBy(value.alias("span")).agg(F.count(F.lit(1)).alias("mult")).select(F.lit(0).alias("pack_id"), "span", "mult")
    elif boundary == "concat":
        size = df.agg(F.sum(F.length(value))).head()[0] or 0
        if size > local_bytes:
            raise TrainingError("corpus too large for one sequence", size=size, limit=local_bytes)
        keyed = df.select(F.struct(*[F.col(c) for c in order], F.hex(value).alias("__h")).alias("r"))
        rows = keyed.agg(F.array_sort(F.collect_list("r")).alias("all")).select(F.lit(0).alias("pack_id"), F.unhex(F.array_join(F.transform("all", lambda x: x["__h"]), "")).alias("span"), F.lit(1).cast("bigint").alias("mult"))
    else:
        raise TrainingError("unknown boundary", boundary=boundary)
    return FlatModel(tuple((left, right, result) for _, left, right, result in _learn(rows, cfg, local_bytes)))


def training_stats(df: DataFrame, text: str, model: PackedModel) -> DataFrame:
    """Columns (pack_id, pack_name, spans, routed_bytes, learned_merges, local_vocab_size), four rows."""
    from mergeloom.operators.route import pack_totals

    learned = df.sparkSession.createDataFrame([(p.pack_id, len(p.merges)) for p in model.packs], "p int, learned int")
    joined = pack_totals(df, text).join(learned, F.col("pack_id") == F.col("p"), "left")
    n = F.coalesce("learned", F.lit(0))
    return joined.select("pack_id", "pack_name", "spans", "routed_bytes", n.alias("learned_merges"), F.when(F.col("pack_id") == BYTE_FALLBACK, BYTE_COUNT).otherwise(n).alias("local_vocab_size"))


# Texts of the metadata entries, by key.
FLAT_ENTRIES = {
    "bpe.algorithm": "flat-byte-level-bpe-v1",
    "bpe.byte_token_count": "256",
    "bpe.encoder_order": "ascending merge rank; replace all non-overlapping matches left-to-right",
    "bpe.merge_id_order": "result token ID = 256 + zero-based merge rank",
    "bpe.normalization": "none",
    "bpe.tie_break": "highest frequency, then ascending (left_id, right_id)",
    "corpus.preprocessing": "raw bytes; no UTF-8 validation or normalization; file contents concatenated without separators",
}
PACKED_ENTRIES = {
    "m2.algorithm": "factorized-byte-level-bpe-v1",
    "m2.byte_token_count": "256",
    "m2.router_policy_id": ROUTER,
    "m2.tie_break": "higher frequency, then ascending pack_id, then ascending (left SymbolRef, right SymbolRef); SymbolRef order is Byte(u8) before Local(u32)",
    "m2.merge_order": "global merge rank order; each selected pack assigns its next contiguous local ID; only the selected pack state is updated",
    "m2.normalization": "none",
    "m2.routing_boundaries": "merge only within each contiguous lexical-v1 routed span",
    "corpus.preprocessing": "raw UTF-8 bytes; no normalization; files concatenated without inserted separators before lexical-v1 routing",
    "experiment.train_eval_boundary": "trainer reads only the supplied training input; held-out fixture files are not opened",
}


def _corpus_entries(files: list[str], total_bytes: int, fnv: int, source: str) -> dict[str, str]:
    out = {"corpus.file_count": str(len(files)), "corpus.fnv1a64": f"{fnv:016x}", "corpus.input": source, "corpus.total_bytes": str(total_bytes)}
    return out | {f"corpus.file.{i:06d}": f for i, f in enumerate(files)}


def flat_artifact(model: FlatModel, cfg: TrainingConfig, files: list[str], total_bytes: int, fnv: int, source: str = "memory") -> Artifact:
    """The artifact of a flat model with its descriptive metadata."""
    own = {"bpe.merge_count": len(model.merges), "bpe.max_merges": cfg.max_merges, "bpe.min_pair_frequency": cfg.min_pair_frequency, "bpe.target_vocab_size": cfg.target_vocab_size, "bpe.vocabulary_size": model.vocabulary_size}
    return Artifact.of_flat(model, FLAT_ENTRIES | {k: str(v) for k, v in own.items()} | _corpus_entries(files, total_bytes, fnv, source))


def packed_artifact(model: PackedModel, stats: list, cfg: TrainingConfig, files: list[str], total_bytes: int, fnv: int, source: str = "memory") -> Artifact:
    """The artifact of a packed model; `stats` are the four rows of training_stats."""
    own = {"m2.target_vocab_size": cfg.target_vocab_size, "m2.max_learned_tokens": cfg.max_merges, "m2.min_pair_frequency": cfg.min_pair_frequency, "m2.total_learned_tokens": model.learned, "m2.total_logical_vocab_size": BYTE_COUNT + model.learned}
    for r in stats:
        prefix = f"m2.pack.{r.pack_id}."
        own |= {prefix + "name": PACK_NAMES[r.pack_id], prefix + "spans": r.spans, prefix + "routed_bytes": r.routed_bytes, prefix + "learned_merges": r.learned_merges, prefix + "local_vocab_size": r.local_vocab_size}
    return Artifact.of_packs(model, PACKED_ENTRIES | {k: str(v) for k, v in own.items()} | _corpus_entries(files, total_bytes, fnv, source))
