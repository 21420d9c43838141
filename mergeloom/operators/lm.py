"""A tiny recurrent language model: parameters, scoring, generation, and independent training runs as grouped tasks."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergeloom.errors import LanguageModelError
from mergeloom.functions.values import Xorshift

# Limits of models.
MAX_HIDDEN, MAX_CONTEXT, MAX_PACKS, MAX_ROWS, MAX_PARAMETERS, MAX_BYTES, MAX_GENERATED = 1024, 4096, 1024, 1_000_000, 16_777_216, 64 << 20, 4096
#: First eight bytes of parameter and mapping files written here; readers keep those of a file.
MODEL_MAGIC, MAP_MAGIC = b"MRGLOML\0", b"MRGLOMM\0"
F32 = np.float32


@dataclass(frozen=True)
class Optimizer:
    """Adam with global norm clipping."""

    learning_rate: float = 0.01
    beta1: float = 0.9
    beta2: float = 0.999
    epsilon: float = 1e-8
    clip: float = 1.0

    def __post_init__(self) -> None:
        if not (0 < self.learning_rate < np.inf and 0 <= self.beta1 < 1 and 0 <= self.beta2 < 1 and 0 < self.epsilon < np.inf and 0 < self.clip < np.inf):
            raise LanguageModelError("invalid optimizer")


@dataclass
class RecurrentModel:
    """h_t = tanh(E[x_t] + P[t] + b + W h_(t-1)), reset per window.

    `packs` is empty for a flat head over `rows` ids, else the (pack_id, count) of a factorized one:
    a head over packs and, within the target's pack, one over its rows.
    """

    hidden: int
    context: int
    packs: tuple[tuple[int, int], ...] = ()
    rows: int = 0
    seed: int = 1
    permutation: tuple[int, ...] = ()
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    moments: tuple[dict[str, np.ndarray], dict[str, np.ndarray]] | None = None
    step: int = 0

    def __post_init__(self) -> None:
        if not (2 <= self.hidden <= MAX_HIDDEN and 1 <= self.context <= MAX_CONTEXT):
            raise LanguageModelError("invalid dimensions", hidden=self.hidden, context=self.context)
        if self.packs:
            if len(self.packs) > MAX_PACKS or len({p for p, _ in self.packs}) < len(self.packs) or any(n < 1 for _, n in self.packs):
                raise LanguageModelError("invalid packs")
            self.packs = tuple(sorted(self.packs))
            self.rows = sum(n for _, n in self.packs)
        if not 1 <= self.rows <= MAX_ROWS:
            raise LanguageModelError("invalid vocabulary", rows=self.rows)
        self.first = dict(zip([p for p, _ in self.packs], np.cumsum([0] + [n for _, n in self.packs]).tolist()))
        if self.parameters > MAX_PARAMETERS or 40 + 6 * max(1, len(self.packs)) + 4 * self.parameters > MAX_BYTES:
            raise LanguageModelError("model too large", parameters=self.parameters)
        if not self.weights:
            self.weights = self._start()

    def shapes(self) -> dict[str, tuple[int, ...]]:
        d, v, k = self.hidden, self.rows, len(self.packs)
        head = {"pack_out": (k, d), "pack_bias": (k,), "local_out": (v, d), "local_bias": (v,)} if k else {"out": (v, d), "out_bias": (v,)}
        return {"embedding": (v, d), "position": (self.context, d), "recurrent": (d, d), "recurrent_bias": (d,)} | head

    @property
    def parameters(self) -> int:
        return sum(int(np.prod(s)) for s in self.shapes().values())

    def _start(self) -> dict[str, np.ndarray]:
        rng, scale = Xorshift(self.seed), F32(0.15) / np.sqrt(F32(self.hidden))
        draw = lambda shape: np.array([rng.signed() for _ in range(int(np.prod(shape)))], F32).reshape(shape)
        out = {}
        for name, shape in self.shapes().items():
            if name.endswith("bias"):
                out[name] = np.zeros(shape, F32)
            elif name == "recurrent":
                out[name] = F32(0.5) * np.eye(self.hidden, dtype=F32) + draw(shape) * F32(0.01)
            else:
                out[name] = draw(shape) * scale
        if self.permutation:
            out["embedding"] = out["embedding"][list(self.permutation)]
        return out

    def row(self, pack: np.ndarray, local: np.ndarray) -> np.ndarray:
        """Embedding rows of tokens; raises LanguageModelError with the index of the first unknown one."""
        pack, local = np.asarray(pack, np.int64), np.asarray(local, np.int64)
        known = np.zeros(pack.shape, bool)
        rows = np.zeros(pack.shape, np.int64)
        for p, n in self.packs or ((0, self.rows),):
            here = (pack == p) & (local >= 0) & (local < n)
            rows[here] = local[here] + self.first.get(p, 0)
            known |= here
        if not known.all():
            at = int(np.flatnonzero(~known.ravel())[0])
            raise LanguageModelError("unknown token", index=at, pack=int(pack.ravel()[at]), local=int(local.ravel()[at]))
        return rows

    def states(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Hidden states (n, t + 1, d), zeros first, of padded row windows; beyond a window's length they repeat the last."""
        w, (n, t) = self.weights, rows.shape
        if t > self.context:
            raise LanguageModelError("context too long", length=t)
        h = np.zeros((n, t + 1, self.hidden), F32)
        for i in range(t):
            h[:, i + 1] = np.tanh(w["embedding"][rows[:, i]] + w["position"][i] + w["recurrent_bias"] + h[:, i] @ w["recurrent"].T)
            done = lengths <= i
            h[done, i + 1] = h[done, i]
        return h

    def losses(self, h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Negative log likelihoods (pack head, token head) of target rows for states (m, d), in doubles; a flat head has pack losses of 0."""
        w = self.weights
        if not self.packs:
            return np.zeros(len(rows)), _loss(h @ w["out"].T + w["out_bias"], rows)
        starts = np.array([self.first[p] for p, _ in self.packs])
        index = np.searchsorted(starts, rows, side="right") - 1
        pack_loss, local = _loss(h @ w["pack_out"].T + w["pack_bias"], index), np.zeros(len(rows))
        for k, (p, n) in enumerate(self.packs):
            at = np.flatnonzero(index == k)
            if len(at):
                s = slice(starts[k], starts[k] + n)
                local[at] = _loss(h[at] @ w["local_out"][s].T + w["local_bias"][s], rows[at] - starts[k])
        return pack_loss, local

    def predict(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy (pack, local): the best pack first, then the best token in it; not the best pair."""
        w = self.weights
        if not self.packs:
            return np.zeros(len(h), np.int64), (h @ w["out"].T + w["out_bias"]).argmax(1)
        k = (h @ w["pack_out"].T + w["pack_bias"]).argmax(1)
        local = np.zeros(len(h), np.int64)
        for i, (p, n) in enumerate(self.packs):
            at = np.flatnonzero(k == i)
            s = slice(self.first[p], self.first[p] + n)
            local[at] = (h[at] @ w["local_out"][s].T + w["local_bias"][s]).argmax(1)
        return np.array([p for p, _ in self.packs])[k], local

    def right_locals(self, h: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whether the best token of the target's own pack is the target; for a flat head, of all tokens."""
        w, packs = self.weights, self.packs or ((0, self.rows),)
        out, bias = (w["local_out"], w["local_bias"]) if self.packs else (w["out"], w["out_bias"])
        right = np.zeros(len(rows), bool)
        for p, n in packs:
            a = self.first.get(p, 0)
            at = np.flatnonzero((rows >= a) & (rows < a + n))
            right[at] = (h[at] @ out[a : a + n].T + bias[a : a + n]).argmax(1) == rows[at] - a
        return right

    def generate(self, prompt: Sequence[tuple[int, int]], count: int) -> list[tuple[int, int]]:
        """Greedy continuation; the last `context` tokens are the window of every step."""
        if not prompt:
            raise LanguageModelError("empty prompt")
        if len(prompt) + count > MAX_GENERATED:
            raise LanguageModelError("generation too long", count=len(prompt) + count)
        self.row(*np.array(prompt).T)
        out = list(prompt)
        for _ in range(count):
            rows = self.row(*np.array(out[-self.context :]).T)[None]
            p, loc = self.predict(self.states(rows, np.array([rows.shape[1]]))[:, -1])
            out.append((int(p[0]), int(loc[0])))
        return out[len(prompt) :]

    def macs(self, inputs: np.ndarray, targets: np.ndarray) -> int:
        """Multiply-accumulates of training on windows (n, t) with target rows (n, t)."""
        n, t = inputs.shape
        d = self.hidden
        if self.packs:
            starts = np.array([self.first[p] for p, _ in self.packs])
            counts = np.array([c for _, c in self.packs])
            rows = int((len(self.packs) + counts[np.searchsorted(starts, targets.ravel(), side="right") - 1]).sum())
        else:
            rows = targets.size * self.rows
        return n * (3 * t - 1) * d * d + 3 * rows * d

    def train_batch(self, inputs: np.ndarray, targets: np.ndarray, opt: Optimizer = Optimizer()) -> dict[str, float]:
        """One Adam step on windows of rows (n, t); nothing changes if a new value isn't finite."""
        if not inputs.size:
            raise LanguageModelError("empty batch")
        w, (n, t), d = self.weights, inputs.shape, self.hidden
        h = self.states(inputs, np.full(n, t))
        flat, gold, scale = h[:, 1:].reshape(-1, d), targets.ravel(), F32(1) / F32(targets.size)
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        back = np.zeros_like(flat)

        def head(out: str, bias: str, at: np.ndarray, s: slice, index: np.ndarray) -> float:
            logits = flat[at] @ w[out][s].T + w[bias][s]
            loss, p = _loss(logits, index), _softmax(logits)
            p[np.arange(len(at)), index] -= 1
            p *= scale
            grads[out][s] += p.T @ flat[at]
            grads[bias][s] += p.sum(0)
            back[at] += p @ w[out][s]
            return float(loss.sum())

        every = np.arange(len(gold))
        if self.packs:
            starts = np.array([self.first[p] for p, _ in self.packs])
            index = np.searchsorted(starts, gold, side="right") - 1
            total = head("pack_out", "pack_bias", every, slice(None), index)
            for k, (p, c) in enumerate(self.packs):
                at = np.flatnonzero(index == k)
                if len(at):
                    total += head("local_out", "local_bias", at, slice(starts[k], starts[k] + c), gold[at] - starts[k])
        else:
            total = head("out", "out_bias", every, slice(None), gold)
        back, carry = back.reshape(n, t, d), np.zeros((n, d), F32)
        for i in range(t - 1, -1, -1):
            pre = (back[:, i] + carry) * (1 - h[:, i + 1] ** 2)
            np.add.at(grads["embedding"], inputs[:, i], pre)
            grads["position"][i] += pre.sum(0)
            grads["recurrent_bias"] += pre.sum(0)
            grads["recurrent"] += pre.T @ h[:, i]
            carry = pre @ w["recurrent"]
        norm = float(np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grads.values())))
        if not np.isfinite(norm):
            raise LanguageModelError("not finite", what="gradient norm")
        if norm > opt.clip:
            grads = {k: g * F32(opt.clip / norm) for k, g in grads.items()}
        self._adam(grads, opt)
        return {"loss_per_token": total / targets.size, "gradient_norm": norm, "macs": self.macs(inputs, targets)}

    def _adam(self, grads: dict[str, np.ndarray], opt: Optimizer) -> None:
        m, v = self.moments or ({k: np.zeros_like(x) for k, x in self.weights.items()}, {k: np.zeros_like(x) for k, x in self.weights.items()})
        s = F32(self.step + 1)
        b1, b2 = F32(opt.beta1), F32(opt.beta2)
        new_m = {k: b1 * m[k] + (1 - b1) * g for k, g in grads.items()}
        new_v = {k: b2 * v[k] + (1 - b2) * g * g for k, g in grads.items()}
        with np.errstate(all="ignore"):  # what isn't finite is refused below
            new_w = {k: self.weights[k] - F32(opt.learning_rate) * (new_m[k] / (1 - b1**s)) / (np.sqrt(new_v[k] / (1 - b2**s)) + F32(opt.epsilon)) for k in grads}
        if not all(np.isfinite(x).all() for part in (new_m, new_v, new_w) for x in part.values()):
            raise LanguageModelError("not finite", what="optimizer step")
        self.weights, self.moments, self.step = new_w, (new_m, new_v), self.step + 1

    def to_bytes(self, magic: bytes = MODEL_MAGIC) -> bytes:
        """Parameter file: head, packs, then all weights in layout order."""
        packs = self.packs or ((0, self.rows),)
        body = b"".join(self.weights[k].astype("<f4").tobytes() for k in self.shapes())
        head = magic + struct.pack("<HBBIIQI", 1, int(bool(self.packs)), 0, self.hidden, self.context, self.seed, len(packs))
        return head + b"".join(struct.pack("<HI", *p) for p in packs) + struct.pack("<Q", self.parameters) + body

    @staticmethod
    def from_bytes(raw: bytes) -> RecurrentModel:
        """Parse a parameter file; the layout is checked before weights are made, weights must be finite."""
        if len(raw) > MAX_BYTES or len(raw) < 40:
            raise LanguageModelError("malformed file", size=len(raw))
        version, kind, zero, hidden, context, seed, n = struct.unpack_from("<HBBIIQI", raw, 8)
        if version != 1 or kind > 1 or zero or n < 1 or n > MAX_PACKS or len(raw) < 40 + 6 * n:
            raise LanguageModelError("malformed file", version=version, kind=kind)
        packs = tuple(struct.unpack_from("<HI", raw, 32 + 6 * i) for i in range(n))
        count = struct.unpack_from("<Q", raw, 32 + 6 * n)[0]
        rows = sum(c for _, c in packs)
        shape = RecurrentModel.__new__(RecurrentModel)
        shape.hidden, shape.context, shape.packs, shape.rows = hidden, context, packs if kind else (), rows
        if not (2 <= hidden <= MAX_HIDDEN and 1 <= context <= MAX_CONTEXT and 1 <= rows <= MAX_ROWS) or shape.parameters != count or count > MAX_PARAMETERS or len(raw) != 40 + 6 * n + 4 * count:
            raise LanguageModelError("parameter count does not match dimensions", count=count)
        values = np.frombuffer(raw, "<f4", offset=40 + 6 * n).astype(F32)
        if not np.isfinite(values).all():
            raise LanguageModelError("not finite", what="parameter")
        weights, at = {}, 0
        for name, s in shape.shapes().items():
            weights[name] = values[at : at + int(np.prod(s))].reshape(s).copy()
            at += int(np.prod(s))
        return RecurrentModel(hidden, context, packs if kind else (), 0 if kind else rows, seed, weights=weights)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z.astype(np.float64) - z.max(1, keepdims=True))
    return (e / e.sum(1, keepdims=True)).astype(F32)


def _loss(z: np.ndarray, target: np.ndarray) -> np.ndarray:
    if not np.isfinite(z).all():
        raise LanguageModelError("not finite", what="logit")
    d = z.astype(np.float64)
    top = d.max(1)
    return (top - d[np.arange(len(d)), target]) + np.log(np.exp(d - top[:, None]).sum(1))


#: Positions that are scored together.
SCORED = 8192
SCORES = "pos bigint, pack int, local bigint, active int, pack_nll double, token_nll double, nll double, pack_right boolean, local_right boolean, right boolean"


def score(df: DataFrame, model: RecurrentModel, ident: str, tokens: str) -> DataFrame:
    """Columns (ident, pos, pack, local, active, pack_nll, token_nll, nll, pack_right, local_right, right): every token but the first, given at most `context` before it.

    `tokens` is ARRAY<STRUCT<pack, local>>. Windows of all sequences of a batch are scored together;
    nothing is shuffled. `active` is the size of the head that the target's pack has.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sizes = dict(m.packs or ((0, m.rows),))
        for b in batches:
            lists = b.column(1).fill_null([]) if b.column(1).null_count else b.column(1)
            begin = np.asarray(lists.offsets, np.int64)
            values = lists.values.slice(begin[0], begin[-1] - begin[0])
            begin = begin - begin[0]
            pack, local = (np.asarray(values.field(i), np.int64) for i in (0, 1))
            rows = m.row(pack, local)
            owner = np.repeat(np.arange(len(b)), np.diff(begin))
            pos = np.arange(len(rows)) - begin[owner]
            every = np.flatnonzero(pos > 0)
            for a in range(0, len(every), SCORED):
                at = every[a : a + SCORED]
                n = np.minimum(pos[at], m.context)
                offset = at[:, None] - n[:, None] + np.arange(m.context)
                h = m.states(rows[np.minimum(offset, len(rows) - 1)], n)[np.arange(len(at)), n]
                pl, tl = m.losses(h, rows[at])
                pp, lp = m.predict(h)
                active = np.array([sizes[p] for p in pack[at].tolist()], np.int32)
                columns = [b.column(0).take(pa.array(owner[at])), pos[at], pack[at].astype(np.int32), local[at], active, pl, tl, pl + tl, pp == pack[at], m.right_locals(h, rows[at]), (pp == pack[at]) & (lp == local[at])]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[ident, *[c.split(" ")[0] for c in SCORES.split(", ")]])

    return df.select(ident, tokens).mapInArrow(run, f"{ident} {kind}, {SCORES}")


def evaluation(scored: DataFrame, packs: int = 0) -> DataFrame:
    """One row of metrics over scored tokens: targets, losses per token and head, accuracies, and for a model of `packs` packs the mean size of the active head and the pack head's share of all logits.

    Without targets all but their number are NULL.
    """
    n, k = F.count(F.lit(1)), F.lit(packs)
    mean = lambda c: F.avg(F.col(c).cast("double"))
    got = scored.agg(n.alias("targets"), mean("nll").alias("loss_per_token"), mean("pack_nll").alias("pack_loss"), mean("token_nll").alias("token_loss"), mean("pack_right").alias("pack_accuracy"), mean("local_right").alias("local_accuracy"), mean("right").alias("accuracy"), mean("active").alias("active_head_mean"))
    return got.withColumn("pack_logit_share", F.when(k > 0, k / (k + F.col("active_head_mean"))))


def pack_accuracy(scored: DataFrame) -> DataFrame:
    """Columns (pack, targets, head_size, pack_accuracy, local_accuracy, accuracy)."""
    mean = lambda c: F.avg(F.col(c).cast("int")).alias(c.replace("right", "accuracy"))
    return scored.groupBy("pack").agg(F.count(F.lit(1)).alias("targets"), F.max("active").alias("head_size"), mean("pack_right"), mean("local_right"), mean("right"))


def training_runs(runs: DataFrame, model: RecurrentModel, train: np.ndarray, updates: int, batch: int = 4, opt: Optimizer = Optimizer()) -> DataFrame:
    """Columns (seed, step, loss_per_token, gradient_norm, macs): one independent run per seed of `runs` (seed), each one task.

    `train` are (pack, local) tokens of the training split; windows start at generator state modulo
    (n - context), as in the sampling of windows.
    """
    shared = runs.sparkSession.sparkContext.broadcast((model, np.asarray(train, np.int64)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seed = int(pdf["seed"].iloc[0])
        base, tokens = shared.value
        m = replace(base, seed=seed, weights={}, moments=None, step=0)
        rows, rng, out = m.row(tokens[:, 0], tokens[:, 1]), Xorshift(seed), []
        if len(rows) <= m.context:
            raise LanguageModelError("training split too short", tokens=len(rows))
        for step in range(1, updates + 1):
            starts = np.array([rng.below(len(rows) - m.context) for _ in range(batch)])
            at = starts[:, None] + np.arange(m.context)
            out.append({"seed": seed, "step": step} | m.train_batch(rows[at], rows[at + 1], opt))
        return pd.DataFrame(out)

    return runs.select("seed").distinct().groupBy("seed").applyInPandas(run, "seed bigint, step bigint, loss_per_token double, gradient_norm double, macs bigint")


#: Rows of drawn windows that one plan may have; they are a plan's own, not the corpus's.
MAX_DRAWN = 4_000_000


def window_draws(spark, runs: Sequence[tuple[str, int, int]], positions: int, context: int, batch: int) -> DataFrame:
    """Columns (run, step, slot, at, pos): the places of every window that runs (name, seed, updates) draw from `positions` tokens.

    Starts are generator states modulo (positions - context); `at` counts 0 to context within the
    window. More than MAX_DRAWN rows, or too few tokens, are an error.
    """
    if positions <= context:
        raise LanguageModelError("training split too short", tokens=positions)
    if sum(u for _, _, u in runs) * batch * (context + 1) > MAX_DRAWN:
        raise LanguageModelError("too many windows in one plan", limit=MAX_DRAWN)
    rows = []
    for name, seed, updates in runs:
        rng = Xorshift(seed)
        rows += [(name, step, slot, rng.below(positions - context)) for step in range(1, updates + 1) for slot in range(batch)]
    drawn = spark.createDataFrame(rows, "run string, step int, slot int, start bigint")
    return drawn.select("run", "step", "slot", F.posexplode(F.sequence(F.col("start"), F.col("start") + context)).alias("at", "pos"))


def train_drawn(draws: DataFrame, tokens: DataFrame, models: dict[str, RecurrentModel], opt: Optimizer = Optimizer()) -> DataFrame:
    """Columns (run, step, loss_per_token, gradient_norm, macs): every run on its drawn windows, a task each.

    `tokens` (pos, pack, local) are the joined training split, of any size: only the drawn places are
    fetched from it. `models` are the runs' untrained models.
    """
    shared = draws.sparkSession.sparkContext.broadcast(models)
    got = draws.join(tokens.hint("merge"), "pos").select("run", "step", "slot", "at", "pack", "local")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["run"].iloc[0]
        base = shared.value[name]
        m = replace(base, weights={}, moments=None, step=0)
        pdf = pdf.sort_values(["step", "slot", "at"])
        rows = m.row(pdf["pack"].to_numpy(), pdf["local"].to_numpy())
        steps, slots, width = pdf["step"].nunique(), pdf["slot"].nunique(), pdf["at"].nunique()
        rows = rows.reshape(steps, slots, width)
        return pd.DataFrame([{"run": name, "step": k + 1} | m.train_batch(r[:, :-1], r[:, 1:], opt) for k, r in enumerate(rows)])

    return got.groupBy("run").applyInPandas(run, "run string, step bigint, loss_per_token double, gradient_norm double, macs bigint")


def generate(df: DataFrame, model: RecurrentModel, ident: str, prompt: str, count: int) -> DataFrame:
    """Columns (ident, tokens ARRAY<STRUCT<pack, local>>): greedy continuations of prompts.

    Prompts may have any length: every token must be known, and the last `context` of them decide,
    as in RecurrentModel.generate, whose limit holds for these and `count` together.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[ident].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in parts:
            got = []
            for p in pdf[prompt]:
                seq = [(int(t["pack"]), int(t["local"])) for t in p]
                if seq:
                    m.row(*np.array(seq).T)
                got.append(m.generate(seq[-m.context :], count))
            yield pd.DataFrame({ident: pdf[ident], "tokens": [[{"pack": p, "local": loc} for p, loc in g] for g in got]})

    return df.select(ident, prompt).mapInPandas(run, f"{ident} {kind}, tokens array<struct<pack:int,local:bigint>>")


def mapping_to_bytes(rows: Sequence[tuple[int, int]], magic: bytes = MAP_MAGIC) -> bytes:
    """Mapping file: (pack, local) by global id."""
    if not 1 <= len(rows) <= MAX_ROWS:
        raise LanguageModelError("invalid mapping", rows=len(rows))
    return magic + struct.pack("<I", len(rows)) + b"".join(struct.pack("<HI", *r) for r in rows)


def mapping_from_bytes(raw: bytes) -> list[tuple[int, int]]:
    if len(raw) < 12:
        raise LanguageModelError("malformed mapping", size=len(raw))
    n = struct.unpack_from("<I", raw, 8)[0]
    if not 1 <= n <= MAX_ROWS or len(raw) != 12 + 6 * n:
        raise LanguageModelError("malformed mapping", rows=n)
    rows = [struct.unpack_from("<HI", raw, 12 + 6 * i) for i in range(n)]
    packs: dict[int, list[int]] = {}
    for p, loc in rows:
        packs.setdefault(p, []).append(loc)
    if any(sorted(v) != list(range(len(v))) for v in packs.values()):
        raise LanguageModelError("mapping is no bijection")
    return rows
