"""Scalar functions as columns: hashes, escapes, token text, schedules, counts of parameters and operations."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from mergeloom.artifact import PACK_NAMES

# Fixed values of the hashes and the generator.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
XORSHIFT_SEED = 0x9E3779B97F4A7C15
ROLLING_BASE = 257
MASK = (1 << 64) - 1


def fnv1a64_bytes(data: bytes, start: int = FNV_START) -> int:
    h = start
    for b in data:
        h = (h ^ b) * FNV_PRIME & MASK
    return h


@F.arrow_udf(LongType())
def fnv1a64(values: pa.Array) -> pa.Array:
    """FNV-1a of STRING or BINARY as BIGINT (two's complement); NULL stays NULL.

    All rows of a batch advance together, one byte position at a time.
    """
    if not pa.types.is_binary(values.type) and not pa.types.is_large_binary(values.type):
        values = values.cast(pa.binary())
    rows = values.to_pylist()
    sizes = np.array([len(v or b"") for v in rows], np.int64)
    data = np.frombuffer(b"".join(v or b"" for v in rows), np.uint8).astype(np.uint64)
    start = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(rows) else np.zeros(0, np.int64)
    order = np.argsort(-sizes, kind="stable")
    active = np.searchsorted(-sizes[order], -np.arange(1, (sizes.max() if len(rows) else 0) + 1), side="right")
    h = np.full(len(rows), FNV_START, np.uint64)
    with np.errstate(over="ignore"):
        for t, k in enumerate(active):
            i = order[:k]
            h[i] = (h[i] ^ data[start[i] + t]) * np.uint64(FNV_PRIME)
    return pa.array(h.view(np.int64), pa.int64(), mask=np.array([v is None for v in rows], bool))


def rolling_hashes(data: bytes, k: int) -> np.ndarray:
    """Polynomial hashes (base 257, digits b + 1, modulo 2^64) of all k-byte windows."""
    n = len(data)
    if k < 1 or n < k:
        return np.zeros(0, np.uint64)
    digits = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    out = np.zeros(n - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):  # Horner's rule for all windows at once
            out = out * np.uint64(ROLLING_BASE) + digits[i : n - k + 1 + i]
    return out


def lists_of(parts: list[np.ndarray]) -> pa.Array:
    """ARRAY<BIGINT> of numpy arrays."""
    begins = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(begins), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def window_anchors(data: bytes, k: int) -> np.ndarray:
    """For every k-byte window, the least mixed hash of the windows of half that length inside it; equal windows have equal anchors."""
    t = k // 2
    h = rolling_hashes(data, t) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    want, have = k - t + 1, 1
    if len(h) < want:
        return np.zeros(0, np.int64)
    n = len(h) - want + 1
    while have * 2 <= want:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[:n], h[want - have : want - have + n]).view(np.int64)


def anchors(k: int):
    """A column function: the distinct anchors of a STRING's or BINARY's k-byte windows as ARRAY<BIGINT>, about one for k / 4 bytes."""

    @F.arrow_udf(ArrayType(LongType()))
    def run(values: pa.Array) -> pa.Array:
        return lists_of([np.unique(window_anchors(v or b"", k)) for v in values.cast(pa.binary()).to_pylist()])

    return run


def anchored(k: int):
    """A column function: the distinct hashes of those k-byte windows of a STRING or BINARY whose anchor is in an ARRAY<BIGINT>."""

    @F.arrow_udf(ArrayType(LongType()))
    def run(values: pa.Array, wanted: pa.Array) -> pa.Array:
        out = []
        for v, w in zip(values.cast(pa.binary()).to_pylist(), wanted):
            here = np.isin(window_anchors(v or b"", k), np.asarray(w.values)) if w.is_valid else np.zeros(0, bool)
            out.append(np.unique(rolling_hashes(v or b"", k).view(np.int64)[here]) if here.any() else np.zeros(0, np.int64))
        return lists_of(out)

    return run


def rolling(k: int, stride: int = 1, distinct: bool = False):
    """A column function: window hashes of STRING or BINARY as ARRAY<BIGINT>, every `stride`-th, once each if `distinct`."""

    @F.arrow_udf(ArrayType(LongType()))
    def run(values: pa.Array) -> pa.Array:
        out = []
        for v in values.cast(pa.binary()).to_pylist():
            h = rolling_hashes(v or b"", k)[::stride].view(np.int64)
            out.append(np.unique(h) if distinct else h)
        return lists_of(out)

    return run


def near(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays' sets of at least 0.8, in integers; empty sets aren't near."""
    common, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return (union > 0) & (common * 5 >= union * 4)


def sha256_hex(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def bytes_hex(value: Column) -> Column:
    return F.lower(F.hex(value.cast("binary")))


def _escape_table() -> tuple[np.ndarray, np.ndarray]:
    """Of every byte, its text padded to four bytes, and the length of the text."""
    named = {0x5C: b"\\\\", 0x22: b'\\"', 0x0A: b"\\n", 0x0D: b"\\r", 0x09: b"\\t"}
    texts = [named.get(b, bytes([b]) if 32 <= b <= 126 else b"\\x%02X" % b) for b in range(256)]
    return np.array([list(x.ljust(4)) for x in texts], np.uint8), np.array([len(x) for x in texts], np.int64)


ESCAPED, ESCAPED_SIZE = _escape_table()


@F.arrow_udf(StringType())
def _escaped(values: pa.Array) -> pa.Array:
    out = []
    for v in values.to_pylist():
        own = np.frombuffer(v or b"", np.uint8)
        parts = [own[i : i + (1 << 20)] for i in range(0, len(own), 1 << 20)]
        out.append(None if v is None else b"".join(ESCAPED[x][np.arange(4) < ESCAPED_SIZE[x][:, None]].tobytes() for x in parts))
    return pa.array(out, pa.binary()).cast(pa.string())


def escape_bytes(value: Column) -> Column:
    r"""Bytes as text: \\ \" \n \r \t, printable ASCII as it is, others as \xHH; NULL stays NULL."""
    return _escaped(value.cast("binary"))


def format_symbol(symbol: Column) -> Column:
    """BYTE(n) or LOCAL(n) of a symbol id, where local id l is 256 + l."""
    return F.when(symbol < 256, F.format_string("BYTE(%d)", symbol)).otherwise(F.format_string("LOCAL(%d)", symbol - 256))


def format_token(pack: Column, local: Column) -> Column:
    """NAME:local; UNKNOWN_PACK for a pack without a name."""
    name = F.create_map(*[F.lit(x) for p, n in PACK_NAMES.items() for x in (p, n)])
    return F.concat_ws(":", F.coalesce(F.try_element_at(name, pack.cast("int")), F.lit("UNKNOWN_PACK")), local.cast("string"))


def parse_token(text: Column) -> Column:
    """STRUCT<pack INT, local BIGINT> of `pack:local`, a name before a number; NULL if malformed or out of range."""
    parts = F.split(text, ":")
    ids = F.create_map(*[F.lit(x) for p, n in PACK_NAMES.items() for x in (n, p)])
    first, second = F.get(parts, 0), F.get(parts, 1)
    digits = r"^\+?[0-9]+$"
    number = F.when(first.rlike(digits), first.try_cast("int"))
    pack = F.coalesce(F.try_element_at(ids, first), F.when(number.between(0, 65535), number))
    local = F.when(second.rlike(digits), second.try_cast("bigint"))
    return F.when((F.size(parts) == 2) & pack.isNotNull() & local.between(0, (1 << 32) - 1), F.struct(pack.alias("pack"), local.alias("local")))


def bits_per_byte(nll: Column, n_bytes: Column, targets: Column | None = None) -> Column:
    """nll / bytes / ln 2; NULL without targets or bytes, or if nll is negative or not finite."""
    ok = (n_bytes > 0) & (nll >= 0) & ~F.isnan(nll) & (nll < float("inf"))
    return F.when(ok if targets is None else ok & (targets > 0), nll / n_bytes / F.lit(math.log(2)))


def nll_per_byte(nll: Column, n_bytes: Column) -> Column:
    return F.when(n_bytes > 0, nll / n_bytes)


def mib_per_second(n_bytes: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, n_bytes / F.lit(1048576.0) / seconds)


def ratio(a: Column, b: Column) -> Column:
    """a / max(b, 1), as the summaries guard their shares."""
    return a / F.greatest(b, F.lit(1))


# Domain of every category that has one.
DOMAINS = {"english-drama": "english-literature", "english-prose": "english-literature", "german-prose": "german-prose", "code": "rust-source", "synthetic-json": "synthetic-json", "synthetic-unicode": "synthetic-unicode"}


def domain_of(category: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in DOMAINS.items() for x in kv]), category)


def learning_rate(step: Column, rate: float, warmup: int, total: int, decay: str = "constant") -> Column:
    """0 at step 0, linear up to `warmup`, then constant or half a cosine down to 0 at `total`."""
    if decay not in ("constant", "cosine") or total < 1 or warmup >= total or not rate > 0:
        raise ValueError("invalid schedule")
    s = step.cast("double")
    done = F.least(s - warmup, F.lit(float(total - warmup))) / F.lit(float(total - warmup))
    after = F.lit(rate) if decay == "constant" else F.lit(rate) * 0.5 * (1.0 + F.cos(F.lit(math.pi) * done))
    out = F.when(step == 0, 0.0)
    if warmup:
        out = out.when(step <= warmup, F.lit(rate) * s / F.lit(float(warmup)))
    return out.otherwise(after)


def xorshift(state: Column) -> Column:
    """The next state of the 13/7/17 generator, on BIGINT as unsigned; 0 stands for its replacement."""
    x = F.when(state == 0, F.lit(XORSHIFT_SEED - (1 << 64)).cast("bigint")).otherwise(state)
    for shift, left in ((13, True), (7, False), (17, True)):
        x = x.bitwiseXOR(F.shiftleft(x, shift) if left else F.shiftrightunsigned(x, shift))
    return x


def unsigned_modulo(x: Column, n: Column) -> Column:
    """x mod n for BIGINT read as unsigned; n > 0."""
    half = F.shiftrightunsigned(x, 1)
    return F.pmod(F.pmod(half, n) * 2 + x.bitwiseAND(F.lit(1).cast("bigint")), n)


class Xorshift:
    """The same generator on the driver or in a task."""

    def __init__(self, seed: int):
        self.state = seed & MASK or XORSHIFT_SEED

    def next(self) -> int:
        x = self.state
        x ^= x << 13 & MASK
        x ^= x >> 7
        x ^= x << 17 & MASK
        self.state = x
        return x

    def below(self, n: int) -> int:
        return self.next() % n

    def signed(self) -> np.float32:
        """A float32 from -1 to 1 of the upper 24 bits."""
        return np.float32(self.next() >> 40) / np.float32(8_388_607.5) - np.float32(1)


def flat_parameters(vocabulary: Column, hidden: Column, context: Column) -> Column:
    """Embedding, positions, recurrence with bias, output with bias."""
    return vocabulary * hidden + context * hidden + hidden * hidden + hidden + vocabulary * hidden + vocabulary


def factorized_parameters(rows: Column, packs: Column, hidden: Column, context: Column) -> Column:
    """As the flat model, but a pack head beside the local one."""
    return rows * hidden + context * hidden + hidden * hidden + hidden + packs * hidden + packs + rows * hidden + rows


def serialized_size(parameters: Column, packs: Column) -> Column:
    """Bytes of a parameter file."""
    return 40 + 6 * packs + 4 * parameters


def transformer_parameters(vocabulary: Column, width: Column, layers: Column, inner: Column, context: Column) -> Column:
    """Parameters of a decoder: token and position embeddings, per layer four projections, an MLP and two norm gains, a last gain, an output head with bias."""
    layer = 4 * (width * width + width) + 2 * width * inner + inner + width + 2 * width
    return vocabulary * width + context * width + layers * layer + width + vocabulary * width + vocabulary


def window_macs(length: Column, hidden: Column, rows: Column) -> Column:
    """Multiply-accumulates of training on one window: (3n - 1) d^2 and 3 rows d per target."""
    return (3 * length - 1) * hidden * hidden + 3 * length * rows * hidden


def softmax_loss(logits: Column, target: Column) -> Column:
    """(max - z_t) + ln sum exp(z - max) in doubles; NULL if a logit isn't finite or the target is no index."""
    z = F.transform(logits, lambda x: x.cast("double"))
    top = F.array_max(z)
    finite = ~F.exists(z, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    spread = F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.when(finite & (target >= 0) & (target < F.size(logits)), top - F.get(z, target) + F.log(spread))


def argmax(values: Column) -> Column:
    """Index of the greatest element, the first one among equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def train_path(path: Column) -> Column:
    """A folder's training file with forward slashes."""
    return F.concat(F.regexp_replace(path, r"\\", "/"), F.lit("/train.txt"))
