"""Same or near-same records across splits: content-defined chunks, and an exact completion for what they leave open."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergeloom.llm.rolling import WINDOW, Rolled, by_record, word_hashes
from mergeloom.llm.splits import split_key
from mergeloom.operators.ranking import first_arrival
from mergeloom.session import cut, stored

#: The share of two records' distinct windows of three words that both must hold.
SHARE = Fraction(60, 100)
#: One window in so many begins a chunk.
CHUNK = 8
#: Records of a batch whose windows are packed together, and windows of one range of hashes (about 20 bytes each in a task).
BATCH, RANGE_WINDOWS = 10_000, 1_000_000
#: A window that so many records of a batch hold is sent once for all of them, with its counts.
AGGREGATED = 16
#: Chunks in more train-held-out pairs are left to the completion.
CHUNK_PAIRS = 4096
#: Candidate records up to this number (8 bytes each) are broadcast to fetch their bodies; beyond it the bodies are joined by merging.
BROADCAST_IDS = 100_000

def _rolled(bodies: pa.Array, corpora: pa.Array) -> Rolled:
    salts = corpora.cast(pa.int64())
    return Rolled(*word_hashes(bodies), np.where(np.asarray(salts.is_null()), 0, 2 * np.asarray(salts.fill_null(0)) + 1))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _members(units: DataFrame) -> DataFrame:
    """(unit_id, corpus_id, source, split, train, key): train and held-out rows, once; equal keys are equal bodies of one corpus."""
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("corpus_id").cast("string"), F.lit("")), F.lit(" "), F.col("body")).cast("binary")))
    rows = units.select("unit_id", "corpus_id", "source", "proposed", key.alias("key"), "ingested_at")
    rows = first_arrival(rows, ["unit_id"], ["corpus_id", "source", "proposed", "key"], ["ingested_at"])
    rows = rows.where("unit_id is not null and key is not null").withColumn("split", split_key("proposed")).where("split in ('train', 'validation', 'test')")
    return rows.select("unit_id", "corpus_id", "source", "split", (F.col("split") == "train").alias("train"), "key")


def _classes(units: DataFrame, members: DataFrame) -> DataFrame:
    """(key, cls, has_train, has_held, corpus, body), one row per distinct record; cls is the least unit_id.

    A body is sent once per task that reads it, however many copies there are.
    """
    one = members.groupBy("key").agg(F.min("unit_id").alias("cls"), F.max("train").alias("has_train"), F.max(~F.col("train")).alias("has_held"))
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("corpus_id").cast("string"), F.lit("")), F.lit(" "), F.col("body")).cast("binary")))
    bodies = units.where("body is not null").select(key.alias("bkey"), F.col("corpus_id").alias("corpus"), "body").groupBy("bkey").agg(F.first("corpus").alias("corpus"), F.first("body").alias("body"))
    return one.join(bodies.hint("merge"), F.col("key") == F.col("bkey")).select("key", "cls", "has_train", "has_held", "corpus", "body")


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte plane by byte plane, compressed."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns]
    return zlib.compress(len(columns[0]).to_bytes(4, "little") + b"".join(planes), 1)


def _unpacked(raw: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zlib.decompress(raw)
    n, at, out = int.from_bytes(raw[:4], "little"), 4, []
    for k in map(np.dtype, kinds):
        planes = np.frombuffer(raw, np.uint8, n * k.itemsize, at).reshape(k.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(k).reshape(n))
        at += n * k.itemsize
    return out


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows sorted by `key`, group by group."""
    now, held = None, []
    for b in batches:
        for r in b.to_pylist():
            if held and r[key] != now:
                yield now, held
                held = []
            now = r[key]
            held.append(r)
    if held:
        yield now, held


TRAIN, HELD, CHUNK_BITS = 128, 64, 63
#: In place of a record of the batch: the window is sent with its counts.
FREQUENT = 65_535
PACKED = "dest bigint, batch bigint, payload binary"


def _entries(classes: DataFrame, bits: int, chunk: int) -> DataFrame:
    """Packed windows and chunk digests of the records, a block for every batch of records and range of hashes; and for every batch what its records are.

    dest >= 0: one of 2^bits ranges of the hash; entries (step of the hash's next 32 bits, record in
    the batch, kind: side bits and 0 for a window or the windows of a chunk that occur once), the
    rest of the chunks' digests, then windows that AGGREGATED or more records of the batch hold, as one entry with their counts.
    dest < 0: (record's class, number of windows, side bits) and, of those frequent windows, who holds them.
    """
    down = np.uint64(32 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), BATCH):
                b = whole.slice(first, BATCH)
                cls = np.asarray(b.column("cls"), np.int64)
                side = np.asarray(b.column("has_train")).astype(np.uint8) * TRAIN + np.asarray(b.column("has_held")).astype(np.uint8) * HELD
                rolled = _rolled(b.column("body"), b.column("corpus"))
                rec, h, n, once = rolled.distinct()
                crec, digest, at, _ = rolled.chunks(chunk)
                low = np.minimum(np.add.reduceat(once.astype(np.int64), at), CHUNK_BITS) if len(at) else at
                crec, digest, low = crec[low > 0], digest[low > 0], low[low > 0]
                w = np.concatenate((h, digest)) >> down
                rec, kind = np.concatenate((rec, crec)), np.concatenate((np.zeros(len(h), np.uint8), low.astype(np.uint8)))
                order = np.argsort(w)
                rest = (np.concatenate((np.zeros(len(h), np.uint64), digest)) & ((np.uint64(1) << down) - np.uint64(1))).astype(np.uint32)
                w, rec, kind, rest = w[order], rec[order].astype(np.uint16), kind[order], rest[order]
                begin = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else np.zeros(0, np.int64)
                size = np.diff(np.append(begin, len(w)))
                often = np.repeat(size >= AGGREGATED, size)
                held_by = often & (kind == 0)  # frequent chunks are left to the completion
                kind |= side[rec]
                fw, fbegin = np.unique(w[held_by], return_index=True)
                train = np.add.reduceat((kind[held_by] >= TRAIN).astype(np.int64), fbegin) if len(fw) else fbegin
                held = np.add.reduceat((kind[held_by] & HELD > 0).astype(np.int64), fbegin) if len(fw) else fbegin
                dest, payload = [-1 - int(cls[0])], [_joined(_packed(cls, n.astype(np.uint32), side), _packed(w[held_by], rec[held_by]))]
                w, rec, kind, rest = w[~often], rec[~often], kind[~often], rest[~often]
                edges, fedges = np.searchsorted(w >> np.uint64(32), np.arange((1 << bits) + 1)), np.searchsorted(fw >> np.uint64(32), np.arange((1 << bits) + 1))
                for p in range(1 << bits):
                    i, j, k, m = edges[p], edges[p + 1], fedges[p], fedges[p + 1]
                    if i < j or k < m:
                        dest.append(p)
                        single = _joined(_packed(_steps(w[i:j]), rec[i:j], kind[i:j]), _packed(rest[i:j][kind[i:j] & CHUNK_BITS > 0]))
                        payload.append(_joined(single, _packed(_steps(fw[k:m]), train[k:m].astype(np.uint32), held[k:m].astype(np.uint32))))
                yield pa.RecordBatch.from_arrays([pa.array(dest, pa.int64()), pa.array([int(cls[0])] * len(dest), pa.int64()), pa.array(payload, pa.binary())], names=["dest", "batch", "payload"])

    return classes.select("cls", "has_train", "has_held", "corpus", "body").mapInArrow(run, PACKED)


def _steps(w: np.ndarray) -> np.ndarray:
    """Sorted hashes of one range as differences of their low 32 bits, which repeat less and pack better."""
    return np.diff(w.astype(np.uint32), prepend=np.uint32(0))


def _joined(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(4, "little") + a + b


def _parted(raw: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(raw[:4], "little")
    return raw[4 : 4 + n], raw[4 + n :]


def _rests(raw: bytes, kind: np.ndarray) -> np.ndarray:
    """The rest of the digests of those entries that are chunks, 0 for windows."""
    out = np.zeros(len(kind), np.uint32)
    out[kind & CHUNK_BITS > 0] = _unpacked(raw, "<u4")[0]
    return out


def _levelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every range of hashes, the windows and chunks that both splits have, sent back to their batches with the level of their train-held-out pairs."""
    for p, rows in _groups(batches, "dest"):
        if p < 0:
            dest, batch, payload = [p] * len(rows), [r["batch"] for r in rows], [r["payload"] for r in rows]
        else:
            dest, batch, payload, parts = [], [], [], []
            for i, r in enumerate(rows):
                one, many = _parted(r["payload"])
                one, rest = _parted(one)
                step, rec, kind = _unpacked(one, "<u4", "<u2", "u1")
                parts.append((np.cumsum(step, dtype=np.uint32), rec, kind, _rests(rest, kind), (kind >= TRAIN).astype(np.int64), (kind & HELD > 0).astype(np.int64), np.full(len(rec), i)))
                step, train, held = _unpacked(many, "<u4", "<u4", "<u4")
                parts.append((np.cumsum(step, dtype=np.uint32), np.full(len(step), FREQUENT, np.uint16), np.zeros(len(step), np.uint8), np.zeros(len(step), np.uint32), train.astype(np.int64), held.astype(np.int64), np.full(len(step), i)))
            w, rec, kind, rest, train, held, block = (np.concatenate(x) for x in zip(*parts))
            key = w.astype(np.uint64) << np.uint64(1) | (kind & CHUNK_BITS > 0)
            order = np.argsort(key)
            begin = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(key) else order
            pairs = np.add.reduceat(train[order], begin).astype(np.float64) * np.add.reduceat(held[order], begin) if len(key) else np.zeros(0)
            every = np.empty(len(key))
            every[order] = np.repeat(pairs, np.diff(np.append(begin, len(key))))
            kept = np.flatnonzero((every > 0) & ((kind & CHUNK_BITS == 0) | (every <= CHUNK_PAIRS)))
            kept = kept[np.argsort(block[kept], kind="stable")]
            level = np.minimum(np.ceil(8 * np.log2(every[kept])), 255).astype(np.uint8)
            edges = np.searchsorted(block[kept], np.arange(len(rows) + 1))
            for i, r in enumerate(rows):
                a, b = edges[i], edges[i + 1]
                if a < b:
                    at = kept[a:b]
                    by = np.argsort(rec[at], kind="stable")
                    dest.append(p)
                    batch.append(r["batch"])
                    payload.append(_joined(_packed(rec[at][by], w[at][by], level[a:b][by], kind[at][by]), _packed(rest[at][by][kind[at][by] & CHUNK_BITS > 0])))
        yield pa.RecordBatch.from_arrays([pa.array(dest, pa.int64()), pa.array(batch, pa.int64()), pa.array(payload, pa.binary())], names=["dest", "batch", "payload"])


CUTS = "x bigint, cls bigint, n int, place int, low int, has_train boolean, has_held boolean"


def _cuts(classes: DataFrame, share: Fraction, chunk: int) -> DataFrame:
    """Columns (x, cls, n, place, low, has_train, has_held): where records may meet. n counts a record's distinct windows.

    Chunks have place 0 and `low`, the number of their windows that the record holds only once. Of
    the windows, those that one split lacks take the first places, the others follow by the number
    of train-held-out pairs that hold them; the first n - ceil(share n) + 1 places are kept. The
    numbers are exact: hashes travel to ranges, packed, and levels travel back.
    """
    size = classes.agg(F.sum(F.octet_length("body"))).head()[0] or 0
    bits = min(16, max(0, (size // (6 * RANGE_WINDOWS)).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "batch"):
            meta, frequent = _parted(next(r["payload"] for r in rows if r["dest"] < 0))
            cls, n, side = _unpacked(meta, "<i8", "<u4", "u1")
            fw, frec = _unpacked(frequent, "<u8", "<u2")
            parts = []
            for r in rows:
                if r["dest"] >= 0:
                    one, rest = _parted(r["payload"])
                    rec, w, level, kind = _unpacked(one, "<u2", "<u4", "u1", "u1")
                    parts.append((rec, np.uint64(r["dest"]) << np.uint64(32) | w.astype(np.uint64), level, kind, _rests(rest, kind)))
            if not parts:
                continue
            rec, w, level, kind, rest = (np.concatenate(x) for x in zip(*parts))
            whole = rec == FREQUENT  # frequent windows: an entry for each record that holds them
            if whole.any():
                by = np.argsort(w[whole])
                at = np.minimum(np.searchsorted(w[whole][by], fw), int(whole.sum()) - 1)
                hit = w[whole][by][at] == fw
                rec, level = np.concatenate((rec[~whole], frec[hit])), np.concatenate((level[~whole], level[whole][by][at[hit]]))
                w, kind = np.concatenate((w[~whole], fw[hit])), np.concatenate((kind[~whole], np.zeros(int(hit.sum()), np.uint8)))
                rest = np.concatenate((rest[~whole], np.zeros(int(hit.sum()), np.uint32)))
            low = (kind & CHUNK_BITS).astype(np.int32)
            own = np.flatnonzero(low == 0)
            own = own[by_record(rec[own], w[own] << np.uint64(32 - bits), level[own])]
            many = np.bincount(rec[own], minlength=len(cls))
            n = n.astype(np.int64)
            place = np.arange(len(own)) - (np.cumsum(many) - many)[rec[own]] + 1 + (n - many)[rec[own]]
            few = n - -(-n * share.numerator // share.denominator) + 1
            kept = place <= few[rec[own]]
            chunks = np.flatnonzero(low)
            r = np.concatenate((rec[chunks], rec[own[kept]]))
            x = np.concatenate((w[chunks] << np.uint64(32 - bits) | rest[chunks], w[own[kept]]))  # a chunk's whole digest, since it can decide
            yield pa.RecordBatch.from_arrays(
                [_signed(x), pa.array(cls[r]), pa.array(n[r].astype(np.int32)), pa.array(np.concatenate((np.zeros(len(chunks), np.int32), place[kept].astype(np.int32)))), pa.array(np.concatenate((low[chunks], np.zeros(int(kept.sum()), np.int32)))), pa.array(side[r] >= TRAIN), pa.array(side[r] & HELD > 0)],
                names=["x", "cls", "n", "place", "low", "has_train", "has_held"],
            )

    sent = _entries(classes, bits, chunk).repartition("dest").sortWithinPartitions("dest").mapInArrow(_levelled, PACKED)
    return sent.repartition("batch").sortWithinPartitions("batch").mapInArrow(run, CUTS)


def _exact(pairs: DataFrame, share: Fraction) -> DataFrame:
    """The rows (ct, ch, by) of (ct, ch, by, corpus, bt, bh) whose bodies share enough distinct windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = len(b)
            rec, h, n, _ = _rolled(pa.concat_arrays([b.column("bt"), b.column("bh")]), pa.concat_arrays([b.column("corpus")] * 2)).distinct()
            r = rec % max(k, 1)
            order = by_record(r, h)
            r, h = r[order], h[order]
            twice = (r[1:] == r[:-1]) & (h[1:] == h[:-1])
            common = np.bincount(r[1:][twice], minlength=k)
            near = common * share.denominator >= (n[:k] + n[k:] - common) * share.numerator
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(near & (n[:k] > 0))) for c in ("ct", "ch", "by")], names=["ct", "ch", "by"])

    return pairs.mapInArrow(run, "ct bigint, ch bigint, by string")


def class_pairs(classes: DataFrame, share: Fraction = SHARE, chunk: int = CHUNK) -> DataFrame:
    """Columns (ct, ch, by): pairs of different records, ct in train and ch held out, that share enough windows.

    Records are cut by rolling hash into chunks, and chunk digests are joined across splits. For
    every pair that meets, the lengths of its shared chunks are summed, counting only windows that
    the record holds once, so the sum is a lower bound of the common windows: a pair whose sum
    reaches the share is found, of other pairs with a shared chunk the bodies are compared (`by` =
    chunks). The same join carries the least windows of every
    record in one order for all, n - ceil(share n) + 1 of n. Two records that reach the share have
    one of these in common, so no pair is lost that chunks leave open; of those that can still reach
    it by the places at which they meet, the bodies are compared too (`by` = windows).

    The order takes windows first that are in few train-held-out pairs. Chunks in more than
    CHUNK_PAIRS pairs are not joined; the windows find their pairs.
    """
    cuts = stored(_cuts(classes, share, chunk))
    train = cuts.where("has_train").select("x", F.col("cls").alias("ct"), F.col("n").alias("nt"), F.col("place").alias("pt"), F.col("low").alias("lt"))
    held = cuts.where("has_held").select("x", F.col("cls").alias("ch"), F.col("n").alias("nh"), F.col("place").alias("ph"), F.col("low").alias("lh"))
    fits = F.least("nt", "nh") * share.denominator >= F.greatest("nt", "nh") * share.numerator
    met = train.join(held.hint("merge"), "x").where((F.col("ct") != F.col("ch")) & fits & ((F.col("pt") > 0) == (F.col("ph") > 0)))
    sums = met.groupBy("ct", "ch", "nt", "nh").agg(F.greatest(F.sum("lt"), F.sum("lh")).alias("low"), F.sum((F.col("pt") > 0).cast("bigint")).alias("seen"), F.max("pt").alias("pt"), F.max("ph").alias("ph"))
    enough = lambda c: c * share.denominator >= (F.col("nt") + F.col("nh") - c) * share.numerator
    most = F.col("seen") + F.least(F.col("nt") - F.col("pt"), F.col("nh") - F.col("ph"))
    sums = cut(sums.withColumn("sure", enough(F.col("low"))).where(F.col("sure") | ((F.col("seen") > 0) & enough(most))).select("ct", "ch", "sure", F.when(F.col("low") > 0, "chunks").otherwise("windows").alias("by")))
    open_pairs = sums.where("not sure").select("ct", "ch", "by")
    ids = cut(open_pairs.select(F.col("ct").alias("cls")).union(open_pairs.select("ch")).distinct())
    ids = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids.hint("merge")
    texts = classes.join(ids, "cls", "left_semi").select("cls", "corpus", "body")
    bt, bh = texts.select(F.col("cls").alias("ct"), "corpus", F.col("body").alias("bt")), texts.select(F.col("cls").alias("ch"), F.col("body").alias("bh"))
    near = _exact(open_pairs.join(bt.hint("merge"), "ct").join(bh.hint("merge"), "ch").select("ct", "ch", "by", "corpus", "bt", "bh"), share)
    return sums.where("sure").select("ct", "ch", "by").unionByName(near)


def overlap_links(units: DataFrame, share: Fraction = SHARE, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Pairs of distinct records and who holds them: (ct, ch, by) and (cls, unit_id, train).

    Copies of a body in one corpus are one record; a record in both splits is paired with itself
    (`by` = copies). Nothing here grows with the number of pairs of copies.
    """
    members = cut(_members(units))
    classes = stored(_classes(units, members))
    same = classes.where("has_train and has_held").select(F.col("cls").alias("ct"), F.col("cls").alias("ch"), F.lit("copies").alias("by"))
    named = members.select("key", "unit_id", "train").join(classes.select("key", "cls").hint("merge"), "key").select("cls", "unit_id", "train")
    return class_pairs(classes, share, chunk).unionByName(same), named


def overlap_pairs(units: DataFrame, share: Fraction = SHARE) -> DataFrame:
    """Columns (unit_id_a, unit_id_b), a < b: pairs of one corpus, one in train, one held out, that are the same or nearly.

    The same: equal bodies. Nearly: of the distinct windows of three words in either, at least
    `share` stand in both, counted exactly (so records of equal words are found too). NULL bodies
    match nothing, bodies without three words only their copies. The links of overlap_links,
    expanded to units, since that is what is asked.
    """
    links, named = overlap_links(units, share)
    mt = named.where("train").select(F.col("cls").alias("ct"), F.col("unit_id").alias("ut"))
    mh = named.where("not train").select(F.col("cls").alias("ch"), F.col("unit_id").alias("uh"))
    found = links.select("ct", "ch").join(mt.hint("merge"), "ct").join(mh.hint("merge"), "ch")
    return found.select(F.least("ut", "uh").alias("unit_id_a"), F.greatest("ut", "uh").alias("unit_id_b"))


def overlap_fractions(units: DataFrame, chunk: int = CHUNK // 2) -> DataFrame:
    """Columns (unit_id, corpus_id, source, split, n_words, shared_words, overlap) for every held-out unit.

    Records are cut before every word whose rolling hash is 0 modulo `chunk`; `shared_words` sums
    the lengths of the chunks whose digest also occurs in a train record of the corpus, `overlap` is
    their share. A chunk counts the words at which its windows begin, the last one all to the end.
    A record without words has overlap 0.
    """
    members = cut(_members(units))
    classes = stored(_classes(units, members))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rolled = _rolled(b.column("body"), b.column("corpus"))
            rec, digest, _, size = rolled.chunks(chunk)
            last = np.append(rec[1:] != rec[:-1], True) if len(rec) else np.zeros(0, bool)
            rec, digest = np.concatenate((rec, rolled.short)), np.concatenate((digest, rolled.short_hash))
            size = np.concatenate((size + (WINDOW - 1) * last, rolled.words[rolled.short]))
            cls = np.asarray(b.column("cls"), np.int64)[rec]
            yield pa.RecordBatch.from_arrays([pa.array(cls), _signed(digest), pa.array(size.astype(np.int64))], names=["cls", "digest", "size"])

    cutted = lambda side: classes.where(side).select("cls", "corpus", "body").mapInArrow(run, "cls bigint, digest bigint, size bigint")
    train = cutted("has_train").select("digest", "size").distinct().withColumn("hit", F.lit(True))
    held = cutted("has_held").join(train.hint("merge"), ["digest", "size"], "left")
    sums = held.groupBy("cls").agg(F.sum("size").alias("n_words"), F.sum(F.when(F.col("hit"), F.col("size")).otherwise(0)).alias("shared_words"))
    named = members.where("not train").join(classes.select("key", "cls").hint("merge"), "key")
    out = named.join(sums.hint("merge"), "cls", "left")
    n, s = F.coalesce("n_words", F.lit(0)), F.coalesce("shared_words", F.lit(0))
    return out.select("unit_id", "corpus_id", "source", "split", n.alias("n_words"), s.alias("shared_words"), F.when(n > 0, s / n).otherwise(0.0).alias("overlap"))


def overlap_counts(units: DataFrame, pairs: DataFrame) -> DataFrame:
    """Columns (corpus_id, split, source, units): held-out units in a pair, by split and source as proposed."""
    rows = _members(units).where("not train").select("unit_id", "corpus_id", "split", "source")
    ids = pairs.select(F.col("unit_id_a").alias("unit_id")).union(pairs.select("unit_id_b")).distinct()
    return rows.join(ids.hint("merge"), "unit_id").groupBy("corpus_id", "split", "source").agg(F.count(F.lit(1)).alias("units"))
