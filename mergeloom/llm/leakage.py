"""Evaluation passages in training text: a generalised suffix automaton over the items' words."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from mergeloom.llm.lookalike import Rewriter
from mergeloom.llm.rolling import WINDOW, WORD, Rolled, word_hashes
from mergeloom.session import cut

#: Consecutive words of an item that make a leak.
MIN_WORDS = 12
#: Words of the items in one automaton (about 150 MB in the task that has it); more items are several automata, each in tasks of its own.
BLOCK_WORDS = 200_000
#: Words of stretches that meet one automaton in one task.
STRETCH_WORDS = 1_000_000
#: Bits of the filter of the items' windows, 2 MB whatever the items; beyond some millions of words of items more stretches pass, results are the same.
FILTER_BITS = 24


def words_of(rewriter: Rewriter, text: str | None) -> list[str]:
    """Runs of letters or digits of the text's one form, case ignored."""
    return WORD.findall(rewriter(text)) if text else []


class ItemAutomaton:
    """Suffix automaton of several word sequences; states know the items whose passages end there."""

    def __init__(self, items: list[tuple[int, list[str]]], min_words: int = MIN_WORDS):
        self.min_words = min_words
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for i, ws in items if len(ws) >= min_words]
        for _, seq in sequences:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        #: Items that hold the passages of each state, as far as these can have min_words words.
        holders: list[set[int]] = [set() for _ in self.next]
        for item, seq in sequences:
            v = 0
            for w in seq:
                v = self.next[v][w]
                u = v
                while self.length[u] >= min_words and item not in holders[u]:  # suffixes are held too
                    holders[u].add(item)
                    u = self.link[u]
        self.held = [tuple(sorted(h)) for h in holders]

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        c = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def matches(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) wherever the longest match that ends there has min_words words."""
        vocabulary, nxt, link, length, least = self.vocabulary, self.next, self.link, self.length, self.min_words
        v = n = 0
        for end, word in enumerate(words, 1):
            w = vocabulary.get(word)
            if w is None:
                v = n = 0
                continue
            to = nxt[v].get(w)
            while to is None and v:
                v = link[v]
                n = length[v]
                to = nxt[v].get(w)
            if to is None:
                v = n = 0
            else:
                v, n = to, n + 1
                if n >= least:
                    yield end, n, v

    def leaks(self, words: list[str]) -> dict[int, int]:
        """Item -> words of its longest passage in the text, if it has min_words or more."""
        out: dict[int, int] = {}
        for _, n, v in self.matches(words):
            while n >= self.min_words:  # shorter suffixes of the match can stand in more items
                for item in self.held[v]:
                    if out.get(item, 0) < n:
                        out[item] = n
                v = self.link[v]
                n = self.length[v]
        return out

    def spans(self, words: list[str]) -> list[tuple[int, int]]:
        """Word ranges [a, b) covered by matches, joined where they overlap or touch."""
        out: list[tuple[int, int]] = []
        for end, n, _ in self.matches(words):
            a = end - n
            while out and out[-1][1] >= a:
                a = min(a, out.pop()[0])
            out.append((a, end))
        return out


def _item_words(eval_items: DataFrame) -> DataFrame:
    """(item_id, words ARRAY<STRING>): the items once, those with enough words for a window."""
    rewriter = Rewriter(fold_case=True)

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([words_of(rewriter, x) for x in texts.to_pylist()], pa.list_(pa.string()))

    rows = eval_items.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    return rows.select("item_id", split(F.col("text")).alias("words")).where(F.size("words") >= WINDOW)


def _filter(items: DataFrame, bits: int = FILTER_BITS) -> bytes:
    """A bit for every window of the items' words: a bound of 2^bits bits, joined from the tasks' own."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << bits, bool)
        for b in batches:
            rolled = Rolled(*word_hashes(pa.array([" ".join(w) for w in b.column(0).to_pylist()], pa.string()), str.split))
            own[(rolled.h >> np.uint64(64 - bits)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(own).tobytes(), 1)] if own.any() else [], pa.binary())], names=["packed"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((1 << bits) // 8, np.uint8)
        for b in batches:
            for x in b.column(0).to_pylist():
                both |= np.frombuffer(zlib.decompress(x), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([both.tobytes()])], names=["packed"])

    return items.select("words").mapInArrow(mark, "packed binary").repartition(1).mapInArrow(join, "packed binary").collect()[0].packed


def _runs(hit: np.ndarray, rec: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of runs of at least `least` windows that are hit, within one text."""
    start = hit.copy()
    start[1:] &= ~hit[:-1] | (rec[1:] != rec[:-1])
    end = hit.copy()
    end[:-1] &= ~hit[1:] | (rec[1:] != rec[:-1])
    a, b = np.flatnonzero(start), np.flatnonzero(end) + 1
    long = b - a >= least
    return a[long], b[long]


def _pieces(rewriter: Rewriter, text: str) -> list[tuple[int, int, list[str]]]:
    """Blank-separated pieces of a text with the blanks after them, and their words."""
    return [(m.start(), m.end(), words_of(rewriter, m[0])) for m in re.finditer(r"\S+\s*", text)]


def _stretches(documents: DataFrame, packed: bytes, min_words: int, by_piece: bool) -> DataFrame:
    """(doc_id, digest, first, words): stretches of words of which every window passes the filter, long enough for a leak.

    A passage shared with an item lies in one stretch. Every document is read once, whole. `by_piece`
    takes the words of blank-separated pieces, as remove_leaks cuts them out.
    """
    sc = documents.sparkSession.sparkContext
    shared = sc.broadcast((Rewriter(fold_case=True), packed))
    least = max(1, min_words - (WINDOW - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewriter, packed = shared.value
        marked = np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool)
        down = np.uint64(65 - len(marked).bit_length())

        def split(text: str) -> list[str]:
            return [w for _, _, ws in _pieces(rewriter, text) for w in ws] if by_piece else words_of(rewriter, text)

        for b in batches:
            texts = b.column("text")
            rolled = Rolled(*word_hashes(texts, split))
            a, e = _runs(marked[(rolled.h >> down).astype(np.int64)], rolled.rec, least)
            out, known = [], (-1, [])
            for i, j in zip(a.tolist(), e.tolist()):
                r = int(rolled.rec[i])
                if known[0] != r:
                    known = (r, split(texts[r].as_py()))
                first = int(rolled.place[i])
                out.append((r, first, known[1][first : first + j - i + WINDOW - 1]))
            rows = pa.array([r for r, _, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()).take(rows), b.column("digest").take(rows), pa.array([f for _, f, _ in out], pa.int32()), pa.array([w for _, _, w in out], pa.list_(pa.string()))], names=["doc_id", "digest", "first", "words"])

    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    return documents.where("text is not null").select("doc_id", "text", digest.alias("digest")).mapInArrow(run, "doc_id bigint, digest binary, first int, words array<string>")


def _matched(documents: DataFrame, eval_items: DataFrame, min_words: int, block_words: int, by_piece: bool, schema: str, use) -> DataFrame | None:
    """`use(automaton, stretch row)` over all stretches and blocks of items, as rows of `schema`; None without items.

    Items are dealt to blocks by hash. A task has one block: it builds the block's automaton and
    streams its share of the stretches through it. Nothing of this passes the driver.
    """
    items = cut(_item_words(eval_items))
    size = items.agg(F.sum(F.size("words"))).head()[0]
    if not size:
        return None
    blocks = -(-size // block_words)
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    found = cut(_stretches(documents, _filter(items), min_words, by_piece))
    shares = 1 + (found.agg(F.sum(F.size("words"))).head()[0] or 0) // STRETCH_WORDS
    sent = found.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("share", F.pmod(F.xxhash64("digest", "first"), F.lit(shares)).cast("int"))
    known = items.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).select("block", "share", "item_id", "words")

    arrow = to_arrow_schema(items.sparkSession.createDataFrame([], schema).schema)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        held: dict[int, set[tuple[str, ...]]] = {}
        for i, w in zip(right.column("item_id").to_pylist(), right.column("words").to_pylist()):
            held.setdefault(i, set()).add(tuple(w))
        automaton = ItemAutomaton([(i, list(w)) for i in sorted(held) for w in sorted(held[i])], min_words)
        return pa.Table.from_pylist([x for r in left.to_pylist() for x in use(automaton, r)], schema=arrow)

    return sent.groupBy("block", "share").cogroup(known.groupBy("block", "share")).applyInArrow(search, schema)


def find_leaks(documents: DataFrame, eval_items: DataFrame, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Columns (doc_id, item_id, longest_words): documents that hold min_words consecutive words of an item.

    Case, punctuation, spacing and look-alike characters make no difference. Every document's whole
    text is read once; stretches of it whose windows of three words all stand in some item are
    streamed through the automata of the items, which give the longest passage exactly. NULL and
    empty texts leak nothing, items of fewer than min_words words can't, rows without a doc_id are
    left out; repeated rows count once.
    """
    if min_words < WINDOW:
        raise ValueError(f"min_words is at least {WINDOW}")
    schema = "doc_id bigint, item_id int, longest_words int"

    def use(automaton: ItemAutomaton, r: dict) -> list[dict]:
        return [{"doc_id": r["doc_id"], "item_id": i, "longest_words": n} for i, n in automaton.leaks(r["words"]).items()]

    got = _matched(documents.where("doc_id is not null"), eval_items, min_words, block_words, False, schema, use)
    if got is None:
        return documents.sparkSession.createDataFrame([], schema)
    return got.groupBy("doc_id", "item_id").agg(F.max("longest_words").alias("longest_words"))


def remove_leaks(documents: DataFrame, eval_items: DataFrame, min_words: int = MIN_WORDS, max_share: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Columns (doc_id, text, removed_words, removed_share, dropped): texts without the leaked passages.

    Blank-separated pieces that touch a passage of min_words or more are removed with the blanks
    after them. A document of whose words more than max_share are covered is marked as dropped, its
    text is empty. Texts without a leak are unchanged, NULL stays NULL. Covered ranges are joined to
    the texts by the text's digest, so copies are cleaned alike.
    """
    if min_words < WINDOW:
        raise ValueError(f"min_words is at least {WINDOW}")
    rewriter = Rewriter(fold_case=True)

    def use(automaton: ItemAutomaton, r: dict) -> list[dict]:
        return [{"digest": r["digest"], "a": r["first"] + a, "b": r["first"] + b} for a, b in automaton.spans(r["words"])]

    def clean(text: str, spans: list[dict]) -> tuple[str, int, float]:
        pieces = _pieces(rewriter, text)
        total = sum(len(ws) for _, _, ws in pieces)
        covered = [False] * total
        for x in spans:
            covered[x["a"] : x["b"]] = [True] * (x["b"] - x["a"])
        kept, at, n = [text[: pieces[0][0]]], 0, sum(covered)
        for a, b, ws in pieces:
            if not any(covered[at : at + len(ws)]):
                kept.append(text[a:b])
            at += len(ws)
        return ("" if n / total > max_share else "".join(kept)), n, n / total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [clean(t, spans) if spans else (t, 0, 0.0) for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.float64()), pa.array([g[2] > max_share for g in got], pa.bool_())], names=["doc_id", "text", "removed_words", "removed_share", "dropped"])

    spans = _matched(documents, eval_items, min_words, block_words, True, "digest binary, a int, b int", use)
    none = F.lit(None).cast("array<struct<a:int,b:int>>")
    if spans is None:
        rows = documents.select("doc_id", "text", none.alias("spans"))
    else:  # a text's spans are fewer than its words
        one = cut(spans.distinct().groupBy("digest").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
        rows = documents.select("doc_id", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("d")).join(one, F.col("d") == F.col("digest"), "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(run, "doc_id bigint, text string, removed_words bigint, removed_share double, dropped boolean")
