"""Tokens of every document under an existing vocabulary, and totals by slice."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergeloom.functions.merge_columns import load_automaton, token_count

#: What a slice is named by.
SLICE = ("corpus_id", "source", "lang", "domain")


class LongestMatch:
    """Longest-match subword counts in one pass: a trie with failure links and precomputed emissions.

    At a byte that does not follow, the longest token at the pending bytes' start is emitted, and
    the failure link leads to the state of what is left; both are found once, when the trie is
    built. Bytes that begin no token count as one unknown token each.
    """

    def __init__(self, vocabulary: list[bytes]):
        words = sorted({w for w in vocabulary if w})
        self.goto: list[dict[int, int]] = [{}]
        final, text = [False], [b""]
        for w in words:
            node = 0
            for i, b in enumerate(w):
                if b not in self.goto[node]:
                    self.goto[node][b] = len(self.goto)
                    self.goto.append({})
                    final.append(False)
                    text.append(w[: i + 1])
                node = self.goto[node][b]
            final[node] = True
        # fail[v], pops[v]: state and tokens emitted when v's bytes can't go on; None where the first byte begins no token
        self.fail: list[int | None] = [None] * len(text)
        self.pops = [0] * len(text)
        for v in sorted(range(1, len(text)), key=lambda v: len(text[v])):
            if final[v]:
                self.fail[v], self.pops[v] = 0, 1
                continue
            parent, b = self._parent(text[v]), text[v][-1]
            at, popped = self.fail[parent], self.pops[parent]
            while at is not None and b not in self.goto[at]:
                popped += self.pops[at]
                at = self.fail[at]
            if at is not None:
                self.fail[v], self.pops[v] = self.goto[at][b], popped

    def _parent(self, word: bytes) -> int:
        node = 0
        for b in word[:-1]:
            node = self.goto[node][b]
        return node

    def count(self, data: bytes) -> int:
        goto, fail, pops = self.goto, self.fail, self.pops
        node, n, i, start, size = 0, 0, 0, 0, len(data)
        while True:
            nxt = goto[node].get(data[i]) if i < size else None
            if nxt is not None:
                node, i = nxt, i + 1
                continue
            if node == 0:
                if i >= size:
                    return n
                n, i = n + 1, i + 1  # a byte that begins no token
            elif fail[node] is None:  # the pending bytes begin with an unknown byte: step over it
                depth = self._depth(node)
                n, i, node = n + 1, i - depth + 1, 0
            else:
                n += pops[node]
                node = fail[node]

    def _depth(self, node: int) -> int:
        if not hasattr(self, "_depths"):
            self._depths = [0] * len(self.goto)
            for v, kids in enumerate(self.goto):
                for c in kids.values():
                    self._depths[c] = self._depths[v] + 1
        return self._depths[node]


def document_tokens(documents: DataFrame, merges: DataFrame) -> DataFrame:
    """Columns (doc_id, corpus_id, source, lang, domain, tokens), one row per document.

    Tokens are those of the merge table on the unnormalised UTF-8 bytes; NULL and empty texts have
    0. A repeated row of a document counts once; no text is shuffled, only its count.
    """
    count = token_count(documents.sparkSession.sparkContext, load_automaton(merges))
    return documents.select("doc_id", *SLICE, count(F.col("text")).alias("tokens")).distinct()


def longest_match_tokens(documents: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Columns (doc_id, corpus_id, source, lang, domain, tokens) under a longest-match vocabulary, linear in the text."""
    shared = documents.sparkSession.sparkContext.broadcast(LongestMatch(vocabulary))

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        trie = shared.value
        return pa.array(np.array([trie.count(x.encode()) if x else 0 for x in texts.to_pylist()], np.int64))

    return documents.select("doc_id", *SLICE, count(F.col("text")).alias("tokens")).distinct()


def slice_totals(counted: DataFrame) -> DataFrame:
    """Columns (corpus_id, source, lang, domain, documents, tokens); NULL is a value of its own. Sums are partial before the shuffle."""
    return counted.groupBy(*SLICE).agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))


def token_budget(documents: DataFrame, merges: DataFrame, domain_metrics: DataFrame) -> DataFrame:
    """Totals beside the stated ones: (metric_id, corpus_id, source, lang, domain, stated_tokens, documents, tokens, off).

    `off` is whether a non-NULL stated number is more than 10 % away from the total. Slices without
    a metric row have a NULL metric_id, metric rows without documents 0 documents and tokens.
    """
    totals = slice_totals(document_tokens(documents, merges))
    stated = domain_metrics.select("metric_id", *[F.col(c).alias(f"m_{c}") for c in SLICE], F.col("tokens").alias("stated_tokens")).distinct()
    same = None
    for c in SLICE:
        one = totals[c].eqNullSafe(stated[f"m_{c}"])
        same = one if same is None else same & one
    both = totals.join(stated, same, "full_outer")
    tokens = F.coalesce(totals["tokens"], F.lit(0))
    off = F.abs(F.col("stated_tokens") - tokens) * 10 > tokens
    where_from = F.col("documents").isNull()
    return both.select("metric_id", *[F.when(where_from, F.col(f"m_{c}")).otherwise(totals[c]).alias(c) for c in SLICE], "stated_tokens", F.coalesce("documents", F.lit(0)).alias("documents"), tokens.alias("tokens"), F.coalesce(off, F.lit(False)).alias("off"))
