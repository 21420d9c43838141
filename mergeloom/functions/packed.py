"""Encoding and decoding with pack-local merge tables, a batch of texts at a time."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np

from mergeloom.artifact import BYTE_FALLBACK
from mergeloom.errors import DecodeError, EncodeError
from mergeloom.functions.automaton import MergeAutomaton, expansions
from mergeloom.functions.routing import span_borders


class PackedAutomaton:
    """One automaton per pack; merges never cross a span.

    `router` gives the pack of every byte and the bytes that begin a span; it must name known packs,
    never the byte fallback, and begin a span wherever the pack changes or a text begins.
    """

    def __init__(self, merges: Mapping[int, list[tuple[int, int, int]]], router: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] = span_borders):
        if BYTE_FALLBACK in merges:
            raise EncodeError("byte fallback as a pack", pack=BYTE_FALLBACK)
        self.router = router
        self.packs = {int(p): MergeAutomaton(np.array(m, np.int32)) for p, m in merges.items() if len(m)}

    def coded(self, data: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pack, local, last byte) of every token, and the router's (packs, borders) of every byte."""
        packs, border = self.router(data, offsets)
        if self.router is not span_borders:
            _check_routing(packs, border, offsets)
        ids, ends, home = data.astype(np.int32), np.ones(len(data), bool), packs
        usable = np.ones(len(data), bool)
        if valid is not None and not valid.all():
            usable = np.repeat(valid, np.diff(offsets))
        for p, automaton in self.packs.items():
            at = np.flatnonzero((packs == p) & usable)
            if not len(at):
                continue
            starts = np.flatnonzero(border[at])
            last, done = automaton._walk(data[at], np.append(starts, len(at)))
            ids[at] = automaton.ids[last]
            ends[at] = done
        places = np.flatnonzero(ends)
        token = ids[places]
        learned = token >= 256
        return np.where(learned, home[places], BYTE_FALLBACK), np.where(learned, token - 256, token), places, packs, border

    def tokens(self, data: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pack, local, begin): a byte left alone is (fallback, byte), a learned token (pack, id - 256).

        Texts whose `valid` is False are bytes throughout.
        """
        pack, local, places, _, _ = self.coded(data, offsets, valid)
        return pack, local, np.searchsorted(places, offsets)

    def sums(self, data: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> dict[int, np.ndarray]:
        """Pack -> (routed bytes, spans, tokens, token bytes) over all texts."""
        pack, _, places, packs, border = self.coded(data, offsets, valid)
        size = np.diff(np.concatenate(([-1], places)))
        out: dict[int, np.ndarray] = {}
        for column, (keys, weights) in enumerate(((packs, None), (packs[border], None), (pack, None), (pack, size))):
            kinds, which = np.unique(keys, return_inverse=True)
            for k, n in zip(kinds.tolist(), np.bincount(which, weights, len(kinds)).tolist()):
                out.setdefault(k, np.zeros(4, np.int64))[column] = int(n)
        return out


def _check_routing(packs: np.ndarray, border: np.ndarray, offsets: np.ndarray) -> None:
    begins = offsets[:-1][offsets[:-1] < len(packs)]
    if len(packs) and (not border[begins].all() or not border[1:][packs[1:] != packs[:-1]].all()):
        raise EncodeError("router leaves a span open")
    if (packs == BYTE_FALLBACK).any() or (packs < 0).any():
        raise EncodeError("router names no pack", byte=int(np.flatnonzero((packs == BYTE_FALLBACK) | (packs < 0))[0]))


class Expander:
    """Bytes of token ids: `code` numbers every (pack, local) or flat id."""

    def __init__(self, spelled: Mapping[tuple[int, int], bytes]):
        self.code = {k: i for i, k in enumerate(sorted(spelled))}
        parts = [spelled[k] for k in sorted(spelled)]
        self.size = np.array([len(x) for x in parts], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)[:-1])) if parts else np.zeros(0, np.int64)
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        packs = sorted({p for p, _ in spelled})
        self.first = {p: min(i for (q, _), i in self.code.items() if q == p) for p in packs}
        self.many = {p: sum(1 for q, _ in spelled if q == p) for p in packs}

    @staticmethod
    def flat(merges: list[tuple[int, int, int]]) -> Expander:
        return Expander({(0, i): x for i, x in expansions(merges).items()})

    @staticmethod
    def packed(merges: Mapping[int, list[tuple[int, int, int]]]) -> Expander:
        out = {(BYTE_FALLBACK, b): bytes([b]) for b in range(256)}
        for p, m in merges.items():
            out |= {(int(p), i - 256): x for i, x in expansions(m).items() if i >= 256}
        return Expander(out)

    def codes(self, pack: np.ndarray, local: np.ndarray) -> np.ndarray:
        """Positions in the table; DecodeError names the first id that is unknown."""
        out = np.full(len(pack), -1, np.int64)
        for p, first in self.first.items():
            here = (pack == p) & (local >= 0) & (local < self.many[p])
            out[here] = first + local[here]
        bad = np.flatnonzero(out < 0)
        if len(bad):
            i = int(bad[0])
            kind = "unknown pack" if int(pack[i]) not in self.first else "byte out of range" if int(pack[i]) == BYTE_FALLBACK else "local id outside pack"
            raise DecodeError(kind, index=i, pack=int(pack[i]), local=int(local[i]))
        return out

    def expand(self, codes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the tokens one after another, and the byte offset where each text begins."""
        size = self.size[codes]
        upto = np.concatenate(([0], np.cumsum(size)))
        inner = np.arange(upto[-1]) - np.repeat(upto[:-1], size)
        return self.data[np.repeat(self.start[codes], size) + inner], upto[begin]
