"""Linear rank-order tokenization: a byte trie with failure links and emissions fixed beforehand.

A merge table defines the tokens of a text by passes: for each rank upward, adjacent (left, right)
become result, left to right without overlap. Two facts give the same tokens in one pass:

* a token sequence is the result for its text exactly if every two neighbours, taken alone, stay
  as they are, and each token alone is the result for its own bytes;
* so the last token of every prefix is unique: the token that ends there and stays beside the
  last token of what is before it.

The automaton walks a whole batch of texts in step, one numpy operation per byte position for all
lanes. A lane is a stretch between byte pairs that no token contains, where a token always ends.

Whether two neighbours stay follows from their outer symbols: the parts at a token's edge, each with
the pass that uses it up. No table of all pairs is kept, so vocabularies of some hundred thousand
ids fit; answers and transitions are remembered in tables of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

#: A merge table is a vocabulary and lives in the driver and every worker; more merges raise an error.
MAX_MERGES = 1 << 19
#: Entries of a memory of answers, 8 bytes each; smaller sets of questions are answered beforehand.
MEMORY = 1 << 21
#: Stretches longer than this advance alone, byte by byte, since no others are left to advance with them.
LONG_LANE = 4096
#: A rank beyond all.
NEVER = np.int32(np.iinfo(np.int32).max)
#: Texts are worked on in chunks of about so many bytes.
CHUNK_BYTES = 1 << 21


def expansions(merges: Iterable[tuple[int, int, int]]) -> dict[int, bytes]:
    """Bytes of every id: 0-255 are bytes, a result is its left and right parts. Raises ValueError on a merge of unknown ids or a result given twice."""
    out = {b: bytes([b]) for b in range(256)}
    for left, right, result in merges:
        if left not in out or right not in out:
            raise ValueError(f"merge ({left}, {right}) refers to an id that no earlier merge made")
        if result in out:
            raise ValueError(f"result {result} is made twice")
        out[result] = out[left] + out[right]
    return out


def rank_passes(symbols: np.ndarray, merges: np.ndarray) -> np.ndarray:
    """Tokens of one text by the definition itself: one pass over the symbols per rank."""
    s = symbols.astype(np.int32)
    for left, right, result in merges:
        if len(s) < 2:
            break
        hit = np.flatnonzero((s[:-1] == left) & (s[1:] == right))
        if not len(hit):
            continue
        if left == right:  # of a run of touching places every second one, from the left
            run = np.concatenate(([0], np.flatnonzero(np.diff(hit) != 1) + 1))
            first = np.repeat(hit[run], np.diff(np.append(run, len(hit))))
            hit = hit[(hit - first) % 2 == 0]
        s[hit] = result
        keep = np.ones(len(s), bool)
        keep[hit + 1] = False
        s = s[keep]
    return s


class Memory:
    """Answers of a function from codes in range(space) to numbers from 0 to 2^24 - 1, batch by batch.

    Few codes are all answered beforehand. Of many, the last answer of each place of a table is
    kept, and others are worked out again.
    """

    def __init__(self, space: int, answer):
        self.answer, self.full = answer, space <= MEMORY
        self.table = answer(np.arange(space, dtype=np.int64)).astype(np.int32) if self.full else np.full(MEMORY, -1, np.int64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        if self.full:
            return self.table[codes]
        place = (codes * 0x9E3779B1 >> 7) % MEMORY
        kept = self.table[place]
        miss = np.flatnonzero(kept >> 24 != codes)
        if len(miss):
            kept[miss] = codes[miss] << 24 | self.answer(codes[miss])
            self.table[place[miss]] = kept[miss]
        return kept & 0xFFFFFF


@dataclass
class MergeAutomaton:
    """Tables for one merge list, given by rank as (left, right, result). Safe to broadcast."""

    merges: np.ndarray
    ids: np.ndarray = field(init=False)
    lengths: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        m = self.merges = np.asarray(self.merges, np.int32).reshape(-1, 3)
        if len(m) > MAX_MERGES:
            raise ValueError(f"{len(m)} merges; at most {MAX_MERGES} are supported")
        spelled = expansions(map(tuple, m.tolist()))
        self.ids = np.array(sorted(spelled), np.int32)
        self.byte_index = np.searchsorted(self.ids, np.arange(256)).astype(np.int32)
        texts = [spelled[int(t)] for t in self.ids]
        self.lengths = np.array([len(x) for x in texts] + [0], np.int32)
        v = len(self.ids)
        left, right, result = (np.searchsorted(self.ids, m[:, c]) for c in range(3))
        self.made, self.part = np.full(v, -1, np.int32), np.full((2, v), -1, np.int32)
        self.made[result], self.part[0][result], self.part[1][result] = np.arange(len(m)), left, right
        codes = left.astype(np.int64) * v + right
        self.pairs, first = np.unique(codes, return_index=True)  # of a pair given twice the first rank holds
        self.pair_rank = first.astype(np.int32)
        own = self.made < 0
        # a token is the result for its own bytes if its parts are, and nothing joins them before its own pass
        whole = self._first_break(left, right) == self.made[result]
        for r, ok, x, y in zip(result.tolist(), whole.tolist(), left.tolist(), right.tolist()):
            own[r] = ok and own[x] and own[y]
        self._trie(texts, own)
        joint = np.zeros((256, 256), bool)
        for x, ok in zip(texts, own):
            if ok:
                b = np.frombuffer(x, np.uint8)
                joint[b[:-1], b[1:]] = True
        self.apart = ~joint
        self._ready()

    def _ready(self) -> None:
        v = len(self.ids)
        self._breaks = Memory(v * v, lambda c: (self._first_break(c // v, c % v) != NEVER).astype(np.int64))
        self._next = Memory(len(self.fail) << 8, self._step)

    def __getstate__(self) -> dict:
        return {k: x for k, x in self.__dict__.items() if k not in ("_breaks", "_next")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pass that merges two symbols, NEVER if none does."""
        if not len(self.pairs):
            return np.full(len(a), NEVER, np.int32)
        code = a.astype(np.int64) * len(self.ids) + b
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        return np.where(self.pairs[at] == code, self.pair_rank[at], NEVER)

    def _first_break(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The first pass that merges across the border of neighbours a and b, NEVER if none does.

        Before pass k the border has the outer symbols that were made before k and are used up at k
        or later. They are walked through from the last passes to the first. In one pass a symbol on
        the left is used up by its own left neighbour before the border is reached.
        """
        n = len(a)
        out = np.full(n, NEVER, np.int32)
        s, t = a.astype(np.int32), b.astype(np.int32)
        until_s, until_t = np.full(n, NEVER, np.int32), np.full(n, NEVER, np.int32)
        live = np.arange(n)
        while len(live):
            k = self._rank(s, t)
            hit = (k < until_s) & (k <= until_t)
            out[live[hit]] = np.minimum(out[live[hit]], k[hit])
            ms, mt = self.made[s], self.made[t]
            more = np.maximum(ms, mt) >= 0
            live, s, t, until_s, until_t, ms, mt = (x[more] for x in (live, s, t, until_s, until_t, ms, mt))
            down = ms >= mt
            until_s, until_t = np.where(down, ms, until_s), np.where(down, until_t, mt)
            s, t = np.where(down, self.part[1][s], s), np.where(down, t, self.part[0][t])
        return out

    def _trie(self, texts: list[bytes], own: np.ndarray) -> None:
        """Trie of own tokens with failure links: `longest` own token that ends at each node, `shorter` the next that ends at the same place."""
        goto: list[dict[int, int]] = [{}]
        token = [-1]
        for i in np.flatnonzero(own).tolist():
            node = 0
            for b in texts[i]:
                nxt = goto[node].get(b)
                if nxt is None:
                    nxt = goto[node][b] = len(goto)
                    goto.append({})
                    token.append(-1)
                node = nxt
            token[node] = i
        fail, longest = [0] * len(goto), [-1] * len(goto)
        self.shorter = np.full(len(self.ids) + 1, -1, np.int32)
        queue = list(goto[0].values())
        for node in queue:  # breadth first: a failure link leads to a shorter suffix
            longest[node] = token[node] if token[node] >= 0 else longest[fail[node]]
            if token[node] >= 0:
                self.shorter[token[node]] = longest[fail[node]]
            for b, c in goto[node].items():
                at = fail[node]
                while at and b not in goto[at]:
                    at = fail[at]
                fail[c] = goto[at].get(b, 0)
                queue.append(c)
        self.fail, self.longest = np.array(fail, np.int32), np.array(longest, np.int32)
        edges = sorted((node << 8 | b, c) for node, kids in enumerate(goto) for b, c in kids.items())
        self.edge, self.edge_to = np.array([e for e, _ in edges], np.int64), np.array([c for _, c in edges], np.int32)

    def _step(self, codes: np.ndarray) -> np.ndarray:
        """The node after (node << 8 | byte), by failure links."""
        out = np.zeros(len(codes), np.int64)
        live, node, byte = np.arange(len(codes)), codes >> 8, codes & 255
        while len(live):
            at = np.minimum(np.searchsorted(self.edge, node << 8 | byte), len(self.edge) - 1)
            found = self.edge[at] == (node << 8 | byte)
            out[live[found]] = self.edge_to[at[found]]
            more = ~found & (node > 0)
            live, node, byte = live[more], self.fail[node[more]].astype(np.int64), byte[more]
        return out

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of texts lying one after another in `data`, and where each text's tokens begin.

        `offsets` has one more entry than there are texts. Empty texts have no tokens.
        """
        if len(offsets) == 2 and len(data) > 2 * CHUNK_BYTES:
            walked = (self._walk(x, np.array([0, len(x)])) for x in self._segments(data))
            ids = np.concatenate([self.ids[last[ends]] for last, ends in walked])
            return ids, np.array([0, len(ids)])
        last, ends = self._walk(data, offsets)
        places = np.flatnonzero(ends)
        return self.ids[last[places]], np.searchsorted(places, offsets)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of every text."""
        if len(offsets) == 2 and len(data) > 2 * CHUNK_BYTES:
            return np.array([sum(int(self._walk(x, np.array([0, len(x)]))[1].sum()) for x in self._segments(data))], np.int64)
        _, ends = self._walk(data, offsets)
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(ends, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    def _segments(self, data: np.ndarray) -> Iterable[np.ndarray]:
        """A very long text in parts of about CHUNK_BYTES, cut where a token ends in any case, so that memory doesn't grow with the text."""
        a, n = 0, len(data)
        while a < n:
            b = a + CHUNK_BYTES
            while b < n:
                step = min(n, b + CHUNK_BYTES)
                hit = np.flatnonzero(self.apart[data[b - 1 : step - 1], data[b:step]])
                if len(hit):
                    b += int(hit[0])
                    break
                b = step
            yield data[a : min(b, n)]
            a = min(b, n)

    def _walk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last token of every prefix of every lane, and where the tokens of the result end."""
        n = len(data)
        last, ends = np.zeros(n, np.int32), np.zeros(n, bool)
        if not n:
            return last, ends
        border = np.zeros(n, bool)
        border[0] = True
        border[1:] = self.apart[data[:-1], data[1:]]
        inner = offsets[(offsets > 0) & (offsets < n)]
        border[inner] = True
        starts = np.flatnonzero(border)
        lens = np.diff(np.append(starts, n))
        for i in np.flatnonzero(lens > LONG_LANE):
            self._alone(data, int(starts[i]), int(lens[i]), last, ends)
        single = lens == 1
        last[starts[single]], ends[starts[single]] = self.byte_index[data[starts[single]]], True
        middle = (lens > 8) & (lens <= LONG_LANE)
        self._advance(data, starts[middle], lens[middle], last, ends)
        for size in range(2, 9):  # short stretches recur: each distinct one is walked once
            at = starts[lens == size]
            if not len(at):
                continue
            spelled = np.zeros(len(at), np.uint64)
            for j in range(size):
                spelled = spelled << np.uint64(8) | data[at + j].astype(np.uint64)
            _, one, which = np.unique(spelled, return_index=True, return_inverse=True)
            own = at[one]
            self._advance(data, own, np.full(len(own), size), last, ends)
            for j in range(size):
                last[at + j], ends[at + j] = last[own + j][which], ends[own + j][which]
        return last, ends

    def _advance(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray, last: np.ndarray, ends: np.ndarray) -> None:
        """Fill `last` and `ends` for the given stretches, all advancing together."""
        if not len(starts):
            return
        order = np.argsort(-lens, kind="stable")
        starts, lens = starts[order], lens[order]
        active = np.searchsorted(-lens, -np.arange(1, lens[0] + 1), side="right")
        v = len(self.ids)
        node = np.zeros(len(starts), np.int64)
        for t in range(int(lens[0])):
            k = int(active[t])
            at = starts[:k] + t
            node = self._next(node[:k] << 8 | data[at])
            token = self.longest[node]
            while len(at):  # the longest token that stays beside the one before it; a byte does at the least
                size = self.lengths[token]
                inner = size <= t
                good = np.ones(len(at), bool)
                good[inner] = self._breaks(last[at[inner] - size[inner]].astype(np.int64) * v + token[inner]) == 0
                last[at[good]] = token[good]
                bad = ~good
                at, token = at[bad], self.shorter[token[bad]]
        at, first = starts + lens - 1, starts
        while len(at):
            ends[at] = True
            at = at - self.lengths[last[at]]
            more = at >= first
            at, first = at[more], first[more]

    def _alone(self, data: np.ndarray, start: int, size: int, last: np.ndarray, ends: np.ndarray) -> None:
        """The same for one long stretch, in linear time.

        Nodes depend on as many bytes as the longest token has, so they are found for many parts at
        once, each begun so much earlier; answers for the longest tokens at every place come first.
        """
        v, lengths, shorter = len(self.ids), self.lengths.tolist(), self.shorter.tolist()
        text, ahead = data[start : start + size], int(self.lengths.max())
        part = max(256, ahead)
        begins = np.arange(0, size, part) - ahead
        node, nodes = np.zeros(len(begins), np.int64), np.zeros(size, np.int64)
        for t in range(part + ahead):
            at = begins + t
            here = np.flatnonzero((at >= 0) & (at < size))
            node[here] = self._next(node[here] << 8 | text[at[here]])
            if t >= ahead:
                nodes[at[here]] = node[here]
        best = self.longest[nodes]
        back = np.arange(size) - self.lengths[best]
        likely = np.unique(best[back[back >= 0]].astype(np.int64) * v + best[back >= 0])
        breaks = dict(zip(likely.tolist(), self._breaks(likely).tolist()))
        done = [0] * size
        for t, token in enumerate(best.tolist()):
            while (n := lengths[token]) <= t:
                code = done[t - n] * v + token
                broken = breaks.get(code)
                if broken is None:
                    broken = breaks[code] = int(self._breaks(np.array([code]))[0])
                if not broken:
                    break
                token = shorter[token]
            done[t] = token
        last[start : start + size] = done
        at = size - 1
        while at >= 0:
            ends[start + at] = True
            at -= lengths[done[at]]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterable[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
