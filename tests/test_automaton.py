"""The one-pass tokenizer against the rank passes, on arbitrary and learned merge tables."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mergeloom.functions.automaton import LONG_LANE, MergeAutomaton, chunks, expansions, rank_passes
from mergeloom.functions.packed import Expander, PackedAutomaton
from mergeloom.functions.routing import span_borders


def by_definition(data: bytes, merges) -> list[int]:
    s = list(data)
    for left, right, result in merges:
        out, i = [], 0
        while i < len(s):
            hit = i + 1 < len(s) and s[i] == left and s[i + 1] == right
            out.append(result if hit else s[i])
            i += 2 if hit else 1
        s = out
    return s


@st.composite
def tables(draw):
    ids, merges = list(b"abc"), []
    for _ in range(draw(st.integers(0, 10))):
        pair = draw(st.sampled_from(ids)), draw(st.sampled_from(ids))
        if pair not in [m[:2] for m in merges]:
            merges.append((*pair, 256 + len(merges)))
            ids.append(merges[-1][2])
    return merges


def joined(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)


@settings(max_examples=150, deadline=None)
@given(tables(), st.lists(st.text("abcx", max_size=40).map(str.encode), max_size=8))
def test_equals_definition(merges, texts):
    automaton = MergeAutomaton(np.array(merges).reshape(-1, 3))
    data, offsets = joined(texts)
    ids, begin = automaton.tokens(data, offsets)
    want = [by_definition(x, merges) for x in texts]
    assert [ids[begin[i] : begin[i + 1]].tolist() for i in range(len(texts))] == want
    assert automaton.counts(data, offsets).tolist() == [len(w) for w in want]
    assert all(rank_passes(np.frombuffer(x, np.uint8), np.array(merges).reshape(-1, 3)).tolist() == w for x, w in zip(texts, want))


def test_exhaustive_small_texts():
    models = ([(97, 97, 256), (256, 97, 257)], [(97, 98, 256), (256, 256, 257)], [(97, 98, 256), (98, 99, 257), (97, 257, 258), (256, 99, 259)])
    texts = [b""]
    for _ in range(6):
        texts += [t + c for t in texts if len(t) == len(texts[-1]) for c in (b"a", b"b", b"c")]
    data, offsets = joined(texts)
    for m in models:
        ids, begin = MergeAutomaton(np.array(m)).tokens(data, offsets)
        for i, t in enumerate(texts):
            assert ids[begin[i] : begin[i + 1]].tolist() == by_definition(t, m)


def test_long_stretch_advances_alone():
    m = [(97, 97, 256), (256, 256, 257), (257, 97, 258)]
    text = b"a" * (LONG_LANE + 3)
    ids, _ = MergeAutomaton(np.array(m)).tokens(*joined([text]))
    assert ids.tolist() == by_definition(text, m)


@settings(max_examples=60, deadline=None)
@given(tables(), st.text("abcx", max_size=60).map(str.encode))
def test_bounded_memory_and_lone_stretches_change_nothing(merges, text):
    import mergeloom.functions.automaton as A

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(A, "MEMORY", 64)
        patch.setattr(A, "LONG_LANE", 3)
        automaton = MergeAutomaton(np.array(merges).reshape(-1, 3))
        assert not automaton._breaks.full
        ids, _ = automaton.tokens(*joined([text]))
    assert ids.tolist() == by_definition(text, merges)


def test_a_vocabulary_of_fifty_thousand_ids_equals_the_rank_passes():
    rng = np.random.default_rng(5)
    merges, seen, size = [], set(), [1] * 256
    while len(merges) < 50_000:
        top = 256 + len(merges)
        a, b = (int(rng.integers(97, 123)) if rng.random() < 0.4 else int(rng.integers(256, top)) if top > 256 else 97 for _ in range(2))
        if (a, b) in seen or size[a] + size[b] > 24:
            continue
        seen.add((a, b))
        size.append(size[a] + size[b])
        merges.append((a, b, top))
    m = np.array(merges)
    automaton = MergeAutomaton(m)
    spelled = expansions(merges)
    texts = [bytes(rng.integers(97, 123, 60, dtype=np.uint8)) for _ in range(8)] + [b"".join(spelled[int(i)] for i in rng.integers(256, 50_256, 12)) for _ in range(12)]
    ids, begin = automaton.tokens(*joined(texts))
    for i, x in enumerate(texts):
        assert ids[begin[i] : begin[i + 1]].tolist() == rank_passes(np.frombuffer(x, np.uint8), m).tolist()


def test_very_long_texts_are_cut_where_tokens_end(monkeypatch):
    import mergeloom.functions.automaton as A

    m = [(97, 98, 256), (256, 256, 257), (98, 97, 258)]
    for text in (b"abbaababcab" * 40, b"ab" * 200, b"c" * 300):
        automaton = MergeAutomaton(np.array(m))
        want = by_definition(text, m)
        monkeypatch.setattr(A, "CHUNK_BYTES", 16)
        ids, begin = automaton.tokens(*joined([text]))
        assert ids.tolist() == want and begin.tolist() == [0, len(want)] and automaton.counts(*joined([text])).tolist() == [len(want)]
        monkeypatch.undo()


def test_bad_tables():
    with pytest.raises(ValueError):
        expansions([(300, 1, 256)])
    with pytest.raises(ValueError):
        expansions([(1, 2, 256), (3, 4, 256)])


def test_chunks_cover_all_rows():
    offsets = np.array([0, 5, 5, 900, 901, 2000])
    assert list(chunks(offsets, 10)) == [(0, 2), (2, 3), (3, 4), (4, 5)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=6))
def test_packs_merge_inside_spans_and_round_trip(texts):
    merges = {0: [(97, 98, 256), (0xC3, 0xA4, 257)], 1: [(49, 50, 256)], 2: [(32, 32, 256)]}
    raw = [t.encode() for t in texts]
    data, offsets = joined(raw)
    pack, local, begin = PackedAutomaton(merges).tokens(data, offsets)
    table = Expander.packed(merges)
    back, at = table.expand(table.codes(pack, local), begin)
    assert back.tobytes() == b"".join(raw) and at.tolist() == offsets.tolist()
    for i, t in enumerate(raw):
        d = np.frombuffer(t, np.uint8)
        packs, border = span_borders(d, np.array([0, len(t)]))
        want = []
        for s, e in zip(np.flatnonzero(border), [*np.flatnonzero(border)[1:], len(t)]):
            p = int(packs[s])
            want += [(65535, x) if x < 256 else (p, x - 256) for x in by_definition(t[s:e], merges[p])]
        assert list(zip(pack[begin[i] : begin[i + 1]].tolist(), local[begin[i] : begin[i + 1]].tolist())) == want
