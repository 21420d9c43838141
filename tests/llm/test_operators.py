"""Operators against slow versions on generated inputs."""

from __future__ import annotations

import heapq
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mergeloom.llm import frequency, leakage, lookalike, mixing, overlap, packing, quantiles, rolling, splits, token_budget
from tests.tables import frame

# --- 1 mixing


def by_heap(weights: dict[str, float], caps: dict[str, int], seats: int) -> dict[str, int]:
    got = dict.fromkeys(weights, 0)
    heap = [(-w, c) for c, w in weights.items() if w > 0 and caps[c] > 0]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            break
        _, c = heapq.heappop(heap)
        got[c] += 1
        if got[c] < caps[c]:
            heapq.heappush(heap, (-weights[c] / (2 * got[c] + 1), c))
    return got


def test_sainte_lague_equals_the_heap(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for mix in range(60):
        cats = [f"c{i}" for i in range(rng.randint(1, 9))]
        weights = {c: rng.choice([0.0, 1.0, 1.0, rng.uniform(0.01, 50)]) for c in cats}
        caps = {c: rng.choice([0, 1, rng.randint(0, 60), 10**6]) for c in cats}
        seats = rng.randint(0, 300)
        rows += [(mix, c, weights[c], seats, caps[c]) for c in cats]
        want |= {(mix, c): n for c, n in by_heap(weights, caps, seats).items()}
    df = spark.createDataFrame(rows, "mix_id int, category string, w double, n_blocks bigint, cap_ bigint")
    got = {(r.mix_id, r.category): r.s for r in mixing.sainte_lague(df, "cap_", "s").collect()}
    assert {k: got.get(k, 0) for k in want} == want


def test_blocks_meet_the_quota_and_repeat_evenly(spark):
    sources = frame(spark, "sources", [dict(source_id=i, corpus_id=1, category="a" if i < 30 else "b", contribution=[100 + i, 0, 0]) for i in range(40)])
    targets = frame(spark, "mix_targets", [dict(mix_id=1, corpus_id=1, category="a", weight=1.0, max_repeats=3, total_bytes=9000), dict(mix_id=1, corpus_id=1, category="b", weight=1.0, max_repeats=3, total_bytes=9000)])
    shares = mixing.mix_shares(sources, targets, 100).cache()
    quota = {r.category: r.blocks for r in shares.collect()}
    blocks = mixing.mix_blocks(sources, shares, 7).collect()
    total, most, least = Counter(), defaultdict(int), {}
    for r in blocks:
        total[r.category] += r.copies
        most[r.category] = max(most[r.category], r.copies)
        least[r.category] = min(least.get(r.category, 99), r.copies)
    assert dict(total) == quota and all(most[c] - least[c] <= 1 for c in quota)
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, mixing.mix_blocks(sources, shares, 7).collect()))
    assert sum(r.reached_share for r in shares.collect()) == pytest.approx(1)


def test_short_by_seats_is_short_in_bytes(spark):
    rng = random.Random(9)
    sources, targets, want = [], [], set()
    for mix in range(40):
        cats = [f"c{i}" for i in range(rng.randint(1, 7))]
        total, weights = rng.choice([7, 999, 10_001, 1_000_000, 123_456_789]), {c: rng.choice([0.0, rng.uniform(0.01, 5)]) for c in cats}
        for c in cats:
            repeats, share = rng.randint(0, 3), weights[c] / (sum(weights.values()) or 1)
            have = max(0, int(share * total / max(repeats, 1)) + rng.choice([-1, 0, 1, rng.randint(-total, total)]))
            sources.append(dict(source_id=len(sources), corpus_id=mix, category=c, contribution=[have, 0, 0]))
            targets.append(dict(mix_id=mix, corpus_id=mix, category=c, weight=weights[c], max_repeats=repeats, total_bytes=total))
            if sum(weights.values()) and have * repeats < share * total:
                want.add((mix, c))
    got = mixing.mix_shares(frame(spark, "sources", sources), frame(spark, "mix_targets", targets)).where("short").collect()
    assert {(r.mix_id, r.category) for r in got} == want


# --- 2 splits


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    for n, m in ((1, 0), (40, 30), (200, 150)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        up = list(range(n))

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        got = {r.id: r.root for r in splits.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
        assert got == {x: find(x) for e in edges for x in e}
    chain = [(i, i + 1) for i in range(64)]
    assert {r.root for r in splits.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()} == {0}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), min_size=1, max_size=6), st.floats(0, 1))
def test_subset_sums_are_nearest(sizes, share):
    total = sum(s * m for s, m in sizes.items())
    goal = round(total * share)
    reach = {0}
    for s, m in sizes.items():
        reach = {r + s * k for r in reach for k in range(m + 1)}
    taken = splits._nearest(sorted(sizes.items()), goal)
    assert all(0 < k <= sizes[s] for s, k in taken.items())
    assert abs(sum(s * k for s, k in taken.items()) - goal) == min(abs(r - goal) for r in reach)


def test_coarse_sums_use_small_groups(monkeypatch):
    monkeypatch.setattr(splits, "SUM_BITS", 64)
    sizes = [(1, 500), (3, 40), (200, 5), (1000, 3)]
    taken = splits._nearest(sizes, 900)
    assert abs(sum(s * k for s, k in taken.items()) - 900) <= 3


def test_groups_never_part(spark):
    rng = random.Random(3)
    sources = frame(spark, "sources", [dict(source_id=i, corpus_id=i % 2, name=f"f{i % 50}.txt", author=f"A{rng.randrange(40)} B", entity_id=rng.choice([None, rng.randrange(60)])) for i in range(80)])
    units = frame(spark, "units", [dict(unit_id=i, corpus_id=i % 2, source=rng.choice(["./F%d.TXT", "f%d.txt ", "x%d"]) % rng.randrange(60)) for i in range(400)])
    targets = frame(spark, "split_targets", [dict(split="train", target_share=0.8), dict(split="validation", target_share=0.1), dict(split="test", target_share=0.1)])
    got = splits.assign_splits(sources, units, targets, 1).collect()
    assert len(got) == 400
    by_group = defaultdict(set)
    for r in got:
        if r.group_id is not None:
            by_group[r.corpus_id, r.group_id].add(r.split)
    assert all(len(s) == 1 for s in by_group.values())
    assert splits.author_words("LEE,  Ann") == splits.author_words("Ａｎｎ lee") == "ann lee"
    assert splits.author_words("N/A") is splits.author_words(" ") is splits.author_words(None) is None


# --- 3 frequencies and 4 percentiles


def test_frequencies(spark):
    df = spark.createDataFrame([(i, [i % 3, 7, 7]) for i in range(1000)] + [(5, [2, 7, 7])], "k int, t array<int>")
    got = {r.val: (r.occurrences, r.records, r.mark) for r in frequency.term_frequencies(df, ["k"], "t", "t").collect()}
    assert got == {0: (334, 334, "common"), 1: (333, 333, "common"), 2: (333, 333, "common"), 7: (2000, 1000, "common")}


@pytest.mark.parametrize("alpha", [0.01, 0.05])
def test_percentiles_within_their_error_and_mergeable(spark, alpha):
    rng = np.random.default_rng(4)
    values = np.concatenate((rng.lognormal(3, 2, 3000), -rng.lognormal(1, 3, 1000), np.zeros(200), rng.integers(1, 9, 500)))
    df = spark.createDataFrame([(int(i % 5), float(v)) for i, v in enumerate(values)] + [(1, None), (1, float("nan"))], "day int, v double")
    days = quantiles.sketch(df, ["day"], "v", alpha)
    whole = quantiles.merge(days.withColumn("one", F.lit(1)), ["one"])
    r = quantiles.percentiles(whole, ["one"], {"p5": 5, "p50": 50, "p95": 95, "p100": 100}, alpha).head()
    ordered = np.sort(values)
    assert r.n == len(values)
    for q in (5, 50, 95, 100):
        exact = ordered[-(-q * len(values) // 100) - 1]
        assert abs(r[f"p{q}"] - exact) <= alpha * abs(exact) + 1e-9 and r[f"p{q}_low"] <= exact <= r[f"p{q}_high"]
        place = spark.createDataFrame([(1, r[f"p{q}_bucket"], -(-q * len(values) // 100) - r[f"p{q}_below"])], "one int, bucket bigint, place bigint")
        assert quantiles.exact_in_buckets(df.withColumn("one", F.lit(1)), place, ["one"], "v", alpha).head().exact == exact


# --- 5 tokens


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=5).map(str.encode), max_size=8), st.text("abcd", max_size=30).map(str.encode))
def test_longest_match(words, text):
    n, i = 0, 0
    while i < len(text):
        best = max((len(w) for w in words if text.startswith(w, i)), default=1)
        n, i = n + 1, i + best
    assert token_budget.LongestMatch(words).count(text) == n


def test_large_split_totals_are_exact(monkeypatch):
    total = lambda taken: sum(s * k for s, k in taken.items())
    assert total(splits._nearest([(4, 150_000)], 30_000)) == 30_000  # 600,000 units
    assert total(splits._nearest([(3, 170_000)], 51_000)) == 51_000
    assert total(splits._nearest([(5, 2), (7, 60_000)], 42_003)) == 42_003 and total(splits._nearest([(1000, 600)], 60_499)) == 60_000
    rng = random.Random(5)
    for _ in range(200):
        sizes = [(s, rng.randint(1, 6)) for s in sorted(rng.sample(range(1, 60), rng.randint(1, 9)))]
        goal = rng.randint(0, total(dict(sizes)))
        whole = splits._nearest(sizes, goal)
        with monkeypatch.context() as m:
            m.setattr(splits, "SUM_BITS", 1)
            assert splits._nearest(sizes, goal) == whole


# --- 4 percentiles


def test_rows_of_hot_groups_are_dealt_out_and_stay_distinct(spark):
    rows = [(i % 500, "hot", 1) for i in range(1200)] + [(i, f"g{i % 300}", None) for i in range(600)] + [(None, None, 2)] * 2
    df = spark.createDataFrame(rows, "i int, g string, v int").repartition(3)
    got = quantiles.distinct_by_group(df, ["g"], "i")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, set(rows)))
    placed = got.select("g", F.spark_partition_id().alias("p")).where("g <> 'hot'").collect()
    assert len({(r.g, r.p) for r in placed}) == len({r.g for r in placed}) == 300


# --- 6 overlap


def test_windows_in_many_ranges_and_batches_find_the_same(spark, monkeypatch):
    rng = random.Random(11)
    common = [" ".join(rng.choice("abcdefg") + rng.choice("xyz") for _ in range(25)) for _ in range(4)]
    rows = []
    for i in range(120):
        ws = rng.choice(common).split()
        ws[rng.randrange(25)] = f"own{i}"
        rows.append(dict(unit_id=i, corpus_id=1, proposed=["train", "test"][i % 2], body=" ".join(ws)))
    units = frame(spark, "units", rows)
    want = sorted(map(tuple, overlap.overlap_pairs(units).collect()))
    assert len(want) > 200
    monkeypatch.setattr(overlap, "AGGREGATED", 3)
    monkeypatch.setattr(overlap, "BATCH", 16)
    monkeypatch.setattr(overlap, "RANGE_WINDOWS", 50)
    assert sorted(map(tuple, overlap.overlap_pairs(units).collect())) == want


def test_overlap_finds_every_pair(spark):
    rng = random.Random(6)
    base = [[rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(rng.randint(0, 40))] for _ in range(15)]
    rows = []
    for i in range(150):
        ws = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            if ws:
                ws[rng.randrange(len(ws))] = rng.choice("abc") + rng.choice("xyz")
        text = rng.choice([" ", ", "]).join(w.upper() if rng.random() < 0.1 else w for w in ws)
        rows.append(dict(unit_id=i, corpus_id=i % 2, source="s", proposed=rng.choice(["train", "train", "val", "TEST ", None, "other"]), body=rng.choice([text, text, text, None, "short"])))
    side = lambda r: {"train": "t", "val": "h", "test": "h"}.get((r["proposed"] or "").strip().lower())

    def grams(b):
        w = re.findall(r"[^\W_]+", b.lower())
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    want = set()
    for a in rows:
        for b in rows:
            if a["unit_id"] < b["unit_id"] and a["corpus_id"] == b["corpus_id"] and {side(a), side(b)} == {"t", "h"} and a["body"] is not None and b["body"] is not None:
                x, y = grams(a["body"]), grams(b["body"])
                if a["body"] == b["body"] or (x | y and len(x & y) * 10 >= 6 * len(x | y)):
                    want.add((a["unit_id"], b["unit_id"]))
    units = frame(spark, "units", rows)
    got = [tuple(r) for r in overlap.overlap_pairs(units).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 20
    links = [{(r.ct, r.ch) for r in overlap.overlap_links(units, chunk=c)[0].collect()} for c in (1, 8, 1 << 40)]
    assert links[0] == links[1] == links[2]  # what chunks leave open is completed
    parts = {r.unit_id: r for r in overlap.overlap_fractions(units).collect()}
    held = {r["unit_id"] for r in rows if side(r) == "h" and r["body"] is not None}
    assert set(parts) == held and all(0 <= r.shared_words <= r.n_words for r in parts.values())
    equal = {b for a, b in want | {(b, a) for a, b in want} if b in held and rows[a]["body"] == rows[b]["body"] and rows[b]["body"]}
    assert all(parts[b].overlap == 1 for b in equal)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB1_ ,éİß漢²\n", max_size=30)), max_size=8))
def test_words_are_split_and_hashed_alike(texts):
    hashes, counts = rolling.word_hashes(pa.array(texts, pa.string()))
    want = [rolling.caseless(t) if t else [] for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert len(hashes) == len(flat) and len({*zip(flat, hashes.tolist())}) == len(set(flat)) == len(set(hashes.tolist()))
    rolled = rolling.Rolled(hashes, counts)
    rec, h, n, once = rolled.distinct()
    grams = [[tuple(w[i : i + 3]) for i in range(len(w) - 2)] for w in want]
    assert n.tolist() == [len(set(g)) for g in grams] and once.tolist() == [g.count(x) == 1 for g in grams for x in g]
    crec, digest, at, size = rolled.chunks(2)
    assert size.sum() == len(rolled.h) and len(digest) == len(crec) == len(at)


# --- 7 packing


def test_sum_of_squares_rule():
    rng = random.Random(7)
    for cap in (5, 16, 50):
        packer, bins = packing.SumOfSquares(cap), []
        for _ in range(300):
            size = rng.randint(0, cap)
            counts = Counter(g for g in bins if 0 < g < cap)

            def squares(gap):
                c = Counter(counts)
                if gap is not None:
                    c[gap] -= 1
                left = (cap if gap is None else gap) - size
                if 0 < left < cap:
                    c[left] += 1
                return sum(n * n for n in c.values())

            name = packer.place(size)
            if name < len(bins):
                gap = bins[name]
                assert gap >= size
                if size:
                    options = [squares(g) for g in set(counts) if g >= size] + [squares(None)]
                    assert squares(gap) == min(options)
                bins[name] -= size
            else:
                assert name == len(bins)
                if size and size < cap:
                    assert squares(None) == min([squares(g) for g in set(counts) if g >= size] + [squares(None)])
                bins.append(cap - size)


def test_packing_costs_no_more_with_a_large_capacity():
    import time

    rng = np.random.default_rng(2)
    docs, tokens = np.arange(4000), (rng.pareto(1.2, 4000) * 200).astype(np.int64)
    took = []
    for capacity in (1024, 1 << 20):
        began = time.perf_counter()
        got = packing.pack_run(docs, tokens, capacity, 0)
        took.append(time.perf_counter() - began)
        fill = np.bincount(got["container_id"], got["n_tokens"])
        assert fill.max() <= capacity and fill.sum() == tokens.sum()
    assert took[1] < 5 * took[0] + 1


def test_packing_places_all_and_wastes_little(spark):
    rng = random.Random(8)
    docs = frame(spark, "documents", [dict(doc_id=i, text="x" * int(rng.paretovariate(1.2) * 20)) for i in range(3000)] + [dict(doc_id=9000, text="y" * 5000)])
    sizes = frame(spark, "context_sizes", [dict(context_name="c", capacity_tokens=256)])
    got = packing.pack_documents(docs, frame(spark, "merges", []), sizes, run_items=1000).collect()
    fill, tokens = Counter(), Counter()
    for r in got:
        fill[r.container_id] += r.n_tokens
        tokens[r.doc_id] += r.n_tokens
    assert max(fill.values()) <= 256 and dict(tokens) == {r.doc_id: len(r.text) for r in docs.collect()}
    assert all(r.n_tokens == 256 for r in got if r.piece_no + 1 < math.ceil(tokens[r.doc_id] / 256))
    assert 1 - sum(fill.values()) / (256 * len(fill)) < 0.02


# --- 8 leakage


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), max_size=5), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(1, 4))
def test_automaton_finds_every_passage(items, words, least):
    def longest(item):
        return max((k for k in range(least, len(item) + 1) for i in range(len(item) - k + 1) for j in range(len(words) - k + 1) if item[i : i + k] == words[j : j + k]), default=0)

    want = {i: n for i, item in enumerate(items) if (n := longest(item))}
    automaton = leakage.ItemAutomaton(list(enumerate(items)), least)
    assert automaton.leaks(words) == want
    covered = {k for a, b in automaton.spans(words) for k in range(a, b)}
    grams = {tuple(item[i : i + least]) for item in items for i in range(len(item) - least + 1)}
    assert covered == {j + k for j in range(len(words) - least + 1) if tuple(words[j : j + least]) in grams for k in range(least)}


def test_many_item_blocks_find_the_same_as_one(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 40)))) for i in range(40)]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(3)]
        chosen = [w.split() for _, w in rng.sample(items, 2)]
        docs.append((i, " ".join([parts[0], " ".join(chosen[0][rng.randint(0, 5) :]), parts[1], " ".join(chosen[1]), parts[2]])))
    df, eval_items = frame(spark, "documents", [dict(doc_id=i, text=x) for i, x in docs]), frame(spark, "eval_items", [dict(item_id=i, text=x) for i, x in items])
    whole = leakage.ItemAutomaton([(i, x.split()) for i, x in items], 12)
    want = {(i, item, n) for i, x in docs for item, n in whole.leaks(x.split()).items()}
    for size in (10, 100, leakage.BLOCK_WORDS):
        got = [tuple(r) for r in leakage.find_leaks(df, eval_items, block_words=size).collect()]
        assert set(got) == want and len(got) == len(want) > 50


def test_leaks_are_removed(spark):
    passage = " ".join(f"word{i}" for i in range(14))
    docs = frame(spark, "documents", [dict(doc_id=1, text=f"Before it, {passage.upper()}. After  it " + "filler " * 40), dict(doc_id=2, text=passage), dict(doc_id=3, text="clean"), dict(doc_id=4)])
    items = frame(spark, "eval_items", [dict(item_id=1, text=passage), dict(item_id=2, text=passage[:60])])
    got = {r.doc_id: r for r in leakage.remove_leaks(docs, items).collect()}
    assert got[1].text == "Before it, After  it " + "filler " * 40 and got[1].removed_words == 14 and not got[1].dropped
    assert got[2].dropped and got[2].text == "" and got[3].text == "clean" and got[4].text is None
    one = sorted(map(tuple, leakage.find_leaks(docs, items).collect()))
    assert sorted(map(tuple, leakage.find_leaks(docs, items, block_words=1).collect())) == one == [(1, 1, 14), (2, 1, 14)]
    again = {r.doc_id: r for r in leakage.remove_leaks(docs, items, block_words=1).collect()}
    assert again == got


# --- 9 look-alikes

SAME = ["fine the x-ray é", "ﬁne ｔｈｅ x‑ray é", "fіnе thе х-rау é", "f​ine t­he x⁠-ray е́"]


def test_same_look_is_one_form():
    r = lookalike.Rewriter()
    assert {r(t) for t in SAME} == {SAME[0]}
    for a, b in (("x2", "x²"), ("e", "é"), ("A", "a"), ("l", "I"), ("l", "1"), ("O", "0"), ("a,b", "ab"), ("rn", "m"), ("ß", "β"), ("s", "ſ"), ("c", "ς"), ("a b", "ab"), ("…", "…."), ("👩‍💻", "👩💻"), ("α", "a"), ("'", "’")):
        assert r(a) != r(b), (a, b)
    assert all(r(r(t)) == r(t) for t in [*SAME, "Ⅳ ŉ Å", "ำ"])


ALIKE = [("ν", "v"), ("υ", "u"), ("Ꭺ", "A"), ("Ꮯ", "C"), ("ս", "u"), ("ո", "n"), ("հ", "h"), ("ꓮ", "A"), ("Ⲏ", "H"), ("ǃ", "!"), ("ǀ", "|"), ("ǁ", "||"), ("ѹ", "oy"), ("ﬃ", "ffi"), ("Ǆ", "DŽ"), ("‼", "!!"), ("…", "..."), ("ײ", "יי"), ("։", ":"), ("\u3164", " "), ("\u2800", " "), ("e\ufe00", "e"), ("d\u034f", "d")]
APART = [("rn", "m"), ("ı", "i"), ("“", '"'), ("–", "-"), ("❤\ufe0f", "❤"), ("葛\ufe00", "葛"), ("ⅳ", "4"), ("½", "1/2"), ("ª", "a"), ("①", "1"), ("㎏", "k g"), ("ø", "o"), ("ł", "l"), ("б", "6")]


def test_look_alikes_of_many_scripts_and_of_strings():
    r = lookalike.Rewriter()
    assert [p for p in ALIKE if r(p[0]) != r(p[1])] == [] and [p for p in APART if r(p[0]) == r(p[1])] == []
    fold = lookalike.Rewriter(fold_case=True)
    assert fold("ΝΕW") == fold("new") == fold("ＮＥＷ") and fold("v") != fold("n") and fold("u") != fold("y")


def test_rewriting_is_leftmost_and_longest():
    r = lookalike.Rewriter()
    members = sorted(r.to, key=lambda m: (-len(m), m))

    def slowly(t):
        out, i = "", 0
        while i < len(t):
            m = next((m for m in members if t.startswith(m, i)), None)
            out, i = out + (t[i] if m is None else r.to[m]), i + len(m or "x")
        return lookalike.unicodedata.normalize("NFC", out)

    rng = random.Random(4)
    some = [m for m in members if len(m) > 1] + members[-200:] + list("ab!|.fi")
    for _ in range(300):
        t = lookalike.unicodedata.normalize("NFD", "".join(rng.choice(some) for _ in range(rng.randint(0, 12))))
        t = "".join(c for c in t if c not in lookalike.JOINERS + lookalike.SELECTORS)
        assert r(t) == slowly(t) or t.isascii()
    for _ in range(300):
        t = "".join(rng.choice([*"aé \u0301\u200d\u200c\ufe0f👩💻नक् ", "ﬁ", "ｘ ", "\u3000", " \u0308"]) for _ in range(rng.randint(0, 14)))
        assert r(t) == r._rewritten(t) or t.isascii()


def test_members_count_spellings_without_pairs(spark):
    docs = frame(spark, "documents", [dict(doc_id=i, text=t) for i, t in enumerate(["same", "sаme", "same", "other", None, ""])])
    rows = {r.doc_id: (r.spellings, r.documents) for r in lookalike.look_members(docs).collect()}
    assert rows == {0: (2, 3), 1: (2, 3), 2: (2, 3), 3: (1, 1), 5: (1, 1)}


def test_representative_is_the_most_frequent(spark):
    docs = frame(spark, "documents", [dict(doc_id=1, text="ааа a"), dict(doc_id=2, text="aaa a")])
    few = lookalike.rewriter_of(docs, "text")
    assert few("а") == "a"
    many = lookalike.rewriter_of(frame(spark, "documents", [dict(doc_id=1, text="ааа a")]), "text")
    assert many("a") == "а" and many("ab") == many("аb")
    odd = lookalike.Rewriter({"і": 9, "о": 9, "ﬁ": 99, "ѹ": 99})
    assert odd("ﬁ") == odd("fi") == odd("fі") == "fі" and odd("ѹ") == odd("оу") == odd("oy")


def test_classes_are_transitive():
    uf = lookalike.Classes()
    for a, b in (("a", "b"), ("c", "d"), ("b", "c"), ("x", "x")):
        uf.join(a, b)
    assert sorted(map(sorted, uf.classes())) == [["a", "b", "c", "d"], ["x"]]
    assert all(len({m for m in c if len(m) == 1 and m.isascii()}) <= 1 for c in lookalike.look_classes())
