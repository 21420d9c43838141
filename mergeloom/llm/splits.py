"""Splits that keep related records together: components by hooking, totals by subset sums."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mergeloom.operators.ranking import distributed_rank, first_arrival
from mergeloom.session import cut

#: Author names that say nothing, as sorted words.
FILLERS = frozenset({"", "unknown", "anonymous", "a n"})
#: Bits of a subset-sum set up to which all of them are kept; of larger ones only some are, and the rest are made again. Results are the same.
SUM_BITS = 1 << 18


def name_key(column: str | Column) -> Column:
    """File names are the same apart from case, outer blanks, the kind of slash and a leading ./"""
    c = F.col(column) if isinstance(column, str) else column
    trimmed = F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")
    return F.regexp_replace(F.translate(F.lower(trimmed), "\\", "/"), r"^(\./)+", "")


def split_key(column: str) -> Column:
    """Split names apart from case and outer blanks; val is validation; empty is NULL."""
    c = F.lower(F.regexp_replace(F.col(column), r"^[\s ]+|[\s ]+$", ""))
    return F.when(c == "val", "validation").when(c != "", c)


def author_words(name: str | None) -> str | None:
    """The words of a name in sorted order, without case, punctuation or character form; NULL for fillers."""
    if name is None:
        return None
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", name).casefold())
    words = "".join(c if c.isalnum() else " " for c in text).split()
    key = " ".join(sorted(words))
    return None if key in FILLERS else key


@F.arrow_udf(StringType())
def author_key(names: pa.Array) -> pa.Array:
    return pa.array([author_words(x) for x in names.to_pylist()], pa.string())


def components(edges: DataFrame) -> DataFrame:
    """Columns (id, root) for every id in `edges` (a BIGINT, b BIGINT); root is the least id of the component.

    Each round hooks every root to its least smaller neighbour, shortcuts the parent array by
    pointer doubling until it is flat, and replaces the edges by those between the new roots. The
    parent array and the edges are tables; only counts come to the driver. NULLs and loops are no
    edges. Rounds are about logarithmic in the number of ids.
    """
    pairs = edges.where("a is not null and b is not null")
    e = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    parent = cut(ids.withColumn("root", F.col("id")))
    while not e.isEmpty():
        hook = cut(e.groupBy("a").agg(F.min("b").alias("p")))
        while True:
            up = hook.select(F.col("a").alias("p"), F.col("p").alias("q"))
            nxt = cut(hook.join(up, "p", "left").select("a", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")))
            hook = nxt.select("a", "p")
            if nxt.where("moved").isEmpty():
                break
        to = hook.select(F.col("a").alias("root"), "p")
        parent = cut(parent.join(to, "root", "left").select("id", F.coalesce("p", "root").alias("root")))
        moved = e.join(hook.select("a", F.col("p").alias("x")), "a").join(hook.select(F.col("a").alias("b"), F.col("p").alias("y")), "b", "left").select("x", F.coalesce("y", "b").alias("y"))
        e = cut(moved.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    return parent


def source_groups(sources: DataFrame) -> DataFrame:
    """Columns (source_id, corpus_id, nkey, group_id): sources of a corpus that share a name, author or entity, directly or through others.

    group_id is the least source_id of the group. Repeated rows of an id count once; a NULL name,
    author or entity joins nothing.
    """
    rows = first_arrival(sources.select("source_id", "corpus_id", "name", "author", "entity_id", "registered_at"), ["source_id"], ["corpus_id", "name", "author", "entity_id"], ["registered_at"]).where("source_id is not null")
    keyed = cut(rows.select("source_id", "corpus_id", name_key("name").alias("nkey"), author_key("author").alias("akey"), F.col("entity_id").cast("string").alias("ekey")))
    links = keyed.select("source_id", "corpus_id", F.explode(F.map_from_arrays(F.array(F.lit("n"), F.lit("a"), F.lit("e")), F.array("nkey", "akey", "ekey"))).alias("kind", "k")).where("k is not null and k <> ''")
    least = links.groupBy("corpus_id", "kind", "k").agg(F.min("source_id").alias("b"))
    edges = links.join(least, (links.k == least.k) & (links.kind == least.kind) & links.corpus_id.eqNullSafe(least.corpus_id)).select(F.col("source_id").alias("a"), "b")
    roots = components(edges)
    return keyed.join(roots.withColumnRenamed("id", "source_id"), "source_id", "left").select("source_id", "corpus_id", "nkey", F.coalesce("root", "source_id").alias("group_id"))


def _unit_rows(units: DataFrame) -> DataFrame:
    rows = units.select("unit_id", "corpus_id", "source", "proposed", "ingested_at")
    return first_arrival(rows, ["unit_id"], ["corpus_id", "source", "proposed"], ["ingested_at"]).withColumn("nkey", name_key("source"))


def split_conflicts(sources: DataFrame, units: DataFrame) -> DataFrame:
    """Columns (source_id, group_id, splits): sources of groups whose units are proposed for more than one split."""
    groups = cut(source_groups(sources))
    seen = _unit_rows(units).select("corpus_id", "nkey", split_key("proposed").alias("split")).where("split is not null").distinct()
    names = groups.groupBy("corpus_id", "nkey").agg(F.min("group_id").alias("group_id"))
    apart = seen.join(names, seen.nkey.eqNullSafe(names.nkey) & seen.nkey.isNotNull() & seen.corpus_id.eqNullSafe(names.corpus_id)).groupBy("group_id").agg(F.countDistinct("split").alias("splits")).where("splits > 1")
    return groups.join(apart, "group_id").select("source_id", "group_id", "splits")


def _nearest(sizes: list[tuple[int, int]], goal: int) -> dict[int, int]:
    """How many groups of each size to take so that their total comes closest to `goal`; sizes are (size, multiplicity).

    A bitset has bit s set where a subset of total s exists; a size's multiplicity is taken in
    powers of two. Sums are exact at every size. Above SUM_BITS bits, one set in about sqrt(items)
    is kept, and the sets of one such stretch at a time are made again to read the subset off.
    """
    goal = max(0, min(goal, sum(s * m for s, m in sizes)))
    items = [(s, k) for s, m in sizes if s for _, k in _powers(m)]
    top = goal + max([s for s, _ in sizes], default=0)
    mask = (1 << (top + 1)) - 1
    step = 1 if top < SUM_BITS else math.isqrt(len(items)) + 1
    got, kept, used = 1, [1], 0
    for s, k in items:
        if got >> goal & 1:
            break
        got, used = (got | got << s * k) & mask, used + 1
        if used % step == 0:
            kept.append(got)
    below = (got & ((1 << (goal + 1)) - 1)).bit_length() - 1
    above = got >> goal
    up = goal + (above & -above).bit_length() - 1 if above else None
    at = below if up is None or goal - below <= up - goal else up
    taken: dict[int, int] = {}
    for first in range((used - 1) // step * step, -1, -step):
        sets = [kept[first // step]]
        for s, k in items[first : min(first + step, used) - 1]:
            sets.append((sets[-1] | sets[-1] << s * k) & mask)
        for i in range(min(first + step, used) - 1, first - 1, -1):
            if not sets[i - first] >> at & 1:
                s, k = items[i]
                taken[s] = taken.get(s, 0) + k
                at -= s * k
    return taken


def _powers(m: int) -> Iterator[tuple[int, int]]:
    """Parts 1, 2, 4, ... and a rest that make every number from 0 to m."""
    j = 0
    while m:
        k = min(1 << j, m)
        yield j, k
        m -= k
        j += 1


def split_quotas(sizes: list[tuple[int, int]], targets: list[tuple[str, float]]) -> list[tuple[int, str, int]]:
    """Rows (size, split, groups): every split but the one of the largest share in turn takes the subset nearest to its share."""
    total, left, out = sum(s * m for s, m in sizes), dict(sizes), []
    ordered = sorted(targets, key=lambda t: (t[1], t[0]))
    whole = sum(t[1] for t in targets) or 1.0
    for split, share in ordered[:-1]:
        for s, k in _nearest(sorted((s, m) for s, m in left.items() if m), round(total * share / whole)).items():
            out.append((s, split, k))
            left[s] -= k
    return out + [(s, ordered[-1][0], m) for s, m in left.items() if m]


def assign_splits(sources: DataFrame, units: DataFrame, split_targets: DataFrame, seed: int = 0) -> DataFrame:
    """Columns (unit_id, corpus_id, group_id, split): a split for every unit; groups never part.

    Per corpus, the numbers of units come as near to the target shares as whole groups allow. Units
    whose source is not listed form a group per source name, units without a source one each
    (group_id NULL; `ugroup` inside). Of groups of the same size a seeded hash decides. Only group
    sizes with their multiplicities, of which n units have about sqrt(2 n) at most, meet in one
    task. No target row gives an empty result.
    """
    targets = sorted((r.split, float(r.target_share)) for r in split_targets.select("split", "target_share").where("split is not null and target_share >= 0").distinct().limit(1001).collect())
    if len(targets) > 1000:
        raise ValueError("more than 1000 splits")
    names = source_groups(sources).groupBy("corpus_id", "nkey").agg(F.min("group_id").alias("group_id"))
    names = names.select(F.col("corpus_id").alias("c"), F.col("nkey").alias("k"), "group_id")
    rows = _unit_rows(units)
    placed = rows.join(names, rows.corpus_id.eqNullSafe(names.c) & (rows.nkey == names.k), "left")
    ugroup = F.coalesce(F.concat(F.lit("g"), F.col("group_id").cast("string")), F.concat(F.lit("n"), F.col("nkey")), F.concat(F.lit("u"), F.col("unit_id").cast("string")))
    placed = cut(placed.select("unit_id", "corpus_id", "group_id", ugroup.alias("ugroup")))
    sized = placed.groupBy("corpus_id", "ugroup").agg(F.count(F.lit(1)).alias("size"))
    histogram = sized.groupBy("corpus_id", "size").agg(F.count(F.lit(1)).alias("mult"))

    def quotas(pdf: pd.DataFrame) -> pd.DataFrame:
        got = split_quotas(sorted(zip(pdf["size"].tolist(), pdf["mult"].tolist())), targets) if targets else []
        order = {name: i for i, (name, _) in enumerate(targets)}
        out, upto = [], {}
        for s, split, k in sorted(got, key=lambda r: (r[0], order[r[1]])):
            out.append((pdf["corpus_id"].iloc[0], s, split, upto.get(s, 0), upto.get(s, 0) + k))
            upto[s] = upto.get(s, 0) + k
        return pd.DataFrame(out, columns=["c", "s", "split", "lo", "hi"]).astype({"c": "Int64"})

    quota = histogram.groupBy("corpus_id").applyInPandas(quotas, "c bigint, s bigint, split string, lo bigint, hi bigint")
    ranked = distributed_rank(sized, ["corpus_id", "size"], ["ugroup"], seed)
    chosen = ranked.join(quota, ranked.corpus_id.eqNullSafe(quota.c) & (F.col("size") == F.col("s")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(F.col("corpus_id").alias("gc"), F.col("ugroup").alias("gu"), "split")
    return placed.join(chosen, placed.corpus_id.eqNullSafe(chosen.gc) & (placed.ugroup == chosen.gu)).select("unit_id", "corpus_id", "group_id", "split")
