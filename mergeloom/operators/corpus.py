"""Corpus hygiene: bodies, splits, leakage and near-duplicate filters, composition, domains of byte ranges."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mergeloom.errors import CorpusError
from mergeloom.functions.values import MASK, anchored, anchors, rolling
from mergeloom.operators.ranking import running_sum
from mergeloom.session import cut

# Fixed values of the filters: bytes of a leaked passage, of a shingle, the stride of the shingles, and the reasons.
PASSAGE, SHINGLE, STRIDE = 128, 32, 16
SHARED, NEAR = "shared-128-byte", "near-duplicate-jaccard80"
HELD_OUT = ("validation", "test")


def split_name(proposed: Column) -> Column:
    """Split names without case and outer blanks of any kind; val is validation."""
    name = F.lower(F.regexp_replace(proposed, r"(?U)^\s+|\s+$", ""))
    return F.when(name == "val", "validation").otherwise(name)


def marked_body(text: Column) -> Column:
    """The part between the line with `*** START OF ` and `*** END OF `; an error if there is none."""
    got = F.regexp_extract(text, r"(?s)\*\*\* START OF [^\n]*\n(.*?)\*\*\* END OF ", 1)
    found = text.rlike(r"(?s)\*\*\* START OF [^\n]*\n.*?\*\*\* END OF ")
    return F.when(text.isNull(), None).when(found, got).otherwise(F.raise_error("no marked body"))


def synthetic_json(spark: SparkSession, n: int = 16_384) -> DataFrame:
    """Columns (i, line): deterministic JSON records."""
    i = F.col("id")
    # fixed value: the line's format
    h = F.lower(F.hex(_wrapping_product(i, 0x9E3779B97F4A7C15)))
    line = F.format_string('{"id":%d,"voltage":%d.%d ,"range":[%d,%d],"enabled":%s,"route":"/probe/%s","note":"Grüße 東京 🦀"}\n', i, i % 241, i % 100, i * 31, i * 31 + 17, F.when(i % 2 == 0, "true").otherwise("false"), F.lpad(h, 16, "0"))
    return spark.range(n).select(i.alias("i"), line.alias("line"))


def synthetic_unicode(spark: SparkSession, n: int = 16_384) -> DataFrame:
    """Columns (i, line): deterministic lines of many scripts."""
    i = F.col("id")
    # fixed value: the line's format
    h = F.lower(F.hex(_wrapping_product(i, 0xA341316C9E3779B9)))
    line = F.format_string("Probe %d: Straße, Häuser, Äpfel — 東京 漢字 🦀 🌍 👩🏽\u200d💻 e\u0301; %d ± %d = %d; checksum %s.\n", i, i * 31, i % 19, i * 31 + i % 19, F.lpad(h, 16, "0"))
    return spark.range(n).select(i.alias("i"), line.alias("line"))


def _wrapping_product(i: Column, k: int) -> Column:
    """i * k modulo 2^64 as BIGINT for 0 <= i < 2^31, by 32-bit halves so that nothing overflows."""
    d = i.cast("decimal(19,0)")
    number = lambda n: F.lit(Decimal(n))
    upper = (d * number(k >> 32)).cast("decimal(38,0)") % number(1 << 32)
    total = ((d * number(k & 0xFFFFFFFF)).cast("decimal(38,0)") + (upper.cast("decimal(19,0)") * number(1 << 32)).cast("decimal(38,0)")) % number(MASK + 1)
    return F.when(total >= number(1 << 63), total - number(MASK + 1)).otherwise(total).cast("bigint")


def capped_files(files: DataFrame, path: str, size: str, limit: int = 20 * 1024 * 1024) -> DataFrame:
    """Columns (path, size, taken, before): files in path order while they fit; one too large is skipped and the next is tried.

    Skipped files don't add, so the sum is a fold in order. One task streams the (path, size) pairs
    of one listing, bounded by the number of files a corpus may have (65,000); no contents.
    """
    listing = files.select(F.col(path).alias("path"), F.col(size).cast("bigint").alias("size"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            taken, before = [], []
            for n in b.column("size").to_pylist():
                fits = n is not None and total + n <= limit
                before.append(total)
                taken.append(fits)
                total += n if fits else 0
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("size"), pa.array(taken, pa.bool_()), pa.array(before, pa.int64())], names=["path", "size", "taken", "before"])

    return listing.repartition(1).sortWithinPartitions("path", "size").mapInArrow(fold, "path string, size bigint, taken boolean, before bigint")


def repeated_windows(blocks: DataFrame, ident: str, split: str, content: str, k: int, across: bool = True) -> DataFrame:
    """Columns (i, s, h): blocks with the hashes of those k-byte windows whose anchor also stands in another split, or with across=False in another block.

    A window's anchor is the least hash of the half as long windows inside it, so equal windows have
    equal anchors: no window that repeats is missing, and only about one row for k / 4 bytes is
    shuffled to find where there are any. Anchors are counted before they are joined.
    """
    b = blocks.select(F.col(ident).alias("i"), F.col(split).alias("s"), F.col(content).alias("c"))
    own = b.select("i", "s", F.explode(anchors(k)(F.col("c"))).alias("a"))
    apart = (lambda c: F.min(c) != F.max(c))("s" if across else "i")
    shared = own.groupBy("a").agg(apart.alias("apart")).where("apart").select("a")
    wanted = cut(own.join(shared.hint("merge"), "a").groupBy("i").agg(F.collect_list("a").alias("wanted")))  # at most a block's own anchors
    return b.join(wanted.hint("merge"), "i").select("i", "s", F.explode(anchored(k)(F.col("c"), F.col("wanted"))).alias("h"))


def splits_share_passage(blocks: DataFrame, split: str, content: str, k: int = 32, ident: str = "unit_id") -> DataFrame:
    """Columns (split_a, split_b, shared): pairs of splits with the number of distinct k-byte passages in both."""
    h = repeated_windows(blocks, ident, split, content, k).select("s", "h").distinct()
    by = h.groupBy("h").agg(F.array_sort(F.collect_set("s")).alias("in_")).where(F.size("in_") > 1)  # as many entries as there are splits
    pair = by.select(F.explode(F.flatten(F.transform("in_", lambda a: F.transform(F.filter("in_", lambda b: b > a), lambda b: F.struct(a.alias("split_a"), b.alias("split_b")))))).alias("p"))
    return pair.select("p.*").groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("shared"))


def drop_leaky_blocks(blocks: DataFrame, ident: str, split: str, content: str, k: int = PASSAGE) -> DataFrame:
    """Columns (ident, split, kept): held-out blocks with a k-byte passage of train, then test blocks with one of a kept validation block."""
    h = cut(repeated_windows(blocks, ident, split, content, k))
    train = h.where("s = 'train'").select("h").distinct()
    bad = h.where(F.col("s").isin(*HELD_OUT)).join(train, "h", "left_semi").select("i").distinct()
    validation = h.where("s = 'validation'").join(bad, "i", "left_anti").select("h").distinct()
    bad2 = h.where("s = 'test'").join(validation, "h", "left_semi").select("i").distinct()
    all_bad = bad.union(bad2).distinct().withColumn("bad", F.lit(True))
    rows = blocks.select(F.col(ident), F.col(split), F.col(ident).alias("i")).join(all_bad, "i", "left")
    return rows.select(ident, split, F.col("bad").isNull().alias("kept"))


def shingle_sets(df: DataFrame, ident: str, content: str, k: int = SHINGLE, stride: int = STRIDE) -> DataFrame:
    """Columns (ident, shingles): the set of every `stride`-th k-byte window hash, counted from the start of the content."""
    return df.select(F.col(ident), rolling(k, stride, distinct=True)(F.col(content)).alias("shingles"))


def near_classes(df: DataFrame, ident: str, content: str, k: int = SHINGLE, stride: int = STRIDE) -> tuple[DataFrame, DataFrame]:
    """(members, near): rows (id, cls, n) with the class of equal shingle sets, named by its least id, and pairs (a, b, common, total), a < b, of classes with a Jaccard similarity of 0.8 or more.

    Classes are joined on a prefix of their rarest shingles, n - ceil(0.8 n) + 1 of n, one of which
    any such pair shares, and checked exactly. Contents without a shingle are in no class.
    """
    sets = shingle_sets(df, ident, content, k, stride).where(F.size("shingles") > 0).select(F.col(ident).alias("id"), "shingles")
    sets = cut(sets.withColumn("key", F.unhex(F.md5(F.array_join("shingles", ",").cast("binary")))))
    named = sets.groupBy("key").agg(F.min("id").alias("cls"))
    members = sets.select("id", "key", F.size("shingles").alias("n")).join(named, "key").select("id", "cls", "n")
    classes = cut(sets.join(named, "key").where("id = cls").select("cls", "shingles").dropDuplicates(["cls"]))
    one = classes.select("cls", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    counts = one.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    own = Window.partitionBy("cls")
    hits = one.join(counts, "s").withColumn("place", F.row_number().over(own.orderBy("c", "s"))).withColumn("k", F.count(F.lit(1)).over(own))
    prefix = cut(hits.where(F.col("place") + F.col("n") - F.col("k") <= F.col("n") - F.ceil(F.col("n") * 4 / 5) + 1).select("cls", "n", "s"))
    other = prefix.select(F.col("cls").alias("b"), F.col("n").alias("nb"), "s")
    candidates = prefix.join(other, "s").where((F.col("cls") < F.col("b")) & (F.least("n", "nb") * 5 >= F.greatest("n", "nb") * 4)).select(F.col("cls").alias("a"), "b").distinct()
    sa, sb = classes.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), classes.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    scored = candidates.join(sa, "a").join(sb, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    near = scored.withColumn("total", F.size("sa") + F.size("sb") - F.col("common")).where("common * 5 >= total * 4").select("a", "b", "common", "total")
    return members, near


def near_duplicate_pairs(df: DataFrame, ident: str, content: str, k: int = SHINGLE, stride: int = STRIDE) -> DataFrame:
    """Columns (id_a, id_b, common, total), id_a < id_b: near-duplicate pairs between class representatives, and each other member of a class with its representative.

    Representatives are the least ids of equal shingle sets, so copies are never expanded into all pairs.
    Shingles are counted from the start of the content: a copy shifted by a number of bytes that is
    no multiple of `stride` shares hardly any of them and is not found.
    """
    members, near = near_classes(df, ident, content, k, stride)
    copies = members.where("id > cls").select(F.col("cls").alias("a"), F.col("id").alias("b"), F.col("n").alias("common"), F.col("n").alias("total"))
    return near.unionByName(copies).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), "common", "total")


def accept_blocks(blocks: DataFrame, ident: str, split: str, content: str, long: int = PASSAGE) -> DataFrame:
    """Columns (ident, split, kept, reason): train blocks are accepted; a validation or test block in order of `ident` is not
    if it shares a `long`-byte passage with an accepted block before it, or is a near-duplicate of one. Test blocks are compared with train and validation only.

    Near-duplicates are those of near_duplicate_pairs, without copies shifted by no multiple of the stride.
    Acceptance depends on order. Each round decides the blocks whose earlier neighbours are all
    decided, from the least accepted and the least undecided validation block of every passage and
    of every class of equal shingle sets; blocks are never paired with each other. Rounds are as
    many as the longest chain of neighbours.
    """
    b = cut(blocks.select(F.col(ident).alias("id"), F.col(split).alias("s"), F.col(content).alias("c")))
    h = cut(repeated_windows(b, "id", "s", "c", long, across=False).withColumnRenamed("i", "id"))
    train = h.where("s = 'train'").select("h").distinct()
    passages = cut(h.where("s <> 'train'"))
    by_train = passages.join(train, "h", "left_semi").select("id").distinct()
    members, near = near_classes(b.select("id", "c"), "id", "c")
    classed = cut(members.join(b.select("id", "s"), "id").select("id", "s", "cls"))
    links = cut(near.select("a", "b").union(near.select("b", "a")).union(members.select(F.col("cls").alias("a"), F.col("cls").alias("b"))).distinct().toDF("k", "cls"))
    trained = classed.where("s = 'train'").select(F.col("cls").alias("k")).distinct()
    near_train = classed.where("s <> 'train'").join(links.join(trained, "k", "left_semi").select("cls").distinct(), "cls", "left_semi").select("id").distinct()
    state = b.where("s <> 'train'").select("id", "s").join(by_train.withColumn("p", F.lit(True)), "id", "left").join(near_train.withColumn("q", F.lit(True)), "id", "left")
    state = cut(state.select("id", "s", "q", F.when(F.col("p"), SHARED).alias("reason")))

    def seen(rows: DataFrame, key: str, least: DataFrame, name: str) -> DataFrame:
        before = lambda c: F.max((F.col(c).isNotNull() & ((F.col("s") == "test") | (F.col(c) < F.col("id")))))
        return rows.join(least, key).groupBy("id").agg(before("acc").alias(f"a{name}"), before("und").alias(f"o{name}"))

    while True:
        val = state.where("s = 'validation'").select(F.col("id").alias("v"), "reason")
        least = [F.min(F.when(F.col("reason") == "accepted", F.col("v"))).alias("acc"), F.min(F.when(F.col("reason").isNull(), F.col("v"))).alias("und")]
        by_passage = passages.join(val, F.col("id") == F.col("v")).groupBy("h").agg(*least)
        by_class = classed.join(val, F.col("id") == F.col("v")).select(F.col("cls").alias("k"), "v", "reason").join(links, "k").groupBy("cls").agg(*least)
        first, second = seen(passages, "h", by_passage, "0"), seen(classed.where("s <> 'train'"), "cls", by_class, "1")
        is_true = lambda c: F.coalesce(F.col(c), F.lit(False))
        decided = F.when(is_true("a0"), SHARED).when(is_true("o0"), None).when(is_true("q") | is_true("a1"), NEAR).when(~is_true("o1"), "accepted")
        state = cut(state.join(first, "id", "left").join(second, "id", "left").select("id", "s", "q", F.coalesce("reason", decided).alias("reason")))
        if state.where("reason is null").isEmpty():
            break
    out = b.join(state.select("id", "reason"), "id", "left").select(F.col("id").alias(ident), F.col("s").alias(split), F.coalesce("reason", F.lit("accepted")).alias("reason"))
    return out.select(ident, split, (F.col("reason") == "accepted").alias("kept"), "reason")


def composition(units: DataFrame, source: str, split: str, size: str, kept: str) -> DataFrame:
    """Columns (source, train, validation, test, removed): kept bytes by split, and the bytes left out."""
    at = lambda s: F.sum(F.when(F.col(kept) & (F.col(split) == s), F.col(size)).otherwise(0)).alias(s)
    return units.groupBy(source).agg(*[at(s) for s in ("train", *HELD_OUT)], F.sum(F.when(~F.col(kept), F.col(size)).otherwise(0)).alias("removed"))


def unit_spans(units: DataFrame, sources: DataFrame, split: str, corpus: str | None = None) -> DataFrame:
    """Columns (start_byte, end_byte, category): places of a split's kept units in the joined split, in unit order.

    `units` has (ord, source, start, end, proposed, kept), `sources` (name, category). With `corpus`,
    a column of both that comes first in the result, every corpus has a joined split of its own and
    its own sources. The ordered sum of lengths runs over ranges of `ord` (see running_sum).
    """
    own = [corpus] if corpus else []
    mine = units.where(F.col("kept") & (F.col("proposed") == split)).select(*own, "ord", "source", (F.col("end") - F.col("start")).alias("size"))
    names = sources.select(*[F.col(c).alias("__c") for c in own], F.col("name").alias("__name"), "category")
    same = F.col("source") == F.col("__name")
    for c in own:
        same = same & F.col(c).eqNullSafe(F.col("__c"))
    named = mine.join(names, same, "left").select(*own, "ord", "size", "category")
    return running_sum(named, ["ord"], "size", "end_byte", own).select(*own, (F.col("end_byte") - F.col("size")).alias("start_byte"), "end_byte", "category")


def span_report(units: DataFrame, sources: DataFrame, stated: DataFrame, corpus: str) -> DataFrame:
    """Columns (corpus, split, units, unit_bytes, empty_units, unknown_sources, stated_bytes, covered), a row for every corpus and split in either input.

    Kept units (corpus, source, start, end, proposed, kept) are held against sources (corpus, name)
    and the stated sizes (corpus, split, size): a unit without bytes, a source that isn't listed, or
    a sum other than the split's size keeps a split from being covered.
    """
    names = sources.select(F.col(corpus).alias("__c"), F.col("name").alias("__n")).distinct().withColumn("__known", F.lit(True))
    mine = units.where("kept").select(F.col(corpus).alias("c"), F.col("proposed").alias("s"), "source", (F.col("end") - F.col("start")).alias("size"))
    sums = mine.join(names, F.col("c").eqNullSafe(F.col("__c")) & (F.col("source") == F.col("__n")), "left").groupBy("c", "s").agg(
        F.count(F.lit(1)).alias("units"), F.sum("size").alias("unit_bytes"), F.sum((F.col("size") <= 0).cast("bigint")).alias("empty_units"), F.sum(F.col("__known").isNull().cast("bigint")).alias("unknown_sources")
    )
    given = stated.select(F.col(corpus).alias("d"), F.col("split").alias("t"), F.col("size").cast("bigint").alias("stated_bytes"))
    both = sums.join(given, F.col("c").eqNullSafe(F.col("d")) & F.col("s").eqNullSafe(F.col("t")), "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rows = both.select(F.coalesce("c", "d").alias(corpus), F.coalesce("s", "t").alias("split"), *[zero(c) for c in ("units", "unit_bytes", "empty_units", "unknown_sources", "stated_bytes")])
    return rows.withColumn("covered", (F.col("empty_units") == 0) & (F.col("unknown_sources") == 0) & (F.col("unit_bytes") == F.col("stated_bytes")))


def require_covered(report: DataFrame) -> None:
    """Raises CorpusError with the first split of a span_report that isn't covered."""
    bad = report.where("not covered").orderBy(*report.columns[:2]).limit(1).collect()
    if bad:
        raise CorpusError("spans don't cover the split", **bad[0].asDict())


def require_mapped(domains: DataFrame) -> DataFrame:
    """Rows of token_domains; one with a gap in the spans below it fails when it is read."""
    gap = F.raise_error(F.concat(F.lit("no span at byte "), F.col("start_byte").cast("string")))
    return domains.withColumn("domain", F.coalesce("domain", gap.cast("string")))


def token_domains(tokens: DataFrame, spans: DataFrame, width: int = 8192, carry: Sequence[str] = ()) -> DataFrame:
    """Columns (pos, start_byte, end_byte, domain, carry): the domain of every token's byte range; mixed-domain across two, NULL with a gap.

    `tokens` has (pos, start_byte, end_byte) and the columns to carry, `spans` (start_byte, end_byte, domain) without overlap.
    Both sides are cut into ranges of `width` bytes and joined on the range's number, so the join
    is hashed; a range's spans, `width` at most, are one row, and only tokens across two ranges are
    put together again. A `width` of about a span's length is fastest.
    """
    cells = lambda: F.explode(F.sequence(F.floor(F.col("start_byte") / width), F.floor((F.col("end_byte") - 1) / width)))
    s = spans.where("end_byte > start_byte").select("start_byte", "end_byte", "domain", cells().alias("cell")).groupBy("cell").agg(F.collect_list(F.struct(F.col("start_byte").alias("a"), F.col("end_byte").alias("b"), "domain")).alias("spans"))
    t = tokens.where("end_byte > start_byte").select("pos", "start_byte", "end_byte", *carry)
    inside = F.floor(F.col("start_byte") / width) == F.floor((F.col("end_byte") - 1) / width)
    here = F.filter("spans", lambda x: (x["a"] < F.least(F.col("end_byte"), (F.col("cell") + 1) * width)) & (x["b"] > F.greatest(F.col("start_byte"), F.col("cell") * width)))
    part = lambda x: F.least(x["b"], F.col("end_byte"), (F.col("cell") + 1) * width) - F.greatest(x["a"], F.col("start_byte"), F.col("cell") * width)

    def met(rows: DataFrame) -> DataFrame:
        both = rows.join(s, "cell", "left").withColumn("here", F.coalesce(here, F.array().cast("array<struct<a:bigint,b:bigint,domain:string>>")))
        names = F.transform("here", lambda x: x["domain"])
        return both.select("pos", "start_byte", "end_byte", *carry, F.aggregate("here", F.lit(0).cast("bigint"), lambda acc, x: acc + part(x)).alias("covered"), F.array_min(names).alias("d1"), F.array_max(names).alias("d2"))

    one = met(t.where(inside).withColumn("cell", F.floor(F.col("start_byte") / width)))
    several = met(t.where(~inside).select("*", cells().alias("cell"))).groupBy("pos", "start_byte", "end_byte").agg(*[F.first(c).alias(c) for c in carry], F.sum("covered").alias("covered"), F.min("d1").alias("d1"), F.max("d2").alias("d2"))
    got = one.unionByName(several)
    return got.select("pos", "start_byte", "end_byte", *carry, F.when(F.col("covered") < F.col("end_byte") - F.col("start_byte"), None).when(F.col("d1") != F.col("d2"), "mixed-domain").otherwise(F.col("d1")).alias("domain"))
