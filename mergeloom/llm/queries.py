"""Queries of the training-data problems over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mergeloom.functions.automaton import expansions
from mergeloom.functions.merge_columns import load_automaton
from mergeloom.llm import frequency, leakage, lookalike, mixing, overlap, packing, quantiles, splits, token_budget
from mergeloom.operators import stats
from mergeloom.operators.ranking import first_arrival
from mergeloom.session import cut, stored


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_shares(_t(spark, d, "sources"), _t(spark, d, "mix_targets"))


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares rounded, since sums of weights depend on their order in the last digit."""
    return _shares(spark, d).withColumn("target_bytes", F.round("target_bytes", 3)).withColumn("target_share", F.round("target_share", 9))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _shares(spark, d).where("short").select("mix_id", "category")


def p1_blocks(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_blocks(_t(spark, d, "sources"), cut(_shares(spark, d)))


def p1_block_sums(spark: SparkSession, d: str) -> DataFrame:
    """What the chosen blocks come to: copies and sources by mix and category, and whether any block is taken twice more often than another."""
    blocks = p1_blocks(spark, d).groupBy("mix_id", "category").agg(F.sum("copies").alias("copies"), F.max("copies").alias("most"), F.count(F.lit(1)).alias("taken"))
    own = _shares(spark, d).where("blocks > 0").select(F.col("mix_id").alias("m"), F.col("category").alias("c"), "blocks")
    rows = own.join(blocks, (F.col("m") == F.col("mix_id")) & (F.col("c") == F.col("category")), "left")
    even = (F.col("most") - 1) * F.col("taken") <= F.col("copies")
    return rows.select(F.col("m").alias("mix_id"), F.col("c").alias("category"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce(even, F.lit(False)).alias("even"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_conflicts(_t(spark, d, "sources"), _t(spark, d, "units")).select("source_id")


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(_t(spark, d, "sources"), _t(spark, d, "units"), _t(spark, d, "split_targets"))


def p2_balance(spark: SparkSession, d: str) -> DataFrame:
    """Per corpus: units that have a split, groups that part, and whether every split is within its largest group of its share."""
    rows = cut(p2_splits(spark, d))
    parted = rows.where("group_id is not null").groupBy("corpus_id", "group_id").agg(F.countDistinct("split").alias("n"), F.count(F.lit(1)).alias("size"))
    by_corpus = parted.groupBy("corpus_id").agg(F.sum((F.col("n") > 1).cast("bigint")).alias("parted"), F.max("size").alias("largest"))
    shares = _t(spark, d, "split_targets").select(F.col("split").alias("s"), (F.col("target_share") / F.sum("target_share").over(Window.partitionBy())).alias("share"))
    sizes = rows.groupBy("corpus_id", "split").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(shares), F.col("split") == F.col("s"))  # a row for each split
    all_n = F.sum("n").over(Window.partitionBy("corpus_id"))
    off = sizes.withColumn("off", F.abs(F.col("n") - all_n * F.col("share"))).groupBy("corpus_id").agg(F.sum("n").alias("units"), F.max("off").alias("off"))
    both = off.join(by_corpus, off.corpus_id.eqNullSafe(by_corpus.corpus_id), "left")
    return both.select(off.corpus_id, "units", F.coalesce("parted", F.lit(0)).alias("parted"), (F.col("off") <= F.greatest(F.coalesce("largest", F.lit(1)), F.lit(1))).alias("near"))


def p3_frequencies(spark: SparkSession, d: str) -> DataFrame:
    seq = frequency.term_frequencies(_t(spark, d, "sequences"), ["seq_id"], "tokens", "sequences.tokens", ["encoded_at"])
    return seq.unionByName(frequency.term_frequencies(_t(spark, d, "pack_stats"), ["seq_id", "pack_id"], "tokens", "pack_stats.tokens"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_frequencies(spark, d).where("mark is not null").select("field", "val", "mark")


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Records with a length of at least 1, every id once."""
    rows = _t(spark, d, "record_lengths").where("rec_len >= 1").select("record_id", "run_id", "tokenizer", "rec_date", "rec_len")
    return quantiles.distinct_by_group(rows, ["run_id", "tokenizer"], "record_id")


WANTED = {"median": 50, "p95": 95}


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """By day, and with rec_date NULL by run and tokenizer as a whole, from the days' sketches put together."""
    return _percentiles(_records(spark, d))


def _percentiles(records: DataFrame) -> DataFrame:
    days = stored(quantiles.sketch(records, ["run_id", "tokenizer", "rec_date"], "rec_len"))
    whole = quantiles.merge(days, ["run_id", "tokenizer"]).withColumn("rec_date", F.lit(None).cast("date"))
    by_day = quantiles.percentiles(days, ["run_id", "tokenizer", "rec_date"], WANTED).withColumn("whole", F.lit(False))
    return by_day.unionByName(quantiles.percentiles(whole, ["run_id", "tokenizer", "rec_date"], WANTED).withColumn("whole", F.lit(True)))


def p4_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Whether every percentile is within 1 % of the exact one and its bounds hold it; the exact ones count every distinct length."""
    records = cut(_records(spark, d))
    got = _percentiles(records)
    days = stats.length_summary(records, "rec_len", ["run_id", "tokenizer", "rec_date"]).withColumn("w", F.lit(False))
    whole = stats.length_summary(records, "rec_len", ["run_id", "tokenizer"]).withColumn("rec_date", F.lit(None).cast("date")).withColumn("w", F.lit(True))
    exact = days.unionByName(whole).select(F.col("run_id").alias("r"), F.col("tokenizer").alias("t"), F.col("rec_date").alias("day"), "w", "cnt", "p50", F.col("p95").alias("q95"))
    same = F.col("r").eqNullSafe(got.run_id) & F.col("t").eqNullSafe(got.tokenizer) & F.col("day").eqNullSafe(got.rec_date) & (F.col("w") == got.whole)
    near = lambda p, e: (F.abs(F.col(p) - F.col(e)) <= F.col(e) * quantiles.ALPHA * (1 + 1e-9)) & (F.col(f"{p}_low") <= F.col(e)) & (F.col(e) <= F.col(f"{p}_high"))
    both = got.join(exact, same, "full_outer")
    return both.select(F.col("r").alias("run_id"), F.col("t").alias("tokenizer"), F.col("day").cast("string").alias("rec_date"), F.col("w").alias("whole"), F.col("cnt").alias("n"), F.coalesce(near("median", "p50") & near("p95", "q95") & (F.col("cnt") == F.col("n")), F.lit(False)).alias("near"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows that the sketch's bounds decide, and the others after an exact look into the buckets in question."""
    records = stored(_records(spark, d))
    got = _percentiles(records)
    stated = first_arrival(_t(spark, d, "sequence_lengths"), ["summary_id"], ["run_id", "tokenizer", "rec_date", "median", "p95"], ["written_at"]).where("median is not null")
    stated = stated.select("summary_id", F.col("run_id").alias("r"), F.col("tokenizer").alias("t"), F.col("rec_date").alias("day"), F.col("median").alias("said_median"), F.col("p95").alias("said_p95"))
    same = (F.col("r") == got.run_id) & (F.col("t") == got.tokenizer) & F.col("day").eqNullSafe(got.rec_date) & (F.col("day").isNull() == got.whole)
    rows = stated.join(got, same)
    parts = F.array(*[F.struct(F.col(f"said_{p}").alias("said"), *[F.col(f"{p}_{x}").alias(x) for x in ("low", "high", "bucket", "below")], F.floor((F.lit(q) * F.col("n") + 99) / 100).alias("rank")) for p, q in WANTED.items()])
    one = rows.select("summary_id", "run_id", "tokenizer", "rec_date", F.explode(parts).alias("x")).select("summary_id", "run_id", "tokenizer", "rec_date", "x.*").where("said is not null")
    off_low, off_high = (F.abs(F.col("said") - F.col(v)) * 20 > F.col(v) for v in ("low", "high"))
    inside = (F.col("low") < F.col("said")) & (F.col("said") < F.col("high"))
    one = cut(one.withColumn("off", F.when(F.col("low") == F.col("high"), off_low).when(inside, F.when(F.col("high") * 20 <= F.col("low") * 21, F.lit(False))).when(off_low == off_high, off_low)))
    found = one.where("off").select("summary_id")
    open_rows = one.where("off is null").withColumn("place", F.col("rank") - F.col("below"))
    if not open_rows.isEmpty():
        for groups, here in ((["run_id", "tokenizer", "rec_date"], "rec_date is not null"), (["run_id", "tokenizer"], "rec_date is null")):
            asked = open_rows.where(here).select("summary_id", *[F.col(g).alias(f"q{i}") for i, g in enumerate(groups)], F.col("bucket").alias("qb"), F.col("place").alias("qp"), "said")
            places = open_rows.where(here).select(*groups, "bucket", "place")
            exact = quantiles.exact_in_buckets(records, places, groups, "rec_len")
            on = (F.col("qb") == F.col("bucket")) & (F.col("qp") == F.col("place"))
            for i, g in enumerate(groups):
                on = on & (F.col(f"q{i}") == F.col(g))
            found = found.unionByName(asked.join(exact, on).where(F.abs(F.col("said") - F.col("exact")) * 20 > F.col("exact")).select("summary_id"))
    return found.distinct()


def p5_tokens(spark: SparkSession, d: str) -> DataFrame:
    return token_budget.document_tokens(_t(spark, d, "documents"), _t(spark, d, "merges"))


def p5_budget(spark: SparkSession, d: str) -> DataFrame:
    return token_budget.token_budget(_t(spark, d, "documents"), _t(spark, d, "merges"), _t(spark, d, "domain_metrics"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_budget(spark, d).where("off").select("metric_id")


def p5_longest(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every document under the tokens of `merges` as a longest-match vocabulary."""
    merges = load_automaton(_t(spark, d, "merges")).merges.tolist()
    return token_budget.longest_match_tokens(_t(spark, d, "documents"), list(expansions(map(tuple, merges)).values())).select("doc_id", "tokens")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_pairs(_t(spark, d, "units"))


def p6_fractions(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_fractions(_t(spark, d, "units"))


def p6_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of every held-out unit, and whether its overlap is in bounds and whole where its body also stands in train."""
    rows = p6_fractions(spark, d)
    copies = overlap_copies(_t(spark, d, "units"))
    sane = (F.col("shared_words") >= 0) & (F.col("shared_words") <= F.col("n_words")) & (~F.coalesce("copied", F.lit(False)) | (F.col("shared_words") == F.col("n_words")))
    return rows.join(copies, "unit_id", "left").select("unit_id", "n_words", F.coalesce("copied", F.lit(False)).alias("copied"), sane.alias("sane"))


def overlap_copies(units: DataFrame) -> DataFrame:
    members = overlap._members(units)
    train = members.where("train").select("key").distinct()
    return members.where("not train").join(train.hint("merge"), "key", "left_semi").select("unit_id", F.lit(True).alias("copied"))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_counts(_t(spark, d, "units"), p6_found(spark, d))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(_t(spark, d, "documents"), _t(spark, d, "merges"), _t(spark, d, "context_sizes"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_containers(spark, d).where("piece_no = 1").select("context_name", "doc_id")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.container_fill(p7_containers(spark, d), _t(spark, d, "context_sizes"))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """Per context: documents and tokens placed, pieces, tokens placed twice or out of order, containers above the capacity, and whether less than 5 % is unused."""
    packed = cut(p7_containers(spark, d))
    sizes = _t(spark, d, "context_sizes").select(F.col("context_name").alias("c"), F.col("capacity_tokens").alias("capacity")).distinct()
    one = packed.groupBy("context_name", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"))
    docs = one.groupBy("context_name").agg(F.count(F.lit(1)).alias("documents"), F.sum("t").alias("tokens"), F.sum("pieces").alias("pieces"), F.sum((F.col("t") != F.col("end")).cast("bigint")).alias("misplaced"))
    full = packed.groupBy("context_name", "container_id").agg(F.sum("n_tokens").alias("t")).join(sizes, F.col("context_name") == F.col("c"))
    used = full.groupBy("c", "capacity").agg(F.sum((F.col("t") > F.col("capacity")).cast("bigint")).alias("overfull"), (1 - F.sum("t") / (F.count(F.lit(1)) * F.col("capacity")) < 0.05).alias("tight"))
    return docs.join(used, F.col("context_name") == F.col("c")).select("context_name", "documents", "tokens", "pieces", "misplaced", "overfull", "tight")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id")


def p8_removed(spark: SparkSession, d: str) -> DataFrame:
    return leakage.remove_leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def p8_covered(spark: SparkSession, d: str) -> DataFrame:
    """What p8_removed takes out of every document."""
    return p8_removed(spark, d).where("removed_words > 0").select("doc_id", "removed_words", F.round("removed_share", 9).alias("removed_share"), "dropped")


def p9_members(spark: SparkSession, d: str) -> DataFrame:
    """Documents in a class of several spellings, with the size of their class."""
    return lookalike.look_members(_t(spark, d, "documents")).where("spellings > 1").select("doc_id", "spellings", "documents")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_pairs(_t(spark, d, "documents"))


def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_forms(_t(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(f)}
