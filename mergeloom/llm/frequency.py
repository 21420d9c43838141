"""Frequency of every distinct value or term, with marks for the too rare and the too common."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from mergeloom.operators.ranking import first_arrival
from mergeloom.session import cut

#: A term of fewer than this share of the records is rare, of more than that share common.
RARE, COMMON = Fraction(4, 1000), Fraction(28, 100)


def term_frequencies(df: DataFrame, record: Sequence[str], term: str, field: str, order: Sequence[str] = (), rare: Fraction = RARE, common: Fraction = COMMON) -> DataFrame:
    """Columns (field, val, occurrences, records, all_records, mark), one row per distinct value.

    `term` is a number or an array of numbers; every element is an occurrence. Records are the
    distinct keys with a non-NULL term column; an empty array is a record without terms, NULL
    elements aren't terms, repeated rows of a key count once (the earliest by `order`). Rows with
    a NULL in the key are no records. Marks are compared exactly in integers. No row at all gives
    an empty result.

    Rows move once, by record key; terms are then counted within each record where they lie, summed
    per partition and only these partial counts are shuffled by value.
    """
    rows = df.select(*record, F.col(term).alias("__term"), *order).where(" and ".join([f"`{k}` is not null" for k in record] + ["__term is not null"]))
    once = first_arrival(rows, record, ["__term"], order)
    as_array = F.col("__term") if isinstance(df.schema[term].dataType, ArrayType) else F.array("__term")
    # the marker, one per record, counts the records in the same pass
    marked = once.select(*record, F.explode(F.concat(F.transform(as_array, lambda x: F.struct(F.lit(False).alias("record"), x.cast("bigint").alias("val"))), F.array(F.struct(F.lit(True).alias("record"), F.lit(None).cast("bigint").alias("val"))))).alias("t"))
    terms = marked.select(*record, "t.record", "t.val").where("record or val is not null")
    per_record = terms.groupBy(*record, "record", "val").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(per_record.groupBy("record", "val").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("records")))
    total = (counts.where("record").head() or {"records": 0})["records"]
    n = F.lit(total)
    mark = F.when(F.col("records") * rare.denominator < n * rare.numerator, "rare").when(F.col("records") * common.denominator > n * common.numerator, "common")
    return counts.where("not record").select(F.lit(field).alias("field"), "val", "occurrences", "records", n.cast("bigint").alias("all_records"), mark.alias("mark"))
