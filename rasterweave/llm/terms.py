"""Frequencies of every distinct term."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.session import cut_lineage

RARE, COMMON = "rare", "common"

#: A code: a longest run of letters and digits.
CODE = r"[\p{L}\p{Nd}]+"


def codes(field: Column) -> Column:
    """All codes of a field in upper case, in order, repeats kept; empty for null."""
    return F.coalesce(F.regexp_extract_all(F.upper(field.cast("string")), F.lit(CODE), F.lit(0)), F.array().cast("array<string>"))


def term_frequencies(records: DataFrame, terms: dict[str, Column], *, min_records: int | None = None, max_share: float | None = None) -> DataFrame:
    """Occurrences and records of every distinct term of each field, with a mark.

    terms: field name to an array of terms. Result: field_name, term, n_occurrences, n_records and mark: 'rare' if
    n_records < min_records, else 'common' if n_records > max_share * number of records, else null. Each row of records
    is one record; make repeated ids single first. Null arrays and null terms count nothing, but a record without
    terms is one of the records. An empty input gives an empty result.

    Each record is first reduced to its distinct terms with their counts, in the time of a sort of its terms. These partial
    counts are combined by hash in the map tasks, so at most one row per term and task is shuffled, however frequent a
    term is. The number of records is counted in the same pass, as a row without a term. The vocabulary may be as large as
    the collection: it is written to the checkpoint folder, never gathered anywhere. The records are read once.
    """
    per_field = [F.struct(F.lit(name).alias("field_name"), F.sort_array(F.filter(column, lambda t: t.isNotNull())).alias("terms")) for name, column in terms.items()]
    record = F.struct(F.lit(None).cast("string").alias("field_name"), F.lit(None).cast("array<string>").alias("terms"))
    fields = records.select(F.explode(F.array(record, *per_field)).alias("_f")).select("_f.field_name", "_f.terms")
    # In a sorted array a term begins where its predecessor differs, and ends where the next one begins.
    first = lambda t, i: (i == 0) | (F.get(F.col("terms"), i - 1) != t)
    marked = fields.select("field_name", "terms", F.transform("terms", lambda t, i: F.when(first(t, i), i)).alias("at")).select("field_name", "terms", F.filter("at", lambda i: i.isNotNull()).alias("at"))
    counted = F.transform("at", lambda i, k: F.struct(F.get(F.col("terms"), i).alias("term"), (F.coalesce(F.get(F.col("at"), k + 1), F.size("terms")) - i).alias("n")))
    within = marked.select("field_name", F.explode_outer(counted).alias("_t")).filter(F.col("field_name").isNull() | F.col("_t").isNotNull())
    totals = cut_lineage(within.groupBy("field_name", F.col("_t.term").alias("term")).agg(F.sum("_t.n").alias("n_occurrences"), F.count(F.lit(1)).alias("n_records")))
    mark = F.lit(None).cast("string")
    if max_share is not None:
        everything = totals.filter("field_name IS NULL").agg(F.max("n_records").alias("n")).scalar()  # one number, as a scalar subquery
        mark = F.when(F.col("n_records") > everything * F.lit(float(max_share)), COMMON)
    if min_records is not None:
        mark = F.when(F.col("n_records") < min_records, RARE).otherwise(mark)
    return totals.filter("field_name IS NOT NULL").withColumn("mark", mark)


def code_frequencies(records: DataFrame, fields: Sequence[str], **bounds) -> DataFrame:
    """term_frequencies of the codes in the named columns."""
    return term_frequencies(records, {f: codes(F.col(f)) for f in fields}, **bounds)
