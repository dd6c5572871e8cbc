"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogmill.session import settled  # noqa: F401  (the operators take it from here)

#: Spark's form of a word: a run of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def fold(key: str, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % divisor


def row_key(*columns: str) -> Column:
    """16 bytes that name a row by the columns' values, nulls told from empty strings.

    Rows equal in these columns share the key; operators treat them as one document.
    """
    parts = [
        F.when(F.col(c).isNull(), F.lit("-")).otherwise(
            F.concat(F.lit("+"), F.md5(F.col(c).cast("string").cast("binary")))
        )
        for c in columns
    ]
    return F.unhex(F.md5(F.concat(*parts).cast("binary")))


def stratified_sample(rows: DataFrame, by: str, key: str, each: int | Column, strata: int, seed: int = 0) -> DataFrame:
    """About ``each`` rows of each value of ``by``, for the ``strata`` commonest values.

    A row is taken if a hash of its key falls below ``each`` divided by its
    value's count, so the sample is uniform within a value, agrees between reruns,
    and no value's rows are gathered anywhere. Rows without ``by`` are left out.
    """
    counts = (
        rows.where(F.col(by).isNotNull())
        .groupBy(F.col(by).alias("_by"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.desc("_n"), "_by")
        .limit(strata)
    )
    unit = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return (
        rows.join(F.broadcast(counts), F.col(by) == F.col("_by"))
        .where(unit < each / F.col("_n"))
        .drop("_by", "_n")
    )
