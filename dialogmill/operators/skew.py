"""Equi join that spreads a hot key over several tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    salts: int = 32,
) -> DataFrame:
    """Join ``many`` to ``one`` (at most one row per key) without hot tasks.

    Rows of one key are spread over ``salts`` tasks by a hash of ``spread_by``;
    ``one`` is repeated per salt. Both sides are deterministic, so a retried
    task gives the same rows. When ``one`` turns out small at run time,
    adaptive execution broadcasts it instead.
    """
    left = many.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def spread_join(many: DataFrame, one: DataFrame, key: str, spread_by: Sequence[str], heavy: int = 1 << 16, salts: int = 32) -> DataFrame:
    """Left join of ``many`` to ``one`` (at most one row per key) that salts heavy keys only.

    Keys of over ``heavy`` rows are found by a count, so they are few; ``one`` is
    repeated per salt for these alone, and not as a whole.
    """
    hot = F.broadcast(many.groupBy(key).count().filter(F.col("count") > heavy).select(key, F.lit(salts).alias("_salts")))
    salt = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread_by), F.col("_salts")))
    left = many.join(hot, key, "left").withColumn("_salt", salt.cast("int")).drop("_salts")
    right = one.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [key, "_salt"], "left").drop("_salt")
