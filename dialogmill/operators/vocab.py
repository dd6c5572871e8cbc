"""Vocabulary learned from a corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Letters, digits, or one other visible character.
WORD_PATTERN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"


@dataclass(frozen=True)
class SpecialTokens:
    """Ids kept free in front of the learned tokens; a missing pad is the eos."""

    unk: int = 0
    bos: int = 1
    eos: int = 2
    pad: int | None = None
    reserved: int = 3

    @property
    def pad_id(self) -> int:
        return self.eos if self.pad is None else self.pad


def default_pad(pad: Column, eos: Column) -> Column:
    """The same rule for a table of tokenizer settings."""
    return F.coalesce(pad, eos)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def _magnitude() -> Column:
    """``n`` on a coarse scale of a few hundred values."""
    return F.floor(F.log2(F.col("n")) * 8)


def learn_vocab(
    texts: DataFrame, text: str, size: int | None = None, special: SpecialTokens = SpecialTokens()
) -> DataFrame:
    """``(token_id, token, n)`` of all tokens, or of the ``size`` most frequent ones.

    Counts are combined before the shuffle, so a token that makes up a third of
    the corpus costs one row per task. Ids rise with falling counts, then with
    the token. No task numbers all of them: tokens fall into buckets by the
    magnitude of their count and, where one magnitude is one small count, by
    their first two characters; an id is the number of tokens in earlier buckets
    plus the place in the bucket. ``explode_outer`` because ``explode`` makes Catalyst
    add a filter that runs the regular expression again for every row.
    """
    counts = (
        texts.select(F.explode_outer(words(F.col(text))).alias("token"))
        .filter(F.col("token").isNotNull())
        .groupBy("token")
        .agg(F.count("*").alias("n"))
        # up to 16 a magnitude is a single count, so the token alone orders it
        .withColumns({"_m": _magnitude(), "_p": F.when(F.col("n") <= 16, F.substring("token", 1, 2)).otherwise("")})
    )
    before = Window.orderBy(F.desc("_m"), "_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counts.groupBy("_m", "_p")
        .agg(F.count("*").alias("_n"))
        .select("_m", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("_m", "_p").orderBy(F.desc("n"), "token")
    place = F.row_number().over(inside) + F.col("_before")
    numbered = counts.join(offsets, ["_m", "_p"]).withColumn("_place", place)
    kept = numbered if size is None else numbered.filter(F.col("_place") <= size)
    return kept.select((F.col("_place") + F.lit(special.reserved - 1)).cast("int").alias("token_id"), "token", "n")


def vocab_size(vocab: DataFrame, special: SpecialTokens = SpecialTokens()) -> DataFrame:
    """One row: number of ids, the reserved ones included."""
    return vocab.agg((F.count("*") + F.lit(special.reserved)).alias("vocab_size"))
