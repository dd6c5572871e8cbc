"""Quality rules with thresholds learned per language and source from quantile sketches.

The sketch of a measure is its number of values in each logarithmic bin, of 1%
relative error (Masson and others, 2019). Sketches merge by adding counts, so
they are a grouped count: combined before the shuffle, the same in each rerun,
and one for a language or for all texts is the sum of those below it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogmill.llm.common import settled

# The characters counted as symbols, and ASCII white space.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: Each bin of a sketch ends at this times its start.
GAMMA = 1.02
#: A group with fewer texts takes the thresholds of its language, and that those of all.
MIN_TEXTS = 200
#: A text is out if it lies this many times the middle half's width beyond that half ...
FENCE = 3.0
#: ... and this much more: (measure, side, slack). Slack keeps short texts, whose
#: shares vary, and measures that are zero in nearly all texts.
MEASURES = (
    ("word_length", "low", 2.5),
    ("word_length", "high", 3.0),
    ("symbol_share", "high", 0.05),
    ("copy_line_share", "high", 0.3),
    ("repeat_share", "high", 0.2),
)


def count_repeats(words: list[bytes], window: int = 5) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    places = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[k : n + k].astype(np.uint64) + np.uint64(1)
    if len(np.unique(mixed)) == n:
        return 0
    code = ids[:n]
    for k in range(1, window):  # exact numbers for runs of k + 1 words
        code = np.unique(code, return_inverse=True)[1].astype(np.int64) * len(places) + ids[k : n + k]
    _, which, counts = np.unique(code, return_inverse=True, return_counts=True)
    steps = np.zeros(len(words) + 1, np.int64)
    found = counts[which] > 1
    steps[:n] += found
    steps[window : n + window] -= found
    return int((np.cumsum(steps[:-1]) > 0).sum())


def base_measures(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and lines with a word."""
    text = text or ""
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    chars = len(text) - sum(map(text.count, SPACES))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), count_repeats(words), len(lines)


def with_measures(docs: DataFrame, text: str = "text", out: str = "measures") -> DataFrame:
    """Add the counts of each whole text as one struct; a null text has none of anything."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([base_measures(t) for t in texts], columns=names, dtype="int64")

    return docs.withColumn(out, run(F.col(text)))


def ratios(measures: str = "measures") -> dict[str, Column]:
    m = F.col(measures)
    share = lambda a, b: F.when(m[b] > 0, m[a] / m[b]).otherwise(0.0)
    return {
        "word_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "copy_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
    }


def sketches(values: DataFrame, measures: list[str]) -> DataFrame:
    """Rows (lang, source, measure, bin, n, grain) of all groups, of each language, and of all texts.

    ``values`` has lang, source and a column per measure. Bin null holds zeros.
    """
    stacked = values.select(
        "lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in measures])).alias("x")
    ).select(
        "lang", "source", "x.measure",
        F.when(F.col("x.value") > 0, F.ceil(F.log(F.col("x.value")) / math.log(GAMMA))).alias("bin"),
    )
    finest = stacked.groupBy("lang", "source", "measure", "bin").agg(F.count(F.lit(1)).alias("n"))
    # merging is addition: the coarser sketches come from the finest, not from the texts
    coarse = finest.groupBy("lang", "measure", "bin").agg(F.sum("n").alias("n")).select("lang", F.lit(None).cast("string").alias("source"), "measure", "bin", "n", F.lit(1).alias("grain"))
    whole = coarse.groupBy("measure", "bin").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "measure", "bin", "n", F.lit(2).alias("grain"))
    return finest.withColumn("grain", F.lit(0)).unionByName(coarse).unionByName(whole)


def quartiles(sketch: DataFrame) -> DataFrame:
    """Rows (grain, lang, source, measure, n, q1, q3); windows hold the bins of one sketch, some thousands at most."""
    group = ("grain", "lang", "source", "measure")
    run = Window.partitionBy(*group).orderBy(F.col("bin").asc_nulls_first())
    value = F.when(F.col("bin").isNull(), 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bin")))
    summed = sketch.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(Window.partitionBy(*group))).withColumn("value", value)
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("value")))
    return summed.groupBy(*group).agg(F.max("all").alias("n"), at(0.25).alias("q1"), at(0.75).alias("q3"))


def thresholds(values: DataFrame) -> DataFrame:
    """One row per (lang, source) with a struct ``limits`` of ``low_`` and ``high_`` limits of each measure."""
    names = list(dict.fromkeys(m for m, _, _ in MEASURES))
    found = quartiles(sketches(values, names))
    limits = []
    for measure, side, slack in MEASURES:
        width = FENCE * (F.col("q3") - F.col("q1")) + slack
        limit = F.col("q1") - width if side == "low" else F.col("q3") + width
        limits.append(F.max(F.when(F.col("measure") == measure, limit)).alias(f"{side}_{measure}"))
    wide = found.groupBy("grain", "lang", "source").agg(F.max("n").alias("n"), *limits)
    packed = wide.select("grain", "lang", "source", "n", F.struct(*[f"{s}_{m}" for m, s, _ in MEASURES]).alias("limits"))
    fine = packed.where("grain = 0").drop("grain").alias("f")
    lang = packed.where("grain = 1").select(F.col("lang").alias("l_lang"), F.col("n").alias("l_n"), F.col("limits").alias("l_limits"))
    whole = packed.where("grain = 2").select("limits").scalar()  # one row, or none
    return (
        fine.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")))
        .select(
            "lang", "source",
            F.when(F.col("n") >= MIN_TEXTS, F.col("limits")).when(F.col("l_n") >= MIN_TEXTS, F.col("l_limits")).otherwise(whole).alias("limits"),
        )
    )


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    ``base_failed``: fewer than 10 words, or over a fifth of them in repeated
    windows. ``kept``: not failed and within the limits of the text's language and
    source. Null languages or sources are groups of their own; null and empty texts
    have no words and fail. Repeated rows count and are returned each. Limits are
    learned from all texts that the base rules keep. An empty table gives none.
    """
    measured = with_measures(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    )
    m = F.col("measures")
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    rows = settled(measured.select("doc_id", "lang", "source", "measures", failed.alias("base_failed"), *[c.alias(n) for n, c in ratios().items()]), "measures")
    limits = thresholds(rows.where("NOT base_failed")).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "limits")
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    within = F.lit(True)
    for measure, side, _ in MEASURES:
        limit = F.col("limits")[f"{side}_{measure}"]
        within = within & (F.col(measure) >= limit if side == "low" else F.col(measure) <= limit)
    return joined.select(
        "doc_id", *[m[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed", (~F.col("base_failed") & F.coalesce(within, F.lit(False))).alias("kept"),
    )
