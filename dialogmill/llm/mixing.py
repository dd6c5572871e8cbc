"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogmill.llm.common import WORD, row_key, settled

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
#: Documents in a bucket of ranks, on average; one bucket per source is ordered row by row.
BUCKET_DOCS = 4096
#: Documents of so many words or more have a source's highest inclusion chance; below, it falls with their words.
FULL_WORDS = 1024
#: Chances are kept this far from 0 and 1, so that their odds are finite.
LEAST_CHANCE = 2.0**-40
#: 13 hex digits.
UNIT = float(1 << 52)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number between 0 and 1 from a document's id and text, the same in each rerun."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("-")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / UNIT


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Rows (source, n_docs, source_size, target), from rows (source, n_docs, source_size), one per source.

    Sources in code point order, null last, take the weights in turn. Together the
    targets are ``share`` of all sizes; none exceeds ``MOST_COPIES`` times its source,
    and what is cut off goes to the others by weight. With sources ordered by that
    bound over their weight, the ones cut are a first part of them; the rest share
    what is left. One small row per source goes through one window.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn)).withColumn("bound", MOST_COPIES * F.col("source_size"))
    by_bound = Window.orderBy((F.col("bound") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    after = by_bound.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0))
    levels = weighed.withColumn("level", left / F.sum("weight").over(after)).withColumn("place", F.row_number().over(by_bound))
    # the level of the first source that it does not fill
    fits = F.when(F.col("level") * F.col("weight") <= F.col("bound"), F.col("place"))
    level = F.coalesce(F.min_by("level", fits).over(everything), F.lit(float("inf")))
    return levels.withColumn("level", level).select(
        "source", "n_docs", "source_size",
        F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("bound").cast("double"), F.col("level") * F.col("weight"))).alias("target"),
    )


def mix(
    docs: DataFrame,
    seed: int = 0,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Rows (key, doc_id, source, size, source_size, target, copies, taken, chance), one per row of ``docs``.

    A source's target over its size is the copies it has on average. The whole ones are
    certain for each of its documents. The rest, r, is their mean inclusion chance:
    a document's own is r + r * (1 - r) * (h - H), where h, from 0 to 1, grows with its
    words up to ``FULL_WORDS``, and H is the mean of h over the source's words. That lies
    between 0 and 1, and weighed by words it averages r, so expected words meet the target.
    Documents are ranked by random odds over inclusion odds, and the first of each source
    are taken until its target in words is met, to half a document. Ranks are counted in
    buckets; sums per bucket tell which one holds the end, and only that one is
    ordered by row, so no source passes through one task. At the end, near r, a bucket
    holds at most about twice ``BUCKET_DOCS`` documents.

    Rows with the same id and text are one document of that many times its size and
    are taken together. Null and empty texts have size 0 and are in step with
    their source. A null source is one of its own. An empty table gives none.
    """
    rows = settled(
        docs.select(
            row_key(doc_id, text).alias("key"),
            F.col(doc_id).alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            word_count(F.col(text)).alias("size"),
            uniform(F.col(doc_id), F.col(text), seed).alias("u"),
        ),
        "sizes",
    )
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    full = F.least(F.col("size"), F.lit(FULL_WORDS))
    sizes = settled(
        rows.groupBy("source").agg(
            F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"), F.sum(F.col("size") * full).alias("full_size")
        ),
        "sources",
    )
    shares = sizes.select("source", (F.col("full_size") / F.greatest("source_size", F.lit(1)) / FULL_WORDS).alias("mean_full"))
    plan = settled(
        targets(sizes.drop("full_size"), weights, share).alias("t").join(shares.alias("h"), same("t", "h")).select("t.*", "mean_full")
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("buckets", F.ceil(F.col("n_docs") / BUCKET_DOCS)),
        "targets",
    )
    mean = F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(0.0)
    own = F.col("mean") + F.col("mean") * (1 - F.col("mean")) * (full / F.lit(float(FULL_WORDS)) - F.col("mean_full"))
    inner = lambda p: F.least(F.greatest(p, F.lit(LEAST_CHANCE)), F.lit(1 - LEAST_CHANCE))
    odds = lambda p: p / (1 - p)
    ranked = (
        rows.alias("d")
        .join(plan.alias("p"), same("d", "p"))
        .select("d.*", "n_docs", "source_size", "target", "whole", "rest", "buckets", "mean_full", mean.alias("mean"))
        .withColumn("chance", F.when(F.col("mean") > 0, inner(own)))
        .withColumn("rank", odds(F.col("u")) / odds(F.col("chance")))
        # what u would be in a source of equal chances: it grows with the rank
        .withColumn("level", F.col("rank") * odds(inner(F.col("mean"))))
        .withColumn("bucket", F.least(F.floor(F.col("level") / (1 + F.col("level")) * F.col("buckets")), F.col("buckets") - 1))
    )
    drawn = ranked.where("chance IS NOT NULL")
    upto = Window.partitionBy("source").orderBy("bucket")
    sums = drawn.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    ends = (
        sums.withColumn("before", F.sum("words").over(upto) - F.col("words"))
        .where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
        .select("source", F.col("bucket").alias("end"), "before")
    )
    last = (
        drawn.alias("d").join(ends.alias("e"), same("d", "e") & (F.col("bucket") == F.col("end")))
        .groupBy("d.source", "key", "before", "rest").agg(F.sum("size").alias("words"), F.min("rank").alias("rank"))
    )
    order = Window.partitionBy("source").orderBy("rank", "key")
    inside = last.withColumn("upto", F.col("before") + F.sum("words").over(order)).where(F.col("upto") - F.col("words") / 2 <= F.col("rest")).select("key", "source")
    chosen = (
        ranked.alias("d").join(ends.alias("e"), same("d", "e"), "left")
        .join(inside.alias("i"), same("d", "i") & (F.col("d.key") == F.col("i.key")), "left")
        .withColumn("drawn", F.coalesce((F.col("bucket") < F.col("end")) | ((F.col("bucket") == F.col("end")) & F.col("i.key").isNotNull()), F.lit(False)))
    )
    copies = (F.col("whole") + F.col("drawn").cast("long")).cast("long")
    return chosen.select(
        "d.key", "d.doc_id", "d.source", "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"), "chance",
    )


def apply_mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` (with doc_id, text and source), each as often as the mix takes it."""
    copies = mix(docs, seed).where("copies > 0").groupBy("key").agg(F.max("copies").alias("copies"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), row_key("doc_id", "text").alias("key"))
    repeated = keyed.join(copies, "key").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return repeated.select("row.*")
