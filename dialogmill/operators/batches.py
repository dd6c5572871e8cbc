"""Seeded training order, steps, micro-batches and collation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogmill.operators.tokens import (
    MAX_LENGTH,
    attention_mask,
    masked_labels,
    pad_right,
    truncate,
)
from dialogmill.operators.vocab import SpecialTokens

# The batch settings of the reference set-up.
ROWS_PER_MICRO_BATCH = 2
MICRO_BATCHES_PER_STEP = 16
MAX_STEPS = 2000  # that set-up's cap on steps; no default here

MAX_BROADCAST_SLOTS = 1_000_000
ROWS_PER_BUCKET = 100_000


def order_key(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key.cast("string")))


def batch_plan(
    rows: DataFrame,
    key: str,
    seed: int = 42,
    max_steps: int | None = None,
    epochs: int | None = None,
    micro_rows: int = ROWS_PER_MICRO_BATCH,
    micros: int = MICRO_BATCHES_PER_STEP,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """``(key, epoch, pos, step, micro_batch, slot)`` for each use of a row.

    ``key`` is unique and only ``key`` is read: token arrays join in later.
    Each epoch is ordered by an md5 of seed, epoch and key. No task sorts a
    whole epoch: rows fall into buckets by the leading bits of the md5, which
    spread evenly; the position is the number of rows in earlier buckets, from
    counts, plus the row number in the bucket. Bucket numbers come from the row
    count, read as a scalar subquery, so nothing is counted on the driver.

    Without ``max_steps`` every row is used once in each of ``epochs``, one by
    default; zero of either is an empty plan. With ``max_steps`` the epochs follow from the row count, and buckets past
    the last step are dropped before rows are shuffled: at a large scale a few
    buckets out of thousands remain.
    """
    if max_steps is None and epochs is None:
        epochs = 1
    per_step = micro_rows * micros
    keys = rows.select(key)
    totals = keys.agg(F.count("*").alias("n"))
    n = F.coalesce(totals.scalar(), F.lit(0))
    steps_per_epoch = F.ceil(n / F.lit(per_step))
    n_epochs = (
        F.lit(epochs) if epochs is not None
        else F.ceil(F.lit(max_steps) / F.greatest(steps_per_epoch, F.lit(1)))
    ).cast("int")
    n_buckets = F.ceil(n / F.lit(rows_per_bucket))

    uses = keys.withColumn("epoch", F.explode(F.when(n_epochs > 0, F.sequence(F.lit(0), n_epochs - 1))))
    hashed = uses.withColumn("_h", order_key(seed, F.col("epoch"), F.col(key)))
    # 40 bits of the hash times the bucket count stays inside a long up to 2^22 buckets
    top = F.conv(F.substring("_h", 1, 10), 16, 10).cast("long")
    # never null; saying so spares the joins a null check that hashes again
    bucket = F.coalesce(F.shiftright(top * n_buckets, 40), F.lit(0))
    bucketed = hashed.withColumn("_bucket", bucket)

    before = Window.partitionBy("epoch").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = bucketed.groupBy("epoch", "_bucket").agg(F.count("*").alias("_n"))
    offsets = counts.select(
        "epoch", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    if max_steps is not None:
        offsets = offsets.filter(
            F.col("epoch") * steps_per_epoch + F.floor(F.col("_offset") / per_step) < max_steps
        )
        # every bucket left starts at another slot below the cap
        if max_steps * per_step <= MAX_BROADCAST_SLOTS:
            offsets = F.broadcast(offsets)

    inside = Window.partitionBy("epoch", "_bucket").orderBy("_h", key)
    placed = bucketed.join(offsets, ["epoch", "_bucket"]).withColumn(
        "pos", F.col("_offset") + F.row_number().over(inside) - 1
    )
    within = F.col("pos") % per_step
    plan = placed.select(
        key,
        "epoch",
        "pos",
        (F.col("epoch") * steps_per_epoch + F.floor(F.col("pos") / per_step)).cast("long").alias("step"),
        F.floor(within / micro_rows).cast("int").alias("micro_batch"),
        (within % micro_rows).cast("int").alias("slot"),
    )
    return plan if max_steps is None else plan.filter(F.col("step") < max_steps)


def planned_rows(
    rows: DataFrame, plan: DataFrame, key: str, max_steps: int | None = None,
    rows_per_step: int = ROWS_PER_MICRO_BATCH * MICRO_BATCHES_PER_STEP,
) -> DataFrame:
    """Rows the plan uses, once each, with their places in ``uses``.

    Tokenize after this: rows beyond the step cap are gone, and a row used in
    many epochs is encoded once. A capped plan has at most ``max_steps *
    rows_per_step`` entries and is broadcast; without a cap both sides shuffle.
    """
    uses = plan.groupBy(key).agg(
        F.collect_list(F.struct("step", "micro_batch", "slot")).alias("uses")
    )
    if max_steps is not None and max_steps * rows_per_step <= MAX_BROADCAST_SLOTS:
        uses = F.broadcast(uses)
    return rows.join(uses, key)


def collate(
    used: DataFrame,
    special: SpecialTokens = SpecialTokens(),
    length: int = MAX_LENGTH,
    mask_by: str = "id",
    laid_out: bool = False,
) -> DataFrame:
    """One record per micro-batch, ``(step, micro_batch, rows)``, from rows with
    ``uses`` and ``ids``.

    With ``laid_out`` a row has one use, whose ``step`` and ``micro_batch`` are columns
    too, by which storage may have put the rows together already.

    Only the unpadded ids are shuffled; padding, mask and labels follow from
    them afterwards. A group has as many rows as a micro-batch has slots.
    """
    if laid_out:
        placed = used.select("step", "micro_batch", "ids", F.col("uses")[0].alias("_use"))
    else:
        placed = used.select("ids", F.explode("uses").alias("_use")).select("_use.step", "_use.micro_batch", "ids", "_use")
    gathered = (
        placed.groupBy("step", "micro_batch")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(F.col("_use.slot").alias("slot"), truncate(F.col("ids"), length).alias("ids"))
                )
            ).alias("rows")
        )
    )

    def pad(row: Column) -> Column:
        ids = row["ids"]
        return F.struct(
            row["slot"].alias("slot"),
            pad_right(ids, special.pad_id, length).alias("input_ids"),
            attention_mask(ids, length).alias("attention_mask"),
            masked_labels(ids, special.pad_id, length, mask_by).alias("labels"),
        )

    return gathered.withColumn("rows", F.transform("rows", pad))
