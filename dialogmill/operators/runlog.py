"""Analysis of training logs ``(run, step, loss)``; ``(run, step)`` is a key.

``loss`` is null on steps that were not logged. One run may hold most of the
rows: whatever needs an order works on blocks of ``STEPS_PER_BLOCK`` steps,
whose size the key bounds, plus a summary with one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogmill.functions.progress import final_line, progress_fraction, status_line

# Log interval and stop threshold of the reference set-up.
LOG_EVERY = 10
STOP_LOSS = 0.26

STEPS_PER_BLOCK = 65_536


def _block(steps: int) -> Column:
    return F.expr(f"step div {int(steps)}")


def _logged_step() -> Column:
    return F.when(F.col("loss").isNotNull(), F.col("step"))


def loss_blocks(log: DataFrame, every: int = LOG_EVERY) -> DataFrame:
    """Mean loss per tumbling block of steps, labelled with the block's last step."""
    return (
        log.groupBy("run", (F.ceil(F.col("step") / every) * every).cast("long").alias("block_end"))
        .agg(F.avg("loss").alias("mean_loss"), F.count("loss").alias("n"))
    )


def loss_asof(log: DataFrame, steps_per_block: int = STEPS_PER_BLOCK) -> DataFrame:
    """Add ``loss_seen``: the newest loss logged before each step.

    A step is checked before its own loss is logged, so the frame ends at the
    row before. Inside a block a window answers; the value carried in from
    earlier blocks comes from the block summary.
    """
    rows = log.select("run", "step", "loss").withColumn("_block", _block(steps_per_block))
    inside = (
        Window.partitionBy("run", "_block").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier = Window.partitionBy("run").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy("run", "_block")
        .agg(F.max_by("loss", _logged_step()).alias("_last"))
        .select("run", "_block", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    )
    return (
        rows.withColumn("_seen", F.last("loss", ignorenulls=True).over(inside))
        .join(carried, ["run", "_block"], "left")
        .select("run", "step", "loss", F.coalesce("_seen", "_carried").alias("loss_seen"))
    )


def loss_series(
    log: DataFrame, loss: str = "loss", steps_per_block: int = STEPS_PER_BLOCK
) -> DataFrame:
    """``(run, block, first_idx, points)``: the loss curve in step order.

    ``points`` is an array of ``(step, loss)`` without null losses. A run of
    ordinary length is one row; a longer one continues in the next block, and
    ``first_idx`` is the place of a block's first point in the whole curve.
    """
    points = log.select(
        "run", _block(steps_per_block).alias("block"), "step", F.col(loss).alias("loss")
    ).filter(F.col("loss").isNotNull() & F.col("run").isNotNull() & F.col("block").isNotNull())
    arrays = points.groupBy("run", "block").agg(
        F.array_sort(F.collect_list(F.struct("step", "loss"))).alias("points")
    )
    # sizes come from the arrays, not from another pass over the log: Spark then
    # shuffles once and reads that shuffle twice
    earlier = Window.partitionBy("run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = arrays.select("run", "block", F.size("points").alias("_n")).select(
        "run", "block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("first_idx")
    )
    return arrays.join(starts, ["run", "block"], "left").select("run", "block", "first_idx", "points")


def series_rows(series: DataFrame) -> DataFrame:
    """The curve as rows ``(run, idx, step, loss)``."""
    return series.select(
        "run", "first_idx", F.posexplode("points").alias("_i", "_p")
    ).select(
        "run",
        (F.col("first_idx") + F.col("_i")).alias("idx"),
        F.col("_p.step").alias("step"),
        F.col("_p.loss").alias("loss"),
    )


def chart_json(series: DataFrame) -> DataFrame:
    """Add ``chart``: x and y arrays as JSON, for a line chart."""
    line = F.struct(
        F.col("points.step").alias("x"), F.col("points.loss").alias("y"), F.lit("line").alias("type")
    )
    return series.withColumn("chart", F.to_json(F.struct(F.array(line).alias("data"))))


def early_stop(log: DataFrame, threshold: float = STOP_LOSS) -> DataFrame:
    """Per run: the step that logged a loss at or below the threshold first,
    the step that saw it (the next one, if the run has it), and the last step."""
    logged = F.min(F.when(F.col("loss") <= threshold, F.col("step")))
    return (
        log.groupBy("run")
        .agg(logged.alias("stop_logged_step"), F.max("step").alias("last_step"))
        .select(
            "run",
            "stop_logged_step",
            F.when(
                F.col("stop_logged_step") < F.col("last_step"), F.col("stop_logged_step") + 1
            ).alias("stop_seen_step"),
            "last_step",
        )
    )


def steps_until_stop(log: DataFrame, threshold: float = STOP_LOSS) -> DataFrame:
    """The log rows a run has executed when it stops early."""
    stops = early_stop(log, threshold).select("run", "stop_seen_step")
    return (
        log.join(stops, ["run"])
        .filter(F.col("stop_seen_step").isNull() | (F.col("step") <= F.col("stop_seen_step")))
        .drop("stop_seen_step")
    )


def final_loss(log: DataFrame, tracked: str | None = None) -> DataFrame:
    """Newest logged loss per run, else the newest ``tracked`` value, else null."""
    newest = F.max_by("loss", _logged_step())
    if tracked is not None:
        fallback = F.max_by(tracked, F.when(F.col(tracked).isNotNull(), F.col("step")))
        newest = F.coalesce(newest, fallback)
    return log.groupBy("run").agg(newest.alias("final_loss")).withColumn(
        "status", final_line(F.col("final_loss"))
    )


def latest_stage(writes: DataFrame, order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """The last ``(stage, progress)`` written per run."""
    newest = F.max_by(F.struct("stage", "progress"), F.struct(*order))
    return (
        writes.groupBy("run").agg(newest.alias("_s")).select("run", "_s.stage", "_s.progress")
    )


def run_progress(log: DataFrame, total: int) -> DataFrame:
    return log.withColumn("progress", progress_fraction(F.col("step"), total))


def run_status(seen: DataFrame, total: int) -> DataFrame:
    """Status line of each step at which a loss is known (from ``loss_asof``)."""
    return seen.filter(F.col("loss_seen").isNotNull()).select(
        "run", "step", status_line(F.col("step"), total, F.col("loss_seen")).alias("status")
    )


def run_state(log: DataFrame, total: int, threshold: float = STOP_LOSS) -> DataFrame:
    """Where each run stands. Order of arrival does not matter, so the same
    aggregation serves batch tables and streams."""
    return (
        log.groupBy("run")
        .agg(
            F.max("step").alias("current_step"),
            F.max_by("loss", _logged_step()).alias("last_loss"),
            F.min(F.when(F.col("loss") <= threshold, F.col("step"))).alias("stop_logged_step"),
        )
        .withColumn("progress", progress_fraction(F.col("current_step"), total))
    )
