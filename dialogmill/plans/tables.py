"""The test tables read as the inputs of this library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEPS_PER_RUN = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 1000) -> DataFrame:
    """A table as a stream of its files, whether it is one file or a folder of them.

    The name is written as a glob, for which Spark takes both.
    """
    return (
        spark.readStream.schema(table(spark, sf_dir, name).schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{sf_dir.rstrip('/')}/{name}.parque[t]")
    )


def spread_small(rows: DataFrame, key: str) -> DataFrame:
    """Spread a small table over the cores before heavy per-row work.

    A table with fewer scan partitions than the cluster has cores would leave
    cores idle; a large one is returned as it is, without a shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(key) if rows.rdd.getNumPartitions() < cores else rows


def style_lines(conversations: DataFrame) -> DataFrame:
    """A turn as a style line: assistant turns are style, the others info."""
    return conversations.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("line_key"),
        F.col("role").alias("speaker"),
        "text",
        F.when(F.col("role") == "assistant", "style").otherwise("info").alias("type"),
    )


def step_log(events: DataFrame) -> DataFrame:
    """Events as steps: each 2000 consecutive events are one run, and every
    step has a raw loss."""
    return events.select(
        F.expr(f"event_id div {STEPS_PER_RUN}").alias("run"),
        (F.col("event_id") % STEPS_PER_RUN + 1).alias("step"),
        F.col("value").alias("loss"),
    )


def logged_steps(events: DataFrame, every: int = 10) -> DataFrame:
    """The same with a loss on every tenth step only, as a trainer logs it."""
    return step_log(events).withColumn("loss", F.when(F.col("step") % every == 0, F.col("loss")))
