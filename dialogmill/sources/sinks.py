"""Dataset output in shards of bounded size, with a size table beside it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARD_BYTES = 2 * 1024**3  # fixed value: shard limit of the reference set-up
TOKEN_COLUMNS = 3  # input_ids, attention_mask, labels
INT_BYTES = 4


def rows_per_shard(length: int, max_bytes: int = SHARD_BYTES, other_bytes: int = 64) -> int:
    """Rows of fixed-length token arrays that fit one shard uncompressed."""
    return max(1, max_bytes // (TOKEN_COLUMNS * INT_BYTES * length + other_bytes))


def write_tokens(
    rows: DataFrame, path: str, length: int, max_bytes: int = SHARD_BYTES, mode: str = "errorifexists"
) -> None:
    """Token rows as parquet; no file holds more than ``max_bytes`` of them."""
    rows.write.mode(mode).option("maxRecordsPerFile", rows_per_shard(length, max_bytes)).parquet(path)


def write_text(
    rows: DataFrame, path: str, max_rows: int = 1_000_000, mode: str = "errorifexists"
) -> None:
    """Rendered texts as JSON lines, ``max_rows`` per file at most."""
    rows.write.mode(mode).option("maxRecordsPerFile", max_rows).json(path)


def _numbered(rows: DataFrame, size: str, max_bytes: int) -> DataFrame:
    """Add ``shard``: the rows of a task in their order, filled up to ``max_bytes`` each.

    A running sum over the task's batches; shards of later tasks have later names. A
    row larger than the bound is a shard of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, shard, used = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            upto = np.cumsum(batch.column(size).to_numpy())
            numbers, at = np.empty(len(upto), np.int64), 0
            while at < len(upto):
                before = upto[at - 1] if at else 0
                end = int(np.searchsorted(upto, before + max_bytes - used, side="right"))
                if end <= at and used:
                    shard, used = shard + 1, 0
                    continue
                end = max(end, at + 1)
                numbers[at:end] = shard
                used, at = used + int(upto[end - 1] - before), end
            names = pa.array([f"{task:06d}-{n:06d}" for n in numbers], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, names], [*batch.schema.names, "shard"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("shard", T.StringType())]))


def write_shards(
    rows: DataFrame,
    path: str,
    order: Sequence[str] = (),
    max_bytes: int = SHARD_BYTES,
    kind: str = "json",
    mode: str = "errorifexists",
) -> None:
    """Rows as JSON lines or parquet in folders ``shard=NNNNNN-NNNNNN`` of one file each.

    The rows of a shard, as JSON lines, take at most ``max_bytes``; only a row above
    that is a larger shard, alone. With ``order``, columns that name a row, reading the
    shards by name and each from its start gives the rows in that order: one
    range exchange, and no task sees more than its range. Without it rows stay
    where they are. A task run again writes the same shards.
    """
    sized = rows.withColumn("_bytes", F.octet_length(F.to_json(F.struct(*rows.columns))).cast("long") + 1)
    if order:
        sized = sized.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = _numbered(sized, "_bytes", max_bytes).drop("_bytes")
    if order:
        # the writer wants the rows of a folder together, and would sort by that alone
        numbered = numbered.sortWithinPartitions("shard", *order)
    numbered.write.mode(mode).partitionBy("shard").format(kind).save(path)


def read_shards(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    """Rows of ``write_shards`` with ``shard`` and ``place``, their place in the whole from 0.

    Shards are counted first, one row each; rows are numbered inside their shard.
    """
    rows = spark.read.schema(f"{schema}, shard string").format(kind).load(path).withColumn("_at", F.monotonically_increasing_id())
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("_n")).select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("shard").orderBy("_at"))
    return rows.withColumn("_inside", inside).join(starts, "shard").withColumn("place", F.col("_start") + F.col("_inside") - 1).drop("_at", "_inside", "_start")


def write_style_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``(speaker, text, type)`` in the form ``read_style_csv`` reads."""
    rows.select("speaker", "text", "type").write.mode(mode).options(
        header=True,
        quote='"',
        escape='"',
        quoteAll=True,
        encoding="UTF-8",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)


def write_metrics(metrics: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A one-row table such as ``vocab_size`` next to the data."""
    metrics.coalesce(1).write.mode(mode).parquet(path)


def write_with_size(rows: DataFrame, path: str, metrics_path: str, name: str, reserved: int = 0, mode: str = "errorifexists") -> int:
    """Rows as parquet, and their number plus ``reserved`` as a one-row table, counted while they are written."""
    seen = Observation(name)
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).parquet(path)
    size = int(seen.get["n"]) + reserved
    write_metrics(rows.sparkSession.range(1).select(F.lit(size).cast("long").alias(name)), metrics_path, mode)
    return size
