"""Run state kept on a stream of log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogmill.operators.runlog import STOP_LOSS, run_state
from dialogmill.streaming.callbacks import start_with_callback


def stream_run_state(
    log: DataFrame, total: int, folder: str, threshold: float = STOP_LOSS, name: str = "run_state"
) -> None:
    """Process all available rows of the streaming ``log``.

    Each step writes the runs that changed below ``folder``, one sub-folder per
    batch; a batch that is run again replaces its own sub-folder. The state per
    run is four values, and rows are combined before they reach it.
    """

    state = run_state(log, total, threshold)
    # no batch at all is an empty state
    log.sparkSession.createDataFrame([], state.schema).write.parquet(f"{folder}/state/batch_id=-1")

    def save(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/state/batch_id={batch_id}")

    query = start_with_callback(state, save, f"{folder}/checkpoint", name)
    query.awaitTermination()


def latest_state(saved: DataFrame) -> DataFrame:
    """The newest state per run from what ``stream_run_state`` has written."""
    values = [c for c in saved.columns if c not in ("run", "batch_id")]
    return (
        saved.groupBy("run")
        .agg(F.max_by(F.struct(*values), "batch_id").alias("_s"))
        .select("run", "_s.*")
    )
