"""Streams of log rows that need an order or a fresh start, kept in state of their own.

Both processors need the RocksDB state store, which is set for the query they start.
Only the columns named here reach Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from dialogmill.functions.progress import progress_fraction
from dialogmill.operators.runlog import STOP_LOSS
from dialogmill.streaming.callbacks import start_with_callback

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _run_to_end(stream: DataFrame, folder: str, what: str, name: str, mode: str = "update") -> None:
    """Write what each batch gives below ``folder/what``; a batch run again replaces its own sub-folder."""
    stream.sparkSession.createDataFrame([], stream.schema).write.parquet(f"{folder}/{what}/batch_id=-1")

    def save(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/{what}/batch_id={batch_id}")

    start_with_callback(stream, save, f"{folder}/checkpoint", name, mode).awaitTermination()


def _none(value) -> float | None:
    return None if pd.isna(value) else float(value)


class _Attempts(StatefulProcessor):
    """State of the newest attempt of a run; step 1 begins another one, which starts empty."""

    def __init__(self, threshold: float, expire_ms: int | None) -> None:
        self.threshold, self.expire_ms = threshold, expire_ms

    def init(self, handle) -> None:
        self.handle = handle
        schema = "seq long, attempt long, step long, loss_step long, loss double, stop long, late long, due long"
        self.state = handle.getValueState("attempt", schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values("seq", kind="stable")
        seen = self.state.get() if self.state.exists() else None
        seq, attempt, step, loss_step, loss, stop, late, due = seen or (None, 0, 0, None, None, None, 0, None)
        if self.expire_ms is not None:
            due = max(due or 0, int(got["ms"].max()) + self.expire_ms)
            self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))
        if seq is not None:
            late += int((got["seq"] <= seq).sum())
            got = got[got["seq"] > seq]
        if len(got):
            begins = got["step"] == 1
            if begins.any():
                attempt += int(begins.sum())
                step, loss_step, loss, stop = 0, None, None, None
                got = got[got["seq"] >= got.loc[begins, "seq"].max()]
            seq, step = int(got["seq"].max()), max(step, int(got["step"].max()))
            logged = got[got["loss"].notna()]
            if len(logged):
                newest = logged.loc[logged["step"].idxmax()] if logged["step"].is_unique else logged.sort_values("step").iloc[-1]
                if loss_step is None or newest["step"] > loss_step:
                    loss_step, loss = int(newest["step"]), float(newest["loss"])
                low = logged.loc[logged["loss"] <= self.threshold, "step"]
                if len(low):
                    stop = int(low.min()) if stop is None else min(stop, int(low.min()))
        self.state.update((seq, attempt, step, loss_step, loss, stop, late, due))
        yield pd.DataFrame(
            {"run": [key[0]], "attempt": [attempt], "current_step": [step], "last_loss": [loss],
             "stop_logged_step": pd.array([stop], "Int64"), "n_late": [late]}
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # rows may have come since the timer was set
        if self.state.exists() and self.state.get()[7] <= timerValues.getCurrentWatermarkInMs():
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_attempts(
    log: DataFrame,
    total: int,
    folder: str,
    threshold: float = STOP_LOSS,
    expire_hours: float | None = None,
    delay: str = "0 seconds",
    name: str = "attempts",
) -> None:
    """Follow runs on a stream of (run, seq, step, loss), a run id being used again for each new attempt.

    ``seq`` orders the rows of a run and is unique in it. A row of step 1 begins an
    attempt: what was known of the run is forgotten. Writes the runs that changed as
    (run, attempt, current_step, last_loss, stop_logged_step, n_late, progress) below
    ``folder/attempts``. Rows may come in any order within a batch. Those that come
    after later ones of their run were handled change nothing and are counted in ``n_late``. State is
    eight numbers a run. With ``expire_hours`` the log has a time ``ts`` too, and the state of a run
    goes when the watermark, ``delay`` behind the newest row of any run, is that far past the run's
    own; what comes later begins empty. A batch's narrow rows of one run are held at
    once; the files of a trigger bound them.
    """
    expire = None if expire_hours is None else int(expire_hours * 3_600_000)
    timed = log if expire is None else log.withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts"))
    rows = timed.select(
        F.col("run").cast("long"), F.col("seq").cast("long"), F.col("step").cast("long"), F.col("loss").cast("double"), *([] if expire is None else ["ms", "ts"])
    )
    schema = "run long, attempt long, current_step long, last_loss double, stop_logged_step long, n_late long"
    followed = rows.groupBy("run").transformWithStateInPandas(_Attempts(threshold, expire), schema, "update", "None" if expire is None else "EventTime")
    with _state_store(log.sparkSession):
        _run_to_end(followed.withColumn("progress", progress_fraction(F.col("current_step"), total)), folder, "attempts", name)


def latest_attempts(log: DataFrame, total: int, threshold: float = STOP_LOSS) -> DataFrame:
    """The same of a table: rows (run, attempt, current_step, last_loss, stop_logged_step, progress)."""
    begins = log.groupBy("run").agg(F.max(F.when(F.col("step") == 1, F.col("seq"))).alias("_begin"), F.count_if(F.col("step") == 1).alias("attempt"))
    own = log.join(begins, "run").where("_begin IS NULL OR seq >= _begin")
    logged = F.when(F.col("loss").isNotNull(), F.col("step"))
    return (
        own.groupBy("run")
        .agg(
            F.max("attempt").alias("attempt"),
            F.max("step").alias("current_step"),
            F.max_by("loss", logged).alias("last_loss"),
            F.min(F.when(F.col("loss") <= threshold, F.col("step"))).alias("stop_logged_step"),
        )
        .withColumn("progress", progress_fraction(F.col("current_step"), total))
    )


class _AsOf(StatefulProcessor):
    """Rows wait until the watermark has passed them and then leave in the order of their steps."""

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, step long, loss double")
        self.known = handle.getValueState("known", "loss double, stopped boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            found = [(int(ms), int(step), _none(loss)) for ms, step, loss in zip(batch["ms"], batch["step"], batch["loss"])]
            if found:
                self.waiting.appendList(found)
                least = min(ms for ms, _, _ in found)
                first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(max(first, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs()
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted((r for r in rows if r[0] <= upto), key=lambda r: r[1])
        later = [r for r in rows if r[0] > upto]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(r[0] for r in later))
        elif rows:
            self.waiting.clear()
        if not ready:
            return
        loss, stopped = self.known.get() if self.known.exists() else (None, False)
        seen, stops = [], []
        for _, _, own in ready:
            stop = not stopped and loss is not None and loss <= self.threshold
            seen.append(loss)
            stops.append(stop)
            stopped = stopped or stop
            loss = loss if own is None else own
        self.known.update((loss, stopped))
        yield pd.DataFrame(
            {"run": [key[0]] * len(ready), "step": [r[1] for r in ready], "loss": pd.Series([r[2] for r in ready], dtype=float),
             "loss_seen": pd.Series(seen, dtype=float), "stops": stops}
        )

    def close(self) -> None:
        pass


def stream_loss_asof(log: DataFrame, folder: str, delay: str, threshold: float = STOP_LOSS, name: str = "loss_asof") -> None:
    """Loss as of each step on a stream of (run, step, loss, ts), for files that come late or out of order.

    ``ts`` rises with the step in a run. Rows wait in state until nothing older than
    ``delay`` can come, as the watermark tells, and are then given in order, each once, as (run,
    step, loss, loss_seen, stops) below ``folder/asof``. ``stops`` is the first
    step of a run that sees a loss of at most ``threshold``. Rows later than the
    delay are left out. Rows newer than the last watermark stay in state
    for the next start; a row of any run with a later ``ts`` lets them go.
    """
    rows = log.withWatermark("ts", delay).select(
        F.col("run").cast("long"), F.col("step").cast("long"), F.col("loss").cast("double"), "ts", F.unix_millis("ts").alias("ms")
    )
    schema = "run long, step long, loss double, loss_seen double, stops boolean"
    ordered = rows.groupBy("run").transformWithStateInPandas(_AsOf(threshold), schema, "append", "EventTime")
    with _state_store(log.sparkSession):
        _run_to_end(ordered, folder, "asof", name, "append")

