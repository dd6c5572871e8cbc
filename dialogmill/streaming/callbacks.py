"""Begin, step and end actions around a stream."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener


class LifecycleListener(StreamingQueryListener):
    """Calls ``on_begin(name)`` and ``on_end(name, error)`` for named queries."""

    def __init__(
        self,
        on_begin: Callable[[str], None] | None = None,
        on_end: Callable[[str, str | None], None] | None = None,
    ) -> None:
        self._on_begin = on_begin
        self._on_end = on_end
        self._names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        name = event.name or str(event.id)
        self._names[str(event.runId)] = name
        if self._on_begin:
            self._on_begin(name)

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self._names.pop(str(event.runId), str(event.id))
        if self._on_end:
            self._on_end(name, event.exception)


class EventLog(StreamingQueryListener):
    """Begin, step and end of the queries of some names as rows (name, kind, step, n_rows, error).

    A step is a batch that read rows. Events come on a thread of their own, after
    the query has gone on: ``write`` waits for the end of each query that began.
    """

    SCHEMA = "name string, kind string, step long, n_rows long, error string"

    def __init__(self, names: set[str]) -> None:
        self._wanted, self._names, self._open = names, {}, 0
        self._changed = threading.Condition()
        self.rows: list[tuple] = []

    def _add(self, *row, opens: int = 0) -> None:
        with self._changed:
            self.rows.append(row)
            self._open += opens
            self._changed.notify_all()

    def onQueryStarted(self, event) -> None:
        if event.name in self._wanted:
            self._names[str(event.runId)] = event.name
            self._add(event.name, "begin", None, None, None, opens=1)

    def onQueryProgress(self, event) -> None:
        name, rows = self._names.get(str(event.progress.runId)), event.progress.numInputRows
        if name and rows:
            self._add(name, "step", event.progress.batchId, rows, None)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self._names.pop(str(event.runId), None)
        if name:
            self._add(name, "end", None, None, event.exception, opens=-1)

    def write(self, spark: SparkSession, path: str, seconds: float = 60) -> None:
        """Write the events so far as a table; they are a few rows a batch."""
        with self._changed:
            if not self._changed.wait_for(lambda: self.rows and not self._open, seconds):
                raise TimeoutError("a query has not ended")
            rows = list(self.rows)
        spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.parquet(path)


def start_with_callback(
    stream: DataFrame,
    on_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    name: str,
    output_mode: str = "update",
) -> StreamingQuery:
    """Run over what is available now, ``on_batch(rows, batch_id)`` per step.

    A batch can be run again after a failure, so ``on_batch`` has to give the
    same result for the same ``batch_id``.
    """
    return (
        stream.writeStream.foreachBatch(on_batch)
        .outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .queryName(name)
        .trigger(availableNow=True)
        .start()
    )
