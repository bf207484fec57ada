"""Metrics that are collected while a job runs: no second pass over the rows, and no file a step."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "step long, name string, value double"


def reducing(value: Column, name: str) -> Column:
    """The aggregate of a metric of this name: the maximum where it holds ``max``, else the minimum where it holds
    ``min``, else the mean."""
    return F.max(value) if "max" in name else F.min(value) if "min" in name else F.avg(value)


class MetricLog:
    """Appends rows (step, name, value) to a Parquet table, ``flush_rows`` or more in a file but for the last.

    ``watch`` names aggregates of the rows of one step; they are computed by whatever job reads these rows next, and
    are picked up when the log is flushed. ``follow`` does the same for a stream, whose micro-batches are the steps. Rows
    that no one reads give no metrics. Null values are left out. Use as a context, or call ``close``.
    """

    def __init__(self, spark: SparkSession, path: str, flush_rows: int = 10_000):
        self.spark, self.path, self.flush_rows = spark, path, flush_rows
        self.rows: list[tuple[int, str, float]] = []
        self.open: list[tuple[int, Observation, threading.Thread, dict]] = []
        self.lock = threading.Lock()
        self.listener: _Progress | None = None
        self.streams: dict[str, dict[int, dict]] = {}

    def watch(self, rows: DataFrame, step: int, **metrics: Column) -> DataFrame:
        seen, got = Observation(), {}
        observed = rows.observe(seen, *(c.alias(n) for n, c in metrics.items()))
        waiting = threading.Thread(target=lambda: got.update(seen.get), daemon=True)  # ``get`` waits for the job
        waiting.start()
        self.open.append((step, seen, waiting, got))
        self._written(self.flush_rows)
        return observed

    def follow(self, rows: DataFrame, stream: str, **metrics: Column) -> DataFrame:
        """``stream`` is a name of its own; what arrives is logged under the micro-batch's number."""
        if self.listener is None:
            self.listener = _Progress(self)
            self.spark.streams.addListener(self.listener)
        self.streams[stream] = {}
        return rows.observe(stream, *(c.alias(n) for n, c in metrics.items()))

    def arrived(self, stream: str, batch: int, values: dict) -> None:
        with self.lock:
            self.streams[stream][batch] = values  # a batch that ran again counts once

    def _gather(self, wait: float) -> None:
        left = []
        for step, seen, waiting, got in self.open:
            waiting.join(wait)
            if waiting.is_alive():
                left.append((step, seen, waiting, got))
            else:
                self._add(step, got.items())
        self.open = left
        with self.lock:
            for batches in self.streams.values():
                for batch in sorted(batches):
                    self._add(batch, batches.pop(batch).items())

    def _add(self, step: int, values: Iterable[tuple[str, object]]) -> None:
        self.rows += [(step, n, float(v)) for n, v in values if v is not None]

    def _written(self, least: int, wait: float = 0.0) -> None:
        self._gather(wait)
        if len(self.rows) >= max(1, least):
            self.spark.createDataFrame(self.rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
            self.rows = []

    def flush(self, wait: float = 2.0) -> None:
        """Writes what has come in; waits up to ``wait`` seconds for a step whose job has just ended."""
        self._written(1, wait)

    def settle(self, stream: str, batches: int, seconds: float = 30.0) -> None:
        """Waits until a stream's listener has been told of so many batches: progress comes after the batch."""
        end = time.time() + seconds
        while time.time() < end and len(self.streams.get(stream, {})) < batches:
            time.sleep(0.05)

    def close(self) -> None:
        self.flush()
        if self.listener is not None:
            self.spark.streams.removeListener(self.listener)
            self.listener = None

    def __enter__(self) -> MetricLog:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class _Progress(StreamingQueryListener):
    def __init__(self, log: MetricLog):
        self.log = log

    def onQueryStarted(self, event) -> None:  # noqa: N802
        return None

    def onQueryProgress(self, event) -> None:  # noqa: N802
        for name, row in event.progress.observedMetrics.items():
            if name in self.log.streams and event.progress.numInputRows:
                self.log.arrived(name, event.progress.batchId, row.asDict())

    def onQueryIdle(self, event) -> None:  # noqa: N802
        return None

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        return None
