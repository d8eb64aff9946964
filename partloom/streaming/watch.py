"""Callbacks on a running stream: progress by row counts, and an end once enough is settled (UDF-03, STM-07).

The figures are observed metrics, computed by the executors beside the rows; what reaches the driver is one small row per
micro-batch, in ``on_progress``.  ``stop_when`` is asked with the sums so far; when it holds, the stream ends after the micro-batch that
reached it and a restart from its checkpoint goes on from there."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

Totals = dict[str, int]


class Watch(StreamingQueryListener):
    """Sums the observed metrics of one named observation over the micro-batches of a query."""

    def __init__(self, name: str, stop_when: Callable[[Totals], bool] | None, on_progress: Callable[[int, Totals, Totals], None] | None):
        self.name, self.stop_when, self.on_progress = name, stop_when, on_progress
        self.totals: Totals = {}
        self.settled, self.seen = threading.Event(), set()
        self.error: Exception | None = None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        row = progress.observedMetrics.get(self.name)
        if row is None or (progress.runId, progress.batchId) in self.seen:
            return
        self.seen.add((progress.runId, progress.batchId))
        new = {k: v or 0 for k, v in row.asDict().items()}
        for k, v in new.items():
            self.totals[k] = self.totals.get(k, 0) + v
        try:
            if self.on_progress:
                self.on_progress(progress.batchId, new, dict(self.totals))
            if self.stop_when and self.stop_when(dict(self.totals)):
                self.settled.set()
        except Exception as e:  # a callback that fails ends the stream and is raised by run()
            self.error = e
            self.settled.set()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def run(
    rows: DataFrame, metrics: dict[str, Column], start: Callable[[DataFrame], StreamingQuery], stop_when: Callable[[Totals], bool] | None = None, on_progress: Callable[[int, Totals, Totals], None] | None = None,
    name: str = "settled", timeout: float = 600,
) -> Totals:
    """Run a stream with ``metrics`` (aggregates by name) observed on ``rows``; ``start`` adds the sink and starts it.  Returns the sums when
    the stream has ended by itself, by ``stop_when`` or after ``timeout`` seconds."""
    watch = Watch(name, stop_when, on_progress)
    streams = rows.sparkSession.streams
    streams.addListener(watch)
    try:
        query = start(rows.observe(name, *[c.alias(k) for k, c in metrics.items()]))
        waited = 0.0
        while not watch.settled.is_set() and waited < timeout and not query.awaitTermination(0.2):
            waited += 0.2
        if query.isActive:
            query.stop()
        elif query.exception():
            raise query.exception()
        rows.sparkSession.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        streams.removeListener(watch)
    if watch.error:
        raise watch.error
    return watch.totals
