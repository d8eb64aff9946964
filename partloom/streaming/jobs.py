"""Structured Streaming forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..dims import Dims
from ..operators import memory
from ..plans.enrich import enrich
from ..sources.state_log import Conflict, StateLog


def enrich_stream(rows: DataFrame, dims: Dims | None = None) -> DataFrame:
    """The batch plan on a stream: without page evidence it holds no state."""
    return enrich(rows, dims)


def start(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch is delivered once per checkpoint; a restarted job goes on where it stopped."""
    writer = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per key and event-time window with a watermark; its state is bounded by the open windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def table_merge(log: StateLog, merge: Callable[[DataFrame, DataFrame], DataFrame], delta: Callable[[DataFrame], DataFrame] | None = None, run: str = "stream", frames: int = 8) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink that merges each micro-batch into a versioned state table.

    The manifest of a version carries the last batch of each ``run``, so a batch that is delivered again is passed over, whether the
    writer died before or after the version was in place, and a run with a new checkpoint goes on from the state that is there
    (name it anew: its batches count from zero).  With ``delta`` (the batch in the state's form, if ``merge`` of states is
    associative) a batch only adds a frame, and every ``frames`` batches the frames are merged into one; readers merge what they read."""

    def sink(batch: DataFrame, number: int) -> None:
        while True:
            base = log.manifest()
            if base["mark"].get(run, -1) >= number:
                return
            mark = {run: number}
            try:
                if delta is not None and len(base["frames"]) < frames:
                    log.commit(delta(batch), base, add=True, mark=mark)
                else:
                    log.commit(merge(log.read(base["version"]), batch if delta is None else delta(batch)), base, mark=mark)
                return
            except Conflict:
                continue

    return sink


DEAD = "host string, template string, miss bigint, hit bigint, dead boolean"


def dead_paths(log: StateLog, version: int | str | None = None) -> DataFrame:
    """The counters of a version: its frames added up."""
    state = log.read(version)
    return memory.merge_counters(state, state.limit(0))


def dead_path_sink(spark: SparkSession, path: str, run: str = "stream", frames: int = 8) -> Callable[[DataFrame, int], None]:
    """Outcomes of a stream added to the dead paths; ``dead_paths`` reads them."""
    return table_merge(StateLog(spark, path, DEAD), memory.merge_counters, memory.dead_paths, run, frames)
