"""Learning between the rows of a stream, and guards that expire (STM-04, STM-05, STM-06).

``Lessons`` keeps per host what was learned (a value state for the host, a map state per url template) and applies rows in their
order, so a row profits from the one before it in the same micro-batch.  ``Guard`` lets the first event of a key through and the
next only after the key's period; its state is cleared by a timer.  Both run the same code on a stream and on a sorted batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from ..operators.memory import MISSES

ATTEMPT = "host string, ord bigint, mpn string, template string, kind string"
LESSON = ATTEMPT + ", tried boolean, miss bigint, hit bigint, storefront boolean"
#: fixed values: what an attempt may have come to
HIT, MISS, JUNK, CHROME = "hit", "miss", "junk", "chrome"


def learn(host: list[int], path: tuple[int, int], kind: str | None) -> tuple[bool, list[int], tuple[int, int]]:
    """One attempt: was it made, the host's (useful, junk, chrome) after it, the template's (miss, hit) after it.  A template with two
    misses and no hit is not tried again; a page without useful items counts for a storefront."""
    miss, hit = path
    if miss >= MISSES and hit == 0:
        return False, host, path
    useful, junk, chrome = host
    if kind == HIT:
        return True, [useful + 1, junk, chrome], (miss, hit + 1)
    if kind in (JUNK, CHROME):
        return True, [useful, junk + (kind == JUNK), chrome + (kind == CHROME)], (miss, hit + 1)
    return True, host, (miss + (kind == MISS), hit)


def sells(host: list[int]) -> bool:
    """No useful item, and a shop's chrome once or junk twice."""
    useful, junk, chrome = host
    return useful == 0 and (chrome >= 1 or junk >= 2)


class Lessons(StatefulProcessor):
    def init(self, handle) -> None:
        self.host = handle.getValueState("host", "useful bigint, junk bigint, chrome bigint")
        self.paths = handle.getMapState("paths", "template string", "miss bigint, hit bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        host = list(self.host.get()) if self.host.exists() else [0, 0, 0]
        for r in sorted(rows, key=lambda r: (r.ord, r.mpn or "", r.template or "", r.kind or "")):
            name = (r.template or "",)
            path = tuple(self.paths.getValue(name)) if self.paths.containsKey(name) else (0, 0)
            tried, host, after = learn(host, path, r.kind)
            if after != path:
                self.paths.updateValue(name, after)
            yield Row(host=key[0], ord=r.ord, mpn=r.mpn, template=r.template, kind=r.kind, tried=tried, miss=after[0], hit=after[1], storefront=sells(host))
        self.host.update(tuple(host))

    def close(self) -> None:
        pass


def learn_stream(attempts: DataFrame) -> DataFrame:
    """``ATTEMPT`` rows of a stream -> ``LESSON`` rows: what the fetcher knew at each attempt.  Rows of a host have to come in the order
    of ``ord`` between micro-batches; inside one they are sorted.  A host's rows of one micro-batch are held by one task, which the
    source's rate limit bounds.  Needs the RocksDB state store."""
    return attempts.groupBy("host").transformWithState(statefulProcessor=Lessons(), outputStructType=StructType.fromDDL(LESSON), outputMode="Append", timeMode="None")


def _runs(batches: Iterator[pa.RecordBatch], begin: Callable[[], object], step: Callable[[object, dict], dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted rows through a state that begins anew with each key (the first column); one state is held at a time."""
    key, state, fresh = None, None, True
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if fresh or row[batch.schema.names[0]] != key:
                key, state, fresh = row[batch.schema.names[0]], begin(), False
            out.append(step(state, row))
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def learn_batch(attempts: DataFrame) -> DataFrame:
    """``learn_stream`` of a whole table: hosts in sorted partitions, read as runs.  A task holds one host's counters."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(StructType.fromDDL(LESSON))

    def step(state: dict, row: dict) -> dict:
        name = row["template"] or ""
        tried, state["host"], after = learn(state["host"], state["paths"].get(name, (0, 0)), row["kind"])
        state["paths"][name] = after
        return {**row, "tried": tried, "miss": after[0], "hit": after[1], "storefront": sells(state["host"])}

    rows = attempts.select(*[p.split(" ")[0] for p in ATTEMPT.split(", ")])
    ordered = rows.repartition("host").sortWithinPartitions("host", "ord", F.coalesce("mpn", F.lit("")), F.coalesce("template", F.lit("")), F.coalesce("kind", F.lit("")))
    return ordered.mapInArrow(lambda batches: _runs(batches, lambda: {"host": [0, 0, 0], "paths": {}}, step, schema), LESSON)


def _micros(t: datetime) -> int:
    """Microseconds since the epoch of a time with a zone, or of a local one."""
    return (t.astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


class Guard(StatefulProcessor):
    """Passes a key's event if none passed within ``days`` before it."""

    def __init__(self, days: float):
        self.period = timedelta(days=days) // timedelta(microseconds=1)

    def init(self, handle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "micros bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = until = self.until.get()[0] if self.until.exists() else None
        for r in sorted(rows, key=lambda r: r.ts):
            if until is None or _micros(r.ts) >= until:
                until = _micros(r.ts) + self.period
                yield Row(key=key[0], ts=r.ts)
        if until != old:
            self.until.update((until,))
            self.handle.registerTimer(-(-until // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The clock passed a period's end: a key that was not renewed since is forgotten."""
        if self.until.exists() and self.until.get()[0] <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.until.clear()
        yield from ()

    def close(self) -> None:
        pass


def guard_stream(events: DataFrame, days: float = 30, late: str = "1 hour") -> DataFrame:
    """``key, ts`` of a stream -> the events that pass; the clock is the events' own, and state goes when it passes a period's end.
    Events without a time and those later than the watermark are dropped.  Needs the RocksDB state store."""
    seen = events.select("key", "ts").where("ts IS NOT NULL").withWatermark("ts", late)
    return seen.groupBy("key").transformWithState(statefulProcessor=Guard(days), outputStructType=StructType.fromDDL("key string, ts timestamp"), outputMode="Append", timeMode="EventTime")


def guard_batch(events: DataFrame, days: float = 30) -> DataFrame:
    """``key, ts`` -> ``key, ts, passed`` of a whole table, in sorted partitions.  Events without a time never pass."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = events.schema["key"].dataType.simpleString()
    ddl = f"key {kind}, ts timestamp, passed boolean"
    schema, period = to_arrow_schema(StructType.fromDDL(ddl)), timedelta(days=days)

    def step(state: dict, row: dict) -> dict:
        passed = row["ts"] is not None and (state["until"] is None or row["ts"] >= state["until"])
        if passed:
            state["until"] = row["ts"] + period
        return {**row, "passed": passed}

    ordered = events.select("key", "ts").repartition("key").sortWithinPartitions("key", "ts")
    return ordered.mapInArrow(lambda batches: _runs(batches, lambda: {"until": None}, step, schema), ddl)
