"""Streams that learn between rows, guards that expire, callbacks that end a stream."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from partloom.streaming import learning, watch

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def attempts():
    out = [("a", 1, "m1", "t", "miss"), ("a", 2, "m2", "t", "miss"), ("a", 3, "m3", "t", "hit"), ("a", 4, "m4", "u", "junk"), ("a", 5, "m5", "u", "junk"), ("a", 6, "m6", "u", "hit")]
    out += [("b", i, f"m{i}", "t", k) for i, k in enumerate(["miss", "hit", "miss", "miss", "chrome", None])] + [("c", 1, None, None, "chrome"), (None, 1, "m", "t", "miss")]
    return out


def key(rows):
    return sorted(map(tuple, rows), key=str)


def test_rows_profit_from_the_row_before(spark):
    got = {(r.host, r.ord): r for r in learning.learn_batch(spark.createDataFrame(attempts(), learning.ATTEMPT).repartition(3)).collect()}
    assert len(got) == len(attempts())
    assert [got["a", i].tried for i in range(1, 7)] == [True, True, False, True, True, True]  # two misses: not tried again
    assert [got["a", i].storefront for i in range(1, 7)] == [False, False, False, False, True, False]
    assert all(got["b", i].tried for i in range(6)) and not got["b", 4].storefront  # one useful item is enough
    assert got["c", 1].storefront and got[None, 1].tried


def test_stream_learns_and_restarts(rocks, tmp_path):
    frame = rocks.createDataFrame(attempts(), learning.ATTEMPT)
    want = key(learning.learn_batch(frame).collect())
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for part in (F.col("ord") <= 3, F.col("ord") > 3):  # the second part after a restart
        frame.where(part).coalesce(1).write.mode("append").parquet(source)
        stream = learning.learn_stream(rocks.readStream.schema(frame.schema).parquet(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    assert key(rocks.read.parquet(out).collect()) == want


def test_guard_expires_with_the_clock(rocks, tmp_path):
    t0 = datetime(2024, 1, 1)
    days = {"a": [0, 1, 29, 31, 60.5, 61.5], "b": [0], "c": [40, 41]}
    rows = [(k, t0 + timedelta(days=d)) for k, v in days.items() for d in v]
    frame = rocks.createDataFrame(rows, "key string, ts timestamp")
    passed = lambda rows: sorted((r.key, (r.ts - t0) / timedelta(days=1)) for r in rows)
    want = [("a", 0.0), ("a", 31.0), ("a", 61.5), ("b", 0.0), ("c", 40.0)]
    assert passed(learning.guard_batch(frame.repartition(3)).where("passed").collect()) == want
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for low, high in ((0, 20), (20, 45), (45, 99)):  # the clock moves with each part
        at = F.col("ts").between(F.lit(t0 + timedelta(days=low)), F.lit(t0 + timedelta(days=high)))
        frame.where(at).coalesce(1).write.mode("append").parquet(source)
        stream = learning.guard_stream(rocks.readStream.schema(frame.schema).parquet(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    assert passed(rocks.read.parquet(out).collect()) == want


def test_a_stream_stops_once_settled(spark, tmp_path):
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_partkey", "p_size")
    parts.repartition(10).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []

    def start(rows):
        return rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(processingTime="1 second").start()

    metrics = {"rows": F.count("*"), "settled": F.count_if(F.col("p_size") > 0)}
    totals = watch.run(stream, metrics, start, lambda t: t["settled"] >= 50, lambda n, new, total: seen.append((n, new["rows"], total["rows"])), timeout=120)
    assert 50 <= totals["settled"] < 200 and seen and seen[-1][2] <= totals["rows"]
    # a restart goes on where the stop was; without a condition the stream ends by itself
    rest = watch.run(stream, metrics, lambda r: r.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start(), timeout=120)
    assert spark.read.parquet(str(tmp_path / "out")).select("p_partkey").distinct().count() == 200 and rest["rows"] >= 200 - totals["rows"] - 40


def test_a_failing_callback_is_raised(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))

    def broken(*_):
        raise ValueError("no")

    with pytest.raises(ValueError):
        watch.run(stream, {"n": F.count("*")}, lambda r: r.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "m")).trigger(availableNow=True).start(), on_progress=broken, timeout=60)
