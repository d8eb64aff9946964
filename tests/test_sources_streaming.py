import pytest
from pyspark.sql import functions as F

from partloom.dims import Dims
from partloom.operators import memory
from partloom.sources import tables
from partloom.sources.state_log import StateLog
from partloom.streaming import jobs


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "in.csv").write_bytes("﻿Mfg_Part_Num, Part_Desc ,x\n A1 ,\"a, b\",\n,,\nB2,c,1\n".encode())
    rows = tables.read_csv_rows(spark, str(tmp_path / "in.csv"))
    assert sorted(map(tuple, rows.collect())) == [("A1", "a, b", ""), ("B2", "c", "1")]
    tables.write_csv_rows(rows.withColumn("Part_Desc", F.lit("ok\x00")), str(tmp_path / "out"), ["Part_Desc", "Mfg_Part_Num", "new"])
    back = tables.read_csv_rows(spark, str(tmp_path / "out"))
    assert back.columns == ["Part_Desc", "Mfg_Part_Num", "new"] and {r[0] for r in back.collect()} == {""}


def test_text_rows(spark):
    got = tables.rows_from_text(spark, ["Mfg_Part_Num,Part_Desc", 'A1,"x, y"', ",", "B2"]).collect()
    assert [(r.row_id, r.Mfg_Part_Num, r.Part_Desc, r.Part_Manuf) for r in got] == [(1, "A1", "x, y", ""), (3, "B2", "", "")]


def test_dictionaries(spark, tmp_path):
    (tmp_path / "aliases.json").write_text('{"Foo": "Trex"}')
    d = Dims.load(spark, str(tmp_path))
    assert d.aliases == {"Foo": "Trex"} and d.hints == Dims().hints and len(d.effective_leaves()) == 16


@pytest.mark.parametrize("body", ["not json", "[1]", "{"])
def test_a_broken_dictionary_is_no_missing_one(spark, tmp_path, body):
    (tmp_path / "hints.json").write_text(body)
    with pytest.raises(ValueError):
        Dims.load(spark, str(tmp_path))


def test_state_survives_repeats_restarts_and_lost_frames(spark, tmp_path):
    path = str(tmp_path / "dead")
    sink = jobs.dead_path_sink(spark, path, frames=2)
    log = StateLog(spark, path, jobs.DEAD)
    batch = spark.createDataFrame([("https://a.com/{mpn}", False)], "template string, ok boolean")
    for number in (0, 1, 1, 0, 2, 3):  # 1 and 0 are delivered again
        sink(batch, number)
    assert jobs.dead_paths(log).first().miss == 4 and len(log.manifest()["frames"]) <= 3
    # a new checkpoint over the same table learns on
    jobs.dead_path_sink(spark, path, run="second")(batch, 0)
    assert jobs.dead_paths(log).first().miss == 5
    # a frame that is gone stops the stream rather than pass for an empty one
    frame = log.manifest()["frames"][0]
    (tmp_path / "dead/data" / frame).rename(tmp_path / "away")
    with pytest.raises(Exception):  # noqa: B017
        [sink(batch, n) or jobs.dead_paths(log).count() for n in (4, 5, 6)]


def test_cache_freshness(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, v string").withColumn("content_hash", tables.content_hash(["k", "v"]))
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    stamped = rows.withColumn("fetched_at", F.when(F.col("k") == "a", F.lit("2024-02-20")).when(F.col("k") == "b", F.lit("2023-01-01")).cast("timestamp"))
    assert [r.k for r in tables.fresh_cache(stamped, ["k", "v"], now).collect()] == ["a"]
    spoiled = stamped.withColumn("v", F.lit("x"))
    assert tables.fresh_cache(spoiled, ["k", "v"], now).count() == 0


def test_workbook(spark):
    cells = spark.createDataFrame([("s", 1, 1, "title"), ("s", 2, 1, "a"), ("s", 2, 2, "b"), ("s", 3, 1, "")], "sheet string, row int, col int, value string")
    assert tables.header_row(cells).first()["header_row"] == 2


def test_taxonomy_union(spark):
    a = spark.createDataFrame([("p", 1, "x"), ("q", 2, "y")], "classpath string, ord int, name string")
    b = spark.createDataFrame([("p", 9, "z")], "classpath string, ord int, name string")
    assert sorted(map(tuple, tables.taxonomy_union(a, b).select("classpath", "ord", "name").collect())) == [("p", 1, "z"), ("q", 2, "y")]


def test_stream_state_equals_batch(spark, tmp_path):
    rows = [(f"https://h{i % 3}.com/p/{{mpn}}", i % 4 == 0) for i in range(40)]
    frame = spark.createDataFrame(rows, "template string, ok boolean")
    for k in range(4):
        frame.where(F.pmod(F.hash("template", "ok"), F.lit(4)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.start(stream, jobs.dead_path_sink(spark, str(tmp_path / "state"), frames=2), str(tmp_path / "checkpoint"))
    q.awaitTermination(120)
    got = jobs.dead_paths(StateLog(spark, str(tmp_path / "state"), jobs.DEAD))
    key = lambda d: sorted((r.host, r.template, r.miss, r.hit, r.dead) for r in d.collect())
    assert key(got) == key(memory.dead_paths(frame))


def test_event_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.write.parquet(str(tmp_path / "e"))
    stream = jobs.event_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("w").agg(F.sum("n")).first()[0] == events.count()


def test_delivery(spark, one):
    from partloom.operators import delivery as D

    rows = spark.createDataFrame([("A", [("Size", "1", "in")])], "normalized_mpn string, slots array<struct<label:string,value:string,uom:string>>")
    saved = spark.createDataFrame([("A", 1, "size", "2", "in"), ("A", 2, "Size", "3", "mm"), ("A", 3, "New", "x", "")], "normalized_mpn string, ord int, label string, value string, uom string")
    assert [tuple(s) for s in D.replay_overrides(rows, saved).first()["slots"]] == [("Size", "3", "mm"), ("New", "x", "")]
    assert one(D.display_source(F.lit("input:x"), F.lit("https://a.com/search?q=1"), F.lit("https://a.com/p"))) == "https://a.com/p"
    assert one(D.property_field(F.lit("arbor size"))) == "Arbor Size" and one(D.property_field(F.lit("GTIN-13"))) == ""
    assert one(D.parse_issue(F.lit("a: b: c")))["message"] == "b: c"
    assert '"completeness_pct":0.4' in one(D.preview({"a": F.lit("x"), "b": F.lit("")}))
    c = spark.createDataFrame([("m", f"https://a.com/p/{i}", i) for i in range(9)] + [("m", f"https://a.com/search?q={i}", 20 + i) for i in range(4)], "mpn string, url string, ord int")
    kept = [r.url for r in D.first_fetches(c).collect()]
    assert len(kept) == 8 and sum("search" in u for u in kept) == 2
    a = spark.createDataFrame([("XX-ABC12-Y", 1), ("Q", 2)], "mpn string, v int")
    e = spark.createDataFrame([("ABC12",), ("Q",), ("nope1",)], "mpn string")
    assert {(r.mpn, r.v) for r in D.substring_match(a, e).collect()} == {("ABC12", 1), ("Q", 2)}
    p = spark.createDataFrame([(1, "mined", 5, "x"), (1, "official", 1, "y"), (1, "official", 2, "z")], "k int, origin string, mtime int, v string")
    assert D.precedence(p, "k", {"mined": 0, "official": 1}).first()["v"] == "z"
    k = D.run_key(a, ["mpn", "v"], "all").first()
    assert k["n"] == 2 and len(k["key"]) == 64 and k == D.run_key(a.orderBy("v"), ["mpn", "v"], "all").first()
