"""Positions, the version log, shared memory."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from partloom.operators import positions, shared
from partloom.sources.state_log import Conflict, StateLog


@pytest.fixture(scope="module")
def scattered(spark):
    r = random.Random(1)
    rows = [(i, r.choice([None, 1, 1, 1, 2, 3]), r.choice("abc"), r.randint(0, 5)) for i in range(500)] + [(7, 1, "a", 2)] * 40
    return spark.createDataFrame(rows, "id long, k int, t string, v long").repartition(7)


def test_positions(scattered):
    got = positions.numbered(scattered, ["k", F.desc("t")], parts=5).collect()
    assert sorted(r.position for r in got) == list(range(540))
    line = sorted(got, key=lambda r: r.position)
    order = [((r.k is not None), r.k or 0, -ord(r.t)) for r in line]
    assert order == sorted(order)


def test_running_and_budget(scattered):
    line = sorted(positions.running(scattered, ["k", "id"], "v", parts=4).collect(), key=lambda r: (r.running, r.k or 0, r.id))
    assert max(r.running for r in line) == sum(r.v for r in line)
    by = sorted(line, key=lambda r: (r.k is not None, r.k or 0, r.id))
    total = 0
    for r in by:
        total += r.v
        assert r.running == total
    done = positions.budgeted(scattered, ["id"], 10, F.col("t") == "a").collect()
    asked = sorted((r for r in done if r.attempt is not None), key=lambda r: r.attempt)
    assert all(r.t == "a" for r in asked) and [r.attempt for r in asked] == list(range(1, len(asked) + 1)) and sum(r.allowed for r in asked) == 10
    assert all(r.allowed is None for r in done if r.t != "a") and [r.id for r in asked] == sorted(r.id for r in asked)


def test_page_and_empty(scattered):
    assert [positions.page_of(scattered, ["id"], o, 100).count() for o in (0, 500, 540)] == [100, 40, 0]
    empty = scattered.limit(0)
    assert positions.numbered(empty, ["id"]).count() == positions.running(empty, ["id"], "v").count() == 0


def test_no_stage_of_one_task(spark, scattered):
    plan = positions.numbered(scattered, ["id"], parts=4)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


ROWS = "k string, n long"


def rows(log, version=None):
    return sorted(map(tuple, log.read(version).collect()))


def test_versions(spark, tmp_path):
    log = StateLog(spark, str(tmp_path / "t"), ROWS)
    make = lambda *r: spark.createDataFrame(list(r), ROWS)
    assert rows(log) == [] and log.versions() == []
    assert log.activate(make(("seed", 1))) == 0 and log.activate(make(("other", 1))) == 0
    log.commit(make(("a", 1)), log.manifest(), add=True, mark={"batch": 3})
    assert rows(log) == [("a", 1), ("seed", 1)]
    log.snapshot("good")
    stale = log.manifest()
    log.commit(make(("bad", 9)), stale)
    with pytest.raises(Conflict):
        log.commit(make(("late", 1)), stale)
    assert rows(log) == [("bad", 9)]
    log.restore("good")
    assert rows(log) == [("a", 1), ("seed", 1)] and log.manifest()["mark"] == {"batch": 3}
    log.restore(0)
    assert rows(log) == [("seed", 1)]
    # the conflict's frame and the dead writer's are orphans; named versions stay
    spark.createDataFrame([("dead", 1)], ROWS).write.parquet(f"{log.path}/data/orphan")
    gone = log.vacuum(keep=1)
    assert "orphan" in gone and rows(log) == [("seed", 1)] and rows(log, "good") == [("a", 1), ("seed", 1)]
    with pytest.raises(KeyError):
        log.read("no such name")


def test_a_crash_before_the_pointer_changes_nothing(spark, tmp_path, monkeypatch):
    log = StateLog(spark, str(tmp_path / "t"), ROWS)
    log.commit(spark.createDataFrame([("old", 1)], ROWS), log.manifest())
    monkeypatch.setattr(log, "_publish", lambda m: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        log.commit(spark.createDataFrame([("new", 1)], ROWS), log.manifest())
    again = StateLog(spark, str(tmp_path / "t"), ROWS)
    assert rows(again) == [("old", 1)]
    assert again.update(lambda s: s.withColumn("n", F.col("n") + 1)) == 1 and rows(again) == [("old", 2)]


def test_two_writers_lose_nothing(spark, tmp_path):
    schema = shared.TABLES["known_urls"]

    def write(who):
        log = StateLog(spark, str(tmp_path / "known"), schema)
        for i in range(3):
            new = spark.createDataFrame([(f"{who}{i}", "https://a.com/p", 0), ("both", f"https://{who}.com", i)], schema)
            log.update(lambda s, new=new: shared.merge_table("known_urls", s, new))

    writers = [threading.Thread(target=write, args=(w,)) for w in "xy"]
    for w in writers:
        w.start()
    for w in writers:
        w.join(120)
    got = StateLog(spark, str(tmp_path / "known"), schema).read().collect()
    assert {r.mpn for r in got} == {"x0", "x1", "x2", "y0", "y1", "y2", "both"} and len([r for r in got if r.mpn == "both"]) == 2


def merged(spark, name, *sides):
    frames = [spark.createDataFrame(s, shared.TABLES[name]) for s in sides]
    out = shared.merge_table(name, *frames)
    again = shared.merge_table(name, out, frames[1])
    key = lambda d: sorted(map(tuple, d.collect()), key=str)
    if name not in shared.LISTS:
        assert key(out) == key(again)  # a replay changes nothing
    else:
        k = shared.KEYS[name]
        assert key(out.select(*k)) == key(again.select(*k))
    return key(out)


def test_merge_rules(spark):
    assert merged(spark, "rejected", [("color", "x", 1, False), ("size", "1", 5, None)], [("color", "x", 1, True), ("mat", "y", 2, False), ("", "z", 1, True)]) == [("color", "x", 1, True), ("mat", "y", 2, True), ("size", "1", 5, True)]
    assert merged(spark, "dead_paths", [("h", "t", 5, 0), ("h", "u", 1, 1)], [("h", "t", 1, 2)]) == [("h", "t", 1, 2), ("h", "u", 1, 1)]
    assert merged(spark, "storefronts", [("WWW.A.com", 0), ("b.com", 1)], [("a.com ", 0), ("c.com", 1), (None, 2)]) == [("a.com", 0), ("b.com", 1), ("c.com", 3)]
    assert merged(spark, "known_urls", [("m", "u1", 0), ("m", "u2", 1)], [("m", "u2", 0), ("m", "u3", 1)]) == [("m", "u1", 0), ("m", "u2", 1), ("m", "u3", 3)]
    assert merged(spark, "overrides", [("m", "Size", "1", "in")], [("m", "Size", "2", "mm"), ("m", "Size", "2", "mm")]) == [("m", "Size", "2", "mm")]
    base = {"known_urls": spark.createDataFrame([("m", "u", 0)], shared.TABLES["known_urls"])}
    assert set(shared.merge_memory(base, {"storefronts": spark.createDataFrame([("a.com", 0)], shared.TABLES["storefronts"])})) == {"known_urls", "storefronts"}


def test_trim_drops_the_oldest_keys(spark):
    entries = spark.createDataFrame([(f"m{i:02d}", f"https://x.com/{i:02d}/{j}", i * 10 + j) for i in range(20) for j in range(3)], shared.TABLES["known_urls"])
    sizes = {f"m{i:02d}": sum(len(f"m{i:02d}") + len(f"https://x.com/{i:02d}/{j}") + len(str(i * 10 + j)) for j in range(3)) for i in range(20)}
    for most in (0, 200, 10**6):
        kept, room = set(), most
        for m in sorted(sizes, reverse=True):
            room -= sizes[m]
            if room < 0:
                break
            kept.add(m)
        assert {r.mpn for r in shared.trimmed(entries, most).collect()} == kept
