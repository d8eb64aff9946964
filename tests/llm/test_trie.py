"""The conversation trie against sets of whole prefixes, and the query against SQL."""

import random

import duckdb
import pytest

from partloom.llm import trie

SF = "/root/testdata/sf0.001"
COLUMNS = [f.split(" ")[0] for f in trie.NODES.split(", ")]


def rows(frame):
    return sorted(map(tuple, frame.select(*COLUMNS).collect()), key=str)


@pytest.fixture(scope="module")
def turns():
    r = random.Random(2)
    out = [(c, t, r.choice(["user", "assistant", None, ""]), r.choice(["a", "bb", None, "é", ""])) for c in range(60) for t in range(r.choice([0, 1, 2, 3, 5, 12]))]
    out += [(c, t, "u", "same") for c in range(100, 160) for t in range(14)]  # copies
    out += [(c, t, "u", f"{c % 4}" if t > 12 else "same") for c in range(200, 230) for t in range(16)]  # a long beginning shared
    out += [(c, t, "u", "same") for c in range(300, 320) for t in range(c - 300)]  # a comb
    out += [(None, 1, "u", "x"), (3, None, "u", "first"), (3, None, "u", "first"), (4, 2, "b", "tie"), (4, 2, "a", "tie"), (4, 2, "b", "tie"), (-7, 1, "u", "minus"), (9, 0, "u", "y" * 100000)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("limit", [1 << 16, 40, 3])
def test_prefix_sets(spark, turns, limit):
    """Small limits make containers burst round after round."""
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "'q' AS head", "1 AS size", "2 AS base", "3 AS first").repartition(5)
    assert rows(trie.trie(trie.rebuilt(frame), limit)) == sorted(trie.brute_force(turns), key=str)


def test_turnless_and_empty(spark):
    seqs = spark.createDataFrame([(7, [], []), (2, [], [])], "conv_id long, ids array<string>, sizes array<int>")
    (root,) = rows(trie.trie(seqs))
    assert root[:7] == (2, 0, None, 2, 0, 1, 0)
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.trie(trie.rebuilt(frame)).count() == 0


def test_query(spark):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    got = rows(trie.op13_trie(spark, SF))
    turns = con.sql("select conv_id, turn, role, text from conversations").fetchall()
    assert got == sorted(con.sql(trie.sql()).fetchall(), key=str) == sorted(trie.brute_force(turns), key=str)
