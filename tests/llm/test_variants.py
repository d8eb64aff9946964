"""Spelling variants against all pairs of words, and the query against SQL."""

import random

import duckdb
import pytest

from partloom.llm import common, variants

SF = "/root/testdata/sf0.001"
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def rows(frame):
    return sorted(map(tuple, frame.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("limit", [8192, 5])
def test_all_pairs(spark, limit):
    """Small alphabets make dense shards; a small limit makes shards split down to single letters."""
    r = random.Random(limit)
    words = {"".join(r.choice("abÉ") for _ in range(r.randint(1, 9))): r.randint(1, 40) for _ in range(400)}
    words |= {"x" * 300: 9, "x" * 301: 2, "x" * 150 + "y" + "x" * 149: 1, "zzzzz": 1}
    frame = spark.createDataFrame(list(words.items()), "word string, n long").selectExpr("*", "'q' AS shard", "1 AS masked")
    assert rows(variants.link(frame, limit=limit)) == sorted(variants.links(words), key=str)


def test_pair_in_both_halves_counts_once():
    for rests, short in ((["ab", "abb"], 2), (["aa", "aaa", "a"], 1)):
        plain = [x.bit_count() for x in variants.near_sets(rests[:2], len(rests[0]), False)]
        assert plain == [1, 1]
        assert [x.bit_count() for x in variants.near_sets(rests[:2], len(rests[0]), True)] == [0, 0]


def test_documents(spark):
    texts = [None, "", "123 !?", "Hello HELLO hello hallo hell0 hellö", "hello " * 50 + "helo " * 3, "Überaus überaus ÜBERAUS", "é" * 6 + " " + "e" * 6, "x" * 5000, "x" * 5000, "x" * 5000 + " ×÷×÷×÷ "]
    texts += ["hello hallo halle hölle"] * 8
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "hello hello hellos hellos hellos"), (4, texts[4])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'q' AS word", "1 AS n")
    found = variants.link(variants.counted(variants.runs(frame)))
    assert rows(found) == sorted(variants.brute_force(docs), key=str)
    assert variants.link(variants.counted(variants.runs(frame.limit(0)))).count() == 0


def test_query(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    docs = [tuple(r) for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = rows(variants.op11_variants(spark, SF))
    assert got == sorted(con.sql(variants.sql()).fetchall(), key=str) == sorted(variants.brute_force(docs), key=str)
