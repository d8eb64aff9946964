"""Rows of a small file are the work of many tasks, with the results that they have in one."""

import pytest
from pyspark.sql import functions as F

from partloom import queries_delivery
from partloom.operators import candidates, identity
from partloom.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("made", [tables.catalog_input, lambda spark, sf: queries_delivery._described(spark, sf, {"Series": (F.lit(True), F.col("kind"), "")}), lambda spark, sf: tables.parts(spark, sf, "p_partkey", "p_brand")])
def test_rows_are_dealt_out(spark, monkeypatch, made):
    monkeypatch.setattr(tables, "ROWS_A_TASK", 25)
    counts = [r["count"] for r in made(spark, SF).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == 200 and len(counts) == 8 and max(counts) <= 50


def test_rows_of_one_host_make_their_urls_in_many_tasks(spark):
    rows = spark.range(200).select(F.col("id").alias("row_id"), F.concat(F.lit("PN"), "id").alias("mpn"), F.array(F.lit("maker.com")).alias("domains"))
    counts = [r["count"] for r in candidates.candidate_urls(rows).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == 1200 and len(counts) == 4


def test_a_text_is_made_once_for_all_entries(spark):
    frame = spark.sql("select 'a Kitchen Aid b' s").select(identity.longest_word(F.upper("s"), [("aid", "1"), ("Kitchen Aid", "2")]).alias("v"))
    plan = frame._jdf.queryExecution().analyzed().toString()
    assert frame.first().v == "2" and "upper(" not in plan[plan.index("filter(") :].split("\n")[0]
