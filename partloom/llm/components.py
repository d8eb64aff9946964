"""Connected components of an edge table, on DataFrames only.

Alternating star contraction: every node's larger neighbours, then its smaller ones, are re-attached to the smallest
node it knows.  Both steps are a partial aggregation and an equi-join, so a hub is pre-aggregated before the shuffle
and its join side can be split.  The number of rounds grows with the logarithm of the component size; each round's
table goes through the reliable checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` -> ``(u, v)``: one row for every node but the smallest of its component, with that smallest node."""
    oriented = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    state, seen = cut(oriented), None
    while True:
        mark = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen or not mark["n"]:
            return state
        seen = mark
        state = cut(_small(_large(state)))
