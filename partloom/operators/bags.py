"""Duplicates, bags and occurrences.

Occurrence numbers come from a window over the key.  Where only counts matter, the done side is aggregated first, so the
join is one row per key; a hot key's rows are sorted in one task only where its order is the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import mpn
from ..functions.text import strip, text


def occurrences(rows: DataFrame, key: Column, order: str = "row_id", name: str = "occurrence") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(order)))


def pending(rows: DataFrame, done: DataFrame, key: str = "Mfg_Part_Num", order: str = "row_id") -> DataFrame:
    """Rows whose occurrence number exceeds the number of done rows of their key; an empty key is never done."""
    counts = done.select(strip(key).alias("_k")).where("_k <> ''").groupBy("_k").agg(F.count("*").alias("_n"))
    numbered = occurrences(rows.withColumn("_key", strip(key)), F.col("_key"), order, "_occ")
    return numbered.join(counts, numbered["_key"] == counts["_k"], "left").where(F.col("_occ") > F.coalesce("_n", F.lit(0))).select(rows.columns)


def ordered_like(rows: DataFrame, output: DataFrame, key: str = "Mfg_Part_Num", order: str = "row_id", out_order: str = "out_id") -> DataFrame:
    """The n-th output row of a key beside its n-th input row; input rows without one keep null output."""
    left = occurrences(rows.withColumn("_key", strip(key)), F.col("_key"), order, "_occ")
    value = [c for c in output.columns if c != key]
    right = occurrences(output.withColumn("_key2", strip(key)), F.col("_key2"), out_order, "_occ2").select("_key2", "_occ2", F.struct(*value).alias("output"))
    return left.join(right, (F.col("_key") == F.col("_key2")) & (F.col("_occ") == F.col("_occ2")), "left").drop("_key", "_occ", "_key2", "_occ2")


def cluster_key(raw: Column | str) -> Column:
    n = mpn.normalize(raw)
    return F.when(n == "", text(raw)).otherwise(n)


def first_per(rows: DataFrame, key: Column, order: str = "row_id") -> DataFrame:
    """The first row of each key, by a partial aggregation."""
    return rows.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*rows.columns), order).alias("_r")).select("_r.*")


def collapse(rows: DataFrame, columns: list[str], key: str = "Mfg_Part_Num", order: str = "row_id") -> DataFrame:
    """One row per cluster of equal normalised numbers: the fullest row (the first on ties), its empty cells filled from
    the others in order.  Works by aggregates that combine before the shuffle, so a large cluster is no hot task."""
    full = F.size(F.filter(F.array(*[text(c) for c in columns]), lambda v: v != ""))
    base = rows.withColumn("_key", cluster_key(key)).withColumn("_full", full)
    aggs = [F.max_by(c, F.struct("_full", (-F.col(order)).alias("o"))).alias(f"_base_{c}") for c in columns]
    aggs += [F.min_by(c, F.when(text(c) != "", F.col(order))).alias(f"_first_{c}") for c in columns]
    found = base.groupBy("_key").agg(F.max_by(order, F.struct("_full", (-F.col(order)).alias("o"))).alias(order), F.count("*").alias("cluster_size"), *aggs)
    return found.select(F.col("_key").alias("cluster"), order, "cluster_size", *[F.when(text(f"_base_{c}") != "", F.col(f"_base_{c}")).otherwise(text(f"_first_{c}")).alias(c) for c in columns])


def upsert(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows take the place of equal keys; the others stay."""
    return current.join(new.select(key).distinct(), key, "left_anti").unionByName(new.dropDuplicates([key]), allowMissingColumns=True)
