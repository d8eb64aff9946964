"""Reports over catalogue rows: aggregates with partial combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import PLACEHOLDERS, strip, text


def pct(n: Column, of: Column) -> Column:
    return F.when(of > 0, F.round(n / of * 100, 2))


def summary(reports: DataFrame) -> DataFrame:
    """rows, averages and the share of rows with issues from ``(filled, evidence, band, issues)``."""
    b = lambda k: F.count_if(F.col("band") == k).alias(f"band_{k}")
    return reports.agg(F.count("*").alias("n_rows"), F.round(F.avg("filled"), 2).alias("avg_filled"), F.round(F.avg("evidence"), 2).alias("avg_evidence"), *map(b, ("high", "medium", "low", "review")), F.count_if(F.col("n_issues") > 0).alias("rows_with_issues"))


def coverage(rows: DataFrame, category: str = "category_id", fallback: str = "generic_industrial") -> DataFrame:
    total = rows.groupBy(category).agg(F.count("*").alias("n")).withColumn("routed", F.col(category) != fallback)
    return total


def char_limits(rows: DataFrame, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """Per description: populated, over, under, compliant share and the longest text."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), text(k).alias("v"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for k, (lo, hi) in limits.items()])).alias("x")).select("x.*").where(F.trim("v") != "")
    n = F.length("v")
    agg = long.groupBy("field").agg(F.count("*").alias("populated"), F.count_if(n > F.col("hi")).alias("over_limit"), F.count_if(n < F.col("lo")).alias("under_limit"), F.min_by("v", F.struct((-n).alias("a"), F.col("v").alias("b"))).alias("worst"))
    return agg.withColumn("compliant_pct", pct(F.col("populated") - F.col("over_limit") - F.col("under_limit"), F.col("populated")))


def lov_rate(slots: DataFrame, allowed: list[str], skip: tuple[str, ...] = ("Series", "Model", "Additional Information", "Product Name", "Size")) -> DataFrame:
    """Long slots ``(label, value)`` -> checked, in_lov, rate_pct."""
    seen = slots.where((strip("label") != "") & (strip("value") != "") & ~strip("label").isin(list(skip)))
    out = seen.agg(F.count("*").alias("checked"), F.count_if(F.lower(strip("value")).isin([a.lower() for a in allowed])).alias("in_lov"))
    return out.withColumn("rate_pct", pct(F.col("in_lov"), F.col("checked")))


def unit_report(slots: DataFrame, approved: list[str]) -> DataFrame:
    """Units outside the approved set and inches left as decimals."""
    u = F.lower(strip("uom"))
    return slots.agg(F.count_if(u != "").alias("checked"), F.count_if((u != "") & ~u.isin([a.lower() for a in approved])).alias("violations"), F.count_if((u == "in") & strip("value").rlike(r"^\d+\.\d+$")).alias("decimal_inches"))


def placeholder_leaks(rows: DataFrame, columns: list[str]) -> DataFrame:
    hits = F.size(F.filter(F.array(*[F.lower(strip(c)) for c in columns]), lambda v: v.isin(PLACEHOLDERS[:3])))
    return rows.agg(F.coalesce(F.sum(hits), F.lit(0)).cast("bigint").alias("leaks"))


def issue_top(rows: DataFrame, issues: str = "issues", top: int = 12) -> DataFrame:
    """The most frequent issues: a top-k report."""
    x = rows.select(F.explode(issues).alias("i")).select(F.concat_ws(":", "i.severity", "i.field").alias("issue"))
    return x.groupBy("issue").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "issue").limit(top)


def host_counts(rows: DataFrame, key: str, url: str, top: int = 150) -> DataFrame:
    """Rows per registrable host, each row counted once per host: a top-k report."""
    pairs = rows.select(key, urls.registrable(url).alias("host")).where("host <> ''").dropDuplicates([key, "host"])
    return pairs.groupBy("host").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(top)


def reference_diff(actual: DataFrame, expected: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Long differences of two wide tables: one row per key and field of the expected table."""
    wide = lambda d, n: d.select(key, *[text(c).alias(c) for c in columns]).unpivot([key], columns, "field", n)
    met = wide(expected, "expected").where("expected <> ''").join(wide(actual, "actual"), [key, "field"], "left")
    status = F.when(F.col("actual").isNull(), "missing_row").when(F.col("actual") == "", "missing").when(strip("actual") == strip("expected"), "match").otherwise("differs")
    return met.withColumn("status", status).withColumn("actual", F.coalesce("actual", F.lit("")))


def reference_score(diff: DataFrame, key: str) -> DataFrame:
    out = diff.groupBy(key).agg(F.count("*").alias("expected_fields"), F.count_if(F.col("status") == "match").alias("matched"))
    return out.withColumn("score", F.round(F.col("matched") / F.col("expected_fields"), 4))


def metric_diff(before: DataFrame, after: DataFrame, name: str = "metric", value: str = "value") -> DataFrame:
    b, a = before.select(name, F.col(value).alias("before")), after.select(name, F.col(value).alias("after"))
    return b.join(a, name, "full").withColumn("delta", F.round(F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)), 4)).withColumn("improved", F.col("delta") > 0)


def glued_units(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Descriptions with a unit written onto its number (``6in``)."""
    texts = rows.select(F.explode(F.array(*[text(c) for c in columns])).alias("t")).where("t <> ''")
    return texts.agg(F.count("*").alias("descriptions_checked"), F.count_if(F.col("t").rlike(r"(?i)(?:^|\s|x)\d+(?:-\d+/\d+)?(?:in|mm|cm|ft|dba)\b")).alias("violations"))


def source_coverage(rows: DataFrame, mfr: str, refs: str) -> DataFrame:
    out = rows.agg(F.count("*").alias("populated_rows"), F.count_if(text(mfr).startswith("http")).alias("_m"), F.count_if(F.exists(refs, lambda u: u.startswith("http"))).alias("_r"))
    return out.select("populated_rows", pct(F.col("_m"), F.col("populated_rows")).alias("mfr_url_pct"), pct(F.col("_r"), F.col("populated_rows")).alias("any_ref_url_pct"))


def distinct_values(slots: DataFrame, label: str = "label", value: str = "value") -> DataFrame:
    """Values seen under each label, with counts (LOV mining)."""
    return slots.where((text(label) != "") & (text(value) != "")).groupBy(label, value).agg(F.count("*").alias("n"))


def ground_truth(scores: DataFrame, category: str, score: str = "score") -> DataFrame:
    return scores.groupBy(category).agg(F.count("*").alias("n"), F.round(F.avg(score), 4).alias("avg_score"), F.count_if(F.col(score) >= 0.999).alias("perfect"))
