"""Reference data from workbook rows.  Tables are read as cells or named columns with their place
(``ord``): wherever several rows say the same, the first one counts, so results do not depend on how the input was cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, text


def workbook_stem(path: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")), r"[\s-]+", "_")


def find_workbook(files: DataFrame, exact: str, groups: list[list[str]], kind: str = "") -> DataFrame:
    """Of ``files(path, kind)`` the one with the exact name, else the first (by path) whose stem holds all tokens of a group, else
    the first of the kind; no row if there is none."""
    stem = workbook_stem(F.col("path"))
    holds = F.lit(False)
    for tokens in groups:
        every = F.lit(True)
        for t in tokens:
            every = every & F.contains(stem, F.lit(t))
        holds = holds | every
    name = F.element_at(F.split("path", "/"), -1)
    rank = F.when(name == exact, 0).when(name.rlike(r"(?i)\.xlsx?$") & ~name.startswith("~$"), F.when(holds, 1).when((F.lit(kind) != "") & (F.col("kind") == kind), 2))
    found = files.withColumn("rank", rank).where("rank is not null").agg(F.min(F.struct("rank", "path")).alias("m"))
    return found.where("m is not null").select("m.path", "m.rank")


def values_by_label(rows: DataFrame) -> DataFrame:
    """``rows(label, value, ord)`` -> distinct values of each label in the order of their first rows."""
    once = rows.select(strip("label").alias("label"), strip("value").alias("value"), "ord").where("label <> '' and value <> ''").groupBy("label", "value").agg(F.min("ord").alias("ord"))
    return once.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("v")).select("label", F.transform("v", lambda x: x["value"]).alias("allowed"))


def unit_abbreviations(rows: DataFrame) -> DataFrame:
    """``rows(measurement, abbreviation, ord)`` -> the first abbreviation of each measurement, any case."""
    full = rows.where((text("measurement") != "") & (text("abbreviation") != ""))
    return full.groupBy(F.lower("measurement").alias("measurement")).agg(F.min_by("abbreviation", "ord").alias("abbreviation"))


def house_rules(rows: DataFrame, top: int = 40) -> DataFrame:
    """``rows(cells, ord)`` -> the first ``top`` distinct sentences about spaces or hyphens, 300 characters each: a top-k report."""
    said = rows.select(F.array_join(F.filter("cells", lambda c: c != ""), " ").alias("rule"), "ord").where(F.lower("rule").rlike("space between|hyphen"))
    return said.groupBy("rule").agg(F.min("ord").alias("ord")).orderBy("ord", "rule").limit(top).select(F.substring("rule", 1, 300).alias("rule"), "ord")


def manufacturers(rows: DataFrame) -> DataFrame:
    """``rows(manufacturer, brand, code, ord)`` -> the first row of each pair that names a manufacturer."""
    named = rows.select(text("manufacturer").alias("manufacturer"), text("brand").alias("brand"), text("code").alias("code"), "ord").where("manufacturer <> ''")
    return named.groupBy("manufacturer", "brand").agg(F.min_by("code", "ord").alias("code"))


def fraction_pairs(cells: DataFrame) -> DataFrame:
    """``cells(row, col, value)`` -> decimals with the fraction in the next filled cell of their row; the first pair counts."""
    filled = cells.where(text("value") != "").withColumn("next", F.lead("value").over(Window.partitionBy("row").orderBy("col")))
    met = filled.where(F.col("value").rlike(r"^\d*\.\d+$") & F.col("next").rlike(r"^\d+-?\d*/\d+$|^\d+/\d+$"))
    return met.groupBy(F.col("value").alias("decimal")).agg(F.min_by("next", F.struct("row", "col")).alias("fraction"))


def taxonomy_index(templates: DataFrame) -> DataFrame:
    """Leaves of templates with their keywords: lower-case names and the words of three letters or more of the path, sorted."""
    names = F.array(*[F.lower(c) for c in ("product_name", "fine", "class")])
    words = F.regexp_extract_all(F.lower("classpath"), F.lit("([a-z]{3,})"), F.lit(1))
    return templates.select(F.col("category_id").alias("template_id"), "classpath", "product_name", F.array_sort(F.array_distinct(F.concat(names, words))).alias("keywords"))
