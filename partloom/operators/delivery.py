"""Delivery helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import compact_key, label_key, strip, text
from ..functions.units import is_hex_colour
from .assemble import override

#: fixed values: property keys of structured data -> evidence field
PROPERTIES = {"height": "Height", "width": "Width", "depth": "Depth", "weight": "Weight", "color": "Color", "material": "Material", "voltage": "Voltage Rating", "wattage": "Wattage", "diameter": "Diameter", "arborsize": "Arbor Size", "maximumspeed": "Maximum RPM", "gritsize": "Grit", "countryoforigin": "Country Of Origin"}
IDS = ["sku", "mpn", "gtin", "gtin12", "gtin13", "gtin14", "upc", "ean", "unspsc", "productid"]


def replay_overrides(rows: DataFrame, saved: DataFrame, key: str = "normalized_mpn") -> DataFrame:
    """Reviewers' values put into the slots, in the order in which they were saved.  ``saved(key, ord, label, value, uom)``
    holds few rows per key by definition (one per label)."""
    last = saved.groupBy(key, label_key("label").alias("_k")).agg(F.max_by(F.struct("ord", "label", "value", "uom"), "ord").alias("s"))
    lists = last.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list("s")).alias("_saved"))
    met = rows.join(lists, rows[key] == lists["_key"], "left")
    put = F.aggregate(F.coalesce("_saved", F.array().cast("array<struct<ord:int,label:string,value:string,uom:string>>")), F.col("slots"), lambda a, s: override(a, s["label"], s["value"], s["uom"]))
    return met.withColumn("slots", put).drop("_key", "_saved")


def preview(row: dict[str, Column], total: int = 252) -> Column:
    """JSON of a row with the share of its filled cells in percent, to one decimal."""
    filled = F.size(F.filter(F.array(*[text(c) for c in row.values()]), lambda v: F.trim(v) != ""))
    return F.to_json(F.struct(F.struct(*[text(c).alias(k) for k, c in row.items()]).alias("row"), filled.alias("filled"), F.round(filled / F.lit(total) * 100, 1).alias("completeness_pct")))


def run_key(inputs: DataFrame, columns: list[str], options: str) -> DataFrame:
    """One row: the key under which a finished run of the same input and options may be reused (order does not matter)."""
    digest = inputs.select(F.xxhash64(*columns).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.sum("h"), F.lit(0)).alias("s"))
    return digest.select("n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.col("s").cast("string"), F.lit(options)), 256).alias("key"))


def first_fetches(candidates: DataFrame, key: str = "mpn", size: int = 8, spare: int = 2) -> DataFrame:
    """At most ``size`` urls a key: products first, but ``spare`` places are kept for searches.  ``candidates(key, url, ord)``."""
    kind = candidates.withColumn("_search", urls.is_search("url"))
    rank = kind.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_search").orderBy("ord")))
    kept = rank.where(F.when(F.col("_search"), F.col("_r") <= size).otherwise(F.col("_r") <= size))
    counts = Window.partitionBy(key)
    searches = F.least(F.count_if("_search").over(counts), F.lit(spare))
    products = F.least(F.count_if(~F.col("_search")).over(counts), F.lit(size) - searches)
    sized = kept.withColumns({"_s": searches, "_p": products})
    return sized.where(F.when(F.col("_search"), F.col("_r") <= F.lit(size) - F.col("_p")).otherwise(F.col("_r") <= F.col("_p"))).drop("_search", "_r", "_s", "_p")


def property_field(name: Column | str) -> Column:
    """Evidence field of a structured property; '' for identifiers and names that cannot be a label."""
    from ..functions.units import lookup

    k = compact_key(name)
    fine = (F.length(text(name)) <= 48) & (F.size(F.split(strip(name), r"\s+")) <= 8) & text(name).rlike("[A-Za-z]")
    return F.coalesce(lookup(PROPERTIES, k), F.when(k.isin(IDS) | ~fine, F.lit("")).otherwise(strip(name)))


def property_value_ok(name: Column, value: Column) -> Column:
    v = strip(value)
    return (v != "") & (F.length(v) <= 80) & ~F.lower(v).isin("true", "false") & (F.lower(v) != F.lower(strip(name))) & ~is_hex_colour(v)


def display_source(slot: Column, label: Column, mfr: Column) -> Column:
    """The first outside page that is no search, else the first source at all."""
    all_ = F.filter(F.array(text(slot), text(label), text(mfr)), lambda u: u != "")
    good = F.filter(all_, lambda u: u.startswith("http") & ~urls.is_search(u))
    return F.coalesce(F.get(good, F.lit(0)), F.get(all_, F.lit(0)), F.lit(""))


def parse_issue(line: Column | str) -> Column:
    """``field: message`` -> an issue of severity warning."""
    parts = F.split(text(line), ": ", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("field"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("message"), F.lit("warning").alias("severity"))


def failed_row(rows: DataFrame, error: Column) -> DataFrame:
    """Rows with an error keep their inputs and go to review."""
    bad = error.isNotNull()
    return rows.withColumn("category_id", F.when(bad, F.lit("error")).otherwise(F.col("category_id"))).withColumn("band", F.when(bad, F.lit("review")).otherwise(F.col("band")))


def precedence(rows: DataFrame, key: str, ranks: dict[str, int], origin: str = "origin", time: str = "mtime") -> DataFrame:
    """Per key the row of the best origin, the newest on ties."""
    rank = F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))])
    order = F.struct(F.coalesce(F.try_element_at(rank, F.col(origin)), F.lit(-1)), F.col(time))
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")


def substring_match(actual: DataFrame, expected: DataFrame, key: str = "mpn") -> DataFrame:
    """Expected rows beside the actual row of an equal key, else of a key that contains it.  The second join only sees
    what the first left over and meets it on shared five-character grams, not by comparing all pairs."""
    equal = expected.join(actual.withColumnRenamed(key, "_a"), F.col(key) == F.col("_a"), "left")
    left = equal.where("_a is null").select(*expected.columns)
    gram = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 4, F.lit(1))), lambda i: F.substring(c, i, F.lit(5)))
    a = actual.withColumnRenamed(key, "_a")
    near = left.withColumn("_g", F.substring(key, 1, 5)).join(a.withColumn("_g", F.explode(F.array_distinct(gram(F.col("_a"))))), "_g").where((F.length(key) >= 5) & F.contains(F.col("_a"), F.col(key)))
    first = near.groupBy(*expected.columns).agg(F.min_by(F.struct(*a.columns), "_a").alias("s")).select(*expected.columns, "s.*")
    return equal.where("_a is not null").select(*expected.columns, *a.columns).unionByName(first)
