"""Brand identity.

All dictionaries are small and sorted on the driver into array literals, so that a longest-match lookup is a filter over
an array inside the scan's stage: no join, no shuffle.  Dictionaries beyond that belong in ``crosswalk``'s equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import Dims
from ..functions.text import bare_brand, clean_brand, contains_word, let, literal, strip, text, texts
from ..functions.units import lookup

COOP = ["APPDE", "UNILOG", "COOP"]


def unusable(x: Column) -> Column:
    low = F.lower(strip(x))
    return (low == "") | low.isin("-", "n/a", "na", "none", "unknown") | F.contains(low, F.lit("unbranded")) | low.startswith("commodity")


def _longest(entries: list[tuple[str, str]]) -> Column:
    rows = sorted(entries, key=lambda kv: -len(kv[0]))
    return F.expr(f"array({', '.join(f'named_struct({chr(39)}k{chr(39)}, {literal(k)}, {chr(39)}l{chr(39)}, lower({literal(k)}), {chr(39)}v{chr(39)}, {literal(v)})' for k, v in rows)})")


def longest_word(x: Column, entries: list[tuple[str, str]]) -> Column:
    """Value of the longest entry that stands in the text as a word; null if none does."""
    if not entries:
        return F.lit(None).cast("string")
    # the text and its small letters are made once, not for every entry
    seen = F.struct(x.alias("x"), F.lower(x).alias("low"))
    return let(seen, lambda s: F.get(F.filter(_longest(entries), lambda e: F.contains(s["low"], e["l"]) & contains_word(s["x"], e["k"])), F.lit(0))["v"])


def brand_names(dims: Dims) -> list[tuple[str, str]]:
    out = []
    for key, (name, _, _) in dims.brands.items():
        out.append((key, key))
        bare = name.replace("®", "").replace("™", "").strip()
        if bare and bare.lower() != key.lower():
            out.append((bare, key))
    return out


def alias_key(x: Column, dims: Dims) -> Column:
    folded = {k.lower(): v for k, v in reversed(list(dims.aliases.items()))}
    return F.coalesce(lookup(dims.aliases, x), lookup(folded, F.lower(x)))


def canonical_key(x: Column, dims: Dims) -> Column:
    keys = list(dims.brands)
    alias = alias_key(x, dims)
    return F.when(x.isin(keys), x).when(alias.isin(keys), alias).otherwise(F.coalesce(longest_word(x, brand_names(dims)), alias, x))


def from_description(x: Column, dims: Dims) -> Column:
    return F.coalesce(longest_word(x, list(dims.aliases.items())), longest_word(x, brand_names(dims)))


def from_manufacturer(x: Column, dims: Dims) -> Column:
    keys = list(dims.brands)
    token = clean_brand(x)
    key = F.when((token != "") & ~F.upper(token).isin(COOP) & ~unusable(token), canonical_key(token, dims))
    low = F.lower(text(x))
    hints = [(k, v) for k, v in dims.hints.items() if v in dims.brands]
    hint = let(low, lambda s: F.get(F.filter(_longest(hints), lambda e: F.contains(s, e["l"])), F.lit(0))["v"]) if hints else F.lit(None).cast("string")
    found = F.coalesce(F.when(key.isin(keys), key), hint, longest_word(text(x), brand_names(dims)))
    return F.when(~text(x).rlike(r"(?i)\bAPPDE\b|Appliance Dealers Cooperative"), found)


def from_prefix(mpn: Column, dims: Dims) -> Column:
    return F.coalesce(*[lookup(dims.prefixes, F.substring(mpn, 1, n)) for n in (4, 3, 2)])


def usable_manufacturer(x: Column) -> Column:
    token = clean_brand(x)
    bare = F.trim(F.regexp_replace(token, r"\s*\([^)]*\)\s*$", ""))
    bad = text(x).rlike(r"(?i)\bAPPDE\b|Appliance Dealers Cooperative") | (token == "") | F.upper(token).isin(COOP) | F.upper(bare).isin(COOP)
    return F.when(bad, F.lit("")).otherwise(bare)


def _identity(key: Column, confidence: float, method: str, fallback: Column | None, dims: Dims) -> Column:
    name = lookup({k: v[0] for k, v in dims.brands.items()}, key)
    maker = lookup({k: v[1] for k, v in dims.brands.items()}, key)
    domains = F.try_element_at(F.create_map(*[x for k, v in dims.brands.items() for x in (F.lit(k), texts(v[2]))]), key)
    return F.struct(key.alias("brand_key"), F.coalesce(name, fallback if fallback is not None else key).alias("brand_name"), F.coalesce(maker, key).alias("manufacturer_name"),
                    F.coalesce(domains, F.array().cast("array<string>")).alias("domains"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method"))


def resolve(rows: DataFrame, dims: Dims, mpn: str = "normalized_mpn", desc: str = "expanded_desc") -> DataFrame:
    """Adds the struct ``identity``: the first of six sources that names a brand, with its confidence and method."""
    steps: list[tuple[Column, float, str, bool]] = []
    for column, confidence, method in (("DIB_Brand", 0.9, "dib_brand"), ("E1_Brand", 0.85, "e1_brand"), ("Unilog_Brand", 0.82, "unilog_brand")):
        token = clean_brand(column)
        steps.append((F.when((token != "") & ~unusable(token), token), confidence, method, True))
    steps.append((from_manufacturer(F.col("Part_Manuf"), dims), 0.8, "part_manuf", False))
    steps.append((from_description(text(desc), dims), 0.75, "part_desc", False))
    steps.append((from_prefix(F.col(mpn), dims), 0.7, "mpn_prefix", False))
    left = usable_manufacturer(F.col("Part_Manuf"))
    steps.append((F.when((left != "") & ~unusable(left), left), 0.45, "part_manuf_unmapped", True))
    candidates = F.array(*[F.struct(c.alias("token"), F.lit(i).alias("i")) for i, (c, *_) in enumerate(steps)])
    first = F.get(F.filter(candidates, lambda x: x["token"].isNotNull()), F.lit(0))
    staged = rows.withColumn("_first", first).withColumn("_token", F.coalesce(F.col("_first.token"), F.lit("")))
    staged = staged.withColumn("_key", F.when(F.col("_first.i").isin([i for i, s in enumerate(steps) if s[3]]), canonical_key(F.col("_token"), dims)).otherwise(F.col("_token")))
    staged = staged.withColumn("_step", F.coalesce(F.col("_first.i"), F.lit(len(steps))))
    base = _identity(F.col("_key"), 0.0, "unknown", F.when(F.col("_token") != "", F.col("_token")), dims)
    confidence = F.element_at(F.array(*[F.lit(s[1]) for s in steps], F.lit(0.0)), F.col("_step") + 1)
    method = F.element_at(F.array(*[F.lit(s[2]) for s in steps], F.lit("unknown")), F.col("_step") + 1)
    staged = staged.withColumn("_base", base.withField("confidence", confidence).withField("method", method))
    return staged.withColumn("identity", canonicalize(F.col("_base"), F.col("Part_Manuf"), dims)).drop("_first", "_token", "_key", "_step", "_base")


def canonicalize(identity: Column, part_manuf: Column, dims: Dims) -> Column:
    """Legal spelling of the brand by exact match on any of its names, any case; the maker is only filled in."""
    manuf = clean_brand(part_manuf)
    names = F.array(identity["brand_name"], identity["manufacturer_name"], manuf, F.trim(F.regexp_replace(manuf, r"\s*\(\d+\)\s*$", "")))
    known = list(dims.reference_names)
    hit = F.get(F.filter(F.transform(names, F.lower), lambda n: n.isin(known)), F.lit(0))
    brand = lookup({k: v[0] for k, v in dims.reference_names.items()}, hit)
    maker = lookup({k: v[1] for k, v in dims.reference_names.items()}, hit)
    upgraded = identity.withField("brand_name", F.coalesce(brand, identity["brand_name"])).withField("manufacturer_name", F.when(identity["manufacturer_name"] == "", maker).otherwise(identity["manufacturer_name"]))
    upgraded = upgraded.withField("confidence", F.greatest(identity["confidence"], F.lit(0.9))).withField("method", F.concat(identity["method"], F.lit("+unicat")))
    upgraded = upgraded.withField("brand_key", F.when(identity["brand_key"] == "", bare_brand(brand)).otherwise(identity["brand_key"]))
    return F.when(hit.isNotNull(), upgraded).otherwise(identity)


def crosswalk(rows: DataFrame, table: DataFrame, mpn: str = "normalized_mpn", raw: str = "Mfg_Part_Num") -> DataFrame:
    """Left equi-joins on the normalised, then the raw number (``table``: key and any columns); the first match counts.
    The table may be of any size: Spark picks the join by its statistics."""
    kept = table.groupBy(F.upper("key").alias("key")).agg(*[F.first(c, ignorenulls=True).alias(c) for c in table.columns if c != "key"])
    value = [c for c in table.columns if c != "key"]
    one = kept.select(F.col("key").alias("_k1"), F.struct(*value).alias("_v1"))
    two = kept.select(F.col("key").alias("_k2"), F.struct(*value).alias("_v2"))
    out = rows.join(one, F.upper(F.col(mpn)) == F.col("_k1"), "left").join(two, F.upper(strip(raw)) == F.col("_k2"), "left")
    return out.withColumn("crosswalk", F.coalesce("_v1", "_v2")).drop("_k1", "_v1", "_k2", "_v2")
