"""Evidence and its merge algebra.

An evidence item is ``struct(field, value, uom, source_url, quote, extractor, confidence)``; a bundle is an array of items
in the order in which they came.  Order is part of the meaning, so merging is a fold over an ordered array: per row and
inside one expression, without a shuffle, when the items stand in the row; ``merge`` first orders long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import label_key, let, text, texts
from ..functions.units import equivalent, family_fits, quantity

FIELDS = ["field", "value", "uom", "source_url", "quote", "extractor", "confidence"]
ITEM = "struct<field:string,value:string,uom:string,source_url:string,quote:string,extractor:string,confidence:double>"


def item(field: Column | str, value: Column, uom: Column | str = "", url: Column | str = "input:Part_Desc", quote: Column | None = None, extractor: str = "", confidence: Column | float = 0.65) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str | float) else x
    return F.struct(lit(field).alias("field"), text(value).alias("value"), text(lit(uom)).alias("uom"), lit(url).alias("source_url"), (quote if quote is not None else F.lit("")).alias("quote"), F.lit(extractor).alias("extractor"), lit(confidence).cast("double").alias("confidence"))


def is_self_cited(url: Column) -> Column:
    return url.startswith("input:") | (url == "")


def _replaces(old: Column, new: Column) -> Column:
    outside = is_self_cited(old["source_url"]) & ~is_self_cited(new["source_url"])
    unit = F.when(old["uom"] != "", old["uom"]).otherwise(new["uom"])
    return F.when(outside, ~equivalent(old["value"], new["value"], unit) & (new["confidence"] >= old["confidence"])).otherwise(new["confidence"] > old["confidence"])


def _rehomed(old: Column, new: Column) -> Column:
    """The old item, citing the new page if that page gives the same measurement."""
    unit = F.when(old["uom"] != "", old["uom"]).otherwise(new["uom"])
    moves = is_self_cited(old["source_url"]) & ~is_self_cited(new["source_url"]) & equivalent(old["value"], new["value"], unit)
    moved = F.struct(old["field"].alias("field"), old["value"].alias("value"), unit.alias("uom"), new["source_url"].alias("source_url"), F.when(new["quote"] != "", new["quote"]).otherwise(old["quote"]).alias("quote"), old["extractor"].alias("extractor"), F.greatest(old["confidence"], new["confidence"]).alias("confidence"))
    return F.when(moves, moved).otherwise(old)


def fold(items: Column) -> Column:
    """Items with one per field (any case): a better item replaces the older one and moves to the end; an outside page
    that repeats a value of the row's own only lends its citation."""

    def step(bundle: Column, new: Column) -> Column:
        same = lambda x: F.lower(x["field"]) == F.lower(new["field"])
        olds = F.filter(bundle, same)
        # a one-element array carries the old item into the function, so that it is computed once
        kept = lambda: F.transform(bundle, lambda x: F.when(same(x), _rehomed(x, new)).otherwise(x))
        moved = lambda: F.concat(F.filter(bundle, lambda x: ~same(x)), F.array(new))
        replaces = F.exists(olds, lambda o: _replaces(o, new))
        return F.when((F.size(olds) > 0) & ~replaces, kept()).otherwise(moved())

    return F.aggregate(F.filter(items, lambda x: (x["value"] != "") & (x["field"] != "")), F.array().cast(f"array<{ITEM}>"), step)


def best(items: Column) -> Column:
    """``fold`` for items that all come from the row itself: no citation can move, so of each field the most confident item
    stays, the first of equals, where it stood.  One pass of comparisons instead of a fold."""
    known = F.transform(F.filter(items, lambda x: (x["value"] != "") & (x["field"] != "")), lambda x, i: F.struct(F.lower(x["field"]).alias("k"), x["confidence"].alias("c"), i.alias("i"), x.alias("x")))
    beats = lambda y, x: (y["k"] == x["k"]) & ((y["c"] > x["c"]) | ((y["c"] == x["c"]) & (y["i"] < x["i"])))
    return let(known, lambda every: F.transform(F.filter(every, lambda x: ~F.exists(every, lambda y: beats(y, x))), lambda x: x["x"]))


def merge(evidence: DataFrame, key: str = "row_id", order: str = "ord") -> DataFrame:
    """Long evidence ``(key, order, item columns)`` -> one row per key with the folded ``items``.  A product has a
    bounded number of items (80 pairs a page, a handful of pages), so a key's items fit one row."""
    gathered = evidence.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *FIELDS))).alias("_all"))
    return gathered.select(key, fold(F.transform("_all", lambda x: F.struct(*[x[f].alias(f) for f in FIELDS]))).alias("items"))


def distinct_in_order(lists: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Ordered union of lists without repeats (first place counts)."""
    return lists.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_l")).select(key, F.array_distinct(F.flatten(F.transform("_l", lambda x: x[value]))).alias(value))


def first_filled(scalars: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """First non-empty value of each column in the given order, by a partial aggregation."""
    return scalars.groupBy(key).agg(*[F.coalesce(F.min_by(c, F.when(text(c) != "", F.col(order))), F.lit("")).alias(c) for c in columns])


def apply_policy(items: Column, allowed: Column, fallback: Column) -> Column:
    """Nothing from a page that is not allowed; at most 0.68 confidence from a fallback page."""
    capped = F.transform(items, lambda x: x.withField("confidence", F.least(x["confidence"], F.lit(0.68))))
    return F.when(~allowed, F.array().cast(f"array<{ITEM}>")).when(fallback, capped).otherwise(items)


def verified(items: Column) -> Column:
    """Number of items that come from outside the row and are no guesses."""
    return F.size(F.filter(items, lambda x: ~x["source_url"].startswith("input:") & (x["source_url"] != "") & (x["extractor"] != "smart_infer")))


def field_matches(field: Column, label: Column | str) -> Column:
    k = F.lower(F.lit(label) if isinstance(label, str) else label)
    return let(label_key(field), lambda f: (f == k) | f.endswith(F.concat(F.lit(" "), k)))


def prepared(items: Column) -> Column:
    """Items with what every comparison with a label needs, computed once per item."""
    return F.transform(items, lambda x, i: F.struct(label_key(x["field"]).alias("k"), F.lower(x["field"]).alias("low"), quantity(x["value"], x["uom"]).alias("q"), (~is_self_cited(x["source_url"])).cast("int").alias("live"), (-i).alias("o"), x.alias("item")))


def pick(items: Column, label: Column | str, aliases: dict[str, list[str]]) -> Column:
    """Best item for a template label, null if none: outside pages first, then confidence, the length of the source,
    exact field names before aliases before suffixes, and order."""
    return let(prepared(items), lambda p: pick_prepared(p, F.lit(label) if isinstance(label, str) else label, aliases))


def pick_prepared(ready: Column, label: Column, aliases: dict[str, list[str]]) -> Column:
    table = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), texts([n.lower() for n in v]))]) if aliases else F.create_map(F.lit(""), F.array(F.lit("")))
    names = F.concat(F.array(F.lower(label)), F.coalesce(F.try_element_at(table, label), F.array().cast("array<string>")))

    def rank(x: Column, known: Column) -> Column:
        at = F.array_position(known, x["low"])
        return F.when(at > 0, at.cast("int")).when(F.exists(known, lambda n: (x["k"] == n) | x["k"].endswith(F.concat(F.lit(" "), n))), F.size(known) + 1)

    def best(known: Column) -> Column:
        fit = F.filter(ready, lambda x: (x["item"]["value"] != "") & family_fits(label, x["q"]))
        ranked = F.transform(fit, lambda x: F.struct(x["live"], x["item"]["confidence"].alias("c"), F.length(x["item"]["source_url"]).alias("n"), (-rank(x, known)).alias("r"), x["o"], x["item"]))
        return F.array_max(F.filter(ranked, lambda s: s["r"].isNotNull()))["item"]

    return let(names, best)


def align(items: Column, labels: Column | list[str], aliases: dict[str, list[str]]) -> Column:
    """Copies of the picked items under the template's own labels, folded in; an alias from the row itself never replaces."""
    labels = texts(labels) if isinstance(labels, list) else labels

    def copied(ready: Column, label: Column) -> Column:
        present = F.exists(ready, lambda x: x["low"] == F.lower(label))
        return let(pick_prepared(ready, label, aliases), lambda c: F.when(c.isNotNull() & (F.lower(c["field"]) != F.lower(label)) & ~(present & is_self_cited(c["source_url"])), c.withField("field", label)))

    copies = let(prepared(items), lambda ready: F.filter(F.transform(labels, lambda label: copied(ready, label)), lambda x: x.isNotNull()))
    return fold(F.concat(items, copies))


def sources(items: Column) -> Column:
    """Field -> source map; the later of two equal fields counts."""
    return F.map_from_entries(F.transform(items, lambda x: F.struct(x["field"], x["source_url"])))
