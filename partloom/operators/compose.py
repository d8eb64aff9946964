"""Descriptions of catalogue rows.

Three grammars: dishwashers, abrasives and everything else.  A grammar is a function from a row's columns to a struct of the five
descriptions; ``COMPOSERS`` names those of categories that have one of their own.  Values are read from a map of the row's items
(``values``), made once for a row.  Styles say how a brand's family leads and what its titles promote: a default, and per brand
what that brand does otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import bare_brand, contains_word, pad_mobile, text

DESCRIPTIONS = ["MOBILE_DESC", "SHORT_DESC", "INVOICE_DESC", "LONG_DESC1", "RETAIL_DESC"]
#: fixed values: what holds for brands without a style of their own
DEFAULT_STYLE = {"mobile_lead": "auto", "mobile_fill": ["mounting"], "short_promote_with": True, "long_promote_with": True, "title_with": "single"}

Row = dict[str, Column]


def values(items: Column) -> Column:
    """Map of lower-case field -> (value, uom); a bundle holds each field once."""
    return F.map_from_entries(F.transform(items, lambda x: F.struct(F.lower(x["field"]).alias("key"), F.struct(x["value"].alias("value"), x["uom"].alias("uom")).alias("value"))))


def value(of: Column, *labels: str, part: str = "value") -> Column:
    """First of the labels that the row has, else ''."""
    return F.coalesce(*[F.try_element_at(of, F.lit(x.lower()))[part] for x in labels], F.lit(""))


def joined(*parts: Column | str, by: str = ", ") -> Column:
    """The parts that are not empty."""
    return F.array_join(F.filter(F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts]), lambda p: p != ""), by)


def around(before: str, x: Column, after: str = "") -> Column:
    """``x`` between two texts, '' if it is empty."""
    return F.when(x == "", F.lit("")).otherwise(F.concat(F.lit(before), x, F.lit(after)))


def style_of(brand: Column, styles: dict[str, dict]) -> Column:
    """Struct of the brand's style: the default, with what the brand's family overrides (any case)."""

    def told(style: dict) -> Column:
        full = {**DEFAULT_STYLE, **styles.get("default", {}), **style}
        fill = F.array(*map(F.lit, full["mobile_fill"])) if full["mobile_fill"] else F.array().cast("array<string>")
        return F.struct(F.lit(full["mobile_lead"].strip()).alias("mobile_lead"), fill.alias("mobile_fill"), F.lit(bool(full["short_promote_with"])).alias("short_promote_with"), F.lit(bool(full["long_promote_with"])).alias("long_promote_with"), F.lit((full["title_with"] or "single").lower()).alias("title_with"))

    own = styles.get("clusters", {})
    if not own:
        return told({})
    table = F.create_map(*[x for k, v in own.items() for x in (F.lit(k.lower()), told(v))])
    return F.coalesce(F.try_element_at(table, F.lower(bare_brand(brand))), told({}))


def mobile_lead(style: Column, maker: Column, brand: Column) -> Column:
    """``auto``: the brand alone where the maker's name holds it as a word, else both; other styles are templates."""
    plain = bare_brand(brand)
    auto = F.when(contains_word(maker, plain), plain).otherwise(joined(maker, plain, by=" "))
    filled = style["mobile_lead"]
    for name, x in (("manufacturer", maker), ("brand_plain", plain), ("brand", brand)):
        filled = F.replace(filled, F.lit("{" + name + "}"), x)
    return F.when(style["mobile_lead"].isin("auto", ""), auto).otherwise(F.trim(filled))


def with_phrase(x: Column) -> Column:
    return F.when((x == "") | F.startswith(F.lower(x), F.lit("with ")), x).otherwise(F.concat(F.lit("With "), x))


def title_with(phrase: Column, style: Column) -> Column:
    """The phrase in a title: always, never, or only while it names a single feature (no comma)."""
    body = F.when(F.startswith(F.lower(phrase), F.lit("with ")), F.substring(phrase, 6, 1 << 20)).otherwise(phrase)
    mode = style["title_with"]
    return F.when(mode == "never", F.lit("")).when((mode != "always") & F.contains(body, F.lit(",")), F.lit("")).otherwise(phrase)


def dishwasher(row: Row) -> Column:
    brand, maker, mpn, style = row["brand"], row["maker"], row["mpn"], row["style"]
    product = F.when(row["product"] == "", F.lit("Dishwasher")).otherwise(row["product"])
    get = lambda x: value(row["values"], x)
    unit = lambda x, default: F.coalesce(F.nullif(value(row["values"], x, part="uom"), F.lit("")), F.lit(default))
    series, mounting, cycles, material, colour = get("Series"), get("Mounting Type"), get("Number of Wash Cycles"), get("Material"), get("Color")
    volt, amp, sound, depth, least = get("Voltage Rating"), get("Amperage Rating"), get("Sound Level"), get("Depth With Door Open"), get("Minimum Height")
    leg = F.lower(mounting) == "leg"
    short_mount = F.when(leg, F.lit("LEG")).when(F.contains(F.lower(mounting), F.lit("built")), F.lit("BLTLN")).otherwise(F.lit(""))
    flag = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(""))
    inches = F.upper(F.replace(depth, F.lit(" "), F.lit("")))
    inches = F.when((depth == "") | inches.endswith("IN"), inches).otherwise(F.concat(inches, F.lit("IN")))
    noise = F.when(sound == "", sound).otherwise(F.upper(F.concat(sound, unit("Sound Level", "DBA"))))
    deep_leg = (depth != "") & leg
    noise = F.when(deep_leg & noise.endswith("DBA"), F.lit("")).otherwise(noise)
    inches = F.when(deep_leg | ((depth != "") & (sound == "")), inches).otherwise(F.lit(""))
    invoice = joined(F.upper(product), short_mount, cycles, flag(material != "", "SST"), flag((colour != "") & (colour == material), "SST"), around("", volt, "V"), around("", amp, "A"), noise, inches, by=" ")
    mount = around("", mounting, " Mounting")
    start = joined(mobile_lead(style, maker, brand), product, series, mpn)
    mobile = F.when(F.array_contains(style["mobile_fill"], "mounting") & (F.length(start) < 60), joined(start, mount)).otherwise(start)
    phrase = with_phrase(F.replace(F.replace(get("With"), F.lit("With "), F.lit("")), F.lit("with "), F.lit("")))
    title = title_with(phrase, style)
    promote = lambda lead, where: F.when((title != "") & style[where], F.trim(F.concat_ws(" ", lead, title))).otherwise(lead)
    short = promote(F.trim(F.concat_ws(" ", brand, series, mpn, product)), "short_promote_with")
    wash = around("", cycles, "-Wash Cycle")
    measured = lambda x, v, default, after="": F.when(v == "", v).otherwise(F.concat(v, F.lit(" "), unit(x, default), F.lit(after)))
    lowest = F.when(F.contains(least, F.lit("Rack")), around("", least, " Minimum Height")).otherwise(measured("Minimum Height", least, "in", " Minimum Height"))
    long = joined(
        promote(F.concat_ws(" ", brand, product), "long_promote_with"), series, around("", cycles, " Wash Cycles"), measured("Voltage Rating", volt, "V"), measured("Amperage Rating", amp, "A"), mount, get("Size"),
        measured("Depth With Door Open", depth, "in", " Depth With Door Open"), lowest, around("", get("Maximum Height"), " Maximum Height"), measured("Sound Level", sound, "dBA", " Sound Level"),
        material, colour, around("Additional Information: ", get("Additional Information")),
    )
    retail = joined(F.when(series == "", product).otherwise(F.concat_ws(" ", series, product)), mount, wash, material, colour)
    return _struct(F.substring(pad_mobile(mobile, mpn, brand, maker), 1, 80), joined(short, mount, wash, material, colour), F.substring(F.upper(invoice), 1, 40), long, retail)


def abrasive(row: Row) -> Column:
    brand = F.when(row["brand"] == "", row["maker"]).otherwise(row["brand"])
    maker, mpn, product, desc = row["maker"], row["mpn"], row["product"], row["desc"]
    across, use = value(row["values"], "Diameter"), value(row["values"], "Application")
    use = F.when(use == "", product).otherwise(use)
    return _struct(
        pad_mobile(joined(maker, F.translate(brand, "®™", ""), product, mpn, across, use), mpn, brand, maker),
        joined(brand, mpn, use, across),
        F.substring(F.trim(F.replace(F.concat_ws(" ", F.upper(product), across), F.lit('"'), F.lit("IN"))), 1, 40),
        joined(brand, product, mpn, across, use, F.substring(desc, 1, 80)),
        joined(product, across, use),
    )


def generic(row: Row) -> Column:
    brand, maker, mpn, desc = row["brand"], row["maker"], row["mpn"], row["desc"]
    kind = value(row["values"], "Product Type")
    kind = F.when(kind == "", row["product"]).otherwise(kind)
    size, finish = value(row["values"], "Size", "Length", "Width", "Blade Span"), value(row["values"], "Finish", "Color")
    short = joined(brand, mpn, kind, size, finish)
    retail = joined(kind, size, finish)
    return _struct(
        pad_mobile(joined(maker, F.translate(brand, "®™", ""), kind, mpn, size, finish), mpn, brand, maker),
        short,
        F.substring(F.upper(joined(F.upper(kind), F.replace(size, F.lit('"'), F.lit("IN")), by=" ")), 1, 40),
        joined(brand, kind, mpn, size, finish, F.when(F.contains(short, desc), F.lit("")).otherwise(F.substring(desc, 1, 120))),
        retail,
    )


def _struct(*columns: Column) -> Column:
    return F.struct(*[c.alias(k) for k, c in zip(DESCRIPTIONS, columns, strict=True)])


#: grammars by category: add a function of the row's columns to give a category its own
COMPOSERS: dict[str, Callable[[Row], Column]] = {"built_in_dishwasher": dishwasher, "metal_cutoff_disc": abrasive, "grinding_wheel": abrasive, "sanding_abrasive": abrasive}


def descriptions(category: Column, row: Row, composers: dict[str, Callable[[Row], Column]] = COMPOSERS) -> Column:
    """The struct of the category's grammar; ``row`` has brand, maker, product, mpn, desc, values and style."""
    row = row | {k: text(row[k]) for k in ("brand", "maker", "product", "mpn", "desc")}
    names: dict = {}
    for name, make in composers.items():
        names.setdefault(make, []).append(name)
    out = F.when(F.lit(False), generic(row))
    for make, of in names.items():
        out = out.when(category.isin(of), make(row))
    return out.otherwise(generic(row))
