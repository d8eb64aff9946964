"""Catalogue rows from evidence; descriptions are in ``compose``.

Inside the engine the 50 attribute slots are one array of ``struct(label, value, uom)``; ``flatten`` makes the wide
delivery columns at the sink only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import Dims
from ..functions.text import asset_prefix, bare_brand, contains_word, label_key, let, sanitize, text, texts
from ..functions.units import NOT_ATTRIBUTES, cleanse, lookup, uom_fits
from .evidence import fold, is_self_cited, pick_prepared, prepared

SLOTS = 50
SLOT = "struct<label:string,value:string,uom:string>"
#: fixed values: evidence field -> named delivery column
NAMED = {"application": "Application", "includes": "Includes", "with": "With", "gtin": "GTIN", "upc": "UPC", "ean": "EAN", "unspsc": "UNSPSC", "country of origin": "Country Of Origin", "model": "ALTERNATE_PART_NUMBER", "weight": "WEIGHT", "net weight": "WEIGHT", "length": "LENGTH", "height": "HEIGHT", "width": "WIDTH", "volume": "VOLUME", "pack quantity": "Selling Qty", "pack qty": "Selling Qty", "warranty": "Warranty"}
MEASURES = ["WEIGHT", "LENGTH", "HEIGHT", "WIDTH", "VOLUME"]
#: fixed values: material -> colour
MATERIAL_COLOURS = {"Stainless Steel": "Stainless Steel", "Brass": "Brass", "Bronze": "Bronze", "Aluminum": "Aluminum", "PVC": "PVC", "Steel": "Steel"}


def _slot(label: Column, value: Column, uom: Column) -> Column:
    return F.struct(label.alias("label"), value.alias("value"), uom.alias("uom"))


def template_picks(items: Column, category: Column, dims: Dims) -> Column:
    """For every label of the category's template the best item, or null: array of ``struct(label, item)``."""
    table = F.create_map(*[x for k, v in dims.labels.items() for x in (F.lit(k), texts(v))])
    labels = F.coalesce(F.try_element_at(table, category), F.array().cast("array<string>"))
    return let(prepared(items), lambda ready: F.transform(labels, lambda label: F.struct(label.alias("label"), pick_prepared(ready, label, dims.field_aliases).alias("item"))))


def aligned(items: Column, picks: Column) -> Column:
    """The bundle with its picks copied under the template's labels; one from the row itself never replaces."""
    def copies(x: Column) -> Column:
        wanted = F.filter(x["picks"], lambda p: p["item"].isNotNull() & (F.lower(p["item"]["field"]) != F.lower(p["label"])) & ~(F.array_contains(x["low"], F.lower(p["label"])) & is_self_cited(p["item"]["source_url"])))
        return F.transform(wanted, lambda p: p["item"].withField("field", p["label"]))

    told = F.struct(picks.alias("picks"), F.transform(items, lambda x: F.lower(x["field"])).alias("low"))
    return let(F.concat(items, let(told, copies)), lambda every: F.when(F.exists(every, lambda x: ~is_self_cited(x["source_url"])), fold(every)).otherwise(every))


def fill_slots(items: Column, picks: Column, category: Column, product: Column, mpn: Column, dims: Dims) -> Column:
    """A slot for every template label (an empty product type falls back to the product's name), then the items that no
    filled slot and no named column took, in order, while slots are free; all cleansed, in one pass."""
    named = texts([*NAMED, *NOT_ATTRIBUTES, "site_name", "state_name", "category"])
    one = lambda label, field, v, u, first: F.struct(label.alias("l"), label_key(field).alias("k"), text(v).alias("v"), text(u).alias("u"), F.lit(first).alias("t"))
    own = F.transform(picks, lambda p: one(p["label"], p["item"]["field"], p["item"]["value"], p["item"]["uom"], True))
    rest = F.transform(F.filter(items, lambda x: ~x["value"].rlike(r"\{\{|attributeValue")), lambda x: one(x["field"], x["field"], x["value"], x["uom"], False))
    rest = F.filter(rest, lambda e: ~F.array_contains(named, e["k"]))
    clean = F.transform(F.concat(own, rest), lambda e: F.struct(e["l"].alias("l"), e["k"].alias("k"), e["t"].alias("t"), cleanse(e["l"], e["v"], e["u"], category, mpn, dims.lov).alias("c"), (e["t"] | uom_fits(e["l"], e["u"], e["v"])).alias("fits")))

    def slots(x: Column) -> Column:
        value = lambda e: F.when(e["t"] & e["l"].isin("Product Type", "Accessory Type") & (e["c"]["value"] == ""), product).otherwise(e["c"]["value"])
        kept = F.filter(x["done"], lambda e: e["t"] | (e["fits"] & (e["c"]["value"] != "") & ~F.array_contains(x["taken"], e["k"])))
        return F.slice(F.transform(kept, lambda e: _slot(e["l"], value(e), e["c"]["uom"])), 1, SLOTS)

    filled = lambda done: F.filter(done, lambda e: e["t"] & (e["c"]["value"] != ""))
    taken = lambda done: F.flatten(F.transform(filled(done), lambda e: F.array(label_key(e["l"]), e["k"])))
    return let(let(clean, lambda done: F.struct(done.alias("done"), taken(done).alias("taken"))), slots)


def fill_related(slots: Column) -> Column:
    """An empty colour takes the material's, else the finish's; blanks are squashed."""
    value = lambda k: F.coalesce(F.get(F.filter(slots, lambda s: (s["label"] == k) & (s["value"] != "")), F.lit(0))["value"], F.lit(""))
    colour = F.coalesce(lookup(MATERIAL_COLOURS, value("Material")), value("Finish"))
    return F.transform(slots, lambda s: _slot(s["label"], F.trim(F.regexp_replace(F.when((s["label"] == "Color") & (s["value"] == ""), colour).otherwise(s["value"]), r"\s+", " ")), s["uom"]))


def named_columns(items: Column, mpn: Column) -> Column:
    """Map of the named delivery columns: the first item of each, as found (not cleansed)."""
    pairs = F.transform(items, lambda x: F.struct(F.coalesce(lookup(NAMED, label_key(x["field"])), F.lit("")).alias("k"), F.trim(x["value"]).alias("v"), x["uom"].alias("u")))
    fit = F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != "") & ~((p["k"] == "ALTERNATE_PART_NUMBER") & (F.lower(p["v"]) == F.lower(mpn))))
    measures = F.transform(F.filter(fit, lambda p: p["k"].isin(MEASURES) & (p["u"] != "")), lambda p: F.struct(F.concat(p["k"], F.lit("_UOM")).alias("k"), p["u"].alias("v")))
    packs = F.transform(F.filter(fit, lambda p: p["k"] == "Selling Qty"), lambda p: F.struct(F.lit("Standard Packaging Information").alias("k"), F.concat(F.lit("Pack of "), p["v"]).alias("v")))
    every = F.concat(F.transform(fit, lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v"))), measures, packs)
    keys = F.array_distinct(F.transform(every, lambda p: p["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.get(F.filter(every, lambda p: p["k"] == k), F.lit(0))["v"])))


#: fixed values: document columns, the file's tail, and what one of the row's PDF urls must name
DOCUMENTS = [
    ("SDS", "SDS", ["sds", "msds", "safety-data"]), ("Instruction/Installation Manual", "Installation", ["install", "installation"]), ("Owners/User Manual", "Owners_Manual", ["owner", "user-manual", "owners-manual"]),
    ("Warranty Information", "Warranty", ["warranty"]), ("Energy Star Guide", "Energy_Guide", ["energy", "energystar"]),
]
#: fixed values: structured id -> delivery column, in order of precedence
PRODUCT_IDS = [("sku", "PART_NUMBER"), ("productid", "PART_NUMBER"), ("gtin13", "GTIN"), ("gtin12", "UPC"), ("gtin8", "EAN"), ("upc", "UPC"), ("ean", "EAN"), ("unspsc", "UNSPSC"), ("countryoforigin", "Country Of Origin"), ("country", "Country Of Origin"), ("gtin", "GTIN"), ("model", "ALTERNATE_PART_NUMBER")]


def has_image(image_urls: Column) -> Column:
    """A captured image url; neither a page's url nor many attributes are an image."""
    return F.coalesce(F.exists(image_urls, lambda u: F.trim(u) != ""), F.lit(False))


def assets(brand: Column, maker: Column, mpn: Column, ref_urls: Column, image_urls: Column, mfr_url: Column) -> Column:
    """Struct of file names by convention; documents only where a PDF url of the row names their kind, and the first two videos."""
    stem = F.concat_ws("_", asset_prefix(F.when(text(brand) == "", maker).otherwise(text(brand))), F.regexp_replace(mpn, r"[^\p{L}\p{N}_-]+", "_"))
    named = lambda tail: F.concat(stem, F.lit(tail))
    urls = F.coalesce(ref_urls, F.array().cast("array<string>"))
    pdfs = F.array_join(F.filter(F.transform(F.concat(urls, F.array(text(mfr_url))), lambda u: F.lower(u)), lambda u: F.contains(u, F.lit(".pdf"))), " ")
    images = F.coalesce(image_urls, F.array().cast("array<string>"))
    videos = F.array_distinct(F.filter(F.concat(urls, images), lambda u: u.rlike(r"(?i)youtube\.com|youtu\.be|vimeo\.com")))
    out = {"Product Image": named(".jpg")} | {f"Alternate Image {i}": named(f"_{i}.jpg") for i in range(1, 5)} | {"Specification Sheet": named("_Specification_Sheet.pdf"), "Actual Image (Yes/No)": F.when(has_image(images), F.lit("Yes")).otherwise(F.lit("No"))}
    out |= {column: F.when(pdfs.rlike("|".join(marks)), named(f"_{tail}.pdf")).otherwise(F.lit("")) for column, tail, marks in DOCUMENTS}
    out |= {"Video Link": text(F.get(videos, F.lit(0))), "Video Link 1": text(F.get(videos, F.lit(1)))}
    return F.struct(*[c.alias(k) for k, c in out.items()])


def product_ids(ids: Column, items: Column, mpn: Column) -> Column:
    """Map of the id columns: structured ids (a map by lower-case key) first, items named like one fill in; the first filled of
    a column wins, a GTIN of 13 digits is an EAN too and one of 12 a UPC, and the part number is no alternate of itself."""
    known = texts([k for k, _ in PRODUCT_IDS])
    keyed = F.transform(items, lambda x: F.struct(F.regexp_replace(F.lower(x["field"]), r"[^\p{L}\p{N}]", "").alias("k"), F.trim(x["value"]).alias("v")))
    more = F.filter(keyed, lambda x: F.array_contains(known, x["k"]) & (x["v"] != ""))

    def found(m: Column) -> Column:
        """Struct of the values of all ids, each looked up once."""
        get = lambda k: F.coalesce(F.nullif(F.trim(F.try_element_at(ids, F.lit(k))), F.lit("")), F.get(F.filter(m, lambda x: x["k"] == k), F.lit(0))["v"])
        return F.struct(*[get(k).alias(k) for k, _ in PRODUCT_IDS])

    def columns(v: Column) -> Column:
        out: dict[str, list[Column]] = {}
        for k, column in PRODUCT_IDS:
            out.setdefault(column, []).append(F.when(F.lower(v[k]) != F.lower(F.trim(mpn)), v[k]) if column == "ALTERNATE_PART_NUMBER" else v[k])
        gtin = F.coalesce(v["gtin"], v["gtin13"], v["gtin12"], v["upc"])
        out["GTIN"].append(gtin)
        out["EAN"].append(F.when(F.length(gtin) == 13, gtin))
        out["UPC"].append(F.when(F.length(gtin) == 12, gtin))
        pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(*x).alias("v")) for k, x in out.items()])
        return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))

    return let(let(more, found), columns)


def marketing(text_: Column, features: Column) -> Column:
    """Struct of the marketing text (at most 2000 characters) and up to 20 features (240 each), unreadable ones left out."""
    clean = F.filter(F.transform(features, lambda f: sanitize(f)), lambda f: f != "")
    return F.struct(F.substring(sanitize(text_), 1, 2000).alias("MARKETING_DESCRIPTION"), F.transform(F.slice(F.coalesce(clean, F.array().cast("array<string>")), 1, 20), lambda f: F.substring(f, 1, 240)).alias("ITEM_FEATURES"))


def manufacturer_named(maker: Column, brand: Column) -> Column:
    """The maker's name holds the brand's as a word."""
    return contains_word(bare_brand(maker), bare_brand(brand))


def field_sources(items: Column, slots: Column, mfr_url: Column, ref_urls: Column, marketing_text: Column) -> Column:
    """Map of output field -> source.  An item's field cites it, a page before the row itself; a slot cites the best item of its
    label or value, else its label's source, else the maker's page, else the description."""
    own, maker = F.lit("input:Part_Desc"), text(mfr_url)
    cite = lambda x: F.when(x["source_url"] == "", own).otherwise(x["source_url"])
    page = F.coalesce(F.nullif(maker, F.lit("")), own)

    def source(known: Column, key: Column) -> Column:
        """Of a field's items the first from a page, else the first."""
        mine = F.filter(known, lambda x: x["f"] == key)
        return F.coalesce(F.get(F.filter(mine, lambda x: x["live"]), F.lit(0))["u"], F.get(mine, F.lit(0))["u"])

    def slot_source(known: Column, s: Column) -> Column:
        fit = F.filter(known, lambda x: (x["k"] == s["k"]) | (x["v"] == s["v"]))
        best = F.array_max(F.transform(fit, lambda x: F.struct(x["live"], x["c"], x["o"], x["raw"])))
        return F.coalesce(F.nullif(best["raw"], F.lit("")), source(known, s["label"]), page)

    def every(known: Column) -> Column:
        fields = F.transform(F.array_distinct(F.transform(known, lambda x: x["f"])), lambda k: F.struct(k.alias("k"), source(known, k).alias("v")))
        ready = F.transform(slots, lambda s: F.struct(s["label"], label_key(s["label"]).alias("k"), F.lower(F.trim(s["value"])).alias("v")))
        told = F.transform(ready, lambda s, i: F.struct(F.concat(F.lit("ATTRIBUTE_VALUE "), (i + 1).cast("string")).alias("k"), F.when((s["label"] != "") & (s["v"] != ""), slot_source(known, s)).alias("v")))
        refs = F.transform(F.slice(F.coalesce(ref_urls, F.array().cast("array<string>")), 1, 5), lambda u, i: F.struct(F.concat(F.lit("Ref URL "), (i + 1).cast("string")).alias("k"), u.alias("v")))
        rest = [("MFR URL", F.nullif(maker, F.lit(""))), ("MARKETING_DESCRIPTION", F.when(text(marketing_text) != "", F.coalesce(F.nullif(maker, F.lit("")), F.lit("manufacturer"))))]
        rest += [(k, page) for k in ("MOBILE_DESC", "SHORT_DESC", "LONG_DESC1", "RETAIL_DESC", "INVOICE_DESC")]
        return F.filter(F.concat(fields, told, refs, F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in rest])), lambda p: p["v"].isNotNull())

    known = F.transform(items, lambda x, i: F.struct(x["field"].alias("f"), label_key(x["field"]).alias("k"), F.lower(F.trim(x["value"])).alias("v"), cite(x).alias("u"), x["source_url"].alias("raw"), (~is_self_cited(x["source_url"])).alias("live"), x["confidence"].alias("c"), (-i).alias("o")))
    # one entry for a key: an item may be named like an output field; the later one counts
    placed = F.transform(let(known, every), lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i")))
    last = let(placed, lambda all_: F.filter(all_, lambda p: ~F.exists(all_, lambda q: (q["k"] == p["k"]) & (q["i"] > p["i"]))))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def override(slots: Column, label: Column, value: Column, uom: Column) -> Column:
    """Set the slot of a label, or append it while slots are free."""
    same = lambda s: label_key(s["label"]) == label_key(label)
    put = F.transform(slots, lambda s: F.when(same(s), _slot(s["label"], value, uom)).otherwise(s))
    return F.when(label.isNull(), slots).when(F.exists(slots, same), put).otherwise(F.slice(F.concat(slots, F.array(_slot(label, value, uom))), 1, SLOTS))


def flatten(rows: DataFrame, slots: str = "slots") -> DataFrame:
    """Delivery columns ``ATTRIBUTE_LABEL 1`` .. ``ATTRIBUTE_UOM 50``."""
    wide = {}
    for i in range(SLOTS):
        s = F.get(F.col(slots), F.lit(i))
        for part in ("label", "value", "uom"):
            wide[f"ATTRIBUTE_{part.upper()} {i + 1}"] = text(s[part])
    return rows.select("*", *[c.alias(k) for k, c in wide.items()]).drop(slots)


def unflatten(rows: DataFrame, slots: str = "slots") -> DataFrame:
    """The slots array back from wide columns; trailing empty slots are cut."""
    made = F.array(*[_slot(*[text(F.col(f"`ATTRIBUTE_{p} {i}`")) for p in ("LABEL", "VALUE", "UOM")]) for i in range(1, SLOTS + 1)])
    last = reduce(F.greatest, [F.when((text(F.col(f"`ATTRIBUTE_LABEL {i}`")) != "") | (text(F.col(f"`ATTRIBUTE_VALUE {i}`")) != ""), i).otherwise(0) for i in range(1, SLOTS + 1)])
    gone = [f"ATTRIBUTE_{p} {i}" for i in range(1, SLOTS + 1) for p in ("LABEL", "VALUE", "UOM")]
    return rows.withColumn(slots, F.slice(made, F.lit(1), last)).drop(*gone)


def filled(row: list[Column]) -> Column:
    return F.size(F.filter(F.array(*[text(c) for c in row]), lambda v: F.trim(v) != ""))
