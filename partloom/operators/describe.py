"""Evidence from product descriptions, as arrays of items built by expressions.

Each extractor is a list of candidate items in the order of its rules; an item whose value is empty does not count.  All
items cite the row itself, so a bundle is its candidates under ``evidence.best``, and bundles merge by concatenation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let, literal, text, title
from ..functions.units import WATT, colour_temperature, dimension_list, lookup, split_value_uom
from .evidence import best

#: fixed values: the patterns of the surveyed extractors
SIDE = r'\d+(?:-\d+/\d+)?(?:\.\d+)?(?:"|in)?'
P = {
    "diameter": r'(?i)(\d+(?:-\d+/\d+)?|\d+(?:\.\d+)?)\s?(?:"|in\b)',
    "thickness": r'(?i)(\.\d+|\d+/\d+)\s?(?:"|x|\b)',
    "grit": r"\bP(\d{2,3})\b",
    "grit_any_case": r"(?i)\bP(\d{2,3})\b",
    "grit_plain": r"(?i)\b(\d{2,3})\s*grit\b",
    "plain_sides": r"(\d+(?:\.\d+)?)\s?[xX]\s?(\d+(?:\.\d+)?)",
    "abrasive_use": "(?i)(Metal Cut Off Disc|Metal Cut-Off Disc|Sanding Belt|Sanding Sponge|Stikit Film|Abranet|Sanding Disc|HIOLIT|Screw Setter)",
    "abrasive_kind": "(?i)(Sanding Sponge|Sanding Belt|Sanding Disc|Screw Setter|Cut[- ]?Off Disc|Grinding Wheel)",
    "abrasive_pack": r"(?i)(\d+)\s?(?:pc|pk|disc|box)\b",
    "grain": r"(?i)(Aluminum Oxide|Silicon Carbide|Zirconia Alumina|Ceramic Alumina|Ceramic)\b",
    "sides": rf"({SIDE}\s*[xX×]\s*{SIDE}(?:\s*[xX×]\s*{SIDE})?)",
    "run": r"(?i)(\d+(?:'\d+)?|\d+(?:\.\d+)?)\s?(?:'|ft|foot|feet|\d+\s*in|\")",
    "width": r'(?i)(\d+(?:\.\d+)?)\s?(?:"|in)\s*(?:range|wide|w\b)',
    "span": r'(?i)(\d+(?:\.\d+)?)\s?(?:"|in)\s*(?:wh|mb|bz)?\s*(?:gilmour|hunter|fan)',
    "span_plain": r'(\d+(?:\.\d+)?)\s?(?:"|in)',
    "gang": r"(\d)\s?[gG]",
    "watt": rf"(?i)(\d+(?:\.\d+)?)\s*{WATT}",
    "volt": r"(?i)(\d{2,3})\s?(?:VAC|VDC|Volts?\b|V\b)",
    "pressure": r"(\d+)\s?#",
    "kelvin": r"(?i)(multi\s*cct|\b(?:2700|3000|3500|4000|5000|6500)\s*k\b)",
    "finish": r"(?i)\b(BK|Black|White|SS|Stainless|Bronze|Mocha|Chrome|Brass|BZ|BRS)\b",
    "material": r"(?i)\b(PVC|Aluminum|Steel|Stainless Steel|Plastic|Brass|Bronze|Galvanized)\b",
    "pack": r"(?i)(\d+)\s?(?:pc|pk|pack|box|disc)\b",
    "fuel": r"(?i)\b(Electric|Gas|Dual Fuel)\b",
    "application": "(?i)(Metal Cut Off Disc|Box Cover|Range|Fan|LED|Drill|Mortar|Coupling|Pipe Fitting|Electrical Box|Abrasive)",
    "pipe": r'(?i)(?:(\d+(?:/\d+)?(?:-\d+/\d+)?)\s*(?:"|in)?\s+)?(coupling|cplg|cpl|elbow|tee|adapter|adpt|nipple|union|bushing|plug|cap|valve|flange)(?:\s+(brass|brs|bronze|brz|steel|ss|stainless|pvc|galv|copper|alum|aluminum))?(?:\s+(\d+)\s*#)?',
    "three_sides": r'(\d+(?:-\d+/\d+)?(?:\.\d+)?)\s*(?:"|in)\s*[xX×]\s*(\d+(?:-\d+/\d+)?(?:\.\d+)?)\s*(?:"|in)?(?:\s*[xX×]\s*(\d+(?:-\d+/\d+)?(?:\.\d+)?)\s*(?:"|in)?)?',
    "deck_colour": r"\b(black|white|gray|grey|brown|sand|shell|tiki|firepit)\b",
    "feet": r"(?i)(\d+(?:'\d+)?|\d+(?:\.\d+)?)\s?(?:'|ft|foot)",
    "gauge": r"\b(\d{1,2})\s?(?:ga|awg|gauge)\b",
    "tape": r"(\d+(?:\.\d+)?)\s?[xX×]\s?(\d+(?:'\d+)?|\d+(?:\.\d+)?)",
    "series": r"(?i)\b(Profile|Ultra|Pro|Max|Elite|Premium)\b",
}
#: fixed values: the kinds of the industrial extractor, in order: pattern on the lower-cased text, product type, application
KINDS = [
    (r"\bmortar\b|\bgrout\b", "Mortar Mix", "Masonry"),
    (r"\btrex\b|\bdeck(?:ing)?\b|\bfascia\b|\brail\b|\bgrooved\b", "Composite Decking", "Decking"),
    (r"\bwire\b|\bcable\b|\bromex\b|\bthhn\b", "Electrical Wire", ""),
    (r"\btape\b|\belect tape\b", "Electrical Tape", ""),
]
#: fixed values: spellings of finishes and of fitting materials
SHADES = {"bk": "Black", "ss": "Stainless Steel", "bz": "Bronze", "brs": "Brass"}
METALS = {"brs": "Brass", "brz": "Bronze", "ss": "Stainless Steel", "galv": "Galvanized", "alum": "Aluminum"}
#: fixed values: ordered (category, pattern on the lower-cased text, product type); an empty pattern is the category's rest
TYPES = [
    ("led_lighting", "strip", "LED Strip Light"), ("led_lighting", "ceiling", "LED Ceiling Light"), ("led_lighting", "wall", "Wall Light"), ("led_lighting", "bath", "Bath Light"),
    ("deck_composite", "fascia", "Composite Fascia Board"), ("deck_composite", "rail", "Composite Railing"), ("deck_composite", "", "Composite Decking Board"),
    ("pipe_fitting", "", "Pipe Coupling"), ("electrical_box", "", "Electrical Box Cover"), ("ceiling_fan", "", "Ceiling Fan"),
    ("cooking_range", "electric", "Electric Range"), ("cooking_range", "gas", "Gas Range"), ("cooking_range", "", "Range"),
    ("power_tool_accessory", "screw setter", "Screw Setter"), ("power_tool_accessory", "countersink|drill", "Drill Bit"), ("power_tool_accessory", "blade", "Saw Blade"), ("power_tool_accessory", "", "Power Tool Accessory"),
    ("generic_industrial", "cplg|coupling", "Coupling"), ("generic_industrial", "elbow|tee|adapter|adpt", "Pipe Fitting"), ("generic_industrial", "mortar|grout", "Mortar Mix"),
]

#: (field, value, unit, confidence): an empty or null value does not count
Rule = tuple[str, Column, Column | str, float]


def _bundle(quote: Column | None, extractor: str, *rules: Rule) -> Column:
    """Items of the rules whose value is filled, in order.  What is constant about the rules is one array literal, so that a rule
    costs its value only.  Without a quote each item quotes its own value."""
    unit = lambda u: literal(u) if isinstance(u, str) else "''"
    known = F.expr("array(" + ", ".join(f"named_struct('f', {literal(f)}, 'u', {unit(u)}, 'c', {c}D)" for f, _, u, c in rules) + ")")
    own = F.array(*[v for _, v, _, _ in rules])
    made = F.zip_with(known, own, lambda k, v: F.struct(k["f"].alias("f"), v.alias("v"), k["u"].alias("u"), k["c"].alias("c")))
    if any(not isinstance(u, str) for _, _, u, _ in rules):
        units = F.array(*[F.lit(None).cast("string") if isinstance(u, str) else u for _, _, u, _ in rules])
        made = F.zip_with(made, units, lambda x, u: x.withField("u", F.coalesce(u, x["u"])))
    said = F.lit(None) if quote is None else F.substring(quote, 1, 120)
    full = lambda x: F.struct(x["f"].alias("field"), x["v"].alias("value"), x["u"].alias("uom"), F.lit("input:Part_Desc").alias("source_url"), F.substring(x["v"], 1, 120).alias("quote") if quote is None else said.alias("quote"), F.lit(extractor).alias("extractor"), x["c"].alias("confidence"))
    return F.transform(F.filter(made, lambda x: x["v"] != ""), full)


def _found(t: Column, names: list[str], more: dict[str, Column] | None = None) -> Column:
    """Struct of the first matches of the named patterns (a digit after a colon picks a group), each looked for once."""
    pick = lambda n: F.regexp_extract(t, P[n.partition(":")[0]], int(n.partition(":")[2] or 1))
    return F.struct(*[pick(n).alias(n.replace(":", "_")) for n in names], *[c.alias(k) for k, c in (more or {}).items()])


def _only(condition: Column, value: Column) -> Column:
    return F.when(condition, value)


def _around(head: str, x: Column, tail: str = "") -> Column:
    return F.when(x != "", F.concat(F.lit(head), x, F.lit(tail)))


def abrasive(desc: Column) -> Column:
    """Diameter, thickness, grit, application, type, pack and grain of abrasives."""

    def items(x: Column) -> Column:
        use = F.when(F.upper(x["abrasive_use"]) == "HIOLIT", F.lit("Sanding Disc")).otherwise(x["use"])
        plain = _only(x["grit_any_case"] == "", x["grit_plain"])
        return _bundle(
            x["t"], "desc_regex",
            ("Diameter", _around("", x["diameter"], '"'), "", 0.7),
            ("Thickness", _only(~x["t"].rlike(r"P\d{2,3}\b"), x["thickness"]), "", 0.65),
            ("Grit", _around("P", x["grit_any_case"]), "", 0.7),
            ("Additional Information", _around("P", x["grit_any_case"], " Grit"), "", 0.7),
            ("Grit", plain, "", 0.7),
            ("Additional Information", _only(x["grit_any_case"] == "", _around("", x["grit_plain"], " Grit")), "", 0.65),
            ("Diameter", _only((x["diameter"] == "") & (x["plain_sides"] != ""), F.concat(x["plain_sides"], F.lit("x"), x["plain_sides_2"])), "", 0.6),
            ("Application", use, "", 0.65),
            ("Product Type", use, "", 0.6),
            ("Product Type", _only(x["abrasive_use"] == "", x["kind"]), "", 0.6),
            ("Pack Quantity", x["abrasive_pack"], "", 0.6),
            ("Abrasive Material", x["grain"], "", 0.6),
        )

    names = ["diameter", "thickness", "grit_any_case", "grit_plain", "plain_sides", "plain_sides:2", "abrasive_use", "abrasive_pack"]
    more = lambda t: {"t": t, "use": title(F.regexp_extract(t, P["abrasive_use"], 1)), "kind": title(F.regexp_extract(t, P["abrasive_kind"], 1)), "grain": title(F.regexp_extract(t, P["grain"], 1))}
    return let(text(desc), lambda t: best(let(_found(t, names, more(t)), items)))


def product_type(desc: Column, category: Column, product: Column) -> Column:
    low = F.lower(desc)
    out = F.when(F.lit(False), product)
    for cat, pattern, name in TYPES:
        out = out.when((category == cat) & (low.rlike(pattern) if pattern else F.lit(True)), F.lit(name))
    return out.otherwise(product)


def generic(desc: Column, mpn: Column, category: Column, product: Column) -> Column:
    """Type, size, length, width, span, gang, watts, volts, pressure, colour temperature, finish, material, grit, pack,
    diameter, fuel and application."""

    def measured(x: Column) -> Column:
        """The values that take more than one pattern."""
        size = dimension_list(x["sides"])
        hay = F.when(x["m"] == "", x["t"]).otherwise(F.regexp_replace(x["t"], F.concat(F.lit(r"(?i)\Q"), x["m"], F.lit(r"\E")), F.lit(" ")))
        return F.struct(
            x.alias("x"), size.alias("size"), split_value_uom(F.trim(x["run_0"])).alias("run"), colour_temperature(F.regexp_extract(hay, P["kelvin"], 1), x["m"]).alias("kelvin"),
            F.coalesce(lookup(SHADES, F.lower(x["finish"])), title(x["finish"])).alias("shade"), product_type(x["t"], x["c"], x["p"]).alias("kind"),
        )

    def items(y: Column) -> Column:
        x = y["x"]
        rough = x["c"] == "generic_industrial"
        run = _only((y["size"] == "") & (x["run_0"] != ""), y["run"]["value"])
        span = F.when(x["span"] != "", x["span"]).when(F.contains(F.lower(x["t"]), F.lit("fan")), x["span_plain"])
        return _bundle(
            x["t"], "generic_desc_parser",
            ("Product Type", _only(rough, y["kind"]), "", 0.55), ("Product Type", _only(~rough, y["kind"]), "", 0.7),
            ("Size", y["size"], "in", 0.65), ("Length", y["size"], "in", 0.65),
            ("Length", run, y["run"]["uom"], 0.65), ("Size", run, y["run"]["uom"], 0.65),
            ("Width", x["width"], "in", 0.65), ("Blade Span", span, "in", 0.65), ("Gang Count", x["gang"], "", 0.65), ("Wattage", x["watt"], "W", 0.65), ("Voltage Rating", x["volt"], "V", 0.7),
            ("Pressure Rating", x["pressure"], "PSI", 0.65), ("Color Temperature", y["kelvin"], "", 0.65), ("Finish", y["shade"], "", 0.65), ("Color", y["shade"], "", 0.65), ("Material", x["metal"], "", 0.65),
            ("Grit", F.coalesce(_around("P", x["grit_any_case"]), x["grit_plain"]), "", 0.65), ("Pack Quantity", x["pack"], "", 0.65),
            ("Diameter", _only(x["c"].isin("power_tool_accessory", "metal_cutoff_disc"), x["diameter"]), "in", 0.65), ("Fuel Type", x["power"], "", 0.65), ("Application", x["use"], "", 0.65),
        )

    names = ["sides", "run:0", "span", "span_plain", "width", "gang", "watt", "volt", "pressure", "finish", "grit_any_case", "grit_plain", "pack", "diameter"]
    more = lambda v: {"t": v["d"], "m": v["m"], "c": v["c"], "p": v["p"], "metal": title(F.regexp_extract(v["d"], P["material"], 1)), "power": title(F.regexp_extract(v["d"], P["fuel"], 1)), "use": title(F.regexp_extract(v["d"], P["application"], 1))}
    told = F.struct(text(desc).alias("d"), text(mpn).alias("m"), category.alias("c"), text(product).alias("p"))
    return let(told, lambda v: best(let(let(_found(v["d"], names, more(v)), measured), items)))


def industrial(desc: Column) -> Column:
    """Pipe fittings alone; else dimensions, one of mortar, deck, wire or tape, and grit."""

    def kinds(t: Column) -> dict[str, Column]:
        low = F.lower(t)
        which = F.lit(0)
        for i, (pattern, _, _) in reversed(list(enumerate(KINDS, 1))):
            which = F.when(low.rlike(pattern), F.lit(i)).otherwise(which)
        metal = F.regexp_extract(t, P["pipe"], 3)
        return {"t": t, "which": F.when(t.rlike(P["pipe"]), F.lit(-1)).otherwise(which), "fitting": F.replace(title(F.regexp_extract(t, P["pipe"], 2)), F.lit("Cplg"), F.lit("Coupling")), "metal": let(metal, lambda m: F.coalesce(lookup(METALS, F.lower(m)), title(m))),
                "colour": title(F.regexp_extract(low, P["deck_colour"], 1)), "gauge": F.regexp_extract(low, P["gauge"], 1)}

    def items(x: Column) -> Column:
        pipe = x["which"] == -1
        size = x["pipe_1"]
        inches = F.when((size == "") | F.contains(x["t"], F.lit('"')) | F.contains(F.lower(x["t"]), F.lit("in")), size).otherwise(F.concat(size, F.lit('"')))
        dims = F.array_join(F.transform(F.filter(F.array(x["three_sides_1"], x["three_sides_2"], x["three_sides_3"]), lambda v: v != ""), lambda v: F.concat(v, F.lit('"'))), " x ")
        of = lambda k: _only(x["which"] > 0, F.element_at(F.array(*[F.lit(r[k]) for r in KINDS]), F.greatest(x["which"], F.lit(1))))
        deck, wire, tape = (x["which"] == n for n in (2, 3, 4))
        return _bundle(
            None, "industrial_parser",
            ("Product Type", _only(pipe, x["fitting"]), "", 0.72), ("Size", _only(pipe, inches), "in", 0.72), ("Material", _only(pipe, x["metal"]), "", 0.72), ("Color", _only(pipe, x["metal"]), "", 0.72),
            ("Pressure Rating", _only(pipe, x["pipe_4"]), "PSI", 0.72), ("Application", _only(pipe, F.lit("Pipe Fitting")), "", 0.72),
            ("Size", _only(~pipe, dims), "in", 0.72), ("Length", _only(~pipe, dims), "in", 0.72), ("Product Type", of(1), "", 0.72), ("Application", of(2), "", 0.72),
            ("Color", _only(deck, x["colour"]), "", 0.72), ("Length", _only(deck, x["feet"]), "ft", 0.72), ("Wire Gauge", _only(wire, x["gauge"]), "AWG", 0.72),
            ("Width", _only(tape, x["tape"]), "in", 0.72), ("Length", _only(tape, x["tape_2"]), "ft", 0.72), ("Grit", _only(~pipe, _around("P", x["grit"])), "", 0.72),
        )

    names = ["pipe:1", "pipe:4", "three_sides:1", "three_sides:2", "three_sides:3", "feet", "tape", "tape:2", "grit"]
    return let(F.trim(text(desc)), lambda t: best(let(_found(t, names, kinds(t)), items)))


def smart(desc: Column, category: Column, parsed: Column) -> Column:
    """A guess of last resort after ``parsed``, the industrial items: the first four tokens name a generic product; grinding
    wheels are known by their words."""

    def items(t: Column) -> Column:
        tokens = F.slice(F.regexp_extract_all(t, F.lit(r'([A-Za-z0-9/"\.]+)'), F.lit(1)), 1, 4)
        grinding = F.lower(t).rlike("grind(?:ing)? wheel|cut and grind|dual metal")
        return _bundle(
            t, "smart_infer",
            ("Product Type", _only((category == "generic_industrial") & (F.size(parsed) < 2), F.array_join(tokens, " ")), "", 0.45),
            ("Product Type", _only(grinding, F.lit("Grinding Wheel")), "", 0.7), ("Application", _only(grinding, F.lit("Metal Grinding")), "", 0.65),
        )

    return let(text(desc), items)


def dishwasher(desc: Column, mpn: Column, items: Column) -> Column:
    """``items`` and the fields of dishwashers that the description names and the bundle lacks."""

    def more(x: Column) -> Column:
        t = x["t"]
        lacks = lambda field: ~F.array_contains(x["have"], field.lower())
        add = lambda field, value, c: (field, _only(lacks(field), value), "", c)
        steel, built = F.lit("Stainless Steel"), t.rlike("(?i)Built.?in|BLTLN")
        return _bundle(
            t, "dishwasher_desc_fallback",
            add("Model", x["m"], 0.9), add("Material", _only(x["steel"], steel), 0.7), add("Color", _only(x["steel"], steel), 0.65), add("Color", _only(~x["steel"] & t.rlike(r"(?i)\bBlack\b"), F.lit("Black")), 0.65),
            add("Mounting Type", F.when(built, F.lit("Built-in")).when(t.rlike(r"(?i)\bLeg\b"), F.lit("Leg")), 0.6), add("Series", x["series"], 0.55),
        )

    told = lambda t: F.struct(t.alias("t"), text(mpn).alias("m"), F.transform(items, lambda i: F.lower(i["field"])).alias("have"), t.rlike(r"(?i)\bSS\b|Stainless").alias("steel"), title(F.regexp_extract(t, P["series"], 1)).alias("series"))
    return F.concat(items, let(let(text(desc), told), more))
