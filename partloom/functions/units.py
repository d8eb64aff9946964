"""Units and plausibility of attribute values."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, mapping, strip, text, texts, title

#: fixed values
FINISHES = {"bk": "Black", "blk": "Black", "wh": "White", "wht": "White", "ss": "Stainless Steel", "sst": "Stainless Steel", "bz": "Bronze", "mb": "Mocha Bronze", "brz": "Bronze", "brs": "Brass", "chrome": "Chrome", "mocha": "Mocha Bronze"}
VOLTS = [12, 24, 36, 48, 110, 115, 120, 125, 208, 220, 230, 240, 277, 347, 380, 400, 415, 440, 480, 600]
KELVINS = ["2700K", "3000K", "3500K", "4000K", "5000K", "6500K", "Multi CCT"]
DEFAULT_UNITS = {"Voltage Rating": "V", "Amperage Rating": "A", "Wattage": "W", "Sound Level": "dBA", "Blade Span": "in", "Diameter": "in", "Length": "in", "Width": "in"}
MEASURED = [*DEFAULT_UNITS, "Size"]
NOT_ATTRIBUTES = ["town_name", "sep", "city", "state", "zip", "postal", "address", "phone", "categories"]
MAINS = ["built_in_dishwasher", "cooking_range"]
LIGHTING = ["led_lighting", "ceiling_fan"]

NUMBER = r"\d+(?:-\d+/\d+)?(?:\.\d+)?"
WATT = r"(?:Watts?\b|W(?![A-Za-z/]))"
VOLT = r"(?:VAC|VDC|Volts?\b|V\b)"


def fractions(denominators: tuple[int, ...] = (2, 4, 8, 16, 32, 64)) -> dict[str, str]:
    """Decimal inches of every reduced fraction, keyed without trailing zeros."""
    out = {}
    for d in denominators:
        for n in range(1, d):
            if gcd(n, d) == 1:
                out[f"{n / d:.6f}".rstrip("0")] = f"{n}/{d}"
    return out


def lookup(pairs: dict[str, str], key: Column) -> Column:
    """Value of a small fixed table, null if absent."""
    return F.try_element_at(mapping(pairs), key)


def parse_fraction(x: Column) -> Column:
    return let(strip(x), lambda t: F.when(t.rlike(r"^\d+-\d+/\d+"), F.regexp_extract(t, r"^(\d+-\d+/\d+)", 1)).otherwise(t))


def decimal_to_fraction(x: Column | str) -> Column:
    """0.25 -> 1/4 and 50.25 -> 50-1/4; anything else stays."""

    def of(t: Column) -> Column:
        number = t.try_cast("double")
        whole = F.floor(number)
        key = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", number - whole), "0+$", ""), r"\.$", "")
        found = let(lookup(fractions(), key), lambda part: F.when(whole == 0, part).otherwise(F.concat(whole.cast("string"), F.lit("-"), part)))
        return F.when((t == "") | F.contains(t, F.lit("/")), parse_fraction(t)).when(t.rlike(r"^[0-9]*\.?[0-9]+$"), F.coalesce(found, t)).otherwise(t)

    return let(strip(x), of)


def _pair(value: Column, unit: Column | str) -> Column:
    return F.struct(value.alias("value"), (F.lit(unit) if isinstance(unit, str) else unit).alias("uom"))


def split_value_uom(raw: Column | str, expected: Column | str = "") -> Column:
    """``struct(value, uom)`` by an ordered cascade of unit patterns; a bare number takes the expected unit."""
    return let(F.struct(strip(raw).alias("t"), (F.lit(expected) if isinstance(expected, str) else expected).alias("e")), lambda x: _split(x["t"], x["e"]))


def _split(t: Column, e: Column) -> Column:
    get = lambda p, g=1: F.regexp_extract(t, p, g)
    metric = rf"(?i)^({NUMBER})\s+(mm|cm|m|ft|feet|foot|')$"
    unit = F.lower(get(metric, 2))
    inch = rf'(?i)^({NUMBER})\s*(?:"|in|inch|inches)$'
    bare = rf"^({NUMBER})$"
    v = get(inch)
    inches = F.when(F.contains(v, F.lit(".")), decimal_to_fraction(v)).otherwise(parse_fraction(v))
    b = parse_fraction(get(bare))
    bare_value = F.when(F.lower(e).isin("in", "inch", "inches", '"'), decimal_to_fraction(b)).otherwise(b)
    watt_lead, volt_lead = rf"(?i)^(\d+(?:\.\d+)?)\s*{WATT}", rf"(?i)^(\d{{2,3}})\s*{VOLT}"
    return (
        F.when(t == "", _pair(F.lit(""), ""))
        .when(t.rlike(metric), _pair(parse_fraction(get(metric)), F.when(unit.isin("feet", "foot"), F.lit("ft")).otherwise(unit)))
        .when(t.rlike(r"^\d+(?:\.\d+)?'$"), _pair(get(r"^(\d+(?:\.\d+)?)'$"), "ft"))
        .when(t.rlike(r"(?i)^\d{2,3}\s*(V|VAC|VDC|Volts?)$"), _pair(get(r"^(\d{2,3})"), "V"))
        .when(t.rlike(r"(?i)^\d+(?:\.\d+)?\s*(A|Amps?)$"), _pair(get(r"^(\d+(?:\.\d+)?)"), "A"))
        .when(t.rlike(r"(?i)^\d+(?:\.\d+)?\s*(W|Watts?)$"), _pair(get(r"^(\d+(?:\.\d+)?)"), "W"))
        .when(t.rlike(inch), _pair(inches, F.when(e == "", F.lit("in")).otherwise(e)))
        .when(t.rlike(bare) & (e != ""), _pair(bare_value, e))
        .when(t.rlike(r"(?i)^\d+\s*dBA$"), _pair(get(r"^(\d+)"), F.when(e == "", F.lit("dBA")).otherwise(e)))
        .when((e != "") & t.rlike(rf"(?i)\d+(?:\.\d+)?\s*{WATT}") & ~F.upper(e).isin("W", "WATT", "WATTS"), _pair(F.when(t.rlike(watt_lead), get(watt_lead)).otherwise(t), "W"))
        .when((e != "") & t.rlike(rf"(?i)\d+(?:\.\d+)?\s*{VOLT}") & ~F.upper(e).isin("V", "VAC", "VDC", "VOLT", "VOLTS"), _pair(F.when(t.rlike(volt_lead), get(volt_lead)).otherwise(t), "V"))
        .otherwise(_pair(t, e))
    )


def dimension_list(x: Column | str) -> Column:
    """``24 in x 34.5`` -> ``24" x 34-1/2"``."""

    def part(p: Column) -> Column:
        s = split_value_uom(p, "in")
        return F.when((s["uom"] == "in") & ~F.contains(s["value"], F.lit('"')) & (s["value"] != ""), F.concat(s["value"], F.lit('"'))).otherwise(s["value"])

    return F.array_join(F.filter(F.transform(F.split(text(x), r"\s*[xX×]\s*"), part), lambda v: v != ""), " x ")


def split_tail(x: Column | str) -> Column:
    """``12.5 lbs`` -> (12.5, lbs) for values of at most four words."""
    t = text(x)
    tail = r"(?i)^(.+?)\s+(in|inch|inches|mm|cm|lb|lbs|kg|oz|rpm|v|volts?|a|amps?|w|watts?)$"
    short = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")) <= 4
    return F.when(short & t.rlike(tail), _pair(F.trim(F.regexp_extract(t, tail, 1)), F.trim(F.regexp_extract(t, tail, 2)))).otherwise(_pair(t, ""))


def unit_family(uom: Column | str) -> Column:
    u = F.regexp_replace(F.lower(strip(uom)), r"\.+$", "")
    return F.when(u.isin("v", "vac", "vdc", "volt", "volts"), F.lit("voltage")).when(u.isin("a", "amp", "amps"), F.lit("amperage")).when(u.isin("w", "watt", "watts"), F.lit("wattage")).otherwise(F.lit(""))


def text_family(x: Column) -> Column:
    n = r"(?i)\d+(?:\.\d+)?\s*"
    return F.when(x.rlike(n + WATT), F.lit("wattage")).when(x.rlike(n + VOLT), F.lit("voltage")).when(x.rlike(n + r"(?:Amps?\b|A\b)"), F.lit("amperage")).otherwise(F.lit(""))


def uom_fits(label: Column, uom: Column, value: Column) -> Column:
    """False when a physical unit stands under a label of another quantity."""
    return family_fits(label, quantity(value, uom))


def quantity(value: Column, uom: Column) -> Column:
    """voltage, amperage or wattage if the value or the unit says so, else ''."""
    seen = let(F.trim(F.concat_ws(" ", text(value), text(uom))), text_family)
    return let(seen, lambda x: F.when(x != "", x).otherwise(unit_family(uom)))


def family_fits(label: Column, family: Column) -> Column:
    want = F.when(label == "Voltage Rating", F.lit("voltage")).when(label == "Amperage Rating", F.lit("amperage")).when(label == "Wattage", F.lit("wattage"))
    return F.when(want.isNull(), F.lit(True)).otherwise(let(family, lambda x: (x == "") | (x == want)))


def is_junk(x: Column | str) -> Column:
    return let(strip(x), lambda t: t.rlike(r"(?i)\{\{|\}\}|attributeValue") | is_hex_colour(t))


def is_hex_colour(t: Column) -> Column:
    return t.rlike(r"^#(?:[0-9a-fA-F]{3}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})$")


def _first_number(x: Column) -> Column:
    return F.regexp_extract(text(x), r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def plausible_voltage(value: Column, category: Column) -> Column:
    return let(_first_number(value), lambda n: _voltage_ok(n, category))


def _voltage_ok(n: Column, category: Column) -> Column:
    mains = category.isin(MAINS)
    listed = n.isin([float(v) for v in VOLTS])
    ranged = F.when(mains, n.between(110, 600)).otherwise(n.between(12, 600)) & (n == F.floor(n))
    return F.coalesce(F.when(listed, ~(mains & (n < 110))).otherwise(ranged), F.lit(False))


def plausible_wattage(value: Column, category: Column) -> Column:
    return let(_first_number(value), lambda n: F.coalesce(F.when(category.isin(LIGHTING), n.between(1, 400)).otherwise(n.between(10, 20000)), F.lit(False)))


def plausible_size(value: Column) -> Column:
    return let(strip(value), _size_ok)


def _size_ok(t: Column) -> Column:
    free = F.contains(F.lower(t), F.lit("x")) | F.contains(t, F.lit('"')) | t.rlike(r"(?i)\bin\b") | ~t.rlike(r"^\d+(?:\.\d+)?$")
    return (t != "") & ~is_junk(t) & (free | F.coalesce(t.try_cast("double").between(8, 96), F.lit(False)))


def plausible_with(value: Column) -> Column:
    return let(strip(value), lambda t: (t != "") & ~is_junk(t) & ~t.rlike("(?i)with more than") & ~F.lower(t).isin("with", "more than"))


def finish(x: Column | str) -> Column:
    return let(strip(x), lambda t: F.when(t == "", t).otherwise(F.coalesce(lookup(FINISHES, F.replace(F.lower(t), F.lit("."), F.lit(""))), title(t))))


def mounting(x: Column | str) -> Column:
    def of(t: Column) -> Column:
        k = F.translate(F.lower(t), "-", " ")
        return F.when(k.isin("built in", "builtin", "blt in", "bltln"), F.lit("Built-in")).when(k == "leg", F.lit("Leg")).otherwise(t)

    return let(strip(x), of)


def colour_temperature(value: Column | str, mpn: Column, allowed: list[str] = KELVINS) -> Column:
    """A standard colour temperature; '' if its digits come from the part number."""
    return let(strip(value), lambda t: _kelvin(t, mpn, allowed))


def _kelvin(t: Column, mpn: Column, allowed: list[str]) -> Column:
    low = F.regexp_replace(F.lower(t), r"\s+", " ")
    k = F.regexp_extract(t, r"(?i)(\d{4})\s*k\b", 1)
    compact = F.regexp_replace(F.upper(text(mpn)), "[^A-Z0-9]", "")

    def of(kelvin: Column) -> Column:
        token = F.concat(kelvin, F.lit("K"))
        return F.when((kelvin != "") & ~F.contains(compact, kelvin) & token.isin(allowed), token).otherwise(F.lit(""))

    found = let(F.when(k != "", k).otherwise(F.regexp_extract(t, r"^(\d{4})$", 1)), of)
    return F.when(F.contains(low, F.lit("multi")) & F.contains(low, F.lit("cct")), F.lit("Multi CCT")).otherwise(found)


def lov_value(label: Column, value: Column, category: Column, lov: dict[str, dict[str, list[str]]]) -> Column:
    """Spelling of the list of values of (category, label): exact, then by mounting form, then any case."""
    pairs = [(f"{cat}|{lab}", allowed) for cat, labels in lov.items() for lab, allowed in labels.items()]
    if not pairs:
        return value
    table = F.create_map(*[x for k, allowed in pairs for x in (F.lit(k), texts(allowed))])

    def of(x: Column) -> Column:
        folded = F.get(F.filter(x["allowed"], lambda a: F.lower(a) == F.lower(x["norm"])), F.lit(0))
        return F.when(x["allowed"].isNull() | F.array_contains(x["allowed"], value), value).when(F.array_contains(x["allowed"], x["norm"]), x["norm"]).otherwise(F.coalesce(folded, x["norm"]))

    norm = F.when(label == "Mounting Type", mounting(value)).otherwise(value)
    return let(F.struct(F.try_element_at(table, F.concat_ws("|", category, label)).alias("allowed"), norm.alias("norm")), of)


def cleanse(label: Column, value: Column, uom: Column, category: Column, mpn: Column, lov: dict[str, dict[str, list[str]]] | None = None) -> Column:
    """``struct(value, uom)`` fit for publication; both are '' for a value that must not be published."""
    row = F.struct(label.alias("label"), text(value).alias("value"), text(uom).alias("uom"), category.alias("category"), text(mpn).alias("mpn"))
    return let(row, lambda x: _cleanse(x["label"], x["value"], x["uom"], x["category"], x["mpn"], lov or {}))


def _cleanse(label: Column, value: Column, uom: Column, category: Column, mpn: Column, lov: dict) -> Column:
    empty = _pair(F.lit(""), "")
    low = F.lower(label)
    dropped = is_junk(value) | ((label != "") & (F.lower(value) == low)) | ((mpn != "") & (F.lower(value) == F.lower(mpn)) & ~low.isin("model", "alternate_part_number", "sku"))
    dropped = dropped | low.isin(NOT_ATTRIBUTES) | ((label == "With") & ~plausible_with(value))
    expected = F.when(uom != "", uom).otherwise(F.coalesce(lookup(DEFAULT_UNITS, label), F.lit("")))

    def measured(p: Column) -> Column:
        unit = F.when(p["uom"] != "", p["uom"]).otherwise(uom)
        wrong = ~uom_fits(label, unit, p["value"]) | ((label == "Voltage Rating") & ~plausible_voltage(p["value"], category)) | ((label == "Wattage") & ~plausible_wattage(p["value"], category)) | ((label == "Size") & ~plausible_size(p["value"]))
        return F.when(wrong, empty).otherwise(_pair(p["value"], unit))

    return (
        F.when(value == "", _pair(value, uom))
        .when(dropped, empty)
        .when(label == "Color Temperature", _pair(colour_temperature(value, mpn), ""))
        .when(~uom_fits(label, uom, value), empty)
        .when(label.isin("Finish", "Color"), _pair(finish(value), uom))
        .when(label == "Mounting Type", _pair(mounting(value), uom))
        .when(label.isin(MEASURED), let(split_value_uom(value, expected), measured))
        .otherwise(_pair(lov_value(label, value, category, lov), uom))
    )


def comparable(value: Column | str, uom: Column | str = "") -> Column:
    """The form in which two measurements are compared: entities, quotes, unit tails and trailing zeros removed."""
    from .text import unescape

    u = strip(uom if not isinstance(uom, str) else F.lit(uom))
    t = F.translate(unescape(value), "“”″‟", '""""')
    t = F.regexp_replace(F.regexp_replace(t, r"\s+", " "), "^[ \t\"']+|[ \t\"']+$", "")
    bare = lambda t: F.trim(F.regexp_replace(t, r"(?i)\s*(?:inches|inch|in|mm|cm|ft|feet|lbs?|kg|oz|rpm|volts?|v|amps?|a|watts?|w|dba)\.?$", ""))
    core = lambda t: F.when(u == "", bare(t)).otherwise(F.trim(F.regexp_replace(bare(t), F.concat(F.lit(r"(?i)\s*\Q"), u, F.lit(r"\E\s*$")), F.lit(""))))
    plain = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    number = lambda t: let(plain(core(t)), lambda c: F.when(c.rlike(r"^[\d./]+$"), c).otherwise(plain(t)))
    whole = lambda c: F.when(c.rlike(r"^\d+\.0+$"), F.substring_index(c, ".", 1)).when(c.rlike(r"^\.\d+$"), F.concat(F.lit("0"), c)).otherwise(c)
    return let(let(t, number), whole)


def equivalent(a: Column, b: Column, uom: Column) -> Column:
    return let(comparable(a, uom), lambda x: (x != "") & (x == comparable(b, uom)))


def product_size_ok(x: Column | str) -> Column:
    """A size of a product, not the pixels of a page: with a unit or an ``x``, or a bare number from 8 to 96."""
    t = strip(x)
    number = F.regexp_extract(F.replace(t, F.lit(","), F.lit("")), r"^(\d+(?:\.\d+)?)$", 1)
    return (t != "") & (t.rlike(r'(?i)in|inch|"|\bx\b') | (number == "") | F.coalesce(number.try_cast("double").between(8, 96), F.lit(False)))


def needles(value: Column | str, uom: Column | str) -> Column:
    """Distinct surface forms under which a page may give a measurement, in order; none for values under two characters."""
    from .text import unescape

    raw = strip(unescape(value))
    told = F.struct(raw.alias("raw"), F.lower(raw).alias("low"), F.lower(text(uom)).alias("u"), comparable(raw, uom).alias("n"))

    def forms(x: Column) -> Column:
        bare = F.btrim(x["low"], F.lit(" \"'"))
        inches = x["u"].isin("in", "inch", "inches")
        own = F.array(x["low"], bare, F.when(x["u"] != "", F.concat(bare, F.lit(" "), x["u"])))
        more = [F.when(inches, F.concat(bare, F.lit(t))) for t in ('"', "-inch", " inch", " in")]
        new = (x["n"] != "") & ~F.array_contains(F.array(x["low"], bare), x["n"])
        tail = [F.when(new, x["n"]), *[F.when(new & (inches | x["raw"].endswith('"')), F.concat(x["n"], F.lit(t))) for t in ('"', " in", "-inch")]]
        every = F.filter(F.concat(own, F.array(*more, *tail)), lambda p: p.isNotNull() & (p != ""))
        low = F.transform(every, lambda p: F.lower(p))
        return F.when(F.length(x["raw"]) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.filter(F.transform(every, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda e: F.array_position(low, F.lower(e["p"])) == e["i"] + 1), lambda e: e["p"]))

    return let(told, forms)
