import pytest
from pyspark.sql import functions as F

from partloom.functions import mpn, text, units, urls
from partloom.operators import analyze

L = F.lit


@pytest.mark.parametrize("f,given,want", [
    (mpn.normalize, "54151-JR-UPC", "54151-JR"), (mpn.normalize, " ab 12-bx ", "AB12"), (mpn.search, "WDTS7024RZ", "WDTS7024R"), (mpn.search, "ABZ", "ABZ"),
    (lambda x: mpn.catalog(x, L("3M")), "3MABR-7100075678", "7100075678"), (lambda x: mpn.catalog(x, L("Milwaukee")), "49-94-0013", "49-94-0013"),
    (mpn.catalog_search, "WDTS7024RZ", "WDTS7024R"), (mpn.catalog_search, "DCB518ASTS06G", "DCB518ASTS06G"),
    (text.title, "metal cut-off disc 3rd", "Metal Cut-Off Disc 3Rd"), (text.clean_brand, "-- No DIB Brand--", ""), (text.clean_brand, " Trex ", "Trex"), (text.strip, " a\t", "a"),
    (text.sanitize, "ok\x00\x04binary", ""), (text.sanitize, "%PDF-1.4", ""), (text.sanitize, "fine", "fine"), (text.clean_label, " Arbor  Size: ", "Arbor Size"), (text.file_key, "", "UNKNOWN"),
    (text.file_key, "ab/1 c", "AB_1_C"), (text.asset_prefix, "Speed Queen®", "Speed_Queen"), (units.decimal_to_fraction, "50.25", "50-1/4"), (units.decimal_to_fraction, "0.25", "1/4"),
    (units.decimal_to_fraction, "0.3", "0.3"), (units.finish, "S.S.", "Stainless Steel"), (units.mounting, "BUILT-IN", "Built-in"), (units.dimension_list, "24 x 34.5 in", '24" x 34-1/2"'),
    (lambda x: units.colour_temperature(x, L("SMC2266KS")), "2266K", ""), (lambda x: units.colour_temperature(x, L("S11828")), "4000K", "4000K"), (lambda x: units.colour_temperature(x, L("")), "Multi  CCT", "Multi CCT"),
    (urls.host, "https://u:p@www.Whirlpool.com:443/x", "whirlpool.com"), (urls.host, "whirlpool.com/a", "whirlpool.com"), (urls.fingerprint, "https://www.A.com/P/?utm=1", "a.com/p"), (urls.fingerprint, "https://a.com/search?q=X", "a.com/search?q=x"),
    (urls.registrable, "https://a.b.co.uk/x", "b.co.uk"), (urls.unwrap_search, "https://e.com/l/?uddg=https%3A%2F%2Fa.com%2Fp", "https://a.com/p"), (urls.unwrap_search, "https://e.com/ck?u=a1aHR0cHM6Ly9hLmNvbS9w", "https://a.com/p"),
    (urls.cite_url, "www.a.com › p › x", "https://www.a.com/p/x"),
])
def test_text(one, f, given, want):
    assert one(f(F.col("v")), v=given) == want


@pytest.mark.parametrize("raw,expected,want", [
    ("600 mm", "in", ("600", "mm")), ("2.5 cm", "in", ("2.5", "cm")), ("10 ft", "", ("10", "ft")), ("48", "in", ("48", "in")), ("48", "", ("48", "")), ("24 in", "in", ("24", "in")), ("50.25 in", "in", ("50-1/4", "in")),
    ("120 V", "", ("120", "V")), ("15 A", "A", ("15", "A")), ("60 W", "V", ("60", "W")), ("9'", "", ("9", "ft")), ("44 dba", "", ("44", "dBA")), ("about 60 Watts max", "V", ("about 60 Watts max", "W")), ("", "in", ("", "")),
])
def test_units(one, raw, expected, want):
    assert tuple(one(units.split_value_uom(F.col("v"), expected), v=raw)) == want


@pytest.mark.parametrize("label,value,uom,category,mpn_,want", [
    ("Voltage Rating", "5", "W", "led_lighting", "", ("", "")), ("Voltage Rating", "120", "", "led_lighting", "", ("120", "V")), ("Voltage Rating", "24", "V", "cooking_range", "", ("", "")), ("Wattage", "5 W", "", "led_lighting", "", ("5", "W")),
    ("Wattage", "5 W", "", "generic_industrial", "", ("", "")), ("Color", "#fff", "", "x", "", ("", "")), ("Size", "1440", "", "x", "", ("", "")), ("Model", "AB1", "", "x", "AB1", ("AB1", "")), ("Series", "AB1", "", "x", "AB1", ("", "")),
    ("town_name", "x", "", "x", "", ("", "")), ("With", "With more than", "", "x", "", ("", "")), ("Plug Type", "corded", "", "built_in_dishwasher", "", ("Corded", "")),
])
def test_cleanse(one, label, value, uom, category, mpn_, want):
    from partloom.dims import LOV

    c = units.cleanse(F.col("l"), F.col("v"), F.col("u"), F.col("c"), F.col("m"), LOV)
    assert tuple(one(c, l=label, v=value, u=uom, c=category, m=mpn_)) == want


@pytest.mark.parametrize("a,b,uom,same", [('5"', "5 in", "in", True), ("5.0", "5", "", True), (".5", "0.5", "", True), ("5", "6", "", False), ("", "", "", False), ("&quot;5&quot;", "5", "", True)])
def test_equivalent(one, a, b, uom, same):
    assert one(units.equivalent(F.col("a"), F.col("b"), F.col("u")), a=a, b=b, u=uom) is same


def test_blocking(one):
    cases = {"https://www.amazon.com/product/123": True, "https://www.grainger.com/product/X1": False, "https://x.com/appliances/y": True, "https://geappliances.com/appliance/X1": False, "": False, "https://google.com/shopping/x": True}
    for url, want in cases.items():
        assert one(urls.is_blocked(F.col("v")), v=url) is want, url
    assert one(urls.on_domains(F.col("v"), F.array(L("lg.com"))), v="https://boxlg.com/x") is True
    assert one(urls.hint_allowed(F.col("v")), v="http://10.0.0.1/x") is False


@pytest.mark.parametrize("url,mpn_,want", [
    ("https://www.southwire.com/wire-cable/building-wire/seu-x/p/13093005", "13093005", ["https://www.southwire.com/p/{mpn}"]), ("https://www.milwaukeetool.com/en-us/products/49-94-3000", "49-94-3000", []),
    ("https://shop.example/products/details/m18-blower/0887-20", "0887-20", ["https://shop.example/products/details/{mpn}"]), ("https://avspare.com/0887-20", "0887-20", []), ("https://a.com/x-KSES530.html", "KSES530", []),
])
def test_templates(one, url, mpn_, want):
    got = one(urls.portable_templates(F.col("u"), F.col("m")), u=url, m=mpn_)
    if want:
        assert got == want
    assert all("{mpn}" in t for t in got)


def test_expand_is_sequential(one):
    got = one(analyze.expand(F.col("v")), v="3/8 CPLG BRS 150#")
    assert got["text"] == "3/8 Coupling Brass 150#" and got["found"] == ["CPLG", "BRS"]
    assert one(analyze.expand(F.col("v")), v="5 in x 6in FNPT")["text"] == "5 Inches x 6in Female NPT"


def test_scores(one):
    assert one(urls.official_score(F.col("u"), F.col("m")), u="https://a.com/p/AB123", m="AB123") == 80
    assert one(urls.official_score(F.col("u"), F.col("m")), u="https://a.com/owner-center/x", m="AB123") == 80
    assert one(urls.official_score(F.col("u")), u="https://a.com/x.pdf") == 0
    assert one(urls.official_score(F.col("u")), u="https://a.com/login") == -1
    assert one(urls.keep_score(F.col("u")), u="https://a.com/search?q=1") == 10
    assert one(urls.keep_score(F.col("u")), u="https://a.com/p/1") == 50


def test_nulls(one):
    n = F.lit(None).cast("string")
    assert one(text.sanitize(n)) == "" and one(mpn.normalize(n)) == "" and one(urls.host(n)) == "" and tuple(one(units.split_value_uom(n))) == ("", "")
