import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from partloom.dims import Dims
from partloom.functions.text import let
from partloom.operators import assemble, bags, classify, describe, evidence, identity, memory, pages, validate

ITEM = "field string, value string, uom string, source_url string, quote string, extractor string, confidence double"


def fold(spark, rows):
    frame = spark.createDataFrame([(i, *r[:3], r[3], "", "x", r[4]) for i, r in enumerate(rows)], "ord int, " + ITEM).withColumn("row_id", F.lit(1))
    return [(x.field, x.value, x.source_url, x.confidence) for x in evidence.merge(frame).first()["items"]]


@pytest.mark.parametrize("rows,want", [
    ([("Diameter", '5"', "", "input:Part_Desc", 0.7), ("Diameter", "6", "in", "https://a", 0.7)], [("Diameter", "6", "https://a", 0.7)]),
    ([("Diameter", '5"', "", "input:Part_Desc", 0.7), ("diameter", "5 in", "", "https://a", 0.7)], [("Diameter", '5"', "https://a", 0.7)]),
    ([("Finish", "White", "", "input:Part_Desc", 0.7), ("Finish", "Almond", "", "https://a", 0.5)], [("Finish", "White", "input:Part_Desc", 0.7)]),
    ([("A", "1", "", "https://a", 0.7), ("B", "2", "", "https://a", 0.7), ("A", "3", "", "https://b", 0.7)], [("A", "1", "https://a", 0.7), ("B", "2", "https://a", 0.7)]),
    ([("A", "1", "", "https://a", 0.7), ("B", "2", "", "https://a", 0.7), ("A", "3", "", "https://b", 0.8)], [("B", "2", "https://a", 0.7), ("A", "3", "https://b", 0.8)]),
    ([("A", "", "", "https://a", 0.7)], []),
])
def test_merge_algebra(spark, rows, want):
    assert fold(spark, rows) == want


def test_pick_prefers_outside_pages(spark):
    rows = [("Diameter", "5", "", "input:Part_Desc", 0.9), ("Wheel Diameter", "6", "", "https://a", 0.5), ("Diameter", "7", "W", "https://bb", 0.9)]
    frame = spark.createDataFrame([(*r[:3], r[3], "", "x", r[4]) for r in rows], ITEM)
    items = frame.agg(F.collect_list(F.struct(*evidence.FIELDS)).alias("i"))
    got = items.select(evidence.pick(F.col("i"), "Diameter", {"Diameter": ["Wheel Diameter"]}).alias("p")).first()["p"]
    assert got["value"] == "7"
    got = items.select(evidence.pick(F.col("i"), "Voltage Rating", {"Voltage Rating": ["Diameter"]}).alias("p")).first()["p"]
    assert got["value"] == "6"  # by its suffix; a wattage never fills a voltage slot


@pytest.mark.parametrize("desc,brand,want", [
    ('S11562 Starfish 6" D/W Downlight', "", "led_lighting"), ("4x4 Wh Heritage Post Trim RDI", "", "building_trim"), ("MISC-123 Widget Adapter", "", "generic_industrial"), ("MISC-123 Widget", "", "generic_industrial"),
    ("#2 Drywall Screw Setter", "Diablo", "power_tool_accessory"), ("Trex Transcend Grooved Decking 12'", "", "deck_composite"), ('51334 44" Wh Gilmour Fan', "Gilmour", "ceiling_fan"), ("", "", "generic_industrial"),
])
def test_routing(spark, desc, brand, want):
    r = spark.createDataFrame([(desc, brand)], "d string, b string")
    assert classify.route(r, Dims(), "d", F.col("b")).first()["category_id"] == want


@pytest.mark.parametrize("row,key,method", [
    (("", "", "Kitchen Aid", "", ""), "KitchenAid", "dib_brand"), (("", "", "", "", 'Diablo 5" disc'), "Diablo", "part_desc"), (("-- Unbranded --", "", "-- No DIB Brand --", "Freud Inc (2435)", "disc"), "Diablo", "part_manuf+unicat"),
    (("", "", "", "APPDE", "x"), "", "unknown"), (("", "", "", "Acme Co (12)", "x"), "Acme Co", "part_manuf_unmapped"), (("commodity x", "", "", "", "51334 44\" Wh Gilmour Fan"), "Gilmour", "part_desc"), (("", "satco", "", "", ""), "Satco", "unilog_brand+unicat"),
])
def test_identity(spark, row, key, method):
    r = spark.createDataFrame([(*row, "X1")], "E1_Brand string, Unilog_Brand string, DIB_Brand string, Part_Manuf string, expanded_desc string, normalized_mpn string")
    got = identity.resolve(r, Dims()).first()["identity"]
    assert (got["brand_key"], got["method"]) == (key, method)


def test_clusters_and_bags(spark):
    rows = spark.createDataFrame([(1, "ABC-123"), (2, "abc-123"), (3, "XYZ-9")], "row_id int, Mfg_Part_Num string")
    assert rows.groupBy(bags.cluster_key("Mfg_Part_Num")).count().count() == 2
    full = spark.createDataFrame([(1, "A1", "", "first"), (2, "a1", "second", "")], "row_id int, Mfg_Part_Num string, f1 string, f2 string")
    got = bags.collapse(full, ["Mfg_Part_Num", "f1", "f2"]).first()
    assert (got["row_id"], got["f1"], got["f2"], got["cluster_size"]) == (1, "second", "first", 2)
    todo = spark.createDataFrame([(1, "AVM6EV"), (2, "AVM6EV"), (3, "X1"), (4, "")], "row_id int, Mfg_Part_Num string")
    done = spark.createDataFrame([("AVM6EV",), ("",), ("",)], "Mfg_Part_Num string")
    assert sorted(r.row_id for r in bags.pending(todo, done).collect()) == [2, 3, 4]
    out = spark.createDataFrame([(1, "X1", "a"), (2, "AVM6EV", "b")], "out_id int, Mfg_Part_Num string, v string")
    z = {r.row_id: r.output.v if r.output else None for r in bags.ordered_like(todo, out).collect()}
    assert z == {1: "b", 2: None, 3: "a", 4: None}
    up = bags.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string"), "k")
    assert sorted(map(tuple, up.collect())) == [(1, "a"), (2, "c")]


def test_pages(spark):
    html = """<html><head><title>Disc</title><meta name="description" content="A very good cut-off disc for metal work of all kinds"></head><body><nav><li>Home: page</li></nav>
    <dl><dt>Arbor Size</dt><dd>7/8 in</dd><dt>Grit Size</dt><dd>P80</dd></dl><table><tr><th>Wheel Type</th><td>Type 1</td></tr><tr><td>a</td><td>b</td><td>c</td><td>d</td></tr></table><p>Maximum RPM: 13300</p>
    <script type="application/ld+json">{"@type":"Product","additionalProperty":[{"name":"Maximum Speed","value":"13300 RPM"},{"name":"price","value":"5"}]}</script>
    <script id="__NEXT_DATA__" type="application/json">{"props":{"specs":[{"name":"Backing","value":"PSA"}]}}</script></body></html>"""
    p = spark.createDataFrame([(1, "https://a.com/p/1", html), (2, "https://a.com/2", None), (3, "https://a.com/3", "%PDF-1.4 x")], "page_id long, url string, html string")
    got = {(r.label, r.value) for r in pages.labelled_pairs(p).collect() if r.page_id == 1}
    assert {("Arbor Size", "7/8 in"), ("Grit Size", "P80"), ("Wheel Type", "Type 1"), ("Maximum RPM", "13300"), ("Maximum Speed", "13300 RPM"), ("Backing", "PSA")} <= got
    assert not any(label.lower() in ("price", "home") for label, _ in got)
    e = {r.page_id: r for r in pages.page_evidence(p).collect()}
    items = {i.field: (i.value, i.uom) for i in e[1]["items"]}
    assert items["Arbor Size"] == ("7/8", "in") and items["Maximum RPM"][0] == "13300" and 3 not in e
    soft = spark.createDataFrame([("<title>Page Not Found</title>", 200, "https://a.com"), ("<p>x</p>", 404, "https://a.com"), ("<p>x</p>", 200, "https://a.com/404.html"), ("<p>x</p>", 200, "https://a.com")], "h string, s int, u string")
    assert [r[0] for r in soft.select(pages.is_usable(F.col("s"), "h", "u")).collect()] == [False, False, False, True]


@pytest.mark.parametrize("slots,category,want", [
    ([("Voltage Rating", "15 A", "")], "x", ["voltage field looks like amperage"]), ([("Voltage Rating", "120 VAC", "")], "x", []), ([("", "v", "")], "x", ["value without label"]), ([("Mounting Type", "wall", "")], "built_in_dishwasher", ["Mounting Type 'wall' not in LOV"]),
    ([("Mounting Type", "built-in", "")], "built_in_dishwasher", []), ([], "x", ["no attributes populated from evidence"]),
])
def test_validation(spark, slots, category, want):
    frame = spark.createDataFrame([(slots,)], "s array<struct<label:string,value:string,uom:string>>")
    got = frame.select(validate.issues({}, F.col("s"), F.lit(category)).alias("i")).first()["i"]
    assert [x["message"] for x in got] == want


def test_validation_of_texts(one):
    row = {"MFR URL": F.lit("https://www.amazon.com/x"), "MOBILE_DESC": F.lit("short"), "INVOICE_DESC": F.lit("x" * 41), "Product Name": F.lit("P")}
    got = one(validate.issues(row, F.array().cast("array<struct<label:string,value:string,uom:string>>"), F.lit("x")))
    assert [i["field"] for i in got] == ["INVOICE_DESC", "MOBILE_DESC", "MFR URL", "Classpath", "attributes", "SHORT_DESC", "LONG_DESC1"]


@pytest.mark.parametrize("identity_,n,want", [(0.3, 9, "review"), (0.7, 5, "high"), (0.6, 3, "high"), (0.5, 2, "medium"), (0.5, 1, "medium"), (0.45, 1, "low"), (0.9, 0, "review")])
def test_bands(one, identity_, n, want):
    assert one(validate.band(F.lit(identity_), F.lit(n))) == want


def test_slots_round_trip(spark):
    s = spark.createDataFrame([(1, [("A", "1", "in"), ("B", "", "")])], "k int, slots array<struct<label:string,value:string,uom:string>>")
    wide = assemble.flatten(s)
    assert len(wide.columns) == 151
    assert assemble.unflatten(wide).first()["slots"] == [Row(label="A", value="1", uom="in"), Row(label="B", value="", uom="")]


def test_description_items(one):
    got = {i.field: i.value for i in one(describe.abrasive(F.col("v")), v='4-1/2" Metal Cut-Off Disc P80 5pc')}
    assert got["Diameter"] == '4-1/2"' and got["Grit"] == "P80" and got["Application"] == "Metal Cut-Off Disc" and got["Pack Quantity"] == "5" and "Thickness" not in got
    got = {i.field: (i.value, i.uom) for i in one(describe.generic(F.col("v"), F.lit(""), F.lit("led_lighting"), F.lit("LED Light")), v="LED strip 12 ft 24W 120V 3000K White")}
    assert got["Wattage"] == ("24", "W") and got["Color Temperature"] == ("3000K", "") and got["Product Type"] == ("LED Strip Light", "") and got["Length"] == ("12", "ft")
    assert one(describe.abrasive(F.col("v")), v="") == []


def test_memory(spark):
    out = spark.createDataFrame([("https://a.com/p/{mpn}", False), ("https://a.com/p/{mpn}", False), ("https://b.com/p/{mpn}", False), ("https://b.com/p/{mpn}", True)], "template string, ok boolean")
    dead = memory.dead_paths(out)
    assert {(r.host, r.dead) for r in dead.collect()} == {("a.com", True), ("b.com", False)}
    twice = memory.merge_counters(dead, dead)
    assert {(r.host, r.miss, r.hit) for r in twice.collect()} == {("a.com", 4, 0), ("b.com", 2, 2)}
    c = spark.createDataFrame([("https://a.com/p/{mpn}", 1), ("https://b.com/p/{mpn}", 2)], "template string, k int")
    assert [r.k for r in memory.drop_dead(c, dead).collect()] == [2]
    known = spark.createDataFrame([("X", "https://a.com/p/X", 1), ("X", "https://a.com/search?q=X", 2), ("X", "https://www.amazon.com/X", 3)], "mpn string, url string, ord int")
    assert [r.url for r in memory.finalize_known(known).collect()] == ["https://a.com/p/X"]
    t = spark.createDataFrame([("a.com", "https://a.com/appliance/{mpn}"), ("b.com", "https://b.com/appliance/{mpn}"), ("c.com", "https://c.com/x/{mpn}")], "host string, template string")
    assert [r["shape"] for r in memory.cross_host_paths(t).collect()] == ["/appliance/{mpn}"]
    made = memory.candidate_urls(spark.createDataFrame([("AB12Z", "a.com")], "mpn string, domain string"), t)
    assert [r.url for r in made.collect()] == ["https://a.com/appliance/AB12Z"]
    kinds = spark.createDataFrame([("town_name", "x"), ("Size", "#444444"), ("Size", "1440"), ("Size", "24 in")], "l string, v string")
    assert [r[0] for r in kinds.select(memory.item_kind(F.col("l"), F.col("v"))).collect()] == ["junk", "junk", "junk", "useful"]


def test_let_computes_once(one):
    assert one(let(F.rand(1), lambda x: x - x)) == 0.0
