"""What a reviewer's page gives."""

import pytest
from pyspark.sql import functions as F

from partloom.operators import reviewer

SPECS = "<html><title>Wheel</title><body><table><tr><th>Arbor Size</th><td>7/8 in</td></tr><tr><th>Material</th><td>Aluminum Oxide</td></tr></table><p>A wheel.</p></body></html>"
SHOP = '<html><body><p>TOWN_NAME</p><span>{{ attributeValue }}</span></body></html>'


def ingested(spark, *pages, **more):
    rows = [(i, u, h, s, n) for i, (u, h, s, n) in enumerate(pages)]
    return {r.page_id: r for r in reviewer.ingest(spark.createDataFrame(rows, "page_id long, url string, html string, status int, names array<string>"), **more).collect()}


def test_kinds_of_pages(spark):
    got = ingested(
        spark, ("https://maker.com/p/1", SPECS, 200, ["Maker Tools"]), ("https://shop.com/appliances/1", SPECS, 200, None), ("https://www.grainger.com/p/1", SPECS, 200, []), ("https://maker.com/search?q=1", SPECS, 200, None),
        ("https://maker.com/gone", SPECS, 404, None), ("https://127.0.0.1/x", SPECS, 200, None), ("ftp://maker.com/x", SPECS, 200, None), ("https://maker.com/e", None, 200, None), ("https://town.com/p", SHOP, 200, ["Maker"]), ("https://maker.com/t", SHOP, 200, ["Maker"]),
    )
    assert set(got) == {0, 1, 2, 3, 8, 9}
    assert {i.field: i.value for i in got[0]["items"]}["Arbor Size"] == "7/8" and got[0].mfr_url == "https://maker.com/p/1" and got[0].ref_urls == [] and not got[0].storefront
    for i, url in ((1, "https://shop.com/appliances/1"), (2, "https://www.grainger.com/p/1")):
        assert got[i].dealer and got[i].mfr_url == "" and got[i].ref_urls == [url] and got[i].marketing == "" and len(got[i]["items"]) == len(got[0]["items"])
    assert got[3].mfr_url == "" and got[3].ref_urls == ["https://maker.com/search?q=1"] and not got[3].dealer
    assert got[8].storefront and not got[9].storefront  # a host with the maker's name is no shop


@pytest.mark.parametrize("html,points", [("", 0), ("town_name", 2), ("{{attributeValue}} TOWN_NAME", 4), ('"@type" : "LocalBusiness"', 0), ('"@type":"localbusiness" addressLocality', 1)])
def test_chrome(one, html, points):
    assert one(reviewer.chrome(F.col("h")), h=html) == points


@pytest.mark.parametrize("field,value,kind", [("City", "x", "junk"), ("Color", "#fff", "junk"), ("Color", "#ffff", "useful"), ("Material", "{{x}}", "junk"), ("Material", "Brass", "useful"), ("Material", " ", "neutral"), ("Color", "color", "junk")])
def test_item_kind(spark, field, value, kind):
    frame = spark.createDataFrame([(field, value, "")], "field string, value string, uom string")
    assert frame.select(reviewer.item_kind(F.struct("field", "value", "uom"))).first()[0] == kind


def test_hosts_join_the_shared_table(spark):
    from partloom.operators import shared

    frame = spark.createDataFrame([(0, "https://town.com/p", SHOP, 200, None), (1, "https://www.town.com/q", SHOP, 200, None)], "page_id long, url string, html string, status int, names array<string>")
    hosts = reviewer.storefront_hosts(reviewer.ingest(frame))
    base = spark.createDataFrame([("old.com", 0)], shared.TABLES["storefronts"])
    assert [r.host for r in shared.merge_table("storefronts", base, hosts).orderBy("ord").collect()] == ["old.com", "town.com"]
