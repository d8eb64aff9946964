"""Candidate urls: the order of a host's paths, taught hosts, dead paths."""

import pytest
from pyspark.sql import functions as F

from partloom.dims import Dims
from partloom.operators import candidates as C

PATHS = [("brand.com", "https://www.brand.com/item/{mpn}", 0), ("brand.com", "https://www.brand.com/find?term={search_mpn}", 1), ("searchy", "https://www.searchy.com/search?q={mpn}&x=1", 2), ("oven.com", "https://www.oven.com/appliance/{mpn}", 3), ("ab", "https://x.ab/{mpn}", 4)]


def found(spark, mpn, domains, **more):
    rows = spark.createDataFrame([(1, mpn, domains)], "row_id long, mpn string, domains array<string>")
    paths = spark.createDataFrame(PATHS, "host string, template string, ord bigint")
    return [(r.url, r.source) for r in C.candidate_urls(rows, paths=paths, **more).orderBy("ord").collect()]


@pytest.mark.parametrize("domain,want", [("a.com", "https://www.a.com"), ("www.a.com", "https://www.a.com"), ("learn.com", "https://learn.com"), ("shop.a.com/x", "https://shop.a.com"), ("http://B.com/p?q", "http://B.com"), ("https://b.com", "https://b.com")])
def test_origin(one, domain, want):
    assert one(C.origin(F.col("d")), d=domain) == want


def test_generic_paths_in_order(spark):
    site = "https://www.new.com"
    assert [u for u, _ in found(spark, "A 1/2Z", ["new.com"])] == [f"{site}{p}A%201%2F2Z" for p in ("/p/", "/products/", "/product/", "/product-support/", "/support/", "/search?q=")]
    got = [u for u, _ in found(spark, "X9", ["new.com"], learned=["/item/{mpn}", "/appliance/{mpn}", "/p/{mpn}"])]
    assert got[5:] == [f"{site}/item/X9", f"{site}/search?q=X9"]


def test_taught_hosts(spark):
    assert [u for u, _ in found(spark, "AB12Z", ["brand.com"])] == ["https://www.brand.com/item/AB12Z", "https://www.brand.com/find?term=AB12", "https://www.brand.com/search?q=AB12Z"]
    assert len(found(spark, "X9", ["brand.com", "new.com"])) == 3 + 6
    searchy = [u for u, _ in found(spark, "X9", ["mysearchy.com"])]
    assert searchy[0] == "https://www.searchy.com/search?q=X9&x=1" and len(searchy) == 7  # a search alone does not stop the guesses
    assert [u for u, _ in found(spark, "X9", ["oven.com"], learned=["/appliance/{mpn}"])] == ["https://www.oven.com/appliance/X9", "https://www.oven.com/search?q=X9"]
    assert found(spark, "X9", ["brand.com", "www.brand.com/x"]) == found(spark, "X9", ["brand.com"])  # one of equal fingerprints


def test_known_dead_and_blocked(spark):
    known = spark.createDataFrame([("X9", "https://www.new.com/real", 0), ("X9", "https://www.new.com/p/X9", 1), ("X9", "https://www.amazon.com/X9", 2), ("X9", "https://www.new.com/x.pdf", 3), ("X9", "https://other.com/X9", 4)], "mpn string, url string, ord bigint")
    got = found(spark, "X9", ["new.com"], known=known)
    assert got[:2] == [("https://www.new.com/real", "known"), ("https://www.new.com/p/X9", "known")] and len(got) == 7
    assert [u for u, s in found(spark, "X9", [], known=known)] == ["https://www.new.com/real", "https://www.new.com/p/X9", "https://other.com/X9"]
    dead = spark.createDataFrame([("https://www.new.com/p/{mpn}", True), ("https://www.new.com/product/{mpn}", False)], "template string, dead boolean")
    assert [u for u, _ in found(spark, "AX99", ["new.com"], dead=dead)][:2] == ["https://www.new.com/products/AX99", "https://www.new.com/product/AX99"]
    assert found(spark, "X9", ["amazon.com"]) == [] and found(spark, None, ["new.com"]) == [] and found(spark, "X9", None) == [] and found(spark, "X9", ["", None]) == []


def test_families_and_templates(spark):
    rows = spark.createDataFrame([(1, "X9", ["maytag.com"])], "row_id long, mpn string, domains array<string>")
    hosts = {r.url.split("/")[2] for r in C.family_urls(rows, Dims(families=[["maytag.com", "amana.com", "parts.maytag.com"], ["z.com", "y.com"]])).collect()}
    assert hosts == {"www.amana.com"}
    got = C.template_urls(rows, {"a.com": ["https://a.com/{mpn}", "https://A.com/{mpn}/"], "amazon.com": ["https://amazon.com/{mpn}"], "b.com": ["https://b.com/q?s={mpn}"]}).orderBy("ord")
    assert [r.url for r in got.collect()] == ["https://a.com/X9", "https://b.com/q?s=X9"]
    assert C.template_urls(rows, {}).count() == 0
