"""OpenGraph, microdata and names (EXT-08, STR-18)."""

import pytest
from pyspark.sql import functions as F

from partloom.functions import urls
from partloom.operators import pages

HTML = """<html><head><meta property="og:title" content="Disc"><meta content="0123456789012" property="product:upc"><meta property="og:image:width" content="1440">
<meta property="product:price:amount" content="5"><meta property="product:grit_size" content="P80"></head><body>
<div itemscope itemtype="https://schema.org/Product"><span itemprop="name">Disc</span><meta itemprop="mpn" content="DBX-12"><b itemprop="material">Stain<i>less</i> &amp; zinc</b>
<ul><li itemprop="additionalProperty" itemscope itemtype="https://schema.org/PropertyValue"><span itemprop="name">Arbor Size</span> <span itemprop="value">7/8 in</span>
<li itemprop="additionalProperty" itemscope itemtype="https://schema.org/PropertyValue"><span itemprop="name">Max Speed</span><span itemprop="value">13300</span></ul>
<div itemprop="seller" itemscope itemtype="https://schema.org/Store"><span itemprop="telephone">555</span></div><img itemprop="image" src="x.png"><p itemprop="color">Red</p><p itemprop="color">Blue</p></div></body></html>"""


def test_opengraph_and_microdata(spark):
    rows = pages.labelled_pairs(spark.createDataFrame([(1, HTML)], "page_id long, html string")).collect()
    got = {(r.kind, r.label, r.value) for r in rows}
    assert got == {("opengraph", "upc", "0123456789012"), ("opengraph", "grit size", "P80"), ("microdata", "mpn", "DBX-12"), ("microdata", "material", "Stainless & zinc"), ("microdata", "Arbor Size", "7/8 in"), ("microdata", "Max Speed", "13300"), ("microdata", "color", "Red")}
    assert ("color", "Blue") in pages.microdata_pairs(HTML)
    assert pages.microdata_pairs("<div itemscope><b itemprop=size>8 in") == [("size", "8 in")] and pages.opengraph_pairs("<meta property=") == []


@pytest.mark.parametrize("name,tokens,domains", [
    ("Freud America, Inc.", ["freud"], ["freud.com"]), ("A. O. Smith Corp", ["ao", "smith"], ["ao.com", "aosmith.com"]), ("3 M Company", ["3m"], ["3m.com"]), ("E Z Red Tool Works Co", ["ez", "red", "tool", "works"], ["ez.com", "ezred.com", "ezredtool.com", "ezredtoolworks.com"]),
    ("X Acme", ["acme"], ["acme.com"]), ("Unbranded goods", ["unbranded", "goods"], []), ("3000 Lights", ["3000", "lights"], []), ("The Co.", [], []), ("", [], []), (None, [], []),
])
def test_names(one, name, tokens, domains):
    assert one(urls.name_tokens(F.col("n")), n=name) == tokens
    assert one(urls.guess_domains(F.col("n")), n=name) == domains
