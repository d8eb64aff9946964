"""Character references, entity lookup, the page cache."""

import html
import os
import random
import time
from datetime import datetime, timedelta
from html.entities import html5

import pytest

from partloom.functions.entities import decode_references
from partloom.operators import lookup
from partloom.sources import page_cache


def test_references_agree_with_the_standard(spark):
    r = random.Random(5)
    names = sorted(html5)
    cases = [f"a&{n}b &{n}" for n in names] + [f"x&{n.rstrip(';')};y&{n.rstrip(';')} z" for n in names]
    numbers = [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFFFD, 0xFFFE, 0xFFFF, 0x1F600, 0x1FFFE, 0x10FFFF, 0x110000, 10**12, 10**30]
    cases += [f for n in numbers for f in (f"&#{n};", f"&#{n}x", f"&#x{n:x};", f"&#X{n:04X}", f"&#000{n};")]
    cases += ["", "&", "&&&", "&;", "&#;", "&#x;", "&#xg;", "&ampx;", "&amp=1", "&notit;", "&amplt;", "&amp;lt;", "&" + "amp" * 20, "&" + "a" * 50 + ";", "&g", "&gt", "& amp;", "&\n", None]
    cases += ["".join(r.choice(["&", "amp", ";", "#", "x", "38", "lt", " ", "not", "in", "A", "copy"]) for _ in range(r.randint(1, 14))) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(cases)), "i int, s string").repartition(4)
    for row in frame.select("s", decode_references("s").alias("d")).collect():
        assert row.d == html.unescape(row.s or ""), repr(row.s)


ENTITIES = "id string, label string, description string, types array<string>, urls array<string>"


@pytest.mark.parametrize("names,want", [
    (["Acme Tools"], ("e1", ["acmetools.com"])), (["acme", "ACME TOOLS "], ("e1", ["acmetools.com"])), (["Zed"], ("z3", ["zed.example"])), (["Singer"], (None, [])),
    (["Other Company"], (None, [])), (["xy"], (None, [])), ([], (None, [])), ([None], (None, [])), (["Bolt"], ("b1", ["bolt-works.com"])),
])
def test_lookup(spark, names, want):
    entities = spark.createDataFrame([
        ("e1", "Acme Tools", "American toolmaker", ["Q783794"], ["https://www.acmetools.com:443/x", "https://acmetools.com", "https://www.amazon.com/acme"]), ("e2", "Acme Tools", "2004 film", ["Q783794"], ["https://acmetools-film.com"]),
        ("z1", "Zed", "given name", None, ["https://zed.example"]), ("z2", "Zed", "a person", ["Q5"], ["https://zed.example"]), ("z3", "Zed", None, None, ["https://zed.example"]), ("z4", "Zed Company", "company", None, ["https://zed.example2"]),
        ("s1", "Singer", "company", None, ["https://unrelated.example"]), ("c1", "Some Company", "x", None, ["https://some.example"]), ("b1", "Bolt Works", "hardware maker", [], ["https://bolt-works.com"]), (None, "Bolt", "company", None, ["https://bolt.com"]),
    ], ENTITIES)
    rows = spark.createDataFrame([(names,), (names,)], "names array<string>")
    (got,) = lookup.official_hosts(rows, entities).collect()
    assert (got.entity, got.hosts) == want
    known = spark.createDataFrame([(names, "q", "seen", ["seen.example"])], "names array<string>, query string, entity string, hosts array<string>")
    assert [r.entity for r in lookup.memo(rows, known, entities).collect()] == ["seen"]


def test_page_cache(spark, tmp_path):
    folder = str(tmp_path / "cache")
    rows = [(f"M{i}", f"https://a.com/{i}", f"<p>page {i}\r\n\x01é</p>\n") for i in range(6)] + [("A/B", "https://s", "slash"), ("A_B", "https://u", "under"), ("", "https://x", "none"), ("N", None, None), ("M1", "https://a.com/0", "older url")]
    frame = spark.createDataFrame(rows, "mpn string, url string, html string")
    page_cache.save_pages(frame, folder)
    got = {r.page: r for r in page_cache.load_pages(spark, folder).collect()}
    assert len(got) == 9 and got["M1"].url == "https://a.com/1" and got["M1"].html == rows[1][2] and got["N"].html == got["N"].url == ""
    assert {r.html for k, r in got.items() if k.startswith("A_B")} == {"slash", "under"}
    # only what is written anew is replaced
    page_cache.save_pages(spark.createDataFrame([("M2", "https://new", "new")], frame.schema), folder)
    got = {r.page: r for r in page_cache.load_pages(spark, folder).collect()}
    assert len(got) == 9 and got["M2"].html == "new" and got["M3"].html == rows[3][2]
    # expiry: by the age of files, before they are opened
    old = time.time() - 40 * 86400
    for name, _, files in os.walk(folder):
        for f in files:
            if "page=M4" in name or "page=M5" in name:
                os.utime(f"{name}/{f}", (old + ("M5" in name), old + ("M5" in name)))
    young = {r.page for r in page_cache.load_pages(spark, folder).collect()}
    assert young == set(got) - {"M4", "M5"}
    assert {r.page for r in page_cache.load_pages(spark, folder, now=datetime.now() - timedelta(days=35)).collect()} == set(got)
    # eviction: the oldest files go
    assert len(page_cache.evict(spark, folder, most=8)) == 1 and page_cache.evict(spark, folder, most=8) == []
    left = {r.page for r in page_cache.load_pages(spark, folder, days=100).collect()}
    assert left == set(got) - {"M4"}
