"""Pages that a reviewer hands in: what they give, where their url counts, and shops that are recognised by them (SUP-33, FIL-12,
SUP-08).

A page is read by all extractors at once (patterns, labelled pairs, embedded JSON, OpenGraph, microdata).  A maker's page gives all it
has and its url; a search gives its url as a reference only; a dealer's or distributor's page gives its items and a reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import units, urls
from ..functions.text import strip, text
from ..functions.urls import BUILT_IN, HostLists
from . import pages as page_ops
from .evidence import ITEM
from .lookup import host_has_name

#: fixed values: labels of address blocks, and labels whose unusable values tell of a shop
PLACE_LABELS = ["town_name", "sep", "city", "state", "zip", "postal", "address", "phone", "site_name", "state_name", "country_name", "categories", "category", "latitude", "longitude", "hours"]
SHOP_LABELS = ["size", "width", "height", "color", "finish", "with"]
JUNK = 2


def chrome(html: Column | str) -> Column:
    """Marks of a shop's frame in a page: town labels and unfilled templates two points each, a local business with its town one."""
    t = text(html)
    has = lambda pattern: t.rlike(pattern)
    return F.when(has("(?i)town_name"), 2).otherwise(0) + F.when(has(r"(?i)\{\{\s*attributeValue\s*\}\}"), 2).otherwise(0) + F.when(has(r'(?i)"@type"\s*:\s*"LocalBusiness"') & has("(?i)addressLocality"), 1).otherwise(0)


def item_kind(x: Column) -> Column:
    """``useful``, ``junk`` or ``neutral``, for an item."""
    value, label = strip(x["value"]), F.lower(strip(x["field"]))
    junk = label.isin(PLACE_LABELS) | value.rlike(r"(?i)\{\{|\}\}|attributeValue|with more than") | units.is_hex_colour(value)
    clean = units.cleanse(strip(x["field"]), value, text(x["uom"]), F.lit("generic_industrial"), F.lit(""))["value"]
    return F.when(value == "", "neutral").when(junk, "junk").when(clean != "", "useful").when(label.isin(SHOP_LABELS), "junk").otherwise("neutral")


def is_storefront(url: Column, html: Column, items: Column, names: Column, hosts: HostLists = BUILT_IN) -> Column:
    """A page that sells but describes nothing: none of its own items is useful, and it has a shop's frame or two junk items.  Searches,
    distributors and hosts with one of the names are never taken for shops."""
    own = F.filter(items, lambda x: urls.host(F.when(text(x["source_url"]) == "", url).otherwise(x["source_url"])) == urls.host(url))
    kinds = F.transform(own, item_kind)
    count = lambda kind: F.size(F.filter(kinds, lambda k: k == kind))
    known = F.coalesce(names, F.array().cast("array<string>"))
    guarded = (urls.host(url) == "") | urls.is_search(url) | urls.is_distributor(url, hosts) | host_has_name(urls.host(url), known)
    return ~guarded & (count("useful") == 0) & ((chrome(html) >= 1) | (count("junk") >= JUNK))


def ingest(pages: DataFrame, evidence: DataFrame | None = None, key: str = "page_id", hosts: HostLists = BUILT_IN, read: bool = False) -> DataFrame:
    """``pages(key, url, html, status, names)`` -> one row per page that may be read: items, marketing, approvals, warranty, mfr_url,
    ref_urls, dealer and storefront.  Urls that a reviewer may not give, unusable pages and searches' items: a page that fails is not
    in the result; a PDF's body gives no items here (see ``spec_pages`` for its text).  ``evidence`` is ``page_evidence`` of the pages, made here
    if absent; repeated keys share it.  With ``read`` the pages are known to have been read: status and body tell that a page is missing,
    its url and title do not."""
    usable = page_ops.is_usable(F.col("status"), "html", titles=False) if read else page_ops.is_usable(F.col("status"), "html", "url")
    fine = pages.where(urls.hint_allowed("url") & usable)
    found = (evidence if evidence is not None else page_ops.page_evidence(fine.dropDuplicates([key]), key)).select(F.col(key).alias("_key"), *[c for c in ("items", "marketing", "approvals", "warranty")])
    met = fine.join(found, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("items", F.coalesce("items", F.array().cast(f"array<{ITEM}>")))
    dealer = urls.is_dealer("url") | urls.is_distributor("url", hosts)
    search = urls.is_search("url")
    none = F.array().cast("array<string>")
    own = F.when(~dealer & ~search, F.col("url")).otherwise(F.lit(""))
    kept = lambda c: F.when(~dealer, text(c)).otherwise(F.lit(""))
    return met.select(
        key, "url", urls.host("url").alias("host"), "items", kept("marketing").alias("marketing"), text("approvals").alias("approvals"), text("warranty").alias("warranty"),
        own.alias("mfr_url"), F.when(dealer | search, F.array("url")).otherwise(none).alias("ref_urls"), dealer.alias("dealer"), is_storefront(F.col("url"), F.col("html"), F.col("items"), F.col("names"), hosts).alias("storefront"),
    )


def storefront_hosts(ingested: DataFrame) -> DataFrame:
    """``host, ord`` of shops that the pages gave away, in the form of the shared table."""
    return ingested.where("storefront").select("host").distinct().select("host", F.lit(0).cast("bigint").alias("ord"))


def without_shops(items: Column, host_list: Column) -> Column:
    """Items from hosts that are known as shops go."""
    return F.filter(items, lambda x: ~F.array_contains(host_list, urls.host(x["source_url"])))
