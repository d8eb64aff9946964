"""The enrichment plan: product rows and fetched pages in, catalogue rows with provenance, issues and a band out.

Everything about a row is one chain of expressions in the stage that reads it; what was learned from pages, known urls and url
templates is joined in on the row's key.  The same function serves batches, micro-batches and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import ABRASIVE_TEMPLATES, Dims
from ..functions import urls
from ..functions.text import sanitize, squash, text
from ..operators import assemble, citations, compose, describe, evidence, memory, validate
from ..operators.analyze import analyze
from ..operators.classify import route
from ..operators.identity import resolve

#: what a row's pages may give beside items, with its type
OUTSIDE = {"items": f"array<{evidence.ITEM}>", "marketing": "string", "features": "array<string>", "image_urls": "array<string>", "ref_urls": "array<string>", "page_url": "string", "ids": "map<string,string>"}
THIN = 4


def spread(rows: DataFrame) -> DataFrame:
    """A row takes milliseconds, so a small file must not become a single task: fewer partitions than cores are dealt out to all
    cores.  Inputs of more partitions stay where they are."""
    if rows.isStreaming:
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def own_evidence(rows: DataFrame) -> DataFrame:
    """``items`` of the description and of the row's pages (``_outside``), by the category's branch: dishwashers read their pages
    first and the description only if these give little; the others read the description first."""
    d, m, c, p = F.col("expanded_desc"), F.col("normalized_mpn"), F.col("category_id"), F.col("product_name")
    none = F.array().cast(f"array<{evidence.ITEM}>")
    rough, machine = c.isin(ABRASIVE_TEMPLATES), c == "built_in_dishwasher"
    staged = rows.withColumn("_parsed", F.when(machine, none).otherwise(describe.industrial(d)))
    first = F.when(machine, none).when(rough, describe.abrasive(d)).otherwise(describe.generic(d, m, c, p))
    staged = staged.withColumn("_own", evidence.best(F.concat(first, "_parsed")))
    guessed = ~rough & ~machine & (F.size("_own") <= 2)
    staged = staged.withColumn("_own", F.when(guessed, evidence.best(F.concat("_own", describe.smart(d, c, F.col("_parsed"))))).otherwise(F.col("_own")))
    few = machine & (F.size("_outside") < THIN)
    staged = staged.withColumn("items", F.when(few, describe.dishwasher(d, m, F.col("_outside"))).when(machine | (F.size("_outside") == 0), F.concat("_own", "_outside")).otherwise(evidence.fold(F.concat("_own", "_outside"))))
    return staged.drop("_own", "_parsed")


def with_pages(rows: DataFrame, pages: DataFrame | None) -> DataFrame:
    """The columns of ``OUTSIDE`` under a leading ``_``, empty where a row has no page; ``items`` becomes ``_outside``."""
    have = {} if pages is None else {k: k for k in OUTSIDE if k in pages.columns}
    if pages is not None:
        told = pages.select(F.col("row_id").alias("_row"), *[F.col(k).alias(f"_{k}") for k in have])
        rows = rows.join(told, F.col("row_id") == F.col("_row"), "left").drop("_row")
    full = rows.withColumns({f"_{k}": F.lit(None).cast(t) for k, t in OUTSIDE.items() if k not in have})
    empty = lambda k: F.coalesce(f"_{k}", F.array().cast(OUTSIDE[k]))
    return full.withColumns({"_items": empty("items"), "_features": empty("features"), "_image_urls": empty("image_urls"), "_ref_urls": empty("ref_urls")}).withColumnRenamed("_items", "_outside")


def enrich(rows: DataFrame, dims: Dims | None = None, pages: DataFrame | None = None, known: DataFrame | None = None, templates: DataFrame | None = None, fetched: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``pages(row_id, items, ...)`` holds each row's folded evidence from allowed pages (see ``OUTSIDE``), ``known(mpn, url, ord)`` and
    ``templates(host, template)`` the url memory, ``fetched`` the pages that were read for the rows: ``(row_id, ord, url)`` and
    ``(url, html)``, which lend their citation to what a description claims; all are optional."""
    dims = dims or Dims()
    hosts = urls.HostLists.of(dims)
    named = route(resolve(analyze(spread(rows), dims.abbreviations), dims), dims)
    found = own_evidence(with_pages(named, pages))
    if fetched is not None:
        cites = citations.confirmed(found.select("row_id", "items"), *fetched, hosts=hosts).select(F.col("row_id").alias("_row"), "cites")
        found = found.join(cites, F.col("row_id") == F.col("_row"), "left").withColumn("items", citations.rehome(F.col("items"), F.col("cites"))).drop("_row", "cites")
    brand, maker, mpn, category = F.col("identity.brand_name"), F.col("identity.manufacturer_name"), F.col("normalized_mpn"), F.col("category_id")
    url = text("_page_url")
    if known is not None or templates is not None:
        spark = rows.sparkSession
        known = known if known is not None else spark.createDataFrame([], "mpn string, url string, ord long")
        templates = templates if templates is not None else spark.createDataFrame([], "host string, template string")
        best = memory.best_mfr_url(named.select("row_id", F.col("normalized_mpn").alias("mpn"), F.col("identity.domains").alias("domains")), known, templates, hosts=hosts)
        found = found.join(best.select(F.col("row_id").alias("_row"), F.col("url").alias("_best_url")), F.col("row_id") == F.col("_row"), "left").drop("_row")
        url = F.coalesce(F.nullif(url, F.lit("")), "_best_url", F.lit(""))
    picked = found.withColumn("mfr_url", url).withColumn("_picks", assemble.template_picks(F.col("items"), category, dims))
    slotted = picked.withColumn("slots", assemble.fill_related(assemble.fill_slots(F.col("items"), F.col("_picks"), category, F.col("product_name"), mpn, dims))).withColumn("items", assemble.aligned(F.col("items"), F.col("_picks"))).drop("_picks")
    valued = slotted.withColumns({"_values": compose.values(F.col("items")), "_style": compose.style_of(brand, dims.styles)})
    told = valued.withColumn("_d", compose.descriptions(category, {"brand": brand, "maker": maker, "product": F.col("product_name"), "mpn": mpn, "desc": F.col("Part_Desc"), "values": F.col("_values"), "style": F.col("_style")}))
    flat = told.withColumns({k: squash(sanitize(F.col(f"_d.{k}"))) for k in compose.DESCRIPTIONS}).withColumn("INVOICE_DESC", F.upper("INVOICE_DESC"))
    extra = {
        "marketing": assemble.marketing(F.col("_marketing"), F.col("_features")), "assets": assemble.assets(brand, maker, mpn, F.col("_ref_urls"), F.col("_image_urls"), F.col("mfr_url")), "product_ids": assemble.product_ids(F.col("_ids"), F.col("items"), mpn),
        "named": assemble.named_columns(F.col("items"), mpn), "field_sources": assemble.field_sources(F.col("items"), F.col("slots"), F.col("mfr_url"), F.col("_ref_urls"), F.col("_marketing")),
    }
    full = flat.withColumns(extra).withColumn("ref_urls", F.slice("_ref_urls", 1, 5)).drop("_d", "_values", "_style", "_best_url", "_outside", *[f"_{k}" for k in OUTSIDE])
    row = {k: F.col(k) for k in ("MOBILE_DESC", "SHORT_DESC", "INVOICE_DESC", "LONG_DESC1")} | {"MFR URL": F.col("mfr_url"), "Product Name": F.col("product_name"), "Classpath": F.col("classpath")}
    checked = full.withColumn("issues", validate.issues(row, F.col("slots"), category, dims.lov, hosts=hosts)).withColumn("evidence_count", evidence.verified(F.col("items")))
    banded = checked.withColumn("band", validate.band(F.col("identity.confidence"), F.col("evidence_count")))
    return banded.withColumn("canonical_key", F.concat_ws("|", F.when(F.col("identity.brand_key") == "", F.lit("UNKNOWN")).otherwise(F.col("identity.brand_key")), "normalized_mpn"))
