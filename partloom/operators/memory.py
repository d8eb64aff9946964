"""URL knowledge that grows with each run.

State tables are long: ``known(mpn, url, ord)``, ``templates(host, template, ord)``, ``dead(host, template, miss, hit)``,
``storefronts(host)``.  Updating is union plus aggregation, so it is the same in a batch and in a micro-batch, and the
result does not depend on how the input was cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import mpn as part
from ..functions import urls
from ..functions.text import strip, text, texts
from ..functions.urls import BUILT_IN, HostLists

MAX_URLS, STRONG = 12, 40
MISSES = 2
SEED_SHAPES = ["/appliance/{mpn}", "/en-us/product/{mpn}", "/products/details/{mpn}"]


def finalize_known(known: DataFrame, hosts: HostLists = BUILT_IN) -> DataFrame:
    """Per part number: urls worth keeping, once, best score first; only strong ones if there are any; at most 12."""
    first = known.where(urls.worth_keeping("url", hosts)).groupBy("mpn", "url").agg(F.min("ord").alias("ord")).withColumn("score", urls.keep_score("url", hosts))
    strong = Window.partitionBy("mpn")
    rank = strong.orderBy(F.desc("score"), "ord", "url")
    kept = first.withColumn("_best", F.max("score").over(strong)).where((F.col("_best") < STRONG) | (F.col("score") >= STRONG))
    return kept.withColumn("ord", F.row_number().over(rank)).where(F.col("ord") <= MAX_URLS).select("mpn", "url", "score", "ord")


def remember(known: DataFrame, new: DataFrame, hosts: HostLists = BUILT_IN) -> DataFrame:
    top = known.groupBy("mpn").agg(F.max("ord").alias("_top"))
    later = new.join(top, "mpn", "left").select("mpn", "url", (F.col("ord") + F.coalesce("_top", F.lit(0))).alias("ord"))
    return finalize_known(known.select("mpn", "url", "ord").unionByName(later), hosts)


def forget(known: DataFrame, gone: DataFrame) -> DataFrame:
    return known.join(gone.select("mpn", "url").distinct(), ["mpn", "url"], "left_anti")


def lookup_known(rows: DataFrame, known: DataFrame, mpn: str = "mpn") -> DataFrame:
    """Urls filed under any of a part number's keys, in the order of the keys."""
    keys = rows.select(F.col(mpn).alias("_mpn")).distinct().select("_mpn", F.posexplode(part.lookup_keys("_mpn")).alias("k", "key"))
    found = keys.join(known.withColumnRenamed("mpn", "key"), "key")
    return found.groupBy("_mpn", "url").agg(F.min(F.struct("k", "ord")).alias("o")).select(F.col("_mpn").alias(mpn), "url", F.col("o.k").alias("key_rank"), F.col("o.ord").alias("ord"))


def mine_templates(pages: DataFrame, mpn: str = "mpn", url: str = "url", hosts: HostLists = BUILT_IN) -> DataFrame:
    """Portable templates per host, once, product pages before searches."""
    found = pages.select(urls.host(url).alias("host"), F.explode(urls.portable_templates(url, F.col(mpn), hosts)).alias("template"))
    return found.groupBy("host", "template").agg(F.count("*").alias("seen")).withColumn("is_search", urls.is_search("template"))


def cross_host_paths(templates: DataFrame, least: int = 2, cap: int = 2) -> DataFrame:
    """Path shapes that two or more hosts share, the most common first, then the seed shapes that occur: a top-k report."""
    shapes = templates.select(F.regexp_replace(F.lower("host"), r"^www\.", "").alias("host"), urls.path_shape(F.col("template")).alias("shape")).where("shape is not null and host <> ''")
    counts = shapes.groupBy("shape").agg(F.countDistinct("host").alias("hosts"))
    seed = F.coalesce(F.array_position(texts(SEED_SHAPES), F.col("shape")), F.lit(0))
    ranked = counts.where((F.col("hosts") >= least) | (seed > 0)).withColumn("_mined", F.col("hosts") >= least)
    return ranked.orderBy(F.desc("_mined"), F.when(F.col("_mined"), -F.col("hosts")).otherwise(seed), "shape").limit(cap).select("shape", "hosts")


def dead_paths(outcomes: DataFrame) -> DataFrame:
    """``(template, ok)`` -> counters and the verdict: two misses or more and no hit."""
    out = outcomes.groupBy(F.regexp_replace(urls.netloc("template"), r"^www\.", "").alias("host"), "template").agg(F.count_if(~F.col("ok")).alias("miss"), F.count_if("ok").alias("hit"))
    return out.withColumn("dead", (F.col("miss") >= MISSES) & (F.col("hit") == 0))


def merge_counters(state: DataFrame, new: DataFrame) -> DataFrame:
    both = state.select("host", "template", "miss", "hit").unionByName(new.select("host", "template", "miss", "hit"))
    out = both.groupBy("host", "template").agg(F.sum("miss").alias("miss"), F.sum("hit").alias("hit"))
    return out.withColumn("dead", (F.col("miss") >= MISSES) & (F.col("hit") == 0))


def drop_dead(candidates: DataFrame, dead: DataFrame) -> DataFrame:
    return candidates.join(dead.where("dead").select("template"), "template", "left_anti")


def candidate_urls(rows: DataFrame, templates: DataFrame, mpn: str = "mpn", domain: str = "domain", hosts: HostLists = BUILT_IN) -> DataFrame:
    """Urls of every template on a row's host, with the part number put in; one per fingerprint.  ``rows`` has one row per
    (part number, domain)."""
    met = rows.withColumn("host", urls.host(domain)).join(templates.select("host", "template"), "host")
    filled = F.replace(F.replace("template", F.lit("{mpn}"), F.col(mpn)), F.lit("{search_mpn}"), part.search(mpn))
    made = met.withColumn("url", filled).where(~urls.is_blocked("url", hosts)).withColumn("score", urls.official_score("url", F.col(mpn), hosts))
    return made.groupBy(mpn, urls.fingerprint("url").alias("fingerprint")).agg(F.max_by(F.struct("url", "score"), F.struct("score", F.col("url"))).alias("s")).select(mpn, "s.url", "s.score")


def best_mfr_url(rows: DataFrame, known: DataFrame, templates: DataFrame, key: str = "row_id", hosts: HostLists = BUILT_IN) -> DataFrame:
    """``rows(key, mpn, domains)`` -> ``(key, url)``: the best known url of the part on its maker's domains, else the best
    candidate of the domains' templates; pages that sell or search, and PDFs, are none."""
    page = ~urls.is_blocked("url", hosts) & ~urls.is_distributor("url", hosts) & ~urls.is_search("url") & ~F.lower("url").endswith(".pdf")
    filed = rows.join(lookup_known(rows, known), "mpn").where(page & ((F.size("domains") == 0) | urls.on_domains("url", F.col("domains"))))
    first = filed.groupBy(key).agg(F.max_by("url", F.struct(urls.keep_score("url", hosts).alias("s"), -F.col("key_rank"), -F.col("ord"), "url")).alias("filed"))
    asked = rows.select("mpn", F.explode("domains").alias("domain")).distinct()
    guess = candidate_urls(asked, templates, hosts=hosts).where(~urls.is_search("url") & ~F.lower("url").endswith(".pdf")).groupBy("mpn").agg(F.max_by("url", F.struct("score", "url")).alias("guess"))
    return rows.select(key, "mpn").join(first, key, "left").join(guess, "mpn", "left").select(key, F.coalesce("filed", "guess", F.lit("")).alias("url"))


def storefronts(items: DataFrame, chrome: DataFrame) -> DataFrame:
    """Hosts that sell but describe nothing: no useful item, and page chrome once or junk items twice.
    ``items(host, kind)`` with kind useful/junk, ``chrome(host, n)``."""
    kinds = items.groupBy("host").agg(F.count_if(F.col("kind") == "useful").alias("useful"), F.count_if(F.col("kind") == "junk").alias("junk"))
    marks = chrome.groupBy("host").agg(F.sum("n").alias("chrome"))
    met = kinds.join(marks, "host", "full").fillna(0, ["useful", "junk", "chrome"])
    return met.withColumn("is_storefront", (F.col("useful") == 0) & ((F.col("chrome") >= 1) | (F.col("junk") >= 2)))


def item_kind(label: Column, value: Column) -> Column:
    key = F.lower(strip(label))
    junk = key.isin("town_name", "sep", "city", "state", "zip", "postal", "address", "phone", "hours") | text(value).rlike(r"^#[0-9a-fA-F]{3,8}$") | text(value).rlike(r"^\d{4,}$")
    return F.when(junk, F.lit("junk")).otherwise(F.lit("useful"))


def rejected(flags: DataFrame, least: int = 2) -> DataFrame:
    """Reviewer flags ``(field, value, is_global)`` -> counts and whether the value is rejected everywhere."""
    out = flags.groupBy(F.lower(strip("field")).alias("field"), F.lower(strip("value")).alias("value")).agg(F.count("*").alias("n"), F.bool_or("is_global").alias("_g"))
    return out.select("field", "value", "n", (F.col("_g") | (F.col("n") >= least)).alias("rejected"))


def discover_domains(hits: DataFrame, mpn: str = "mpn", url: str = "url", names: str = "names", top: int = 3, hosts: HostLists = BUILT_IN) -> DataFrame:
    """Hosts of search hits scored by name, part number in the path and kind of page; a host with a name wins outright."""
    h = urls.host(url)
    named = F.exists(F.col(names), lambda n: (F.length(n) >= 3) & F.exists(urls.labels(url), lambda x: x.startswith(n)))
    with_mpn = urls.path_has_mpn(url, F.col(mpn))
    page = F.lower(text(url)).rlike("/p/|/product|/item|/sku|/details")
    score = F.when(named, 10).otherwise(0) + F.when(with_mpn, 8).otherwise(0) + F.when(page & with_mpn, 6).otherwise(0) + F.when(urls.official_score(url, hosts=hosts) > 10, 4).otherwise(0)
    seen = hits.withColumns({"host": h, "named": named, "score": score, "_ok": named | (page & with_mpn)}).where((F.col("host") != "") & ~urls.is_blocked(url, hosts) & F.col("_ok"))
    first = seen.groupBy(mpn, "host").agg(F.min_by(F.struct("score", "named"), "ord").alias("s")).select(mpn, "host", "s.score", "s.named")
    w = Window.partitionBy(mpn)
    kept = first.withColumn("_any", F.max("named").over(w)).where(F.col("named") | ~F.col("_any"))
    return kept.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "host"))).where(F.col("rank") <= top).select(mpn, "host", "score", "rank")


def search_queries(mpn: Column, brand: Column, desc: Column) -> Column:
    quoted = F.concat(F.lit('"'), mpn, F.lit('"'))
    words = F.array_join(F.slice(F.filter(F.split(desc, r"\s+"), lambda w: w != ""), 1, 4), " ")
    raw = F.array(F.concat_ws(" ", F.nullif(brand, F.lit("")), quoted), quoted, F.concat_ws(" ", F.nullif(brand, F.lit("")), mpn, words), F.concat_ws(" ", mpn, F.lit("specifications")))
    return F.array_distinct(F.transform(raw, F.trim))


def move_to_front(engines: Column, last: Column) -> Column:
    return F.when(F.array_contains(engines, last), F.concat(F.array(last), F.array_remove(engines, last))).otherwise(engines)


def tier_fallback(evidence: DataFrame, key: str = "row_id", least: int = 2) -> DataFrame:
    """Keeps a tier's evidence only while the tiers before it gave fewer than ``least`` distinct fields.
    First one row per (key, field): its first tier; then the running count per key stays small."""
    first = evidence.groupBy(key, F.lower("field").alias("_f")).agg(F.min("tier").alias("tier"))
    per = first.groupBy(key, "tier").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tiers = evidence.select(key, "tier").distinct().join(per, [key, "tier"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    live = tiers.withColumn("_before", before).where(F.col("_before") < least).select(key, "tier")
    return evidence.join(live, [key, "tier"], "left_semi")


def expand_families(domains: DataFrame, families: list[list[str]], domain: str = "domain") -> DataFrame:
    """Sister domains of each domain by equality within its family (a broadcast-size constant table)."""
    table = domains.sparkSession.createDataFrame([(a, b) for f in families for a in f for b in f if a != b], "domain string, sister string")
    return domains.join(table, domains[domain] == table["domain"], "inner").select(domains[domain].alias(domain), "sister").distinct()
