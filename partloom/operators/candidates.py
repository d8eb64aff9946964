"""Candidate urls of a part on its maker's domains, in the order in which they are fetched (JOI-14, JOI-15, JOI-18, URL-16, FIL-07).

For each domain, in order: the url templates taught to any key that its host contains, then the generic paths of products, paths that
several hosts share and one search.  A host that was taught a product path gets the search only; an appliance path is only tried on
a host that was taught one.  Urls filed under the part come before all; what is blocked or dead goes; of equal fingerprints the
first stays.  Keys meet hosts by an equi-join on the parts of each distinct host, never by comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import Dims
from ..functions import mpn as part
from ..functions import urls
from ..functions.text import strip, text, texts
from ..functions.urls import BUILT_IN, HostLists
from . import memory
from .sourcing import bare_host, family_domains, is_appliance_template

#: fixed values: paths of products and the one search that every host is asked
OFFICIAL_PATHS = ["/p/{mpn}", "/products/{mpn}", "/product/{mpn}", "/product-support/{mpn}", "/support/{mpn}"]
SEARCH_PATHS = ["/search?q={mpn}"]
#: hosts whose beginning tells that they stand for themselves, without ``www.``
OWN_HOSTS = ["learn", "support", "products", "docs"]


def quoted(x: Column) -> Column:
    """Percent-encoded; letters, digits, ``-_.~`` stay."""
    form = F.url_encode(x)
    return F.replace(F.replace(F.replace(form, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def filled(template: Column, mpn: Column) -> Column:
    """The template with the part number and its form for searches put in."""
    out = F.replace(template, F.lit("{mpn}"), quoted(mpn))
    return F.replace(out, F.lit("{search_mpn}"), quoted(F.when(mpn.endswith("Z") & (F.length(mpn) > 4), F.substring(mpn, F.lit(1), F.length(mpn) - 1)).otherwise(mpn)))


def origin(domain: Column | str) -> Column:
    """Scheme and host of a domain or url; a bare two-label domain gets ``www.``."""
    raw = strip(domain)
    full = F.rtrim(F.concat(F.regexp_extract(raw, "^(https?)://", 1), F.lit("://"), F.regexp_extract(raw, "^https?://([^/?#]*)", 1)), F.lit("/"))
    host = F.substring_index(raw, "/", 1)
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    own = F.lit(False)
    for word in OWN_HOSTS:
        own = own | host.startswith(word)
    return F.when(raw.rlike("^https?://"), full).otherwise(F.concat(F.lit("https://"), F.when(~host.startswith("www.") & (dots == 1) & ~own, F.concat(F.lit("www."), host)).otherwise(host)))


def host_parts(host: Column) -> Column:
    """Every part of a host, of three characters or more (a few hundred)."""
    n = F.length(host)
    begins = F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(begins, lambda b: F.transform(F.sequence(F.lit(3), F.greatest(n - b + 1, F.lit(3))), lambda k: F.substr(host, b, k)))))


def taught(hosts: DataFrame, paths: DataFrame) -> DataFrame:
    """``hosts(host)`` and ``paths(host, template, ord)`` -> host, templates (of all keys it contains, in order), appliance: whether one
    of them has an appliance path.  Keys of fewer than three characters name no host."""
    keys = paths.select(F.lower(strip("host")).alias("key"), "template", "ord").where((F.length("key") >= 3) & (text("template") != ""))
    own = hosts.select("host").distinct()
    # an appliance path counts with and without www. on either side
    met = own.select("host", F.explode(host_parts(F.col("host"))).alias("key")).join(keys, "key")
    bare = own.select("host", F.explode(host_parts(bare_host(F.col("host")))).alias("key")).join(keys.where(is_appliance_template(F.col("template"))).withColumn("key", bare_host(F.col("key"))), "key").select("host").distinct().withColumn("appliance", F.lit(True))
    lists = met.groupBy("host").agg(F.array_sort(F.collect_set(F.struct("ord", "key", "template"))).alias("l")).select("host", F.transform("l", lambda x: x["template"]).alias("templates"))
    return own.join(lists, "host", "left").join(bare, "host", "left").select("host", F.coalesce("templates", F.array().cast("array<string>")).alias("templates"), F.coalesce("appliance", F.lit(False)).alias("appliance"))


def paths_of(templates: Column, appliance: Column, site: Column, learned: list[str]) -> Column:
    """A host's templates and generic urls, in order."""
    usable = F.filter(templates, lambda t: appliance | ~is_appliance_template(t))
    shapes = [p for p in dict.fromkeys(learned) if p not in OFFICIAL_PATHS + SEARCH_PATHS]
    generic = F.filter(texts([*OFFICIAL_PATHS, *shapes, *SEARCH_PATHS]), lambda p: appliance | ~is_appliance_template(p))
    product = F.exists(usable, lambda t: ~urls.is_search(t))
    rest = F.when(product, texts(SEARCH_PATHS)).otherwise(generic)
    return F.concat(usable, F.transform(rest, lambda p: F.concat(site, p)))


def candidate_urls(
    rows: DataFrame, known: DataFrame | None = None, paths: DataFrame | None = None, dead: DataFrame | None = None, learned: list[str] | None = None, key: str = "row_id", hosts: HostLists = BUILT_IN,
) -> DataFrame:
    """``rows(key, mpn, domains)`` -> ``key, mpn, url, ord, source`` (``known`` or ``guess``), ``ord`` counting from zero in fetching order.
    ``known(mpn, url, ord)``, ``paths(host, template, ord)``, ``dead(template, dead)`` and ``learned`` paths are what was learned.  A row
    without domains has its filed urls only; null part numbers have none."""
    spark = rows.sparkSession
    paths = paths if paths is not None else spark.createDataFrame([], "host string, template string, ord bigint")
    own = rows.select(key, F.col("mpn"), F.coalesce("domains", F.array().cast("array<string>")).alias("domains")).where(text("mpn") != "")
    each = own.select(key, "mpn", F.posexplode("domains").alias("_d", "domain")).where(strip("domain") != "").withColumn("_site", origin("domain")).withColumn("host", urls.netloc("_site"))
    # a few hosts may have all rows, and few bytes of rows make many urls: the rows are dealt out again before they grow
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ready = each.join(taught(each.select("host"), paths), "host", "left").repartition(tasks, key, "mpn")
    made = ready.select(key, "mpn", "_d", F.posexplode(paths_of(F.col("templates"), F.col("appliance"), F.col("_site"), learned or [])).alias("_p", "template"))
    guessed = made.select(key, "mpn", filled(F.col("template"), F.col("mpn")).alias("url"), F.struct(F.lit(1).alias("s"), F.col("_d").alias("a"), F.col("_p").cast("bigint").alias("b")).alias("_o"), F.lit("guess").alias("source"))
    if dead is not None:
        gone = dead.where("dead").select(F.col("template").alias("_t")).distinct()
        exact = guessed.withColumn("_u", urls.url_template(F.col("url"), F.col("mpn"))).withColumn("_t", F.when(urls.is_portable(F.col("_u"), hosts), F.col("_u")))
        guessed = exact.join(gone, "_t", "left_anti").drop("_t", "_u")
    every = guessed
    if known is not None:
        filed = own.join(memory.lookup_known(own, known), "mpn").where(~urls.is_blocked("url", hosts) & ~urls.is_distributor("url", hosts) & ~urls.is_pdf("url"))
        filed = filed.where((F.size("domains") == 0) | urls.on_domains("url", F.col("domains")))
        every = filed.select(key, "mpn", "url", F.struct(F.lit(0).alias("s"), F.col("key_rank").alias("a"), F.col("ord").cast("bigint").alias("b")).alias("_o"), F.lit("known").alias("source")).unionByName(guessed)
    fresh = every.where(~urls.is_blocked("url", hosts))
    first = fresh.groupBy(key, "mpn", urls.fingerprint("url").alias("_f")).agg(F.min(F.struct("_o", "url", "source")).alias("m"))
    place = F.row_number().over(Window.partitionBy(key, "mpn").orderBy("m._o", "m.url")) - 1
    return first.select(key, "mpn", "m.url", place.cast("bigint").alias("ord"), "m.source")


def family_urls(rows: DataFrame, dims: Dims, key: str = "row_id", **learned) -> DataFrame:
    """Candidates on the sister domains of a row's own, without those that its own domains hold already."""
    sisters = F.filter(F.array_distinct(family_domains(F.col("domains"), dims.families)), lambda d: ~urls.on_domains(F.concat(F.lit("https://"), d, F.lit("/")), F.col("domains")))
    return candidate_urls(rows.withColumn("domains", sisters), key=key, **learned)


def template_urls(rows: DataFrame, templates: dict[str, list[str]], key: str = "row_id", hosts: HostLists = BUILT_IN) -> DataFrame:
    """Candidates from the templates of third parties or of distributors, in the order of the dictionary."""
    every = texts([t for own in templates.values() for t in own]) if any(templates.values()) else F.array().cast("array<string>")
    made = rows.where(text("mpn") != "").select(key, "mpn", F.posexplode(every).alias("_p", "t")).withColumn("url", filled(F.col("t"), F.col("mpn"))).where(~urls.is_blocked("url", hosts))
    first = made.groupBy(key, "mpn", urls.fingerprint("url").alias("_f")).agg(F.min(F.struct("_p", "url")).alias("m"))
    return first.select(key, "mpn", "m.url", (F.row_number().over(Window.partitionBy(key, "mpn").orderBy("m._p")) - 1).cast("bigint").alias("ord"))
