"""Which hosts a row may read, and which results of a search it keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import Dims
from ..functions import urls
from . import positions
from ..functions.text import strip, text, texts


def _first_of_each(xs: Column) -> Column:
    """Elements without repeats of any case, the first spelling counts; empty ones go."""
    low = F.transform(xs, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x")))
    every = F.filter(low, lambda e: e["k"] != "")
    return F.transform(F.filter(every, lambda e: F.array_position(F.transform(every, lambda o: o["k"]), e["k"]) == F.array_position(F.transform(every, lambda o: o["i"]), e["i"])), lambda e: e["x"])


def family_domains(domains: Column, families: list[list[str]]) -> Column:
    """Domains of every family with a member that holds, or is held by, one of the row's."""
    if not families:
        return F.array().cast("array<string>")
    groups = F.array(*[texts(g) for g in families])
    meets = lambda g: F.exists(g, lambda m: F.exists(domains, lambda d: (d != "") & (F.contains(F.lower(m), F.lower(d)) | F.contains(F.lower(d), F.lower(m)))))
    return F.flatten(F.filter(groups, meets))


def allowed_domains(domains: Column, dims: Dims, third_party: bool = True, distributors: bool = False) -> Column:
    """The maker's domains, its families', and on demand those of third parties and distributors, in this order."""
    parts = [domains, family_domains(domains, dims.families)]
    parts += [texts(list(dims.third_party))] if third_party else []
    parts += [texts(list(dims.distributor_templates))] if distributors else []
    return _first_of_each(F.concat(*parts))


def is_appliance_template(template: Column) -> Column:
    """The path of a template (or a bare path) is ``/appliance/...``."""
    p = F.lower(F.regexp_replace(F.regexp_replace(strip(template), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", ""))
    return p.startswith("/appliance/") | F.contains(p, F.lit("/appliance/{mpn}"))


def bare_host(h: Column) -> Column:
    return F.regexp_replace(F.lower(text(h)), r"^www\.", "")


def may_use_appliance_path(hosts: DataFrame, templates: DataFrame, host: str = "host") -> DataFrame:
    """Distinct ``hosts`` and whether one of ``templates(host, template)`` of theirs already has an appliance path.  A template's
    host counts where it is the host, a parent of it, or ends inside it at a dot or at its end; each such part of a host is
    a key of the equi-join (a few hundred a host)."""
    taught = templates.where(is_appliance_template(F.col("template"))).select(bare_host(F.col("host")).alias("part")).where("part <> ''").distinct()
    own = hosts.select(bare_host(F.col(host)).alias("host")).where("host <> ''").distinct()
    ends = F.filter(F.sequence(F.lit(1), F.length("host")), lambda e: (e == F.length("host")) | (F.substr(F.col("host"), e + 1, F.lit(1)) == "."))
    parts = F.array_distinct(F.flatten(F.transform(ends, lambda e: F.transform(F.sequence(F.lit(1), e), lambda b: F.substr(F.col("host"), b, e - b + 1)))))
    met = own.select("host", F.explode(parts).alias("part")).join(taught, "part").select("host").distinct().withColumn("taught", F.lit(True))
    return own.join(met, "host", "left").withColumn("taught", F.coalesce("taught", F.lit(False)))


def url_host(url: Column) -> Column:
    """What stands between ``//`` and the next slash, as found; '' without ``://``."""
    return F.when(F.contains(text(url), F.lit("://")), F.split_part(text(url), F.lit("/"), F.lit(3))).otherwise(F.lit(""))


def hosts_of(urls_: Column) -> Column:
    return F.filter(F.transform(urls_, lambda u: bare_host(url_host(u))), lambda h: h != "")


def follow_hosts(url: Column, domains: Column, dims: Dims) -> Column:
    """Hosts whose links a page may lead to: its own first, then the maker's; without a url all allowed ones."""
    own = url_host(url)
    return F.when(own != "", F.concat(F.array(own), domains)).otherwise(allowed_domains(domains, dims))


def first_of_kind(results: DataFrame, kind: Column, kinds: list[str], limit: int, key: str = "mpn", url: str = "url", order: str = "ord") -> DataFrame:
    """Per key the first ``limit`` distinct urls of these kinds, in order: a top-k.  Repeats fold before the ranking."""
    once = results.where(kind.isin(kinds)).groupBy(key, url).agg(F.min(order).alias(order))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(order, url))).where(F.col("rank") <= limit)


def allowed_results(results: DataFrame, limit: int, domains: str = "domains", hosts: urls.HostLists = urls.BUILT_IN) -> DataFrame:
    return first_of_kind(results, urls.classify("url", F.col(domains), F.col(domains), hosts), ["MANUFACTURER"], limit)


def batch_rows(rows: DataFrame, only: str = "", limit: int = 0) -> DataFrame:
    """Rows of a run: all, dishwashers or one buying group; a run's limit counts the rows that are left, in their order."""
    kept = {"dishwasher": F.contains(F.lower("Part_Desc"), F.lit("dishwasher")), "appde": F.contains("Part_Manuf", F.lit("APPDE"))}.get(only)
    out = rows if kept is None else rows.where(kept)
    return positions.page_of(out, ["row_id"], 0, limit) if limit else out
