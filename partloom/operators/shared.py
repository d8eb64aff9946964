"""Memory that several runs share: an idempotent merge of what each has learned, and its size limit (AGG-17, SRC-19).

Every table's merge is a union and one aggregation by the entry's key, so it combines before the shuffle and a replayed overlay
changes nothing.  Lists keep their order by ``ord``: what the base holds stays in front of what the overlay adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .positions import running

#: schema of each shared table
TABLES = {
    "known_urls": "mpn string, url string, ord bigint", "search_paths": "host string, template string, ord bigint", "dead_paths": "host string, template string, miss bigint, hit bigint",
    "storefronts": "host string, ord bigint", "rejected": "field string, value string, n bigint, global boolean", "overrides": "mpn string, label string, value string, uom string",
    "reviewer_urls": "mpn string, url string, ord bigint", "flags": "id string, at timestamp, field string, value string",
}
KEYS = {"known_urls": ["mpn", "url"], "search_paths": ["host", "template"], "storefronts": ["host"], "reviewer_urls": ["mpn", "url"], "dead_paths": ["host", "template"], "rejected": ["field", "value"], "overrides": ["mpn", "label"], "flags": ["id"]}
LISTS = ["known_urls", "search_paths", "storefronts", "reviewer_urls"]
HOSTS, FLAGS = 500, 300


def bare_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(strip(host)), r"^www\.", "")


def _union(base: DataFrame, overlay: DataFrame) -> DataFrame:
    return base.withColumn("_side", F.lit(0)).unionByName(overlay.select(*base.columns).withColumn("_side", F.lit(1)))


def merge_table(name: str, base: DataFrame, overlay: DataFrame) -> DataFrame:
    """One shared table merged.  Lists: the union, an entry stays where it stood, new ones come behind in their order.  Dead paths
    and overrides: the overlay's entry wins.  Rejections: the larger count; global if either is, or at two.  Flags: the union by id,
    the newest 300.  Storefronts: hosts in one form, the first 500.  Entries with an empty or null key are dropped."""
    keys = KEYS[name]
    if name == "storefronts":
        base, overlay = (x.withColumn("host", bare_host(F.col("host"))) for x in (base, overlay))
    both = _union(base, overlay)
    for k in keys:
        both = both.where(F.coalesce(F.col(k), F.lit("")) != "")
    if name in LISTS:
        # places of new entries begin behind the base's last place, one figure for the table
        top = base.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("m")).first()["m"] + 1
        first = both.groupBy(*keys).agg(F.min(F.struct("_side", "ord")).alias("s"))
        out = first.select(*keys, (F.col("s.ord") + F.when(F.col("s._side") == 1, top).otherwise(0)).alias("ord"))
        return out.orderBy("ord", *keys).limit(HOSTS) if name == "storefronts" else out
    if name == "rejected":
        out = both.groupBy(*keys).agg(F.max("n").alias("n"), F.bool_or("global").alias("global"))
        return out.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("global", F.coalesce("global", F.lit(False)) | (F.col("n") >= 2))
    rest = [c for c in base.columns if c not in keys]
    out = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_side", *rest)).alias("s")).select(*keys, "s.*").select(*base.columns)
    return out.orderBy(F.desc("at"), "id").limit(FLAGS) if name == "flags" else out


def merge_memory(base: dict[str, DataFrame], overlay: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables of ``TABLES``; one that a side lacks is taken from the other."""
    return {n: merge_table(n, base[n], overlay[n]) if n in base and n in overlay else (base[n] if n in base else overlay[n]) for n in TABLES if n in base or n in overlay}


def trimmed(entries: DataFrame, most: int, key: str = "mpn", order: str = "ord") -> DataFrame:
    """Whole keys, oldest first, go until what stays is within ``most`` bytes.  A key is as old as its first place; sizes are
    UTF-8 bytes of all its columns; ties go by the key.  The sum runs over ranges of keys, not through one task."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in entries.columns), F.lit(0))
    keys = entries.groupBy(key).agg(F.sum(size.cast("bigint")).alias("_size"), F.min(order).alias("_born"))
    kept = running(keys, [F.desc("_born"), F.desc(key)], "_size", "_sum").where(F.col("_sum") <= most).select(key)
    return entries.join(kept, key, "left_semi")
