"""Official hosts of company names from a table of known entities (SRC-17, SUP-32).

Entities are found by an inverted index of their labels' words: a name meets the postings of its rarest word only, so words that
every company has ("company", "tools") gather nothing unless a name has no other.  The five best candidates are judged in order and
the first that may be the company and has a usable host answers.  Each different name is looked up once; the result is a table by
name that later rows join (``memo``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import strip, text, texts
from ..functions.urls import BUILT_IN, HostLists

CANDIDATES = 5
#: fixed values: types of companies and of things that are none, and words of descriptions for both
ALLOW = ["Q4830453", "Q783794", "Q167270", "Q431289", "Q6881511", "Q891723", "Q161726", "Q13235160", "Q1639109", "Q507619"]
REJECT = ["Q5", "Q11424", "Q7366", "Q134556", "Q5398426", "Q16521"]
COMPANY_WORDS = ["manufacturer", "company", "brand", "corporation", "tools", "lighting", "appliance", "electronics", "building", "industrial", "hardware"]
SKIP_WORDS = ["disambiguation", "family name", "given name", "human", "film", "song", "video game", "fictional", "wikipedia"]


def longest_name(names: Column) -> Column:
    """What is looked up: the longest of a row's names of three characters or more, the first of equals; '' if there is none."""
    known = F.transform(F.filter(names, lambda n: F.length(strip(n)) >= 3), lambda n, i: F.struct(F.length(strip(n)).alias("l"), (-i).alias("i"), strip(n).alias("n")))
    return F.coalesce(F.array_max(known)["n"], F.lit(""))


def words(x: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text(x)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def may_be_company(description: Column, types: Column, label: Column, names: Column) -> Column:
    """Ordered: skipping words, rejected types, allowed types, company words, then a label equal to a name."""
    low = F.lower(text(description))
    holds = lambda xs: F.exists(texts(xs), lambda w: F.contains(low, w))
    has = lambda xs: F.arrays_overlap(F.coalesce(types, F.array().cast("array<string>")), texts(xs))
    same = F.exists(names, lambda n: (text(n) != "") & (F.lower(n) == F.lower(text(label))))
    return F.when(holds(SKIP_WORDS) | has(REJECT), F.lit(False)).when(has(ALLOW) | holds(COMPANY_WORDS), F.lit(True)).otherwise(F.coalesce(same, F.lit(False)))


def host_has_name(host: Column, names: Column) -> Column:
    """A label of the host is a word of a name, or holds it (four letters), or begins with it (three); legal suffixes are no words."""
    parts = F.filter(F.split(F.lower(host), r"[.\-]"), lambda p: p != "")
    tokens = F.filter(F.flatten(F.transform(names, urls.name_tokens)), lambda t: F.length(t) >= 3)
    met = lambda t, p: (p == t) | ((F.length(t) >= 4) & F.contains(p, t)) | ((F.length(t) == 3) & p.startswith(t))
    return F.exists(tokens, lambda t: F.exists(parts, lambda p: met(t, p)))


def candidates(queries: DataFrame, entities: DataFrame, query: str = "query", top: int = CANDIDATES) -> DataFrame:
    """Distinct ``query`` -> its ``top`` best entities: equal labels, labels that begin with it, then the share of common words, then the
    smallest id: a top-k per name."""
    asked = queries.select(F.lower(strip(query)).alias("query")).where("query <> ''").distinct().withColumn("words", words("query"))
    index = entities.select("id", "label", words("label").alias("theirs"))
    posts = index.select("id", "label", "theirs", F.explode("theirs").alias("word"))
    common = posts.groupBy("word").agg(F.count("*").alias("n"))
    each = asked.select("query", "words", F.explode("words").alias("word")).join(common, "word")
    rarest = each.groupBy("query", "words").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    met = rarest.join(posts, "word")
    shared = F.size(F.array_intersect("words", "theirs")) / F.size(F.array_union("words", "theirs"))
    low = F.lower(strip("label"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy((low != F.col("query")), ~low.startswith(F.col("query")), F.desc(shared), "id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= top).select("query", "id", "rank")


def official_hosts(rows: DataFrame, entities: DataFrame, names: str = "names", hosts: HostLists = BUILT_IN) -> DataFrame:
    """``rows(names array)`` and ``entities(id, label, description, types, urls)`` -> one row per different list of names: names, query,
    entity and hosts.  Names without an answer have an empty list; entities without an id are none."""
    asked = rows.select(F.col(names).alias("names")).where(F.col("names").isNotNull()).distinct().withColumn("query", F.lower(longest_name(F.col("names"))))
    known = entities.where("id IS NOT NULL")
    found = candidates(asked, known)
    judged = asked.join(found, "query").join(known, "id").where(may_be_company(F.col("description"), F.col("types"), F.col("label"), F.col("names")))
    fine = F.filter(F.coalesce("urls", F.array().cast("array<string>")), lambda u: text(u).startswith("http") & ~urls.is_blocked(u, hosts) & ~urls.is_distributor(u, hosts))
    bare = F.array_distinct(F.transform(fine, lambda u: F.regexp_replace(F.regexp_replace(urls.netloc(u), r"^www\.", ""), ":.*$", "")))
    kept = judged.withColumn("hosts", bare).withColumn("hosts", F.filter("hosts", lambda h: (h != "") & ~h.endswith("wikipedia.org") & ~h.endswith("wikidata.org") & host_has_name(h, F.col("names"))))
    first = kept.where(F.size("hosts") > 0).groupBy("names", "query").agg(F.min_by(F.struct("id", "hosts"), "rank").alias("s"))
    return asked.join(first, ["names", "query"], "left").select("names", "query", F.col("s.id").alias("entity"), F.coalesce("s.hosts", F.array().cast("array<string>")).alias("hosts"))


def memo(rows: DataFrame, known: DataFrame, entities: DataFrame, names: str = "names", hosts: HostLists = BUILT_IN) -> DataFrame:
    """``known`` (a result of ``official_hosts``) with the names of ``rows`` that it lacks looked up and added."""
    new = rows.select(F.col(names).alias("names")).join(known.select("names"), "names", "left_anti")
    return known.unionByName(official_hosts(new, entities, "names", hosts))
