"""URL filters: host and path rules, then a weighted vocabulary matched by an Aho-Corasick automaton.

The longest fitting rule decides.  Without one the whole url (percent signs decoded, A-Z lower-cased, query and
fragment included) is scanned once for all terms; a hit counts if it is bounded by the ends or by characters other than
letters and digits.  One strict term rejects the url, and so do two or more distinct soft terms whose weights add up to
the vocabulary's limit.  Rules and vocabulary are parameters; ``Vocabulary.load`` reads one from a table.

Defined results: a null url has an empty host and path, no rule, and is allowed; a url without ``://`` has an empty host and
path but is scanned; bytes that decode to no character are replaced; repeated rows are judged one by one; other columns
pass through in ``keep``, whatever their names."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import unquote

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: fixed by the contract: (verdict, host and path)
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@dataclass(frozen=True)
class Vocabulary:
    """Lower-case terms; one strict hit, or distinct soft hits of weight ``limit`` together, reject.  No soft term can
    reach the limit alone."""

    strict: tuple[str, ...] = ("porn", "porno", "pornography", "xxx", "hentai", "escort", "escorts", "casino", "casinos", "kasino", "viagra", "cialis", "malware",
                               "phishing", "warez", "keygen", "crackz", "camgirl", "camgirls", "payday-loan", "payday-loans")
    soft: dict[str, int] = field(default_factory=lambda: {
        "adult": 2, "nude": 2, "erotic": 2, "erotik": 2, "erotico": 2, "sexy": 2, "gambling": 2, "poker": 2, "roulette": 2, "slots": 2, "betting": 2, "jackpot": 2, "pills": 2, "pharmacy": 1, "replica": 2, "spam": 2,
        "torrent": 2, "crack": 2, "serial": 1, "dating": 2, "singles": 1, "bet": 1, "bonus": 1, "free": 1, "gratis": 1, "gratuit": 1, "kostenlos": 1, "cheap": 1, "discount": 1, "win": 1, "winner": 1, "loan": 1,
        "loans": 1, "credit": 1, "kredit": 1, "click": 1, "deal": 1, "promo": 1, "farm": 1, "ads": 1, "popup": 1})
    limit: int = 3

    def __post_init__(self):
        if any(w >= self.limit or w < 1 for w in self.soft.values()):
            raise ValueError("soft weights lie between one and below the limit")
        if any(t != ascii_lowered(t) or not t for t in (*self.strict, *self.soft)):
            raise ValueError("terms are not empty and in lower case")

    @classmethod
    def load(cls, terms: DataFrame, limit: int = 3, most: int = 1_000_000) -> Vocabulary:
        """From ``terms(term, weight)``; a null weight marks a strict term.  At most ``most`` terms reach the driver."""
        rows = terms.select(ascii_lower(F.col("term")).alias("term"), F.col("weight").cast("int").alias("weight")).where("term <> ''").distinct().limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} terms")
        strict = {r["term"] for r in rows if r["weight"] is None}
        soft: dict[str, int] = {}
        for r in rows:
            if r["term"] not in strict:
                soft[r["term"]] = max(r["weight"], soft.get(r["term"], 0))
        return cls(tuple(sorted(strict)), soft, limit)

    def automaton(self) -> ahocorasick.Automaton:
        machine = ahocorasick.Automaton()
        for term, weight in [*((t, w) for t, w in self.soft.items() if t not in self.strict), *((t, 0) for t in self.strict)]:
            machine.add_word(term, (term, weight))
        machine.make_automaton()
        return machine

    def rejects(self, machine: ahocorasick.Automaton, text: str) -> bool:
        if not len(machine):
            return False
        soft: dict[str, int] = {}
        for end, (term, weight) in machine.iter(text):
            if _edge(text, end - len(term)) and _edge(text, end + 1):
                if not weight:
                    return True
                soft[term] = weight
        return sum(soft.values()) >= self.limit


def _edge(text: str, i: int) -> bool:
    return i < 0 or i >= len(text) or not text[i].isalnum()


def ascii_lowered(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text)


def ascii_lower(x) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def judge(pages: DataFrame, keep: list[str], url: str = "url", rules: list[tuple[str, str]] = RULES, vocabulary: Vocabulary | None = None) -> tuple[DataFrame, str]:
    """``keep`` columns and a struct column (its name is returned) of host, path, rule and verdict."""
    words = vocabulary or Vocabulary()
    own = [f"k{i}" for i in range(len(keep))]
    base = pages.select(*[F.col(c).alias(k) for k, c in zip(own, keep, strict=True)], F.col(url).alias("url"))
    rest = F.when(F.instr("url", "://") > 0, F.substring_index(F.regexp_replace("url", r"(?s)^.*?://", ""), "#", 1)).otherwise(F.lit(""))
    parts = base.withColumn("bare", F.substring_index(F.coalesce(rest, F.lit("")), "?", 1))
    parts = parts.withColumn("host", ascii_lower(F.substring_index("bare", "/", 1))).withColumn("path", F.expr("substring(bare, length(host) + 1)"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, fit in sorted(rules, key=lambda r: len(r[1])):
        at, _, start = fit.partition("/")
        fits = F.concat(F.lit("."), "host").endswith("." + at) & F.col("path").startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(fit)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    ruled = parts.select(*own, "host", "path", rule.alias("rule"), verdict.alias("say"), "url")

    def make():
        machine = words.automaton()

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            said, urls = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("say", "url"))
            return [pa.array([s or ("block" if t and words.rejects(machine, ascii_lowered(unquote(t))) else "allow") for s, t in zip(said, urls, strict=True)], pa.string())]

        return work

    out, found = common.annotate(ruled, make, "verdict string", [*own, "host", "path", "rule"], ["say", "url"])
    name = common.free_name(keep)
    return out.select(*[F.col(k).alias(c) for k, c in zip(own, keep, strict=True)], F.struct("host", "path", "rule", F.col(found)["verdict"].alias("verdict")).alias(name)), name


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, name = judge(common.table(spark, sf_dir, "pages").select("page_id", "url"), ["page_id"])
    return found.select("page_id", *[F.col(name)[n].alias(n) for n in ("host", "path", "rule", "verdict")])


def sql(vocabulary: Vocabulary | None = None) -> str:
    words = vocabulary or Vocabulary()
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bounded = lambda terms: r"(^|[^\p{L}\p{N}])(" + "|".join(map(re.escape, terms)) + r")([^\p{L}\p{N}]|$)"
    rules = sorted(RULES, key=lambda r: -len(r[1]))
    fits = {f: f"('.' || host) LIKE '%.{f.partition('/')[0]}' AND starts_with(path, '/{f.partition('/')[2]}')" for _, f in rules}
    soft = " + ".join(f"CASE WHEN regexp_matches(seen, '{bounded([t])}') THEN {w} ELSE 0 END" for t, w in words.soft.items())
    return f"""
WITH a AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS bare FROM pages),
b AS (SELECT page_id, url, {lower("split_part(coalesce(bare, ''), '/', 1)")} AS host, substr(coalesce(bare, ''), length(split_part(coalesce(bare, ''), '/', 1)) + 1) AS path FROM a),
c AS (SELECT *, CASE {' '.join(f"WHEN {c} THEN '{f}'" for f, c in fits.items())} END AS rule, {lower("url_decode(coalesce(url, ''))")} AS seen FROM b)
SELECT page_id, host, path, rule, CASE {' '.join(f"WHEN rule = '{f}' THEN '{v}'" for v, f in rules)}
  WHEN regexp_matches(seen, '{bounded(words.strict)}') OR {soft} >= {words.limit} THEN 'block' ELSE 'allow' END AS verdict
FROM c"""
