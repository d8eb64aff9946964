"""Input analysis: part number, description and quality of one product row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import ABBREVIATIONS
from ..functions import mpn
from ..functions.text import BLANKS, clean_brand, literal, strip, text

INPUT = ["Mfg_Part_Num", "Part_Desc", "E1_Brand", "Unilog_Brand", "DIB_Brand", "Part_Manuf"]


def clean_desc(x: Column | str) -> Column:
    t = F.regexp_replace(strip(x), BLANKS, " ")
    return F.replace(F.replace(t, F.lit("''"), F.lit('"')), F.lit('""'), F.lit('"'))


def ordered_abbreviations(table: dict[str, str]) -> list[tuple[str, str]]:
    return sorted(table.items(), key=lambda kv: -len(kv[0]))


def expand(x: Column, table: dict[str, str] = ABBREVIATIONS) -> Column:
    """``struct(text, found)``: each abbreviation in turn, longest first, over the text the earlier ones left."""
    one = lambda k, v: f"named_struct('k', {literal(k)}, 'v', {literal(v)}, 'u', {literal(k.upper())}, 'p', {literal(rf'(?i){chr(92)}b{chr(92)}Q{k}{chr(92)}E{chr(92)}b')})"
    entries = F.expr(f"array({', '.join(one(k, v) for k, v in ordered_abbreviations(table))})")
    # capitals are made anew only where the text changed
    state = lambda t, found: F.struct(t.alias("text"), F.upper(t).alias("up"), found.alias("found"))

    def step(a: Column, e: Column) -> Column:
        hit = F.contains(a["up"], e["u"]) & F.rlike(a["text"], e["p"])
        return F.when(hit, state(F.regexp_replace(a["text"], e["p"], e["v"]), F.concat(a["found"], F.array(e["k"])))).otherwise(a)

    return F.aggregate(entries, state(x, F.array().cast("array<string>")), step, lambda a: F.struct(a["text"].alias("text"), a["found"].alias("found")))


def embedded_mpn(desc: Column, raw: Column) -> Column:
    """The row's own number if the description begins with it, else the first other part-number-like token."""
    n = mpn.normalize(raw)
    token = mpn.normalize(F.regexp_extract(desc, r"\b([A-Z0-9][A-Z0-9\-/]{3,})\b", 1))
    lead = F.rlike(desc, F.concat(F.lit(r"(?i)^\Q"), n, F.lit(r"\E\b")))
    return F.when(lead, n).when((token != n) & (F.length(token) >= 4), token).otherwise(F.lit(""))


def analyze(rows: DataFrame, table: dict[str, str] = ABBREVIATIONS) -> DataFrame:
    """Adds clean_desc, expanded_desc, abbreviations_found, normalized_mpn, search_mpn, embedded_mpn, empty_fields, quality_score."""
    named = rows.withColumn("clean_desc", clean_desc("Part_Desc")).withColumn("_e", expand(F.col("clean_desc"), table))
    brands = ["E1_Brand", "Unilog_Brand", "DIB_Brand"]
    empty = [F.when(clean_brand(c) == "", F.lit(c)) for c in brands] + [F.when(strip("Part_Manuf") == "", F.lit("Part_Manuf"))]
    return named.withColumns({
        "expanded_desc": F.col("_e.text"), "abbreviations_found": F.col("_e.found"), "normalized_mpn": mpn.normalize("Mfg_Part_Num"), "search_mpn": mpn.search("Mfg_Part_Num"),
        "embedded_mpn": embedded_mpn(F.col("clean_desc"), text("Mfg_Part_Num")), "empty_fields": F.filter(F.array(*empty), lambda x: x.isNotNull()),
    }).withColumn("quality_score", F.round((6 - F.size("empty_fields")) / F.lit(6.0), 2)).drop("_e")
