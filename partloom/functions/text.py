"""Column builders for text.  Missing text is the empty string throughout; helpers accept null and return ''."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: brand cells that say "no brand"
PLACEHOLDERS = ["-- unbranded --", "-- no unilog brand --", "-- no dib brand --", "-- no dib brand--"]


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text(x: Column | str) -> Column:
    return F.coalesce(col(x).cast("string"), F.lit(""))


def literal(s: str) -> str:
    """SQL text of a string constant."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def texts(xs: list[str]) -> Column:
    """Array constant, parsed in one call."""
    return F.expr(f"array({', '.join(map(literal, xs))})") if xs else F.array().cast("array<string>")


def mapping(pairs: dict[str, str]) -> Column:
    return F.expr(f"map({', '.join(literal(x) for kv in pairs.items() for x in kv)})")


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` computed once, however often ``f`` uses it: keeps large expressions from doubling."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


#: white space as Python sees it
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
BLANKS = r"[\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def strip(x: Column | str) -> Column:
    """Trim white space of any kind, as Python's ``str.strip``."""
    return F.btrim(text(x), F.lit(SPACES))


def squash(x: Column | str) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(text(x), BLANKS, " "))


def title(x: Column | str) -> Column:
    """Capital after every non-letter, as Python's ``str.title``: ``cut-off`` gives ``Cut-Off``."""
    runs = F.regexp_extract_all(text(x), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1 << 30)))), "")


def is_placeholder(x: Column | str) -> Column:
    return (text(x) == "") | F.lower(strip(x)).isin(PLACEHOLDERS)


def clean_brand(x: Column | str) -> Column:
    return F.when(is_placeholder(x), F.lit("")).otherwise(strip(x))


def label_key(x: Column | str) -> Column:
    """Lower case and single blanks: the form in which labels are compared."""
    return F.lower(squash(x))


def compact_key(x: Column | str) -> Column:
    """Letters and digits only, lower case."""
    return F.lower(F.regexp_replace(text(x), r"[^\p{L}\p{N}]", ""))


def clean_label(x: Column | str) -> Column:
    return F.substring(F.regexp_replace(squash(x), ":+$", ""), 1, 48)


def clean_value(x: Column | str) -> Column:
    return F.substring(squash(x), 1, 80)


def is_readable(x: Column | str) -> Column:
    """False for PDF bytes, control characters, or text whose first 4000 characters are under 85 % printable."""
    t = text(x)
    sample = F.substring(t, 1, 4000)
    odd = F.length(sample) - F.length(F.regexp_replace(sample, r"[\p{C}\p{Z}&&[^ \n\t\r]]", ""))
    printable = F.length(sample) - odd
    pdf = F.startswith(F.ltrim(t, F.lit(SPACES)), F.lit("%PDF"))
    return (t == "") | (~pdf & ~t.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]") & (printable >= 0.85 * F.length(sample)))


def sanitize(x: Column | str) -> Column:
    """A cell that cannot be written as text is blanked as a whole."""
    return F.when(is_readable(x), text(x)).otherwise(F.lit(""))


def bare_brand(x: Column | str) -> Column:
    return F.trim(F.translate(text(x), "®™", ""))


def contains_word(haystack: Column, needle: Column) -> Column:
    """``needle`` occurs in ``haystack`` between word boundaries, any case; an empty needle never does."""
    return (needle != "") & F.rlike(haystack, F.concat(F.lit(r"(?i)\b\Q"), needle, F.lit(r"\E\b")))


def asset_prefix(brand: Column | str) -> Column:
    """Brand as a file-name prefix: alphanumeric parts, first letters upper, joined by ``_``; two brands have a fixed one."""
    bare = bare_brand(brand)
    parts = F.regexp_extract_all(bare, F.lit(r"([A-Za-z0-9]+)"), F.lit(1))
    made = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "_")
    return F.when(F.lower(bare) == "whirlpool", F.lit("Whirlpool")).when(F.upper(bare) == "FRIGIDAIRE", F.lit("FRIGIDAIRE")).when(F.size(parts) == 0, F.lit("PRODUCT")).otherwise(made)


def file_key(x: Column | str) -> Column:
    """Upper-case file name: other characters become ``_``; nothing left gives ``UNKNOWN``."""
    name = F.upper(F.regexp_replace(strip(x), r"[^\p{L}\p{N}_-]", "_"))
    return F.when(name == "", F.lit("UNKNOWN")).otherwise(name)


#: fixed values: single-character entities and marks that occur in product pages
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&reg;", "®"), ("&trade;", "™"), ("&deg;", "°"), ("&amp;", "&")]


def unescape(x: Column | str) -> Column:
    """The entities that occur in short values; whole pages go through ``entities.decode_references``."""
    out = text(x)
    for entity, mark in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(mark))
    return out


def visible(x: Column | str) -> Column:
    """Text of a page without scripts, styles and tags."""
    bare = F.regexp_replace(text(x), r"(?is)<script[^>]*>.*?</script>", " ")
    bare = F.regexp_replace(bare, r"(?is)<style[^>]*>.*?</style>", " ")
    return F.regexp_replace(bare, r"<[^>]+>", " ")


def page_text(x: Column | str) -> Column:
    """Unescape first, then drop markup, so escaped tags vanish too; white space is squashed, ends are kept."""
    from .entities import decode_references

    return F.regexp_replace(visible(decode_references(x)), BLANKS, " ")


def pad_mobile(core: Column, mpn: Column, brand: Column, manufacturer: Column, minimum: int = 60) -> Column:
    """Comma-join, with fillers that are not in it yet and then with the part number and ``Spec`` until ``minimum`` characters;
    never over 80."""
    short = lambda a: F.length(a) < minimum
    fillers = F.array(manufacturer, F.trim(F.translate(brand, "®™", "")), mpn, F.lit("Industrial Product"))
    start = F.substring(F.array_join(F.filter(F.transform(F.split(core, ","), lambda p: F.trim(p)), lambda p: p != ""), ", "), 1, 80)
    filled = F.aggregate(fillers, start, lambda a, p: F.when(short(a) & (p != "") & ~F.contains(a, p), F.btrim(F.concat(a, F.lit(", "), p), F.lit(", "))).otherwise(a))

    def more(a: Column, _: Column) -> Column:
        grown = F.concat(a, F.lit(", "), mpn)
        return F.when(~short(a), a).when(~short(grown), grown).otherwise(F.concat(grown, F.lit(", Spec")))

    # every round adds eight characters at least
    return F.substring(F.aggregate(F.sequence(F.lit(1), F.lit(-(-minimum // 8))), filled, more), 1, 80)
