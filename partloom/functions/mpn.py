"""Part-number functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BLANKS, strip, text

#: fixed values: packaging suffixes that are not part of a part number
SUFFIXES = ["-UPC", "-JR", "-PKG", "-BX", "-BOX", "-EA", "-PK", "-PACK", "-BULK"]


def normalize(x: Column | str) -> Column:
    """Upper case, one packaging suffix removed, white space removed."""
    return F.regexp_replace(F.regexp_replace(F.upper(strip(x)), f"({'|'.join(SUFFIXES)})$", ""), BLANKS, "")


def search(x: Column | str) -> Column:
    """The form to search for: a trailing Z of a number over four characters is dropped."""
    n = normalize(x)
    return F.when(n.endswith("Z") & (F.length(n) > 4), F.substring(n, F.lit(1), F.length(n) - 1)).otherwise(n)


def catalog(x: Column | str, brand: Column | None = None) -> Column:
    """The maker's own number inside a distributor's wrapper ``PREFIX-REST``."""
    n = normalize(x)
    prefix, rest = F.regexp_extract(n, r"^([A-Z0-9]{2,6})-(.+)$", 1), F.regexp_extract(n, r"^([A-Z0-9]{2,6})-(.+)$", 2)
    wrapped = prefix.rlike("[A-Z]")
    number = rest.rlike("^[0-9]{8,}$")
    compact = F.regexp_replace(F.upper(text(brand if brand is not None else F.lit(""))), "[^A-Z0-9]", "")
    branded = (compact != "") & prefix.startswith(compact) & (F.length(rest) >= 6)
    return F.when(wrapped & (number | branded), rest).otherwise(n)


def catalog_search(x: Column | str, brand: Column | None = None) -> Column:
    found = catalog(x, brand)
    return F.when(found != normalize(x), found).otherwise(search(x))


def lookup_keys(x: Column | str) -> Column:
    """Keys under which a part number may be filed, most exact first."""
    from .text import file_key

    raw = strip(x)
    cut = F.substring(raw, F.lit(1), F.length(raw) - 1)
    short = F.when(raw.endswith("Z") & (F.length(raw) > 4), F.array(cut, F.upper(cut))).otherwise(F.array().cast("array<string>"))
    keys = F.array_distinct(F.concat(F.array(raw, F.upper(raw)), short, F.array(file_key(raw))))
    return F.when(raw == "", F.array().cast("array<string>")).otherwise(keys)
