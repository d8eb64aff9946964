"""Character references of HTML, decoded in the JVM as the standard says (STR-19): every name, the longest known beginning of an
unknown one (``&ampx;`` is ``&x;``), names that need no semicolon, and numbers with the standard's substitutions.

Names come from Python's table of the standard, in a literal dealt into small maps, because Spark searches a map from its beginning."""

from __future__ import annotations

import json
import zlib
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, text

MAPS = 2048
#: a reference behind its ampersand: a number, or the beginning of what may be a name (the longest has 31 letters)
TOKEN = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z0-9]{1,32};?)"


def _names() -> Column:
    dealt: list[dict[str, str]] = [{} for _ in range(MAPS)]
    for name, mark in html5.items():
        dealt[zlib.crc32(name.encode()) % MAPS][name] = mark
    return F.from_json(F.lit(json.dumps(dealt)), "array<map<string,string>>")


def _substitutes() -> Column:
    """Numbers that stand for other characters: those of the Windows code page, zero and the carriage return."""
    table = {n: bytes([n]).decode("cp1252", "replace") for n in range(0x80, 0xA0)}
    table = {n: c for n, c in table.items() if c != "�"} | {0: "�", 13: "\r"}
    table |= {n: chr(n) for n in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
    return F.create_map(*[x for n, c in sorted(table.items()) for x in (F.lit(n), F.lit(c))])


def _number(token: Column) -> Column:
    """``#34;`` or ``#x22;`` -> its character; nothing for numbers that stand for none."""
    bare = F.rtrim(F.substring(token, F.lit(2), F.length(token)), F.lit(";"))
    hexadecimal = F.lower(F.substring(bare, 1, 1)) == "x"
    digits = F.regexp_replace(F.when(hexadecimal, F.substring(bare, F.lit(2), F.length(bare))).otherwise(bare), "^0+(?=.)", "")
    value = F.when(F.length(digits) > 8, F.lit(1 << 32)).when(hexadecimal, F.conv(digits, 16, 10).cast("bigint")).otherwise(digits.cast("bigint"))

    def mark(n: Column) -> Column:
        plane = n.bitwiseAND(F.lit(0xFFFF))
        void = n.between(1, 8) | n.between(0xE, 0x1F) | n.between(0x7F, 0x9F) | n.between(0xFDD0, 0xFDEF) | (n == 0xB) | (plane >= 0xFFFE)
        made = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        known = F.try_element_at(_substitutes(), n.cast("int"))
        return F.when(n > 0x10FFFF, F.lit("�")).when(known.isNotNull(), known).when(n.between(0xD800, 0xDFFF), F.lit("�")).when(void, F.lit("")).otherwise(made)

    return let(value, mark)


def decode_references(x: Column | str) -> Column:
    """``x`` with its character references decoded, once, from left to right; null is empty."""

    def named(names: Column, token: Column) -> Column:
        find = lambda t: F.try_element_at(F.get(names, F.crc32(t.cast("binary")) % MAPS), t)
        ends = F.sequence(F.length(token), F.lit(2), F.lit(-1))
        hits = F.filter(F.transform(ends, lambda n: F.struct(n.alias("n"), find(F.substring(token, F.lit(1), n)).alias("mark"))), lambda h: h["mark"].isNotNull())
        # a token of 33 characters is a longer word's beginning: only what the standard's 32 hold may match
        return F.when(F.length(token) >= 2, let(F.get(hits, F.lit(0)), lambda h: F.concat(h["mark"], F.substring(token, h["n"] + 1, F.length(token)))))

    def piece(names: Column, p: Column) -> Column:
        def decoded(token: Column) -> Column:
            new = F.when(token.startswith("#"), _number(token)).otherwise(named(names, token))
            return F.when(token == "", F.concat(F.lit("&"), p)).otherwise(F.concat(F.coalesce(new, F.concat(F.lit("&"), token)), F.substring(p, F.length(token) + 1, F.length(p))))

        return let(F.regexp_extract(p, TOKEN, 1), decoded)

    def every(raw: Column) -> Column:
        parts = F.split(raw, "&")
        return F.array_join(let(_names(), lambda names: F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(piece(names, p)))), "")

    return let(text(x), lambda raw: F.when(F.contains(raw, F.lit("&")), every(raw)).otherwise(raw))
