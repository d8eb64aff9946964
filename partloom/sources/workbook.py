"""Workbooks as a Spark data source: one partition a sheet, one row a filled cell (SRC-06, SRC-07).

``spark.dataSource.register(Workbooks)`` and ``spark.read.format("workbook").load("folder/*.xlsx")`` give ``path, sheet, sheet_no, row, col, value``.
A task streams its sheet's XML and holds the workbook's shared strings, nothing else; rows and columns count from one.  Files are
opened by the workers, so they have to lie in a folder that all of them see.

Defined results: placeholders of missing brands and blank cells are no cells; numbers keep their digits, whole ones without
``.0``; booleans are ``TRUE`` and ``FALSE``; a formula gives its stored value; an error gives its text; dates stay the numbers they are
stored as.  A file that is no workbook fails; hidden lock files (``~$``) are passed over."""

from __future__ import annotations

import glob
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import text

SCHEMA = "path string, sheet string, sheet_no int, row int, col int, value string"
#: cells that say there is no brand
PLACEHOLDER = re.compile(r"-- (unbranded|no \w+ brand) --", re.I)
HEADER_ROWS, HEADER_CELLS = 12, 3
_REFERENCE = re.compile(r"([A-Z]+)([0-9]+)")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


class Sheet(InputPartition):
    def __init__(self, path: str, name: str, number: int, member: str):
        super().__init__(number)
        self.path, self.name, self.number, self.member = path, name, number, member


def sheets(path: str) -> list[Sheet]:
    """The sheets of a workbook in their order, with the archive members that hold them."""
    with zipfile.ZipFile(path) as book:
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        found = []
        for x in ElementTree.fromstring(book.read("xl/workbook.xml")).iter():
            if _local(x.tag) == "sheet":
                link = next(v for k, v in x.attrib.items() if _local(k) == "id")
                target = links[link]
                found.append(Sheet(path, x.get("name", ""), len(found) + 1, target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return found


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out, parts, phonetic = [], [], False
    with book.open("xl/sharedStrings.xml") as source:
        for event, x in ElementTree.iterparse(source, ("start", "end")):
            tag = _local(x.tag)
            if tag == "rPh":
                phonetic = event == "start"
            elif event == "end" and tag == "t" and not phonetic:
                parts.append(x.text or "")
            elif event == "end" and tag == "si":
                out.append("".join(parts))
                parts = []
                x.clear()
    return out


def _shown(kind: str, raw: str, strings: list[str]) -> str:
    if kind == "s":
        return strings[int(raw)] if raw else ""
    if kind == "b":
        return "TRUE" if raw == "1" else "FALSE"
    if kind in ("str", "inlineStr", "e"):
        return raw
    return str(int(float(raw))) if re.fullmatch(r"-?\d+(\.0+)?", raw) and len(raw) < 16 else raw


def cells(sheet: Sheet) -> Iterator[tuple]:
    """The filled cells of a sheet, streamed row by row."""
    with zipfile.ZipFile(sheet.path) as book:
        strings = _strings(book)
        with book.open(sheet.member) as source:
            row = col = 0
            for event, x in ElementTree.iterparse(source, ("start", "end")):
                tag = _local(x.tag)
                if event == "start":
                    if tag == "row":
                        row, col = int(x.get("r") or row + 1), 0
                    continue
                if tag == "c":
                    place = _REFERENCE.fullmatch(x.get("r") or "")
                    col = column_number(place[1]) if place else col + 1
                    raw = "".join(t.text or "" for t in x.iter() if _local(t.tag) in ("v", "t"))
                    value = _shown(x.get("t", "n"), raw, strings).strip()
                    if value and not PLACEHOLDER.fullmatch(value):
                        yield sheet.path, sheet.name, sheet.number, row, col, value
                elif tag == "row":
                    x.clear()


class _Reader(DataSourceReader):
    def __init__(self, pattern: str):
        self.pattern = pattern

    def partitions(self) -> list[Sheet]:
        found = sorted(glob.glob(self.pattern)) if not os.path.isdir(self.pattern) else sorted(glob.glob(os.path.join(self.pattern, "*.xlsx")))
        return [s for path in found if not os.path.basename(path).startswith("~$") for s in sheets(path)]

    def read(self, partition: Sheet) -> Iterator[tuple]:
        yield from cells(partition)


class Workbooks(DataSource):
    """``format("workbook")``; ``load`` takes a file, a folder or a pattern."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"].removeprefix("file://"))


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(Workbooks)
    return spark.read.format("workbook").load(path)


def headers(book: DataFrame) -> DataFrame:
    """``path, sheet, sheet_no, row, names``: each sheet's densest row among the first ``HEADER_ROWS`` (the first of equals, three cells at
    least, else its first row) with its cells in lower case by column."""
    keys = ["path", "sheet", "sheet_no"]
    first = book.where(F.col("row") <= HEADER_ROWS).groupBy(*keys, "row").agg(F.count("*").alias("n"), F.map_from_entries(F.collect_list(F.struct("col", F.lower("value")))).alias("names"))
    dense = F.struct(F.when(F.col("n") >= HEADER_CELLS, F.col("n")).otherwise(0), -F.col("row"))
    return first.groupBy(*keys).agg(F.max_by(F.struct("row", "names"), dense).alias("h")).select(*keys, "h.row", "h.names")


def kind_of(names: Column, sheet_names: Column) -> Column:
    """Kind of a workbook from the header cells of all its sheets and the sheets' names; null if none fits."""
    has = lambda *words: F.exists(names, lambda h: F.array_contains(F.array(*[F.contains(h, F.lit(w)) for w in words]), True))
    equal = lambda *words: F.arrays_overlap(names, F.array(*map(F.lit, words)))
    lov = (has("attribute label", "normalized label") & has("attribute value", "normalized value")) | (equal("attribute label") & equal("attribute values", "values"))
    result = F.exists(sheet_names, lambda s: F.lower(s).rlike("delivery|expected|output"))
    return (
        F.when(lov, "lov").when(has("manufacturer_name") & has("brand_name"), "manufacturers").when(has("abbreviation", "capture form") & has("measurement", "uom type", "uom"), "uom")
        .when(has("decimal") & has("fraction"), "fractions").when(has("classpath", "leaf node classpath") & ~has("attribute value", "normalized value"), "taxonomy")
        .when(result & has("mfg_part_num", "manufacturer_part_number"), "reference200")
    )


def classified(book: DataFrame) -> DataFrame:
    """``path, kind`` of each workbook."""
    h = headers(book)
    each = h.groupBy("path").agg(F.array_distinct(F.flatten(F.collect_list(F.map_values("names")))).alias("names"), F.collect_set("sheet").alias("sheets"))
    return each.select("path", kind_of(F.col("names"), F.col("sheets")).alias("kind"))


def table(book: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """Rows under each sheet's header as ``path, sheet, ord`` and one column for each of ``columns``: name -> header words, of which the
    first that a header cell equals, else contains, gives the column.  ``ord`` grows with the sheets and rows of a workbook;
    rows without any of the columns are left out."""
    h = headers(book).withColumnRenamed("row", "_head")
    pairs = F.map_entries("names")

    def first(word: str, same: bool) -> Column:
        return F.get(F.filter(pairs, lambda e: (e["value"] == word) if same else F.contains(e["value"], F.lit(word))), F.lit(0))["key"]

    def place(words: list[str]) -> Column:
        return F.coalesce(*[first(w, same) for same in (True, False) for w in words])

    at = h.select("path", "sheet", "sheet_no", "_head", F.array(*[F.struct(F.lit(name).alias("name"), place(words).alias("col")) for name, words in columns.items()]).alias("_at"))
    wanted = at.select("path", "sheet", "sheet_no", "_head", F.explode("_at").alias("a")).select("path", "sheet", "sheet_no", "_head", "a.name", "a.col").where("col IS NOT NULL")
    met = book.join(wanted, ["path", "sheet", "sheet_no", "col"]).where(F.col("row") > F.col("_head"))
    rows = met.groupBy("path", "sheet", "sheet_no", "row").agg(*[F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in columns])
    return rows.select("path", "sheet", (F.col("sheet_no") * F.lit(1 << 21) + F.col("row")).cast("bigint").alias("ord"), *[text(c).alias(c) for c in columns])
