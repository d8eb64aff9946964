"""Workbooks read cell by cell, their headers, kinds and tables."""

import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from partloom.operators import references
from partloom.sources import workbook

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def column(n):
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def write(path, sheets, places=True):
    """A workbook of ``{name: rows}`` with shared strings, as office programs write it."""
    strings: list[str] = []

    def cell(v, r, c):
        at = f' r="{column(c)}{r}"' if places else ""
        if v is None:
            return f"<c{at}/>" if not places else ""
        if isinstance(v, bool):
            return f'<c{at} t="b"><v>{int(v)}</v></c>'
        if isinstance(v, int | float):
            return f"<c{at}><v>{v}</v></c>"
        if v.startswith("="):
            return f'<c{at} t="str"><f>{escape(v)}</f><v>made</v></c>'
        if v.startswith("inline:"):
            return f'<c{at} t="inlineStr"><is><t>{escape(v[7:])}</t></is></c>'
        strings.append(v)
        return f'<c{at} t="s"><v>{len(strings) - 1}</v></c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{LINK}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{LINK}/worksheet" Target="{"/xl/" if i == 1 else ""}worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">' + "".join(cell(v, r, c) for c, v in enumerate(row, 1)) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si><r><t>{escape(s[:2])}</t></r><r><t>{escape(s[2:])}</t></r><rPh><t>no</t></rPh></si>" for s in strings) + "</sst>")


LOV = {"Guide": [["read me"], [None, "x"]], "LOV": [["Title of all"], [None], ["a", "b"], ["Attribute Label", "Attribute Value", "Remarks"], ["Color", "Red", None], ["Color", " Blue ", "-- Unbranded --"], ["Size", 3.0, True], ["Size", 0.125, "=A1"], ["Color", "Red", "inline:again & again"]]}


@pytest.mark.parametrize("places", [True, False])
def test_cells(spark, tmp_path, places):
    write(tmp_path / "lov.xlsx", LOV, places)
    got = {(r.sheet, r.row, r.col): r.value for r in workbook.read_workbooks(spark, str(tmp_path / "lov.xlsx")).collect()}
    assert got["Guide", 2, 2] == "x" and got["LOV", 6, 2] == "Blue" and ("LOV", 6, 3) not in got and got["LOV", 7, 2] == "3" and got["LOV", 7, 3] == "TRUE"
    assert got["LOV", 8, 2] == "0.125" and got["LOV", 8, 3] == "made" and got["LOV", 9, 3] == "again & again" and ("LOV", 2, 1) not in got


def test_headers_kinds_and_tables(spark, tmp_path):
    books = {
        "lov": LOV, "makers": {"S": [["MANUFACTURER_NAME", "BRAND_NAME", "CODE"], ["Acme", "A", 1]]}, "units": {"S": [["Measurement Type", "Abbreviation"], ["inch", "in"]]}, "fractions": {"S": [["Decimal", "Fraction", "x"], [".5", "1/2"]]},
        "tax": {"S": [["Leaf Node Classpath", "Class", "Fine"], ["a>b", "c", "d"]]}, "ref": {"Expected Output": [["Mfg_Part_Num", "x", "y"], ["1", "2", "3"]]}, "other": {"Expected": [["q"]]}, "~$lock": {"S": [["x"]]},
        "deep": {"S": [*[["junk", "junk"]] * 10, ["Attribute Label", "Values", "c", "d"], ["Color", "Red"]]},
    }
    for name, sheets in books.items():
        write(tmp_path / f"{name}.xlsx", sheets)
    book = workbook.read_workbooks(spark, str(tmp_path))
    kinds = {r.path.rsplit("/", 1)[-1][:-5]: r.kind for r in workbook.classified(book).collect()}
    assert kinds == {"lov": "lov", "makers": "manufacturers", "units": "uom", "fractions": "fractions", "tax": "taxonomy", "ref": "reference200", "other": None, "deep": "lov"}
    heads = {(r.path.rsplit("/", 1)[-1], r.sheet): r.row for r in workbook.headers(book).collect()}
    assert heads["lov.xlsx", "LOV"] == 4 and heads["deep.xlsx", "S"] == 11 and heads["lov.xlsx", "Guide"] == 1 and heads["units.xlsx", "S"] == 1
    rows = workbook.table(book.where(F.col("path").endswith("/lov.xlsx") | F.col("path").endswith("/deep.xlsx")), {"label": ["attribute label"], "value": ["attribute value", "values"]})
    allowed = {r.label: r.allowed for r in references.values_by_label(rows.where(F.col("path").endswith("lov.xlsx"))).collect()}
    assert allowed == {"Color": ["Red", "Blue"], "Size": ["3", "0.125"]}
    assert [(r.label, r.value) for r in rows.where(F.col("path").endswith("deep.xlsx")).collect()] == [("Color", "Red")]
    assert book.rdd.getNumPartitions() == 9  # sheets


def test_no_workbook_fails(spark, tmp_path):
    (tmp_path / "x.xlsx").write_text("no archive")
    with pytest.raises(Exception):  # noqa: B017
        workbook.read_workbooks(spark, str(tmp_path)).count()
