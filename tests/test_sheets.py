"""Spreadsheets written part by part."""

from __future__ import annotations

import zipfile

import pytest

from lodestone.sources import sheets

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
LINKS = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, pages: dict[str, str], shared: str | None = None, absolute: bool = False) -> str:
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(pages, 1))
        book.writestr("xl/workbook.xml", f"<workbook {NS} {LINKS}><sheets>{names}</sheets></workbook>")
        at = "/xl/" if absolute else ""
        book.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="{at}worksheets/sheet{i}.xml"/>' for i in range(1, len(pages) + 1)) + "</Relationships>")
        if shared is not None:
            book.writestr("xl/sharedStrings.xml", f"<sst {NS}>{shared}</sst>")
        for i, rows in enumerate(pages.values(), 1):
            book.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")
    return str(path)


def cells(number: int, *values: str) -> str:
    return f'<row r="{number}">' + "".join(f'<c r="{chr(65 + i)}{number}" t="inlineStr"><is><t>{v}</t></is></c>' for i, v in enumerate(values)) + "</row>"


def test_kinds_of_cells(spark, tmp_path):
    shared = "<si><t>plain</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si>"
    rows = (
        cells(1, "title") + '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2"><v>1.5</v></c><c r="C2" t="b"><v>1</v></c><c r="D2" t="e"><v>#N/A</v></c></row>'
        '<row r="3"><c r="A3" t="s"><v>1</v></c><c r="D3" t="str"><f>A1</f><v>made</v></c></row><row r="4"><c r="B4"><v>7</v></c></row>'
        '<row><c t="inlineStr"><is><t>next</t></is></c><c><v>3</v></c></row><row r="9"><c r="A9"/></row><row r="10"><c r="A10" t="s"><v>0</v></c><c r="AA10"><v>1</v></c></row>'
    )
    path = workbook(tmp_path / "a.xlsx", {"One": rows, "Two": ""}, shared)
    got = [tuple(r)[1:] for r in sheets.sheet_rows(spark, path, ["a", "b", "c", "d"]).orderBy("row").collect()]
    assert got == [("One", 2, "plain", "1.5", "true", None), ("One", 3, "rich", None, None, "made"), ("One", 5, "next", "3", None, None), ("One", 10, "plain", None, None, None)]


def test_many_rows_and_several_books(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for k in range(3):
        workbook(tmp_path / "x" / f"{k}.xlsx", {"S": "".join(cells(i, f"v{i % 100} ", str(i)) for i in range(1, 5001))}, absolute=k == 1)
    rows = sheets.sheet_rows(spark, str(tmp_path / "x"), ["a", "b"], ["S"], first=1, distinct={"S": 100})
    assert rows.count() == 15000 and rows.where("cast(b AS long) <> row").count() == 0


@pytest.mark.parametrize(
    ("how", "message"),
    [({"sheets": ["T"]}, "no sheet 'T'"), ({"header": ["a", "b"]}, "header"), ({"distinct": {"S": 3}}, "has 2 different values")],
)
def test_what_does_not_hold_is_an_error(spark, tmp_path, how, message):
    path = workbook(tmp_path / "a.xlsx", {"S": cells(1, "a", "c") + cells(2, "x", "1") + cells(3, "y", "2") + cells(4, "x ", "3")})
    assert sheets.sheet_rows(spark, path, ["a", "b"], header=["a", "c"], distinct={"S": 2}).count() == 3
    with pytest.raises(Exception, match=message):
        sheets.sheet_rows(spark, path, ["a", "b"], **how).collect()
