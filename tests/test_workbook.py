"""Workbooks: types of cells, shared strings, gaps, several sheets and files, missing columns."""

import io
import zipfile

import pytest

from funnelweir.sources import workbook as WB


def test_reads_sheets_by_name_and_trims_headers(spark, tmp_path):
    rows = [[" id ", "name\t", "ok", "price"], [1, "a & <b>", True, 2.5], [None] * 4, [2, None, False, None], [3, " kept ", None, 1e-7]]
    (tmp_path / "one.xlsx").write_bytes(WB.workbook_bytes({"x": rows, "y": [["price", "id"], [9, "007"]], "empty": []}))
    (tmp_path / "two.xlsx").write_bytes(WB.workbook_bytes({"x": [["id", "extra"], [4, "é漢😀"]]}))
    (tmp_path / "~$one.xlsx").write_bytes(b"lock")
    (tmp_path / "note.txt").write_text("no workbook")
    df = WB.read_workbook(spark, str(tmp_path), None, {"id": "item_id"})
    assert df.columns == ["item_id", "name", "ok", "price", "extra"]
    assert df.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, df.collect())) == sorted(
        [("1", "a & <b>", "TRUE", "2.5", None), ("2", None, "FALSE", None, None), ("3", " kept ", None, "1e-07", None), ("007", None, None, "9", None), ("4", None, None, None, "é漢😀")]
    )
    assert [tuple(r) for r in WB.read_workbook(spark, str(tmp_path / "one.xlsx"), ["y"]).collect()] == [("9", "007")]
    with pytest.raises(FileNotFoundError):
        WB.read_workbook(spark, str(tmp_path / "none*.xlsx"))
    with pytest.raises(ValueError):
        WB.read_workbook(spark, str(tmp_path / "one.xlsx"), ["empty"])


def test_shared_strings_references_and_errors():
    """What other writers produce: shared and rich strings, gaps by reference, errors, formulas, absolute targets."""
    main = WB.MAIN[1:-1]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{WB.RELATION[1:-3]}"><sheets><sheet name="s" sheetId="1" r:id="a"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="a" Target="/xl/worksheets/s.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>id</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>hint</t></rPh></si><si><t/></si></sst>')
        cells = '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="AB2" t="s"><v>1</v></c></row><row r="5"><c r="AB5" t="str"><f>1+1</f><v>two</v></c></row>'
        cells += '<row r="6"><c r="A6" t="e"><v>#N/A</v></c><c r="AB6" t="s"><v>2</v></c></row><row r="7"><c r="A7"><v>44197</v></c></row>'
        book.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')
    book = zipfile.ZipFile(io.BytesIO(out.getvalue()))
    assert WB.sheets_of(book) == {"s": "xl/worksheets/s.xml"}
    rows = list(WB.rows_of(book, "xl/worksheets/s.xml", WB.shared_strings(book)))
    assert rows == [{0: "id", 27: "rich"}, {27: "two"}, {0: "44197"}]


def test_a_sheet_larger_than_a_batch(spark, tmp_path):
    n = 2 * WB.BATCH_ROWS + 7
    (tmp_path / "long.xlsx").write_bytes(WB.workbook_bytes({"s": [["k"], *([i] for i in range(n))]}))
    df = WB.read_workbook(spark, str(tmp_path / "long.xlsx"))
    assert df.selectExpr("count(*)", "sum(cast(k as bigint))").first() == (n, n * (n - 1) // 2)
