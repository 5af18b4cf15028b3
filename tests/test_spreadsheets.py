"""Spreadsheet statements: written by hand, read by Spark."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

import oracle_check
from ledgerlake.sources import spreadsheets, statements
from ledgerlake.workload import views as V
from ledgerlake.workload.oracle import ORACLE
from ledgerlake.workload.queries import QUERIES

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
PREFIXED = MAIN.replace("xmlns=", "xmlns:x=")
IDS = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
STYLES = (
    f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="164" formatCode="[Red]&quot;day&quot; 0.00"/>'
    '<numFmt numFmtId="165" formatCode="d\\-mmm\\-yy"/></numFmts>'
    '<cellStyleXfs><xf numFmtId="14"/></cellStyleXfs>'
    '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>'
)


def workbook(sheet, strings=None, styles=STYLES, target="worksheets/sheet1.xml", epoch=""):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} {IDS}>{epoch}<sheets><sheet name="first" r:id="rId9"/>'
                   '<sheet name="other" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships><Relationship Id="rId1" Target="worksheets/no.xml"/>'
                   f'<Relationship Id="rId9" Target="{target}"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/worksheets/no.xml", f"<worksheet {MAIN}><sheetData/></worksheet>")
        if styles:
            z.writestr("xl/styles.xml", styles)
        if strings:
            z.writestr("xl/sharedStrings.xml", strings)
    return data.getvalue()


def rows(*lines):
    return f"<worksheet {MAIN}><sheetData>{''.join(lines)}</sheetData></worksheet>"


def line(*cells, r=None):
    at = f' r="{r}"' if r else ""
    return f"<row{at}>{''.join(cells)}</row>"


def text(value, r=None):
    at = f' r="{r}"' if r else ""
    return f'<c{at} t="inlineStr"><is><t>{value}</t></is></c>'


def value(v, r=None, s=None, t=None):
    given = "".join(f' {k}="{x}"' for k, x in (("r", r), ("s", s), ("t", t)) if x is not None)
    return f"<c{given}><v>{v}</v></c>"


HEAD = line(text("Date"), text("Description"), text("Debit"), text("user_id"))


def frame(spark, *contents):
    return spark.createDataFrame([(f"/in/f{i}.xlsx", c) for i, c in enumerate(contents)], "path string, content binary")


def debits(spark, *contents):
    got = statements.normalise_spreadsheets(frame(spark, *contents)).collect()
    return sorted((r.user_id, float(r.amount), r.receiver, r.timestamp) for r in got)


def test_cells_of_all_kinds(spark):
    strings = (
        f'<sst {MAIN}><si><t>Lotus Tea</t></si><si><r><rPr><b/></rPr><t xml:space="preserve">Two </t></r>'
        '<r><t>Runs &amp; more</t></r><rPh sb="0" eb="1"><t>sound</t></rPh></si><si/></sst>'
    )
    sheet = rows(
        line(value(" ", t="str"), r=1),
        HEAD.replace("<row>", '<row r="4">'),
        line(value(45292, s=1), value(0, t="s"), value("1200.5"), text("u"), r=5),
        line(value("45292.75", s=3), value(1, t="s"), value("1.25E3", s=2), text("u"), r=6),
        line(value("2024-01-03", t="str"), value(2, t="s"), text("Rs 1,000.25"), text("u"), r=7),
        line(text("4 Jan 2024"), value(77), value(5, s=0), text("u"), r=8),
        line(value(45296, s=0), text("no date style"), value(6), text("u"), r=9),
        line(value(45296, s=1), text("error"), value("#N/A", t="e"), text("u"), r=10),
        line(value("2024-01-06T10:00:00", t="d"), value(1, t="b"), value("7", t="str"), text("u"), r=11),
    )
    assert debits(spark, workbook(sheet, strings)) == [
        ("u", 5.0, "77", dt.datetime(2024, 1, 4)),
        ("u", 7.0, "True", dt.datetime(2024, 1, 6, 10)),
        ("u", 1000.25, "UNKNOWN", dt.datetime(2024, 1, 3)),
        ("u", 1200.5, "Lotus Tea", dt.datetime(2024, 1, 1)),
        ("u", 1250.0, "Two Runs & more", dt.datetime(2024, 1, 1, 18)),
    ]


def test_layouts_places_epochs_and_prefixes(spark):
    sheet = rows(
        line(text("user_id", "B3"), text("Withdrawal Amt", "D3"), text(" Value Date ", "AA3"), r=3),
        line(text("a", "B7"), value(10, "D7"), value(0, "AA7", 1), r=7),
        line(value(11, "D9"), value(43831, "AA9", 1), r=9),
    )
    early = rows(HEAD, *[line(value(n, s=1), text(f"day {n}"), value(1), text("b")) for n in (59, 60, 61)])
    prefixed = rows(HEAD, line(value(45292, s=1), text("x"), value(3), text("c")))
    prefixed = prefixed.replace("</", "</x:").replace("<", "<x:").replace("<x:/x:", "</x:").replace(MAIN, PREFIXED)
    lines = statements.normalise_spreadsheets(frame(
        spark, workbook(sheet, epoch='<workbookPr date1904="1"/>', target="/xl/worksheets/sheet1.xml"),
        workbook(early), workbook(prefixed))).collect()
    got = sorted((r.user_id or "", float(r.amount), r.receiver, r.timestamp) for r in lines)
    assert got == [
        ("", 11.0, "UNKNOWN", dt.datetime(2024, 1, 2)),
        ("a", 10.0, "UNKNOWN", dt.datetime(1904, 1, 1)),
        ("b", 1.0, "day 59", dt.datetime(1900, 2, 28)),
        ("b", 1.0, "day 61", dt.datetime(1900, 3, 1)),
        ("c", 3.0, "x", dt.datetime(2024, 1, 1)),
    ]


def test_files_that_cannot_be_read(spark):
    good = workbook(rows(HEAD, line(value(45292, s=1), text("x"), value(3), text("c"))), styles=STYLES)
    cut = workbook(rows(HEAD, line(value(45292, s=1), text("x"), value(3), text("c")))[:-30])
    files = frame(spark, good, b"not a zip", b"", good[:200], workbook(rows()), cut,
                  workbook(rows(line(text("Date"), text("Balance")), line(text("1/1/2024"), value(1)))))
    lines, rejected = spreadsheets.read_spreadsheets(files)
    assert {r.file for r in lines.collect()} == {"/in/f0.xlsx"}
    assert {(r.file[-6], r.reason) for r in rejected.collect()} == {
        ("1", "unreadable"), ("2", "unreadable"), ("3", "unreadable"), ("4", "empty"), ("5", "unreadable"), ("6", "no_columns"),
    }
    lines, rejected = spreadsheets.read_spreadsheets(files.limit(0))
    assert lines.count() == rejected.count() == 0


def test_same_statement_as_text_and_as_sheet(spark, tmp_path):
    (tmp_path / "user_id=7").mkdir()
    (tmp_path / "user_id=7" / "a.csv").write_text("Date,Description,Debit\n01/01/2024,Lotus Tea,\"1,200.50\"\n02/01/2024,,7\n")
    sheet = rows(
        line(text("Date"), text("Description"), text("Debit")),
        line(value(45292, s=1), text("Lotus Tea"), value("1200.5")), line(value(45293, s=1), "<c/>", value(7)),
    )
    (tmp_path / "user_id=7" / "b.XLSX".lower()).write_bytes(workbook(sheet))
    got = statements.normalise_files(spark, str(tmp_path)).select("user_id", "amount", "receiver", "raw_text", "timestamp")
    pairs = got.groupBy(*got.columns).agg(F.count("*").alias("n")).collect()
    assert len(pairs) == 2 and {(r.user_id, r.n) for r in pairs} == {("7", 2)}


def test_only_sheets_in_a_folder(spark, tmp_path):
    sheet = rows(HEAD, line(value(45292, s=1), text("x"), value(3), text("c")))
    (tmp_path / "a.xlsx").write_bytes(workbook(sheet))
    assert [r.user_id for r in statements.normalise_files(spark, str(tmp_path)).collect()] == ["c"]


@pytest.mark.parametrize("name", ["statement_sheets", "statement_files"])
def test_query(spark, name):
    tables = "/root/testdata/sf0.001"
    assert oracle_check.differences(QUERIES[name](spark, tables), oracle_check.connect(tables), ORACLE[name]) == []


def test_workbooks_are_written_where_their_lines_were_gathered(spark, tmp_path):
    """Lines are not taken apart again, each with all texts of its file, and gathered a second time."""
    rows = [(i, i % 3, "O", 10.0 + i, dt.datetime(1995, 1, 1 + i % 28), "1") for i in range(1, 40)]
    names = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "orders.parquet"))
    made = V.workbooks(spark, str(tmp_path), size=20)
    assert made.count() == 2
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("collect_list") == 1
