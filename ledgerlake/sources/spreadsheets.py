"""Bank statements as spreadsheets (xlsx).

A task unzips a file into the XML of its first sheet's rows, its shared texts
and its formats, some hundred elements a row. From there on it is Spark's work: the XML is
read by its own function, shared texts are joined in by file and number, serial
numbers become dates, and columns are found by the file's own header, so files of
any layout are one table and nothing of a file passes the driver.
"""

import io
import posixpath
import zipfile
import zlib
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.text import strip
from ledgerlake.sources.shared import materialise

PATTERN = "*.xls[xm]"
#: Rows or shared texts whose XML is read at once, and what leaves a task together.
TOGETHER, BATCH = 200, 50

# Built-in number formats that show a date or a time.
DATE_FORMATS = [*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)]
# Quoted, escaped and bracketed parts of a format, and what marks a date in the rest.
FORMAT_TEXT = r'"[^"]*"|\\.|\[[^\]]*\]|_.'
FORMAT_DATE = "(?i)[ymdhs]"

_PARTS = "file string, part string, at long, xml string"
_ROWS = (
    "row array<struct<_r: long, c: array<struct<_r: string, _s: int, _t: string, v: string, "
    "`is`: struct<t: string, r: array<struct<t: string>>>>>>>"
)
_TEXTS = "si array<struct<t: string, r: array<struct<t: string>>>>"
_XML = {"ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"}


def _local(name: str) -> str:
    return name.rpartition("}")[2]


def _elements(stream, names: set[str]):
    """The elements of some names, without namespaces, as the part is read; what
    was given is let go."""
    above = []
    for event, element in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            above.append(element)
            continue
        above.pop()
        if _local(element.tag) not in names:
            continue
        for e in element.iter():
            e.tag = _local(e.tag)
            e.attrib = {k: v for k, v in e.attrib.items() if "}" not in k}
        element.tail = None
        yield element
        if above:
            above[-1].clear()


def _together(elements):
    """Elements by the hundreds: how many there were before, and their XML."""
    held, before = [], 0
    for element in elements:
        held.append(ElementTree.tostring(element, encoding="unicode"))
        if len(held) == TOGETHER:
            yield before, f"<all>{''.join(held)}</all>"
            held, before = [], before + len(held)
    if held:
        yield before, f"<all>{''.join(held)}</all>"


def _numbered(rows):
    """Rows of a sheet, each with its number."""
    at = 0
    for row in rows:
        at = int(row.get("r", at + 1))
        row.set("r", str(at))
        yield row


def _target(base: str, target: str) -> str:
    """Name of the member that a part in ``base`` refers to."""
    return target[1:] if target.startswith("/") else posixpath.normpath(posixpath.join(base, target))


def _first_sheet(archive: zipfile.ZipFile) -> tuple[str, int]:
    """Member of the workbook's first sheet, and the year its days count from."""
    sheets, year = [], 1900
    with archive.open("xl/workbook.xml") as part:
        for _, e in ElementTree.iterparse(part):
            if _local(e.tag) == "sheet":
                sheets.append(next(v for k, v in e.attrib.items() if k.endswith("}id")))
            elif _local(e.tag) == "workbookPr" and e.attrib.get("date1904") in ("1", "true"):
                year = 1904
    with archive.open("xl/_rels/workbook.xml.rels") as part:
        targets = {e.get("Id"): e.get("Target") for e in _elements(part, {"Relationship"})}
    return _target("xl", targets[sheets[0]]), year


def _of_file(content: bytes):
    """``part``, ``at``, ``xml`` of one file; a file that can't be read ends
    with a part ``broken``."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            members = set(archive.namelist())
            sheet, year = _first_sheet(archive)
            yield "book", year, None
            if "xl/styles.xml" in members:
                with archive.open("xl/styles.xml") as part:
                    for e in _elements(part, {"numFmts", "cellXfs"}):
                        yield e.tag, 0, ElementTree.tostring(e, encoding="unicode")
            if "xl/sharedStrings.xml" in members:
                with archive.open("xl/sharedStrings.xml") as part:
                    for at, xml in _together(_elements(part, {"si"})):
                        yield "text", at, xml
            with archive.open(sheet) as part:
                for at, xml in _together(_numbered(_elements(part, {"row"}))):
                    yield "row", at, xml
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, StopIteration, ValueError, EOFError, NotImplementedError, RuntimeError, zlib.error) as error:
        yield "broken", 0, type(error).__name__


def _unzipped(batches):
    schema = pa.schema([("file", pa.string()), ("part", pa.string()), ("at", pa.int64()), ("xml", pa.string())])
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            rows = []
            for part, at, xml in _of_file(content.as_py() or b""):
                rows.append({"file": path.as_py(), "part": part, "at": at, "xml": xml})
                if len(rows) == BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Spreadsheet files under ``path``, with their bytes."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", PATTERN)
    return reader.option("recursiveFileLookup", True).load(path)


def unzip(files: DataFrame) -> DataFrame:
    """Elements of the files (``path``, ``content``): ``file``, ``part`` (row,
    text, numFmts, cellXfs, book, broken), ``at`` (elements before), ``xml``."""
    parts = files.select("path", "content").mapInArrow(_unzipped, _PARTS)
    return materialise(parts, "sheet-parts")


def _plain(text: Column) -> Column:
    """Text of a shared or inline string: one piece, or formatted pieces."""
    pieces = F.array_join(F.transform(text["r"], lambda r: F.coalesce(r["t"], F.lit(""))), "")
    return F.concat(F.coalesce(text["t"], F.lit("")), F.coalesce(pieces, F.lit("")))


def _formats(parts: DataFrame) -> DataFrame:
    """``file``, ``year`` and for each cell style whether it shows a date."""
    of = lambda part, value: F.max(F.when(F.col("part") == part, F.col(value)))
    each = parts.where("part IN ('book', 'numFmts', 'cellXfs')").groupBy("file").agg(
        of("book", "at").alias("year"), of("numFmts", "xml").alias("custom"), of("cellXfs", "xml").alias("styles")
    )
    custom = F.from_xml("custom", "numFmt array<struct<_numFmtId: int, _formatCode: string>>", _XML)["numFmt"]
    shown = F.filter(custom, lambda f: F.regexp_replace(f["_formatCode"], FORMAT_TEXT, "").rlike(FORMAT_DATE))
    own = F.coalesce(F.transform(shown, lambda f: f["_numFmtId"]), F.array().cast("array<int>"))
    ids = F.from_xml("styles", "xf array<struct<_numFmtId: int>>", _XML)["xf"]
    dated = F.transform(
        ids, lambda x: x["_numFmtId"].isin(DATE_FORMATS) | F.coalesce(F.array_contains("own", x["_numFmtId"]), F.lit(False))
    )
    return each.withColumn("own", own).select("file", "year", dated.alias("dated"))


def _column_number(reference: Column) -> Column:
    """AB12 is column 28."""
    letters = F.regexp_extract_all(reference, F.lit("([A-Z])"), 1)
    return F.aggregate(letters, F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64)


def serial_date(serial: Column, year: Column) -> Column:
    """Wall-clock time of a serial number of days, to the second. The calendar
    from 1900 has a 29 February 1900, which is no day, so days before it count
    from one day later."""
    seconds = F.round(serial * 86400).cast("long")
    first = F.when(year == 1904, F.lit("1904-01-01")).when(serial < 60, F.lit("1899-12-31")).otherwise(F.lit("1899-12-30"))
    moment = F.timestamp_add("SECOND", seconds, first.cast("timestamp_ntz"))
    exists = (serial >= 0) & (serial < 2958466) & ((year == 1904) | (serial < 60) | (serial >= 61))
    return F.when(exists, moment)


def _number_text(number: Column) -> Column:
    """A number as it would be typed: no exponent, no trailing zeros."""
    exact = F.regexp_replace(number.try_cast("decimal(38,10)").cast("string"), r"\.?0+$", "")
    whole = number.try_cast("decimal(38,0)").cast("string")
    return F.when(number == F.floor(number), whole).otherwise(exact)


def cell_texts(parts: DataFrame) -> DataFrame:
    """``file``, ``at`` (row), ``cells``: column and text of every cell that is
    not blank, by column. Dates are written as yyyy-MM-dd HH:mm:ss, errors are blank."""
    rows = parts.where("part = 'row'").select("file", F.explode(F.from_xml("xml", _ROWS, _XML)["row"]).alias("x"))
    rows = rows.select("file", F.col("x._r").alias("at"), F.posexplode("x.c").alias("i", "c"))
    texts = parts.where("part = 'text'").select("file", "at", F.posexplode(F.from_xml("xml", _TEXTS, _XML)["si"]).alias("i", "x"))
    texts = texts.select("file", (F.col("at") + F.col("i")).alias("number"), _plain(F.col("x")).alias("shared"))
    kind = F.coalesce(F.col("c._t"), F.lit("n"))
    cells = rows.withColumn("number", F.when(kind == "s", F.col("c.v").try_cast("long")))
    cells = cells.join(texts, ["file", "number"], "left").join(_formats(parts), "file", "left")
    number = F.col("c.v").try_cast("double")
    dated = F.coalesce(F.get("dated", F.coalesce("c._s", F.lit(0))), F.lit(False))
    date = F.date_format(serial_date(number, F.col("year")), "yyyy-MM-dd HH:mm:ss")
    value = (
        F.when(kind == "s", F.col("shared"))
        .when(kind == "inlineStr", _plain(F.col("c")["is"]))
        .when(kind.isin("str", "d"), F.col("c.v"))
        .when(kind == "b", F.when(F.col("c.v") == "1", "True").otherwise("False"))
        .when(kind == "n", F.when(dated, date).otherwise(_number_text(number)))
    )
    place = F.coalesce(_column_number(F.col("c._r")), F.col("i") + 1)
    named = cells.select("file", "at", F.struct(place.alias("column"), "i", value.alias("text")).alias("cell"))
    filled = named.where(F.coalesce(strip(F.col("cell.text")), F.lit("")) != "")
    return filled.groupBy("file", "at").agg(F.sort_array(F.collect_list("cell")).alias("cells"))


def _headed(lines: DataFrame, user: str, keep: list[str]) -> DataFrame:
    """Per file its first line that is not blank (``head``), and the columns of
    each role: the first name that fits, as in ``statements.discover_columns``."""
    header = lines.groupBy("file").agg(F.min("at").alias("head"), F.min_by("cells", "at").alias("names"))

    def found(test) -> Column:
        return F.get(F.filter("names", lambda c: test(F.lower(strip(c["text"])))), 0)["column"]

    def role(*words: str):
        def test(name):
            fits = F.contains(name, F.lit(words[0]))
            for word in words[1:]:
                fits = fits | F.contains(name, F.lit(word))
            return fits & ~F.endswith(name, F.lit("_id"))

        return found(test)

    return header.select(
        "file", "head",
        role("date").alias("_date"), role("narration", "description").alias("_narration"),
        role("withdrawal", "debit").alias("_withdrawal"),
        *[found(lambda name, k=k: name == k.lower()).alias(f"_{k}") for k in [user, *keep]],
    )


def read_spreadsheets(files: DataFrame, user: str = "user_id", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Lines of the first sheets of ``files`` (``path``, ``content``), as
    ``normalise_statement`` takes them, and the files that can't be read.

    Lines: ``file``, ``line`` (row of the sheet), the owner (a column of the
    sheet, or a folder such as ``user_id=7``), Date, Narration, Withdrawal, and
    the columns named in ``keep``, all text. Files: ``file``, ``reason`` (unreadable,
    no_columns, empty). Only whole files are read: a broken one gives no lines.
    """
    parts = unzip(files)
    broken = parts.where("part = 'broken'").select("file").distinct()
    lines = materialise(cell_texts(parts.join(broken, "file", "left_anti")), "sheet-lines")
    header = _headed(lines, user, list(keep))
    both = "_date IS NOT NULL AND _withdrawal IS NOT NULL"

    def cell(column: str) -> Column:
        return F.get(F.filter("cells", lambda c: c["column"] == F.col(column)), 0)["text"]

    folder = F.nullif(F.regexp_extract("file", f"/{user}=([^/]+)/", 1), F.lit(""))
    table = lines.join(header.where(both), "file").where("at > head").select(
        "file", F.col("at").alias("line"), F.coalesce(cell(f"_{user}"), folder).alias(user),
        cell("_date").alias("Date"), cell("_narration").alias("Narration"), cell("_withdrawal").alias("Withdrawal"),
        *[cell(f"_{k}").alias(k) for k in keep],
    )
    known = parts.select("file").distinct().join(broken.withColumn("broken", F.lit(True)), "file", "left")
    known = known.join(header.select("file", F.expr(both).alias("fits")), "file", "left")
    reason = F.when(F.col("broken"), "unreadable").when(F.col("fits").isNull(), "empty").when(~F.col("fits"), "no_columns")
    return table, known.select("file", reason.alias("reason")).where("reason IS NOT NULL")
