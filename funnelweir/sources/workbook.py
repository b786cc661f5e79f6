"""Workbooks (xlsx) as a Spark source: one partition per sheet, XML read as a stream.

A sheet's first row with a value is its header; names are trimmed, and columns are matched
by name, so sheets may order them differently. Every column is a string as the file holds
it (dates are serial numbers); empty and error cells are null; rows without a value are
skipped. A task holds the workbook's shared strings and one batch of rows.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

# fixed values: name spaces of the format
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
BATCH_ROWS = 5000


def opened(path: str) -> zipfile.ZipFile:
    """The archive behind a path or URI, read by ranges."""
    system, name = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return zipfile.ZipFile(system.open_input_file(name))


def sheets_of(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheet names and the members that hold them, in the workbook's order."""
    links = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = ET.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
    member = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(f"xl/{t}")
    return {s.get("name"): member(links[s.get(RELATION)]) for s in found}


def text_of(node: ET.Element) -> str:
    """All text runs of a string, without phonetic hints."""
    hints = {id(t) for h in node.iter(f"{MAIN}rPh") for t in h.iter(f"{MAIN}t")}
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t") if id(t) not in hints)


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as stream:
        for _, node in ET.iterparse(stream):
            if node.tag == f"{MAIN}si":
                out.append(text_of(node))
                node.clear()
    return out


def column_number(reference: str) -> int:
    """0 for A, 25 for Z, 26 for AA, from a cell reference."""
    number = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        number = number * 26 + ord(letter) - 64
    return number - 1


def cell_value(cell: ET.Element, strings: Sequence[str]) -> str | None:
    kind, value = cell.get("t", "n"), cell.find(f"{MAIN}v")
    if kind == "inlineStr":
        return text_of(cell)
    if value is None or value.text is None or kind == "e":
        return None
    if kind == "s":
        return strings[int(value.text)]
    return {"0": "FALSE", "1": "TRUE"}[value.text] if kind == "b" else value.text


def rows_of(book: zipfile.ZipFile, member: str, strings: Sequence[str]) -> Iterator[dict[int, str]]:
    """Values by column number of each row that has one."""
    with book.open(member) as stream:
        for _, node in ET.iterparse(stream):
            if node.tag != f"{MAIN}row":
                continue
            row, at = {}, -1
            for cell in node.iter(f"{MAIN}c"):
                at = column_number(cell.get("r")) if cell.get("r") else at + 1
                value = cell_value(cell, strings)
                if value is not None and value != "":
                    row[at] = value
            node.clear()
            if row:
                yield row


def header_of(rows: Iterator[dict[int, str]]) -> dict[int, str]:
    return {k: name.strip() for k, name in next(rows, {}).items()}


class SheetPartition(InputPartition):
    def __init__(self, path: str, member: str):
        self.path, self.member = path, member


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: StructType, options: Mapping[str, str]):
        self.names = [f.name for f in schema]
        self.paths, self.sheets = json.loads(options["paths"]), json.loads(options.get("sheets", "null"))

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for path in self.paths:
            with opened(path) as book:
                out += [SheetPartition(path, m) for name, m in sheets_of(book).items() if self.sheets is None or name in self.sheets]
        return out

    def read(self, partition: SheetPartition) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string()) for n in self.names])
        with opened(partition.path) as book:
            rows = rows_of(book, partition.member, shared_strings(book))
            at = {name: k for k, name in reversed(header_of(rows).items())}  # of equal names the first column counts
            places = [at.get(n) for n in self.names]
            held: list[list[str | None]] = []
            for row in rows:
                held.append([None if k is None else row.get(k) for k in places])
                if len(held) == BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], schema=schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], schema=schema)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "funnelweir_workbook"

    def schema(self) -> StructType:
        """Trimmed header names of all sheets asked for, in order of appearance."""
        wanted, names = json.loads(self.options.get("sheets", "null")), {}
        for path in json.loads(self.options["paths"]):
            with opened(path) as book:
                strings = shared_strings(book)
                for sheet, member in sheets_of(book).items():
                    if wanted is None or sheet in wanted:
                        names |= dict.fromkeys(header_of(rows_of(book, member, strings)).values())
        return StructType([StructField(n, StringType()) for n in names if n])

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorkbookReader(schema, self.options)


def workbook_paths(spark: SparkSession, path: str) -> list[str]:
    """The workbooks of a file, folder or glob, listed by the Hadoop file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in system.globStatus(target) or []:
        inner = system.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [s.getPath().toString() for s in inner]
    return sorted(p for p in found if p.endswith(".xlsx") and not posixpath.basename(p).startswith("~$"))


def read_workbook(spark: SparkSession, path: str, sheets: Sequence[str] | None = None, renames: Mapping[str, str] | None = None) -> DataFrame:
    """Rows of the sheets (all by default) of one or many workbooks, as strings under trimmed names.

    Raises FileNotFoundError without a workbook, ValueError if no sheet has a header.
    """
    paths = workbook_paths(spark, path)
    if not paths:
        raise FileNotFoundError(f"no workbook at {path}")
    spark.dataSource.register(WorkbookSource)
    df = spark.read.format("funnelweir_workbook").option("paths", json.dumps(paths)).option("sheets", json.dumps(list(sheets) if sheets is not None else None)).load()
    if not df.columns:
        raise ValueError(f"no sheet with a header in {paths}")
    return df.withColumnsRenamed(dict(renames or {}))


# ---- writing


def _cell(value: object) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float):
        return f"<c><v>{value!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def workbook_bytes(sheets: Mapping[str, Sequence[Sequence[object]]]) -> bytes:
    """A workbook with the given rows (headers included) per sheet."""
    main, links = MAIN[1:-1], RELATION[1:-3]
    package = "http://schemas.openxmlformats.org/package/2006"
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    names = list(sheets)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kinds}.worksheet+xml"/>' for k in range(1, len(names) + 1))
        book.writestr(
            "[Content_Types].xml",
            f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/>{parts}</Types>',
        )
        book.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{links}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="s{k}"/>' for k, n in enumerate(names, 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{links}"><sheets>{listed}</sheets></workbook>')
        targets = "".join(f'<Relationship Id="s{k}" Type="{links}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">{targets}</Relationships>')
        for k, rows in enumerate(sheets.values(), 1):
            with book.open(f"xl/worksheets/sheet{k}.xml", "w") as stream:
                stream.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
                for row in rows:
                    stream.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
                stream.write(b"</sheetData></worksheet>")
    return out.getvalue()
