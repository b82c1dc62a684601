"""Workbooks as a Python data source: spark.read.format('xlsx').load(path). Only zipfile and the XML parser are used.

The first sheet is read as text cells; numbers stay numbers as typed (dates as serials). Each file is one partition, so
a folder of workbooks is read by as many tasks as it has files.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rollcall.sources.grid import MAX_BYTES

SCHEMA = "path string, row_number int, cells array<string>"
#: Unpacked bytes a workbook part may have, against archives that unpack to far more than they show.
MAX_PART = 512 << 20


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _part(book: zipfile.ZipFile, name: str) -> bytes | None:
    if name not in book.namelist():
        return None
    if book.getinfo(name).file_size > MAX_PART:
        raise ValueError(f"{name} is too large")
    return book.read(name)


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")


def number_text(value: str) -> str:
    """A stored number as text, whole ones without a point."""
    try:
        x = float(value)
    except ValueError:
        return value
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def first_sheet(data: bytes) -> Iterator[tuple[int, list[str]]]:
    """(line, cells) of the rows of a workbook's first sheet."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared = _part(book, "xl/sharedStrings.xml")
        strings = [_text(s) for s in ElementTree.fromstring(shared) if _local(s.tag) == "si"] if shared else []
        workbook = ElementTree.fromstring(_part(book, "xl/workbook.xml") or b"<workbook/>")
        sheet = next((s for s in workbook.iter() if _local(s.tag) == "sheet"), None)
        target = "worksheets/sheet1.xml"
        relations = _part(book, "xl/_rels/workbook.xml.rels")
        if sheet is not None and relations:
            wanted = next((v for k, v in sheet.attrib.items() if _local(k) == "id"), None)
            target = next((r.attrib["Target"] for r in ElementTree.fromstring(relations) if r.attrib.get("Id") == wanted), target)
        name = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
        content = _part(book, name)
        if content is None:
            return
        line = 0
        for _, row in ElementTree.iterparse(io.BytesIO(content)):
            if _local(row.tag) != "row":
                continue
            line = int(row.attrib.get("r", line + 1))
            cells: list[str] = []
            for c in row:
                at = _column(c.attrib["r"]) if "r" in c.attrib else len(cells)
                cells += [""] * (at + 1 - len(cells))
                value = next((x.text or "" for x in c if _local(x.tag) == "v"), "")
                kind = c.attrib.get("t", "n")
                if kind == "s":
                    cells[at] = strings[int(value)] if value else ""
                elif kind == "inlineStr":
                    cells[at] = _text(c)
                elif kind == "b":
                    cells[at] = "true" if value == "1" else "false"
                else:
                    cells[at] = number_text(value) if kind == "n" and value else value
            yield line, cells
            row.clear()


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], limit: int):
        self.paths, self.limit = paths, limit

    def partitions(self) -> list[_File]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple[str, int, list[str]]]:
        with open(partition.path, "rb") as f:
            data = f.read(self.limit + 1)
        if len(data) > self.limit:
            raise ValueError(f"{partition.path} is larger than {self.limit} bytes")
        for line, cells in first_sheet(data):
            yield partition.path, line, cells


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:  # noqa: ANN001 - the signature is Spark's
        from glob import glob

        paths = sorted(p for part in self.options["path"].split(",") for p in glob(part.removeprefix("file:")))
        return _Reader(paths, int(self.options.get("maxBytes", MAX_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxSource)
