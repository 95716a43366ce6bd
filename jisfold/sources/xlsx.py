"""A Spark data source for XLSX workbooks.

``spark.dataSource.register(XlsxDataSource)``, then
``spark.read.format("xlsx").option("sheet", 1).load(path)`` gives a row for
each sheet row: its number and its cells as strings.  A partition is a file.
Shared, rich and inline strings, cached values of formulas, and missing cells
are read; phonetic guides are left out.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, row_no int, cells array<string>"


def column_number(letters: str) -> int:
    """A is 1, Z 26, AA 27.

    >>> column_number("AA")
    27
    """
    n = 0
    for c in letters.upper():
        if not "A" <= c <= "Z":
            raise ValueError(f"not a column: {letters!r}")
        n = n * 26 + ord(c) - 64
    return n


def cell_reference(text: str) -> tuple[int, int]:
    """(column, row) of "B3"."""
    found = re.fullmatch(r"([A-Za-z]+)([0-9]+)", text)
    if not found:
        raise ValueError(f"not a cell: {text!r}")
    return column_number(found[1]), int(found[2])


def cell_range(text: str) -> tuple[tuple[int, int], tuple[int, int]]:
    """The corners of "A1:C9"; a single cell is its own range."""
    first, _, last = text.partition(":")
    return cell_reference(first), cell_reference(last or first)


def row_span(text: str) -> tuple[int, int]:
    """(first, last) of a row's "1:17"."""
    first, _, last = text.partition(":")
    return int(first), int(last)


def _name(element) -> str:
    return element.tag.rpartition("}")[2]


def _text(element) -> str:
    """The text of a string item: its own and its runs', without phonetic guides."""
    out = []
    for child in element:
        if _name(child) == "t":
            out.append(child.text or "")
        elif _name(child) == "r":
            out += [t.text or "" for t in child if _name(t) == "t"]
    return "".join(out)


def read_rows(file, sheet: int = 1) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells) of a sheet, as they are parsed."""
    with zipfile.ZipFile(file) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as f:
                for _, element in ElementTree.iterparse(f):
                    if _name(element) == "si":
                        shared.append(_text(element))
                        element.clear()
        width = row_no = 0
        with book.open(f"xl/worksheets/sheet{sheet}.xml") as f:
            for _, element in ElementTree.iterparse(f):
                if _name(element) == "dimension":
                    width = cell_range(element.get("ref", "A1"))[1][0]
                elif _name(element) == "row":
                    row_no = int(element.get("r", row_no + 1))
                    cells: list[str | None] = []
                    for cell in element:
                        at = cell_reference(cell.get("r"))[0] if cell.get("r") else len(cells) + 1
                        cells += [None] * (at - 1 - len(cells))
                        cells.append(_value(cell, shared))
                    end = max(width, row_span(element.get("spans"))[1] if element.get("spans") else 0)
                    yield row_no, cells + [None] * (end - len(cells))
                    element.clear()


def _value(cell, shared: list[str]) -> str | None:
    parts = {_name(x): x for x in cell}
    if "is" in parts:
        return _text(parts["is"])
    value = parts["v"].text if "v" in parts else None
    if value is None:
        return parts["f"].text if "f" in parts else None
    return shared[int(value)] if cell.get("t") == "s" else value


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class XlsxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.sheet = options["path"], int(options.get("sheet", 1))

    def partitions(self) -> list[_File]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(base)
        if info.type == fs.FileType.File:
            return [_File(self.path)]
        if info.type != fs.FileType.Directory:
            raise FileNotFoundError(self.path)
        names = [x.base_name for x in system.get_file_info(fs.FileSelector(base)) if x.base_name.lower().endswith(".xlsx")]
        return [_File(f"{self.path.rstrip('/')}/{n}") for n in sorted(names)]

    def read(self, partition: _File) -> Iterator[tuple]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(partition.path)
        with system.open_input_file(base) as f:
            for row_no, cells in read_rows(f, self.sheet):
                yield partition.path, row_no, cells


class XlsxDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> XlsxReader:
        return XlsxReader(dict(self.options))
