"""Sheets of .xlsx workbooks as rows of text, with the standard library alone.

A workbook is a zip of XML files: one names the sheets, one holds the shared strings, one the number formats, and one for
each sheet the cells. Sheets are read as a stream, row by row. A cell's text is that of its value: numbers without a
needless fraction, dates and times (by their format) in ISO form, true and false as TRUE and FALSE; an empty cell is None.
"""

from __future__ import annotations

import datetime as dt
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree as ET

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# The numbers of built-in formats that show a date or a time.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_EPOCH = dt.datetime(1899, 12, 30)


def _text(node: ET.Element) -> str:
    """The text of a string, its formatted runs put together; phonetic hints are left out."""
    return "".join(t.text or "" for r in node for t in ([r] if r.tag == f"{MAIN}t" else r.iter(f"{MAIN}t") if r.tag == f"{MAIN}r" else []))


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return [_text(item) for item in ET.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a date or a time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", "")) for f in root.iter(f"{MAIN}numFmt")}
    dated = DATE_FORMATS | {k for k, code in own.items() if re.search("[ymdhs]", code, re.I)}
    cells = root.find(f"{MAIN}cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else []) if int(x.get("numFmtId", 0)) in dated}


def sheets(path: str | Path) -> dict[str, str]:
    """Names of the sheets in order, and the files within the workbook that hold them."""
    with zipfile.ZipFile(path) as book:
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        listed = ET.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
        return {s.get("name"): (t[1:] if t.startswith("/") else f"xl/{t}") for s in listed for t in [targets[s.get(LINK)]]}


def _number(text: str, dated: bool) -> str:
    value = float(text)
    if not dated:
        return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)
    when = _EPOCH + dt.timedelta(seconds=round(value * 86_400))
    return when.strftime("%Y-%m-%d %H:%M:%S") if value >= 1 else when.strftime("%H:%M:%S")


def _column(reference: str) -> int:
    n = 0
    for c in reference.rstrip("0123456789"):
        n = n * 26 + ord(c) - 64
    return n - 1


def rows(path: str | Path, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows of a sheet (the first by default), each as long as its last filled cell needs."""
    found = sheets(path)
    if sheet is not None and sheet not in found:
        raise ValueError(f"no sheet {sheet!r}; there are {list(found)}")
    with zipfile.ZipFile(path) as book:
        shared, dated = _shared(book), _date_styles(book)
        with book.open(found[sheet] if sheet is not None else next(iter(found.values()))) as f:
            for _, node in ET.iterparse(f):
                if node.tag != f"{MAIN}row":
                    continue
                row: list[str | None] = []
                for cell in node.iter(f"{MAIN}c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(row)
                    row += [None] * (at + 1 - len(row))
                    kind, value = cell.get("t", "n"), cell.find(f"{MAIN}v")
                    inline = cell.find(f"{MAIN}is")
                    if inline is not None:
                        row[at] = _text(inline)
                    elif value is not None and value.text is not None:
                        known = {"s": lambda v: shared[int(v)], "b": lambda v: "TRUE" if v == "1" else "FALSE", "n": lambda v, c=cell: _number(v, int(c.get("s", 0)) in dated)}
                        row[at] = known.get(kind, str)(value.text)
                yield row
                node.clear()
