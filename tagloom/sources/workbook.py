"""Reading XLSX workbooks with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Fixed value: built-in number formats that show dates.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None


def _parts(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, file) of each sheet."""
    rels = {r.get("Id"): r.get("Target") for r in _xml(z, "xl/_rels/workbook.xml.rels")}
    path = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
    return [(s.get("name"), path(rels[s.get(_REL)])) for s in _xml(z, "xl/workbook.xml").iterfind("m:sheets/m:sheet", _NS)]


def sheets(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [name for name, _ in _parts(z)]


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iterfind(".//m:t", _NS))


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Cell styles that show dates."""
    root = _xml(z, "xl/styles.xml")
    if root is None:
        return set()
    own = {int(f.get("numFmtId")) for f in root.iterfind("m:numFmts/m:numFmt", _NS) if re.search(r"[dmy]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
    return {i for i, x in enumerate(root.iterfind("m:cellXfs/m:xf", _NS)) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _value(cell: ElementTree.Element, strings: list[str], dates: set[int], epoch: datetime) -> object:
    kind, v = cell.get("t", "n"), cell.find("m:v", _NS)
    if kind == "inlineStr":
        return _text(cell)
    if v is None or v.text is None:
        return ""
    if kind == "s":
        return strings[int(v.text)]
    if kind in ("str", "e", "d"):
        return v.text[:10] if kind == "d" else v.text
    if kind == "b":
        return int(v.text)
    n = float(v.text)
    if int(cell.get("s", 0)) in dates:
        return (epoch + timedelta(days=n)).strftime("%Y-%m-%d")
    return int(n) if n == int(n) else n


def read_sheet(content: bytes, index: int = 0, expand_merged: bool = False) -> list[list[object]]:
    """Rows of a sheet: whole numbers as int, dates as ISO text, truth values as 0 or 1. expand_merged repeats a merged cell's value in all its places."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = _parts(z)
        if not 0 <= index < len(parts):
            raise IndexError(f"no sheet {index}; the workbook has {len(parts)}")
        shared = _xml(z, "xl/sharedStrings.xml")
        strings = [] if shared is None else [_text(s) for s in shared.iterfind("m:si", _NS)]
        dates, book = _date_styles(z), _xml(z, "xl/workbook.xml")
        properties = book.find("m:workbookPr", _NS)
        epoch = datetime(1904, 1, 1) if properties is not None and properties.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        root = _xml(z, parts[index][1])
        rows: list[list[object]] = []
        for row in root.iterfind("m:sheetData/m:row", _NS):
            at = int(row.get("r", len(rows) + 1)) - 1
            rows += [[] for _ in range(at + 1 - len(rows))]
            for cell in row.iterfind("m:c", _NS):
                place = _column(cell.get("r")) if cell.get("r") else len(rows[at])
                rows[at] += [""] * (place + 1 - len(rows[at]))
                rows[at][place] = _value(cell, strings, dates, epoch)
        if expand_merged:
            for merged in root.iterfind("m:mergeCells/m:mergeCell", _NS):
                _spread(rows, merged.get("ref"))
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def _spread(rows: list[list[object]], ref: str) -> None:
    first, _, last = ref.partition(":")
    (top, left), (bottom, right) = ((int(re.search(r"\d+", x)[0]) - 1, _column(x)) for x in (first, last or first))
    rows += [[] for _ in range(bottom + 1 - len(rows))]
    value = rows[top][left] if left < len(rows[top]) else ""
    for r in range(top, bottom + 1):
        rows[r] += [""] * (right + 1 - len(rows[r]))
        rows[r][left : right + 1] = [value] * (right + 1 - left)
