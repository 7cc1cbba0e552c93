"""The first sheet of a workbook (Office Open XML), with the standard library alone."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

Cell = str | float | bool | None


def _text(element: ElementTree.Element) -> str:
    """The text of a string item: its own, or that of its runs; what is said for reading aloud is left out."""
    runs = [*element.findall(f"{_MAIN}t"), *(t for r in element.findall(f"{_MAIN}r") for t in r.findall(f"{_MAIN}t"))]
    said = "".join(t.text or "" for t in runs)
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), said)


def _column(reference: str) -> int:
    """Column number from 0 of a cell reference such as AB12."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _value(cell: ElementTree.Element, shared: list[str]) -> Cell:
    kind, held = cell.get("t", "n"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        inner = cell.find(f"{_MAIN}is")
        return _text(inner) if inner is not None else None
    if held is None or held.text is None:
        return None
    if kind == "s":
        return shared[int(held.text)]
    if kind in ("str", "d"):
        return held.text
    if kind == "b":
        return held.text == "1"
    return None if kind == "e" else float(held.text)  # an error value is no value


def first_sheet(data: bytes) -> Iterator[list[Cell]]:
    """Rows of the first sheet from its first cell on: texts, numbers, truth values, and None for cells that are empty or hold an error."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = [_text(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        sheet = ElementTree.fromstring(z.read("xl/workbook.xml")).find(f"{_MAIN}sheets")[0].get(_RELATION)
        links = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next(x.get("Target") for x in links if x.get("Id") == sheet)
        with z.open(target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                out: list[Cell] = []
                for cell in row.findall(f"{_MAIN}c"):
                    at = _column(cell.get("r", "")) if cell.get("r") else len(out)
                    out += [None] * (at - len(out)) + [_value(cell, shared)]
                row.clear()
                yield out


def written(rows: list[list[Cell]]) -> bytes:
    """A workbook of one sheet with these rows; texts are written in their cells."""
    xml = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    links = "http://schemas.openxmlformats.org/package/2006/relationships"
    office = _RELATION[1:-3]

    def cell(value: Cell) -> str:
        if value is None:
            return "<c/>"
        if isinstance(value, bool):
            return f'<c t="b"><v>{int(value)}</v></c>'
        return f"<c><v>{value}</v></c>" if isinstance(value, int | float) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'

    sheet = "".join(f"<row>{''.join(map(cell, row))}</row>" for row in rows)
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{links}"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{office}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{links}"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{sheet}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, xml + text)
    return out.getvalue()
