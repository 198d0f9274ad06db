"""Workbooks in the public Office Open XML layout: cells, merged ranges and hidden rows or columns, read as a stream; and a
minimal writer."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from datetime import date, datetime, timedelta
from typing import Any
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from ..errors import FormatError
from ..functions.refs import column_index_to_letter, column_letter_to_index, parse_range

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
EPOCH, EPOCH_1904 = datetime(1899, 12, 30), datetime(1904, 1, 1)
# --- fixed values: formats that every workbook knows by number ---
BUILT_IN = {0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@"}
# --- end of fixed values ---


def is_date_format(code: str) -> bool:
    """Whether a number format shows dates or times."""
    plain = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code)
    return bool(re.search(r"[ymdhs]", plain, re.I)) and "General" not in code


class Workbook:
    """The parts of a workbook's zip file that readers need."""

    def __init__(self, data: bytes, name: str | None = None):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
            root = ET.fromstring(self.zip.read("xl/workbook.xml"))
            rels = ET.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))
        except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
            raise FormatError(f"Not a readable workbook: {e}", file_path=name) from e
        target = {r.get("Id"): r.get("Target") for r in rels}
        part = lambda t: t.lstrip("/") if t.startswith("/") else "xl/" + t
        self.sheets = [(s.get("name"), part(target[s.get(_REL + "id")])) for s in root.iter(_MAIN + "sheet") if s.get(_REL + "id") in target]
        self.sheets = [(n, p) for n, p in self.sheets if "worksheets" in p]
        props = root.find(_MAIN + "workbookPr")
        self.epoch = EPOCH_1904 if props is not None and props.get("date1904") in ("1", "true") else EPOCH
        self.strings = self._strings()
        self.formats = self._formats()

    def _strings(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.zip.namelist():
            return []
        out = []
        for _, item in ET.iterparse(self.zip.open("xl/sharedStrings.xml")):
            if item.tag == _MAIN + "si":
                out.append(_shown(item))
                item.clear()
        return out

    def _formats(self) -> list[str]:
        if "xl/styles.xml" not in self.zip.namelist():
            return []
        root = ET.fromstring(self.zip.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")): f.get("formatCode") for f in root.iter(_MAIN + "numFmt")}
        cells = root.find(_MAIN + "cellXfs")
        ids = [int(x.get("numFmtId", 0)) for x in cells] if cells is not None else []
        return [own.get(i, BUILT_IN.get(i, "General")) for i in ids]

    def cells(self, part: str, r1: int = 1, r2: int | None = None) -> Iterator[tuple]:
        """(row, col, ctype, s, n, b, ts, formula, number_format) of the rows from r1 to r2, in order; the sheet is streamed."""
        row = col = 0
        masters: dict[str, tuple[int, int, str]] = {}
        try:
            for event, e in ET.iterparse(self.zip.open(part), ("start", "end")):
                if event == "start":
                    if e.tag == _MAIN + "row":
                        row, col = int(e.get("r") or row + 1), 0
                        if r2 is not None and row > r2:
                            return
                    continue
                if e.tag == _MAIN + "c":
                    ref = re.match(r"([A-Z]+)(\d+)$", e.get("r") or "")
                    col = column_letter_to_index(ref[1]) if ref else col + 1
                    got = self._cell(e, row, col, masters)
                    if got and row >= r1:
                        yield (row, col, *got)
                elif e.tag == _MAIN + "row":
                    e.clear()
        except ET.ParseError as err:
            raise FormatError(f"Damaged sheet: {err}", part=part) from err

    def _cell(self, e: ET.Element, row: int, col: int, masters: dict) -> tuple | None:
        kind, v, f = e.get("t", "n"), e.find(_MAIN + "v"), e.find(_MAIN + "f")
        style = int(e.get("s") or 0)
        code = self.formats[style] if style < len(self.formats) else "General"
        formula = None
        if f is not None:
            formula = f.text
            if f.get("t") == "shared":
                if formula:
                    masters[f.get("si")] = (row, col, formula)
                elif f.get("si") in masters:
                    formula = shifted(*masters[f.get("si")], row, col)
        text = v.text if v is not None else None
        if kind == "inlineStr":
            text = _shown(e.find(_MAIN + "is")) if e.find(_MAIN + "is") is not None else None
        if text is None:
            return (None, None, None, None, None, formula, code) if formula is not None else None
        if kind == "s":
            return "s", self.strings[int(text)], None, None, None, formula, code
        if kind in ("str", "inlineStr"):
            return "s", text, None, None, None, formula, code
        if kind == "b":
            return "b", None, None, text.strip() in ("1", "true"), None, formula, code
        if kind == "e":
            return "e", text, None, None, None, formula, code
        if kind == "d":
            return "d", None, None, None, datetime.fromisoformat(text.rstrip("Z")), formula, code
        n = float(text)
        if is_date_format(code) and 0 <= n < 2_958_466:
            return "d", None, None, None, self.epoch + timedelta(seconds=round(n * 86400, 3)), formula, code
        return "n", None, n, None, None, formula, code

    def layout(self, part: str) -> tuple[list[tuple[int, int, int, int]], list[int], list[int]]:
        """Merged ranges (r1, c1, r2, c2), hidden rows and hidden columns."""
        merged, rows, cols, row = [], [], [], 0
        for event, e in ET.iterparse(self.zip.open(part), ("start", "end")):
            if event == "start":
                if e.tag == _MAIN + "row":
                    row = int(e.get("r") or row + 1)
                    if e.get("hidden") in ("1", "true"):
                        rows.append(row)
            elif e.tag == _MAIN + "mergeCell":
                _, r1, c1, r2, c2 = parse_range(e.get("ref"))
                merged.append((r1, c1, r2, c2))
            elif e.tag == _MAIN + "col" and e.get("hidden") in ("1", "true"):
                cols += range(int(e.get("min")), int(e.get("max")) + 1)
            elif e.tag == _MAIN + "row":
                e.clear()
        return merged, rows, cols


def _shown(item: ET.Element) -> str:
    """The text of a string item, without phonetic guides."""
    out = []
    for child in item:
        if child.tag == _MAIN + "t":
            out.append(child.text or "")
        elif child.tag == _MAIN + "r":
            out += [t.text or "" for t in child.iter(_MAIN + "t")]
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), "".join(out))


def shifted(row: int, col: int, formula: str, to_row: int, to_col: int) -> str:
    """A shared formula as it reads in another cell: relative addresses move along."""

    def move(m: re.Match) -> str:
        c = m[2] if m[1] else column_index_to_letter(column_letter_to_index(m[2]) + to_col - col)
        r = m[4] if m[3] else str(int(m[4]) + to_row - row)
        return f"{m[1]}{c}{m[3]}{r}"

    parts = re.split(r'("[^"]*")', formula)
    return "".join(p if p.startswith('"') else re.sub(r"(?<![A-Za-z0-9_.])(\$?)([A-Z]{1,3})(\$?)(\d+)(?![A-Za-z0-9_(])", move, p) for p in parts)


def write_workbook(sheets: dict[str, Iterable[Iterable[Any]]], merges: dict[str, list[str]] | None = None, hidden_rows: dict[str, list[int]] | None = None, hidden_cols: dict[str, list[int]] | None = None, formulas: dict[str, dict[str, Any]] | None = None, formats: dict[str, dict[str, str]] | None = None) -> bytes:
    """A workbook of plain values: None leaves a cell out, a text that begins with = is a formula.

    merges: ranges; formulas: the cached values of formula cells by address; formats: number formats by address."""
    codes = sorted({c for f in (formats or {}).values() for c in f.values()})
    style = {c: i + 2 for i, c in enumerate(codes)}
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        overrides = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{overrides}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook {ns} xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}<Relationship Id="rIdS" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        own = "".join(f'<numFmt numFmtId="{164 + i}" formatCode={quoteattr(c)}/>' for i, c in enumerate(codes))
        xfs = '<xf numFmtId="0"/><xf numFmtId="22"/>' + "".join(f'<xf numFmtId="{164 + i}"/>' for i in range(len(codes)))
        z.writestr("xl/styles.xml", f'{head}<styleSheet {ns}><numFmts count="{len(codes)}">{own}</numFmts><cellXfs count="{2 + len(codes)}">{xfs}</cellXfs></styleSheet>')
        for i, (name, rows) in enumerate(sheets.items(), 1):
            cols = "".join(f'<col min="{c}" max="{c}" hidden="1"/>' for c in (hidden_cols or {}).get(name, []))
            body = []
            gone = set((hidden_rows or {}).get(name, []))
            for r, row in enumerate(rows, 1):
                cells = "".join(_written(f"{column_index_to_letter(c)}{r}", v, (formulas or {}).get(name, {}), style, (formats or {}).get(name, {})) for c, v in enumerate(row, 1) if v is not None)
                if cells or r in gone:
                    body.append(f'<row r="{r}"{" hidden=" + chr(34) + "1" + chr(34) if r in gone else ""}>{cells}</row>')
            ranges = (merges or {}).get(name, [])
            merged = f'<mergeCells count="{len(ranges)}">{"".join(f"<mergeCell ref={quoteattr(x)}/>" for x in ranges)}</mergeCells>' if ranges else ""
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"{head}<worksheet {ns}>{f'<cols>{cols}</cols>' if cols else ''}<sheetData>{''.join(body)}</sheetData>{merged}</worksheet>")
    return out.getvalue()


def _written(ref: str, v: Any, cached: dict[str, Any], style: dict[str, int], formats: dict[str, str]) -> str:
    s = f' s="{style[formats[ref]]}"' if ref in formats else ""
    if isinstance(v, str) and v.startswith("="):
        got = cached.get(ref)
        kind = ' t="str"' if isinstance(got, str) else ""
        return f'<c r="{ref}"{s}{kind}><f>{escape(v[1:])}</f>{"" if got is None else f"<v>{escape(str(got))}</v>"}</c>'
    if isinstance(v, bool):
        return f'<c r="{ref}"{s} t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"{s}><v>{v!r}</v></c>'
    if isinstance(v, (date, datetime)):
        at = v if isinstance(v, datetime) else datetime(v.year, v.month, v.day)
        return f'<c r="{ref}" s="1"><v>{(at - EPOCH).total_seconds() / 86400!r}</v></c>'
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", lambda m: f"_x{ord(m[0]):04X}_", str(v))
    if re.fullmatch(r"#[A-Z/0!?_]+[!?A0]?", text) and text in ("#DIV/0!", "#N/A", "#NAME?", "#NULL!", "#NUM!", "#REF!", "#VALUE!"):
        return f'<c r="{ref}"{s} t="e"><v>{text}</v></c>'
    return f'<c r="{ref}"{s} t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'
