"""Legacy workbooks (BIFF8 in an OLE2 container), by the public record layout: cells, merged ranges, hidden rows and columns."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import timedelta

from ..errors import FormatError
from ..functions.fixed import BIFF8_MAGIC, OLE_MAGIC
from .ooxml import BUILT_IN, EPOCH, EPOCH_1904, is_date_format

# --- fixed values: record numbers and error codes ---
BOF, EOF, CONTINUE, DATEMODE, FORMAT, XF, BOUNDSHEET, SST = 0x809, 0x0A, 0x3C, 0x22, 0x41E, 0xE0, 0x85, 0xFC
LABELSST, LABEL, NUMBER, RK, MULRK, BOOLERR, FORMULA, STRING, ROW, COLINFO, MERGED = 0xFD, 0x204, 0x203, 0x27E, 0xBD, 0x205, 0x06, 0x207, 0x208, 0x7D, 0xE5
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}
# --- end of fixed values ---
_END = 0xFFFFFFFA


def ole_stream(data: bytes, names: tuple[str, ...] = ("Workbook", "Book")) -> bytes:
    """The bytes of the first stream of that name in an OLE2 container."""
    shift, mini_shift = struct.unpack_from("<HH", data, 30)
    size, mini = 1 << shift, 1 << mini_shift
    (start_dir,) = struct.unpack_from("<I", data, 48)
    cutoff, start_mini, _, start_difat, n_difat = struct.unpack_from("<IIIII", data, 56)
    sector = lambda i: data[(i + 1) * size : (i + 2) * size]
    table = list(struct.unpack_from("<109I", data, 76))
    for _ in range(n_difat):
        part = struct.unpack(f"<{size // 4}I", sector(start_difat))
        table += part[:-1]
        start_difat = part[-1]
    fat: list[int] = []
    for i in table:
        if i < _END:
            fat += struct.unpack(f"<{size // 4}I", sector(i).ljust(size, b"\xff"))

    def chain(i: int, links: list[int], read) -> bytes:
        out, seen = [], 0
        while i < _END and seen <= len(links):
            out.append(read(i))
            i, seen = links[i], seen + 1
        return b"".join(out)

    entries = {}
    directory = chain(start_dir, fat, sector)
    for at in range(0, len(directory) - 127, 128):
        (length,) = struct.unpack_from("<H", directory, at + 64)
        kind, begin, n = directory[at + 66], *struct.unpack_from("<II", directory, at + 116)
        if kind:
            entries[directory[at : at + max(0, length - 2)].decode("utf-16-le", "replace")] = (kind, begin, n)
    root = next((e for e in entries.values() if e[0] == 5), None)
    for name in names:
        if name in entries:
            _, begin, n = entries[name]
            if n >= cutoff or root is None:
                return chain(begin, fat, sector)[:n]
            pool = chain(root[1], fat, sector)
            raw = chain(start_mini, fat, sector)
            links = list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))
            return chain(begin, links, lambda i: pool[i * mini : (i + 1) * mini])[:n]
    raise FormatError("No workbook stream")


def _records(data: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(number, parts) of records up to the end of a substream; parts after the first come from CONTINUE records."""
    while at + 4 <= len(data):
        kind, n = struct.unpack_from("<HH", data, at)
        parts, at = [data[at + 4 : at + 4 + n]], at + 4 + n
        while at + 4 <= len(data) and struct.unpack_from("<H", data, at)[0] == CONTINUE:
            (n,) = struct.unpack_from("<H", data, at + 2)
            parts.append(data[at + 4 : at + 4 + n])
            at += 4 + n
        yield kind, parts
        if kind == EOF:
            return


class _Parts:
    """Reads across the parts of a record; characters that go on in the next part start with a new width there."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.i, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n and self.i < len(self.parts):
            got = self.parts[self.i][self.at : self.at + n]
            out, n, self.at = out + got, n - len(got), self.at + len(got)
            if n:
                self.i, self.at = self.i + 1, 0
        return out

    def text(self, n: int) -> str:
        flags = self.take(1)[0]
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out = []
        while n:
            if self.at >= len(self.parts[self.i]):
                if self.i + 1 >= len(self.parts):
                    break
                self.i, self.at = self.i + 1, 0
                flags = self.take(1)[0]
            width = 2 if flags & 1 else 1
            k = min(n, (len(self.parts[self.i]) - self.at) // width)
            out.append(self.take(k * width).decode("utf-16-le" if width == 2 else "latin-1", "replace"))
            n -= k
            if not k:
                break
        self.take(4 * runs + extra)
        return "".join(out)


def _rk(x: int) -> float:
    n = float(x >> 2 if x < 1 << 31 else (x >> 2) - (1 << 30)) if x & 2 else struct.unpack("<d", struct.pack("<Q", (x & 0xFFFFFFFC) << 32))[0]
    return n / 100 if x & 1 else n


class LegacyBook:
    """The parts of a legacy workbook, in the shape of ooxml.Workbook."""

    def __init__(self, data: bytes, name: str | None = None):
        try:
            self.data = ole_stream(data) if data.startswith(OLE_MAGIC) else data
            self.sheets, self.strings, self.formats, self.epoch = [], [], [], EPOCH
            self._globals()
        except (struct.error, IndexError) as e:
            raise FormatError(f"Not a readable legacy workbook: {e}", file_path=name) from e

    def _globals(self) -> None:
        own, styles = {}, []
        for kind, parts in _records(self.data):
            p = parts[0]
            if kind == BOF and struct.unpack_from("<H", p)[0] != 0x600:
                raise FormatError("Only BIFF8 workbooks are read")
            if kind == BOUNDSHEET and p[5] == 0:
                self.sheets.append((_Parts([p[7:]]).text(p[6]), str(struct.unpack_from("<I", p)[0])))
            elif kind == DATEMODE and struct.unpack_from("<H", p)[0]:
                self.epoch = EPOCH_1904
            elif kind == FORMAT:
                i, n = struct.unpack_from("<HH", p)
                own[i] = _Parts([p[4:]]).text(n)
            elif kind == XF:
                styles.append(struct.unpack_from("<H", p, 2)[0])
            elif kind == SST:
                reader = _Parts(parts)
                (_, n) = struct.unpack("<II", reader.take(8))
                for _ in range(n):
                    self.strings.append(reader.text(struct.unpack("<H", reader.take(2))[0]))
        self.formats = [own.get(i, BUILT_IN.get(i, "General")) for i in styles]

    def _number(self, n: float, xf: int) -> tuple:
        code = self.formats[xf] if xf < len(self.formats) else "General"
        if is_date_format(code) and 0 <= n < 2_958_466:
            return "d", None, None, None, self.epoch + timedelta(seconds=round(n * 86400, 3)), None, code
        return "n", None, n, None, None, None, code

    def cells(self, part: str, r1: int = 1, r2: int | None = None) -> Iterator[tuple]:
        """(row, col, ctype, s, n, b, ts, formula, number_format); formulas are their cached values."""
        pending = None
        for kind, parts in _records(self.data, int(part)):
            p = parts[0]
            if kind == STRING and pending:
                yield (*pending, "s", _Parts([p[2:], *parts[1:]]).text(struct.unpack_from("<H", p)[0]), None, None, None, None, "General")
                pending = None
                continue
            if kind not in (LABELSST, LABEL, NUMBER, RK, MULRK, BOOLERR, FORMULA):
                continue
            row, col, xf = struct.unpack_from("<HHH", p)
            if not r1 <= row + 1 <= (r2 or 1 << 20):
                continue
            at = (row + 1, col + 1)
            if kind == LABELSST:
                yield (*at, "s", self.strings[struct.unpack_from("<I", p, 6)[0]], None, None, None, None, "General")
            elif kind == LABEL:
                yield (*at, "s", _Parts([p[8:], *parts[1:]]).text(struct.unpack_from("<H", p, 6)[0]), None, None, None, None, "General")
            elif kind == NUMBER:
                yield (*at, *self._number(struct.unpack_from("<d", p, 6)[0], xf))
            elif kind == RK:
                yield (*at, *self._number(_rk(struct.unpack_from("<I", p, 6)[0]), xf))
            elif kind == MULRK:
                for k in range((len(p) - 6) // 6):
                    xf, x = struct.unpack_from("<HI", p, 4 + 6 * k)
                    yield (row + 1, col + 1 + k, *self._number(_rk(x), xf))
            elif kind == BOOLERR or p[12:14] == b"\xff\xff" and p[6] in (1, 2):
                value, error = (p[6], p[7]) if kind == BOOLERR else (p[8], p[6] == 2)
                yield (*at, "e", ERRORS.get(value, "#N/A"), None, None, None, None, "General") if error else (*at, "b", None, None, bool(value), None, None, "General")
            elif p[12:14] == b"\xff\xff":
                pending = at if p[6] == 0 else None
            else:
                yield (*at, *self._number(struct.unpack_from("<d", p, 6)[0], xf))

    def layout(self, part: str) -> tuple[list[tuple[int, int, int, int]], list[int], list[int]]:
        merged, rows, cols = [], [], []
        for kind, parts in _records(self.data, int(part)):
            p = parts[0]
            if kind == MERGED:
                for k in range(struct.unpack_from("<H", p)[0]):
                    a, b, c, d = struct.unpack_from("<HHHH", p, 2 + 8 * k)
                    merged.append((a + 1, c + 1, b + 1, d + 1))
            elif kind == ROW and struct.unpack_from("<H", p, 12)[0] & 0x20:
                rows.append(struct.unpack_from("<H", p)[0] + 1)
            elif kind == COLINFO and struct.unpack_from("<H", p, 8)[0] & 1:
                a, b = struct.unpack_from("<HH", p)
                cols += range(a + 1, b + 2)
        return merged, rows, cols


def is_legacy(data: bytes) -> bool:
    return data.startswith((OLE_MAGIC, BIFF8_MAGIC))
