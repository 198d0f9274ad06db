"""Formats, encodings and delimiters by content."""

from __future__ import annotations

import codecs
import io
import os
import re
import zipfile
from statistics import mean, pvariance

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import FormatError
from ..functions.fixed import BIFF8_MAGIC, CSV_METADATA, CSV_MOST_SKIPPED, CSV_PROBE, DELIMITERS, EXTENSIONS, OLE_MAGIC, ZIP_MAGIC, any_of
from ..plans.config import FormatInfo, FormatType

HEAD_BYTES, PRINTABLE_BYTES, ENCODING_BYTES = 8192, 1000, 10_000


def detect_encoding(head: bytes) -> str:
    """By byte order mark, else UTF-8 if it is, else latin-1."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if head.startswith(mark):
            return name
    try:
        head.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        return "latin-1"


def delimiter_scores(lines: list[str]) -> dict[str, float]:
    """How evenly each delimiter is spread over lines; none for those that the first line lacks."""
    out = {}
    for d in DELIMITERS:
        counts = [line.count(d) for line in lines]
        if counts and counts[0]:
            out[d] = mean(counts) / (pvariance(counts) + 1)
    return out


def detect_delimiter(lines: list[str]) -> tuple[str, float]:
    scores = delimiter_scores(lines)
    if not scores:
        return ",", 0.5
    best = max(scores, key=lambda d: scores[d])
    return best, min(0.9, 0.5 + scores[best] / 20)


def _by_extension(name: str | None) -> FormatInfo:
    kind = EXTENSIONS.get(os.path.splitext(name or "")[1].lower())
    return FormatInfo(FormatType(kind), 0.5) if kind else FormatInfo(FormatType.UNKNOWN, 0.0)


def _zip(data: bytes, name: str | None) -> FormatInfo:
    try:
        names = set(zipfile.ZipFile(io.BytesIO(data)).namelist())
    except zipfile.BadZipFile:
        return _by_extension(name)
    if "EncryptionInfo" in names:
        return FormatInfo(FormatType.XLSX, 0.9, is_encrypted=True)
    if "xl/workbook.xml" in names:
        macros = any(n.endswith("vbaProject.bin") for n in names)
        return FormatInfo(FormatType.XLSM if macros else FormatType.XLSX, 1.0, has_macros=macros)
    if "xl/workbook.bin" in names:
        return FormatInfo(FormatType.XLSB, 1.0)
    return FormatInfo(FormatType.UNKNOWN, 0.3)


def _text(head: bytes) -> FormatInfo:
    encoding = detect_encoding(head[:PRINTABLE_BYTES])
    lines = [x for x in head.decode(encoding, "replace").lstrip("﻿").splitlines() if x.strip()][:10]
    if len(lines) < 2:
        return FormatInfo(FormatType.CSV, 0.5, encoding, ",")
    delimiter, sure = detect_delimiter(lines)
    return FormatInfo(FormatType.TSV if delimiter == "\t" else FormatType.CSV, sure, encoding, delimiter)


def printable_share(head: bytes) -> float:
    part = head[:PRINTABLE_BYTES]
    return sum(32 <= b < 127 or b in (9, 10, 13) or b >= 128 for b in part) / len(part)


def detect_format(data: bytes, name: str | None = None) -> FormatInfo:
    """Magic numbers, then whether it reads as text, then the extension. Empty content is a FormatError."""
    if not data:
        raise FormatError("File is empty", file_path=name)
    if data.startswith(ZIP_MAGIC):
        return _zip(data, name)
    if data.startswith(OLE_MAGIC):
        encrypted = "EncryptedPackage".encode("utf-16-le") in data
        return FormatInfo(FormatType.XLSX if encrypted else FormatType.XLS, 0.9, is_encrypted=encrypted)
    if data.startswith(BIFF8_MAGIC):
        return FormatInfo(FormatType.XLS, 0.9)
    if data.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)) or printable_share(data) > 0.8:
        return _text(data[:HEAD_BYTES])
    return _by_extension(name)


def validate(data: bytes, name: str | None = None) -> tuple[bool, str | None]:
    """Whether the content can be read, and why not."""
    try:
        found = detect_format(data, name)
    except FormatError as e:
        return False, str(e)
    if found.format_type == FormatType.UNKNOWN:
        return False, "Unknown file format"
    return (False, "File is encrypted") if found.is_encrypted else (True, None)


def detect_files(files: DataFrame) -> DataFrame:
    """files (of binaryFile) with kind: zip, xls, text or unknown, by their first bytes, without Python."""
    head = F.substring("content", 1, PRINTABLE_BYTES)
    text = F.decode(head, "ISO-8859-1")
    printable = F.length(F.regexp_replace(text, r"[^\x20-\x7e\x80-\xff\t\n\r]", "")) / F.length(text)
    start = F.hex(F.substring("content", 1, 8))
    kind = F.when(F.octet_length("content") == 0, "empty").when(start.startswith(ZIP_MAGIC.hex().upper()), "zip").when(start.startswith(OLE_MAGIC.hex().upper()) | start.startswith(BIFF8_MAGIC.hex().upper()), "xls").when(printable > 0.8, "text").otherwise("unknown")
    return files.withColumn("kind", kind)


def delimiter_score(lines: DataFrame, line: str, d: str, order: str, keys: list[str]) -> DataFrame:
    """(keys, score) of a delimiter over lines, null where the first line lacks it."""
    count = F.length(line) - F.length(F.replace(F.col(line), F.lit(d), F.lit("")))
    one = lines.groupBy(*keys).agg((F.avg(count) / (F.var_pop(count) + 1)).alias("score"), F.min_by(count, order).alias("first"))
    return one.select(*keys, F.when(F.col("first") > 0, F.col("score")).alias("score"))


def metadata_share(cells: Column) -> tuple[Column, Column, Column]:
    """(filled cells, share of empty cells, whether metadata is mentioned) of an array of fields."""
    filled = F.size(F.filter(cells, lambda x: F.trim(x) != ""))
    return filled, 1 - filled / F.size(cells), F.exists(cells, lambda x: x.rlike(any_of(CSV_METADATA)))


def metadata_scores(rows: list[list[str]]) -> list[float]:
    """How much each of the first rows looks like it stands above the table, against rows 2 to 9."""
    probe = rows[:CSV_PROBE]
    filled = [sum(bool(x.strip()) for x in r) for r in probe]
    empty = [1 - n / len(r) if r else 1.0 for n, r in zip(filled, probe)]
    usual = [i for i in range(2, min(10, len(probe))) if filled[i]]
    if not usual:
        return [0.0] * len(probe)
    cells, share = int(mean(filled[i] for i in usual)), mean(empty[i] for i in usual)
    out = []
    for i, r in enumerate(probe):
        if not filled[i]:
            out.append(1.0)
            continue
        score = 0.35 * (empty[i] > share + 0.3) + 0.35 * (cells > 0 and filled[i] / cells < 0.4)
        score += 0.4 * any(re.search(any_of(CSV_METADATA), x) for x in r if x.strip())
        out.append(min(1.0, score))
    return out


def rows_above(rows: list[list[str]]) -> int:
    """How many leading rows to skip; none if there are fewer than three rows."""
    if len(rows) < 3:
        return 0
    n = 0
    for score in metadata_scores(rows):
        if score < 0.35 or n == CSV_MOST_SKIPPED:
            break
        n += 1
    return n
