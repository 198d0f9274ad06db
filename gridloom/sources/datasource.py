"""The grid data source: cells, layouts and sheet names of workbooks, one partition for each sheet of each file."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import CELLS
from .biff import LegacyBook, is_legacy
from .ooxml import Workbook

SHEETS = "path string, sheet_index int, sheet string, part string"
DIMS = "path string, sheet string, axis string, idx int, hidden boolean"
MERGES = "path string, sheet string, r1 int, c1 int, r2 int, c2 int"
#: Rows of one Arrow batch.
BATCH = 8192


@dataclass(frozen=True)
class Layout:
    merges: DataFrame
    dims: DataFrame


def open_book(data: bytes, name: str | None = None) -> Workbook | LegacyBook:
    """A workbook by its first bytes."""
    return LegacyBook(data, name) if is_legacy(data) else Workbook(data, name)


def _books(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Workbook]]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            yield path, open_book(content.as_py(), path)


def list_sheets(files: DataFrame) -> DataFrame:
    """(path, sheet_index, sheet, part) of every workbook in files (of binaryFile)."""

    def run(batches):
        for path, book in _books(batches):
            yield pa.RecordBatch.from_pylist([{"path": path, "sheet_index": i, "sheet": n, "part": p} for i, (n, p) in enumerate(book.sheets)], pa.schema([("path", pa.string()), ("sheet_index", pa.int32()), ("sheet", pa.string()), ("part", pa.string())]))

    return files.select("path", "content").mapInArrow(run, SHEETS)


_ARROW = pa.schema([("path", pa.string()), ("sheet_index", pa.int32()), ("sheet", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("ctype", pa.string()), ("s", pa.string()), ("n", pa.float64()), ("b", pa.bool_()), ("ts", pa.timestamp("us")), ("formula", pa.string()), ("number_format", pa.string())])


def read_cells(files: DataFrame, sheets: list[str] | None = None, first_row: int = 1, last_row: int | None = None) -> DataFrame:
    """The cells relation of every workbook in files, only of the named sheets and rows if they are given.

    A file's bytes are decoded where they are read; sheets stream row by row in Arrow batches."""
    wanted = None if sheets is None else set(sheets)

    def run(batches):
        for path, book in _books(batches):
            for i, (name, part) in enumerate(book.sheets):
                if wanted is not None and name not in wanted:
                    continue
                rows: list[tuple] = []
                for cell in book.cells(part, first_row, last_row):
                    rows.append((path, i, name, *cell))
                    if len(rows) == BATCH:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return files.select("path", "content").mapInArrow(run, CELLS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def read_layout(files: DataFrame, sheets: list[str] | None = None) -> Layout:
    """Merged ranges, and hidden rows and columns, of every workbook in files."""
    wanted = None if sheets is None else set(sheets)
    kind = "path string, sheet string, kind string, a int, b int, c int, d int"

    def run(batches):
        schema = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("kind", pa.string()), *((x, pa.int32()) for x in "abcd")])
        for path, book in _books(batches):
            for name, part in book.sheets:
                if wanted is not None and name not in wanted:
                    continue
                merged, rows, cols = book.layout(part)
                out = [(path, name, "merge", *m) for m in merged] + [(path, name, "row", r, 0, 0, 0) for r in rows] + [(path, name, "col", c, 0, 0, 0) for c in cols]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    rows = files.select("path", "content").mapInArrow(run, kind)
    merges = rows.where("kind = 'merge'").select("path", "sheet", F.col("a").alias("r1"), F.col("b").alias("c1"), F.col("c").alias("r2"), F.col("d").alias("c2"))
    dims = rows.where("kind <> 'merge'").select("path", "sheet", F.col("kind").alias("axis"), F.col("a").alias("idx"), F.lit(True).alias("hidden"))
    return Layout(merges, dims)


def workbook_files(spark: SparkSession, path: str) -> DataFrame:
    """All workbooks under a path or glob, as binaryFile rows; what else is there is left out by its first bytes."""
    return spark.read.format("binaryFile").load(path).where(F.hex(F.substring("content", 1, 4)).isin("504B0304", "D0CF11E0"))
