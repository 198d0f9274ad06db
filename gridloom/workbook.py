"""Workbooks and text tables as lazy DataFrames."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import FileError, FormatError, GridError
from .functions.formula import FormulaEngine
from .functions.names import sanitize_column_name, unique_names
from .functions.refs import cell_ref_to_coords, coords_to_cell_ref, parse_range
from .operators import grid
from .operators.normalize import STEPS, Normalizer, normalize
from .operators.rows import drop_conditions, drop_matching
from .plans.cache import StructureCache
from .plans.config import CellValue, DataType, FormatInfo, FormatType, FormulaConfig, FormulaEvaluationMode, MergeStrategy, SheetConfig, SheetError, StructureInfo, TableInfo
from .plans.parse_plan import GRID_FORMATS, TEXT_FORMATS, ParsePlan, compile_plan, needs_structure
from .plans.structure import analyze_cells
from .sources.datasource import Layout, open_book, read_cells, read_layout
from .sources.handle import SourceHandle
from .sources.sniff import detect_format, validate
from .sources.text import read_text_grid

_CACHE = StructureCache()
_EXCEL_NAMES = (".xlsx", ".xlsm", ".xltx", ".xltm", ".xls")


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


class Handler:
    """A reader of a format beyond the built-in ones. The grid of parse has row (from 1) and c0, c1, ..., as many as it says."""

    def can_handle(self, kind: FormatType) -> bool:
        raise NotImplementedError

    def parse(self, spark: SparkSession, source: SourceHandle, sheet: str) -> tuple[DataFrame, int]:
        raise NotImplementedError

    def get_sheet_names(self, source: SourceHandle) -> list[str]:
        return ["Sheet1"]

    def validate(self, source: SourceHandle) -> tuple[bool, str | None]:
        return True, None


class _Pair(Handler):
    def __init__(self, can_handle: Callable[[FormatType], bool], parse: Callable[[SparkSession, SourceHandle, str], tuple[DataFrame, int]]):
        self.can_handle, self.parse = can_handle, parse


class Registry:
    """Handlers in order, and a detector of formats (an object with detect(handle)). Of the handlers for a format the first
    reads it; where one fails, the next is asked, and the last one's error holds."""

    def __init__(self, handlers: list[Handler] | None = None, detector: Any = None) -> None:
        self.handlers, self.detector = list(handlers or []), detector

    def register_handler(self, handler: Handler | Callable[[FormatType], bool], parse: Callable | None = None, priority: int = -1) -> None:
        """handler, or the two functions can_handle and parse; priority: its place in the order, or behind all others."""
        added = handler if parse is None else _Pair(handler, parse)
        self.handlers.insert(len(self.handlers) if priority < 0 else priority, added)

    def detect_format(self, handle: SourceHandle) -> FormatInfo:
        return self.detector.detect(handle) if self.detector else detect_format(handle.read_bytes(), handle.filename_hint)

    def handlers_of(self, kind: FormatType) -> list[Handler]:
        return [h for h in self.handlers if h.can_handle(kind)]

    def _first(self, kind: FormatType, ask: Callable[[Handler], Any]) -> Any:
        failed: Exception | None = None
        for h in self.handlers_of(kind):
            try:
                return ask(h)
            except Exception as e:  # noqa: BLE001  the next handler may do better
                failed = e
        raise failed or FormatError("No handler for the format", detected_format=str(kind))

    def read(self, kind: FormatType, spark: SparkSession, source: SourceHandle, sheet: str) -> tuple[DataFrame, int]:
        def ask(h: Handler) -> tuple[DataFrame, int]:
            good, why = h.validate(source)
            if not good:
                raise FormatError(why or "Not readable", file_path=source.description)
            return h.parse(spark, source, sheet)

        return self._first(kind, ask)

    def sheet_names(self, kind: FormatType, source: SourceHandle) -> list[str]:
        return list(self._first(kind, lambda h: h.get_sheet_names(source)))


class GridBook:
    """A workbook or text table. Frames are lazy; only the bounded evidence that plans need is read at once."""

    def __init__(self, source: Any, sheet_config: SheetConfig | None = None, formula_config: FormulaConfig | None = None, filename: str | None = None, registry: Registry | None = None, spark: SparkSession | None = None):
        self.spark = spark or _session()
        self.source = SourceHandle(source, filename)
        self._config, self.formula_config = sheet_config or SheetConfig(), formula_config or FormulaConfig()
        self.registry = registry or Registry()
        if self.source.is_path and not os.path.exists(self.source.path):
            raise FileError("File not found", file_path=self.source.path)
        info = self.registry.detect_format(self.source)
        self._reject(info)
        self.info, self._frames = info, {}
        self._sheets: dict[str, GridSheet] = {}
        self._structures: dict[tuple, StructureInfo] = {}
        self._engine: FormulaEngine | None = None
        grids = (*GRID_FORMATS, FormatType.XLS)
        if self.registry.handlers_of(info.format_type):
            self._names = self.registry.sheet_names(info.format_type, self.source)
        else:
            self._names = [n for n, _ in open_book(self.source.read_bytes(), self.source.description).sheets] if info.format_type in grids else ["Sheet1"]

    def _reject(self, info: FormatInfo) -> None:
        kind, name = info.format_type, self.source.filename_hint or ""
        if self.registry.handlers_of(kind):
            return
        if kind == FormatType.UNKNOWN:
            raise FormatError("Unknown file format", file_path=name)
        if kind == FormatType.XLSB:
            raise FormatError("Binary workbooks (.xlsb) aren't supported", file_path=name)
        if self.source.is_path and name.lower().endswith(_EXCEL_NAMES) and kind in TEXT_FORMATS:
            raise FormatError("The content doesn't match the extension", file_path=name, detected_format=str(kind))
        if kind in GRID_FORMATS:
            good, why = validate(self.source.read_bytes(), name)
            if not good:
                raise FormatError(why or "Not readable", file_path=name)

    # --- what is there ---

    @property
    def sheet_names(self) -> list[str]:
        return list(self._names)

    @property
    def format_type(self) -> FormatType:
        return self.info.format_type

    @property
    def file_path(self) -> str | None:
        return self.source.path

    def get_sheet(self, name: str | None = None) -> GridSheet:
        name = self._named(name)
        if name not in self._sheets:
            self._sheets[name] = GridSheet(self, name)
        return self._sheets[name]

    def __getitem__(self, name: str) -> GridSheet:
        return self.get_sheet(name)

    def _named(self, name: str | None) -> str:
        if name is None:
            if not self._names:
                raise FormatError("The workbook has no sheets", file_path=self.source.description)
            return self._names[0]
        if name not in self._names:
            raise FormatError(f"Sheet not found: {name}", available=self._names)
        return name

    def cells(self, sheet: str) -> DataFrame:
        """The sheet's cells; kept in Spark's cache, since a profile and a projection read them."""
        if sheet not in self._frames:
            self._frames[sheet] = read_cells(self.source.files(self.spark), [sheet]).persist()
        return self._frames[sheet]

    def layout(self, sheet: str) -> Layout:
        key = ("layout", sheet)
        if key not in self._frames:
            found = read_layout(self.source.files(self.spark), [sheet])
            self._frames[key] = Layout(found.merges.persist(), found.dims.persist())
        return self._frames[key]

    def get_structure(self, sheet: str | None = None, config: SheetConfig | None = None) -> StructureInfo:
        sheet, config = self._named(sheet), config or self._config
        if self.format_type not in GRID_FORMATS:
            return StructureInfo()
        variant = "\x1f".join(config.header_patterns or [])
        where = self.source.identity
        key = (*where, sheet, variant) if where else (None, id(self), sheet, variant)
        held = _CACHE.get(key) if where else self._structures.get(key)
        if held is None:
            layout = self.layout(sheet)
            held = analyze_cells(self.cells(sheet), layout.merges, layout.dims, config.header_patterns)
            if where:
                _CACHE.put(key, held)
            else:
                self._structures[key] = held
        return held

    # --- frames ---

    def plan(self, sheet: str | None = None, config: SheetConfig | None = None) -> ParsePlan:
        config = config or self._config
        if self.format_type == FormatType.XLS:  # legacy sheets are read as they are: no ranges, merges or hidden rows
            config = replace(config, cell_range=None, merge_strategy=MergeStrategy.SKIP, include_hidden=True)
        found = self.get_structure(sheet, config) if needs_structure(config, self.format_type) else None
        return compile_plan(config, found, self.format_type)

    def to_dataframe(self, sheet: str | None = None, config: SheetConfig | None = None) -> DataFrame:
        """The sheet as a clean, typed frame."""
        sheet, config = self._named(sheet), config or self._config
        plan = self.plan(sheet, config)
        wide, names = self._raw(sheet, plan)
        return finish(wide.toDF("_ord", *[f"c{i}" for i in range(len(names))]), names, plan)

    def to_dataframes(self, config: SheetConfig | None = None, include_errors: bool = False) -> Any:
        """Frames by sheet; sheets that fail are left out, or told of as well."""
        frames, errors = {}, []
        for name in self._names:
            try:
                frames[name] = self.to_dataframe(name, config)
            except GridError as e:
                errors.append(SheetError(name, type(e).__name__, e.message, e.context))
        return (frames, errors) if include_errors else frames

    def _raw(self, sheet: str, plan: ParsePlan) -> tuple[DataFrame, list[str]]:
        """(wide rows below the header, column names): _ord and a struct of the cell for each column."""
        if self.registry.handlers_of(self.format_type):
            wide, width = self.registry.read(self.format_type, self.spark, self.source, sheet)
            skip = plan.skip_rows
        elif self.format_type in TEXT_FORMATS:
            wide, skip, width = read_text_grid(self.spark, self.source.read_bytes(), None, None, plan.text_header_scan, plan.skip_rows)
        else:
            wide, width, skip = self._grid(sheet, plan)
        head = wide.where((F.col("row") > skip) & (F.col("row") <= skip + plan.header_rows)).orderBy("row").collect() if plan.header_rows else []
        texts = [[_shown(r[i + 1]) for i in range(width)] for r in head]
        if head and len(head) < plan.header_rows:
            texts = []
        first = skip + (plan.header_rows if texts else 0)
        names = grid.header_names(texts, width)
        body = wide.where(F.col("row") > first)
        if plan.skip_footer:
            last = wide.agg(F.max("row")).first()[0] or 0
            body = body.where(F.col("row") <= last - plan.skip_footer)
        return body, names

    def _grid(self, sheet: str, plan: ParsePlan) -> tuple[DataFrame, int, int]:
        cells, layout, skip = self.cells(sheet), self.layout(sheet), plan.skip_rows
        if not plan.cached_values:
            cells = grid.formula_view(cells)
        cells = cells.where("ctype is not null")
        if plan.merge_strategy == MergeStrategy.FILL:
            cells = grid.fill_merged(cells, layout.merges)
        elif plan.merge_strategy == MergeStrategy.FIRST_ONLY:
            cells = grid.keep_first_of_merged(cells, layout.merges)
        if plan.cell_range:
            try:
                area = plan.cell_range if ":" in plan.cell_range else f"{plan.cell_range}:{plan.cell_range.rpartition('!')[2]}"
                _, r1, c1, r2, c2 = parse_range(area)
            except ValueError as e:
                raise FormatError(f"Invalid cell range: {plan.cell_range}") from e
            cells = grid.slice_cells(cells, r1, c1, r2, c2)
        if plan.drop_hidden:
            cells = grid.drop_hidden(cells, layout.dims)
        if plan.cell_range:  # the rectangle's first row is row 1
            hidden = [] if not plan.drop_hidden else layout.dims.collect()
            up = r1 - 1 - sum(h["axis"] == "row" and h["idx"] < r1 for h in hidden)
            left = c1 - 1 - sum(h["axis"] == "col" and h["idx"] < c1 for h in hidden)
            cells = cells.withColumn("row", F.col("row") - up).withColumn("col", F.col("col") - left)
            skip = 0
        width = cells.agg(F.max("col")).first()[0] or 0
        return grid.to_wide(cells, list(range(1, width + 1))), width, skip

    # --- cells ---

    def get_cell(self, sheet: str | None, row: int, col: int) -> CellValue:
        """One cell, its formula evaluated as the configuration says."""
        sheet = self._named(sheet)
        found = self._point(sheet, row, col)
        layout = self.layout(sheet)
        merged = layout.merges.where(F.lit(row).between(F.col("r1"), F.col("r2")) & F.lit(col).between(F.col("c1"), F.col("c2"))).limit(1).count() > 0
        hidden = layout.dims.where(((F.col("axis") == "row") & (F.col("idx") == row)) | ((F.col("axis") == "col") & (F.col("idx") == col))).limit(1).count() > 0
        if found is None:
            return CellValue(is_merged=merged, is_hidden=hidden)
        formula = None if found["formula"] is None else "=" + found["formula"]
        value = _value(found)
        if formula and self.formula_config.mode != FormulaEvaluationMode.DISABLED:
            value = self.engine.evaluate(sheet, row, col)
        elif formula:
            value = formula
        return CellValue(value, formula, merged, hidden, _kind(value), found["number_format"])

    def get_cell_by_ref(self, ref: str) -> CellValue:
        sheet, row, col = cell_ref_to_coords(ref)
        return self.get_cell(sheet, row, col)

    @property
    def engine(self) -> FormulaEngine:
        if self._engine is None:
            self._engine = FormulaEngine(self._cached, self.formula_config)
        return self._engine

    def _point(self, sheet: str, row: int, col: int):
        rows = self.cells(sheet).where((F.col("row") == row) & (F.col("col") == col)).limit(1).collect()
        return rows[0] if rows else None

    def _cached(self, sheet: str, row: int, col: int) -> tuple[Any, str | None]:
        found = self._point(self._named(sheet), row, col)
        return (None, None) if found is None else (_value(found), found["formula"])

    def close(self) -> None:
        for frame in self._frames.values():
            for df in (frame.merges, frame.dims) if isinstance(frame, Layout) else (frame,):
                df.unpersist()
        self._frames.clear()
        self.source.close()

    def __enter__(self) -> GridBook:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()


class GridTable:
    """A rectangle of a sheet as a frame of its own."""

    def __init__(self, sheet: GridSheet, info: TableInfo):
        self.sheet, self.info = sheet, info

    def to_dataframe(self, config: SheetConfig | None = None) -> DataFrame:
        config = replace(config or self.sheet.book._config, cell_range=self.info.range, header_detection_mode="manual", skip_footer=0)
        return self.sheet.book.to_dataframe(self.sheet.name, config)


class GridSheet:
    """One sheet of a workbook."""

    def __init__(self, book: GridBook, name: str):
        self.book, self.name = book, name

    @property
    def structure(self) -> StructureInfo:
        return self.book.get_structure(self.name)

    @property
    def tables(self) -> list[GridTable]:
        return [GridTable(self, t) for t in self.structure.table_ranges]

    def to_dataframe(self, config: SheetConfig | None = None) -> DataFrame:
        return self.book.to_dataframe(self.name, config)

    def iter_rows(self, min_row: int = 1, max_row: int | None = None, min_col: int = 1, max_col: int | None = None) -> Iterator[list[Any]]:
        """Values row by row, blank rows too; Spark hands over one partition at a time."""
        found = self.structure if max_row is None or max_col is None else None
        last, right = max_row or found.data_end_row, max_col or found.data_end_col
        cells = grid.slice_cells(self.book.cells(self.name), min_row, min_col, last, right).orderBy("row", "col")
        at, line = min_row, [None] * (right - min_col + 1)
        for c in cells.toLocalIterator():
            while at < c["row"]:
                yield line
                at, line = at + 1, [None] * (right - min_col + 1)
            line[c["col"] - min_col] = _value(c)
        while at <= last:
            yield line
            at, line = at + 1, [None] * (right - min_col + 1)

    def __getitem__(self, ref: str) -> Any:
        if ":" not in ref:
            _, row, col = cell_ref_to_coords(ref)
            return self.book.get_cell(self.name, row, col)
        _, r1, c1, r2, c2 = parse_range(ref)
        return list(self.iter_rows(r1, r2, c1, c2))


def _value(cell: Any) -> Any:
    n = cell["n"]
    if n is not None:
        return int(n) if float(n).is_integer() and abs(n) < 1e15 else n
    return next((cell[k] for k in ("s", "b", "ts") if cell[k] is not None), None)


def _shown(cell: Any) -> str | None:
    if cell is None or isinstance(cell, str):
        return cell
    value = _value(cell)
    return None if value is None else str(value)


def _kind(value: Any) -> DataType:
    if value is None:
        return DataType.EMPTY
    if isinstance(value, bool):
        return DataType.BOOLEAN
    if isinstance(value, (int, float)):
        return DataType.NUMBER
    if isinstance(value, str):
        return DataType.ERROR if value.startswith("#") and value.endswith("!") else DataType.TEXT
    return DataType.DATE


def finish(wide: DataFrame, names: list[str], plan: ParsePlan) -> DataFrame:
    """Cleans, names and filters wide rows (_ord, c0, c1, ...)."""
    titled = unique_names(names)
    ids = {f"c{i}": n for i, n in enumerate(titled)}
    hints = {f"c{i}": h for i, n in enumerate(names) for k, h in plan.type_hints if k.upper() in n.upper()}
    skip = tuple(s for s in STEPS if s not in plan.steps) if plan.normalize else STEPS
    how = Normalizer(hints, plan.decimal_separator, plan.thousands_separator, skip, plan.extended_missing, drop_empty=plan.normalize)
    clean = normalize_named(wide, ids, how)
    shown = [ids[c] for c in clean.columns if c != "_ord"]
    if plan.sanitize:
        shown = unique_names([sanitize_column_name(n) for n in shown])
    renames = dict(plan.renames)
    shown = [renames.get(n, n) for n in shown]
    low: set[str] = set()
    for i, n in enumerate(shown):  # Spark tells names apart by their letters alone
        while n.lower() in low:
            n += "_"
        low.add(n.lower())
        shown[i] = n
    out = clean.toDF("_ord", *shown)
    if plan.normalize:
        if plan.drop_regex:
            out = drop_matching(out, plan.drop_regex, ("_ord",))
        out = drop_conditions(out, [{"column": c, "value": v} for c, v in plan.drop_conditions])
    return out.orderBy("_ord").drop("_ord")


def normalize_named(wide: DataFrame, ids: dict[str, str], how: Normalizer) -> DataFrame:
    """normalize of columns c0, c1, ... that decide by their titles."""
    plain = wide.toDF("_ord", *[f"{ids[c]}\x00{c}" for c in wide.columns[1:]])
    named = Normalizer(None if how.hints is None else {f"{ids[c]}\x00{c}": h for c, h in how.hints.items()}, how.decimal, how.thousands, how.skip, how.extended_missing, how.extra_missing, how.preserve_linebreaks, how.drop_empty)
    out, _ = normalize(plain, named, "_ord")
    return out.toDF("_ord", *[c.partition("\x00")[2] for c in out.columns[1:]])


def read_excel(path: Any, sheet: str | None = None, **config: Any) -> DataFrame:
    return GridBook(path).to_dataframe(sheet, SheetConfig(**config))


def read_excel_tables(path: Any, sheet: str | None = None, **config: Any) -> list[DataFrame]:
    return [t.to_dataframe(SheetConfig(**config)) for t in GridBook(path).get_sheet(sheet).tables]


def analyze_structure(path: Any, sheet: str | None = None, **config: Any) -> StructureInfo:
    return GridBook(path).get_structure(sheet, SheetConfig(**config))


__all__ = ["GridBook", "GridSheet", "GridTable", "Handler", "Registry", "analyze_structure", "coords_to_cell_ref", "read_excel", "read_excel_tables"]
