"""All data sheets of a workbook."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.detect import raw_header_rows, triage
from .plans.config import FormatType, MultiSheetOptions, SheetConfig, SheetInfo
from .workbook import GridBook

_EXTENSIONS = (".xlsx", ".xlsm", ".xls")


class MultiSheetParser:
    """Tells data sheets from empty, small and pivot sheets, and reads those that stay."""

    def __init__(self, source: Any, options: MultiSheetOptions | None = None, **more: Any):
        self.options = options or MultiSheetOptions(**more)
        if isinstance(source, str) and not source.lower().endswith(_EXTENSIONS):
            raise ValueError(f"Not a workbook: {source}")
        self.book = GridBook(source)

    def analyze(self) -> list[SheetInfo]:
        """What each sheet is: one aggregate over the cells of all sheets."""
        o, out = self.options, []
        frames = [self.book.cells(n).where("ctype is not null") for n in self.book.sheet_names]
        cells = frames[0]
        for f in frames[1:]:
            cells = cells.unionByName(f)
        found = {r["sheet"]: r for r in triage(cells, ["sheet"], o.min_rows, o.min_cols, o.skip_pivots).join(raw_header_rows(cells, ["sheet"], o.header_scan_rows), "sheet", "left").collect()}
        for name in self.book.sheet_names:
            r = found.get(name)
            if r is None:
                out.append(SheetInfo(name, is_empty=True, skip_reason="Empty sheet" if o.skip_empty else None))
                continue
            info = SheetInfo(name, r["n_rows"], r["n_cols"], r["header_row"] or 0, False, r["is_pivot"], r["skip_reason"])
            if info.skip_reason is None and self.book.format_type in (FormatType.XLSX, FormatType.XLSM):
                head = self.book.get_structure(name).header_row
                info.header_row = head - 1 if head and head - 1 < o.header_scan_rows else 0
            out.append(info)
        return out

    def parse_all(self) -> dict[str, DataFrame]:
        o, out = self.options, {}
        for info in self.analyze():
            if info.skip_reason or (o.sheet_filter and not o.sheet_filter(info)) or (o.sheets is not None and info.name not in o.sheets):
                continue
            frame = self._parse(info)
            if frame.columns and frame.limit(1).count():
                out[info.name] = frame
        return out

    def parse_sheet(self, name: str) -> DataFrame:
        """One sheet, whatever its triage says."""
        return self._parse(next((i for i in self.analyze() if i.name == name), SheetInfo(name)))

    def _parse(self, info: SheetInfo) -> DataFrame:
        o = self.options
        config = SheetConfig(
            auto_detect=False, skip_rows=info.header_row, header_rows=1, include_hidden=True,
            sanitize_column_names=o.clean_column_names, ensure_type_consistency=o.ensure_type_consistency,
            use_extended_missing_list=o.use_extended_missing_list, normalize_numbers=o.normalize_numbers,
            decimal_separator=o.decimal_separator, thousands_separator=o.thousands_separator,
        )
        return self.book.to_dataframe(info.name, config)


def read_all_sheets(path: Any, **options: Any) -> dict[str, DataFrame]:
    return MultiSheetParser(path, MultiSheetOptions(**options)).parse_all()


def analyze_excel(path: Any) -> list[SheetInfo]:
    return MultiSheetParser(path).analyze()


def union_all(frames: dict[str, DataFrame], sheet_column: str = "sheet_name") -> DataFrame:
    """All frames under one another by column names, with the name of the sheet; columns that a sheet lacks are null there."""
    out: DataFrame | None = None
    for name, frame in frames.items():
        named = frame.withColumn(sheet_column, F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    if out is None:
        raise ValueError("no frames")
    return out
