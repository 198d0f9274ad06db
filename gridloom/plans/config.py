"""What a caller can ask for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum
from typing import Any


class _Text(str, Enum):
    def __str__(self) -> str:
        return self.value


class DataType(_Text):
    EMPTY, TEXT, NUMBER, BOOLEAN, DATE, ERROR, FORMULA = "empty", "text", "number", "boolean", "date", "error", "formula"


class FormatType(_Text):
    XLSX, XLSM, XLSB, XLS, CSV, TSV, TXT, UNKNOWN = "xlsx", "xlsm", "xlsb", "xls", "csv", "tsv", "txt", "unknown"


class MergeStrategy(_Text):
    FILL, SKIP, FIRST_ONLY = "fill", "skip", "first_only"


class HeaderDetectionMode(_Text):
    AUTO, MANUAL, SMART = "auto", "manual", "smart"


class HeaderFallback(_Text):
    FIRST_ROW, NONE, ERROR = "first_row", "none", "error"


class FormulaEvaluationMode(_Text):
    DISABLED, CACHED_ONLY, CACHED_WITH_FALLBACK, ALWAYS_EVALUATE = "disabled", "cached_only", "cached_with_fallback", "always_evaluate"


class CircularRefStrategy(_Text):
    ERROR, RETURN_CACHED, ITERATE = "error", "return_cached", "iterate"


@dataclass
class SheetConfig:
    """How to read a sheet. Texts are taken for the enumerations."""

    skip_rows: int = 0
    header_rows: int = 1
    skip_footer: int = 0
    cell_range: str | None = None
    column_renames: dict[str, str] = field(default_factory=dict)
    type_hints: dict[str, str] = field(default_factory=dict)
    auto_detect: bool = True
    include_hidden: bool = False
    merge_strategy: MergeStrategy = MergeStrategy.FILL
    locale: str | None = None
    evaluate_formulas: bool = True
    drop_regex: str | None = None
    drop_conditions: list[dict[str, Any]] = field(default_factory=list)
    header_detection_mode: HeaderDetectionMode = HeaderDetectionMode.SMART
    header_confidence_threshold: float = 0.7
    header_fallback: HeaderFallback = HeaderFallback.FIRST_ROW
    multi_row_headers: bool = False
    header_patterns: list[str] | None = None
    normalize: bool = True
    normalize_dates: bool = True
    normalize_numbers: bool = True
    normalize_whitespace: bool = True
    use_extended_missing_list: bool = False
    preserve_types: bool = True
    ensure_type_consistency: bool = True
    decimal_separator: str | None = None
    thousands_separator: str | None = None
    sanitize_column_names: bool = True

    def __post_init__(self) -> None:
        for name, kind in (("merge_strategy", MergeStrategy), ("header_detection_mode", HeaderDetectionMode), ("header_fallback", HeaderFallback)):
            setattr(self, name, kind(getattr(self, name)))
        for name in ("skip_rows", "header_rows", "skip_footer"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must be 0 or more")
        if not 0 <= self.header_confidence_threshold <= 1:
            raise ValueError("header_confidence_threshold must be between 0 and 1")


@dataclass
class FormulaConfig:
    """How single cells' formulas are evaluated."""

    mode: FormulaEvaluationMode = FormulaEvaluationMode.CACHED_WITH_FALLBACK
    circular_strategy: CircularRefStrategy = CircularRefStrategy.ERROR
    max_depth: int = 100
    max_iterations: int = 100
    unsupported_value: Any = "#UNSUPPORTED"
    raise_unsupported: bool = False

    def __post_init__(self) -> None:
        self.mode, self.circular_strategy = FormulaEvaluationMode(self.mode), CircularRefStrategy(self.circular_strategy)
        if self.max_depth < 1 or self.max_iterations < 1:
            raise ValueError("max_depth and max_iterations must be 1 or more")


@dataclass
class SheetInfo:
    """What a sheet is, before it is parsed."""

    name: str
    row_count: int = 0
    col_count: int = 0
    header_row: int = 0
    is_empty: bool = False
    is_pivot: bool = False
    skip_reason: str | None = None


@dataclass
class MultiSheetOptions:
    """Which sheets of a workbook to read, and how."""

    sheets: list[str] | None = None
    skip_pivots: bool = True
    skip_empty: bool = True
    min_rows: int = 2
    min_cols: int = 2
    header_scan_rows: int = 10
    clean_column_names: bool = True
    ensure_type_consistency: bool = True
    use_extended_missing_list: bool = False
    normalize_numbers: bool = True
    decimal_separator: str | None = None
    thousands_separator: str | None = None
    sheet_filter: Callable[[SheetInfo], bool] | None = None


@dataclass
class FormatInfo:
    """What a file is: its format, how sure that is, and for texts the encoding and delimiter."""

    format_type: FormatType
    confidence: float
    encoding: str | None = None
    delimiter: str | None = None
    has_macros: bool = False
    is_encrypted: bool = False


@dataclass
class TableInfo:
    """A rectangle of a sheet, both ends included, from 1."""

    start_row: int
    end_row: int
    start_col: int
    end_col: int
    has_header: bool = True
    header_row: int | None = None
    confidence: float = 1.0

    @property
    def row_count(self) -> int:
        return max(0, self.end_row - self.start_row + 1 - int(self.has_header))

    @property
    def range(self) -> str:
        from ..functions.refs import coords_to_cell_ref

        return f"{coords_to_cell_ref(self.start_row, self.start_col)}:{coords_to_cell_ref(self.end_row, self.end_col)}"


@dataclass
class StructureInfo:
    """Evidence about one sheet."""

    data_start_row: int = 1
    data_end_row: int = 1
    data_start_col: int = 1
    data_end_col: int = 1
    header_row: int | None = None
    header_rows_count: int = 0
    header_confidence: float = 0.0
    metadata_rows: list[int] = field(default_factory=list)
    metadata_type: str = "unknown"
    merged_ranges: list[tuple[int, int, int, int]] = field(default_factory=list)
    merged_in_headers: bool = False
    merged_in_data: bool = False
    hidden_rows: list[int] = field(default_factory=list)
    hidden_columns: list[int] = field(default_factory=list)
    detected_locale: str = "en_US"
    decimal_separator: str = "."
    thousands_separator: str = ","
    num_tables: int = 1
    table_ranges: list[TableInfo] = field(default_factory=list)
    blank_rows: list[int] = field(default_factory=list)
    inconsistent_columns: bool = False
    has_formulas: bool = False
    sparse_columns: list[int] = field(default_factory=list)
    suggested_skip_rows: int = 0
    suggested_skip_footer: int = 0
    suggested_overrides: dict[str, Any] = field(default_factory=dict)


@dataclass
class SheetError:
    """Why a sheet couldn't be read."""

    sheet_name: str
    error_type: str
    message: str
    context: dict[str, Any] = field(default_factory=dict)


@dataclass
class CellValue:
    """One cell and what is known of it."""

    value: Any = None
    formula: str | None = None
    is_merged: bool = False
    is_hidden: bool = False
    data_type: DataType = DataType.EMPTY
    number_format: str | None = None

    @property
    def is_error(self) -> bool:
        return isinstance(self.value, str) and self.value.startswith("#") and self.value.endswith("!")
