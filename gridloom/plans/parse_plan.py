"""Request and evidence into a plan of fixed decisions; no input is read here."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import StructureError
from ..functions.fixed import LOCALES_DOT, LOCALES_SPACE
from .config import FormatType, HeaderDetectionMode, HeaderFallback, MergeStrategy, SheetConfig, StructureInfo

TEXT_FORMATS = (FormatType.CSV, FormatType.TSV, FormatType.TXT)
GRID_FORMATS = (FormatType.XLSX, FormatType.XLSM)


@dataclass(frozen=True, slots=True)
class ParsePlan:
    """What the scan, the cleaning and the finish will do."""

    skip_rows: int
    header_rows: int
    skip_footer: int
    cell_range: str | None
    merge_strategy: MergeStrategy
    drop_hidden: bool
    cached_values: bool
    text_header_scan: bool
    decimal_separator: str | None
    thousands_separator: str | None
    steps: tuple[str, ...]
    extended_missing: bool
    type_hints: tuple[tuple[str, str], ...]
    normalize: bool
    sanitize: bool
    renames: tuple[tuple[str, str], ...]
    drop_regex: str | None
    drop_conditions: tuple[tuple[str | None, object], ...]


def separators_of(locale: str) -> tuple[str, str]:
    """(decimal, thousands) of a locale such as de_DE."""
    language, _, country = locale.replace("-", "_").partition("_")
    if language == "de" and country.upper() == "CH":
        return ".", "'"
    if language in LOCALES_DOT:
        return ",", "."
    return (",", " ") if language in LOCALES_SPACE else (".", ",")


def needs_structure(config: SheetConfig, kind: FormatType) -> bool:
    return config.auto_detect and kind in GRID_FORMATS


def _header(config: SheetConfig, found: StructureInfo | None) -> tuple[int, int]:
    """(rows to skip, rows of the header)."""
    asked = (config.skip_rows, config.header_rows)
    if found is None or config.header_detection_mode == HeaderDetectionMode.MANUAL:
        return asked
    usable = found.header_row is not None and found.header_confidence >= config.header_confidence_threshold
    if usable:
        above = found.header_row - 1
        if not config.include_hidden:
            above -= sum(r < found.header_row for r in found.hidden_rows)
        detected = (max(0, above), found.header_rows_count)
    if config.header_detection_mode == HeaderDetectionMode.SMART:
        return detected if usable and config.skip_rows == 0 else asked
    if usable:
        return detected
    if config.header_fallback == HeaderFallback.ERROR:
        raise StructureError("No header row found", header_confidence=found.header_confidence, threshold=config.header_confidence_threshold)
    return (config.skip_rows, 0) if config.header_fallback == HeaderFallback.NONE else (0, 1)


def _footer(config: SheetConfig, found: StructureInfo | None) -> int:
    if config.skip_footer or found is None or config.cell_range:
        return config.skip_footer
    if found.num_tables > 1 and found.table_ranges:
        end = found.table_ranges[0].end_row
        rest = found.data_end_row - end
        if not config.include_hidden:
            rest -= sum(end < r <= found.data_end_row for r in found.hidden_rows)
        return max(found.suggested_skip_footer, rest)
    return found.suggested_skip_footer


def compile_plan(config: SheetConfig, found: StructureInfo | None, kind: FormatType) -> ParsePlan:
    skip, header = _header(config, found)
    decimal, thousands = config.decimal_separator, config.thousands_separator
    if decimal is None and thousands is None:
        locale = config.locale or (found.detected_locale if found else None)
        if locale and locale != "auto":
            decimal, thousands = separators_of(locale)
    steps = tuple(s for s, on in (("whitespace", config.normalize_whitespace), ("numbers", config.normalize_numbers), ("dates", config.normalize_dates), ("missing", True), ("type_coercion", config.ensure_type_consistency)) if on)
    return ParsePlan(
        skip_rows=skip,
        header_rows=header,
        skip_footer=_footer(config, found),
        cell_range=config.cell_range or None,
        merge_strategy=config.merge_strategy if found is None or found.merged_ranges else MergeStrategy.SKIP,
        drop_hidden=not config.include_hidden and (found is None or bool(found.hidden_rows or found.hidden_columns)),
        cached_values=config.evaluate_formulas,
        text_header_scan=config.auto_detect and kind in TEXT_FORMATS,
        decimal_separator=decimal,
        thousands_separator=thousands,
        steps=steps,
        extended_missing=config.use_extended_missing_list,
        type_hints=tuple(config.type_hints.items()),
        normalize=config.normalize,
        sanitize=config.sanitize_column_names,
        renames=tuple(config.column_renames.items()),
        drop_regex=config.drop_regex,
        drop_conditions=tuple((c.get("column"), c.get("value")) for c in config.drop_conditions),
    )
