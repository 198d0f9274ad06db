"""Evidence about one sheet: a few bounded aggregates over its cells, read on the driver."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import EMPTY_STOP, FOOTER_ROWS, FOOTER_STREAK, FOOTERS, SCAN_ROWS, any_of
from ..operators.detect import best_header, formula_flags, header_scores, locales, row_profile
from .config import StructureInfo, TableInfo
from .parse_plan import separators_of


def region_of(rows: list[Any]) -> tuple[int, int, int, int]:
    """(first row, last row, first column, last column) before a gap of more than EMPTY_STOP rows; 1, 1, 1, 1 without rows."""
    kept = []
    for r in rows:
        if kept and r["row"] - kept[-1]["row"] > EMPTY_STOP + 1:
            break
        kept.append(r)
    if not kept:
        return 1, 1, 1, 1
    return kept[0]["row"], kept[-1]["row"], min(r["lo"] for r in kept), max(r["hi"] for r in kept)


def tables_of(rows: list[int], left: int, right: int, header: int | None, confidence: float) -> list[TableInfo]:
    """Tables that two or more blank rows part; a single one keeps the header's evidence."""
    runs: list[list[int]] = []
    for r in rows:
        if runs and r - runs[-1][1] < 3:
            runs[-1][1] = r
        else:
            runs.append([r, r])
    if len(runs) < 2:
        first, last = (rows[0], rows[-1]) if rows else (1, 1)
        return [TableInfo(first, last, left, right, header is not None, header, confidence)]
    return [TableInfo(a, b, left, right) for a, b in runs]


def footer_of(lines: dict[int, str], start: int, end: int) -> int:
    """How many of the last rows are notes or blank, read upwards until a row that is neither."""
    skip = streak = 0
    for r in range(end, max(start, end - FOOTER_ROWS + 1) - 1, -1):
        line = lines.get(r, "").strip()
        if not line:
            skip, streak = skip + 1, streak + 1
            if streak >= FOOTER_STREAK:
                break
        elif re.search(any_of(FOOTERS), line):
            skip, streak = skip + 1, 0
        else:
            break
    return skip


def analyze_cells(cells: DataFrame, merges: DataFrame, dims: DataFrame, patterns: list[str] | None = None) -> StructureInfo:
    """Evidence about the one sheet that cells, merges and dims are of."""
    valued = cells.where("ctype is not null")
    rows = row_profile(valued.where(F.col("row") <= SCAN_ROWS)).orderBy("row").collect()  # SCAN_ROWS at most
    start, end, left, right = region_of(rows)
    inside = [r for r in rows if start <= r["row"] <= end]
    if rows and rows[-1]["row"] == end and end > SCAN_ROWS - 10:
        end = valued.agg(F.max("row")).first()[0]
    numbers = [r["row"] for r in inside]
    blank = sorted(set(range(start, (numbers[-1] if numbers else start) + 1)) - set(numbers)) if numbers else []
    head = best_header(header_scores(valued, merges=merges, patterns=patterns)).collect() if inside else []
    header, confidence = (head[0]["header_row"], head[0]["confidence"]) if head else (None, 0.0)
    merged = [tuple(r) for r in merges.select("r1", "c1", "r2", "c2").orderBy("r1", "c1").collect()]
    hidden = dims.where("hidden").select("axis", "idx").collect()
    spot = locales(valued).collect() if inside else []
    locale = spot[0]["locale"] if spot else "en_US"
    n = min(len(inside) and end - start + 1, 1000)
    counts = valued.where(F.col("row").between(start, start + n - 1)).groupBy("col").count().collect() if n else []
    found = {r["col"]: r["count"] for r in counts}
    flags = formula_flags(cells).collect() if inside else []
    metadata = [r["row"] for r in inside if header is not None and r["row"] < header and 1 <= r["n"] <= 2]
    tables = tables_of(numbers, left, right, header, confidence)
    decimal, thousands = separators_of(locale)
    return StructureInfo(
        data_start_row=start, data_end_row=end, data_start_col=left, data_end_col=right,
        header_row=header, header_rows_count=int(header is not None), header_confidence=confidence,
        metadata_rows=metadata, merged_ranges=merged,
        merged_in_headers=any(header is not None and r1 <= header <= r2 for r1, _, r2, _ in merged),
        merged_in_data=any(r1 > (header or 0) for r1, *_ in merged),
        hidden_rows=sorted(r["idx"] for r in hidden if r["axis"] == "row"),
        hidden_columns=sorted(r["idx"] for r in hidden if r["axis"] == "col"),
        detected_locale=locale, decimal_separator=decimal, thousands_separator=thousands,
        num_tables=len(tables), table_ranges=tables, blank_rows=blank,
        has_formulas=bool(flags and flags[0]["has_formulas"]),
        sparse_columns=[c for c in range(left, right + 1) if n and found.get(c, 0) < n * 0.1] if inside else [],
        suggested_skip_rows=len(metadata),
        suggested_skip_footer=footer_of({r["row"]: r["line"] for r in inside}, start, end) if inside else 0,
    )
