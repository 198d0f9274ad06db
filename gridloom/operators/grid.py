"""Operators on the long relation of cells: (path, sheet_index, sheet, row, col, ctype, s, n, b, ts, formula, number_format).

Rows and columns count from 1; an empty cell is an absent row. Ranges of cells are (path, sheet, r1, c1, r2, c2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHEET = ["path", "sheet"]
CELLS = "path string, sheet_index int, sheet string, row int, col int, ctype string, s string, n double, b boolean, ts timestamp_ntz, formula string, number_format string"
VALUE = ["ctype", "s", "n", "b", "ts", "formula", "number_format"]


def slice_cells(cells: DataFrame, r1: int, c1: int, r2: int, c2: int) -> DataFrame:
    """The cells of a rectangle, both ends included; the predicate reaches the source."""
    return cells.where(F.col("row").between(r1, r2) & F.col("col").between(c1, c2))


def _hidden_of(dims: DataFrame, axis: str) -> DataFrame:
    return dims.where((F.col("axis") == axis) & F.col("hidden")).groupBy(*SHEET).agg(F.array_sort(F.collect_set("idx")).alias(f"_{axis}"))


def drop_hidden(cells: DataFrame, dims: DataFrame) -> DataFrame:
    """Without hidden rows and columns; what follows them moves up and to the left. dims: (path, sheet, axis, idx, hidden)."""
    out = cells
    for axis in ("row", "col"):
        out = out.join(_hidden_of(dims, axis), SHEET, "left")
        gone = F.coalesce(F.col(f"_{axis}"), F.array().cast("array<int>"))
        at = F.col(axis)
        moved = at - F.size(F.filter(gone, lambda x: x < at))  # noqa: B023  used within this round
        out = out.where(~F.array_contains(gone, F.col(axis))).withColumn(axis, moved.cast("int")).drop(f"_{axis}")
    return out.select(cells.columns)


def _members(merges: DataFrame) -> DataFrame:
    """A row for each cell of each merged range, with the range's first cell."""
    rows = merges.select(*SHEET, F.col("r1").alias("_r"), F.col("c1").alias("_c"), F.explode(F.sequence("r1", "r2")).alias("row"), "c1", "c2")
    return rows.select(*SHEET, "_r", "_c", "row", F.explode(F.sequence("c1", "c2")).alias("col"))


def fill_merged(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Every cell of a merged range gets the value of its first cell. Equi-joins on cells of ranges, no range join."""
    member = _members(merges)
    first = cells.select(*SHEET, F.col("row").alias("_r"), F.col("col").alias("_c"), "sheet_index", *VALUE)
    filled = member.join(first, [*SHEET, "_r", "_c"]).select(cells.columns)
    return cells.join(member.select(*SHEET, "row", "col"), [*SHEET, "row", "col"], "left_anti").select(cells.columns).unionByName(filled)


def keep_first_of_merged(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Only the first cell of a merged range keeps its value."""
    others = _members(merges).where("row != _r or col != _c").select(*SHEET, "row", "col")
    return cells.join(others, [*SHEET, "row", "col"], "left_anti").select(cells.columns)


def formula_view(cells: DataFrame) -> DataFrame:
    """Cells with a formula show its text instead of the value."""
    has = F.col("formula").isNotNull()
    out = cells.withColumn("s", F.when(has, F.concat(F.lit("="), F.col("formula"))).otherwise(F.col("s")))
    for c in ("n", "b", "ts"):
        out = out.withColumn(c, F.when(~has, F.col(c)))
    return out.withColumn("ctype", F.when(has, "s").otherwise(F.col("ctype")))


def text_of() -> Column:
    """A cell's value as text: whole numbers without a fraction, dates in ISO form."""
    whole = (F.col("n") % 1 == 0) & (F.abs(F.col("n")) < 1e15)
    number = F.when(whole, F.col("n").cast("bigint").cast("string")).otherwise(F.col("n").cast("string"))
    return F.coalesce(F.col("s"), number, F.initcap(F.col("b").cast("string")), F.col("ts").cast("string"))


def header_names(rows: list[list[str | None]], width: int) -> list[str]:
    """Names of columns from header rows: col_0, col_1, ... without one, parts joined by __ if there are several."""
    out = []
    for i in range(width):
        parts = [r[i].strip() if len(rows) > 1 else r[i] for r in rows if i < len(r) and r[i] is not None and r[i] != "nan"]
        out.append("__".join(parts) if parts else f"col_{i}")
    return out


def to_wide(cells: DataFrame, columns: list[int], keys: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row of the grid: keys, row, and for each column a struct of the cell (null: empty).

    One aggregation gathers a row's cells, so the plan grows by one lookup a column. Of several cells in one place the
    greatest stays."""
    entry = F.struct("col", F.struct("ctype", "s", "n", "b", "ts").alias("cell"))

    def last(a: Column) -> Column:
        return F.map_from_entries(F.filter(a, lambda x, i: F.coalesce(F.get(a, i + 1)["col"] != x["col"], F.lit(True))))

    # the map is made in the aggregation, below which no later predicate on a column moves
    gathered = F.get(F.transform(F.array(F.array_sort(F.collect_list(entry))), last), F.lit(0))
    rows = cells.where(F.col("col").isNotNull()).groupBy(*keys, "row").agg(gathered.alias("_cells"))
    return rows.select(*keys, "row", *[F.expr(f"_cells[{c}] AS c{i}") for i, c in enumerate(columns)])
