"""Structure of grids, as aggregates and windows over any number of sheets at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import EMPTY_STOP, EUROPEAN_FORMATS, FOOTER_ROWS, FOOTER_STREAK, FOOTERS, FORMULA_WINDOW, GRID_METADATA, HEADER_ROWS, HEADER_TOKEN, HEADER_WORDS, LOCALE_WINDOW, PIVOT_MARKS, PIVOT_ROWS, SCAN_ROWS, SCAN_STREAK, any_of
from .grid import SHEET, text_of

WORD_EDGE = "(^|[^A-Za-z0-9_])"
EU_VOTES, US_VOTES = (r"[0-9],[0-9]{2}([^0-9]|$)", r"[0-9][.][0-9]{3}"), (r"[0-9][.][0-9]{2}([^0-9]|$)", r"[0-9],[0-9]{3}")


def row_profile(cells: DataFrame, keys: list[str] = SHEET) -> DataFrame:
    """(keys, row, n, n_text, n_number, lo, hi, line): what the other detectors need of each row that isn't empty."""
    text = F.lower(text_of())
    return cells.groupBy(*keys, "row").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("ctype") == "s").alias("n_text"),
        F.count_if(F.col("ctype").isin("n", "b")).alias("n_number"),
        F.min("col").alias("lo"),
        F.max("col").alias("hi"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", text.alias("t")))), lambda x: x["t"]), " ").alias("line"),
    )


def data_region(cells: DataFrame, keys: list[str] = SHEET) -> DataFrame:
    """(keys, start_row, end_row, start_col, end_col): the box of cells before a gap of more than EMPTY_STOP empty rows.

    The first SCAN_ROWS rows are scanned; if fewer than SCAN_STREAK empty rows end the scan of a longer sheet, the box goes
    on to the sheet's last row. A sheet without cells in those rows has the box 1, 1, 1, 1."""
    rows = cells.groupBy(*keys, "row").agg(F.min("col").alias("lo"), F.max("col").alias("hi"))
    by = Window.partitionBy(*keys).orderBy("row")
    gap = F.coalesce((F.col("row") - F.lag("row").over(by) > EMPTY_STOP + 1).cast("int"), F.lit(0))
    seen = rows.withColumn("_gap", gap).withColumn("_island", F.sum("_gap").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    inside = (F.col("_island") == 0) & (F.col("row") <= SCAN_ROWS)
    box = seen.groupBy(*keys).agg(F.min(F.when(inside, F.col("row"))).alias("start_row"), F.max(F.when(inside, F.col("row"))).alias("end_row"), F.min(F.when(inside, F.col("lo"))).alias("start_col"), F.max(F.when(inside, F.col("hi"))).alias("end_col"), F.max("row").alias("_last"))
    longer = (F.col("_last") > SCAN_ROWS) & (SCAN_ROWS - F.col("end_row") < SCAN_STREAK)
    box = box.withColumn("end_row", F.when(longer, F.col("_last")).otherwise(F.col("end_row")))
    return box.select(*keys, *[F.coalesce(c, F.lit(1)).alias(c) for c in ("start_row", "end_row", "start_col", "end_col")])


def blank_rows(rows: DataFrame, keys: list[str] = SHEET) -> DataFrame:
    """(keys, row): rows without a cell between the first and the last one. rows: (keys, row) of those with cells."""
    by = Window.partitionBy(*keys).orderBy("row")
    gaps = rows.select(*keys, "row").distinct().withColumn("_next", F.lead("row").over(by)).where("_next - row > 1")
    return gaps.select(*keys, F.explode(F.sequence(F.col("row") + 1, F.col("_next") - 1)).alias("row"))


def consecutive_runs(rows: DataFrame, keys: list[str] = SHEET) -> DataFrame:
    """(keys, first, last, length) of runs of consecutive rows."""
    by = Window.partitionBy(*keys).orderBy("row")
    return rows.select(*keys, "row").distinct().withColumn("_run", F.col("row") - F.row_number().over(by)).groupBy(*keys, "_run").agg(F.min("row").alias("first"), F.max("row").alias("last"), F.count("*").alias("length")).drop("_run")


def tables(rows: DataFrame, keys: list[str] = SHEET) -> DataFrame:
    """(keys, table_no, start_row, end_row): runs of rows that two or more blank rows part; more than SCAN_ROWS rows are one table."""
    by = Window.partitionBy(*keys).orderBy("row")
    every = Window.partitionBy(*keys)
    short = F.max("row").over(every) - F.min("row").over(every) + 1 <= SCAN_ROWS
    new = F.coalesce((short & (F.col("row") - F.lag("row").over(by) >= 3)).cast("int"), F.lit(0))
    numbered = rows.select(*keys, "row").distinct().withColumn("_new", new).withColumn("table_no", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)) + 1)
    return numbered.groupBy(*keys, "table_no").agg(F.min("row").alias("start_row"), F.max("row").alias("end_row"))


def header_scores(cells: DataFrame, keys: list[str] = SHEET, merges: DataFrame | None = None, patterns: list[str] | None = None) -> DataFrame:
    """(keys, row, confidence, underscores) of rows that can be a header, among the first HEADER_ROWS of the region.

    The parts of the confidence are added in a fixed order: ties of doubles matter."""
    region = data_region(cells, keys)
    inside = cells.join(region, keys).where("row between start_row and end_row and col between start_col and end_col")
    near = inside.where(F.col("row") < F.col("start_row") + HEADER_ROWS + 3)
    text = F.lower(F.col("s"))
    word = any_of([WORD_EDGE + w + "($|[^A-Za-z0-9_])" for w in HEADER_WORDS])
    rows = near.groupBy(*keys, "row").agg(
        F.first("start_row").alias("start_row"),
        (F.first("end_col") - F.first("start_col") + 1).alias("width"),
        F.count("*").alias("n"),
        F.count_if(F.col("ctype") == "s").alias("n_text"),
        F.max(F.col("ctype").isin("n", "b").cast("int")).alias("number"),
        F.count_if(text.rlike(HEADER_TOKEN) | text.rlike(word)).alias("likely"),
        F.count_if(F.col("s").contains("_")).alias("underscores"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", text.alias("t")))), lambda x: x["t"]), " ").alias("line"),
    )
    ahead = Window.partitionBy(*keys).orderBy("row").rangeBetween(1, 3)
    rows = rows.withColumn("below", F.coalesce(F.max("number").over(ahead), F.lit(0)))
    if merges is not None:
        starts = merges.groupBy(*keys, F.col("r1").alias("row")).agg(F.lit(1).alias("merged"))
        rows = rows.join(starts, [*keys, "row"], "left")
    else:
        rows = rows.withColumn("merged", F.lit(None).cast("int"))
    cover = F.col("n") / F.col("width")
    score = F.lit(0.3) + 0.1
    score = score + F.when(cover >= 0.5, 0.2).when(cover >= 0.3, 0.1).otherwise(0.0)
    score = score + F.when(F.col("below") > 0, 0.2).otherwise(0.0)
    score = score + F.least(F.lit(0.2), F.lit(0.3) * (F.col("likely") / F.col("n")))
    score = score + F.when(F.col("merged").isNotNull(), 0.05).otherwise(0.0)
    if patterns:
        hits = sum((F.col("line").rlike("(?i)" + p).cast("int") for p in patterns), F.lit(0))
        score = score + F.least(F.lit(0.15), hits * 0.05)
    ok = (F.col("row") < F.col("start_row") + HEADER_ROWS) & (F.col("n_text") == F.col("n")) & ~((cover < 0.3) & (F.col("n") <= 2))
    return rows.where(ok).select(*keys, "row", score.alias("confidence"), "underscores")


def best_header(scores: DataFrame, keys: list[str] = SHEET) -> DataFrame:
    """(keys, header_row, confidence): the highest score; of equals the one with more underscores, then the earliest."""
    top = F.max_by(F.struct("row", "confidence"), F.struct("confidence", "underscores", -F.col("row")))
    return scores.groupBy(*keys).agg(top.alias("x")).select(*keys, F.col("x.row").alias("header_row"), F.col("x.confidence").alias("confidence"))


def metadata_rows(rows: DataFrame, header: DataFrame, keys: list[str] = SHEET) -> DataFrame:
    """(keys, row): rows above the header with one or two cells. rows: of row_profile or with (row, n)."""
    return rows.join(header, keys).where("row < header_row and n between 1 and 2").select(*keys, "row")


def footer_rows(lines: DataFrame, keys: list[str], row: str = "row", line: str = "line") -> DataFrame:
    """(keys, skip_footer): how many of the last FOOTER_ROWS rows are notes or blank, read upwards until neither.

    lines: a row for each row of the grid, blank ones with a null or empty line. FOOTER_STREAK blanks in a row end it too."""
    by = Window.partitionBy(*keys).orderBy(F.desc(row))
    tail = lines.select(*keys, F.row_number().over(by).alias("k"), F.coalesce(F.trim(line), F.lit("")).alias("t")).where(F.col("k") <= FOOTER_ROWS)
    kind = F.when(F.col("t") == "", 0).when(F.col("t").rlike(any_of(FOOTERS)), 1).otherwise(2)
    seq = tail.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", kind.alias("kind")))), lambda x: x["kind"]).alias("kinds"))

    def step(acc: Column, kind: Column) -> Column:
        go = ~acc["stop"]
        streak = F.when(kind == 0, acc["streak"] + 1).otherwise(0)
        count = F.when(go & (kind == 0) & (streak < FOOTER_STREAK), acc["count"] + 1).when(go & (kind == 0), acc["count"] + 1).when(go & (kind == 1), acc["count"] + 1).otherwise(acc["count"])
        return F.struct(count.cast("int").alias("count"), streak.cast("int").alias("streak"), (acc["stop"] | (kind == 2) | (streak >= FOOTER_STREAK)).alias("stop"))

    start = F.struct(F.lit(0).alias("count"), F.lit(0).alias("streak"), F.lit(False).alias("stop"))
    return seq.select(*keys, F.aggregate("kinds", start, step, lambda acc: acc["count"]).alias("skip_footer"))


def sparse_columns(cells: DataFrame, n_rows: int, keys: list[str] = SHEET) -> DataFrame:
    """(keys, col, n): columns filled in less than a tenth of n_rows."""
    return cells.groupBy(*keys, "col").agg(F.count("*").alias("n")).where(F.col("n") < n_rows * 0.1)


def formula_flags(cells: DataFrame, keys: list[str] = SHEET) -> DataFrame:
    """(keys, has_formulas), by the first rows and columns of the region."""
    region = data_region(cells, keys)
    r, c = FORMULA_WINDOW
    near = (F.col("row") < F.col("start_row") + r) & (F.col("col") < F.col("start_col") + c) & (F.col("row") >= F.col("start_row")) & (F.col("col") >= F.col("start_col"))
    return cells.join(region, keys).groupBy(*keys).agg(F.coalesce(F.bool_or(near & F.col("formula").isNotNull()), F.lit(False)).alias("has_formulas"))


def separator_votes(texts: Column) -> tuple[Column, Column]:
    """Votes of a text column for 1.234,56 and for 1,234.56, as aggregates."""
    eu, us = (sum((F.count_if(texts.rlike(p)) for p in patterns), F.lit(0)) for patterns in (EU_VOTES, US_VOTES))
    return eu, us


def locale_of(eu: Column, us: Column) -> tuple[Column, Column]:
    """(locale, confidence) of votes."""
    locale = F.when(eu > us, "de_DE").otherwise("en_US")
    lead = F.least(F.lit(0.9), 0.5 + F.abs(eu - us) / (eu + us))
    return locale, F.when((eu > us) | (us > 0), lead).otherwise(0.7)


def locales(cells: DataFrame, keys: list[str] = SHEET) -> DataFrame:
    """(keys, locale, confidence) by number formats and texts near the region's start."""
    region = data_region(cells, keys)
    r, c = LOCALE_WINDOW
    near = cells.join(region, keys).where((F.col("row") < F.col("start_row") + r) & (F.col("col") < F.col("start_col") + c))
    eu, us = separator_votes(F.col("s"))
    votes = near.groupBy(*keys).agg(F.coalesce(F.bool_or(F.col("number_format").rlike("|".join(EUROPEAN_FORMATS))), F.lit(False)).alias("marked"), eu.alias("eu"), us.alias("us"))
    locale, sure = locale_of(F.col("eu"), F.col("us"))
    return votes.select(*keys, F.when(F.col("marked"), "de_DE").otherwise(locale).alias("locale"), F.when(F.col("marked"), 0.9).otherwise(sure).alias("confidence"))


def raw_header_rows(cells: DataFrame, keys: list[str], most: int = 10) -> DataFrame:
    """(keys, header_row): 0-based; the first row of two or more values without metadata, a date or a bare number, else 0."""
    t = text_of()
    bad = t.rlike(any_of(GRID_METADATA)) | t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}") | t.rlike(r"^[0-9,.]+$")
    rows = cells.where(F.col("row") <= most).groupBy(*keys, "row").agg((~F.bool_or(bad) & (F.count("*") >= 2)).alias("ok"))
    return rows.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("ok"), F.col("row") - 1)), F.lit(0)).cast("int").alias("header_row"))


def triage(cells: DataFrame, keys: list[str], min_rows: int = 2, min_cols: int = 2, skip_pivots: bool = True) -> DataFrame:
    """(keys, n_rows, n_cols, is_pivot, skip_reason) of every sheet that has cells."""
    marks = (F.col("row") <= PIVOT_ROWS) & F.col("s").rlike(any_of(PIVOT_MARKS))
    one = cells.groupBy(*keys).agg(F.count_distinct("row").alias("n_rows"), F.max("col").alias("n_cols"), F.coalesce(F.bool_or(marks), F.lit(False)).alias("is_pivot"))
    small = (F.col("n_rows") < min_rows) | (F.col("n_cols") < min_cols)
    reason = F.when(small, "Too small")
    if skip_pivots:
        reason = reason.when(F.col("is_pivot"), "Pivot table")
    return one.withColumn("skip_reason", reason)
