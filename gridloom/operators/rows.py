"""Row filters: ranges of rows, empty rows and columns, patterns, values."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_rows(df: DataFrame, ordinal: str, skip: int = 0, footer: int = 0, most: int | None = None, last: int | None = None) -> DataFrame:
    """Rows after the first skip, before the last footer ones, at most so many; ordinal counts from 1. last: the greatest
    ordinal, if it is known; one aggregate finds it otherwise, and only if there is a footer."""
    out = df.where(F.col(ordinal) > skip) if skip else df
    if footer:
        last = last if last is not None else (df.agg(F.max(ordinal)).first()[0] or 0)
        out = out.where(F.col(ordinal) <= last - footer)
    return out.where(F.col(ordinal) <= skip + most) if most is not None else out


def drop_empty_rows(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Without the rows in which all columns but those of keep are null."""
    values = [c for c in df.columns if c not in keep]
    return df.dropna(how="all", subset=values) if values else df


def fill_ratios(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_rows, n_filled, is_sparse): sparse columns are filled in less than a tenth of the rows. One pass."""
    one = df.agg(F.count("*").alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"c{i}").alias("n_filled")) for i, c in enumerate(columns)]))
    return one.select(rows.alias("x")).select("x.*").withColumn("is_sparse", F.col("n_filled") < F.col("n_rows") * 0.1)


def drop_matching(df: DataFrame, pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Without the rows in which the pattern is found in the text of any value that isn't null. A bad pattern is a re.error."""
    re.compile(pattern)
    texts = [F.col(f"`{c}`").cast("string") for c in df.columns if c not in keep]
    return df.where(~F.exists(F.array(*texts), lambda x: F.coalesce(x.rlike(pattern), F.lit(False)))) if texts else df


def drop_conditions(df: DataFrame, conditions: list[dict[str, Any]]) -> DataFrame:
    """Without the rows where a column equals its value, one condition after another; nulls stay, unknown columns and a value of None do nothing."""
    for c in conditions:
        name, value = c.get("column"), c.get("value")
        if name in df.columns and value is not None:
            df = df.where(F.col(f"`{name}`").isNull() | (F.col(f"`{name}`") != F.lit(value)))
    return df
