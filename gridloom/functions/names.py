"""Column names that every warehouse takes."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import KIND_DATES, KIND_NUMBERS, KIND_TEMPORAL, KIND_TEXTS, DATE_NAMES, NON_DATE_NAMES, RESERVED_WORDS, any_of

_STEPS = ((r"([a-z])([A-Z])", "_"), (r"([A-Z]+)([A-Z][a-z])", "_"))


def sanitize_column_name(name: Any, max_length: int = 300) -> str:
    """A lower-case name of ASCII letters, digits and underscores: camelCase split, slashes dropped, reserved words and digits prefixed."""
    text = "" if name is None else str(name).strip()
    if not text or text.lower() == "nan":
        return "unnamed"
    for pattern, between in _STEPS:
        text = re.sub(pattern, rf"\1{between}\2", text)
    text = re.sub(r"_+", "_", re.sub(r"[^a-z0-9_]", "_", text.lower().replace("/", ""))).strip("_")
    if text[:1].isdigit():
        text = "col_" + text
    if text in RESERVED_WORDS:
        text = "col_" + text
    return (text[:max_length].rstrip("_") if len(text) > max_length else text) or "unnamed"


def unique_names(names: list[str]) -> list[str]:
    """Names with _1, _2, ... after those that came before; what is made up never collides with another name."""
    taken, counts, out = set(names), {}, []
    for name in names:
        if name not in counts:
            counts[name] = 0
            out.append(name)
            continue
        while True:
            counts[name] += 1
            candidate = f"{name}_{counts[name]}"
            if candidate not in taken:
                break
        taken.add(candidate)
        out.append(candidate)
    return out


def sanitized(c: Column, max_length: int = 300) -> Column:
    """sanitize_column_name of a text column, without Python (letters beyond ASCII give underscores)."""
    x = F.regexp_replace(c, r"^\s+|\s+$", "")
    for pattern, between in _STEPS:
        x = F.regexp_replace(x, pattern, f"$1{between}$2")
    x = F.regexp_replace(F.replace(F.lower(x), F.lit("/"), F.lit("")), "[^a-z0-9_]", "_")
    x = F.regexp_replace(F.regexp_replace(x, "_+", "_"), "^_|_$", "")
    x = F.when(x.rlike("^[0-9]"), F.concat(F.lit("col_"), x)).otherwise(x)
    x = F.when(x.isin(sorted(RESERVED_WORDS)), F.concat(F.lit("col_"), x)).otherwise(x)
    x = F.when(F.length(x) > max_length, F.regexp_replace(F.substring(x, 1, max_length), "_+$", "")).otherwise(x)
    blank = c.isNull() | (x == "") | (F.lower(F.trim(c)) == "nan")
    return F.when(blank, "unnamed").otherwise(x)


def suggests_date(name: str) -> bool:
    """Whether a column of this name holds dates; plain substrings, those that deny it first."""
    return not re.search(any_of(NON_DATE_NAMES), name) and bool(re.search(any_of(DATE_NAMES), name))


def suggests_date_expr(c: Column) -> Column:
    return ~c.rlike(any_of(NON_DATE_NAMES)) & c.rlike(any_of(DATE_NAMES))


def kind_of_name(name: str) -> str | None:
    """DECIMAL, TIMESTAMP or VARCHAR as the name suggests, or None."""
    low = name.lower().strip()
    for patterns, kind in (([KIND_TEMPORAL], "DECIMAL"), (KIND_DATES, "TIMESTAMP"), (KIND_TEXTS, "VARCHAR"), (KIND_NUMBERS, "DECIMAL")):
        if re.search(any_of(patterns), low):
            return kind
    return None


def kind_of_name_expr(c: Column) -> Column:
    low = F.trim(F.lower(c))
    out = F.when(low.rlike(KIND_TEMPORAL), "DECIMAL")
    for patterns, kind in ((KIND_DATES, "TIMESTAMP"), (KIND_TEXTS, "VARCHAR"), (KIND_NUMBERS, "DECIMAL")):
        out = out.when(low.rlike(any_of(patterns)), kind)
    return out
