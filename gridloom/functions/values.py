"""Cleaning of values: white space, missing markers, numbers in text, dates in text, serial dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed import CURRENCIES, DATE_FORMATS, EXCEL_EPOCH, EXCEL_ERRORS, MISSING, MISSING_EXTENDED, SERIAL_LEAST, SERIAL_MOST, SPACE

NUMBER_LIKE = rf"^[+-]?(?:[0-9,.]|{SPACE})+$|^\((?:[0-9,.]|{SPACE})+\)$|^[$€£¥₹](?:[0-9,.]|{SPACE})+$"
_STRICT = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
_CURRENCY = "|".join("[$]" if x == "$" else x for x in CURRENCIES)
COMMA_DECIMAL, DOT_DECIMAL, COMMA_THOUSANDS, DOT_THOUSANDS = r"[0-9],[0-9]{2}$", r"[0-9][.][0-9]{2}$", r"[0-9],[0-9]{3}", r"[0-9][.][0-9]{3}"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def clean_whitespace(c: Column, preserve_linebreaks: bool = False) -> Column:
    """Runs of white space as one space, none at the ends; with preserve_linebreaks only blanks, tabs and no-break spaces are run together."""
    if preserve_linebreaks:
        return stripped(F.regexp_replace(c, r"[ \t\x{a0}]+", " "))
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))  # only plain spaces are left


def null_missing(c: Column, extended: bool = False, extra: list[str] | None = None, blank: bool = True) -> Column:
    """Null for markers of missing values and, if blank, for texts of white space alone."""
    gone = c.isin(MISSING + (MISSING_EXTENDED if extended else []) + (extra or []))
    if blank:
        may = (c < "!") | (c >= "\x7f")  # by its first character; the pattern is for the few that may be blank
        gone = gone | (may & c.rlike(f"^{SPACE}*$"))
    return F.when(~gone, c)


def null_errors(c: Column) -> Column:
    """Null for a spreadsheet's error texts."""
    return F.when(~c.isin(EXCEL_ERRORS), c)


def number_like(c: Column) -> Column:
    return stripped(c).rlike(NUMBER_LIKE)


def number_text(c: Column) -> Column:
    """A text without currencies and white space; (x) is -x."""
    x = F.regexp_replace(c, f"{_CURRENCY}|{SPACE}", "")
    return F.regexp_replace(x, r"^\((.*)\)$", "-$1")


def plain_text(u: Column, decimal: str = ".", thousands: str = ",") -> Column:
    """number_text with its separators given way to a decimal point."""
    if thousands.strip():
        u = F.replace(u, F.lit(thousands), F.lit(""))
    return u if decimal == "." else F.replace(u, F.lit(decimal), F.lit("."))


def mixed_text(u: Column) -> Column:
    """number_text where each value tells its own separators: the last one is the decimal one, a comma alone separates thousands."""
    last = F.regexp_extract(u, r"([,.])[^,.]*$", 1)
    european = (last == ",") & (F.contains(u, F.lit(".")) | u.rlike(COMMA_DECIMAL))
    eu = F.translate(F.replace(u, F.lit("."), F.lit("")), ",", ".")
    return F.when(european, eu).otherwise(F.replace(u, F.lit(","), F.lit("")))


def number_of(x: Column) -> Column:
    """A double; null if the text is no number (a cast alone would take 12d)."""
    return F.when(x.rlike(_STRICT), x.try_cast("double"))


def to_number(c: Column, decimal: str = ".", thousands: str = ",") -> Column:
    """A text as a double: currencies go, (x) is -x, separators give way; null if it is no number."""
    return number_of(plain_text(number_text(c), decimal, thousands))


def to_number_mixed(c: Column) -> Column:
    """to_number where each value tells its own separators."""
    return number_of(mixed_text(number_text(c)))


def with_numbers(df: DataFrame, columns: dict[str, str], decimal: str, thousands: str, mixed: dict[str, str]) -> DataFrame:
    """df with to_number (columns: text to new name) and to_number_mixed (mixed), step by step, so that no step is computed twice."""
    texts = dict.fromkeys([*columns, *mixed])
    out = df.select("*", *[number_text(F.col(c)).alias(f"_u_{c}") for c in texts])
    out = out.select("*", *[plain_text(F.col(f"_u_{c}"), decimal, thousands).alias(f"_p_{c}") for c in columns], *[mixed_text(F.col(f"_u_{c}")).alias(f"_m_{c}") for c in mixed])
    out = out.select("*", *[number_of(F.col(f"_p_{c}")).alias(n) for c, n in columns.items()], *[number_of(F.col(f"_m_{c}")).alias(n) for c, n in mixed.items()])
    return out.drop(*[f"_u_{c}" for c in texts], *[f"_p_{c}" for c in columns], *[f"_m_{c}" for c in mixed])


def as_date(c: Column, pattern: str) -> Column:
    return F.try_to_timestamp(c, F.lit(pattern)).cast("timestamp_ntz")


def as_any_date(c: Column) -> Column:
    """The first format that fits, else an ISO 8601 reading."""
    return F.coalesce(*[as_date(c, p) for p, _ in DATE_FORMATS], F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), c.try_cast("timestamp_ntz")))


def serial_date(c: Column) -> Column:
    """Days since the spreadsheet epoch as a timestamp, fractions kept to the microsecond."""
    micros = F.round(c.cast("double") * 86_400_000_000).cast("bigint")
    return F.to_timestamp_ntz(F.lit(EXCEL_EPOCH + " 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), micros.cast("decimal(24,0)") / F.lit(1_000_000).cast("decimal(7,0)"))


def serial_candidate(c: Column) -> Column:
    """Whether a number can be a serial date: whole, and within the range of days."""
    return (c >= SERIAL_LEAST) & (c <= SERIAL_MOST) & (c % 1 == 0)


def python_float(c: Column) -> Column:
    """A double as text the way Python prints it (Spark turns to exponents at 1e7, Python at 1e16)."""
    plain = F.regexp_replace(F.format_number(c, "0.0###############"), r"^$", "0.0")
    return F.when((F.abs(c) >= 1e7) & (F.abs(c) < 1e16), plain).when((F.abs(c) < 1e-3) & (F.abs(c) >= 1e-4), plain).otherwise(c.cast("string"))
