"""Cleaning of whole columns: profile, decide, project.

A column is a struct (ctype, s, n, b, ts) of cells, or any column of a plain type. Decisions are all or nothing for a
column and look at the first values in row order, so a profile comes first: one read of the first rows and one aggregate over all of
them. Both take the columns as rows, so that their plans are of one size however many columns there are. The driver
decides for each column, and the result is one lazy projection of built-in expressions."""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..functions.fixed import DATE_FORMATS, DATE_SAMPLE, NUMBER_SAMPLE, SEPARATOR_SAMPLE, SERIAL_LEAST, SERIAL_MOST, TYPE_SAMPLE
from ..functions.names import kind_of_name, suggests_date

STEPS = ("whitespace", "numbers", "dates", "missing", "type_coercion")
_PY_NUMBER = re.compile(r"^[+-]?[\d,.\s]+$|^\([0-9,.\s]+\)$|^[$€£¥₹][0-9,.\s]+$")
_TEXT_HINTS, _NO_DATE_HINTS, _DATE_HINTS = ("VARCHAR", "TEXT", "STRING", "CHAR"), ("DECIMAL", "NUMERIC", "INTEGER", "FLOAT", "VARCHAR", "TEXT"), ("TIMESTAMP", "DATE")


@dataclass
class Decision:
    """What becomes of a column. kind: text, number, keep, serial_date, text_date, any_date, timestamp, boolean, to_text."""

    name: str
    kind: str
    decimal: str = "."
    thousands: str = ","
    mixed_separators: bool = False
    date_format: str | None = None
    integral: bool = False


@dataclass
class Normalizer:
    """The cleaning pipeline. hints: by column name, or None to infer them from names; skip: names of steps to leave out."""

    hints: dict[str, str] | None = field(default_factory=dict)
    decimal: str | None = None
    thousands: str | None = None
    skip: tuple[str, ...] = ()
    extended_missing: bool = False
    extra_missing: list[str] | None = None
    preserve_linebreaks: bool = False
    drop_empty: bool = True

    def on(self, step: str) -> bool:
        return step not in self.skip

    def hint(self, name: str) -> str:
        found = kind_of_name(name) if self.hints is None else self.hints.get(name)
        return (found or "").upper()


def parts_of(c: Column, kind: T.DataType) -> dict[str, Column]:
    """A column's text (s), number (n), boolean (b) and time (t), as far as its type can hold them."""
    if isinstance(kind, T.StructType):
        error = c["ctype"].isNull() | (c["ctype"] == "e")
        return {"s": F.when(~error, c["s"]), "n": c["n"], "b": c["b"], "t": c["ts"]}
    if isinstance(kind, T.BooleanType):
        return {"b": c}
    if isinstance(kind, T.NumericType):
        return {"n": c.cast("double")}
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return {"t": c.cast("timestamp_ntz")}
    return {"s": c.cast("string")}


def _py_separators(columns: list[list[str]]) -> tuple[str, str]:
    """(decimal, thousands) by votes of the first texts of all columns."""
    comma = dot = comma3 = dot3 = 0
    for texts in columns:
        for t in texts[:SEPARATOR_SAMPLE]:
            if not re.match(r"[\d.,\s]+", t):
                continue
            comma += bool(re.search(r"\d,\d{2}$", t))
            dot += bool(re.search(r"\d\.\d{2}$", t))
            dot3 += bool(re.search(r"\d\.\d{3}", t))
            comma3 += bool(re.search(r"\d,\d{3}", t))
    if comma > dot or (comma == dot and dot3 > comma3):
        return ",", "."
    return ".", ","


def _py_date_format(texts: list[str]) -> str | None:
    for spark, strp in DATE_FORMATS:
        good = 0
        for t in texts:
            try:
                datetime.strptime(t, strp)
                good += 1
            except ValueError:
                pass
        if texts and good / len(texts) > 0.8:
            return spark
    return None


def _py_any_date(t: str) -> bool:
    for _, strp in DATE_FORMATS:
        try:
            datetime.strptime(t, strp)
            return True
        except ValueError:
            pass
    try:
        datetime.fromisoformat(t)
        return bool(re.match(r"\d{4}-", t))
    except ValueError:
        return False


def _py_clean(t: str, linebreaks: bool) -> str:
    return re.sub(r"[ \t\xa0]+" if linebreaks else r"[\s\xa0]+", " ", t).strip()


#: Columns that share a decision and an expression, if there are more than so many.
SHARED = 16
_KINDS = {"s": "string", "n": "double", "b": "boolean", "t": "timestamp_ntz"}
#: What the aggregate counts of each column: texts, numbers, booleans, times; texts that aren't missing; serial dates and whole
#: numbers; texts that parse as numbers, with mixed separators, and blank ones; signs of either decimal separator; serial dates
#: and whole numbers among the parsed, and among the mixed; texts that parse as dates.
_COUNTS = "snbtkqwpmexyrvzd"


@dataclass
class Profile:
    """Names, what each column's type can hold, the first cells of each column, counts over all cells, separators."""

    names: list[str]
    has: list[set[str]]
    first: list[list[dict[str, Any]]]
    total: dict[str, Any]
    seps: tuple[str, str]


def _gate(first: list[dict[str, Any]], hint: str, how: Normalizer) -> bool:
    """Whether the first cells allow a column to become a number."""
    if not how.on("numbers") or any(h in hint for h in _TEXT_HINTS):
        return False
    sample = [c["s"].strip() for c in first if c.get("s") is not None][:NUMBER_SAMPLE]
    if any(c.get("n") is not None for c in first):
        return True
    return bool(sample) and sum(bool(_PY_NUMBER.match(x)) for x in sample) / len(sample) > 0.5


def kinds_of(df: DataFrame, names: list[str]) -> list[T.DataType]:
    found = {f.name: f.dataType for f in df.schema.fields}
    return [found[n] for n in names]


def numbered(df: DataFrame, names: list[str], ordinal: str | None) -> DataFrame:
    """df with its columns named x0, x1, ... but for the ordinal."""
    at = {n: f"x{i}" for i, n in enumerate(names)}
    return df.toDF(*[at.get(c, c) for c in df.columns])


def array_of(columns) -> Column:
    """An array of numbered columns; one expression text, since a call for each column of a wide sheet takes long."""
    return F.expr(f"array({', '.join(f'x{i}' for i in columns)})")


def long_cells(df: DataFrame, names: list[str], how: Normalizer, ordinal: str | None) -> DataFrame:
    """(_o, i, s, n, b, t): a row for each cell that holds something; i is its column's place in names."""
    kinds = kinds_of(df, names)
    keep = [F.col(f"`{ordinal}`").alias("_o")] if ordinal else [F.lit(None).cast("long").alias("_o")]
    if all(isinstance(k, T.StructType) and k == kinds[0] for k in kinds):
        plain = numbered(df, names, ordinal)
        rows = plain.select(*keep, F.posexplode(array_of(range(len(names)))).alias("i", "x"))
        parts = parts_of(F.col("x"), kinds[0])
    else:
        entries = [parts_of(F.col(f"`{n}`"), k) for n, k in zip(names, kinds)]
        cells = [F.struct(*[e.get(k, F.lit(None)).cast(t).alias(k) for k, t in _KINDS.items()]) for e in entries]
        rows = df.select(*keep, F.posexplode(F.array(*cells)).alias("i", "x"))
        parts = {k: F.col("x")[k] for k in _KINDS}
    rows = rows.select("_o", "i", *[parts[k].alias(k) for k in _KINDS])
    text = V.clean_whitespace(F.col("s"), how.preserve_linebreaks) if how.on("whitespace") else F.col("s")
    return rows.withColumn("s", V.null_errors(text)).where(F.coalesce("s", *[F.col(k).cast("string") for k in "nbt"]).isNotNull())


def _of_column(c: Column, members: list[int]) -> Column:
    return c.isin(members) if members else F.lit(False)


def profile(df: DataFrame, ordinal: str | None, how: Normalizer) -> Profile:
    """One read of the first rows, then one aggregate over all rows that counts what the first rows leave open.

    Without an ordinal the first rows are those that Spark reads first: give one where the rows' order can change."""
    names = [c for c in df.columns if c != ordinal]
    kinds = kinds_of(df, names)
    of_kind = {k: set(parts_of(F.lit(None).cast(k), k)) for k in set(kinds)}
    has = [of_kind[k] for k in kinds]
    head = (df.orderBy(ordinal) if ordinal else df).limit(TYPE_SAMPLE)
    first: list[list[dict[str, Any]]] = [[] for _ in names]
    if names:
        rows = long_cells(head, names, how, ordinal).collect()
        for r in sorted(rows, key=lambda r: r["_o"]) if ordinal else rows:
            first[r["i"]].append({k: r[k] for k in has[r["i"]]})
    short = [i for i, seen in enumerate(first) if len(seen) < NUMBER_SAMPLE]
    if short and ordinal and head.count() == TYPE_SAMPLE:  # samples that the first rows don't fill go on below them
        by = Window.partitionBy("i").orderBy("_o")
        more = long_cells(df, names, how, ordinal).where(_of_column(F.col("i"), short)).withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= NUMBER_SAMPLE).collect()
        for i in short:
            first[i] = [{k: r[k] for k in has[i]} for r in sorted((r for r in more if r["i"] == i), key=lambda r: r["_k"])]
    if how.decimal is None:
        seps = _py_separators([[c["s"] for c in col if c.get("s") is not None] for col in first])
    else:
        seps = (how.decimal, how.thousands if how.thousands is not None else ("." if how.decimal == "," else ","))
    total = {f"{k}{i}": 0 for i in range(len(names)) for k in _COUNTS}
    if names:
        open_ = [i for i, n in enumerate(names) if "s" in has[i] and _gate(first[i], how.hint(n), how)]
        for r in _counts(long_cells(df, names, how, None), open_, [_date_of(first[i], how.hint(n), how, n) for i, n in enumerate(names)], seps, how).collect():  # a row for each column
            total |= {f"{k}{r['i']}": r[f"_{k}"] for k in _COUNTS}
    return Profile(names, has, first, total, seps)


def _counts(cells: DataFrame, open_: list[int], dates: list[str | None], seps: tuple[str, str], how: Normalizer) -> DataFrame:
    """(i, a column for each of _COUNTS): one aggregate. open_: columns whose texts may be numbers; dates: by column, the
    format of its texts, "" for any, or None."""
    s, n = F.col("s"), F.col("n")
    cells = cells.withColumn("g", F.when(_of_column(F.col("i"), open_), s))
    cells = V.with_numbers(cells, {"g": "p"}, *seps, {"g": "m"})
    left = V.null_missing(s, how.extended_missing, how.extra_missing) if how.on("missing") else s
    parsed = [F.when(_of_column(F.col("i"), [i for i, d in enumerate(dates) if d == f]), V.as_date(left, f) if f else V.as_any_date(left)) for f in sorted({d for d in dates if d is not None})]
    g, p, m = (F.col(c) for c in "gpm")
    counted = {
        "s": F.count(s), "n": F.count(n), "b": F.count("b"), "t": F.count("t"), "k": F.count(left),
        "q": F.count_if(V.serial_candidate(n)), "w": F.count_if(n % 1 == 0), "p": F.count(p), "m": F.count(m),
        "e": F.count_if(F.trim(g) == ""),
        "x": F.coalesce(F.bool_or(g.rlike(V.COMMA_DECIMAL)), F.lit(False)), "y": F.coalesce(F.bool_or(g.rlike(V.DOT_DECIMAL)), F.lit(False)),
        "r": F.count_if(V.serial_candidate(p)), "v": F.count_if(p % 1 == 0), "z": F.count_if(m % 1 == 0),
        "d": F.count(F.coalesce(*parsed)) if parsed else F.lit(0),
    }
    return cells.groupBy("i").agg(*[c.alias(f"_{k}") for k, c in counted.items()])


def _date_of(first: list[dict[str, Any]], hint: str, how: Normalizer, name: str) -> str | None:
    """The format of the dates among the first texts, "" for any, None if they are no dates (numbers are decided elsewhere)."""
    if not how.on("dates") or any(h in hint for h in _NO_DATE_HINTS):
        return None
    forced = any(h in hint for h in _DATE_HINTS)
    kinds = first[:DATE_SAMPLE]
    sample = [c["s"] for c in kinds if c.get("s") is not None]
    plain = sum(c.get("n") is not None for c in kinds) > len(kinds) / 2 or sum(bool(re.match(r"^[+-]?[\d,.\s]+%?$", t)) for t in sample) > len(sample) / 2
    if plain and not forced:
        return None
    found = _py_date_format(sample)
    if found:
        return found
    return "" if (suggests_date(name) or forced) and sample and sum(map(_py_any_date, sample)) / len(sample) > 0.5 else None


def decide(name: str, i: int, first: list[Any], a: Any, seps: tuple[str, str], how: Normalizer) -> Decision:
    """The decision for one column, by the first cells and the aggregates over all."""
    hint = how.hint(name)
    n_text, n_num, n_bool, n_ts = (a[f"{k}{i}"] for k in "snbt")
    number = n_num > 0 and not n_text and not n_bool and not n_ts
    d = Decision(name, "number" if number else "keep", *seps, integral=number and a[f"w{i}"] == n_num)
    may = how.on("numbers") and not any(h in hint for h in _TEXT_HINTS)
    if may and n_text and not n_bool and not n_ts:
        gate = _gate(first, hint, how)
        mixed = a[f"x{i}"] and a[f"y{i}"]
        parsed = a[f"m{i}"] if mixed else a[f"p{i}"]
        if gate and parsed + a[f"e{i}"] == n_text and parsed:
            whole = (a[f"z{i}"] if mixed else a[f"v{i}"]) + a[f"w{i}"]
            d = Decision(name, "number", *seps, mixed_separators=mixed, integral=whole == parsed + n_num)
            number = True
    if how.on("dates") and not any(h in hint for h in _NO_DATE_HINTS):
        forced = any(h in hint for h in _DATE_HINTS)
        if number and not n_bool:
            serial = (a[f"q{i}"] + (a[f"r{i}"] if n_text else 0)) / max(1, n_num + n_text - a[f"e{i}"]) > 0.8
            if serial and (forced or suggests_date(name)):
                d.kind = "serial_date"
        elif n_text and not n_bool:
            found = _date_of(first, hint, how, name)
            if found is not None:
                d = Decision(name, "text_date" if found else "any_date", *seps, date_format=found or None)
    if d.kind == "keep":
        left = a[f"k{i}"] if n_text else 0
        present = [k for k, n in (("text", left), ("number", n_num), ("boolean", n_bool), ("timestamp", n_ts)) if n]
        if not present:
            d.kind = "text"
        elif len(present) == 1:
            d.kind = present[0]
            d.integral = d.kind == "number" and a[f"w{i}"] == n_num
        elif set(present) == {"number", "boolean"} and a[f"w{i}"] == n_num and not how.on("type_coercion"):
            d.kind = "number"
        else:
            d.kind = "to_text"
    return d


def expression(d: Decision, parts: dict[str, Column], parsed: Column | None, how: Normalizer) -> Column:
    """The column that a decision makes of the parts of its cells. parsed: the texts as numbers."""
    raw, n, b, ts = (parts[k] if k in parts else F.lit(None).cast(t) for k, t in _KINDS.items())
    s = V.null_missing(raw, how.extended_missing, how.extra_missing) if how.on("missing") else raw
    if d.kind in ("number", "serial_date"):
        number = n if parsed is None else F.coalesce(n, parsed)
        if d.kind == "number":
            return number.cast("bigint") if d.integral else number
        return F.when((number >= SERIAL_LEAST) & (number < SERIAL_MOST + 1), V.serial_date(number))
    if d.kind == "text_date":
        return F.coalesce(ts, V.as_date(s, d.date_format))
    if d.kind == "any_date":
        return F.coalesce(ts, V.as_any_date(s))
    if d.kind == "timestamp":
        return ts
    if d.kind == "boolean":
        return b
    if d.kind == "to_text":
        whole = (n % 1 == 0) & (F.abs(n) < 1e15)
        shown = F.when(whole, n.cast("bigint").cast("string")).otherwise(V.python_float(n))
        return F.coalesce(s, shown, F.initcap(b.cast("string")), ts.cast("string"))
    return s


def _parsed(d: Decision, held: set[str]) -> bool:
    return d.kind in ("number", "serial_date") and "s" in held


def project(df: DataFrame, names: list[str], decisions: list[Decision], held: list[set[str]], seps: tuple[str, str], how: Normalizer, ordinal: str | None, drop_empty: bool) -> DataFrame:
    """df's columns as decided, named c0, c1, ...; held: the kinds of cells of each column that its decision uses. drop_empty:
    without the rows that hold nothing.

    Columns of cells that many share a decision go through one expression over an array of them, so that a wide sheet's
    plan stays small; the others have an expression each, in whole-stage code."""

    def parts(c: Column, i: int, kind: T.DataType) -> dict[str, Column]:
        found = {k: x for k, x in parts_of(c, kind).items() if k in held[i]}
        if "s" in found:
            found["s"] = V.null_errors(V.clean_whitespace(found["s"], how.preserve_linebreaks) if how.on("whitespace") else found["s"])
        return found

    def like(i: int):
        """The expression of cells of column i."""

        def one(c: Column) -> Column:
            of, d, parsed = parts(c, i, kinds[names[i]]), decisions[i], None
            if _parsed(d, held[i]):
                parsed = V.to_number_mixed(of["s"]) if d.mixed_separators else V.to_number(of["s"], *seps)
            return expression(d, of, parsed, how)

        return one

    keep = [ordinal] if ordinal else []
    kinds = dict(zip(names, kinds_of(df, names)))
    groups: dict[tuple, list[int]] = {}
    for i, d in enumerate(decisions):
        if isinstance(kinds[names[i]], T.StructType):
            groups.setdefault((d.kind, d.decimal, d.thousands, d.mixed_separators, d.date_format, d.integral, tuple(sorted(held[i]))), []).append(i)
    shared = {k: g for k, g in enumerate(g for g in groups.values() if len(g) > SHARED)}
    place = {i: (k, j) for k, g in shared.items() for j, i in enumerate(g)}
    plain = numbered(df, names, ordinal)
    arrays = [F.transform(array_of(g), like(g[0])).alias(f"_g{k}") for k, g in shared.items()]
    alone = [i for i in range(len(names)) if i not in place]
    flat = [c.alias(f"{k}{i}") for i in alone for k, c in sorted(parts(F.col(f"x{i}"), i, kinds[names[i]]).items())]
    cells = plain.select(*keep, *flat, *arrays)
    for mixed in (False, True):  # numbers in texts, parsed step by step
        wanted = {f"s{i}": f"v{i}" for i in alone if _parsed(decisions[i], held[i]) and decisions[i].mixed_separators == mixed}
        if wanted:
            cells = V.with_numbers(cells, {} if mixed else wanted, *seps, wanted if mixed else {})

    def column(i: int) -> Column:
        if i in place:
            return F.expr(f"_g{place[i][0]}[{place[i][1]}]")
        d = decisions[i]
        return expression(d, {k: F.col(f"{k}{i}") for k in held[i]}, F.col(f"v{i}") if _parsed(d, held[i]) else None, how)

    if drop_empty:  # asked of whole arrays, so that the predicate names each of them once
        some = [F.exists(f"_g{k}", lambda x: x.isNotNull()) for k in shared]
        if shared:
            alone_ = [column(i).isNotNull() for i in alone]
            cells = cells.where(functools.reduce(operator.or_, [*some, *alone_]))
    out = cells.select(*keep, *[column(i).alias(f"c{i}") for i in range(len(names))])
    return out if shared or not drop_empty else out.dropna(how="all", subset=[f"c{i}" for i in range(len(names))])


def normalize(df: DataFrame, how: Normalizer | None = None, ordinal: str | None = None) -> tuple[DataFrame, list[Decision]]:
    """df with clean, typed columns, and the decisions; ordinal (row order) stays as the first column if it is given.

    Rows and columns that hold nothing any more go. An empty table keeps its columns as texts."""
    how = how or Normalizer()
    found = profile(df, ordinal, how)
    names, total = found.names, found.total
    decisions = [decide(n, i, found.first[i], total, found.seps, how) for i, n in enumerate(names)]
    uses = {"number": "sn", "serial_date": "sn", "text_date": "st", "any_date": "st", "timestamp": "t", "boolean": "b", "to_text": "snbt"}
    held = [{k for k in found.has[i] if total[f"{k}{i}"] and k in uses.get(d.kind, "s")} for i, d in enumerate(decisions)]
    kept = list(range(len(names)))
    drop = how.drop_empty and how.on("missing") and bool(names)
    if drop:
        empty = {i for i in kept if sum(total[f"{k}{i}"] for k in "nbtk") == 0}
        # dates that can't be read become null, so that a column may turn out empty
        empty |= {i for i in kept if decisions[i].kind in ("text_date", "any_date") and not total[f"d{i}"] and not total[f"t{i}"]}
        if len(empty) < len(kept) or any(total[f"{k}{i}"] for i in kept for k in "snbt"):
            kept = [i for i in kept if i not in empty]
    out = project(df, names, decisions, held, found.seps, how, ordinal, drop and bool(kept))
    out = out.select(*([ordinal] if ordinal else []), *[F.col(f"c{i}").alias(names[i]) for i in kept])
    return out, [decisions[i] for i in kept]


def contamination(kinds: dict[str, str], schema: T.StructType) -> list[dict[str, str]]:
    """Columns whose types contradict their kinds: numbers that are dates, texts or dates that are numbers."""
    out = []
    for name, kind in kinds.items():
        actual = schema[name].dataType
        is_date = isinstance(actual, (T.DateType, T.TimestampType, T.TimestampNTZType))
        is_number = isinstance(actual, T.NumericType)
        if kind == "DECIMAL" and is_date or kind in ("VARCHAR", "TIMESTAMP") and is_number:
            out.append({"column": name, "expected": kind, "actual": actual.simpleString()})
    return out


def analyze(df: DataFrame, ordinal: str | None = None) -> dict[str, Any]:
    """A dry run: kinds by names, contradictions, separators, and sizes."""
    how = Normalizer()
    found = profile(df, ordinal, how)
    names, seps = found.names, found.seps
    kinds = {n: k for n in names if (k := kind_of_name(n))}
    return {"type_hints": kinds, "contamination": contamination(kinds, df.schema), "decimal_separator": seps[0], "thousands_separator": seps[1], "rows": df.count(), "columns": len(names)}


__all__ = ["Decision", "Normalizer", "analyze", "contamination", "normalize"]
