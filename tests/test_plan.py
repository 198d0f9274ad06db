"""The plan's decision table, the structure cache, sniffing and formulas: no Spark."""

import io

import pytest

from gridloom.errors import CircularReferenceError, FormatError, StructureError, UnsupportedFunctionError
from gridloom.functions.formula import FormulaEngine
from gridloom.plans.cache import StructureCache
from gridloom.plans.config import FormatType, FormulaConfig, MergeStrategy, SheetConfig, StructureInfo, TableInfo
from gridloom.plans.parse_plan import compile_plan, separators_of
from gridloom.plans.structure import footer_of, tables_of
from gridloom.sources.handle import SourceHandle
from gridloom.sources.sniff import detect_delimiter, detect_format, rows_above

X = FormatType.XLSX


def found(**kw):
    return StructureInfo(**({"header_row": 4, "header_rows_count": 1, "header_confidence": 0.9, "data_end_row": 20} | kw))


def test_header_modes():
    assert compile_plan(SheetConfig(), found(), X).skip_rows == 3
    assert compile_plan(SheetConfig(skip_rows=1), found(), X).skip_rows == 1
    assert compile_plan(SheetConfig(header_detection_mode="auto", skip_rows=1), found(), X).skip_rows == 3
    assert compile_plan(SheetConfig(header_detection_mode="manual"), found(), X).skip_rows == 0
    assert compile_plan(SheetConfig(), found(header_confidence=0.7), X).skip_rows == 3
    assert compile_plan(SheetConfig(), found(hidden_rows=[1, 9]), X).skip_rows == 2
    weak = found(header_confidence=0.2)
    assert compile_plan(SheetConfig(header_detection_mode="auto", header_fallback="none", skip_rows=2), weak, X).header_rows == 0
    with pytest.raises(StructureError):
        compile_plan(SheetConfig(header_detection_mode="auto", header_fallback="error"), weak, X)


def test_footer_merges_hidden_separators():
    two = found(num_tables=2, table_ranges=[TableInfo(4, 10, 1, 3), TableInfo(13, 20, 1, 3)], suggested_skip_footer=1)
    assert compile_plan(SheetConfig(), two, X).skip_footer == 10
    assert compile_plan(SheetConfig(skip_footer=2), two, X).skip_footer == 2
    assert compile_plan(SheetConfig(cell_range="A1:B2"), two, X).skip_footer == 0
    assert compile_plan(SheetConfig(), found(), X).merge_strategy == MergeStrategy.SKIP
    assert not compile_plan(SheetConfig(), found(), X).drop_hidden
    assert compile_plan(SheetConfig(locale="de_DE"), None, X).decimal_separator == ","
    assert compile_plan(SheetConfig(thousands_separator=" "), found(), X).decimal_separator is None
    assert separators_of("de_CH") == (".", "'") and separators_of("fr_FR") == (",", " ")
    for bad in ({"skip_rows": -1}, {"header_confidence_threshold": 2}, {"merge_strategy": "x"}):
        with pytest.raises(ValueError):
            SheetConfig(**bad)


def test_tables_and_footer():
    assert [(t.start_row, t.end_row) for t in tables_of([1, 2, 3, 6, 7, 9], 1, 2, 1, 0.9)] == [(1, 3), (6, 9)]
    assert tables_of([1, 2, 4], 1, 2, 1, 0.9)[0].confidence == 0.9
    assert footer_of({8: "data", 10: "notes: x"}, 1, 10) == 2
    assert footer_of({10: "total 5"}, 1, 10) == 0


def test_cache_evicts_the_oldest():
    c = StructureCache(2)
    for i in range(3):
        c.put(("p", i), i)
    assert c.get(("p", 0)) is None and c.get(("p", 2)) == 2
    c.invalidate("p")
    assert len(c) == 0


def test_sniffing():
    assert detect_format(b"a,b\n1,2\n").format_type == FormatType.CSV
    assert detect_format(b"a\tb\n1\t2\n").format_type == FormatType.TSV
    assert detect_format(b"PK\x03\x04junk", "x.xlsx").format_type == FormatType.XLSX
    assert detect_format(bytes(range(1, 9)) * 20).format_type == FormatType.UNKNOWN
    with pytest.raises(FormatError):
        detect_format(b"")
    assert detect_delimiter(["a;b;c", "1;2;3"])[0] == ";"
    assert rows_above([["Report: Sales", ""], ["Generated: 2024", ""], ["Name", "Amount"], ["A", "1"], ["B", "2"]]) == 2
    assert rows_above([["a", "b"], ["1", "2"]]) == 0


class Once(io.BytesIO):
    def seekable(self):
        return False


def test_sources_are_replayed_and_left_alone():
    stream = io.BytesIO(b"abcdef")
    stream.seek(3)
    h = SourceHandle(stream)
    assert h.read_bytes() == b"abcdef" and stream.tell() == 3 and not stream.closed
    once = SourceHandle(Once(b"xyz"))
    assert once.read_bytes() == once.read_bytes() == b"xyz"
    h.close()
    with pytest.raises(ValueError):
        h.read_bytes()
    with pytest.raises(TypeError):
        SourceHandle(5)


def test_formulas():
    cells = {("S", 1, 1): (2, None), ("S", 2, 1): (3, None), ("S", 3, 1): (None, "SUM(A1:A2)*2"), ("S", 4, 1): (None, 'IF(A3>=10,"big","small")'), ("S", 5, 1): (None, "A6"), ("S", 6, 1): (None, "A5"), ("S", 7, 1): (None, "NOPE(1)"), ("S", 8, 1): (None, "A1/0"), ("S", 9, 1): (None, "-2^2+50%")}
    cell = lambda s, r, c: cells.get((s, r, c), (None, None))
    e = FormulaEngine(cell)
    assert e.evaluate("S", 3, 1) == 10 and e.evaluate("S", 4, 1) == "big" and e.evaluate("S", 8, 1) == "#DIV/0!" and e.evaluate("S", 9, 1) == 4.5
    assert e.evaluate("S", 7, 1) == "#UNSUPPORTED"
    with pytest.raises(CircularReferenceError):
        e.evaluate("S", 5, 1)
    with pytest.raises(UnsupportedFunctionError):
        FormulaEngine(cell, FormulaConfig(raise_unsupported=True)).evaluate("S", 7, 1)
    assert FormulaEngine(cell, FormulaConfig(circular_strategy="iterate")).evaluate("S", 5, 1) == 0
    e.register_function("NOPE", lambda x: x + 1)
    assert e.evaluate("S", 7, 1) == 2
