"""Workbooks and text tables end to end."""

import io
import struct

import pytest

from gridloom.errors import FileError, FormatError
from gridloom.multisheet import analyze_excel, read_all_sheets
from gridloom.plans.config import SheetConfig
from gridloom.sources.ooxml import shifted, write_workbook
from gridloom.workbook import GridBook, read_excel, read_excel_tables


def rows(df):
    return [tuple(r) for r in df.collect()]


def book(rows, **kw):
    return io.BytesIO(write_workbook({"Data": rows}, **kw))


def test_messy_report(spark):
    data = book([["Monthly Sales Report"], ["Generated: 2024-01-15"], [], ["Product", "Q1 Sales", "Note"], ["Widget A", 1000, " a  b "], ["Widget B", 800, "NA"], [], ["Prepared by: me"]])
    df = read_excel(data)
    assert df.columns == ["product", "q1_sales", "note"] and dict(df.dtypes)["q1_sales"] == "bigint"
    assert rows(df) == [("Widget A", 1000, "a b"), ("Widget B", 800, None)]


def test_tables_hidden_merged_ranges(spark):
    two = book([["First Item", "First Value"], ["Alpha", 1], ["Beta", 2], [], [], ["Second Item", "Second Value"], ["Gamma", 3]])
    a, b = read_excel_tables(two)
    assert rows(a) == [("Alpha", 1), ("Beta", 2)] and rows(b) == [("Gamma", 3)]
    hid = [["name", "value"], ["Alice", 100], ["Bob", 200], ["Charlie", 300]]
    assert len(rows(read_excel(book(hid, hidden_rows={"Data": [3]})))) == 2
    assert len(rows(read_excel(book(hid, hidden_rows={"Data": [3]}), include_hidden=True))) == 3
    merged = book([["Region", "Q"], ["North", 1], [None, 2]], merges={"Data": ["A2:A3"]})
    assert rows(read_excel(merged)) == [("North", 1), ("North", 2)]
    assert rows(read_excel(merged, merge_strategy="first_only")) == [("North", 1), (None, 2)]
    assert rows(read_excel(book([["x"], ["a", "b"], ["1", "2"]]), cell_range="A2:B3")) == [(1, 2)]


def test_config_steps(spark):
    data = [["Name", "Amount", "Name"], ["Alice", "$1,234.56", "x"], ["Bob", "$7.00", "TOTAL"], ["Eve", "$1.50", "y"]]
    df = read_excel(book(data), column_renames={"amount": "usd"}, drop_regex="TOTAL", drop_conditions=[{"column": "name", "value": "Eve"}])
    assert df.columns == ["name", "usd", "name_1"] and rows(df) == [("Alice", 1234.56, "x")]
    assert dict(read_excel(book(data), type_hints={"Amount": "VARCHAR"}).dtypes)["amount"] == "string"
    config = SheetConfig(column_renames={"a": "b"})
    GridBook(book(data), config).to_dataframe()
    assert config == SheetConfig(column_renames={"a": "b"})
    dates = read_excel(book([["serial", "v"], [45292, 1], [45293, 2]]), type_hints={"serial": "TIMESTAMP"})
    assert [str(r[0]) for r in rows(dates)] == ["2024-01-01 00:00:00", "2024-01-02 00:00:00"]


def test_cells_and_formulas(spark):
    data = io.BytesIO(write_workbook({"S": [["A", "B", "Sum"], [10, 20, "=A2+B2"], [1, 2, "=A3*B3"]]}, formulas={"S": {"C2": 30}}))
    b = GridBook(data)
    cell = b.get_cell_by_ref("S!C2")
    assert cell.value == 30 and cell.formula == "=A2+B2" and b.get_cell("S", 3, 3).value == 2
    assert b["S"]["A1:B2"] == [["A", "B"], [10, 20]]
    assert rows(b.to_dataframe(config=SheetConfig(evaluate_formulas=False)))[0][2] == "=A2+B2"
    assert shifted(1, 1, 'A1+$B$2&"A1"', 2, 2) == 'B2+$B$2&"A1"'


def test_all_sheets(spark):
    data = io.BytesIO(write_workbook({"Sales": [["Product", "Price"], ["A", 1.5], ["B", 2.5]], "Empty": [], "Report": [["Printed Date: 2025-01-10"], [], ["Name", "Unit", "Salary"], ["Al", "HR", 100], ["Bo", "IT", 200]], "Summary": [["Row Labels", "Sum of Sales"], ["x", 1], ["y", 2]]}))
    found = {i.name: i for i in analyze_excel(data)}
    assert found["Empty"].is_empty and found["Summary"].is_pivot and found["Report"].header_row == 2
    frames = read_all_sheets(data)
    assert list(frames) == ["Sales", "Report"] and rows(frames["Report"]) == [("Al", "HR", 100), ("Bo", "IT", 200)]


def test_text_tables(spark):
    assert rows(read_excel(io.BytesIO(b"Report: Sales,\nGenerated: 2024-01-01,\nName,Amount\nAlice,10\nBob,20\n"))) == [("Alice", 10), ("Bob", 20)]
    assert rows(read_excel(io.BytesIO("Name;City\nJosé;\"A; B\"\nBob;LA\n".encode("latin-1")))) == [("José", "A; B"), ("Bob", "LA")]
    assert rows(read_excel(io.BytesIO(b"A,B,C\n1,2,3\n4,5\n6,7,8,9\n"))) == [(1, 2, 3), (4, 5, None)]


def test_bad_input(spark, tmp_path):
    with pytest.raises(FileError):
        GridBook(str(tmp_path / "none.xlsx"))
    for content in (b"", b"PK\x03\x04junk"):
        with pytest.raises(FormatError):
            GridBook(io.BytesIO(content), filename="x.xlsx")
    text = tmp_path / "text.xlsx"
    text.write_text("a,b\n1,2\n")
    with pytest.raises(FormatError):
        GridBook(str(text))


def test_streamed_directory(spark, tmp_path):
    from gridloom.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.xlsx").write_bytes(write_workbook({"D": [["x"], [1]]}))
    (tmp_path / "in/b.txt").write_text("no workbook")
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def legacy_book(strings, cells):
    """A BIFF8 workbook in an OLE2 container: strings for the table, split over a CONTINUE record; (row, col, record, body)."""
    rec = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    bof = lambda t: rec(0x809, struct.pack("<HHHHII", 0x600, t, 0, 0, 0, 0))
    xfs = rec(0xE0, struct.pack("<HH", 0, 0)) + rec(0xE0, struct.pack("<HH", 0, 14))
    table = struct.pack("<II", len(strings), len(strings)) + b"".join(struct.pack("<HB", len(s), 1) + s.encode("utf-16-le") for s in strings)
    cut = 8 + 3 + 2  # after the first character of the first string
    sst = rec(0xFC, table[:cut]) + rec(0x3C, b"\x01" + table[cut:])
    sheet = bof(0x10) + b"".join(rec(kind, struct.pack("<HHH", r, c, x) + body) for r, c, x, kind, body in cells) + rec(0xE5, struct.pack("<HHHHH", 1, 0, 0, 3, 4)) + rec(0x0A, b"")
    name = b"Old"
    head = lambda at: bof(5) + xfs + rec(0x85, struct.pack("<IBBBB", at, 0, 0, len(name), 0) + name) + sst + rec(0x0A, b"")
    stream = head(len(head(0))) + sheet
    stream = stream.ljust(4608, b"\0")
    n = len(stream) // 512
    fat = [0xFFFFFFFD, 0xFFFFFFFE, *range(3, 2 + n), 0xFFFFFFFE]
    entry = lambda name, kind, start, size: name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<II", start, size) + b"\0" * 4
    directory = entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("Workbook", 2, 2, len(stream)) + b"\0" * 256
    header = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<IIIIIIIII", 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0, 0) + b"\xff" * 432
    return header[:512] + struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff") + directory + stream


def test_legacy_workbook(spark):
    number = lambda x: struct.pack("<d", x)
    text = lambda i: struct.pack("<I", i)
    cells = [(0, 0, 0, 0xFD, text(0)), (0, 1, 0, 0xFD, text(1)), (0, 2, 0, 0xFD, text(2)), (1, 0, 0, 0xFD, text(3)), (1, 1, 0, 0x203, number(1.5)), (1, 2, 1, 0x203, number(45292)), (2, 0, 0, 0xFD, text(4)), (2, 1, 0, 0x27E, struct.pack("<I", (250 << 2) | 3)), (2, 2, 1, 0x27E, struct.pack("<I", (45293 << 2) | 2))]
    data = io.BytesIO(legacy_book(["Näme", "Value", "Day", "Alice", "Bob"], cells))
    b = GridBook(data)
    assert b.sheet_names == ["Old"] and str(b.format_type) == "xls"
    df = b.to_dataframe()
    assert df.columns == ["n_me", "value", "day"]
    assert [(r[0], r[1], str(r[2])) for r in df.collect()] == [("Alice", 1.5, "2024-01-01 00:00:00"), ("Bob", 2.5, "2024-01-02 00:00:00")]
    with pytest.raises(FormatError):
        GridBook(io.BytesIO(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"x" * 30))


def test_handlers_fall_back_and_tell_their_sheets(spark):
    from gridloom.plans.config import FormatInfo, FormatType
    from gridloom.workbook import Handler, Registry

    class Broken(Handler):
        def can_handle(self, kind):
            return kind == FormatType.UNKNOWN

        def get_sheet_names(self, source):
            raise ValueError("no names")

        def validate(self, source):
            return False, "not mine"

    class Lines(Broken):
        def get_sheet_names(self, source):
            return ["one", "two"]

        def validate(self, source):
            return True, None

        def parse(self, spark, source, sheet):
            lines = source.read_bytes().decode("latin-1").split("|")
            return spark.createDataFrame([(i + 1, f"{x}{sheet if i else ''}") for i, x in enumerate(lines)], "row int, c0 string"), 1

    class Detector:
        def detect(self, handle):
            return FormatInfo(FormatType.UNKNOWN, 0.5)

    registry = Registry([Broken()], Detector())
    with pytest.raises(ValueError):
        GridBook(io.BytesIO(b"x|a"), registry=registry)
    registry.register_handler(Lines())
    with GridBook(io.BytesIO(b"name|a|b"), registry=registry) as found:
        assert found.sheet_names == ["one", "two"]
        assert rows(found.to_dataframe("two", SheetConfig(header_detection_mode="manual", header_rows=1))) == [("atwo",), ("btwo",)]
    with pytest.raises(FormatError, match="not mine"):
        Registry([Broken()]).read(FormatType.UNKNOWN, spark, None or type("S", (), {"description": "x"})(), "one")


def test_wide_sheets_share_expressions_and_agree_with_narrow_ones(spark):
    from gridloom.operators import normalize as N

    head = [f"Field {i}" for i in range(60)]
    data = [[f" a{r}  {i}" if i % 4 == 0 else r * i if i % 4 == 1 else f"1.{r}{i},50" if i % 4 == 2 else ("NA" if i < 30 else f"2024-01-{r + 10}") for i in range(60)] for r in range(9)] + [[None] * 60, ["NA"] * 60]
    wide = read_excel(book([head, *data]))
    try:
        N.SHARED, before = 1000, N.SHARED
        narrow = read_excel(book([head, *data]))
        assert wide.schema == narrow.schema and rows(wide) == rows(narrow) and len(rows(wide)) == 9
    finally:
        N.SHARED = before
    assert dict(wide.dtypes)["field_1"] == "bigint" and "field_3" not in wide.columns
