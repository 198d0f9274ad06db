"""Names, addresses and values: examples with fixed results."""

import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import names as N
from gridloom.functions import values as V
from gridloom.functions.refs import cell_ref_to_coords, column_index_to_letter, column_letter_to_index, coords_to_cell_ref, flatten, parse_range

NAMES = [("First Name", "first_name"), ("Amount ($)", "amount"), ("123-ID", "col_123_id"), ("firstName", "first_name"), ("XMLParser", "xml_parser"), ("P/O No.", "po_no"), ("", "unnamed"), (None, "unnamed"), ("nan", "unnamed"), ("select", "col_select"), ("Order", "col_order"), ("a__b", "a_b"), ("--", "unnamed"), ("Balance Qty.", "balance_qty"), ("getHTTPResponse", "get_http_response"), ("  x  ", "x"), ("Straße", "stra_e")]


@pytest.mark.parametrize(("given_name", "wanted"), NAMES)
def test_sanitize(given_name, wanted):
    assert N.sanitize_column_name(given_name) == wanted


def test_sanitize_as_expression(spark):
    rows = spark.createDataFrame([(n, w) for n, w in NAMES], "n string, w string")
    assert rows.select(N.sanitized(F.col("n")).alias("g"), "w").where("g <> w").collect() == []


@given(st.text())
def test_sanitized_names_are_valid(text):
    assert re.fullmatch(r"[a-z_][a-z0-9_]*", N.sanitize_column_name(text))
    assert len(N.sanitize_column_name(text * 50)) <= 300


def test_unique_names_never_collide():
    assert N.unique_names(["a", "a", "a_1", "a"]) == ["a", "a_2", "a_1", "a_3"]
    assert N.unique_names(["name", "name", "name"]) == ["name", "name_1", "name_2"]


@pytest.mark.parametrize(("name", "wanted"), [("created", True), ("order_date", False), ("expiration_date", False), ("start", True), ("year", False), ("birth_date", True), ("count", False)])
def test_suggests_date(name, wanted):
    assert N.suggests_date(name) is wanted


@pytest.mark.parametrize(("name", "wanted"), [("year", "DECIMAL"), ("birth_date", "TIMESTAMP"), ("customer_id", "VARCHAR"), ("unit_price", "DECIMAL"), ("city", None)])
def test_kind_of_name(name, wanted):
    assert N.kind_of_name(name) == wanted


def test_addresses():
    assert cell_ref_to_coords("Data!$B$3") == ("Data", 3, 2)
    assert coords_to_cell_ref(3, 28, "My Sheet") == "'My Sheet'!AB3"
    assert parse_range("S!A1:B2") == ("S", 1, 1, 2, 2)
    for bad in ("A", "1", "A1B"):
        with pytest.raises(ValueError):
            cell_ref_to_coords(bad)
    with pytest.raises(ValueError):
        parse_range("A1")
    assert all(column_letter_to_index(column_index_to_letter(i)) == i for i in range(1, 20000, 7))
    assert flatten([1, [2, ("x", [3])]]) == [1, 2, "x", 3]


NUMBERS = [("1,234.56", 1234.56), ("$1,234.56", 1234.56), ("(234.56)", -234.56), ("€ 5", 5.0), ("12d", None), ("1_000", None), ("", None), (None, None), ("CHF 3.5", 3.5), ("-7", -7.0), ("1e3", 1000.0)]


def test_numbers(spark):
    rows = spark.createDataFrame(NUMBERS, "s string, w double")
    assert [r[0] for r in rows.select(V.to_number(F.col("s"))).collect()] == [w for _, w in NUMBERS]
    mixed = spark.createDataFrame([("1.234,56", 1234.56), ("1,234.56", 1234.56), ("1,234", 1234.0), ("3,45", 3.45), ("x", None)], "s string, w double")
    assert [r[0] == r[1] for r in mixed.select(V.to_number_mixed(F.col("s")), "w").collect()] == [True] * 5


def test_white_space_missing_and_dates(spark):
    rows = spark.createDataFrame([("  hello    world ",), ("a b",), ("  ",), ("NA",), ("x\ny",)], "s string")
    assert [r[0] for r in rows.select(V.clean_whitespace(F.col("s"))).collect()] == ["hello world", "a b", "", "NA", "x y"]
    assert [r[0] for r in rows.select(V.clean_whitespace(F.col("s"), True)).collect()][-1] == "x\ny"
    assert [r[0] is None for r in rows.select(V.null_missing(F.col("s"))).collect()] == [False, False, True, True, False]
    dates = spark.createDataFrame([("2024-01-15",), ("15/01/2024",), ("January 5, 2024",), ("2024-02-30",), ("2024-01-15T10:30:00",)], "s string")
    assert [str(r[0]) for r in dates.select(V.as_any_date(F.col("s"))).collect()] == ["2024-01-15 00:00:00", "2024-01-15 00:00:00", "2024-01-05 00:00:00", "None", "2024-01-15 10:30:00"]
    serial = spark.createDataFrame([(45292.0,), (45293.5,)], "n double")
    assert [str(r[0]) for r in serial.select(V.serial_date(F.col("n"))).collect()] == ["2024-01-01 00:00:00", "2024-01-02 12:00:00"]
