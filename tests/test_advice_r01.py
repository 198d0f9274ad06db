"""What the first review found missing in the grid operators."""

from gridloom.operators import detect


def test_long_sheets(spark):
    rows = {"goes on": [1, *range(50, 10_001, 50), 9_995, 10_300, 12_000], "stops": [*range(50, 9_991, 50), 9_990, 12_000], "late": [11_000], "short": [3, 4, 9, 10]}
    cells = spark.createDataFrame([(k, r, r % 7 + 1) for k, x in rows.items() for r in x], "sheet string, row int, col int")
    got = {r["sheet"]: tuple(r)[1:3] for r in detect.data_region(cells, ["sheet"]).collect()}
    assert got == {"goes on": (1, 12_000), "stops": (50, 9_990), "late": (1, 1), "short": (3, 10)}
    found = sorted(tuple(r) for r in detect.tables(cells.where("sheet in ('goes on', 'late', 'short')"), ["sheet"]).collect())
    assert found == [("goes on", 1, 1, 12_000), ("late", 1, 11_000, 11_000), ("short", 1, 3, 4), ("short", 2, 9, 10)]
