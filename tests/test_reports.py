"""Report tables: sections in order, rows over lines, cells good, absent and bad."""

from loftline.sources import reports as R

TEXT = """Header  9  9  9
SCORING
 5i  1,204  −3.5  41.2%
prose that matches nothing at all here

7i  12  N/A  0%
PW  x1  inf  41.2
PUTTING
12.5%

4-6 ft  123  12' 6"
3 / 24
lost line
100%
6-8 ft  1  —
SCORING
9i  1  1  1%
"""
ONE = R.Layout("score", "SCORING", "PUTTING", (r"^(\S+)\s+(\S+)\s+(\S+)\s+(\S+)$",), (("club", "text"), ("n", "num"), ("miss", "num"), ("on", "pct")))
TWO = R.Layout("putts", "PUTTING", None, (r"^([\d.]+%)$", r"^(\S+) ft\s+(\d+)\s+(.+)$"), (("three", "pct"), ("range", "text"), ("n", "num"), ("leave", "feet")))


def rows(spark, text, layouts):
    return [(r.section, r.row_no, r.line_no, r.texts, r.numbers, r.bad) for r in R.report_rows(spark.createDataFrame([(1, text)], "id int, body string"), "id", "body", layouts).orderBy("section", "row_no").collect()]


def test_rows(spark):
    got = rows(spark, TEXT, [ONE, TWO])
    assert got == [("putts", 1, 8, {"range": "4-6"}, {"three": 0.125, "n": 123.0, "leave": 12.5}, []), ("putts", 2, 13, {"range": "6-8"}, {"three": 1.0, "n": 1.0, "leave": None}, []),
                   ("score", 1, 2, {"club": "5i"}, {"n": 1204.0, "miss": -3.5, "on": 0.41200000000000003}, []), ("score", 2, 5, {"club": "7i"}, {"n": 12.0, "miss": None, "on": 0.0}, []),
                   ("score", 3, 6, {"club": "PW"}, {"n": None, "miss": None, "on": 0.41200000000000003}, ["n", "miss"])]


def test_order_and_absence(spark):
    assert [r[0] for r in rows(spark, TEXT, [TWO, ONE])] == ["putts", "putts", "score"]   # scoring is looked for after putting
    assert rows(spark, "nothing", [ONE, TWO]) == [] and rows(spark, None, [ONE]) == [] and rows(spark, "", [ONE]) == []
    assert rows(spark, "SCORING", [ONE]) == []


def test_cells():
    assert [R.cell(x, "num") for x in ("1,000", "−2", "5%", "", "n/a", "1e400", "nan", "abc")] == [(1000.0, False), (-2.0, False), (None, True), (None, False), (None, False), (None, True), (None, True), (None, True)]
    assert [R.cell(x, "feet") for x in ("3'", '6"', "2' 3\"", "2", "'")] == [(3.0, False), (0.5, False), (2.25, False), (None, True), (None, True)]
