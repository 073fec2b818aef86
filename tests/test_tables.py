"""Facts of HTML tables: hand-made statements, and the grid against a plain matrix."""

import random
from decimal import Decimal

import pytest

from filigree.operators.facts import pivot_facts, yoy_trend
from filigree.operators.tables import extract_facts, place_cells, table_facts, tables


def facts_of(spark, html):
    rows = table_facts(spark.createDataFrame([(1, html)], "id int, html string")).collect()
    return {(r.data_point, r.year): float(r.value) for r in rows}, len(rows)


HEAD = "<tr><td></td><td>2023</td><td>2022</td></tr>"


@pytest.mark.parametrize(("html", "expected"), [
    (f"<table>{HEAD}<tr><td>Cash</td><td>1,234.5</td><td>(6)</td></tr></table>", {("Cash", 2023): 1234.5, ("Cash", 2022): -6}),
    # The note nearest to the table counts; a row's own unit goes before it; percentages and rows per share have none.
    (f"<p>in thousands</p><table></table><p>(in millions, except per share amounts)</p><table>{HEAD}<tr><td>Cash</td><td>2</td><td>—</td></tr>"
     "<tr><td>Debt (in billions)</td><td>1</td><td>n.m.</td></tr><tr><td>Income per diluted share</td><td>$ 3.10</td><td>$(0.2)</td></tr>"
     "<tr><td>Growth</td><td>4 %</td><td>(5)%</td></tr></table>",
     {("Cash", 2023): 2e6, ("Debt (in billions)", 2023): 1e9, ("Income per diluted share", 2023): 3.1,
      ("Income per diluted share", 2022): -0.2, ("Growth", 2023): 4, ("Growth", 2022): -5}),
    # A heading ends with its total.
    (f"<table>{HEAD}<tr><td>Assets:</td></tr><tr><td>Cash</td><td>1</td><td>2</td></tr><tr><td>Total assets</td><td>3</td><td>4</td></tr>"
     "<tr><td>Employees</td><td>5</td><td>6</td></tr></table>",
     {("Assets / Cash", 2023): 1, ("Assets / Cash", 2022): 2, ("Assets / Total assets", 2023): 3, ("Assets / Total assets", 2022): 4,
      ("Employees", 2023): 5, ("Employees", 2022): 6}),
    # A later header row stands for its columns; years in a label are not periods; two amounts under one period are none.
    (f"<table>{HEAD}<tr><td>Notes due 2030</td><td>1</td><td>2</td></tr><tr><td></td><td>2021</td><td>2020</td></tr>"
     "<tr><td>Cash</td><td>3</td><td>4</td></tr></table>",
     {("Notes due 2030", 2023): 1, ("Notes due 2030", 2022): 2, ("Cash", 2021): 3, ("Cash", 2020): 4}),
    ("<table><tr><td></td><td colspan=2>2023</td></tr><tr><td></td><td>Q1</td><td>Q2</td></tr><tr><td>Cash</td><td>3</td><td>4</td></tr></table>", {}),
    (f"<table>{HEAD}<tr><td>Founded</td><td>1998</td><td></td></tr><tr><td></td><td>7</td><td>8</td></tr></table>", {("Founded", 2023): 1998}),
    (f"<table><tr><td rowspan=0>All</td><td>2023</td><td>2022</td></tr><tr><td>1</td><td>2</td></tr></table>", {("All", 2023): 1, ("All", 2022): 2}),
    ("<table><tr><td>no periods</td><td>12</td></tr></table><table></table><table><tr></tr></table><p>2023</p>", {}),
    (f"<table>{HEAD}<tr><td>Big</td><td>{'9' * 30}</td><td>1 2</td></tr></table>", {}),
    (None, {}), ("", {}), ("<table>", {}), ("<table><tr><td>2023", {}),
])
def test_facts(spark, html, expected):
    assert facts_of(spark, html) == (expected, len(expected))


def test_cells_meet_a_plain_matrix():
    draw = random.Random(2)
    for _ in range(300):
        rows = [[(draw.choice([1, 1, 2, 3, 0]), draw.randint(1, 3)) for _ in range(draw.randrange(5))] for _ in range(draw.randint(1, 6))]
        taken = set()
        for i, (cells, columns) in enumerate(zip(rows, place_cells(rows))):
            at = 0
            for (height, width), column in zip(cells, columns):
                while (i, at) in taken:
                    at += 1
                assert column == at
                taken |= {(y, x) for y in range(i, i + height if height else len(rows)) for x in range(at, at + width)}
                at += width


def test_inner_tables_only(spark):
    html = "<table><tr><td>a<table id='x'><tr><td>in</td></tr></table>b</td></tr></table> <TABLE ><TR><TH>x&amp;y<TD>z</TABLE>"
    found = tables(spark.createDataFrame([("k", html)], "table_key string, html string")).orderBy("table_no").collect()
    assert [[[c.text for c in row] for row in r["rows"]] for r in found] == [[["in"]], [["x&y", "z"]]]
    assert [c.head for c in found[1]["rows"][0]] == [True, False]


def test_the_newest_filing_gives_the_fact(spark):
    page = f"<table>{HEAD}<tr><td>Cash</td><td>%d</td><td>%d</td></tr><tr><td>Cash</td><td>-9</td><td>-9</td></tr></table>"
    rows = [("T", "1", "2023-02-01", page % (1, 2)), ("T", "2", "2024-02-01", page % (3, 4)), ("T", "3", None, page % (5, 6)),
            ("U", "4", None, page % (7, 8)), ("U", "5", None, page % (0, 10)), (None, None, None, None)]
    found = extract_facts(spark.createDataFrame(rows, "ticker string, accession_number string, filing_date string, html string"))
    assert {(r.ticker, r.year): r.value for r in found.collect()} == {
        ("T", 2023): Decimal(3), ("T", 2022): Decimal(4), ("U", 2023): Decimal(0), ("U", 2022): Decimal(10)}
    changes = {(r.ticker, r.year): r.pct_change for r in yoy_trend(found).collect()}
    assert changes == {("T", 2022): None, ("T", 2023): -25.0, ("U", 2022): None, ("U", 2023): -100.0}
    assert pivot_facts(found, ["Cash"], [2023]).count() == 2
    assert extract_facts(spark.createDataFrame(rows, "ticker string, accession_number string, filing_date string, html string").limit(0)).count() == 0
