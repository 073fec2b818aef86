"""Numeric facts from the HTML tables of filings.

A page is cut at its tables, a table into rows and cells, and the cells are placed on the table's grid, where row and
column spans count. Header rows name periods: a header cell with one year stands for the columns it spans, until a
header cell further down stands for one of them. A row's label is what lies left of the first period. The texts that a
row has below one period are read as one amount, since filings give the currency sign, the number and a closing
bracket cells of their own.

Everything but the placing on the grid is column expressions, and a table is one row until its facts leave it, so
nothing is shuffled but facts.

Defined results: of a table that holds other tables, only the inner ones are read. Amounts in brackets or behind a dash
are negative; a lone dash, a blank or other words are no fact. Units ("in thousands", "$ millions", "(000s)") come from the
row's label, else from a row without amounts, else from the text before the table; they do not apply to percentages and to rows per share. A label
that ends with a colon and has no amounts heads the rows below it, up to a row that begins with "Total". Two amounts
under one period, or a cell of several years, are no fact. A null or empty page has no table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filigree.functions.text import decode_entities, plain_blanks, years_in_text

#: Characters of text before a table in which its unit may be given.
NOTE_CHARS = 600
#: Widest and highest spans, as browsers read them.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
UNIT = (
    r"(?i)\bin\s+(?:us\s+|u\.s\.\s+)?(?:dollars\s+in\s+)?(?:\$\s*)?(thousand|million|billion)s?\b"
    r"|[$(]\s*(thousand|million|billion)s?\b|\b(thousand|million|billion)s\s+of\s+(?:u\.?s\.?\s+)?dollars\b|(000)'?s?\)"
)
SCALES = {"thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000, "000": 1_000}
#: A number once blanks, commas and currency signs are gone.
AMOUNT = r"^(?:\(-?|-)?(\d+(?:\.\d+)?|\.\d+)(?:%?\)|\)?%)?$"
FACT_KEY = ["ticker", "data_point", "year"]


def place_cells(rows: list[list[tuple[int, int]]]) -> list[list[int]]:
    """Grid column of every cell, given the height and width of the cells of each row; height 0 reaches the last row."""
    free_at: dict[int, int] = {}
    out = []
    for i, cells in enumerate(rows):
        column, placed = 0, []
        for height, width in cells:
            while free_at.get(column, 0) > i:
                column += 1
            placed.append(column)
            for c in range(column, column + width):
                free_at[c] = max(free_at.get(c, 0), i + height if height else len(rows))
            column += width
        out.append(placed)
    return out


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def grid_columns(spans: pd.Series) -> pd.Series:
    """Grid columns of tables, whose spans are texts: rows by `;`, cells by blanks, a cell as height`x`width."""
    def of(text: str) -> list[list[int]]:
        return place_cells([[tuple(map(int, cell.split("x"))) for cell in row.split()] for row in text.split(";")])

    return spans.map(of)


def plain_text(html: Column) -> Column:
    """Text of a piece of markup in one line; superscripts (marks of footnotes) are left out."""
    out = F.regexp_replace(F.regexp_replace(html, r"(?is)<sup\b[^>]*>.*?</sup>", ""), r"<[^>]*>", " ")
    # Most cells have no entity, and decoding them is most of the work.
    out = F.when(F.contains(html, F.lit("&")), decode_entities(out)).otherwise(out)
    return F.trim(F.regexp_replace(plain_blanks(out), r"\s+", " "))


def _span(attributes: Column, name: str, most: int) -> Column:
    given = F.regexp_extract(attributes, rf"(?i)\b{name}\s*=\s*[\"']?(\d{{1,6}})", 1).try_cast("int")
    return F.least(F.coalesce(given, F.lit(1)), F.lit(most))


def _cell(piece: Column) -> Column:
    attributes = F.substring_index(piece, ">", 1)
    inner = F.regexp_replace(F.split(piece, r"(?i)</t[dh]\b", 2)[0], r"^[^>]*>", "")
    return F.struct(
        F.lower(F.substring(piece, 1, 1)).eqNullSafe(F.lit("h")).alias("head"),
        _span(attributes, "rowspan", MOST_ROWS).alias("height"),
        F.greatest(_span(attributes, "colspan", MOST_COLUMNS), F.lit(1)).alias("width"),
        plain_text(inner).alias("text"),
    )


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """`rows` with columns that are evaluated once. A column of a plain projection would be put into every lambda that names it."""
    held = F.inline(F.array(F.struct(*[column.alias(name) for name, column in columns.items()])))
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in columns], held)


def tables(documents: DataFrame, html_col: str = "html") -> DataFrame:
    """(other columns, table_no, note, rows): the innermost tables of every page. `rows`: arrays of (head, height, width, text)."""
    others = [F.col(f"`{c}`") for c in documents.columns if c != html_col]
    clean = F.regexp_replace(F.col(f"`{html_col}`"), r"(?s)<!--.*?-->", "")
    cut = settled(documents.select(*others, clean.alias("_page")), _page=F.split("_page", r"(?i)<table\b"))
    parts = F.transform("_page", lambda p, i: F.struct(p.alias("piece"), F.when(i > 0, F.col("_page")[i - 1]).alias("before")))
    rows = cut.where(F.size("_page") > 1).select(*others, F.posexplode(parts).alias("table_no", "_p")).where("table_no > 0")
    rows = rows.where(F.col("_p.piece").rlike(r"(?i)</table\b")).select(
        *others, "table_no", F.regexp_replace(F.split("_p.piece", r"(?i)</table\b", 2)[0], r"^[^>]*>", "").alias("_body"),
        F.element_at(F.split("_p.before", r"(?i)</table\b[^>]*>"), -1).alias("_before"))
    caption = F.regexp_extract("_body", r"(?is)<caption\b[^>]*>(.*?)</caption>", 1)
    note = F.concat_ws(" ", plain_text(F.right(F.col("_before"), F.lit(NOTE_CHARS))), plain_text(caption))
    cut = F.transform(
        F.slice(F.split("_body", r"(?i)<tr\b"), 2, 1 << 30),
        lambda row: F.transform(F.slice(F.split(row, r"(?i)<t(?=[dh]\b)"), 2, 1 << 30), _cell))
    return rows.select(*others, "table_no", note.alias("note"), cut.alias("rows"))


def clean_amount(text: Column) -> Column:
    """A text without what only dresses a number: blanks, commas and currency signs; every dash is a minus."""
    return F.regexp_replace(F.regexp_replace(text, "[−–—‒]", "-"), r"[\s,$€£¥]", "")


def is_amount(text: Column) -> Column:
    return clean_amount(text).rlike(AMOUNT) & ~text.rlike(r"\d\s+\d")


def gridded(found: DataFrame) -> DataFrame:
    """`tables` with `grid` in place of `rows`: the cells each row of the grid meets, those from above included."""
    others = [F.col(f"`{c}`") for c in found.columns if c != "rows"]
    spans = F.array_join(F.transform("rows", lambda row: F.array_join(
        F.transform(row, lambda c: F.concat(c["height"].cast("string"), F.lit("x"), c["width"].cast("string"))), " ")), ";")
    placed = found.where(F.size("rows") > 0).withColumn("_columns", grid_columns(spans))

    def row_cells(row: Column, i: Column) -> Column:
        return F.transform(row, lambda c, j: F.struct(
            i.alias("row"), F.when(c["height"] == 0, F.lit(MOST_ROWS)).otherwise(i + c["height"]).alias("until"),
            F.col("_columns")[i][j].alias("column"), (F.col("_columns")[i][j] + c["width"]).alias("end"),
            c["head"].alias("head"), c["text"].alias("text"), is_amount(c["text"]).alias("amount"), years_in_text(c["text"]).alias("years")))

    placed = settled(placed, _own=F.transform("rows", row_cells))
    placed = settled(placed, _high=F.filter(F.flatten("_own"), lambda c: c["until"] > c["row"] + 1))

    def met(row: Column, i: Column) -> Column:
        above = F.filter("_high", lambda c: (c["row"] < i) & (c["until"] > i))
        return F.array_sort(F.concat(row, above), lambda a, b: a["column"] - b["column"])

    return settled(placed, grid=F.transform("_own", met)).select(*others, "grid")


def _is_header(row: Column) -> Column:
    """A row that names periods: years and no other amounts, and not one year beside an ordinary label."""
    cells = F.filter(row, lambda c: (c["column"] > 0) & (c["text"] != ""))
    named = F.filter(cells, lambda c: F.size(c["years"]) == 1)
    amounts = F.exists(cells, lambda c: c["amount"] & ~c["text"].rlike(r"^\d{4}$"))
    label = F.array_join(F.transform(F.filter(row, lambda c: c["column"] == 0), lambda c: c["text"]), " ")
    heads = ~F.exists(row, lambda c: ~c["head"] & (c["text"] != ""))
    plain = (label == "") | label.rlike(UNIT) | label.rlike(r"(?i)\b(?:ended|fiscal|as of|years?)\b")
    return (F.size(named) > 0) & ~amounts & (plain | heads | (F.size(named) > 1))


def _unit(text: Column, last: bool) -> Column:
    """The unit a text gives, its first or last one; null without."""
    found = F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))
    name = F.regexp_extract(F.lower(F.element_at(F.when(F.size(found) > 0, found), -1 if last else 1)), "thousand|million|billion|000", 0)
    return F.create_map(*[F.lit(x) for pair in SCALES.items() for x in pair])[name]


def table_facts(documents: DataFrame, html_col: str = "html") -> DataFrame:
    """(other columns, table_no, row_no, column_no, data_point, year, value): every fact of every table.

    A heading above the row is put before its label: `Net sales / Products`.
    """
    others = [F.col(f"`{c}`") for c in documents.columns if c != html_col]
    found = gridded(tables(documents, html_col))
    named = F.flatten(F.transform("grid", lambda row, i: F.when(_is_header(row), F.transform(
        F.filter(row, lambda c: (c["column"] > 0) & (F.size(c["years"]) == 1)),
        lambda c: F.struct(i.alias("row"), c["column"].alias("column"), c["end"].alias("end"), c["years"][0].alias("year")),
    )).otherwise(F.expr("cast(array() as array<struct<row:int,column:int,end:int,year:int>>)"))))
    heads = F.filter("grid", lambda row: ~F.exists(row, lambda c: c["amount"] & ~c["text"].rlike(r"^\d{4}$")))
    words = F.array_join(F.transform(heads, lambda row: F.array_join(F.transform(row, lambda c: c["text"]), " ")), "\n")
    scale = F.coalesce(_unit(words, False), _unit(F.col("note"), True), F.lit(1))
    found = settled(found.select(*others, "table_no", "note", "grid"), _periods=named, _scale=scale).where(F.size("_periods") > 0)

    def line(row: Column, i: Column) -> Column:
        above = F.filter("_periods", lambda h: h["row"] < i)
        left = F.array_min(F.transform(above, lambda h: h["column"]))
        label = F.array_join(F.transform(F.filter(row, lambda c: (c["end"] <= left) & (c["text"] != "")), lambda c: c["text"]), " ")
        amounts = F.exists(row, lambda c: (c["column"] >= left) & c["amount"])
        open_ = F.filter(above, lambda h: ~F.exists("_periods", lambda g: (
            (g["row"] > h["row"]) & (g["row"] < i) & (g["column"] < h["end"]) & (h["column"] < g["end"]))))
        return F.struct(
            i.alias("row"), F.coalesce(label, F.lit("")).alias("label"), F.coalesce(amounts, F.lit(False)).alias("amounts"),
            open_.alias("periods"), F.transform(row, lambda c: F.struct(c["column"].alias("column"), c["text"].alias("text"))).alias("cells"))

    found = settled(found, _lines=F.transform("grid", line)).drop("grid", "note", "_periods")
    heading = F.filter("_lines", lambda r: ~r["amounts"] & r["label"].endswith(":"))
    total = F.filter("_lines", lambda r: r["amounts"] & r["label"].rlike(r"(?i)^total\b"))
    found = settled(
        found, _headings=F.transform(heading, lambda r: F.struct(r["row"].alias("row"), r["label"].alias("label"))),
        _totals=F.transform(total, lambda r: r["row"]))

    def headed(r: Column) -> Column:
        """The line with its heading, unless a total lies between them."""
        last = F.array_max(F.filter("_headings", lambda h: h["row"] < r["row"]))
        closed = F.exists("_totals", lambda t: (t < r["row"]) & (t > last["row"]))
        return F.struct(
            r["row"].alias("row"), r["label"].alias("label"), F.when(~closed, last["label"]).alias("heading"),
            r["periods"].alias("periods"), r["cells"].alias("cells"))

    data = F.filter("_lines", lambda r: r["amounts"] & (r["label"] != ""))
    rows = found.select(*others, "table_no", "_scale", F.explode(F.transform(data, headed)).alias("_line"))
    rows = rows.select(
        *others, "table_no", F.col("_line.row").alias("row_no"), "_scale", F.col("_line.label").alias("_label"),
        F.col("_line.heading").alias("_heading"), F.col("_line.cells").alias("_cells"), F.explode("_line.periods").alias("_period"))
    below = F.filter("_cells", lambda c: (c["column"] >= F.col("_period.column")) & (c["column"] < F.col("_period.end")))
    rows = settled(rows, _below=F.transform(below, lambda c: c["text"])).drop("_cells")
    numbers = F.size(F.filter("_below", lambda c: c.rlike(r"\d")))
    raw = F.array_join("_below", "")
    rows = rows.where(numbers == 1).where(~raw.rlike(r"\d\s+\d")).withColumn("_raw", clean_amount(raw)).where(F.col("_raw").rlike(AMOUNT))
    bare = F.col("_raw").contains("%") | F.col("_label").rlike(r"(?i)\bper\b.*\bshare\b")
    factor = F.when(bare, 1).otherwise(F.coalesce(_unit(F.col("_label"), True), F.col("_scale")))
    number = F.regexp_extract("_raw", AMOUNT, 1).try_cast("decimal(24,6)") * factor.cast("decimal(10,0)")
    value = F.when(F.col("_raw").rlike(r"^[(-]"), -number).otherwise(number).try_cast("decimal(18,2)")

    def name(label: Column) -> Column:
        return F.regexp_replace(label, r"\s*:\s*$", "")

    point = F.concat_ws(" / ", name(F.col("_heading")), name(F.col("_label")))
    return rows.select(
        *others, "table_no", "row_no", F.col("_period.column").alias("column_no"), point.alias("data_point"), F.col("_period.year").alias("year"), value.alias("value"),
    ).where("value is not null")


def extract_facts(documents: DataFrame, html_col: str = "html") -> DataFrame:
    """(ticker, data_point, year, value): one value for each company, data point and year, as `pivot_facts` and `yoy_trend` take them.

    `documents`: ticker, accession_number, filing_date and the page. Of several values the one from the newest filing is taken, in
    it the first one of the first table, by rows.
    """
    key = ["ticker", "accession_number", "filing_date"]
    found = table_facts(documents.select(*key, F.col(f"`{html_col}`").alias("html")))
    date = F.coalesce(F.col("filing_date").cast("string"), F.lit(""))
    order = F.struct(date, F.coalesce("accession_number", F.lit("")), -F.col("table_no"), -F.col("row_no"), -F.col("column_no"), "value")
    return found.groupBy(*FACT_KEY).agg(F.max_by("value", order).alias("value"))
