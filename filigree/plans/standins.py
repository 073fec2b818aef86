"""How the driver tables stand in for filings, questions and histories.

The tables hold invented prose, so the finance words of `rules` hardly occur in it. The
dictionaries below have the same shape and words that do occur.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree import rules as R
from filigree.functions import text as X
from filigree.functions.chunking import chunk_rows
from filigree.operators.conversation import clean_history, format_history
from filigree.operators.ranks import numbered
from filigree.session import materialize, open_uri, scratch_path

TOPICS = {
    "revenue": ["thble", "heitlich"],
    "growth": ["tion", "keit"],
    "risks": ["with", "avec"],
    "products": ["thtion", "para"],
    "strategy": ["that", "sich"],
    "financial": ["from", "von den"],
    "innovation": ["ther", "ción"],
}
PATTERNS = {
    "comparison": ["thble", "chein"],
    "trend": ["with", "avec"],
    "recommendation": ["that", "die der"],
    "explanation": ["from", "qui"],
    "listing": ["ther", "una"],
}
WORDS = ["thble", "tion", "with", "that", "from", "thtion", "ther"]
ROUTING = ["thtion", "with", "avec"]
RULES = R.FollowupRules(
    topics=TOPICS, patterns=PATTERNS, names=["tion", "heit"], tickers=["ING", "ENT", "OU"],
    sections=["risk factors", "with", "avec"], peers=["ING", "ENT", "OU", "src1", "src2"],
)
AGENT = R.AgentRules(
    topics=["revenue", *WORDS], history_topics=["growth", "tion", "that", "with", "risk"],
)
HINTS = [(["thble", "ein"], " [hint one]"), (["tion"], " [hint two]"), (["from", "avec"], " [hint three]")]
ANSWER_SECTIONS = ["That", "With", "From", "Avec", "Para"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, most: int = 64) -> DataFrame:
    """Spread a scan of few partitions over all cores before costly work on its rows.

    A small table may sit in one row group and keep one core busy. A scan of `most` or more
    partitions is left as it is, so no large table is ever shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, most) else df


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for costly row work: small ones sit in one row group."""
    return spread(table(spark, sf_dir, name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_table(spark, sf_dir, "documents")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))


def selection() -> Column:
    """No, one or two companies, by conversation."""
    one, two = F.lit("src1"), F.lit("src2")
    kind = F.col("conv_id") % 3
    none = F.expr("cast(array() as array<string>)")
    return F.when(kind == 0, none).when(kind == 1, F.array(one)).otherwise(F.array(one, two))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user message as a request."""
    users = messages(spark, sf_dir).filter(F.col("role") == "user")
    return users.select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"), "conv_id", "turn",
        F.col("content").alias("query"), selection().alias("companies"),
    )


def every_question(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every user message as a request of its own, answered by the message after it if that is a reply, and its history.

    The history is what a client sends along: the last messages before the question, by their place in the conversation.
    Requests and messages meet on conversation and place, so a long conversation is no group of its own.
    """
    every = format_history(clean_history(messages(spark, sf_dir)))
    every = materialize(numbered(every, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("content")]), "numbered")
    key = F.concat_ws("-", "conv_id", "pos")
    users = every.filter("role = 'user'")
    replies = every.filter("role = 'assistant'").select("conv_id", (F.col("pos") - 1).alias("pos"), F.col("content").alias("reply"))
    requests = users.join(replies, ["conv_id", "pos"], "left").select(
        key.alias("query_id"), key.alias("conv_id"), F.col("content").alias("query"), selection().alias("companies"),
        F.coalesce("reply", F.lit("")).alias("answer"),
    )
    places = F.explode(F.sequence(F.greatest(F.col("pos") - R.HISTORY_WINDOW, F.lit(0)), F.col("pos") - 1))
    before = users.filter("pos > 0").select(key.alias("_key"), "conv_id", places.alias("pos")).join(every, ["conv_id", "pos"])
    return requests, before.select(F.col("_key").alias("conv_id"), F.col("pos").alias("turn"), "role", "content")


def section_of() -> Column:
    return F.when(F.col("n_chars") > 1000, "Risk Factors").otherwise("Business")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut into chunks with metadata."""
    rows = documents(spark, sf_dir).select(
        "doc_id", F.col("source").alias("ticker"), F.col("lang").alias("filing_type"),
        F.col("doc_id").cast("string").alias("accession_number"), section_of().alias("section"), "text",
    )
    cut = chunk_rows(rows)
    key = [F.col(c) for c in ("ticker", "filing_type", "accession_number", "section", "chunk_index")]
    return cut.select(
        X.chunk_id(*key).alias("chunk_id"), "content",
        X.chunk_metadata(
            F.col("ticker"), F.lit(""), F.col("filing_type"), F.lit(None).cast("string"),
            F.col("accession_number"), F.col("section"), F.col("chunk_index"),
        ).alias("metadata"),
        "ticker",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, with the document of the same number as content."""
    texts = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("vec_id"), F.col("text").alias("content"), "source", "lang", section_of().alias("section"),
    )
    rows = table(spark, sf_dir, "embeddings").join(texts, "vec_id", "left")
    ticker = F.col("label").cast("string")
    return rows.select(
        F.col("vec_id").alias("chunk_id"), ticker.alias("ticker"), "embedding", F.coalesce("content", F.lit("")).alias("content"),
        X.chunk_metadata(
            ticker, F.concat(F.lit("Company "), ticker), F.col("lang"), F.lit(None).cast("string"),
            F.col("vec_id").cast("string"), F.col("section"), F.lit(0),
        ).alias("metadata"),
    )


def vector_requests(spark: SparkSession, sf_dir: str, filtered: bool) -> DataFrame:
    """Every embedding as a request; filtered ones see their own label and the next."""
    label = F.col("label")
    own = F.array(label.cast("string"), ((label + 1) % 10).cast("string"))
    companies = own if filtered else F.lit(None).cast("array<string>")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), companies.alias("companies"), "embedding"
    )


def accession() -> Column:
    """An accession number for an order; orders in process get an invalid one."""
    number = F.concat_ws(
        "-", F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.date_format("o_orderdate", "yy"),
        F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0"),
    )
    return F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("P-"), F.col("o_orderkey").cast("string"))).otherwise(number)


def filing_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of a filing tree."""
    return spread_table(spark, sf_dir, "orders").select(F.concat(
        F.lit("file:/data/sec-edgar-filings/C"), F.col("o_custkey").cast("string"), F.lit("/10-K/"),
        accession(), F.lit("/primary.htm"),
    ).alias("path"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly order values by priority."""
    value = F.col("o_totalprice").cast("decimal(18,2)")
    return table(spark, sf_dir, "orders").groupBy(
        F.lit("ALL").alias("ticker"), F.col("o_orderpriority").alias("data_point"), F.year("o_orderdate").alias("year")
    ).agg(F.sum(value).cast("decimal(18,2)").alias("value"))


def filing_tree(spark: SparkSession, sf_dir: str) -> str:
    """All pages as files of a filing tree: pages, full submissions, and every fifth filing without a document."""
    root = scratch_path(spark, "tree")
    number = F.col("page_id").cast("string")
    kind = F.col("page_id") % 5
    name = F.when(kind == 0, "exhibit.pdf").when(kind == 1, "full-submission.txt").otherwise("primary.htm")
    marks = "<p>\u00a0Item&#160;1A.&nbsp;Risk Factors</p><p>risk &#8211; of "
    page = F.replace("html", F.lit("</article>"), F.concat(
        F.lit(marks), number, F.lit("</p><p>Item 7. Discussion</p><p>talk &ldquo;of&rdquo; "), number, F.lit("</p></article>")))
    page = F.when(F.col("page_id") % 7 == 0, F.lit("<p>no items here</p>")).otherwise(page)
    wrapped = F.concat(
        F.lit("<SEC-HEADER>x</SEC-HEADER>\n<DOCUMENT>\n<TYPE>10-K\n<TEXT>\n"), page,
        F.lit("</TEXT></DOCUMENT>\n<DOCUMENT><TYPE>EX-1<TEXT>Item 7. Exhibit\nof no use</TEXT></DOCUMENT>"))
    files = table(spark, sf_dir, "pages").select(
        F.concat(
            F.lit("/sec-edgar-filings/P"), (F.col("page_id") % 20).cast("string"), F.lit("/10-K/"),
            F.lpad(number, 10, "0"), F.lit("-21-"), F.lpad((F.col("page_id") % 1000000).cast("string"), 6, "0"), F.lit("/"), name,
        ).alias("path"),
        F.encode(F.when(kind == 1, wrapped).otherwise(page), "utf-8").alias("data"),
    )

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(*(column.to_pylist() for column in batch.columns)):
                fs, top = open_uri(root)
                fs.create_dir(f"{top}{path}".rpartition("/")[0], recursive=True)
                with fs.open_output_stream(f"{top}{path}") as out:
                    out.write(data)
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["path"])

    files.mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()
    return root


def filers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The companies of `filing_tree`."""
    ticker = F.concat(F.lit("P"), (F.col("page_id") % 20).cast("string"))
    return table(spark, sf_dir, "pages").select(ticker.alias("ticker"), F.concat(F.lit("Name "), ticker).alias("name")).distinct()


def _amount(value: Column) -> Column:
    """A whole number as statements print it: thousands apart, negative ones in brackets."""
    shown = F.format_number(F.abs(value), 0)
    return F.when(value < 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)


def statement_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as filings with a statement of one of four layouts in their article, with numbers that follow from the page."""
    n = F.col("page_id")
    sales, before, gain, loss = n * 1000 + 37, n * 900 + 11, n * 7 + 3, -(n * 10 + 5)

    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    plain = text(
        "<p>Selected data (in thousands, except per share data)</p><table border=1><tr><th></th><th>2023</th><th>2022</th></tr>",
        "<tr><td>Revenue</td><td>$ ", _amount(sales), "</td><td>$ ", _amount(before), "</td></tr>",
        "<tr><td>Net income (loss)</td><td>", _amount(loss), "</td><td>", _amount(gain), "</td></tr>",
        "<tr><td>Earnings per share</td><td>1.25</td><td>(0.50)</td></tr><tr><td>Margin</td><td>12.5%</td><td>&mdash;</td></tr></table>")
    split = text(
        "<TABLE class='f'>\n<TR>\n<TD>(in millions)<TD colspan=\"6\">Year ended December 31,</TR>",
        "<tr><td>&nbsp;</td><td colspan='3'>2023</td><td colspan='3'>2022</td></tr>",
        "<tr><td>Revenue</td><td>$</td><td>", _amount(sales), "</td><td></td><td>$</td><td>", _amount(before), "</td><td></td></tr>",
        "<tr><td>Net income (loss)</td><td></td><td>(", F.format_number(-loss, 0), "</td><td>)</td><td></td><td>", _amount(gain), "</td><td></td></tr></TABLE>")
    grouped = text(
        "<table><caption>Segments, $ billions</caption><tr><td rowspan=2>Segment</td><td colspan=2>Fiscal year</td></tr>",
        "<tr><td>2023</td><td>2022</td></tr><tr><td>Net sales:</td><td></td><td></td></tr>",
        "<tr><td>Products</td><td>", n.cast("string"), ".5</td><td>2</td></tr><tr><td>Services</td><td rowspan='2'>3</td><td>4</td></tr>",
        "<tr><td>Total net sales</td><td>6</td></tr><tr><td>Employees (in thousands)</td><td>", _amount(gain), "</td><td>8</td></tr></table>")
    nested = text(
        "<table><tr><td>Outer 2023</td><td>99</td></tr><tr><td><!-- <table> --><table><tr><th>Item</th><th>Fiscal 2023</th><th>2023 vs 2022</th></tr>",
        "<tr><td>Revenue<sup>(1)</sup></td><td>&euro;", _amount(sales), "</td><td>4%</td></tr>",
        "<tr><td>Net&nbsp;income (loss)</td><td>&#8722;", F.format_number(-loss, 0), "</td><td>n/a</td></tr>",
        "<tr><td>Revenue</td><td>7</td><td></td></tr></table></td></tr></table>")
    kind = n % 4
    statement = F.when(kind == 0, plain).when(kind == 1, split).when(kind == 2, grouped).otherwise(nested)
    number = n.cast("string")
    return spread_table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("P"), (n % 20).cast("string")).alias("ticker"), F.lpad(number, 10, "0").alias("accession_number"),
        F.when(n % 3 > 0, F.concat(F.lit("2024-0"), (F.floor(n / 20) % 9 + 1).cast("string"), F.lit("-01"))).alias("filing_date"),
        F.replace("html", F.lit("</article>"), F.concat(statement, F.lit("</article>"))).alias("html"))
