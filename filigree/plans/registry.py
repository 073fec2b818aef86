"""Registered queries: every operator over the whole driver tables.

Array results are joined to text, so that rows compare as plain values.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree import rules as R
from filigree.functions import prompts as P
from filigree.functions import sets as S
from filigree.functions import text as X
from filigree.functions.chunking import chunk_rows
from filigree.functions.matching import word_tags
from filigree.operators import cells as M
from filigree.operators import chunks as C
from filigree.operators import context as K
from filigree.operators import conversation as V
from filigree.operators import dictionary as J
from filigree.operators import facts as N
from filigree.operators import lookup as H
from filigree.operators import postings as Z
from filigree.operators import retrieval as Q
from filigree.operators import routing as G
from filigree.operators import suggestions as U
from filigree.operators import tables as T
from filigree.operators import terms as W
from filigree.operators import textops as O
from filigree.plans import ingest as Y
from filigree.plans import standins as D
from filigree.plans.ask import agent_responses, history_lines
from filigree.plans.ask import ask as ask_flow
from filigree.session import materialize, scratch_path
from filigree.sources import collection as L
from filigree.sources import companies as B
from filigree.sources import filings as E
from filigree.sources import tree as A
from filigree.streaming import history_stream as HS
from filigree.streaming import ingest_stream as I

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def line(array: Column | str) -> Column:
    """An array as text; null and empty arrays read the same."""
    return F.coalesce(F.array_join(array, "|"), F.lit(""))


def _responses(rows: DataFrame) -> DataFrame:
    sources = F.transform("citations", lambda c: F.concat_ws("/", c["company"], c["ticker"], c["filing"], c["section"]))
    return rows.select("query_id", "answer", line(sources).alias("citations"), line("suggested_queries").alias("suggested_queries"))


# -- sources ---------------------------------------------------------------


@query
def list_filings(spark, sf):
    return E.list_filings(E.parse_paths(D.filing_paths(spark, sf)))


@query
def company_filings(spark, sf):
    companies = D.table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("ticker"), F.col("c_name").alias("name")
    )
    return E.company_filings(E.parse_paths(D.filing_paths(spark, sf)), companies, ["10-K"])


@query
def pick_primary_document(spark, sf):
    number = F.col("l_linenumber").cast("string")
    name = (
        F.when(F.col("l_linenumber") == 1, F.lit("full-submission.txt"))
        .when(F.col("l_returnflag") == "A", F.concat(F.lit("b"), number, F.lit(".HTM")))
        .when(F.col("l_returnflag") == "R", F.concat(F.lit("a"), number, F.lit(".html")))
        .otherwise(F.concat(F.lit("exhibit"), number, F.lit(".pdf")))
    )
    folder = F.concat(F.lit("/sec-edgar-filings/T/10-K/"), F.col("l_orderkey").cast("string"), F.lit("/"))
    files = D.spread_table(spark, sf, "lineitem").select(F.concat(folder, name).alias("path"))
    return E.pick_primary_document(E.parse_paths(files)).select("accession_number", "file_name")


@query
def latest_filings(spark, sf):
    rows = D.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return E.latest(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 2).select("o_custkey", "o_orderkey")


@query
def list_companies(spark, sf):
    dimension = D.table(spark, sf, "supplier").select(
        F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("ticker"), F.col("s_name").alias("name")
    )
    chunks = D.table(spark, sf, "documents").select(F.col("source").alias("ticker"), F.upper("source").alias("company"))
    return B.list_companies(chunks, dimension)


@query
def search_companies(spark, sf):
    companies = D.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("ticker"), F.col("c_name").alias("name"))
    return B.search_companies(companies, "7 (AUTO")


@query
def search_companies_typed(spark, sf):
    """Names of parts as companies, and for every part what a user may type: its first word, for most with letters wrong or missing."""
    companies = D.table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("ticker"), F.col("p_name").alias("name"))
    word = F.regexp_extract("p_name", r"(\w+)", 1)
    wrong = F.concat(F.substring(word, 1, 2), F.substring(word, 4, 3), F.lit("x"), F.substring(word, 7, 20))
    typed = D.table(spark, sf, "part").select(
        F.col("p_partkey").alias("search_id"), F.when(F.col("p_partkey") % 4 == 0, word).otherwise(wrong).alias("text"))
    return H.search_many(companies, typed, 5)


@query
def selectable_company(spark, sf):
    selections = D.table(spark, sf, "events").select("event_id", F.col("user_id").alias("ticker"))
    customers = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("ticker"))
    return B.selectable_company(selections, customers).select("event_id", "ticker")


@query
def company_display_name(spark, sf):
    names = D.table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("ticker"), F.col("n_name").alias("display")
    )
    nation = F.col("c_nationkey") + F.when(F.col("c_custkey") % 3 == 0, 100).otherwise(0)  # a third is unknown
    rows = D.table(spark, sf, "customer").select("c_custkey", nation.cast("string").alias("ticker"))
    return B.company_display_name(rows, names)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return L.open_collection(spark, path).select("chunk_id", "content", "ticker", "metadata.section", "metadata.chunk_index")


@query
def write_chunks(spark, sf):
    """Written twice: the second run adds nothing."""
    path = scratch_path(spark, "collection")
    for _ in range(2):
        L.write_chunks(D.chunks(spark, sf), path)
    return _stored(spark, path)


@query
def ingest_stream(spark, sf):
    schema = D.table(spark, sf, "documents").schema
    documents = I.read_document_stream(spark, f"{sf}/documents[.]parquet", schema).select(
        F.col("source").alias("ticker"), F.col("lang").alias("filing_type"),
        F.col("doc_id").cast("string").alias("accession_number"), F.lit("").alias("company"),
        F.lit(None).cast("string").alias("filing_date"), "text",
    )
    path = scratch_path(spark, "collection")
    I.ingest_stream(documents, path, scratch_path(spark, "stream"), targets=None)
    return _stored(spark, path)


@query
def read_document(spark, sf):
    """Texts as bytes of another encoding, so that accented letters are not UTF-8."""
    data = F.encode("text", "ISO-8859-1")
    return D.table(spark, sf, "documents").select("doc_id", X.valid_utf8(data).alias("text"))


EVERY = 1_000_000_000


@query
def read_documents(spark, sf):
    """A tree of files, of which the primary ones are opened; here as plain text."""
    found = Y.filing_documents(spark, D.filing_tree(spark, sf), D.filers(spark, sf), ["10-K"], EVERY)
    return found.select("ticker", "accession_number", "company", "file_name", F.length("text").alias("n_chars"))


@query
def ingest(spark, sf):
    """A tree of files to chunks of two sections, written twice: the second run adds nothing."""
    tree, path = D.filing_tree(spark, sf), scratch_path(spark, "collection")
    for _ in range(2):
        Y.ingest(spark, tree, D.filers(spark, sf), path, ["10-K"], EVERY)
    return _stored(spark, path)


@query
def ingest_report(spark, sf):
    tree, path = D.filing_tree(spark, sf), scratch_path(spark, "collection")
    return Y.ingest(spark, tree, D.filers(spark, sf), path, ["10-K"], EVERY).drop("filing_type")


@query
def filing_tree(spark, sf):
    """Every file of the tree, listed by tasks."""
    found = A.filing_tree(spark, D.filing_tree(spark, sf))
    return found.select("ticker", "filing_type", "accession_number", "file_name")


@query
def filing_tree_stream(spark, sf):
    """The same files by a stream that is started twice."""
    root, seen, state = D.filing_tree(spark, sf), scratch_path(spark, "seen"), scratch_path(spark, "state")
    for _ in range(2):
        stream = A.filing_tree_stream(spark, root, 0).select("ticker", "filing_type", "accession_number", "file_name")
        started = stream.writeStream.format("parquet").option("path", seen).option("checkpointLocation", state).trigger(availableNow=True).start()
        started.awaitTermination()
    return spark.read.parquet(seen)


@query
def valid_accession(spark, sf):
    orders = D.table(spark, sf, "orders").select("o_orderkey", D.accession().alias("accession"))
    return orders.select("o_orderkey", E.valid_accession(F.col("accession")).alias("valid"))


@query
def filter_companies(spark, sf):
    return Q.filter_companies(D.chunks(spark, sf), ["src3", "src5"]).select("chunk_id", "ticker")


@query
def embed(spark, sf):
    @F.pandas_udf("array<float>")
    def lengths(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(n), float(e)] for n, e in zip(texts.str.len(), texts.str.count("e"))])

    vectors = Q.embed(D.chunks(spark, sf), lengths)
    return vectors.select("chunk_id", *[F.col("embedding")[i].cast("int").alias(n) for i, n in enumerate(("n_chars", "n_e"))])


# -- scalar and text -------------------------------------------------------


@query
def filing_url(spark, sf):
    name = F.concat(F.lit("/tree/x/"), F.lower("o_orderstatus"), F.lit(".htm"))
    return D.table(spark, sf, "orders").select("o_orderkey", X.filing_url(D.accession(), name).alias("url"))


@query
def html_to_text(spark, sf):
    return _marked_pages(spark, sf).select("page_id", X.html_to_text(F.col("html")).alias("text"))


def _marked_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with a paragraph of entities at the end of their article."""
    marks = "<p>&#8220;a&#x201D;&#xa0;&ndash; &#128512;&rsquo;s &amp;lt; &#0; &#xD800; &unknown;</p></article>"
    return D.spread_table(spark, sf, "pages").withColumn("html", F.replace("html", F.lit("</article>"), F.lit(marks)))


@query
def extract_sections(spark, sf):
    body = F.concat(
        F.lit("Contents\nItem 1A. Risk Factors\nITEM 7. Discussion\n\u00a0Item\u00a01A.\u3000Risk Factors\n"), F.col("text"),
        F.lit("\n \u2003item\u00a07. Discussion\n"), F.col("lang"), F.lit(" "), F.col("text"), F.lit("\nItem 8. Statements\nnone"),
    )
    filings = D.documents(spark, sf).select("doc_id", body.alias("text"))
    return C.extract_sections(filings)


@query
def extract_sections_by_sequence(spark, sf):
    """Filings with a contents page, references at the start of lines, headings that repeat, and one without item 7."""
    text = F.col("text")
    contents = F.lit("Contents\nItem 1A. Risk Factors ..... 3\nItem 7. Discussion\t21\nItem 8 Statements     40\n\nItem 1. Business\nwe sell\n")
    risks = F.concat(F.lit("ITEM 1A.\n"), text, F.lit("\nItem 7 of this report, and\nItem 8, which follows\nend of risks\nItem 1B. None\n-\n"))
    talk = F.concat(F.lit("Item 7. Discussion\n"), F.col("lang"), F.lit(" "), text, F.lit("\nItem 1A. Risk Factors\nas above\n"))
    rest = F.lit("Item 7A. Market risk\nrates\nItem 8. Statements\nsee\nItem 7. Discussion\nfor more")
    body = F.concat(contents, risks, F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(talk), rest)
    return C.extract_sections(D.documents(spark, sf).select("doc_id", body.alias("text")))


@query
def chunk_text(spark, sf):
    return chunk_rows(D.table(spark, sf, "documents").select("doc_id", "text"))


@query
def chunk_text_snapped(spark, sf):
    return chunk_rows(D.table(spark, sf, "documents").select("doc_id", "text"), snap=True)


@query
def chunk_text_recursive(spark, sf):
    return chunk_rows(D.table(spark, sf, "documents").select("doc_id", "text"), snap="recursive")


@query
def chunk_counts(spark, sf):
    return C.chunk_counts(D.chunks(spark, sf))


@query
def process_filing(spark, sf):
    pages = _marked_pages(spark, sf).select(
        F.regexp_extract("url", r"//([^.]+)\.", 1).alias("ticker"), F.lit("10-K").alias("filing_type"),
        F.col("page_id").cast("string").alias("accession_number"), F.lit("").alias("company"),
        F.lit("").alias("filing_date"), X.html_to_text(F.col("html")).alias("text"),
    )
    rows = C.process_filing(pages, targets=None)
    return rows.select("chunk_id", "content", "metadata.company", "metadata.date", "metadata.section", "metadata.chunk_index")


@query
def filing_label(spark, sf):
    date = F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return D.table(spark, sf, "orders").select("o_orderkey", X.filing_label(F.col("o_orderpriority"), date).alias("filing"))


@query
def company_label(spark, sf):
    return D.table(spark, sf, "supplier").select(
        "s_suppkey", X.company_label(F.col("s_name"), F.col("s_suppkey").cast("string")).alias("label")
    )


@query
def chunk_metadata(spark, sf):
    return D.chunks(spark, sf).select("metadata.*")


@query
def format_context_block(spark, sf):
    return D.chunks(spark, sf).select("chunk_id", X.context_block(F.col("metadata"), F.col("content")).alias("block"))


@query
def annotate_user_message(spark, sf):
    return V.annotate_user_message(D.messages(spark, sf).withColumn("companies", D.selection())).select("conv_id", "turn", "content")


@query
def extract_years(spark, sf):
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    content = F.concat(F.lit("in "), date, F.lit(", after "), (F.year("o_orderdate") - 3).cast("string"),
                       F.lit(" and not in 123"), F.col("o_orderkey").cast("string"), F.lit(" or 1899"))
    stored = F.when(F.col("o_orderstatus") == "O", F.lit("Unknown")).otherwise(date)
    return D.spread_table(spark, sf, "orders").select(
        "o_orderkey", X.year_of_date(stored).cast("string").alias("filing_year"),
        line(F.transform(X.years_in_text(content), lambda y: y.cast("string"))).alias("years"),
    )


@query
def strip_selection_tag(spark, sf):
    tagged = V.annotate_user_message(D.messages(spark, sf).withColumn("companies", D.selection()))
    twice = tagged.withColumn("annotated", F.col("content")).withColumn(
        "content", F.concat(F.lit(" \u00a0\n"), F.col("content"), F.lit(" (Companies selected: kept)\u3000\t"))
    )
    return V.strip_selection_tag(twice).select("conv_id", "turn", "annotated", "content")


# -- retrieval -------------------------------------------------------------


@query
def lexical_search(spark, sf):
    requests = D.questions(spark, sf).withColumn("companies", F.lit(None).cast("array<string>"))
    return Q.lexical_search(Q.term_index(D.chunks(spark, sf)), requests).select("query_id", "rank", "score", "chunk_id")


@query
def stored_search(spark, sf):
    """The hits of `lexical_search` from a stored index, which is extended once."""
    chunks, path = D.chunks(spark, sf), scratch_path(spark, "terms")
    late = F.xxhash64("chunk_id") % 3 == 0
    Z.add_terms(chunks.where(~late), path)
    Z.refresh(spark, path)
    Z.add_terms(chunks.where(late), path)
    Z.refresh(spark, path)
    requests = D.questions(spark, sf).withColumn("companies", F.lit(None).cast("array<string>"))
    return Z.stored_search(Z.open_terms(spark, path), requests, chunks).select("query_id", "rank", "score", "chunk_id")


@query
def retrieve_sections(spark, sf):
    asked = D.questions(spark, sf)
    blank = asked.withColumns({"query_id": F.concat("query_id", F.lit("-blank")), "query": F.lit(" \n\u00a0")})
    requests = asked.union(blank)
    return Q.retrieve_sections(Q.term_index(D.chunks(spark, sf)), requests).select("query_id", "rank", "score", "chunk_id")


def _neighbours(spark: SparkSession, sf: str, k: int, filtered: bool = False) -> DataFrame:
    return Q.knn_search(D.vectors(spark, sf), D.vector_requests(spark, sf, filtered), k)


@query
def knn_search(spark, sf):
    return _neighbours(spark, sf, 3).select("query_id", "rank", "score", "chunk_id")


@query
def knn_odd_vectors(spark, sf):
    """Some vectors have a null or a NaN element: these have no hits and are none, for any k."""
    kind = F.col("vec_id") % 7
    broken = F.when(kind == 1, F.lit(None).cast("double")).otherwise(F.lit(float("nan")))
    odd = F.transform("embedding", lambda x, i: F.when((i == 3) & kind.isin(1, 2), broken).otherwise(x.cast("double")))
    rows = D.table(spark, sf, "embeddings").select("vec_id", odd.alias("embedding"))
    vectors = rows.select(F.col("vec_id").alias("chunk_id"), F.lit("T").alias("ticker"), "embedding")
    requests = rows.select(F.col("vec_id").alias("query_id"), F.lit(None).cast("array<string>").alias("companies"), "embedding")
    found = [Q.knn_search(vectors, requests, k).select(F.lit(k).alias("k"), "query_id", "rank", "chunk_id") for k in (1, 3, 20)]
    return found[0].union(found[1]).union(found[2])


@query
def knn_filtered(spark, sf):
    return _neighbours(spark, sf, 3, True).select("query_id", "rank", "score", "chunk_id", "metadata.ticker")


def _clustered(spark: SparkSession, sf: str, filtered: bool) -> DataFrame:
    vectors = D.vectors(spark, sf)
    index = M.build_cells(vectors, scratch_path(spark, "cells"))
    return M.knn_clustered(index, D.vector_requests(spark, sf, filtered), vectors).select("query_id", "rank", "score", "chunk_id")


@query
def knn_clustered(spark, sf):
    """The hits of `knn_search` from the index of cells."""
    return _clustered(spark, sf, False)


@query
def knn_clustered_filtered(spark, sf):
    return _clustered(spark, sf, True)


# -- context and citations -------------------------------------------------


@query
def assemble_context(spark, sf):
    requests = D.table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"))
    return K.assemble_context(requests, _neighbours(spark, sf, 3))


@query
def dedupe_citations(spark, sf):
    return K.dedupe_citations(_neighbours(spark, sf, 8, True))


@query
def citation_ordinal(spark, sf):
    return K.dedupe_citations(_neighbours(spark, sf, 5)).select("query_id", "ord", "section")


@query
def build_responses(spark, sf):
    """Documents as requests and answers; those without an embedding have no hit."""
    requests = D.table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("answer"), "lang")
    hits = materialize(_neighbours(spark, sf, 3), "hits")
    suggestions = requests.filter("lang = 'en'").select("query_id", F.array("lang").alias("suggested_queries"))
    return _responses(K.build_responses(requests, requests, hits, K.dedupe_citations(hits), suggestions))


@query
def source_counts(spark, sf):
    return K.source_counts(K.dedupe_citations(_neighbours(spark, sf, 8, True)))


@query
def collect_metadata(spark, sf):
    found = K.collect_metadata(_neighbours(spark, sf, 5))
    return found.select("query_id", line("sections").alias("sections"), line("entities").alias("entities"))


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    """Eight neighbours as three tool steps; the middle one is no retrieval."""
    hits = _neighbours(spark, sf, 8, True)
    step = F.floor((F.col("rank") - 1) / 3).cast("int")
    tool = F.when(F.col("step_no") == 1, F.lit(R.COMPARER_TOOL)).otherwise(F.lit(R.RETRIEVER_TOOL))
    grouped = hits.withColumn("step_no", step).groupBy("query_id", "step_no").agg(
        F.array_sort(F.collect_list(F.struct("rank", "content", "metadata"))).alias("r")
    )
    result = F.transform("r", lambda x: F.struct(x["content"].alias("content"), x["metadata"].alias("metadata")))
    return grouped.select("query_id", "step_no", tool.alias("tool"), result.alias("results"))


@query
def agent_citations(spark, sf):
    return K.agent_citations(_steps(spark, sf))


@query
def trace_profile(spark, sf):
    found = U.trace_profile(_steps(spark, sf), D.AGENT.topics)
    return found.select("query_id", *[line(c).alias(c) for c in ("tools", "sections", "topics")])


@query
def fallback_citations(spark, sf):
    answers = D.table(spark, sf, "documents").select(
        F.col("doc_id").alias("query_id"), F.col("text").alias("answer"),
        F.when(F.col("lang") != "es", F.array("source", "lang", "source")).alias("companies"),
    )
    return K.fallback_citations(answers, D.ANSWER_SECTIONS)


# -- routing and tags ------------------------------------------------------


@query
def valid_query(spark, sf):
    kind = F.col("turn") % 4
    answered = F.when(kind == 0, F.col("content")).when(kind == 1, F.lit(" \n\t")).when(kind == 2, F.lit("\u00a0\u3000\x1c"))
    return Q.valid_query(D.messages(spark, sf).withColumn("query", answered)).select("conv_id", "turn", "query")


@query
def normalize_companies(spark, sf):
    rows = D.table(spark, sf, "documents").select("doc_id", "source", F.array("source", "lang").alias("listed"), "n_chars")
    kinds = dict(rows.dtypes)
    return rows.select("doc_id", *[
        line(Q.normalize_companies(F.col(c), kinds[c])).alias(c) for c in ("source", "listed", "n_chars")
    ])


@query
def route_query(spark, sf):
    return G.route_query(D.questions(spark, sf), D.ROUTING).select("query_id", "to_agent")


@query
def route_query_default(spark, sf):
    documents = D.table(spark, sf, "documents").select("doc_id", F.col("text").alias("query"), F.array("source").alias("companies"))
    return G.route_query(documents).select("doc_id", "to_agent")


@query
def flag_complex_query(spark, sf):
    return G.flag_complex_query(D.questions(spark, sf), D.ROUTING).select("query_id", "is_complex", "timeout_ms")


@query
def tag_topics(spark, sf):
    found = G.tag_topics(D.table(spark, sf, "documents").select("doc_id", "text"), dictionary=D.TOPICS)
    return found.select("doc_id", line("topics").alias("topics"))


@query
def tag_topics_default(spark, sf):
    found = G.tag_topics(D.table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", line("topics").alias("topics"))


@query
def tag_query_patterns(spark, sf):
    found = G.tag_query_patterns(D.questions(spark, sf), patterns=D.PATTERNS)
    return found.select("query_id", *[f"is_{name}" for name in D.PATTERNS])


@query
def tag_mentions(spark, sf):
    found = G.tag_mentions(D.messages(spark, sf), names=D.RULES.names, tickers=D.RULES.tickers, sections=D.RULES.sections)
    return found.select("conv_id", "turn", line("companies_named").alias("companies_named"), line("sections_named").alias("sections_named"))


@query
def tag_agent_topics(spark, sf):
    found = G.tag_agent_topics(D.table(spark, sf, "documents"), "text", D.AGENT.topics)
    return found.select("doc_id", line("topics").alias("topics"))


@query
def match_rules(spark, sf):
    return G.match_rules(D.table(spark, sf, "documents").select("doc_id", "text"), dictionary=D.TOPICS)


@query
def match_dictionary(spark, sf):
    """Keywords cut from every document, as a table, against all documents."""
    cut = F.concat(F.lit("r"), (F.col("doc_id") % 40).cast("string"))
    word = F.substr("text", F.lit(3) + F.col("doc_id") % 7, (F.lit(2) + F.col("doc_id") % 11).cast("int"))
    documents = D.documents(spark, sf).select("doc_id", "text")
    return J.match_dictionary(documents, documents.select(cut.alias("rule"), word.alias("word")))


# -- conversations ---------------------------------------------------------


def _raw_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of which some lack a content or are still pending."""
    content = F.when(F.length("text") % 5 > 0, F.col("text"))
    return D.table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", content.alias("text"), (F.length("text") % 7 == 0).alias("is_loading")
    )


@query
def clean_history(spark, sf):
    return V.clean_history(V.normalize_history(_raw_messages(spark, sf), "text"))


@query
def normalize_history(spark, sf):
    return V.normalize_history(_raw_messages(spark, sf), "text")


@query
def drop_loading(spark, sf):
    return V.drop_loading(_raw_messages(spark, sf)).select("conv_id", "turn")


@query
def format_history(spark, sf):
    return V.format_history(D.messages(spark, sf))


@query
def last_n_messages(spark, sf):
    recent = V.last_n_messages(V.format_history(V.clean_history(D.messages(spark, sf))), 3)
    return recent.select("conv_id", "turn", "role", "content")


@query
def compose_history(spark, sf):
    """Annotated messages of which some are pending, as the history of the next request."""
    shown = V.annotate_user_message(D.messages(spark, sf).withColumn("companies", D.selection()))
    return V.compose_history(shown.withColumn("is_loading", F.length("content") % 7 == 0), 3).select("conv_id", "turn", "role", "content")


@query
def history_profile(spark, sf):
    found = V.history_profile(D.messages(spark, sf), D.RULES, 3)
    return found.select("conv_id", *[line(c).alias(c) for c in ("topics", "companies", "sections", "asked")])


@query
def history_stream(spark, sf):
    """Profiles of the histories that a stream of all messages has kept."""
    schema = D.table(spark, sf, "conversations").schema
    arrived = I.read_document_stream(spark, f"{sf}/conversations[.]parquet", schema).withColumnRenamed("text", "content")
    path = scratch_path(spark, "histories")
    HS.history_stream(arrived, path, scratch_path(spark, "stream"))
    found = V.history_profile(HS.latest(spark, path), D.RULES)
    return found.select("conv_id", *[line(c).alias(c) for c in ("topics", "companies", "sections", "asked")])


@query
def user_topics(spark, sf):
    return V.user_topics(D.messages(spark, sf), D.WORDS).select("conv_id", line("topics").alias("topics"))


@query
def priority_topics(spark, sf):
    every = D.messages(spark, sf)
    asked = V.user_topics(every, D.WORDS).select("conv_id", F.col("topics").alias("history"))
    answered = every.filter("role = 'assistant'").withColumn("role", F.lit("user"))
    content = V.user_topics(answered, D.WORDS)
    none = F.expr("cast(array() as array<string>)")
    both = asked.join(content, "conv_id", "full").select(
        "conv_id", F.coalesce("history", none).alias("history"), F.coalesce("topics", none).alias("topics"))
    return both.select("conv_id", line(S.priority_topics(F.col("history"), F.col("topics"))).alias("topics"))


@query
def missing_sections(spark, sf):
    found = word_tags(F.lower("text"), D.WORDS)
    return D.table(spark, sf, "documents").select("doc_id", line(S.missing_sections(found, D.WORDS)).alias("missing"))


@query
def other_companies(spark, sf):
    discussed = F.array(F.concat(F.lit("src"), (F.col("doc_id") % 7).cast("string")), F.lit("OU"))
    others = S.other_companies(F.col("source"), F.when(F.col("lang") == "en", discussed).otherwise(F.array("source")), D.RULES.peers)
    return D.table(spark, sf, "documents").select("doc_id", line(others).alias("others"))


@query
def union_suggestions(spark, sf):
    low = F.lower("text")
    lists = [word_tags(low, D.WORDS[:4]), F.array(F.lit("from"), F.when(F.col("lang") == "en", F.lit("with"))), word_tags(low, D.WORDS[2:])]
    return D.table(spark, sf, "documents").select("doc_id", line(S.union_suggestions(*lists)).alias("texts"))


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of user messages, offered to their own conversation and to the next one."""
    users = D.messages(spark, sf).filter("role = 'user'")
    cut = users.select("conv_id", "turn", F.posexplode(O.sentences(F.col("content"))).alias("pos", "text"))
    return cut.select(
        F.col("conv_id").alias("from_conv"), "turn", "pos",
        F.explode(F.array("conv_id", F.col("conv_id") + 1)).alias("conv_id"), "text",
    )


@query
def drop_asked_questions(spark, sf):
    return U.drop_asked_questions(_candidates(spark, sf), D.messages(spark, sf))


@query
def drop_asked_comparisons(spark, sf):
    pairs = F.array(*[F.struct(F.lit(a).alias("company"), F.lit(b).alias("other"))
                      for a, b in [("Thble", "With"), ("ION", "ther"), ("avec", "Que"), ("Ein", "ung")]])
    every = D.messages(spark, sf)
    candidates = every.filter("role = 'user'").select("conv_id", "turn", F.inline(pairs))
    return U.drop_asked_comparisons(candidates, every, "tion")


# -- suggestions and prompts -----------------------------------------------


def _suggestions(spark: SparkSession, sf: str) -> DataFrame:
    requests, before = D.every_question(spark, sf)
    hits = Q.lexical_search(Q.term_index(D.chunks(spark, sf)), requests)
    return U.suggest_followups(requests, hits, before, D.RULES)


@query
def suggest_followups(spark, sf):
    return _suggestions(spark, sf).select("query_id", line("suggested_queries").alias("suggested_queries"))


def _agent_requests(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("query_id") % 3
    companies = F.when(kind == 1, F.array(F.lit("AAPL"))).when(kind == 2, F.array(F.lit("AAPL"), F.lit("MSFT")))
    return D.table(spark, sf, "documents").select(
        F.col("doc_id").alias("query_id"), F.col("doc_id").alias("conv_id"), F.col("text").alias("answer"),
        (F.col("doc_id") % 2 == 0).alias("no_trace"),
    ).withColumn("companies", companies)


@query
def suggest_agent_followups(spark, sf):
    found = U.suggest_agent_followups(_agent_requests(spark, sf), _steps(spark, sf), D.messages(spark, sf), D.AGENT)
    return found.select("query_id", line("suggested_queries").alias("suggested_queries"))


@query
def build_agent_prompt(spark, sf):
    return D.questions(spark, sf).select("query_id", P.agent_prompt(F.col("query"), F.col("companies"), D.HINTS).alias("prompt"))


@query
def build_agent_prompt_default(spark, sf):
    documents = D.table(spark, sf, "documents")
    return documents.select("doc_id", P.agent_prompt(F.col("text"), F.array("source", "lang")).alias("prompt"))


@query
def build_rag_prompt(spark, sf):
    requests, before = D.every_question(spark, sf)
    joined = requests.join(history_lines(V.format_history(before)), "conv_id", "left")
    return joined.select("query_id", P.rag_prompt(F.col("query"), F.col("answer"), F.col("lines")).alias("prompt"))


@query
def build_compare_prompt(spark, sf):
    focus = F.when(F.col("lang") == "en", F.lit("null")).when(F.col("lang") == "fr", F.lit("risk factors"))
    texts = F.when(F.col("lang") == "de", F.array("text")).otherwise(F.array("text", "source"))
    return D.table(spark, sf, "documents").select("doc_id", P.compare_prompt(texts, focus).alias("prompt"))


@query
def build_summary_prompt(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", P.summary_prompt(F.col("text")).alias("prompt"))


@query
def ask(spark, sf):
    """Questions to responses with the agent off: retrieve, cite, suggest, assemble."""
    requests, before = D.every_question(spark, sf)
    asked = ask_flow(Q.term_index(D.chunks(spark, sf)), requests.drop("answer"), before, agent=False)
    return _responses(asked.responses(requests.select("query_id", "answer"), D.RULES))


@query
def ask_both_routes(spark, sf):
    """Every question by its route to a response: retrieval, or the agent, whose record is one call of the retriever tool."""
    requests, before = D.every_question(spark, sf)
    index = Q.term_index(D.chunks(spark, sf))
    asked = ask_flow(index, requests.drop("answer"), before)
    found = F.array_sort(F.collect_list(F.struct("rank", "content", "metadata")))
    results = F.transform(found, lambda x: F.struct(x["content"].alias("content"), x["metadata"].alias("metadata")))
    steps = Q.retrieve_sections(index, asked.by_agent).groupBy("query_id").agg(results.alias("results"))
    steps = materialize(steps.select("query_id", F.lit(0).alias("step_no"), F.lit(R.RETRIEVER_TOOL).alias("tool"), "results"), "steps")
    return _responses(asked.responses(requests.select("query_id", "answer"), D.RULES, steps, D.AGENT))


@query
def ask_prompts(spark, sf):
    requests, before = D.every_question(spark, sf)
    return ask_flow(Q.term_index(D.chunks(spark, sf)), requests, before).prompts


@query
def ask_agent(spark, sf):
    """Documents as answers; those with an embedding have tool steps."""
    requests = _agent_requests(spark, sf)
    steps = materialize(_steps(spark, sf), "steps")
    return _responses(agent_responses(requests, steps, requests, D.messages(spark, sf), D.AGENT))


# -- facts and texts -------------------------------------------------------


@query
def pivot_facts(spark, sf):
    points = N.pivot_facts(D.facts(spark, sf), ["1-URGENT", "2-HIGH", "5-LOW"], [1995, 1996, 1997, 1998])
    series = F.transform("series", lambda p: F.concat(p["year"].cast("string"), F.lit("="), p["value"].cast("string")))
    return points.select("ticker", "data_point", line(series).alias("series"))


@query
def yoy_trend(spark, sf):
    before = F.col("previous_year").cast("string").alias("previous_year")
    return N.yoy_trend(D.facts(spark, sf)).select("data_point", "year", before, "pct_change", "is_latest")


@query
def trend_text(spark, sf):
    return N.trend_text(N.yoy_trend(D.facts(spark, sf)))


@query
def table_facts(spark, sf):
    """Every fact of the statements written into the pages, with its place."""
    found = T.table_facts(D.statement_pages(spark, sf).select("page_id", "html"))
    return found.select("page_id", "row_no", "column_no", "data_point", "year", "value")


@query
def extract_facts(spark, sf):
    return T.extract_facts(D.statement_pages(spark, sf))


@query
def extracted_series(spark, sf):
    """Facts from the pages' statements as series."""
    points = N.pivot_facts(T.extract_facts(D.statement_pages(spark, sf)), ["Revenue", "Net income (loss)", "Net sales / Products"])
    series = F.transform("series", lambda p: F.concat(p["year"].cast("string"), F.lit("="), p["value"].cast("string")))
    return points.select("ticker", "data_point", line(series).alias("series"))


@query
def extracted_trends(spark, sf):
    """Yearly change of the facts from the pages' statements, in words."""
    return N.trend_text(N.yoy_trend(T.extract_facts(D.statement_pages(spark, sf))))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its successor; the last one has an empty text beside it."""
    documents = D.documents(spark, sf).select("doc_id", "text")
    after = documents.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    other = F.coalesce("other", F.lit(""))
    return documents.join(after, "doc_id", "left").select(F.col("doc_id").alias("pair_id"), F.array("text", other).alias("texts"))


@query
def compare_texts(spark, sf):
    found = O.compare_texts(_pairs(spark, sf))
    return found.select(
        "pair_id", line("shared_terms").alias("shared_terms"), line(F.get("own_terms", F.lit(0))).alias("own_first"),
        line(F.get("own_terms", F.lit(1))).alias("own_second"), "jaccard",
    )


@query
def compare_weights(spark, sf):
    documents = D.documents(spark, sf).select("doc_id", "text")
    words = W.vocabulary(materialize(W.counted_terms(documents, ["doc_id"], "text"), "terms"))
    return O.compare_weights(_pairs(spark, sf), words)


@query
def summarize_extractive(spark, sf):
    return O.summarize_extractive(D.documents(spark, sf).select("doc_id", "text"))
