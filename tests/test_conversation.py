"""Histories, tags, citations, contexts, prompts, facts."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from filigree import rules as R
from filigree import schemas as S
from filigree.functions import prompts as P
from filigree.operators import context as K
from filigree.operators import conversation as V
from filigree.operators import facts as N
from filigree.operators import routing as G
from filigree.operators import textops as O

META = ("Apple Inc.", "AAPL", "10-K", "2024-01-01", "acc", "Risk Factors", 0)


def meta(**changes):
    names = [f.name for f in S.METADATA]
    return tuple(changes.get(name, value) for name, value in zip(names, META))


HIT = "query_id long, rank int, score double, chunk_id string, content string, metadata struct<" + ", ".join(
    f"{f.name}: {f.dataType.simpleString()}" for f in S.METADATA) + ">"


@pytest.mark.parametrize("length", [9, 10, 11])
def test_history_window(spark, length):
    rows = [(1, t, "user", f"m{t}") for t in range(length)]
    kept = V.last_n_messages(spark.createDataFrame(rows, S.MESSAGES)).collect()
    assert sorted(r.turn for r in kept) == list(range(max(0, length - 10), length))


def test_history_cleaning(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", None), (1, 2, None, "x"), (1, 3, "user", ""), (1, 4, "assistant", "a")]
    df = spark.createDataFrame(rows, S.MESSAGES)
    assert {r.turn for r in V.clean_history(df).collect()} == {0, 3, 4}
    assert {r.turn for r in V.format_history(df).collect()} == {1, 3, 4}
    pending = df.withColumn("is_loading", F.when(F.col("turn") == 4, True))
    assert pending.count() - V.drop_loading(pending).count() == 1
    assert V.normalize_history(df.withColumnRenamed("content", "text"), "text").schema.simpleString() == S.MESSAGES.simpleString()


def test_history_profile(spark):
    rows = [(1, t, "user", "old: Microsoft outlook") for t in range(2)]
    rows += [(1, 2 + t, "assistant", "revenue") for t in range(8)]
    rows += [(1, 10, "user", "Apple RISK factors, aapl"), (1, 11, "user", "Cash flow of META?")]
    row = V.history_profile(spark.createDataFrame(rows, S.MESSAGES)).first()
    assert row.topics == ["risks", "financial"]
    assert row.companies == ["APPLE", "META", "AAPL"]
    assert row.sections == ["RISK FACTORS"]
    assert row.asked == ["apple risk factors, aapl", "cash flow of meta?"]


def test_routing(spark):
    rows = [(1, "Show trends", []), (2, "plain", None), (3, "plain", ["A", "B"]), (4, "contrasting", ["A"]), (5, "plain", ["A"])]
    df = spark.createDataFrame(rows, "query_id long, query string, companies array<string>")
    assert {r.query_id for r in G.route_query(df).filter("to_agent").collect()} == {1, 3, 4}
    assert G.route_query(df, agent=False).filter("to_agent").count() == 0
    flagged = G.flag_complex_query(df.withColumn("query", F.concat(F.lit("Summarize "), "query"))).first()
    assert (flagged.is_complex, flagged.timeout_ms) == (True, 240000)


def test_tags_are_substring_tests(spark):
    df = spark.createDataFrame([("Show metal, R&D and GREW",), (None,)], "content string")
    first, second = G.tag_topics(df, "content").collect()
    assert first.topics == ["growth", "innovation"]
    assert second.topics == []
    mentions = G.tag_mentions(df).first()
    assert mentions.companies_named == ["META"] and mentions.sections_named == []
    patterns = G.tag_query_patterns(df, "content").first()
    assert patterns.is_explanation and not patterns.is_comparison
    assert G.match_rules(df, "content").count() == 2


def test_citations(spark):
    hits = [
        (1, 1, .9, "a", "x", META), (1, 2, .8, "b", "x", meta(company="Second")), (1, 3, .7, "c", "x", meta(section="Business")),
        (1, 4, .6, "d", "x", meta(date=None)), (1, 5, .5, "e", "x", meta(date=None)),
        (2, 1, .9, "f", "x", (None,) * 7),
    ]
    df = spark.createDataFrame(hits, HIT)
    got = [tuple(r) for r in K.dedupe_citations(df).orderBy("query_id", "ord").collect()]
    assert got == [
        (1, 1, "Apple Inc.", "AAPL", "10-K (2024-01-01)", "Risk Factors", 0),
        (1, 2, "Apple Inc.", "AAPL", "10-K (2024-01-01)", "Business", 0),
        (1, 3, "Apple Inc.", "AAPL", "10-K (N/A)", "Risk Factors", 0),
        (2, 1, "Unknown", "N/A", "N/A (N/A)", "N/A", 0),
    ]
    found = {r.query_id: r for r in K.collect_metadata(df).collect()}
    assert found[1].sections == ["Risk Factors", "Business"]
    assert found[1].entities == ["Apple Inc.", "AAPL", "Second"]
    assert 2 not in found


def test_context(spark):
    hits = spark.createDataFrame([(1, 2, .1, "b", "two", (None,) * 7), (1, 1, .2, "a", "one", META)], HIT)
    requests = spark.createDataFrame([(1,), (9,)], "query_id long")
    got = {r.query_id: r.context for r in K.assemble_context(requests, hits).collect()}
    assert got[1] == (
        "Source: 10-K (Apple Inc., 2024-01-01), Section: Risk Factors\nContent: one\n\n---\n\n"
        "Source: N/A (N/A, N/A), Section: N/A\nContent: two"
    )
    assert got[9] == "No relevant context found."


def test_agent_citations(spark):
    hit = ("text", META)
    steps = [
        (1, 2, R.RETRIEVER_TOOL, [("t", meta(ticker=None)), hit]), (1, 1, R.RETRIEVER_TOOL, [hit, ("t", None)]),
        (1, 0, R.COMPARER_TOOL, [("t", meta(ticker="MSFT"))]), (2, 1, R.RETRIEVER_TOOL, []),
        (1, 3, R.RETRIEVER_TOOL, [("t", meta(ticker="N/A", company="Later"))]),
    ]
    got = [(r.ord, r.company, r.ticker) for r in K.agent_citations(spark.createDataFrame(steps, S.STEPS)).orderBy("ord").collect()]
    assert got == [(1, "Apple Inc.", "AAPL"), (2, "Apple Inc.", "N/A")]


def test_fallback_citations(spark):
    rows = [(1, "MD&A and risk factors, Business", ["A", "B", "A"]), (2, "Business", []), (3, "Business", None), (4, "none", ["C"])]
    df = spark.createDataFrame(rows, "query_id long, answer string, companies array<string>")
    got = [(r.query_id, r.ord, r.ticker, r.section) for r in K.fallback_citations(df).orderBy("query_id", "ord").collect()]
    assert got == [
        (1, 1, "A", "Various"), (1, 2, "B", "Various"), (1, 3, "A", "Various"), (1, 4, "A", "MD&A"), (1, 5, "A", "Business"),
        (1, 6, "B", "MD&A"), (1, 7, "B", "Business"), (4, 1, "C", "Various"),
    ]


def test_responses(spark):
    requests = spark.createDataFrame([(1,), (2,)], "query_id long")
    answers = spark.createDataFrame([(1, "yes"), (2, "made up")], "query_id long, answer string")
    hits = spark.createDataFrame([(1, 1, .2, "a", "one", META)], HIT)
    suggestions = spark.createDataFrame([(1, ["q"]), (2, ["q"])], "query_id long, suggested_queries array<string>")
    rows = K.build_responses(requests, answers, hits, K.dedupe_citations(hits), suggestions).orderBy("query_id").collect()
    assert rows[0].answer == "yes" and rows[0].citations[0].ticker == "AAPL" and rows[0].suggested_queries == ["q"]
    assert rows[1].answer == R.NO_HITS_ANSWER and not rows[1].citations and rows[1].suggested_queries == []


def test_prompts(spark):
    df = spark.createDataFrame(
        [(["a", "b"], "risk"), (["a", "b"], "undefined"), (["a"], None), (None, None)], "t array<string>, f string")
    got = [r.p for r in df.select(P.compare_prompt(F.col("t"), F.col("f")).alias("p")).collect()]
    assert got[0].endswith("texts. Focus the comparison on: risk. \n\nText 1:\na\n\nText 2:\nb\n\n")
    assert "Focus" not in got[1] and got[2] == got[3] == R.COMPARE_TOO_FEW
    asked = spark.createDataFrame([("Buy vs sell?", ["A", "B"]), ("x", None)], "q string, c array<string>")
    first, second = [r.p for r in asked.select(P.agent_prompt(F.col("q"), F.col("c")).alias("p")).collect()]
    assert first.startswith("Buy vs sell?\n\nFocus on the following companies: A, B\n\nThis requires comparing")
    assert "comparison query" in first and "investment-related" in first and "over time" not in first
    assert second == "x"


def test_trends(spark):
    rows = [("A", "Revenue", 2023, 110), ("A", "Revenue", 2021, 0), ("A", "Revenue", 2022, 100), ("A", "Loss", 2022, -50),
            ("A", "Loss", 2020, -40), ("B", "One", 2020, 1)]
    df = spark.createDataFrame([(*r[:3], Decimal(r[3])) for r in rows], S.FACTS)
    got = {(r.data_point, r.year): (r.previous_year, r.pct_change, r.is_latest) for r in N.yoy_trend(df).collect()}
    assert got == {
        ("Revenue", 2021): (None, None, False), ("Revenue", 2022): (2021, None, False), ("Revenue", 2023): (2022, 10.0, True),
        ("Loss", 2020): (None, None, False), ("Loss", 2022): (2020, 25.0, True), ("One", 2020): (None, None, True),
    }
    texts = {r.data_point: r.message for r in N.trend_text(N.yoy_trend(df)).collect()}
    assert texts["Revenue"] == "Placeholder: Revenue changed by 10.00% between 2022 and 2023."
    assert texts["One"].startswith("Need at least two")
    series = N.pivot_facts(df, ["Revenue"], [2022, 2023]).collect()
    assert [(p.year, float(p.value)) for p in series[0].series] == [(2022, 100.0), (2023, 110.0)]


def test_compare_and_summary(spark):
    df = spark.createDataFrame([(1, ["cash flow risk", "risk market", "risk cash"]), (2, ["one"]), (3, ["same text", "same text"])],
                               "pair_id long, texts array<string>")
    got = {r.pair_id: r for r in O.compare_texts(df).collect()}
    assert got[1].shared_terms == ["risk"] and got[1].own_terms == [["flow"], ["market"], []] and got[1].jaccard == 0.25
    assert got[2].shared_terms is None and got[3].jaccard == 1.0
    focused = O.compare_texts(df, focus=["Cash", "risk"]).filter("pair_id = 1").first()
    assert focused.jaccard == 0.5
    docs = spark.createDataFrame([(1, "Rare words here. The the. " + "the " * 200 + ". Rare words again"), (2, "the " * 300), (3, "the. the")],
                                 "doc_id long, text string")
    rows = {r.doc_id: r for r in O.summarize_extractive(docs, max_words=6).collect()}
    assert rows[1].summary == "Rare words here. Rare words again" and rows[1].n_words == 6
    assert rows[2].n_words == 300 and rows[3].summary == "the. the"
    boosted = {r.doc_id: r for r in O.summarize_extractive(docs, max_words=3, boost=["again"]).collect()}
    assert boosted[1].summary == "Rare words again"
