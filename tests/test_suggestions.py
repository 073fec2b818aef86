"""The follow-up rules on filings-like fixtures."""

import pytest

from filigree import rules as R
from filigree import schemas as S
from filigree.operators import suggestions as U

META = "struct<" + ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in S.METADATA) + ">"
REQUEST = "query_id long, conv_id long, query string, companies array<string>, answer string"
HIT = f"query_id long, rank int, content string, metadata {META}"


def meta(ticker="AAPL", company="Apple Inc.", section="Risk Factors"):
    return (company, ticker, "10-K", "2024", "acc", section, 0)


def suggest(spark, query, companies=None, answer="", hits=(), history=(), **options):
    requests = spark.createDataFrame([(7, 1, query, companies, answer)], REQUEST)
    found = spark.createDataFrame([(7, i + 1, c, m) for i, (c, m) in enumerate(hits)], HIT)
    messages = spark.createDataFrame([(1, i, role, text) for i, (role, text) in enumerate(history)], S.MESSAGES)
    return U.suggest_followups(requests, found, messages, **options).first().suggested_queries


def test_comparison_by_history(spark):
    got = suggest(spark, "AAPL vs MSFT", ["AAPL", "MSFT"], history=[("user", "product and risk")])
    assert got[0] == "How do AAPL and MSFT compare in terms of product portfolio?"
    assert suggest(spark, "AAPL vs MSFT", ["AAPL", "MSFT"])[0].endswith("in terms of revenue growth?")


def test_recommendation_then_trend(spark):
    got = suggest(spark, "Should I buy, given the trend?", ["META"], history=[("user", "cash flow")])
    assert got == [
        "What are the biggest risks for investing in META?", "What competitive advantages does META have?",
        "What has been the trend in META's revenue over the past 3 years?",
    ]


def test_detected_company_counts_name_and_ticker(spark):
    got = suggest(spark, "compare it", hits=[("text", meta())])
    assert got == [
        "How do Apple Inc. and AAPL compare in terms of revenue growth?",
        "What strategies does Apple Inc. have to mitigate these risks?",
    ]


def test_discussed_section_and_asked_topic(spark):
    hits = [("guidance on leadership", meta())]
    history = [("user", "Tell me about risk factors"), ("user", "Have there been any recent changes in executive leadership? Please"),
               ("assistant", "outlook")]
    got = suggest(spark, "x", ["AAPL"], hits=hits, history=history)
    # Management is asked already; risks are in the history but not in the content.
    assert got[0] == "What is AAPL's guidance for the next fiscal year?"
    assert not any("mitigate" in q or "leadership" in q for q in got)
    assert got[1] == "How does AAPL compare to MSFT in terms of business model?"


def test_history_topics_come_first(spark):
    got = suggest(spark, "x", ["AAPL", "MSFT"], answer="risk, strategy, revenue", history=[("user", "your approach")])
    assert got == ["What is the long-term business strategy?", "What are the main sources of revenue?", "What are the top 3 risk factors mentioned?"]


def test_peer_prefers_discussed_and_is_not_repeated(spark):
    history = [("user", "GOOGL please")]
    assert "How does AAPL compare to GOOGL in terms of business model?" in suggest(spark, "x", ["AAPL"], history=history)
    history = [("user", "compare aapl with googl")]
    assert not any("compare to GOOGL" in q for q in suggest(spark, "x", ["AAPL"], history=history))


def test_peer_basis(spark):
    assert suggest(spark, "x", ["AAPL"], answer="research")[-1] == "How does AAPL compare to MSFT in terms of R&D investments?"
    history = [("user", "balance sheet")]
    assert "How does AAPL compare to MSFT in terms of revenue growth?" in suggest(spark, "x", ["AAPL"], history=history)


def test_generic_fill(spark):
    got = suggest(spark, "x", history=[("user", "How does the company allocate its capital?"),
                                       ("user", "What are the key growth drivers mentioned in recent filings? now")])
    assert got == [
        "What significant changes have occurred in the latest quarterly report?",
        "What risks does the company face from regulatory changes?",
        "How has the company's market position changed in recent years?",
    ]
    # A blank earlier message overlaps every question.
    assert suggest(spark, "x", history=[("user", "")]) == []


def test_personal_rules_fill_free_places(spark):
    got = suggest(spark, "x", ["AAPL", "MSFT"], answer="", history=[("user", "our plan")])
    assert got[-1] != "What long-term strategic initiatives is AAPL investing in?" and len(got) == 3
    rules = R.FollowupRules(generic=[])
    got = suggest(spark, "x", ["AAPL", "MSFT"], answer="growth", history=[("user", "our plan, cash flow")], rules=rules)
    assert got == [
        "What has been the trend in AAPL's revenue over the past 3 years?",
        "What financial metrics show AAPL's strongest growth areas?",
        "What long-term strategic initiatives is AAPL investing in?",
    ]


def test_hash_choice_and_guess(spark):
    one = suggest(spark, "a vs b", ["A", "B"], choice="hash")
    assert one == suggest(spark, "a vs b", ["A", "B"], choice="hash")
    assert len(one) == len(set(one)) == 3
    requests = spark.createDataFrame([(i, i, "trend", None, "") for i in range(200)], REQUEST)
    none = spark.createDataFrame([], HIT), spark.createDataFrame([], S.MESSAGES)
    rows = U.suggest_followups(requests, *none, choice="hash", guess_company=True).collect()
    named = sum(1 for r in rows if any("What has been the trend in" in q for q in r.suggested_queries))
    assert 110 < named < 170
    with pytest.raises(ValueError):
        suggest(spark, "a vs b", ["A", "B"], choice="random")


def agent(spark, companies, answer="", steps=(), history=(), **options):
    requests = spark.createDataFrame([(7, 1, companies, answer)], "query_id long, conv_id long, companies array<string>, answer string")
    rows = spark.createDataFrame([(7, i, tool, found) for i, (tool, found) in enumerate(steps)], S.STEPS)
    messages = spark.createDataFrame([(1, i, "user", text) for i, text in enumerate(history)], S.MESSAGES)
    return U.suggest_agent_followups(requests, rows, messages, **options).first().suggested_queries


def test_agent_rules(spark):
    steps = [(R.COMPARER_TOOL, None), (R.RETRIEVER_TOOL, [("revenue text", meta())])]
    assert agent(spark, ["AAPL", "MSFT"], steps=steps, history=["risk", "growth"]) == [
        "What specific differences did you find in risk factors between AAPL and MSFT?",
        "What factors are driving AAPL's growth according to recent filings?",
        "What strategies does AAPL mention for mitigating these risks?",
    ]
    assert agent(spark, ["MSFT"], "a market and a product", history=["product"]) == [
        "What does the MD&A section reveal about MSFT?", "How does MSFT's approach to product compare to AAPL?",
    ]
    assert agent(spark, None) == [
        "What does the MD&A section reveal about the company?",
        "What future outlook does the company provide in their latest filing?",
    ]
    assert agent(spark, ["TSLA"]) == [
        "What does the MD&A section reveal about TSLA?", "What future outlook does TSLA provide in their latest filing?",
    ]


def test_agent_all_sections_seen(spark):
    found = [("x", meta(section=s)) for s in ("MD&A", "Business", "Risk Factors")]
    assert agent(spark, None, steps=[(R.RETRIEVER_TOOL, found)]) == [
        "What strategies does the company mention for mitigating these risks?",
        "What future outlook does the company provide in their latest filing?",
    ]


def test_trace_profile(spark):
    steps = spark.createDataFrame([
        (1, 0, R.RETRIEVER_TOOL, [("Growth of MARKET", meta()), ("x", meta(section=""))]),
        (1, 1, R.COMPARER_TOOL, [("revenue", meta(section="Business"))]), (2, 0, R.FACTS_TOOL, None),
    ], S.STEPS)
    got = {r.query_id: (r.tools, r.sections, r.topics) for r in U.trace_profile(steps).collect()}
    assert got == {1: ([R.COMPARER_TOOL, R.RETRIEVER_TOOL], ["Risk Factors"], ["growth", "market"]), 2: ([R.FACTS_TOOL], [], [])}


def test_asked_filters(spark):
    messages = spark.createDataFrame([(1, 0, "user", "What is CASH flow? And more"), (1, 1, "assistant", "x y"), (2, 0, "user", "")], S.MESSAGES)
    candidates = spark.createDataFrame([(1, "cash FLOW"), (1, "x y"), (2, "anything"), (3, "cash flow")], "conv_id long, text string")
    assert {(r.conv_id, r.text) for r in U.drop_asked_questions(candidates, messages).collect()} == {(1, "x y"), (3, "cash flow")}
    messages = spark.createDataFrame([(1, 0, "user", "Compare AAPL and msft")], S.MESSAGES)
    pairs = spark.createDataFrame([(1, "AAPL", "MSFT"), (1, "AAPL", "META"), (2, "AAPL", "MSFT")], "conv_id long, company string, other string")
    assert {(r.conv_id, r.other) for r in U.drop_asked_comparisons(pairs, messages).collect()} == {(1, "META"), (2, "MSFT")}
