"""Rule-based follow-up questions.

Hits, steps and histories are first reduced to one row per request. All rules are then column
expressions of that row, so no rule adds a shuffle: each yields a text or null, the texts are
joined in rule order, and the first three different ones remain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree import rules as R
from filigree.functions.matching import literal_array, tags, word_tags
from filigree.functions.sets import (
    missing_sections, options_for, other_companies, pick, priority_topics, union_suggestions,
)
from filigree.operators.conversation import history_profile, last_n_messages, user_topics
from filigree.operators.routing import tag_query_patterns

EMPTY = "cast(array() as array<string>)"


def overlaps_asked(question: Column, asked: Column) -> Column:
    """The question contains, or is contained in, an earlier message (both lower-cased)."""
    low = F.lower(question)
    return F.exists(asked, lambda p: F.contains(p, low) | F.contains(low, p))


def compared_before(first: Column, second: Column, asked: Column) -> Column:
    """An earlier message compares the two companies."""
    return F.exists(
        asked,
        lambda p: F.contains(p, F.lit("compare")) & F.contains(p, F.lower(first)) & F.contains(p, F.lower(second)),
    )


def _recent_questions(messages: DataFrame, window: int) -> DataFrame:
    """(_c, _m): lower-cased user messages among the last `window` of each conversation."""
    recent = last_n_messages(messages, window).filter(F.col("role") == "user")
    return recent.select(F.col("conv_id").alias("_c"), F.lower("content").alias("_m"))


def drop_asked_questions(candidates: DataFrame, messages: DataFrame, window: int = R.HISTORY_WINDOW) -> DataFrame:
    """Candidates (conv_id, text) that do not overlap a recent user message of their conversation.

    An anti-join on the conversation with the containment test as residual condition. A
    candidate meets at most `window` messages, however long its conversation is.
    """
    low = F.lower(F.col("text"))
    hit = F.contains(F.col("_m"), low) | F.contains(low, F.col("_m"))
    asked = _recent_questions(messages, window)
    return candidates.join(asked, (F.col("conv_id") == F.col("_c")) & hit, "left_anti")


def drop_asked_comparisons(
    candidates: DataFrame, messages: DataFrame, word: str = "compare", window: int = R.HISTORY_WINDOW
) -> DataFrame:
    """Candidates (conv_id, company, other) that no recent user message of the conversation compares."""
    asked = _recent_questions(messages, window).filter(F.contains("_m", F.lit(word)))
    hit = F.contains(F.col("_m"), F.lower("company")) & F.contains(F.col("_m"), F.lower("other"))
    return candidates.join(asked, (F.col("conv_id") == F.col("_c")) & hit, "left_anti")


def _from_hits(hits: DataFrame) -> DataFrame:
    """(query_id, _content, sections, entities) of the at most k hits of a request, by rank.

    One grouping of the hits; everything else is taken from the small array it leaves.
    """
    meta = F.col("metadata")
    kept = F.struct("rank", "content", meta["section"].alias("section"), meta["company"].alias("company"), meta["ticker"].alias("ticker"))
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(kept)).alias("_h"))

    def distinct(values: Column) -> Column:
        return F.array_distinct(F.filter(values, lambda v: v != ""))

    return rows.select(
        "query_id",
        F.array_join("_h.content", " ").alias("_content"),
        distinct(F.col("_h.section")).alias("sections"),
        distinct(F.flatten(F.transform("_h", lambda h: F.array(h["company"], h["ticker"])))).alias("entities"),
    )


def suggest_followups(
    requests: DataFrame,
    hits: DataFrame,
    messages: DataFrame,
    rules: R.FollowupRules = R.FollowupRules(),
    choice: str = "first",
    guess_company: bool = False,
    window: int = R.HISTORY_WINDOW,
) -> DataFrame:
    """(query_id, suggested_queries): at most three questions per request.

    `requests`: query_id, conv_id, query, companies, answer. `messages` is the history before
    the request. `guess_company` names a company in seven of ten requests that have none.
    """
    empty = F.expr(EMPTY)
    facts = (
        requests.join(_from_hits(hits), "query_id", "left")
        .join(
            history_profile(messages, rules, window).select(
                "conv_id", F.col("topics").alias("hist"), F.col("companies").alias("discussed"),
                F.col("sections").alias("discussed_sections"), "asked",
            ),
            "conv_id", "left",
        )
    )
    facts = facts.withColumns({c: F.coalesce(c, empty) for c in
                               ("sections", "entities", "hist", "discussed", "discussed_sections", "asked")})
    text = F.lower(F.concat(F.coalesce("answer", F.lit("")), F.lit(" "), F.coalesce("_content", F.lit(""))))
    facts = facts.withColumn("_text", text).withColumn("topics", tags(F.col("_text"), rules.topics))
    given = F.coalesce(F.size("companies") > 0, F.lit(False))
    facts = tag_query_patterns(
        facts.withColumn("targets", F.when(given, F.col("companies")).otherwise(F.col("entities"))),
        "query", rules.patterns,
    )
    key = F.col("query_id")
    if guess_company:
        pool = F.when(F.size("discussed") > 0, F.col("discussed")).otherwise(literal_array(rules.peers))
        drawn = F.pmod(F.xxhash64(key, F.lit(0)), F.lit(10)) < 7
        guess = F.when((F.size("targets") == 0) & drawn, F.array(pick(pool, choice, key, 1)))
        facts = facts.withColumn("targets", F.coalesce(guess, F.col("targets")))
    facts = facts.withColumns({
        "company": F.get("targets", F.lit(0)),
        "company_ref": F.coalesce(F.get("targets", F.lit(0)), F.lit("the company")),
    })

    hist, topics, targets, asked = (F.col(c) for c in ("hist", "topics", "targets", "asked"))
    company, ref = F.col("company"), F.col("company_ref")
    named = company.isNotNull()

    def say(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def has(array: Column, value: str) -> Column:
        return F.array_contains(array, value)

    comparison = F.when(
        F.col("is_comparison") & (F.size(targets) >= 2),
        say("How do ", F.array_join(F.slice(targets, 1, 2), " and "), " compare in terms of ",
            pick(options_for(hist, R.COMPARE_ASPECTS), choice, key, 10), "?"),
    )
    invest = F.col("is_recommendation") & named
    risk_of = F.when(invest, say("What are the biggest risks for investing in ", company, "?"))
    advantage_of = F.when(invest, say("What competitive advantages does ", company, " have?"))
    trend = F.when(
        (F.col("is_trend") | has(topics, "growth")) & named,
        say("What has been the trend in ", company, "'s ",
            pick(options_for(hist, R.TREND_METRICS), choice, key, 30), " over the past 3 years?"),
    )
    mitigation = F.when(
        has(F.col("sections"), "Risk Factors") & ~has(F.col("discussed_sections"), "RISK FACTORS"),
        say("What strategies does ", ref, " have to mitigate these risks?"),
    )
    outlook = F.when(
        has(F.col("sections"), "MD&A") & ~has(F.col("discussed_sections"), "MD&A"),
        say("What does management say about future growth opportunities for ", ref, "?"),
    )
    question_of = F.create_map(*[F.lit(x) for pair in rules.questions.items() for x in pair])
    by_topic = F.array_compact(F.transform(
        priority_topics(hist, topics),
        lambda t: F.replace(F.try_element_at(question_of, t), F.lit("the company"), ref),
    ))
    by_topic = F.filter(by_topic, lambda q: ~overlaps_asked(q, asked))

    peer = pick(other_companies(company, F.col("discussed"), rules.peers), choice, key, 70)
    basis = pick(options_for(hist, R.PEER_BASES), choice, key, 71)
    by_content = F.lit(None).cast("string")
    for topic, words in reversed(R.PEER_BASIS_BY_CONTENT):
        by_content = F.when(has(topics, topic), F.lit(words)).otherwise(by_content)
    basis = F.when(F.size(hist) == 0, F.coalesce(by_content, basis)).otherwise(basis)
    to_peer = F.when(
        (F.size(targets) == 1) & ~F.col("is_comparison") & ~compared_before(company, F.col("_peer"), asked),
        say("How does ", company, " compare to ", F.col("_peer"), " in terms of ", basis, "?"),
    )

    facts = facts.withColumn("_peer", peer)
    facts = facts.withColumn("_first", F.array_compact(F.concat(
        F.array(comparison, risk_of, advantage_of, trend, mitigation, outlook), by_topic, F.array(to_peer)
    )))
    generic = literal_array(rules.generic)
    if choice == "hash":
        keyed = F.transform(generic, lambda q: F.struct(F.xxhash64(key, q).alias("h"), q.alias("q")))
        generic = F.transform(F.array_sort(keyed), lambda x: x["q"])
    generic = F.filter(generic, lambda q: ~overlaps_asked(q, asked))
    generic = F.transform(generic, lambda q: F.replace(q, F.lit("the company"), ref))
    have = F.size("_first")
    fill = F.when(have < 2, F.slice(generic, F.lit(1), R.MAX_SUGGESTIONS - have)).otherwise(empty)

    growth = F.when(has(hist, "financial") & has(topics, "growth") & named,
                    say("What financial metrics show ", company, "'s strongest growth areas?"))
    risk = F.when(has(hist, "risk") & named,
                  say("How has ", company, "'s risk profile changed since their previous filing?"))
    strategy = F.when(has(hist, "strategy") & named,
                      say("What long-term strategic initiatives is ", company, " investing in?"))
    everything = union_suggestions(F.col("_first"), fill, F.array(growth, risk, strategy))
    return facts.select("query_id", F.slice(everything, 1, R.MAX_SUGGESTIONS).alias("suggested_queries"))


def trace_profile(steps: DataFrame, topics: list[str] = R.AGENT_TOPICS) -> DataFrame:
    """(query_id, tools, sections, topics) of the steps of a request.

    Tools come from every step; sections and topics from retriever results. Each topic is one
    boolean per result and one `max` per request.
    """
    flat = steps.select(
        "query_id", "tool",
        F.explode_outer(F.when(F.col("tool") == R.RETRIEVER_TOOL, F.col("results"))).alias("hit"),
    )
    low = flat.select(
        "query_id", "tool", F.nullif(F.col("hit.metadata.section"), F.lit("")).alias("section"),
        word_tags(F.lower("hit.content"), topics).alias("_found"),
    )
    flags = [F.max(F.array_contains("_found", topic)).alias(f"_t{i}") for i, topic in enumerate(topics)]
    grouped = low.groupBy("query_id").agg(
        F.array_sort(F.collect_set("tool")).alias("tools"),
        F.array_sort(F.collect_set("section")).alias("sections"), *flags,
    )
    found = F.array_compact(F.array(*[F.when(F.col(f"_t{i}"), F.lit(topic)) for i, topic in enumerate(topics)]))
    return grouped.select("query_id", "tools", "sections", found.alias("topics"))


def suggest_agent_followups(
    requests: DataFrame,
    steps: DataFrame,
    messages: DataFrame,
    rules: R.AgentRules = R.AgentRules(),
    choice: str = "first",
) -> DataFrame:
    """(query_id, suggested_queries) after an agent run.

    `requests`: query_id, conv_id, companies, answer; `steps` are the tool results.
    """
    empty = F.expr(EMPTY)
    profile = trace_profile(steps, rules.topics).withColumnRenamed("topics", "step_topics")
    history = user_topics(messages, rules.history_topics).withColumnRenamed("topics", "hist")
    facts = requests.join(profile, "query_id", "left").join(history, "conv_id", "left")
    facts = facts.withColumns({c: F.coalesce(c, empty) for c in
                               ("companies", "tools", "sections", "step_topics", "hist")})
    in_answer = word_tags(F.lower(F.coalesce("answer", F.lit(""))), rules.topics)
    seen = F.concat(F.col("step_topics"), F.col("_answer_topics"))
    facts = facts.withColumn("_answer_topics", in_answer).withColumns({
        # Dictionary order, as if the topics came from one text.
        "topics": F.array_intersect(literal_array(rules.topics), seen),
        "company": F.get("companies", F.lit(0)),
        "company_ref": F.coalesce(F.get("companies", F.lit(0)), F.lit("the company")),
    })
    key, hist, topics, companies = (F.col(c) for c in ("query_id", "hist", "topics", "companies"))
    company, ref = F.col("company"), F.col("company_ref")

    compared = F.when(
        F.array_contains("tools", R.COMPARER_TOOL) & (F.size(companies) > 1),
        F.concat(F.lit("What specific differences did you find in "),
                 pick(options_for(hist, R.AGENT_ASPECTS), choice, key, 10),
                 F.lit(" between "), F.array_join(companies, " and "), F.lit("?")),
    )
    numbers = F.when(
        F.array_contains("tools", R.FACTS_TOOL) | F.arrays_overlap(topics, literal_array(["financial", "revenue"])),
        F.when(F.array_contains(hist, "growth"),
               F.concat(F.lit("What factors are driving "), ref, F.lit("'s growth according to recent filings?")))
        .otherwise(F.concat(F.lit("How has "), ref,
                            F.lit("'s financial performance trended over the past 3 years?"))),
    )
    risks = F.when(
        F.array_contains("sections", "Risk Factors"),
        F.concat(F.lit("What strategies does "), ref, F.lit(" mention for mitigating these risks?")),
    )
    gap = F.get(missing_sections(F.col("sections"), rules.sections), F.lit(0))
    section = F.concat(F.lit("What does the "), gap, F.lit(" section reveal about "), ref, F.lit("?"))
    peers = literal_array(rules.peers)
    # Topics of the history come first, both in dictionary order.
    ordered = F.concat(F.array_intersect(topics, hist), F.array_except(topics, hist))
    topic = F.coalesce(F.get(ordered, F.lit(0)), F.lit("business strategy"))
    peer = F.when(
        (F.size(companies) == 1) & F.array_contains(peers, company),
        F.concat(F.lit("How does "), company, F.lit("'s approach to "), topic, F.lit(" compare to "),
                 pick(F.array_remove(peers, company), choice, key, 50), F.lit("?")),
    )
    facts = facts.withColumn("_first", F.array_compact(F.array(compared, numbers, risks, section, peer)))
    general = F.array(*[
        F.concat(*[ref if part == "{company}" else F.lit(part) for part in _parts(text)]) for text in R.AGENT_GENERAL
    ])
    # General questions fill up to two.
    fill = F.slice(F.array_except(general, F.col("_first")), F.lit(1), F.greatest(F.lit(0), 2 - F.size("_first")))
    return facts.select(
        "query_id", F.slice(F.concat("_first", fill), 1, R.MAX_SUGGESTIONS).alias("suggested_queries")
    )


def _parts(template: str) -> list[str]:
    """A template split around `{company}`, the placeholder kept as its own part."""
    before, after = template.split("{company}")
    return [part for part in (before, "{company}", after) if part]
