"""Chat histories: cleaning, windows and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree import rules as R
from filigree.functions.matching import contains_any, with_lowered
from filigree.functions.text import annotate_selection, strip_selection

ROLES = ["user", "assistant"]


def clean_history(messages: DataFrame) -> DataFrame:
    """Messages that have a role and a content."""
    return messages.filter(F.col("role").isNotNull() & F.col("content").isNotNull())


def drop_loading(messages: DataFrame) -> DataFrame:
    """Without messages that are still pending."""
    return messages.filter(~F.coalesce("is_loading", F.lit(False)))


def format_history(messages: DataFrame) -> DataFrame:
    """User and assistant messages only."""
    return messages.filter(F.col("role").isin(ROLES))


def normalize_history(messages: DataFrame, content: str = "content") -> DataFrame:
    """Any message table with the columns of the `messages` schema."""
    return messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        "role", F.col(content).alias("content"),
    )


def annotate_user_message(messages: DataFrame, companies: str = "companies") -> DataFrame:
    return messages.withColumn("content", annotate_selection(F.col("content"), F.col(companies)))


def strip_selection_tag(messages: DataFrame) -> DataFrame:
    return messages.withColumn("content", strip_selection(F.col("content")))


def last_n_messages(messages: DataFrame, n: int = R.HISTORY_WINDOW) -> DataFrame:
    """Last n messages of every conversation. Tasks drop older ones before the shuffle."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= n).drop("_n")


def compose_history(messages: DataFrame, n: int = R.HISTORY_WINDOW) -> DataFrame:
    """What a request sends along: the last n messages that are not pending, without their selection notes."""
    return strip_selection_tag(last_n_messages(drop_loading(messages), n))


def _names(flags: dict[str, str]) -> Column:
    """Array of names whose flag column is set, in order."""
    return F.array_compact(F.array(*[F.when(F.col(flag), F.lit(name)) for flag, name in flags.items()]))


def history_profile(messages: DataFrame, rules: R.FollowupRules = R.FollowupRules(), n: int = R.HISTORY_WINDOW) -> DataFrame:
    """(conv_id, topics, companies, sections, asked) of the user turns among the last n messages.

    Every test is one boolean per message and one `max` per conversation; `asked` holds the
    lower-cased user messages, at most n.
    """
    recent = with_lowered(last_n_messages(messages, n).filter(F.col("role") == "user"), "content")
    tests = {}
    groups: dict[str, dict[str, str]] = {"topics": {}, "companies": {}, "sections": {}}

    def test(group: str, name: str, words: list[str]) -> None:
        flag = f"_{group}_{len(groups[group])}"
        tests[flag] = contains_any(F.col("_low"), words)
        groups[group][flag] = name

    for topic, words in rules.topics.items():
        test("topics", topic, words)
    for name in rules.names:
        test("companies", name.upper(), [name])
    for ticker in rules.tickers:
        test("companies", ticker, [ticker.lower()])
    for section in rules.sections:
        test("sections", section.upper(), [section])
    grouped = recent.withColumns(tests).groupBy("conv_id").agg(
        F.array_sort(F.collect_set("_low")).alias("asked"), *[F.max(flag).alias(flag) for flag in tests]
    )
    return grouped.select(
        "conv_id",
        _names(groups["topics"]).alias("topics"),
        F.array_distinct(_names(groups["companies"])).alias("companies"),
        _names(groups["sections"]).alias("sections"),
        "asked",
    )


def user_topics(messages: DataFrame, topics: list[str] = R.AGENT_HISTORY_TOPICS) -> DataFrame:
    """(conv_id, topics): words of the list in any user turn of the whole history."""
    low = with_lowered(messages.filter(F.col("role") == "user"), "content")
    flags = {f"_t{i}": topic for i, topic in enumerate(topics)}
    tests = {flag: contains_any(F.col("_low"), [topic]) for flag, topic in flags.items()}
    grouped = low.select("conv_id", *[c.alias(f) for f, c in tests.items()]).groupBy("conv_id").agg(
        *[F.max(flag).alias(flag) for flag in flags]
    )
    return grouped.select("conv_id", _names(flags).alias("topics"))
