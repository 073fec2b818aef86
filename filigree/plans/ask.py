"""A table of questions against a collection: the retrieval route and the agent route."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.functions.prompts import agent_prompt, rag_prompt
from filigree.operators import context as K
from filigree.operators.conversation import clean_history, format_history, last_n_messages
from filigree.operators.retrieval import TermIndex, lexical_search
from filigree.operators.routing import route_query
from filigree.operators.suggestions import suggest_agent_followups, suggest_followups
from filigree.rules import AgentRules, FollowupRules
from filigree.session import materialize


@dataclass(frozen=True)
class Asked:
    """What is known before a model has answered.

    `requests` are those of the retrieval route, with their `hits` and `citations`, `by_agent` those of the
    agent route; `prompts` (query_id, route, prompt) covers both.
    """

    requests: DataFrame
    by_agent: DataFrame
    hits: DataFrame
    citations: DataFrame
    prompts: DataFrame
    messages: DataFrame

    def responses(
        self, answers: DataFrame, rules: FollowupRules = FollowupRules(),
        steps: DataFrame | None = None, agent_rules: AgentRules = AgentRules(),
    ) -> DataFrame:
        """Final rows of every request for answers (query_id, answer) to the prompts.

        With the tool steps of the agent route both routes are in the table; without them only the retrieval route.
        """
        full = self.requests.join(answers, "query_id", "left")
        suggestions = suggest_followups(full, self.hits, self.messages, rules)
        direct = K.build_responses(self.requests, answers, self.hits, self.citations, suggestions)
        if steps is None:
            return direct
        return direct.unionByName(agent_responses(self.by_agent, steps, answers, self.messages, agent_rules))


def history_lines(messages: DataFrame) -> DataFrame:
    """(conv_id, lines): the last messages of each conversation as `role: content`."""
    return last_n_messages(messages).groupBy("conv_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("turn", "role", "content"))),
            lambda m: F.concat(m["role"], F.lit(": "), m["content"]),
        ).alias("lines")
    )


def ask(index: TermIndex, requests: DataFrame, messages: DataFrame, k: int = 3, agent: bool = True) -> Asked:
    """Route, retrieve once, then derive contexts, citations and prompts from the stored hits.

    Routed requests and hits are stored, since every later branch reads them.

    Requests of the agent route only get a prompt here; what its tools return comes in through
    `agent_responses`. Without the agent every request takes the retrieval route.
    """
    history = format_history(clean_history(messages))
    routed = materialize(route_query(requests, agent=agent), "requests")
    direct = routed.filter(~F.col("to_agent")).drop("to_agent")
    hits = materialize(lexical_search(index, direct, k), "hits")
    rag = (
        direct.join(K.assemble_context(direct, hits), "query_id")
        .join(history_lines(history), "conv_id", "left")
        .select("query_id", F.lit("rag").alias("route"),
                rag_prompt(F.col("query"), F.col("context"), F.col("lines")).alias("prompt"))
    )
    taken = routed.filter("to_agent").drop("to_agent")
    by_agent = taken.select(
        "query_id", F.lit("agent").alias("route"), agent_prompt(F.col("query"), F.col("companies")).alias("prompt")
    )
    return Asked(direct, taken, hits, K.dedupe_citations(hits), rag.unionByName(by_agent), history)


def agent_responses(
    requests: DataFrame, steps: DataFrame, answers: DataFrame, messages: DataFrame, rules: AgentRules = AgentRules()
) -> DataFrame:
    """Final rows of the agent route from its steps and answers.

    Citations come from the retriever steps. A request without steps has none, unless its column
    `no_trace` says that the record of its steps is missing: then it gets those its answer and
    companies allow.
    """
    full = requests.drop("answer").join(answers.select("query_id", "answer"), "query_id", "left")
    missing = F.coalesce("no_trace", F.lit(False)) if "no_trace" in full.columns else F.lit(False)
    without = full.filter(missing).join(steps.select("query_id"), "query_id", "left_anti")
    cited = K.collect_citations(K.agent_citations(steps).unionByName(K.fallback_citations(without)))
    suggestions = suggest_agent_followups(full, steps, messages, rules)
    return (
        full.select("query_id", "answer").join(cited, "query_id", "left").join(suggestions, "query_id", "left")
        .select("query_id", "answer", "citations", "suggested_queries")
    )
