"""Keyword dictionaries, question templates and prompt texts.

Everything here is a default: each operator takes the rule set as an argument, so a
caller can replace any dictionary without touching the operators.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Words, names and texts that results depend on.
# ---------------------------------------------------------------------------

COMPANIES = [
    ("AAPL", "Apple Inc."),
    ("MSFT", "Microsoft Corporation"),
    ("AMZN", "Amazon.com Inc."),
    ("GOOGL", "Alphabet Inc."),
    ("META", "Meta Platforms Inc."),
]

DISPLAY_NAMES = {
    "AAPL": "Apple",
    "MSFT": "Microsoft",
    "GOOGL": "Google",
    "META": "Meta",
    "AMZN": "Amazon",
    "TSLA": "Tesla",
}

FILING_TYPES = ["10-K"]
FILINGS_PER_TYPE = 2

TARGET_SECTIONS = {
    "1A": "Risk Factors",
    "7": "Management's Discussion and Analysis of Financial Condition and Results of Operations",
}
WHOLE_DOCUMENT = "Full Document"

CHUNK_SIZE = 1000
CHUNK_OVERLAP = 100
HISTORY_WINDOW = 10
MAX_SUGGESTIONS = 3

ROUTING_KEYWORDS = [
    "compare", "contrast", "summarize", "trend", "analyze", "difference", "similarity",
]
COMPLEX_KEYWORDS = ["compare", "summarize", "analyze"]
COMPLEX_TIMEOUT_MS = 240000
SIMPLE_TIMEOUT_MS = 120000

TOPIC_KEYWORDS = {
    "revenue": ["revenue", "sales", "income", "earnings", "profit"],
    "growth": ["growth", "increase", "expand", "growing", "grew"],
    "risks": ["risk", "threat", "challenge", "uncertainty", "potential issues"],
    "competition": ["competition", "competitor", "market share", "industry", "rival"],
    "strategy": ["strategy", "plan", "approach", "initiative", "objective"],
    "products": ["product", "service", "offering", "solution", "device"],
    "innovation": ["innovation", "research", "development", "r&d", "technology"],
    "financial": ["financial", "balance sheet", "cash flow", "assets", "liabilities"],
    "management": ["management", "executive", "leadership", "ceo", "officer"],
    "outlook": ["outlook", "forecast", "future", "guidance", "projection"],
}

QUERY_PATTERNS = {
    "comparison": ["compare", "vs", "versus", "difference between"],
    "trend": ["trend", "over time", "change in", "historical"],
    "recommendation": ["invest", "buy", "sell", "recommend", "should i"],
    "explanation": ["why", "how", "explain", "what is", "define"],
    "listing": ["list", "what are", "enumerate", "examples of"],
}

TOPIC_QUESTIONS = {
    "revenue": "What are the main sources of revenue?",
    "products": "What new products or services are being developed?",
    "innovation": "How much does the company invest in R&D?",
    "competition": "Who are the main competitors and what's the competitive landscape?",
    "risks": "What are the top 3 risk factors mentioned?",
    "strategy": "What is the long-term business strategy?",
    "management": "Have there been any recent changes in executive leadership?",
    "financial": "How strong is the balance sheet and cash position?",
    "outlook": "What is the company's guidance for the next fiscal year?",
}

GENERIC_QUESTIONS = [
    "What significant changes have occurred in the latest quarterly report?",
    "What are the key growth drivers mentioned in recent filings?",
    "How does the company allocate its capital?",
    "What risks does the company face from regulatory changes?",
    "How has the company's market position changed in recent years?",
]

MENTION_NAMES = ["apple", "microsoft", "amazon", "google", "meta", "facebook"]
MENTION_TICKERS = ["AAPL", "MSFT", "AMZN", "GOOGL", "META"]
MENTION_SECTIONS = ["risk factors", "management discussion", "md&a", "business"]
PEER_TICKERS = ["AAPL", "MSFT", "GOOGL", "AMZN", "META"]

# (topics of which one must be in the history, texts to pick from); the last entry has no
# condition and is the default.
COMPARE_ASPECTS = [
    (["financial", "revenue"],
     ["revenue growth", "profit margins", "operating expenses", "gross margin", "cash flow"]),
    (["innovation", "products"],
     ["product portfolio", "R&D investments", "patent filings", "innovation strategy",
      "technology adoption"]),
    (["risks"],
     ["risk factors", "regulatory challenges", "market uncertainties", "competitive threats",
      "supply chain risks"]),
    ([],
     ["revenue growth", "profit margins", "business strategy",
      "research and development investments", "market position"]),
]
TREND_METRICS = [
    (["financial"],
     ["revenue", "profit margin", "cash flow", "debt ratio", "gross margin"]),
    (["growth"],
     ["year-over-year growth", "customer acquisition", "market expansion",
      "product line growth", "international revenue"]),
    ([],
     ["revenue", "profit margin", "market share", "R&D spending", "employee headcount"]),
]
PEER_BASES = [
    (["financial"],
     ["revenue growth", "profit margins", "financial health", "cash flow management"]),
    (["strategy"],
     ["growth strategy", "market expansion plans", "competitive positioning", "business model"]),
    (["innovation"],
     ["R&D investments", "innovation pipeline", "technology adoption", "patent portfolio"]),
    ([],
     ["business model", "growth strategy", "financial performance", "market position"]),
]
# Used for PEER_BASES when the history has no topic: (topic in the content, text).
PEER_BASIS_BY_CONTENT = [
    ("revenue", "revenue sources"),
    ("innovation", "R&D investments"),
    ("risks", "risk factors"),
]

RETRIEVER_TOOL = "SECSectionRetriever"
COMPARER_TOOL = "LLMComparer"
FACTS_TOOL = "FinancialDataExtractor"

AGENT_TOPICS = [
    "revenue", "growth", "risk", "competition", "strategy", "outlook", "research",
    "development", "market", "product", "service",
]
AGENT_HISTORY_TOPICS = [
    "risk", "revenue", "growth", "strategy", "competition", "financial", "management",
    "product", "research",
]
AGENT_SECTIONS = ["MD&A", "Risk Factors", "Business"]
AGENT_ASPECTS = [
    (["financial", "revenue"],
     ["revenue structure", "profit margins", "operating expenses", "cash flow"]),
    (["risk"],
     ["risk factors", "regulatory challenges", "competitive threats"]),
    (["strategy"],
     ["business strategy", "growth initiatives", "market positioning"]),
    ([],
     ["business strategy", "growth prospects", "risk factors", "revenue sources",
      "market position", "competitive advantages"]),
]
AGENT_GENERAL = [
    "What future outlook does {company} provide in their latest filing?",
    "What competitive advantages does {company} highlight?",
    "How does {company} describe their target market and customer base?",
    "What are the main growth drivers mentioned by {company}?",
]

ANSWER_SECTIONS = [
    "Risk Factors", "Management's Discussion", "MD&A", "Business", "Financial Statements",
]
FALLBACK_FILING = "10-K/10-Q (Recent)"
FALLBACK_SECTION = "Various"

NO_CONTEXT = "No relevant context found."
NO_HITS_ANSWER = (
    "Could not find relevant information in the available filings for this specific query."
)
CONTEXT_SEPARATOR = "\n\n---\n\n"

RAG_SYSTEM = (
    "You are an assistant for question-answering tasks. Use the following pieces of retrieved "
    "context to answer the question. If you don't know the answer, just say that you don't know. "
    "Use three sentences maximum and keep the answer concise."
)
SUMMARY_SYSTEM = (
    "Summarize the following text, focusing on key financial insights, risks, or strategies. "
    "Keep the summary concise, ideally under {words} words."
)
COMPARE_SYSTEM = "You are an expert financial analyst AI assistant."
COMPARE_INTRO = "Compare and contrast the following texts. "
COMPARE_TOO_FEW = "Error: At least two texts are required for comparison."

AGENT_COMPANY_LINE = "\n\nFocus on the following companies: "
AGENT_MULTI_COMPANY = (
    "\n\nThis requires comparing information across multiple companies. Follow these steps:\n"
    "1. Use SECSectionRetriever separately for EACH company to get relevant information\n"
    "2. For each company, retrieve both general business information AND specific details"
    " related to the query\n"
    "3. Once you have information about all companies, use the LLMComparer tool as follows:\n"
    "   - Include texts_to_compare parameter with the text sections to compare\n"
    "   - ONLY use comparison_focus parameter if you're focusing on a specific aspect,"
    " otherwise omit it\n"
    "   - NEVER pass comparison_focus as null, undefined, or empty string\n"
    "4. Synthesize the results into a comprehensive answer"
)
# (words that trigger the hint, hint)
AGENT_HINTS = [
    (["compare", "vs", "versus", "difference", "similarities"],
     "\n\nThis is a comparison query. To properly answer:\n"
     "1. First retrieve relevant information about each entity using SECSectionRetriever\n"
     "2. Use the LLMComparer tool with the retrieved information. Only include the"
     " comparison_focus parameter if you want to focus on a specific aspect.\n"
     "3. Be specific about the key differences and similarities found"),
    (["trend", "over time", "historical", "changed", "growth"],
     "\n\nThis query involves analysis over time. Consider:\n"
     "1. Retrieving information from multiple time periods using SECSectionRetriever\n"
     "2. Looking specifically for year-over-year comparisons in MD&A sections\n"
     "3. Using financial data from different periods if available"),
    (["invest", "investment", "allocate", "portfolio", "buy", "sell"],
     "\n\nThis appears to be an investment-related query. Focus on:\n"
     "1. Retrieving risk factors for each company mentioned\n"
     "2. Gathering business strategy and competitive advantage information\n"
     "3. Looking for financial performance indicators\n"
     "4. Remember, as an AI, you cannot provide direct investment advice, but you can analyze"
     " information from SEC filings to help inform investment decisions"),
]

# ---------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class FollowupRules:
    """Dictionaries behind `suggest_followups`; topic order is the priority order."""

    topics: dict[str, list[str]] = field(default_factory=lambda: TOPIC_KEYWORDS)
    patterns: dict[str, list[str]] = field(default_factory=lambda: QUERY_PATTERNS)
    questions: dict[str, str] = field(default_factory=lambda: TOPIC_QUESTIONS)
    generic: list[str] = field(default_factory=lambda: GENERIC_QUESTIONS)
    names: list[str] = field(default_factory=lambda: MENTION_NAMES)
    tickers: list[str] = field(default_factory=lambda: MENTION_TICKERS)
    sections: list[str] = field(default_factory=lambda: MENTION_SECTIONS)
    peers: list[str] = field(default_factory=lambda: PEER_TICKERS)


@dataclass(frozen=True)
class AgentRules:
    """Dictionaries behind `suggest_agent_followups`."""

    topics: list[str] = field(default_factory=lambda: AGENT_TOPICS)
    history_topics: list[str] = field(default_factory=lambda: AGENT_HISTORY_TOPICS)
    sections: list[str] = field(default_factory=lambda: AGENT_SECTIONS)
    peers: list[str] = field(default_factory=lambda: PEER_TICKERS)
