"""Sections by the sequence of headings, against all chains of a text."""

import random
import re
from itertools import combinations

import pytest

from filigree.functions.sections import MOST_CHARS
from filigree.operators.chunks import extract_sections

LONG = "Prices may fall. " * 200
TARGETS = {"1": "one", "1A": "risk", "7": "talk", "8": "numbers"}


def bodies(spark, text):
    rows = extract_sections(spark.createDataFrame([(1, text)], "id int, text string"), TARGETS).collect()
    assert len(rows) == len({r.section for r in rows})
    return {r.section: r.text for r in rows}


@pytest.mark.parametrize(("text", "expected"), [
    # A wrapped reference neither cuts its section nor hides the real one.
    (f"Item 1A. Risk Factors\n{LONG}\nItem 7 of this report, and more\nthe end\nItem 7. Discussion\nRevenue grew.\nItem 8. Statements\nnone",
     {"risk": f"{LONG}\nItem 7 of this report, and more\nthe end", "talk": "Revenue grew.", "numbers": "none"}),
    # The contents lose though they come first and their last entry is followed by much text.
    (f"Item 1. Business ... 2\nItem 1A. Risk Factors ... 5\nItem 7. Discussion ... 9\nItem 8. Statements ... 30\n{LONG}\nItem 1. Business\nWe sell.\n"
     f"Item 1A. Risk Factors\n{LONG}\nItem 7. Discussion\nUp.\nItem 8. Statements\nsee notes",
     {"one": "We sell.", "risk": LONG.strip(), "talk": "Up.", "numbers": "see notes"}),
    # A heading out of order is text of the section it stands in.
    (f"Item 7. Discussion\n{LONG}\nItem 1A. Risk Factors\nas before\nItem 8. Statements\nx", {"talk": f"{LONG}\nItem 1A. Risk Factors\nas before", "numbers": "x"}),
    ("Item 7, Management's view\na\nITEM 8—Statements\n b ", {"talk": "a", "numbers": "b"}),
    ("Item 7A. x\ny\nItem 21. z\nItem 99\nItem 7", {}), ("", {}), (None, {}), ("no headings", {}),
])
def test_bodies(spark, text, expected):
    assert bodies(spark, text) == expected


def plain_chain(pieces):
    """The best of all chains of (place, chars)."""
    best = (0, 0, ())
    for n in range(1, len(pieces) + 1):
        for at in combinations(range(len(pieces)), n):
            if all(pieces[a][0] < pieces[b][0] for a, b in zip(at, at[1:])):
                best = max(best, (n, sum(min(pieces[i][1], MOST_CHARS) for i in at), at))
    return best[2]


def test_chains_equal_all_chains(spark):
    draw, texts, wanted = random.Random(6), [], []
    items = ["1", "1A", "1B", "2", "7", "7A", "8"]
    for case in range(60):
        picked = [(draw.choice(items), draw.choice([3, 40, 1500, 3000])) for _ in range(draw.randint(1, 9))]
        pieces = [f"Item {item}. Title\n{case}-{i} {'x' * n}\n" for i, (item, n) in enumerate(picked)]
        texts.append((case, "".join(pieces)))
        places = [(4 * int(re.match(r"\d+", item)[0]) + "abc".find(item[-1].lower()) + 1, len(p)) for (item, _), p in zip(picked, pieces)]
        chain = plain_chain(places)
        for at, after in zip(chain, [*chain[1:], len(pieces)]):
            wanted.append((case, picked[at][0], "".join(pieces[at:after]).split("\n", 1)[1].strip()))
    rows = extract_sections(spark.createDataFrame(texts, "id int, text string"), {i: i for i in items}).collect()
    assert sorted((r.id, r.section, r.text) for r in rows) == sorted(wanted)


def test_many_candidates(spark):
    text = "".join(f"Item {i % 15 + 1}. Title\nbody {i}\n" for i in range(3000))
    rows = extract_sections(spark.createDataFrame([(1, text)], "id int, text string"), {"1": "one", "15": "last"}).collect()
    assert len(rows) == 2
