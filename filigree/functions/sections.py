"""Bodies of the items of an annual report, by the sequence of its headings.

Every line that begins with an item number is a candidate. Of all chains of candidates whose items strictly increase
along the text, the longest is taken, so that an entry of the contents or a reference at the start of a wrapped line, which stand
out of order or only repeat an item, lose. Of chains of one length the one with more text below its headings is taken (each
counts up to `MOST_CHARS`, an entry with a page number nothing), of equal ones the later. A line that goes on like a sentence after
its number ("Item 7 of this report") is never a heading. The text below a heading ends at the next heading of the chain.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filigree.functions.text import plain_blanks, strip_space

ITEM = r"item[ \t]+(\d{1,2}[a-c]?)\b"
#: Numbers of items reach 20 at most; each has room for itself and the letters a to c.
LAST_ITEM = 20
PLACES = 4 * (LAST_ITEM + 1)
#: Characters below a heading that make it count in full.
MOST_CHARS = 2_000
#: What follows the number where the line is part of a sentence.
REFERENCE = (
    rf"(?i:\A[ \t]*{ITEM})[ \t]*[,;)\"'\u201d\u2019]*[ \t]*(?:(?:of|in|above|below|to|and|or|for|from|under|on|at|by|with|as|is|are|was|were|"
    r"has|have|which|that|this|herein|hereof|see|also|contains?|includes?|entitled|titled|captioned)\b|[,;][ \t]*[a-z])"
)
#: A line of the contents: the title, then dots or wide space, and the page.
CONTENTS = r"(?:\.{3,}|[ \t.]{3,}|\t|\u2026)[ \t]*\d{1,3}[ \t]*\Z"
STATE = f"array_repeat(named_struct('n', 0, 'chars', 0, 'at', cast(array() as array<int>)), {PLACES + 1})"


def candidates(text: Column) -> Column:
    """The text cut in front of every line that begins with an item number. Wide blanks count as plain ones."""
    return F.split(plain_blanks(text), rf"(?im)(?=^[ \t]*{ITEM})")


def _place(piece: Column) -> Column:
    """Place of a candidate's item in the order of items, from 1; null for what is no heading."""
    item = F.regexp_extract(piece, rf"(?i)\A[ \t]*{ITEM}", 1)
    number = F.regexp_extract(item, r"^\d+", 0).try_cast("int")
    letter = F.instr(F.lit("abc"), F.lower(F.regexp_extract(item, "[a-cA-C]$", 0)))
    place = 4 * number + F.when(item.rlike("[a-cA-C]$"), letter).otherwise(0) + 1
    return F.when(number.between(1, LAST_ITEM) & ~piece.rlike(REFERENCE), place)


def _chars(piece: Column) -> Column:
    line = F.regexp_extract(piece, r"\A[^\n]*", 0)
    return F.when(line.rlike(CONTENTS), 0).otherwise(F.least(F.length(piece), F.lit(MOST_CHARS)))


def heading_chain(pieces: Column) -> Column:
    """Numbers of the pieces (from 0) that begin with a heading of the chosen chain.

    One pass over the candidates keeps, for every item, the best chain that ends with it.
    """
    found = F.filter(
        F.transform(pieces, lambda p, i: F.struct(i.alias("i"), _place(p).alias("place"), _chars(p).alias("chars"))),
        lambda c: c["place"].isNotNull())

    def add(best: Column, c: Column) -> Column:
        before = F.array_max(F.slice(best, F.lit(1), c["place"]))
        longer = F.struct((before["n"] + 1).alias("n"), (before["chars"] + c["chars"]).alias("chars"),
                          F.concat(before["at"], F.array(c["i"])).alias("at"))
        return F.concat(
            F.slice(best, F.lit(1), c["place"]), F.array(F.greatest(F.element_at(best, c["place"] + 1), longer)),
            F.slice(best, c["place"] + 2, F.lit(PLACES)))

    return F.array_max(F.aggregate(found, F.expr(STATE), add))["at"]


def section_bodies(pieces: Column, chain: Column) -> Column:
    """Array of (item, body) along the chain; the heading's own line is left out of the body."""
    ends = F.concat(F.slice(chain, F.lit(2), F.lit(PLACES)), F.array(F.size(pieces)))

    def body(at: Column, k: Column) -> Column:
        whole = F.array_join(F.slice(pieces, at + 1, ends[k] - at), "")
        return F.struct(
            F.upper(F.regexp_extract(whole, rf"(?i)\A[ \t]*{ITEM}", 1)).alias("item"),
            strip_space(F.regexp_replace(whole, r"\A[^\n]*\n?", "")).alias("body"))

    return F.transform(chain, body)
