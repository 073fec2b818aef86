"""Scalar expressions over filings, labels and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line breaks come from these tags; every other tag is dropped where it stands.
BLOCK_TAGS = "p|div|br|h[1-6]|li|ul|ol|tr|table|section|article|header|footer|hr|pre|blockquote"
# Named entities; the ampersand comes last, so that what it uncovers is not read as another one.
ENTITIES = [
    ("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("ndash", "\u2013"), ("mdash", "\u2014"),
    ("lsquo", "\u2018"), ("rsquo", "\u2019"), ("ldquo", "\u201c"), ("rdquo", "\u201d"), ("bull", "\u2022"),
    ("hellip", "\u2026"), ("copy", "\u00a9"), ("reg", "\u00ae"), ("trade", "\u2122"), ("sect", "\u00a7"), ("para", "\u00b6"),
    ("middot", "\u00b7"), ("deg", "\u00b0"), ("euro", "\u20ac"), ("pound", "\u00a3"), ("cent", "\u00a2"), ("frac12", "\u00bd"),
    ("eacute", "\u00e9"), ("emsp", " "), ("ensp", " "), ("thinsp", " "), ("amp", "&"),
]
# White space of every script and the control characters that count as such.
BLANK = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Blanks that stand for a plain one inside a line of a filing.
WIDE_BLANKS = "\u00a0" + "".join(map(chr, range(0x2000, 0x200C))) + "\u202f\u3000"


def or_default(value: Column, default: Column | str) -> Column:
    """`value`, or the default when it is null or empty."""
    other = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(value, F.lit("")), other)


def strip_space(value: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(value, rf"^{BLANK}+|{BLANK}+$", "")


def plain_blanks(text: Column) -> Column:
    """Non-breaking and other wide blanks as plain ones."""
    return F.translate(text, WIDE_BLANKS, " " * len(WIDE_BLANKS))


def decode_entities(text: Column) -> Column:
    """Numeric and the usual named entities as their characters; unknown ones and impossible numbers stay."""
    def character(piece: Column) -> Column:
        digits = F.regexp_extract(piece, r"^&#([xX]?[0-9a-fA-F]{1,7});", 1)
        hexed = F.when(F.lower(digits).startswith("x"), F.substring(digits, 2, 7)).otherwise(F.conv(digits, 10, 16))
        code = F.conv(hexed, 16, 10).cast("int")
        possible = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        decoded = F.decode(F.unhex(F.lpad(F.when(possible, hexed), 8, "0")), "UTF-32")
        rest = F.regexp_replace(piece, r"^&#[xX]?[0-9a-fA-F]{1,7};", "")
        return F.when(possible, F.concat(F.when(code == 0xA0, F.lit(" ")).otherwise(decoded), rest)).otherwise(piece)

    # `text` stands here once: it is a long expression, which a condition would evaluate again.
    out = F.array_join(F.transform(F.split(text, r"(?=&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});)"), character), "")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def main_document(submission: Column) -> Column:
    """Text of the first document of a full submission; the whole when it has no such part."""
    return or_default(F.regexp_extract(submission, r"(?is)<DOCUMENT>.*?<TEXT>(.*?)</TEXT>", 1), submission)


def filing_url(accession: Column, path: Column) -> Column:
    """Address of a filing document in the public archive, built from its accession number."""
    digits = F.regexp_extract(accession, r"^(\d+)-\d+-\d+", 1)
    cik = (
        F.when(digits == "", F.lit("0" * 10))
        .when(F.length(digits) >= 10, digits)
        .otherwise(F.lpad(digits, 10, "0"))
    )
    return F.concat(
        F.lit("https://www.sec.gov/Archives/edgar/data/"), cik, F.lit("/"),
        F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"),
        F.element_at(F.split(path, "/"), -1),
    )


def filing_label(filing_type: Column, date: Column) -> Column:
    return F.concat(
        F.coalesce(filing_type, F.lit("N/A")), F.lit(" ("), F.coalesce(date, F.lit("N/A")), F.lit(")")
    )


def company_label(name: Column, ticker: Column) -> Column:
    return F.concat(name, F.lit(" ("), ticker, F.lit(")"))


def chunk_id(ticker: Column, filing_type: Column, accession: Column, section: Column, index: Column) -> Column:
    """Unique over filings and sections of a ticker: an underscore inside a part is doubled."""
    parts = [
        F.replace(F.coalesce(c.cast("string"), F.lit("NA")), F.lit("_"), F.lit("__"))
        for c in (ticker, filing_type, accession, section, index)
    ]
    return F.concat_ws("_", *parts)


def chunk_metadata(
    ticker: Column, company: Column, filing_type: Column, date: Column,
    accession: Column, section: Column, index: Column,
) -> Column:
    """The flat metadata record of a chunk with its defaults."""
    return F.struct(
        or_default(company, ticker).alias("company"),
        ticker.alias("ticker"),
        filing_type.alias("filing_type"),
        or_default(date, "Unknown").alias("date"),
        accession.alias("accession_number"),
        section.alias("section"),
        index.cast("int").alias("chunk_index"),
    )


def context_block(metadata: Column, content: Column) -> Column:
    def part(name: str) -> Column:
        return F.coalesce(metadata[name], F.lit("N/A"))

    return F.concat(
        F.lit("Source: "), part("filing_type"), F.lit(" ("), part("company"), F.lit(", "), part("date"),
        F.lit("), Section: "), part("section"), F.lit("\nContent: "), content,
    )


def annotate_selection(query: Column, companies: Column) -> Column:
    """Append the selected companies to a message, if there are any."""
    note = F.concat(F.lit(" (Companies selected: "), F.array_join(companies, ", "), F.lit(")"))
    return F.concat(query, F.when(F.size(companies) > 0, note).otherwise(F.lit("")))


def strip_selection(content: Column) -> Column:
    """Remove the first selection note, then trim."""
    pattern = r"(?s)^(.*?)\(Companies selected:[^\n\r]*?\)(.*)$"
    return strip_space(F.regexp_replace(content, pattern, "$1$2"))


def year_of_date(date: Column) -> Column:
    """Year of a text date when it is a plausible one, else null."""
    year = F.substring(date, 1, 4).try_cast("int")
    return F.when(year.between(1990, 2030), year)


def years_in_text(content: Column) -> Column:
    """Distinct years 1900 to 2099 named in a text, ascending."""
    found = F.regexp_extract_all(content, F.lit(r"\b(?:19|20)\d{2}\b"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda y: y.cast("int"))))


def html_to_text(html: Column) -> Column:
    """Readable text of a page: its article or body, without scripts, comments and tags."""
    article = F.regexp_extract(html, r"(?is)<article[^>]*>(.*)</article>", 1)
    body = F.regexp_extract(html, r"(?is)<body[^>]*>(.*)</body>", 1)
    out = or_default(article, or_default(body, html))
    out = F.regexp_replace(out, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "")
    out = F.regexp_replace(out, rf"(?i)</?(?:{BLOCK_TAGS})(?:\s[^>]*)?/?>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    out = decode_entities(out)
    out = F.regexp_replace(out, r"[ \t\r]+", " ")
    out = F.regexp_replace(out, r" ?\n[ \n]*", "\n")
    return strip_space(out)


def valid_utf8(binary: Column) -> Column:
    """Text of file bytes; bytes that are not UTF-8 become the replacement character."""
    return F.make_valid_utf8(binary.cast("string"))
