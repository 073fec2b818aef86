"""Keyword tests. All of them are case-insensitive substring tests, not word tests.

Tests are OR chains of `contains` on a column lower-cased once, which stay inside generated
code and stop at the first hit; array lambdas would be interpreted per element.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains_any(lowered: Column, words: Iterable[str]) -> Column:
    """True when the already lower-cased text contains one of the words."""
    tests = [F.contains(lowered, F.lit(word)) for word in words]
    return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))


def tags(lowered: Column, dictionary: Mapping[str, Iterable[str]]) -> Column:
    """Names whose words occur in the text, in dictionary order.

    Nulls are removed with `array_except`: unlike `array_compact` it has generated code, which
    keeps the whole projection compiled. Names are unique, so nothing else is removed.
    """
    hits = [F.when(contains_any(lowered, words), F.lit(name)) for name, words in dictionary.items()]
    return F.array_except(F.array(*hits), F.array(F.lit(None).cast("string")))


def word_tags(lowered: Column, words: Iterable[str]) -> Column:
    """The words themselves that occur in the text, as spelled in the list."""
    return tags(lowered, {word: [word.lower()] for word in words})


def with_lowered(df: DataFrame, text: str, name: str = "_low") -> DataFrame:
    return df.withColumn(name, F.lower(F.col(text)))


def literal_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(value) for value in values]).cast("array<string>")
