"""Company search for a table of typed texts, with spelling mistakes.

A text finds the companies whose label contains it, as `search_companies`, and those with a word at a small edit distance.
Both are equi-joins: `contains` by the rarest q-gram of a text (`match_dictionary`), distances by deletions. Two
words within d edits have a text in common that either becomes by deleting at most d characters, so all pairs within d meet
there, and `levenshtein` decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.functions.text import company_label
from filigree.operators.dictionary import match_dictionary
from filigree.session import materialize

#: Edits that are forgiven: none below 4 characters, one below 8, two from there on.
ONE_FROM, TWO_FROM = 4, 8
WORD = r"[\p{L}\p{N}]+"


def allowed_edits(text: Column) -> Column:
    return F.when(F.length(text) >= TWO_FROM, 2).when(F.length(text) >= ONE_FROM, 1).otherwise(0)


def deletions(word: Column, most: Column) -> Column:
    """The distinct texts that a word becomes when at most `most` (0 to 2) of its characters are deleted."""
    def without_one(text: Column) -> Column:
        places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))

    none = F.array().cast("array<string>")
    first = F.when(most >= 1, F.array_distinct(without_one(word))).otherwise(none)
    second = F.when(most >= 2, F.flatten(F.transform(first, without_one))).otherwise(none)
    return F.array_distinct(F.concat(F.array(word), first, second))


def search_many(companies: DataFrame, typed: DataFrame, k: int = 10) -> DataFrame:
    """(search_id, rank, ticker, name, distance): the k best companies for each typed text (search_id, text).

    Labels that contain the text come first (distance 0, as for an equal word), then those with a word within the forgiven
    edits, the nearest first; ties go by label and ticker. A blank text finds nothing.
    """
    rows = companies.select("ticker", "name").distinct().withColumn("label", company_label(F.col("name"), F.col("ticker")))
    rows = materialize(rows.where("label is not null").withColumn("company", F.monotonically_increasing_id()), "companies")
    asked = materialize(typed.select("search_id", F.lower(F.trim("text")).alias("text")).where("text <> ''").distinct(), "typed")
    # Many type the same: every text is looked up once.
    texts = asked.select("text").distinct()
    inside = match_dictionary(rows, texts.select(F.col("text").alias("rule"), F.col("text").alias("word")), "company", "label")
    inside = inside.select(F.col("rule").alias("text"), "company", F.lit(0).alias("place"), F.lit(0).alias("distance"))
    words = rows.select("company", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("label"), F.lit(WORD), F.lit(0)))).alias("word"))
    distinct = words.select("word").distinct().select("word", F.explode(deletions(F.col("word"), F.lit(2))).alias("rest"))
    edits = allowed_edits(F.col("text"))
    wanted = texts.select("text", edits.alias("edits"), F.explode(deletions(F.col("text"), edits)).alias("rest"))
    near = wanted.join(distinct, "rest").select("text", "edits", "word").distinct()
    near = near.withColumn("distance", F.levenshtein("text", "word")).where("distance <= edits")
    similar = near.join(words, "word").select("text", "company", F.lit(1).alias("place"), "distance")
    best = inside.union(similar).groupBy("text", "company").agg(F.min(F.struct("place", "distance")).alias("best"))
    order = Window.partitionBy("text").orderBy("best.place", "best.distance", "label", "ticker")
    found = best.join(rows, "company").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    found = found.select("text", "rank", "ticker", "name", F.col("best.distance").alias("distance"))
    return asked.join(found, "text").select("search_id", "rank", "ticker", "name", "distance")
