"""Extractive summaries and comparisons of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.functions.text import strip_space
from filigree.operators import terms as tf
from filigree.session import materialize


def sentences(text: Column) -> Column:
    """A text split at `. `; white space around a sentence and blank sentences are dropped."""
    parts = F.transform(F.split(text, r"\. "), strip_space)
    return F.filter(parts, lambda s: s != "")


def summarize_extractive(
    documents: DataFrame, key: str = "doc_id", text: str = "text", max_words: int = 150,
    boost: list[str] | None = None, words: tf.Vocabulary | None = None,
) -> DataFrame:
    """(key, summary, n_words): the best sentences of each text within the word limit, in text order.

    A sentence scores the mean idf of its terms (a boosted term counts twice), rounded to 6
    places; ties go to the earlier one. Sentences are taken by score while the sum of their
    words stays within the limit, and the first that exceeds it ends the summary. The best
    sentence is always taken. A text without a sentence has an empty summary.
    """
    if words is None:
        words = tf.vocabulary(materialize(tf.counted_terms(documents, [key], text), "terms"))
    split = documents.select(key, F.posexplode_outer(sentences(F.col(text))).alias("pos", "sentence"))
    split = split.withColumns({"pos": F.coalesce("pos", F.lit(0)), "sentence": F.coalesce("sentence", F.lit(""))})
    scores = tf.idf_sums(tf.counted_terms(split, [key, "pos", "sentence"], "sentence"), [key, "pos"], words, boost)
    scored = scores.select(
        key, "pos", "sentence", F.when(F.col("sentence") == "", 0).otherwise(F.size(F.split("sentence", r"\s+"))).alias("n"),
        F.round(F.coalesce("mean_idf", F.lit(0.0)), 6).alias("score"),
    )
    best = Window.partitionBy(key).orderBy(F.desc("score"), "pos")
    running = F.sum("n").over(best.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    taken = scored.withColumn("running", running).filter((F.col("running") <= max_words) | (F.col("running") == F.col("n")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "sentence")))
    return taken.groupBy(key).agg(
        F.array_join(F.transform(ordered, lambda s: s["sentence"]), ". ").alias("summary"),
        F.sum("n").alias("n_words"),
    )


def compare_texts(pairs: DataFrame, texts: str = "texts", focus: list[str] | None = None) -> DataFrame:
    """Add shared_terms, own_terms (per text, in no other) and jaccard of the texts of a row.

    Works on any number of texts in one row; `focus` limits the comparison to those terms. A
    row with fewer than two texts gets nulls.
    """
    def distinct(text: Column) -> Column:
        found = F.array_distinct(tf.terms(text))
        kept = F.array_intersect(found, F.array(*[F.lit(f.lower()) for f in focus])) if focus else found
        return F.array_sort(kept)

    enough = F.size(texts) >= 2
    rows = pairs.withColumn("_t", F.when(enough, F.transform(texts, distinct)))
    every = F.array_distinct(F.flatten("_t"))
    shared = F.aggregate(F.slice("_t", F.lit(2), F.size("_t")), F.get("_t", F.lit(0)), F.array_intersect)
    rows = rows.withColumns({"_all": every, "shared_terms": shared})

    def own(terms: Column, i: Column) -> Column:
        others = F.flatten(F.filter("_t", lambda _, j: j != i))
        return F.array_except(terms, others)

    return rows.withColumns({
        "own_terms": F.transform("_t", own),
        "jaccard": F.round(F.try_divide(F.size("shared_terms"), F.size("_all")), 4),
    }).drop("_t", "_all")


def compare_weights(pairs: DataFrame, words: tf.Vocabulary, key: str = "pair_id", texts: str = "texts") -> DataFrame:
    """(key, other, cosine): tf-idf cosine of the first text of a row with each other one.

    Products are summed where the texts of a row are read; only rare terms are rows of their own, to fetch their
    idf. The cosine with a text without terms is 0. `key` is unique.
    """
    found = tf.cosines(pairs.filter(F.size(texts) >= 2), key, texts, words)
    return found.withColumn("cosine", F.round(F.coalesce("cosine", F.lit(0.0)), 4))
