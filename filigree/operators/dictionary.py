"""Rules of a dictionary table against texts, without an expression per keyword.

A keyword of at most Q characters is itself a q-gram, so the texts' q-grams find it in an equi-join that needs no test.
A keyword that holds a shorter one of these in its own rule can add nothing to the rule and is left out. Every other keyword is
looked up by one of its q-grams, the one that the fewest texts hold, and only pairs found there are tested with
`contains`, each word once whatever the number of its rules. The plan is the same for ten keywords and for millions; its cost
grows with the texts and with the pairs that share a rare q-gram.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filigree.session import materialize

#: Characters of a q-gram; shorter keywords are their own.
Q = 3


#: Rows of grams that a task hands on at once.
BATCH_GRAMS = 1 << 20


def _grams(text: bytes | None, sizes: list[int]) -> np.ndarray:
    """The distinct runs of as many characters as `sizes` say, as numbers of 21 bits a character."""
    points = np.frombuffer((text or b"").decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.int64) + 1
    found = [np.zeros(0, np.int64)]
    for q in sizes:
        code = points[:max(0, len(points) - q + 1)]
        for i in range(1, q):
            code = code << 21 | points[i:i + len(code)]
        found.append(np.unique(code))
    return np.concatenate(found)


def gram_rows(texts: DataFrame, keys: list[str], text: str, sizes: list[int]) -> DataFrame:
    """(keys, gram): a row for each text and distinct gram of it, counted where the text is read."""
    schema = T.StructType([*[texts.schema[key] for key in keys], T.StructField("gram", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batch: pa.RecordBatch, held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            line = np.repeat([i for i, _ in held], [len(g) for _, g in held])
            own = [batch.column(key).take(pa.array(line, pa.int64())) for key in keys]
            return pa.RecordBatch.from_arrays([*own, pa.array(np.concatenate([g for _, g in held]))], schema.fieldNames())

        for batch in batches:
            held, n = [], 0
            for i, value in enumerate(batch.column("_bytes")):
                held.append((i, _grams(value.as_py(), sizes)))
                n += len(held[-1][1])
                if n >= BATCH_GRAMS:
                    yield rows(batch, held)
                    held, n = [], 0
            if n:
                yield rows(batch, held)

    return texts.select(*keys, F.col(text).cast("binary").alias("_bytes")).mapInArrow(run, schema)


def keyed_words(words: DataFrame, held: DataFrame) -> DataFrame:
    """(word, gram) with the gram of the fewest texts. `words`: word and any gram of it; `held`: a row for each text and gram."""
    counts = held.join(words.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    # A keyword with a gram that no text holds occurs nowhere.
    counted = words.join(counts, "gram", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    rarest = counted.groupBy("word").agg(F.min(F.struct("texts", "gram")).alias("rarest")).where("rarest.texts > 0")
    return rarest.select("word", F.col("rarest.gram").alias("gram"))


def match_dictionary(texts: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (`key`, rule) for each text and rule with a keyword in it, in any case.

    `dictionary`: rule, word; blank and null words match nothing. Rows of one key count as one text in parts.
    """
    words = dictionary.select(F.lower("word").alias("word"), "rule").where("word is not null and trim(word) <> ''").distinct()
    words = materialize(words, "words")
    sizes = sorted(r[0] for r in words.select(F.least(F.length("word"), F.lit(Q))).distinct().collect())
    if not sizes:
        return texts.select(key, F.lit(None).cast(words.schema["rule"].dataType).alias("rule")).limit(0)

    # A byte that is no UTF-8 is read as U+FFFD, so keywords with that character are tested.
    is_gram = (F.length("word") <= Q) & F.is_valid_utf8("word") & ~F.contains("word", F.lit("\ufffd"))
    own = materialize(gram_rows(words, ["word", "rule"], "word", sizes), "word-grams")
    # A word of at most Q characters holds the gram that it is itself and shorter ones, whose numbers are smaller.
    small = own.where(is_gram).groupBy("word", "rule").agg(F.max("gram").alias("gram"))
    same = (F.col("word") == F.col("_word")) & F.col("rule").eqNullSafe(F.col("_rule"))
    holds = own.join(small.select("gram", F.col("word").alias("_word"), F.col("rule").alias("_rule")), "gram")
    idle = holds.where((F.col("word") != F.col("_word")) & F.col("rule").eqNullSafe(F.col("_rule"))).select(
        F.col("word").alias("_word"), F.col("rule").alias("_rule")).distinct()
    words = materialize(words.join(idle, same, "left_anti"), "words-needed")
    low = texts.select(key, F.lower(F.col(text)).alias("low")).where("low is not null")
    held = gram_rows(low, [key], "low", sizes)
    needed = small.join(words.select(F.col("word").alias("_word"), F.col("rule").alias("_rule")), same, "left_semi")
    direct = materialize(held.join(needed.select("gram", "rule"), "gram").select(key, "rule").distinct(), "direct")
    tested = words.where(~is_gram)
    if tested.isEmpty():
        return direct
    keyed = materialize(keyed_words(own.join(tested.select("word").distinct(), "word", "left_semi").select("word", "gram").distinct(), held), "keyed-words")
    pairs = held.join(keyed, "gram").join(tested, "word").select(F.col(key).alias("_key"), "word", "rule")
    known = direct.groupBy(F.col(key).alias("_known")).agg(F.collect_set("rule").alias("rules"))
    low = low.join(known, F.col(key).eqNullSafe(F.col("_known")), "left")
    fresh = ~F.coalesce(F.array_contains("rules", F.col("rule")), F.lit(False))
    found = low.join(pairs, F.col(key).eqNullSafe(F.col("_key"))).where(fresh & F.contains("low", F.col("word"))).select(key, "rule")
    return direct.union(found).distinct()
