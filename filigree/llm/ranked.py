"""Ranked lexical search by NRA (no random access) over impact-sorted lists.

The index is one row for each document: its terms, how often each occurs, and its length. A search deals it over
tasks in runs of documents. A run makes one list for each asked term, sorted by falling impact, and reads the lists of an
item from the front only, in steps that double. Every document read so far has a lower bound (the impacts seen)
and an upper bound (for each list it was not yet seen in, that list's next impact is added); a document never seen
is bounded by the sum of all next impacts. Reading goes on until every document whose upper bound reaches the k-th
lower bound has equal bounds, so members, ties and scores of the run are final. The k best of each run are complete
candidates for the whole, since a score needs only its own document and corpus counts; a window takes the k best of those.

Neither postings nor scored pairs are shuffled. Items lie in blocks in the shared folder and are read one block after
the other by each run.

Defined results: rows of one item_id, also null, are one item with the terms of all of them; every row of documents is a
document of its own; of equal scores the smaller doc_id is first, null before all; a null text has no term, and an item
or document without a term has no result; a table without terms gives no row; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.llm.text import id_and_text, utf8, word_blocks
from filigree.session import materialize, open_uri, scratch_path

#: Places of the ranking.
K = 20
#: Constants of the score: fixed values of the contract.
SCALE, SATURATION, SLOPE, FLOOR = 1_000_000_000, 12, 25, 75
#: Documents and postings of a run of the index in a task.
RUN_DOCS, RUN_POSTINGS = 1 << 16, 1 << 21
#: Terms of a block of items, on average.
BLOCK_TERMS = 200_000
#: Postings of each list that the first step reads.
FIRST_STEP = 64

#: Every byte that is no letter, digit or part of a character beyond ASCII becomes a blank; A-Z become a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(data: bytes) -> Counter:
    """How often each term occurs in a text, a bounded block of it at a time."""
    found: Counter = Counter()
    for words in word_blocks(data.translate(_FOLD), 0):
        found.update(words)
    return found


def count_terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The index: id, n (terms with repeats), and the parallel arrays terms and tfs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("text"))
            for at in range(0, len(texts), 512):
                counts = [term_counts(text) for text in texts[at:at + 512]]
                ends = np.cumsum([0, *map(len, counts)]).astype(np.int32)
                terms = pa.array([t for c in counts for t in c], pa.binary()).cast(pa.string())
                tfs = pa.array([n for c in counts for n in c.values()], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, 512), pa.array([sum(c.values()) for c in counts], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends), terms), pa.ListArray.from_arrays(pa.array(ends), tfs)],
                    ["id", "n", "terms", "tfs"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"id {kind}, n bigint, terms array<string>, tfs array<bigint>")


def weighted_items(items: DataFrame, index: DataFrame, docs_with_terms: int, id_col: str, text_col: str) -> DataFrame:
    """item, term, times (of the term in the item) and weight; terms that no document holds or that weigh nothing are left out."""
    counted = count_terms(items, id_col, text_col)
    asked = (
        counted.select(F.col("id").alias("item"), F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
        .groupBy("item", F.col("t.terms").alias("term")).agg(F.sum("t.tfs").alias("times"))
    )
    asked = materialize(asked, "asked-terms")
    held = index.select(F.explode("terms").alias("term"))
    df = held.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * docs_with_terms + 2)) / (2 * F.col("df") + 1).cast("double")))
    return asked.join(df, "term").select("item", "term", "times", weight.cast("bigint").alias("weight")).where("weight <> 0")


class Lists:
    """Impact-sorted lists of a run of documents for one block of terms."""

    def __init__(self, docs: np.ndarray, terms: np.ndarray, shares: np.ndarray, n_terms: int, n_docs: int):
        order = np.lexsort((docs, -shares, terms))
        self.docs, self.shares, self.n_docs = docs[order], shares[order], n_docs
        self.ends = np.concatenate(([0], np.cumsum(np.bincount(terms, minlength=n_terms))))

    def best(self, terms: np.ndarray, factors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the k best for an item: term numbers, and a factor for the shares of each.

        Ties at the k-th place are all given.
        """
        lists = [(a, b, f) for a, b, f in zip(self.ends[terms].tolist(), self.ends[terms + 1].tolist(), factors.tolist()) if a < b]
        lower = np.zeros(self.n_docs, np.int64)
        read, step = 0, FIRST_STEP
        while True:
            # A next impact is 0 once a list is read to its end.
            nexts, total = [], 0
            for a, b, factor in lists:
                part = slice(a + read, min(a + read + step, b))
                lower[self.docs[part]] += factor * self.shares[part]
                nexts.append(factor * int(self.shares[part.stop]) if part.stop < b else 0)
                total += nexts[-1]
            read, step = read + step, read + step
            kth = int(np.partition(lower, len(lower) - k)[len(lower) - k]) if len(lower) >= k else 0
            if total and kth <= total:
                continue
            unseen = np.full(self.n_docs, total, np.int64)
            for (a, b, _), following in zip(lists, nexts):
                if following:
                    unseen[self.docs[a:a + read]] -= following
            open_ = (lower + unseen >= kth) & (unseen > 0) & (lower > 0)
            if not open_.any():
                chosen = np.flatnonzero((lower >= kth) & (lower > 0))
                return chosen, lower[chosen]


def nra_search(
    docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
    run_docs: int = RUN_DOCS,
) -> DataFrame:
    """item, rank, id and score of the k best documents of each item."""
    spark = docs.sparkSession
    kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((docs, id_col), (items, item_col)))
    index = materialize(count_terms(docs, id_col, text_col), "term-counts")
    n_docs, n_terms = index.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    asked = weighted_items(items, index, n_docs, item_col, text_col)
    asked = materialize(asked, "weighted-items")
    blocks = max(1, math.ceil(asked.count() / BLOCK_TERMS))
    folder = scratch_path(spark, "item-blocks")
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    numbered.repartition("block").sortWithinPartitions("block", "item").write.partitionBy("block").parquet(folder)

    def read_block(number: int) -> pa.Table | None:
        fs, place = open_uri(f"{folder}/block={number}")
        if fs.get_file_info(place).type.name != "Directory":
            return None
        return ds.dataset(place, filesystem=fs, format="parquet").to_table()

    def search_run(run: pa.Table, block: pa.Table) -> Iterator[pa.RecordBatch]:
        vocabulary = pc.unique(block.column("term"))
        terms = run.column("terms").combine_chunks()
        places = pc.index_in(terms.flatten(), value_set=vocabulary)
        held = pc.is_valid(places).to_numpy(zero_copy_only=False)
        numbers = places.drop_null().to_numpy()
        rows = np.repeat(np.arange(run.num_rows), pc.list_value_length(terms).to_numpy())[held]
        tfs = run.column("tfs").combine_chunks().flatten().to_numpy()[held]
        # Whole numbers of any size, as a long document of a large corpus would not fit into 64 bits here.
        m = np.array([FLOOR + SLOPE * n * n_docs // n_terms for n in run.column("n").to_pylist()], np.int64)
        shares = (SCALE * tfs) // (1000 * tfs + SATURATION * m[rows])
        lists = Lists(rows, numbers, shares, len(vocabulary), run.num_rows)
        own = pc.index_in(block.column("term").combine_chunks(), value_set=vocabulary).to_numpy()
        factors = block.column("times").to_numpy() * block.column("weight").to_numpy()
        item = block.column("item").combine_chunks()
        codes = item.dictionary_encode(null_encoding="encode")
        numbers_of = codes.indices.to_numpy()
        order = np.argsort(numbers_of, kind="stable")
        cuts = np.flatnonzero(np.diff(numbers_of[order])) + 1
        for part in np.split(order, cuts):
            found, scores = lists.best(own[part], factors[part], min(k, run.num_rows))
            if len(found):
                ids = run.column("id").combine_chunks().take(pa.array(found))
                if len(found) > k:
                    best = np.lexsort((pc.rank(ids, null_placement="at_start", tiebreaker="first").to_numpy(), -scores))[:k]
                    ids, scores = ids.take(pa.array(best)), scores[best]
                yield pa.RecordBatch.from_arrays([item.take(pa.array(np.full(len(ids), part[0]))), ids, pa.array(scores)], ["item", "id", "score"])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []
        docs_held = postings = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                pending.append(part)
                docs_held += part.num_rows
                postings += len(part.column("terms").flatten())
                if docs_held >= run_docs or postings >= RUN_POSTINGS:
                    yield from search_all(pending)
                    pending, docs_held, postings = [], 0, 0
        if pending:
            yield from search_all(pending)

    def search_all(pending: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.Table.from_batches(pending)
        for number in range(blocks):
            block = read_block(number)
            if block is not None and block.num_rows:
                yield from search_run(run, block)

    found = index.where("n > 0").mapInArrow(scan, f"item {item_kind}, id {kind}, score bigint")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_first())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item", "rank", "id", "score")


def oracle_sql() -> str:
    """The query over the given tables in SQL: every document scored for every item."""
    return r"""
        with d as (
            select row_number() over () as r, doc_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
        q as (
            select item_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
        tf as (select r, doc_id, term, count(*) as tf from d group by all),
        len as (select r, sum(tf)::bigint as n from tf group by r),
        total as (select count(*) as docs, sum(n)::bigint as terms from len),
        df as (select term, count(*) as df from tf group by term),
        asked as (
            select item_id, term, count(*) as times, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w
            from q join df using (term), total group by item_id, term, df, docs),
        scored as (
            select item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms))))::bigint as score
            from asked join tf using (term) join len using (r), total group by item_id, r, doc_id),
        placed as (
            select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls first)::int as rank, doc_id, score
            from scored where score > 0)
        select item_id, rank, doc_id, score from placed where rank <= 20"""
