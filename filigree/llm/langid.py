"""Language ID by sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character n-grams of one to three characters over lower-cased letters (all else is a
blank). Document frequencies cover all documents that may be learned from. Weights are learned on a
bounded sample (`SAMPLE` rows, spread evenly over the languages) by follow-the-regularised-leader
with an elastic net, which leaves most weights at zero; a temperature is then fitted on the part of
the sample that was not learned from. A prediction sums one weight per position and language, so it is linear in the
text and needs no sparse vector.

Defined results: a null text or one without a letter is `und` with score 0, and so is every text if there was
nothing to learn from; repeated rows and null ids each give a row; an empty table gives an empty result; other columns of the
input are not read, save the label where it is learned from.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.llm.text import arrow_map, id_and_text, labelled_sample, strings

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
ORDERS = 3
#: Rows that weights are learned from at most, in total, and passes over them.
SAMPLE, EPOCHS = 2_400, 4
#: Learning rate, its offset, and the two penalties of the elastic net.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
#: Factor that brings relative frequencies into the range the learning rate is meant for.
SCALE = 100.0
#: Share of the sample that fits the temperature alone: one row in five.
HELD = 5
UNKNOWN = "und"
BLOCK = 1 << 20

_WORD = re.compile(r"[^\W\d_]")
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]
_FOLDED: list[np.ndarray] = []


def has_letter(text: str) -> bool:
    """Whether any character is a letter; digits and numbers of any kind are none."""
    return any(found[0].isalpha() for found in _WORD.finditer(text))


def folded() -> np.ndarray:
    """Code point to its lower-cased letter, or to a blank."""
    if not _FOLDED:
        table = np.full(sys.maxunicode + 1, 32, np.uint32)
        for point in range(sys.maxunicode + 1):
            char = chr(point)
            if char.isalpha():
                lower = char.lower()
                table[point] = ord(lower) if len(lower) == 1 else point
        _FOLDED.append(table)
    return _FOLDED[0]


def gram_blocks(text: str) -> Iterator[list[np.ndarray]]:
    """Buckets of the n-grams that begin at each character, an array for each order, a block of text at a time."""
    points = folded()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    for at in range(0, len(points), BLOCK):
        part = points[at:at + BLOCK + ORDERS - 1].astype(np.uint64)
        n = min(BLOCK, len(points) - at)
        part = np.concatenate((part, np.full(n + ORDERS - 1 - len(part), 32, np.uint64)))
        mixed, out = np.zeros(n, np.uint64), []
        for order in range(ORDERS):
            mixed = (mixed + part[order:order + n] + np.uint64(order)) * _MIX[order]
            out.append((mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
        yield out


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each occurs."""
    total = np.zeros(BUCKETS, np.int64)
    for block in gram_blocks(text):
        for grams in block:
            total += np.bincount(grams, minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found.astype(np.int32), total[found]


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Number of documents with each bucket, and of documents, over all rows of `text`."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, documents = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in strings(batch.column(0)):
                seen = np.zeros(BUCKETS, bool)
                for block in gram_blocks(text):
                    for grams in block:
                        seen[grams] = True
                total += seen
                documents += 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(found, -1).astype(np.int32)), pa.array(np.append(total[found], documents))], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out, documents = np.zeros(BUCKETS, np.int64), 0
    for bucket, n in rows.collect():  # at most one row for each bucket
        if bucket < 0:
            documents = n
        else:
            out[bucket] = n
    return out, documents


class FTRL:
    """Multinomial logistic regression learned one row at a time; weights stay zero within the L1 penalty."""

    def __init__(self, classes: int, features: int):
        self.z = np.zeros((classes, features))
        self.n = np.zeros((classes, features))

    def weights(self, features: np.ndarray) -> np.ndarray:
        z, n = self.z[:, features], self.n[:, features]
        shrunk = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) > L1, shrunk, 0.0)

    def learn(self, features: np.ndarray, values: np.ndarray, label: int) -> None:
        weights = self.weights(features)
        wrong = softmax(weights @ values)
        wrong[label] -= 1
        gradient = wrong[:, None] * values[None, :]
        before = self.n[:, features]
        after = before + gradient * gradient
        self.z[:, features] += gradient - (np.sqrt(after) - np.sqrt(before)) / ALPHA * weights
        self.n[:, features] = after


def softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return raised / raised.sum(axis=-1, keepdims=True)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least negative log-likelihood, by golden-section search on its logarithm.

    Targets are smoothed as if two more rows had been seen, so that a sample without a mistake does not
    make every prediction certain.
    """
    rows, others = len(labels), max(1, logits.shape[1] - 1)
    target = np.full(logits.shape, 1 / (rows + 2) / others)
    target[np.arange(rows), labels] = (rows + 1) / (rows + 2)

    def loss(log_t: float) -> float:
        return float(-(target * np.log(np.maximum(softmax(logits / np.exp(log_t)), 1e-300))).sum())

    low, high, ratio = -4.0, 4.0, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass(frozen=True)
class LanguageModel:
    """Languages and, for each bucket, a weight per language with IDF and scale inside."""

    languages: list[str]
    table: np.ndarray
    temperature: float

    def predict(self, text: str) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        logits, n = np.zeros(len(self.languages)), 0
        for block in gram_blocks(text):
            for grams in block:
                logits += self.table[grams].sum(axis=0, dtype=np.float64)
                n += len(grams)
        chances = softmax(logits / n / self.temperature)
        best = int(chances.argmax())
        return self.languages[best], float(chances[best])


def train(docs: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> LanguageModel:
    """Learn from rows whose label is not null. Which rows are in the sample is settled by a hash of their id."""
    known = docs.where(F.col(label_col).isNotNull())
    languages = sorted(r[0] for r in known.select(label_col).distinct().collect())
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), 1.0)
    known = known.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.coalesce(text_col, F.lit("")).alias("text"))
    frequency, documents = document_frequencies(known)
    idf = np.log((1 + documents) / (1 + frequency)) + 1

    each = max(1, sample // len(languages))
    chosen = labelled_sample(known.select("id", "label"), each)
    held = F.col("place") % HELD == 0
    chosen = chosen.select("id", "label", held.alias("held"), F.xxhash64("id").alias("turn"))  # at most `sample` rows
    rows = known.select("id", "label", "text").join(F.broadcast(chosen), ["id", "label"])
    # An id may be repeated any number of times: one of its texts is enough.
    rows = rows.groupBy("turn", "label", "held").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [counts(text) for text in strings(batch.column("text"))]
        return [batch.column("turn"), batch.column("label"), batch.column("held"),
                pa.array([f.tolist() for f, _ in found], pa.list_(pa.int32())),
                pa.array([c.tolist() for _, c in found], pa.list_(pa.int64()))]

    names = ["turn", "label", "held", "features", "counts"]
    schema = "turn bigint, label string, held boolean, features array<int>, counts array<bigint>"
    got = arrow_map(rows.select("turn", "label", "held", "text"), schema, columns, names).where("size(features) > 0").collect()
    got.sort(key=lambda r: (r.turn, r.label, r.features))
    vectors = []
    for row in got:
        features, n = np.array(row.features), np.array(row.counts, float)
        vectors.append((features, SCALE * n / n.sum() * idf[features], languages.index(row.label), row.held))
    return fit(vectors, languages, idf)


def fit(vectors: list, languages: list[str], idf: np.ndarray) -> LanguageModel:
    model = FTRL(len(languages), BUCKETS)
    for _ in range(EPOCHS):
        for features, values, label, held in vectors:
            if not held:
                model.learn(features, values, label)
    everything = model.weights(np.arange(BUCKETS))
    held = [(everything[:, f] @ v, label) for f, v, label, h in vectors if h]
    temperature = fit_temperature(np.array([x for x, _ in held]), np.array([y for _, y in held])) if held else 1.0
    return LanguageModel(languages, (everything * idf * SCALE).T.astype(np.float32).copy(), temperature)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score (calibrated chance of that language) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [shared.value.predict(text) for text in strings(batch.column("text"))]
        return [batch.column("id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]

    schema = f"id {kind}, lang_pred string, score double"
    return arrow_map(id_and_text(docs, id_col, text_col), schema, columns, ["id", "lang_pred", "score"])


def keep_identified(docs: DataFrame, model: LanguageModel, least: float, text_col: str = "text") -> DataFrame:
    """`docs` without the rows that no language is found for, or none with a score of `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(text) for text in strings(batch.column(place))]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
