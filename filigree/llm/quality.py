"""Quality scores learned from preference pairs by a Bradley-Terry model.

A document is described by a fixed list of figures of its whole text. Pairs of a better and a worse
document, drawn from a bounded labelled sample (`SAMPLE` rows of each label, `PAIRS` pairs), give the weights
by logistic loss on the difference of their figures. The threshold is a quantile of the scores of
all labelled documents that may be learned from, at the share of worse ones among them; scores are
mapped to 0 to 1 so that this quantile falls on `CUT`.

Defined results: an empty or null text has figures of zero and a score like any other; without labels of
both kinds every score is 0.5; repeated rows and null ids each give a row; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.llm.text import arrow_map, id_and_text, labelled_sample, utf8, word_blocks
from filigree.session import materialize

#: Labelled rows of each label the weights are learned from at most, and pairs drawn from them.
SAMPLE, PAIRS = 1_500, 20_000
CUT = 0.3
PENALTY = 1e-3

_CLASS = np.zeros(256, np.int8)  # 0 other symbol, 1 lower, 2 upper, 3 digit, 4 blank, 5 usual punctuation, 6 beyond ASCII
for _bytes, _number in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3),
                        (b" \t\n\v\f\r", 4), (b".,;:'\"-?()", 5), (bytes(range(128, 256)), 6)):
    _CLASS[list(_bytes)] = _number


def figures(data: bytes) -> list[float]:
    """What the model sees of a text."""
    byte_counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    classes = np.bincount(_CLASS, weights=byte_counts, minlength=7)
    size = max(1, len(data))
    shares = classes / size
    letters = max(1.0, classes[1] + classes[2] + classes[6])
    chances = byte_counts[byte_counts > 0] / size
    words: Counter = Counter()
    same = ended = 0
    last: list[bytes] = []
    for block in word_blocks(data, 0):
        words.update(block)
        same += sum(map(bytes.__eq__, block[1:], block))
        same += bool(last and block and last[-1] == block[0])
        last = block[-1:] or last
    total = max(1, words.total())
    ended = sum(n for w, n in words.items() if _CLASS[w[-1]] == 0)
    bare = sum(n for w, n in words.items() if len(w) == 1 and _CLASS[w[0]] == 0)
    top = words.most_common(1)[0][1] if words else 0
    lines = data.split(b"\n")
    return [
        np.log1p(total), len(data) / total, shares[0], shares[3], shares[4], shares[5], shares[6], classes[2] / letters,
        float(-(chances * np.log(chances)).sum()), len(words) / total, np.log1p(total) * len(words) / total, top / total,
        same / total, ended / total, bare / total, np.log1p(len(data) / len(lines)), len(set(lines)) / len(lines),
        byte_counts[ord("!")] / size, byte_counts[ord("|")] / size, float(classes[0] > 0.02 * size), float(classes[2] > 0.5 * letters),
        float(same > 0.2 * total),
    ]


N_FIGURES = len(figures(b""))


@dataclass(frozen=True)
class QualityModel:
    centre: np.ndarray
    weights: np.ndarray

    def strength(self, data: bytes) -> float:
        return float((np.array(figures(data)) - self.centre) @ self.weights)


def fit_pairs(better: np.ndarray, worse: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> QualityModel:
    """Bradley-Terry weights by Newton's method on the logistic loss of figure differences."""
    both = np.concatenate((better, worse))
    centre, spread = both.mean(axis=0), both.std(axis=0)
    spread[spread < 1e-9] = np.inf
    rng = np.random.default_rng(seed)
    difference = (better[rng.integers(len(better), size=pairs)] - worse[rng.integers(len(worse), size=pairs)]) / spread
    weights = np.zeros(difference.shape[1])
    for _ in range(25):
        lost = 1 / (1 + np.exp(np.clip(difference @ weights, -40, 40)))
        gradient = PENALTY * weights - difference.T @ lost / pairs
        bend = (difference * (lost * (1 - lost))[:, None]).T @ difference / pairs + PENALTY * np.eye(len(weights))
        step = np.linalg.solve(bend, gradient)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return QualityModel(centre, weights / spread)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          sample: int = SAMPLE) -> QualityModel | None:
    """Learn from the labelled rows of `docs`; None without rows of both labels."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    ids = docs.select(F.col(id_col).alias("id")).where("id is not null").join(known, "id").distinct()
    chosen = labelled_sample(ids, sample).select("id", "label")
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "id")  # `chosen` has at most twice `sample` rows
    # An id may be repeated any number of times: one of its texts is enough.
    rows = rows.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [[float(x) for x in figures(text)] for text in utf8(batch.column("text"))]
        return [batch.column("label"), pa.array(found, pa.list_(pa.float64()))]

    got = arrow_map(rows.select("label", "text"), "label int, figures array<double>", columns, ["label", "figures"]).collect()
    sides = [np.array(sorted(r.figures for r in got if r.label == side)) for side in (1, 0)]
    return fit_pairs(*sides) if all(len(side) for side in sides) else None


def strengths(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and strength, the model's raw score, of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        model = shared.value
        found = [model.strength(text) if model else 0.0 for text in utf8(batch.column("text"))]
        return [batch.column("id"), pa.array(found, pa.float64())]

    return arrow_map(id_and_text(docs, id_col, text_col), f"id {kind}, strength double", columns, ["id", "strength"])


def score(docs: DataFrame, labels: DataFrame, learnable, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", cut: float = CUT) -> DataFrame:
    """id, score (0 to 1) and predicted (1 if the score reaches `cut`) of every row.

    `learnable` is a condition on `docs` and `labels` alike: only such rows' labels are read.
    """
    model = train(docs.where(learnable), labels.where(learnable), label_col, id_col, text_col)
    raw = materialize(strengths(docs, model, id_col, text_col), "strengths")
    known = labels.where(learnable).where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    labelled = materialize(raw.join(known, "id"), "labelled-strengths")
    share = labelled.agg(F.avg((F.col("label") == 0).cast("double"))).first()[0]
    if model is None or not share:
        return raw.select("id", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    bound, low, high = labelled.agg(F.percentile_approx("strength", [share, 0.25, 0.75], 10_000)).first()[0]
    unit = high - low if high > low else 1.0
    above = (F.col("strength") - F.lit(bound)) / F.lit(unit) - F.lit(1e-9)  # a document at the quantile is below it
    part = above / (1 + F.abs(above))
    value = F.lit(cut) + part * F.when(above > 0, 1 - cut).otherwise(cut)
    return raw.select("id", value.alias("score")).withColumn("predicted", (F.col("score") >= cut).cast("int"))
