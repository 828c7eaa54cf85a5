"""Quality classifier (2): logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A word here is a run of letters, digits and non-ASCII characters or a run of other visible
characters, case kept.  Features of a text are its words and pairs of neighbouring words, hashed
into ``2**bits`` columns; the value of a column is its share of the text's n-grams times ``SCALE``.  The score of a
text is one sparse dot product with the weights, a sum of looked-up weights.

Training takes at most ``sample`` labelled rows, those with the lowest hash of id and text, each with all its
columns; it runs ``epochs`` times over them in an order that a hash fixes.
The bound is a parameter of the fit alone: every whole text is scored.

Null and empty texts have no features and get the score of the intercept.  Labels that are null are
left out, several labels of one id are several examples.  Without any label the score is 0.5.
Rows that repeat score alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.llm.text import BYTE, WORD_BASE, SpanHash, mix, raw_texts, session_of

SCALE = 16.0
#: 0: blank and control bytes, 1: digits, letters and non-ASCII characters, 2: other visible characters.
KIND = np.array([1 if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b > 127 else 2 if 33 <= b <= 126 else 0
                 for b in range(256)], np.int8)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    intercept: float
    bits: int

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        margins = np.full(len(texts), self.intercept)
        for i, text in enumerate(texts):
            grams = ngrams(text, self.bits)
            if len(grams):
                margins[i] += SCALE * float(self.weights[grams].mean(dtype=np.float64))
        return 1 / (1 + np.exp(-np.clip(margins, -40, 40)))


def ngrams(text: bytes | None, bits: int) -> np.ndarray:
    """Columns of all words and word pairs of a text, repeated as they repeat."""
    data = np.frombuffer(text or b"", np.uint8)
    kind = KIND[data]
    edge = np.flatnonzero(np.diff(kind, prepend=np.int8(0), append=np.int8(0)))
    if not len(edge):
        return np.zeros(0, np.int64)
    start, stop = edge[:-1], edge[1:]
    word = kind[start] > 0
    words = SpanHash(BYTE[data], WORD_BASE).of(start[word], stop[word])
    pairs = mix(words[:-1] * np.uint64(3) + words[1:])
    return (np.concatenate([words, pairs]) >> np.uint64(64 - bits)).astype(np.int64)


def features(text: bytes | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of a training row."""
    columns, counts = np.unique(ngrams(text, bits), return_counts=True)
    return columns, SCALE * counts / max(1, counts.sum())


def pack(columns: np.ndarray, counts: np.ndarray) -> bytes:
    """A training row in about two bytes an n-gram: steps between columns and counts, compressed."""
    return zstandard.compress(np.append(np.diff(columns, prepend=0), counts).astype(np.int32).tobytes(), 3)


class Packed(Sequence):
    """Training rows (columns, values, label), unpacked one at a time."""

    def __init__(self, rows: list[bytes], labels: list[int]):
        self.rows, self.labels = rows, labels

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray, int]:
        steps, counts = np.frombuffer(zstandard.decompress(self.rows[i]), np.int32).reshape(2, -1).astype(np.int64)
        return np.cumsum(steps), SCALE * counts / max(1, counts.sum()), self.labels[i]


def follow_leader(rows: Sequence[tuple[np.ndarray, np.ndarray, int]], bits: int, epochs: int = 4, alpha: float = 0.5,
                  beta: float = 0.1, l1: float = 0.02, l2: float = 0.02) -> Model:
    """FTRL-proximal updates, one example after the other."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at):
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    order = np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            columns, values, label = rows[i]
            at, x = np.append(columns, size), np.append(values, 1.0)  # the last column is the intercept
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -40, 40))) - label) * x
            squares = n[at] + g * g
            z[at] += g - (np.sqrt(squares) - np.sqrt(n[at])) / alpha * w
            n[at] = squares
    final = weights(np.arange(size + 1))
    return Model(final[:-1].astype(np.float32), float(final[-1]), bits)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no fit may see: crc32 of the id as text leaves 2 when divided by 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(documents: DataFrame, labels: DataFrame, sample: int = 4000, bits: int = 18, **rates) -> Model:
    """Learn ``quality`` from labelled documents that are not held out."""
    session_of(documents)
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.select(F.col("doc_id").alias("labelled"), F.col("quality").cast("int").alias("quality")).distinct()
    known = known.orderBy(F.xxhash64("labelled"), "labelled", "quality").limit(sample)
    texts = documents.select(F.col("doc_id").alias("labelled"), F.col("text").cast("string").alias("text"))

    @F.arrow_udf("binary")
    def extract(text: pa.Array) -> pa.Array:
        return pa.array([pack(*np.unique(ngrams(t, bits), return_counts=True)) for t in raw_texts(text)], pa.binary())

    rows = texts.join(F.broadcast(known), "labelled")  # `sample` rows of two numbers
    rows = rows.select("labelled", F.xxhash64("text").alias("th"), "quality", extract("text").alias("f"))
    rows = rows.orderBy(F.xxhash64("labelled"), "labelled", "th", "quality").limit(sample).select("quality", "f")
    table = rows.toArrow()
    data = Packed(table.column("f").to_pylist(), [int(q > 0) for q in table.column("quality").to_pylist()])
    return follow_leader(data, bits, **rates)


def scorer(documents: DataFrame, model: Model):
    """A function of a text column to its score."""
    held = session_of(documents).sparkContext.broadcast(model)  # 4 bytes a weight

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(held.value.scores(raw_texts(text)))

    return score


def digest(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    score = scorer(documents, fit(documents, labels))
    scored = documents.select("doc_id", held_out().alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that the classifier does not reject, all columns as they were."""
    score = scorer(documents, fit(documents, labels))
    return documents.filter(score(F.col("text").cast("string")) >= threshold)
