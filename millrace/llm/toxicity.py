"""Toxicity: a linear classifier of character n-grams whose features are scaled by naive Bayes log-count ratios.

Features are the character n-grams of ORDERS of the lower-case text, hashed to 2**BITS buckets, as present or absent. From
labelled texts come, for each bucket, the texts of either label that have it, and from these the log-count ratio; the
FEATURES buckets that tell the labels apart best are kept, and a logistic regression is fitted to them, each scaled by its
ratio. A text's score is the regression's probability, over the whole text.

Labelled rows are used up to MAX_TRAIN (a hash of the id picks them evenly from all labelled rows, whatever the size of the
table). Their counts are summed in Spark; the driver gets one pair of counts for each bucket, and for each labelled text the
kept buckets that it has, and fits the weights. The weights, 2**BITS numbers, go to the tasks.

Defined cases: null and empty texts have no n-grams and get the score of the intercept; labels that are null or whose row
has no text are left out; a document that has several labels counts with each; without both labels every score is the share
of label 1 (0 without labels); a null id is never held out nor learnt from; rows that repeat get the same score; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ._arrow import slices, utf8

ORDERS = (3, 4, 5)
BITS = 19
FEATURES = 5_000
MAX_TRAIN = 20_000
ALPHA = 0.5
L2 = 1.0
LEAST_TEXTS = 3
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], dtype=np.uint32)


def buckets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of the n-gram at each character of all texts together, and whether it lies within one text."""
    raw, off = utf8(pc.utf8_lower(column))
    chars = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    ends = lead[off]
    room = np.repeat(ends[1:], np.diff(ends)) - np.arange(len(chars))
    for n in ORDERS:
        h = np.full(max(0, len(chars) - n + 1), np.uint32(n))
        for k in range(n):
            h += chars[k : k + len(h)] * _FACTORS[k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0x297A2D39)
        yield h >> np.uint32(32 - BITS), room[: len(h)] >= n


def present(column: pa.Array, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of each kept bucket that a text has, once each."""
    raw, off = utf8(pc.utf8_lower(column))
    ends = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[off]
    keys = []
    for h, whole in buckets(column):
        at = np.flatnonzero(kept[h] & whole)
        keys.append((np.searchsorted(ends, at, side="right") - 1) << BITS | h[at])
    keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return keys >> BITS, keys & ((1 << BITS) - 1)


@dataclass
class Model:
    weights: np.ndarray  # for each bucket, the ratio times its coefficient; 0 where it isn't kept
    intercept: float

    def scores(self, column: pa.Array) -> np.ndarray:
        text, bucket = present(column, self.weights != 0)
        total = np.bincount(text, weights=self.weights[bucket], minlength=len(column)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def ratios(positive: np.ndarray, negative: np.ndarray, n1: int, n0: int) -> tuple[np.ndarray, np.ndarray]:
    """The log-count ratio of each bucket, and which FEATURES buckets tell the labels apart best (by log-likelihood ratio)."""
    p, q = positive + ALPHA, negative + ALPHA
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    total, n = positive + negative, n1 + n0
    gain = np.zeros(len(total))
    for seen, of in ((positive, n1), (negative, n0)):
        for a, b in ((seen, total), (of - seen, n - total)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain += np.where(a > 0, a * np.log(a * n / (of * np.maximum(b, 1e-9))), 0)
    gain[total < LEAST_TEXTS] = 0
    kept = np.zeros(len(total), dtype=bool)
    kept[np.argsort(-gain, kind="stable")[:FEATURES]] = True
    return r, kept & (gain > 0)


def fit(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, labels: np.ndarray, n_columns: int, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty on sparse rows, by accelerated gradient descent."""
    n = len(labels)
    w, b = np.zeros(n_columns), float(np.log((labels.sum() + 1) / (n - labels.sum() + 1)))
    v, c, momentum = w.copy(), b, 1.0
    # a bound of the curvature: the largest eigenvalue of X'X by power iteration
    u = np.random.default_rng(1).normal(size=n_columns)
    for _ in range(20):
        u /= np.linalg.norm(u) + 1e-12
        u = np.bincount(columns, weights=values * np.bincount(rows, weights=values * u[columns], minlength=n)[rows], minlength=n_columns)
    rate = 1 / (0.25 * (np.linalg.norm(u) * 1.1 + n) + L2)
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights=values * v[columns], minlength=n) + c, -30, 30))) - labels
        new_w = v - rate * (np.bincount(columns, weights=values * error[rows], minlength=n_columns) + L2 * v)
        new_b = c - rate * error.sum()
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        v, c = new_w + (momentum - 1) / after * (new_w - w), new_b + (momentum - 1) / after * (new_b - b)
        w, b, momentum = new_w, new_b, after
    return w, b


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, every = np.zeros((2, 1 << BITS), np.int64), np.ones(1 << BITS, dtype=bool)
    for piece in slices(batches, "text"):
        label = piece.column(1).to_numpy()
        text, bucket = present(piece.column(0), every)
        for c in (0, 1):
            counts[c] += np.bincount(bucket[label[text] == c], minlength=1 << BITS)
    some = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[1, some]), pa.array(counts[0, some])], names=["bucket", "n1", "n0"])


def _rows(kept):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            text, bucket = present(piece.column(0), kept.value)
            ends = np.searchsorted(text, np.arange(piece.num_rows + 1))
            yield pa.RecordBatch.from_arrays([piece.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bucket, pa.int32()))], names=["label", "buckets"])

    return run


def train(sample: DataFrame) -> Model:
    """A model from a table of text and label."""
    context = sample.sparkSession.sparkContext
    sums = sample.mapInArrow(_counter, "bucket bigint, n1 bigint, n0 bigint").groupBy("bucket").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).toArrow()
    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model(np.zeros(1 << BITS), float(np.log((n1 + 1e-9) / (n0 + 1e-9 if n0 or n1 else 1e9))))
    positive, negative = np.zeros(1 << BITS), np.zeros(1 << BITS)
    at = sums["bucket"].to_numpy()
    positive[at], negative[at] = sums["n1"].to_numpy(), sums["n0"].to_numpy()
    r, kept = ratios(positive, negative, n1, n0)
    rows = sample.mapInArrow(_rows(context.broadcast(kept)), "label int, buckets array<int>").toArrow().combine_chunks()
    lists = rows["buckets"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    length = np.diff(lists.offsets.to_numpy())
    flat, slot = lists.flatten().to_numpy(), np.cumsum(kept) - 1
    w, b = fit(np.repeat(np.arange(len(length)), length), slot[flat], r[flat], rows["label"].to_numpy().astype(float), int(kept.sum()))
    weights = np.zeros(1 << BITS)
    weights[kept] = w * r[kept]
    return Model(weights, b)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: id_col and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(shared.value.scores(piece.column(1)))], names=["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "id bigint, score double").withColumnRenamed("id", id_col)
