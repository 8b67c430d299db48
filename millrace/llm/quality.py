"""Quality: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of PASSAGE words, all of it. A passage is encoded from figures of its form (letters,
capitals, digits, signs, word lengths, words that repeat, line and sentence ends, ...) and a signed hash of its character
3-grams, by one learnt layer. Gated attention (Ilse, Tomczak, Welling 2018) weighs the passages, and the document's score
is the logistic of a linear function of the weighted mean of their codes. Labels are those of documents.

Labelled rows are used up to MAX_TRAIN (a hash of the id picks them evenly). Their passages' features, not their texts, go
to the driver, which fits the few thousand weights; the weights go to the tasks.

Defined cases: a null, empty or blank text is a bag of one passage whose figures are all 0; labels that are null or whose row
has no text are left out; without both labels every score is the share of label 1 (0 without labels); a null id is never
held out nor learnt from; rows that repeat get the same score; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._arrow import lower_ascii, slices, span_hashes, utf8, words

PASSAGE = 64
GRAM_BUCKETS = 32
CODE, GATE = 24, 12
MAX_TRAIN = 8_000
EPOCHS = 12
BATCH = 128
RATE = 0.01
L2 = 1e-5


def _class(characters: str | range) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) if isinstance(c, str) else c for c in characters]] = True
    return out


_CLASSES = [_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz"), _class("0123456789"), _class(range(0x80, 0x100)), _class(".,;:"), _class("!?"),
            _class("#*$%&|<>"), _class("\"'()[]{}-_/\\@~^`+="), _class(" "), _class("\n"), _class("\t\r\x0b\x0c"), _class(".!?")]
N_FEATURES = len(_CLASSES) + 8 + GRAM_BUCKETS


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage (rows), and the first passage of each text and one past the last (a text without words has one row of zeros)."""
    raw, off = utf8(column)
    start, end, doc = words(raw, off)
    per_doc = np.bincount(doc, minlength=len(column))
    index = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    heads = np.flatnonzero(index % PASSAGE == 0)
    bag = np.maximum(1, -(-per_doc // PASSAGE))
    first = np.concatenate(([0], np.cumsum(bag)))
    out = np.zeros((first[-1], N_FEATURES), dtype=np.float32)
    if not len(heads):
        return out, first
    row = first[doc[heads]] + index[heads] // PASSAGE
    a = start[heads]
    b = np.append(a[1:], len(raw))
    b = np.minimum(b, off[doc[heads] + 1])
    n_words = np.diff(np.append(heads, len(doc))).astype(np.float32)
    size = np.maximum(1, b - a).astype(np.float32)
    for k, kind in enumerate(_CLASSES):
        total = np.concatenate(([0], np.cumsum(kind[raw], dtype=np.int32)))
        out[row, k] = (total[b] - total[a]) / size
    k = len(_CLASSES)
    owner = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(doc))))
    mean = lambda x: np.bincount(owner, weights=x, minlength=len(heads)) / n_words
    length = (end - start).astype(np.float64)
    h = span_hashes(lower_ascii(raw), start, end)
    key = np.stack([owner.astype(np.uint64), h])
    order = np.lexsort((key[1], key[0]))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=len(heads))
    before = np.concatenate(([False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])))
    caps = _CLASSES[0][raw]
    capital = caps[start]
    all_caps = capital & caps[end - 1] & (end - start > 1)
    for x in (mean(length) / 10, np.sqrt(np.maximum(0, mean(length**2) - mean(length) ** 2)) / 10, distinct / n_words, mean(before), mean(capital), mean(all_caps), np.log1p(n_words), mean(length == 1)):
        out[row, k] = x
        k += 1
    if len(raw) < 3:
        return out, first
    low = lower_ascii(raw).astype(np.uint32)
    g = low[:-2] * np.uint32(0x9E3779B1) + low[1:-1] * np.uint32(0x85EBCA77) + low[2:] * np.uint32(0xC2B2AE3D)
    g ^= g >> np.uint32(15)
    g *= np.uint32(0x2C1B3C6D)
    sign = np.where(g >> np.uint32(31), 1.0, -1.0).astype(np.float32)
    for k in (1, 2):  # 3-grams that would run on into the next text
        sign[np.clip(off[1:-1] - k, 0, max(0, len(sign) - 1))] = 0
    bucket = ((g >> np.uint32(20)) % np.uint32(GRAM_BUCKETS)).astype(np.int64)
    place = np.repeat(np.arange(len(heads)), np.diff(np.append(a, len(raw))))
    place = place[: max(0, len(g) - int(a[0]))]
    at = int(a[0])
    sums = np.bincount(place * GRAM_BUCKETS + bucket[at : at + len(place)], weights=sign[at : at + len(place)], minlength=len(heads) * GRAM_BUCKETS).reshape(-1, GRAM_BUCKETS)
    out[row, N_FEATURES - GRAM_BUCKETS :] = sums / np.sqrt(size)[:, None]
    return out, first


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] | None
    share: float

    def attention(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each bag, and weight of each passage in its bag."""
        parts = _forward(self.weights, (x - self.mean) / self.scale, first)
        return parts["p"], parts["a"]

    def scores(self, column: pa.Array) -> np.ndarray:
        x, first = passages(column)
        # rounded, as the last digits of a matrix product depend on the rows beside
        return self.attention(x, first)[0].round(9) if self.weights is not None else np.full(len(column), self.share)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    e = (t * g) @ w["w"]
    a = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
    a /= np.add.reduceat(a, first[:-1])[bag]
    z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
    return {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["d"])}


def _gradient(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(w, x, first)
    error = (f["p"] - y) / len(y)
    dz = (error[:, None] * w["c"])[f["bag"]]
    da = (f["h"] * dz).sum(axis=1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, first[:-1])[f["bag"]])
    gate = de[:, None] * w["w"]
    dt, dg = gate * f["g"] * (1 - f["t"] ** 2), gate * f["t"] * f["g"] * (1 - f["g"])
    dh = f["a"][:, None] * dz + dt @ w["V"].T + dg @ w["U"].T
    dx = dh * (1 - f["h"] ** 2)
    out = {"W": x.T @ dx, "b": dx.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ error, "d": np.array([error.sum()])}
    return {k: v + L2 * w[k] for k, v in out.items()}


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, seed: int = 5) -> Model:
    """Adam over batches of bags."""
    if len(np.unique(y)) < 2:
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), None, float(y.mean()) if len(y) else 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x, rng = (x - mean) / scale, np.random.default_rng(seed)
    size = {"W": (N_FEATURES, CODE), "b": (CODE,), "V": (CODE, GATE), "U": (CODE, GATE), "w": (GATE,), "c": (CODE,), "d": (1,)}
    w = {k: rng.normal(size=s) * (0.0 if k in "bd" else 1 / np.sqrt(s[0])) for k, s in size.items()}
    m, v, step = {k: np.zeros(s) for k, s in size.items()}, {k: np.zeros(s) for k, s in size.items()}, 0
    total = EPOCHS * -(-len(y) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            own = order[k : k + BATCH]
            n = first[own + 1] - first[own]
            ends = np.concatenate(([0], np.cumsum(n)))
            rows = np.repeat(first[own] - ends[:-1], n) + np.arange(ends[-1])
            step += 1
            for name, g in _gradient(w, x[rows], ends, y[own]).items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g**2
                w[name] = w[name] - RATE * (1 - step / (total + 1)) * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w, float(y.mean()))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches, "text"):
        x, first = passages(piece.column(0))
        yield pa.RecordBatch.from_arrays([piece.column(1), pa.ListArray.from_arrays(pa.array(first * N_FEATURES, pa.int32()), pa.array(x.reshape(-1)))], names=["label", "x"])


def train(sample: DataFrame) -> Model:
    """A model from a table of text and label."""
    rows = sample.mapInArrow(_bags, "label int, x array<float>").toArrow().combine_chunks()
    if not rows.num_rows:
        return fit(np.zeros((0, N_FEATURES)), np.zeros(1, np.int64), np.zeros(0))
    lists = rows["x"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy()
    first = (offsets - offsets[0]).astype(np.int64) // N_FEATURES
    return fit(lists.flatten().to_numpy().reshape(-1, N_FEATURES), first, rows["label"].to_numpy().astype(float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: id_col and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(shared.value.scores(piece.column(1)).astype(float))], names=["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "id bigint, score double").withColumnRenamed("id", id_col)
