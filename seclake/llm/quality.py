"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Words are runs of letters and digits and runs of other signs (A-Z in lower
case); features are the hashes of all word n-grams of a text, present or not.
Training goes over a bounded sample of labelled texts in a seeded order, one text
at a time; scoring is a sparse dot product per text, in batches on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seclake.llm.common import SIGNS, mix, row_slices, training_sample, utf8, words

BITS = 18  # 2**18 weights: 1 MB in single precision, whatever the corpus holds
ORDERS = 2
BATCH_BYTES = 4 << 20


def text_features(data: np.ndarray, offsets: np.ndarray, bits: int, orders: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed feature of every distinct n-gram of the rows, sorted by row and feature."""
    hashes, rows, _ = words(data, offsets, SIGNS)
    keys = []
    gram = hashes
    for n in range(1, orders + 1):
        if n > 1:
            gram = mix(gram[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[n - 1 :])
        same = rows[: len(gram)] == rows[n - 1 :]
        feature = (gram[same] >> np.uint64(64 - bits)).astype(np.int64)
        keys.append((rows[: len(gram)][same] << bits) | feature)
        if len(gram) < 2:
            break
    key = np.unique(np.concatenate(keys))
    return key >> bits, key & ((1 << bits) - 1)


@dataclass
class FtrlModel:
    """Per-coordinate follow-the-regularised-leader for logistic loss."""

    bits: int = BITS
    orders: int = ORDERS
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 0.3
    l2: float = 1.0
    z: np.ndarray = field(default=None, repr=False)
    n: np.ndarray = field(default=None, repr=False)

    def __post_init__(self) -> None:
        if self.z is None:
            self.z = np.zeros((1 << self.bits) + 1)  # the last weight is the bias
            self.n = np.zeros((1 << self.bits) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, features: np.ndarray, label: int) -> None:
        at = np.append(features, 1 << self.bits)
        w = self.weights(at)
        value = _value(len(features))
        x = np.full(len(at), value)
        x[-1] = 1.0
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _value(count) -> np.ndarray:
    """Value of each of a text's features, so that the length of the text does not scale the score."""
    return 8.0 / np.sqrt(np.maximum(count, 16))


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 8000, epochs: int = 3, seed: int = 5, **params) -> FtrlModel:
    """Learn from at most ``max_rows`` labelled documents outside the held-out fold.

    The features are made on the executors; the driver gets at most ``max_rows``
    arrays of at most 2**bits ids.  No labelled rows: a model that scores 0.5.
    """
    model = FtrlModel(**params)
    bits, orders = model.bits, model.orders

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in row_slices(offsets, BATCH_BYTES):
                rows, ids = text_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bits, orders)
                cuts = np.searchsorted(rows, np.arange(b - a + 1))
                packed = [ids[i:j].astype("<u4").tobytes() for i, j in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], batch.column("label")[a:b], pa.array(packed, pa.binary())], ["doc_id", "label", "features"])

    sample = training_sample(docs, labels, label, max_rows)
    rows = sample.select("doc_id", "label", "text").mapInArrow(features, "doc_id long, label int, features binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            model.learn(np.frombuffer(rows[i]["features"], "<u4").astype(np.int64), rows[i]["label"])
    return model


def score_texts(docs: DataFrame, model: FtrlModel, threshold: float = 0.3, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """Columns of ``docs`` and ``score, predicted``; every text is read whole.

    Null and empty texts get the score of a text without words.  Columns named
    like the results are replaced; no rows: no rows.
    """
    weights, bits, orders = model.weights().astype(np.float32), model.bits, model.orders

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.astype(np.float64)
        for batch in batches:
            data, offsets = utf8(batch.column(text_at))
            out = []
            for a, b in row_slices(offsets, BATCH_BYTES):
                rows, ids = text_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bits, orders)
                total = np.bincount(rows, w[ids], b - a)
                out.append(w[-1] + total * _value(np.bincount(rows, minlength=b - a)))
            z = np.concatenate(out) if out else np.empty(0)
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))
            kept = [c for i, c in enumerate(batch.columns) if i in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=names)

    keep = [i for i, c in enumerate(docs.columns) if c not in (score, predicted)]
    text_at = docs.columns.index("text")
    names = [*(docs.columns[i] for i in keep), score, predicted]
    fields = [f"`{docs.columns[i]}` {docs.schema[i].dataType.simpleString()}" for i in keep]
    return docs.mapInArrow(dot, ", ".join([*fields, f"`{score}` double", f"`{predicted}` int"]))
