"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence has probability ``s = sigmoid(w . x)`` over its hashed words and their
first bytes, which inflected words share; a document is toxic if any of its sentences is: ``P = 1 - prod(1 - s)`` (noisy-or).
The weights are learned from document labels alone, through the noisy-or; the
same sentence probabilities then locate the offending sentences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seclake.llm.common import LETTERS, release, releasing, row_slices, training_sample, utf8, words

BITS = 18
STEM = 4  # bytes of a word that its inflections share
BATCH_BYTES = 1 << 18  # bytes of text whose words are held at a time, 100 bytes and more for each byte
_ENDS = np.zeros(256, bool)
_ENDS[[10, 33, 46, 63]] = True  # line end ! . ?


def sentence_words(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature and sentence of every word and of every stem; row and first byte of every sentence.

    A sentence ends with a line end or with ``. ! ?``; sentences without words don't count.
    """
    hashes, rows, firsts, stems = words(data, offsets, LETTERS, STEM)
    ends = np.flatnonzero(_ENDS[data])
    number = np.searchsorted(ends, firsts) + rows  # a new row is a new sentence
    new = np.ones(len(number), bool)
    new[1:] = (number[1:] != number[:-1]) | (rows[1:] != rows[:-1])
    ids = np.column_stack([hashes, stems]).ravel() >> np.uint64(64 - bits)
    return ids.astype(np.int64), np.repeat(np.cumsum(new) - 1, 2), rows[new], firsts[new]


@dataclass
class ToxicityModel:
    weights: np.ndarray  # 2**bits word weights
    bias: float
    bits: int = BITS

    def sentence_logits(self, ids: np.ndarray, sentences: np.ndarray, count: int) -> np.ndarray:
        return self.bias + np.bincount(sentences, self.weights[ids], count)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def noisy_or(logits: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """P = 1 - prod(1 - sigmoid(z)) per row; rows without sentences get 0."""
    return -np.expm1(-np.bincount(rows, _softplus(logits), count))


def fit_noisy_or(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, epochs: int = 12, rate: float = 1.0, l1: float = 5e-4, least_docs: int = 5, batch: int = 256, seed: int = 3) -> ToxicityModel:
    """Gradient steps on the documents' log-likelihood; ``bags`` are (word features, number of features of each sentence).

    Steps are scaled by each weight's past gradients and shrunk by ``l1``, so that
    words which tell nothing stay at 0, as do those of fewer than ``least_docs``
    documents.
    """
    if not labels.any():
        return ToxicityModel(np.zeros(1 << bits), -30.0, bits)
    seen = np.zeros(1 << bits, np.int64)
    for ids, _ in bags:
        seen[np.unique(ids)] += 1
    common = seen >= least_docs
    w, bias, gw, gb = np.zeros(1 << bits), -5.0, np.full(1 << bits, 1e-6), 1e-6
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        shuffled = order.permutation(len(bags))
        for at in range(0, len(bags), batch):
            chosen = shuffled[at : at + batch]
            ids = np.concatenate([bags[i][0] for i in chosen]).astype(np.int64)
            sizes = np.concatenate([bags[i][1] for i in chosen])
            sentence = np.repeat(np.arange(len(sizes)), sizes)
            row = np.repeat(np.arange(len(chosen)), [len(bags[i][1]) for i in chosen])
            z = bias + np.bincount(sentence, w[ids], len(sizes))
            p = np.maximum(noisy_or(z, row, len(chosen)), 1e-9)
            y = labels[chosen]
            slope = np.where(y == 1, -(1 - p) / p, 1.0)  # d loss / d softplus(z)
            dz = slope[row] / (1.0 + np.exp(-np.clip(z, -35, 35)))
            step = np.bincount(ids, dz[sentence], 1 << bits) / len(chosen)
            used = np.flatnonzero(common & (step != 0))
            g = step[used]
            gw[used] += g * g
            pace = rate / np.sqrt(gw[used])
            moved = w[used] - pace * g
            w[used] = np.sign(moved) * np.maximum(np.abs(moved) - pace * l1, 0.0)
            g = dz.sum() / len(chosen)
            gb += g * g
            bias -= rate * g / np.sqrt(gb)
    return ToxicityModel(w.astype(np.float32).astype(np.float64), float(bias), bits)


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 10_000, bits: int = BITS, **params) -> ToxicityModel:
    """Learn from at most ``max_rows`` labelled documents outside the held-out fold.

    Word features are made on the executors.  No toxic labels: everything scores about 0.
    """

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in row_slices(offsets, BATCH_BYTES):
                ids, sentence, rows, _ = sentence_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bits)
                of_row = np.searchsorted(rows, np.arange(b - a))  # first sentence of each row
                cuts = np.searchsorted(sentence, [*of_row, len(rows)])
                packed = [ids[i:j].astype("<u4").tobytes() for i, j in zip(cuts[:-1], cuts[1:])]
                sizes = np.bincount(sentence, minlength=len(rows)).astype("<u4")
                inner = [sizes[i:j].tobytes() for i, j in zip(of_row, [*of_row[1:], len(rows)])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], batch.column("label")[a:b], pa.array(packed, pa.binary()), pa.array(inner, pa.binary())],
                    ["doc_id", "label", "ids", "sizes"],
                )

    sample = training_sample(docs, labels, label, max_rows).select("doc_id", "label", "text")
    rows = sample.mapInArrow(releasing(bag), "doc_id long, label int, ids binary, sizes binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    bags = [(np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["sizes"], "<u4")) for r in rows]
    y = np.array([r["label"] for r in rows], int)
    del rows
    model = fit_noisy_or(bags, y, bits, **params)
    del bags
    release()  # the driver goes on without the sample's memory
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, located: bool = True) -> DataFrame:
    """Columns of ``docs`` and ``score, predicted, n_sentences, worst_score, worst_start, worst_sentence``.

    ``worst_start`` is the first byte of the most offending sentence's first word;
    ``worst_sentence`` is that sentence's text if ``located``.  Null, empty and
    wordless texts score 0 and have no sentence.  Columns named like the results
    are replaced; no rows: no rows.
    """
    results = {"score": "double", "predicted": "int", "n_sentences": "long", "worst_score": "double", "worst_start": "long"}
    if located:
        results["worst_sentence"] = "string"
    keep = [i for i, c in enumerate(docs.columns) if c not in results]
    text_at = docs.columns.index("text")
    names = [*(docs.columns[i] for i in keep), *results]
    weights, bias, bits = model.weights.astype(np.float32), model.bias, model.bits

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicityModel(weights.astype(np.float64), bias, bits)
        for batch in batches:
            data, offsets = utf8(batch.column(text_at))
            for a, b in row_slices(offsets, BATCH_BYTES):
                n = b - a
                p, count, worst, start = np.zeros(n), np.zeros(n, np.int64), np.zeros(n), np.full(n, -1, np.int64)
                text = np.full(n, None, object)
                part, inner = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                ids, sentence, rows, firsts = sentence_words(part, inner, bits)
                if len(rows):
                    z = own.sentence_logits(ids, sentence, len(rows))
                    p = noisy_or(z, rows, n)
                    count = np.bincount(rows, minlength=n)
                    best = np.lexsort((firsts, -z, rows))
                    best = best[np.r_[True, rows[best][1:] != rows[best][:-1]]]
                    at = rows[best]
                    worst[at] = 1.0 / (1.0 + np.exp(-np.clip(z[best], -35, 35)))
                    start[at] = firsts[best] - inner[at]
                    if located:
                        ends = np.flatnonzero(_ENDS[part])
                        nearest = np.searchsorted(ends, firsts[best])
                        stop = np.where(nearest < len(ends), ends[np.minimum(nearest, len(ends) - 1)] + 1, len(part)) if len(ends) else np.full(len(best), len(part))
                        stop = np.minimum(stop, inner[at + 1])
                        for i, f, s in zip(at, firsts[best], stop):
                            text[i] = part[f:s].tobytes().decode("utf-8", "replace")
                columns = [c.slice(a, n) for i, c in enumerate(batch.columns) if i in keep]
                made = [pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(count), pa.array(worst), pa.array(start, mask=start < 0)]
                if located:
                    made.append(pa.array(text, pa.string()))
                yield pa.RecordBatch.from_arrays([*columns, *made], names=names)

    fields = [f"`{docs.columns[i]}` {docs.schema[i].dataType.simpleString()}" for i in keep]
    return docs.mapInArrow(releasing(score), ", ".join([*fields, *(f"`{k}` {v}" for k, v in results.items())]))
