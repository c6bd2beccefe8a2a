"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Items are short and documents long, so their Jaccard similarity is small however
much of the item a document holds.  Documents are therefore searched in pieces:
items are partitioned by their number of shingles into classes (w/2, w], and for
each class a document is covered by pieces of w shingles, half overlapping.  A
piece that holds most of an item has a Jaccard similarity with it that does not
depend on the length of the document, and each class asks for as many hash
functions as bring the chance of a miss below ``MISS``.  A piece and an item that
agree in one minimum are a candidate; candidates are verified on the whole text:
the share of the item's distinct shingles that the document has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seclake.llm.common import WORDS, broadcast_if_small, checkpointed, free_name, mix, releasing, row_slices, utf8, words

SHINGLE = 5
MISS = 1e-7
#: similarity of an item to the best piece of a document that holds a run of four fifths of it
LEAST_SIMILARITY = 0.3 / 1.4
BLOCK_CHARS = 16 << 20  # items that are sent to the tasks at a time; more items make further passes
SLICE = 1 << 19
_BITS = 22


def shingle_hashes(hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every k-word shingle; rows of fewer words have one shingle, the whole sequence."""
    out, of = [], []
    counts = np.bincount(rows, minlength=n_rows)
    first = np.cumsum(counts) - counts
    for size in range(1, k + 1):
        if size < k:
            at = first[counts == size]
        else:
            at = np.flatnonzero(rows[: max(0, len(rows) - k + 1)] == rows[k - 1 :])
        value = np.full(len(at), size, np.uint64)
        for i in range(size):
            value = mix(value * np.uint64(0x9FB21C651E98DF25) + hashes[at + i])
        out.append(value)
        of.append(rows[at])
    value, row = np.concatenate(out), np.concatenate(of)
    order = np.argsort(row, kind="stable")
    return value[order], row[order]


def text_shingles(text: str, k: int = SHINGLE) -> set[bytes]:
    parts = text.encode().lower().split()
    return {b" ".join(parts[i : i + k]) for i in range(max(1, len(parts) - k + 1))} if parts else set()


@dataclass
class ItemIndex:
    """Minima of a bounded block of items, by size class."""

    ids: list
    texts: list[str]
    levels: list[int]  # piece sizes that have items, as powers of 2
    values: dict[int, np.ndarray]  # level -> sorted salted minima
    owners: dict[int, np.ndarray]  # level -> item of each minimum
    maps: dict[int, np.ndarray]  # level -> which low bits occur
    factors: np.ndarray
    offsets: np.ndarray

    @classmethod
    def build(cls, ids: list, texts: list[str], seed: int = 11) -> ItemIndex:
        count = math.ceil(math.log(MISS) / math.log(1 - LEAST_SIMILARITY))
        random = np.random.default_rng(seed)
        factors = random.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
        offsets = random.integers(0, 1 << 63, count, np.uint64)
        data, at = utf8(pa.array(texts, pa.string()))
        hashes, rows, _ = words(data, at, WORDS)
        values, row = shingle_hashes(hashes, rows, len(texts))
        starts = np.searchsorted(row, np.arange(len(texts)))
        ends = np.searchsorted(row, np.arange(len(texts)), "right")
        minima, owners = {}, {}
        for item, (a, b) in enumerate(zip(starts, ends)):
            if a == b:
                continue
            own = np.unique(values[a:b])
            size = max(1, math.ceil(math.log2(len(own)))) if len(own) > 1 else 1
            lows = (own[None, :] * factors[:, None] + offsets[:, None]).min(1)
            minima.setdefault(size, []).append(_salted(lows, np.arange(count)))
            owners.setdefault(size, []).append(np.full(count, item))
        table, owner, maps = {}, {}, {}
        for size in minima:
            flat, who = np.concatenate(minima[size]), np.concatenate(owners[size])
            order = np.argsort(flat, kind="stable")
            table[size], owner[size] = flat[order], who[order]
            maps[size] = np.zeros(1 << _BITS, bool)
            maps[size][(flat & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
        return cls(ids, texts, sorted(table), table, owner, maps, factors, offsets)

    def candidates(self, values: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
        """Distinct (row, item) pairs, one per line, of pieces that agree with an item in a minimum."""
        if not len(values) or not self.levels:
            return np.empty((0, 2), np.int64)
        lowest = self.levels[0] - 1  # pieces of 2**level shingles are two blocks of 2**(level - 1)
        first = np.searchsorted(row, np.arange(n_rows))
        place = np.arange(len(row)) - first[row]
        starts = [np.flatnonzero(place % (1 << lowest) == 0)]
        owner = [row[starts[0]]]
        for _ in range(self.levels[0], self.levels[-1]):
            lead = np.searchsorted(owner[-1], np.arange(n_rows))
            index = np.arange(len(owner[-1])) - lead[owner[-1]]
            starts.append(np.flatnonzero(index % 2 == 0))
            owner.append(owner[-1][starts[-1]])
        same = [o[:-1] == o[1:] for o in owner]
        found = []
        low_bits = np.uint64((1 << _BITS) - 1)
        for j, (factor, offset) in enumerate(zip(self.factors, self.offsets)):
            low = values * factor + offset
            for depth, at in enumerate(starts):
                low = np.minimum.reduceat(low, at)
                level = lowest + depth + 1
                if level not in self.values:
                    continue
                piece = low.copy()
                piece[:-1][same[depth]] = np.minimum(low[:-1], low[1:])[same[depth]]
                key = _salted(piece, j)
                hit = np.flatnonzero(self.maps[level][(key & low_bits).astype(np.int64)])
                if not len(hit):
                    continue
                table = self.values[level]
                a, b = np.searchsorted(table, key[hit]), np.searchsorted(table, key[hit], "right")
                for i in np.flatnonzero(b > a):
                    found.append(np.column_stack([np.full(b[i] - a[i], owner[depth][hit[i]]), self.owners[level][a[i] : b[i]]]))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)


def _salted(minima: np.ndarray, function: int | np.ndarray) -> np.ndarray:
    return mix(minima + np.asarray(function, np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _blocks(items: DataFrame, chars: int) -> Iterator[tuple[list, list[str]]]:
    """Items in blocks of a bounded number of characters, one block at the driver at a time."""
    ids, texts, held = [], [], 0
    for row in items.toLocalIterator():
        if not row["text"]:
            continue
        if ids and held + len(row["text"]) > chars:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        held += len(row["text"])
    if ids:
        yield ids, texts


def contaminated(docs: DataFrame, items: DataFrame, least: float = 0.8, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, n_item, n_shared, containment``: documents that hold at least ``least`` of an item's shingles.

    ``docs`` has ``doc_id, text``, ``items`` has ``item_id, text``.  Words are
    parted by white space, A-Z in lower case; texts of fewer than five words have
    one shingle, all their words.  Null, empty and wordless texts match nothing.
    Rows that repeat an id are judged one by one, equal results are one row.
    Items travel to the tasks in blocks of ``block_chars`` characters at most.
    """
    shape = (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, "
        "n_item long, n_shared long, containment double"
    )

    def search(index: ItemIndex):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[int, set[bytes]] = {}
            for batch in batches:
                data, offsets = utf8(batch.column("text"))
                rows_out: list[tuple] = []
                for a, b in row_slices(offsets, SLICE):
                    hashes, rows, _ = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], WORDS)
                    values, row = shingle_hashes(hashes, rows, b - a)
                    last, own = -1, set()
                    for r, item in index.candidates(values, row, b - a):
                        if r != last:
                            own, last = text_shingles(batch.column("text")[a + int(r)].as_py()), r
                        if item not in known:
                            known[item] = text_shingles(index.texts[item])
                        want = known[item]
                        shared = len(want & own)
                        if shared >= least * len(want):
                            rows_out.append((a + int(r), int(item), len(want), shared))
                at = pa.array([r[0] for r in rows_out], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(at), pa.array([index.ids[r[1]] for r in rows_out], id_type),
                        pa.array([r[2] for r in rows_out], pa.int64()), pa.array([r[3] for r in rows_out], pa.int64()),
                        pa.array([r[3] / r[2] for r in rows_out], pa.float64()),
                    ],
                    names=["doc_id", "item_id", "n_item", "n_shared", "containment"],
                )

        return releasing(run)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(items.schema["item_id"].dataType)
    out = None
    for ids, texts in _blocks(items.select("item_id", "text"), block_chars):
        index = ItemIndex.build(ids, texts)
        part = docs.select("doc_id", "text").mapInArrow(search(index), shape)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], shape)
    return out.distinct()


def drop_contaminated(docs: DataFrame, items: DataFrame, least: float = 0.8) -> DataFrame:
    """Columns of ``docs`` without the documents that hold an item; rows without an id stay."""
    own = free_name(docs, "hit")
    hit = checkpointed(contaminated(docs, items, least).select(F.col("doc_id").alias(own)).distinct())
    return docs.join(broadcast_if_small(hit), F.col("doc_id") == F.col(own), "left_anti")
