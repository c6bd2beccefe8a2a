"""Exact removal of repeated byte strings by blockwise suffix sorting with a difference cover.

Texts are UTF-8 bytes.  A byte goes if it is covered by a string of ``LENGTH`` bytes
that also starts in a document with a smaller id; strings are judged on the input.

All suffixes of a corpus fit no memory, so they are sorted one bucket at a time.
A suffix belongs to the bucket of the smallest hash among the 16-byte grams of its
first ``LENGTH`` bytes, so equal strings always share a bucket.  Neighbouring suffixes
mostly share it too: they travel as one *stretch* of bytes.

1. Every task hashes its stretches; a bucket tells which hashes occur in more than
   one document.  Only those stretches go on: text that is nowhere repeated is
   never shuffled as text by bucket.  The number of buckets follows the counted
   stretches.  Keys of more than ``HOT`` stretches are split: their windows go by a
   hash of all their bytes, so equal ones still meet, in buckets of bounded size.
2. Stretches of a task that are equal to one of a smaller document are marked at
   once; one copy goes to its bucket.  A bucket is what a task can gather, more than
   it can sort at once, so that what a task packs for a bucket stays large.
3. A bucket sorts the suffixes of its different stretches, some keys at a time.  Suffixes with a long
   common prefix are ordered by ranks of a *difference cover* sample: of any two
   positions some common shift of less than ``PERIOD`` leads both into the sample,
   whose ranks to depth ``LENGTH`` were computed before.  Memory is bounded by the
   bucket, however long the repeats are.  Runs of suffixes that agree in ``LENGTH``
   bytes are classes; a suffix goes if its class has a smaller document.
4. The marks are joined with the documents once more, and the bytes are cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seclake.llm.common import checkpointed, free_name, mix, release, row_slices, utf8, worker_state

LENGTH = 50
GRAM = 16
PERIOD = 7
COVER = (0, 1, 3)  # the differences of these, modulo 7, are all of 0..6
SLICE = 1 << 19  # bytes whose grams are hashed at a time
FLUSH = 400_000  # stretches that a task holds back to pack them by bucket
TEXT = 1 << 25  # bytes of text that it holds back for these
HOT = 50_000  # stretches of a key above which its windows are spread
KEYS = 2_000_000  # stretches whose keys are gathered in one task, about
GATHERED = 8_000_000  # windows of the stretches that are gathered in one task, about
SORTED = 500_000  # windows that are sorted at a time, about
RUN = 17  # windows of a stretch on average


# -- stretches -------------------------------------------------------------------------------------
def _words(data: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The 8 bytes from each position on, as one number."""
    return np.ndarray((max(0, len(data) - 7),), kind, data, strides=(1,))


def window_keys(data: np.ndarray) -> np.ndarray:
    """For every position with ``LENGTH`` bytes, the smallest hash of the grams in these bytes."""
    if len(data) < LENGTH:
        return np.empty(0, np.uint64)
    eight = _words(data).astype(np.uint64)
    h = eight[:-8] * np.uint64(0x9E3779B97F4A7C15) + eight[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    width, covered = LENGTH - GRAM + 1, 1
    while covered < width:
        step = min(covered, width - covered)
        h = np.minimum(h[:-step], h[step:])
        covered += step
    return h


def stretches(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, first window, number of windows and key of all stretches, slice by slice.

    A stretch is a run of neighbouring windows of one row with one key.  Long rows
    are cut between windows, which changes no window's key.
    """
    for a, b in row_slices(offsets, SLICE):
        first, last = int(offsets[a]), int(offsets[b])
        for at in range(first, last, SLICE) if b - a == 1 else [first]:
            end = min(last, at + SLICE + LENGTH - 1) if b - a == 1 else last
            keys = window_keys(data[at:end])
            if not len(keys):
                continue
            row = np.repeat(np.arange(a, b), np.diff(np.clip(offsets[a : b + 1], at, end)))[: len(keys)]
            place = np.arange(at, at + len(keys))
            valid = place + LENGTH <= offsets[row + 1]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]
            head = np.flatnonzero(new & valid)
            if not len(head):
                continue
            run = np.cumsum(new)[valid]
            count = np.bincount(run - run[0])
            count = count[count > 0]
            yield row[head], place[head], count, keys[head]


def _pack(*arrays: np.ndarray) -> bytes:
    head = ";".join([f"{a.dtype.str},{len(a)}" for a in arrays]).encode()
    zipped = worker_state("zip", lambda: zstandard.ZstdCompressor(level=3))
    return zipped.compress(b"".join([len(head).to_bytes(4, "little"), head, *[a.tobytes() for a in arrays]]))


def _unpack(payload: bytes) -> tuple[np.ndarray, ...]:
    raw = worker_state("unzip", zstandard.ZstdDecompressor).decompress(payload)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for kind, n in (x.split(",") for x in raw[4:at].decode().split(";")):
        out.append(np.frombuffer(raw, kind, int(n), at))
        at += out[-1].nbytes
    return tuple(out)


def _by_bucket(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each bucket's members, in their order."""
    bucket = bucket.astype(np.uint16 if n <= 1 << 16 else np.int64)  # short numbers sort faster
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        yield i, order[cuts[i] : cuts[i + 1]]


def _within(size: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the sizes."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all strings, one after the other."""
    return data[np.repeat(start, size) + _within(size)]


def _equal(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each string of ``LENGTH`` bytes or more, and the first string of each number.

    Strings of one number are equal.  Equal strings have one number, except for long
    ones that differ from others in the middle only.
    """
    eight, h = _words(data), size.astype(np.uint64)

    def ends(start: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
        for first in (start, start + size - LENGTH):
            for p in (*range(0, LENGTH - 7, 8), LENGTH - 8):
                yield eight[first + p]

    for word in ends(start, size):
        h = (h ^ word) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h)
    s = h[order]
    near = np.flatnonzero(s[1:] == s[:-1])
    a, b = order[near], order[near + 1]
    same = size[a] == size[b]
    for one, other in zip(ends(start[a], size[a]), ends(start[b], size[b])):
        same &= one == other
    for i in np.flatnonzero(same & (size[a] > 2 * LENGTH)).tolist():
        x, y, n = int(start[a[i]]), int(start[b[i]]), int(size[a[i]])
        same[i] = np.array_equal(data[x : x + n], data[y : y + n])
    new = np.ones(len(order), bool)
    new[near[same] + 1] = False
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, np.minimum.reduceat(order, np.flatnonzero(new)) if len(order) else order


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


# -- step 1: which stretches may repeat ---------------------------------------------------------------
TAG = np.uint64(0xFFFFFFFF)


def _emit_keys(n_buckets: int):
    """Per bucket, the documents and the low 32 bits of their stretches' keys."""
    names = ["bucket", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            ids, keys = (np.concatenate(x) for x in zip(*held))
            out = []
            for i, at in _by_bucket(_bucket(keys, n_buckets), n_buckets):
                head = np.flatnonzero(np.r_[True, np.diff(ids[at]) != 0])
                counts = np.diff(np.append(head, len(at))).astype(np.uint32)
                out.append((i, _pack(np.diff(ids[at][head], prepend=0), counts, (keys[at] & TAG).astype(np.uint32))))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names)

        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            for row, _, _, key in stretches(data, offsets):
                held.append((ids[row], key))
                size += len(row)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
        release()

    return run


def _shared_keys(hot: int):
    """One row per document: its keys of one bucket that occur in another document, too.

    Without a document, ``tags`` are the shared keys of more than ``hot`` stretches.
    """

    def run(bucket: pa.Table) -> pa.Table:
        parts = [_unpack(p) for p in bucket.column("payload").to_pylist()]
        ids = np.concatenate([np.repeat(np.cumsum(d), n) for d, n, _ in parts])
        tags = np.concatenate([t for _, _, t in parts])
        order = np.argsort(tags, kind="stable")
        head = np.flatnonzero(np.r_[True, np.diff(tags[order]) != 0])
        low, high = np.minimum.reduceat(ids[order], head), np.maximum.reduceat(ids[order], head)
        size = np.diff(np.append(head, len(ids)))
        many = tags[order[head[(low != high) & (size > hot)]]].astype("<u4")
        kept = order[np.repeat(low != high, size)]
        kept = kept[np.argsort(ids[kept], kind="stable")]
        owner, values = ids[kept], tags[kept].astype("<u4")
        head = np.flatnonzero(np.r_[True, np.diff(owner) != 0]) if len(owner) else np.empty(0, np.int64)
        out = pa.table({"doc_id": pa.array(owner[head]), "tags": _binaries(values, np.append(head, len(owner)))})
        spread = pa.table({"doc_id": pa.array([None], pa.int64()), "tags": pa.array([many.tobytes()], pa.binary())})
        release()
        return pa.concat_tables([out, spread]) if len(many) else out

    return run


def _binaries(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of ``values`` between the cuts."""
    offsets = (cuts * values.itemsize * (values.size // max(1, len(values)))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])


def _joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all binaries of a column, and the size of each."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return data, np.diff(offsets)


def _spans_by_doc(ids: np.ndarray, hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row per document: its (first window, number of windows) pairs as bytes."""
    order = np.lexsort((starts, hashes, ids))
    ids, hashes = ids[order], hashes[order]
    pairs = np.column_stack([starts[order], counts[order]]).astype("<u4")
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])
    head = np.flatnonzero(new)
    return pa.RecordBatch.from_arrays([pa.array(ids[head]), pa.array(hashes[head]), _binaries(pairs, np.append(head, len(ids)))], ["doc_id", "h", "spans"])


SPANS = "doc_id long, h int, spans binary"
_NO_SPANS = pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.binary())], ["doc_id", "h", "spans"])


# -- step 2: send the bytes of these stretches ----------------------------------------------------------
def _covered(column: pa.Array, hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Flag per byte: covered by a span of its row."""
    change = np.zeros(int(offsets[-1]) + 1, np.int8)
    lists = column.flatten()
    if len(lists):
        owner = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
        own = lists.field("h").to_numpy() == hashes[owner]
        spans, owner = lists.field("spans").filter(pa.array(own)), owner[own]
        flat, sizes = _joined_bytes(spans)
        pairs = flat.view("<u4").reshape(-1, 2).astype(np.int64)
        start = offsets[np.repeat(owner, sizes // 8)] + pairs[:, 0]
        end = start + pairs[:, 1] - 1 + LENGTH
        order = np.argsort(start, kind="stable")
        start, end = start[order], np.maximum.accumulate(end[order])
        new = np.ones(len(start), bool)
        new[1:] = start[1:] > end[:-1]
        if len(start):  # spans that touch are one, so the steps are 1 and -1
            change[start[new]] = 1
            change[end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]] = -1
    return np.cumsum(change[:-1], dtype=np.int8).view(bool)


def _shared_tags(column: pa.Array) -> np.ndarray:
    """Sorted (row << 32 | tag) of the rows' lists of packed tags."""
    lists = column.flatten()
    owner = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    flat, sizes = _joined_bytes(lists)
    return np.sort((np.repeat(owner, sizes // 4) << 32) | flat.view("<u4").astype(np.int64))


def _split(data: np.ndarray, hot: np.ndarray, row: np.ndarray, place: np.ndarray, count: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
    """The stretches, those of a key in ``hot`` cut into windows whose keys are hashes of all their bytes."""
    cut = np.isin((key & TAG).astype(np.uint32), hot)
    if not cut.any():
        return row, place, count, key
    times = np.where(cut, count, 1)
    inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    own = np.repeat(cut, times)
    row, place, key, count = np.repeat(row, times), np.repeat(place, times) + inner, np.repeat(key, times), np.repeat(count, times)
    eight, at = _words(data), place[own]
    total = np.zeros(len(at), np.uint64)
    for p in (*range(0, LENGTH - 7, 8), LENGTH - 8):
        total = mix(total ^ eight[at + p].astype(np.uint64))
    key[own], count[own] = total, 1
    return row, place, count, key


def _joined(doc: np.ndarray, h: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans that follow each other in one document, as one."""
    new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]) | (start[1:] != start[:-1] + count[:-1])]
    head = np.flatnonzero(new)
    return doc[head], h[head], start[head], np.add.reduceat(count, head)


def _emit_stretches(n_buckets: int, hot: np.ndarray):
    names = ["bucket", "payload", "local"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, held, n_bytes, n_held = [], [], 0, 0
        for batch in batches:
            _, cuts = utf8(batch.column("text"))
            for a, b in row_slices(cuts, SLICE):
                part = batch.slice(a, b - a)
                data, offsets = utf8(part.column("text"))
                shared = _shared_tags(part.column("tags"))
                ids, hashes = part.column("doc_id").to_numpy(), part.column("h").to_numpy()
                for row, place, count, key in stretches(data, offsets):
                    wanted = (row << 32) | (key & TAG).astype(np.int64)
                    at = np.searchsorted(shared, wanted)
                    found = (at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == wanted)
                    if not found.any():
                        continue
                    row, place, count, key = _split(data, hot, row[found], place[found], count[found], key[found])
                    low, high = int(place[0]), int((place + count).max()) + LENGTH - 1
                    for lo in range(0, len(row), FLUSH):
                        at = slice(lo, lo + FLUSH)
                        if not lo or not texts:  # a text goes with all that is taken of it
                            texts.append(data[low:high].copy())
                            base, n_bytes = n_bytes - low, n_bytes + high - low
                        held.append((ids[row[at]], hashes[row[at]], place[at] - offsets[row[at]], count[at], key[at], place[at] + base))
                        n_held += len(held[-1][0])
                        if n_held >= FLUSH or n_bytes >= TEXT:
                            yield flush(texts, held)
                            texts, held, n_bytes, n_held = [], [], 0, 0
        if held:
            yield flush(texts, held)
        release()

    def flush(texts: list, held: list) -> pa.RecordBatch:
        doc, h, start, count, key, place = (np.concatenate(x) for x in zip(*held))
        data = np.concatenate(texts)
        number, first = _equal(data, place, count + LENGTH - 1)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, number, doc)
        kept = doc == least[number]
        sent = np.flatnonzero(kept)
        sent = sent[np.argsort(first[number[sent]], kind="stable")]  # copies follow each other
        buckets, members = zip(*_by_bucket(_bucket(key[sent], n_buckets), n_buckets))
        sent, cuts = sent[np.concatenate(members)], np.cumsum([0, *map(len, members)])
        new = np.r_[True, np.diff(number[sent]) != 0]
        one, before = sent[new], np.r_[0, np.cumsum(new)][cuts]
        size = count[one] + LENGTH - 1
        sizes, tags, inner = size.astype(np.uint32), (key[one] & TAG).astype(np.uint32), new.astype(np.int8)
        docs, hashes, starts = np.diff(doc[sent], prepend=0), h[sent], start[sent].astype(np.uint32)
        inner[cuts[:-1]], docs[cuts[:-1]] = 0, doc[sent[cuts[:-1]]]
        bytes_before = np.r_[0, np.cumsum(size)][before]
        out = []
        for a, b in row_slices(bytes_before, SLICE):
            text = _gather(data, place[one[before[a] : before[b]]], size[before[a] : before[b]])
            for i in range(a, b):
                its, rows = slice(before[i], before[i + 1]), slice(cuts[i], cuts[i + 1])
                own = text[bytes_before[i] - bytes_before[a] : bytes_before[i + 1] - bytes_before[a]]
                out.append((buckets[i], _pack(own, sizes[its], tags[its], inner[rows], docs[rows], hashes[rows], starts[rows]), None))
        if not kept.all():
            rest = ~kept
            spans = _joined(doc[rest], h[rest], start[rest], count[rest])
            out.append((int(spans[1][0] % n_buckets), None, _pack(*spans)))
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], names
        )

    return run


# -- step 3: sort the suffixes of a bucket -----------------------------------------------------------------
def _shift_table() -> np.ndarray:
    """Smallest shift that leads two residues into the cover together."""
    table = np.zeros((PERIOD, PERIOD), np.int64)
    for r in range(PERIOD):
        for s in range(PERIOD):
            table[r, s] = next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER and (s + d) % PERIOD in COVER)
    return table


def _prefix(text: np.ndarray, at: np.ndarray, depth: int) -> Iterator[np.ndarray]:
    """Numbers that compare as the ``depth`` bytes from ``at`` on, the most significant first."""
    eight = _words(text, ">u8")
    places = [*range(0, depth - 7, 8)]
    if places[-1] + 8 < depth:
        places.append(depth - 8)
    for p in places:
        yield eight[at + p].astype(np.uint64)


def _dense(columns: Iterator[np.ndarray]) -> np.ndarray:
    """Rank of every row of ``columns``, of which one is held at a time; equal rows share a rank."""
    rank = None
    for column in columns:
        column = np.unique(column, return_inverse=True)[1]
        if rank is None:
            rank = column
        else:  # ranks and places are below the number of rows
            rank = np.unique(rank * (int(column.max()) + 1) + column, return_inverse=True)[1]
        if rank.max() + 1 == len(rank):
            break
    return rank


def sort_suffixes(text: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Class of each window: equal for those that agree in ``LENGTH`` bytes, ascending in suffix order.

    ``text`` must run on for ``LENGTH + PERIOD`` bytes behind every window.
    """
    if not len(windows):
        return np.empty(0, np.int64)
    # the cover sample, ranked to depth LENGTH
    sample = np.zeros(len(text), bool)
    for d in range(PERIOD):
        sample[windows + d] = True
    sample &= np.isin(np.arange(len(text)) % PERIOD, COVER)
    places = np.flatnonzero(sample)
    rank = np.zeros(len(text), np.int64)
    rank[places] = _dense(_prefix(text, places, LENGTH))
    # the windows by their first bytes
    start = _dense(_prefix(text, windows, 8))
    tied = np.flatnonzero(np.bincount(start)[start] > 1)
    # long ties by the sample: a window's place is the number of windows before it in every residue class
    shift, residue = _shift_table(), windows[tied] % PERIOD
    of = [tied[residue == r] for r in range(PERIOD)]

    def key(members: np.ndarray, d: int) -> np.ndarray:
        return (start[members] << 40) | rank[windows[members] + d]

    ahead = np.zeros(len(windows), np.int64)
    for r in range(PERIOD):
        for s in range(PERIOD):
            if len(of[r]) and len(of[s]):
                ahead[of[r]] += np.searchsorted(np.sort(key(of[s], shift[r, s])), key(of[r], shift[r, s]))
    order = np.lexsort((ahead, start))
    # neighbours that agree in LENGTH bytes are one class
    new = np.zeros(len(windows), bool)
    for c in _prefix(text, windows, LENGTH):
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(windows), np.int64)
    out[order] = np.cumsum(new)
    return out


def _repeats(bucket: pa.Table) -> pa.Table:
    """Spans of one bucket that repeat a smaller document, by document."""
    done = [_unpack(x) for x in bucket.column("local").drop_null().to_pylist()]
    parts = [_unpack(x) for x in bucket.column("payload").drop_null().to_pylist()]
    if parts:
        done += _spans_of(*_strings(parts))
    if not done:
        return pa.Table.from_batches([_NO_SPANS])
    doc, h, start, count = (np.concatenate(x) for x in zip(*done))
    return pa.Table.from_batches([_spans_by_doc(doc, h, start, count) if len(doc) else _NO_SPANS])


def _strings(parts: list[tuple]) -> tuple[np.ndarray, ...]:
    """Bytes, first byte, size and key of the different stretches, and the stretch, document, hash and first window of each row."""
    data = np.concatenate([p[0] for p in parts])
    size = np.concatenate([p[1] for p in parts]).astype(np.int64)
    key = np.concatenate([p[2] for p in parts])
    before = np.cumsum([0, *(len(p[1]) for p in parts)])
    group = np.concatenate([np.cumsum(p[3], dtype=np.int64) + n for p, n in zip(parts, before)])
    doc = np.concatenate([np.cumsum(p[4]) for p in parts])
    h, start = np.concatenate([p[5] for p in parts]), np.concatenate([p[6] for p in parts]).astype(np.int64)
    parts.clear()
    place = np.cumsum(size) - size
    number, first = _equal(data, place, size)
    return data, place[first], size[first], key[first], number[group], doc, h, start


def _spans_of(
    data: np.ndarray, place: np.ndarray, size: np.ndarray, key: np.ndarray, group: np.ndarray, doc: np.ndarray, h: np.ndarray, start: np.ndarray
) -> Iterator[tuple[np.ndarray, ...]]:
    """Document, hash, first window and number of windows of what repeats a smaller document."""
    least = np.full(len(size), np.iinfo(np.int64).max)
    np.minimum.at(least, group, doc)
    later = doc > least[group]
    yield doc[later], h[later], start[later], (size - LENGTH + 1)[group[later]]
    # each stretch counts for all places where its smallest document has it
    entries = np.flatnonzero(~later)
    entries = entries[np.argsort(group[entries], kind="stable")]
    cuts = np.searchsorted(group[entries], np.arange(len(size) + 1))
    # only keys with several different stretches need sorting, some whole keys at a time
    order = np.argsort(key, kind="stable")
    _, count = np.unique(key[order], return_counts=True)
    order = order[np.repeat(count > 1, count)]
    head = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(order) else np.empty(0, np.int64)
    windows = np.add.reduceat(size[order] - LENGTH + 1, head) if len(order) else head
    turn = (np.cumsum(windows) - windows) // SORTED
    for a, b in zip(np.searchsorted(turn, np.unique(turn)), np.searchsorted(turn, np.unique(turn), "right")):
        mixed = order[head[a] : head[b] if b < len(head) else len(order)]
        n = size[mixed]
        base = np.cumsum(n + PERIOD) - n - PERIOD
        text = np.zeros(int((n + PERIOD).sum()) + LENGTH + PERIOD + 8, np.uint8)
        text[np.repeat(base, n) + _within(n)] = _gather(data, place[mixed], n)
        owner = np.repeat(np.arange(len(mixed)), n - LENGTH + 1)
        inner = _within(n - LENGTH + 1)
        classes = sort_suffixes(text, base[owner] + inner)
        first = np.full(int(classes.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, classes, least[mixed][owner])
        gone = first[classes] < least[mixed][owner]
        new = gone & np.r_[True, ~gone[:-1] | (owner[1:] != owner[:-1])]
        runs = np.flatnonzero(new)
        if not len(runs):
            continue
        run = np.bincount(np.cumsum(new)[gone] - 1, minlength=len(runs))
        of_string = mixed[owner[runs]]
        times = cuts[of_string + 1] - cuts[of_string]
        at = entries[np.repeat(cuts[of_string], times) + _within(times)]
        yield doc[at], h[at], start[at] + np.repeat(inner[runs], times), np.repeat(run, times)


# -- the operator ---------------------------------------------------------------------------------------------
def _sent(docs: DataFrame, n_buckets: int | None, hot: int) -> DataFrame:
    """``bucket, payload, local``: the stretches that may repeat, by bucket."""
    keyed = _keyed(docs)
    n = n_buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_keys = max(64, n // 4)
    if n_buckets is None:
        n_bytes = keyed.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        n_keys = max(n_keys, n_bytes // (RUN * KEYS))
    # a document's keys fall into so many buckets that the rows below follow the documents, not the buckets
    hashed = keyed.mapInArrow(_emit_keys(n_keys), "bucket int, payload binary")
    shared = hashed.groupBy("bucket").applyInArrow(_shared_keys(hot), "doc_id long, tags binary")
    shared = checkpointed(shared.groupBy("doc_id").agg(F.collect_list("tags").alias("tags")))
    spread = shared.where("doc_id is null").first()
    spread = np.unique(np.frombuffer(b"".join(spread["tags"]) if spread else b"", "<u4"))
    if n_buckets is None:
        sizes = F.aggregate("tags", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t))
        n = max(n, RUN * (shared.where("doc_id is not null").agg(F.sum(sizes)).first()[0] or 0) // 4 // GATHERED)
    texts = keyed.join(shared, "doc_id")
    return texts.select("doc_id", "h", "text", "tags").mapInArrow(_emit_stretches(n, spread), "bucket int, payload binary, local binary")


def find_repeats(docs: DataFrame, n_buckets: int | None = None, hot: int = HOT) -> DataFrame:
    """``doc_id, spans`` of all documents with repeated strings: a list of (h, packed pairs), h the hash of the row's text.

    A pair (first window, number of windows) as unsigned 32-bit numbers covers the
    bytes from the first window on to the last one's end.  Keys of more than
    ``hot`` stretches are spread over the buckets window by window.
    """
    def sort_bucket(bucket: pa.Table) -> pa.Table:
        out = _repeats(bucket)
        release()
        return out

    repeats = _sent(docs, n_buckets, hot).groupBy("bucket").applyInArrow(sort_bucket, SPANS)
    return repeats.groupBy("doc_id").agg(F.collect_list(F.struct("h", "spans")).alias("spans"))


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows that take part; rows that repeat an id are told apart by their text's hash."""
    text = F.coalesce("text", F.lit(""))
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), text.alias("text"), F.hash(text).alias("h"))


def _cut(make: Callable[[np.ndarray, np.ndarray], tuple], names: list[str], types: list[pa.DataType], at: dict[str, int]):
    """Apply ``make(bytes, covered flags)`` to every row; its results replace or follow the row's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, cuts = utf8(batch.column(at["text"]))
            for lo, hi in row_slices(cuts, SLICE):
                part = batch.slice(lo, hi - lo)
                data, offsets = utf8(part.column(at["text"]))
                covered = _covered(part.column(at["spans"]), part.column(at["h"]).to_numpy(), offsets)
                made = [make(data[a:b], covered[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                kept = [c for i, c in enumerate(part.columns) if i not in at.values()]
                arrays = [pa.array([m[i] for m in made], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*kept, *arrays], names=names)
        release()

    return run


def _digest(data: np.ndarray, covered: np.ndarray) -> tuple[int, int, int, str]:
    spans = int(np.count_nonzero(covered[1:] & ~covered[:-1])) + int(len(covered) > 0 and covered[0])
    return len(data), int(covered.sum()), spans, hashlib.sha256(data[~covered].tobytes()).hexdigest()


def _characters(data: np.ndarray, covered: np.ndarray) -> tuple[str]:
    """The text without the characters all of whose bytes are covered."""
    if not covered.any():
        return (data.tobytes().decode("utf-8", "replace"),)
    head = np.flatnonzero((data & 0xC0) != 0x80)
    whole = np.logical_and.reduceat(covered, head)
    size = np.diff(np.append(head, len(data)))
    return (data[~np.repeat(whole, size)].tobytes().decode("utf-8", "replace"),)


def repeat_digests(docs: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row.

    Null texts count as empty.  Rows with one id neither take from nor give to
    each other; rows without an id keep all their bytes and take none from
    others.  No rows: no rows.  ``doc_id`` is an integer.
    """
    keyed = _keyed(docs)
    joined = keyed.join(find_repeats(docs, n_buckets), "doc_id", "left").select("doc_id", "h", "text", "spans")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    shape = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    cut = joined.mapInArrow(_cut(_digest, names, types, {"h": 1, "text": 2, "spans": 3}), shape)
    text = F.coalesce("text", F.lit(""))
    whole = docs.where("doc_id is null").select(
        F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"),
    )
    return cut.unionByName(whole)


def remove_repeats(docs: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """Columns of ``docs`` with the characters cut out of ``text`` whose bytes are all repeated.

    Rows as in ``repeat_digests``; null texts become empty.  ``n_chars``, where
    there is such a column, is counted anew.
    """
    columns = docs.columns
    text = F.coalesce("text", F.lit(""))
    own_h, own_id, own_spans = (free_name(docs, n) for n in ("h", "id", "spans"))
    full = docs.withColumns({"text": text, own_h: F.hash(text)})
    spans = find_repeats(docs, n_buckets).select(F.col("doc_id").alias(own_id), F.col("spans").alias(own_spans))
    joined = full.join(spans, F.col("doc_id") == F.col(own_id), "left").drop(own_id)
    at = {"text": joined.columns.index("text"), "h": joined.columns.index(own_h), "spans": joined.columns.index(own_spans)}
    kept = [c for c in columns if c != "text"]
    shape = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "text string"])
    out = joined.mapInArrow(_cut(_characters, [*kept, "text"], [pa.string()], at), shape)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)
