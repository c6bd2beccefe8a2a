"""Cross-tokenizer alignment: tokens of two tokenizers matched by the bytes they cover.

A byte-level BPE (A) and a sentencepiece model (B) encode the same bytes, a space
and the text.  Tokens by bytes is a sparse incidence matrix in compressed rows
(CSR), built by hand.  Its row products give the links: A . Bt over all bytes links
tokens that overlap and counts the bytes they share; over last bytes only it links
tokens that end together.  Offsets where both end cut the tokens into groups, and
the product of the two group incidences links all tokens that share a group.

A blank between two characters that are no white space begins a token in both
tokenizers (no piece of B has a space after another sign; this is checked), so a
text is aligned piece by piece and a worker remembers the pieces it met lately.

Corpus-wide counts of linked ids are gathered by slices, runs of documents with
about ``SLICE_LINKS`` links together: a slice's distinct pairs are summed before
they are shuffled, and come back to the slice with their counts.  No slice is larger
than its largest document, whatever the corpus holds, and nothing passes the driver.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seclake.llm.common import Remembered, row_slices, stored, utf8, worker_state

SLICE_LINKS = 2_000_000  # links of a run of documents whose pairs are counted together
MEMORY = 100_000  # pieces of a generation that a worker remembers
SEGMENT = 1 << 18  # characters of a long text that are aligned at a time
SLICE = 1 << 19  # bytes of short texts that are aligned at a time
LINKS = ("end", "overlap", "group")

_CUT = re.compile(r"(?<=\S) (?=\S)")


# -- compressed sparse rows ------------------------------------------------------------------------
class Csr(NamedTuple):
    """Row i has the columns ``indices[indptr[i]:indptr[i + 1]]`` and as many values."""

    indptr: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    n_columns: int


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] numbers), first[1], ..."""
    total = int(count.sum())
    starts = np.cumsum(count) - count
    return np.arange(total) - np.repeat(starts - first, count)


def byte_incidence(lengths: np.ndarray) -> Csr:
    """Tokens by bytes, of tokens that follow each other with these lengths."""
    indptr = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    total = int(indptr[-1])
    return Csr(indptr, np.arange(total), np.ones(total, np.int64), total)


def one_each(columns: np.ndarray, n_columns: int) -> Csr:
    """One entry in every row."""
    return Csr(np.arange(len(columns) + 1), columns.astype(np.int64), np.ones(len(columns), np.int64), n_columns)


def transpose(m: Csr) -> Csr:
    rows = np.repeat(np.arange(len(m.indptr) - 1), np.diff(m.indptr))
    order = np.argsort(m.indices, kind="stable")
    indptr = np.concatenate([[0], np.cumsum(np.bincount(m.indices, minlength=m.n_columns))])
    return Csr(indptr, rows[order], m.values[order], len(m.indptr) - 1)


def product(a: Csr, b: Csr) -> Csr:
    """Gustavson's row products: row i of the result is the sum of a[i, k] times row k of b."""
    n_rows = len(a.indptr) - 1
    counts = np.diff(b.indptr)[a.indices]
    source = _ranges(b.indptr[a.indices], counts)
    rows = np.repeat(np.repeat(np.arange(n_rows), np.diff(a.indptr)), counts)
    columns, values = b.indices[source], np.repeat(a.values, counts) * b.values[source]
    keys = rows * b.n_columns + columns
    if len(keys) and np.any(keys[1:] <= keys[:-1]):  # add up what falls on one entry
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        values = np.add.reduceat(values[order], heads)
        rows, columns = rows[order][heads], columns[order][heads]
    indptr = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n_rows))])
    return Csr(indptr, columns, values, b.n_columns)


# -- numbers in bytes --------------------------------------------------------------------------------
def pack_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, low ones first, the high bit set on all but the last byte; bytes and the length of each number."""
    values = values.astype(np.uint64)
    length = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        length += values >= np.uint64(1 << bits)
    out = np.empty(int(length.sum()), np.uint8)
    at = np.cumsum(length) - length
    for k in range(int(length.max(initial=0))):
        some = length > k
        part = (values[some] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[some] + k] = part.astype(np.uint8) | np.where(length[some] > k + 1, 128, 0).astype(np.uint8)
    return out, length


def unpack_numbers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers and the position after each."""
    ends = np.flatnonzero(data < 128) + 1
    if not len(ends):
        return np.empty(0, np.int64), ends
    starts = np.concatenate([[0], ends[:-1]])
    place = np.arange(len(data)) - np.repeat(starts, ends - starts)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts), ends


# -- alignment of pieces -----------------------------------------------------------------------------
#: numbers of tokens, groups and links; groups as text; links as int64 a * n_ids_b + b
Aligned = tuple[int, int, int, int, str, bytes]
UNALIGNED: Aligned = (0, 0, 0, 0, "", b"")  # any other part has a token
_SIGNS = ["", ",", "|", ";"]  # what may follow an id


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the alignment of pieces."""

    def __init__(self, a_path: str, b_path: str, links: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.links = links
        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.post_processor = None
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        signs = _byte_signs()
        self.a_bytes: list[bytes] = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for entry, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = bytes(signs[c] for c in entry) if all(c in signs for c in entry) else entry.encode()
        self.n_b = self.b.get_piece_size()
        self.b_bytes = []
        for i in range(self.n_b):
            piece = self.b.id_to_piece(i)
            if re.search("[^▁]▁", piece):
                raise ValueError("a piece with a space after another sign: texts cannot be cut at spaces")
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in of], np.int64) for of in (self.a_bytes, self.b_bytes))

        ids = range(max(len(self.a_bytes), self.n_b))
        self.written = pa.array([str(i) + sign for i in ids for sign in _SIGNS])

    def __call__(self, parts: list[str]) -> list[Aligned]:
        """Alignment of each part behind a space; ``UNALIGNED`` where the tokens' bytes differ from it.

        Parts that begin and end with no white space are encoded together, a space
        between them: both tokenizers have a boundary there.
        """
        out = [UNALIGNED] * len(parts)
        together = [i for i, p in enumerate(parts) if p == p.strip()]
        alone = [i for i, p in enumerate(parts) if p != p.strip()]
        some = [parts[i] for i in together]
        sizes = np.fromiter((len(p.encode()) + 1 for p in some), np.int64, len(some))
        text = " ".join(some)
        found = self._split(" " + text, text, sizes) if some else []
        if found is None:  # one of them differs
            alone += together
        else:
            for i, aligned in zip(together, found):
                out[i] = aligned
        for i in alone:
            found = self._split(" " + parts[i], parts[i], np.array([len(parts[i].encode()) + 1]))
            out[i] = found[0] if found else UNALIGNED
        return out

    def _split(self, a_text: str, b_text: str, sizes: np.ndarray) -> list[Aligned] | None:
        """Alignments of the pieces of a text, whose bytes are ``sizes``; None if bytes differ or a piece ends inside a token."""
        a_ids = self.a.encode_batch_fast([a_text], add_special_tokens=False)[0].ids
        b_ids = self.b.encode(b_text)
        raw = a_text.encode()
        if not b"".join(map(self.a_bytes.__getitem__, a_ids)) == raw == b"".join(map(self.b_bytes.__getitem__, b_ids)):
            return None
        a, b = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        rows, columns = byte_incidence(self.a_sizes[a]), byte_incidence(self.b_sizes[b])
        a_end, b_end, ends = rows.indptr[1:], columns.indptr[1:], np.cumsum(sizes)
        a_first = np.concatenate([[0], np.searchsorted(a_end, ends, "right")])
        b_first = np.concatenate([[0], np.searchsorted(b_end, ends, "right")])
        if not len(a) or (a_end[a_first[1:] - 1] != ends).any() or (b_end[b_first[1:] - 1] != ends).any():
            return None
        found = product(one_each(a_end - 1, rows.n_columns), transpose(one_each(b_end - 1, rows.n_columns)))
        common = a_end[np.diff(found.indptr) > 0]
        a_group, b_group = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
        if self.links == "overlap":
            found = product(rows, transpose(columns))
        elif self.links == "group":
            found = product(one_each(a_group, len(common)), transpose(one_each(b_group, len(common))))
        codes = (np.repeat(a, np.diff(found.indptr)) * self.n_b + b[found.indices]).tobytes()
        link_first, group_first = found.indptr[a_first], np.searchsorted(common, np.concatenate([[0], ends]), "right")
        groups = self._written(a, a_group, b, b_group, a_first + b_first)
        numbers = (np.diff(x).tolist() for x in (a_first, b_first, group_first, link_first))
        cuts = (8 * link_first).tolist()
        return list(zip(*numbers, groups, [codes[i:j] for i, j in zip(cuts, cuts[1:])]))

    def _written(self, a: np.ndarray, a_group: np.ndarray, b: np.ndarray, b_group: np.ndarray, first: np.ndarray) -> list[str]:
        """Groups of each piece as ``a1,a2|b1;a3|b2,b3``; ``first`` has the pieces' first tokens, both sides counted."""
        place = np.concatenate([2 * a_group, 2 * b_group + 1])
        order = np.argsort(place, kind="stable")
        place, ids = place[order], np.concatenate([a, b])[order]
        sign = np.full(len(ids), _SIGNS.index(";"))
        sign[:-1][place[1:] == place[:-1]] = _SIGNS.index(",")
        sign[:-1][(place[1:] == place[:-1] + 1) & (place[:-1] % 2 == 0)] = _SIGNS.index("|")
        sign[first[1:] - 1] = _SIGNS.index("")
        text = self.written.take(pa.array(len(_SIGNS) * ids + sign))
        offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1][first]
        return pa.Array.from_buffers(pa.string(), len(first) - 1, [None, pa.py_buffer(offsets.tobytes()), text.buffers()[2]]).to_pylist()


def _byte_signs() -> dict[str, int]:
    """The printable sign that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def segments(text: str) -> Iterator[str]:
    """A long text in parts between which both tokenizers have a boundary; the space there belongs to neither."""
    at = 0
    while len(text) - at > SEGMENT:
        cut = _CUT.search(text, at + SEGMENT)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def _summed(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, times = codes[order], times[order]
    heads = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
    return codes[heads], (np.add.reduceat(times, heads) if len(heads) else times)


def _pieced(texts: list[str], remembered: Remembered) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Four numbers and groups of each text, and text and code of all links; a text with a part that is not aligned has zeros."""
    parts = [_CUT.split(t) for t in texts]
    first = np.cumsum([0, *map(len, parts)])[:-1]
    *numbers, written, links = zip(*remembered(list(chain.from_iterable(parts))))
    numbers = np.array(numbers, np.int64)
    bad = np.minimum.reduceat(numbers[0], first) == 0
    totals = np.add.reduceat(numbers, first, axis=1)
    rows = np.repeat(np.arange(len(texts)), totals[3])
    codes = np.frombuffer(b"".join(links), np.int64)
    if bad.any():
        rows, codes = rows[~bad[rows]], codes[~bad[rows]]
        totals[:, bad] = 0
    groups = ["" if b else ";".join(written[i:j]) for b, i, j in zip(bad.tolist(), first.tolist(), [*first[1:].tolist(), len(written)])]
    return totals.T, groups, rows, codes


def align_texts(texts: list[str | None], remembered: Remembered) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Four numbers and groups of each text; text, code and number of links of each distinct linked pair, in order."""
    numbers, groups = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
    found = [(np.empty(0, np.int64),) * 3]
    short = [i for i, t in enumerate(texts) if t and len(t) <= SEGMENT]
    if short:
        numbers[short], written, rows, codes = _pieced([texts[i] for i in short], remembered)
        for i, text in zip(short, written):
            groups[i] = text
        found.append((np.array(short)[rows], codes, np.ones(len(codes), np.int64)))
    for i, text in enumerate(texts):
        if not text or len(text) <= SEGMENT:
            continue
        written, codes, times = [], np.empty(0, np.int64), np.empty(0, np.int64)
        for segment in segments(text):
            (part,), (group,), _, new = _pieced([segment], remembered)
            if not part[0]:
                numbers[i], written, codes, times = 0, [], codes[:0], times[:0]
                break
            numbers[i] += part
            written.append(group)
            codes, times = _summed(np.concatenate([codes, new]), np.concatenate([times, np.ones(len(new), np.int64)]))
        groups[i] = ";".join(written)
        found.append((np.full(len(codes), i), codes, times))
    rows, codes, times = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((codes, rows))
    rows, codes, times = rows[order], codes[order], times[order]
    heads = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])])) if len(rows) else np.empty(0, np.int64)
    return numbers, groups, rows[heads], codes[heads], np.add.reduceat(times, heads) if len(heads) else times


def _packed(n_rows: int, rows: np.ndarray, codes: np.ndarray, times: np.ndarray) -> pa.Array:
    """For each row its distinct codes in order, as differences, each followed by its number of links."""
    steps = np.diff(codes, prepend=0)
    heads = np.flatnonzero(np.diff(rows, prepend=-1))
    steps[heads] = codes[heads]
    data, length = pack_numbers(np.column_stack([steps, times]).ravel())
    ends = np.concatenate([[0], np.cumsum(length)])
    offsets = ends[2 * np.searchsorted(rows, np.arange(n_rows + 1))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n_rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and number of links of every pair in a column of packed pairs."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(column) else np.empty(0, np.uint8)
    numbers, ends = unpack_numbers(data)
    sizes = np.diff(np.searchsorted(ends, offsets - offsets[0], "right")) // 2 if len(column) else np.empty(0, np.int64)
    steps, times = numbers[::2], numbers[1::2]
    rows = np.repeat(np.arange(len(sizes)), sizes)
    total = np.cumsum(steps)
    heads = np.cumsum(sizes) - sizes
    before = np.concatenate([[0], total])[heads]
    return rows, total - np.repeat(before, sizes), times


# -- operators -----------------------------------------------------------------------------------------
def align(docs: DataFrame, a_path: str, b_path: str, links: str = "end", slice_links: int = SLICE_LINKS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups, slice, pairs``, one row for each row of ``docs`` (doc_id, text).

    ``groups`` is the alignment as text, ``a1,a2|b1;a3|b2,b3`` with ids in order;
    ``pairs`` the packed id pairs that ``links`` ("end", "overlap" or "group")
    connects, see ``pair_rows``.  Null and empty texts, and texts whose tokens of
    either side do not spell a space and the text, have no tokens: zeros and ''.
    Special strings in texts are plain text.  Rows that repeat an id are aligned
    one by one; other columns of ``docs`` are not carried.  No rows: no rows.
    """
    if links not in LINKS:
        raise ValueError(f"links must be one of {LINKS}")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "slice", "pairs"]
    key_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered = worker_state(f"aligned {a_path} {b_path} {links}", lambda: Remembered(Aligner(a_path, b_path, links), MEMORY))
        slice_, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for a, b in row_slices(offsets, SLICE):
                part = batch.slice(a, b - a)
                numbers, groups, *pairs = align_texts(part.column(1).to_pylist(), remembered)
                slices = []
                for n_links in numbers[:, 3].tolist():
                    slices.append(slice_)
                    held += n_links
                    if held >= slice_links:
                        slice_, held = slice_ + 1, 0
                columns = [*(pa.array(numbers[:, k].copy()) for k in range(4)), pa.array(groups, pa.string()), pa.array(slices, pa.int64()), _packed(b - a, *pairs)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    shape = f"doc_id {key_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, slice bigint, pairs binary"
    return docs.select("doc_id", "text").mapInArrow(run, shape)


def n_ids(b_path: str) -> int:
    """Number of ids of the sentencepiece model."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()


def _pair_sums(aligned: DataFrame) -> DataFrame:
    """``slice, code, n`` of linked pairs, summed within a slice as far as a task sees it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_, codes, times, held = None, [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            c, t = _summed(np.concatenate(codes), np.concatenate(times))
            for lo in range(0, len(c), 100_000):
                part = c[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), slice_)), pa.array(part), pa.array(t[lo : lo + 100_000])], names=["slice", "code", "n"])

        for batch in batches:
            slices = batch.column(0).to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(np.concatenate([[True], slices[1:] != slices[:-1]])) if len(slices) else []
            for lo, hi in zip(heads, [*heads[1:], len(slices)]):
                for at in range(lo, hi, 512):
                    if held and (slice_ != slices[lo] or held > SLICE_LINKS):
                        yield from out()
                        codes, times, held = [], [], 0
                    slice_ = int(slices[lo])
                    _, c, t = _unpacked(batch.column(1).slice(at, min(512, hi - at)))
                    codes.append(c)
                    times.append(t)
                    held += len(c)
        if held:
            yield from out()

    return aligned.select("slice", "pairs").mapInArrow(run, "slice bigint, code bigint, n bigint").groupBy("slice", "code").agg(F.sum("n").alias("n"))


def link_counts(aligned: DataFrame, ids_b: int) -> DataFrame:
    """``a_id, b_id, n``: how many links of all documents connect the pair."""
    summed = _pair_sums(aligned).groupBy("code").agg(F.sum("n").alias("n"))
    return summed.select(F.floor(F.col("code") / ids_b).cast("bigint").alias("a_id"), (F.col("code") % ids_b).alias("b_id"), "n")


def pair_rows(aligned: DataFrame, ids_b: int) -> DataFrame:
    """``doc_id, a_id, b_id, n``: the linked pairs of every row of ``align``."""
    key_type = aligned.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, codes, times = _unpacked(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), pa.array(codes // ids_b), pa.array(codes % ids_b), pa.array(times)], names=["doc_id", "a_id", "b_id", "n"])

    return aligned.select("doc_id", "pairs").mapInArrow(run, f"doc_id {key_type}, a_id bigint, b_id bigint, n bigint")


def score_links(aligned: DataFrame, ids_b: int) -> DataFrame:
    """Columns of ``aligned`` without slice and pairs, and ``n_best, count_sum``.

    ``count_sum`` adds up, over a row's links, how many links of all rows connect
    the same two ids; ``n_best`` counts the links whose pair is the most frequent
    one of its B id, ties included.  ``aligned`` is written to the shared folder
    once (drop ``groups`` before if it is not needed) and read three times.  Rows
    without links have zeros.
    """
    kept = [c for c in aligned.columns if c not in ("slice", "pairs", "n_best", "count_sum")]
    aligned = stored(aligned.select(*kept, "slice", "pairs"))
    sums = stored(_pair_sums(aligned))
    counts = sums.groupBy("code").agg(F.sum("n").alias("total"))
    counts = stored(counts.withColumn("b", F.col("code") % ids_b))
    best = counts.groupBy("b").agg(F.max("total").alias("highest"))
    judged = counts.join(best, "b").select("code", "total", (F.col("total") == F.col("highest")).alias("best"))
    # the counts go back to the slices that asked for them
    asked = sums.select("slice", "code").join(judged, "code").select("slice", "code", "total", "best")

    def run(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        codes = pairs["code"].to_numpy()
        order = np.argsort(codes)
        codes, totals, highest = codes[order], pairs["total"].to_numpy()[order], pairs["best"].to_numpy()[order]
        n_best, count_sum = [], []
        for batch in docs.select(["pairs"]).to_batches(max_chunksize=1024):
            rows, code, times = _unpacked(batch.column(0))
            at = np.searchsorted(codes, code)
            n_best.append(np.bincount(rows, times * highest[at] if len(at) else None, batch.num_rows))
            count_sum.append(_row_sums(rows, times * totals[at] if len(at) else times, batch.num_rows))
        columns = [docs[c] for c in kept]
        for found in (n_best, count_sum):
            columns.append(pa.array(np.concatenate(found).astype(np.int64) if found else [], pa.int64()))
        return pa.table(columns, names=[*kept, "n_best", "count_sum"])

    fields = "".join(f"`{aligned.schema[c].name}` {aligned.schema[c].dataType.simpleString()}, " for c in kept)
    return aligned.groupBy("slice").cogroup(asked.groupBy("slice")).applyInArrow(run, fields + "n_best bigint, count_sum bigint")


def _row_sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums by row in whole numbers, which may exceed what a float holds."""
    running = np.concatenate([[0], np.cumsum(values)])
    return running[np.searchsorted(rows, np.arange(n), "right")] - running[np.searchsorted(rows, np.arange(n))]
