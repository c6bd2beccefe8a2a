"""Exact token counts, also of huge documents, by overlap resynchronisation.

A document of more than ``chunk_chars`` characters is cut into chunks that run
``overlap`` characters into their successor, and chunks are encoded on their own,
with offsets.  Two neighbours are spliced at a boundary between two pre-tokens
that both have in the overlap.  Such a boundary is stable: pre-tokens are matched
from left to right with no look behind and at most two characters ahead, and
merges never leave a pre-token; so a boundary of the left chunk that is not near
its end is one of the whole text, and from a true boundary on the right chunk
goes as the whole text does.  Boundaries in the last ``MARGIN`` characters of a
chunk, which may cut a contraction, white space or a special string, don't count.
Where neighbours have no common boundary (one word fills the overlap), the
document is cut again with chunks and overlaps four times as long.

Inside a chunk only the overlaps are encoded with offsets, and what lies between is
counted as shorter documents are.

Shorter documents are counted piece by piece.  A blank between two characters that
are no white space always begins a pre-token, so pieces are cut there; a worker
asks the library once for each different piece, and remembers those it met lately.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seclake.llm.common import Remembered, checkpointed, free_name, row_slices, utf8, worker_state

CHUNK_CHARS = 32_768
OVERLAP = 512
MARGIN = 64  # longer than any special string and any look-ahead
MEMORY = 150_000  # pieces of a generation whose counts a worker remembers
SLICE = 1 << 20  # bytes of short documents, or of chunks in one batch, that are worked on at a time

_CUT = re.compile(r"(?<=\S) (?=\S)")
_STEM = re.compile(r"(?:[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+(?=[!-/:-@\[-`{-~]))?")  # letters or numbers before an ASCII sign
#: white space of the language and the library together: a blank beside one of these cuts nothing (fixed values)
_SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_NOT_PLAIN = rf"^ | $|[{_SPACE}] | [{_SPACE}]"


def load_tokenizer(path: str):
    """The tokenizer of a file, read once per worker process."""
    return worker_state(f"tokenizer {path}", lambda: _read_tokenizer(path))


def _read_tokenizer(path: str):
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.post_processor = None
    if isinstance(tokenizer.pre_tokenizer, ByteLevel):
        tokenizer.pre_tokenizer.trim_offsets = False
    return tokenizer


def _token_bytes(tokenizer) -> np.ndarray | None:
    """Bytes of each token of a byte-level vocabulary, which has one sign for each; None for others."""
    from tokenizers.pre_tokenizers import ByteLevel

    if not isinstance(tokenizer.pre_tokenizer, ByteLevel) or tokenizer.normalizer is not None:
        return None
    special = {i: len(t.content.encode()) for i, t in tokenizer.get_added_tokens_decoder().items()}
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for entry, i in vocabulary.items():
        sizes[i] = special.get(i, len(entry))
    return sizes


class Counter:
    """Counts of whole texts; the pieces' counts come from the tokenizer."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        self.sizes = _token_bytes(tokenizer)
        self.first = Remembered(self._counts, MEMORY // 4)
        self.stems = Remembered(self._behind_blanks, MEMORY)
        self.later = Remembered(self._stems_and_tails, MEMORY)  # a piece behind the first has its blank

    def _counts(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _stems_and_tails(self, parts: list[str]) -> list[int]:
        """Tokens of each part behind its blank; a sign behind letters or numbers always begins a pre-token."""
        split = [_STEM.match(p).end() for p in parts]
        tails = iter(self.first([p[at:] for p, at in zip(parts, split) if 0 < at < len(p)]))
        stems = self.stems([p[:at] if at else p for p, at in zip(parts, split)])
        return [n + (next(tails) if 0 < at < len(p) else 0) for p, at, n in zip(parts, split, stems)]

    def _behind_blanks(self, parts: list[str]) -> list[int]:
        """Tokens of each part behind its blank; parts are encoded as one text and told apart by their bytes."""
        if self.sizes is None or len(parts) < 2:
            return self._counts([" " + p for p in parts])
        whole = [i for i, p in enumerate(parts) if p == p.strip()]
        text = "".join([" " + parts[i] for i in whole])
        ends = np.cumsum([1 + len(parts[i].encode()) for i in whole])
        reached = np.cumsum(self.sizes[self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids]) if whole else ends
        before = np.searchsorted(reached, ends, "right")
        if len(whole) < len(parts) or (reached[before - 1] != ends).any():
            alone = iter(self._counts([" " + p for i, p in enumerate(parts) if p != p.strip()]))
            rest = iter(self._behind_blanks([parts[i] for i in whole]) if len(whole) < len(parts) else self._counts([" " + p for p in parts]))
            return [next(rest) if p == p.strip() else next(alone) for p in parts]
        return np.diff(before, prepend=0).tolist()

    def behind_blank(self, text: str) -> int:
        """Tokens of a blank and ``text``, which begins and ends with no white space."""
        return sum(self.later(_CUT.split(text)))

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """Number of tokens of each text; null counts as empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        out = np.zeros(len(texts), np.int64)
        odd = np.asarray(pc.match_substring_regex(texts, _NOT_PLAIN))
        for row in np.flatnonzero(odd).tolist():
            parts = _CUT.split(texts[row].as_py())
            out[row] = self.first(parts[:1])[0] + sum(self.later(parts[1:]))
        plain = np.flatnonzero(~odd)
        if len(plain):
            parts = pc.split_pattern(texts.take(pa.array(plain)), " ")
            sizes, values = pc.list_value_length(parts).to_numpy(), pc.list_flatten(parts)
            heads = np.cumsum(sizes) - sizes
            inner = np.ones(len(values), bool)
            inner[heads] = False
            coded = values.filter(pa.array(inner)).dictionary_encode()
            known = np.array(self.later(coded.dictionary.to_pylist()), np.int64)
            running = np.concatenate([[0], np.cumsum(known[coded.indices.to_numpy()])]).astype(np.int64)
            ends = np.cumsum(sizes - 1)
            out[plain] = running[ends] - running[ends - sizes + 1] + np.array(self.first(values.take(pa.array(heads)).to_pylist()), np.int64)
        return out


def load_counter(path: str) -> Counter:
    return worker_state(f"counter {path}", lambda: Counter(load_tokenizer(path)))


def _boundaries(tokenizer, text: str) -> tuple[int, list[tuple[int, int]]]:
    """Number of tokens, and the place of every pre-token with the tokens before it."""
    encoding = tokenizer.encode(text, add_special_tokens=False)
    out, before = [], object()
    for i, (word, (at, _)) in enumerate(zip(encoding.word_ids, encoding.offsets)):
        if word != before or word is None:
            out.append((at, i))
        before = word
    return len(encoding), out


def _last_cut(text: str, least: int, most: int) -> int:
    """Place of the last blank from ``least`` to ``most`` that certainly begins a pre-token, or -1."""
    reach = 256
    while True:
        low = max(least, most - reach)
        found = -1
        for cut in _CUT.finditer(text, low, most + 2):
            found = cut.start()
        if found >= 0 or low == least:
            return found
        reach *= 4


def chunk_boundaries(path: str, text: str, start: int, stride: int, overlap: int, last: bool) -> tuple[int, list, list]:
    """Tokens of a chunk; pre-token boundaries in its head and tail overlaps, each with the tokens before it."""
    tokenizer, count = load_tokenizer(path), load_counter(path)
    # where the head that is encoded with offsets ends, and where the tail begins
    cut = _CUT.search(text, overlap) if start > 0 else None
    after_head = cut.start() if cut else 0 if start == 0 else -1
    before_tail = len(text) if last else _last_cut(text, after_head + 1, stride - 1) if after_head >= 0 else -1
    if after_head < 0 or before_tail <= after_head:
        total, found = _boundaries(tokenizer, text)
        head = [(start + at, i) for at, i in found if start > 0 and at <= overlap - MARGIN]
        return total, head, [(start + at, i) for at, i in found if not last and stride <= at <= len(text) - MARGIN]
    n_head, found = _boundaries(tokenizer, text[:after_head]) if start > 0 else (0, [])
    head = [(start + at, i) for at, i in found if at <= overlap - MARGIN]
    middle = text[after_head:before_tail]
    n_middle = int(count(pa.array([middle]))[0]) if start == 0 else count.behind_blank(middle[1:])
    n_tail, found = _boundaries(tokenizer, text[before_tail:]) if not last else (0, [])
    tail = [(start + before_tail + at, n_head + n_middle + i) for at, i in found if stride <= before_tail + at <= len(text) - MARGIN]
    return n_head + n_middle + n_tail, head, tail


def count_tokens(docs: DataFrame, path: str, limit: int = 512, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Columns of ``docs`` and ``n_bytes, n_tokens, over_limit`` (n_tokens above ``limit``).

    Counts are those of the tokenizer file at ``path`` without added tokens;
    special strings in texts count as the library reads them by default.  Null
    texts count as empty, with 0 tokens.  Rows that repeat an id are counted one
    by one.  Columns named like the results are replaced; no rows: no rows.
    """
    if overlap <= MARGIN or chunk_chars <= 2 * overlap:
        raise ValueError("chunks must be longer than two overlaps, overlaps longer than the margin")
    results = ["n_bytes", "n_tokens", "over_limit"]
    kept = docs.drop(*results)
    short = kept.where(F.coalesce(F.length("text"), F.lit(0)) <= chunk_chars)
    long = kept.where(F.length("text") > chunk_chars)
    text_at = kept.columns.index("text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load_counter(path)
        for batch in batches:
            _, offsets = utf8(batch.column(text_at))
            for a, b in row_slices(offsets, SLICE):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(count(part.column(text_at)))], names=[*part.schema.names, "n_tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    counted = short.mapInArrow(whole, fields + ", n_tokens bigint").withColumn("n_bytes", n_bytes)

    # one key for all equal texts, so that repeated rows are encoded once and ids may repeat
    key = F.sha2("text", 256)
    spliced = splice_long(long.select(key.alias("_key"), "text"), path, chunk_chars, overlap)
    own = free_name(kept, "key")
    counted_long = long.withColumns({own: key, "n_bytes": n_bytes}).join(spliced.withColumnRenamed("_key", own), own).drop(own)
    out = counted.unionByName(counted_long)
    return out.withColumns({"over_limit": F.col("n_tokens") > limit}).select(*kept.columns, *results)


def splice_long(texts: DataFrame, path: str, chunk_chars: int, overlap: int) -> DataFrame:
    """``_key, n_tokens`` of the distinct texts ``_key, text``, by chunks dealt out over all tasks."""

    def cut(stride: int, overlap: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Every text is read once and its chunks follow each other."""
            rows, held = [], 0
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    text = text.as_py()
                    n = max(1, -(-(len(text) - overlap) // stride))
                    for i in range(n):
                        part = text[i * stride :] if i == n - 1 else text[i * stride : (i + 1) * stride + overlap]
                        rows.append({"_key": key, "chunk": i, "start": i * stride, "stride": stride, "overlap": overlap, "last": i == n - 1, "part": part})
                        held += len(part)
                        if held >= SLICE:
                            yield pa.RecordBatch.from_pylist(rows, parts)
                            rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, parts)

        return run

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                total, head, tail = chunk_boundaries(path, row["part"], row["start"], row["stride"], row["overlap"], row["last"])
                yield pa.RecordBatch.from_pylist(
                    [{"_key": row["_key"], "chunk": row["chunk"], "last": row["last"], "total": total,
                      "head": [{"at": a, "n": n} for a, n in head], "tail": [{"at": a, "n": n} for a, n in tail]}], schema)

    parts = pa.schema([("_key", pa.string()), ("chunk", pa.int64()), ("start", pa.int64()), ("stride", pa.int64()), ("overlap", pa.int64()), ("last", pa.bool_()), ("part", pa.string())])
    edge = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
    schema = pa.schema([("_key", pa.string()), ("chunk", pa.int64()), ("last", pa.bool_()), ("total", pa.int64()), ("head", edge), ("tail", edge)])
    shape = "_key string, chunk bigint, last boolean, total bigint, head array<struct<at:bigint,n:bigint>>, tail array<struct<at:bigint,n:bigint>>"
    open_, done = texts, None
    while True:
        chunks = open_.mapInArrow(cut(chunk_chars, overlap), "_key string, chunk bigint, start bigint, stride bigint, overlap bigint, last boolean, part string")
        dealt = chunks.repartition(F.col("_key"), F.col("chunk"))  # equal texts meet, and long ones spread
        encoded = checkpointed(dealt.dropDuplicates(["_key", "chunk"]).mapInArrow(encode, shape))
        # an edge is the pair (chunk, chunk + 1)
        left = encoded.where("not last").select("_key", F.col("chunk").alias("edge"), F.col("tail"), F.lit(None).cast("array<struct<at:bigint,n:bigint>>").alias("head"))
        right = encoded.where("chunk > 0").select("_key", (F.col("chunk") - 1).alias("edge"), F.lit(None).cast("array<struct<at:bigint,n:bigint>>").alias("tail"), "head")
        edges = left.unionByName(right).groupBy("_key", "edge").agg(F.first("tail", True).alias("tail"), F.first("head", True).alias("head"))
        common = F.array_min(F.array_intersect(F.transform("tail", lambda e: e["at"]), F.transform("head", lambda e: e["at"])))
        met = edges.withColumn("at", common)

        def before(side: str):
            return F.filter(side, lambda e: e["at"] == F.col("at"))[0]["n"]

        edge_counts = met.select("_key", F.when(F.col("at").isNull(), None).otherwise(before("tail") - before("head")).alias("n"), F.col("at").isNull().alias("apart"))
        last = encoded.where("last").select("_key", F.col("total").alias("n"), F.lit(False).alias("apart"))
        sums = checkpointed(last.unionByName(edge_counts).groupBy("_key").agg(F.sum("n").alias("n_tokens"), F.max("apart").alias("apart")))
        good = sums.where("not apart").select("_key", "n_tokens")
        done = good if done is None else done.unionByName(good)
        if not sums.where("apart").limit(1).count():
            return done
        open_ = open_.join(sums.where("apart").select("_key"), "_key", "left_semi")
        chunk_chars, overlap = chunk_chars * 4, overlap * 4
