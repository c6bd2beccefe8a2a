"""Helpers shared by the corpus operators: checkpoints, Arrow text buffers, hashed words, samples, components."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20  # bytes of text that are hashed at a time; bounds the working memory of a task
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


# -- lineage -----------------------------------------------------------------------------------
def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Frames made inside delete their shuffle files when they have run, not when the driver's garbage collector comes to them.

    For frames that run once; one that runs again shuffles again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from those files."""
    shared_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint()  # a frame takes the setting when it is made


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to a new place in the shared folder and go on from those files."""
    place = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def remove(spark: SparkSession, place: str) -> None:
    """Delete a folder of the shared file system that this session has written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, max_rows: int = 500_000) -> DataFrame:
    """Broadcast ``df``, a few short columns, if it has at most ``max_rows`` rows; beyond that Spark shuffles and splits skewed keys.

    ``df`` should be checkpointed, as it is counted.
    """
    with shuffles_removed(df.sparkSession):
        small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# -- worker processes ------------------------------------------------------------------------------
def worker_state(name: str, make: Callable):
    """A value that lives as long as the worker process; the globals of functions sent to it do not."""
    state = sys.modules.setdefault("_worker_state", ModuleType("_worker_state")).__dict__
    if name not in state:
        state[name] = make()
    return state[name]


def release() -> None:
    """Give memory that was freed back to the system, so that a worker does not keep the peak of an earlier task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems have other C libraries
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def releasing(run: Callable) -> Callable:
    """``run`` on a task's batches, then ``release``."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


class Remembered:
    """Values of strings that ``make`` computes for a list of them; those met lately are remembered.

    Two generations of about ``size`` strings are held.  When the young one is
    full it becomes the old one, and what was old goes unless it is met again.
    """

    def __init__(self, make: Callable[[list[str]], list], size: int) -> None:
        self.make, self.size = make, size
        self.young: dict = {}
        self.old: dict = {}

    def __call__(self, parts: list[str]) -> list:
        missing = set(parts).difference(self.young)
        if missing and self.young and len(self.young) + len(missing) > self.size:
            self.old, self.young = self.young, {}
            missing = set(parts)
        young, old = self.young, self.old
        if missing:
            new = []
            for part in missing:
                if part in old:
                    young[part] = old[part]
                else:
                    new.append(part)
            for at in range(0, len(new), 4096):
                some = new[at : at + 4096]
                young.update(zip(some, self.make(some)))
        return list(map(young.__getitem__, parts))


# -- Arrow text ----------------------------------------------------------------------------------
def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets of the rows; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.empty(0, np.uint8)
    return data, offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def row_slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes together; a longer row stands alone."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end
        row = end


# -- hashed words --------------------------------------------------------------------------------
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: white space parts words: bytes 09-0d and 20
WORDS = np.ones(256, np.uint8)
WORDS[[9, 10, 11, 12, 13, 32]] = 0
#: runs of letters and digits (2), and runs of other signs (1), are words of their own
SIGNS = WORDS.copy()
SIGNS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 2
#: only letters and digits make words
LETTERS = np.where(SIGNS == 2, 1, 0).astype(np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = np.empty(0, np.uint64), np.empty(0, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) < n:
        _UP, _DOWN = _powers(_BASE, n), _powers(_INVERSE, n)
    return _UP, _DOWN


def _pieces(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``SLICE_BYTES`` that cut no word, unless one word alone is longer."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + SLICE_BYTES)
        if end < n:
            blank = np.flatnonzero(kinds[data[at:end]] == 0)
            row = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            cut = max(at + int(blank[-1]) + 1 if len(blank) else at, row)
            end = cut if cut > at else end
        yield at, end
        at = end


def words(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray, prefix: int = 0) -> tuple[np.ndarray, ...]:
    """Hash (A-Z in lower case), row and first byte of every word of the rows.

    A word is a longest run of bytes of one kind; kind 0 parts words.  With
    ``prefix``, a fourth array has the hash of each word's first bytes.
    """
    hashes, rows, firsts, stems = [], [], [], []
    for a, b in _pieces(data, offsets, kinds):
        part = data[a:b]
        kind = kinds[part]
        before = np.empty_like(kind)
        before[1:] = kind[:-1]
        before[0] = 0
        heads = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
        before[heads] = 0
        start = np.flatnonzero((kind != before) & (kind != 0))
        if not len(start):
            continue
        after = np.empty_like(kind)
        after[:-1] = kind[1:]
        after[-1] = 0
        after[heads[heads > 0] - 1] = 0
        end = np.flatnonzero((kind != after) & (kind != 0)) + 1
        up, down = _tables(SLICE_BYTES + 1)
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum((LOWER[part].astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
        hashes.append(mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)))
        rows.append(np.searchsorted(offsets, start + a, "right") - 1)
        firsts.append(start + a)
        if prefix:
            stop = np.minimum(end, start + prefix)
            stems.append(mix((total[stop] - total[start]) * down[start] ^ np.uint64(0xD1B54A32D192ED03)))
    none = [np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)]
    found = [np.concatenate(x) if x else n for x, n in zip((hashes, rows, firsts, stems), none)]
    return tuple(found) if prefix else tuple(found[:3])


# -- samples of labelled rows ----------------------------------------------------------------------
def held_out(doc_id: Column) -> Column:
    """True for rows that no model learns from: crc32 of the id as text, modulo 5, is 0 (or the id is null)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """``text, label`` of at most ``max_rows`` labelled documents outside the held-out fold.

    The ids with the smallest hashes are taken, so reruns take the same ones.
    Repeated labels count as 1 if one of them is 1; of repeated documents the
    smallest text counts.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id")
        .limit(max_rows)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # max_rows bounds the broadcast
    return texts.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


# -- connected components ----------------------------------------------------------------------------
def components(links: DataFrame) -> DataFrame:
    """``node, component`` of all nodes in ``links`` (columns a, b of one orderable type): the smallest node reachable.

    Alternates large-star and small-star rounds until a round changes nothing;
    each round is one aggregate and one join on the links, written to the shared
    checkpoint folder.  A hub's links meet in joins that Spark can split.
    """
    edges = checkpointed(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u > v")
        smallest = down.groupBy("u").agg(F.min("v").alias("m"))
        star = (
            down.join(smallest, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u > v")
            .distinct()
        )
        after = checkpointed(star)
        with shuffles_removed(edges.sparkSession):
            old = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            new = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        edges = after
        if old == new:
            break
    nodes = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
