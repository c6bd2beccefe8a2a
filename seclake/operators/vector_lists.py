"""A vector index in coarse lists, and exact or probing search over it.

Centroids are fitted on a bounded sample; every vector belongs to the list of its
nearest centroid and knows its angle to it.  A query meets lists by equal list number.
For unit vectors the angle is a metric, so a list whose vectors are within an angle h
of its centroid, which a query sees at an angle a, has all its vectors between a - h
and a + h.  The lists with the smallest a + h that hold enough vectors bound the
query's k-th angle, and so does the k-th best vector of the sample, which is in the index;
lists that begin beyond the nearer bound are not read, and the result is exact.
Lists built of more vectors than the sample holds are searched in two steps: the list
nearest to a query gives a bound that tightens with the index, and the others are read
as far as that bound asks.

The number of vectors and the angles of each list are measured when the index is built
and are kept with the centroids, so that planning a search runs nothing.  Lists of many
vectors are spread over several tasks by a hash of the id; lists that many queries ask
for take them in blocks.  Every task splits its vectors into cells of neighbours, multiplies
the queries with those cells that may hold one of the best rows, and returns these only.  Written as files, the scope and the list are partition columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seclake.operators.dedupe import first_n
from seclake.session import kept
from seclake.vocab import SCOPE_COLUMNS

SAMPLE = 20_000  # vectors on which centroids are fitted
LISTS = 1024  # lists at most; one for every ``PER_LIST`` vectors of the sample
PER_LIST = 500
BLOCK_ROWS = 20_000  # vectors of a list in one task
QUERY_ROWS = 16_000  # queries of a list in one task
CELL = 64  # vectors of a cell at most
AXES = 16  # directions along which cells are bounded, at most
NO_DIRECTION = -1  # list of the zero vectors, whose cosine with all is 0
_SCORES_AT_ONCE = 4_000_000
_SLACK = 1e-6  # angles of nearly equal vectors are not more precise


def unit_rows(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows scaled to length one; a zero vector stays zero."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    matrix = flat.astype(np.float64).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


@dataclass(frozen=True)
class CoarseLists:
    """Centroids of length one with the numbers of vectors, smallest and largest angles of their lists.

    There are ``LISTS`` at most, whatever the index holds, and one more for the
    vectors without a direction, the last entry of the measures.  ``some`` are vectors
    of the index, for lists that are searched right after they were built.
    """

    centroids: np.ndarray
    sizes: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    some: np.ndarray | None = None

    @classmethod
    def fit(cls, index: DataFrame, count: int | None = None, sample: int = SAMPLE, rounds: int = 6) -> CoarseLists:
        """Spherical k-means on the ``sample`` vectors with the smallest hashes of their ids; nothing is measured yet."""
        some = index.where("embedding is not null").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("embedding").toArrow()
        units = unit_rows(some["embedding"])
        units = units[units.any(axis=1)]
        if not len(units):
            return cls(np.zeros((0, 1)))
        count = min(count or max(1, len(units) // PER_LIST), LISTS, len(units))
        centroids = units[:count].copy()
        for _ in range(rounds):
            nearest = (units @ centroids.T).argmax(1)
            sums = np.zeros_like(centroids)
            np.add.at(sums, nearest, units)
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
        return cls(centroids, some=units[np.isfinite(units).all(axis=1)])

    def measured(self, entries: DataFrame) -> CoarseLists:
        """With the measures of ``entries`` (list, angle); one short row per list comes back."""
        rows = entries.groupBy("list").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()
        sizes, low, high = np.zeros(len(self.centroids) + 1, np.int64), np.zeros(len(self.centroids) + 1), np.zeros(len(self.centroids) + 1)
        for r in rows:
            sizes[r["list"]], low[r["list"]], high[r["list"]] = r["n"], r["low"], r["high"]
        return CoarseLists(self.centroids, sizes, low, high)

    @classmethod
    def build(cls, index: DataFrame, count: int | None = None) -> CoarseLists:
        """Fitted on and measured over ``index`` (chunk_id, embedding)."""
        lists = cls.fit(index, count)
        measured = lists.measured(lists.assign(index.select("chunk_id", "embedding")))
        return replace(measured, some=lists.some)

    def angles(self, units: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(units @ self.centroids.T, -1.0, 1.0))

    def assign(self, index: DataFrame) -> DataFrame:
        """Columns of ``index`` and ``list, angle``; rows without a vector go."""
        rows = index.where("embedding is not null").drop("list", "angle")
        at = rows.columns.index("embedding")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                units = unit_rows(batch.column(at))
                lists, angles = np.full(len(units), NO_DIRECTION), np.full(len(units), math.pi / 2)
                some = np.flatnonzero(units.any(axis=1)) if len(self.centroids) else np.empty(0, np.int64)
                for lo in range(0, len(some), 2048):
                    part = some[lo : lo + 2048]
                    found = self.angles(units[part])
                    lists[part], angles[part] = found.argmin(1), found.min(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.int32()), pa.array(angles)], names=[*batch.schema.names, "list", "angle"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(run, fields + ", list int, angle double")

    def reached(self, units: np.ndarray, limit: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each query and list whether it may hold one of the ``limit`` best vectors, and a cosine that these reach.

        ``known`` has a cosine of each query that these reach (or NaN), in place of the sample's.
        """
        angles = np.full((len(units), len(self.centroids) + 1), math.pi / 2)
        if len(self.centroids):
            angles[:, :-1] = self.angles(units)
        far = angles + self.high
        far[:, -1] = math.pi / 2  # any query and a vector without a direction
        order = np.argsort(far, axis=1)
        enough = np.cumsum(self.sizes[order], axis=1) >= limit
        place = np.where(enough.any(axis=1), enough.argmax(axis=1), len(self.sizes) - 1)
        bound = np.take_along_axis(far, np.take_along_axis(order, place[:, None], 1), 1)
        bound = np.where(enough.any(axis=1)[:, None], bound, math.pi)
        gap = np.maximum(np.maximum(angles - self.high, self.low - angles), 0.0)
        if len(self.centroids):
            gap[:, :-1] = np.maximum(gap[:, :-1], self.beyond(units))
        gap[:, -1] = math.pi / 2
        aimless = ~units.any(axis=1)
        gap[aimless], bound[aimless] = 0.0, math.pi
        if known is not None:
            known = np.where(np.isnan(known), -1.0, known - 1e-9)
            bound[:, 0] = np.minimum(bound[:, 0], np.arccos(np.clip(known, -1.0, 1.0)))
        elif self.some is not None and len(self.some) >= limit:
            for lo in range(0, len(units), 64):
                scores = units[lo : lo + 64] @ self.some.T
                best = np.partition(scores, len(self.some) - limit, axis=1)[:, len(self.some) - limit]
                bound[lo : lo + 64, 0] = np.minimum(bound[lo : lo + 64, 0], np.arccos(np.clip(best, -1.0, 1.0)))
        bound = np.minimum(bound + _SLACK, math.pi)
        floor = np.cos(bound[:, 0]) - _SLACK
        return (gap <= bound) & (self.sizes > 0), floor if known is None else np.maximum(floor, known)

    def beyond(self, units: np.ndarray) -> np.ndarray:
        """The angle from each query to the side of each list: its vectors are nearer to its centroid than to the query's."""
        dots = units @ self.centroids.T
        home = dots.argmax(1)
        apart = np.linalg.norm(self.centroids[:, None] - self.centroids[None], axis=2)[home]
        ahead = np.maximum(dots[np.arange(len(units)), home][:, None] - dots - 1e-12, 0.0)
        way = np.divide(ahead, apart, out=np.zeros_like(ahead), where=apart > 0)
        return 2 * np.arcsin(np.clip(way / 2, 0.0, 1.0)) - _SLACK

    def nearest(self, units: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query and list whether it is one of the nearest ones that hold vectors."""
        angles = np.full((len(units), len(self.centroids) + 1), math.pi / 2)
        if len(self.centroids):
            angles[:, :-1] = self.angles(units)
        angles[:, self.sizes == 0] = np.inf
        place = np.argsort(np.argsort(angles, axis=1, kind="stable"), axis=1)
        return (place < probes) & (self.sizes > 0), np.full(len(units), -2.0)

    def routes(self, queries: DataFrame, limit: int, probes: int | None = None) -> DataFrame:
        """``query_id, embedding, list, floor``: the lists that a query has to read, and a cosine that its result reaches.

        A column ``known`` of the queries has such a cosine already.
        """
        columns = [c for c in ("query_id", "embedding", "known") if c in queries.columns]
        kinds = [queries.schema[c].dataType.simpleString() for c in ("query_id", "embedding")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    part = batch.slice(lo, 512)
                    units = unit_rows(part.column(1))
                    known = part.column(2).to_numpy(zero_copy_only=False).astype(np.float64) if len(columns) > 2 else None
                    read, floor = self.reached(units, limit, known) if probes is None else self.nearest(units, probes)
                    query, list_ = np.nonzero(read)
                    list_ = np.where(list_ == len(self.centroids), NO_DIRECTION, list_)
                    found = [*part.take(pa.array(query)).columns[:2], pa.array(list_, pa.int32()), pa.array(floor[query])]
                    yield pa.RecordBatch.from_arrays(found, names=["query_id", "embedding", "list", "floor"])

        return queries.select(*columns).mapInArrow(run, f"query_id {kinds[0]}, embedding {kinds[1]}, list int, floor double")

    def parts(self) -> Column:
        """Number of tasks that the vectors of column ``list`` are spread over."""
        counts = np.maximum(1, -(-self.sizes // BLOCK_ROWS))
        if (counts == 1).all():
            return F.lit(1)
        return F.get(F.lit([int(counts[-1]), *map(int, counts[:-1])]), F.col("list") - NO_DIRECTION)


# -- the index as files ---------------------------------------------------------------------------
def write_lists(index: DataFrame, path: str, count: int | None = None) -> CoarseLists:
    """Write ``index`` (chunk_id, embedding, scope columns, ...) in lists; scope and list are folders."""
    spark, lists = index.sparkSession, CoarseLists.fit(index, count)
    lists.assign(index).repartition(*SCOPE_COLUMNS, "list").write.partitionBy(*SCOPE_COLUMNS, "list").parquet(f"{path}/entries")
    lists = lists.measured(spark.read.parquet(f"{path}/entries"))
    numbers = zip(lists.sizes.tolist(), lists.low.tolist(), lists.high.tolist())
    rows = [(i, [float(x) for x in c], *m) for i, (c, m) in enumerate(zip([*lists.centroids, []], numbers))]
    spark.createDataFrame(rows, "list int, centroid array<double>, n long, low double, high double").coalesce(1).write.parquet(f"{path}/centroids")
    return lists


def read_lists(spark: SparkSession, path: str) -> tuple[DataFrame, CoarseLists]:
    """Index with ``list, angle``, and its lists."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").toArrow()
    centroids = unit_rows(rows["centroid"].slice(0, rows.num_rows - 1)) if rows.num_rows > 1 else np.zeros((0, 1))
    return spark.read.parquet(f"{path}/entries"), CoarseLists(centroids, *(rows[c].to_numpy() for c in ("n", "low", "high")))


# -- search -----------------------------------------------------------------------------------------
def _objects(values: list) -> np.ndarray:
    out = np.empty(len(values), dtype=object)
    out[:] = values
    return out


def _ranked(query: np.ndarray, row: np.ndarray, score: np.ndarray, id_rank: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, score and row of the ``n`` best rows of every query; ties go to the smaller id."""
    # rounded, so that equal vectors tie whatever block they are in
    score = np.round(score, 12)
    order = np.lexsort((id_rank[row], -score, query))
    query, row, score = query[order], row[order], score[order]
    best = np.arange(len(query)) - np.searchsorted(query, query) < n
    return query[best], score[best], row[best]


def _best(queries: np.ndarray, floor: np.ndarray, units: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, score and row of the ``n`` best rows of every query, no score below ``floor``; ties go to the smaller id."""
    found = []
    id_rank = np.unique(ids, return_inverse=True)[1]
    cells = _Cells.of(units) if len(units) > 8 * CELL and np.isfinite(units).all() else None
    width = max(_SCORES_AT_ONCE // max(len(units), 1), 1)
    some = width if cells is None else max(_SCORES_AT_ONCE // len(cells.size) // 4, width)
    for first in range(0, len(queries), some):
        asked, low = queries[first : first + some], floor[first : first + some]
        hits = cells.hits(asked, low, n) if cells else None
        if hits is not None:
            query, score, row = _ranked(*hits, id_rank, n)
            found.append((query + first, score, row))
            continue
        for at in range(0, len(asked), width):
            scores = asked[at : at + width] @ units.T
            reached = scores >= low[at : at + width, None]
            full = np.flatnonzero(reached.sum(axis=1) > n)
            if len(full):
                # the floor, as the scores, is not more precise
                best = np.partition(scores[full], len(units) - n, axis=1)[:, len(units) - n]
                reached[full] &= scores[full] >= best[:, None] - 1e-9
            query, row = np.nonzero(reached)
            query, score, row = _ranked(query, row, scores[query, row], id_rank, n)
            found.append((query + first + at, score, row))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int), np.empty(0), np.empty(0, int))


@dataclass(frozen=True)
class _Cells:
    """Vectors in cells of neighbours: each cell's rows (the last ones of short cells are -1) and its box along the widest directions."""

    units: np.ndarray
    rows: np.ndarray
    size: np.ndarray
    axes: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, units: np.ndarray) -> _Cells:
        """Halved along the widest of the main directions until a cell is small."""
        axes = np.linalg.eigh(np.cov(units.T).reshape(units.shape[1], -1))[1][:, ::-1][:, :AXES]
        along = units @ axes
        parts, done = [np.arange(len(units))], []
        while parts:
            rows = parts.pop()
            if len(rows) <= CELL:
                done.append(rows)
                continue
            own = along[rows]
            wide = own[:, np.ptp(own, axis=0).argmax()]
            order, half = np.argpartition(wide, len(rows) // 2), len(rows) // 2
            parts += [rows[order[:half]], rows[order[half:]]]
        table = np.full((len(done), CELL), -1)
        for i, rows in enumerate(done):
            table[i, : len(rows)] = rows
        size = np.array([len(x) for x in done])
        low, high = (np.stack([f(along[x], axis=0) for x in done]) for f in (np.min, np.max))
        return cls(units, table[:, : size.max()], size, axes, low, high)

    def away(self, queries: np.ndarray) -> np.ndarray:
        """The distance from each query to each box, as the vectors in it are not nearer."""
        along = queries @ self.axes
        square = np.zeros((len(queries), len(self.size)))
        for d in range(along.shape[1]):
            at = along[:, d, None]
            square += np.maximum(np.maximum(self.low[:, d] - at, at - self.high[:, d]), 0.0) ** 2
        return np.sqrt(square)

    def hits(self, queries: np.ndarray, floor: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Query, row and score of rows among which are the ``n`` best; None if too many cells may hold them."""
        away = self.away(queries)
        floor = np.maximum(floor, self.reach(queries, away, n))
        # vectors of length one or zero whose scalar product is at least f are sqrt(2 - 2 f) apart at most
        may = away <= np.sqrt(np.maximum(2 - 2 * floor, 0.0))[:, None] + _SLACK
        if may.mean() > 0.3 or (may @ self.size).sum() > 8 * _SCORES_AT_ONCE:
            return None
        found = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
        for cell in np.flatnonzero(may.any(0)).tolist():
            who, rows = np.flatnonzero(may[:, cell]), self.rows[cell, : self.size[cell]]
            scores = queries[who] @ self.units[rows].T
            query, row = np.nonzero(scores >= floor[who, None])
            found.append((who[query], rows[row], scores[query, row]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def reach(self, queries: np.ndarray, away: np.ndarray, n: int) -> np.ndarray:
        """A cosine of each query that its ``n`` best rows reach, from the nearest cells."""
        count = min(-(-3 * n // int(self.size.min())), len(self.size))
        out = np.full(len(queries), -2.0)
        if int(np.sort(self.size)[:count].sum()) < n:
            return out
        step = max(_SCORES_AT_ONCE // (4 * count * self.rows.shape[1] * queries.shape[1]), 1)
        for at in range(0, len(queries), step):
            cells = np.argpartition(away[at : at + step], count - 1, axis=1)[:, :count]
            rows = self.rows[cells].reshape(len(cells), -1)
            scores = np.einsum("qd,qrd->qr", queries[at : at + step], self.units[rows])
            scores[rows < 0] = -2.0
            out[at : at + step] = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n] - 1e-9
        return out


def search_lists(queries: DataFrame, index: DataFrame, lists: CoarseLists, limit: int, probes: int | None = None) -> DataFrame:
    """``query_id, chunk_id, dense_score, dense_rank``: the ``limit`` largest cosines of each query.

    ``queries``: query_id, embedding.  ``index``: chunk_id, embedding and, if it was
    written in lists, ``list, angle``; ``lists`` must have been measured over its rows
    or more.  With ``probes`` only that many lists nearest to a query are read, and the
    result may miss rows.  Rows and queries without a vector take no part; a query
    without a direction scores 0 everywhere, and ids decide.
    """
    if lists.sizes is None:
        raise ValueError("lists must be measured before they are searched")
    entries = index if "list" in index.columns else lists.assign(index)
    asked = queries.where("embedding is not null")
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {index.schema['chunk_id'].dataType.simpleString()}, dense_score double"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    blocks = F.coalesce("blocks", F.lit(1))

    def dealt(name: str, count: Column) -> Column:
        return F.pmod(F.xxhash64(name), count).cast("int")

    def every(count: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), count - 1))

    def search(one: pa.Table, other: pa.Table) -> pa.Table:
        if not one.num_rows or not other.num_rows:
            return arrow.empty_table()
        ids = _objects(other["chunk_id"].to_pylist())
        query, score, row = _best(unit_rows(one["embedding"]), one["floor"].to_numpy(), unit_rows(other["embedding"]), ids, limit)
        columns = [one["query_id"].combine_chunks().take(pa.array(query)), other["chunk_id"].combine_chunks().take(pa.array(row)), pa.array(score)]
        return pa.Table.from_arrays(columns, schema=arrow)

    def found(asks: DataFrame, tasks: int | None = None) -> DataFrame:
        # lists that many queries ask for; one row per list at most
        crowded = asks.groupBy("list").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks")).where("blocks > 1")
        left = asks.join(F.broadcast(crowded), "list", "left").select(
            "query_id", "embedding", "floor", "list", dealt("query_id", blocks).alias("block"), every(lists.parts()).alias("part")
        )
        right = entries.join(F.broadcast(crowded), "list", "left").select(
            "chunk_id", "embedding", "list", dealt("chunk_id", lists.parts()).alias("part"), every(blocks).alias("block")
        )
        place = ["list", "part", "block"]
        if tasks:  # few bytes make much work here, so they are not to be put together
            left, right = left.repartition(tasks, *place), right.repartition(tasks, *place)
        rows = left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(search, schema)
        return first_n(rows, ["query_id"], [F.desc("dense_score"), "chunk_id"], limit, rank="dense_rank")

    if probes is not None or lists.some is None or len(lists.some) >= lists.sizes.sum():
        return found(lists.routes(asked, limit, probes))
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = found(lists.routes(asked, limit, probes=1), tasks).where(F.col("dense_rank") == limit)
    known = asked.join(near.select("query_id", F.col("dense_score").alias("known")), "query_id", "left")
    return found(kept(lists.routes(known, limit)), tasks)  # read twice


def lists_read(queries: DataFrame, lists: CoarseLists, limit: int) -> DataFrame:
    """``query_id, lists_read, vectors_read``: what an exact search reads for each query."""
    sizes = F.lit([int(lists.sizes[-1]), *map(int, lists.sizes[:-1])])
    asks = lists.routes(queries.where("embedding is not null"), limit)
    return asks.groupBy("query_id").agg(F.count("*").alias("lists_read"), F.sum(F.get(sizes, F.col("list") - NO_DIRECTION)).alias("vectors_read"))
