"""Approximate nearest neighbours by low-dimensional stable projections and a kd-tree.

Vectors are scaled to length 1, so that the largest cosine is the smallest
Euclidean distance, and projected on ``m`` Gaussian directions.  For two vectors at
distance d the squared distance of their projections is d*d times a chi-square
variable of m degrees.  Neighbours are taken in the order of their projections and
verified; the search stops once a projection so far away would, for a vector as
near as the k-th best, have a chance below ``1 - confidence``: the chi-square test.

The projections are parted by a kd-tree whose upper splits are fitted on a bounded
sample; every vector is indexed, each cell with a small kd-tree of its own.
A query first searches its own cell; the k-th distance found there tells by the same
test which other cells it must visit.  Queries meet cells in an equi join; vectors are
copied only of cells that more than ``QUERY_BLOCK`` queries visit, once for each
further block of queries.  Equal vectors are indexed once, with the ids that can be
results.

The share of vectors that is verified depends on the data.  Where they have no
structure at all (independent Gaussian components), no cell can be ruled out, and the
work of a query grows with the number of vectors, less the part that the test saves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seclake.llm.common import checkpointed, stored

LEAF = 256
SAMPLE = 20_000  # projections on which the cells are fitted
CELL = (1_000, 50_000)  # least and most vectors in a cell, about
FIRST = 32  # neighbours that are verified before the first test; each further step takes twice as many
QUERY_BLOCK = 4_000  # queries of one cell that a task searches at a time


def chi_square_quantile(p: float, m: int) -> float:
    """Value that a chi-square variable of m degrees stays below with probability p."""

    def below(x: float) -> float:
        a, term, total = m / 2, 1.0 / (m / 2), 1.0 / (m / 2)
        n = a
        while term > total * 1e-14:
            n += 1
            term *= (x / 2) / n
            total += term
        return total * math.exp(-x / 2 + a * math.log(x / 2) - math.lgamma(a))

    low, high = 1e-9, 10.0 * m + 100
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


# -- kd-trees -------------------------------------------------------------------------------------------
def split_points(points: np.ndarray, least: int) -> list[np.ndarray]:
    """Leaves of a kd-tree: index arrays of at most ``least`` points, split at the median of the widest side."""
    todo, leaves = [np.arange(len(points))], []
    while todo:
        at = todo.pop()
        if len(at) <= least:
            leaves.append(at)
            continue
        part = points[at]
        side = int(np.argmax(part.max(0) - part.min(0)))
        order = np.argpartition(part[:, side], len(at) // 2)
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return leaves


@dataclass
class Cells:
    """Upper kd-tree: boxes that together cover the whole projected space."""

    low: np.ndarray
    high: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, count: int) -> Cells:
        m = sample.shape[1]
        boxes = [(np.full(m, -np.inf), np.full(m, np.inf), sample)]
        while len(boxes) < count:
            boxes.sort(key=lambda b: len(b[2]))
            low, high, part = boxes.pop()
            side = int(np.argmax(part.max(0) - part.min(0))) if len(part) else 0
            cut = np.median(part[:, side]) if len(part) else 0.0
            if len(part) < 2 or not (part[:, side] < cut).any():
                boxes.append((low, high, part))
                break
            upper, lower = low.copy(), high.copy()
            upper[side], lower[side] = cut, cut
            boxes += [(low, lower, part[part[:, side] < cut]), (upper, high, part[part[:, side] >= cut])]
        return cls(np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes]))

    def of(self, points: np.ndarray) -> np.ndarray:
        out = [
            ((part[:, None, :] >= self.low) & (part[:, None, :] < self.high)).all(2).argmax(1)
            for part in np.array_split(points, max(1, len(points) // 256))
        ]
        return np.concatenate(out)

    def reached(self, points: np.ndarray, radius2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, cell) pairs with the cell's box within the radius."""
        gap = np.maximum(0.0, np.maximum(self.low - points[:, None, :], points[:, None, :] - self.high))
        return np.nonzero((gap * gap).sum(2) <= radius2[:, None])


@dataclass
class Tree:
    """Small kd-tree over the projections of one cell, with the vectors to verify; leaves follow each other."""

    ids: list[np.ndarray]  # per vector, its smallest ids
    vectors: np.ndarray
    norms: np.ndarray
    projected: np.ndarray
    leaf: np.ndarray  # of each vector
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def build(cls, ids: list[np.ndarray], vectors: np.ndarray, projected: np.ndarray) -> Tree:
        leaves = split_points(projected, LEAF)
        low, high = (np.array([f(projected[at], 0) for at in leaves]) for f in (np.min, np.max))
        order = np.concatenate(leaves)
        leaf = np.repeat(np.arange(len(leaves)), [len(at) for at in leaves])
        vectors = vectors[order]
        return cls([ids[i] for i in order], vectors, np.sqrt((vectors * vectors).sum(1)), projected[order], leaf, low, high)

    def search(self, vector: np.ndarray, point: np.ndarray, k: int, worst: float, limit: float) -> tuple[list[tuple[float, int]], int]:
        """Best (cosine, id) pairs and the number of vectors that were verified.

        ``worst`` is a k-th squared distance already known, ``limit`` the chi-square
        bound.  Vectors come in the order of their projected distance.
        """
        gap = np.maximum(0.0, np.maximum(self.low - point, point - self.high))
        at = np.flatnonzero(((gap * gap).sum(1) <= limit * worst)[self.leaf])
        away = self.projected[at] - point
        away = np.einsum("ij,ij->i", away, away)
        at, away = at[away <= limit * worst], away[away <= limit * worst]
        order = np.argsort(away, kind="stable")
        at, away = at[order], away[order]
        norm = math.sqrt((vector * vector).sum())
        best: list[tuple[float, int]] = []
        done, step = 0, FIRST
        while done < len(at) and away[done] <= limit * worst:  # the chi-square test
            end = min(done + step, int(np.searchsorted(away, limit * worst, "right")))
            some = at[done:end]
            cosine = (self.vectors[some] * vector).sum(1) / (self.norms[some] * norm)
            near = np.flatnonzero(2.0 - 2.0 * cosine <= worst + 1e-9)
            best += [(float(cosine[i]), int(v)) for i in near for v in self.ids[some[i]]]
            best.sort(key=lambda b: (-b[0], b[1]))
            del best[k:]
            if len(best) == k:
                worst = min(worst, max(0.0, 2.0 - 2.0 * best[-1][0]))
            done, step = end, 2 * step
        return best, done


# -- the operator -----------------------------------------------------------------------------------------
def usable(vectors: DataFrame) -> DataFrame:
    """Rows ``vec_id, embedding`` that take part: an id, all components finite, not all 0, the most frequent length."""
    array = F.col("embedding").cast("array<double>")
    clean = vectors.select("vec_id", array.alias("embedding")).where("vec_id is not null and embedding is not null and size(embedding) > 0")
    finite = F.forall("embedding", lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    clean = clean.where(finite & F.exists("embedding", lambda x: x != 0))
    length = clean.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return clean.where(F.size("embedding") == (length[0]["n"] if length else 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, m: int = 32, confidence: float = 0.93, seed: int = 23) -> DataFrame:
    """``query_id, rank, vec_id, score, n_verified``: the k largest cosines found for each id of ``queries`` (column query_id).

    Candidates are all usable rows of ``vectors`` but the query's own; ties go to
    the smaller id.  Queries that are no usable row have no result, and fewer than
    k candidates give fewer rows.  Rows that repeat an id and its vector count once.
    ``n_verified`` is the number of different vectors whose cosine was computed.
    """
    key = F.concat(F.hex(F.xxhash64("embedding")), F.lit("-"), F.hex(F.xxhash64("embedding", F.lit(seed))))
    rows = usable(vectors).withColumn("key", key)
    # k ids of a vector are enough, and one more in case the query itself is among them
    heads = rows.withColumn("n", F.dense_rank().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    index = checkpointed(heads.groupBy("key").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"), F.first("embedding").alias("embedding")))
    asked = rows.select("vec_id", "key").join(queries.select(F.col("query_id").alias("vec_id")).distinct(), "vec_id").distinct()
    asked = checkpointed(asked.select(F.col("vec_id").alias("query_id"), "key"))
    total = index.count()
    result = "query_id long, rank int, vec_id long, score double, n_verified long"
    if not total:
        return vectors.sparkSession.createDataFrame([], result)
    wanted = checkpointed(index.join(asked.select("key").distinct(), "key").select("key", "embedding"))

    size = index.limit(1).select(F.size("embedding")).first()[0]
    directions = np.random.default_rng(seed).standard_normal((size, m))
    part = index.orderBy(F.xxhash64("key")).limit(SAMPLE).select("embedding").toArrow()
    per_cell = min(max(10 * math.isqrt(total), CELL[0]), CELL[1])
    cells = Cells.fit(_scaled(_matrix(part.column("embedding").combine_chunks(), size)) @ directions, max(1, round(total / per_cell)))
    limit = chi_square_quantile(confidence, m)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _scaled(_matrix(batch.column("embedding"), size)) @ directions
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.of(points), pa.int32())], names=[*batch.schema.names, "cell"])

    def search(own: bool):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            keys, cosines, found, verified = [], [], [], []
            if left.num_rows and right.num_rows:
                matrix = _matrix(right.column("embedding").combine_chunks(), size)
                ids = [np.array(x) for x in right.column("ids").to_pylist()]
                tree = Tree.build(ids, matrix, _scaled(matrix) @ directions)
                asked_for = _matrix(left.column("embedding").combine_chunks(), size)
                points = _scaled(asked_for) @ directions
                worst = np.full(left.num_rows, 4.0) if own else left.column("worst").to_numpy()
                for i, one in enumerate(left.column("key").to_pylist()):
                    best, n = tree.search(asked_for[i], points[i], k + 1, float(worst[i]), limit)
                    best = best or [(None, None)]  # the number counts even so
                    keys += [one] * len(best)
                    cosines += [b[0] for b in best]
                    found += [b[1] for b in best]
                    verified += [n] + [0] * (len(best) - 1)
            columns = {"key": pa.array(keys, pa.string()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(cosines, pa.float64()), "verified": pa.array(verified, pa.int64())}
            return pa.table(columns)

        return run

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _scaled(_matrix(batch.column("embedding"), size)) @ directions
            worst = batch.column("worst").to_numpy()
            home = cells.of(points)
            for at in range(0, batch.num_rows, 256):
                query, cell = cells.reached(points[at : at + 256], limit * worst[at : at + 256])
                other = home[at + query] != cell
                query, cell = query[other] + at, cell[other]
                for lo in range(0, len(query), 2048):
                    taken = batch.take(pa.array(query[lo : lo + 2048]))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell[lo : lo + 2048], pa.int32())], names=[*batch.schema.names, "cell"])

    shape = "key string, vec_id long, score double, verified long"
    placed = index.mapInArrow(place, "key string, ids array<long>, embedding array<double>, cell int").select("ids", "embedding", "cell")

    def met(asking: DataFrame, own: bool) -> DataFrame:
        """Results of queries in their cells; cells of many queries are copied for each block of them."""
        counts = asking.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))  # one short row per cell
        counts = F.broadcast(checkpointed(counts))
        spread = placed.join(counts, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = asking.join(counts, "cell").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).drop("blocks")
        return dealt.groupBy("cell", "block").cogroup(spread.drop("blocks").groupBy("cell", "block")).applyInArrow(search(own), shape)

    at_home = wanted.mapInArrow(place, "key string, embedding array<double>, cell int")
    first_found = checkpointed(met(at_home, True))
    kth = first_found.groupBy("key").agg(F.count("vec_id").alias("n"), F.min("score").alias("low"))
    bound = F.when(F.col("n") >= k + 1, F.greatest(F.lit(0.0), 2 - 2 * F.col("low"))).otherwise(4.0)
    routed = wanted.join(kth, "key", "left").select("key", "embedding", F.coalesce(bound, F.lit(4.0)).alias("worst"))
    away = stored(routed.mapInArrow(route, "key string, embedding array<double>, worst double, cell int"))
    found = checkpointed(first_found.unionByName(met(away, False)))
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    best = found.where("vec_id IS NOT NULL").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n", "verified")
    best = best.join(found.groupBy("key").agg(F.sum("verified").alias("n_verified")), "key")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    own = asked.join(best, "key").where("query_id <> vec_id").withColumn("rank", F.row_number().over(ranked))
    return own.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "n_verified")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors as rows, divided by a power of 2 each, which no cosine feels and no square overflows."""
    matrix = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    if not len(matrix):
        return matrix
    return np.ldexp(matrix, -np.frexp(np.abs(matrix).max(1, keepdims=True))[1])


def _scaled(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.sqrt((matrix * matrix).sum(1, keepdims=True)) if len(matrix) else matrix
