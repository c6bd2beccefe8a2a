"""First-wins selection, per-group caps and the duplicate counts that go with them.

``row_number() <= n`` is planned with a limit on both sides of the shuffle, so a
key that holds a third of all rows sends at most ``n`` rows per task.  For a larger
``n`` than Spark plans so, ``first_n`` ranks inside slices of the input first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seclake.functions.ids import content_hash
from seclake.functions.text import normalized

_GROUP_LIMIT_THRESHOLD = 1000
_SLICES = 64


def first_n(df: DataFrame, keys: list[str], order: list, n: int | None, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in the given order, all for None; ``rank`` keeps the number."""
    name = rank or "_rank"
    if n is None and rank is None:
        return df
    if n is not None and n > _GROUP_LIMIT_THRESHOLD:
        # exact: a row that is not among the first n of its slice cannot be among the first n
        sliced = df.withColumn("_slice", F.spark_partition_id() % _SLICES)
        inner = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = sliced.withColumn("_in", F.row_number().over(inner)).where(F.col("_in") <= n).drop("_slice", "_in")
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(window))
    if n is not None:
        ranked = ranked.where(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def ranked_by_score(df: DataFrame, keys: list[str], score: str, order: list, steps: int = 1000, rank: str = "rank") -> DataFrame:
    """Number all rows of each key by falling ``score`` (0 to 1), then ``order``, without a key's rows in one task.

    Scores fall into ``steps`` ranges.  Rows are numbered inside their range, and the
    counts of the ranges above, at most ``steps`` short rows a key, are added.  Null
    scores come last.
    """
    taken = {c.lower() for c in df.columns}
    step, above, size = (next(n + "_" * i for i in range(99) if n + "_" * i not in taken) for n in ("step", "above", "size"))
    place = F.coalesce(F.least(F.greatest(F.floor(F.col(score) * steps), F.lit(0)), F.lit(steps)), F.lit(-1)).cast("int")
    ranged = df.withColumn(step, place)
    counts = ranged.groupBy(*keys, step).agg(F.count("*").alias(size))
    before = Window.partitionBy(*keys).orderBy(F.desc(step)).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, step, F.coalesce(F.sum(size).over(before), F.lit(0)).alias(above))
    inner = F.row_number().over(Window.partitionBy(*keys, step).orderBy(F.desc(score), *order))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, step)]
    numbered = ranged.withColumn(size, inner).alias("l").join(counts.alias("r"), same)
    return numbered.select(*[f"l.{c}" for c in df.columns], (F.col(f"l.{size}") + F.col(f"r.{above}")).cast("int").alias(rank))


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return first_n(df, keys, order, 1)


def dedupe_chunks(df: DataFrame, order: list) -> DataFrame:
    """One row per ``chunk_id``, the first in ``order``."""
    return first_per_key(df, ["chunk_id"], order)


def dedupe_normalized(df: DataFrame, text: str, order: list) -> DataFrame:
    """One row per normalised text (lower case, white space collapsed)."""
    keyed = df.withColumn("_key", content_hash(normalized(F.col(text))))
    return first_per_key(keyed, ["_key"], order).drop("_key")


def cap_chunks(df: DataFrame, n: int, order: list, key: str = "document_id") -> DataFrame:
    return first_n(df, [key], order, n)


def count_over_cap(df: DataFrame, n: int, key: str = "document_id") -> DataFrame:
    """Rows per key that a cap of ``n`` drops; counts combine before the shuffle."""
    counts = df.groupBy(key).agg(F.count("*").alias("total"))
    return counts.select(key, "total", F.greatest(F.col("total") - n, F.lit(0)).alias("dropped"))


def flag_first(df: DataFrame, key: Column, n: int | None, among: Column | None = None) -> DataFrame:
    """Add ``_within``: the row is one of the first ``n`` by a unique key among those that pass ``among``.

    A distributed top-n finds the keys; without ``n`` all rows are within.
    """
    if n is None:
        return df.withColumn("_within", F.lit(True))
    counted = df if among is None else df.where(among)
    first = counted.select(key.alias("_k")).orderBy("_k").limit(n).withColumn("_within", F.lit(True))
    joined = df.withColumn("_key", key).join(first, F.col("_key") == F.col("_k"), "left")
    return joined.withColumn("_within", F.coalesce("_within", F.lit(False))).drop("_key", "_k")
