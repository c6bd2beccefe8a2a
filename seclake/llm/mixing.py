"""Mixing sources to target weights by capped water-filling.

Each source's target is its weight's share of the wanted total, but no more than
``max_epochs`` times its own size.  Sources above their cap are clamped, and
what they can't take is dealt again to the others by weight, until no source is
above.  The targets then become copies: every document is taken the whole number
of times its source allows, and one time more if it belongs to the fraction of
the source that comes first in a seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seclake.llm.common import broadcast_if_small, checkpointed

WORD = r"[^\x20\x09-\x0D]+"
PARTS = (3, 6, 9)  # hex digits of the seeded order by which the fraction's end is narrowed down


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def water_fill(sources: DataFrame, total: float | None = None, max_epochs: float = 3.0) -> DataFrame:
    """Add ``target`` to rows ``source, source_size, weight``.

    ``total`` is by default the sum of all sizes.  Every round takes two sums
    over the sources and clamps those above their cap; only these sums reach
    the driver.  If the caps together are below the total, every source gets its
    cap.  Weights that are null or not above 0 get 0.
    """
    rows = checkpointed(
        sources.select(
            "*",
            F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(0.0).alias("_w"),
            (F.col("source_size") * max_epochs).cast("double").alias("_cap"),
        ).withColumn("_full", F.col("_w") == 0)
    )
    if total is None:
        total = rows.agg(F.sum("source_size")).first()[0] or 0
    clamped = F.when(F.col("_w") == 0, 0.0).otherwise(F.col("_cap"))
    while True:
        sums = rows.agg(
            F.sum(F.when(F.col("_full"), clamped)).alias("taken"), F.sum(F.when(~F.col("_full"), F.col("_w"))).alias("open")
        ).first()
        if sums["open"] is None:
            break
        level = (float(total) - (sums["taken"] or 0.0), sums["open"])
        share = F.lit(level[0]) * F.col("_w") / F.lit(level[1])
        above = ~F.col("_full") & (share > F.col("_cap"))
        if not rows.where(above).limit(1).count():
            return rows.select(*sources.columns, F.when(F.col("_full"), clamped).otherwise(share).alias("target"))
        rows = checkpointed(rows.withColumn("_full", F.col("_full") | above))
    return rows.select(*sources.columns, clamped.alias("target"))


def seeded_order(seed: int) -> Column:
    """Hex string in which the documents of a source come; the same for every run."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15)


def _last_within(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``source, last_order``: the end of the fraction each source takes once more.

    The order's first digits part each source into ranges whose words are added
    up; only the range in which the fraction ends is parted further, so no task
    ever sorts a whole source.
    """
    open_ = checkpointed(plan.where("fraction > 0").select("source", F.col("fraction").alias("left"), F.lit("").alias("prefix")))
    last = None
    for digits in (*PARTS, 15):
        near = broadcast_if_small(open_)
        inside = sized.join(near, sized["source"].eqNullSafe(near["source"]) & F.startswith(sized["_order"], near["prefix"])).select(
            sized["source"], F.substring(sized["_order"], 1, digits).alias("part"), "size", "left"
        )
        sums = inside.groupBy("source", "part").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
        running = Window.partitionBy("source").orderBy("part")
        upto = sums.withColumn("upto", F.sum("words").over(running)).withColumn("before", F.col("upto") - F.col("words"))
        if digits < 15:
            crossing = upto.where("before <= left and upto > left")
            open_ = checkpointed(crossing.select("source", (F.col("left") - F.col("before")).alias("left"), F.col("part").alias("prefix")))
        else:  # the last document is taken if that comes nearer to the target
            last = upto.where("(before + upto) / 2 <= left").groupBy("source").agg(F.max("part").alias("last_order"))
            last = open_.select("source", "prefix").join(last, open_["source"].eqNullSafe(last["source"]), "left").select(
                open_["source"], F.coalesce("last_order", "prefix").alias("last_order")
            )
    return last


def mix(docs: DataFrame, weights: DataFrame, total: float | None = None, max_epochs: float = 3.0, seed: int = 17) -> DataFrame:
    """Columns of ``docs`` and ``size, source_size, target, copies, taken`` for every document.

    ``weights`` has one row ``source, weight`` per source; sources without one
    get weight 0.  Null is a source of its own.  Texts that are null or empty
    have size 0.  Rows with one doc_id share their place in the order, so all of
    them or none get the further copy.  No rows: no rows.  Columns named like the
    results or beginning with ``_`` are replaced.
    """
    sized = docs.withColumns({"size": word_count(F.col("text")), "_order": seeded_order(seed)})
    slim = checkpointed(sized.select("source", "size", "_order"))
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = sizes.join(weights.select(F.col("source").alias("_s"), "weight"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    targets = water_fill(weighed, total, max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = checkpointed(
        targets.withColumn("whole", F.floor(ratio + 1e-12).cast("bigint")).withColumn(
            "fraction", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))
        )
    )
    ends = _last_within(slim, plan)
    plan = checkpointed(
        plan.join(ends.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
        .select(F.col("source").alias("_s"), "source_size", "target", "whole", "last_order")
    )
    kept = [c for c in sized.columns if c not in ("source_size", "target", "copies", "taken")]
    more = F.coalesce((F.col("_order") <= F.col("last_order")).cast("bigint"), F.lit(0))
    copies = F.least(F.col("whole") + more, F.lit(int(max_epochs)).cast("bigint"))
    return (
        sized.select(*kept)
        .join(broadcast_if_small(plan), F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("copies", copies)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("_s", "_order", "whole", "last_order")
    )


def repeat(mixed: DataFrame) -> DataFrame:
    """One row for every copy that the mix takes."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
