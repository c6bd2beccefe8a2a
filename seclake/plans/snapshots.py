"""Incremental indexing by comparing a listing with the last one.

A manifest holds path, size and content hash of every document of a run.  The next
run joins its own listing with it: added and changed documents are chunked, and
changed, emptied and removed ones get deletion marks.  Unchanged documents are read
for their hash only.  A run's change in the index log is named after the manifest's
version, and the manifest is written after the change: a run that died in between is
repeated under its name and overwrites itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from seclake.functions import ids
from seclake.operators.chunking import chunk_rows, split_documents
from seclake.operators.dedupe import first_per_key
from seclake.plans.index import write_change

STATES = ["added", "changed", "emptied", "removed", "unchanged"]


def manifest_of(docs: DataFrame) -> DataFrame:
    """``path, size, content_hash`` of documents (path, text); of several rows of a path the last by text counts."""
    once = first_per_key(docs.select("path", F.coalesce("text", F.lit("")).alias("text")), ["path"], [F.desc("text")])
    return once.select("path", F.octet_length("text").cast("bigint").alias("size"), F.sha2("text", 256).alias("content_hash"))


def snapshot_difference(before: DataFrame, now: DataFrame) -> DataFrame:
    """``path, state`` of all documents of two manifests.

    A document that was empty before and still is counts as unchanged; one that is
    new and empty as added.
    """
    old = before.select("path", F.col("size").alias("old_size"), F.col("content_hash").alias("old_hash"))
    new = now.select("path", F.col("size").alias("new_size"), F.col("content_hash").alias("new_hash"))
    state = (
        F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed")
        .when(F.col("old_hash") == F.col("new_hash"), "unchanged").when(F.col("new_size") == 0, "emptied").otherwise("changed")
    )
    return old.join(new, "path", "full").select("path", state.alias("state"))


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", path).parquet(f"{path}/version=*")
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in str(problem):
            return None
        raise


@dataclass
class Run:
    """What a run did: its version and the number of documents in every state."""

    version: int
    states: dict[str, int]


def index_snapshot(
    docs: DataFrame, index_path: str, manifest_path: str, scope: dict[str, str], source_name: str = "local", index_root: str = "", **options
) -> Run:
    """Bring the index log to the state of ``docs`` (path, text), writing what differs from the last run only.

    A listing without any document is refused if the last one had some, as a sync
    of nothing would delete everything.
    """
    spark = docs.sparkSession
    last = _versions(spark, manifest_path)
    version = 0
    now = manifest_of(docs)
    if last is None:
        states = now.select("path", F.lit("added").alias("state"))
    else:
        version = last.agg(F.max("version")).first()[0] + 1
        states = snapshot_difference(last.where(F.col("version") == version - 1), now)
    # the decision is written first: what it says is what the change does, whatever is read again
    decided_path = f"{manifest_path}/decided-{version}"
    states.join(now, "path", "left").write.mode("overwrite").parquet(decided_path)
    decided = spark.read.parquet(decided_path)
    counts = {r["state"]: r["n"] for r in decided.groupBy("state").agg(F.count("*").alias("n")).collect()}
    found = {state: counts.get(state, 0) for state in STATES}
    if found["removed"] and not any(found[s] for s in STATES if s != "removed"):
        raise ValueError("the listing is empty: refused, as it would remove every document")
    if version and not any(found[s] for s in ("added", "changed", "emptied", "removed")):
        return Run(version - 1, found)
    open_ = decided.where(F.col("state").isin("added", "changed")).select("path", "content_hash")
    texts = docs.withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256)).join(open_, ["path", "content_hash"], "left_semi").drop("content_hash")
    split = split_documents(first_per_key(texts, ["path"], [F.desc_nulls_last("text")]), **options)
    chunks = chunk_rows(split, scope=scope, source_name=source_name, index_root=index_root)
    marked = decided.where("state <> 'unchanged'").select(ids.document_id(F.col("path"), source_name=F.lit(source_name), scope=scope).alias("document_id"))
    write_change(chunks, marked, scope, index_path, change=f"snapshot {version}")
    decided.where("state <> 'removed'").select("path", "size", "content_hash").write.mode("overwrite").parquet(f"{manifest_path}/version={version}")
    return Run(version, found)
