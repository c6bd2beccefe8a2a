"""Continuous forms of the traffic rules, index updates and audit log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seclake.functions import ids
from seclake.operators.dedupe import first_per_key
from seclake.operators.chunking import chunk_rows, split_documents
from seclake.operators.traffic import as_findings, candidates
from seclake.plans.index import write_change
from seclake.sources.sinks import redact_audit


def stream_findings(flows: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Findings of a live flow stream, one per capture, rule and key.

    The first row to arrive wins and flows later than ``delay`` may be dropped;
    the batch cap of 20 findings per rule does not apply to a stream.
    """
    once = candidates(flows).withWatermark("ts", delay).dropDuplicatesWithinWatermark(
        ["capture_id", "rule_id", "seen_key"]
    )
    return as_findings(once, "capture_id", "ts")


def start_findings(flows: DataFrame, path: str, checkpoint: str, delay: str = "10 minutes") -> StreamingQuery:
    return (
        stream_findings(flows, delay).writeStream.format("json").option("path", path)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )


def index_batch(
    scope: dict[str, str], path: str, source_name: str = "local", index_root: str = "",
    embed: Callable[[DataFrame], DataFrame] | None = None, latest_by: str | None = None, writer: str | None = None, **options,
) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: changed documents replace their chunks in the index log.

    A change is named after its stream (``writer``, by default the id Spark keeps
    in the checkpoint) and batch, so a repeated batch overwrites itself and other
    streams get numbers of their own.  Of several versions of a document in a
    batch the last by ``latest_by`` counts, without it the last by text.
    """

    def apply(docs: DataFrame, batch: int) -> None:
        stream = writer or docs.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        newest = [F.desc_nulls_last(latest_by)] if latest_by else []
        docs = first_per_key(docs, ["path"], [*newest, F.desc_nulls_last("text")])
        split = split_documents(docs, **options)
        chunks = chunk_rows(split, scope=scope, source_name=source_name, index_root=index_root)
        if embed is not None:
            chunks = embed(chunks)
        changed = docs.select(
            ids.document_id(F.col("path"), source_name=F.lit(source_name), scope=scope).alias("document_id")
        )
        write_change(chunks, changed, scope, path, change=f"{stream}/{batch}")

    return apply


def start_indexing(docs: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return (
        docs.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def start_audit(events: DataFrame, path: str, checkpoint: str, pii_mode: str = "off") -> StreamingQuery:
    return (
        redact_audit(events, pii_mode).writeStream.format("json").option("path", path)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )


def audit_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes", kind: str = "event") -> DataFrame:
    """Events per tumbling window and type; works on a batch table as well."""
    windowed = events.withWatermark("ts", delay) if events.isStreaming else events
    counts = windowed.groupBy(F.window("ts", width), kind).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), kind, "n")
