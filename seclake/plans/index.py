"""Building and maintaining a scoped chunk index.

``upsert_chunks``, ``replace_documents`` and ``sync_root`` are pure: index in,
index out.  On disk the index is a log of numbered writes: a change appends its
new chunks and one deletion mark per replaced document, so its cost follows the
change and not the index.  ``read_index`` shows the last state of every
document; ``compact_index`` rewrites the log now and then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from seclake.operators.dedupe import first_per_key
from seclake.vocab import EMBEDDING_BATCH, SCOPE_COLUMNS, SOURCE_PRIORITY, UPSERT_BATCH

Scope = dict[str, str]


def set_scope(chunks: DataFrame, scope: Scope) -> DataFrame:
    """Scope columns are set last, so a chunk cannot bring its own."""
    for name in SCOPE_COLUMNS:
        chunks = chunks.withColumn(name, F.lit(scope[name]))
    return chunks


def _inside(scope: Scope, source_name: str | None = None, source_type: str | None = None) -> Column:
    test = F.lit(True)
    for name in SCOPE_COLUMNS:
        test = test & (F.col(name) == scope[name])
    if source_name:
        test = test & (F.col("source_name") == source_name)
    if source_type:
        test = test & (F.col("source_type") == source_type)
    return F.coalesce(test, F.lit(False))


def upsert_chunks(index: DataFrame, new: DataFrame, scope: Scope) -> DataFrame:
    """New rows replace rows of the same chunk_id; of several new ones the first by content stays."""
    scoped = set_scope(first_per_key(new, ["chunk_id"], [F.to_json(F.struct("*"))]), scope)
    kept = index.join(scoped.select("chunk_id"), "chunk_id", "left_anti")
    return kept.unionByName(scoped, allowMissingColumns=True)


def delete_documents(
    index: DataFrame, document_ids: DataFrame, scope: Scope,
    source_name: str | None = None, source_type: str | None = None,
) -> DataFrame:
    """Drop the chunks of the given documents, inside the scope only."""
    ids = document_ids.select("document_id").distinct()
    inside = _inside(scope, source_name, source_type)
    gone = index.where(inside).join(ids, "document_id", "left_anti")
    return index.where(~inside).unionByName(gone)


def replace_documents(
    index: DataFrame, new: DataFrame, scope: Scope, document_ids: DataFrame | None = None,
    source_name: str | None = None, source_type: str | None = None,
) -> DataFrame:
    """Delete all chunks of the incoming documents, then upsert.

    ``document_ids`` names the documents that were read, also those that gave
    no chunk; without it the ids of the new chunks are used.
    """
    ids = document_ids if document_ids is not None else new.select("document_id")
    return upsert_chunks(delete_documents(index, ids, scope, source_name, source_type), new, scope)


def sync_root(
    index: DataFrame, new: DataFrame, scope: Scope, index_root: str, accepted_files: int,
    source_name: str | None = None, source_type: str | None = None,
) -> DataFrame:
    """Replace everything below an index root; refused when no file was accepted."""
    if accepted_files == 0:
        return upsert_chunks(index, new, scope)
    stale = _inside(scope, source_name, source_type) & (F.col("index_root") == index_root)
    return upsert_chunks(index.where(~F.coalesce(stale, F.lit(False))), new, scope)


# -- the log on disk ----------------------------------------------------------------------


def _log(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", path).parquet(f"{path}/seq=*")
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in str(problem):
            return None
        raise


def _numbers(spark: SparkSession, path: str) -> dict[int, str]:
    """Numbers of the log and the change each holds; one row per change comes to the driver."""
    log = _log(spark, path)
    if log is None:
        return {}
    return {r["seq"]: r["change"] for r in log.groupBy("seq").agg(F.max("change").alias("change")).collect()}


def write_change(
    chunks: DataFrame, document_ids: DataFrame, scope: Scope, path: str, seq: int | None = None, change: str | None = None,
    version: str | None = None, failed: int = 0,
) -> int:
    """Append one change and return its number.

    What it upserts and replaces is counted while it is written and kept beside it
    with ``version`` and the number of ``failed`` chunks, see ``change_counts``.

    ``change`` names the change: written again it overwrites itself, so retries
    are safe.  Without ``seq`` it gets the number it had, or the next free one; a
    number that holds another change is refused.  Rows and deletion marks are
    committed together, sorted by document.
    """
    if change is None and seq is None:
        raise ValueError("a change needs a name or a number")
    change = f"number {seq}" if change is None else change
    taken = _numbers(chunks.sparkSession, path)
    if seq is None:
        own = [number for number, name in taken.items() if name == change]
        seq = own[0] if own else max(taken, default=-1) + 1
    elif taken.get(seq, change) != change:
        raise ValueError(f"number {seq} holds the change {taken[seq]!r}")
    out = set_scope(chunks, scope).withColumn("deleted", F.lit(False))
    # one mark without a document, so that an empty change has its number, too
    own = chunks.sparkSession.range(1).select(F.lit(None).cast("string").alias("document_id"))
    marks = set_scope(document_ids.select("document_id").distinct().union(own), scope).withColumn("deleted", F.lit(True))
    out = out.unionByName(marks, allowMissingColumns=True).withColumn("change", F.lit(change))
    seen = Observation(f"change {seq}")
    marked = F.col("deleted") & F.col("document_id").isNotNull()
    out = out.observe(seen, F.count_if(~F.col("deleted")).alias("upserted"), F.count_if(marked).alias("replaced"))
    _write(out, f"{path}/seq={seq}")
    row = (change, version, seen.get["upserted"], seen.get["replaced"], failed)
    chunks.sparkSession.createDataFrame([row], _COUNTS).coalesce(1).write.mode("overwrite").parquet(f"{path}/_changes/seq={seq}")
    return seq


_COUNTS = "change string, version string, chunks_upserted long, documents_replaced long, chunks_failed long"


def change_counts(spark: SparkSession, path: str) -> DataFrame:
    """``seq`` and the counts of every change of a log; no chunk is read."""
    try:
        return spark.read.option("basePath", f"{path}/_changes").parquet(f"{path}/_changes/seq=*")
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in str(problem):
            return spark.createDataFrame([], _COUNTS + ", seq int")
        raise


def _write(rows: DataFrame, path: str) -> None:
    # one scope per change: its column statistics let a scan skip whole files
    ordered = rows.repartition("document_id").sortWithinPartitions("deleted", *SCOPE_COLUMNS, "document_id")
    ordered.write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str, scope: Scope | None = None) -> DataFrame | None:
    """Live chunks: rows no later change has marked as replaced.

    Only the marks are aggregated; as long as they are few (compact now and
    then) Spark broadcasts them and the chunks are not shuffled.
    """
    log = _log(spark, path)
    if log is None:
        return None
    if scope is not None:
        log = log.where(_inside(scope))
    key = [*SCOPE_COLUMNS, "document_id"]
    last = log.where(F.col("deleted")).groupBy(*key).agg(F.max("seq").alias("_last"))
    live = log.where(~F.col("deleted")).join(last, key, "left").where("_last is null or seq >= _last")
    return live.drop("deleted", "change", "seq", "_last")


def sync_change(
    spark: SparkSession, chunks: DataFrame, document_ids: DataFrame, scope: Scope, path: str, seq: int | None,
    index_root: str, accepted_files: int, source_name: str | None = None, source_type: str | None = None, change: str | None = None,
) -> bool:
    """Write a change that also removes documents no longer below the root."""
    ids = document_ids.select("document_id")
    live = read_index(spark, path)
    synced = accepted_files > 0
    if synced and live is not None:
        stale = live.where(_inside(scope, source_name, source_type) & (F.col("index_root") == index_root))
        ids = ids.union(stale.select("document_id"))
    write_change(chunks, ids, scope, path, seq, change)
    return synced


def compact_index(spark: SparkSession, path: str, target: str) -> None:
    """Write the live state as one change of a new log."""
    live = read_index(spark, path)
    if live is not None:
        _write(live.withColumns({"deleted": F.lit(False), "change": F.lit("compacted")}), f"{target}/seq=0")


# -- reports ------------------------------------------------------------------------------


def nested_batches(n: Column, outer: int, inner: int) -> Column:
    """Inner batches when every outer batch is cut on its own."""
    per_full = -(-outer // inner)
    rest = n % outer
    return F.floor(n / outer) * per_full + F.ceil(rest / inner)


def index_report(
    split: DataFrame, dispositions: DataFrame, dry_run: bool = False,
    embedding_batch: int = EMBEDDING_BATCH, upsert_batch: int = UPSERT_BATCH,
    changes: DataFrame | None = None, version: str | None = None, domain: Column | None = None,
) -> DataFrame:
    """One row of counters and distributions.

    ``split``: the per-document output of ``split_documents``;
    ``dispositions``: path, disposition; ``changes``: rows of ``change_counts``,
    whose counts are added up (a dry run has none); ``domain``: the security domain
    of a row of ``split``.
    """
    from seclake.functions.documents import source_type

    made = F.size("chunks")
    per_document = split.select(
        made.alias("n"), source_type(F.col("path")).alias("kind"), (domain if domain is not None else F.lit(None).cast("string")).alias("domain"),
        "duplicate_chunks", "truncated_chunks",
    )
    # both inputs feed one aggregate, so no two one-row results have to be joined; it keeps a row per kind, domain and disposition
    rows = per_document.unionByName(dispositions.select("disposition"), allowMissingColumns=True)
    if changes is not None:
        rows = rows.unionByName(changes.select("chunks_upserted", "documents_replaced", "chunks_failed"), allowMissingColumns=True)
    sums = ["n", "duplicate_chunks", "truncated_chunks", *(["chunks_upserted", "documents_replaced", "chunks_failed"] if changes is not None else [])]
    small = rows.groupBy("kind", "domain", "disposition").agg(F.count("disposition").alias("files"), *[F.sum(c).alias(c) for c in sums])
    state = F.col("disposition")

    def files(*states: str) -> Column:
        return F.coalesce(F.sum(F.when(state.isin(*states), F.col("files"))), F.lit(0))

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)) if name in small.columns else F.lit(0).cast("bigint")

    def shares(name: str) -> Column:
        pairs = F.collect_list(F.when(F.col(name).isNotNull() & (F.col("n") > 0), F.struct(F.col(name).alias("key"), F.col("n").alias("value"))))
        keys = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["key"])))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.aggregate(F.filter(pairs, lambda p: p["key"] == k), F.lit(0).cast("bigint"), lambda a, p: a + p["value"])))

    joined = small.agg(
        F.coalesce(F.sum("files"), F.lit(0)).alias("files_scanned"),
        files("accepted").alias("files_accepted"),
        files("unsupported", "oversized").alias("files_skipped"),
        files("not_utf8").alias("files_failed"),
        files("over_limit").alias("files_over_limit"),
        total("n").alias("chunks_created"),
        total("chunks_upserted").alias("chunks_upserted"),
        total("chunks_failed").alias("chunks_failed"),
        total("documents_replaced").alias("documents_replaced"),
        total("duplicate_chunks").alias("duplicate_chunks"),
        total("truncated_chunks").alias("chunks_truncated"),
        shares("kind").alias("source_type_distribution"),
        shares("domain").alias("security_domain_distribution"),
    )
    n = F.col("chunks_created")
    warnings = F.array_compact(
        F.array(
            F.when(F.col("chunks_truncated") > 0, F.lit("chunk limit reached; some chunks were skipped")),
            F.when(F.col("files_failed") > 0, F.lit("some files were not UTF-8 and were skipped")),
            F.when(F.col("files_over_limit") > 0, F.lit("file limit reached; later files were skipped")),
            F.when(F.col("files_accepted") == 0, F.lit("no file was accepted; a sync would delete nothing")),
            F.when(F.col("chunks_failed") > 0, F.lit("some chunks could not be embedded")),
        )
    )
    return joined.select(
        "*",
        F.ceil(n / embedding_batch).alias("embedding_batches"),
        nested_batches(n, embedding_batch, upsert_batch).alias("upsert_batches"),
        F.lit(dry_run).alias("dry_run"), F.lit(version).alias("version"),
        warnings.alias("warnings"),
    )
