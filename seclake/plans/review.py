"""Issues to prompt context: link pages, query the index, fuse, pack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seclake.operators.evidence import evidence_context, issue_queries, source_catalog
from seclake.operators.issues import link_pages
from seclake.operators.retrieval import embed_chunks, fuse, in_scope, pack_context, search
from seclake.session import kept
from seclake.vocab import MAX_CHUNKS_PER_SOURCE, MAX_CONTEXT_CHARS, SCOPE_COLUMNS, TOP_K


def retrieve_for_issues(
    queries: DataFrame, index: DataFrame, scope: dict[str, str], k: int = TOP_K,
    max_chars: int = MAX_CONTEXT_CHARS, per_source: int = MAX_CHUNKS_PER_SOURCE, **options,
) -> DataFrame:
    """Packed chunks per issue.

    ``queries``: issue_key, query_no, query_text, embedding.
    """
    keyed = queries.withColumn("query_id", F.concat_ws("#", "issue_key", F.col("query_no").cast("string")))
    keys = search(keyed, index, scope, max(k, 4), texts=False, **options)
    named = keys.join(keyed.select("query_id", "issue_key", "query_no"), "query_id").drop("query_id")
    packed = pack_context(fuse(named, gathered=True), "issue_key", max_chars, per_source, length="n_chars", carried=True).drop("n_chars")
    # texts of the chosen chunks only
    return packed.join(in_scope(index, scope).select("chunk_id", "title", "text"), "chunk_id")


def issue_context(
    issues: DataFrame, issue_pages: DataFrame, index: DataFrame, scope: dict[str, str], embed: Callable, dim: int,
    pii_mode: str = "off", vocabulary: dict[str, list[str]] | None = None, **options,
) -> DataFrame:
    """From issues to packed context: queries of each issue, their vectors by ``embed``, search, fusion, packing.

    Queries and vectors are read several times and kept, so that each text is embedded once.
    """
    asked = issue_queries(issues, issue_pages, pii_mode, vocabulary)
    embedded = kept(embed_chunks(asked, embed, dim, "query_text"))
    vectors = kept(in_scope(index, scope).select("chunk_id", "embedding", *SCOPE_COLUMNS))
    chunks = index.drop("embedding")
    return retrieve_for_issues(embedded, chunks, scope, pii_mode=pii_mode, vocabulary=vocabulary, vectors=vectors, **options)


def review_inputs(
    issues: DataFrame, remote_links: DataFrame, pages: DataFrame, flows: DataFrame | None = None,
    pii_mode: str = "off",
) -> dict[str, DataFrame]:
    """Tables a review starts from: linked pages, retrieval queries, catalogue, evidence."""
    linked = link_pages(issues, remote_links, pages)
    return {
        "pages": linked,
        "queries": issue_queries(issues, linked, pii_mode),
        "catalog": source_catalog(issues, linked, flows),
        "evidence": evidence_context(issues, linked, flows, pii_mode=pii_mode),
    }
