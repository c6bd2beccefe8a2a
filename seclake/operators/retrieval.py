"""Many queries at once against a scoped chunk index.

Dense search reads an index in coarse lists (``vector_lists``): queries meet lists by
an equi join, and tasks keep only the best rows per query, so no row pairs are ever
shuffled.  Text is joined to the surviving candidates only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seclake.functions.documents import effective_priority
from seclake.functions.lexical import overlap_share, terms
from seclake.functions.redact import redact
from seclake.functions.text import computed, truncate_text
from seclake.operators.classify import query_domains
from seclake.operators.dedupe import first_n, ranked_by_score
from seclake.operators.vector_lists import CoarseLists, search_lists
from seclake.vocab import (
    CANDIDATE_MULTIPLIER,
    DEFAULT_DOMAIN_BONUS,
    DOMAIN_BONUS,
    MAX_CHUNKS_PER_SOURCE,
    MAX_CONTEXT_CHARS,
    RERANK_WEIGHTS,
    SCOPE_COLUMNS,
    TOP_K,
)


# -- index vectors ------------------------------------------------------------------


def in_scope(index: DataFrame, scope: dict[str, str]) -> DataFrame:
    """Keep one scope; all three values are needed and reach the scan as filters."""
    missing = [name for name in SCOPE_COLUMNS if not scope.get(name)]
    if missing:
        raise ValueError(f"scope is incomplete: {missing}")
    for name in SCOPE_COLUMNS:
        index = index.where(F.col(name) == scope[name])
    return index


def attach_vectors(chunks: DataFrame, vectors: DataFrame, dim: int, key: str = "chunk_id", strict: bool = True) -> DataFrame:
    """Join precomputed vectors; a missing or wrongly sized vector fails the job.

    Without ``strict`` such chunks stay, have no vector, and ``vector_problem``
    says why ("missing", "dimension").
    """
    joined = chunks.join(vectors.select(key, "embedding"), key, "left")
    if not strict:
        problem = F.when(F.col("embedding").isNull(), "missing").when(F.size("embedding") != dim, "dimension")
        return joined.withColumn("vector_problem", problem).withColumn("embedding", F.when(F.col("vector_problem").isNull(), F.col("embedding")))
    return joined.withColumn(
        "embedding",
        F.when(F.col("embedding").isNull(), F.raise_error(F.concat(F.lit("no vector for chunk "), F.col(key))))
        .when(
            F.size("embedding") != dim,
            F.raise_error(F.concat(F.lit("wrong vector size for chunk "), F.col(key))),
        )
        .otherwise(F.col("embedding")),
    )


def vector_problems(chunks: DataFrame, vectors: DataFrame, dim: int, key: str = "chunk_id") -> DataFrame:
    """Chunks without a vector and vectors of the wrong size, as rows."""
    absent = chunks.join(vectors, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    wrong = vectors.where(F.size("embedding") != dim).select(key, F.lit("dimension").alias("problem"))
    return absent.unionByName(wrong)


def embed_chunks(
    chunks: DataFrame, embed: Callable[[pd.Series], pd.Series], dim: int, text: str = "text"
) -> DataFrame:
    """Add ``embedding`` by calling ``embed`` on Arrow batches of texts.

    The batch size is ``spark.sql.execution.arrow.maxRecordsPerBatch``; failed
    tasks are retried by Spark.
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = embed(batch)
            if len(out) != len(batch):
                raise ValueError(f"embedding count mismatch: expected {len(batch)}, got {len(out)}")
            if any(len(vector) != dim for vector in out):
                raise ValueError(f"embedding dimension mismatch: expected {dim}")
            yield out

    return chunks.withColumn("embedding", run(F.col(text)))


# -- dense top-k ----------------------------------------------------------------------


def dense_topk(
    queries: DataFrame,
    index: DataFrame,
    scope: dict[str, str],
    k: int = TOP_K,
    multiplier: int = CANDIDATE_MULTIPLIER,
    lists: CoarseLists | None = None,
    probes: int | None = None,
) -> DataFrame:
    """Cosine top ``k * multiplier`` chunks per query, exact unless ``probes`` bounds the lists read.

    ``queries``: query_id, embedding.  ``index``: chunk_id, embedding and the
    scope columns.  Result: query_id, chunk_id, dense_score, dense_rank.  Without
    ``lists`` the scope is built into lists first, which reads its vectors.
    """
    rows = in_scope(index, scope)
    return search_lists(queries, rows, lists or CoarseLists.build(rows), k * multiplier, probes)


# -- rerank -----------------------------------------------------------------------------


def lexical_score(query: Column, document: Column) -> Column:
    return overlap_share(terms(query), terms(document))


def domain_bonus(wanted: Column, primary: Column, others: Column, kind: Column) -> Column:
    none = F.array().cast("array<string>")
    own = F.array_union(
        F.when(primary.isNotNull(), F.array(primary)).otherwise(none), F.coalesce(others, none)
    )
    value = F.lit(DEFAULT_DOMAIN_BONUS)
    for name, bonus in DOMAIN_BONUS.items():
        value = F.when(kind == name, F.lit(bonus)).otherwise(value)
    return F.when(F.arrays_overlap(wanted, own), value).otherwise(F.lit(0.0))


_ASKED_AT_ONCE = 1000  # queries that a chunk's terms are compared with in one row


def rerank(
    candidates: DataFrame,
    queries: DataFrame,
    chunks: DataFrame,
    weights: dict[str, float] = RERANK_WEIGHTS,
    k: int = TOP_K,
    vocabulary: dict | None = None,
    facet_domains: dict[str, str] | None = None,
    texts: bool = True,
) -> DataFrame:
    """Weighted mean of dense, lexical and source score plus a domain bonus, top ``k``.

    ``queries`` carries query_id and query_text, ``chunks`` the chunk columns.
    Equal scores are ordered by chunk_id.  The terms of a chunk are taken once,
    however many queries found it.  Without ``texts`` the result has ``n_chars``, the
    length of the text, instead of title, text and query_terms.
    """
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("at least one rerank weight must be above zero")
    options = {"vocabulary": vocabulary} if vocabulary else {}
    wanted = queries.select(
        "query_id",
        terms(F.col("query_text")).alias("query_terms"),
        query_domains(F.col("query_text"), facet_domains=facet_domains, **options).alias("_wanted"),
    )
    known = set(chunks.columns)
    null = F.lit(None)

    def column(name: str, kind: str) -> Column:
        return F.col(name) if name in known else null.cast(kind)

    side = chunks.select(
        "chunk_id", "source", "title", "text",
        column("source_type", "string").alias("source_type"),
        column("source_priority", "double").alias("_configured"),
        column("is_template", "boolean").alias("is_template"),
        column("security_domain", "string").alias("_primary"),
        column("security_domains", "array<string>").alias("_domains"),
    )
    # the queries that found a chunk, in blocks, so that a chunk that many found is no large row
    place = F.row_number().over(Window.partitionBy("chunk_id").orderBy("query_id")) - 1
    asked = candidates.select("chunk_id", F.struct("query_id", "dense_score").alias("_asked"), F.floor(place / _ASKED_AT_ONCE).alias("_block"))
    blocks = asked.groupBy("chunk_id", "_block").agg(F.collect_list("_asked").alias("_asked"))
    shown = ["title", "text"] if texts else ["n_chars"]
    side = blocks.join(side, "chunk_id").withColumns({"_terms": terms(F.concat_ws(" ", "title", "text")), "n_chars": F.length("text")})
    side = side.drop("_block", *({"title", "text", "n_chars"} - set(shown))).withColumn("_one", F.explode(computed("_asked")))
    template = F.coalesce(F.col("is_template"), F.lit(False)) | F.contains(F.col("source"), F.lit(".template."))
    joined = side.select("*", "_one.*").join(wanted, "query_id")
    scored = joined.select(
        "query_id", "chunk_id", "source", *shown, "source_type", *(["query_terms"] if texts else []),
        F.greatest(F.least("dense_score", F.lit(1.0)), F.lit(0.0)).alias("dense_score"),
        overlap_share(F.col("query_terms"), F.col("_terms")).alias("lexical_score"),
        effective_priority(F.col("_configured"), F.col("source_type"), template).alias("source_priority"),
        domain_bonus(
            F.col("_wanted"), F.col("_primary"), F.col("_domains"), F.coalesce("source_type", F.lit(""))
        ).alias("domain_score"),
    )
    mean = (
        weights["dense"] * F.col("dense_score")
        + weights["lexical"] * F.col("lexical_score")
        + weights["source"] * F.col("source_priority")
    ) / total
    final = scored.withColumn("score", F.least(mean + F.col("domain_score"), F.lit(1.0)))
    return first_n(final, ["query_id"], [F.desc("score"), "chunk_id"], k, rank="rank")


def search(
    queries: DataFrame,
    index: DataFrame,
    scope: dict[str, str],
    k: int = TOP_K,
    multiplier: int = CANDIDATE_MULTIPLIER,
    weights: dict[str, float] = RERANK_WEIGHTS,
    pii_mode: str = "off",
    lists: CoarseLists | None = None,
    vectors: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Hybrid search.  ``queries``: query_id, query_text, embedding.

    ``vectors`` has chunk_id, embedding and the scope of the chunks, where ``index`` has no vectors.
    """
    safe = queries.withColumn("query_text", redact(F.col("query_text"), pii_mode))
    candidates = dense_topk(safe, index if vectors is None else vectors, scope, k, multiplier, lists)
    return rerank(candidates, safe, in_scope(index, scope), weights, k, **options)


# -- fusion and context budgets -----------------------------------------------------------


def fuse(
    results: DataFrame, group: str = "issue_key", query_order: str = "query_no", limit: int | None = None, gathered: bool = False
) -> DataFrame:
    """Best score of each chunk over the queries of a group, ranked; with ``limit`` the best that many.

    On equal scores the earlier query's row stays.  Aggregation combines before
    the shuffle, so a chunk found by many queries costs one row per task.  Without
    a limit no task holds a whole group, for which ``results`` are read twice; ``gathered``
    numbers groups that are gathered later anyway in one window.  Texts are better joined
    to the ranks afterwards than carried along.
    """
    payload = [c for c in results.columns if c not in (group, "chunk_id")]
    best = results.groupBy(group, "chunk_id").agg(
        F.max_by(F.struct(*payload), F.struct(F.col("score"), -F.col(query_order))).alias("_b")
    )
    flat = best.select(group, "chunk_id", *[F.col(f"_b.{c}").alias(c) for c in payload if c != "rank"])
    if limit is None and not gathered:
        return ranked_by_score(flat, [group], "score", [query_order, "chunk_id"])
    return first_n(flat, [group], [F.desc("score"), query_order, "chunk_id"], limit, rank="rank")


_LEAST_ITEM = 40  # the keys of an item alone take more characters


def _ordered_items(df: DataFrame, group: str, rank: str, max_chars: int) -> DataFrame:
    """Items that a budget can reach, in order; the fold stops at the first that does not fit."""
    df = first_n(df, [group], [rank], max_chars // _LEAST_ITEM + 1)
    df = df.withColumn("text", F.substring("text", 1, max(max_chars, 1200) + 1))
    items = [c for c in df.columns if c not in (group, rank)]
    packed = df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(rank, *items))).alias("_items"))
    return packed


def pack_context(
    ranked: DataFrame,
    group: str = "issue_key",
    max_chars: int = MAX_CONTEXT_CHARS,
    per_source: int = MAX_CHUNKS_PER_SOURCE,
    rank: str = "rank",
    source: str = "source",
    text: str | None = "text",
    length: str | None = None,
    carried: bool = False,
) -> DataFrame:
    """Take chunks in rank order while they fit the budget and the source quota.

    A chunk that does not fit is skipped and later ones may still be taken.  Once
    one is skipped, so are all later ones of its source and length; the first
    ``per_source`` of each source and length are therefore enough to decide, and
    only their lengths are gathered.  Texts are joined to the chosen ranks.  Ranked
    rows without texts give their ``length`` instead.  ``carried`` gathers all columns, for
    short rows with a rank each, so that ``ranked`` is read once and not joined again.
    """
    n = F.col(length) if length else F.length(text)
    rows = [F.struct(*[c for c in ranked.columns if c not in (group, rank)]).alias("_row")] if carried else []
    slim = ranked.select(group, rank, F.col(source).alias("_source"), n.alias("_n"), *rows).where(F.col("_n") <= max_chars)
    slim = first_n(slim, [group, "_source", "_n"], [rank], per_source)
    items = F.collect_list(F.struct(rank, "_source", "_n", *(["_row"] if carried else [])))
    packed = slim.groupBy(group).agg(F.sort_array(items).alias("_items"))
    place = ranked.schema[rank].dataType.simpleString()
    start = F.struct(
        F.lit(0).alias("used"), F.array().cast(f"array<struct<at:{place},source:string>>").alias("taken")
    )

    def step(acc: Column, x: Column) -> Column:
        quota = F.size(F.filter(acc["taken"], lambda t: t["source"].eqNullSafe(x["_source"]))) < per_source
        fits = quota & (acc["used"] + x["_n"] <= max_chars)
        taken = F.concat(acc["taken"], F.array(F.struct(x[rank].alias("at"), x["_source"].alias("source"))))
        return F.struct(
            F.when(fits, acc["used"] + x["_n"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, taken).otherwise(acc["taken"]).alias("taken"),
        )

    chosen = F.aggregate("_items", start, step, lambda acc: acc["taken"])
    if carried:
        kept = F.filter("_items", lambda x: F.array_contains(F.col("_at"), x[rank]))
        whole = packed.where(F.col(group).isNotNull()).withColumn("_at", F.transform(chosen, lambda t: t["at"])).select(group, F.explode(computed(kept)).alias("_item"))
        return whole.select(group, F.col(f"_item.{rank}").alias(rank), "_item._row.*").select(*[group, rank], *[c for c in ranked.columns if c not in (group, rank)])
    picked = packed.select(group, F.explode(F.transform(chosen, lambda t: t["at"])).alias(rank))
    return ranked.join(picked, [group, rank])


def _budget(
    packed: DataFrame, group: str, render: Callable[[Column, Column], Column], max_chars: int
) -> DataFrame:
    """Greedy fold: cut texts to what is left, stop at the first item that does not fit."""

    def encoded(x: Column, chars: Column) -> Column:
        return F.to_json(render(x, chars), {"ignoreNullFields": "false"})

    start = F.struct(
        F.lit(max_chars).alias("left"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("out")
    )

    def step(acc: Column, x: Column) -> Column:
        first_try = encoded(x, F.least(acc["left"], F.lit(1200)))
        retry = encoded(x, F.greatest(F.lit(200), acc["left"] - 300))
        too_long = F.length(first_try) > acc["left"]
        stop = acc["done"] | (acc["left"] <= 0) | (too_long & (F.size(acc["out"]) > 0))
        item = F.when(too_long, retry).otherwise(first_try)
        return F.when(stop, F.struct(acc["left"].alias("left"), F.lit(True).alias("done"), acc["out"].alias("out"))).otherwise(
            F.struct(
                (acc["left"] - F.length(item)).alias("left"),
                F.lit(False).alias("done"),
                F.concat(acc["out"], F.array(item)).alias("out"),
            )
        )

    folded = packed.withColumn("_out", F.aggregate("_items", start, step, lambda acc: acc["out"]))
    return folded.select(group, F.posexplode(computed("_out")).alias("item_no", "item"))


def compact_context(
    chunks: DataFrame, group: str = "issue_key", max_chars: int = 12_000, rank: str = "rank"
) -> DataFrame:
    """Compact JSON items of retrieved chunks for a prompt: group, item_no, item."""

    def render(x: Column, chars: Column) -> Column:
        return F.struct(
            x["chunk_id"].alias("id"), x["source"].alias("source"), x["title"].alias("title"),
            truncate_text(x["text"], chars).alias("text"), x["score"].alias("score"),
            x["source_type"].alias("source_type"), x["control_areas"].alias("control_areas"),
        )

    if "control_areas" not in chunks.columns:
        chunks = chunks.withColumn("control_areas", F.array().cast("array<string>"))
    return _budget(_ordered_items(chunks, group, rank, max_chars), group, render, max_chars)


def compact_flows(
    flows: DataFrame, group: str = "issue_key", max_chars: int = 8000, order: str = "seq"
) -> DataFrame:
    """Compact JSON items of rendered flows (``text`` holds the rendering)."""

    def render(x: Column, chars: Column) -> Column:
        return F.struct(
            x["id"].alias("id"), x["method"].alias("method"), x["url"].alias("url"),
            x["status_code"].alias("status_code"), truncate_text(x["text"], chars).alias("text"),
        )

    return _budget(_ordered_items(flows, group, order, max_chars), group, render, max_chars)
