"""Registry of the queries on the supplied tables, and their projections.

The supplied tables stand in for real inputs through plain projections.  Those
are written once, as SQL expressions valid in Spark and in the checking engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seclake.sources.files import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SCOPE = {"tenant_id": "acme", "environment": "preprod", "knowledge_base_id": "kb"}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its check."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expression} AS {name}" for name, expression in columns.items()])


def select_sql(source: str, columns: dict[str, str]) -> str:
    inner = ", ".join(f"{expression} AS {name}" for name, expression in columns.items())
    return f"SELECT {inner} FROM {source}"


def with_scope(df: DataFrame) -> DataFrame:
    return df.select("*", *[F.lit(value).alias(name) for name, value in SCOPE.items()])


# -- documents as knowledge files ------------------------------------------------------------
KIND = (
    "CASE CAST(substr(source, 4) AS INT) % 6 WHEN 0 THEN 'internal' WHEN 1 THEN 'portswigger' "
    "WHEN 2 THEN 'mitre' WHEN 3 THEN 'owasp' WHEN 4 THEN 'payloads' ELSE 'local' END"
)
PRIORITY = (
    "CASE CAST(substr(source, 4) AS INT) % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.55 WHEN 2 THEN 0.65 "
    "WHEN 3 THEN 0.6 WHEN 4 THEN 0.5 ELSE 0.75 END"
)
PATH = f"concat({KIND}, '/', CAST(doc_id AS STRING), '.txt')"
DOCS = {"doc_id": "doc_id", "text": "text", "lang": "lang", "kind": KIND, "path": PATH}
DOCS_SQL = select_sql("documents", DOCS)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(table(spark, sf_dir, "documents"), DOCS)


# -- conversations as issues: turn 0 describes, later turns comment ---------------------------
def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    grouped = turns.groupBy("conv_id").agg(
        F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("description"),
        F.sort_array(F.collect_list(F.when(F.col("turn") > 0, F.struct("turn", "text")))).alias("_c"),
    )
    none = F.array().cast("array<string>")
    return grouped.select(
        F.concat(F.lit("ISS-"), F.col("conv_id").cast("string")).alias("key"),
        F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("summary"),
        "description",
        F.lit(None).cast("string").alias("acceptance_criteria"),
        F.lit("Story").alias("issue_type"), F.lit("Open").alias("status"), F.lit("P2").alias("priority"),
        none.alias("labels"), none.alias("components"),
        F.transform("_c", lambda c: c["text"]).alias("comments"),
        "conv_id",
    )


ISSUES_SQL = """
SELECT conv_id, 'ISS-' || conv_id AS key, 'Conversation ' || conv_id AS summary,
       max(CASE WHEN turn = 0 THEN text END) AS description,
       coalesce(string_agg(CASE WHEN turn > 0 THEN text END, chr(10) ORDER BY turn), '') AS comments
FROM conversations GROUP BY conv_id
"""

# -- pages as captured flows ------------------------------------------------------------------
HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
URL_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
FLOWS = {
    "capture_id": "concat('cap', CAST(page_id % 5 AS STRING))",
    "seq": "page_id",
    "id": "concat('flow', CAST(page_id AS STRING))",
    "method": "CASE WHEN page_id % 3 = 0 THEN 'POST' ELSE 'GET' END",
    "url": "url",
    "host": HOST,
    "scheme": "regexp_extract(url, '^([a-z]+):', 1)",
    "status_code": "CAST(CASE WHEN page_id % 11 = 0 THEN NULL ELSE 200 END AS INT)",
    "authorization": (
        "concat('Bearer ', CASE page_id % 4 "
        "WHEN 0 THEN 'eyJhbGciOiJub25lIn0' WHEN 1 THEN 'eyJhbGciOiJIUzI1NiJ9' "
        "WHEN 2 THEN 'eyJ0eXAiOiJKV1QifQ' ELSE 'eyJhbGciOiJOb25lIn0' END, "
        "'.eyJzdWIiOiIxMjM0NTYifQ.', 'c2lnbmF0dXJl', lpad(CAST(page_id AS STRING), 6, '0'))"
    ),
    "hsts": "CASE WHEN page_id % 7 = 0 THEN 'max-age=1' END",
    "csp": "CASE WHEN page_id % 6 = 0 THEN 'default-src self' END",
    "cookie": (
        "concat('sid', CAST(page_id % 13 AS STRING), '=x', CASE WHEN page_id % 2 = 0 THEN '; Secure' ELSE '' END, "
        "CASE WHEN page_id % 3 = 0 THEN '; HttpOnly' ELSE '' END, "
        "CASE WHEN page_id % 5 = 0 THEN '; SameSite=Lax' ELSE '' END)"
    ),
    "body_key": "CASE WHEN page_id % 9 = 0 THEN concat('AKIA', lpad(CAST(page_id % 50 AS STRING), 16, '0')) ELSE '' END",
    "html": "html",
}
FLOWS_SQL = select_sql("pages", FLOWS)


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = project(table(spark, sf_dir, "pages"), FLOWS)

    def header(name: str, column: str):
        value = F.col(column)
        return F.when(value.isNotNull(), F.struct(F.lit(name).alias("name"), value.alias("value")))

    response = F.array_compact(
        F.array(
            F.struct(F.lit("Content-Type").alias("name"), F.lit("text/html; charset=utf-8").alias("value")),
            header("Strict-Transport-Security", "hsts"),
            header("Content-Security-Policy", "csp"),
            header("Set-Cookie", "cookie"),
        )
    )
    return flat.select(
        "capture_id", "seq", "id", "method", "url", "host", "scheme", "status_code",
        F.array(header("Authorization", "authorization")).alias("request_headers"),
        F.lit(None).cast("string").alias("request_body"),
        response.alias("response_headers"),
        F.concat("html", F.lit(" "), "body_key").alias("response_body"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")).alias("ts"),
        F.lit("manual_capture").alias("source"),
    )


# -- embeddings as the index, benchmark items as queries --------------------------------------
# Documents and items without a vector stay: search skips them, ``unsearchable`` lists them.
def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    base = docs(spark, sf_dir).join(vectors, "doc_id", "left")
    return with_scope(
        base.select(
            F.col("doc_id").alias("chunk_id"), F.col("path").alias("source"),
            F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), "text",
            F.col("kind").alias("source_type"),
            F.when(F.col("doc_id") % 3 == 0, F.lit(0.9)).alias("source_priority"),
            F.lit(False).alias("is_template"),
            F.col("lang").alias("security_domain"), "label", "embedding",
        )
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "item_id")
    items = table(spark, sf_dir, "benchmark").join(vectors, "item_id", "left")
    return items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"), "label", "embedding")


INDEX_SQL = f"""
SELECT d.doc_id AS chunk_id, d.path AS source, 'Document ' || d.doc_id AS title, d.text, d.kind AS source_type,
       CASE WHEN d.doc_id % 3 = 0 THEN 0.9 ELSE {PRIORITY.replace('source', 'd.source_raw')} END AS priority,
       d.lang AS security_domain, e.label, list_transform(e.embedding, lambda x: x::DOUBLE) AS embedding
FROM (SELECT doc_id, text, lang, source AS source_raw, {KIND} AS kind, {PATH} AS path FROM documents) d
LEFT JOIN embeddings e ON e.vec_id = d.doc_id
"""
QUERIES_SQL = """
SELECT b.item_id AS query_id, b.text AS query_text, e.label,
       list_transform(e.embedding, lambda x: x::DOUBLE) AS embedding
FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id
"""
# candidates: cosine, best 24 per query, ties by id
DENSE_SQL = f"""
idx AS ({INDEX_SQL}), qs AS ({QUERIES_SQL}),
dense AS (
  SELECT query_id, chunk_id, score AS dense_score, rn AS dense_rank FROM (
    SELECT q.query_id, i.chunk_id, list_cosine_similarity(q.embedding, i.embedding) AS score,
           row_number() OVER (PARTITION BY q.query_id
                              ORDER BY list_cosine_similarity(q.embedding, i.embedding) DESC, i.chunk_id) AS rn
    FROM qs q CROSS JOIN idx i WHERE q.embedding IS NOT NULL AND i.embedding IS NOT NULL) WHERE rn <= 24)
"""
