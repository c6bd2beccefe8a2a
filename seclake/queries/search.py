"""Classification, retrieval and retrieval quality on the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seclake.operators import classify, evaluation, retrieval
from seclake.operators.vector_lists import CoarseLists
from seclake.queries import base
from seclake.queries.base import (
    DENSE_SQL,
    DOCS_SQL,
    INDEX_SQL,
    QUERIES_SQL,
    SCOPE,
    docs,
    project,
    query,
    select_sql,
    table,
)
from seclake.vocab import EXTERNAL_METHODOLOGY

# vocabularies of frequent corpus words; the real ones hardly occur in this corpus
VOCABULARY = {
    "en": ["the", "with", "and the", "token"],
    "fr": ["le", "avec", "dans", "de la"],
    "de": ["der", "und", "nicht", "auf"],
    "es": ["para", "los", "por", "una"],
}
_TOKENS = "regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}_]+')"


def _hit_sql(term: str, tokens: str, text: str) -> str:
    if " " in term:
        return f"regexp_matches(lower({text}), '(^|[^\\p{{L}}\\p{{N}}_]){term}([^\\p{{L}}\\p{{N}}_]|$)')"
    return f"list_contains({tokens}, '{term}')"


def _facet_rows_sql(source: str, keys: str, text: str, vocabulary=VOCABULARY, ordered=sorted) -> str:
    """One row per key, facet with its matched terms joined by commas."""
    parts = []
    for no, (facet, terms) in enumerate(vocabulary.items()):
        hits = ", ".join(f"CASE WHEN {_hit_sql(t, 'tk', text)} THEN '{t}' END" for t in ordered(terms))
        parts.append(
            f"SELECT {keys}, {no} AS ord, '{facet}' AS facet, array_to_string(list_filter([{hits}], lambda x: x IS NOT NULL), ',') AS terms FROM tk"
        )
    union = " UNION ALL ".join(parts)
    return f"WITH tk AS (SELECT *, {_TOKENS.format(text)} AS tk FROM {source}) SELECT * FROM ({union}) WHERE terms <> ''"


@query(
    "security_facets",
    f"SELECT conv_id, turn, facet, terms FROM ({_facet_rows_sql('conversations', 'conv_id, turn', 'text')})",
)
def security_facets(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    found = classify.security_facets(turns, "text", VOCABULARY)
    return found.select("conv_id", "turn", "facet", F.array_join("terms", ",").alias("terms"))


@query(
    "facet_counts",
    f"SELECT lang, facet, count(*) AS docs FROM ({_facet_rows_sql('documents', 'doc_id, lang', 'text')}) GROUP BY lang, facet",
)
def facet_counts(spark, sf_dir):
    found = classify.security_facets(docs(spark, sf_dir).select("doc_id", "lang", "text"), "text", VOCABULARY)
    return found.groupBy("lang", "facet").agg(F.count("*").alias("docs"))


_CALLS = {
    "page_id": "page_id",
    "note": (
        "concat('Call ', CASE WHEN page_id % 2 = 0 THEN 'GET ' ELSE 'post ' END, "
        "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/{accountId} with userId, then DELETE /a/', "
        "CAST(page_id AS STRING), ' and userId.')"
    ),
    "path": base.URL_PATH,
}


@query(
    "endpoint_extract",
    f"""WITH c AS ({select_sql('pages', _CALLS)})
    SELECT page_id, 'endpoint' AS kind, CASE WHEN page_id % 2 = 0 THEN 'GET ' ELSE 'post ' END || path || '/{{accountId}}' AS value FROM c
    UNION ALL SELECT page_id, 'endpoint', 'DELETE /a/' || page_id FROM c
    UNION ALL SELECT page_id, 'identifier', unnest(['accountId', 'userId']) FROM c""",
)
def endpoint_extract(spark, sf_dir):
    notes = project(table(spark, sf_dir, "pages"), _CALLS).select("page_id", "note")
    return classify.endpoint_rows(notes, "note")


_DOMAIN_WORDS = {
    "english": ["the ", " and ", "with"], "french": ["le ", " de ", "avec", "que"], "german": ["der ", "und", "nicht"],
    "spanish": ["los", "para", "por "],
}


def _domain_sql() -> str:
    scores = ", ".join(
        "{'s': -(" + " + ".join(f"CAST(contains(h, '{w}') AS INT)" for w in words) + f"), 'n': '{name}'}}"
        for name, words in _DOMAIN_WORDS.items()
    )
    return (
        f"WITH h AS (SELECT doc_id, replace(lower(path || ' ' || 'Doc ' || doc_id || ' ' || text), '-', ' ') AS h FROM ({DOCS_SQL})), "
        f"s AS (SELECT doc_id, list_sort(list_filter([{scores}], lambda x: x.s < 0)) AS l FROM h) "
        "SELECT doc_id, CASE WHEN len(l) = 0 THEN 'general_web_security' ELSE array_to_string(list_transform(l, lambda x: x.n), ',') END AS domains, "
        "CASE WHEN len(l) = 0 THEN 'general_web_security' ELSE l[1].n END AS security_domain FROM s"
    )


@query("classify_domains", _domain_sql())
def classify_domains(spark, sf_dir):
    titled = docs(spark, sf_dir).withColumn("title", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")))
    found = classify.classify_domains(titled, "path", "title", "text", _DOMAIN_WORDS)
    return found.select("doc_id", F.array_join("security_domains", ",").alias("domains"), "security_domain")


@query(
    "domain_counts",
    f"SELECT security_domain, count(*) AS docs FROM ({_domain_sql()}) GROUP BY security_domain",
)
def domain_counts(spark, sf_dir):
    return classify_domains(spark, sf_dir).groupBy("security_domain").agg(F.count("*").alias("docs"))


@query(
    "security_signals",
    "SELECT conv_id, turn, facet AS signal, terms AS keywords FROM ("
    + _facet_rows_sql("conversations", "conv_id, turn", "text", VOCABULARY, ordered=list)
    + ")",
)
def security_signals(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    found = classify.security_signals(turns, "text", VOCABULARY)
    return found.select("conv_id", "turn", "signal", F.array_join("keywords", ",").alias("keywords"))


_TRIGGERS = {"english": ["the ", "thing"], "french": ["eaux"]}


@query(
    "query_domains",
    f"""WITH f AS ({_facet_rows_sql('benchmark', 'item_id', 'text')}),
    a AS (SELECT item_id, facet AS domain FROM f
      UNION SELECT item_id, 'english' FROM benchmark WHERE contains(lower(text), 'the ') OR contains(lower(text), 'thing')
      UNION SELECT item_id, 'french' FROM benchmark WHERE contains(lower(text), 'eaux'))
    SELECT b.item_id, coalesce(string_agg(a.domain, ',' ORDER BY a.domain), '') AS domains
    FROM benchmark b LEFT JOIN a USING (item_id) GROUP BY b.item_id""",
)
def query_domains(spark, sf_dir):
    found = classify.query_domains(F.col("text"), VOCABULARY, _TRIGGERS)
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(found), ",").alias("domains"))


# -- retrieval -----------------------------------------------------------------------------------


@query(
    "dense_topk",
    f"""WITH idx AS ({INDEX_SQL}), qs AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: x::DOUBLE) AS embedding FROM embeddings),
    s AS (SELECT q.query_id, i.chunk_id, list_cosine_similarity(q.embedding, i.embedding) AS c FROM qs q CROSS JOIN idx i WHERE i.embedding IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, chunk_id) AS dense_rank FROM s)
    SELECT query_id, chunk_id, round(c, 6) AS dense_score, CAST(dense_rank AS INT) AS dense_rank FROM r WHERE dense_rank <= 24""",
)
def dense_topk(spark, sf_dir):
    asked = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    found = retrieval.dense_topk(asked, base.index(spark, sf_dir), SCOPE)
    return found.withColumn("dense_score", F.round("dense_score", 6))


@query(
    "vector_problems",
    """SELECT doc_id AS chunk_id, 'missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
    UNION ALL SELECT vec_id, 'dimension' FROM embeddings WHERE label = 3""",
)
def vector_problems(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"),
        F.when(F.col("label") == 3, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("embedding"),
    )
    chunks = docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"))
    return retrieval.vector_problems(chunks, vectors, 64)


@query(
    "attach_vectors",
    """SELECT d.doc_id AS chunk_id, d.lang, CAST(len(e.embedding) AS INT) AS dim, round(CAST(e.embedding[1] AS DOUBLE), 6) AS first_value,
         CASE WHEN e.vec_id IS NULL THEN 'missing' END AS vector_problem
    FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
)
def attach_vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    chunks = docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "lang")
    out = retrieval.attach_vectors(chunks, vectors, 64, strict=False)
    dim = F.when(F.col("embedding").isNotNull(), F.size("embedding"))
    return out.select("chunk_id", "lang", dim.alias("dim"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first_value"), "vector_problem")


@query(
    "unsearchable",
    """SELECT 'chunk' AS side, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
    UNION ALL SELECT 'query', item_id FROM benchmark WHERE item_id NOT IN (SELECT vec_id FROM embeddings)""",
)
def unsearchable(spark, sf_dir):
    """Chunks and queries that dense search skips, as they have no vector."""
    index, asked = base.index(spark, sf_dir), base.queries(spark, sf_dir)
    chunks = index.where("embedding is null").select(F.lit("chunk").alias("side"), F.col("chunk_id").alias("id"))
    return chunks.unionByName(asked.where("embedding is null").select(F.lit("query").alias("side"), F.col("query_id").alias("id")))


@query("dense_probes")
def dense_probes(spark, sf_dir, probes: int | None = None):
    """Recall of search that reads three quarters of the lists only, per query against the exact result."""
    asked = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    index = base.index(spark, sf_dir)
    lists = CoarseLists.build(retrieval.in_scope(index, SCOPE), count=8)
    probes = probes or max(1, -(-3 * len(lists.centroids) // 4))
    exact = retrieval.dense_topk(asked, index, SCOPE, 5, 1, lists).select("query_id", "chunk_id")
    some = retrieval.dense_topk(asked, index, SCOPE, 5, 1, lists, probes=probes).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    counted = exact.join(some, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found"))
    return counted.select("query_id", "n_exact", "n_found", (F.col("n_found") / F.col("n_exact")).alias("recall"), F.lit(probes).alias("probes"))


_TERMS = (
    "list_distinct(list_filter(list_transform(regexp_extract_all({}, '[a-zA-Z0-9_./{{}}:-]+'), lambda x: lower(x)), lambda x: length(x) > 1))"
)
_SCORED_SQL = f"""
{DENSE_SQL},
qf AS (SELECT query_id, {_TERMS.format('query_text')} AS terms FROM qs),
qd AS (SELECT query_id, list(facet) AS domains FROM ({_facet_rows_sql('qs', 'query_id', 'query_text')}) GROUP BY query_id),
scored AS (
  SELECT d.query_id, d.chunk_id, i.source, i.title, i.text, i.source_type, i.security_domain, i.label,
    greatest(least(d.dense_score, 1.0), 0.0) AS dense_score,
    CASE WHEN len(qf.terms) = 0 THEN 0.0 ELSE len(list_intersect(qf.terms, {_TERMS.format("i.title || ' ' || i.text")})) / len(qf.terms) END AS lexical_score,
    CAST(i.priority AS DOUBLE) AS source_priority,
    CASE WHEN list_contains(coalesce(qd.domains, []), i.security_domain)
         THEN (CASE WHEN i.source_type = 'internal' THEN 0.04 ELSE 0.02 END)::DOUBLE ELSE 0.0::DOUBLE END AS domain_score
  FROM dense d JOIN idx i USING (chunk_id) JOIN qf USING (query_id) LEFT JOIN qd USING (query_id)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT *, least((0.65::DOUBLE * dense_score + 0.2::DOUBLE * lexical_score + 0.15::DOUBLE * source_priority) + domain_score, 1.0) AS score FROM scored)),
found AS (SELECT * FROM ranked WHERE rank <= 6)
"""


def _search(spark, sf_dir):
    return retrieval.search(base.queries(spark, sf_dir), base.index(spark, sf_dir), SCOPE, vocabulary=VOCABULARY)


@query(
    "lexical_score",
    f"WITH {_SCORED_SQL} SELECT query_id, chunk_id, round(lexical_score, 6) AS lexical_score FROM scored",
)
def lexical_score(spark, sf_dir):
    asked, idx = base.queries(spark, sf_dir), base.index(spark, sf_dir)
    candidates = retrieval.dense_topk(asked, idx, SCOPE).select("query_id", "chunk_id")
    pairs = candidates.join(idx.select("chunk_id", "title", "text"), "chunk_id").join(
        asked.select("query_id", "query_text"), "query_id"
    )
    value = retrieval.lexical_score(F.col("query_text"), F.concat_ws(" ", "title", "text"))
    return pairs.select("query_id", "chunk_id", F.round(value, 6).alias("lexical_score"))


@query(
    "hybrid_search",
    f"""WITH {_SCORED_SQL} SELECT query_id, chunk_id, source, CAST(rank AS INT) AS rank, round(dense_score, 6) AS dense_score,
    round(lexical_score, 6) AS lexical_score, source_priority, domain_score, round(score, 6) AS score FROM found""",
)
def hybrid_search(spark, sf_dir):
    return _search(spark, sf_dir).select(
        "query_id", "chunk_id", "source", "rank", F.round("dense_score", 6).alias("dense_score"),
        F.round("lexical_score", 6).alias("lexical_score"), "source_priority", "domain_score",
        F.round("score", 6).alias("score"),
    )


_FUSED_SQL = f"""
{_SCORED_SQL},
best AS (SELECT 'L' || q.label AS issue_key, f.chunk_id, f.source, f.source_type, f.title, f.text, f.score, f.query_id AS query_no,
           row_number() OVER (PARTITION BY q.label, f.chunk_id ORDER BY f.score DESC, f.query_id) AS pick
         FROM found f JOIN qs q USING (query_id)),
fused AS (SELECT issue_key, chunk_id, source, source_type, title, text, score, query_no,
            row_number() OVER (PARTITION BY issue_key ORDER BY score DESC, query_no, chunk_id) AS rank FROM best WHERE pick = 1)
"""


def _fused(spark, sf_dir):
    asked = base.queries(spark, sf_dir).select(
        "query_id", F.concat(F.lit("L"), F.col("label").cast("string")).alias("issue_key"), F.col("query_id").alias("query_no")
    )
    keys = _search(spark, sf_dir).select("query_id", "chunk_id", "source_type", "score", F.length("text").alias("n_chars"))
    return retrieval.fuse(keys.join(asked, "query_id").drop("query_id"))


def _with_texts(spark, sf_dir, ranked):
    """Texts of the chosen ranks."""
    return ranked.join(base.index(spark, sf_dir).select("chunk_id", "source", "title", "text"), "chunk_id")


@query(
    "query_fusion",
    f"WITH {_FUSED_SQL} SELECT issue_key, chunk_id, query_no, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM fused",
)
def query_fusion(spark, sf_dir):
    return _fused(spark, sf_dir).select("issue_key", "chunk_id", "query_no", F.round("score", 6).alias("score"), "rank")


@query(
    "pack_context",
    f"""WITH RECURSIVE {_FUSED_SQL.replace('idx AS (', 'idx AS MATERIALIZED (', 1)},
    f AS MATERIALIZED (SELECT issue_key, rank, chunk_id, source_type, length(text) AS n FROM fused),
    walk AS (
      SELECT issue_key, 0::BIGINT AS rank, 0::BIGINT AS used, []::VARCHAR[] AS srcs, false AS taken, NULL::BIGINT AS chunk_id FROM (SELECT DISTINCT issue_key FROM f)
      UNION ALL
      SELECT w.issue_key, f.rank, CASE WHEN ok THEN w.used + f.n ELSE w.used END,
        CASE WHEN ok THEN list_append(w.srcs, f.source_type) ELSE w.srcs END, ok, f.chunk_id
      FROM walk w JOIN f ON f.issue_key = w.issue_key AND f.rank = w.rank + 1,
      LATERAL (SELECT len(list_filter(w.srcs, lambda s: s = f.source_type)) < 3 AND w.used + f.n <= 8000 AS ok))
    SELECT issue_key, CAST(rank AS INT) AS rank, chunk_id FROM walk WHERE taken""",
)
def pack_context(spark, sf_dir):
    packed = retrieval.pack_context(_fused(spark, sf_dir), source="source_type", length="n_chars")
    return packed.select("issue_key", "rank", "chunk_id")


@query(
    "compact_context",
    f"""WITH RECURSIVE {_FUSED_SQL.replace('idx AS (', 'idx AS MATERIALIZED (', 1)},
    f AS MATERIALIZED (SELECT issue_key, rank, chunk_id, source, title, text, source_type FROM fused),
    walk AS (
      SELECT issue_key, 0::BIGINT AS rank, 3000::BIGINT AS left_over, 0 AS taken, false AS done, NULL::VARCHAR AS item FROM (SELECT DISTINCT issue_key FROM f)
      UNION ALL
      SELECT w.issue_key, f.rank, CASE WHEN stop THEN w.left_over ELSE w.left_over - length(j) END, CASE WHEN stop THEN w.taken ELSE w.taken + 1 END, stop, CASE WHEN stop THEN NULL ELSE j END
      FROM walk w JOIN f ON f.issue_key = w.issue_key AND f.rank = w.rank + 1,
      LATERAL (SELECT least(w.left_over, 1200) AS c1, greatest(200, w.left_over - 300) AS c2),
      LATERAL (SELECT CAST(to_json({{'id': f.chunk_id, 'source': f.source, 'title': f.title, 'text': CASE WHEN length(f.text) <= c1 THEN f.text ELSE rtrim(substr(f.text, 1, c1), chr(32) || chr(10)) || chr(10) || '[truncated]' END, 'score': CAST(f.rank AS DOUBLE), 'source_type': f.source_type, 'control_areas': []::VARCHAR[]}}) AS VARCHAR) AS j1,
                      CAST(to_json({{'id': f.chunk_id, 'source': f.source, 'title': f.title, 'text': CASE WHEN length(f.text) <= c2 THEN f.text ELSE rtrim(substr(f.text, 1, c2), chr(32) || chr(10)) || chr(10) || '[truncated]' END, 'score': CAST(f.rank AS DOUBLE), 'source_type': f.source_type, 'control_areas': []::VARCHAR[]}}) AS VARCHAR) AS j2),
      LATERAL (SELECT w.done OR w.left_over <= 0 OR (length(j1) > w.left_over AND w.taken > 0) AS stop, CASE WHEN length(j1) > w.left_over THEN j2 ELSE j1 END AS j)
      WHERE NOT w.done)
    SELECT issue_key, CAST(row_number() OVER (PARTITION BY issue_key ORDER BY rank) - 1 AS INT) AS item_no, item FROM walk WHERE item IS NOT NULL""",
)
def compact_context(spark, sf_dir):
    # the rank stands in for the score, so both engines print the same number
    ranked = _fused(spark, sf_dir).withColumn("score", F.col("rank").cast("double"))
    # an item takes 40 characters at least, so no later rank can be in the budget
    return retrieval.compact_context(_with_texts(spark, sf_dir, ranked.where(F.col("rank") <= 3000 // 40 + 1)), max_chars=3000)


# -- retrieval quality -----------------------------------------------------------------------------


def _expectations(spark, sf_dir):
    cases = base.queries(spark, sf_dir).select(F.col("query_id").alias("case_id"))
    paths = docs(spark, sf_dir).select("doc_id", "path")
    own = cases.join(paths, F.col("case_id") == F.col("doc_id")).select("case_id", F.lit("source").alias("kind"), F.col("path").alias("item"))
    fixed = cases.select(
        "case_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.lit("source").alias("kind"), F.lit("internal/").alias("item")),
                    F.struct(F.lit("source_type").alias("kind"), F.when(F.col("case_id") % 2 == 0, "internal").otherwise("owasp").alias("item")),
                    F.struct(F.lit("security_domain").alias("kind"), F.lit("en").alias("item")),
                    F.when(F.col("case_id") % 3 == 0, F.struct(F.lit("security_domain").alias("kind"), F.lit("fr").alias("item"))),
                )
            )
        ).alias("_e"),
    ).select("case_id", "_e.kind", "_e.item")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(
        "doc_id", F.explode(F.array(F.col("doc_id"), F.col("doc_id") - 1, F.col("doc_id") - 2)).alias("case_id")
    )
    banned = toxic.join(paths, "doc_id").join(cases, "case_id", "left_semi").select(
        "case_id", F.lit("forbidden").alias("kind"), F.col("path").alias("item")
    )
    return cases, own.unionByName(fixed).unionByName(banned)


_CASE_LISTS = [
    ("expected_sources", "source", ""), ("hits", "source", " AND hit"), ("misses", "source", " AND NOT hit"), ("expected_source_types", "source_type", ""),
    ("source_type_hits", "source_type", " AND hit"), ("expected_security_domains", "security_domain", ""), ("security_domain_hits", "security_domain", " AND hit"),
    ("forbidden_source_hits", "forbidden", " AND hit"),
]
_EVAL_SQL = f"""
{_SCORED_SQL},
dd AS ({DOCS_SQL}),
r AS (SELECT query_id AS case_id, rank, source, CASE WHEN source_type = 'payloads' THEN '{EXTERNAL_METHODOLOGY}' ELSE source_type END AS source_type, security_domain FROM found),
ex AS (
  SELECT query_id AS case_id, 'source' AS kind, dd.path AS item FROM qs JOIN dd ON dd.doc_id = qs.query_id
  UNION SELECT query_id, 'source', 'internal/' FROM qs
  UNION SELECT query_id, 'source_type', CASE WHEN query_id % 2 = 0 THEN 'internal' ELSE 'owasp' END FROM qs
  UNION SELECT query_id, 'security_domain', 'en' FROM qs
  UNION SELECT query_id, 'security_domain', 'fr' FROM qs WHERE query_id % 3 = 0
  UNION SELECT qs.query_id, 'forbidden', dd.path FROM labels l JOIN dd USING (doc_id) JOIN qs ON qs.query_id IN (l.doc_id, l.doc_id - 1, l.doc_id - 2) WHERE l.toxic = 1),
hit AS (
  SELECT ex.case_id, ex.kind, ex.item, coalesce(bool_or(CASE ex.kind WHEN 'source_type' THEN r.source_type = ex.item
      WHEN 'security_domain' THEN r.security_domain = ex.item ELSE contains(r.source, ex.item) END), false) AS hit
  FROM ex LEFT JOIN r USING (case_id) GROUP BY ex.case_id, ex.kind, ex.item),
rel AS (SELECT r.case_id, count(DISTINCT r.rank) AS n, min(r.rank) AS best FROM r JOIN ex ON ex.case_id = r.case_id AND ex.kind = 'source' AND contains(r.source, ex.item) GROUP BY r.case_id),
agg AS (SELECT case_id, count(*) AS retrieved, min(CASE WHEN source_type = 'internal' THEN rank END) AS fi, min(CASE WHEN source_type = '{EXTERNAL_METHODOLOGY}' THEN rank END) AS fe FROM r GROUP BY case_id),
sh AS (SELECT case_id,
    coalesce(avg(hit::INT) FILTER (kind = 'source'), 1.0) AS recall_at_k,
    coalesce(avg(hit::INT) FILTER (kind = 'forbidden'), 0.0) AS false_positive_source_rate,
    coalesce(avg(hit::INT) FILTER (kind = 'source_type'), 1.0) AS source_type_coverage,
    coalesce(avg(hit::INT) FILTER (kind = 'security_domain'), 1.0) AS security_domain_coverage FROM hit GROUP BY case_id),
lists AS (SELECT case_id, {', '.join(f"string_agg(item, '|' ORDER BY item) FILTER (kind = '{kind}'{test}) AS {name}" for name, kind, test in _CASE_LISTS)} FROM hit GROUP BY case_id),
got AS (SELECT case_id, string_agg(source, '|' ORDER BY rank) AS retrieved_sources, string_agg(DISTINCT source_type, '|' ORDER BY source_type) AS retrieved_source_types,
    string_agg(DISTINCT security_domain, '|' ORDER BY security_domain) AS retrieved_security_domains FROM r GROUP BY case_id),
cases AS (SELECT qs.query_id AS case_id, coalesce(retrieved, 0) AS retrieved, recall_at_k, coalesce(rel.n / retrieved, 0.0) AS precision_at_k, coalesce(1.0 / rel.best, 0.0)::DOUBLE AS mrr,
    source_type_coverage, security_domain_coverage, false_positive_source_rate, coalesce(fi < fe, true) AS internal_before_external_guidance
  FROM qs LEFT JOIN agg ON agg.case_id = qs.query_id LEFT JOIN sh ON sh.case_id = qs.query_id LEFT JOIN rel ON rel.case_id = qs.query_id)
"""
_SHARES = ["recall_at_k", "precision_at_k", "mrr", "source_type_coverage", "security_domain_coverage", "false_positive_source_rate"]


def _evaluated(spark, sf_dir):
    cases, expectations = _expectations(spark, sf_dir)
    languages = docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.array("lang").alias("security_domains"))
    kind = F.when(F.col("source_type") == "payloads", EXTERNAL_METHODOLOGY).otherwise(F.col("source_type"))
    results = _search(spark, sf_dir).join(languages, "chunk_id").select(
        F.col("query_id").alias("case_id"), "rank", "source", kind.alias("source_type"), "security_domains"
    )
    return evaluation.evaluate_retrieval(results, cases, expectations)


@query(
    "eval_cases",
    f"WITH {_EVAL_SQL} SELECT case_id, CAST(retrieved AS INT) AS retrieved, {', '.join(f'round({c}, 6) AS {c}' for c in _SHARES)}, internal_before_external_guidance, "
    f"{', '.join(f'coalesce({c}, {chr(39)}{chr(39)}) AS {c}' for c in evaluation.LISTS)} FROM cases LEFT JOIN lists USING (case_id) LEFT JOIN got USING (case_id)",
)
def eval_cases(spark, sf_dir):
    out = _evaluated(spark, sf_dir)
    lists = [F.array_join(c, "|").alias(c) for c in evaluation.LISTS]
    return out.select("case_id", "retrieved", *[F.round(c, 6).alias(c) for c in _SHARES], "internal_before_external_guidance", *lists)


@query(
    "eval_summary",
    f"""WITH {_EVAL_SQL} SELECT count(*) AS cases, {', '.join(f'round(avg({c}), 6) AS mean_{c}' for c in _SHARES)},
    round(avg(internal_before_external_guidance::INT), 6) AS internal_before_external_guidance_rate FROM cases""",
)
def eval_summary(spark, sf_dir):
    out = evaluation.summarize_eval(_evaluated(spark, sf_dir))
    return out.select("cases", *[F.round(c, 6).alias(c) for c in out.columns if c != "cases"])


@query(
    "scope_isolation",
    f"""WITH idx AS ({INDEX_SQL}), qs AS ({QUERIES_SQL}),
    s AS (SELECT q.query_id, i.chunk_id, list_cosine_similarity(q.embedding, i.embedding) AS c FROM qs q CROSS JOIN idx i
          WHERE i.source_type = 'internal' AND i.embedding IS NOT NULL AND q.embedding IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, chunk_id) AS n FROM s)
    SELECT query_id, chunk_id, round(c, 6) AS dense_score FROM r WHERE n <= 3""",
)
def scope_isolation(spark, sf_dir):
    """Only the internal documents belong to the asking tenant."""
    idx = base.index(spark, sf_dir).withColumn(
        "tenant_id", F.when(F.col("source_type") == "internal", F.lit("acme")).otherwise(F.lit("other"))
    )
    found = retrieval.dense_topk(base.queries(spark, sf_dir), idx, SCOPE, k=3, multiplier=1)
    return found.select("query_id", "chunk_id", F.round("dense_score", 6).alias("dense_score"))


