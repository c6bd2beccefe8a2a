"""Segments, quotes, citations, confidence and reports on the supplied tables.

Every document is a claim that cites its own sentences (even positions) and, for
odd positions, the next document, which mostly does not contain them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from seclake.operators import evidence, issues, responses, retrieval
from seclake.plans import review
from seclake.queries import base
from seclake.queries.base import DOCS_SQL, FLOWS_SQL, ISSUES_SQL, ORACLES, SCOPE, docs, project, query, table
from seclake.queries.search import VOCABULARY, _facet_rows_sql, _search, _SCORED_SQL
from seclake.queries.text import _secret_chain
from seclake.sources import catalogues, trackers

_BLANKS = "chr(32) || chr(10) || chr(9)"
_SENTENCES = (
    "list_filter(list_transform(regexp_split_to_array(regexp_replace({p}, '([.!?。！？])\\s+', '\\1' || chr(10), 'g'), '\\n+'), "
    "lambda s: trim(s, " + _BLANKS + ")), lambda s: s <> '')"
)
_PARAGRAPHS = "list_filter(list_transform(regexp_split_to_array({t}, '\\n\\s*\\n+'), lambda p: trim(p, " + _BLANKS + ")), lambda p: p <> '')"
_NORMAL = "array_to_string(list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda w: w <> ''), ' ')"
# every second document gets blank lines between its lines
_SPACED_SQL = "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE text END AS text FROM documents"


def _spaced(spark, sf_dir):
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\n\n"))).otherwise(F.col("text"))
    return docs(spark, sf_dir).withColumn("text", text)


@query(
    "segment_text",
    f"""WITH s AS ({_SPACED_SQL}),
    l AS (SELECT doc_id, flatten(list_transform({_PARAGRAPHS.format(t='text')}, lambda p: list_concat([p], {_SENTENCES.format(p='p')}))) AS l FROM s)
    SELECT doc_id, CAST(i - 1 AS INT) AS segment_no, l[i] AS segment FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l)""",
)
def segment_text(spark, sf_dir):
    return evidence.segments(_spaced(spark, sf_dir).select("doc_id", "text"))


_TYPES = {
    "internal": "security_policy", "portswigger": "security_guidance", "mitre": "past_finding", "owasp": "system_fact",
    "payloads": "business_requirement", "local": "assumption",
}
_TYPE_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPES.items()) + " END"


def _context(spark, sf_dir):
    kinds = F.create_map(*[F.lit(x) for pair in _TYPES.items() for x in pair])
    return _spaced(spark, sf_dir).select(
        F.col("doc_id").alias("source_id"), "text", kinds[F.col("kind")].alias("evidence_type"),
        (F.col("doc_id") % 10 == 0).alias("is_template"),
    )


def _citations(spark, sf_dir):
    paragraphs = evidence.paragraphs(F.col("text"))
    quotes = F.flatten(F.transform(paragraphs, evidence.sentences))
    rows = _spaced(spark, sf_dir).select(F.col("doc_id").alias("claim_id"), F.posexplode(quotes).alias("pos", "evidence_quote"))
    return rows.select(
        "claim_id", "pos", (F.col("claim_id") + F.col("pos") % 2).alias("source_id"), "evidence_quote",
        F.lit("system_fact").alias("evidence_type"),
    )


def _claims(spark, sf_dir):
    number = F.col("doc_id")
    return docs(spark, sf_dir).select(
        number.alias("claim_id"),
        F.concat(F.lit("ISS-"), number.cast("string")).alias("issue_key"),
        F.when(number % 2 == 0, "risk").otherwise("test").alias("kind"),
        F.concat(F.lit("Claim "), number.cast("string")).alias("title"),
        F.array_repeat(F.lit("assumed"), (number % 4).cast("int")).alias("assumptions"),
    )


_CITED_SQL = f"""
d AS ({DOCS_SQL}), sp AS ({_SPACED_SQL}),
ctx AS MATERIALIZED (SELECT d.doc_id AS source_id, {_TYPE_SQL} AS evidence_type, d.doc_id % 10 = 0 AS is_template,
   list_transform({_PARAGRAPHS.format(t='sp.text')}, lambda p: {_NORMAL.format(x='p')}) AS segs FROM d JOIN sp USING (doc_id)),
ql AS (SELECT doc_id AS claim_id, flatten(list_transform({_PARAGRAPHS.format(t='text')}, lambda p: {_SENTENCES.format(p='p')})) AS l FROM sp),
cit AS MATERIALIZED (SELECT claim_id, i - 1 AS pos, claim_id + (i - 1) % 2 AS source_id, l[i] AS evidence_quote, {_NORMAL.format(x='l[i]')} AS quote
  FROM (SELECT claim_id, l, unnest(range(1, len(l) + 1)) AS i FROM ql)),
valid AS MATERIALIZED (SELECT DISTINCT c.source_id, c.quote, x.evidence_type, x.is_template FROM cit c JOIN ctx x USING (source_id)
  WHERE len(string_split(c.quote, ' ')) >= 5 AND length(c.quote) <= 500 AND len(list_filter(x.segs, lambda s: contains(s, c.quote))) > 0),
kept AS MATERIALIZED (SELECT * FROM (SELECT c.claim_id, c.pos, c.source_id, c.evidence_quote, c.quote, v.evidence_type, v.is_template,
   row_number() OVER (PARTITION BY c.claim_id, c.source_id, c.quote ORDER BY c.pos) AS rn FROM cit c JOIN valid v USING (source_id, quote)) WHERE rn = 1),
claims AS (SELECT doc_id AS claim_id, CASE WHEN doc_id % 2 = 0 THEN 'risk' ELSE 'test' END AS kind, 'Claim ' || doc_id AS title, doc_id % 4 AS assumed FROM documents)
"""


@query("quote_validation", f"WITH {_CITED_SQL} SELECT source_id, quote, evidence_type, is_template FROM valid")
def quote_validation(spark, sf_dir):
    return evidence.valid_quotes(_citations(spark, sf_dir), _context(spark, sf_dir))


@query(
    "citation_validation",
    f"WITH {_CITED_SQL} SELECT claim_id, CAST(pos AS INT) AS pos, source_id, evidence_quote, evidence_type FROM kept",
)
def citation_validation(spark, sf_dir):
    kept = evidence.validate_citations(_citations(spark, sf_dir), _context(spark, sf_dir))
    return kept.select("claim_id", "pos", "source_id", "evidence_quote", "evidence_type")


_CONFIDENCE_SQL = f"""
{_CITED_SQL},
votes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, source_id ORDER BY pos) AS v FROM kept) WHERE v = 1),
w AS (SELECT claim_id, sum(CASE evidence_type WHEN 'system_fact' THEN 2 WHEN 'business_requirement' THEN 2 WHEN 'security_policy' THEN 2 WHEN 'past_finding' THEN 1 WHEN 'assumption' THEN -1 ELSE 0 END) AS weight,
   sum(is_template::INT) AS templates, bool_or(regexp_matches(evidence_quote, '(?i)\\b(?:GET|POST|PUT|PATCH|DELETE)\\s+/\\S+')) AS ep,
   bool_or(evidence_type IN ('system_fact', 'business_requirement')) AS sys FROM votes GROUP BY claim_id),
n AS (SELECT claim_id, string_agg(evidence_type || '=' || c, ', ' ORDER BY evidence_type) AS summary FROM (SELECT claim_id, evidence_type, count(*) AS c FROM votes GROUP BY 1, 2) GROUP BY claim_id),
sc AS (SELECT c.claim_id, c.kind, c.title, c.assumed, coalesce(w.weight, 0) - least(c.assumed, 2) - coalesce(w.templates, 0) + coalesce(w.ep, false)::INT AS score,
   coalesce(w.sys, false) AS sys, coalesce(n.summary, 'no validated evidence') AS summary FROM claims c LEFT JOIN w USING (claim_id) LEFT JOIN n USING (claim_id)),
rated AS (SELECT *, CASE WHEN score >= 5 AND sys THEN 'high' WHEN score >= 2 THEN 'medium' ELSE 'low' END AS confidence,
   'Deterministic evidence score ' || score || '; ' || summary || '; assumptions=' || assumed || '.' AS confidence_reason FROM sc)
"""


@query(
    "confidence_scores",
    f"WITH {_CONFIDENCE_SQL} SELECT claim_id, CAST(score AS INT) AS score, confidence, confidence_reason FROM rated",
)
def confidence_scores(spark, sf_dir):
    valid = evidence.validate_citations(_citations(spark, sf_dir), _context(spark, sf_dir))
    scored = evidence.confidence(_claims(spark, sf_dir), valid)
    return scored.select("claim_id", "score", "confidence", "confidence_reason")


@query(
    "citation_warnings",
    f"""WITH {_CITED_SQL} SELECT claim_id, kind, CASE kind WHEN 'risk' THEN 'Risk hypothesis' ELSE 'Test idea' END || ' has no valid citation: ' || title AS warning
    FROM claims WHERE claim_id NOT IN (SELECT claim_id FROM kept)""",
)
def citation_warnings(spark, sf_dir):
    valid = evidence.validate_citations(_citations(spark, sf_dir), _context(spark, sf_dir))
    return evidence.citation_warnings(_claims(spark, sf_dir), valid)


_CLAIM_LINE = "title || ' [' || assumed || ' assumed]' || {rating} || coalesce(chr(10) || quotes, '')"
_RATING = "' ' || confidence || ': ' || confidence_reason"


@query(
    "issue_reports",
    f"""WITH {_SCORED_SQL.replace('idx AS (', 'idx AS MATERIALIZED (', 1)}, {_CONFIDENCE_SQL},
    r AS (SELECT query_id, string_agg(source || ' ' || title || ' ' || CAST(CAST(round(score * 1000) AS BIGINT) AS VARCHAR) || ' ' || chunk_id, chr(10) ORDER BY score DESC, source, title, chunk_id) AS sources FROM found GROUP BY query_id),
    e AS (SELECT claim_id, string_agg(pos || ' ' || source_id || ' ' || evidence_type || ' ' || evidence_quote, chr(10) ORDER BY pos, source_id, evidence_quote) AS quotes FROM kept GROUP BY claim_id)
    SELECT 'ISS-' || s.claim_id AS issue_key,
      CASE WHEN s.kind = 'risk' THEN {_CLAIM_LINE.format(rating=_RATING)} ELSE '' END AS risks,
      CASE WHEN s.kind = 'test' THEN {_CLAIM_LINE.format(rating="''")} ELSE '' END AS tests,
      CASE WHEN e.quotes IS NULL THEN CASE s.kind WHEN 'risk' THEN 'Risk hypothesis' ELSE 'Test idea' END || ' has no valid citation: ' || s.title ELSE '' END AS warnings,
      CASE WHEN r.sources IS NOT NULL THEN 'ok' ELSE 'empty' END AS rag_status, coalesce(r.sources, '') AS sources, 'acme' AS tenant_id
    FROM rated s LEFT JOIN r ON r.query_id = s.claim_id LEFT JOIN e ON e.claim_id = s.claim_id""",
)
def issue_reports(spark, sf_dir):
    """One claim per issue; the report's lists as lines."""
    found = _search(spark, sf_dir).select(
        F.concat(F.lit("ISS-"), F.col("query_id").cast("string")).alias("issue_key"), "chunk_id", "source", "title", "score"
    )
    reports = evidence.assemble_reports(None, _claims(spark, sf_dir), _citations(spark, sf_dir), found, _context(spark, sf_dir), SCOPE)

    def text(x):
        return x.cast("string")

    def quotes(c):
        lines = F.transform(c["supporting_evidence"], lambda e: F.concat_ws(" ", text(e["pos"]), text(e["source_id"]), e["evidence_type"], e["evidence_quote"]))
        return F.when(F.size(lines) > 0, F.concat(F.lit("\n"), F.array_join(lines, "\n"))).otherwise("")

    def claim(rated):
        def line(c):
            rating = F.concat(F.lit(" "), c["confidence"], F.lit(": "), c["confidence_reason"]) if rated else F.lit("")
            return F.concat(c["title"], F.lit(" ["), text(F.size(c["assumptions"])), F.lit(" assumed]"), rating, quotes(c))

        return line

    def source(s):
        return F.concat_ws(" ", s["source"], s["title"], text(F.round(s["score"] * 1000).cast("bigint")), text(s["chunk_id"]))

    return reports.select(
        "issue_key", F.array_join(F.transform("risk_hypotheses", claim(True)), "\n").alias("risks"),
        F.array_join(F.transform("test_ideas", claim(False)), "\n").alias("tests"), F.array_join("citation_warnings", "\n").alias("warnings"),
        "rag_status", F.coalesce(F.array_join(F.transform("rag_sources", source), "\n"), F.lit("")).alias("sources"), "analysis_metadata.tenant_id",
    )


# -- issues ------------------------------------------------------------------------------------------


def _issue_pages(spark, sf_dir):
    """Benchmark passages as wiki pages; page n belongs to issue n."""
    item = F.col("item_id").cast("string")
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("ISS-"), item).alias("issue_key"), F.lit(0).alias("position"), item.alias("id"),
        F.concat(F.lit("Page "), item).alias("title"), F.concat(F.lit("https://wiki.example/"), item).alias("url"),
        F.lit("SEC").alias("space_key"), F.col("text").alias("body_text"),
    )


def _issue_flows(spark, sf_dir):
    body = F.concat(F.lit('{"id": '), F.col("seq").cast("string"), F.lit(', "tags": ["a", "b"]}'))
    return (
        base.flows(spark, sf_dir)
        .withColumn("issue_key", F.concat(F.lit("ISS-"), F.col("seq").cast("string")))
        .withColumn("request_body", body)
        .withColumn("response_body", F.lit(None).cast("string"))
    )


def _issue_chunks(spark, sf_dir):
    return docs(spark, sf_dir).select(
        F.concat(F.lit("ISS-"), F.col("doc_id").cast("string")).alias("issue_key"), F.col("doc_id").cast("string").alias("chunk_id"),
        F.col("path").alias("source"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"),
        "text", F.col("kind").alias("source_type"), (F.col("doc_id") % 10 == 0).alias("is_template"),
    )


_RENDERED_SQL = f"""
SELECT seq, method || ' ' || url || ' (host ' || host || ', scheme ' || scheme || ')' || chr(10) || 'Authorization: ' || "authorization" || chr(10) || chr(10)
  || 'HTTP status ' || coalesce(CAST(status_code AS VARCHAR), 'unknown') || chr(10) || 'Content-Type: text/html; charset=utf-8'
  || coalesce(chr(10) || 'Strict-Transport-Security: ' || hsts, '') || coalesce(chr(10) || 'Content-Security-Policy: ' || csp, '') || chr(10) || 'Set-Cookie: ' || cookie
  || chr(10) || chr(10) || 'Request body:' || chr(10) || '{{' || chr(10) || '  "id": ' || seq || ',' || chr(10) || '  "tags": [' || chr(10) || '    "a",' || chr(10) || '    "b"' || chr(10) || '  ]' || chr(10) || '}}' AS text
FROM ({FLOWS_SQL})
"""


@query("render_flows", f"SELECT seq, text FROM ({_RENDERED_SQL})")
def render_flows(spark, sf_dir):
    return _issue_flows(spark, sf_dir).select("seq", evidence.render_flow().alias("text"))


@query(
    "evidence_union",
    f"""WITH i AS ({ISSUES_SQL}), d AS ({DOCS_SQL}), f AS ({_RENDERED_SQL}), e AS (
      SELECT key AS issue_key, 'jira:' || key || ':summary' AS source_id, summary AS text, 'business_requirement' AS evidence_type, false AS is_template FROM i
      UNION ALL SELECT key, 'jira:' || key || ':description', coalesce(description, ''), 'business_requirement', false FROM i
      UNION ALL SELECT key, 'jira:' || key || ':acceptance_criteria', '', 'business_requirement', false FROM i
      UNION ALL SELECT key, 'jira:' || key || ':comments', comments, 'assumption', false FROM i
      UNION ALL SELECT 'ISS-' || item_id, 'confluence:' || item_id, text, 'system_fact', false FROM benchmark
      UNION ALL SELECT 'ISS-' || seq, 'traffic:flow' || seq, text, 'system_fact', false FROM f
      UNION ALL SELECT 'ISS-' || doc_id, 'rag:' || doc_id, text, CASE WHEN kind = 'internal' AND doc_id % 10 <> 0 THEN 'security_policy' ELSE 'security_guidance' END, doc_id % 10 = 0 FROM d)
    SELECT issue_key, source_id, evidence_type, is_template, {_secret_chain('text')} AS text FROM e""",
)
def evidence_union(spark, sf_dir):
    return evidence.evidence_context(
        base.issues(spark, sf_dir), _issue_pages(spark, sf_dir), _issue_flows(spark, sf_dir), _issue_chunks(spark, sf_dir)
    )


@query(
    "source_catalog",
    f"""WITH i AS ({ISSUES_SQL}), d AS ({DOCS_SQL}), f AS ({FLOWS_SQL})
    SELECT key AS issue_key, 'jira:' || key || ':' || p AS source_id, 'Jira ' || replace(p, '_', ' ') AS label
      FROM i CROSS JOIN (SELECT unnest(['summary', 'description', 'acceptance_criteria', 'comments']) AS p)
    UNION ALL SELECT 'ISS-' || item_id, 'confluence:' || item_id, 'Page ' || item_id FROM benchmark
    UNION ALL SELECT 'ISS-' || seq, 'traffic:' || id, method || ' ' || host || coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') || ' (status ' || coalesce(CAST(status_code AS VARCHAR), 'None') || ')' FROM f
    UNION ALL SELECT 'ISS-' || doc_id, 'rag:' || doc_id, path || ' - Doc ' || doc_id FROM d""",
)
def source_catalog(spark, sf_dir):
    return evidence.source_catalog(
        base.issues(spark, sf_dir), _issue_pages(spark, sf_dir), _issue_flows(spark, sf_dir), _issue_chunks(spark, sf_dir)
    )


@query(
    "normalize_issues",
    f"""WITH i AS ({ISSUES_SQL}) SELECT i.key, {_secret_chain('i.description')} AS description, {_secret_chain('i.comments')} AS comments,
    CAST((b.item_id IS NOT NULL)::INT AS INT) AS pages, CASE WHEN length(b.text) <= 300 THEN b.text ELSE rtrim(substr(b.text, 1, 300), {_BLANKS}) || chr(10) || '[truncated]' END AS page
    FROM i LEFT JOIN benchmark b ON b.item_id = i.conv_id""",
)
def normalize_issues(spark, sf_dir):
    out = evidence.normalize_issues(base.issues(spark, sf_dir), _issue_pages(spark, sf_dir), page_chars=300)
    return out.select(
        "key", "description", F.array_join("comments", "\n").alias("comments"), F.size("confluence_pages").alias("pages"),
        F.try_element_at("confluence_pages", F.lit(1))["body_text"].alias("page"),
    )


_ISSUE_TEXT_SQL = (
    f"SELECT i.key, i.conv_id, i.summary || chr(10) || coalesce(i.description, '') || chr(10) || chr(10) || chr(10) || chr(10) || replace(i.comments, chr(10), ' ') || chr(10) "
    f"|| coalesce('Page ' || b.item_id, '') || chr(10) || coalesce(b.text, '') AS text FROM ({ISSUES_SQL}) i LEFT JOIN benchmark b ON b.item_id = i.conv_id"
)


@query(
    "issue_facet_queries",
    f"SELECT key AS issue_key, 'security facet ' || facet || ': ' || replace(terms, ',', ' ') AS query_text FROM ({_facet_rows_sql('(' + _ISSUE_TEXT_SQL + ')', 'key', 'text')})",
)
def issue_facet_queries(spark, sf_dir):
    out = evidence.issue_queries(base.issues(spark, sf_dir), _issue_pages(spark, sf_dir), vocabulary=VOCABULARY)
    return out.where("query_no > 0").select("issue_key", "query_text")


@query(
    "issue_json_queries",
    f"""WITH i AS ({ISSUES_SQL}), c AS (SELECT conv_id, list(text ORDER BY turn) AS l FROM conversations WHERE turn > 0 GROUP BY conv_id)
    SELECT i.key AS issue_key, '{{"summary": ' || to_json(i.summary) || ', "description": ' || coalesce(CAST(to_json({_secret_chain('i.description')}) AS VARCHAR), 'null')
      || ', "acceptance_criteria": null, "labels": [], "components": [], "comments": ['
      || array_to_string(list_transform(coalesce(c.l, []), lambda x: CAST(to_json({_secret_chain('x')}) AS VARCHAR)), ', ')
      || '], "confluence_titles": [' || coalesce('"Page ' || b.item_id || '"', '') || '], "confluence_excerpt": [' || coalesce(CAST(to_json({_secret_chain('b.text')}) AS VARCHAR), '') || ']}}' AS query_text
    FROM i LEFT JOIN c USING (conv_id) LEFT JOIN benchmark b ON b.item_id = i.conv_id""",
)
def issue_json_queries(spark, sf_dir):
    out = evidence.issue_queries(base.issues(spark, sf_dir), _issue_pages(spark, sf_dir), vocabulary=VOCABULARY)
    return out.where("query_no = 0").select("issue_key", "query_text")


# -- from issues to context, with counts of frequent letters as vectors ------------------------------------
_LETTERS = "entaisor"


def _letter_counts(texts):
    """Vectors of a batch of texts: how often each letter occurs, and a 1."""
    columns = [texts.str.count(letter).astype("float32") for letter in _LETTERS]
    return pd.Series([[*map(float, row), 1.0] for row in zip(*columns)], index=texts.index)


def _letters_sql(text: str) -> str:
    return "[" + ", ".join(f"(length({text}) - length(replace({text}, '{x}', '')))::DOUBLE" for x in _LETTERS) + ", 1.0::DOUBLE]"


@query(
    "embed_chunks",
    f"SELECT doc_id AS chunk_id, array_to_string(list_transform({_letters_sql('text')}, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ' ') AS vector FROM documents",
)
def embed_chunks(spark, sf_dir):
    chunks = docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text")
    vectors = retrieval.embed_chunks(chunks, _letter_counts, len(_LETTERS) + 1)
    return vectors.select("chunk_id", F.array_join(F.transform("embedding", lambda x: x.cast("bigint").cast("string")), " ").alias("vector"))


def _issue_context_sql() -> str:
    """The check of packed context, with issue queries as queries and letter counts as vectors."""
    facets = f"SELECT key AS issue_key, row_number() OVER (PARTITION BY key ORDER BY ord) AS query_no, 'security facet ' || facet || ': ' || replace(terms, ',', ' ') AS query_text FROM ({_facet_rows_sql('(' + _ISSUE_TEXT_SQL + ')', 'key', 'text')})"
    asked = f"SELECT issue_key, 0 AS query_no, query_text FROM ({ORACLES['issue_json_queries']}) UNION ALL {facets}"
    queries = f"SELECT issue_key || '#' || query_no AS query_id, issue_key, query_no, query_text, 0 AS label, {_letters_sql('query_text')} AS embedding FROM ({asked})"
    sql = ORACLES["pack_context"]
    for old, new in (
        (base.INDEX_SQL, base.INDEX_SQL.replace("list_transform(e.embedding, lambda x: x::DOUBLE) AS embedding", f"{_letters_sql('d.text')} AS embedding")),
        (base.QUERIES_SQL, queries), ("'L' || q.label AS issue_key", "q.issue_key AS issue_key"), ("f.query_id AS query_no", "q.query_no AS query_no"),
        ("PARTITION BY q.label, f.chunk_id ORDER BY f.score DESC, f.query_id", "PARTITION BY q.issue_key, f.chunk_id ORDER BY f.score DESC, q.query_no"),
        ("chunk_id, source_type, length(text) AS n FROM fused", "chunk_id, source AS source_type, length(text) AS n FROM fused"),
        ("list_cosine_similarity(q.embedding, i.embedding)", "round(list_cosine_similarity(q.embedding, i.embedding), 12)"),
    ):
        assert old in sql, old
        sql = sql.replace(old, new)
    return sql


@query("issue_context", _issue_context_sql())
def issue_context(spark, sf_dir):
    index = base.index(spark, sf_dir).drop("embedding")
    index = retrieval.embed_chunks(index, _letter_counts, len(_LETTERS) + 1)
    out = review.issue_context(
        base.issues(spark, sf_dir), _issue_pages(spark, sf_dir), index, SCOPE, _letter_counts, len(_LETTERS) + 1, vocabulary=VOCABULARY
    )
    return out.select("issue_key", "rank", "chunk_id")


@query(
    "prompt_metrics",
    f"""WITH i AS ({ISSUES_SQL})
    SELECT i.key AS issue_key, coalesce((b.item_id IS NOT NULL)::INT, 0)::BIGINT AS confluence_pages, coalesce(length(b.text), 0)::BIGINT AS confluence_chars_total,
      (CASE WHEN b.item_id IS NULL THEN 0 ELSE least(length(b.text), 100) END)::BIGINT AS confluence_chars_sent, (p.page_id IS NOT NULL)::BIGINT AS http_flows, (d.doc_id IS NOT NULL)::BIGINT AS rag_chunks,
      coalesce(length(d.text), 0)::BIGINT AS rag_context_chars, (4 + (b.item_id IS NOT NULL)::INT + (p.page_id IS NOT NULL)::INT + (d.doc_id IS NOT NULL)::INT)::BIGINT AS source_catalog_entries
    FROM i LEFT JOIN benchmark b ON b.item_id = i.conv_id LEFT JOIN pages p ON p.page_id = i.conv_id LEFT JOIN documents d ON d.doc_id = i.conv_id""",
)
def prompt_metrics(spark, sf_dir):
    return evidence.prompt_metrics(
        base.issues(spark, sf_dir), _issue_pages(spark, sf_dir), _issue_flows(spark, sf_dir), _issue_chunks(spark, sf_dir), page_chars=100
    )


# -- model responses ------------------------------------------------------------------------------------


def _payload_sql() -> str:
    """Payload expression; the backslash of a JSON escape is chr(92) in both engines."""
    q, nl = "', chr(92), '\"", "', chr(92), 'n"
    ident = "', CAST(event_id AS STRING), '"
    inner = "{" + f"{q}issue_key{q}: {q}E{ident}{q}, {q}n{q}: %d" + "}"
    forms = [
        '{"choices": [{"message": {"content": "```json' + nl + inner % 1 + nl + '```"}}]}',
        '{"choices": [{"message": {"content": "Here: ' + inner % 2 + ' and } more"}}]}',
        '{"choices": [{"message": {"content": [{"type": "text", "text": "' + inner % 3 + '"}, " "]}}]}',
        '{"choices": [{"message": {"content": null, "tool_calls": [{"function": {"arguments": "' + inner % 4 + '"}}]}}]}',
        '{"choices": [{"finish_reason": "length", "message": {"content": "", "reasoning": "no object"}}]}',
        '{"choices": [{"message": {"content": "{' + q + "n" + q + ': 5}"}}]}',
    ]
    cases = " ".join(f"WHEN {i} THEN concat('{form}')" for i, form in enumerate(forms))
    return f"CASE event_id % 6 {cases} END"


_PAYLOADS = {"event_id": "event_id", "payload": _payload_sql()}


@query(
    "parse_responses",
    """SELECT event_id, CASE WHEN event_id % 6 < 4 THEN 'E' || event_id END AS issue_key, CAST(CASE WHEN event_id % 6 < 4 THEN event_id % 6 + 1 END AS INT) AS n,
    CASE event_id % 6 WHEN 4 THEN 'token limit reached before any content' WHEN 5 THEN 'missing fields: issue_key' END AS reject_reason FROM events""",
)
def parse_responses(spark, sf_dir):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("issue_key", T.StringType(), False), T.StructField("n", T.IntegerType())])
    out = responses.parse_responses(project(table(spark, sf_dir, "events"), _PAYLOADS), schema)
    return out.select("event_id", "parsed.issue_key", "parsed.n", "reject_reason")


# -- exports: conversations, pages and benchmark items written as JSON objects ---------------------------
def _json_column(df, name: str, fields: str):
    return df.selectExpr(f"to_json({fields}) AS {name}")


@query(
    "parse_issues",
    """SELECT 'C-' || conv_id || '-' || turn AS key, 'Turn ' || turn AS summary, nullif(trim(text, chr(32) || chr(10)), '') AS description,
      role AS issue_type, 'Open' AS status, role || ',' || turn AS labels, CASE WHEN turn % 2 = 0 THEN role ELSE '' END AS components,
      CASE WHEN turn % 3 = 0 THEN 'see https://x.example/' || conv_id ELSE '' END AS comments FROM conversations""",
)
def parse_issues(spark, sf_dir):
    """Every turn as one issue export; the description is a rich-text tree, a comment is plain text."""
    turns = table(spark, sf_dir, "conversations")
    body = "named_struct('type', 'doc', 'content', array(named_struct('type', 'paragraph', 'content', array(named_struct('type', 'text', 'text', text)))))"
    exported = _json_column(
        turns, "value",
        f"""named_struct('key', concat('C-', conv_id, '-', turn), 'fields', named_struct('summary', concat('Turn ', turn), 'description', {body},
        'issuetype', named_struct('name', role), 'status', named_struct('name', 'Open'), 'labels', array(role, cast(turn as string)),
        'components', CASE WHEN turn % 2 = 0 THEN array(named_struct('name', role)) ELSE array(named_struct('name', '')) END,
        'comment', named_struct('comments', CASE WHEN turn % 3 = 0 THEN array(named_struct('body', concat('see https://x.example/', conv_id))) ELSE array(named_struct('body', '')) END)))""",
    )
    out = trackers.parse_issues(exported)
    return out.select(
        "key", "summary", "description", "issue_type", "status", F.array_join("labels", ",").alias("labels"),
        F.array_join("components", ",").alias("components"), F.array_join("comments", ",").alias("comments"),
    )


@query(
    "parse_pages",
    """SELECT CAST(page_id AS VARCHAR) AS id, CASE WHEN page_id % 4 = 0 THEN 'Confluence page ' || page_id ELSE 'T' || page_id END AS title,
      'https://wiki.example/p/' || page_id AS url, CASE WHEN page_id % 5 > 0 THEN 'S' || page_id % 5 END AS space_key,
      'Line ' || page_id || chr(10) || 'Item <' || page_id % 7 || '>' AS body_text FROM pages""",
)
def parse_pages(spark, sf_dir):
    """Every page as one wiki export, the body in its storage or its rendered form."""
    body = "concat('<p>Line ', page_id, '</p><ul><li>Item &lt;', page_id % 7, '&gt;</li></ul>')"
    exported = _json_column(
        table(spark, sf_dir, "pages"), "value",
        f"""named_struct('id', cast(page_id as string), 'title', CASE WHEN page_id % 4 > 0 THEN concat('T', page_id) ELSE '' END,
        '_links', named_struct('webui', concat('/p/', page_id)), 'space', CASE WHEN page_id % 5 > 0 THEN named_struct('key', concat('S', page_id % 5)) END,
        'body', named_struct('storage', named_struct('value', CASE WHEN page_id % 2 = 0 THEN {body} ELSE '' END), 'view', named_struct('value', CASE WHEN page_id % 2 = 1 THEN {body} END)))""",
    )
    return trackers.parse_pages(exported, base_url="https://wiki.example/").select("id", "title", "url", "space_key", "body_text")


@query(
    "parse_eval_cases",
    """SELECT 'find ' || item_id AS query, CASE WHEN item_id % 3 = 0 THEN 'old-' || item_id WHEN item_id % 3 = 1 THEN 'src-' || item_id || ',both' ELSE '' END AS sources,
      CASE WHEN item_id % 2 = 0 THEN 'internal' ELSE '' END AS types, CASE WHEN item_id % 5 = 0 THEN 'bad' ELSE '' END AS forbidden FROM benchmark""",
)
def parse_eval_cases(spark, sf_dir):
    exported = _json_column(
        table(spark, sf_dir, "benchmark"), "value",
        """named_struct('query', concat('find ', item_id), 'must_retrieve', CASE WHEN item_id % 3 < 2 THEN array(concat('old-', item_id)) END,
        'expected_sources', CASE WHEN item_id % 3 = 1 THEN array(concat('src-', item_id), 'both') END,
        'expected_source_types', CASE WHEN item_id % 2 = 0 THEN array('internal') END, 'forbidden_sources', CASE WHEN item_id % 5 = 0 THEN array('bad') END)""",
    )
    out = catalogues.parse_eval_cases(exported)
    return out.select(
        "query", F.array_join("expected_sources", ",").alias("sources"), F.array_join("expected_source_types", ",").alias("types"),
        F.array_join("forbidden_sources", ",").alias("forbidden"),
    )


@query(
    "link_pages",
    """WITH inline AS (SELECT conv_id, conv_id % 50 AS page FROM conversations WHERE turn = 0),
    remote AS (SELECT conv_id, (conv_id + turn) % 60 AS page, turn FROM conversations),
    links AS (SELECT conv_id, page, 0 AS kind, 0 AS place FROM inline UNION ALL SELECT conv_id, page, 1, turn FROM remote),
    once AS (SELECT conv_id, page, kind, place FROM links QUALIFY row_number() OVER (PARTITION BY conv_id, page ORDER BY kind, place) = 1),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY kind, place, CAST(page AS VARCHAR)) - 1 AS position FROM once)
    SELECT 'ISS-' || conv_id AS issue_key, CAST(position AS INT) AS position, CAST(page_id AS VARCHAR) AS id, url FROM numbered JOIN pages ON page_id = page""",
)
def link_pages(spark, sf_dir):
    """Issues that name a page in their text, and remote links from every turn; some pages don't exist."""
    turns = table(spark, sf_dir, "conversations")
    key = F.concat(F.lit("ISS-"), F.col("conv_id").cast("string"))
    address = F.concat(F.lit("https://h.example/wiki/pages/"), (F.col("conv_id") % 50).cast("string"))
    issues_ = turns.where("turn = 0").select(
        key.alias("key"), F.concat(F.lit("see "), address, F.lit(".")).alias("description"), F.lit(None).cast("string").alias("acceptance_criteria"),
        F.array().cast("array<string>").alias("comments"),
    )
    target = F.concat(F.lit("https://confluence.example/x?pageId="), ((F.col("conv_id") + F.col("turn")) % 60).cast("string"))
    remote = turns.select(key.alias("issue_key"), F.col("turn").cast("int").alias("position"), target.alias("url"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), "url")
    return issues.link_pages(issues_, remote, pages).select("issue_key", "position", "id", "url")
