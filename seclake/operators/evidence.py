"""Quotable sources, citation checks, confidence and report rows.

Claims, citations and sources are tables keyed by ``claim_id`` and
``source_id``; many issues are handled in one job.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seclake.functions.http import url_path
from seclake.functions.redact import redact, redact_df
from seclake.functions.text import let, normalized, strip, truncate_text
from seclake.operators.dedupe import first_per_key
from seclake.vocab import (
    EVIDENCE_WEIGHTS,
    EXTERNAL_METHODOLOGY,
    METHOD_PATH_PATTERN,
    PARAGRAPH_BREAK,
    SCOPE_COLUMNS,
    SENTENCE_BREAK,
)

MIN_QUOTE_WORDS, MAX_QUOTE_CHARS = 5, 500


def _shortened(text: Column, limit: int | None) -> Column:
    return F.coalesce(text, F.lit("")) if limit is None else truncate_text(text, limit)


# -- issues ---------------------------------------------------------------------------


def normalize_issues(
    issues: DataFrame, issue_pages: DataFrame, pii_mode: str = "off", page_chars: int | None = None
) -> DataFrame:
    """Issue fields plus their linked pages (``issue_key`` + page columns), all redacted.

    Page texts are whole unless ``page_chars`` limits them.
    """
    pages = issue_pages.groupBy("issue_key").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "position", "id", "title", "url", "space_key",
                    _shortened(F.col("body_text"), page_chars).alias("body_text"),
                )
            )
        ).alias("confluence_pages")
    )
    page_type = "array<struct<id:string,title:string,url:string,space_key:string,body_text:string>>"
    joined = issues.join(pages, issues["key"] == pages["issue_key"], "left").select(
        "key", "summary", "description", "acceptance_criteria", "issue_type", "status", "priority",
        "labels", "components", "comments",
        F.coalesce(
            F.transform("confluence_pages", lambda p: p.dropFields("position")), F.array().cast(page_type)
        ).alias("confluence_pages"),
    )
    return redact_df(joined, pii_mode=pii_mode)


def issue_queries(
    issues: DataFrame,
    issue_pages: DataFrame,
    pii_mode: str = "off",
    vocabulary: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Retrieval queries per issue: the issue as JSON, then one per facet.

    Result: issue_key, query_no, query_text.
    """
    from seclake.operators.classify import facet_array

    pages = issue_pages.groupBy("issue_key").agg(
        F.sort_array(F.collect_list(F.struct("position", "title", F.col("body_text").alias("body")))).alias("_p")
    )
    joined = issues.join(pages, issues["key"] == pages["issue_key"], "left").withColumn(
        "_p", F.coalesce("_p", F.array().cast("array<struct<position:int,title:string,body:string>>"))
    )
    titles = F.transform("_p", lambda p: p["title"])
    empty = F.lit("")
    text = F.concat_ws(
        "\n",
        F.col("summary"),
        F.coalesce("description", empty),
        F.coalesce("acceptance_criteria", empty),
        F.array_join("labels", " "),
        F.array_join("components", " "),
        F.array_join("comments", " "),
        F.array_join(titles, " "),
        F.array_join(F.transform("_p", lambda p: p["body"]), " "),
    )
    payload = F.struct(
        "summary", "description", "acceptance_criteria", "labels", "components", "comments",
        titles.alias("confluence_titles"),
        F.transform("_p", lambda p: p["body"]).alias("confluence_excerpt"),
    )
    staged = joined.select(F.col("key").alias("issue_key"), payload.alias("payload"), redact(text, pii_mode).alias("text"))
    staged = redact_df(staged, ["payload"], pii_mode)
    options = {"vocabulary": vocabulary} if vocabulary else {}
    facets = F.transform(
        facet_array(F.col("text"), **options),
        lambda f: F.concat(F.lit("security facet "), f["type"], F.lit(": "), F.array_join(f["terms"], " ")),
    )
    queries = F.concat(F.array(_spaced_json("payload", staged.schema["payload"].dataType)), facets)
    return staged.select("issue_key", F.posexplode(queries).alias("query_no", "query_text"))


def _json_string(value: Column) -> Column:
    quoted = F.to_json(F.array(value))
    return F.substr(quoted, F.lit(2), F.length(quoted) - 2)


def _spaced_json(name: str, kind: T.StructType) -> Column:
    """JSON object with a blank after each comma and colon, nulls kept."""
    parts = []
    for field in kind.fields:
        value = F.col(f"{name}.{field.name}")
        if isinstance(field.dataType, T.ArrayType):
            shown = F.concat(F.lit("["), F.array_join(F.transform(value, _json_string), ", "), F.lit("]"))
        else:
            shown = _json_string(value)
        parts.append(F.concat(F.lit(f'"{field.name}": '), shown))
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def issue_signals(normalized: DataFrame, vocabulary: dict[str, list[str]] | None = None) -> DataFrame:
    """key, signal, keywords over the whole normalised issue, field names included."""
    from seclake.operators.classify import security_signals

    options = {"vocabulary": vocabulary} if vocabulary else {}
    text = F.to_json(F.struct(*normalized.columns), {"ignoreNullFields": "false"})
    return security_signals(normalized.select("key", text.alias("_json")), "_json", **options)


# -- sources --------------------------------------------------------------------------


def _issue_sources(issues: DataFrame) -> DataFrame:
    """issue_key, source_id, label, text, field for the four quotable issue parts."""
    fields = [
        ("summary", "summary", F.col("summary")),
        ("description", "description", F.coalesce("description", F.lit(""))),
        ("acceptance_criteria", "acceptance criteria", F.coalesce("acceptance_criteria", F.lit(""))),
        ("comments", "comments", F.array_join("comments", "\n")),
    ]
    parts = F.array(
        *[
            F.struct(F.lit(name).alias("field"), F.lit(f"Jira {label}").alias("label"), text.alias("text"))
            for name, label, text in fields
        ]
    )
    exploded = issues.select(F.col("key").alias("issue_key"), F.explode(parts).alias("_p"))
    return exploded.select(
        "issue_key",
        F.concat(F.lit("jira:"), "issue_key", F.lit(":"), "_p.field").alias("source_id"),
        F.col("_p.label").alias("label"),
        F.col("_p.text").alias("text"),
        F.col("_p.field").alias("field"),
    )


def source_catalog(
    issues: DataFrame,
    issue_pages: DataFrame | None = None,
    issue_flows: DataFrame | None = None,
    issue_chunks: DataFrame | None = None,
) -> DataFrame:
    """issue_key, source_id, label of everything that may be cited."""
    out = _issue_sources(issues).select("issue_key", "source_id", "label")
    if issue_pages is not None:
        out = out.unionByName(
            issue_pages.select("issue_key", F.concat(F.lit("confluence:"), "id").alias("source_id"), F.col("title").alias("label"))
        )
    if issue_flows is not None:
        label = F.concat(
            "method", F.lit(" "), "host", url_path(F.col("url")), F.lit(" (status "),
            F.coalesce(F.col("status_code").cast("string"), F.lit("None")), F.lit(")"),
        )
        out = out.unionByName(
            issue_flows.select("issue_key", F.concat(F.lit("traffic:"), "id").alias("source_id"), label.alias("label"))
        )
    if issue_chunks is not None:
        out = out.unionByName(
            issue_chunks.select(
                "issue_key", F.concat(F.lit("rag:"), "chunk_id").alias("source_id"),
                F.concat("source", F.lit(" - "), "title").alias("label"),
            )
        )
    return out.dropDuplicates(["issue_key", "source_id"])


def chunk_evidence_type(kind: Column, source: Column, template: Column) -> Column:
    real = ~F.coalesce(template, F.lit(False))
    return (
        F.when(kind == EXTERNAL_METHODOLOGY, "security_guidance")
        .when(F.contains(source, F.lit("past-findings")) & real, "past_finding")
        .when((kind == "internal") & real, "security_policy")
        .otherwise("security_guidance")
    )


def evidence_context(
    issues: DataFrame,
    issue_pages: DataFrame | None = None,
    issue_flows: DataFrame | None = None,
    issue_chunks: DataFrame | None = None,
    pii_mode: str = "off",
) -> DataFrame:
    """issue_key, source_id, text, evidence_type, is_template; text is redacted."""
    own = _issue_sources(issues)
    out = own.select(
        "issue_key", "source_id", "text",
        F.when(F.col("field") == "comments", "assumption").otherwise("business_requirement").alias("evidence_type"),
        F.lit(False).alias("is_template"),
    )
    fact, no_template = F.lit("system_fact").alias("evidence_type"), F.lit(False).alias("is_template")
    if issue_pages is not None:
        out = out.unionByName(
            issue_pages.select(
                "issue_key", F.concat(F.lit("confluence:"), "id").alias("source_id"),
                F.col("body_text").alias("text"), fact, no_template,
            )
        )
    if issue_flows is not None:
        out = out.unionByName(
            issue_flows.select(
                "issue_key", F.concat(F.lit("traffic:"), "id").alias("source_id"),
                render_flow().alias("text"), fact, no_template,
            )
        )
    if issue_chunks is not None:
        template = F.coalesce("is_template", F.lit(False))
        out = out.unionByName(
            issue_chunks.select(
                "issue_key", F.concat(F.lit("rag:"), "chunk_id").alias("source_id"), "text",
                chunk_evidence_type(F.coalesce("source_type", F.lit("local")), F.col("source"), template).alias("evidence_type"),
                template.alias("is_template"),
            )
        )
    return out.withColumn("text", redact(F.col("text"), pii_mode))


# -- flows as text ----------------------------------------------------------------------


def _indented(body: str) -> str:
    try:
        return json.dumps(json.loads(body), indent=2, ensure_ascii=False)
    except (ValueError, RecursionError):
        return body


def _pretty_json(body: Column) -> Column:
    """Indented JSON; anything that does not parse stays as it is.

    Quotes are checked against this text, so the layout is fixed; Spark prints
    another one.  Bodies that cannot be JSON never leave the JVM.
    """

    @F.pandas_udf(T.StringType())
    def indent(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda b: None if b is None else _indented(b))

    maybe = F.rlike(body, F.lit(r'^\s*[\[{"\-0-9tfnNI]'))
    return F.coalesce(indent(F.when(maybe, body)), body)


def render_flow(body_chars: int | None = None) -> Column:
    """Quotable text of a flow row: blank lines separate the citable paragraphs.

    Bodies are whole unless ``body_chars`` limits them.
    """

    def headers(name: str) -> Column:
        return F.transform(name, lambda h: F.concat(h["name"], F.lit(": "), h["value"]))

    def body(name: str, label: str) -> Column:
        shown = _shortened(_pretty_json(F.col(name)), body_chars)
        return F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit(f"{label}:\n"), shown))

    request = F.concat("method", F.lit(" "), "url", F.lit(" (host "), "host", F.lit(", scheme "), "scheme", F.lit(")"))
    status = F.concat(F.lit("HTTP status "), F.coalesce(F.col("status_code").cast("string"), F.lit("unknown")))
    return F.concat_ws(
        "\n\n",
        F.concat_ws("\n", request, headers("request_headers")),
        F.concat_ws("\n", status, headers("response_headers")),
        body("request_body", "Request body"),
        body("response_body", "Response body"),
    )


# -- quotes and citations -----------------------------------------------------------------


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, PARAGRAPH_BREAK), strip), lambda p: p != "")


def sentences(paragraph: Column) -> Column:
    return F.filter(F.transform(F.split(paragraph, SENTENCE_BREAK), strip), lambda s: s != "")


def segment_array(text: Column) -> Column:
    """Each paragraph followed by its sentences and lines."""
    return F.flatten(
        F.transform(paragraphs(text), lambda p: F.concat(F.array(p), sentences(p)))
    )


def segments(df: DataFrame, text: str = "text") -> DataFrame:
    kept = [c for c in df.columns if c != text]
    return df.select(*kept, F.posexplode(segment_array(F.col(text))).alias("segment_no", "segment"))


def quote_fits(quote: Column) -> Column:
    """Length rule of a normalised quote."""
    return (F.size(F.split(quote, " ")) >= MIN_QUOTE_WORDS) & (F.length(quote) <= MAX_QUOTE_CHARS) & (quote != "")


def _sources(context: DataFrame) -> DataFrame:
    """Source texts as normalised paragraphs.  Sentences lie inside their paragraph."""
    return context.select(
        "source_id", "evidence_type", "is_template",
        F.transform(paragraphs(F.col("text")), normalized).alias("_segments"),
    )


def _stands_in_source() -> Column:
    return F.exists("_segments", lambda s: F.contains(s, F.col("quote")))


def valid_quotes(citations: DataFrame, context: DataFrame) -> DataFrame:
    """Distinct (source_id, normalised quote) pairs whose quote stands in one segment.

    Repeated pairs collapse before the join with the texts.
    """
    # filtering inside the generator normalises each quote once
    fitting = F.filter(F.array(normalized(F.col("evidence_quote"))), quote_fits)
    quotes = citations.select("source_id", F.explode(fitting).alias("quote")).distinct()
    joined = quotes.join(_sources(context), "source_id")
    return joined.where(_stands_in_source()).select("source_id", "quote", "evidence_type", "is_template")


def validate_citations(citations: DataFrame, context: DataFrame) -> DataFrame:
    """Keep citations of known sources with valid quotes, once per claim.

    ``citations``: claim_id, pos, source_id, evidence_quote.  The evidence type
    is the source's, whatever the citation said.
    """
    keyed = citations.drop("evidence_type").withColumn("quote", normalized(F.col("evidence_quote")))
    # repeats go first: whether a quote is valid does not depend on the citation
    once = first_per_key(keyed, ["claim_id", "source_id", "quote"], ["pos"])
    sources = _sources(context)
    return once.join(sources, "source_id").where(quote_fits(F.col("quote")) & _stands_in_source()).drop("_segments")


def claim_evidence(valid: DataFrame) -> DataFrame:
    """One row per claim with valid citations: what its votes add up to, and ``supporting_evidence`` in order.

    Every source votes once, with its first valid citation.  One shuffle by claim
    serves both aggregates, and everything that is asked of a claim's evidence
    comes from this row.
    """
    item = F.struct("pos", "source_id", "evidence_quote", "evidence_type")
    by_source = valid.repartition("claim_id").groupBy("claim_id", "source_id").agg(
        F.min_by(F.struct("evidence_type", "is_template", "evidence_quote"), "pos").alias("_vote"), F.collect_list(item).alias("_items")
    )
    weight = F.lit(0)
    for kind, value in EVIDENCE_WEIGHTS.items():
        weight = F.when(F.col("_vote.evidence_type") == kind, F.lit(value)).otherwise(weight)
    return by_source.groupBy("claim_id").agg(
        F.sum(weight).alias("_weight"),
        F.sum(F.col("_vote.is_template").cast("int")).alias("_templates"),
        F.bool_or(F.rlike("_vote.evidence_quote", F.lit(METHOD_PATH_PATTERN))).alias("_endpoint"),
        *[F.count_if(F.col("_vote.evidence_type") == kind).alias(f"_n_{kind}") for kind in sorted(EVIDENCE_WEIGHTS)],
        F.sort_array(F.flatten(F.collect_list("_items"))).alias("supporting_evidence"),
    )


def rated_claims(claims: DataFrame, valid: DataFrame) -> DataFrame:
    """Columns of ``claims`` and ``score, confidence, confidence_reason, supporting_evidence`` (null without evidence)."""
    kinds = sorted(EVIDENCE_WEIGHTS)
    joined = claims.join(claim_evidence(valid), "claim_id", "left")
    assumed = F.size(F.coalesce("assumptions", F.array().cast("array<string>")))
    score = (
        F.coalesce("_weight", F.lit(0))
        - F.least(assumed, F.lit(2))
        - F.coalesce("_templates", F.lit(0))
        + F.coalesce("_endpoint", F.lit(False)).cast("int")
    )
    system = F.coalesce(F.col("_n_system_fact") + F.col("_n_business_requirement") > 0, F.lit(False))
    level = F.when((score >= 5) & system, "high").when(score >= 2, "medium").otherwise("low")
    counts = F.concat_ws(
        ", ",
        *[
            F.when(F.col(f"_n_{kind}") > 0, F.concat(F.lit(f"{kind}="), F.col(f"_n_{kind}").cast("string")))
            for kind in kinds
        ],
    )
    summary = F.when(counts == "", F.lit("no validated evidence")).otherwise(counts)
    reason = F.concat(
        F.lit("Deterministic evidence score "), score.cast("string"), F.lit("; "), summary,
        F.lit("; assumptions="), assumed.cast("string"), F.lit("."),
    )
    return joined.select(
        *claims.columns, score.cast("int").alias("score"), level.alias("confidence"), reason.alias("confidence_reason"), "supporting_evidence"
    )


def confidence(claims: DataFrame, valid: DataFrame) -> DataFrame:
    """Score, level and reason per claim.

    ``claims``: claim_id, assumptions.  A claim without evidence is low.
    """
    return rated_claims(claims, valid).drop("supporting_evidence")


def _warning() -> Column:
    label = F.when(F.col("kind") == "risk", "Risk hypothesis").otherwise("Test idea")
    return F.concat(label, F.lit(" has no valid citation: "), "title")


def citation_warnings(claims: DataFrame, valid: DataFrame) -> DataFrame:
    """One warning per claim (kind risk or test) that kept no citation."""
    bare = claims.join(valid.select("claim_id").distinct(), "claim_id", "left_anti")
    return bare.select("claim_id", "kind", _warning().alias("warning"))


# -- reports ------------------------------------------------------------------------------


def assemble_reports(
    briefs: DataFrame | None,
    claims: DataFrame,
    citations: DataFrame,
    retrieval: DataFrame,
    context: DataFrame,
    scope: dict[str, str],
    metadata: dict[str, str] | None = None,
) -> DataFrame:
    """One nested report per issue.

    ``briefs``: issue_key plus any brief columns, or None if ``claims`` names them
    all; ``claims``: issue_key, claim_id, kind, title, assumptions; ``retrieval``:
    issue_key, chunk_id, source, title, score, and optionally an error column
    ``rag_error`` on its issues (a row with a NULL chunk_id reports a failed search).

    Citations are checked against the texts once.  Claims with their evidence,
    retrieved chunks and briefs become rows of one form, and one aggregate by
    issue puts the reports together.
    """
    rated = rated_claims(claims, validate_citations(citations, context))
    bare = F.col("supporting_evidence").isNull()
    evidence_type = rated.schema["supporting_evidence"].dataType
    item = F.struct(
        "claim_id", "title", "confidence", "confidence_reason", "assumptions",
        F.coalesce("supporting_evidence", F.array().cast(evidence_type)).alias("supporting_evidence"),
    )
    rows = rated.select(
        "issue_key", F.when(F.col("kind") == "risk", item).alias("risk"),
        F.when(F.col("kind") == "test", item.dropFields("confidence", "confidence_reason")).alias("test"),
        F.when(bare, _warning()).alias("warning"),
    )
    if "rag_error" not in retrieval.columns:
        retrieval = retrieval.withColumn("rag_error", F.lit(None).cast("string"))
    ref = F.struct(
        (-F.col("score")).alias("_o"), "source", redact(F.col("title")).alias("title"), "score", "chunk_id"
    )
    found = retrieval.select("issue_key", F.when(F.col("chunk_id").isNotNull(), ref).alias("ref"), "rag_error", F.lit(True).alias("searched"))
    own = [c for c in briefs.columns if c != "issue_key"] if briefs is not None else []
    if briefs is not None:
        rows = rows.unionByName(briefs.select("issue_key", F.struct(F.lit(True).alias("_given"), *own).alias("brief")), allowMissingColumns=True)
    rows = rows.unionByName(found, allowMissingColumns=True)
    kept = F.max("brief") if briefs is not None else F.bool_or(F.col("risk").isNotNull() | F.col("test").isNotNull())
    whole = rows.groupBy("issue_key").agg(
        F.sort_array(F.collect_list("risk")).alias("risk_hypotheses"), F.sort_array(F.collect_list("test")).alias("test_ideas"),
        F.sort_array(F.collect_list("warning")).alias("citation_warnings"), F.sort_array(F.collect_list("ref")).alias("_s"),
        F.max("rag_error").alias("rag_error"), F.bool_or("searched").alias("_searched"), kept.alias("_kept"),
    )
    whole = whole.where("_kept._given" if briefs is not None else "_kept")
    status = (
        F.when(F.col("rag_error").isNotNull(), "failed")
        .when(F.size("_s") > 0, "ok")
        .otherwise("empty")
    )
    meta = {**(metadata or {}), **{name: scope[name] for name in SCOPE_COLUMNS}}
    return whole.select(
        "issue_key", *[F.col(f"_kept.{c}").alias(c) for c in own],
        "risk_hypotheses", "test_ideas", "citation_warnings",
        status.alias("rag_status"), "rag_error",
        F.when(F.col("_searched"), F.transform("_s", lambda s: s.dropFields("_o"))).alias("rag_sources"),
        F.struct(*[F.lit(v).alias(k) for k, v in meta.items()]).alias("analysis_metadata"),
    )


def prompt_metrics(
    issues: DataFrame, issue_pages: DataFrame, issue_flows: DataFrame, issue_chunks: DataFrame,
    page_chars: int | None = None,
) -> DataFrame:
    """Volumes per issue: page characters in total and sent, flows, chunks, sources."""
    keys = issues.select(F.col("key").alias("issue_key"))
    pages = issue_pages.groupBy("issue_key").agg(
        F.count("*").alias("confluence_pages"),
        F.sum(F.length("body_text")).alias("confluence_chars_total"),
        F.sum(F.least(F.length("body_text"), F.lit(page_chars))).alias("confluence_chars_sent"),
    )
    flows = issue_flows.groupBy("issue_key").agg(F.count("*").alias("http_flows"))
    chunks = issue_chunks.groupBy("issue_key").agg(
        F.count("*").alias("rag_chunks"), F.sum(F.length("text")).alias("rag_context_chars")
    )
    joined = keys
    for side in (pages, flows, chunks):
        joined = joined.join(side, "issue_key", "left")
    joined = joined.na.fill(0)
    entries = F.lit(4) + F.col("confluence_pages") + F.col("http_flows") + F.col("rag_chunks")
    return joined.withColumn("source_catalog_entries", entries)
