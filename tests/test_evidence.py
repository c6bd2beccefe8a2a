import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seclake.operators import evidence, responses
from seclake.operators.issues import link_pages, page_id, rich_text, unresolved_links, wiki_urls

CONTEXT = "source_id string, text string, evidence_type string, is_template boolean"
CITES = "claim_id string, pos int, source_id string, evidence_quote string, evidence_type string"
FACT = "The service accepts POST /transfers without a second approval. Limits apply.\n\nA second paragraph has five more words"


@pytest.fixture
def context(spark):
    rows = [
        ("jira:A:description", FACT, "business_requirement", False),
        ("rag:1", "Every transfer must have two approvers at all times", "security_policy", False),
        ("rag:2", "This template says nothing of real interest here", "security_guidance", True),
        ("jira:A:comments", "we think that this might be fine today", "assumption", False),
    ]
    return spark.createDataFrame(rows, CONTEXT)


def test_segments(value):
    got = value(evidence.segment_array, "One. Two!\nthree\n \nFour。 five")
    assert got == ["One. Two!\nthree", "One.", "Two!", "three", "Four。 five", "Four。", "five"]


def test_quote_rules(spark, context):
    quotes = [
        ("q1", 0, "jira:A:description", "accepts  post /transfers WITHOUT a", ""),
        ("q2", 0, "jira:A:description", "accepts POST /transfers without", ""),  # four words
        ("q3", 0, "jira:A:description", "Limits apply. A second paragraph has", ""),  # spans paragraphs
        ("q4", 0, "nowhere", "accepts post /transfers without a", ""),
        ("q5", 0, "jira:A:description", " ".join(["word"] * 200), ""),
    ]
    valid = evidence.validate_citations(spark.createDataFrame(quotes, CITES), context).collect()
    assert [r.claim_id for r in valid] == ["q1"]
    assert valid[0].evidence_type == "business_requirement"


def test_confidence_levels_and_reasons(spark, context):
    cites = spark.createDataFrame(
        [
            ("high", 0, "jira:A:description", "accepts POST /transfers without a second approval", ""),
            ("high", 1, "rag:1", "every transfer must have two approvers", ""),
            ("high", 2, "jira:A:description", "a second paragraph has five more", ""),  # one vote per source
            ("high", 3, "rag:1", "Every transfer must have  two approvers", ""),  # same quote again
            ("mid", 0, "rag:1", "every transfer must have two approvers", ""),
            ("low", 0, "rag:2", "says nothing of real interest here", ""),
        ],
        CITES,
    )
    claims = spark.createDataFrame(
        [("high", "risk", "H", []), ("mid", "risk", "M", []), ("low", "test", "L", ["a", "b", "c"]), ("bare", "test", "B", None)],
        "claim_id string, kind string, title string, assumptions array<string>",
    )
    valid = evidence.validate_citations(cites, context)
    assert valid.where("claim_id = 'high'").count() == 3
    rows = {r.claim_id: r for r in evidence.confidence(claims, valid).collect()}
    assert (rows["high"].score, rows["high"].confidence) == (5, "high")
    assert rows["high"].confidence_reason == (
        "Deterministic evidence score 5; business_requirement=1, security_policy=1; assumptions=0."
    )
    assert (rows["mid"].score, rows["mid"].confidence) == (2, "medium")
    assert (rows["low"].score, rows["low"].confidence) == (-3, "low")
    assert rows["bare"].confidence_reason == "Deterministic evidence score 0; no validated evidence; assumptions=0."
    warnings = [r.warning for r in evidence.citation_warnings(claims, valid).collect()]
    assert warnings == ["Test idea has no valid citation: B"]


def test_repeated_claims_of_one_hot_source(spark, context):
    cites = spark.range(500).select(
        F.col("id").cast("string").alias("claim_id"), F.lit(0).alias("pos"), F.lit("rag:1").alias("source_id"),
        F.lit("every transfer must have two approvers").alias("evidence_quote"), F.lit("").alias("evidence_type"),
    )
    assert evidence.validate_citations(cites, context).count() == 500
    assert evidence.valid_quotes(cites, context).count() == 1


ISSUE = (
    "key string, summary string, description string, acceptance_criteria string, issue_type string, status string, "
    "priority string, labels array<string>, components array<string>, comments array<string>"
)


@pytest.fixture
def issues(spark):
    rows = [
        ("A-1", "Pay", "See https://wiki.example/wiki/spaces/X/pages/11/T. role POST /pay/{id} token=abc", None, "Story", "Open", None,
         ["l"], [], ["again https://wiki.example/confluence?pageId=12)", "https://other.example/x"]),
        ("A-2", "Log", None, "AC: none", None, None, None, [], [], []),
    ]
    return spark.createDataFrame(rows, ISSUE)


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(
        [("11", "One", "u", "S", "first body " * 3), ("12", "Two", None, None, "second body")],
        "id string, title string, url string, space_key string, body_text string",
    )


def test_links_and_pages(spark, issues, pages):
    remote = spark.createDataFrame(
        [("A-1", 0, "https://wiki.example/wiki/x?pageId=11"), ("A-2", 0, "https://wiki.example/wiki/content/99"), ("A-2", 1, "https://no.example/pages/11")],
        "issue_key string, position int, url string",
    )
    linked = link_pages(issues, remote, pages).orderBy("issue_key", "position").collect()
    assert [(r.issue_key, r.id) for r in linked] == [("A-1", "11"), ("A-1", "12")]
    lost = unresolved_links(issues, remote, pages).collect()
    assert [(r.issue_key, r.id) for r in lost] == [("A-2", "99")]


def test_page_id_forms(value):
    assert value(page_id, "https://h/x/pages/5?pageId=%37") == "7"
    assert value(page_id, "https://h/rest/content/8/x") == "8"
    assert value(page_id, "https://h/pageId/9") == "9"
    assert value(page_id, "https://h/other") is None
    assert value(wiki_urls, "a https://h/wiki/1. https://h/wiki/1, https://h/z") == ["https://h/wiki/1"]


def test_rich_text_order(value):
    tree = {
        "type": "doc",
        "content": [
            {"type": "paragraph", "content": [{"type": "text", "text": "go", "marks": [{"type": "link", "attrs": {"href": "https://a"}}]}]},
            {"type": "inlineCard", "attrs": {"url": "https://b"}},
            {"type": "heading", "content": [{"type": "text", "text": "H"}]},
        ],
    }
    assert value(rich_text, json.dumps(tree)) == "https://a\ngo\n\n\nhttps://b\nH"
    assert value(rich_text, "plain {text") == "plain {text"
    assert value(rich_text, "true") == "true"


def test_normalized_issue_and_queries(spark, issues, pages):
    linked = pages.select(F.lit("A-1").alias("issue_key"), F.lit(0).alias("position"), "*")
    row = evidence.normalize_issues(issues, linked, page_chars=10).where("key = 'A-1'").first()
    assert "token=[REDACTED]" in row.description
    assert [p.body_text for p in row.confluence_pages] == ["first body\n[truncated]", "second bod\n[truncated]"]
    queries = evidence.issue_queries(issues, linked).where("issue_key = 'A-1'").orderBy("query_no").collect()
    payload = json.loads(queries[0].query_text)
    assert queries[0].query_text == json.dumps(payload, ensure_ascii=False)
    assert payload["acceptance_criteria"] is None and payload["confluence_titles"] == ["One", "Two"]
    assert queries[1].query_text.startswith("security facet authorization: role pageId POST /pay/{id}")
    signals = evidence.issue_signals(evidence.normalize_issues(issues, linked)).where("key = 'A-1'").collect()
    assert {s.signal for s in signals} >= {"authorization", "idor"}


def test_evidence_union_and_catalog(spark, issues, pages):
    linked = pages.select(F.lit("A-1").alias("issue_key"), F.lit(0).alias("position"), "*")
    chunks = spark.createDataFrame(
        [("A-1", "c1", "internal/past-findings/x.md", "t", "b", "internal", False),
         ("A-1", "c2", "internal/p.template.md", "t", "b", "internal", True),
         ("A-1", "c3", "internal/p.md", "t", "b", "internal", False),
         ("A-1", "c4", "curated:past-findings/x.md", "t", "b", "external_pentest_methodology", False)],
        "issue_key string, chunk_id string, source string, title string, text string, source_type string, is_template boolean",
    )
    rows = {r.source_id: r for r in evidence.evidence_context(issues, linked, None, chunks).where("issue_key = 'A-1'").collect()}
    assert rows["rag:c1"].evidence_type == "past_finding" and rows["rag:c2"].evidence_type == "security_guidance"
    assert rows["rag:c3"].evidence_type == "security_policy" and rows["rag:c4"].evidence_type == "security_guidance"
    assert rows["jira:A-1:comments"].evidence_type == "assumption" and rows["confluence:11"].evidence_type == "system_fact"
    labels = {r.source_id: r.label for r in evidence.source_catalog(issues, linked, None, chunks).collect()}
    assert labels["confluence:12"] == "Two" and labels["jira:A-2:summary"] == "Jira summary"


SCHEMA = T.StructType([T.StructField("a", T.StringType(), False), T.StructField("n", T.IntegerType())])


def _reply(message, **choice):
    return json.dumps({"choices": [{"message": message, **choice}]})


@pytest.mark.parametrize(
    "payload,expected",
    [
        (_reply({"content": '```json\n{"a": "x", "n": 1}\n```'}), ("x", 1)),
        (_reply({"content": 'text {"a": "b}\\"{", "n": 2} tail }'}), ('b}"{', 2)),
        (_reply({"content": [{"type": "text", "text": '{"a": '}, '"y"}']}), ("y", None)),
        (_reply({"content": None, "parsed": {"a": "z", "n": 4}}), ("z", 4)),
        (_reply({"content": "", "tool_calls": [{"function": {"arguments": '{"a": "t"'}}, {"function": {"arguments": "}"}}]}), ("t", None)),
        (_reply({"content": None, "reasoning": 'so {"a": "r"}'}), ("r", None)),
        (_reply({"content": None}, text='{"a": "c"}'), ("c", None)),
        (_reply({"content": {"text": '{"a": "d"}'}}), ("d", None)),
    ],
)
def test_model_responses(spark, payload, expected):
    row = responses.parse_responses(spark.createDataFrame([(payload,)], "payload string"), SCHEMA).first()
    assert row.reject_reason is None and (row.parsed.a, row.parsed.n) == expected


@pytest.mark.parametrize(
    "payload,reason",
    [
        (_reply({"content": None, "reasoning": "no object"}), "no text content"),
        (_reply({"content": ""}, finish_reason="length"), "token limit reached before any content"),
        (_reply({"content": '{"n": 3}'}), "missing fields: a"),
        (_reply({"content": "no json at all"}), "content does not match the schema"),
        ("oops", "payload is not JSON"),
    ],
)
def test_rejected_responses(spark, payload, reason):
    row = responses.parse_responses(spark.createDataFrame([(payload,)], "payload string"), SCHEMA).first()
    assert row.parsed is None and row.reject_reason == reason


def test_reports(spark, context, scope):
    claims = spark.createDataFrame(
        [("c1", "A", "risk", "R", []), ("c2", "A", "test", "T", []), ("c3", "B", "risk", "S", [])],
        "claim_id string, issue_key string, kind string, title string, assumptions array<string>",
    )
    cites = spark.createDataFrame([("c1", 0, "rag:1", "every transfer must have two approvers", "")], CITES)
    found = spark.createDataFrame(
        [("A", "k1", "s", "t", 0.2, None), ("A", "k2", "s", "t", 0.9, None), ("B", None, None, None, None, "timeout")],
        "issue_key string, chunk_id string, source string, title string, score double, rag_error string",
    )
    briefs = spark.createDataFrame([("A", "x"), ("B", "y"), ("C", "z")], "issue_key string, change_summary string")
    rows = {r.issue_key: r for r in evidence.assemble_reports(briefs, claims, cites, found, context, scope, {"model": "m"}).collect()}
    assert [s.chunk_id for s in rows["A"].rag_sources] == ["k2", "k1"] and rows["A"].rag_status == "ok"
    assert rows["A"].risk_hypotheses[0].supporting_evidence[0].source_id == "rag:1"
    assert rows["A"].citation_warnings == ["Test idea has no valid citation: T"]
    assert rows["B"].rag_status == "failed" and rows["C"].rag_status == "empty"
    assert rows["A"].analysis_metadata.model == "m" and rows["A"].analysis_metadata.environment == "preprod"


def test_the_registered_report_reads_documents_few_times(spark):
    """Claims, citations and their texts once each; the search reads vectors and texts of its index."""
    import __spark_entry__ as contract

    plan = contract.queries()["issue_reports"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("documents.parquet") <= 5


def test_reports_of_briefs_without_claims_and_failed_searches(spark, scope):
    claims = spark.createDataFrame([("I", 1, "risk", "R", ["a"]), ("I", 2, "test", "T", None), ("J", 3, "test", "U", [])], "issue_key string, claim_id long, kind string, title string, assumptions array<string>")
    briefs = spark.createDataFrame([("I", "first"), ("K", None)], "issue_key string, change_summary string")
    context = spark.createDataFrame([("s", "system_fact", False, "The login page keeps the session token.")], "source_id string, evidence_type string, is_template boolean, text string")
    citations = spark.createDataFrame([(1, 0, "s", "login page keeps the session token."), (1, 1, "s", "the login page keeps the session")], "claim_id long, pos int, source_id string, evidence_quote string")
    found = spark.createDataFrame([("I", 7, "d", "t", 0.5, None), ("K", None, None, None, None, "timeout")], "issue_key string, chunk_id long, source string, title string, score double, rag_error string")
    rows = {r.issue_key: r for r in evidence.assemble_reports(briefs, claims, citations, found, context, scope).collect()}
    assert set(rows) == {"I", "K"} and rows["I"].change_summary == "first" and rows["K"].change_summary is None
    assert [len(c.supporting_evidence) for c in rows["I"].risk_hypotheses] == [2] and rows["I"].citation_warnings == ["Test idea has no valid citation: T"]
    assert rows["I"].rag_status == "ok" and rows["K"].rag_status == "failed" and rows["K"].risk_hypotheses == []
    alone = {r.issue_key: r for r in evidence.assemble_reports(None, claims, citations, found, context, scope).collect()}
    assert set(alone) == {"I", "J"} and alone["J"].rag_status == "empty" and alone["J"].rag_sources is None
