"""Redaction, chunking and document features on the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seclake.functions import documents as D
from seclake.functions import ids, redact
from seclake.functions.text import file_slug, truncate_middle, truncate_text, word_count
from seclake.operators import catalog, chunking, dedupe
from seclake.operators.issues import page_id, rich_text, wiki_urls
from seclake.plans import index as plans
from seclake.plans import snapshots
from seclake.queries.base import DOCS_SQL, SCOPE, docs, project, query, select_sql, table
from seclake.sources import captures, catalogues
from seclake.sources.sinks import redact_audit
from seclake.vocab import BARE_SECRETS, PII_PATTERNS, PREFIXED_SECRETS

# -- redaction ----------------------------------------------------------------------------


def _re2(pattern: str) -> str:
    return pattern.replace("(?iuU)", "(?i)").replace("(?iU)", "(?i)").replace("(?isu)", "(?is)").replace("(?U)", "").replace("'", "''")


def _secret_chain(column: str) -> str:
    sql = column
    for pattern, replacement, _ in PREFIXED_SECRETS:
        to = replacement.replace("$", "\\")
        sql = f"regexp_replace({sql}, '{_re2(pattern)}', '{to}', 'g')"
    for _, pattern, _ in BARE_SECRETS:
        sql = f"regexp_replace({sql}, '{_re2(pattern)}', '[REDACTED]', 'g')"
    return sql


def _pii_chain(column: str) -> str:
    sql = column
    for _, pattern in PII_PATTERNS:
        sql = f"regexp_replace({sql}, '{_re2(pattern)}', '[REDACTED:PII]', 'g')"
    return sql


@query("redact_secrets", f"SELECT doc_id, {_secret_chain('text')} AS text FROM documents")
def redact_secrets(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", redact.redact_secrets(F.col("text")).alias("text"))


_NOTES = {
    "event_id": "event_id",
    "note": (
        "concat('user ', CAST(user_id AS STRING), CASE event_type "
        "WHEN 'error' THEN concat(' used AKIA', lpad(CAST(event_id AS STRING), 16, '0'), ' on login') "
        "WHEN 'signup' THEN concat(' got glpat-', lpad(CAST(event_id AS STRING), 20, 'x')) "
        "WHEN 'view' THEN concat(' opened postgres://app:pw', CAST(event_id AS STRING), '@db/x now') "
        "WHEN 'click' THEN concat(' sent password=', CAST(event_id AS STRING), '; ok') "
        "ELSE concat(' said Authorization: Bearer t', CAST(event_id AS STRING), ', done') END)"
    ),
}
_NOTES_SQL = select_sql("events", _NOTES)


@query("redact_notes", f"WITH n AS ({_NOTES_SQL}) SELECT event_id, {_secret_chain('note')} AS note FROM n")
def redact_notes(spark, sf_dir):
    notes = project(table(spark, sf_dir, "events"), _NOTES)
    return notes.select("event_id", redact.redact(F.col("note")).alias("note"))


@query(
    "secret_matches",
    f"""WITH n AS ({_NOTES_SQL}), m AS (
      SELECT event_id, regexp_extract(note, 'AKIA[0-9A-Z]{{16}}') AS s, 'aws_access_key' AS kind FROM n
      UNION ALL SELECT event_id, regexp_extract(note, 'glpat-[A-Za-z0-9_-]{{20,}}'), 'gitlab_token' FROM n
      UNION ALL SELECT event_id, regexp_extract(note, 'postgres://[^ /@:]+:[^ /@]+@[^ ]+'), 'database_uri' FROM n)
    SELECT event_id, kind, s AS secret FROM m WHERE s <> ''""",
)
def secret_matches(spark, sf_dir):
    notes = project(table(spark, sf_dir, "events"), _NOTES)
    found = notes.select("event_id", F.explode(redact.find_secrets(F.col("note"))).alias("secret"))
    return found.select("event_id", redact.secret_kind(F.col("secret")).alias("kind"), "secret")


_TAGGED_URL = {
    "page_id": "page_id",
    "url": (
        "concat(regexp_extract(url, '^([^#]*)', 1), CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END, "
        "'token=', CAST(page_id AS STRING), '&z=', CAST(page_id % 7 AS STRING), "
        "regexp_extract(url, '^[^#]*(.*)$', 1))"
    ),
}


@query(
    "redact_url_secrets",
    f"""WITH u AS ({select_sql('pages', _TAGGED_URL)})
    SELECT page_id, regexp_replace(url, '([?&]token=)[^&#]*', '\\1%5BREDACTED%5D') AS url FROM u""",
)
def redact_url_secrets(spark, sf_dir):
    tagged = project(table(spark, sf_dir, "pages"), _TAGGED_URL)
    return tagged.select("page_id", redact.redact_url(F.col("url")).alias("url"))


@query(
    "mask_pii",
    f"""SELECT 'document' AS kind, doc_id AS id, 0 AS part, {_pii_chain('text')} AS text FROM documents
    UNION ALL SELECT 'turn', conv_id, turn, {_pii_chain('text')} FROM conversations""",
)
def mask_pii(spark, sf_dir):
    masked = redact.mask_pii(F.col("text")).alias("text")
    first = docs(spark, sf_dir).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("part"), masked)
    turns = table(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").alias("part"), masked)
    return first.unionByName(turns)


@query(
    "pii_counts",
    "SELECT lang, count(*) AS docs, "
    + ", ".join(
        f"CAST(sum(len(regexp_extract_all(text, '{_re2(p)}'))) AS BIGINT) AS n_{n}" for n, p in PII_PATTERNS
    )
    + " FROM documents GROUP BY lang",
)
def pii_counts(spark, sf_dir):
    counted = docs(spark, sf_dir).select("lang", *redact.pii_counts(F.col("text")))
    return counted.groupBy("lang").agg(
        F.count("*").alias("docs"), *[F.sum(f"n_{n}").alias(f"n_{n}") for n, _ in PII_PATTERNS]
    )


@query(
    "audit_redaction",
    f"""SELECT event_id, event_type AS event, '[REDACTED]' AS api_key, CAST(value AS STRING) AS amount,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS "timestamp",
    regexp_replace('password=' || event_id || '; ok', '(password=)[^;]+', '\\1[REDACTED]') AS note
    FROM events""",
)
def audit_redaction(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("event_type").alias("event"),
        F.create_map(
            F.lit("API_KEY"), F.col("props"),
            F.lit("amount"), F.col("value").cast("string"),
            F.lit("note"), F.concat(F.lit("password="), F.col("event_id").cast("string"), F.lit("; ok")),
        ).alias("payload"),
    )
    out = redact_audit(events)
    return out.select(
        "event_id", "event", F.col("payload")["API_KEY"].alias("api_key"), F.col("payload")["amount"].alias("amount"),
        F.col("payload")["note"].alias("note"), "timestamp",
    )


# -- chunking -------------------------------------------------------------------------------

_WORDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> '')"


def _windows_sql(source: str, keys: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"""SELECT {keys}, i AS chunk_index, array_to_string(list_slice(w, i * {step} + 1, i * {step} + {size}), ' ') AS chunk_text
    FROM (SELECT {keys}, w, unnest(range(CASE WHEN len(w) = 0 THEN 0 ELSE 1 + CAST(ceil(greatest(len(w) - {size}, 0) / {step}.0) AS INT) END)) AS i
          FROM (SELECT {keys}, {_WORDS.format('text')} AS w FROM {source}))"""


@query("word_windows", _windows_sql("documents", "doc_id", 350, 60))
def word_windows(spark, sf_dir):
    return chunking.word_windows(docs(spark, sf_dir).select("doc_id", "text"))


@query(
    "chunk_counts",
    f"""WITH c AS ({_windows_sql('documents', 'doc_id, lang', 50, 10)})
    SELECT lang, count(*) AS chunks, CAST(sum(length(chunk_text)) AS BIGINT) AS chars FROM c GROUP BY lang""",
)
def chunk_counts(spark, sf_dir):
    chunks = chunking.word_windows(docs(spark, sf_dir).select("doc_id", "lang", "text"), size=50, overlap=10)
    return chunks.groupBy("lang").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk_text")).alias("chars"))


# markdown made of the documents: the first word of each line becomes a heading
_MD_SQL = """SELECT doc_id, '# Doc ' || doc_id || chr(10) ||
  regexp_replace(regexp_replace(text, '\\n([^\\n ]{1,4}) ', chr(10) || '### \\1' || chr(10), 'g'),
                 '\\n([^\\n #]{5,}) ', chr(10) || '## \\1' || chr(10), 'g') AS md FROM documents"""


def _markdown(spark, sf_dir):
    text = F.regexp_replace("text", r"\n([^\n ]{1,4}) ", "\n### $1\n")
    text = F.regexp_replace(text, r"\n([^\n #]{5,}) ", "\n## $1\n")
    head = F.concat(F.lit("# Doc "), F.col("doc_id").cast("string"), F.lit("\n"))
    return docs(spark, sf_dir).select("doc_id", F.concat(head, text).alias("md"))


@query(
    "markdown_sections",
    f"""WITH md AS ({_MD_SQL}),
    ln AS (SELECT doc_id, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS n FROM md),
    hd AS (SELECT *, length(regexp_extract(trim(line), '^(#{{1,6}})\\s+(.+?)\\s*$', 1)) AS lv,
                  regexp_extract(trim(line), '^(#{{1,6}})\\s+(.+?)\\s*$', 2) AS title FROM ln),
    sec AS (SELECT *, sum(CASE WHEN lv > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS k FROM hd),
    heads AS (SELECT doc_id, k, title, k + least(0, min(lv - k) OVER (PARTITION BY doc_id ORDER BY k)) AS d FROM sec WHERE lv > 0),
    paths AS (SELECT doc_id, k, d,
        last_value(CASE WHEN d = 1 THEN title END IGNORE NULLS) OVER w AS a1,
        last_value(CASE WHEN d = 2 THEN title END IGNORE NULLS) OVER w AS a2,
        last_value(CASE WHEN d = 3 THEN title END IGNORE NULLS) OVER w AS a3
        FROM heads WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
    body AS (SELECT doc_id, k, string_agg(line, chr(10) ORDER BY n) AS t FROM sec GROUP BY doc_id, k)
    SELECT b.doc_id, CAST(row_number() OVER (PARTITION BY b.doc_id ORDER BY b.k) - 1 AS INT) AS section_no,
      CASE p.d WHEN 1 THEN a1 WHEN 2 THEN a1 || ' > ' || a2 ELSE a1 || ' > ' || a2 || ' > ' || a3 END AS section,
      regexp_replace(b.t, '^\\s+|\\s+$', '', 'g') AS section_text
    FROM body b JOIN paths p USING (doc_id, k)""",
)
def markdown_sections(spark, sf_dir):
    return chunking.markdown_sections(_markdown(spark, sf_dir), text="md")


_JSON = {
    "event_id": "event_id",
    "payload": (
        "CASE WHEN event_type = 'error' THEN concat('{', props) ELSE "
        "concat('{\"a\": ', props, ', \"b\": [', CAST(event_id AS STRING), ', ', CAST(user_id AS STRING), ']}') END"
    ),
}


@query(
    "json_chunks",
    f"""WITH j AS ({select_sql('events', {**_JSON, 'bad': "event_type = 'error'", 'props': 'props', 'user_id': 'user_id'})})
    SELECT event_id, 0 AS part_no, '' AS title, payload AS text, 'json_invalid' AS chunk_type FROM j WHERE bad
    UNION ALL SELECT event_id, 0, 'a', '{{' || chr(10) || '  ' || trim(props, '{{}}') || chr(10) || '}}', 'json' FROM j WHERE NOT bad
    UNION ALL SELECT event_id, 1, 'b', '[' || chr(10) || '  ' || event_id || ',' || chr(10) || '  ' || user_id || chr(10) || ']', 'json' FROM j WHERE NOT bad""",
)
def json_chunks(spark, sf_dir):
    source = project(table(spark, sf_dir, "events"), _JSON)
    return chunking.json_chunks(source, text="payload", max_words=5).select("event_id", "part_no", "title", "text", "chunk_type")


# tables and fences made of the documents: two words per cell, every third document fenced
_BLOCKS_SQL = """SELECT doc_id, 'Intro ' || doc_id || chr(10) || '```' || chr(10) || lang || chr(10) || '# x' || chr(10) || '```' || chr(10)
  || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || replace(text, chr(10), ' |' || chr(10) || '| ') || ' |' || chr(10) || 'End.' AS md,
  text, lang FROM documents"""


@query(
    "markdown_blocks",
    f"""WITH b AS ({_BLOCKS_SQL})
    SELECT doc_id, 0 AS block_no, 'prose' AS kind, 'Intro ' || doc_id AS text FROM b
    UNION ALL SELECT doc_id, 1, 'code', '```' || chr(10) || lang || chr(10) || '# x' || chr(10) || '```' FROM b
    UNION ALL SELECT doc_id, 2, 'table', '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || replace(text, chr(10), ' |' || chr(10) || '| ') || ' |' FROM b
    UNION ALL SELECT doc_id, 3, 'prose', 'End.' FROM b""",
)
def markdown_blocks(spark, sf_dir):
    head = F.concat(F.lit("Intro "), F.col("doc_id").cast("string"), F.lit("\n```\n"), "lang", F.lit("\n# x\n```\n"))
    rows = F.replace("text", F.lit("\n"), F.lit(" |\n| "))
    md = F.concat(head, F.lit("| a | b |\n|---|---|\n| "), rows, F.lit(" |\nEnd."))
    exploded = docs(spark, sf_dir).select("doc_id", F.posexplode(chunking.block_array(md)).alias("block_no", "_b"))
    return exploded.select("doc_id", "block_no", "_b.kind", "_b.text")


_ROWS_SQL = "string_split('| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || replace(text, chr(10), ' |' || chr(10) || '| ') || ' |', chr(10))"


@query(
    "table_chunks",
    f"""WITH RECURSIVE t AS (SELECT doc_id, {_ROWS_SQL} AS l FROM documents),
    r AS MATERIALIZED (SELECT doc_id, i - 2 AS n, l[i] AS line, len(list_filter(regexp_split_to_array(l[i], '\\s+'), lambda x: x <> '')) AS w
       FROM (SELECT doc_id, l, unnest(range(3, len(l) + 1)) AS i FROM t)),
    walk AS (SELECT doc_id, n, line, w + 6 AS used, 0 AS part FROM r WHERE n = 1
      UNION ALL SELECT r.doc_id, r.n, r.line, CASE WHEN k.used + r.w > 60 THEN 6 + r.w ELSE k.used + r.w END,
        CASE WHEN k.used + r.w > 60 THEN k.part + 1 ELSE k.part END FROM walk k JOIN r ON r.doc_id = k.doc_id AND r.n = k.n + 1)
    SELECT doc_id, part AS part_no, CAST(max(used) AS INT) AS words, md5('| a | b |' || chr(10) || '|---|---|' || chr(10) || string_agg(line, chr(10) ORDER BY n)) AS digest
    FROM walk GROUP BY doc_id, part""",
)
def table_chunks(spark, sf_dir):
    rows = F.concat(F.lit("| a | b |\n|---|---|\n| "), F.replace("text", F.lit("\n"), F.lit(" |\n| ")), F.lit(" |"))
    exploded = docs(spark, sf_dir).select("doc_id", F.posexplode(chunking.table_texts(rows, 60)).alias("part_no", "text"))
    return exploded.select("doc_id", "part_no", word_count(F.col("text")).alias("words"), F.md5("text").alias("digest"))


# documents are redacted before they are split
_SAFE_DOCS = f"(SELECT doc_id, {_secret_chain('text')} AS text FROM documents)"
_ROOT_ID = "unhex('6ba7b8119dad11d180b400c04fd430c8')"


def _uuid_sql(name: str) -> str:
    h = f"sha1({_ROOT_ID} || encode({name}))"
    return (
        f"substr({h},1,8) || '-' || substr({h},9,4) || '-5' || substr({h},14,3) || '-' || "
        f"translate(substr({h},17,1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h},18,3) || '-' || substr({h},21,12)"
    )


@query(
    "chunk_ids",
    f"""WITH d AS ({DOCS_SQL}),
    u AS (SELECT doc_id, chunk_text, min(chunk_index) AS at FROM ({_windows_sql(_SAFE_DOCS, 'doc_id', 350, 60)}) GROUP BY doc_id, chunk_text),
    w AS (SELECT d.path, CAST(row_number() OVER (PARTITION BY u.doc_id ORDER BY u.at) - 1 AS INT) AS chunk_index, u.chunk_text FROM u JOIN d USING (doc_id)),
    i AS (SELECT *, {_uuid_sql("'document:' || '2|local|acme|preprod|kb|' || path")} AS document_id FROM w)
    SELECT document_id, path AS source, chunk_index, sha256(chunk_text) AS text_hash,
      {_uuid_sql("'chunk:' || '2|' || document_id || '||' || sha256(chunk_text)")} AS chunk_id FROM i""",
)
def chunk_ids(spark, sf_dir):
    chunks = chunking.chunk_documents(docs(spark, sf_dir), scope=SCOPE, formats=())
    return chunks.select("document_id", "source", "chunk_index", F.sha2("text", 256).alias("text_hash"), "chunk_id")


@query(
    "index_report",
    f"""WITH d AS ({DOCS_SQL}),
    c AS (SELECT d.kind, count(DISTINCT w.chunk_text) AS n, count(*) AS made
          FROM ({_windows_sql(_SAFE_DOCS, 'doc_id', 350, 60)}) w JOIN d USING (doc_id) GROUP BY d.kind, d.doc_id),
    k AS (SELECT kind, sum(n) AS n FROM c GROUP BY kind HAVING sum(n) > 0)
    SELECT (SELECT count(*) FROM d) AS files_scanned, (SELECT count(*) FROM d) AS files_accepted,
      (SELECT CAST(sum(n) AS BIGINT) FROM c) AS chunks_created, (SELECT CAST(ceil(sum(n) / 32.0) AS BIGINT) FROM c) AS embedding_batches,
      (SELECT CAST(ceil(sum(n) / 32.0) AS BIGINT) FROM c) AS upsert_batches, CAST(0 AS BIGINT) AS chunks_truncated,
      (SELECT CAST(sum(made - n) AS BIGINT) FROM c) AS duplicate_chunks,
      (SELECT string_agg(kind || '=' || n, ',' ORDER BY kind) FROM k) AS source_types,
      (SELECT string_agg(lang || '=' || n, ',' ORDER BY lang) FROM (SELECT d.lang, sum(c.n) AS n FROM c JOIN d USING (doc_id) GROUP BY d.lang)) AS domains, 'v2' AS version""".replace("SELECT d.kind, count(DISTINCT", "SELECT d.doc_id, d.kind, count(DISTINCT"),
)
def index_report(spark, sf_dir):
    source = docs(spark, sf_dir)
    split = chunking.split_documents(source, formats=()).join(source.select("path", "lang"), "path")
    report = plans.index_report(split, source.select("path", F.lit("accepted").alias("disposition")), version="v2", domain=F.col("lang"))

    def entries(name):
        return F.array_join(F.transform(F.array_sort(F.map_entries(name)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")

    shown, domains = entries("source_type_distribution"), entries("security_domain_distribution")
    return report.select(
        "files_scanned", "files_accepted", "chunks_created", "embedding_batches", "upsert_batches",
        F.col("chunks_truncated").cast("bigint").alias("chunks_truncated"),
        F.col("duplicate_chunks").cast("bigint").alias("duplicate_chunks"), shown.alias("source_types"), domains.alias("domains"), "version",
    )


# parts as catalogue records in CSV and XML, pages as flows in JSON; some records are cut off
@query(
    "parse_catalog_csv",
    """SELECT p_partkey, p_partkey % 17 = 0 AS broken, CASE WHEN p_partkey % 17 > 0 THEN trim(p_name) END AS name,
      CASE WHEN p_partkey % 17 > 0 THEN 'a "' || p_brand || '", b' END AS brand FROM part""",
)
def parse_catalog_csv(spark, sf_dir):
    line = """concat(CASE WHEN p_partkey % 3 = 0 THEN decode(unhex('EFBBBF'), 'UTF-8') ELSE '' END, CAST(p_partkey AS STRING), ', ', p_name, ' ,"a ""', p_brand, '"", b"')"""
    lines = table(spark, sf_dir, "part").selectExpr("p_partkey", f"CASE WHEN p_partkey % 17 = 0 THEN substr({line}, 1, length({line}) - 1) ELSE {line} END AS value")
    found = catalogues.parse_catalog_csv(lines, ["\ufeff ID", "Name ", "Brand"])
    return found.select("p_partkey", "broken", F.col("record")["Name"].alias("name"), F.col("record")["Brand"].alias("brand"))


@query(
    "parse_catalog_xml",
    """SELECT p_partkey, p_partkey % 17 = 0 AS broken, CASE WHEN p_partkey % 17 > 0 THEN CAST(p_partkey AS VARCHAR) END AS id,
      CASE WHEN p_partkey % 17 > 0 THEN p_brand || ' & co' END AS name, CASE WHEN p_partkey % 17 > 0 THEN 'Some ' || p_name || ' text' END AS description FROM part""",
)
def parse_catalog_xml(spark, sf_dir):
    element = "concat('<Weakness ID=\"', CAST(p_partkey AS STRING), '\" Name=\"', p_brand, ' &amp; co\"><Description>Some <b>', p_name, '</b> text</Description></Weakness>')"
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"CASE WHEN p_partkey % 17 = 0 THEN substr({element}, 1, length({element}) - 8) ELSE {element} END AS value")
    found = catalogues.parse_catalog_xml(rows)
    return found.select("p_partkey", "broken", F.col("record")["ID"].alias("id"), F.col("record")["Name"].alias("name"), F.col("record")["Description"].alias("description"))


@query(
    "parse_flows",
    """SELECT page_id, page_id % 19 = 0 AS broken, CASE WHEN page_id % 19 > 0 THEN url END AS url, CASE WHEN page_id % 19 > 0 THEN html END AS response_body,
      CASE WHEN page_id % 19 > 0 THEN CAST(page_id AS BIGINT) END AS seq FROM pages""",
)
def parse_flows(spark, sf_dir):
    flow = F.to_json(F.struct(F.lit("c").alias("capture_id"), F.col("page_id").alias("seq"), "url", F.col("html").alias("response_body")))
    lines = table(spark, sf_dir, "pages").select("page_id", flow.alias("_j")).select("page_id", F.expr("CASE WHEN page_id % 19 = 0 THEN substr(_j, 1, length(_j) - 1) ELSE _j END AS value"))
    return captures.parse_flows(lines).select(
        "page_id", "broken", *[F.when(~F.col("broken"), F.col(c)).alias(c) for c in ("url", "response_body", "seq")]
    )


# two states of the documents: some are added, changed, emptied or removed in the second
_BEFORE = {"path": "concat('d', CAST(doc_id AS STRING))", "text": "text"}
_NOW = {"path": "concat('d', CAST(doc_id AS STRING))", "text": "CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 5 = 0 THEN concat(text, ' x') ELSE text END"}


@query(
    "snapshot_difference",
    f"""WITH a AS ({select_sql('documents', _BEFORE)} WHERE doc_id % 7 > 0), b AS ({select_sql('documents', _NOW)} WHERE doc_id % 11 > 0)
    SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.text = b.text THEN 'unchanged'
      WHEN b.text = '' THEN 'emptied' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.path = b.path""",
)
def snapshot_difference(spark, sf_dir):
    source = table(spark, sf_dir, "documents")
    before, now = project(source.where("doc_id % 7 > 0"), _BEFORE), project(source.where("doc_id % 11 > 0"), _NOW)
    return snapshots.snapshot_difference(snapshots.manifest_of(before), snapshots.manifest_of(now))


# -- features ---------------------------------------------------------------------------------


@query(
    "doc_title",
    """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents)
    SELECT doc_id, CASE WHEN len(ls) = 0 THEN CAST(doc_id AS STRING)
      WHEN starts_with(ls[1], '#') THEN coalesce(nullif(trim(ltrim(ls[1], '#')), ''), CAST(doc_id AS STRING))
      ELSE substr(ls[1], 1, 120) END AS title FROM l""",
)
def doc_title(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", D.doc_title(F.col("text"), F.col("path")).alias("title"))


@query(
    "source_type_priority",
    f"""WITH d AS ({DOCS_SQL}) SELECT doc_id, kind AS source_type, CAST(CASE kind WHEN 'internal' THEN 1.0 WHEN 'local' THEN 0.75
      WHEN 'mitre' THEN 0.65 WHEN 'owasp' THEN 0.6 WHEN 'portswigger' THEN 0.55 ELSE 0.5 END AS DOUBLE) AS source_priority FROM d""",
)
def source_type_priority(spark, sf_dir):
    path = F.col("path")
    return docs(spark, sf_dir).select("doc_id", D.source_type(path).alias("source_type"), D.source_priority(path).alias("source_priority"))


# areas named by frequent words of the corpus, next to real ones
AREAS = {"english": ["the", "with", "token"], "french": ["le", "avec", "dans"], "german": ["der", "und", "nicht"], "spanish": ["para", "los", "por"]}


def _area_sql() -> str:
    parts = [
        f"CASE WHEN list_has_any(t, [{', '.join(repr(w) for w in words)}]) THEN '{area}' END" for area, words in AREAS.items()
    ]
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), ',')"


@query(
    "control_areas",
    f"""WITH t AS (SELECT doc_id, regexp_split_to_array(replace(lower(text), '-', ' '), '\\s+') AS t FROM documents)
    SELECT doc_id, {_area_sql()} AS areas FROM t""",
)
def control_areas(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(D.control_areas(F.col("text"), AREAS), ",").alias("areas"))


@query(
    "dedupe_exact",
    """SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text""",
)
def dedupe_exact(spark, sf_dir):
    keyed = docs(spark, sf_dir).select("doc_id", ids.content_hash(F.col("text")).alias("chunk_id"), F.md5("text").alias("digest"))
    kept = dedupe.dedupe_chunks(keyed, ["doc_id"])
    copies = keyed.groupBy("chunk_id").agg(F.count("*").alias("copies"))
    return kept.join(copies, "chunk_id").select("digest", "doc_id", "copies")


@query(
    "dedupe_normalized",
    f"""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (
      PARTITION BY array_to_string({_WORDS.format('lower(text)')}, ' ') ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
)
def dedupe_normalized(spark, sf_dir):
    return dedupe.dedupe_normalized(docs(spark, sf_dir), "text", ["doc_id"]).select("doc_id", "lang")


@query(
    "chunk_cap",
    f"""WITH c AS ({_windows_sql('documents', 'doc_id', 50, 10)})
    SELECT doc_id, chunk_index, md5(chunk_text) AS digest FROM c
    WHERE chunk_index < 5""",
)
def chunk_cap(spark, sf_dir):
    chunks = chunking.word_windows(docs(spark, sf_dir).select("doc_id", "text"), size=50, overlap=10)
    slim = chunks.select("doc_id", "chunk_index", F.md5("chunk_text").alias("digest"))
    return dedupe.cap_chunks(slim, 5, ["chunk_index"], key="doc_id")


@query(
    "chunk_cap_counts",
    f"""WITH c AS ({_windows_sql('documents', 'doc_id', 50, 10)})
    SELECT doc_id, count(*) AS total, greatest(count(*) - 5, 0) AS dropped FROM c GROUP BY doc_id""",
)
def chunk_cap_counts(spark, sf_dir):
    chunks = chunking.word_windows(docs(spark, sf_dir).select("doc_id", "text"), size=50, overlap=10)
    return dedupe.count_over_cap(chunks, 5, "doc_id")


@query(
    "low_value_docs",
    """WITH p AS (SELECT page_id, url || chr(10) || CASE WHEN page_id % 2 = 0 THEN url || chr(10) || url ELSE 'text line' || chr(10) || 'more' END || repeat(' pad', CAST(page_id % 40 AS INT)) AS t FROM pages),
    l AS (SELECT page_id, t, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM p)
    SELECT page_id, (length(trim(t)) < 120 OR len(list_filter(ls, lambda x: starts_with(x, 'http://') OR starts_with(x, 'https://'))) / len(ls) > 0.6) AS low_value FROM l""",
)
def low_value_docs(spark, sf_dir):
    url = F.col("url")
    rest = F.when(F.col("page_id") % 2 == 0, F.concat(url, F.lit("\n"), url)).otherwise(F.lit("text line\nmore"))
    text = F.concat(url, F.lit("\n"), rest, F.repeat(F.lit(" pad"), (F.col("page_id") % 40).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", D.is_low_value(text, 120).alias("low_value"))


_MARKUP_SQL = (
    r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
    r"|<[a-z/](?:\"[^\"]*\"|''[^'']*''|[^''\">])*>|<[!?][^>]*>|[^<]+|<"
)
_ENTITY_SQL = "replace(replace(replace(replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


@query(
    "html_to_text",
    f"""WITH t AS (SELECT page_id, regexp_extract_all(html, '{_MARKUP_SQL}') AS toks FROM pages),
    n AS (SELECT page_id, list_filter(list_transform(toks, lambda x: CASE
        WHEN NOT starts_with(x, '<') OR x = '<' THEN trim({_ENTITY_SQL.format('x')}, chr(32) || chr(10) || chr(9) || chr(13))
        WHEN regexp_matches(x, '(?i)^<(?:p|br|li|tr|h[1-4])[\\s/>]') THEN chr(10)
        WHEN regexp_matches(x, '(?i)^<(?:script|style)\\b') THEN trim(regexp_replace(x, '(?is)^<[^>]*>|</(?:script|style)\\s*>$', '', 'g'))
        ELSE '' END), lambda x: x <> '') AS nodes FROM t)
    SELECT page_id, array_to_string(list_filter(list_transform(string_split(array_to_string(nodes, ' '), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM n""",
)
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", D.html_to_text(F.col("html")).alias("text"))


_LINKED = {
    "page_id": "page_id",
    "note": (
        "concat('Spec ', regexp_extract(url, '^([a-z]+://[^/]*)', 1), '/wiki/pages/', CAST(page_id AS STRING), '; see ', url, '), and ', "
        "regexp_extract(url, '^([a-z]+://[^/]*)', 1), '/confluence/x?a=1&pageId=', CAST(page_id + 1 AS STRING), '.')"
    ),
    "site": "regexp_extract(url, '^([a-z]+://[^/]*)', 1)",
}


@query(
    "url_extract",
    f"""WITH l AS ({select_sql('pages', _LINKED)})
    SELECT page_id, 0 AS link_no, site || '/wiki/pages/' || page_id AS url, CAST(page_id AS STRING) AS linked FROM l
    UNION ALL SELECT page_id, 1, site || '/confluence/x?a=1&pageId=' || (page_id + 1), CAST(page_id + 1 AS STRING) FROM l""",
)
def wiki_links(spark, sf_dir):
    notes = project(table(spark, sf_dir, "pages"), _LINKED)
    links = notes.select("page_id", F.posexplode(wiki_urls(F.col("note"))).alias("link_no", "url"))
    return links.withColumn("linked", page_id(F.col("url")))


_RICH = {
    "event_id": "event_id",
    "body": (
        "concat('{\"type\":\"doc\",\"content\":[{\"type\":\"paragraph\",\"content\":[{\"type\":\"text\",\"text\":\"', event_type, "
        "'\",\"marks\":[{\"type\":\"link\",\"attrs\":{\"href\":\"https://x.example/', CAST(event_id AS STRING), '\"}}]}]},"
        "{\"type\":\"text\",\"text\":\"u', CAST(user_id AS STRING), '\"}]}')"
    ),
}


@query(
    "rich_text",
    """SELECT event_id, 'https://x.example/' || event_id || chr(10) || event_type || chr(10) || chr(10) || chr(10) || 'u' || user_id AS text FROM events""",
)
def rich_text_query(spark, sf_dir):
    source = project(table(spark, sf_dir, "events"), _RICH)
    return source.select("event_id", rich_text(F.col("body")).alias("text"))


_MARKERS = ["que ", "the ", "der "]


@query(
    "acceptance_criteria",
    f"""SELECT conv_id, turn, CASE {' '.join(f"WHEN contains(lower(text), '{m}') THEN trim(substr(text, instr(lower(text), '{m}')), chr(32) || chr(10))" for m in _MARKERS)} END AS criteria FROM conversations""",
)
def acceptance_criteria(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", D.acceptance_criteria(F.col("text"), _MARKERS).alias("criteria")
    )


@query(
    "clean_markdown",
    """SELECT doc_id, '# Doc ' || doc_id || chr(10) || '## Keep ' || lang || chr(10) || trim(replace(text, chr(10), chr(10) || '- '), chr(32) || chr(10)) AS text FROM documents""",
)
def clean_markdown(spark, sf_dir):
    body = F.replace("text", F.lit("\n"), F.lit("\n- "))
    md = F.concat(
        F.lit("---\nid: x\n---\n# Doc "), F.col("doc_id").cast("string"), F.lit("\n![](a.png)\n## Social\ngone\n"),
        F.lit("<figure>x</figure>\n## Keep "), "lang", F.lit("\n"), body,
    )
    return docs(spark, sf_dir).select("doc_id", D.clean_markdown(D.strip_front_matter(md)).alias("text"))


@query(
    "truncation",
    """SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE rtrim(substr(text, 1, 400), chr(32) || chr(10)) || chr(10) || '[truncated]' END AS cut,
    CASE WHEN length(text) <= 900 THEN text ELSE rtrim(substr(text, 1, 520), chr(32) || chr(10)) || chr(10) || '[large prompt truncated to avoid LLM timeout]' || chr(10) || ltrim(right(text, 300), chr(32) || chr(10)) END AS middle
    FROM documents""",
)
def truncation(spark, sf_dir):
    text = F.col("text")
    return docs(spark, sf_dir).select("doc_id", truncate_text(text, 400).alias("cut"), truncate_middle(text, 900).alias("middle"))


# -- collections and catalogues -----------------------------------------------------------------

_COLLECTION = {
    "doc_id": "doc_id",
    "relative_path": (
        "concat(CASE doc_id % 5 WHEN 0 THEN 'pentesting-web/a/' WHEN 1 THEN 'forensics/' WHEN 2 THEN 'docs/Guide ' "
        "WHEN 3 THEN 'misc/oauth-' ELSE 'docs/notes_' END, lang, '-', CAST(doc_id AS STRING), '.md')"
    ),
    "text": "text",
}
_COLLECTION_SQL = select_sql("documents", _COLLECTION)


@query(
    "curated_selection",
    f"""WITH c AS ({_COLLECTION_SQL})
    SELECT doc_id, CASE WHEN starts_with(relative_path, 'forensics/') THEN 'excluded'
      WHEN NOT (starts_with(relative_path, 'pentesting-web/') OR contains(relative_path, 'oauth')) THEN 'not_allowed'
      WHEN length(trim(text, chr(32) || chr(10))) < 120 THEN 'too_short' ELSE 'accepted' END AS disposition FROM c""",
)
def curated_selection(spark, sf_dir):
    source = project(table(spark, sf_dir, "documents"), _COLLECTION).withColumn("relative_path", F.concat(F.lit("x/"), "relative_path"))
    return catalog.curated_dispositions(source).select("doc_id", "disposition")


@query("curated_chunks")
def curated_chunks(spark, sf_dir):
    source = project(table(spark, sf_dir, "documents"), _COLLECTION).withColumn("relative_path", F.concat(F.lit("x/"), "relative_path"))
    selected = catalog.select_by_globs(source)
    chunks = catalog.chunk_curated(selected, scope=SCOPE)
    return chunks.select("chunk_id", "document_path", "chunk_index", "security_domain", F.length("text").alias("chars"))


@query(
    "import_markdown",
    f"""WITH c AS ({_COLLECTION_SQL})
    SELECT relative_path, 'owasp-api/docs/' || lower(replace(regexp_replace(relative_path, '^docs/', ''), ' ', '-')) AS destination,
      md5('# ' || {{title}} || chr(10) || chr(10) || '- Source: OWASP API Security' || chr(10) || '- Upstream: https://github.com/OWASP/API-Security' || chr(10)
        || '- Upstream path: `' || relative_path || '`' || chr(10) || '- License: CC-BY-SA-4.0' || chr(10) || chr(10) || '## Imported Content' || chr(10) || chr(10)
        || trim(text, chr(32) || chr(10)) || chr(10)) AS digest
    FROM c WHERE starts_with(relative_path, 'docs/') AND len(regexp_extract_all(text, '[A-Za-z0-9_]+')) >= 20""".replace(
        "{title}",
        "(CASE WHEN contains(relative_path, 'Guide ') THEN 'Guide ' ELSE 'Notes ' END || upper(substr(regexp_extract(relative_path, '[ _]([a-z][a-z])-', 1), 1, 1)) "
        "|| substr(regexp_extract(relative_path, '[ _]([a-z][a-z])-', 1), 2) || ' ' || doc_id)",
    ),
)
def import_markdown(spark, sf_dir):
    source = project(table(spark, sf_dir, "documents"), _COLLECTION)
    return catalog.import_markdown(source, "owasp-api").select("relative_path", "destination", F.md5("text").alias("digest"))


@query(
    "import_report",
    f"""WITH c AS ({_COLLECTION_SQL}), s AS (SELECT (starts_with(relative_path, 'docs/') AND len(regexp_extract_all(text, '[A-Za-z0-9_]+')) >= 20) AS ok FROM c)
    SELECT 'owasp-api' AS source_kind, count(*) AS files_scanned, count(*) FILTER (ok) AS files_written, count(*) FILTER (NOT ok) AS files_skipped FROM s""",
)
def import_report(spark, sf_dir):
    source = project(table(spark, sf_dir, "documents"), _COLLECTION)
    return catalog.import_report(catalog.import_dispositions(source, "owasp-api"), "owasp-api").drop("warnings")


@query(
    "catalog_relevance",
    """SELECT CAST(p_partkey AS STRING) AS identifier, p_name AS name,
      'mitre-cwe/' || regexp_replace(lower(p_partkey || '-' || p_name), '[^a-z0-9._-]+', '-', 'g') || '.md' AS destination,
      '# MITRE CWE - ' || p_partkey || ': ' || p_name || chr(10) || chr(10) || '- Source: MITRE CWE' || chr(10) || '- Source ID: ' || p_partkey
        || chr(10) || chr(10) || '## Description' || chr(10) || chr(10) || p_type || ' ' || p_brand || chr(10) || chr(10)
        || '## Additional Fields' || chr(10) || chr(10) || '- Size: ' || p_size || chr(10) AS text
    FROM part WHERE contains(p_name, 'ring') OR contains(lower(p_type), 'promo') OR p_partkey IN (20, 22, 78, 79, 89, 200)""",
)
def catalog_relevance(spark, sf_dir):
    records = table(spark, sf_dir, "part").select(
        F.create_map(
            F.lit("ID"), F.col("p_partkey").cast("string"), F.lit("Name"), F.col("p_name"),
            F.lit("Description"), F.concat("p_type", F.lit("  "), "p_brand"), F.lit("Size"), F.col("p_size").cast("string"),
        ).alias("record")
    )
    found = catalog.relevant_records(records, ["ring", "promo"], ["20", "22", "78", "79", "89", "200"])
    return catalog.catalog_to_markdown(found, "MITRE CWE", "mitre-cwe")


@query(
    "file_slugs",
    """SELECT p_partkey, coalesce(nullif(trim(regexp_replace(regexp_replace(lower(trim(p_name || ' / ' || p_brand)), '[^a-z0-9._-]+', '-', 'g'), '-{2,}', '-', 'g'), '-._'), ''), 'item') AS slug FROM part""",
)
def file_slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", file_slug(F.concat("p_name", F.lit(" / "), "p_brand")).alias("slug"))


# -- index maintenance ----------------------------------------------------------------------------


def _index_rows(source, version: str):
    return source.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("#0")).alias("chunk_id"), F.col("doc_id").cast("string").alias("document_id"),
        F.lit(version).alias("version"), F.col("kind").alias("source_type"), F.lit("local").alias("source_name"),
        F.concat(F.lit("root-"), "lang").alias("index_root"),
        *[F.lit(v).alias(k) for k, v in SCOPE.items()],
    )


@query(
    "upsert_chunks",
    """SELECT doc_id || '#0' AS chunk_id, CASE WHEN lang <> 'en' THEN 'new' ELSE 'old' END AS version FROM documents""",
)
def upsert_chunks(spark, sf_dir):
    source = docs(spark, sf_dir)
    hostile = _index_rows(source.where("lang <> 'en'"), "new").withColumn("tenant_id", F.lit("other"))
    out = plans.upsert_chunks(_index_rows(source, "old"), hostile, SCOPE)
    return out.where("tenant_id = 'acme'").select("chunk_id", "version")


@query(
    "replace_documents",
    f"""WITH d AS ({DOCS_SQL})
    SELECT doc_id || '#0' AS chunk_id, CASE WHEN kind = 'internal' THEN 'new' ELSE 'old' END AS version FROM d WHERE kind <> 'mitre'""",
)
def replace_documents(spark, sf_dir):
    source = docs(spark, sf_dir)
    read = source.where("kind in ('internal', 'mitre')").select(F.col("doc_id").cast("string").alias("document_id"))
    new = _index_rows(source.where("kind = 'internal'"), "new")
    return plans.replace_documents(_index_rows(source, "old"), new, SCOPE, read, source_name="local").select("chunk_id", "version")


@query(
    "sync_root",
    f"""WITH d AS ({DOCS_SQL})
    SELECT doc_id || '#0' AS chunk_id, CASE WHEN lang = 'en' THEN 'new' ELSE 'old' END AS version FROM d WHERE lang <> 'en' OR kind <> 'mitre'""",
)
def sync_root(spark, sf_dir):
    source = docs(spark, sf_dir)
    new = _index_rows(source.where("lang = 'en' and kind <> 'mitre'"), "new")
    accepted = 1  # the guard's count; the refused form is covered by the tests
    return plans.sync_root(_index_rows(source, "old"), new, SCOPE, "root-en", accepted).select("chunk_id", "version")
